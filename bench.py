"""Seconds per headline query: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.

Prints one JSON line. ``clean_python`` is the post cleaning chain as row-at-a-time Python
functions over the same texts, the way it would run without native expressions; it is
reported next to the native chain and is not part of the total.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import tempfile
import time
import unicodedata
from html.parser import HTMLParser
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from catalog import QUERIES  # noqa: E402
from catalog.registry import posts  # noqa: E402

HEADLINE = [
    "clean_posts", "clean_text", "remove_html_pages", "tokenize_words", "mail_prepare", "bag_of_words",
    "bow_bigram", "vocab_alphabetical", "build_vocab_first_seen", "tf_idf", "one_hot_tokens", "label_encode",
    "mean_vector", "topn_similar", "lemmatize", "lemmatize_built_in", "entity_spans", "extract_entities",
    "match_token_pattern", "subject_object_triples", "keyphrases_textrank", "keyphrases_sgrank",
    "keywords_ranked", "correct_spelling_frequency", "group_term_variants",
]


def page_text(page: str) -> str:
    nodes: list[str] = []
    hidden = ("script", "style")

    class Reader(HTMLParser):
        depth = 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag in hidden

        def handle_endtag(self, tag):
            if tag in hidden and self.depth:
                self.depth -= 1

        def handle_data(self, data):
            if not self.depth and data.strip():
                nodes.append(data.strip())

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    return " ".join(nodes)


def clean_in_python(text: str | None) -> str:
    """The cleaning chain one text at a time, with the standard library."""
    text = "NULL" if text is None else text
    text = re.sub(r"(http|https|ftp|ssh|sftp|www)://\S+", "", text)
    text = page_text(text)
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().replace("?", "")
    text = re.sub(r"[\t\r\n]", " ", text)
    text = re.sub(r"[a-z0-9+._-]+@[a-z0-9+._-]+\.[a-z0-9+_-]+", "", text).lower()
    text = text.replace("n't", " not").translate(str.maketrans("", "", string.punctuation))
    return re.sub(" +", " ", text)


def run(df) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillmill-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["row_count"](spark, sf_dir))  # starts the session's workers
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        started = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    clean_python = F.udf(clean_in_python, "string")("text")
    compared = {"clean_python": round(run(posts(spark, sf_dir).select("id", clean_python)), 3)}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "compared": compared,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
