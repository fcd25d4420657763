"""The post flow: raw posts to cleaned, lemmatised and corrected posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import patterns as P
from quillmill.functions import text as X
from quillmill.functions.tokens import split_words
from quillmill.operators.lexicon import lemma_text
from quillmill.operators.spelling import correct_by_join, corrections, spelled_words, word_counts
from quillmill.operators.tables import flag_prefix, pick_full_text
from quillmill.plans.storage import cut_lineage


def select_posts(raw: DataFrame, lang: str = "en") -> DataFrame:
    """Distinct posts of one language with their metadata and full text."""
    retweet = F.col("retweeted_status")
    full_text = pick_full_text(
        F.col("is_it_a_retweet"),
        retweet["truncated"],
        retweet["extended_tweet"]["full_text"],
        retweet["text"],
        F.col("truncated"),
        F.col("extended_tweet.full_text"),
        F.col("text"),
    )
    return (
        raw.where(F.col("lang") == lang)
        .withColumn("is_it_a_retweet", flag_prefix(F.col("text")))
        .select(
            "id",
            "lang",
            "created_at",
            "source",
            F.col("user.id_str").alias("user_id_str"),
            F.col("user.name").alias("user_name"),
            F.col("user.location").alias("user_location"),
            F.col("user.description").alias("user_description"),
            full_text.alias("tweet_text"),
        )
        .distinct()
    )


def clean_posts(posts: DataFrame, null_token: str | None = P.NULL_TOKEN) -> DataFrame:
    """Hashtags, mentions, addresses and the cleaned text of each post.

    A missing text reads as ``null_token``; with ``null_token=None`` its post is left out. That
    is tested on the text itself: a filter on the cleaned text would clean every text twice.
    """
    if null_token is None:
        posts = posts.where(F.col("tweet_text").isNotNull())
    return posts.select(
        "*",
        X.get_hashtag("tweet_text", null_token).alias("hashtag"),
        X.get_mention("tweet_text", null_token).alias("mention"),
        X.get_email_address("tweet_text", null_token).alias("emails"),
        X.clean_text("tweet_text", null_token).alias("clean_tweet_text"),
    )


def enrich_posts(
    cleaned: DataFrame,
    dictionary: DataFrame,
    methods: tuple[str, ...] = ("similarity", "frequency"),
    text_col: str = "clean_tweet_text",
) -> DataFrame:
    """Cleaned posts with their lemmas, the corrected text by each method, and its lemmas.

    Columns ``<text>_lemma``, ``spell_<method>`` and ``spell_<method>_lemma``. The cleaned
    posts are written once, under a row number of their own as ids may repeat, and their
    words counted once for all methods. Corrections that are small are made inside the rows.
    ``dictionary`` is (word, freq).
    """
    numbered = cut_lineage(cleaned.withColumn("_row", F.monotonically_increasing_id()))
    text = F.coalesce(F.col(text_col), F.lit(P.NULL_TOKEN))
    texts = numbered.select("_row", text.alias("text"))
    listed = cut_lineage(dictionary.select("word", "freq"))
    counts = cut_lineage(word_counts(texts))
    found = numbered.withColumn(f"{text_col}_lemma", lemma_text(F.col(text_col)))
    for method in methods:
        corrected = corrections(counts, listed, method)
        spell = spelled_words(corrected)
        if spell is None:
            joined = correct_by_join(texts, corrected, counts, "_row")
            found = found.join(joined.withColumnRenamed("corrected", f"spell_{method}"), "_row", "left")
        else:
            found = found.withColumn("_words", split_words(text))
            found = found.withColumn(f"spell_{method}", F.array_join(spell(F.col("_words")), " ")).drop("_words")
        found = found.withColumn(f"spell_{method}_lemma", lemma_text(F.col(f"spell_{method}")))
    return found.drop("_row")
