"""Readers and writers: each query writes a table it derives and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    CATEGORIES_SQL, DATED_SQL, MAILS_SQL, POSTS_SQL, categories, mails, query, raw_posts, table,
)
from quillmill.plans.mails import date_mails
from quillmill.plans.storage import new_path
from quillmill.sources import readers as IN
from quillmill.sources import writers as OUT

FLAT_POSTS = f"with {POSTS_SQL} select id, lang, text, truncated, user_name, rt_full_text from posts"


def _flat(df):
    return df.select(
        "id", "lang", "text", "truncated", F.col("user.name").alias("user_name"),
        F.col("retweeted_status.extended_tweet.full_text").alias("rt_full_text"),
    )


@query("scan_json_lines", FLAT_POSTS)
def scan_json_lines(spark, sf_dir):
    path = new_path(spark, "posts")
    OUT.sink_json(raw_posts(spark, sf_dir), path)
    return _flat(IN.scan_json_lines(spark, f"{path}/*.json"))


@query("sink_json", FLAT_POSTS)
def sink_json(spark, sf_dir):
    path = new_path(spark, "posts")
    OUT.sink_json(raw_posts(spark, sf_dir).drop("created_at", "source"), path)
    return _flat(IN.scan_json_lines(spark, path))


@query(
    "scan_json_lines_concat",
    "select doc_id as id, lang, text, null as role from documents union all "
    "select conv_id, null, text, role from conversations",
)
def scan_json_lines_concat(spark, sf_dir):
    first, second = new_path(spark, "documents"), new_path(spark, "conversations")
    docs = table(spark, sf_dir, "documents")
    turns = table(spark, sf_dir, "conversations")
    OUT.sink_json(docs.select(F.col("doc_id").alias("id"), "lang", "text"), first)
    OUT.sink_json(turns.select(F.col("conv_id").alias("id"), "text", "role"), second)
    return IN.scan_json_lines_concat(
        spark, [first, second], ["id bigint, lang string, text string", "id bigint, text string, role string"]
    )


MAIL_FIELDS = f"with {MAILS_SQL} select mail_from as sender, mail_date as date, subject from mails"


@query("scan_json_records", MAIL_FIELDS)
def scan_json_records(spark, sf_dir):
    """Files with one array of records each, as many as the mails have partitions."""
    path = new_path(spark, "mails")
    records = mails(spark, sf_dir).select(F.to_json(F.struct("From", "To", "Date", "Subject")).alias("value"))
    # one array per file, and a file for each partition of the events: no array outgrows one
    in_file = F.concat(F.lit("["), F.concat_ws(",", F.collect_list("value")), F.lit("]"))
    wrapped = records.groupBy(F.spark_partition_id().alias("file")).agg(in_file.alias("value"))
    wrapped.write.partitionBy("file").text(path)
    found = IN.scan_json_records(spark, path)
    return found.select(F.col("From").alias("sender"), F.col("Date").alias("date"), F.col("Subject").alias("subject"))


@query("sink_json_records", MAIL_FIELDS)
def sink_json_records(spark, sf_dir):
    path = new_path(spark, "mails")
    OUT.sink_json_records(mails(spark, sf_dir), path)
    found = IN.scan_json_lines(spark, path, IN.MAILS_RAW)
    return found.select(F.col("From").alias("sender"), F.col("Date").alias("date"), F.col("Subject").alias("subject"))


@query(
    "scan_text_lines",
    "select text_data from (select unnest(string_split(text, chr(10))) as text_data from documents) "
    "where length(trim(text_data)) > 0",
)
def scan_text_lines(spark, sf_dir):
    path = new_path(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return IN.scan_text_lines(spark, path)


@query("scan_whole_text", "select item_id, text || chr(10) as text_data from benchmark")
def scan_whole_text(spark, sf_dir):
    path = new_path(spark, "files")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    return IN.scan_whole_text(spark, path).select(F.col("item_id").cast("bigint").alias("item_id"), "text_data")


CATEGORY_ROWS = f"with {MAILS_SQL}, {DATED_SQL}, {CATEGORIES_SQL} select domain_names, required from categories"


@query("scan_category_csv", CATEGORY_ROWS)
def scan_category_csv(spark, sf_dir):
    path = new_path(spark, "domains")
    OUT.sink_csv(categories(date_mails(mails(spark, sf_dir))), path)
    return IN.scan_category_csv(spark, path)


@query("sink_csv", "select event_id, event_type, props from events")
def sink_csv(spark, sf_dir):
    path = new_path(spark, "events")
    OUT.sink_csv(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), path)
    schema = "event_id bigint, event_type string, props string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query(
    "scan_vectors",
    "select 'w' || vec_id as word, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings",
)
def scan_vectors(spark, sf_dir):
    """Vectors written as text lines and read back: every number survives."""
    path = new_path(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings")
    numbers = F.array_join(F.col("embedding").cast("array<string>"), " ")
    vectors.select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), numbers).alias("value")).write.text(path)
    found = IN.scan_vectors(spark, path, form="text")
    return found.select("word", F.posexplode("vector").alias("place", "x")).select(
        "word", "x", (F.col("place") + 1).cast("bigint").alias("i")
    )
