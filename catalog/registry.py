"""The register, the table loader and the views that both engines derive from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under an operator's name, with its SQL twin if it has one."""

    def register(plan):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for text work that is bound by CPU.

    A table that one file holds is one task; a table of more parts than cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- posts --------------------------------------------------------------------------
POST_TEXT = """case when blank then null else concat(
    case when doc_id % 3 = 0 then 'RT ' else '' end, '@user', doc_id % 7, ' ', text,
    ' Don{q}t miss Café <b>news</b> &amp; more caf&eacute; &#233;t&#xE9; &pound;5 &nosuch; &amp;lt; #tag', doc_id % 11, ' https://t.co/a', doc_id, ' 12.5',
    case when doc_id % 13 = 0 then concat(' <img alt="a > b" src=', repeat('x', 2500), '> end <b open ', repeat('y', 2500))
      else '' end) end"""
# Each 17th document gives a post without a text as well.
POST_ROWS = """select doc_id, text, lang, source, false as blank from {documents}
  union all select -1 - doc_id, text, lang, source, true from {documents} where doc_id % 17 = 0"""

POSTS = """
posts as (
  select doc_id as id, lang, concat('day ', doc_id % 31) as created_at, source, {text} as text,
    doc_id % 5 = 0 as truncated, concat(text, ' #full') as full_text,
    cast(doc_id % 97 as varchar) as user_id_str, concat('name ', doc_id % 13) as user_name,
    source as user_location, lang as user_description,
    concat(text, ' retweeted') as rt_text,
    case when doc_id % 19 = 0 then null else doc_id % 2 = 0 end as rt_truncated,
    concat(text, ' retweeted #full') as rt_full_text
  from ({rows}))
"""
POSTS_SQL = POSTS.format(text=POST_TEXT.format(q="''"), rows=POST_ROWS.format(documents="documents"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat posts derived from ``documents``."""
    text = POST_TEXT.format(q="\\'")
    rows = spark.sql(POST_ROWS.format(documents="{documents}"), documents=dealt(table(spark, sf_dir, "documents")))
    return rows.selectExpr(
        "doc_id as id",
        "lang",
        "concat('day ', doc_id % 31) as created_at",
        "source",
        f"{text} as text",
        "doc_id % 5 = 0 as truncated",
        "concat(text, ' #full') as full_text",
        "cast(doc_id % 97 as string) as user_id_str",
        "concat('name ', doc_id % 13) as user_name",
        "source as user_location",
        "lang as user_description",
        "concat(text, ' retweeted') as rt_text",
        "case when doc_id % 19 = 0 then null else doc_id % 2 = 0 end as rt_truncated",
        "concat(text, ' retweeted #full') as rt_full_text",
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts in the nested shape in which they arrive."""
    return posts(spark, sf_dir).selectExpr(
        "id", "lang", "created_at", "source", "text", "truncated",
        "struct(full_text) as extended_tweet",
        "struct(user_id_str as id_str, user_name as name, user_location as location, "
        "user_description as description) as user",
        "struct(rt_text as text, rt_truncated as truncated, struct(rt_full_text as full_text) "
        "as extended_tweet) as retweeted_status",
    )


# --- mails --------------------------------------------------------------------------
MAIL_SHAPE = """
  event_id,
  concat('user', user_id, case when event_id % 10 = 0 then '' else concat('@', event_type, '.example.com') end)
    as mail_from,
  case when event_id % 4 = 0 then concat({a}, ' -0300 (GMT+3)') when event_id % 4 = 1 then concat({a}, ' +0530')
       when event_id % 16 = 2 then concat({a}, ' -0800 (PST)') when event_id % 16 = 6 then concat({h}, ' +0530 (IST)')
       when event_id % 16 = 10 then concat({y}, ' +0000 (UTC)')
       when event_id % 4 = 2 then concat({b}, ' GMT') when event_id % 8 = 3 then concat({a}, ' o{q}clock GMT+1')
       else 'junk' end as mail_date,
  event_type as subject
"""
MAILS_SQL = (
    "mails as (select "
    + MAIL_SHAPE.format(
        a="strftime(ts, '%a, %-d %b %Y %H:%M:%S')", b="strftime(ts, '%a %b %-d %H:%M:%S %Y')",
        h="strftime(ts, '%a, %-d %b %Y %-H:%M:%S')", y="strftime(ts, '%a, %-d %b %y %H:%M:%S')", q="''"
    )
    + " from events)"
)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mails derived from ``events``: event_id, From, To, Date, Subject."""
    shape = MAIL_SHAPE.format(
        a="date_format(ts, 'EEE, d MMM yyyy HH:mm:ss')",
        b="date_format(ts, 'EEE MMM d HH:mm:ss yyyy')",
        h="date_format(ts, 'EEE, d MMM yyyy H:mm:ss')",
        y="date_format(ts, 'EEE, d MMM yy HH:mm:ss')",
        q="\\'",
    )
    table(spark, sf_dir, "events").createOrReplaceTempView("mail_events")
    return spark.sql(f"select {shape} from mail_events").select(
        "event_id",
        F.col("mail_from").alias("From"),
        F.array(F.lit("me@example.com"), F.col("subject")).alias("To"),
        F.col("mail_date").alias("Date"),
        F.col("subject").alias("Subject"),
    )


# Twin of the parsed date, and of the Indian time (half-hour zone without daylight saving).
STRIPPED_SQL = (
    "regexp_replace(regexp_replace(mail_date, '\\(GMT.*\\)', '', 'g'), 'o''clock GMT.*', 'GMT', 'g')"
)
BARE_SQL = f"regexp_replace({STRIPPED_SQL}, ' *\\([A-Z]+\\)$', '')"
UTC_SQL = f"""coalesce(
  try_strptime(trim({BARE_SQL}), '%a, %-d %b %y %H:%M:%S %z') at time zone 'UTC',
  try_strptime(trim({BARE_SQL}), '%a, %-d %b %Y %H:%M:%S %z') at time zone 'UTC',
  try_strptime(trim(replace({STRIPPED_SQL}, ' GMT', '')), '%a, %-d %b %Y %H:%M:%S'),
  try_strptime(trim(replace({STRIPPED_SQL}, ' GMT', '')), '%a %b %-d %H:%M:%S %Y'))"""
DATED_SQL = f"""
dated as (
  select *, india as datetime_ist, strftime(india, '%Y-%m-%d') as only_date,
    strftime(india, '%H:%M:%S') as only_time, list_extract(string_split(mail_from, '@'), -1) as domain
  from (select *, utc + interval 330 minute as india from (select *, {UTC_SQL} as utc from mails)))
"""
CATEGORIES_SQL = """
categories as (
  select distinct domain as domain_names,
    case when length(domain) % 3 = 0 then null else concat('label ', length(domain) % 5) end as required
  from dated where only_date >= '2018-01-01')
"""


def categories(dated: DataFrame) -> DataFrame:
    """The labelled domains of dated mails."""
    size = F.length("domain_names")
    return (
        dated.where(F.col("only_Date") >= "2018-01-01")
        .select(F.col("domain").alias("domain_names"))
        .distinct()
        .withColumn(
            "required", F.when(size % 3 != 0, F.concat(F.lit("label "), (size % 5).cast("string")))
        )
    )


def quoted(text: str) -> str:
    """A SQL string literal for the twin."""
    return "'" + text.replace("'", "''") + "'"
