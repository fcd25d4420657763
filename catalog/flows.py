"""Projections, filters, joins and counts, and the post and mail flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    CATEGORIES_SQL, DATED_SQL, MAILS_SQL, POSTS_SQL, categories, mails, posts, query, raw_posts, table,
)
from catalog.scalars import sql_clean, sql_words
from quillmill.functions import patterns as P
from quillmill.functions import text as X
from quillmill.operators import tables as R
from quillmill.plans.mails import date_mails, mail_prepare
from quillmill.plans.posts import clean_posts, select_posts
from quillmill.sources.writers import preview_rows, register_view

FLAG = "case when substr(text, 1, 2) = 'RT' then 'Y' else 'N' end"
FULL = f"""case when {FLAG} = 'Y' and rt_truncated then rt_full_text
  when {FLAG} = 'Y' and not rt_truncated then rt_text
  when {FLAG} <> 'Y' and truncated then full_text
  when {FLAG} <> 'Y' and not truncated then text end"""
SELECTED = f"""selected as (
  select distinct id, lang, created_at, source, user_id_str, user_name, user_location, user_description,
    {FULL} as tweet_text
  from posts where lang = 'en')"""
TWEET = "coalesce(tweet_text, 'NULL')"


@query(
    "clean_posts",
    f"""with {POSTS_SQL}, {SELECTED}
    select *, '[' || array_to_string({sql_words(TWEET, '#')}, ', ') || ']' as hashtag,
      '[' || array_to_string({sql_words(TWEET, '@')}, ', ') || ']' as mention,
      '[' || array_to_string(regexp_extract_all({TWEET}, '{P.EMAIL}', 1), ', ') || ']' as emails,
      {sql_clean(TWEET)} as clean_tweet_text
    from selected""",
)
def clean_posts_flow(spark, sf_dir):
    """The whole post flow: filter, full text, distinct, tags and cleaned text."""
    cleaned = clean_posts(select_posts(raw_posts(spark, sf_dir)))
    lists = {c: X.to_reference_string(c) for c in ("hashtag", "mention", "emails")}
    return cleaned.withColumns(lists)


@query("distinct_rows", f"with {POSTS_SQL}, {SELECTED} select * from selected")
def distinct_rows(spark, sf_dir):
    return select_posts(raw_posts(spark, sf_dir))


@query("project_columns", "select doc_id, lang, source from documents")
def project_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


@query(
    "project_nested",
    f"with {POSTS_SQL} select id, user_id_str, user_name, user_location, user_description, rt_text from posts",
)
def project_nested(spark, sf_dir):
    return raw_posts(spark, sf_dir).select(
        "id",
        F.col("user.id_str").alias("user_id_str"),
        F.col("user.name").alias("user_name"),
        F.col("user.location").alias("user_location"),
        F.col("user.description").alias("user_description"),
        F.col("retweeted_status.text").alias("rt_text"),
    )


@query(
    "project_json_field", "select event_id, json_extract_string(props, '$.k') as k from events"
)
def project_json_field(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("project_star_plus", "select *, upper(lang) as lang_upper from documents")
def project_star_plus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("*", F.upper("lang").alias("lang_upper"))


@query("add_column", "select *, mail_date as date_new from (select event_id, event_type as mail_date from events)")
def add_column(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    named = events.select("event_id", F.col("event_type").alias("mail_date"))
    return named.withColumn("date_new", F.col("mail_date"))


@query("rename_columns", "select doc_id as id, text as text_data from documents")
def rename_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").toDF("id", "text_data")


@query("drop_columns", "select doc_id, lang, source from documents")
def drop_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").drop("text", "n_chars")


@query("flag_prefix", f"with {POSTS_SQL} select id, {FLAG} as is_it_a_retweet from posts")
def flag_prefix(spark, sf_dir):
    flag = R.flag_prefix(F.col("text")).alias("is_it_a_retweet")
    return posts(spark, sf_dir).select("id", flag)


@query("pick_full_text", f"with {POSTS_SQL} select id, {FULL} as tweet_text from posts")
def pick_full_text(spark, sf_dir):
    text = R.pick_full_text(
        R.flag_prefix(F.col("text")),
        *[F.col(c) for c in ("rt_truncated", "rt_full_text", "rt_text", "truncated", "full_text", "text")],
    )
    return posts(spark, sf_dir).select("id", text.alias("tweet_text"))


def _filter(name, condition, where, view="posts", columns="id, text"):
    with_ = f"with {POSTS_SQL}" if view == "posts" else ""

    @query(name, f"{with_} select {columns} from {view} where {where}")
    def plan(spark, sf_dir):
        df = posts(spark, sf_dir) if view == "posts" else table(spark, sf_dir, view)
        return df.where(condition()).select(*columns.split(", "))


_filter("filter_equals", lambda: F.col("lang") == "en", "lang = 'en'")
_filter("filter_not_null", lambda: F.col("text").isNotNull(), "text is not null")
_filter("filter_by_id", lambda: F.col("id") == 42, "id = 42")
_filter("filter_id_list", lambda: F.col("id").isin(3, 33, 42, 133), "id in (3, 33, 42, 133)")
_filter("filter_contains", lambda: ~F.col("text").contains("@user3"), "not contains(text, '@user3')")
_filter("filter_contains_positive", lambda: F.col("text").contains("@user3"), "contains(text, '@user3')")
_filter("filter_contains_regex", lambda: F.col("text").rlike("@user[35] "), "regexp_matches(text, '@user[35] ')")
_filter(
    "filter_any_of",
    lambda: (F.col("source") == "src1") | (F.col("source") == "src2") | F.col("text").rlike("#tag(7|8) "),
    "source = 'src1' or source = 'src2' or regexp_matches(text, '#tag(7|8) ')",
)


@query(
    "filter_date_range",
    f"with {MAILS_SQL}, {DATED_SQL} select event_id, only_date from dated "
    "where only_date between '2024-01-02' and '2024-01-06'",
)
def filter_date_range(spark, sf_dir):
    dated = date_mails(mails(spark, sf_dir))
    kept = dated.where(F.col("only_Date").between("2024-01-02", "2024-01-06"))
    return kept.select("event_id", F.col("only_Date").alias("only_date"))


@query("fill_nulls", f"with {POSTS_SQL} select cast(id as varchar) as id, coalesce(text, 'na') as text from posts")
def fill_nulls(spark, sf_dir):
    return R.fill_nulls(posts(spark, sf_dir).select("id", "text"), "na")


@query("coalesce_text", f"with {POSTS_SQL} select id, coalesce(text, rt_text, full_text) as tweet from posts")
def coalesce_text(spark, sf_dir):
    return posts(spark, sf_dir).select("id", F.coalesce("text", "rt_text", "full_text").alias("tweet"))


LEFT_JOIN = f"""with {MAILS_SQL}, {DATED_SQL}, {CATEGORIES_SQL}
select event_id, domain, coalesce(case when domain_names is not null then coalesce(required, 'n') end, 'na')
  as required
from dated left join categories on domain = domain_names"""


@query("left_join_category", LEFT_JOIN)
def left_join_category(spark, sf_dir):
    dated = date_mails(mails(spark, sf_dir))
    joined = R.left_join_category(dated.select("event_id", "domain"), categories(dated))
    return joined.select(F.col("event_id").cast("bigint").alias("event_id"), "domain", "required")


@query(
    "mail_prepare",
    f"""with {MAILS_SQL}, {DATED_SQL}, {CATEGORIES_SQL}
    select cast(event_id as varchar) as event_id, mail_from as sender,
      '[me@example.com, ' || subject || ']' as receiver, subject,
      coalesce(strftime(datetime_ist, '%Y-%m-%d %H:%M:%S'), 'na') as datetime_ist,
      coalesce(only_date, 'na') as only_date, coalesce(only_time, 'na') as only_time, domain,
      coalesce(case when domain_names is not null then coalesce(required, 'n') end, 'na') as required
    from dated left join categories on domain = domain_names""",
)
def mail_prepare_flow(spark, sf_dir):
    raw = mails(spark, sf_dir)
    prepared = mail_prepare(raw, categories(date_mails(raw)))
    return prepared.select(
        "event_id",
        F.col("From").alias("sender"),
        F.col("To").alias("receiver"),
        F.col("Subject").alias("subject"),
        "datetime_ist",
        F.col("only_Date").alias("only_date"),
        "only_time",
        "domain",
        "required",
    )


@query("row_count", f"with {POSTS_SQL} select count(*) as n from posts")
def row_count(spark, sf_dir):
    return posts(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(
    "non_null_counts",
    f"with {POSTS_SQL} select count(id) as id, count(text) as text, count(rt_truncated) as rt_truncated from posts",
)
def non_null_counts(spark, sf_dir):
    return R.non_null_counts(posts(spark, sf_dir).select("id", "text", "rt_truncated"))


@query(
    "distinct_domains",
    f"with {MAILS_SQL}, {DATED_SQL} select distinct domain as domain_names from dated where only_date >= '2024-01-05'",
)
def distinct_domains(spark, sf_dir):
    return R.distinct_domains(date_mails(mails(spark, sf_dir)), "2024-01-05")


@query(
    "emails_by_year",
    f"with {MAILS_SQL}, {DATED_SQL} select cast(substr(only_date, 1, 4) as integer) as year, count(*) as n "
    "from dated where only_date is not null group by 1",
)
def emails_by_year(spark, sf_dir):
    return R.emails_by_year(date_mails(mails(spark, sf_dir)))


@query(
    "union_all",
    "select doc_id as id, text, lang from documents union all select item_id, text, null from benchmark",
)
def union_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.union_all([docs, items])


@query("drop_duplicates", "select distinct conv_id, role from conversations")
def drop_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "role").dropDuplicates()


@query("register_view", "select lang, count(*) as n from documents group by lang")
def registered_view(spark, sf_dir):
    register_view(table(spark, sf_dir, "documents"), "documents_view")
    return spark.sql("select lang, count(*) as n from documents_view group by lang")


@query("preview_rows", "select doc_id, text from documents order by doc_id limit 20")
def preview(spark, sf_dir):
    return preview_rows(table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id"), 20)
