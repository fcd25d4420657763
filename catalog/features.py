"""Vocabularies, bags of words, TF-IDF, one-hot tables and word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import dealt, query, table
from catalog.scalars import TOKENS_SQL, sql_quick
from quillmill.functions.tokens import tokenize_words
from quillmill.operators import features as FE
from quillmill.operators import vectors as V
from quillmill.operators.keyphrases import topn_per_document

TERMS = f"terms as (select doc_id, unnest({TOKENS_SQL}) as term from documents)"
BAG = f"{TERMS}, bag as (select doc_id, term, count(*) as count from terms group by all)"
BIGRAMS = f"""tokens as (select doc_id, {TOKENS_SQL} as t from documents),
bigrams as (select doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as term
  from tokens where len(t) > 1)"""
IDF = f"""{BAG}, idf as (select term, count(*) as df,
  ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from bag group by term)"""
QUICK = sql_quick("coalesce(text, 'NULL')")
FIRST_SEEN = f"""cut as (select doc_id, string_split({QUICK}, ' ') as words from documents),
seen as (select doc_id, unnest(words) as term, generate_subscripts(words, 1) as pos from cut),
firsts as (select term, min((doc_id, pos)) as place from seen group by term),
first_seen as (select term, row_number() over (order by place) as term_id from firsts)"""


def docs(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", "text")


@query("bag_of_words", f"with {BAG} select doc_id, term, count from bag")
def bag_of_words(spark, sf_dir):
    return FE.bag_of_words(docs(spark, sf_dir))


@query("bow_binary", f"with {BAG} select doc_id, term, 1 as count from bag")
def bow_binary(spark, sf_dir):
    return FE.bag_of_words(docs(spark, sf_dir), binary=True)


@query("bow_bigram", f"with {BIGRAMS} select doc_id, term, count(*) as count from bigrams group by all")
def bow_bigram(spark, sf_dir):
    return FE.bag_of_words(docs(spark, sf_dir), n=2)


ALPHABETICAL = "select term, row_number() over (order by term) - 1 as term_id from (select distinct term from bag)"


@query("vocab_alphabetical", f"with {BAG} {ALPHABETICAL}")
def vocab_alphabetical(spark, sf_dir):
    return FE.vocab_alphabetical(FE.bag_of_words(docs(spark, sf_dir)))


@query("vocab_sorted_by_id", f"with {BAG} {ALPHABETICAL} order by term_id")
def vocab_sorted_by_id(spark, sf_dir):
    return FE.vocab_sorted_by_id(FE.vocab_alphabetical(FE.bag_of_words(docs(spark, sf_dir))))


@query("build_vocab_first_seen", f"with {FIRST_SEEN} select term, term_id from first_seen")
def build_vocab_first_seen(spark, sf_dir):
    return FE.build_vocab_first_seen(docs(spark, sf_dir))


@query("vocab_size", f"with {BAG} select count(distinct term) as vocab_size from bag")
def vocab_size(spark, sf_dir):
    return FE.vocab_size(FE.bag_of_words(docs(spark, sf_dir)))


@query(
    "matrix_shape",
    f"with {BAG} select (select count(distinct doc_id) from documents) as docs, count(distinct term) as terms from bag",
)
def matrix_shape(spark, sf_dir):
    texts = docs(spark, sf_dir)
    return FE.matrix_shape(texts, FE.bag_of_words(texts))


# The vocabulary of the benchmark items is the fitted one; documents are the new texts.
FITTED = """fitted as (select term, row_number() over (order by term) - 1 as term_id from (
  select distinct unnest({tokens}) as term from benchmark))""".format(tokens=TOKENS_SQL)


def fitted_vocab(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return FE.vocab_alphabetical(FE.bag_of_words(items, id_col="item_id"))


@query(
    "bow_transform",
    f"with {BAG}, {FITTED} select doc_id, term_id, term, count from bag join fitted using (term)",
)
def bow_transform(spark, sf_dir):
    return FE.bow_transform(docs(spark, sf_dir), fitted_vocab(spark, sf_dir))


@query("document_frequency", f"with {IDF} select term, df from idf")
def document_frequency(spark, sf_dir):
    return FE.document_frequency(FE.bag_of_words(docs(spark, sf_dir)))


@query("idf_smooth", f"with {IDF} select term, df, round(idf, 6) as idf from idf")
def idf_smooth(spark, sf_dir):
    texts = docs(spark, sf_dir)
    idf = FE.idf_smooth(FE.bag_of_words(texts), FE.count_docs(texts))
    return idf.withColumn("idf", F.round("idf", 6))


@query(
    "tf_idf",
    f"""with {IDF}, weighted as (select doc_id, term, count * idf as weight from bag join idf using (term))
    select doc_id, term, round(weight / sqrt(sum(weight * weight) over (partition by doc_id)), 6) as tf_idf
    from weighted""",
)
def tf_idf(spark, sf_dir):
    return FE.tf_idf(docs(spark, sf_dir)).withColumn("tf_idf", F.round("tf_idf", 6))


# Columns of the twin, which needs them by name: every word that part names are made of (fixed by the data generator).
PART_WORDS = [
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring",
    "rod", "small", "widget",
]


@query(
    "dense_matrix",
    "with words as (select p_partkey, unnest(string_split(p_name, ' ')) as w from part) select p_partkey, "
    + ", ".join(f"count(*) filter (w = '{w}') as {w}" for w in PART_WORDS)
    + " from words group by p_partkey",
)
def dense_matrix(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    bag = FE.bag_of_words(parts, id_col="p_partkey")
    return FE.dense_matrix(parts, bag, None, "count", id_col="p_partkey")


@query(
    "dense_rows",
    """with words as (select p_partkey, unnest(string_split(p_name, ' ')) as w from part),
    vocab as (select distinct w from words),
    counted as (select p_partkey, w, count(*)::double as n from words group by all)
    select p.p_partkey, '[' || string_agg(cast(coalesce(n, 0)::int as varchar), ', ' order by v.w) || ']' as row_values
    from part p cross join vocab v left join counted c on c.p_partkey = p.p_partkey and c.w = v.w group by p.p_partkey""",
)
def dense_rows(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    bag = FE.bag_of_words(parts, id_col="p_partkey")
    rows = FE.dense_rows(parts, bag, FE.vocab_alphabetical(bag), "count", id_col="p_partkey")
    shown = F.array_join(F.transform("values", lambda x: x.cast("int").cast("string")), ", ")
    return rows.select("p_partkey", F.concat(F.lit("["), shown, F.lit("]")).alias("row_values"))


ONE_HOT = f"""with {FIRST_SEEN},
tokens as (select doc_id, list_filter(regexp_split_to_array({QUICK}, '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}]+'),
  lambda w: w <> '') as words from documents),
placed as (select doc_id, unnest(words) as term, generate_subscripts(words, 1) - 1 as pos from tokens)
select doc_id, pos, term, term_id from placed left join first_seen using (term)"""


@query("one_hot_tokens", ONE_HOT)
def one_hot_tokens(spark, sf_dir):
    texts = docs(spark, sf_dir)
    hot = FE.one_hot_tokens(texts, FE.build_vocab_first_seen(texts))
    return hot.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "label_encode",
    "select o_orderkey, o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as label_id from orders",
)
def label_encode(spark, sf_dir):
    return FE.label_encode(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])


# Columns of the twin, which needs them by name.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot_categories",
    "select c_custkey, " + ", ".join(f"cast(c_mktsegment = '{s}' as integer) as {s}" for s in SEGMENTS)
    + " from customer",
)
def one_hot_categories(spark, sf_dir):
    return FE.one_hot_categories(table(spark, sf_dir, "customer"), "c_mktsegment", None, ["c_custkey"])


@query(
    "topn_per_document",
    f"""with {BAG} select doc_id, term, count, rank from (
      select *, row_number() over (partition by doc_id order by count desc, term) as rank from bag)
    where rank <= 5""",
)
def topn(spark, sf_dir):
    bag = FE.bag_of_words(docs(spark, sf_dir))
    best = topn_per_document(bag, 5, term_col="term", score_col="count")
    return best.withColumn("rank", F.col("rank").cast("bigint"))


# --- word vectors -------------------------------------------------------------------
WORD_VECTORS = f"""{FITTED}, word_vectors as (
  select coalesce(term, 'w' || vec_id) as word, embedding as vector from embeddings left join fitted on term_id = vec_id)"""
SUMMARY = "round(list_extract(vector, 1), 6) as first, round(list_sum(vector::double[]), 6) as total"
DIM = 64


def word_vectors(spark, sf_dir):
    """All embeddings, named by the fitted vocabulary in its order, and by their ids beyond it."""
    vectors = table(spark, sf_dir, "embeddings")
    named = vectors.join(fitted_vocab(spark, sf_dir), F.col("term_id") == F.col("vec_id"), "left")
    word = F.coalesce("term", F.concat(F.lit("w"), F.col("vec_id").cast("string")))
    return named.select(word.alias("word"), F.col("embedding").alias("vector"))


def _summary(df, *columns):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select(
        *columns,
        F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"),
        F.round(total, 6).alias("total"),
    )


@query(
    "vector_lookup",
    f"with {WORD_VECTORS} select word, unnest(vector) as x, generate_subscripts(vector, 1) - 1 as i "
    "from word_vectors where word = 'and'",
)
def vector_lookup(spark, sf_dir):
    row = V.vector_lookup(word_vectors(spark, sf_dir), "and", strict=True)
    return row.select("word", F.posexplode("vector").alias("i", "x")).select(
        "word", "x", F.col("i").cast("bigint").alias("i")
    )


PLACED = f"""placed as (select doc_id, unnest({TOKENS_SQL}) as term, generate_subscripts({TOKENS_SQL}, 1) - 1 as pos
  from documents)"""


@query(
    "vectors_for_text",
    f"with {WORD_VECTORS}, {PLACED} select doc_id, pos, term, {SUMMARY.replace('list_extract(vector, 1)', 'list_extract(vector, 1)::double')} "
    "from placed left join word_vectors on term = word",
)
def vectors_for_text(spark, sf_dir):
    found = V.vectors_for_text(
        docs(spark, sf_dir), word_vectors(spark, sf_dir), tokenize_words("text")
    )
    return _summary(found, "doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query(
    "token_vector_or_zero",
    f"""with {WORD_VECTORS}, {PLACED} select doc_id, pos, term,
      round(coalesce(list_extract(vector, 1)::double, 0.0), 6) as first,
      round(coalesce(list_sum(vector::double[]), 0.0), 6) as total
    from placed left join word_vectors on term = word""",
)
def token_vector_or_zero(spark, sf_dir):
    found = V.vectors_for_text(docs(spark, sf_dir), word_vectors(spark, sf_dir), tokenize_words("text"))
    filled = V.token_vector_or_zero(found, DIM)
    return _summary(filled, "doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query(
    "mean_vector",
    f"""with {WORD_VECTORS}, {TERMS}, counted as (select doc_id, term, count(*) as n from terms group by all),
    sizes as (select doc_id, sum(n) as size from counted group by doc_id),
    cells as (select doc_id, n, unnest(vector)::double as x, generate_subscripts(vector, 1) - 1 as i
      from counted join word_vectors on term = word),
    sums as (select doc_id, i, sum(n * x) as total from cells group by all)
    select doc_id, i, round(coalesce(total, 0) / size, 6) as x
    from sizes cross join range({DIM}) as dims(i) left join sums using (doc_id, i)""",
)
def mean_vector(spark, sf_dir):
    mean = V.mean_vector(docs(spark, sf_dir), word_vectors(spark, sf_dir), tokenize_words("text"), DIM)
    return mean.select("doc_id", F.posexplode("vector").alias("i", "x")).select(
        "doc_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x")
    )


COSINE = "list_cosine_similarity(v.vector::double[], q.vector::double[])"


@query(
    "most_similar",
    f"""with {WORD_VECTORS} select v.word, round({COSINE}, 6) as similarity from word_vectors v, word_vectors q
    where q.word = 'and' and v.word <> 'and' order by {COSINE} desc, v.word limit 10""",
)
def most_similar(spark, sf_dir):
    found = V.most_similar(word_vectors(spark, sf_dir), "and", 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "topn_similar",
    f"""with {WORD_VECTORS}, pairs as (select q.word as query, v.word, {COSINE} as similarity
      from word_vectors v, word_vectors q where q.word in ('and', 'by', 'be') and v.word <> q.word),
    ranked as (select *, row_number() over (partition by query order by similarity desc, word) as rank from pairs)
    select query, word, round(similarity, 6) as similarity, rank from ranked where rank <= 5""",
)
def topn_similar(spark, sf_dir):
    found = V.topn_similar(word_vectors(spark, sf_dir), ["and", "by", "be"], 5)
    return found.select("query", "word", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))
