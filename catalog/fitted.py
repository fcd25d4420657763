"""Fitted models, sketches, posts of unlike shapes, other scripts, and word tables from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.corpus import ENTITY_MAPS, FOUND, NOUN_MAPS, _map_text, clean_docs, gazetteer, tags
from catalog.features import IDF, docs
from catalog.registry import dealt, query, quoted, table
from catalog.scalars import TOKENS_SQL
from quillmill.functions import scripts as SC
from quillmill.functions.tokens import tokenize_words
from quillmill.operators import sketches as SK
from quillmill.operators import tagging as TG
from quillmill.operators.sqllookups import register_lookups
from quillmill.operators.vectorizers import TextVectorizer, TextVectorizerModel, model_path
from quillmill.plans.storage import new_path
from quillmill.sources import variants as VA
from quillmill.sources import writers as OUT

# --- tags by context ----------------------------------------------------------------
# Annotations of the documents' words, by the word and the one before it (test values): one form has several tags.
TAG_RULE = """case when before is null then case when length(form) % 2 = 0 then 'PROPN' else 'DET' end
  when length(before) <= 3 then case when length(form) > 3 then 'NOUN' else 'ADP' end
  when length(form) % 3 = 0 then 'VERB' when length(form) <= 3 then 'DET' else 'NOUN' end"""
LINE_TOKENS = TOKENS_SQL.replace("text", "line")
ANNOTATED = f"""lines as (select doc_id, s, x[s] as line from (
  select doc_id, x, unnest(generate_series(1, len(x))) as s from (
    select doc_id, regexp_split_to_array(text, '[.!?\\n]+') as x from documents where text is not null))),
placed as materialized (select doc_id, s - 1 as sentence, unnest({LINE_TOKENS}) as form,
  generate_subscripts({LINE_TOKENS}, 1) - 1 as pos from lines),
annotated as materialized (select *, {TAG_RULE} as tag from (
  select *, lag(form) over (partition by doc_id, sentence order by pos) as before from placed))"""
TAG_MODEL = f"""{ANNOTATED},
tags as materialized (select tag, count(*) as n, row_number() over (order by tag) as t from annotated group by tag),
counted as materialized (select form, tag, count(*) as n from annotated group by all),
sizes as (select count(distinct form) as forms, (select count(*) from tags) as n_tags from counted),
emitted as materialized (select form, list(cast(round(ln((coalesce(c.n, 0) + 1) / (t.n + forms)) * 1000) as bigint) order by t.t) as scores
  from (select distinct form from counted) f cross join tags t cross join sizes left join counted c using (form, tag) group by form),
follows as (select lag(tag) over (partition by doc_id, sentence order by pos) as a, tag as b from annotated),
paired as (select a, b, count(*) as n from follows group by all),
sources as (select tag as a, t from tags union all select null, 0),
moves as materialized (select s.t as a, list(cast(round(ln((coalesce(p.n, 0) + 1) / (total + n_tags)) * 1000) as bigint) order by t.t) as scores
  from sources s cross join tags t cross join sizes left join paired p on p.a is not distinct from s.a and p.b = t.tag
    left join (select a, sum(n)::bigint as total from paired group by a) q on q.a is not distinct from s.a
  group by s.t),
opening as (select scores from moves where a = 0),
matrix as (select list(scores order by a) as m from moves where a > 0)"""
# forwards: the sums of each word, from the sums of the word before, and the tag each came from
DECODED = f"""{TAG_MODEL},
sentences as (select doc_id, sentence, list(scores order by pos) as e, list(form order by pos) as w
  from placed join emitted using (form) group by all),
folded as materialized (select doc_id, sentence, w, list_reduce(
    list_transform(e, lambda x, i: {{'s': case when i = 1 then list_transform(range(1, len(x) + 1), lambda k: x[k] + o.scores[k]) else x end,
      'p': []::bigint[][]}}),
    lambda acc, x: {{
      's': list_transform(range(1, len(x.s) + 1), lambda k: x.s[k] + list_max(list_transform(range(1, len(x.s) + 1), lambda j: acc.s[j] + m[j][k]))),
      'p': list_append(acc.p, list_transform(range(1, len(x.s) + 1), lambda k:
        -list_max(list_transform(range(1, len(x.s) + 1), lambda j: {{'v': acc.s[j] + m[j][k], 'j': -j}})).j))}}) as f
  from sentences cross join (select scores from opening) o cross join matrix),
ways as materialized (select doc_id, sentence, w, f.p as p,
    -list_max(list_transform(range(1, len(f.s) + 1), lambda k: {{'v': f.s[k], 'k': -k}})).k as last from folded),
-- backwards: the last tag, and before each tag the one it came from
back(doc_id, sentence, pos, t, p) as (
  select doc_id, sentence, len(w), last::bigint, p from ways
  union all select doc_id, sentence, pos - 1, p[pos - 1][t], p[:pos - 2] from back where pos > 1),
tagged as (select b.doc_id, b.sentence, b.pos - 1 as pos, w.w[b.pos] as form, g.tag
  from back b join ways w using (doc_id, sentence) join tags g using (t))"""


def annotated(spark, sf_dir):
    """The documents' words with their tags: doc_id, sentence, pos, form, tag."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", TG.SENTENCE_END)).alias("sentence", "line"))
    words = lines.withColumn("words", tokenize_words("line")).where(F.size("words") > 0)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("words", F.lit(1), F.size("words") - 1))
    pairs = F.arrays_zip(F.col("words").alias("form"), before.alias("before"))
    placed = words.select("doc_id", "sentence", F.posexplode(pairs).alias("pos", "word"))
    return placed.select("doc_id", "sentence", "pos", "word.form", "word.before").withColumn("tag", F.expr(TAG_RULE)).drop("before")


def _tagger(spark, sf_dir):
    return TG.fit_tagger(annotated(spark, sf_dir), ["doc_id", "sentence"])


@query("tag_words", f"with recursive {DECODED} select doc_id, sentence::bigint as sentence, pos::bigint as pos, form, tag from tagged")
def tag_words(spark, sf_dir):
    found = TG.tag_words(docs(spark, sf_dir), _tagger(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("sentence", "pos")})


@query(
    "nouns_in_context",
    f"""with recursive {DECODED}, chosen as (select doc_id, form, arg_max(tag, (sentence, pos)) as tag from tagged
      where tag in ('NOUN', 'PROPN') group by all),
    listed as (select doc_id, string_agg(form || '=' || tag, ',' order by form || '=' || tag) as nouns from chosen group by doc_id)
    select doc_id, coalesce(nouns, '') as nouns from documents left join listed using (doc_id)""",
)
def nouns_in_context(spark, sf_dir):
    found = TG.nouns_in_context(docs(spark, sf_dir), _tagger(spark, sf_dir))
    entries = F.transform(F.map_entries("nouns"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("doc_id", F.array_join(F.sort_array(entries), ",").alias("nouns"))


# --- vectorizers --------------------------------------------------------------------
@query(
    "saved_vectorizer",
    f"""with item_terms as (select item_id, unnest({TOKENS_SQL}) as term from benchmark),
    item_df as (select term, count(distinct item_id) as df from item_terms group by term having count(distinct item_id) >= 2),
    vocab as (select term, row_number() over (order by term) - 1 as i,
      ln((1 + (select count(*) from benchmark)) / (1 + df)) + 1 as idf from item_df),
    {IDF.split(', idf as')[0]},
    weighted as (select doc_id, i, count * vocab.idf as x from bag join vocab using (term))
    select doc_id, i, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as x from weighted""",
)
def saved_vectorizer(spark, sf_dir):
    """Fitted on the benchmark items, saved, loaded and applied to the documents."""
    path = model_path(spark)
    items = table(spark, sf_dir, "benchmark")
    TextVectorizer(use_idf=True, unit_length=True, min_df=2).fit(items).save(path)
    found = TextVectorizerModel.load(spark, path).transform(docs(spark, sf_dir))
    # the entries of a vector, through its JSON form
    own = F.from_json(F.to_json(F.struct("features")), "features struct<indices: array<bigint>, values: array<double>>")
    entries = F.arrays_zip(own["features"]["indices"].alias("i"), own["features"]["values"].alias("x"))
    return found.select("doc_id", F.inline(entries)).select("doc_id", "i", F.round("x", 6).alias("x"))


# --- sketches -----------------------------------------------------------------------
@query(
    "vocab_sketches",
    f"""with terms as (select source, unnest({TOKENS_SQL}) as term from documents)
    select source, count(distinct term) as exact, true as within from terms group by source
    union all select 'all', count(distinct term), true from terms""",
)
def vocab_sketches(spark, sf_dir):
    """Sketches of each source, written, and merged from what was written; beside the exact counts.

    An estimate is within if it is off by at most four standard errors.
    """
    texts = dealt(table(spark, sf_dir, "documents"))
    terms = texts.select("source", F.explode(tokenize_words("text")).alias("term")).distinct()
    path = new_path(spark, "sketches")
    SK.vocab_sketches(terms, ["source"]).write.parquet(path)
    kept = spark.read.parquet(path)
    merged = SK.merge_sketches(kept, []).select(F.lit("all").alias("source"), "sketch")
    sizes = SK.sketched_sizes(kept.unionByName(merged))
    own = terms.groupBy("source").agg(F.count(F.lit(1)).alias("exact"))
    whole = terms.select("term").distinct().agg(F.count(F.lit(1)).alias("exact"))
    exact = own.unionByName(whole.select(F.lit("all").alias("source"), "exact"))
    off = F.abs(F.col("vocab_size") - F.col("exact")) <= F.ceil(4 * SK.relative_error() * F.col("exact"))
    both = exact.withColumnRenamed("source", "_source").join(sizes, F.col("_source").eqNullSafe(F.col("source")))
    return both.select("source", "exact", off.alias("within"))


# --- posts of unlike shapes ---------------------------------------------------------
FIELDS = {
    "id": ("$.id", "bigint"), "lang": ("$.lang", "string"), "role": ("$.author.role", "string"),
    "n": ("$.n", "bigint"),
}


def _unlike(spark, sf_dir):
    """Documents and conversation turns as posts of unlike shapes, and lines that are no records."""
    path = new_path(spark, "unlike")
    documents, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    OUT.sink_json(documents.select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("n")), f"{path}/a")
    turned = turns.select(
        F.col("conv_id").cast("string").alias("id"), F.struct("role").alias("author"), F.lit("many").alias("n")
    )
    OUT.sink_json(turned, f"{path}/b")
    broken = table(spark, sf_dir, "benchmark").select(F.concat(F.lit('{"id": '), F.col("item_id").cast("string")))
    broken.write.text(f"{path}/c")
    return VA.scan_variants(spark, [f"{path}/a", f"{path}/b", f"{path}/c"])


@query(
    "scan_variants",
    """select doc_id as id, lang, null as role, n_chars::bigint as n, null as corrupt_record from documents
    union all select conv_id, null, role, null, null from conversations
    union all select null, null, null, null, '{"id": ' || item_id from benchmark""",
)
def scan_variants(spark, sf_dir):
    return VA.typed_fields(_unlike(spark, sf_dir), FIELDS, keep_corrupt=True)


@query(
    "drift_report",
    """with found as (
      select 'id' as field, 'BIGINT' as kind, count(*) as n, 'declared' as status from documents where doc_id is not null
      union all select 'lang', 'STRING', count(*), 'declared' from documents where lang is not null
      union all select 'n', 'BIGINT', count(*), 'declared' from documents where n_chars is not null
      union all select 'id', 'STRING', count(*), 'other kind' from conversations where conv_id is not null
      union all select 'author', 'OBJECT', count(*), 'undeclared' from conversations
      union all select 'n', 'STRING', count(*), 'other kind' from conversations)
    select * from found where n > 0 union all select 'place', null, 0, 'missing'""",
)
def drift_report(spark, sf_dir):
    declared = {"id": "BIGINT", "lang": "STRING", "n": "BIGINT", "place": "STRING"}
    return VA.drift_report(_unlike(spark, sf_dir), declared)


# --- other scripts ------------------------------------------------------------------
# The documents' Latin letters as letters of four scripts, by document (test values).
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGH"
SCRIPTS = [
    "абцдефгхийклмнопюрстувшызАЖЦДЕФГЩ", "αβψδεφγηιθκλμνοπχρστυξωύζΑΒΨΔΕΦΓΉ",
    "あばちだえふがはいじかラマナオパキュロサタウヴわヤざアブチデエフガハ", "가박찬댅에팥궑하이즈칼랇망높옷픽뀨롬삶특웋뷁왜얍쥐각힣차다한국어힐",
]


def _scripted(translate: str) -> str:
    cases = " ".join(f"when doc_id % 5 = {k} then {translate.format(to=letters)}" for k, letters in enumerate(SCRIPTS))
    return f"concat(text, ' | ', case {cases} else text end)"


SCRIPTED = _scripted(f"translate(text, '{LATIN}', '{{to}}')")
# one map of all letters, and the syllables from their parts in order
LETTERS = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SC.spellings().items()) + "}"
SYLLABLE_ROWS = f"""syllables as materialized (select map(list(chr(({SC.HANGUL} + (i - 1) * {len(SC.VOWELS) * len(SC.FINALS)}
    + (v - 1) * {len(SC.FINALS)} + f - 1)::int)), list(a[i] || b[v] || c[f])) as h
  from (select {SC.INITIALS} as a, {SC.VOWELS} as b, {SC.FINALS} as c), range(1, {len(SC.INITIALS) + 1}) r1(i),
    range(1, {len(SC.VOWELS) + 1}) r2(v), range(1, {len(SC.FINALS) + 1}) r3(f))"""


@query(
    "spell_in_latin",
    f"""with {SYLLABLE_ROWS}, letters as materialized (select {LETTERS} as m),
    single as (select doc_id, {SCRIPTED} as text from documents),
    used as materialized (select c, coalesce(m[c], h[c], c) as spelt from (
      select distinct unnest(string_split(text, '')) as c from single) cross join letters cross join syllables),
    cut as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as p from single
      where length(text) > 0)
    select doc_id, coalesce(latin, case when text is null then 'NULL' else '' end) as latin from single left join (
      select doc_id, string_agg(spelt, '' order by p) as latin from cut join used using (c) group by doc_id) using (doc_id)""",
)
def spell_in_latin(spark, sf_dir):
    texts = docs(spark, sf_dir).select("doc_id", F.expr(SCRIPTED).alias("text"))
    return texts.select("doc_id", SC.spell_in_latin("text").alias("latin"))


# --- word tables from SQL -----------------------------------------------------------
@query(
    "sql_lookups",
    f"""with recursive {FOUND}, {ENTITY_MAPS}, {NOUN_MAPS} select doc_id, coalesce(entities, '') as entities,
      coalesce(nouns, '') as nouns
    from clean left join entity_maps using (doc_id) left join noun_maps using (doc_id)""",
)
def sql_lookups(spark, sf_dir):
    register_lookups(spark, gazetteer(spark), tags(spark))
    clean_docs(spark, sf_dir).createOrReplaceTempView("clean_docs_view")
    found = spark.sql(
        "select doc_id, get_ner_spacy_udf(text) as entities, get_noun_spacy_udf(text) as nouns from clean_docs_view"
    )
    return found.withColumns({"entities": _map_text("entities"), "nouns": _map_text("nouns")})
