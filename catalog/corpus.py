"""Lemmas, spelling, entities, token patterns, triples and key phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.flows import SELECTED, TWEET
from catalog.registry import POSTS_SQL, dealt, posts, query, quoted, raw_posts, table
from catalog.scalars import SQL_FUNCTIONS, TOKENS_SQL, sql_clean, sql_words
from quillmill.functions import text as X
from quillmill.functions.sqlfunctions import register_functions
from quillmill.functions.tokens import tokenize_words
from quillmill.operators import keyphrases as K
from quillmill.operators import lexicon as L
from quillmill.operators import spelling as S
from quillmill.plans.posts import clean_posts, enrich_posts, select_posts

# Small word tables over words of the corpus (test values).
LEXICON = [
    ("are", "be"), ("is", "be"), ("was", "be"), ("this", "-PRON-"), ("ononst", "onon"), ("inoran", "oran"),
    ("thatin", "that"), ("erenan", "eren"), ("hehely", "hehe"), ("mentend", "ment"),
]
GAZETTEER = [
    ("ononst", "ORG"), ("inoran", "GPE"), ("thatin", "PERSON"), ("of the", "LOC"), ("the", "MISC"),
    ("and the", "EVENT"), ("and the of", "WORK"), ("is in", "FAC"), ("in the by the", "LAW"), ("orre", "GPE"),
    ("of", "MISC"), ("of and", "CARDINAL"), ("by the the of and in", "LAW"), ("the of", "DATE"), ("in the", "DATE"),
    ("la", "GPE"), ("que la", "ORG"), ("la de", "DATE"), ("de la de la de la", "WORK"), ("der die", "ORG"), ("thanedble", "PRODUCT"), ("rewh", "NORP"),
]
TAGS = [
    ("ononst", "PROPN"), ("inoran", "PROPN"), ("thatin", "NOUN"), ("rewh", "NOUN"), ("orre", "NOUN"),
    ("erin", "NOUN"), ("the", "DET"), ("is", "AUX"), ("hehely", "ADV"), ("thanedble", "PROPN"), ("la", "DET"),
]
PATTERNS = {
    "the_mark": [[{"LOWER": "the"}, {"IS_PUNCT": True}]],
    "of_the": [[{"LOWER": "of"}, {"IS_PUNCT": True}, {"LOWER": "the"}], [{"LOWER": "of"}, {"LOWER": "the"}]],
}


def values(rows, name: str, columns: str) -> str:
    listed = ", ".join("(" + ", ".join(quoted(str(v)) for v in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {listed})"


CLEAN = f"clean as materialized (select doc_id, trim({sql_clean('text')}) as text from documents)"
WORDS = f"""{CLEAN}, split as (
  select doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') as w from clean),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from split)"""


def clean_docs(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", F.trim(X.clean_text("text")).alias("text"))


# --- lemmas -------------------------------------------------------------------------
def sql_regular(word: str) -> str:
    cases = " ".join(
        f"when ends_with({word}, '{ending}') and length({word}) >= {shortest} "
        f"then left({word}, length({word}) - {len(ending)}) || '{replacement}'"
        for ending, replacement, shortest in L.LEMMA_ENDINGS
    )
    return f"case {cases} else {word} end"


def sql_lemma(word: str, listed: str) -> str:
    kept = ", ".join(quoted(w) for w in L.KEPT_FORMS)
    return (
        f"case when {listed} in ('be', '-PRON-') then {word} when {listed} is not null then {listed} "
        f"when {word} in ({kept}) then {word} else {sql_regular(word)} end"
    )


IRREGULAR = values(L.IRREGULAR_LEMMAS.items(), "irregular", "form, lemma")


def _lemma_sql(lexicon: str, name: str) -> str:
    return f"""with {WORDS}, {lexicon}
    select doc_id, coalesce(string_agg({sql_lemma('word', 'lemma')}, ' ' order by pos), '') as lemma
    from clean left join words using (doc_id) left join {name} on word = form group by doc_id"""


@query("lemmatize", _lemma_sql(values(LEXICON, "lexicon", "form, lemma"), "lexicon"))
def lemmatize(spark, sf_dir):
    lexicon = spark.createDataFrame(LEXICON, "form string, lemma string")
    return L.lemmatize(clean_docs(spark, sf_dir), lexicon)


@query("lemmatize_built_in", _lemma_sql(IRREGULAR, "irregular"))
def lemmatize_built_in(spark, sf_dir):
    return clean_docs(spark, sf_dir).select("doc_id", L.lemma_text(F.col("text")).alias("lemma"))


# --- spelling -----------------------------------------------------------------------
DICTIONARY = f"""listed as (select word, count(*) as freq from (select unnest(list_filter(
  string_split({sql_clean('text')}, ' '), lambda w: w <> '')) as word from benchmark) group by word)"""


def dictionary(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(X.clean_text("text").alias("text"))
    return S.word_counts(items).select("word", F.col("n").alias("freq"))


@query(
    "correct_spelling_frequency",
    f"""with {WORDS}, {DICTIONARY}, unknown as materialized (
      select distinct word from words where regexp_matches(word, '\\p{{L}}') and word not in (select word from listed)),
    near as (select u.word, l.word as other, l.freq, levenshtein(u.word, l.word) as distance from unknown u
      join listed l on length(l.word) between length(u.word) - 2 and length(u.word) + 2
      where levenshtein(u.word, l.word) <= 2),
    best as (select word, arg_min(other, (distance, -freq, other)) as correction from near group by word)
    select doc_id, coalesce(string_agg(coalesce(correction, word), ' ' order by pos), '') as corrected
    from clean left join words using (doc_id) left join best using (word) group by doc_id""",
)
def correct_spelling_frequency(spark, sf_dir):
    return S.correct_spelling_frequency(clean_docs(spark, sf_dir), dictionary(spark, sf_dir))


# the longest common stretch of the texts a and b, first in a, then in b
STRETCH = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1),
  lambda j: {'n': coalesce(list_max(list_filter(range(1, least(length(a) - i, length(b) - j) + 2),
    lambda n: substr(a, i, n) = substr(b, j, n))), 0), 'i': -i, 'j': -j}))))"""
# letters in common stretches: the longest, then what stands left and what right of it
RATIOS = f"""parts(word, other, a, b, n) as (
  select word, other, word, other, 0::bigint from near
  union all
  select word, other, unnest([substr(a, 1, -s.i - 1), substr(a, -s.i + s.n)]),
    unnest([substr(b, 1, -s.j - 1), substr(b, -s.j + s.n)]), unnest([s.n, 0])
  from (select *, {STRETCH} as s from (select word, other, a, b from parts) where a <> '' and b <> '') where s.n > 0),
rated as (select word, other, 2.0 * sum(n) / (length(word) + length(other)) as ratio from parts group by word, other)"""


@query(
    "correct_spelling_similarity",
    f"""with recursive {WORDS}, {DICTIONARY}, unknown as materialized (
      select distinct word from words where regexp_matches(word, '\\p{{L}}') and word not in (select word from listed)),
    near as materialized (select u.word, l.word as other from unknown u
      join listed l on length(l.word) between length(u.word) - 2 and length(u.word) + 2
      where levenshtein(u.word, l.word) <= 2), {RATIOS},
    best as (select word, arg_min(other, (-ratio, other)) as correction from rated group by word)
    select doc_id, coalesce(string_agg(coalesce(correction, word), ' ' order by pos), '') as corrected
    from clean left join words using (doc_id) left join best using (word) group by doc_id""",
)
def correct_spelling_similarity(spark, sf_dir):
    return S.correct_spelling_similarity(clean_docs(spark, sf_dir), dictionary(spark, sf_dir))


# --- entities, nouns ----------------------------------------------------------------
LONGEST = max(len(phrase.split(" ")) for phrase, _ in GAZETTEER)


def _grams_sql() -> str:
    """Runs of words of each length a listed phrase has."""
    parts = []
    for n in sorted({len(phrase.split(" ")) for phrase, _ in GAZETTEER}):
        phrase = " || ' ' || ".join(f"w{k}" for k in range(n))
        parts.append(f"select doc_id, start, {n} as n, {phrase} as phrase, start_char from placed where w{n - 1} is not null")
    return " union all ".join(parts)


# hits are taken one by one, the longest first, by a list of the places that are taken
FOUND = f"""{WORDS}, {values(GAZETTEER, 'gazetteer', 'phrase, label')},
placed as (select doc_id, pos as start, word as w0, {', '.join(f'lead(word, {k}) over d as w{k}' for k in range(1, LONGEST))},
    sum(length(word) + 1) over d - length(word) - 1 as start_char
  from words window d as (partition by doc_id order by pos)),
grams as ({_grams_sql()}),
hits as materialized (select doc_id, start, n, phrase, label, start_char,
  row_number() over (partition by doc_id order by n desc, start) as turn from grams join gazetteer using (phrase)),
taken(doc_id, turn, places) as (
  select doc_id, 0::bigint, []::bigint[] from (select distinct doc_id from hits)
  union all
  select t.doc_id, t.turn + 1, case when list_has_any(t.places, range(h.start, h.start + h.n)) then t.places
    else list_concat(t.places, range(h.start, h.start + h.n)) end
  from taken t join hits h on h.doc_id = t.doc_id and h.turn = t.turn + 1),
found as (select h.* from hits h join taken t on t.doc_id = h.doc_id and t.turn = h.turn - 1
  where not list_has_any(t.places, range(h.start, h.start + h.n)))"""


def gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "phrase string, label string")


def tags(spark):
    return spark.createDataFrame(TAGS, "form string, pos string")


def _map_text(name: str):
    entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.sort_array(entries), ",")


@query(
    "entity_spans",
    f"with recursive {FOUND} select doc_id, phrase as text, cast(start_char as bigint) as start_char, cast(start_char as bigint) + length(phrase) as end_char, label from found",
)
def entity_spans(spark, sf_dir):
    spans = L.entity_spans(clean_docs(spark, sf_dir), gazetteer(spark))
    return spans.select(
        "doc_id", "text", F.col("start_char").cast("bigint").alias("start_char"),
        F.col("end_char").cast("bigint").alias("end_char"), "label",
    )


@query("entity_set", f"with recursive {FOUND} select distinct doc_id, phrase, label from found")
def entity_set(spark, sf_dir):
    return L.entity_set(clean_docs(spark, sf_dir), gazetteer(spark))


ENTITY_MAPS = """entity_maps as (select doc_id, string_agg(phrase || '=' || label, ',' order by phrase || '=' || label)
  as entities from (select distinct doc_id, phrase, label from found) group by doc_id)"""
NOUN_MAPS = f"""{values([t for t in TAGS if t[1] in ('NOUN', 'PROPN')], 'tags', 'form, tag')},
noun_maps as (select doc_id, string_agg(form || '=' || tag, ',' order by form || '=' || tag) as nouns
  from (select distinct doc_id, form, tag from words join tags on word = form) group by doc_id)"""


@query(
    "extract_entities",
    f"with recursive {FOUND}, {ENTITY_MAPS} select doc_id, coalesce(entities, '') as entities "
    "from documents left join entity_maps using (doc_id)",
)
def extract_entities(spark, sf_dir):
    maps = L.extract_entities(clean_docs(spark, sf_dir), gazetteer(spark))
    return maps.withColumn("entities", _map_text("entities"))


@query(
    "extract_nouns",
    f"with {WORDS}, {NOUN_MAPS} select doc_id, coalesce(nouns, '') as nouns "
    "from documents left join noun_maps using (doc_id)",
)
def extract_nouns(spark, sf_dir):
    maps = L.extract_nouns(clean_docs(spark, sf_dir), tags(spark))
    return maps.withColumn("nouns", _map_text("nouns"))


@query(
    "annotate_posts",
    f"""with recursive {FOUND}, {ENTITY_MAPS}, {NOUN_MAPS} select doc_id, c.text, coalesce(entities, '') as entities,
      coalesce(nouns, '') as nouns
    from clean c left join entity_maps using (doc_id) left join noun_maps using (doc_id)""",
)
def annotate_posts(spark, sf_dir):
    notes = L.annotate_posts(clean_docs(spark, sf_dir), gazetteer(spark), tags(spark))
    return notes.withColumns({"entities": _map_text("entities"), "nouns": _map_text("nouns")})


# --- token patterns, triples --------------------------------------------------------
MARKS = """marked as (select doc_id,
  regexp_extract_all(text, '(?:[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\t-\\r\\x1c-\\x20\\x85\\p{Z}])[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]*') as s
  from documents),
tokens as (select doc_id, unnest(s) as spaced, generate_subscripts(s, 1) - 1 as pos from marked),
trimmed as (select doc_id, pos, spaced, lower(regexp_replace(spaced, '[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+$', '')) as t from tokens),
ahead as (select *, lead(t) over w as t1, lead(t, 2) over w as t2, lead(spaced) over w as s1, lead(spaced, 2) over w as s2
  from trimmed window w as (partition by doc_id order by pos)),
hits as (
  select doc_id, 'the_mark' as name, pos, 2 as n, spaced || s1 as run from ahead
    where t = 'the' and regexp_matches(t1, '^\\p{P}$')
  union all select doc_id, 'of_the', pos, 2, spaced || s1 from ahead where t = 'of' and t1 = 'the'
  union all select doc_id, 'of_the', pos, 3, spaced || s1 || s2 from ahead
    where t = 'of' and regexp_matches(t1, '^\\p{P}$') and t2 = 'the')"""


@query(
    "match_token_pattern",
    f"""with {MARKS} select doc_id, name, pos as start, pos + n as "end",
      regexp_replace(run, '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}]+$', '') as text from hits""",
)
def match_token_pattern(spark, sf_dir):
    hits = L.match_token_pattern(dealt(table(spark, sf_dir, "documents")).select("doc_id", "text"), PATTERNS)
    return hits.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


DEP = """case when {doc} % 3 = 0 and {pos} % 11 = 5 then 'nsubjpass'
  else case (length({text}) + {pos}) % 7 when 0 then 'nsubj' when 1 then 'dobj' when 2 then 'ROOT' when 3 then 'pobj'
  when 4 then 'det' when 5 then 'csubj' else 'prep' end end"""
TRIPLES = f"""with placed as (select doc_id, unnest({TOKENS_SQL}) as text, generate_subscripts({TOKENS_SQL}, 1) - 1 as pos
  from documents),
deps as (select *, {DEP.format(doc='doc_id', pos='pos', text='text')} as dep from placed),
last as (select doc_id, dep, arg_max(text, pos) as text from deps group by all),
flags as (select doc_id, bool_or(instr(dep, 'subjpass') = 2) as passive from last group by doc_id)
select doc_id,
  coalesce(string_agg(dep || '=' || text, ',' order by dep) filter (
    case when passive then ends_with(dep, 'obj') else ends_with(dep, 'subj') end), '') as x,
  coalesce(string_agg(dep || '=' || text, ',' order by dep) filter (ends_with(dep, 'ROOT')), '') as v,
  coalesce(string_agg(dep || '=' || text, ',' order by dep) filter (
    case when passive then instr(dep, 'subjpass') = 2 else ends_with(dep, 'obj') end), '') as y
from last join flags using (doc_id) group by doc_id"""


@query("subject_object_triples", TRIPLES)
def subject_object_triples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    placed = docs.select("doc_id", F.posexplode(tokenize_words("text")).alias("pos", "text"))
    tokens = placed.withColumn("dep", F.expr(DEP.format(doc="doc_id", pos="pos", text="text")))
    triples = L.subject_object_triples(tokens)
    return triples.select("doc_id", *[_map_text(c).alias(c) for c in ("x", "v", "y")])


# --- key phrases --------------------------------------------------------------------
STOP = ", ".join(quoted(w) for w in K.STOP_WORDS)


def _kept_sql(tokens: str = TOKENS_SQL) -> str:
    return f"""placed as (select doc_id, unnest({tokens}) as term, generate_subscripts({tokens}, 1) - 1 as pos
  from documents),
kept as materialized (select * from placed where term not in ({STOP}) and regexp_matches(term, '\\p{{L}}'))"""


def _rounds_sql(rounds: int = K.ROUNDS, damping: float = K.DAMPING) -> str:
    """Ranking rounds over nodes(doc_id, term, base) and links(doc_id, a, b, weight)."""
    steps = [
        "scaled as materialized (select doc_id, term, base * count(*) over d / sum(base) over d as base "
        "from nodes window d as (partition by doc_id))",
        "strength as (select doc_id, a, sum(weight) as total from links group by all)",
        "shares as materialized (select doc_id, a, b, weight / total as share "
        "from links join strength using (doc_id, a))",
        "rank0 as (select doc_id, term, base as rank from scaled)",
    ]
    for k in range(rounds):
        steps.append(
            f"rank{k + 1} as materialized (select s.doc_id, s.term, "
            f"{1 - damping} * any_value(s.base) + {damping} * coalesce(sum(share * rank), 0) as rank "
            f"from scaled s left join shares e on e.doc_id = s.doc_id and e.b = s.term "
            f"left join rank{k} r on r.doc_id = e.doc_id and r.term = e.a group by s.doc_id, s.term)"
        )
    steps.append(f"ranked as materialized (select * from rank{rounds})")
    return ", ".join(steps)


def _word_graph_sql(window_size: int, position_bias: bool, binary: bool) -> str:
    base = "sum(1.0::double / (pos + 1))" if position_bias else "1.0::double"
    near = f"""select x.doc_id, x.term as a, y.term as b, 1.0::double as weight from kept x join kept y
      on x.doc_id = y.doc_id and y.pos between x.pos - {window_size - 1} and x.pos + {window_size - 1}
      where x.term <> y.term"""
    return f"""nodes as (select doc_id, term, {base} as base from kept group by all),
    links as materialized ({near.replace('select', 'select distinct', 1) if binary else near}), {_rounds_sql()}"""


def _runs_sql(words: str, score: str) -> str:
    return f"""runs as (select *, pos - row_number() over (partition by doc_id order by pos) as run from {words}),
    joined as (select doc_id, string_agg(term, ' ' order by pos) as phrase, {score} as score
      from runs group by doc_id, run),
    phrases as (select doc_id, phrase, max(score) as score from joined group by all)"""


def _top_sql(n: int) -> str:
    return f"""best as (select *, row_number() over (partition by doc_id
      order by round(score, {K.SCORE_DIGITS}) desc, phrase) as rank from phrases),
    top as (select doc_id, phrase, score, rank from best where rank <= {n})"""


def _textrank_sql(topn=5, window_size=2, position_bias=False, tokens=TOKENS_SQL) -> str:
    return f"""{_kept_sql(tokens)}, {_word_graph_sql(window_size, position_bias, True)},
    scored as (select doc_id, pos, term, rank from kept join ranked using (doc_id, term)),
    {_runs_sql('scored', 'sum(rank)')}, {_top_sql(topn)}"""


ROUNDED_TOP = "select doc_id, phrase, round(score, 6) as score, rank from top"


def docs(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", "text")


def _rounded(df):
    return df.select(
        "doc_id", "phrase", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query("keyphrases_textrank", f"with {_textrank_sql()} {ROUNDED_TOP}")
def keyphrases_textrank(spark, sf_dir):
    return _rounded(K.keyphrases_textrank(docs(spark, sf_dir)))


@query("keyphrases_textrank_biased", f"with {_textrank_sql(10, 5, True)} {ROUNDED_TOP}")
def keyphrases_textrank_biased(spark, sf_dir):
    found = K.keyphrases_textrank(docs(spark, sf_dir), topn=10, window_size=5, position_bias=True)
    return _rounded(found)


LEMMA_MAP = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in L.IRREGULAR_LEMMAS.items()) + "}"
LEMMA_TOKENS = f"list_transform({TOKENS_SQL}, lambda w: {sql_lemma('w', f'({LEMMA_MAP})[w]')})"


def _keywords_sql(tokens: str = TOKENS_SQL) -> str:
    return f"""{_kept_sql(tokens)}, {_word_graph_sql(2, False, False)},
    placed_terms as (select *, row_number() over (partition by doc_id order by round(rank, {K.SCORE_DIGITS}) desc, term)
      as place from ranked),
    chosen as (select k.doc_id, k.pos, k.term, t.rank from kept k join placed_terms t
      on k.doc_id = t.doc_id and k.term = t.term and t.place <= 5),
    {_runs_sql('chosen', 'avg(rank)')}, {_top_sql(5)}"""


@query("keywords_ranked", f"with {_keywords_sql()} {ROUNDED_TOP}")
def keywords_ranked(spark, sf_dir):
    return _rounded(K.keywords_ranked(docs(spark, sf_dir)))


@query("keywords_ranked_lemma", f"with {_keywords_sql(LEMMA_TOKENS)} {ROUNDED_TOP}")
def keywords_ranked_lemma(spark, sf_dir):
    return _rounded(K.keywords_ranked(docs(spark, sf_dir), lemmatize=True))


@query("keyphrases_textrank_lemma", f"with {_textrank_sql(tokens=LEMMA_TOKENS)} {ROUNDED_TOP}")
def keyphrases_textrank_lemma(spark, sf_dir):
    return _rounded(K.keyphrases_textrank(docs(spark, sf_dir), normalize="lemma"))


def _sgrank_sql(use_idf: bool, topn=5, window_size=3, ngrams=(1, 2, 3), tokens=TOKENS_SQL) -> str:
    grams = " union all ".join(
        f"""select doc_id, pos, {n} as n, array_to_string([{', '.join(['term'] + [f't{k}' for k in range(1, n)])}], ' ')
        as gram from ahead where {' and '.join(['true'] + [f'p{k} - pos = {k}' for k in range(1, n)])}"""
        for n in ngrams
    )
    leads = ", ".join(
        f"lead(term, {k}) over w as t{k}, lead(pos, {k}) over w as p{k}" for k in range(1, max(ngrams))
    )
    idf = f"ln((1 + (select count(*) from documents)) / (1 + df)) + 1" if use_idf else "1"
    return f"""{_kept_sql(tokens)},
    ahead as (select *, {leads} from kept window w as (partition by doc_id order by pos)),
    grams as materialized ({grams}),
    weighted as (select doc_id, gram, count(*) * any_value(n) / log2(min(pos) + 2) as tf from grams group by all),
    freq as (select gram, count(*) as df from weighted group by gram),
    heavy as (select doc_id, gram, tf * ({idf}) as weight from weighted join freq using (gram)),
    nodes as materialized (select doc_id, gram as term, weight as base from heavy),
    spots as materialized (select doc_id, pos, gram as term from grams),
    links as materialized (select x.doc_id, x.term as a, y.term as b,
      sum(log2(1 + {window_size} / abs(x.pos - y.pos))) as weight
      from spots x join spots y on x.doc_id = y.doc_id and abs(x.pos - y.pos) between 1 and {window_size - 1}
      where x.term <> y.term group by all),
    {_rounds_sql()}, phrases as (select doc_id, term as phrase, rank as score from ranked), {_top_sql(topn)}"""


@query("keyphrases_sgrank", f"with {_sgrank_sql(True)} {ROUNDED_TOP}")
def keyphrases_sgrank(spark, sf_dir):
    return _rounded(K.keyphrases_sgrank(docs(spark, sf_dir), use_idf=True))


@query("keyphrases_sgrank_lemma", f"with {_sgrank_sql(False, tokens=LEMMA_TOKENS)} {ROUNDED_TOP}")
def keyphrases_sgrank_lemma(spark, sf_dir):
    return _rounded(K.keyphrases_sgrank(docs(spark, sf_dir), normalize="lemma"))


@query("keyphrases_sgrank_bigram", f"with {_sgrank_sql(False, 5, 2, (2,))} {ROUNDED_TOP}")
def keyphrases_sgrank_bigram(spark, sf_dir):
    return _rounded(K.keyphrases_sgrank(docs(spark, sf_dir), window_size=2, ngrams=2))


LISTED = "select doc_id, string_agg(phrase, '|' order by rank) as phrases from top group by doc_id"


def _tables_sql(tokens: str) -> str:
    return f"""with a as materialized (with {_textrank_sql(tokens=tokens)} {LISTED}),
    b as materialized (with {_sgrank_sql(False, tokens=tokens)} {LISTED}),
    c as materialized (with {_keywords_sql(tokens)} {LISTED})
    select d.doc_id, coalesce(a.phrases, '') as textrank, coalesce(b.phrases, '') as sgrank,
      coalesce(c.phrases, '') as keywords
    from documents d left join a using (doc_id) left join b using (doc_id) left join c using (doc_id)"""


def _keyword_table(spark, sf_dir, normalize):
    found = K.extract_keyphrases(docs(spark, sf_dir), normalize=normalize)
    return found.select(
        "doc_id",
        F.array_join("keyphrases.textrank", "|").alias("textrank"),
        F.array_join("keyphrases.sgrank", "|").alias("sgrank"),
        F.array_join("keywords", "|").alias("keywords"),
    )


@query("extract_keyphrases", _tables_sql(TOKENS_SQL))
def extract_keyphrases(spark, sf_dir):
    return _keyword_table(spark, sf_dir, None)


@query("extract_keyphrases_lemma", _tables_sql(LEMMA_TOKENS))
def extract_keyphrases_lemma(spark, sf_dir):
    return _keyword_table(spark, sf_dir, "lemma")


@query(
    "group_term_variants",
    f"""with recursive {_sgrank_sql(False, 10)},
    forms as materialized (select doc_id, phrase as term, score,
      regexp_replace(regexp_replace(lower(phrase), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '([^s])s$', '\\1') as form from top),
    linked as materialized (select x.doc_id, x.term as a, y.term as b from forms x join forms y using (doc_id)
      where x.term = y.term or x.form = y.form or contains(' ' || x.term || ' ', ' ' || y.term || ' ')
        or contains(' ' || y.term || ' ', ' ' || x.term || ' ')),
    reach(doc_id, a, b) as (select * from linked union
      select r.doc_id, r.a, l.b from reach r join linked l on r.doc_id = l.doc_id and r.b = l.a)
    select r.doc_id, r.a as term, arg_min(r.b, (-round(f.score, {K.SCORE_DIGITS}),
      len(string_split(r.b, ' ')), r.b)) as variant_of
    from reach r join forms f on f.doc_id = r.doc_id and f.term = r.b group by r.doc_id, r.a""",
)
def group_term_variants(spark, sf_dir):
    found = K.keyphrases_sgrank(docs(spark, sf_dir), topn=10)
    return K.group_term_variants(found.select("doc_id", F.col("phrase").alias("term"), "score"), score_col="score")


# --- the functions from SQL, and as columns -----------------------------------------
CHAINED = f"""with {POSTS_SQL} select id, {sql_clean("coalesce(text, 'NULL')")} as clean,
  '[' || array_to_string({sql_words("coalesce(text, 'NULL')", '#')}, ', ') || ']' as tags,
  {SQL_FUNCTIONS['remove_digits']} as plain from posts"""


@query("sql_functions", CHAINED)
def sql_functions(spark, sf_dir):
    register_functions(spark)
    posts(spark, sf_dir).createOrReplaceTempView("posts_view")
    return spark.sql(
        "select id, clean_text_udf(text) as clean, to_reference_string_udf(get_hashtag_udf(text)) as tags, "
        "remove_digits_udf(text) as plain from posts_view"
    )


@query("column_functions", CHAINED)
def column_functions(spark, sf_dir):
    return posts(spark, sf_dir).select(
        "id",
        X.clean_text("text").alias("clean"),
        X.to_reference_string(X.get_hashtag("text")).alias("tags"),
        X.remove_digits("text").alias("plain"),
    )


# --- the full post job --------------------------------------------------------------
def _lemmas_sql(name: str, source: str, column: str) -> str:
    """Lemmas of the words of a text column, joined again."""
    return f"""{name}_words as (select r, unnest(w) as word, generate_subscripts(w, 1) as pos from (
      select r, list_filter(string_split({column}, ' '), lambda x: x <> '') as w from {source})),
    {name} as (select s.r, coalesce(string_agg({sql_lemma('word', 'lemma')}, ' ' order by pos), '') as {name}
      from {source} s left join {name}_words w on s.r = w.r left join irregular on word = form group by s.r)"""


ENRICHED = f"""with {POSTS_SQL}, {SELECTED}, {IRREGULAR}, {DICTIONARY},
cleaned as materialized (select *, row_number() over () as r, {sql_clean(TWEET)} as t from selected),
{_lemmas_sql('clean_tweet_text_lemma', 'cleaned', 't')},
unknown as materialized (select distinct word from clean_tweet_text_lemma_words
  where regexp_matches(word, '\\p{{L}}') and word not in (select word from listed)),
near as (select u.word, l.word as other, l.freq, levenshtein(u.word, l.word) as distance from unknown u
  join listed l on length(l.word) between length(u.word) - 2 and length(u.word) + 2 where levenshtein(u.word, l.word) <= 2),
best as (select word, arg_min(other, (distance, -freq, other)) as correction from near group by word),
corrected as materialized (select c.r, coalesce(string_agg(coalesce(correction, word), ' ' order by pos), '') as t
  from cleaned c left join clean_tweet_text_lemma_words w on c.r = w.r left join best using (word) group by c.r),
{_lemmas_sql('spell_frequency_lemma', 'corrected', 't')}
select c.id, c.t as clean_tweet_text, clean_tweet_text_lemma, x.t as spell_frequency, spell_frequency_lemma
from cleaned c join clean_tweet_text_lemma using (r) join corrected x using (r) join spell_frequency_lemma using (r)"""


def _enriched(spark, sf_dir, methods):
    cleaned = clean_posts(select_posts(raw_posts(spark, sf_dir))).select("id", "clean_tweet_text")
    return enrich_posts(cleaned, dictionary(spark, sf_dir), methods)


@query("enrich_posts", ENRICHED)
def enrich_posts_flow(spark, sf_dir):
    return _enriched(spark, sf_dir, ("frequency",))


@query("enrich_posts_both")
def enrich_posts_both(spark, sf_dir):
    return _enriched(spark, sf_dir, ("similarity", "frequency"))
