"""Entities and nouns of a text from SQL, by the names the original jobs use.

The word tables are brought to the workers as broadcasts of a measured size, and each text is read
once where it lies, in Arrow batches. A subquery in the body of an SQL function would group by the
whole text and carry it beside each of its words, which long texts do not stand.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.gazetteer import ENTRY_BYTES, TABLE_BYTES, longest_of, small_automaton
from quillmill.operators.lexicon import noun_forms
from quillmill.plans.shipping import ship
from quillmill.plans.storage import cut_lineage

ENTITIES, NOUNS = "get_ner_spacy_udf", "get_noun_spacy_udf"
MAP = pa.map_(pa.string(), pa.string())


def register_lookups(spark: SparkSession, gazetteer: DataFrame, tags: DataFrame) -> list[str]:
    """Create both functions over a (phrase, label) and a (form, pos) table; returns their names.

    Both take a text and give a map: phrase to label as ``extract_entities`` does, and word to
    NOUN or PROPN as ``extract_nouns`` does. A missing or empty text, and one in which nothing is
    listed, has an empty map. The tables are read at the call. One of over 64 MB is an error; the
    two operators named meet such a table by a join.
    """
    ship(spark)
    automaton = small_automaton(spark, gazetteer)
    if automaton is None:
        raise ValueError("the gazetteer is too large for a function; use extract_entities")
    forms = cut_lineage(noun_forms(tags))
    size = forms.agg(F.sum(F.octet_length("form") + ENTRY_BYTES)).first()[0] or 0
    if size > TABLE_BYTES:
        raise ValueError("the table of tags is too large for a function; use extract_nouns")
    nouns = spark.sparkContext.broadcast({r["form"]: r["tag"] for r in forms.collect()})

    @F.arrow_udf("map<string,string>")
    def entities(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            hits = longest_of(automaton.value.hits((text or "").split()))
            found.append(sorted({(phrase, label) for _, _, phrase, label in hits}))
        return pa.array(found, MAP)

    @F.arrow_udf("map<string,string>")
    def listed_nouns(texts: pa.Array) -> pa.Array:
        known = nouns.value
        return pa.array([[(w, known[w]) for w in sorted(set((text or "").split())) if w in known] for text in texts.to_pylist()], MAP)

    for name, function in ((ENTITIES, entities), (NOUNS, listed_nouns)):
        spark.udf.register(name, function)
    return [ENTITIES, NOUNS]
