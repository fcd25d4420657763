"""Posts of unlike shapes: read as variants, typed when asked, with a report of what drifted.

No pass over the files goes into a schema. Each line is read once as a variant; a field comes out
in the type asked for, or null where the line has none that fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANT, CORRUPT = "record", "corrupt_record"


def scan_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record, corrupt_record): JSON objects, one per line, in files of any shapes.

    A line that is not one JSON object has a null record, and itself as ``corrupt_record``;
    blank lines are left out.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    record = F.when(is_object, parsed)
    return lines.select(record.alias(VARIANT), F.when(record.isNull(), F.col("value")).alias(CORRUPT))


def typed_fields(records: DataFrame, fields: dict[str, tuple[str, str]], keep_corrupt: bool = False) -> DataFrame:
    """Columns ``name: (path, type)`` of the records, null where a record lacks the field or it does not fit.

    Lines that hold no record are left out unless asked for.
    """
    rows = records if keep_corrupt else records.where(F.col(VARIANT).isNotNull())
    columns = [F.try_variant_get(VARIANT, path, kind).alias(name) for name, (path, kind) in fields.items()]
    return rows.select(*columns, *([CORRUPT] if keep_corrupt else []))


def drift_report(records: DataFrame, declared: dict[str, str]) -> DataFrame:
    """(field, kind, n, status): the top-level fields found, their kinds and in how many records.

    ``declared`` gives the kind expected of a field, as in STRING, BIGINT, BOOLEAN, OBJECT or
    ARRAY. Status is ``declared``, ``other kind``, ``undeclared``, or ``missing`` for a declared
    field that is in no record (kind null, n 0). A null field is of kind VOID and fits any.
    """
    entries = F.variant_get(VARIANT, "$", "map<string, variant>")
    fields = records.where(F.col(VARIANT).isNotNull()).select(F.explode(entries).alias("field", "_value"))
    kind = F.regexp_extract(F.schema_of_variant("_value"), "^[A-Z]+", 0)
    found = fields.select("field", kind.alias("kind")).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))
    rows = records.sparkSession.createDataFrame(list(declared.items()), "field string, _expected string")
    both = found.join(rows, "field", "full")
    status = (
        F.when(F.col("kind").isNull(), "missing")
        .when(F.col("_expected").isNull(), "undeclared")
        .when(F.col("kind").isin("VOID") | (F.col("kind") == F.col("_expected")), "declared")
        .otherwise("other kind")
    )
    return both.select("field", "kind", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))
