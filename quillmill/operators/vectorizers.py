"""Bags of words and TF-IDF as an estimator and a model that can be saved.

The vocabulary is a table (term, term_id, idf), not a list in the model, so it may have any
size; it is written with the model and joined when texts are transformed. The result is a
sparse vector per row.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.features import bag_of_words, vocab_alphabetical
from quillmill.plans.joins import lookup_join
from quillmill.plans.storage import cut_lineage, new_path

SETTINGS = ("text_col", "output_col", "n", "binary", "use_idf", "unit_length", "min_df")


class TextVectorizer(Estimator):
    """Learns the vocabulary of a text column, and with ``use_idf`` the weights of its terms.

    Terms are words or ``n`` words in a row; those in fewer than ``min_df`` rows are left out. With
    ``binary`` a term counts once per text; with ``unit_length`` a vector is scaled to length 1.
    """

    def __init__(
        self, text_col: str = "text", output_col: str = "features", n: int = 1, binary: bool = False,
        use_idf: bool = False, unit_length: bool = False, min_df: int = 1,
    ):
        super().__init__()
        given = (text_col, output_col, n, binary, use_idf, unit_length, min_df)
        self.settings = dict(zip(SETTINGS, given, strict=True))

    def _fit(self, dataset: DataFrame) -> TextVectorizerModel:
        s = self.settings
        rows = dataset.select(F.monotonically_increasing_id().alias("_row"), s["text_col"])
        bag = cut_lineage(bag_of_words(rows, s["n"], True, "_row", s["text_col"]))
        seen = bag.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= s["min_df"])
        n_docs = rows.agg(F.count(F.lit(1)).alias("n"))
        idf = F.log((1 + n_docs.scalar()) / (1 + F.col("df"))) + 1 if s["use_idf"] else F.lit(1.0)
        weights = cut_lineage(seen.select("term", idf.alias("idf")))
        vocab = cut_lineage(lookup_join(vocab_alphabetical(weights), weights, "term"))
        return TextVectorizerModel(s, vocab, vocab.count())


class TextVectorizerModel(Model):
    """Texts as sparse vectors over a fitted vocabulary; terms that it does not hold count nothing."""

    def __init__(self, settings: dict, vocab: DataFrame, size: int):
        super().__init__()
        self.settings, self.vocab, self.size = dict(settings), vocab, size

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """All rows and columns, and the vector; a missing or empty text has one without entries.

        A column that has the name of the vector's is replaced.
        """
        s = self.settings
        if s["output_col"] == s["text_col"]:
            raise ValueError("the text would be replaced by its vector")
        # written once: the row number joins the vectors back and must not change
        kept = dataset.drop(s["output_col"])
        row = "_row"
        while row in kept.columns:
            row += "_"
        rows = cut_lineage(kept.withColumn(row, F.monotonically_increasing_id()))
        bag = bag_of_words(rows, s["n"], s["binary"], row, s["text_col"])
        known = lookup_join(bag, self.vocab, "term").select(
            row, F.col("term_id").cast("int").alias("i"), (F.col("count") * F.col("idf")).alias("x")
        )
        entries = F.sort_array(F.collect_list(F.struct("i", "x")))
        length = F.sqrt(F.sum(F.col("x") * F.col("x"))) if s["unit_length"] else F.lit(1.0)
        own = known.groupBy(row).agg(entries.alias("_entries"), length.alias("_length"))
        own = own.select(
            F.col(row),
            F.col("_entries.i").alias("_indices"),
            F.transform("_entries.x", lambda x: x / F.col("_length")).alias("_values"),
        )
        own = own.select(row, as_sparse(self.size, F.col("_indices"), F.col("_values")).alias("_vector"))
        none = as_sparse(self.size, F.array().cast("array<int>"), F.array().cast("array<double>"))
        found = rows.join(own, row, "left").withColumn(s["output_col"], F.coalesce("_vector", none))
        return found.drop(row, "_vector")

    def save(self, path: str) -> None:
        """Write the settings and the vocabulary under a new folder."""
        spark = self.vocab.sparkSession
        self.vocab.write.parquet(f"{path}/vocab")
        text = json.dumps(self.settings | {"size": self.size})
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextVectorizerModel:
        kept = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        return cls({name: kept[name] for name in SETTINGS}, spark.read.parquet(f"{path}/vocab"), kept["size"])


def as_sparse(size: int, indices, values):
    """A sparse vector column of sorted ``indices`` and their ``values``, without Python workers.

    Vectors are a user type, which no cast reaches; a JSON text is read as one.
    """
    shape = T.StructType([T.StructField("v", VectorUDT())])
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values")
    )
    return F.from_json(F.to_json(F.struct(vector.alias("v"))), shape)["v"]


def model_path(spark: SparkSession) -> str:
    """A fresh folder for a model in the session's shared folder."""
    return new_path(spark, "vectorizer")
