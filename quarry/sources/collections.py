"""Vector collections: a Parquet table with properties that are checked before anything is written."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROPERTIES = "space string, dimension int, embedding_model string, created_at string"
SPACES = ("cosine", "l2", "ip")


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


@dataclass
class Collection:
    """Records (id, embedding, document and metadata) under a folder, batch by batch, with the properties space, dimension, embedding_model and created_at."""

    spark: SparkSession
    path: str
    space: str
    dimension: int
    embedding_model: str
    created_at: str

    @classmethod
    def get_or_create(cls, spark: SparkSession, path: str, dimension: int, space: str = "cosine", embedding_model: str = "all-minilm", recreate: bool = False) -> Collection:
        """The collection at `path`; a new one where there is none, or where it is to be recreated. Another dimension or space than the standing one is an error."""
        if space not in SPACES:
            raise ValueError(f"space is one of {SPACES}")
        from pyspark.errors import AnalysisException

        try:
            row = spark.read.schema(PROPERTIES).json(f"{path}/properties").first()
        except AnalysisException as e:
            if not _missing(e):
                raise
            row = None
        if row is not None and not recreate:
            if (row["dimension"], row["space"]) != (dimension, space):
                raise ValueError(f"the collection has dimension {row['dimension']} and space {row['space']}")
            return cls(spark, path, **row.asDict())
        made = (space, dimension, embedding_model, datetime.now(timezone.utc).isoformat())
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        spark.createDataFrame([made], PROPERTIES).coalesce(1).write.json(f"{path}/properties")
        return cls(spark, path, *made)

    def add(self, records: DataFrame, batch: int = 50) -> DataFrame:
        """Write records in numbered batches; a batch with a record without an id or with a vector of another dimension isn't written. Returns batch, records, written, error."""
        numbered = records.withColumn("_batch", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-records.count() // batch)))))
        bad = F.col("id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.dimension)
        ledger = numbered.groupBy("_batch").agg(F.count("*").alias("records"), F.count_if(bad).alias("bad"))
        good = numbered.join(ledger.filter("bad = 0").select("_batch"), "_batch", "left_semi").drop("_batch")
        good.write.mode("append").parquet(f"{self.path}/records")
        error = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(f" records without an id or not of dimension {self.dimension}")))
        return ledger.select(F.col("_batch").alias("batch"), "records", F.when(F.col("bad") == 0, F.col("records")).otherwise(0).alias("written"), error.alias("error"))

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    def readback(self, expected: DataFrame, tolerance: float = 1e-4) -> DataFrame:
        """What was written, held against what is stored."""
        return compare_records(expected, self.records(), tolerance)


def compare_records(expected: DataFrame, stored: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Per expected id: whether it is stored, whether its text agrees, whether its vector has the same dimension and, within a tolerance, direction, and whether all do."""
    there = stored.groupBy("id").agg(F.first("embedding").alias("_e"), F.first("document").alias("_d"))
    rows = expected.select("id", F.col("embedding").cast("array<double>").alias("e"), "document").join(there, "id", "left").withColumn("_e", F.col("_e").cast("array<double>"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(dot("e", "e")) * F.sqrt(dot("_e", "_e"))
    same = F.coalesce(F.size("e") == F.size("_e"), F.lit(False))
    near = same & F.coalesce(F.when(scale == 0, F.col("e") == F.col("_e")).otherwise(F.abs(dot("e", "_e") / scale - 1) <= tolerance), F.lit(False))
    rows = rows.withColumns({"found": F.col("_e").isNotNull(), "text_agrees": F.coalesce(F.col("document") == F.col("_d"), F.lit(False)), "dimension_agrees": same, "vector_agrees": near})
    ok = F.col("found") & F.col("text_agrees") & F.col("vector_agrees")
    return rows.select("id", "found", "text_agrees", "dimension_agrees", "vector_agrees", ok.alias("verified"))


def verify_vectors(records: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: records, smallest and largest dimension, whether they agree, distinct documents, file types in order."""
    return records.agg(
        F.count("*").alias("records"), F.min(F.size(vec_col)).alias("smallest"), F.max(F.size(vec_col)).alias("largest"), (F.min(F.size(vec_col)) == F.max(F.size(vec_col))).alias("uniform"),
        F.count_distinct("document_id").alias("documents"), F.array_join(F.array_sort(F.collect_set("file_type")), ",").alias("file_types"),
    )
