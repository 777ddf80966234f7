"""Chunk, vector and audit tables as Parquet, JSON and JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.collections import verify_vectors

AUDIT = (
    "request_id STRING, timestamp TIMESTAMP, question STRING, answer_preview STRING, cache_hit BOOLEAN, status STRING, error STRING, "
    "latency_seconds DOUBLE, prompt_tokens INT, completion_tokens INT, total_tokens INT, estimated_cost_usd DOUBLE, cost_saved_usd DOUBLE, "
    "top_k INT, model STRING"
)


def read_chunks(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Prepared chunks from a JSON document with a list `chunks`; the first `most` in its order."""
    rows = spark.read.option("multiLine", True).json(path).select(F.posexplode("chunks").alias("position", "c")).select("position", "c.*")
    return rows if most is None else rows.orderBy("position").limit(most)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Cached vectors by chunk_id; rows without a vector don't count."""
    return spark.read.parquet(path).filter(F.size("embedding") > 0)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines; blank and malformed lines are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def tail(records: DataFrame, n: int, order_col: str = "timestamp") -> DataFrame:
    """The last n records, oldest first."""
    return records.orderBy(F.desc(order_col)).limit(n).orderBy(order_col)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_embedded_corpus(records: DataFrame, path: str, model: str, vec_col: str = "embedding") -> DataFrame:
    """An embedded corpus as JSON Lines under path/records and a row that describes it under path/summary: model, records, smallest and largest dimension, whether they agree, documents and file types. Returns that row.

    The records are written first, and the summary is counted over what was written: a summary means a whole corpus.
    """
    spark = records.sparkSession
    records.write.mode("overwrite").json(f"{path}/records")
    back = spark.read.schema(records.schema).json(f"{path}/records")
    summary = verify_vectors(back, vec_col).withColumn("embedding_model", F.lit(model)).withColumn("status", F.when(F.col("uniform"), "PASS").otherwise("FAIL"))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")  # one row
    return summary


def read_embedded_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a corpus that write_embedded_corpus has finished."""
    spark.read.json(f"{path}/summary").limit(1).collect()  # an error where there is none
    return spark.read.schema(schema).json(f"{path}/records")


def write_run(parts: dict[str, DataFrame], path: str) -> None:
    """What a run has made, table by table under path/<name>, as JSON Lines; a run that is written again replaces itself."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def record(table: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; no row where the key is absent."""
    return table.filter(F.col(key) == F.lit(value))


def reachable(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read."""
    try:
        spark.read.parquet(path).limit(1).collect()
    except Exception:  # noqa: BLE001  any failure means that it can't
        return False
    return True
