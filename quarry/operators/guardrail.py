"""Retrieval-quality gate: answer or refuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFICIENT, EMPTY, LOW, FEW = "SUFFICIENT_CONTEXT", "EMPTY_RESULTS", "LOW_SIMILARITY_SCORE", "TOO_FEW_RELEVANT_CHUNKS"


def assess(queries: DataFrame, hits: DataFrame, min_similarity: float = 0.5, min_top: float = 0.5, min_chunks: int = 1) -> DataFrame:
    """A row a query: status, top score, chunks found and qualifying, mean score of these, and the action."""
    good = F.col("score") >= min_similarity
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("found"), F.max("score").alias("top"), F.count_if(good).alias("good"), F.avg(F.when(good, F.col("score"))).alias("mean")
    )
    out = queries.select("query_id").join(per, "query_id", "left")
    status = (
        F.when(F.col("found").isNull(), EMPTY)
        .when(F.col("top") < max(min_top, min_similarity), LOW)
        .when(F.col("good") < min_chunks, FEW)
        .otherwise(SUFFICIENT)
    )
    out = out.withColumn("status", status)
    enough = F.col("status") == SUFFICIENT
    return out.select(
        "query_id",
        "status",
        F.coalesce("top", F.lit(0.0)).alias("top_score"),
        F.coalesce("found", F.lit(0).cast("long")).alias("chunks_found"),
        F.when(F.col("status").isin(EMPTY, LOW), F.lit(0).cast("long")).otherwise(F.col("good")).alias("qualifying"),
        F.when(enough, F.col("mean")).otherwise(0.0).alias("mean_qualifying_score"),
        F.when(enough, "ANSWER").otherwise("REFUSE").alias("action"),
    )


def refusals(assessed: DataFrame) -> DataFrame:
    """The refusal text of each query that isn't answered."""
    text = F.format_string("Insufficient context (%s): top score %.4f over %d chunks.", "status", "top_score", "chunks_found")
    return assessed.filter("action = 'REFUSE'").select("query_id", text.alias("refusal"))


def answerable(hits: DataFrame, assessed: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """The qualifying rows of the queries that are answered."""
    good = assessed.filter("action = 'ANSWER'").select("query_id")
    return hits.filter(F.col("score") >= min_similarity).join(good, "query_id", "left_semi")
