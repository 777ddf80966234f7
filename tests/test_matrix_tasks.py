"""Every task of the matrix has one cell and part, and its similarities are rounded in blocks as SQL's round does."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarry.operators import ranking
from quarry.plans import retrieval


def test_one_cell_and_part_a_task(spark):
    rows = spark.range(3000).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vec"))
    dealt = ranking.dealt_pairs(rows).select("cell", "part", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(dealt) == len({r["task"] for r in dealt}) == len({(r["cell"], r["part"]) for r in dealt}) == 16


def test_rounded_as_sql(spark):
    x = np.concatenate([np.random.default_rng(3).uniform(-1, 1, 5000), [0.03125, -0.03125, 0.00005, -0.00005, 0.00004, -0.00004, 1, -1, 0, 0.12345, -0.12345, 0.99995]])
    want = np.array(duckdb.sql("SELECT round(x, 4) FROM (SELECT unnest($x) AS x)", params={"x": x.tolist()}).fetchall())[:, 0]
    got = ranking.half_up(x, 4)
    assert (got == want).all() and not np.signbit(got[got == 0]).any()


def test_query_rounds_in_blocks(spark):
    d = "/root/testdata/sf0.001"
    out = retrieval.similarity_matrix(spark, d)
    assert "round(" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r["a"], r["b"]): r["similarity"] for r in out.collect()}
    want = {(a, b): s for a, b, s in duckdb.sql(retrieval_sql().replace("FROM embeddings a, embeddings b", f"FROM '{d}/embeddings.parquet' a, '{d}/embeddings.parquet' b")).fetchall()}
    assert got == want


def retrieval_sql():
    from quarry.plans.registry import SQL

    return SQL["similarity_matrix"]
