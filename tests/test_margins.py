"""Margins by blocked products against margins over all scored pairs: copies that tie, rows of every kind, cells in place of a broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import ranking
from quarry.operators import retrieval as R


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_margins_by_label(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(ranking, "ROWS_AT_ONCE", 16)
    rng = random.Random(4)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(4)]
    rows = [(i, vec(), rng.choice([*range(4), 9, None])) for i in range(150)] + [(i, [1.0, 2.0, 3.0, 4.0], i % 3) for i in range(150, 220)]
    rows += [(300, None, 1), (320, [0.0] * 4, 1), (340, [1.0, None, 2.0, 3.0], 1), (360, [float("nan")] * 4, 2), (380, [1.0, 2.0], 2)]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(3)
    asks = corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("label").alias("query_label"))
    pairs = R.scored_pairs(asks.filter("query_id < 340"), corpus.filter("id < 340"), skip_own=True, carry=("query_label",))
    want = E.margins(pairs, F.col("label") == F.col("query_label"), F.col("label") == (F.col("query_label") + 1) % 10).collect()
    queries = asks.withColumns({"wanted": F.col("query_label"), "unwanted": (F.col("query_label") + 1) % 10})
    got = E.margins_by_label(queries, corpus)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 12
