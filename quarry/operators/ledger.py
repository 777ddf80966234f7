"""Rows, tokens and seconds of the stages of a run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.session import stored


class StageLedger:
    """Runs stages one after another and keeps a row of each: what it gave, the tokens in it, and how long it took.

    A stage's result is written to the shared folder; rows and tokens are observed by that very write, so that nothing is read or computed twice for the ledger's sake.
    """

    def __init__(self):
        self._rows: list[tuple[str, int, int, float]] = []

    def stage(self, name: str, rows: DataFrame | Callable[[], DataFrame], token_col: str | None = None) -> DataFrame:
        """The stage's rows, stored; a function that makes them belongs to the stage's time."""
        seen, began = Observation(f"{name}-{len(self._rows)}"), time.perf_counter()
        rows = rows() if callable(rows) else rows
        tokens = F.coalesce(F.sum(token_col), F.lit(0)).cast("long") if token_col else F.lit(0).cast("long")
        out = stored(rows.observe(seen, F.count(F.lit(1)).alias("rows"), tokens.alias("tokens")), f"stage-{name}")
        found = seen.get
        self._rows.append((name, found["rows"], found["tokens"], time.perf_counter() - began))
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """stage, rows, tokens, latency_seconds, and each stage's share of the whole time, in order."""
        whole = sum(r[3] for r in self._rows) or 1.0
        rows = [(i, *r, round(100 * r[3] / whole, 2)) for i, r in enumerate(self._rows)]
        return spark.createDataFrame(rows, "position int, stage string, rows long, tokens long, latency_seconds double, share_pct double")
