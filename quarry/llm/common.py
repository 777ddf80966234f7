"""What the operators share: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import contextlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir, ship_package

#: Rows of an Arrow batch while an operator writes: texts are long, and a batch is held by the JVM and by Python.
ARROW_ROWS = "1000"
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Freed memory of Python workers goes back to the system, since an executor's JVM and its workers share one limit.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "131072"}


def bound_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound their memory."""
    ship_package(spark)
    for k, v in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(k, v)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = int(ARROW_ROWS)):
    """`rows` rows a batch inside the block, where the session has no smaller number; the session's own setting comes back."""
    own = spark.conf.get(ARROW_SETTING)
    if 0 < int(own) <= rows:
        yield
        return
    spark.conf.set(ARROW_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_SETTING, own)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of this process's workspaces that still stand, in order.
_STANDING: list[str] = []


@contextlib.contextmanager
def passing_workspaces(spark: SparkSession):
    """Delete, at the end, what operators called inside the block have written: for blocks that end with the result stored elsewhere."""
    before = set(_STANDING)
    yield
    for folder in [f for f in _STANDING if f not in before]:
        delete_folder(spark, folder)
        _STANDING.remove(folder)


class Workspace:
    """Intermediate tables of one operator call, written as Parquet into the shared folder.

    A written table cuts lineage: a lost executor costs at most the stage that was running, never the ones before. A result that reads them
    keeps them alive; passing_workspaces deletes them where the result has been stored.
    """

    def __init__(self, spark: SparkSession, label: str):
        bound_workers(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _STANDING.append(self.base)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.base}/{self._n:03d}-{name}"
        self._n += 1
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for table in tables:
            delete_folder(self.spark, table._quarry_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (u, v of one orderable type); component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): O(log^2 n) rounds of equi-joins and
    partially aggregated minima. Minima are written before they are joined, so that a hub's rows
    meet in a plain sort-merge join whose large partitions Spark can split.
    """
    e = ws.save(
        edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _fingerprint(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = ws.save(
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star"
        )
        low2 = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        joined = large.join(low2, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = ws.save(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new_mark = _fingerprint(new)
        ws.drop(e, low, large, low2)
        if new_mark == mark:
            break
        e, mark = new, new_mark
    nodes = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(e: DataFrame) -> tuple:
    row = e.agg(
        F.count("*"),
        F.bit_xor(F.xxhash64("u", "v")),
        F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF))),
    ).first()
    return tuple(row)


BITS_A_KEY = 16  #: of a membership filter
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  #: of a membership filter: the largest one is 16 MB


def free_name(name: str, taken: list[str]) -> str:
    """`name`, lengthened until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def _spots(column: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def membership_filter(keys: DataFrame, column: str) -> DataFrame | None:
    """A Bloom filter over a long column of BITS_A_KEY bits a key, MOST_BITS at most, as a table of one row (its words); None where there are so many keys that it would pass nearly all.

    Its words are gathered by partially aggregated bit_or and reach the driver as one Arrow table of at most MOST_BITS / 64 rows. What it passes still has
    to be joined; it only keeps most of the rows that can't match out of that join's shuffle.
    """
    import numpy as np
    import pyarrow as pa

    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, n) * BITS_A_KEY))))
    if n * 2 > bits:  # more than two thirds of the bits would be set
        return None
    bit = F.explode(F.array(*_spots(column, bits))).alias("spot")
    words = keys.select(bit).groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("bits")
    )
    table = words.toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    row = pa.table({"words": pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))})
    out = keys.sparkSession.createDataFrame(row)
    out._quarry_bits = bits
    return out


def passing(rows: DataFrame, column: str, shared: DataFrame | None, clear: bool = False) -> DataFrame:
    """Rows whose key the filter may hold, or with `clear` the others. Without a filter (None) all rows may be held.

    The filter is a scalar subquery: its one value goes out with the tasks and is read where the rows are scanned.
    """
    if shared is None:
        return rows.filter(F.lit(not clear))
    size, words = shared._quarry_bits, shared.select("words").scalar()
    hold = [F.getbit(F.get(words, F.shiftright(s, 6).cast("int")), (s.bitwiseAND(F.lit(63))).cast("int")) == 1 for s in _spots(column, size)]
    return rows.filter(~(hold[0] & hold[1]) if clear else hold[0] & hold[1])


def drop_keys(ws: Workspace, rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose long key is not among the written `keys`; only rows that a filter of bounded size can't clear are shuffled."""
    shared = membership_filter(keys, column)
    maybe = passing(rows, column, shared).join(keys.select(column), column, "left_anti").select(*rows.columns)
    return passing(rows, column, shared, clear=True).unionByName(maybe)
