"""Contiguous shards of near-equal bytes, by global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, shuffle_partitions

LAW = "bytes"


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_tolerance: float = 0.01,
) -> DataFrame:
    """Put every row into one of `n_shards` contiguous shards of near-equal bytes.

    Rows are ordered by (first id among rows of equal text, id): the corpus order, with copies pulled to
    their first copy. A row's size is its text's UTF-8 bytes (null: none) plus 1. Range partitions of that order give
    totals; the driver turns the totals (one number a partition) into offsets; running sums inside partitions then give
    each row's global byte prefix, and prefix midpoints are cut at equal targets. A group of equal texts that a cut
    would split goes whole to the shard of its middle if it is smaller than `group_tolerance` of a shard; larger groups
    are cut where the target falls, so a hot text can't unbalance the shards.

    Returns id, size, text_crc32, law, shard, slot (position in the shard, gapless from 0), grown_shard (null).
    Null ids come first; rows that repeat an id and text are kept, each with its own slot. An empty table gives no rows.
    Columns other than id and text are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.coalesce(F.sha1(F.encode(F.col(text_col), "UTF-8")), F.lit("")).alias("grp"),
    )
    rows = ws.save(rows, "rows")
    copies = ws.save(
        rows.groupBy("grp").agg(F.min("id").alias("lead"), F.sum("size").alias("grp_bytes"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"),
        "copies",
    )
    keyed = rows.join(copies, "grp", "left").withColumn("lead", F.coalesce("lead", "id"))
    order = ["lead", "grp", "id", "size"]
    placed = ws.save(
        keyed.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "placed"
    )
    totals = placed.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("c")).orderBy("part").collect()
    offsets, at_b, at_c = [], 0, 0
    for t in totals:
        offsets.append((t["part"], at_b, at_c))
        at_b, at_c = at_b + t["b"], at_c + t["c"]
    total = max(at_b, 1)
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, from_b long, from_c long"))  # a row a partition
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = (
        placed.withColumn("upto", F.sum("size").over(w))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        .join(starts, "part")
        .withColumn("middle", F.col("from_b") + F.col("upto") - F.col("size") / 2)
        .withColumn("index", F.col("from_c") + F.col("nth") - 1)
    )
    cut = lambda c: F.least(F.lit(n_shards - 1), F.floor(c * n_shards / F.lit(total))).cast("int")
    run = ws.save(
        run.select("id", "size", "crc", "grp", "grp_bytes", "middle", "index", cut(F.col("middle")).alias("shard")), "cut"
    )
    # A cut splits at most one group: no more than n_shards - 1 rows come back here.
    small = F.col("grp_bytes") <= F.lit(group_tolerance * total / n_shards)
    split = (
        run.filter(F.col("grp_bytes").isNotNull() & small)
        .groupBy("grp")
        .agg(
            F.min("shard").alias("s0"), F.max("shard").alias("s1"), cut((F.min("middle") + F.max("middle")) / 2).alias("to")
        )
        .filter("s0 <> s1")
        .limit(n_shards)
        .collect()
    )
    moves = F.broadcast(spark.createDataFrame([(r["grp"], r["to"]) for r in split], "grp string, to int"))
    final = run.join(moves, "grp", "left").withColumn("shard", F.coalesce("to", "shard"))
    heads = F.broadcast(final.groupBy("shard").agg(F.min("index").alias("head")))  # a row a shard
    return final.join(heads, "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("index") - F.col("head")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
