"""Lookups between tables: the last row at or before a place, and the interval that holds a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import PREAMBLE
from quarry.session import stored


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns `take` of the right row of its key that has the greatest `at` not beyond the row's `on`; nulls where there is none.

    Both sides are put together and range-sorted by key and place, so that a key with very many rows spreads over ranges. Inside a range the last right row is carried forward; what a range begins with
    comes from the ranges before, by one row for each range and key. Of right rows at one place the greatest counts. Left rows with a null key or place find nothing; right ones are passed over.
    """
    spark, n = left.sparkSession, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    salt = F.xxhash64(F.monotonically_increasing_id()).alias("_salt")
    held, given = F.struct(*take).alias("_r"), F.struct(*(F.col(c) for c in left.columns)).alias("_l")
    a = left.select(*keys, F.col(on).cast("double").alias("_at"), F.lit(1).alias("_kind"), salt, given)
    b = right.dropna(subset=[at, *by]).select(*keys, F.col(at).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt"), held)
    order = [*names, "_at", "_kind", "_salt"]
    both = a.unionByName(b, allowMissingColumns=True).repartitionByRange(n, *order)
    placed = stored(both.withColumn("_part", F.spark_partition_id()), "asof")  # bounds are sampled: ranges are read, not made again
    before = Window.partitionBy("_part", *names).orderBy("_at", "_kind", "_salt", "_r").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("_here", F.last("_r", ignorenulls=True).over(before)).filter("_kind = 1")
    last = placed.groupBy("_part", *names).agg(F.max_by("_r", F.when(F.col("_kind") == 0, F.struct("_at", "_r"))).alias("_last"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).filter("_carried IS NOT NULL").drop("_last")
    rows = filled.join(carried, ["_part", *names], "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_here", "_carried"))
    return rows.select("_l.*", found.alias("_found")).select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in take))


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, take: list[str], width: int | None = None) -> DataFrame:
    """Each point with the columns `take` of the first interval of its key that holds it, both ends included; nulls where there is none.

    Intervals are dealt to buckets of `width` places (their mean length if it isn't given, so that an interval lies in two or three), and points meet the intervals of their own bucket alone. Of several intervals the one that
    begins first counts, then the one that ends first.
    """
    if width is None:
        width = max(1, int(intervals.agg(F.avg(F.col(end) - F.col(start) + 1)).first()[0] or 1))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    held = intervals.filter(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*take).alias("_r"), F.explode(F.sequence(bucket(start), bucket(end))).alias("_b"))
    numbered = stored(points.withColumn("_n", F.monotonically_increasing_id()), "points")
    asked = numbered.select("_n", *keys, F.col(at).alias("_at"), bucket(at).alias("_b"))
    met = asked.join(held, [*names, "_b"]).filter("_s <= _at AND _at <= _e")
    first = met.groupBy("_n").agg(F.min_by("_r", F.struct("_s", "_e", "_r")).alias("_found"))
    return numbered.join(first, "_n", "left").select(*points.columns, *(F.col(f"_found.{c}").alias(c) for c in take))


def sections_of(chunks: DataFrame, sections: DataFrame, doc_col: str = "doc_id", place: str = "char_start") -> DataFrame:
    """Chunks with the title of the last section (doc_col, offset, title, and position where several begin at one place) that begins at or before them; before all of them the first one's, and the preamble's name in documents without any."""
    place_of = F.col("position") if "position" in sections.columns else F.lit(0)
    named = sections.select(doc_col, "offset", place_of.alias("_position"), F.col("title").alias("section"))
    first = named.groupBy(doc_col).agg(F.min_by("section", F.struct("offset", "_position")).alias("_first"))
    rows = asof_join(chunks, named, [doc_col], place, "offset", ["_position", "section"])
    return rows.join(first, doc_col, "left").withColumn("section", F.coalesce("section", "_first", F.lit(PREAMBLE))).drop("_first", "_position")


def pages_of(chunks: DataFrame, pages: DataFrame, doc_col: str = "doc_id", place: str = "char_start") -> DataFrame:
    """Chunks with the page (doc_col, page, start, end) that holds their place; the last page beyond its end, else 1."""
    last = pages.groupBy(doc_col).agg(F.max_by("page", F.struct("end", "start")).alias("_last"), F.max("end").alias("_end"))
    rows = interval_join(chunks, pages.withColumnRenamed("page", "page_number"), [doc_col], place, "start", "end", ["page_number"]).join(last, doc_col, "left")
    page = F.coalesce("page_number", F.when(F.col(place) > F.col("_end"), F.col("_last")), F.lit(1))
    return rows.withColumn("page_number", page).drop("_last", "_end")
