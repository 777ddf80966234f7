"""Joins as of a place and by interval against brute force, with one key far larger than the others."""

import random

from pyspark.sql import functions as F

from quarry.operators import lookups as L


def test_asof(spark):
    rng = random.Random(3)
    right = [(k, rng.randrange(0, 500), f"t{n}") for n, k in enumerate(rng.choices(["a", "b", None, "big"], [1, 1, 1, 20], k=150))]
    right += [("a", None, "none"), ("late", 900, "l"), ("big", 100, "dup1"), ("big", 100, "dup2")]
    left = [(n, k, rng.choice([None, *range(0, 500)])) for n, k in enumerate(rng.choices(["a", "b", None, "big", "only", "late"], [1, 1, 1, 20, 1, 1], k=600))]
    left += [(1000 + n, "big", 100) for n in range(200)]  # one place, many rows
    l_frame, r_frame = spark.createDataFrame(left, "n int, k string, p int"), spark.createDataFrame(right, "k string, p int, title string")
    got = {r["n"]: r["title"] for r in L.asof_join(l_frame, r_frame, ["k"], "p", "p", ["title"]).collect()}
    for n, k, p in left:
        here = [(q, t) for g, q, t in right if g == k and k is not None and p is not None and q is not None and q <= p]
        assert got[n] == (max(here)[1] if here else None), (n, k, p)
    assert len(got) == len(left)
    assert L.asof_join(l_frame.limit(0), r_frame, ["k"], "p", "p", ["title"]).count() == 0
    assert L.asof_join(l_frame, r_frame.limit(0), ["k"], "p", "p", ["title"]).filter("title IS NOT NULL").count() == 0


def test_one_key_spreads_over_ranges(spark):
    left = spark.range(20_000).select(F.lit("big").alias("k"), F.col("id").alias("p"))
    right = spark.range(0, 20_000, 7000).select(F.lit("big").alias("k"), F.col("id").alias("q"), F.col("id").alias("v"))
    out = L.asof_join(left, right, ["k"], "p", "q", ["v"])
    assert out.filter(F.col("v") != F.col("p") - F.col("p") % 7000).count() == 0 and out.count() == 20_000
    parts = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    assert parts.groupBy("_part").count().count() > 1


def test_intervals(spark):
    rng = random.Random(4)
    spans = [(rng.choice("abc"), a := rng.randrange(0, 300), a + rng.randrange(-2, 60), n) for n in range(60)]
    points = [(n, rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(-5, 380)])) for n in range(400)]
    p, s = spark.createDataFrame(points, "n int, k string, at int"), spark.createDataFrame(spans, "k string, start int, end int, page int")
    for width in (None, 1, 1000):
        got = {r["n"]: r["page"] for r in L.interval_join(p, s, ["k"], "at", "start", "end", ["page"], width).collect()}
        for n, k, at in points:
            hits = [(a, b, g) for q, a, b, g in spans if q == k and at is not None and a <= at <= b]
            assert got[n] == (min(hits)[2] if hits else None)
    assert L.interval_join(p, s.limit(0), ["k"], "at", "start", "end", ["page"]).filter("page IS NULL").count() == 400


def test_sections_and_pages(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 50), (1, 99), (2, 5), (3, 7)], "doc_id int, char_start int")
    found = spark.createDataFrame([(1, 10, "A"), (1, 50, "B"), (2, 9, "C")], "doc_id int, offset int, title string")
    assert sorted((r["doc_id"], r["char_start"], r["section"]) for r in L.sections_of(chunks, found).collect()) == [(1, 0, "A"), (1, 50, "B"), (1, 99, "B"), (2, 5, "C"), (3, 7, L.PREAMBLE)]
    pages = spark.createDataFrame([(1, 1, 0, 40), (1, 2, 42, 60), (2, 7, 0, 3)], "doc_id int, page int, start int, end int")
    more = chunks.union(spark.createDataFrame([(1, 41)], "doc_id int, char_start int"))
    assert sorted((r["doc_id"], r["char_start"], r["page_number"]) for r in L.pages_of(more, pages).collect()) == [(1, 0, 1), (1, 41, 1), (1, 50, 2), (1, 99, 2), (2, 5, 7), (3, 7, 1)]
