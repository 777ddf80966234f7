"""Ingestion accounting, integrity checks, embedding plans and upserts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stored

REQUIRED = [
    "chunk_id", "source", "filename", "document_id", "file_type", "strategy", "chunk_index", "total_chunks", "section",
    "page_number", "token_count", "char_start", "char_end",
]
# Dollars a million tokens.
EMBEDDING_RATES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10, "all-minilm": 0.0}


def ingest_status(docs: DataFrame, text_col: str, chars: Column, chunks: Column) -> DataFrame:
    """status INGESTED or SKIPPED with the stage and error that skipped a document; no document disappears."""
    text = F.col(text_col)
    stage = F.when(text.isNull() | ~F.rlike(text, F.lit(r"\S")), "LOADING").when(chars == 0, "CLEANING").when(chunks == 0, "CHUNKING")
    error = F.when(stage == "LOADING", "EMPTY_DOCUMENT").when(stage == "CLEANING", "EMPTY_AFTER_CLEANING").when(stage == "CHUNKING", "NO_CHUNKS")
    return docs.withColumns({"stage": stage, "error_type": error, "status": F.when(stage.isNull(), "INGESTED").otherwise("SKIPPED")})


def reconcile(discovered: DataFrame, ingested: DataFrame, skipped: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One row of counts: discovered, ingested, skipped, unaccounted, duplicates, documents without chunks, and whether all agrees."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    lost = discovered.join(ingested.select(key).unionByName(skipped.select(key)), key, "left_anti")
    twice = discovered.groupBy(key).count().filter("count > 1")
    bare = ingested.join(chunks.select(key).distinct(), key, "left_anti")
    out = one(discovered, "discovered")
    for df, name in ((ingested, "ingested"), (skipped, "skipped"), (lost, "unaccounted"), (twice, "duplicates"), (bare, "without_chunks")):
        out = out.crossJoin(F.broadcast(one(df, name)))  # a row each
    ok = (F.col("discovered") == F.col("ingested") + F.col("skipped")) & (F.col("unaccounted") == 0) & (F.col("duplicates") == 0) & (F.col("without_chunks") == 0)
    return out.withColumn("complete", ok)


def metadata_compliance(chunks: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Rows that break each rule: a required field is null, spans or counts are out of order, the content is blank."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (REQUIRED if required is None else required)]
    return chunks.agg(
        *nulls,
        F.count_if(~((F.col("char_start") >= 0) & (F.col("char_start") <= F.col("char_end")))).alias("bad_spans"),
        F.count_if(F.col("token_count") <= 0).alias("bad_tokens"),
        F.count_if(F.trim("content") == "").alias("blank"),
    )


def require_complete(report: DataFrame) -> None:
    """Raise if a reconciliation or compliance report (one row) counts anything amiss."""
    row = report.first().asDict()
    amiss = {k: v for k, v in row.items() if (k.startswith(("null_", "bad_")) or k in ("blank", "unaccounted", "duplicates", "without_chunks")) and v}
    if amiss or row.get("complete") is False:
        raise ValueError(f"ingestion is incomplete: {amiss or row}")


def embedding_plan(chunks: DataFrame, cache: DataFrame, batch: int = 10, order_col: str = "position", force: bool = False) -> DataFrame:
    """Chunks with the action EMBED or SKIP (cached with a vector) and, for EMBED, their batch in order.

    Batches are cut by running counts inside ranges of the order, so that no task sees all rows.
    """
    known = cache.filter(F.size("embedding") > 0).select("chunk_id").distinct().withColumn("cached", F.lit(True))
    rows = stored(chunks.join(known, "chunk_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)) & F.lit(not force)), "embedding-plan")
    todo = rows.filter(~F.col("cached"))
    numbered = running_index(todo, [F.col(order_col), F.col("chunk_id")], "nth")
    done = rows.filter("cached").withColumns({"action": F.lit("SKIP"), "batch": F.lit(None).cast("long")})
    return numbered.withColumns({"action": F.lit("EMBED"), "batch": F.floor(F.col("nth") / batch)}).drop("nth").unionByName(done)


def running_index(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in order: one range shuffle, places inside the sorted ranges, and the counts of the ranges before. Ties are numbered in any order.

    The ranges are written to the shared folder, since their bounds are sampled and would differ if they were computed again.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "running-index")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, at = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a range
        offsets.append((r["part"], at))
        at += r["count"]
    before = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    return placed.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + nth).drop("_part", "_before", "_at")


def embedding_ledger(plan: DataFrame, model: str = "text-embedding-3-small", failed: DataFrame | None = None) -> DataFrame:
    """Per action: chunks, tokens, batches, and the cost spent or saved. Chunks of `failed` (chunk_id) count as FAILED instead of EMBED."""
    rate = EMBEDDING_RATES.get(model, 0.02)
    if failed is not None:
        lost = failed.select("chunk_id").distinct().withColumn("_lost", F.lit(True))
        plan = plan.join(lost, "chunk_id", "left").withColumn("action", F.when(F.col("_lost") & (F.col("action") == "EMBED"), "FAILED").otherwise(F.col("action"))).drop("_lost")
    return plan.groupBy("action").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_distinct("batch").alias("batches"),
        F.round(F.sum("token_count") / 1e6 * rate, 6).alias("cost"),
    )


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 10, attempts: int = 3, id_col: str = "chunk_id", text_col: str = "content", first_wait: float = 0.5, factor: float = 2.0, longest_wait: float = 8.0) -> DataFrame:
    """Vectors from a pluggable provider, called on batches inside Arrow partitions; transient errors are tried again after `first_wait` seconds, each time `factor` times as long but at most
    `longest_wait`; a batch that goes on failing gets its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part, vectors, error = frame.iloc[a : a + batch], None, None
                for k in range(attempts):
                    if k:
                        time.sleep(min(longest_wait, first_wait * factor ** (k - 1)))
                    try:
                        vectors, error = provider(part[text_col].fillna("").tolist()), None
                        break
                    except (ConnectionError, TimeoutError) as e:
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({id_col: part[id_col], "embedding": vectors if vectors is not None else [None] * len(part), "error": [error] * len(part)})

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>, error string")


def merged_vectors(chunks: DataFrame, new: DataFrame, cached: DataFrame, order_col: str = "position") -> DataFrame:
    """Each chunk's vector, the new one before the cached one, with its origin (new, cached or failed) and a preview; order_col gives the chunks' order back."""
    fresh = new.filter(F.size("embedding") > 0).groupBy("chunk_id").agg(F.first("embedding").alias("_new"))
    old = cached.filter(F.size("embedding") > 0).groupBy("chunk_id").agg(F.first("embedding").alias("_old"))
    rows = chunks.select("chunk_id", order_col).join(fresh, "chunk_id", "left").join(old, "chunk_id", "left")
    origin = F.when(F.col("_new").isNotNull(), "new").when(F.col("_old").isNotNull(), "cached").otherwise("failed")
    rows = rows.withColumns({"embedding": F.coalesce("_new", "_old"), "origin": origin}).drop("_new", "_old")
    return rows.withColumn("preview", vector_preview(F.col("embedding")))


def vector_preview(vec: Column, n: int = 8, digits: int = 6) -> Column:
    return F.transform(F.slice(vec, 1, n), lambda x: F.round(x.cast("double"), digits))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed counts of hashed words, unit length."""

    def vectors(texts: list[str]) -> list[list[float]]:
        import hashlib
        import math

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return vectors


def check_dimension(records: DataFrame, dimension: int, vec_col: str = "embedding") -> None:
    """Raise before anything is written if a vector has another dimension."""
    bad = records.filter((F.size(vec_col) != dimension) | F.col(vec_col).isNull()).limit(1).count()
    if bad:
        raise ValueError(f"vectors have dimension {dimension}")


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows, and current ones whose key they don't hold. Of incoming rows with one key the one of largest version stays; of equal versions the one whose row has the smallest hash."""
    last = Window.partitionBy(key).orderBy(F.desc("version"), F.xxhash64(*incoming.columns))
    new = incoming.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def count_confirmation(stored: DataFrame, expected: DataFrame) -> DataFrame:
    s, e = stored.agg(F.count("*").alias("stored")), expected.agg(F.count("*").alias("expected"))
    return s.crossJoin(F.broadcast(e)).withColumn("confirmed", (F.col("stored") == F.col("expected")) & (F.col("stored") > 0))


def spot_check(source: DataFrame, stored: DataFrame, key: str, doc_col: str, order_col: str, fields: list[str]) -> DataFrame:
    """First, middle and last row and every document's first, held against what is stored; the fields that differ."""
    n = source.count()
    numbered = running_index(source, [F.col(order_col)], "_i")
    first = F.row_number().over(Window.partitionBy(doc_col).orderBy(order_col)) == 1
    picked = numbered.withColumn("_first", first).filter(F.col("_first") | F.col("_i").isin(0, n // 2, n - 1))
    there = stored.select(key, *(F.col(f).alias(f"stored_{f}") for f in fields), F.lit(True).alias("found"))
    rows = picked.join(there, key, "left")
    wrong = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"stored_{f}")), F.lit(f)) for f in fields)))
    return rows.select(key, F.coalesce("found", F.lit(False)).alias("found"), wrong.alias("mismatches"))
