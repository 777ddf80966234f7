"""Exact top-k inner products, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace

SEGMENTS = (4, 16, 32)
CANDIDATES_A_BLOCK, QUERIES_A_BLOCK = 8192, 1024
QUERIES_AT_ONCE, GROUP = 128, 64


def usable(vec_col: str) -> Column:
    """Whether a vector is there, not empty, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col(vec_col)
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True))


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Each segment's mean and deviation, times the root of its length: their product bounds the inner product from above.

    The squared distance of two vectors is at least the sum over segments of length * ((difference of means)^2 + (difference of
    deviations)^2); with both norms known, that lower bound is this upper bound on the inner product.
    """
    parts = np.array_split(x, segments, axis=1)
    return np.concatenate(
        [np.stack([p.mean(1), p.std(1)], axis=1) * math.sqrt(p.shape[1]) for p in parts if p.shape[1]], axis=1
    )


LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FAR = 1 << 62  #: larger scaled components count as this


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of two blocks of whole numbers, exactly: by a float product where every partial sum is a whole number that the float holds. Those beyond a long count as its ends."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return np.einsum("id,jd->ij", q.astype(np.int64), c.astype(np.int64))
    exact = q.astype(np.int64).astype(object) @ c.astype(np.int64).astype(object).T
    return np.minimum(np.maximum(exact, LOWEST), HIGHEST).astype(np.int64)


def tree_order(x: np.ndarray) -> np.ndarray:
    """Rows in the order of a tree that halves them at the median of the widest coarse statistic, down to GROUP rows: neighbours have like statistics."""
    stats = segment_statistics(x.astype(np.float64), min(SEGMENTS[0], x.shape[1]))
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= GROUP:
            done.append(rows)
            continue
        own = stats[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = max(GROUP, (len(rows) // GROUP + 1) // 2 * GROUP)  # whole groups on the left
        split = np.argpartition(own[:, axis], min(half, len(rows) - 1))
        todo += [rows[split[half:]], rows[split[:half]]]
    return np.concatenate(done) if done else np.arange(0)


class Candidates:
    """Rows in tree order with their segment statistics, and for each group of GROUP rows the ranges of its statistics, coarse to fine."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.segments = [s for s in SEGMENTS if 2 * s <= x.shape[1]] or [1]
        self.norm = float(np.linalg.norm(x.astype(np.float64), axis=1).max(initial=0))
        self.starts = np.arange(0, self.n, GROUP)
        self.stats = [segment_statistics(x.astype(np.float64), s).astype(np.float32) for s in self.segments]
        self.low = [np.minimum.reduceat(s, self.starts) for s in self.stats]
        self.high = [np.maximum.reduceat(s, self.starts) for s in self.stats]

    def group_bounds(self, level: int, q: np.ndarray) -> np.ndarray:
        """Upper bounds on the inner product of each query (its statistics) with any row of each group."""
        return np.maximum(q, 0) @ self.high[level].T + np.minimum(q, 0) @ self.low[level].T


def block_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query row, candidate row, score, survivors) of the k best candidates of each query in one block, ties to smaller ids.

    Candidates stand in tree order. The exact scores of the groups with the best coarse bounds give each query a score to beat. Whole groups whose bound can't reach it
    drop at each level, coarse to fine; in a group that is left, finer bounds are taken for the queries and rows that are, and exact scores for the last survivors, which raise
    the score to beat. survivors: pairs in all, pairs in groups that survive each level of group bounds, pairs that survive each level of row bounds.
    """
    tree, out = Candidates(c), []
    counts = np.zeros(1 + 2 * len(tree.segments), np.int64)
    for a in range(0, len(q), QUERIES_AT_ONCE):
        rows, cols, score = _some_top_k(q_ids[a : a + QUERIES_AT_ONCE], q[a : a + QUERIES_AT_ONCE], c_ids, tree, k, counts)
        out.append((rows + a, cols, score))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), counts


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), LOWEST)


def _some_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, tree: Candidates, k: int, counts: np.ndarray):
    qf = q.astype(np.float64)
    stats = [segment_statistics(qf, s).astype(np.float32) for s in tree.segments]
    slack = 1e-5 * np.linalg.norm(qf, axis=1) * tree.norm + 1e-3  # bounds are in single precision
    sizes = np.diff(np.append(tree.starts, tree.n))
    # A first score to beat: the exact scores of the groups with the best coarse bounds.
    coarse = tree.group_bounds(0, stats[0])
    tried = min(len(sizes), -(-(k + 1) // GROUP) + 1)
    picks = np.argsort(-coarse, axis=1, kind="stable")[:, :tried]
    near = np.minimum((tree.starts[picks][:, :, None] + np.arange(GROUP)).reshape(len(q), -1), tree.n)
    tried = tree.x[np.minimum(near, tree.n - 1)]
    if int(np.abs(q).max(initial=0)) * int(np.abs(tree.x).max(initial=0)) * q.shape[1] < 1 << 53:
        first = np.einsum("qd,qcd->qc", qf, tried.astype(np.float64)).astype(np.int64)
    else:
        first = np.concatenate([exact_scores(q[i : i + 1], x) for i, x in enumerate(tried)])
    first[(near == tree.n) | (c_ids[np.minimum(near, tree.n - 1)] == q_ids[:, None])] = LOWEST
    floor = _kth_best(first, k)
    # Groups, coarse to fine.
    alive = np.ones(coarse.shape, bool)
    counts[0] += len(q) * tree.n
    for level, own in enumerate(stats):
        bound = coarse if level == 0 else tree.group_bounds(level, own)
        alive &= bound >= (floor - slack)[:, None]
        counts[1 + level] += int((alive * sizes).sum())
    # Rows of the groups that are left, the most promising groups first.
    best, found = np.full((len(q), k), LOWEST), []
    for g in np.argsort(-np.where(alive, coarse, -np.inf).max(0), kind="stable").tolist():
        rows = np.flatnonzero(alive[:, g])
        cols = np.arange(tree.starts[g], tree.starts[g] + sizes[g])
        live = np.ones((len(rows), len(cols)), bool)
        for level, own in enumerate(stats):
            if not live.size:
                break
            live &= own[rows] @ tree.stats[level][cols].T >= (floor - slack)[rows, None]
            counts[1 + len(stats) + level] += int(live.sum())
            r, c = live.any(1), live.any(0)
            rows, cols, live = rows[r], cols[c], live[r][:, c]
        if not live.size:
            continue
        exact = exact_scores(q[rows], tree.x[cols])
        live &= (exact >= floor[rows, None]) & (q_ids[rows][:, None] != c_ids[cols][None])
        r, c = np.nonzero(live)
        found.append((rows[r], cols[c], exact[r, c]))
        if len(r):
            both = np.concatenate([best[rows], np.where(live, exact, LOWEST)], axis=1)
            best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            floor = np.maximum(floor, best.min(axis=1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, cols, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = score >= floor[rows]
    rows, cols, score = rows[keep], cols[keep], score[keep]
    order = np.lexsort((c_ids[cols], ~score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first_k = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first_k], cols[first_k], score[first_k]


def _pack(scale: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = np.array(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
        whole = np.clip(np.floor(scale * x), -FAR, FAR).astype("<i8").reshape(len(ids), -1)
        order = tree_order(whole)
        ids, whole = ids[order], whole[order]
        small = np.abs(whole).max(initial=0) < 1 << 15
        data = whole.astype("<i2") if small else whole
        dim, block = table.column("dim")[0], table.column("block")[0]
        return pa.Table.from_arrays(
            [pa.array([dim.as_py()], pa.int32()), pa.array([block.as_py()], pa.int64()), pa.array([ids.astype("<i8").tobytes()]), pa.array([data.tobytes()]), pa.array([data.itemsize], pa.int32())],
            ["dim", "block", "ids", "data", "width"],
        )

    return run


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    dim = table.column("dim")[0].as_py()
    data = np.frombuffer(table.column("data")[0].as_buffer(), f"<i{table.column('width')[0].as_py()}").astype(np.int64)
    return np.frombuffer(table.column("ids")[0].as_buffer(), "<i8"), data.reshape(-1, dim)


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The k largest inner products of floor(scale * x) for each query row against every other row.

    Candidates and queries are packed into blocks of bounded size, candidates in an order in which groups have like segment statistics; every query block meets every candidate block
    once. In a pair of blocks, upper bounds from segment means and deviations, coarse to fine, drop whole groups and then pairs that can't reach the query's k-th
    best exact score so far; exact scores of the survivors give the block's best k, and a window the best k of all.

    Vectors that are null, empty, or hold null or non-finite components take no part; nor do rows with a null id. Vectors are compared
    with those of equal length only. Rows with the query's own id are not its candidates. Ties go to smaller ids. Scaled components beyond 2**62 count as 2**62, scores beyond a long as its ends. No query or no
    candidate gives no rows; columns other than id and vector are ignored. Returns query_id, rank (from 1), id, score.
    """
    return top_k_and_survivors(vectors, is_query, k, scale, id_col, vec_col)[0]


def top_k_and_survivors(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """exact_top_k, and (step, pairs): pairs in all (step 0), in groups that survive each level, and that survive each level of their own bounds."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    rows = vectors.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.size(vec_col).alias("dim"), is_query.alias("asks")
    )
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_c, n_q = max(1, math.ceil(n / CANDIDATES_A_BLOCK)), max(1, math.ceil(asked / QUERIES_A_BLOCK))
    packed = "dim int, block long, ids binary, data binary, width int"
    into = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).alias("block")
    cands = ws.save(rows.select("id", "vec", "dim", into(n_c)).groupBy("dim", "block").applyInArrow(_pack(scale), packed), "candidates")
    asks = ws.save(rows.filter("asks").select("id", "vec", "dim", into(n_q)).groupBy("dim", "block").applyInArrow(_pack(scale), packed), "queries")
    left = asks.withColumnRenamed("block", "qb").withColumn("cb", _each(n_c))
    right = cands.withColumnRenamed("block", "cb").withColumn("qb", _each(n_q))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        out = ([], [], [])
        if q.num_rows and c.num_rows:
            q_ids, qx = _unpack(q)
            c_ids, cx = _unpack(c)
            r, s, score, pairs = block_top_k(q_ids, qx, c_ids, cx, k)
            none = np.ma.masked_all(len(pairs), np.int64)  # a row without a query counts the survivors of a step
            out = (np.ma.concatenate([q_ids[r], none]), np.concatenate([c_ids[s], np.arange(len(pairs))]), np.concatenate([score, pairs]))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "id", "score"])

    keys = ("dim", "qb", "cb")
    near = ws.save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score long"), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = near.filter("query_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    pairs = near.filter("query_id IS NULL").groupBy(F.col("id").alias("step")).agg(F.sum("score").alias("pairs"))
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score"), pairs
