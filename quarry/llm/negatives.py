"""Hard negatives: close rows of other labels, found by branch and bound over ball trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, shuffle_partitions, small_batches
from quarry.llm.topk import FAR, HIGHEST, LOWEST, exact_scores, usable

LEAF = 64  #: rows of a tree's leaf
BLOCK_BYTES, TREE_BYTES = 1 << 18, 16 << 20  #: of a packed block and of the blocks of one tree
QUERIES_A_BLOCK, LEAST_TREE_ROWS = 256, 4096
LEAVES_AT_ONCE = 8


class BallTree:
    """A tree that halves its rows along the line through two far points, down to LEAF rows; each node is a ball with the range of its labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        n = len(ids)
        order, levels, nodes = np.arange(n), [], [(0, n)]
        points = x.astype(np.float64 if np.abs(x).max(initial=0) >= 1 << 24 else np.float32)
        while nodes:
            levels.append(np.array(nodes, np.int64))
            nodes = []
            for a, b in levels[-1].tolist():
                if b - a <= LEAF:
                    continue
                own = points[order[a:b]]
                first = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
                second = own[np.argmax(((own - first) ** 2).sum(1))]
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (second - first), middle)]
                nodes += [(a, a + middle), (a + middle, b)]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        points = points[order].astype(np.float64)
        self.longest, self.levels = float(np.linalg.norm(points, axis=1).max(initial=0)), []
        for spans in levels:
            center = np.stack([points[a:b].mean(0) for a, b in spans])
            radius = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, center, strict=True)])
            low, high = np.minimum.reduceat(self.labels, spans[:, 0]), np.maximum.reduceat(self.labels, spans[:, 0])
            for k in np.flatnonzero(np.append(spans[1:, 0], n) != spans[:, 1]).tolist():  # a leaf of a level above stands between
                own = self.labels[spans[k, 0] : spans[k, 1]]
                low[k], high[k] = own.min(), own.max()
            self.levels.append((spans, center, radius, low, high))

    def leaves(self, q: np.ndarray, labels: np.ndarray, floor: np.ndarray, roof: np.ndarray, same: bool):
        """(first row, last row, upper bounds, lower bounds, mask of queries) of the leaves that bounds and labels leave to at least one query.

        floor and roof: the least and greatest score that each query still takes. The inner product of a query and any row of a ball lies within the query's
        length times the radius of its product with the centre; a child is only looked at for the queries that its parent leaves.
        """
        length = np.linalg.norm(q, axis=1)
        slack = 1e-3 + 1e-9 * length * self.longest
        found, alive, cols = [], np.ones((len(q), 1), bool), np.arange(1)
        for spans, center, radius, low, high in self.levels:
            product, reach = q @ center[cols].T, length[:, None] * radius[cols]
            upper, lower = product + reach + slack[:, None], product - reach - slack[:, None]
            alive &= (upper >= floor[:, None]) & (lower <= roof[:, None])
            if same:
                alive &= (low[cols] <= labels[:, None]) & (labels[:, None] <= high[cols])
            else:
                alive &= ~((low[cols] == high[cols]) & (low[cols] == labels[:, None]))
            some = alive.any(0)
            leaf = spans[cols, 1] - spans[cols, 0] <= LEAF
            for k in np.flatnonzero(some & leaf).tolist():
                found.append((*spans[cols[k]].tolist(), upper[:, k], lower[:, k], alive[:, k].copy()))
            inner = np.flatnonzero(some & ~leaf)
            if not len(inner):
                break
            # The inner nodes of a level, in order, have the next level's nodes as children, two each.
            rank = np.cumsum(spans[:, 1] - spans[:, 0] > LEAF) - 1
            cols = np.stack([2 * rank[cols[inner]], 2 * rank[cols[inner]] + 1], 1).ravel()
            alive = np.repeat(alive[:, inner], 2, axis=1)
        return found


def search(tree: BallTree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
    """(query, window, row id, score) of the k best rows of the same label, or of other labels, in each of a query's windows of scores; ties to smaller ids. Also the pairs in leaves that were opened.

    low and high: queries x windows, both included. A node goes for a query when its upper bound is under all windows' lower ends or strictly beneath the scores to beat there, or its lower bound over all
    upper ends. Each query's most promising leaf is opened first, so that the others meet scores to beat; then the rest, the most promising first and a few at a time.
    """
    n, windows = low.shape
    beat, beat_id = low.copy(), np.full(low.shape, HIGHEST)  # the k-th best so far, or what the window asks
    best: list[np.ndarray] = [np.zeros(0, np.int64)] * 3  # query * windows + window, id, score
    opened = 0

    def look(some: list, open_to: list[np.ndarray]) -> None:
        """Meet the rows of some leaves with the queries that each is open to."""
        nonlocal best, opened
        rows = np.flatnonzero(np.any(open_to, axis=0))
        cols = np.concatenate([np.arange(leaf[0], leaf[1]) for leaf in some])
        mask = np.repeat(np.stack(open_to, 1)[rows], [leaf[1] - leaf[0] for leaf in some], axis=1)
        opened += int(mask.sum())
        score, col_ids = exact_scores(q[rows], tree.x[cols]), tree.ids[cols]
        mask &= (labels[rows][:, None] == tree.labels[cols]) == same
        mask &= ids[rows][:, None] != col_ids
        for w in range(windows):
            live = mask & (score <= high[rows, w, None]) & ((score > beat[rows, w, None]) | (score == beat[rows, w, None]) & (col_ids <= beat_id[rows, w, None]))
            r, c = np.nonzero(live)
            if not len(r):
                continue
            key = rows[r] * windows + w
            touched = np.isin(best[0], key)
            own = [np.concatenate([b[touched], new]) for b, new in zip(best, (key, col_ids[c], score[r, c]), strict=True)]
            order = np.lexsort((own[1], ~own[2], own[0]))
            own = [o[order] for o in own]
            place = np.arange(len(order)) - np.searchsorted(own[0], own[0])
            last = place == k - 1
            beat[own[0][last] // windows, w], beat_id[own[0][last] // windows, w] = own[2][last], own[1][last]
            best = [np.concatenate([b[~touched], o[place < k]]) for b, o in zip(best, own, strict=True)]

    left = tree.leaves(q.astype(np.float64), labels, low.min(1).astype(np.float64), high.max(1).astype(np.float64), same)
    if left:
        first = np.argmax(np.stack([np.where(leaf[4], leaf[2], -np.inf) for leaf in left]), axis=0)
        for at in np.unique(first).tolist():
            own = left[at][4] & (first == at)
            if own.any():
                look([left[at]], [own])
                left[at][4][own] = False
    left = [leaf for leaf in left if leaf[4].any()]
    left.sort(key=lambda leaf: -float(leaf[2][leaf[4]].max()))
    for at in range(0, len(left), LEAVES_AT_ONCE):
        some = left[at : at + LEAVES_AT_ONCE]
        open_to = [leaf[4] & ((leaf[2][:, None] >= beat) & (leaf[3][:, None] <= high) & (low <= high)).any(1) for leaf in some]
        some, open_to = [s for s, o in zip(some, open_to, strict=True) if o.any()], [o for o in open_to if o.any()]
        if some:
            look(some, open_to)
    return best[0] // windows, best[0] % windows, best[1], best[2], opened


PACKED = "kind int, part long, nth long, dim int, n int, windows int, width int, ids binary, labels binary, uids binary, low binary, high binary, data binary"


def _packed(kind: int, part: int, nth: int, dim: int, ids, labels, uids, whole: np.ndarray, low=None, high=None) -> pa.RecordBatch:
    most = int(np.abs(whole).max(initial=0))
    data = whole.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
    cells = [kind, part, nth, dim, len(ids), 0 if low is None else low.shape[1], data.itemsize, *(None if x is None else x.astype("<i8").tobytes() for x in (ids, labels, uids, low, high)), data.tobytes()]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], kinds[t]) for c, (_, t) in zip(cells, fields, strict=True)], [name for name, _ in fields])


def _scaled(column: pa.Array, scale: int, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -FAR, FAR).astype(np.int64).reshape(-1, dim)


def _pack_rows(scale: int):
    """Rows in blocks of about BLOCK_BYTES, where they are read."""

    def run(batches):
        part, nth, held = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                held.setdefault(dim, []).append((own.column("id").to_numpy(), own.column("label").to_numpy(), _scaled(own.column("vec"), scale, dim)))
                if sum(x.size for _, _, x in held[dim]) * 2 >= BLOCK_BYTES:
                    ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
                    yield _packed(0, part, nth, dim, ids, labels, None, x)
                    nth += 1
        for dim, parts in held.items():
            ids, labels, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield _packed(0, part, nth, dim, ids, labels, None, x)
            nth += 1

    return run


def _pack_queries(scale: int, low: int, high: int, windows: int):
    """A block of queries; a window for each of the scores that it comes with: low to high percent of the score. Without scores, one window of all."""

    def run(table: pa.Table) -> pa.Table:
        dim, n = table.column("dim")[0].as_py(), table.num_rows
        ends = [np.full((n, windows), 1), np.zeros((n, windows), np.int64)]  # empty windows
        if "scores" not in table.column_names:
            ends = [np.full((n, 1), LOWEST), np.full((n, 1), HIGHEST)]
        else:
            for i, scores in enumerate(table.column("scores").to_pylist()):
                for w, s in enumerate(scores):
                    ends[0][i, w], ends[1][i, w] = max(LOWEST, -(-low * s // 100)), min(HIGHEST, high * s // 100)
        cells = [table.column(c).to_numpy() for c in ("id", "label", "uid")]
        return pa.Table.from_batches([_packed(1, 0, table.column("block")[0].as_py(), dim, *cells, _scaled(table.column("vec").combine_chunks(), scale, dim), *ends)])

    return run


def _unpack(row: dict, names: tuple[str, ...]) -> list[np.ndarray]:
    out = [np.frombuffer(row[c], "<i8") for c in names]
    return [*out, np.frombuffer(row["data"], f"<i{row['width']}").reshape(-1, row["dim"])]


FOUND = "uid long, window int, id long, score long"


def _search_blocks(k: int, same: bool):
    """Blocks of one tree's rows come first, then every block of queries."""

    def run(batches):
        tree_of, trees, held = None, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["tree"] != tree_of:
                    tree_of, trees, held = row["tree"], {}, {}
                if row["kind"] == 0:
                    held.setdefault(row["dim"], []).append(_unpack(row, ("ids", "labels")))
                    continue
                for dim, blocks in held.items():
                    ids, labels, x = (np.concatenate(c) for c in zip(*blocks, strict=True))
                    trees[dim] = BallTree(ids, labels, x)
                held = {}
                ids, labels, uids, low, high, q = _unpack(row, ("ids", "labels", "uids", "low", "high"))
                shape = (len(ids), row["windows"])
                out = [np.zeros(0, np.int64)] * 4
                if row["dim"] in trees:
                    at, window, found, score, opened = search(trees[row["dim"]], ids, labels, q.astype(np.int64), low.reshape(shape), high.reshape(shape), k, same)
                    pairs = len(ids) * len(trees[row["dim"]].ids)
                    out = [pa.array([*uids[at].tolist(), None, None], pa.int64()), np.append(window, [0, 1]), np.append(found, [0, 0]), np.append(score, [pairs, opened])]  # rows without a query count pairs
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    return run


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of other labels that score low to high percent of the positive's score.

    Scores are inner products of floor(scale * x), higher first, ties to smaller ids. Rows are packed into blocks where they are read and dealt to trees of at most about
    TREE_BYTES; every block of anchors passes every tree once for the positives and once, with a window of scores a positive, for the negatives. A ball tree bounds
    the inner products of a node's rows from both sides: nodes outside the windows or strictly beneath the current k-th score are left closed. Only the best of each tree are shuffled and merged.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; vectors are compared with those of equal length only. A row with the anchor's id is not one of
    its candidates; anchors that repeat an id are anchors of their own. Anchors without positives, and positives without negatives, give no rows; a negative score of a positive leaves its window empty.
    Scaled components beyond 2**62 count as 2**62 and scores beyond a long as its ends. Other columns are ignored. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    return negatives_and_pairs(vectors, is_anchor, label, positives, negatives, low, high, scale, id_col, vec_col)[0]


def negatives_and_pairs(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """mine_hard_negatives, and (pass, opened, pairs): pairs of anchors and rows in all and in leaves that the bounds left, for positives and for negatives."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), is_anchor.alias("asks"))
    rows = rows.filter(usable("vec") & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumn("dim", F.size("vec"))
    blocks = ws.save(rows.select("id", "label", "vec", "dim").mapInArrow(_pack_rows(scale), PACKED), "blocks")
    anchors = ws.save(rows.filter("asks").select(F.monotonically_increasing_id().alias("uid"), "id", "label", "vec", "dim"), "anchors")
    held, n = blocks.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    trees = max(1, math.ceil(held / TREE_BYTES), min(shuffle_partitions(spark), n // LEAST_TREE_ROWS))
    dealt = blocks.withColumn("tree", F.pmod(F.col("part") + F.col("nth"), F.lit(trees)))
    into = F.pmod(F.xxhash64("uid"), F.lit(max(1, math.ceil(anchors.count() / QUERIES_A_BLOCK)))).alias("block")
    each_tree = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")))

    def best(asks: DataFrame, windows: int, k: int, same: bool, name: str) -> tuple[DataFrame, DataFrame]:
        queries = asks.groupBy("dim", "block").applyInArrow(_pack_queries(scale, low, high, windows), PACKED)
        queries = ws.save(queries, f"{name}-queries").withColumn("tree", each_tree)
        with small_batches(spark, 64):  # a packed block has about BLOCK_BYTES
            met = dealt.unionByName(queries).repartition(trees, "tree").sortWithinPartitions("tree", "kind", "part", "nth")
            found = ws.save(met.mapInArrow(_search_blocks(k, same), FOUND), name)
        order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id")
        ranked = found.filter("uid IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        counted = found.filter("uid IS NULL").groupBy((F.col("window") == 1).alias("opened")).agg(F.sum("score").alias("pairs"))
        return ranked, counted.select(F.lit(name).alias("pass"), "opened", "pairs")

    asks = anchors.select("uid", "id", "label", "vec", "dim", into)
    nearest, first = best(asks, 1, positives, True, "positives")
    nearest = ws.save(nearest.select("uid", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "nearest")
    scores = nearest.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("window", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    hard, second = best(asks.join(scores, "uid"), positives, negatives, False, "negatives")
    hard = hard.select("uid", (F.col("window") + 1).alias("window"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(nearest, ["uid", "window"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), first.unionByName(second)
