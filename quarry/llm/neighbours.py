"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, connected_components
from quarry.llm.topk import usable

LINKS, LINKS_BASE = 12, 24  #: neighbours of a node on upper layers and on the base layer
BUILD_BEAM, FIRST_BEAM = 48, 32
LEAST_SHARD, MOST_SHARD = 1024, 200_000  #: vectors of a shard
SHARD_BYTES = 128 << 20  #: of a shard's vectors in double precision
FEW_SHARDS = 8
QUERY_GROUP, PACK = 32_768, 1024  #: queries that meet a shard in one task, and rows of one packed blob
AUDITED, AUDIT_RECALL = 64, 0.99
MOST_DRAWN = 2048  #: queries at most that are held against a whole shard for an audit
FEW_LINKS = 64  #: links in one shard up to which a query names them, so that a link found from one side alone counts on both
BATCH = 512
NAMED, COUNTED, NEEDED, AUDIT = range(4)  #: kinds of a search task's rows


class Hnsw:
    """Layers of neighbour lists over unit vectors; nodes are inserted in batches, those of high layers first."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = x.astype(np.float32)
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")
        level = level[self.order]
        self.x = self.x[self.order]  # from here on node i is the i-th inserted: layer l holds the first sizes[l] nodes
        self.sizes = [int((level >= lv).sum()) for lv in range(int(level.max(initial=0)) + 1)]
        self.lists = [np.full((s, LINKS_BASE if lv == 0 else LINKS), -1, np.int32) for lv, s in enumerate(self.sizes)]
        at = 0
        while at < n:
            step = min(n - at, max(32, min(at, BATCH)))
            self._insert(at, at + step)
            at += step

    @classmethod
    def load(cls, blob: bytes) -> Hnsw:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as f:
            self.x, self.order = f["x"], f["order"]
            self.lists = [f[f"lists{k}"] for k in range(int(f["layers"]))]
        self.sizes = [len(a) for a in self.lists]
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, order=self.order, layers=len(self.lists), **{f"lists{k}": a for k, a in enumerate(self.lists)})
        return out.getvalue()

    def _insert(self, a: int, b: int) -> None:
        q = self.x[a:b]
        mates = q @ q.T
        np.fill_diagonal(mates, -2)
        entry = np.zeros((b - a, 1), np.int64)
        for lv in range(len(self.sizes) - 1, -1, -1):
            new = min(b, self.sizes[lv]) - a  # the batch's nodes on this layer come first
            seen = min(a, self.sizes[lv])
            ids, sims = np.full((b - a, 0), -1), np.zeros((b - a, 0), np.float32)
            if seen:
                ids, sims = self._beam(q, entry, lv, BUILD_BEAM if new > 0 else 1, limit=seen)
                entry = ids[:, :4] if new > 0 else ids[:, :1]
                entry = np.where(entry < 0, ids[:, :1], entry)
            if new <= 0:
                continue
            k = min(LINKS, new - 1)
            if k > 0:
                near = np.argpartition(-mates[:new, :new], k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids[:new], near + a], axis=1)
                sims = np.concatenate([sims[:new], np.take_along_axis(mates[:new, :new], near, 1)], axis=1)
            else:
                ids, sims = ids[:new], sims[:new]
            if not ids.shape[1]:
                continue
            width = self.lists[lv].shape[1]
            chosen = self._select(ids, sims, LINKS if lv else LINKS)
            self.lists[lv][a : a + new, : chosen.shape[1]] = chosen
            self._link_back(lv, np.arange(a, a + new), chosen, width)

    def _select(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """At most m neighbours of each row, near ones first, leaving out those nearer to a chosen one than to the node;
        what is left out fills the places that remain."""
        sims = np.where(ids < 0, -3, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * m]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        x = self.x[np.maximum(ids, 0)]
        between = np.matmul(x, x.transpose(0, 2, 1))
        n, c = ids.shape
        taken = np.zeros((n, c), bool)
        count = np.zeros(n, np.int64)
        for j in range(c):
            close = (np.where(taken, between[:, j], -3) > sims[:, j : j + 1]).any(axis=1)
            ok = (ids[:, j] >= 0) & ~close & (count < m)
            taken[:, j] = ok
            count += ok
        rank = np.where(ids < 0, 2, np.where(taken, 0, 1))
        first = np.argsort(rank, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(ids, first, 1)

    def _link_back(self, lv: int, nodes: np.ndarray, chosen: np.ndarray, width: int) -> None:
        to, back = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        keep = to >= 0
        to, back = to[keep], back[keep]
        owners = np.unique(to)
        old = self.lists[lv][owners]
        owner = np.concatenate([np.repeat(owners, width), to])
        cand = np.concatenate([old.ravel(), back])
        keep = cand >= 0
        pair = np.unique(np.stack([owner[keep], cand[keep]], axis=1), axis=0)
        sim = np.einsum("ij,ij->i", self.x[pair[:, 0]], self.x[pair[:, 1]])
        o = np.lexsort((-sim, pair[:, 0]))
        pair, sim = pair[o], sim[o]
        place = np.arange(len(pair)) - np.searchsorted(pair[:, 0], pair[:, 0])
        keep = place < 2 * width
        pair, sim, place = pair[keep], sim[keep], place[keep]
        row = np.searchsorted(owners, pair[:, 0])
        ids = np.full((len(owners), int(place.max()) + 1), -1, np.int64)
        sims = np.full(ids.shape, -3, np.float32)
        ids[row, place], sims[row, place] = pair[:, 1], sim
        full = (ids >= 0).sum(1) > width
        lists = np.full((len(owners), width), -1, np.int64)
        w = min(width, ids.shape[1])
        lists[~full, :w] = ids[~full, :w]
        if full.any():
            got = self._select(ids[full], sims[full], width)
            lists[full, : got.shape[1]] = got
        self.lists[lv][owners] = lists

    def _beam(self, q: np.ndarray, entry: np.ndarray, lv: int, ef: int, limit: int | None = None):
        """(ids, similarities), best first, of a beam of width ef for each query on one layer."""
        n = self.sizes[lv] if limit is None else limit
        lists, rows = self.lists[lv], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last column stands for "no node"
        ids = np.where((entry < 0) | (entry >= n), n, entry)
        first = np.ones(ids.shape, bool)
        for j in range(1, ids.shape[1]):
            first[:, j] = (ids[:, j : j + 1] != ids[:, :j]).all(axis=1)
        ids = np.where(first, ids, n)
        seen[rows, ids] = True
        sims = np.einsum("bkd,bd->bk", self.x[np.minimum(ids, len(self.x) - 1)], q)
        sims = np.where(ids == n, -4, sims).astype(np.float32)
        done = ids == n
        active = np.arange(len(q))
        ids, sims, done = _widen(ids, n, ef), _widen(sims, -4, ef), _widen(done, True, ef)
        wide = 1 if ef < 4 else 4
        while active.size:
            r = np.arange(len(active))[:, None]
            a_ids, a_sims, a_done = ids[active], sims[active], done[active]
            pick = np.argsort(a_done, axis=1, kind="stable")[:, :wide]  # the best that aren't expanded
            fresh = ~np.take_along_axis(a_done, pick, 1)
            node = np.where(fresh, np.take_along_axis(a_ids, pick, 1), n)
            np.put_along_axis(a_done, pick, True, 1)
            near = lists[np.minimum(node, len(lists) - 1)].astype(np.int64)
            near = np.where((node == n)[:, :, None] | (near < 0) | (near >= n), n, near).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near = np.where(seen[active[:, None], near], n, near)
            seen[active[:, None], near] = True
            seen[active, n] = False
            near = np.sort(near, axis=1)  # what is new comes first
            near = near[:, : max(1, int((near < n).sum(1).max()))]
            got = np.einsum("bkd,bd->bk", self.x[np.minimum(near, len(self.x) - 1)], q[active])
            got = np.where(near == n, -4, got).astype(np.float32)
            all_ids = np.concatenate([a_ids, near], axis=1)
            all_sims = np.concatenate([a_sims, got], axis=1)
            all_done = np.concatenate([a_done, near == n], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[active], sims[active], done[active] = all_ids[r, best], all_sims[r, best], all_done[r, best]
            active = active[~done[active].all(axis=1)]
        return np.where(ids == n, -1, ids), sims

    def search(self, q: np.ndarray, ef: int):
        q = q.astype(np.float32)
        entry = np.zeros((len(q), 1), np.int64)
        for lv in range(len(self.sizes) - 1, 0, -1):
            entry = self._beam(q, entry, lv, 1)[0]
        return self._beam(q, entry, 0, ef)


def _widen(a: np.ndarray, fill, width: int) -> np.ndarray:
    if a.shape[1] >= width:
        return a[:, :width].copy()
    return np.concatenate([a, np.full((len(a), width - a.shape[1]), fill, a.dtype)], axis=1)


class Forest:
    """Union-find that answers which links were needed."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        p = self.parent[nodes]
        while (self.parent[p] != p).any():
            p = self.parent[p]
        self.parent[nodes] = p
        return p

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        used = []
        ra, rb = self.roots(a), self.roots(b)
        apart = ra != rb
        if not apart.any():
            return used
        pairs, at = np.unique(np.stack([ra[apart], rb[apart]], axis=1), axis=0, return_index=True)
        a, b = a[apart][at], b[apart][at]
        for (x, y), u, v in zip(pairs.tolist(), a.tolist(), b.tolist(), strict=True):
            while self.parent[x] != x:
                x = self.parent[x]
            while self.parent[y] != y:
                y = self.parent[y]
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                used.append((u, v))
        return used


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; rows are scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def audited_beam(graph: Hnsw, shard_x: np.ndarray, shard_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, threshold: float) -> tuple[int, int, int]:
    """(beam, true links of the audited queries, of these found): the narrowest doubled beam that passes.

    Queries are drawn and compared with the whole shard until AUDITED of them have links but too few to fill the beam, or MOST_DRAWN are drawn; full beams widen on their
    own. The beam is doubled until the mean over audited queries of the share of their links that is found reaches AUDIT_RECALL.
    """
    ef = min(FIRST_BEAM, len(shard_ids))
    drawn = np.random.default_rng(len(q)).permutation(len(q))[:MOST_DRAWN]
    picked, truths, have = [], [], 0
    for a in range(0, len(drawn), 4 * AUDITED):
        part = drawn[a : a + 4 * AUDITED]
        truth = (q[part] @ shard_x.T >= threshold) & (q_ids[part][:, None] != shard_ids[None])
        some = np.flatnonzero((truth.sum(1) > 0) & (truth.sum(1) < ef - 1))
        picked.append(part[some])
        truths.append(truth[some])
        have += len(some)
        if have >= AUDITED:
            break
    rows, truth = (np.concatenate(picked), np.concatenate(truths)) if picked else (np.zeros(0, np.int64), np.zeros((0, len(shard_ids)), bool))
    hits = 0
    while len(rows):
        ids, _ = graph.search(q[rows], ef)
        row, col = np.nonzero(ids >= 0)
        found = np.zeros(truth.shape, bool)
        found[row, graph.order[ids[row, col]]] = True
        each = (found & truth).sum(1)
        hits = int(each.sum())
        if (each / truth.sum(1)).mean() >= AUDIT_RECALL or ef >= len(shard_ids):
            break
        ef *= 2
    return min(ef, len(shard_ids)), int(truth.sum()), hits


def links_in_shard(graph: Hnsw, shard_x: np.ndarray, shard_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, threshold: float, ef: int):
    """Yield (query rows, shard rows) of the verified links of each batch of queries; all links of a query come in one batch.

    The beam starts at `ef`, which an audit has passed (see audited_beam). A query whose beam holds nothing below the threshold may have missed links: its beam is
    doubled, and beyond an eighth of the shard it is compared with all of it.
    """
    slack = 1e-4  # the graph's similarities are in single precision
    most = max(4 * ef, len(shard_ids) // 8)
    step = max(1, min(BATCH, (1 << 25) // (len(shard_ids) + 1)))
    for a in range(0, len(q), step):
        todo, width = np.arange(a, min(a + step, len(q))), ef
        while todo.size:
            if width > most or width >= len(shard_ids):  # an exact way for the rest
                row, col = np.nonzero(q[todo] @ shard_x.T >= threshold - slack)
                row, todo = todo[row], todo[:0]
            else:
                ids, sims = graph.search(q[todo], width)
                full = (sims[:, -1] >= threshold - slack) & (ids[:, -1] >= 0)
                r, c = np.nonzero((sims >= threshold - slack) & (ids >= 0) & ~full[:, None])
                row, col = todo[r], graph.order[ids[r, c]]
                todo, width = todo[full], 2 * width
            other = q_ids[row] != shard_ids[col]
            row, col = row[other], col[other]
            exact = np.empty(len(row))
            for s in range(0, len(row), 1 << 16):
                exact[s : s + (1 << 16)] = np.einsum("ij,ij->i", q[row[s : s + (1 << 16)]], shard_x[col[s : s + (1 << 16)]])
            keep = exact >= threshold
            if keep.any():
                yield row[keep], col[keep]


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, np.asarray(flat).reshape(len(ids), -1)


def _build(table: pa.Table) -> pa.Table:
    ids, x = _vectors(table)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    graph = Hnsw(_unit(x))
    return pa.Table.from_arrays(
        [pa.array([table.column(c)[0].as_py()], t) for c, t in (("dim", pa.int32()), ("shard", pa.int64()))]
        + [pa.array([ids.astype("<i8").tobytes()]), pa.array([x.astype("<f8" if x.dtype == np.float64 else "<f4").tobytes()]), pa.array([x.dtype.itemsize], pa.int32()), pa.array([graph.dump()])],
        ["dim", "shard", "ids", "data", "width", "graph"],
    )


def _pack(table: pa.Table) -> pa.Table:
    ids, x = _vectors(table)
    return pa.Table.from_arrays(
        [pa.array([table.column(c)[0].as_py()], t) for c, t in (("dim", pa.int32()), ("pack", pa.int64()))]
        + [pa.array([ids.astype("<i8").tobytes()]), pa.array([x.tobytes()]), pa.array([x.dtype.itemsize], pa.int32())],
        ["dim", "pack", "ids", "data", "width"],
    )


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(b.as_buffer(), "<i8") for b in table.column("ids")])
    width, dim = table.column("width")[0].as_py(), table.column("dim")[0].as_py()
    x = np.concatenate([np.frombuffer(b.as_buffer(), f"<f{width}").reshape(-1, dim) for b in table.column("data")])
    return ids, x


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least `threshold`, and unite them into components.

    Vectors are dealt to shards by the hash of their id; each shard builds a navigable small-world graph. Every vector queries every
    shard, with a beam that audits have passed (see audited_beam, links_in_shard). Each task passes on only the links that its
    union-find needed, so a dense group costs counts and a forest, not all its pairs. A query with up to FEW_LINKS links in a shard names them: a link that one side alone has found
    counts on both. Of a query with more links the task gives their number.

    Returns id, n_links (other ids linked directly), component_id (the smallest id reachable, itself included), kept (id is its component's).
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of unequal length don't link.
    Rows with a null id have no links and a null component, and aren't kept. Rows that repeat an id don't link with each other. Other columns are ignored.
    """
    return near_vectors_and_audit(vectors, threshold, id_col, vec_col)[0]


def near_vectors_and_audit(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """near_vectors, and one row (truths, hits): true links of all audited queries, and those that the graphs found at the beams that were used."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "neighbours")
    zero = F.forall(vec_col, lambda x: x == 0)
    good = vectors.filter(F.col(id_col).isNotNull() & usable(vec_col)).filter(~zero)
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"))
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)) * 8).first()
    shards = max(min(FEW_SHARDS, math.ceil(n / LEAST_SHARD)), math.ceil(n / MOST_SHARD), math.ceil(held / SHARD_BYTES), 1)
    dealt = lambda m, name: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(m).cast("long")).alias(name)
    graphs = ws.save(
        rows.select("id", "vec", "dim", dealt(shards, "shard")).groupBy("dim", "shard")
        .applyInArrow(_build, "dim int, shard long, ids binary, data binary, width int, graph binary"), "graphs"
    )
    packs = math.ceil(n / PACK) or 1
    asks = ws.save(
        rows.select("id", "vec", "dim", dealt(packs, "pack")).groupBy("dim", "pack")
        .applyInArrow(_pack, "dim int, pack long, ids binary, data binary, width int"), "queries"
    )
    groups = max(1, math.ceil(n / QUERY_GROUP))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = graphs.withColumn("group", each(groups))
    right = asks.withColumn("group", F.pmod("pack", F.lit(groups).cast("long"))).withColumn("shard", each(shards))

    def search(g: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if g.num_rows and q.num_rows:
            c_ids, cx = _load(g)
            q_ids, qx = _load(q)
            cx, qx = _unit(cx), _unit(qx)
            graph = Hnsw.load(g.column("graph")[0].as_py())
            names = np.unique(np.concatenate([q_ids, c_ids]))
            q_at, c_at = np.searchsorted(names, q_ids), np.searchsorted(names, c_ids)
            forest, shard = Forest(len(names)), g.column("shard")[0].as_py()
            ef, truths, hits = audited_beam(graph, cx, c_ids, qx, q_ids, threshold)
            out.append((AUDIT, truths, hits, shard, 0))
            for row, col in links_in_shard(graph, cx, c_ids, qx, q_ids, threshold, ef):
                pair = np.unique(np.stack([q_at[row], c_at[col]], axis=1), axis=0)
                own, first, count = np.unique(pair[:, 0], return_index=True, return_counts=True)
                for i, at, n in zip(own.tolist(), first.tolist(), count.tolist(), strict=True):
                    if n <= FEW_LINKS:
                        out += [(NAMED, int(names[i]), int(names[v]), shard, 1) for v in pair[at : at + n, 1].tolist()]
                    else:
                        out.append((COUNTED, int(names[i]), None, shard, n))
                out += [(NEEDED, int(names[u]), int(names[v]), shard, 0) for u, v in forest.join(pair[:, 0], pair[:, 1])]
        cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
        kinds = [pa.int32(), *[pa.int64()] * 4]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "u", "v", "shard", "n"])

    keys = ("dim", "shard", "group")
    found = ws.save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "kind int, u long, v long, shard long, n long"), "links")
    named, counted = found.filter(F.col("kind") == NAMED), found.filter(F.col("kind") == COUNTED).groupBy("u", "shard").agg(F.max("n").alias("n"))
    # A link from one side stands in the other vector's shard as well; where that side has counted its links there, the count holds.
    both = named.select("u", "v", "shard").unionByName(named.select(F.col("v").alias("u"), F.col("u").alias("v"), F.pmod(F.xxhash64("u", F.lit("shard")), F.lit(shards).cast("long")).alias("shard")))
    both = both.distinct().join(counted.select("u", "shard"), ["u", "shard"], "left_anti")
    counts = both.select("u", F.lit(1).cast("long").alias("n")).unionByName(counted.select("u", "n")).groupBy("u").agg(F.sum("n").alias("n_links"))
    audit = found.filter(F.col("kind") == AUDIT).agg(F.coalesce(F.sum("u"), F.lit(0).cast("long")).alias("truths"), F.coalesce(F.sum("v"), F.lit(0).cast("long")).alias("hits"))
    components = connected_components(ws, found.filter(F.col("kind") == NEEDED).select("u", "v"))
    ids = vectors.select(F.col(id_col))
    key = ids[id_col].cast("long")
    out = (
        ids.join(counts, key == counts["u"], "left")
        .join(components, key == components["node"], "left")
        .select(
            F.col(id_col),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", F.col(id_col)).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )
    return out, audit
