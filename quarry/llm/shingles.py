"""Exact Jaccard links between whole texts' word shingles, by R-trees over hashed token counts."""

from __future__ import annotations

import hashlib
import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, connected_components, membership_filter, passing, shuffle_partitions
from quarry.llm.neighbours import Forest
from quarry.llm.repeats import keyed

FREQUENT_TOKENS = 1 << 18  #: tokens at most that are ordered last because they are frequent
FREQUENT_IN_PART = 3  #: texts of one batch that make a token count as repeated there
BATCH_TOKENS = 2 << 20
BLOB_TOKENS = 1 << 19
CACHED_WORDS = 150_000  #: words whose hashes a Python worker remembers
TASK_TEXTS = 512  #: texts of small shards that share a task
SHARD_TEXTS = 1024  #: texts of one shard beyond which it is taken apart around pivots, then dealt out in pairs of blocks
PIVOT_TEXTS = 128  #: texts that one task compares with their pivot
PIVOT_ROUNDS = 4  #: pivots that a large shard is taken apart around; what no pivot parts is dealt out in pairs of blocks
HOT_TEXTS = 1 << 16  #: counted texts of a token beyond which its bucket is dealt to several tasks
GROUPS = (32, 64, 128, 256, 512, 1024, 2048, 4096)
FANOUT = 16

_MIX = np.random.default_rng(23).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_WORD_CACHE: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORD_CACHE) > CACHED_WORDS:
        _WORD_CACHE.clear()
    for w in set(words).difference(_WORD_CACHE):
        _WORD_CACHE[w] = _word_hash(w)
    return np.fromiter(map(_WORD_CACHE.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit fingerprints of the text's distinct shingles of `size` words; of all its words if they are fewer.

    Words are what stands between ASCII white space, with A-Z in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _MIX[i % len(_MIX)] + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    """Tokens in front of the order of which a set of n shares one with every set it can link with."""
    return n - (percent * n + 99) // 100 + 1


def least_overlap(a, b, percent: int):
    """Shared tokens that sets of a and b need: 100 * overlap >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


# First pass: set sizes, signatures, and tokens that recur within a batch of texts.

SETS = "uid long, n long, hi long, lo long, token long, texts long"


def _summaries(size: int):
    names = ["uid", "n", "hi", "lo", "token", "texts"]

    def run(batches):
        rows, held, total, sigs = [], [], 0, set()

        def frequent():
            if not held:
                return None
            t, c = np.unique(np.concatenate(held), return_counts=True)
            t, c = t[c >= FREQUENT_IN_PART], c[c >= FREQUENT_IN_PART]
            none = pa.nulls(len(t), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(t.view(np.int64)), pa.array(c)], names)

        for batch in batches:
            rows = []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), size)
                sig = signature(s)
                rows.append((uid, len(s), *sig))
                if len(s) and sig not in sigs:  # copies don't make a token frequent
                    sigs.add(sig)
                    held.append(s)
                    total += len(s)
                    if total >= BATCH_TOKENS:
                        yield frequent()
                        held, total, sigs = [], 0, set()
            if rows:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), none, none], names)
        if (last := frequent()) is not None:
            yield last

    return run


# Second pass: prefix tokens of every text, packed by the part that their hash falls into.

BLOB = "part int, blob binary"
ROW = np.dtype([("token", "<u8"), ("hi", "<i8"), ("n", "<i4"), ("at", "<i4")])
PART_ROWS = 4_000_000  #: prefix tokens of one part


def pack(rows: np.ndarray) -> bytes:
    """Column after column, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in ROW.names), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    rows = np.empty(len(raw) // ROW.itemsize, ROW)
    at = 0
    for c in ROW.names:
        width = len(rows) * ROW[c].itemsize
        rows[c] = np.frombuffer(raw, ROW[c], len(rows), at)
        at += width
    return rows


def _prefixes(size: int, percent: int, parts: int, hot_parts: int, shared):
    """(part, blob) rows. A token that a batch holds very often is passed on once for each different set there, like any other.

    Parts from `parts` on hold the hot tokens, dealt by set: their buckets have no task of their own.
    """

    def run(batches):
        last, hot = shared.value
        held, total, sigs = [], 0, set()

        def out():
            rows = np.concatenate(held)
            part = (rows["token"] % np.uint64(parts)).astype(np.int32)
            if len(hot):
                is_hot = np.isin(rows["token"], hot)
                part[is_hot] = parts + (rows["hi"][is_hot] % hot_parts).astype(np.int32)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [pack(r) for r in np.split(rows, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size)
                if not len(s):
                    continue
                sig = signature(s)
                if sig in sigs:
                    continue
                sigs.add(sig)
                p = prefix_length(len(s), percent)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common = last[at] == s
                    lead = np.concatenate([s[~common][:p], s[common]])[:p]
                else:
                    lead = s[:p]
                rows = np.empty(p, ROW)
                rows["token"], rows["hi"], rows["n"], rows["at"] = lead, sig[0], len(s), np.arange(p)
                held.append(rows)
                total += p
                if total >= BLOB_TOKENS:
                    yield out()
                    held, total, sigs = [], 0, set()
        if held:
            yield out()

    return run


MEMBER = "leader long, hi long, token long"


def _buckets(percent: int, parts: int):
    """For each token that different sets share: which sets may link there, under the name of the smallest of them.

    Two sets that link do so at their first shared token in the order; there the overlap is no more than the tokens that either set has
    from that place on. A set is left out of a bucket if no other set there passes that and the size bound. Sets go by the first
    half of their signature. A part from `parts` on holds sets of hot tokens: all of them stay, under the token, which is named later.
    """

    def fit(a, b):
        """Whether sets a and b (a not larger) may link where they meet."""
        need = least_overlap(a["n"].astype(np.int64), b["n"].astype(np.int64), percent)
        return np.minimum(a["n"] - a["at"], b["n"] - b["at"]) >= need

    def large_bucket(g: np.ndarray) -> np.ndarray:
        n, keep = g["n"].astype(np.int64), np.zeros(len(g), bool)
        reach = np.searchsorted(n, n * 100 // percent, side="right")  # partners are at least as large; sets are in order of size
        for s in range(0, len(g), 512):
            e = min(s + 512, len(g))
            for t in range(s, int(reach[s:e].max()), 512):
                u = min(t + 512, len(g))
                if keep[s:e].all() and keep[t:u].all():
                    continue
                ok = fit(g[s:e, None], g[None, t:u]) & (np.arange(t, u)[None] > np.arange(s, e)[:, None])
                keep[s:e] |= ok.any(1)
                keep[t:u] |= ok.any(0)
        return g[keep]

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([unpack(b.as_buffer()) for b in table.column("blob")])
        rows = rows[np.lexsort((rows["hi"], rows["token"]))]
        again = np.zeros(len(rows), bool)  # the same set from another batch
        again[1:] = (rows["token"][1:] == rows["token"][:-1]) & (rows["hi"][1:] == rows["hi"][:-1])
        rows = rows[~again]
        if table.column("part")[0].as_py() >= parts:
            tokens = pa.array(rows["token"].view(np.int64))
            return pa.Table.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array(rows["hi"]), tokens], ["leader", "hi", "token"])
        first = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])) if len(rows) else np.zeros(0, int)
        size = np.diff(np.append(first, len(rows)))
        two = first[size == 2]
        a, b = rows[two], rows[two + 1]
        swap = a["n"] > b["n"]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ok = fit(a, b)
        lead = np.minimum(a["hi"], b["hi"])[ok]
        out = [np.stack([lead, a["hi"][ok]], axis=1), np.stack([lead, b["hi"][ok]], axis=1)]
        for at, m in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            g = rows[at : at + m]
            g = large_bucket(g[np.argsort(g["n"], kind="stable")])
            if len(g) > 1:
                out.append(np.stack([np.full(len(g), g["hi"].min()), g["hi"]], axis=1))
        all_ = np.unique(np.concatenate(out), axis=0)
        return pa.Table.from_arrays([pa.array(all_[:, 0]), pa.array(all_[:, 1]), pa.nulls(len(all_), pa.int64())], ["leader", "hi", "token"])

    return run


class CountTree:
    """An R-tree over the sets' count vectors: tokens are hashed into groups, coordinates are the groups' counts.

    A leaf holds FANOUT points of near size; a node keeps the largest count of each group and the smallest set size below it. A query's
    overlap with any set below a node is at most the sum of the smaller of its count and the node's.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent, self.vectors, self.sizes = percent, vectors, sizes
        order = np.lexsort((vectors[:, : min(4, vectors.shape[1])].argmax(axis=1), sizes))
        self.levels: list[tuple] = []
        members = [np.array([i]) for i in order]
        high, low, large = vectors[order], sizes[order], sizes[order]
        self.order = order
        while len(members) > 1:
            step = range(0, len(members), FANOUT)
            high = np.array([high[s : s + FANOUT].max(0) for s in step])
            low = np.array([low[s : s + FANOUT].min() for s in step])
            large = np.array([large[s : s + FANOUT].max() for s in step])
            members = [None] * len(high)
            self.levels.append((high, low, large))

    def search(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, bounds) of what may link with a set of n tokens and counts q."""
        at = np.zeros(1, np.int64) if self.levels else np.arange(len(self.order))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, large = self.levels[depth]
            bound = np.minimum(high[at], q).sum(1)
            size = np.maximum(low[at], -(-n * self.percent // 100))
            fine = (bound >= least_overlap(n, size, self.percent)) & (low[at] * self.percent <= 100 * n) & (large[at] * 100 >= n * self.percent)
            at = (at[fine][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < (len(self.levels[depth - 1][0]) if depth else len(self.order))]
        points = self.order[at]
        bound = np.minimum(self.vectors[points], q).sum(1)
        fine = bound >= least_overlap(n, self.sizes[points], self.percent)
        return points[fine], bound[fine]


def count_vectors(sets: list[np.ndarray], groups: int) -> np.ndarray:
    out = np.zeros((len(sets), groups), np.int32)
    for k, s in enumerate(sets):
        out[k] = np.bincount((s >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return out


def groups_for(n: int) -> int:
    """Groups enough that unlike sets of n tokens differ by more than links may."""
    return next((g for g in GROUPS if 6 * g >= n), GROUPS[-1])


VECTOR = "uid long, n long, counts binary"


def widest(n: int, percent: int) -> int:
    """Groups of the largest set that one of n tokens may link with."""
    return groups_for(n * 100 // percent + 1)


def _vectors(size: int, percent: int):
    """Each text's token counts in as many groups as its largest partner has; groups are powers of two, so that narrower counts follow by adding up."""

    def run(batches):
        for batch in batches:
            rows = []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), size)
                if len(s):
                    counts = count_vectors([s], widest(len(s), percent))[0]
                    rows.append((uid, len(s), zstandard.compress((counts.astype("<u2") if counts.max() < 1 << 16 else counts.astype("<i4")).tobytes(), 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["uid", "n", "counts"])

    return run


def _counts(blob: bytes, groups: int) -> np.ndarray:
    raw = zstandard.decompress(blob)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * groups else "<i4").astype(np.int32)


def _narrower(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(0, dtype=np.int32)


def candidate_groups(sizes: np.ndarray, counts: list[np.ndarray], percent: int) -> np.ndarray:
    """The root of each set's group: sets whose count vectors allow a link are in one group. By R-trees over the vectors, a band of sizes each."""
    forest, bands = Forest(len(sizes)), {}
    for i, n in enumerate(sizes.tolist()):
        bands.setdefault(groups_for(n), []).append(i)
    for ga, asking in bands.items():
        for gb, inside in bands.items():
            asks = [i for i in asking if len(counts[i]) >= gb] if gb >= ga else []
            if not asks:
                continue
            tree = CountTree(np.stack([_narrower(counts[i], gb) for i in inside]), sizes[inside], percent)
            own = np.array(inside)
            for i in asks:
                points, _ = tree.search(_narrower(counts[i], gb), int(sizes[i]))
                forest.join(np.full(len(points), i), own[points])
    return forest.roots(np.arange(len(sizes)))


def _grouped(percent: int):
    """Member lists taken apart by count vectors: a list becomes one under each group's smallest set; sets alone in their group leave."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leader", "ascending"), ("uid", "ascending")])
        leader, uid, n = (table.column(c).to_numpy() for c in ("leader", "uid", "n"))
        blobs, out = table.column("counts"), []
        ends = [*(np.flatnonzero(leader[1:] != leader[:-1]) + 1).tolist(), len(leader)]
        for a, b in zip([0, *ends], ends, strict=False):
            counts = [_counts(blobs[k].as_py(), widest(int(n[k]), percent)) for k in range(a, b)]
            root = candidate_groups(n[a:b].astype(np.int64), counts, percent)
            many = np.bincount(root, minlength=b - a)[root] > 1
            out.append(np.stack([uid[a:b][root[many]], uid[a:b][many]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["leader", "uid"])

    return run


def _narrowed(ws: Workspace, rows: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Member lists without the sets that no other set of the list can link with, by their count vectors: most lists only share a token by chance, and their texts need not move.

    Lists of more than SHARD_TEXTS sets stay as they are; they are taken apart around pivots. A list all of whose members have one and the same larger list goes, since they meet there.
    """
    sizes = ws.save(members.groupBy("leader").agg(F.count("*").alias("m")), "sizes")
    small = members.join(sizes.filter(F.col("m") <= SHARD_TEXTS), "leader").select("leader", "uid")
    large = members.join(sizes.filter(F.col("m") > SHARD_TEXTS), "leader").select("leader", "uid")
    asked = ws.save(small.select("uid").distinct(), "asked")
    vectors = passing(rows, "uid", membership_filter(asked, "uid")).mapInArrow(_vectors(size, percent), VECTOR)
    vectors = ws.save(vectors.dropDuplicates(["uid"]), "vectors")
    tasks = members.count() // TASK_TEXTS + 1
    met = small.join(vectors, "uid").withColumn("task", F.pmod(F.xxhash64("leader"), F.lit(tasks)))
    left = ws.save(met.groupBy("task").applyInArrow(_grouped(percent), "leader long, uid long").unionByName(large).distinct(), "grouped")
    counts = ws.save(left.groupBy("leader").agg(F.count("*").alias("m")), "grouped-sizes")
    largest = left.join(counts, "leader").groupBy("uid").agg(F.max_by("leader", F.struct("m", "leader")).alias("largest"))
    inside = left.join(largest, "uid").groupBy("leader").agg(F.min("largest").alias("a"), F.max("largest").alias("b")).filter("a = b AND a <> leader")
    return ws.save(left.join(inside.select("leader"), "leader", "left_anti"), "narrowed")


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def link_sets(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets' components: all pairs that can link are verified, but for pairs that are in one component by then.

    With sides, only pairs of different sides, or of a side with itself where there is one side, are looked for.
    """
    forest, out = Forest(len(sets)), []
    sizes = np.array([len(s) for s in sets], np.int64)
    bands: dict[int, list[int]] = {}
    for i, n in enumerate(sizes.tolist()):
        bands.setdefault(groups_for(n), []).append(i)
    keys = sorted(bands)
    for ga in keys:  # queries of one band against the trees of this and the next larger ones they reach
        largest = max(int(sizes[i]) for i in bands[ga])
        for gb in keys:
            if gb < ga or min(int(sizes[i]) for i in bands[gb]) * percent > 100 * largest:
                continue
            inside = np.array(bands[gb])
            tree = CountTree(count_vectors([sets[i] for i in inside], gb), sizes[inside], percent)
            vectors = count_vectors([sets[i] for i in bands[ga]], gb)
            for i, q in zip(bands[ga], vectors, strict=True):
                points, bound = tree.search(q, int(sizes[i]))
                near = inside[points]
                fine = (near > i) if ga == gb else np.ones(len(near), bool)
                if sides is not None:
                    fine &= sides[near] != sides[i]
                near, bound = near[fine], bound[fine]
                if not len(near):
                    continue
                roots = forest.roots(near)
                mine = int(forest.roots(np.array([i]))[0])
                tried = [(-float(b) / max(1, int(sizes[j])), int(j)) for b, j in zip(bound[roots != mine], near[roots != mine], strict=True)]
                heapq.heapify(tried)
                while tried:
                    _, j = heapq.heappop(tried)
                    if int(forest.roots(np.array([j]))[0]) == int(forest.roots(np.array([i]))[0]):
                        continue
                    if shared_count(sets[i], sets[j]) >= least_overlap(int(sizes[i]), int(sizes[j]), percent):
                        forest.join(np.array([i]), np.array([j]))
                        out.append((i, j))
    return out


def _shards(size: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        uid, leader, b1, b2, block = (table.column(c).to_numpy() for c in ("uid", "leader", "b1", "b2", "block"))
        texts, sets, links = table.column("text"), {}, set()
        for k, u in enumerate(uid.tolist()):
            if u not in sets:
                sets[u] = shingle_set(texts[k].as_py(), size)
        order = np.lexsort((uid, b2, b1, leader))
        name = np.stack([leader, b1, b2], axis=1)[order]
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]).any(axis=1)])) if len(order) else np.zeros(0, int)
        for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
            own = order[a:b]
            sides = None if name[a, 1] == name[a, 2] else block[own]
            here = uid[own].tolist()
            links |= {(here[i], here[j]) for i, j in link_sets([sets[u] for u in here], percent, sides)}
        cols = list(zip(*sorted(links), strict=True)) or [[], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])

    return run


def _beside_pivots(size: int, percent: int):
    """For each text of a shard but its pivot: whether it links with the pivot; texts too far from it to link with any that does are left out."""

    def run(table: pa.Table) -> pa.Table:
        uid, leader, pivot = (table.column(c).to_numpy() for c in ("uid", "leader", "pivot"))
        texts, sets, out = table.column("text"), {}, []
        for k in np.flatnonzero(uid == pivot).tolist():
            sets[int(pivot[k])] = shingle_set(texts[k].as_py(), size)
        for k in np.flatnonzero(uid != pivot).tolist():
            a, b = sets[int(pivot[k])], shingle_set(texts[k].as_py(), size)
            both = shared_count(a, b)
            union = len(a) + len(b) - both
            if 100 * both >= (2 * percent - 100) * union:
                out.append((int(leader[k]), int(uid[k]), int(pivot[k]), 100 * both >= percent * union))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["leader", "uid", "pivot", "linked"])

    return run


def _met(ws: Workspace, rows: DataFrame, places: DataFrame) -> DataFrame:
    """Texts (uid, text) at all their places (uid and further columns). A text goes to its places in one list, which its prefix and the blocks of its largest shard bound."""
    listed = places.groupBy("uid").agg(F.collect_list(F.struct(*[c for c in places.columns if c != "uid"])).alias("at"))
    listed = ws.save(listed, "listed")
    near = passing(rows, "uid", membership_filter(listed, "uid")).dropDuplicates(["uid"])
    return near.join(listed, "uid").select("uid", "text", F.explode("at").alias("at")).select("uid", "text", "at.*")


def _blocks(texts: str, size: int | None = None):
    return F.ceil(F.col(texts) / (size or SHARD_TEXTS))


def _apart(ws: Workspace, rows: DataFrame, members: DataFrame, size: int, percent: int) -> tuple[list, list, DataFrame]:
    """Take shards of more than SHARD_TEXTS texts apart around pivots: (links, places of what still has to meet, members left).

    Each round, every text of such a shard is compared with one text drawn from it, the pivot. Those that link with it are one component and
    need no comparison among each other. Jaccard distance is a metric: a text whose distance to the pivot is more than twice a link's can link with none of them.
    So they only have to meet the texts between, and leave the shard. A group of near copies costs its own size, not the square of it.
    """
    links, places = [], []
    for turn in range(PIVOT_ROUNDS):
        drawn = F.min_by("uid", F.xxhash64("uid", F.lit(turn))).alias("pivot")
        pivots = ws.save(members.groupBy("leader").agg(drawn, F.count("*").alias("m")).filter(F.col("m") > SHARD_TEXTS), "pivots")
        if pivots.limit(1).count() == 0:
            break
        inside = members.join(pivots, "leader").filter("uid <> pivot").withColumn("block", F.pmod(F.xxhash64("uid"), _blocks("m", PIVOT_TEXTS)))
        lead = pivots.withColumn("uid", F.col("pivot")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _blocks("m", PIVOT_TEXTS) - 1)))
        to = [*(F.col(c) for c in ("uid", "leader", "pivot")), F.xxhash64("leader", "block").alias("task")]
        met = _met(ws, rows, inside.select(*to).unionByName(lead.select(*to)))
        found = met.groupBy("task").applyInArrow(_beside_pivots(size, percent), "leader long, uid long, pivot long, linked boolean")
        found = ws.save(found, "beside")
        links.append(found.filter("linked").select(F.col("pivot").alias("u"), F.col("uid").alias("v")))
        sides = found.groupBy("leader").agg(F.count_if("linked").alias("own"), F.count_if(~F.col("linked")).alias("between"))
        own, between, spot = _blocks("own"), _blocks("between"), F.xxhash64("uid")
        meeting = (
            found.join(sides.filter("own > 0 AND between > 0"), "leader")
            .withColumn("block", F.when(F.col("linked"), F.pmod(spot, own)).otherwise(own + F.pmod(spot, between)))
            .withColumn("other", F.explode(F.when(F.col("linked"), F.sequence(own, own + between - 1)).otherwise(F.sequence(F.lit(0).cast("long"), own - 1))))
            .select(F.xxhash64("leader", F.lit(turn)).alias("leader"), "uid", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
        )
        places.append(meeting.withColumn("task", F.xxhash64("leader", "b1", "b2")))
        gone = found.filter("linked").select("leader", "uid").unionByName(pivots.select("leader", F.col("pivot").alias("uid")))
        members = ws.save(members.join(gone, ["leader", "uid"], "left_anti"), "left")
    return links, places, members


def jaccard_components(
    docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Link texts whose sets of `size`-word shingles have a Jaccard similarity of `percent` % or more, and unite them.

    Equal sets are one class. Candidates: every set's prefix in a global order (hash order, with the most frequent tokens last)
    is dealt out by token, in packed blobs of numbers; each token's bucket of two sets or more becomes a member list under its smallest set. R-trees over the members' hashed token
    counts take the lists apart (bounds by summed coordinate minima), before any text moves: what can link with no member leaves. The texts of a list meet in one
    shard, where an R-tree over hashed token counts bounds overlaps by summed coordinate minima and surviving pairs are verified on whole sets, unless a link has united them already.
    Shards of more than SHARD_TEXTS texts are first taken apart around pivots, by the triangle inequality; what is left of them is dealt out as pairs of blocks. The bucket of a token
    of more than HOT_TEXTS texts is dealt to several tasks by set. Nothing is capped: every pair that can link meets in some shard, or is united there by a pivot.

    Returns id, n_shingles (set size), component_id (the smallest id reachable by links, itself included). Null, empty and blank texts have no
    shingles and link with nothing. Rows with a null id link too, but carry a hash of their text as component if no id is smaller. Rows that repeat an id are nodes of their own if
    their texts differ, and one node else; every row of the input has one row. Other columns are ignored. Shingles are compared by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shingles")
    own = keyed(ws, docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text", "uid", "body")
    rows = own.select("uid", F.col("body").alias("text"))
    first = ws.save(rows.mapInArrow(_summaries(size), SETS), "sets")
    sets = first.filter("token IS NULL").select("uid", "n", "hi", "lo")
    often = first.filter("token IS NOT NULL").groupBy("token").agg(F.sum("texts").alias("texts"))
    often = often.orderBy(F.desc("texts"), "token").limit(FREQUENT_TOKENS).toArrow()
    tokens, texts = often.column("token").to_numpy().view(np.uint64), often.column("texts").to_numpy()
    hot = texts > HOT_TEXTS
    hot_parts = max(shuffle_partitions(spark), int(texts[hot].sum()) // PART_ROWS)
    shared = spark.sparkContext.broadcast((np.sort(tokens), np.sort(tokens[hot])))
    classes = ws.save(sets.filter("n > 0").groupBy("hi", "lo").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")), "classes")
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), total * (100 - percent) // 100 // PART_ROWS)
    blobs = rows.mapInArrow(_prefixes(size, percent, parts, hot_parts, shared), BLOB)
    members = ws.save(blobs.groupBy("part").applyInArrow(_buckets(percent, parts), MEMBER).distinct(), "members")
    if hot.any():  # FREQUENT_TOKENS rows at most
        named = members.filter("token IS NOT NULL").groupBy("token").agg(F.min("hi").alias("least"))
        members = members.join(F.broadcast(named), "token", "left").withColumn("leader", F.coalesce("leader", "least"))
    members = ws.save(members.join(classes.select("hi", F.col("rep").alias("uid")), "hi").select("leader", "uid").distinct(), "named")
    members = _narrowed(ws, rows, members, size, percent)
    links, places, members = _apart(ws, rows, members, size, percent)
    counts = ws.save(members.groupBy("leader").agg(F.count("*").alias("m")), "counts")
    tasks = members.count() // TASK_TEXTS + 1
    placed = (
        members.join(counts, "leader")
        .withColumn("blocks", _blocks("m"))
        .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("leader", "blocks", "uid", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
        .withColumn("task", F.when(F.col("blocks") > 1, F.xxhash64("leader", "b1", "b2")).otherwise(F.pmod(F.xxhash64("leader"), F.lit(tasks))))
        .drop("blocks")
    )
    dealt = _met(ws, rows, reduce(DataFrame.unionByName, places, placed))
    links.append(dealt.groupBy("task").applyInArrow(_shards(size, percent), "u long, v long"))
    edges = ws.save(reduce(DataFrame.unionByName, links).distinct(), "links")
    united = connected_components(ws, edges)
    classes = classes.join(united, classes["rep"] == united["node"], "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    classes = ws.save(classes, "components")
    out = sets.join(classes, ["hi", "lo"], "left").select("uid", "n", F.coalesce("component", "uid").alias("component")).distinct()
    out = own.select("id", "uid").join(ws.save(out, "result"), "uid")
    if own._quarry_torn:  # a hash stands for the id of such rows: components are named anew
        out = ws.save(out, "rows")
        named = out.groupBy("component").agg(F.min(F.coalesce(F.col("id").cast("long"), F.col("uid"))).alias("least"))
        out = out.join(named, "component").withColumn("component", F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
