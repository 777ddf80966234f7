"""Repeated byte strings of a fixed length, by longest previous and next factors in suffix order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.anchors import BYTE_HASHES, STEP_HASHES, anchor_blocks, content_hash
from quarry.llm.common import Workspace, free_name, membership_filter, passing

TASK_BYTES = 1 << 20  #: of block text that one suffix order holds
HOT_CONTENTS = 512  #: different blocks of one anchor beyond which they are split by content instead
CELLS = (64, 16, 4, 1)  #: window starts of a cell, at each splitting of a hot anchor's blocks

BLOCKS = "key long, hi long, lo long, uid long, start long, n int, lead int, c int"
SPANS = "uid long, start long, n long, earlier boolean"


def _merge(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Unite overlapping or touching [start, start + count) ranges."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for s, n in zip(starts[order].tolist(), counts[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(a, b - a) for a, b in out]


def _blocks(length: int):
    """Blocks of window starts, of whole texts or of their ranges in a third column, that share an anchor. A content that recurs inside its text is one row with a count; the window starts of its later copies are merged into rows without a key."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 3

    def run(batches):
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            parts = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for row, (uid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = text.as_buffer()
                if data is None or data.size < length:
                    continue
                data = data.to_pybytes()
                first: dict[tuple[int, int], list] = {}
                later: list[tuple[int, int]] = []
                for at, size in [(r["start"], r["n"] + length - 1) for r in parts[row]] if parts else [(0, len(data))]:
                    for keys, starts, counts, anchors in anchor_blocks(data[at : at + size], length):
                        for k, s, n, p in zip(keys.tolist(), (starts + at).tolist(), counts.tolist(), (anchors + at).tolist(), strict=True):
                            h = content_hash(data[s : s + n + length - 1])
                            if (seen := first.get(h)) is None:
                                first[h] = [k, *h, uid, s, n, p - s, 1]
                            else:
                                seen[-1] += 1
                                later.append((s, n))
                rows += map(tuple, first.values())
                if later:
                    s, n = np.array(later, np.int64).T
                    rows += [(None, None, None, uid, a, b, None, None) for a, b in _merge(s, n)]
                if len(rows) >= 20_000:
                    yield out()
                    rows = []
        if rows:
            yield out()

    return run


def window_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The rank, in suffix order to a depth of `length` bytes, of the suffixes at `starts`: equal ranks share `length` bytes.

    Prefix doubling over every position of the data; the last step joins two overlapping depths.
    """
    pad = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    n = len(data)
    word = np.zeros(len(pad) - 7, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | pad[k : k + len(word)]
    rank = np.unique(word[: n + length], return_inverse=True)[1].astype(np.uint64)
    depth = 8
    while 2 * depth <= length:
        pair = (rank[: len(rank) - depth] << np.uint64(32)) | rank[depth:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
    pair = (rank[starts] << np.uint64(32)) | rank[starts + (length - depth)]
    return np.unique(pair, return_inverse=True)[1]


def repeated_factors(classes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, whether a smaller and whether a larger position holds the same first `length` bytes.

    In suffix order with ties by position, the previous smaller position of a suffix is its neighbour before it and
    the next larger one its neighbour after it wherever they share the depth: so its longest previous (next) factor reaches the depth exactly
    if that neighbour is of its class.
    """
    order = np.lexsort((positions, classes))
    same = classes[order[1:]] == classes[order[:-1]]
    earlier, later = np.zeros(len(classes), bool), np.zeros(len(classes), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each position on: equal strings have equal hashes."""
    h, width, k = BYTE_HASHES[data], 1, 0
    while 2 * width <= length:
        h = h[: len(h) - width] * STEP_HASHES[k % len(STEP_HASHES)] + h[width:]
        h ^= h >> np.uint64(29)
        width, k = 2 * width, k + 1
    rest = length - width
    return h[: len(h) - rest] * STEP_HASHES[0] + h[rest:] if rest else h


def _live_parts(texts: list[np.ndarray], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block of n windows: the first of its windows whose hash occurs twice among all blocks, and the number of windows from there to the last such one (0: none)."""
    hashes = np.concatenate([window_hashes(t, length) for t in texts])
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
    np.minimum.at(low, owner[twice], inner[twice])
    np.maximum.at(high, owner[twice], inner[twice])
    return low, np.where(high < 0, 0, high - low + 1)


def _suffix_stage(length: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(table: pa.Table) -> pa.Table:
        uid, start, n = (table.column(c).to_numpy() for c in ("uid", "start", "n"))
        texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("data")]
        # Only parts of blocks that hold a window with a twin go into the suffix order.
        low, some = _live_parts(texts, n.astype(np.int64), length)
        live = np.flatnonzero(some)
        texts = [texts[i][low[i] : low[i] + some[i] + length - 1] for i in live.tolist()]
        uid, start, n = uid[live], start[live] + low[live], some[live]
        rows = []
        if len(live):
            order = np.lexsort((start, uid))  # positions are ordered by (document, place)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = np.concatenate([[0], np.cumsum([t.size for t in texts])])[:-1]
            owner = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            classes = window_classes(np.concatenate(texts), at[owner] + inner, length)
            earlier, later = repeated_factors(classes, place[owner] * (int(n.max()) + 1) + inner)
            ends = np.cumsum(n)
            for flags, kind in ((earlier, True), (later & ~earlier, False)):
                for i in np.unique(owner[flags]).tolist():
                    rows += [(int(uid[i]), int(start[i]) + a, b, kind) for a, b in _runs(flags[ends[i] - n[i] : ends[i]])]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["uid", "start", "n", "earlier"])

    return run


WITH_TEXT = "key long, uid long, start long, n int, lead int, data binary"


def _cut_blocks(length: int):
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
    names = [x.split()[0] for x in WITH_TEXT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for uid, text, blocks in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("blocks").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                rows += [(b["key"], uid, b["start"], b["n"], b["lead"], data[b["start"] : b["start"] + b["n"] + length - 1]) for b in blocks]
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


CELL = "key long, uid long, start long, n int, lead int, data binary, cell int, core_hi long, core_lo long, hi long, lo long"


def _cells(length: int, size: int):
    """Split blocks into cells by their windows' distance to the anchor; each cell has the hash of its bytes and of its core, the bytes that all of the cell's windows share."""
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary(), pa.int32()] + [pa.int64()] * 4
    names = [x.split()[0] for x in CELL.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                s, data = 0, r["data"]
                while s < r["n"]:
                    far = r["lead"] - s  # the window's distance to the anchor
                    cell = far // size
                    m = min(far - cell * size + 1, r["n"] - s)
                    own = data[s : s + m + length - 1]
                    near = cell * size
                    core = data[r["lead"] - near : r["lead"] - near + length - size + 1]
                    rows.append((r["key"], r["uid"], r["start"] + s, m, far, own, cell, *content_hash(core), *content_hash(own + bytes([m]))))
                    s += m
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _hot_spans(ws: Workspace, blocks: DataFrame, length: int) -> list[DataFrame]:
    """Repeats among the blocks of anchors with very many different contents, without bringing them together.

    Cells whose core is unlike all others hold no repeat; cells with equal bytes repeat whole; what is left is split
    into smaller cells, down to single windows. Only partially aggregated hashes are shuffled by content.
    """
    spans, todo = [], blocks
    spot = F.struct("uid", "start").alias("spot")
    for size in CELLS:
        cells = ws.save(todo.mapInArrow(_cells(length, size), CELL), "cells")
        core_key, own_key = ["key", "cell", "core_hi", "core_lo"], ["key", "cell", "hi", "lo"]
        core = ws.save(cells.groupBy(*core_key).count().filter("count > 1").drop("count"), "cores")
        live = ws.save(cells.join(core, core_key, "left_semi"), "live")
        own = ws.save(live.groupBy(*own_key).agg(F.count("*").alias("c"), F.min(spot).alias("first")), "own")
        marked = live.join(own, own_key)
        is_first = (F.col("uid") == F.col("first.uid")) & (F.col("start") == F.col("first.start"))
        repeat = marked.filter("c > 1").select("uid", "start", F.col("n").cast("long").alias("n"), (~is_first).alias("earlier"))
        spans.append(ws.save(repeat, "spans"))
        if size > 1:
            todo = marked.filter(is_first).select("key", "uid", "start", "n", "lead", "data")
    return spans


def repeated_windows(ws: Workspace, rows: DataFrame, length: int) -> DataFrame:
    """(uid, start, n, earlier) ranges of window starts whose `length` bytes also start elsewhere; earlier: at a smaller (uid, start) too.

    A range with earlier false holds windows that have a later copy, and perhaps no earlier one.
    """
    found = ws.save(rows.mapInArrow(_blocks(length), BLOCKS), "blocks")
    inner = found.filter("key IS NULL").select("uid", "start", F.col("n").cast("long").alias("n"), F.lit(True).alias("earlier"))
    blocks = found.filter("key IS NOT NULL")
    differ = (F.min("hi") != F.max("hi")) | (F.min("lo") != F.max("lo"))
    keys = blocks.groupBy("key").agg(F.sum("c").alias("total"), differ.alias("several")).filter("total > 1").drop("total")
    shared = ws.save(blocks.join(ws.save(keys, "keys"), "key"), "shared")
    spot = F.struct("uid", "start").alias("spot")
    contents = ws.save(
        shared.groupBy("key", "hi", "lo").agg(F.sum("c").alias("total"), F.min(spot).alias("first"), F.first("several").alias("several")),
        "contents",
    )
    marked = shared.drop("several").join(contents, ["key", "hi", "lo"])
    is_first = (F.col("uid") == F.col("first.uid")) & (F.col("start") == F.col("first.start"))
    copies = ws.save(
        marked.filter("total > 1").select("uid", "start", F.col("n").cast("long").alias("n"), (~is_first).alias("earlier")), "copies"
    )
    distinct = ws.save(marked.filter(F.col("several") & is_first).select("key", "uid", "start", "n", "lead").dropDuplicates(["key", "uid", "start"]), "distinct")
    hot = ws.save(distinct.groupBy("key").count().filter(F.col("count") > HOT_CONTENTS).drop("count"), "hot")
    spans = [inner, copies]
    n_blocks = distinct.count()
    if n_blocks:
        listed = distinct.groupBy("uid").agg(F.collect_list(F.struct("key", "start", "n", "lead")).alias("blocks"))  # bounded by the text
        listed = ws.save(listed, "listed")
        near = passing(rows.select("uid", "text"), "uid", membership_filter(listed, "uid")).dropDuplicates(["uid"])
        cut = ws.save(near.join(listed, "uid").mapInArrow(_cut_blocks(length), WITH_TEXT), "texts")
        n_bytes = cut.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        tasks = int(n_bytes // TASK_BYTES + 1)
        cold = cut.join(hot, "key", "left_anti")
        spread = cold.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
        spans.append(ws.save(spread.groupBy("task").applyInArrow(_suffix_stage(length), SPANS), "spans"))
        if hot.limit(1).count():
            spans += _hot_spans(ws, cut.join(hot, "key", "left_semi"), length)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _remove(length: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())])), pa.binary()]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for uid, text, windows in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("windows"), strict=True):
                data = text.as_buffer().to_pybytes()
                flat = windows.values
                s, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                cut = _merge(s, n + length - 1)
                parts, at = [], 0
                for a, b in cut:
                    parts.append(data[at:a])
                    at = a + b
                parts.append(data[at:])
                rows.append((uid, sum(b for _, b in cut), len(cut), [{"start": a, "bytes": b} for a, b in cut], b"".join(parts)))
                held += len(data)
                if held >= 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "n_removed", "n_spans", "spans", "kept"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "n_removed", "n_spans", "spans", "kept"])

    return run


def keyed(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, uid: str = "uid", text: str = "text") -> DataFrame:
    """`docs` with two more columns: `uid`, a long that equal (id, text) rows share and no others, and `text`, never null.

    It is the id, or a hash of the text where the id is null; rows whose id stands on another text too get a hash of both.
    """
    rows = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn(uid, F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)))
    hashed = rows.select(F.col(uid).alias("uid"), F.xxhash64(text).alias("h"))
    torn = ws.save(hashed.groupBy("uid").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("uid"), "torn-ids")
    if torn.limit(1).count() == 0:
        rows._quarry_torn = False
        return rows
    key, shared = free_name("_torn", rows.columns), membership_filter(torn, "uid")
    maybe = passing(rows, uid, shared).join(torn.select(F.col("uid").alias(key)), F.col(uid) == F.col(key), "left")
    maybe = maybe.withColumn(uid, F.when(F.col(key).isNotNull(), F.xxhash64(uid, text)).otherwise(F.col(uid))).drop(key)
    out = passing(rows, uid, shared, clear=True).unionByName(maybe)
    out._quarry_torn = True  # some id stands on several texts
    return out


def _by_text(ws: Workspace, windows: DataFrame) -> DataFrame:
    """The ranges of each text in one row, bounded by the text."""
    return ws.save(windows.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("windows")), "windows")


REMOVED = "uid long, n_removed long, n_spans long, spans array<struct<start: long, bytes: long>>, kept binary"


def _removed(ws: Workspace, rows: DataFrame, by_text: DataFrame, length: int) -> DataFrame:
    near = passing(rows.select("uid", "text"), "uid", membership_filter(by_text, "uid")).dropDuplicates(["uid"])
    return ws.save(near.join(by_text, "uid").mapInArrow(_remove(length), REMOVED), "removed")


def _check(length: int, keep: str) -> None:
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    if length < 64:
        raise ValueError("length is 64 at least")


def find_repeats(docs: DataFrame, length: int = 400, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes of every text that are covered by a `length`-byte string which also starts elsewhere, same text included.

    keep "first" leaves the first copy, by (id, place), of every such string; keep "none" leaves none. Strings are judged on the input, overlaps count, and matches never cross texts.

    Only windows that can repeat are brought together: a window's anchor depends on its bytes alone, and blocks of
    windows whose anchor occurs once are done. Equal blocks repeat whole. Of the others the different ones are dealt out by anchor; each task drops parts without a window
    whose hash occurs twice, sorts the suffixes of the rest and reads longest previous and next factors off the order (see repeated_factors). Anchors with more than
    HOT_CONTENTS different blocks are split by content instead (see _hot_spans).

    Returns, for texts with such bytes alone, uid (the id; for a null id a hash of the text, for an id that stands on different texts a hash of both), n_removed,
    n_spans (maximal removed runs), spans (start, bytes), kept (the remaining bytes). Null and empty texts have no bytes. Equal rows (id and text) are copies
    of each other and share one result row. Other columns are ignored; an empty table gives no rows.
    """
    _check(length, keep)
    ws = Workspace(docs.sparkSession, "repeats")
    rows = keyed(ws, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "id", "body").select("uid", "text")
    windows = repeated_windows(ws, rows, length)
    if keep == "first":
        windows = windows.filter("earlier")
    return _removed(ws, rows, _by_text(ws, windows), length)


CUT = "uid long, cut string"


def _whole_characters(batches):
    """The text without its spans; a character that a span covers in part stays."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data, at, parts = text.as_buffer().to_pybytes(), 0, []
            for r in spans:
                a, b = r["start"], r["start"] + r["bytes"]
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(data[at:a])
                at = b
            texts.append(b"".join([*parts, data[at:]]).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(texts, pa.string())], ["uid", "cut"])


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of `docs` with their own columns; in `text_col`, later copies of `length`-byte strings are cut out and the first copy, by (id, place), stays.

    See find_repeats for what is cut. A character that is covered in part stays whole. Rows that are equal in id and text are one text: they keep the same words. A row
    with a null id is ordered by a hash of its text. Null texts stay null, texts of which nothing is left become empty. Only rows whose text changes are shuffled.
    """
    _check(length, "first")
    ws = Workspace(docs.sparkSession, "without-repeats")
    uid, body = free_name("_uid", docs.columns), free_name("_body", docs.columns)
    rows = keyed(ws, docs, id_col, text_col, uid, body)
    texts = rows.select(F.col(uid).alias("uid"), F.col(body).alias("text"))
    by_text = _by_text(ws, repeated_windows(ws, texts, length).filter("earlier"))
    near = passing(texts, "uid", membership_filter(by_text, "uid")).dropDuplicates(["uid"])
    spans = F.transform("windows", lambda w: F.struct(w["start"].alias("start"), (w["n"] + length - 1).alias("bytes")))
    cut = near.join(by_text.select("uid", spans.alias("spans")), "uid").mapInArrow(_united, "uid long, text string, spans array<struct<start: long, bytes: long>>")
    cut = ws.save(cut.mapInArrow(_whole_characters, CUT), "cut").toDF(uid, free_name("_cut", docs.columns))
    new = cut.columns[1]
    shared = membership_filter(cut, uid)
    changed = passing(rows, uid, shared).join(cut, uid, "left").withColumn(text_col, F.coalesce(F.col(new), F.col(text_col)))
    return passing(rows, uid, shared, clear=True).select(*docs.columns).unionByName(changed.select(*docs.columns))


def _united(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
    for batch in batches:
        spans = []
        for w in batch.column("spans"):
            merged = _merge(w.values.field("start").to_numpy(), w.values.field("bytes").to_numpy())
            spans.append([{"start": a, "bytes": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("text"), pa.array(spans, kind)], ["uid", "text", "spans"])


PASSAGES = "uid long, passage_bytes long, passage_spans long, ranges array<struct<start: long, n: long>>"


def _passages(passage: int, length: int):
    """Bytes and runs that repeated passages cover, and the ranges of window starts that may repeat at the greater length: all shorter windows within repeat."""
    kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))]

    def run(batches):
        for batch in batches:
            rows = []
            for uid, windows in zip(batch.column("uid").to_pylist(), batch.column("windows"), strict=True):
                s, n = windows.values.field("start").to_numpy(), windows.values.field("n").to_numpy()
                cover = _merge(s, n + passage - 1)
                more = length - passage
                rows.append((uid, sum(b for _, b in cover), len(cover), [{"start": a, "n": b - more} for a, b in _merge(s, n) if b > more]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PASSAGES.split(", ", 3)])

    return run


def repeat_digests(docs: DataFrame, length: int = 400, keep: str = "none", passage: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256 (lower-case hex of the remaining bytes), passage_bytes, passage_spans.

    The first five tell of the `length`-byte strings of find_repeats. passage_bytes and passage_spans count the bytes and maximal runs covered by repeated strings of
    `passage` bytes (no longer than `length`; nothing is removed for them): passages too short to hold a string of `length` bytes show there. A string of `length` bytes can repeat
    only where all its parts of `passage` bytes do, so the longer ones are looked for in such ranges alone. Nulls and equal rows are handled as in find_repeats.
    """
    _check(min(passage, length), keep)
    if passage > length:
        raise ValueError("passage is no longer than length")
    ws = Workspace(docs.sparkSession, "digests")
    rows = keyed(ws, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "id", "body").select("id", "uid", "text")
    texts = rows.select("uid", "text")
    short = _by_text(ws, repeated_windows(ws, texts, passage))
    short = ws.save(short.mapInArrow(_passages(passage, length), PASSAGES), "passages")
    ranges = short.filter(F.size("ranges") > 0).select("uid", "ranges")
    shared = membership_filter(ranges, "uid")
    inside = ws.save(passing(texts, "uid", shared).join(ranges, "uid").select("uid", "text", "ranges"), "inside")
    windows = repeated_windows(ws, inside, length)
    if keep == "first":
        windows = windows.filter("earlier")
    found = _removed(ws, inside, _by_text(ws, windows), length).select("uid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    found = ws.save(short.select("uid", "passage_bytes", "passage_spans").join(found, "uid", "left"), "found")
    raw = F.encode("text", "UTF-8")
    rows = rows.select("id", "uid", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, "uid", "left").select(
        F.col("id").alias(id_col), "n_bytes", zero("n_removed"), zero("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), zero("passage_bytes"), zero("passage_spans"),
    )
