"""As few token sequences as best-fit decreasing needs, planned from the lengths alone."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace

BATCH_CHARS = 1 << 20
#: In lower case, letters of ASCII and Latin letters are one class, each digit stands alone, all other visible ASCII is one class: the same in all versions of Unicode. Words with
#: other characters, and those that may hold a contraction or an added token, go to the library.
_odd = re.compile("[^ !-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|<\\|").search
SPACE, LETTER, DIGIT, OTHER, BREAK = range(5)
END_OF_WORD = "A"  #: lower-case text has none


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[ord("a") : ord("z") + 1] = out[128:] = LETTER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[ord(" ")], out[ord("\n")] = SPACE, BREAK
    return out


CLASSES = _classes()


def mark_words(text: str) -> str:
    """Lower-case text of known characters without spaces, END_OF_WORD behind each word; line feeds stay."""
    data = np.frombuffer(text.encode(), np.uint8)
    kind = CLASSES[data]
    ends = np.append(kind[:-1] != kind[1:], len(kind) > 0)[: len(kind)] | (kind == DIGIT)
    ends &= kind != BREAK
    at = np.flatnonzero(kind)
    size = 1 + ends[at]
    out = np.full(int(size.sum()), ord(END_OF_WORD), np.uint8)
    out[np.cumsum(size) - size] = data[at]
    return out.tobytes().decode()


#: Fixed value: the splitting rule of the vocabulary that mark_words follows.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class TightestBin:
    """A segment tree over remaining capacities 0 to `most`; a leaf counts the open bins with that much room."""

    def __init__(self, most: int):
        self.width = 1 << max(1, most.bit_length())
        self.tree = [0] * (2 * self.width)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.width
        while at:
            self.tree[at] += bins
            at >>= 1

    def find(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least `least`, by one walk up and one down."""
        tree, at = self.tree, least + self.width
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        return at - self.width


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Best-fit decreasing of counts[n] pieces of each length n, as runs (length, first rank, pieces a bin, first bin, offset).

    Pieces go longest first, each into the open bin with the least room that holds it, or into a new one. The bin that took a piece is the tightest for the next of
    the same length while it holds one, since no open bin was tighter before; so equal pieces fill bin after bin, and a group of bins with the
    same room takes its pieces in one step. The result is that of placing the pieces one by one. A length adds at most four groups to the plan: its size depends on the
    capacity and not on the number of pieces.
    """
    tree, groups, runs, n_bins = TightestBin(capacity), {}, [], 0

    def put(room: int, first: int, bins: int) -> None:
        if room:
            groups.setdefault(room, []).append((first, bins))
            tree.add(room, bins)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                a_bin = capacity // length
                room, first, bins = capacity, n_bins, -(-left // a_bin)
                n_bins += bins
            else:
                a_bin = room // length
                first, bins = groups[room].pop()
                tree.add(room, -bins)
            used = min(bins, -(-left // a_bin))
            if used < bins:
                put(room, first + used, bins - used)
            runs.append((length, rank, a_bin, first, capacity - room))
            whole = min(used, left // a_bin)
            if whole:
                put(room - a_bin * length, first, whole)
            rest = min(left, used * a_bin) - whole * a_bin
            if rest:
                put(room - rest * length, first + whole, 1)
            rank, left = rank + whole * a_bin + rest, left - whole * a_bin - rest
    table = np.array(runs, np.int64).reshape(-1, 5)
    return tuple(np.ascontiguousarray(table[:, k]) for k in range(5))


def places(plan: tuple[np.ndarray, ...], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces by their length and rank among all pieces of that length. Lengths stand in the plan in falling order, ranks below 2**47."""
    length, rank, a_bin, first, offset = plan
    run = np.searchsorted(rank - (length << 47), ranks - (lengths << 47), "right") - 1
    nth = ranks - rank[run]
    return first[run] + nth // a_bin[run], offset[run] + nth % a_bin[run] * lengths


def _slices(text: str, size: int):
    """The text in parts of about `size` characters, cut at spaces."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _plain_encoder(found: dict):
    """A tiktoken encoding of lower-case words, each with END_OF_WORD behind it; None where the file's rules don't allow it.

    The file's ids are its merge ranks: single bytes, then single bytes that end a word, then merged tokens in the order of the rules. With the end of a word written as a byte that
    lower-case text doesn't hold, the bytes that end a word are the first merges, and the others follow in the same order.
    """
    import tiktoken

    steps = [n["type"] for n in (found.get("normalizer") or {}).get("normalizers", ())]
    split = [p.get("pattern", {}).get("Regex") for p in (found.get("pre_tokenizer") or {}).get("pretokenizers", ())]
    if (steps, split[:1], found["model"].get("type"), found["model"].get("end_of_word_suffix")) != (["NFC", "Replace", "Lowercase"], [WORDS], "BPE", "</w>"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocab, special = found["model"]["vocab"], {t["id"] for t in found.get("added_tokens", ())}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in found["model"]["merges"]]
    if merged != sorted(merged) or merged[:1] <= [511]:
        return None
    spelt = lambda t: bytes(alphabet[c] for c in t.removesuffix("</w>")) + (END_OF_WORD.encode() if t.endswith("</w>") and t != "</w>" else b"")
    ranks = {spelt(t): i for t, i in vocab.items() if i not in special}
    return tiktoken.Encoding("words", pat_str=f"[^{END_OF_WORD}\\n]+{END_OF_WORD}|\\n", mergeable_ranks=ranks, special_tokens={})


class WordIds:
    """Ids of texts by a file of the tokenizers library, whose splitting rules never join what white space parts.

    Where the file's rules allow it, words of known characters are encoded by tiktoken from the same vocabulary, which is some times faster, and only the others by the library; the
    ids are the library's for the whole text, added tokens in it included.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.encoding = _plain_encoder(found)
        if self.encoding:
            (self.line_feed,) = self.encoding.encode_ordinary("\n")

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, texts: list[str]) -> list[bytes]:
        if self.encoding is None:
            return self.ids(texts)
        known, between, odd = [], [], {}  # between: what stands for each line feed, None where a text ends
        for text in texts:
            text = text.replace("\n", " ").replace("\t", " ")
            if _odd(text):
                words = text.split(" ")
                others = {w: odd.setdefault(w, len(odd)) for w in words if _odd(w)}
                between += [others[w] for w in words if w in others]
                text = " ".join("\n" if w in others else w for w in words)
            known.append(text.lower())
            between.append(None)
        ids = np.concatenate([self.encoding.encode_to_numpy(mark_words(t)).astype(self.dtype) for t in _slices("\n".join(known), 2 * BATCH_CHARS)])
        width, data, of_odd = self.dtype.itemsize, ids.tobytes(), self.ids(list(odd))
        ends = [*(np.flatnonzero(ids == self.line_feed) * width).tolist(), len(data)]
        out, own, at = [], [], 0
        for filler, end in zip(between, ends, strict=True):
            own.append(data[at:end])
            at = end + width
            if filler is None:
                out.append(b"".join(own))
                own = []
            else:
                own.append(of_odd[filler])
        return out


@functools.cache
def _words(path: str) -> WordIds:
    return WordIds(path)


def _texts(batches, limit: int):
    """(keys, texts) in lists of about `limit` characters."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            keys.append(key.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1]) + 1
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


TOKEN_SCHEMA = "part int, id long, piece int, start long, length int, nth long, ids binary"


def _tokenise(path: str, capacity: int, end_id: int):
    names, kinds = [x.split()[0] for x in TOKEN_SCHEMA.split(", ")], [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        words, part = _words(path), TaskContext.get().partitionId()
        end, width, seen = np.array([end_id], words.dtype).tobytes(), words.dtype.itemsize, [0] * (capacity + 1)
        for keys, texts in _texts(batches, BATCH_CHARS):
            rows = []
            for key, ids in zip(keys, words.texts(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), capacity * width)):
                    own = ids[at : at + capacity * width]
                    n = len(own) // width
                    rows.append((part, key, piece, at // width, n, seen[n], own))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def pack_best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole texts into as few sequences of at most `capacity` tokens as best-fit decreasing finds, over the whole table at once.

    A document is its text's ids and `end_id`; one longer than `capacity` is cut into pieces of that length, the last may be shorter. Where a piece goes depends only on its
    length and on its rank among equal lengths. So tasks tokenise, number their pieces by length and write them; a table of (task, length, pieces) is summed to at
    most `capacity` counts, from which the driver plans the bins with a segment tree over remaining capacities (plan_bins); running sums of the table turn a
    task's numbers into ranks, and each piece looks its bin up. No group meets in one task, however many pieces are equally long, and the driver's part doesn't grow with the table.

    Returns a row a piece: id, piece (from 0), start, length, sequence_id, offset, and ids (little-endian unsigned 32-bit). A null or empty text is a document of `end_id`
    alone; null ids and repeated rows are packed like any other; an empty table gives no rows. Columns other than id and text are ignored.
    """
    if not 0 < capacity < 1 << 15:
        raise ValueError("a sequence holds 1 to 32767 tokens")
    spark = docs.sparkSession
    ws = Workspace(spark, "best-fit")
    width = _words(tokenizer_path).dtype.itemsize
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens = ws.save(rows.mapInArrow(_tokenise(tokenizer_path, capacity, end_id), TOKEN_SCHEMA), "tokens")
    by_task = ws.save(tokens.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            sequence, offset = places(plan.value, length, b.column("rank").to_numpy())
            ids = [np.frombuffer(x.as_buffer(), f"<u{width}").astype("<u4").tobytes() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("piece"), b.column("start"), pa.array(length), pa.array(sequence), pa.array(offset), pa.array(ids, pa.binary())],
                ["id", "piece", "start", "length", "sequence_id", "offset", "ids"],
            )

    ranked = tokens.join(starts, ["part", "length"]).select("id", "piece", "start", "length", (F.col("nth") + F.col("before")).alias("rank"), "ids")
    out = ranked.mapInArrow(place, "id long, piece int, start long, length long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)
