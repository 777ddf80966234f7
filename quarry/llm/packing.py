"""Token sequences of a fixed length, filled along a Hilbert curve through document space."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, shuffle_partitions

HASHED_DIMS, CURVE_DIMS, CURVE_BITS = 64, 4, 12
#: Fixed value: the pre-token pattern of the byte-level BPE vocabulary.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BATCH_CHARS = 1 << 20
PARTITION_BYTES = 64 << 20  #: of ids in one range of the curve


class ByteBpe:
    """Ids by a byte-level BPE file of the tokenizers library, encoded by tiktoken from the same vocabulary.

    The vocabulary's ids below its special tokens are the merge ranks. `ids` takes strings of added tokens as ordinary text; `text_ids`
    takes them as the tokens, as the library does by default.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        special = {t["id"] for t in found.get("added_tokens", ()) if t.get("special")}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        alphabet = {chr(b): b for b in plain}
        alphabet |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in found["model"]["vocab"].items() if i not in special}
        self.added = {t["content"]: t["id"] for t in found.get("added_tokens", ())}
        if any(t.get(k) for t in found.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: added tokens that take in spaces or stand at word bounds are not supported")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        self.size = max([*ranks.values(), *special, *self.added.values()]) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), self.dtype)

    def text_ids(self, text: str) -> np.ndarray:
        if self.cuts is None or not self.cuts.search(text):
            return self.ids(text)
        parts = self.cuts.split(text)  # text, token, text, ...
        return np.concatenate([np.array([self.added[t]], self.dtype) if k % 2 else self.ids(t) for k, t in enumerate(parts)])


@functools.cache
def _tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@functools.cache
def _hashed(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token id's hashed dimension and sign, and the projection of the dimensions to the curve's."""
    h = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(40)) % np.uint64(HASHED_DIMS)
    sign = np.where((h >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)
    return bucket.astype(np.int64), sign, np.random.default_rng(7).standard_normal((HASHED_DIMS, CURVE_DIMS))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned coordinates below 2**bits (Skilling's transpose form)."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one, q = np.uint64(1), np.uint64(1) << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1) << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_points(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Quantised projections of the documents' normalised hashed token counts."""
    bucket, sign, directions = _hashed(vocabulary)
    vectors = np.zeros((len(ids), HASHED_DIMS))
    for k, a in enumerate(ids):
        if len(a):
            counts = np.bincount(bucket[a], weights=sign[a], minlength=HASHED_DIMS)
            vectors[k] = counts / max(np.linalg.norm(counts), 1e-12)
    at = vectors @ directions  # standard normal for a random document
    return np.clip((at + 4) / 8 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)


def _chunks(batches, limit: int):
    """(keys, texts) in lists of about `limit` characters."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            t = text.as_py() or ""
            keys.append(key.as_py())
            texts.append(t)
            size += len(t) + 1
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def _tokenise(path: str, pattern: str, end_id: int):
    def run(batches):
        tokenizer = _tokenizer(path, pattern)
        end = np.array([end_id], tokenizer.dtype)
        for keys, texts in _chunks(batches, BATCH_CHARS):
            ids = [np.concatenate([tokenizer.text_ids(t), end]) for t in texts]
            curve = hilbert_keys(curve_points([a[:-1] for a in ids], tokenizer.size), CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(curve, pa.int64()), pa.array([len(a) for a in ids], pa.int64()), pa.array([a.tobytes() for a in ids], pa.binary())],
                ["id", "curve", "n", "ids"],
            )

    return run


PIECE_SCHEMA = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve long, ids binary"


def _pack(length: int, width: int):
    def run(batches):
        sequence, filled = TaskContext.get().partitionId() << 40, 0
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
        rows, held = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for id_, curve, n, raw in zip(*(batch.column(c) for c in ("id", "curve", "n", "ids")), strict=True):
                ids, start = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4"), 0
                n = n.as_py()
                while start < n:
                    take = min(n - start, length - filled)
                    rows.append((id_.as_py(), start, take, n, sequence, filled, curve.as_py(), ids[start : start + take].tobytes()))
                    start, filled, held = start + take, filled + take, held + take
                    if filled == length:
                        sequence, filled = sequence + 1, 0
                    if held >= 1 << 20:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return run


def pack_along_curve(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str = PRE_TOKENS,
    length: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack whole texts into sequences of `length` tokens, neighbours on the Hilbert curve together.

    A document is its text's ids, those of added tokens in it included, and `end_id`. Its token counts, hashed to signed dimensions and normalised, are
    projected to four dimensions; the point's Hilbert key orders the documents. The table is range-partitioned by (key,
    id, length, hash of the ids), so that a group of copies that shares one key may spread over partitions; each partition fills its
    sequences one after another and cuts documents where a sequence is full. Only the last sequence of a partition is
    short.

    Returns a row a piece: id, start, length, doc_tokens, sequence_id, offset, and ids (little-endian unsigned
    32-bit). A null or empty text is a document of `end_id` alone; null ids and repeated rows are packed like any other; an empty table
    gives no rows. Columns other than id and text are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens = ws.save(rows.mapInArrow(_tokenise(tokenizer_path, pattern, end_id), "id long, curve long, n long, ids binary"), "tokens")
    held = (tokens.agg(F.sum("n")).first()[0] or 0) * _tokenizer(tokenizer_path, pattern).dtype.itemsize
    parts = max(shuffle_partitions(spark), -(-held // PARTITION_BYTES))
    order = ["curve", "id", "n", F.xxhash64("ids")]  # rows that are alike in all of these are interchangeable
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = ordered.mapInArrow(_pack(length, _tokenizer(tokenizer_path, pattern).dtype.itemsize), PIECE_SCHEMA)
    return pieces.select(F.col("id").alias(id_col), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
