"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Workspace, free_name

ORDER = 5
DOCS_A_LANGUAGE = 400  #: documents of each language that a model is fitted on, by hash order
LONGEST_TRAINING_TEXT = 100_000  #: characters; longer labelled texts are used for fitting only where a language has no others
CHUNK = 1 << 19  #: characters of texts taken together
SCORED = 1 << 16  #: characters scored at a time
MARGIN, SHORT = 0.9, 3.0  #: nats above the sample's cross-entropies that are still accepted; more for texts of n characters by SHORT / sqrt(n)
PAD, SPACE = 1, 32
UNDETERMINED = "und"


@functools.cache
def _folding() -> np.ndarray:
    """Lower-case code point of every letter, a space for anything else; 0 marks what is not in the table (above the BMP)."""
    table = np.full(0x10000, SPACE, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def fold(text: str) -> np.ndarray:
    """Letters in lower case as code points, with one space for each run of anything else."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(raw, 0xFFFF)
    codes = _folding()[low]
    if (high := np.flatnonzero(raw > 0xFFFF)).size:
        codes[high] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else SPACE for c in raw[high].tolist()]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    return codes[keep]


_MULTIPLIERS = np.random.default_rng(3).integers(1 << 62, 1 << 63, ORDER, dtype=np.uint64) | np.uint64(1)


def gram_hashes(codes: np.ndarray, n: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n characters that end at each position from n - 1 on, or just before each of `ends` + n."""
    wide = codes if codes.dtype == np.uint64 else codes.astype(np.uint64)
    m = len(codes) - n + 1
    h = np.full(m if ends is None else len(ends), n, np.uint64)
    for k in range(n):
        h += (wide[k : k + m] if ends is None else wide[ends + k]) * _MULTIPLIERS[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


class SortedHashes:
    """Sorted 64-bit hashes with a directory of where each run of leading bits begins."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where absent."""
        at = self.first[h >> self.shift]
        got = self.keys[at]
        out = np.where(got == h, at, -1)
        left = np.flatnonzero(got < h)
        while left.size:
            at_left = at[left] + 1
            at[left] = at_left
            got = self.keys[at_left]
            same = got == h[left]
            out[left[same]] = at_left[same]
            left = left[got < h[left]]
        return out


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' characters, each text led by ORDER - 1 pads; where each text's own characters begin."""
    parts, starts, at = [], [], 0
    pad = np.full(ORDER - 1, PAD, np.uint32)
    for t in texts:
        c = fold(t)
        parts += [pad, c]
        starts.append(at + ORDER - 1)
        at += ORDER - 1 + len(c)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(starts, np.int64)


def fit(texts: list[str]) -> dict[str, np.ndarray]:
    """One language's model: for each order its n-grams' sorted hashes and interpolated log probabilities, and its contexts' log back-off weights.

    The highest order counts occurrences, the lower ones distinct left neighbours; each order has its own discount.
    """
    codes, _ = _padded(texts)
    own = codes != PAD
    alphabet = np.unique(codes[own])
    model: dict[str, np.ndarray] = {}
    grams: dict[int, tuple] = {}
    for n in range(ORDER, 0, -1):
        h = gram_hashes(codes, n)
        ends_own = own[n - 1 :]
        first = np.zeros(len(h), np.int64) if n == 1 else np.arange(len(h))
        ctx = gram_hashes(codes[:-1], n - 1) if n > 1 else np.zeros(len(h), np.uint64)
        shorter = gram_hashes(codes, n - 1)[1:] if n > 1 else np.zeros(len(h), np.uint64)
        h, ctx, shorter, first = h[ends_own], ctx[ends_own], shorter[ends_own], first[ends_own]
        keys, at, counts = np.unique(h, return_index=True, return_counts=True)
        grams[n] = (keys, counts, ctx[at], shorter[at])
    lower_counts = {}
    for n in range(ORDER, 1, -1):  # continuation counts: how many longer n-grams end in this one
        keys, _, _, shorter = grams[n]
        k, c = np.unique(shorter, return_counts=True)
        lower_counts[n - 1] = dict_counts(grams[n - 1][0], k, c)
    prob_below = np.full(1, 1.0 / (len(alphabet) + 1))
    keys_below = np.zeros(1, np.uint64)
    for n in range(1, ORDER + 1):
        keys, counts, ctx, shorter = grams[n]
        c = (counts if n == ORDER else lower_counts[n]).astype(np.float64)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx_keys, inv = np.unique(ctx, return_inverse=True)
        total = np.bincount(inv, weights=c)
        kinds = np.bincount(inv, weights=(c > 0).astype(float))
        total = np.maximum(total, 1e-9)
        weight = np.where(kinds > 0, d * kinds / total, 1.0)
        below = prob_below[np.searchsorted(keys_below, shorter)] if n > 1 else np.full(len(keys), prob_below[0])
        p = np.maximum(c - d, 0) / total[inv] + weight[inv] * below
        model[f"gram{n}"], model[f"logp{n}"] = keys, np.log(p)
        model[f"shorter{n}"], model[f"ctxof{n}"] = shorter, ctx
        model[f"ctx{n}"], model[f"back{n}"] = ctx_keys, np.log(np.minimum(weight, 1.0))
        keys_below, prob_below = keys, p
    model["floor"] = np.array([np.log(1.0 / (len(alphabet) + 1))])
    return model


def dict_counts(keys: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts c of the sorted k, read at keys; 0 where absent."""
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return np.where(k[at] == keys, c[at], 0)


class Models:
    """All languages' models side by side: for each order one sorted hash array of every language's n-grams, with a column of resolved log probabilities for each language."""

    def __init__(self, by_language: dict[str, dict[str, np.ndarray]], thresholds: dict[str, float]):
        self.languages = sorted(by_language)
        self.thresholds = np.array([thresholds[x] for x in self.languages])
        models = [by_language[x] for x in self.languages]
        floor = np.array([m["floor"][0] for m in models], np.float64)
        empty = np.array([m["back1"][0] for m in models])
        self.unseen = (floor + empty).astype(np.float32)
        self.grams, self.rows, self.ctx, self.back = [], [], [], []
        below, below_keys = None, None
        for n in range(1, ORDER + 1):
            keys, at = np.unique(np.concatenate([m[f"gram{n}"] for m in models]), return_index=True)
            shorter = np.concatenate([m[f"shorter{n}"] for m in models])[at]
            ctxof = np.concatenate([m[f"ctxof{n}"] for m in models])[at]
            ctx = np.unique(np.concatenate([m[f"ctx{n}"] for m in models]))
            back = np.zeros((len(ctx), len(models)))
            for j, m in enumerate(models):
                back[np.searchsorted(ctx, m[f"ctx{n}"]), j] = m[f"back{n}"]
            if n == 1:
                rows = np.repeat((floor + empty)[None], len(keys), axis=0)
            else:  # a language that hasn't seen the n-gram backs off
                rows = back[np.searchsorted(ctx, ctxof)] + below[np.searchsorted(below_keys, shorter)]
            for j, m in enumerate(models):
                rows[np.searchsorted(keys, m[f"gram{n}"]), j] = m[f"logp{n}"]
            below, below_keys = rows, keys
            self.grams.append(SortedHashes(keys))
            self.rows.append(rows.astype(np.float32))
            self.ctx.append(SortedHashes(ctx))
            self.back.append(back.astype(np.float32))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Row for each position from ORDER - 1 on: each language's log probability of that character."""
        codes = codes.astype(np.uint64)
        at = self.grams[-1].find(gram_hashes(codes, ORDER))
        out = self.rows[-1][at]
        left = np.flatnonzero(at < 0)
        owed = np.zeros((len(left), len(self.languages)), np.float32)  # back-off weights of the contexts passed
        for n in range(ORDER - 1, 0, -1):
            if not left.size:
                return out
            ctx = self.ctx[n].find(gram_hashes(codes, n, left + (ORDER - 1 - n)))
            owed += np.where((ctx >= 0)[:, None], self.back[n][ctx], 0)
            at = self.grams[n - 1].find(gram_hashes(codes, n, left + (ORDER - n)))
            hit = at >= 0
            out[left[hit]] = owed[hit] + self.rows[n - 1][at[hit]]
            left, owed = left[~hit], owed[~hit]
        out[left] = owed + self.unseen
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy for each language) of each text; long texts are scored in chunks that overlap by the context."""
        sums = np.zeros((len(texts), len(self.languages)))
        lengths = np.zeros(len(texts), np.int64)
        codes, starts = _padded(texts)
        ends = np.append(starts[1:] - (ORDER - 1), len(codes))
        lengths[:] = ends - starts
        for a in range(ORDER - 1, len(codes), SCORED):
            b = min(a + SCORED, len(codes))
            lp = self.log_probabilities(codes[a - ORDER + 1 : b]).astype(np.float64)
            here = np.flatnonzero((starts < b) & (ends > a))
            lo, hi = np.maximum(starts[here], a) - a, np.minimum(ends[here], b) - a
            lp = np.vstack([lp, np.zeros(lp.shape[1])])  # so that the last bound exists
            cuts = np.stack([lo, hi], axis=1).ravel()
            got = np.add.reduceat(lp, cuts, axis=0)[::2]
            sums[here] += np.where((hi > lo)[:, None], got, 0)
        return lengths, -sums / np.maximum(lengths, 1)[:, None]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _texts(column: pa.Array, limit: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of stretches of about `limit` characters."""
    first, texts, size = 0, [], 0
    for text in column:
        texts.append(text.as_py())
        size += len(texts[-1] or "") + ORDER
        if size >= limit:
            yield first, texts
            first, texts, size = first + len(texts), [], 0
    if texts:
        yield first, texts


def _train(table: pa.Table) -> pa.Table:
    """Fit on four fifths of a language's sample; the rest calibrates its rejection threshold."""
    pairs = sorted(zip(table.column("rank").to_pylist(), table.column("text").to_pylist(), strict=True))
    texts = [t for _, t in pairs]
    held = texts[::5] if len(texts) >= 10 else []
    model = fit([t for k, t in enumerate(texts) if not held or k % 5])
    alone = Models({"x": model}, {"x": 0.0})
    _, ce = alone.score(held or texts)
    ce = np.sort(ce[:, 0])
    middle, high = np.quantile(ce, 0.5), np.quantile(ce, 0.95)
    threshold = float(high + 2 * (high - middle) + MARGIN)
    rows = [(table.column("lang")[0].as_py(), name, a.astype("<u8" if a.dtype.kind == "u" else "<f8").tobytes(), threshold) for name, a in model.items()]
    return pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "part", "data", "threshold"])


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_a_language: int) -> Models | None:
    """Fit a model for each label on at most `docs_a_language` texts, chosen by hash order of their ids.

    Texts over LONGEST_TRAINING_TEXT are used only for languages without shorter ones, whole, until as many characters are reached as
    `docs_a_language` texts of that bound have; one at least.
    """
    ws = Workspace(labelled.sparkSession, "language")
    length = F.length(text_col)
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (length > 0))
    named = ws.save(usable.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), length.alias("chars")), "labelled")
    short = F.col("chars") <= LONGEST_TRAINING_TEXT
    counts = named.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("n"))  # a row a language
    counts = counts.select("lang", (F.col("short") > 0).alias("has_short"), F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("n")).alias("n"))
    # A part of the hash range that holds a little over the wanted number keeps a frequent language's ids out of the window.
    part = F.ceil(F.lit(1.5 * docs_a_language) / F.col("n") * (1 << 30))
    few = named.join(F.broadcast(counts), "lang").filter(short | ~F.col("has_short")).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "chars")
    before = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars")
    picked = few.select("lang", "id", "chars", F.row_number().over(order).alias("rank"), before.alias("before"))
    picked = picked.filter((F.col("rank") <= docs_a_language) & (F.col("before") < docs_a_language * LONGEST_TRAINING_TEXT)).drop("before")
    picked = ws.save(picked, "picked")  # docs_a_language rows a language at most
    texts = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), length.alias("chars"))
    sample = texts.join(F.broadcast(picked), ["id", "lang", "chars"]).dropDuplicates(["id", "lang", "text"])
    fitted = sample.groupBy("lang").applyInArrow(_train, "lang string, part string, data binary, threshold double")
    by_language: dict[str, dict[str, np.ndarray]] = {}
    thresholds: dict[str, float] = {}
    for r in fitted.collect():  # bounded by the sample
        kind = "<u8" if r["part"].startswith(("gram", "ctx", "shorter")) else "<f8"
        by_language.setdefault(r["lang"], {})[r["part"]] = np.frombuffer(bytes(r["data"]), kind)
        thresholds[r["lang"]] = r["threshold"]
    return Models(by_language, thresholds) if by_language else None




PREDICTED = "lang_pred string, score double, cross_entropy double, n_chars long, rejected boolean"


def _predict(shared, n_own: int, prefix: str):
    """Append the prediction to the first n_own columns of each batch; the text is the last one."""

    def run(batches):
        models: Models | None = shared.value
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
        names = [prefix + x.split()[0] for x in PREDICTED.split(", ")]
        for batch in batches:
            for at, texts in _texts(batch.column(batch.num_columns - 1), CHUNK):
                known = [t if t is not None and _has_letter(t) else None for t in texts]
                use = [k for k, t in enumerate(known) if t is not None]
                rows: list[tuple] = [(UNDETERMINED, 0.0, None, 0, True)] * len(texts)
                if use and models is not None:
                    n, ce = models.score([known[k] for k in use])
                    best = ce.argmin(axis=1)
                    low = ce[np.arange(len(use)), best]
                    # Evidence of at most 64 characters counts, so that the score of a long text isn't always 1.
                    odds = np.exp(-np.minimum(n, 64)[:, None] * (ce - low[:, None]))
                    score = 1.0 / odds.sum(axis=1)
                    for i, k in enumerate(use):
                        rows[k] = (models.languages[best[i]], float(score[i]), float(low[i]), int(n[i]), bool(low[i] > models.thresholds[best[i]] + SHORT / np.sqrt(max(1, n[i]))))
                own = batch.slice(at, len(texts))
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns[:n_own], *new], [*own.schema.names[:n_own], *names])

    return run


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.filter(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 != 1)


def identify_languages(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_a_language: int = DOCS_A_LANGUAGE,
    whole_rows: bool = False,
) -> DataFrame:
    """Predict the language of every whole text.

    For each label of `labelled` (default: the rows of `docs` that `training_rows` allows) an interpolated Kneser-Ney
    model of 5 characters is fitted on at most `docs_a_language` texts. A text gets the language of lowest cross-entropy a
    character. Four fifths of the sample give counts; the cross-entropies of the rest set the language's rejection
    threshold: their 95th percentile, plus twice its distance from the median, plus MARGIN; short texts get
    more room.

    Returns id, lang_pred, score (posterior from at most 64 characters of evidence, 0 to 1), cross_entropy, n_chars, rejected. A text that is null or without a letter is
    `und`, score 0, rejected; so is everything if no row has a label. Null ids and repeated rows each get their row. Columns other than id, text and label are ignored;
    label and id are never read when predicting. With whole_rows all columns of `docs` are returned, and the new ones are led by pred_ (and more underscores where a
    column of `docs` has that name already).
    """
    spark = docs.sparkSession
    models = train(training_rows(docs, id_col) if labelled is None else labelled, id_col, text_col, lang_col, docs_a_language)
    shared = spark.sparkContext.broadcast(models)
    own = docs if whole_rows else docs.select(id_col)
    new, prefix = T._parse_datatype_string(PREDICTED).fields, "pred_" if whole_rows else ""
    while any(f"{prefix}{f.name}" in own.columns for f in new):
        prefix += "_"
    schema = T.StructType(own.schema.fields + [T.StructField(f"{prefix}{f.name}", f.dataType) for f in new])
    rows = docs.select(*own.columns, F.col(text_col).cast("string").alias(free_name("_text", own.columns)))
    return Workspace(spark, "predicted").save(rows.mapInArrow(_predict(shared, len(own.columns), prefix), schema))
