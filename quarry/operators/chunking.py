"""Chunks of documents with their provenance."""

from __future__ import annotations

import functools
import os
import re
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREAMBLE = "Preamble / Document Header"
# What a section heading looks like.
HEADING = (
    r"(?i)^(?:#{1,6}\s+[^\n]+|(?:section|clause|article|chapter|part|rule)\s+[0-9ivxlcdm]+[:.\-]?\s*[^\n]+"
    r"|[0-9]{1,2}(?:\.[0-9]{1,2})*\.\s+[a-z][^\n]+)$"
)


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size is 1 at least")
    if not 0 <= overlap < size:
        raise ValueError("overlap is 0 at least and less than size")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def estimated_tokens(text: Column) -> Column:
    """Words times 1.3, at least 1; 0 for a text without words."""
    return F.coalesce(F.floor(F.array_size(words(text)) * 1.3).cast("int"), F.lit(1))  # one use of the words, since lambdas compute each use anew; 1 for null


class Tokenizer(Protocol):
    """What chunking and budgets need of a tokenizer; an object of this kind is sent to the workers and used there on batches of texts."""

    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[int]) -> str: ...


class FileTokenizer:
    """A file of the tokenizers library; it is read once in each worker that uses it."""

    def __init__(self, path: str):
        self.path = path

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in _file_tokenizer(self.path).encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return _file_tokenizer(self.path).decode(ids, skip_special_tokens=False)


@functools.cache
def _file_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


def count_tokens(rows: DataFrame, tokenizer: Tokenizer, text_col: str = "text", out: str = "token_count") -> DataFrame:
    """Add the tokens that a tokenizer gives each text; 0 for null and empty ones."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for ids in tokenizer.encode_batch(texts.fillna("").tolist())], dtype="int32")

    return rows.withColumn(out, count(F.col(text_col)))


def chunk_tokens(docs: DataFrame, tokenizer: Tokenizer, size: int = 300, overlap: int = 50, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_words by a tokenizer's own tokens: windows of `size` ids that share `overlap`, each decoded. Texts without ids give no chunk."""
    check_window(size, overlap)

    def run(batches):
        for batch in batches:
            out = []
            for i, ids in enumerate(tokenizer.encode_batch([t or "" for t in batch.column("t").to_pylist()])):
                starts = range(0, max(1, -(-(len(ids) - size) // (size - overlap)) + 1) * (size - overlap), size - overlap) if ids else ()
                out += [(i, k, len(starts), a, min(a + size, len(ids)), tokenizer.decode(ids[a : a + size])) for k, a in enumerate(starts)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            own = batch.column("d").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["d", "chunk_index", "total_chunks", "token_start", "token_end", "content"])

    rows = docs.select(F.col(doc_col).alias("d"), F.col(text_col).alias("t"))
    kind = rows.schema["d"].dataType.simpleString()
    found = rows.mapInArrow(run, f"d {kind}, chunk_index int, total_chunks int, token_start int, token_end int, content string").withColumnRenamed("d", doc_col)
    return _named(found.withColumn("token_count", F.col("token_end") - F.col("token_start")), doc_col, "tokenaware")


def _starts(n: Column, size: int, overlap: int) -> Column:
    """Window starts 0, step, ... up to the first window that reaches the end."""
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int") * step)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last, F.lit(step)))


def unnested(rows: DataFrame, pieces: str, at: str, piece: str, *keep: Column | str) -> DataFrame:
    """A row for each element of an array, with its place; none for null and empty arrays.

    Of posexplode Spark infers that the array isn't empty and repeats the expression that makes it in a filter below, so that a text is cut twice, or once for every reference in it. The outer form has
    no such filter, and the one on the place can't move below it.
    """
    return rows.select(*keep, F.posexplode_outer(pieces).alias(at, piece)).filter(F.col(at).isNotNull())


def _named(chunks: DataFrame, doc_col: str, suffix: str) -> DataFrame:
    return chunks.withColumn(
        "chunk_id", F.format_string(f"%s_{suffix}_%03d", F.regexp_replace(F.col(doc_col).cast("string"), r"\.", "_"), F.col("chunk_index"))
    ).withColumn("strategy", F.lit(suffix))


def _finish(chunks: DataFrame, doc_col: str, suffix: str) -> DataFrame:
    total = F.size("pieces") if "pieces" in chunks.columns else F.count("*").over(Window.partitionBy(doc_col))
    return _named(chunks.withColumn("total_chunks", total), doc_col, suffix)


def word_windows(docs: DataFrame, size: int = 300, overlap: int = 50, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_words without the contents, for plans that need places and counts alone."""
    check_window(size, overlap)
    rows = docs.select(F.col(doc_col), F.size(words(F.coalesce(F.col(text_col), F.lit("")))).alias("n"))
    rows = rows.withColumn("pieces", _starts(F.col("n"), size, overlap))
    out = unnested(rows, "pieces", "chunk_index", "token_start", doc_col, "n", F.size("pieces").alias("total_chunks"))
    out = out.withColumn("token_end", F.least(F.col("token_start") + size, F.col("n"))).withColumn("token_count", F.col("token_end") - F.col("token_start"))
    return _named(out.drop("n"), doc_col, "tokenaware")


def chunk_words(docs: DataFrame, size: int = 300, overlap: int = 50, doc_col: str = "doc_id", text_col: str = "text", strategy: str = "tokenaware") -> DataFrame:
    """Sliding windows of `size` words that share `overlap`; the last one ends with the text. Texts without words give no chunk.

    The windows are cut before the rows are multiplied, so that no row carries the whole text.
    """
    check_window(size, overlap)
    rows = docs.select(F.col(doc_col), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))

    def window(s: Column) -> Column:
        return F.struct(s.alias("s"), F.least(s + size, F.size("w")).alias("e"), F.array_join(F.slice("w", s + 1, F.lit(size)), " ").alias("c"))

    rows = rows.select(doc_col, F.transform(_starts(F.size("w"), size, overlap), window).alias("pieces"))
    out = unnested(rows, "pieces", "chunk_index", "p", doc_col, F.size("pieces").alias("total_chunks"))
    out = out.select(doc_col, "total_chunks", "chunk_index", F.col("p.s").alias("token_start"), F.col("p.e").alias("token_end"), (F.col("p.e") - F.col("p.s")).alias("token_count"), F.col("p.c").alias("content"))
    out = _named(out, doc_col, strategy)
    return out.select(doc_col, "chunk_id", "chunk_index", "total_chunks", "token_start", "token_end", "token_count", "content", "strategy")


def chunk_fixed(docs: DataFrame, size: int = 300, overlap: int = 60, count_by: str = "chars", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fixed windows by characters or by tokens (words)."""
    if count_by not in ("chars", "tokens"):
        raise ValueError("count_by is 'chars' or 'tokens'")
    return chunk_chars(docs, size, overlap, doc_col, text_col) if count_by == "chars" else chunk_words(docs, size, overlap, doc_col, text_col, "fixed")


def chunk_chars(docs: DataFrame, size: int = 300, overlap: int = 60, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sliding windows of `size` characters; char_start and char_end are those of the window, content is trimmed, blank windows go."""
    check_window(size, overlap)
    rows = docs.select(F.col(doc_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("starts", _starts(F.length("t"), size, overlap))
    pieces = F.transform(
        "starts",
        lambda s: F.struct(s.alias("s"), F.trim(F.col("t").substr(s + 1, F.lit(size))).alias("c")),
    )
    rows = rows.withColumn("pieces", F.filter(pieces, lambda p: p["c"] != ""))
    out = unnested(rows, "pieces", "chunk_index", "p", doc_col, F.length("t").alias("n"), F.size("pieces").alias("total_chunks"))
    out = out.select(
        doc_col, "total_chunks", "chunk_index", F.col("p.s").alias("char_start"),
        F.least(F.col("p.s") + size, F.col("n")).alias("char_end"), F.col("p.c").alias("content"),
    )
    return _named(out, doc_col, "fixed")


def _packed(pieces: Column, most: int, glue: str) -> Column:
    """Greedy runs of pieces whose estimated tokens fit `most`; an oversized piece stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def add(acc: Column, piece: Column) -> Column:
        n = estimated_tokens(piece)
        full = (acc["n"] > 0) & (acc["n"] + n > most)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), piece).otherwise(F.concat(acc["cur"], F.lit(glue), piece)).alias("cur"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]))


def _explode(docs: DataFrame, doc_col: str, pieces: Column, suffix: str) -> DataFrame:
    rows = docs.select(F.col(doc_col), pieces.alias("pieces"))
    out = unnested(rows, "pieces", "chunk_index", "content", doc_col, "pieces")
    return _finish(out.withColumn("token_count", estimated_tokens(F.col("content"))), doc_col, suffix).drop("pieces")


def chunk_paragraphs(docs: DataFrame, most: int = 450, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs packed in order while their estimated tokens fit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    paras = F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.trim(p)), lambda p: p != "")
    return _explode(docs, doc_col, _packed(paras, most, "\n\n"), "para")


SEPARATORS = ("\n\n", "\n", ". ", " ")


def recursive_pieces(text: Column, most: int) -> Column:
    """A text split at blank lines, lines, sentences, words and at last characters, each only where a piece has more than `most` estimated tokens; pieces are stripped, blank ones go."""
    return F.transform(_sized_pieces(text, most), lambda p: p["t"])


def _sized(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.struct(p.alias("t"), estimated_tokens(p).alias("n")))


def _sized_pieces(text: Column, most: int) -> Column:
    """recursive_pieces with their tokens, which are estimated once a piece: struct(t, n)."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def split_long(pieces: Column, cut) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.when(p["n"] <= most, F.array(p)).otherwise(_sized(cut(p["t"])))))

    pieces = _sized(F.array(text))
    for sep in SEPARATORS:
        pieces = split_long(pieces, lambda t, pattern=re.escape(sep): F.filter(F.transform(F.split(t, pattern), trimmed), lambda x: x != ""))
    return split_long(pieces, lambda t: F.split(t, ""))


def merged_pieces(pieces: Column, most: int, overlap: int) -> Column:
    """_merged of pieces without their tokens."""
    return _merged(_sized(pieces), most, overlap)


def _merged(sized: Column, most: int, overlap: int) -> Column:
    """Runs of pieces (t, n) whose tokens fit `most`, joined by blank lines; a new run begins with the last pieces of the one before that fit `overlap` tokens."""
    piece = "struct<t:string,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(f"array<{piece}>").alias("cur"), F.lit(0).alias("n"))
    glued = lambda cur: F.regexp_replace(F.array_join(F.transform(cur, lambda p: p["t"]), "\n\n"), r"^\s+|\s+$", "")

    def carried(cur: Column) -> Column:
        begin = F.struct(F.array().cast(f"array<{piece}>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def take(acc: Column, p: Column) -> Column:
            fits = acc["open"] & (acc["n"] + p["n"] <= overlap)
            return F.struct(F.when(fits, F.array_prepend(acc["kept"], p)).otherwise(acc["kept"]).alias("kept"), (acc["n"] + F.when(fits, p["n"]).otherwise(0)).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(cur), begin, take)

    def add(acc: Column, p: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["n"] + p["n"] > most)
        tail = F.when(full, carried(acc["cur"]))
        return F.struct(
            F.when(full, F.array_append(acc["done"], glued(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.array_append(F.when(full, tail["kept"]).otherwise(acc["cur"]), p).alias("cur"),
            (F.when(full, tail["n"]).otherwise(acc["n"]) + p["n"]).alias("n"),
        )

    last = lambda acc: F.when((F.size(acc["cur"]) > 0) & (glued(acc["cur"]) != ""), F.array_append(acc["done"], glued(acc["cur"]))).otherwise(acc["done"])
    return F.aggregate(sized, start, add, last)


def chunk_recursive(docs: DataFrame, most: int = 350, overlap: int = 50, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """recursive_pieces, merged up to `most` estimated tokens with up to `overlap` tokens carried over. Blank texts give no chunk."""
    check_window(most, overlap)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _explode(docs, doc_col, _merged(_sized_pieces(text, most), most, overlap), "recursive")


def sections(text: Column) -> Column:
    """array<struct(offset, title)> of headings by line, led by the preamble at 0; offsets count characters from 0."""
    lines = F.transform(F.split(text, "\n"), lambda s: s)
    start = F.struct(F.lit(0).alias("at"), F.array(F.struct(F.lit(0).alias("offset"), F.lit(PREAMBLE).alias("title"))).alias("found"))

    def add(acc: Column, line: Column) -> Column:
        title = F.trim(F.regexp_replace(F.trim(line), r"^#{1,6}\s*", ""))
        heading = F.rlike(line, F.lit(HEADING)) & (title != "") & (F.length(title) <= 150)
        entry = F.named_struct(F.lit("offset"), acc["at"], F.lit("title"), title)  # struct() would lose its names beside a generator
        return F.struct(
            (acc["at"] + F.length(line) + 1).alias("at"),
            F.when(heading, F.array_append(acc["found"], entry)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(lines, start, add, lambda acc: acc["found"])


def active_section(found: Column, offset: Column) -> Column:
    """Title of the last section that begins at or before an offset."""
    return F.element_at(F.filter(found, lambda s: s["offset"] <= offset), -1)["title"]


def page_of(offset: Column, boundaries: Column, text: Column | None = None) -> Column:
    """Page whose [start, end] holds the offset, both ends included; the last page beyond them, else 1. Without boundaries, form feeds of the text before the offset end pages."""
    inside = F.filter(boundaries, lambda b: (b["start"] <= offset) & (offset <= b["end"]))
    last = F.element_at(boundaries, -1)
    return (
        F.when(F.size(boundaries) == 0, 1 if text is None else F.size(F.split(F.substring(text, F.lit(1), offset), "\f")))
        .when(F.size(inside) > 0, F.get(inside, F.lit(0))["page"])
        .when(offset > last["end"], last["page"])
        .otherwise(1)
    )


def chunk_statistics(chunks: DataFrame, document_tokens: DataFrame | None = None) -> DataFrame:
    """Per strategy: chunks, characters and tokens, their means, extremes, population deviation around the rounded mean, and chunks that end a sentence.

    One pass: the deviation follows from the sums of the counts and of their squares. document_tokens (one row, `document_tokens`) adds the tokens that
    overlaps repeat, in % of the documents' own.
    """
    n, tokens = F.count("*"), F.col("token_count").cast("double")
    ends = F.rlike(F.regexp_replace("content", r"\s+$", ""), F.lit("""[.?!:"']$""")).cast("double")
    out = chunks.groupBy("strategy").agg(
        n.alias("total_chunks"), F.sum(F.length("content")).alias("total_chars"), F.sum("token_count").alias("total_tokens"),
        F.round(F.avg(F.length("content")), 1).alias("avg_chars"), F.round(F.avg("token_count"), 1).alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.avg(tokens).alias("_m"), F.avg(tokens * tokens).alias("_s"),
        F.round(F.avg(ends) * 100, 2).alias("sentence_end_pct"),
    )
    spread = F.col("_s") - 2 * F.col("avg_tokens") * F.col("_m") + F.col("avg_tokens") * F.col("avg_tokens")
    out = out.withColumn("std_tokens", F.round(F.sqrt(F.greatest(F.lit(0.0), spread)), 4)).drop("_m", "_s")
    if document_tokens is None:
        return out
    own = F.col("document_tokens")
    more = F.when(own > 0, F.round((F.col("total_tokens") - own) / own * 100, 1)).otherwise(0.0)
    return out.crossJoin(F.broadcast(document_tokens)).withColumn("overlap_overhead_pct", more).drop("document_tokens")  # one row


def compare_strategies(docs: DataFrame, strategies: dict[str, DataFrame], doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_statistics of several chunkers' outputs over the same documents, by name."""
    own = docs.agg(F.sum(estimated_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("document_tokens"))
    out = None
    for name, chunks in strategies.items():
        content = F.col("content")
        part = chunks.select(F.lit(name).alias("strategy"), content.alias("content"), estimated_tokens(content).alias("token_count"))
        out = part if out is None else out.unionByName(part)
    return chunk_statistics(out, own)


def boundary_preservation(docs: DataFrame, size: int = 300, overlap: int = 50, around: int = 20, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document of more than `size` words: chunks without and with overlap, words that the second chunk repeats, and whether the words around the first boundary stand whole in it."""
    check_window(size, overlap)
    w = words(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(doc_col, w.alias("w")).withColumn("n", F.size("w")).filter(F.col("n") > size)
    idea = F.array_join(F.slice("w", F.lit(max(0, size - around) + 1), F.lit(around + min(around, size))), " ")
    second = F.array_join(F.slice("w", F.lit(size - overlap + 1), F.lit(size)), " ")
    return rows.select(
        doc_col, F.col("n").alias("total_tokens"), F.size(_starts(F.col("n"), size, 0)).alias("chunks_plain"), F.size(_starts(F.col("n"), size, overlap)).alias("chunks_overlapping"),
        F.lit(overlap).alias("shared_tokens"), F.contains(second, idea).alias("boundary_intact"),
    )


SYSTEM_TOKENS, QUERY_TOKENS, ANSWER_TOKENS = 550, 150, 1024  #: fixed values: parts of a prompt's budget beside the chunks


def window_budget(window: Column, size: Column, overlap: Column, k: Column) -> Column:
    """struct(retrieved, used, headroom, utilisation_pct, overhead_pct) of k chunks of `size` tokens in a model's window."""
    used = k * size + SYSTEM_TOKENS + QUERY_TOKENS + ANSWER_TOKENS
    return F.struct(
        (k * size).alias("retrieved"), used.alias("used"), (window - used).alias("headroom"),
        F.round(used / window * 100, 1).alias("utilisation_pct"), F.round(overlap / (size - overlap) * 100, 1).alias("overhead_pct"),
    )


def longest_border(head: list[str], tail: list[str]) -> int:
    """Length of the longest beginning of `head` that is an end of `tail`, by the prefix function of the two put together."""
    joined = [*head, None, *tail]  # no token equals the one between
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        border[i] = k + (joined[i] == joined[k])
    return border[-1] if tail else 0


def _shared(most: int):
    @F.pandas_udf("struct<tokens:int,text:string>")
    def run(a: pd.Series, tail: pd.Series, head: pd.Series) -> pd.DataFrame:
        out = []
        for text, end, begin in zip(a, tail, head, strict=True):
            end, begin = list(end), list(begin)
            n = longest_border(begin[: most + 2], end)
            if not n:  # a word may be cut where the chunk begins or ends: then the text is compared
                n = next((k for k in range(min(len(begin), 2 * most), 0, -1) if text.endswith(" ".join(begin[:k]))), 0)
            out.append((n, " ".join(begin[:n])))
        return pd.DataFrame(out, columns=["tokens", "text"])

    return run


def overlaps(chunks: DataFrame, overlap: int, doc_col: str = "doc_id") -> DataFrame:
    """For each chunk and the next of its document, what the texts themselves share: the longest run of at most overlap + 2 words that ends the one and begins the other, by the prefix function of both ends; where
    there is none, the longest run of at most twice `overlap` words with which the text ends; else the words that the windows' places share, where the chunks have them.

    Columns: chunk_a, chunk_b, expected, shared (words), shared_text, is_overlapping. Null contents share nothing.
    """
    order = Window.partitionBy(doc_col).orderBy("chunk_index")
    ends = ["token_start", "token_end"] if "token_start" in chunks.columns else []
    places = [F.lead("token_start").over(order).alias("next_start"), "token_end"] if ends else []
    rows = chunks.withColumn("content", F.coalesce("content", F.lit(""))).select(doc_col, "chunk_id", "content", F.lead("chunk_id").over(order).alias("next_id"), F.lead("content").over(order).alias("next_content"), *places)
    rows = rows.filter("next_id IS NOT NULL").select(
        "chunk_id", "next_id", F.trim("content").alias("a"), F.slice(F.reverse(words(F.col("content"))), 1, overlap + 2).alias("back"), F.slice(words(F.col("next_content")), 1, max(2 * overlap, overlap + 2)).alias("head"), *(["token_end", "next_start"] if ends else [])
    )
    a = F.col("a").substr(F.greatest(F.lit(1), F.length("a") - F.length(F.array_join("head", " ")) + 1), F.length("a"))  # what may be shared
    found = rows.withColumn("s", _shared(overlap)(a, F.reverse("back"), F.col("head")))
    by_place = F.greatest(F.lit(0), F.col("token_end") - F.col("next_start")) if ends else F.lit(0)
    shared = F.when(F.col("s.tokens") > 0, F.col("s.tokens")).otherwise(by_place)
    return found.select(
        F.col("chunk_id").alias("chunk_a"), F.col("next_id").alias("chunk_b"), F.lit(overlap).alias("expected"), shared.cast("int").alias("shared"), F.col("s.text").alias("shared_text"),
        ((F.col("s.tokens") > 0) | (by_place > 0)).alias("is_overlapping"),
    )


def trace(chunks: DataFrame, docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", context: int = 120) -> DataFrame:
    """Hold each chunk against its document: 1.0 where the slice agrees but for white space, 0.95 where its first 50 characters are found, else 0."""
    own = docs.select(doc_col, F.col(text_col).alias("source_text"))
    rows = chunks.join(own, doc_col, "left")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.col("source_text").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    exact = F.contains(flat(cut), flat(F.col("content")))
    score = F.when(exact, 1.0).when(F.contains(F.col("source_text"), F.substring("content", 1, 50)), 0.95).otherwise(0.0)
    at = F.greatest(F.lit(0), F.col("char_start") - context)
    around = F.col("source_text").substr(at + 1, F.col("char_end") + context - at)
    return rows.select(
        doc_col, "chunk_id", F.col("source_text").isNotNull().alias("file_exists"), F.coalesce(score, F.lit(0.0)).alias("similarity_score"),
        F.coalesce(score > 0, F.lit(False)).alias("is_verified"), F.length(around).alias("context_chars"),
    )
