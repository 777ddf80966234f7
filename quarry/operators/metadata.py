"""Uniform chunk metadata, citations of chunks, index records, and the places of chunks in their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.chunking import PREAMBLE, active_section, estimated_tokens, page_of, sections

FIELDS = {
    "source": "string", "filename": "string", "document_id": "string", "file_type": "string", "section": "string", "page_number": "int", "chunk_index": "int",
    "total_chunks": "int", "char_start": "int", "char_end": "int", "char_count": "int", "token_count": "int", "strategy": "string",
}
UNKNOWN = "unknown_document"


def _given(c: Column) -> Column:
    """A string, or null where it is empty."""
    return F.when(F.length(c) > 0, c)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def suffix(name: Column) -> Column:
    """The last extension with its dot; empty for a name without one, or with its only dot in front."""
    return F.regexp_extract(name, r"[^.](\.[^./\\]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^./\\])\.[^./\\]+$", "")


def chunk_metadata(chunks: DataFrame, extra: str | None = None) -> DataFrame:
    """The thirteen fields of FIELDS with their defaults, whatever of them `chunks` has; other columns stay.

    filename defaults to the source's last part, else "document"; the source to the filename; document_id to the filename with _ for dots; file_type to the filename's
    extension; section to the preamble; page_number to 1 where it is null or below 1; counts to 0, total_chunks to 1, strategy to "default". Of a map column `extra`, entries whose key is a
    field or starts with _ are left out.
    """
    have = set(chunks.columns)
    col = lambda c: F.col(c).cast(FIELDS[c]) if c in have else F.lit(None).cast(FIELDS[c])
    source, name = F.coalesce(_given(col("source")), F.lit("")), _given(col("filename"))
    name = F.coalesce(name, _given(base_name(source)), F.lit("document"))
    numbers = {c: F.coalesce(col(c), F.lit(1 if c == "total_chunks" else 0)) for c in ("chunk_index", "total_chunks", "char_start", "char_end", "char_count", "token_count")}
    out = chunks.withColumns(
        {
            "source": F.coalesce(_given(source), name), "filename": name, "document_id": F.coalesce(_given(col("document_id")), F.replace(name, F.lit("."), F.lit("_"))),
            "file_type": F.coalesce(_given(col("file_type")), suffix(name)), "section": F.coalesce(_given(col("section")), F.lit(PREAMBLE)),
            "page_number": F.when(col("page_number") > 0, col("page_number")).otherwise(1), "strategy": F.coalesce(_given(col("strategy")), F.lit("default")), **numbers,
        }
    )
    if extra:
        out = out.withColumn(extra, F.map_filter(extra, lambda k, _: ~k.isin(*FIELDS) & ~F.startswith(k, F.lit("_"))))
    return out


def citation(filename: Column, index: Column, total: Column, section: Column, page: Column) -> Column:
    """[Source: f, Chunk: i/n, Section: 's', Page: p], without a section that is blank or the preamble and without a page that is null or 0."""
    parts = F.array(
        F.concat(F.lit("Source: "), F.coalesce(filename, F.lit("Document"))),
        F.concat(F.lit("Chunk: "), (index + 1).cast("string"), F.lit("/"), total.cast("string")),
        F.when((section != "") & (section != PREAMBLE), F.concat(F.lit("Section: '"), section, F.lit("'"))),
        F.when(page != 0, F.concat(F.lit("Page: "), page.cast("string"))),
    )
    return F.concat(F.lit("["), F.array_join(F.array_compact(parts), ", "), F.lit("]"))


def sanitise(rows: DataFrame) -> DataFrame:
    """Every column as a primitive that a vector store takes: arrays, maps and structs as JSON, other types as text, a null text as an empty one.

    Numbers and booleans keep their type, so that a null one stays null.
    """
    plain = (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType)

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        elif not isinstance(f.dataType, plain):
            c = c.cast("string")
        elif not isinstance(f.dataType, T.StringType):
            return c.alias(f.name)
        return F.coalesce(c, F.lit("")).alias(f.name)

    return rows.select(*map(one, rows.schema.fields))


def index_record(chunks: DataFrame, dimension: int | None = None) -> DataFrame:
    """(id, embedding, document, metadata fields) of embedded chunks with the defaults of an index.

    chunks: chunk_id, source_text, embedding, and what there is of filename, source_document, chunk_index, section, page_number, document_id, token_count, file_type, strategy,
    total_chunks, relative_path, char_count. The source is the filename, else source_document, else UNKNOWN. A vector of another dimension is an error when the row is read.
    """
    have = set(chunks.columns)
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), default) if c in have else default
    number = lambda c, default: F.coalesce(F.col(c).cast("int"), default) if c in have else default
    source = F.coalesce(_given(text("filename", F.lit(None))), _given(text("source_document", F.lit(None))), F.lit(UNKNOWN))
    vec = F.col("embedding")
    if dimension is not None:
        message = F.concat(F.lit("dimension of chunk "), F.col("chunk_id").cast("string"), F.lit(f" is not {dimension}"))
        vec = F.when(F.size(vec) == dimension, vec).otherwise(F.raise_error(message).cast(chunks.schema["embedding"].dataType))
    return chunks.select(
        F.col("chunk_id").alias("id"), vec.alias("embedding"), F.col("source_text").alias("document"), source.alias("source_document"), source.alias("filename"),
        number("chunk_index", F.lit(0)).alias("chunk_index"), text("section", F.lit(PREAMBLE)).alias("section"), number("page_number", F.lit(1)).alias("page_number"),
        text("document_id", stem(base_name(source))).alias("document_id"), number("token_count", F.lit(0)).alias("token_count"), text("file_type", suffix(source)).alias("file_type"),
        text("strategy", F.lit("token_aware")).alias("strategy"), number("total_chunks", F.lit(1)).alias("total_chunks"), text("relative_path", F.lit("")).alias("relative_path"),
        number("char_count", F.length("source_text")).alias("char_count"),
    )


def find_span(text: Column, chunk: Column, hint: Column) -> Column:
    """struct(start, end) of a chunk in its document, counted from 0.

    The exact text from the hint on, else anywhere; else from its first 50 characters (from 200 before the hint on, else anywhere) to its last 50 after them; else its length from the hint on.
    """
    n, whole = F.length(text), F.length(chunk)
    clean = F.regexp_replace(chunk, r"^\s+|\s+$", "")
    head, tail = F.substring(clean, 1, 50), F.when(F.length(clean) > 50, F.right(clean, F.lit(50))).otherwise(clean)
    place = lambda part, start: F.call_function("locate", part, text, (start + 1).cast("int")) - 1
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    from_hint, anywhere = place(chunk, hint), place(chunk, F.lit(0))
    near, first = place(head, F.greatest(F.lit(0), hint - 200)), place(head, F.lit(0))
    begin = F.when(near >= 0, near).otherwise(first)
    last = place(tail, begin)
    safe = F.least(hint, n)
    return (
        F.when((n == 0) | (whole == 0) | text.isNull() | chunk.isNull(), span(F.lit(0), F.lit(0)))
        .when(from_hint >= 0, span(from_hint, from_hint + whole))
        .when(anywhere >= 0, span(anywhere, anywhere + whole))
        .when((begin >= 0) & (last >= 0), span(begin, last + F.length(tail)))
        .when(begin >= 0, span(begin, F.least(n, begin + whole)))
        .otherwise(span(safe, F.least(safe + whole, n)))
    )


def spans(text: Column, contents: Column) -> Column:
    """array<struct(start, end)> of a document's chunks in order; each is looked for from one character after the start of the one before."""
    start = F.struct(F.lit(0).alias("hint"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def add(acc: Column, chunk: Column) -> Column:
        one = find_span(text, chunk, acc["hint"])
        grown = F.transform(F.array(one), lambda s: F.struct((s["start"] + 1).alias("hint"), F.array_append(acc["found"], s).alias("found")))
        return F.get(grown, F.lit(0))

    return F.aggregate(contents, start, add, lambda acc: acc["found"])


def with_provenance(chunks: DataFrame, docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", boundaries: str | None = None) -> DataFrame:
    """Any chunker's output (doc_col, chunk_index, content, strategy) with the thirteen uniform fields: spans by find_span, the section at the start, the page, sizes.

    docs: doc_col, text_col, and what there is of source, filename, document_id, file_type and an array of page boundaries. A document's chunks are folded in one array.
    """
    named = [c for c in ("source", "filename", "document_id", "file_type") if c in docs.columns]
    pieces = chunks.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content", "strategy"))).alias("_p"))
    pages = F.col(boundaries) if boundaries else F.array().cast("array<struct<page:int,start:int,end:int>>")
    own = docs.select(doc_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *named, pages.alias("_b"))
    rows = pieces.join(own, doc_col).withColumn("_s", spans(F.col("_t"), F.transform("_p", lambda p: p["content"]))).withColumn("_h", sections(F.col("_t")))
    rows = rows.withColumn("_n", F.size("_p")).select(doc_col, *named, "_h", "_b", "_n", F.explode(F.arrays_zip("_p", "_s")).alias("z"))
    rows = rows.select(
        doc_col, *named, F.col("z._p.chunk_id").alias("chunk_id"), F.col("z._p.content").alias("content"), F.col("z._p.strategy").alias("strategy"), F.col("z._p.chunk_index").alias("chunk_index"),
        F.col("_n").alias("total_chunks"), F.col("z._s.start").alias("char_start"), F.col("z._s.end").alias("char_end"), F.length("z._p.content").alias("char_count"),
        estimated_tokens(F.col("z._p.content")).alias("token_count"), active_section(F.col("_h"), F.col("z._s.start")).alias("section"), page_of(F.col("z._s.start"), F.col("_b")).alias("page_number"),
    )
    return chunk_metadata(rows)
