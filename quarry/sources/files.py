"""Documents from files: one binary scan, typed errors instead of failures."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are read, and their kind.
KINDS = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".pdf": "pdf"}
SILENT = {"script", "style", "noscript", "svg"}
UPLOAD_MB = 10


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.silent, self.in_title = [], "", 0, False

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        self.in_title = tag == "title"

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.silent and data.strip():
            self.parts.append(data.strip())


def html_to_text(html: str | None) -> tuple[str, str]:
    """(title, text): visible text, a line for each run of it."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser.title.strip(), "\n".join(parser.parts)


def with_html_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add title and content of HTML pages, in Arrow batches."""

    @F.pandas_udf("title string, content string")
    def extract(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_to_text(h) for h in html], columns=["title", "content"])

    return pages.withColumn("_x", extract(F.col(html_col))).select("*", "_x.title", "_x.content").drop("_x")


def decode_text(raw: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1; trimmed."""
    return F.trim(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1")))


def markdown_parts(text: Column) -> Column:
    """struct(title, content): front matter dropped, the first # line is the title."""
    body = F.regexp_replace(text, r"^(?s)---\s*\n.*?\n---\s*\n", "")
    return F.struct(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1).alias("title"), F.trim(body).alias("content"))


def pdf_pages(raw: bytes) -> list[str]:
    """Page texts by an optional parser."""
    import io

    from pypdf import PdfReader

    return [t for p in PdfReader(io.BytesIO(raw)).pages if (t := (p.extract_text() or "").strip())]


def page_boundaries(pages: list[str]) -> list[dict]:
    out, at = [], 0
    for i, p in enumerate(pages, 1):
        out.append({"page": i, "start": at, "end": at + len(p)})
        at += len(p) + 2
    return out


def _rich(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for kind, raw in zip(f["kind"], f["content"], strict=True):
            title, text, pages, error = "", "", [], None
            try:
                if kind == "html":
                    title, text = html_to_text(bytes(raw).decode("utf-8", "replace"))
                elif not bytes(raw).startswith(b"%PDF"):
                    error = "CORRUPT_PDF"
                else:
                    parts = pdf_pages(bytes(raw))
                    text, pages = "\n\n".join(parts), page_boundaries(parts)
            except ImportError:
                error = "PARSER_UNAVAILABLE"
            except Exception as e:  # noqa: BLE001  a bad file becomes an error record
                error = type(e).__name__
            rows.append((title, text, pages, error))
        out = pd.DataFrame(rows, columns=["title", "text", "page_boundaries", "parse_error"])
        yield pd.concat([f[["path", "length", "kind"]].reset_index(drop=True), out], axis=1)


RICH = "path string, length long, kind string, title string, text string, page_boundaries array<struct<page:int,start:int,end:int>>, parse_error string"


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, content of all files; Spark's scan passes over files without bytes, so these are added from its listing."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    found = scan.select(_one_slash(F.col("path")).alias("path"), "length", "content")
    listed = spark.createDataFrame([(p,) for p in scan.inputFiles()], "path string").select(_one_slash(F.col("path")).alias("path"))
    bare = listed.join(found.select("path"), "path", "left_anti")
    return found.unionByName(bare.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def _one_slash(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def load_documents(files: DataFrame) -> DataFrame:
    """A row a file: text, title, pages and counts, or error_type: UNSUPPORTED_FORMAT, EMPTY_FILE, EMPTY_CONTENT, or what its parser met."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    files = files.withColumns({"kind": F.try_element_at(kinds, ext), "file_type": ext, "filename": name})
    plain = files.filter("kind IN ('text', 'markdown') OR kind IS NULL")
    text = decode_text(F.col("content"))
    md = markdown_parts(text)
    plain = plain.select(
        "path", "length", "kind", F.when(F.col("kind") == "markdown", md["title"]).otherwise("").alias("title"),
        F.when(F.col("kind") == "markdown", md["content"]).when(F.col("kind") == "text", text).alias("text"),
        F.array().cast("array<struct<page:int,start:int,end:int>>").alias("page_boundaries"), F.lit(None).cast("string").alias("parse_error"),
    )
    rich = files.filter("kind IN ('html', 'pdf')").select("path", "length", "kind", "content").mapInPandas(_rich, RICH)
    rows = plain.unionByName(rich).withColumns({"filename": name, "file_type": ext})
    error = (
        F.when(F.col("kind").isNull(), "UNSUPPORTED_FORMAT")
        .when(F.col("length") == 0, "EMPTY_FILE")
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S")), "EMPTY_CONTENT")
    )
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return rows.withColumns({"error_type": error, "char_count": F.length("text"), "word_count": words}).drop("parse_error")


def in_path_order(files: DataFrame) -> DataFrame:
    """Files with their `position` in the order of their lower-cased paths, counted from 0; numbered inside ranges, not in one task."""
    from quarry.operators.ingest import running_index

    return running_index(files, [F.lower("path"), F.col("path")], "position")


#: What a strict load raises for an error type; a parser's own errors are a ValueError.
STRICT = {"UNSUPPORTED_FORMAT": NotImplementedError, "EMPTY_FILE": ValueError, "EMPTY_CONTENT": ValueError, "PARSER_UNAVAILABLE": ImportError}


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as a document (one row), or an error: FileNotFoundError, NotImplementedError for its format, ImportError without a parser, ValueError where it is empty or can't be read."""
    from pyspark.errors import AnalysisException

    try:
        rows = load_documents(scan_folder(spark, path, recursive=False)).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    if not rows:
        raise FileNotFoundError(path)
    if len(rows) > 1:
        raise IsADirectoryError(path)
    if problem := rows[0]["error_type"]:
        raise STRICT.get(problem, ValueError)(f"{path}: {problem}")
    return load_documents(scan_folder(spark, path, recursive=False))


def intake(loaded: DataFrame) -> DataFrame:
    ok = F.col("error_type").isNull()
    return loaded.agg(
        F.count("*").alias("files"), F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("skipped"),
        F.sum(F.when(ok, F.col("char_count"))).alias("chars"), F.sum(F.when(ok, F.col("word_count"))).alias("words"),
    )


def upload_problem(filename: Column, size: Column, chunk_size: Column, overlap: Column) -> Column:
    """Why an upload is refused; null if it isn't."""
    ext = F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1))
    return (
        F.when(F.trim(filename) == "", "MISSING_NAME")
        .when(~ext.isin(*KINDS), "UNSUPPORTED_FORMAT")
        .when(size == 0, "EMPTY_FILE")
        .when(size > UPLOAD_MB * 1024 * 1024, "TOO_LARGE")
        .when(~chunk_size.between(50, 2000), "BAD_CHUNK_SIZE")
        .when((overlap < 0) | (overlap >= chunk_size), "BAD_OVERLAP")
    )


def safe_name(filename: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(filename, r"[/\\]"), -1), r"[^A-Za-z0-9._-]", "_")
