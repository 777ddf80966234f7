"""Uploads that can be searched as soon as their micro-batch is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.chunking import chunk_words
from quarry.operators.cleaning import clean_documents
from quarry.operators.ingest import embed
from quarry.operators.metadata import base_name, index_record, stem, suffix, with_provenance
from quarry.operators.ranking import best_rows
from quarry.session import stored
from quarry.sources.files import load_documents, safe_name, upload_problem
from quarry.sources.keyed import KeyedTable

Provider = Callable[[list[str]], list[list[float]]]


class UploadIndex:
    """Two keyed tables by document: `records` (id, embedding, document and metadata) and `ledger` (one row an upload)."""

    def __init__(self, spark: SparkSession, path: str, provider: Provider, dimension: int, chunk_size: int = 300, chunk_overlap: int = 50):
        self.records = KeyedTable(spark, f"{path}/records", "filename")
        self.ledger = KeyedTable(spark, f"{path}/ledger", "filename")
        self.provider, self.dimension, self.size, self.overlap = provider, dimension, chunk_size, chunk_overlap

    def add(self, batch: int, uploads: DataFrame) -> None:
        """Check, load, clean, chunk and embed uploads (filename, content), and put their records in place of those that their names had.

        Refused uploads leave what stands under their name. Of uploads of one name in a batch the one with the smallest hash counts. A batch that is added again replaces itself.
        """
        given, size = F.trim(F.coalesce(F.col("filename"), F.lit(""))), F.coalesce(F.octet_length("content"), F.lit(0))
        name = F.when(given == "", "").otherwise(safe_name(given))
        rows = uploads.select(name.alias("path"), F.coalesce("content", F.lit(b"")).alias("content"), size.cast("long").alias("length"))
        rows = rows.groupBy("path").agg(F.min_by(F.struct("content", "length"), F.xxhash64("content")).alias("u")).select("path", "u.*")
        rows = stored(rows.withColumn("problem", upload_problem(F.col("path"), F.col("length"), F.lit(self.size), F.lit(self.overlap))), "upload-batch")
        loaded = load_documents(rows.filter("problem IS NULL").select("path", "length", "content"))
        cleaned = clean_documents(loaded.withColumn("text", F.when(F.col("error_type").isNull(), F.col("text"))))
        texts = stored(cleaned.select("path", "length", F.col("path").alias("doc_id"), F.col("error_type").alias("problem"), "raw_char_count", "cleaned_char_count", F.col("cleaned_text").alias("text"), "page_boundaries"), "uploads")
        self._index(batch, texts)
        made = self.records.changes(batch).groupBy(F.col("filename").alias("path")).agg(F.count("*").alias("indexed"))
        done = texts.join(made, "path", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("indexed").isNull(), "NO_RECORDS")))
        refused = rows.filter("problem IS NOT NULL").select("path", "length", "problem")
        every = done.select("path", "length", "problem", "raw_char_count", "cleaned_char_count", "indexed").unionByName(refused, allowMissingColumns=True)
        number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        self.ledger.write(batch, every.select(
            F.col("path").alias("filename"), F.when(F.col("problem").isNull(), "success").otherwise("refused").alias("status"), "problem", suffix(F.col("path")).alias("file_type"), F.col("length").alias("file_size_bytes"),
            number("raw_char_count").alias("raw_characters"), number("cleaned_char_count").alias("cleaned_characters"), number("indexed").alias("records_indexed"),
        ))

    def _index(self, batch: int, texts: DataFrame) -> None:
        good = texts.filter("problem IS NULL").withColumns({"filename": base_name(F.col("path")), "source": F.col("path"), "document_id": stem(F.col("path")), "file_type": suffix(F.col("path"))})
        chunks = with_provenance(chunk_words(good, self.size, self.overlap), good, boundaries="page_boundaries")
        chunks = stored(chunks, "upload-chunks")
        vectors = embed(chunks, self.provider).filter("error IS NULL").select("chunk_id", "embedding")
        self.records.write(batch, index_record(chunks.join(vectors, "chunk_id").withColumnRenamed("content", "source_text"), self.dimension))

    def stream(self, uploads: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add every micro-batch of a stream of uploads; the stream's checkpoint numbers them."""
        return uploads.writeStream.foreachBatch(lambda rows, batch: self.add(batch, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def search(self, queries: DataFrame, k: int = 3, metric: str = "cosine", **more) -> DataFrame:
        """The k best records for each query (query_id, query_vec), over all that is indexed now; no rows before the first upload."""
        records = self.records.read()
        if records is None:
            raise ValueError("nothing has been uploaded")
        asked = more.get("match", (None, None))[1]  # texts and metadata meet the rows that were found, they aren't ranked with
        ranked = stored(best_rows(queries, records.select("id", F.col("embedding").alias("vec"), *([asked] if asked else [])), k, metric, **more), "found")
        return ranked.join(records.drop("embedding", *([asked] if asked else [])), "id")
