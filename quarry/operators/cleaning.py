"""Cleaned documents and what cleaning removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.cleaning import clean, word_count


def clean_documents(docs: DataFrame, text_col: str = "text", **switches: bool) -> DataFrame:
    """Add cleaned text and per-document metrics. A null text is cleaned to the empty one."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("cleaned_text", clean(raw, **switches))
    a, b = F.length(raw), F.length("cleaned_text")
    return out.withColumns(
        {
            "raw_char_count": a,
            "cleaned_char_count": b,
            "chars_removed": F.greatest(F.lit(0), a - b),
            "reduction_pct": F.when(a > 0, F.round((a - b) / a * 100, 2)).otherwise(0.0),
            "raw_word_count": word_count(raw),
            "cleaned_word_count": word_count(F.col("cleaned_text")),
        }
    )


def corpus_rollup(cleaned: DataFrame) -> DataFrame:
    """Totals over the corpus; the reduction is a ratio of sums."""
    sums = cleaned.agg(
        F.count("*").alias("documents"),
        F.sum("raw_char_count").alias("raw_chars"),
        F.sum("cleaned_char_count").alias("cleaned_chars"),
        F.sum("chars_removed").alias("removed_chars"),
    )
    return sums.withColumn(
        "reduction_pct",
        F.when(F.col("raw_chars") > 0, F.round((F.col("raw_chars") - F.col("cleaned_chars")) / F.col("raw_chars") * 100, 2)).otherwise(0.0),
    )


SAMPLE_CHARS = 250


def before_after(rows: DataFrame, raw: str = "text", cleaned: str = "cleaned_text") -> DataFrame:
    """Raw and cleaned text side by side: characters, words, lines, and the trimmed first SAMPLE_CHARS characters of each. Null texts count as empty."""
    out = rows
    for name, column in (("raw", raw), ("cleaned", cleaned)):
        text = F.coalesce(F.col(column), F.lit(""))
        out = out.withColumns(
            {f"{name}_chars": F.length(text), f"{name}_words": word_count(text), f"{name}_lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, f"{name}_sample": F.btrim(F.substring(text, 1, SAMPLE_CHARS), F.lit(" \t\n\r"))}
        )
    gone = F.greatest(F.lit(0), F.col("raw_chars") - F.col("cleaned_chars"))
    return out.withColumns({"chars_removed": gone, "reduction_pct": F.when(F.col("raw_chars") > 0, F.round(gone / F.col("raw_chars") * 100, 2)).otherwise(0.0)})
