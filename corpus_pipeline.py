"""A training-corpus pipeline: language, near copies, repeated passages, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, drop_keys, free_name, membership_filter, passing, passing_workspaces
from quarry.llm.language import identify_languages
from quarry.llm.mixing import mix_sources
from quarry.llm.packing import pack_along_curve
from quarry.llm.queries import tokenizer_path
from quarry.llm.repeats import keyed, without_repeats
from quarry.llm.shingles import jaccard_components

#: Bytes of a repeated passage: 51 words of three letters and a space have a few more.
PASSAGE_BYTES = 200
MIX_REPETITION = 1.25  #: epochs of the most repeated source; every document stays at least once


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the models reject go, null and letterless texts among them. Every row is judged by its own text: null and repeated ids don't matter."""
    found = identify_languages(docs, whole_rows=True)
    rejected = found.columns[-1]
    return found.filter(~F.col(rejected)).select(*docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that 5-word shingles link at 0.8 or more.

    A null or blank text links with nothing and stays. Rows that repeat an id and its text are copies of each other: one of them stays. Of rows with a null id each
    stands under a hash of its text and goes only if it is linked with a smaller one.
    """
    ws = Workspace(spark, "near-copies")
    uid = free_name("_uid", docs.columns)
    rows = keyed(ws, docs, "doc_id", "text", uid, body := free_name("_body", docs.columns))
    found = jaccard_components(rows.select(F.col(uid).alias("doc_id"), F.col(body).alias("text")), percent=80, size=5)
    others = ws.save(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(uid)).distinct(), "others")
    left = drop_keys(ws, rows, others, uid)
    twice = ws.save(left.groupBy(uid).agg(F.count("*").alias("n")).filter("n > 1").select(uid), "twice")
    if twice.limit(1).count() == 0:
        return left.select(*docs.columns)
    shared = membership_filter(twice, uid)
    again = passing(left, uid, shared).dropDuplicates([uid])
    return passing(left, uid, shared, clear=True).unionByName(again).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of strings of PASSAGE_BYTES bytes; the first copy, by id, stays. A text that is one whole later copy goes.

    Passages of over 50 words are longer than that. Null texts stay, n_chars follows the text.
    """
    before = free_name("_before", docs.columns)
    cut = without_repeats(docs.withColumn(before, F.length("text").cast("long")), length=PASSAGE_BYTES)
    now = F.length("text").cast("long")
    cut = cut.filter(F.col("text").isNull() | (now > 0) | (F.col(before) == 0))
    return cut.withColumn("n_chars", F.when(now != F.col(before), now).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights: small sources are partly repeated, every document stays at least once."""
    return mix_sources(docs, max_repetition=MIX_REPETITION, cover=True).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, neighbours on the Hilbert curve together."""
    return pack_along_curve(docs, tokenizer_path(), length=1024, end_id=0)


STAGES = [
    ("language", keep_identified),
    ("near_copies", keep_one_near_copy),
    ("repeats", cut_repeats),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None  #: trained models, hashed permutations and tokenizers have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; what a stage wrote on its way is deleted after it."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with passing_workspaces(spark):
            docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
