"""Pieces of texts lose the blanks at their edges and nothing else, whatever digits they begin or end with: a function of two parameters in F.transform would be given the piece's place as what to trim."""

import duckdb
from pyspark.sql import functions as F

from quarry.functions.rerank import sentences
from quarry.operators import chunking as H
from quarry.operators import citations as C
from quarry.plans import answers
from quarry.plans.registry import SQL


def test_paragraphs_keep_digits(spark):
    df = spark.createDataFrame([(1, "0997 a 0\n\n 1b1 \n\n2 c 22")], "doc_id int, text string")
    assert [r["content"] for r in H.chunk_paragraphs(df).collect()] == ["0997 a 0\n\n1b1\n\n2 c 22"]


def test_claims_keep_digits(spark):
    answers = spark.createDataFrame([(1, "00 days are given [1]. 19.37 is the rate. [2] 20 are left [3].\n 100 rows [4]  \n2 hours [5] 3")], "answer_id int, answer string")
    rows = C.extract_claims(answers).orderBy("claim_no").select("claim", "marker").collect()
    assert [tuple(r) for r in rows] == [("00 days are given [1].", "[1]"), ("19.37 is the rate. [2] 20 are left [3].", "[2]"), ("19.37 is the rate. [2] 20 are left [3].", "[3]"), ("100 rows [4]", "[4]"), ("2 hours [5] 3", "[5]")]


def test_sentences_keep_digits(spark):
    (row,) = spark.range(1).select(sentences(F.lit("00 reports are due.  11 hours is the limit 1!\n 22 things are said")).alias("s")).collect()
    assert row["s"] == ["00 reports are due.", "11 hours is the limit 1!", "22 things are said"]


def test_audits_of_claims_that_begin_with_their_place(spark, tmp_path):
    """The claim is the answer's second sentence and begins with 1: without that digit its only run of three words is gone, and with it the support of [1]."""
    docs = [(1, "Ab cd ef gh ij kl. 11 zu ie and more of it.", "s1"), (2, "Ab cd ef gh ij kl. 21 zu ie and more of it.", "s2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for f in (answers.citation_claims, answers.citation_audit, answers.stream_citation_audit):
        out = f(spark, str(tmp_path))
        names = ", ".join(f'"{c}"' for c in out.columns)
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, con.execute(f"select {names} from ({SQL[f.__name__]})").fetchall()))
