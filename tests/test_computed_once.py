"""What lambdas look things up in is computed once a row, and what is estimated once a piece."""

from pyspark.sql import functions as F

from quarry.operators import chunking as H
from quarry.operators import evaluation as E


def expressions(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_context_is_lowered_once(spark):
    df = spark.createDataFrame([("It takes 6 hours to report. Zebras fly over the mountains today.", "Firms say IT TAKES 6 Hours to Report."), ("One two three four.", ""), ("", "x"), ("insufficient information", "x"), (None, None)], "answer string, context string")
    out = df.select(E.grounding(F.col("answer"), F.col("context")).alias("g"))
    assert [r["g"] for r in out.collect()] == [0.5, 0.0, 1.0, 1.0, 0.0]
    assert expressions(out, "lower(coalesce(context") == 1


def test_summary_reads_results_once(spark):
    rows = [(True, False, 0.5, 1.0, "PASS"), (True, False, None, 0.5, "MARGINAL_QUALITY"), (False, True, 0.25, 0.0, "PASS"), (False, False, 0.0, 0.0, "HALLUCINATED_ANSWER")]
    df = spark.createDataFrame([(*r[:2], r[2], r[3], r[3], r[4]) for r in rows], "answerable boolean, refused boolean, overall double, correctness double, grounding double, verdict string")
    out = E.answer_summary(df)
    row = out.first().asDict()
    assert row == {"cases": 4, "pass_rate": 0.5, "overall": 0.25, "correctness": 0.375, "grounding": 0.375, "safe_refusals": 0.5, "failures": {"HALLUCINATED_ANSWER": 1, "MARGINAL_QUALITY": 1}}
    assert expressions(out, "LogicalRDD") + expressions(out, "LocalRelation") == 1
    assert E.answer_summary(df.limit(0)).first().asDict() == {"cases": 0, "pass_rate": None, "overall": None, "correctness": None, "grounding": None, "safe_refusals": 1.0, "failures": {}}


def test_tokens_are_estimated_once(spark):
    texts = [("",), (" ",), ("a",), ("a b\n c  d",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    out = df.select(H.estimated_tokens(F.col("t")).alias("n"))
    assert [r["n"] for r in out.collect()] == [0, 0, 1, 5, 1] and expressions(out, "split(t") == 1
    text = "one two three. four five\n\nsix " + "seven " * 9 + "\n" + "x" * 40
    pieces = spark.createDataFrame([(text,)], "t string").select(H.recursive_pieces(F.col("t"), 3).alias("p")).first()["p"]
    assert pieces == ["one two three", "four five", "six", *["seven"] * 9, "x" * 40]
