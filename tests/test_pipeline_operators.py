"""Question runs and experiments with stand-in providers."""

from pyspark.sql import functions as F

from quarry.operators import pipeline as P
from quarry.plans import answers


def test_question_runs(spark):
    rows = answers.question_runs(spark, "/root/testdata/sf0.001").collect()
    d = "/root/testdata/sf0.001"
    ids = spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 20 = 0").selectExpr("vec_id AS doc_id").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    assert len(rows) == ids.count() > 0 and {r["action"] for r in rows} <= {"ANSWER", "REFUSE"}
    for r in rows:
        assert r["fabricated"] == 0 and ("[1]" in r["answer"]) == (r["action"] == "ANSWER")
        assert r["verdict"] == "PASS" or r["action"] == "ANSWER"


def test_grid_prompts_and_scores(spark):
    q = spark.createDataFrame([(1, "what"), (2, None)], "query_id int, question string")
    prompts = q.withColumn("prompt", F.concat(F.lit("SOURCE [1]: x\nContent:\na b c d "), "question"))
    out = P.experiment_grid(prompts, [("short", {"max_tokens": 2}), ("long", {"max_tokens": 4})], P.extractive_generator).collect()
    assert {(r["query_id"], r["setting"], r["answer"]) for r in out} == {(1, "short", "a b. [1]"), (1, "long", "a b c d. [1]"), (2, "short", None), (2, "long", None)}
    raw = spark.createDataFrame([('ok {"score": 7.5} bye',), ("none",)], "raw string")
    assert [r["s"] for r in raw.select(P.model_score(F.col("raw")).alias("s")).collect()] == [0.75, 0.5]
    ab = P.compare_prompts(q, {"a": "{q}?", "b": "SOURCE [1]: y\nContent:\n{q}"}, {"q": F.col("question")}, P.extractive_generator)
    assert ab.count() == 4
    same = P.contrast(ab.filter("template = 'b'"), ab.filter("template = 'a'"))
    assert same.filter("query_id = 1").first()["with_cites"]
