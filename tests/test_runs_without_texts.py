"""Vectors are ranked by themselves; texts meet the rows that were found."""

from quarry.operators import pipeline as P
from quarry.operators import retrieval as R
from quarry.operators.ledger import StageLedger


def test_ranking_carries_no_texts(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, [1.0, float(i)], f"text {i} of the corpus", "s", "1", 1) for i in range(30)], "id long, vec array<double>, text string, source_document string, section string, page_number int")
    questions = spark.createDataFrame([(i, f"what is {i}?", [1.0, float(i)]) for i in (3, 7)], "query_id long, question string, query_vec array<double>")
    seen, top_k = [], R.top_k
    monkeypatch.setattr(R, "top_k", lambda q, c, *a, **more: seen.append(sorted(c.columns)) or top_k(q, c, *a, **more))
    plain = P.answer_questions(questions, corpus, P.extractive_generator, k=2, skip_own=True).collect()
    ledger = StageLedger()
    told = P.answer_questions(questions, corpus, P.extractive_generator, k=2, skip_own=True, ledger=ledger).collect()
    assert seen == [["id", "vec"]] * 2 and sorted(plain) == sorted(told)
    assert {r["query_id"]: r["answer"][:20] for r in plain} == {3: "text 4 of the corpus", 7: "text 8 of the corpus"}
    apart = P.answer_questions(questions, corpus.select("id", "vec"), P.extractive_generator, k=2, skip_own=True, texts=corpus.drop("vec")).collect()
    assert sorted(apart) == sorted(plain)
    assert [tuple(r) for r in ledger.rows(spark).filter("position = 0").select("stage", "rows", "tokens").collect()] == [("retrieve", 4, 24)]
