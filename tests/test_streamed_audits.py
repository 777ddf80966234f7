"""Streamed answers with their sources: late, repeated, unfinished and failed requests; the audit equals the batch form."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import citations as C
from quarry.plans import answers as A
from quarry.streaming import answers as SA
from quarry.streaming import usage as SU

EVENTS = "request_id long, seq int, event string, payload string"


def events_of(request, answer, sources, end="done"):
    parts = answer.split(" ")
    listed = json.dumps([{"rank": i + 1, "marker": f"[{i + 1}]", "filename": f"f{i}", "id": i, "text": t} for i, t in enumerate(sources)])
    out = [(request, 0, "sources", listed)] + [(request, i + 1, "token", ("" if i == 0 else " ") + p) for i, p in enumerate(parts)]
    return out + ([(request, len(parts) + 1, end, "")] if end else [])


ANSWERS = {
    1: ("Entities report within 6 hours. [1]", ["Entities report within 6 hours of noticing."]),
    2: ("Banks keep gold bars at home daily. [1] Nothing else. [7]", ["Deposits are insured up to a limit."]),
    3: ("There is insufficient information.", []),
    4: ("No marker at all here.", ["x"]),
    5: ("", ["x"]),
}


def run(spark, tmp_path, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        SA.audited_answers(stream, str(tmp_path / "out"), timeout_ms=0).awaitTermination()
    return {r["answer_id"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "out/audits")).collect()}


@pytest.fixture
def batch_form(spark):
    rows = [(i, a) for i, (a, _) in ANSWERS.items()]
    reg = [(i, f"[{k + 1}]", k + 1, f"f{k}", k, t) for i, (_, ts) in ANSWERS.items() for k, t in enumerate(ts)]
    answers = spark.createDataFrame(rows, "answer_id long, answer string")
    registry = spark.createDataFrame(reg, "answer_id long, marker string, rank int, filename string, id long, text string")
    return {r["answer_id"]: r.asDict() for r in C.audit(answers, C.verify(C.resolve(C.extract_claims(answers), registry))).collect()}


def test_late_repeated_and_unfinished(spark, tmp_path, batch_form):
    every = {i: events_of(i, *x) for i, x in ANSWERS.items()}
    first = every[1] + every[1][:3] + every[2][:4] + every[3][::-1] + every[5] + events_of(8, "never ends", ["x"], end=None) + events_of(9, "goes wrong", ["x"], end="error")
    second = every[2][4:][::-1] + every[2][:2] + every[1] + every[4][1:] + events_of(10, "no sources yet", ["x"])[1:]  # repeated events of a finished answer; sources come last
    third = every[4][:1] + every[3]
    got = run(spark, tmp_path, first, second, third)
    assert set(got) == {1, 2, 3, 4, 5, 9} and got[9]["status"] == "ERROR" and got[9]["citations"] is None and got[9]["is_fallback"] is None
    for i, want in batch_form.items():
        assert {k: got[i][k] for k in want} == want and got[i]["status"] == "COMPLETE"
    assert (got[1]["verdict"], got[2]["has_fabricated"], got[2]["verdict"]) == ("PASS", True, "REJECTED")
    assert {i: got[i]["is_fallback"] for i in ANSWERS} == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert spark.read.parquet(str(tmp_path / "out/audits")).count() == 6  # each once


def test_timeouts_emit_open_answers_once():
    class State:
        hasTimedOut, exists, kept, waits = False, False, None, None

        def update(self, value):
            self.kept, self.exists = value, True

        def remove(self):
            self.kept, self.exists = None, False

        def setTimeoutDuration(self, ms):
            self.waits = ms

        get = property(lambda self: self.kept)

    import pandas as pd

    frame = lambda rows: iter([pd.DataFrame(rows, columns=["request_id", "seq", "event", "payload"])])
    state = State()
    assert list(SA._cited_step((1,), frame(events_of(1, "a b", ["x"], end=None)), state, 50)) == [] and state.waits == 50
    state.hasTimedOut = True
    (out,) = SA._cited_step((1,), frame([]), state, 50)
    assert out.iloc[0][["answer", "status", "tokens"]].tolist() == ["a b", "OPEN", 2] and not state.exists
    state.hasTimedOut = False
    assert len(list(SA._cited_step((1,), frame(events_of(1, "a b", ["x"])), state, 50))) == 1
    assert list(SA._cited_step((1,), frame(events_of(1, "a b", ["x"])), state, 50)) == []
    state.hasTimedOut = True
    assert list(SA._cited_step((1,), frame([]), state, 50)) == [] and not state.exists


def test_equal_to_the_batch_audit_on_all_documents(spark):
    d = "/root/testdata/sf0.001"
    streamed = {r["answer_id"]: r for r in A.stream_citation_audit(spark, d).collect()}
    batch = {r["answer_id"]: r.asDict() for r in A.citation_audit(spark, d).collect()}
    assert set(streamed) == set(batch) and all({k: streamed[i][k] for k in b} == b for i, b in batch.items())


def test_longest_spans(spark):
    words = "one two three four five six seven eight nine ten"
    rows = [(1, words, f"zero {words} eleven", "one two three four five six seven eight", 8, 1), (2, "a b c x d e f g", "d e f g a b c", "d e f g", 4, 0), (3, "a b", "a b", None, None, None), (4, "p q r", "p-q r", None, None, None), (5, "x y z w x y z", "so x y z.", "x y z", 3, 1)]
    answers = spark.createDataFrame([(i, f"{c} [1]") for i, c, *_ in rows], "answer_id long, answer string")
    registry = spark.createDataFrame([(i, "[1]", 1, "f", i, t) for i, _, t, *_ in rows], "answer_id long, marker string, rank int, filename string, id long, text string")
    out = {r["answer_id"]: (r["span"], r["span_words"], r["span_at"]) for r in C.verify(C.resolve(C.extract_claims(answers), registry)).collect()}
    assert out == {i: (s, n, at) for i, _, _, s, n, at in rows}


def test_streams_of_nothing(spark, tmp_path):
    events = spark.createDataFrame([], EVENTS)
    events.write.parquet(str(tmp_path / "e"))
    folded = SU.run_to_end(SA.fold_cited(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "e")), timeout_ms=0), "append")
    assert folded.count() == 0 and SA.audit_cited(folded).count() == 0
    assert F.col("x") is not None
