"""Tokens of an answer travel as runs; the folds are those of single tokens, for any order, repeated numbers and nulls."""

import random

from pyspark.sql import functions as F

from quarry.session import fresh_folder
from quarry.streaming import answers as SA
from quarry.streaming import usage as SU


def test_events_of_an_answer_stand_together(spark):
    answers = spark.createDataFrame([(1, "a b  c"), (2, ""), (3, None)], "request_id long, answer string").coalesce(1)
    rows = [tuple(r) for r in SA.replay(answers).collect()]
    assert rows == [
        (1, 0, "sources", ""), (1, 1, "token", "a"), (1, 2, "token", " b"), (1, 3, "token", " "), (1, 4, "token", " c"), (1, 5, "done", ""),
        (2, 0, "sources", ""), (2, 1, "token", ""), (2, 2, "done", ""), (3, 0, "sources", ""), (3, 1, "done", ""),
    ]
    assert [(r["request_id"], r["seq"], r["event"], r["payload"], r["sizes"]) for r in SA.runs_of(SA.replay(answers)).filter("event = 'token'").collect()] == [(1, 1, "token", "a b  c", [1, 2, 1, 2]), (2, 1, "token", "", [0])]


def test_folds_of_runs(spark):
    rng, rows = random.Random(9), []
    for request in range(40):
        tokens = [(i + 1, rng.choice(["", "x", " é😀", "yz"])) for i in range(rng.randrange(0, 30))]
        if request % 4 == 0:
            rng.shuffle(tokens)
        if request % 8 == 1 and tokens:  # repeated numbers
            tokens += [(a, p + "!") for a, p in rng.sample(tokens, min(3, len(tokens)))]
        rows += [(request, a, "token", p) for a, p in tokens] + ([(request, len(tokens) + 1, "done", "")] if request % 5 else [])
    events = spark.createDataFrame(rows, "request_id long, seq int, event string, payload string")
    want = {}
    for request in {r[0] for r in rows}:
        own = sorted((a, p) for q, a, e, p in rows if q == request and e == "token")
        want[request] = ("".join(p for _, p in own), len(own), "COMPLETE" if request % 5 else "OPEN")
    for dealt in (events.coalesce(1), events.repartition(5)):
        assert {r["request_id"]: tuple(r)[1:] for r in SA.fold(dealt).collect()} == want
    folder = fresh_folder(spark, "runs")
    events.repartition(20).write.parquet(folder)
    got = SU.run_to_end(SA.fold_stream(SU.read_events(spark, folder), timeout_ms=0), "append").filter(F.col("request_id") % 8 != 1)
    assert {r["request_id"]: tuple(r)[1:] for r in got.collect()} == {q: v for q, v in want.items() if v[2] == "COMPLETE" and q % 8 != 1}
