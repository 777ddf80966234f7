"""Cited answers are folded by buckets: few calls of the state function, a bounded number of micro-batches, each request with a time of its own."""

from quarry.streaming import answers as SA
from quarry.streaming import usage as SU

COLUMNS = ["request_id", "seq", "event", "payload"]


class State:
    hasTimedOut, exists, kept, waits = False, False, None, None

    def update(self, value):
        self.kept, self.exists = value, True

    def remove(self):
        self.kept, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.waits = ms

    get = property(lambda self: self.kept)


def events_of(request, *words, end="done"):
    rows = [(request, 0, "sources", "[]")] + [(request, i + 1, "token", w) for i, w in enumerate(words)]
    return rows + ([(request, len(words) + 1, end, "")] if end else [])


def stepped(state, rows, timeout_ms, **kw):
    import pandas as pd

    out = list(SA._cited_step((7,), iter([pd.DataFrame(rows, columns=COLUMNS)]), state, timeout_ms, **kw))
    return sorted((r["request_id"], r["answer"], r["status"]) for f in out for _, r in f.iterrows())


def test_requests_of_a_bucket_stay_apart():
    state = State()
    first = events_of("1", "a", "b") + events_of("2", "c", "d")[:2] + events_of("3", "e", end="error") + events_of("4", "f", end=None)
    assert stepped(state, first, 0) == [("1", "ab", "COMPLETE"), ("3", "e", "ERROR")]
    assert stepped(state, events_of("2", "c", "d")[2:] + events_of("1", "a", "b"), 0) == [("2", "cd", "COMPLETE")]
    assert state.exists and state.waits is None and set(state.kept[0]) == {"1", "2", "3", "4"}


def test_each_request_has_its_own_time(monkeypatch):
    state, now = State(), [1000]
    monkeypatch.setattr(SA.time, "time_ns", lambda: now[0] * 1_000_000)
    assert stepped(state, events_of("1", "a", end=None), 50) == [] and state.waits == 50
    now[0] = 1030
    assert stepped(state, events_of("2", "b", end=None), 50) == [] and state.waits == 20
    now[0] = 1060  # a busy bucket doesn't time out, but the first request's time is over
    assert stepped(state, events_of("3", "c", end=None), 50) == [("1", "a", "OPEN")] and state.waits == 20
    state.hasTimedOut = True
    now[0] = 1070  # Spark's clock is ahead of this one
    assert stepped(state, [], 50) == [("2", "b", "OPEN")] and state.exists and state.waits > 0
    now[0] = 1200
    assert stepped(state, [], 50) == [("3", "c", "OPEN")] and not state.exists


def test_state_is_of_buckets_and_batches_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SA, "BUCKETS", 8)
    rows = [e for i in range(300) for e in events_of(i, f"w{i}", " x")] + events_of(None, "nobody")
    spark.createDataFrame(rows, "request_id long, seq int, event string, payload string").repartition(70).write.parquet(str(tmp_path / "in"))
    events = SU.read_events(spark, str(tmp_path / "in"), batches=2)
    seen = []
    query = SA.fold_cited(events, 0).writeStream.foreachBatch(lambda b, e: seen.extend((r["request_id"], r["answer"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert len(progress) == 2 and max(s.numRowsTotal for p in progress for s in p.stateOperators) <= 9  # as many states as requests before, and nine micro-batches
    assert sorted(seen, key=str) == sorted([(i, f"w{i} x") for i in range(300)] + [(None, "nobody")], key=str)


def test_sources_meet_an_answer_once(spark):
    answers = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "request_id long, answer string")
    registry = spark.createDataFrame([(1, 1, "[1]", "f", 5, "the text")], "request_id long, rank int, marker string, filename string, id long, text string")
    out = SA.replay_cited(answers, registry)
    got = sorted(tuple(r) for r in out.collect())
    listed = '[{"rank":1,"marker":"[1]","filename":"f","id":5,"text":"the text"}]'
    assert got == [
        (1, 0, "sources", listed), (1, 1, "token", "a"), (1, 2, "token", " b"), (1, 3, "done", ""), (2, 0, "sources", "[]"), (2, 1, "token", "c"), (2, 2, "done", ""), (3, 0, "sources", "[]"), (3, 1, "done", ""),
    ]
