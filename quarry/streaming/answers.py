"""Answer streams as event rows, folded by request."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import citations as C
from quarry.operators.chunking import unnested
from quarry.session import ship_package, stored

FOLDED = "request_id long, answer string, tokens int, status string"


def replay(answers: DataFrame) -> DataFrame:
    """An answer as the events of a stream: sources, its tokens (all but the first led by a blank), done. Its events stand beside each other, in order."""
    event = lambda name, payload: F.struct(F.lit(name).alias("event"), payload.alias("payload"))
    pieces = F.coalesce(F.split("answer", " "), F.array().cast("array<string>"))
    tokens = F.transform(pieces, lambda p, i: event("token", F.when(i > 0, F.concat(F.lit(" "), p)).otherwise(p)))
    events = F.concat(F.array(event("sources", F.lit(""))), tokens, F.array(event("done", F.lit(""))))
    return unnested(answers.select("request_id", events.alias("events")), "events", "seq", "e", "request_id").select("request_id", "seq", "e.event", "e.payload")


RUNS = "request_id {}, seq int, event string, payload string, sizes array<int>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring tokens of a request whose numbers follow each other as one row: the first one's number, their texts put together, and the characters of each."""
    for batch in batches:
        rows = batch.num_rows
        ids, seq = batch.column("request_id"), pc.fill_null(batch.column("seq"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        token = pc.fill_null(pc.equal(batch.column("event"), "token"), False).to_numpy(zero_copy_only=False) & batch.column("payload").is_valid().to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, max(0, rows - 1))), False).to_numpy(zero_copy_only=False)
        follows = np.concatenate([[False], same & token[1:] & token[:-1] & (seq[1:] == seq[:-1] + 1)]) if rows else np.zeros(0, bool)
        first = np.flatnonzero(~follows)
        ends = pa.array(np.append(first, rows).astype(np.int32))
        payload = batch.column("payload")
        text = pc.binary_join(pa.ListArray.from_arrays(ends, pc.fill_null(payload, "")), "")
        sizes = pa.ListArray.from_arrays(ends, pc.fill_null(pc.utf8_length(payload), 0))
        at = pa.array(first)
        alone = pa.array(token[first])
        yield pa.RecordBatch.from_arrays(
            [ids.take(at), batch.column("seq").take(at), batch.column("event").take(at), pc.if_else(alone, text, payload.take(at)), pc.if_else(alone, sizes, pa.scalar(None, sizes.type))], ["request_id", "seq", "event", "payload", "sizes"]
        )


def runs_of(events: DataFrame) -> DataFrame:
    """Events (request_id, seq, event, payload) with runs of tokens put together where they stand in order, before anything is shuffled; `sizes` cuts a run into its tokens again."""
    ship_package(events.sparkSession)
    kind = events.schema["request_id"].dataType.simpleString()
    return events.select("request_id", F.col("seq").cast("int").alias("seq"), "event", "payload").mapInArrow(_runs, RUNS.format(kind))


def fold(events: DataFrame) -> DataFrame:
    """Batch form: each request's answer from its tokens in order, and COMPLETE, ERROR or OPEN.

    Runs of tokens are shuffled, not tokens; runs of a request that overlap (repeated numbers) are cut into tokens and ordered one by one.
    """
    token = F.col("event") == "token"
    parts = F.array_sort(F.collect_list(F.when(token, F.struct("seq", "payload", "sizes"))))
    has = lambda e: F.max((F.col("event") == e).cast("int")) == 1
    status = F.when(has("error"), "ERROR").when(has("done"), "COMPLETE").otherwise("OPEN")
    per = runs_of(events).groupBy("request_id").agg(parts.alias("parts"), F.sum(F.when(token, F.coalesce(F.size("sizes"), F.lit(1))).otherwise(0)).cast("int").alias("tokens"), status.alias("status"))
    overlap = F.exists(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get("parts", i)["seq"] < F.get("parts", i - 1)["seq"] + F.size(F.get("parts", i - 1)["sizes"]))

    def tokens_of(run):
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<seq:int,payload:string>>").alias("found"))

        def add(acc, n):
            piece = F.struct((run["seq"] + F.size(acc["found"])).alias("seq"), F.substring(run["payload"], acc["at"], n).alias("payload"))
            return F.struct((acc["at"] + n).alias("at"), F.array_append(acc["found"], piece).alias("found"))

        whole = F.array(F.struct(run["seq"].alias("seq"), run["payload"].alias("payload")))
        return F.when(run["sizes"].isNull(), whole).otherwise(F.aggregate(run["sizes"], start, add, lambda acc: acc["found"]))

    pieces = F.when(F.coalesce(overlap, F.lit(False)), F.array_sort(F.flatten(F.transform("parts", tokens_of)))["payload"]).otherwise(F.col("parts")["payload"])
    return per.select("request_id", F.array_join(pieces, "").alias("answer"), "tokens", "status")


def _joined(runs: list[tuple[int, str, list[int]]]) -> tuple[str, int]:
    """The text and the number of a request's tokens; runs that overlap are cut into tokens and ordered one by one."""
    runs.sort(key=lambda r: r[:2])
    if all(a + len(n) <= b for (a, _, n), (b, _, _) in itertools.pairwise(runs)):
        return "".join(p for _, p, _ in runs), sum(len(n) for _, _, n in runs)
    tokens = sorted((a + i, p[e - n[i] : e]) for a, p, n in runs for i, e in enumerate(itertools.accumulate(n)))
    return "".join(p for _, p in tokens), len(tokens)


def _step(key, frames: Iterator[pd.DataFrame], state, timeout_ms: int) -> Iterator[pd.DataFrame]:
    seqs, payloads, sizes, end = ([], [], [], 0) if not state.exists else (*map(list, state.get[:3]), state.get[3])
    if timeout_ms and state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], *_joined(list(zip(seqs, payloads, sizes, strict=True))), "OPEN")], columns=["request_id", "answer", "tokens", "status"])
        return
    status = ""
    for f in frames:
        for s, e, p, n in zip(f["seq"], f["event"], f["payload"], f["sizes"], strict=True):
            if e == "token":
                seqs.append(int(s))
                payloads.append(p or "")
                sizes.append([0] if n is None else [int(x) for x in n])
            elif e in ("done", "error"):
                end, status = int(s), "COMPLETE" if e == "done" else "ERROR"
    if end and (status == "ERROR" or sum(map(len, sizes)) >= end - 1):
        if state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *_joined(list(zip(seqs, payloads, sizes, strict=True))), status or "COMPLETE")], columns=["request_id", "answer", "tokens", "status"])
    else:
        state.update((seqs, payloads, sizes, end))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)


def fold_stream(events: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """Streaming form: runs of tokens are put together first; state is keyed by request and dropped when its answer is complete, or after ten minutes without an event.

    With a timeout the query goes on as long as there may be state; 0 is for inputs that end, run with availableNow.
    """

    def step(key, frames, state):
        return _step(key, frames, state, timeout_ms)

    kind = "ProcessingTimeTimeout" if timeout_ms else "NoTimeout"
    return runs_of(events).groupBy("request_id").applyInPandasWithState(step, FOLDED, "seqs array<int>, payloads array<string>, sizes array<array<int>>, finish int", "append", kind)


CITED = "request_id string, answer string, tokens int, status string, sources string"
SOURCES = "array<struct<rank:int,marker:string,filename:string,id:long,text:string>>"
BUCKETS = 4096  #: of requests; a bucket's open requests are one state, since a call of the state function costs milliseconds
HELD = "requests array<string>, seqs array<array<int>>, payloads array<array<string>>, finish array<int>, sources array<string>, emitted array<boolean>, until array<long>"


def replay_cited(answers: DataFrame, registry: DataFrame) -> DataFrame:
    """Answers (request_id, answer) as events whose first one, `sources`, carries the registry (request_id, rank, marker, filename, id, text) as JSON."""
    own = registry.groupBy("request_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "marker", "filename", "id", "text")))).alias("json"))
    events = replay(answers)
    first = answers.select("request_id").join(own, "request_id", "left")  # the JSON meets an answer once, not each of its events
    first = first.select("request_id", F.lit(0).cast(events.schema["seq"].dataType).alias("seq"), F.lit("sources").alias("event"), F.coalesce("json", F.lit("[]")).alias("payload"))
    return events.filter("event <> 'sources'").unionByName(first)


@dataclass
class _Held:
    """What has come of a request. `until`: when it leaves without another event, in milliseconds; `emitted`: its answer is out."""

    parts: dict[int, str] = field(default_factory=dict)
    end: int = 0
    sources: str = ""
    emitted: bool = False
    until: int = 0

    def row(self, request, status: str) -> tuple:
        return request, "".join(self.parts[s] for s in sorted(self.parts)).strip(), len(self.parts), status, self.sources


def _cited_step(key, frames: Iterator[pd.DataFrame], state, timeout_ms: int) -> Iterator[pd.DataFrame]:
    """Steps a bucket of requests forward; answers leave once they are whole or failed, and unfinished ones when their time is over."""
    held = {r: _Held(dict(zip(s, p, strict=True)), *rest) for r, s, p, *rest in zip(*state.get, strict=True)} if state.exists else {}
    now, out, touched, failed = time.time_ns() // 1_000_000, [], set(), set()
    if state.hasTimedOut:  # the first of them is due, whatever this clock says
        now = max([now, *([min(h.until for h in held.values())] if held else [])])
    for f in frames:
        for r, s, e, p in zip(f["request_id"], f["seq"], f["event"], f["payload"], strict=True):
            h = held.get(r)
            if h is None:
                h = held[r] = _Held()
            if h.emitted:  # a repeated or late event of an answer that is out
                continue
            touched.add(r)
            if e == "token":
                h.parts[int(s)] = p or ""
            elif e == "sources":
                h.sources = p
            elif e in ("done", "error"):
                h.end = int(s)
                if e == "error":
                    failed.add(r)
    for r in touched:
        h = held[r]
        if r in failed or (h.end > 0 and len(h.parts) >= h.end - 1 and h.sources != ""):
            out.append(h.row(r, "ERROR" if r in failed else "COMPLETE"))
            held[r] = h = _Held(end=h.end, emitted=True)
        h.until = now + timeout_ms
    for r in [r for r, h in held.items() if timeout_ms and h.until <= now]:
        if not (h := held.pop(r)).emitted:
            out.append(h.row(r, "OPEN"))
    if held:
        state.update(([*held], [list(h.parts) for h in held.values()], [list(h.parts.values()) for h in held.values()], *([getattr(h, c) for h in held.values()] for c in ("end", "sources", "emitted", "until"))))
        if timeout_ms:
            state.setTimeoutDuration(max(1, min(h.until for h in held.values()) - now))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CITED.split(", ")])


def fold_cited(events: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """Streaming form of cited answers: state holds the sources beside the tokens, and an answer leaves once `done` has come and nothing before it is missing.

    Events may come late, in any order and more than once: they count by their number, and what comes after the answer has left is passed over until the state expires. With a timeout an answer that
    stays unfinished leaves as OPEN; 0 is for inputs that end, run with availableNow, where unfinished answers stay in the state. State is keyed by buckets of requests, each request with a time of its own.
    """

    def step(key, frames, state):
        return _cited_step(key, frames, state, timeout_ms)

    kind = "ProcessingTimeTimeout" if timeout_ms else "NoTimeout"
    rows = events.select(F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).alias("bucket"), F.col("request_id").cast("string").alias("request_id"), "seq", "event", "payload")
    folded = rows.groupBy("bucket").applyInPandasWithState(step, CITED, HELD, "append", kind)
    return folded.withColumn("request_id", F.col("request_id").cast("long"))


def audit_cited(folded: DataFrame) -> DataFrame:
    """The citation audit of folded answers against the sources that came with them: audit's columns, status, and whether markers are fabricated and the answer is a fallback.

    An answer is a fallback without sources, or if it refuses and cites nothing. Answers that are open or ended in an error aren't audited: their counts are null.
    """
    answers = folded.withColumnRenamed("request_id", "answer_id")
    done = answers.filter("status = 'COMPLETE'")
    listed = F.from_json("sources", SOURCES)
    registry = done.select("answer_id", F.explode(listed).alias("s")).select("answer_id", "s.*")
    audited = C.audit(done, C.verify(C.resolve(C.extract_claims(done), registry)))
    fallback = (F.coalesce(F.size(listed), F.lit(0)) <= 0) | (C.is_refusal(F.col("answer")) & (F.col("citations") == 0))
    return answers.join(audited, "answer_id", "left").select(
        "answer_id", "status", "tokens", "citations", "verified", "fabricated", "unsupported", "citation_precision", "verdict", (F.col("fabricated") > 0).alias("has_fabricated"), F.when(F.col("status") == "COMPLETE", fallback).alias("is_fallback")
    )


def audited_answers(events: DataFrame, folder: str, timeout_ms: int = 600_000) -> StreamingQuery:
    """Fold a stream of answer events and audit each micro-batch's finished answers; a batch writes its own folder under `folder`/audits, so that one that runs again replaces it."""

    def write(batch: DataFrame, epoch: int) -> None:
        folded = stored(batch, "cited-batch")  # the audit reads it more than once; the state is stepped forward once
        audit_cited(folded).write.mode("overwrite").parquet(f"{folder}/audits/batch={epoch}")

    writer = fold_cited(events, timeout_ms).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer if timeout_ms else writer.trigger(availableNow=True)).start()
