"""Chunk metadata, recursive chunks, collections, vectors, streams and turns against plain Python models and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import cleaning as K
from quarry.operators import chunking as H
from quarry.operators import citations as C
from quarry.operators import evaluation as E
from quarry.operators import ingest as I
from quarry.operators import metadata as M
from quarry.operators import pipeline as P
from quarry.sources import collections as L
from quarry.streaming import usage as SU


def tokens(t):
    n = len(t.split())
    return max(1, int(n * 1.3)) if n else 0


def pieces(text, most, seps):
    if tokens(text) <= most or not seps:
        return [text]
    if seps[0] == "":
        return list(text)
    out = []
    for p in (x.strip() for x in text.split(seps[0])):
        if p:
            out += pieces(p, most, seps[1:]) if tokens(p) > most else [p]
    return out


def merged(parts, most, overlap):
    done, cur, n = [], [], 0
    for p in parts:
        if cur and n + tokens(p) > most:
            done.append("\n\n".join(cur).strip())
            kept, m = [], 0
            for x in reversed(cur):
                if m + tokens(x) > overlap:
                    break
                kept.insert(0, x)
                m += tokens(x)
            cur, n = [*kept, p], m + tokens(p)
        else:
            cur.append(p)
            n += tokens(p)
    last = "\n\n".join(cur).strip()
    return done + [last] if cur and last else done


def test_recursive_chunks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    texts = ["", None, "  ", "one", "a\tb\tc\td\te\tf\tg\th\ti\tj\tk\tl\tm\tn\to\tp"]
    texts += ["".join(word() + rng.choice([" ", " ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(rng.randrange(1, 150))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in H.chunk_recursive(df, 12, 5).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    want = {i: merged(pieces(t or "", 12, ["\n\n", "\n", ". ", " ", ""]), 12, 5) for i, t in enumerate(texts)}
    assert got == {i: c for i, c in want.items() if c}


def test_every_chunker_gets_uniform_metadata(spark):
    text = "Intro words here.\n\n# Scope\nThis part says a lot of things. And more things.\n\nSection 2: Terms\nTerms are many and long indeed."
    docs = spark.createDataFrame([(1, text, "x/rules.txt", [(1, 0, 40), (2, 42, 200)]), (2, None, None, [])], "doc_id int, text string, source string, b array<struct<page:int,start:int,end:int>>")
    for chunks in (H.chunk_words(docs, 6, 2), H.chunk_chars(docs, 40, 10), H.chunk_paragraphs(docs, 8), H.chunk_recursive(docs, 8, 2)):
        rows = M.with_provenance(chunks, docs, boundaries="b").collect()
        assert rows and all(r[f] is not None for r in rows for f in M.FIELDS)
        for r in rows:
            assert (r["filename"], r["document_id"], r["file_type"]) == ("rules.txt", "rules_txt", ".txt") and 0 <= r["char_start"] <= r["char_end"] <= len(text)
            assert r["page_number"] == (2 if 42 <= r["char_start"] else 1)
            assert r["section"] == ("Section 2: Terms" if r["char_start"] >= text.index("Section 2") else "Scope" if r["char_start"] >= text.index("# Scope") else H.PREAMBLE)
    extra = docs.select("doc_id", F.expr("map('page_number', '9', '_x', '1', 'note', 'n')").alias("extra"))
    assert M.chunk_metadata(extra, "extra").first()["extra"] == {"note": "n"}


def test_index_records_check_the_dimension(spark):
    rows = spark.createDataFrame([("a", "t", [1.0, 2.0])], "chunk_id string, source_text string, embedding array<double>")
    assert M.index_record(rows, 2).first()["document_id"] == "unknown_document"
    with pytest.raises(Exception, match="dimension of chunk a is not 3"):
        M.index_record(rows, 3).collect()


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", [float(i), 1.0] if i != 5 else [1.0], f"t{i}") for i in range(12)], "id string, embedding array<double>, document string")
    box = L.Collection.get_or_create(spark, str(tmp_path / "c"), 2)
    ledger = box.add(rows, batch=4).collect()
    assert sum(r["records"] for r in ledger) == 12 and sum(r["error"] is not None for r in ledger) == 1
    stored = {r["id"] for r in box.records().collect()}
    back = {r["id"]: r["verified"] for r in box.readback(rows).collect()}
    assert "c5" not in stored and back == {f"c{i}": f"c{i}" in stored for i in range(12)}
    assert L.Collection.get_or_create(spark, str(tmp_path / "c"), 2).created_at == box.created_at
    with pytest.raises(ValueError, match="dimension 2"):
        L.Collection.get_or_create(spark, str(tmp_path / "c"), 3)
    new = L.Collection.get_or_create(spark, str(tmp_path / "c"), 3, space="l2", recreate=True)
    assert (new.dimension, new.space) == (3, "l2")


def test_embedding_waits_between_attempts(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def flaky(texts):
        import time

        with open(seen, "a") as f:
            f.write(f"{time.time()}\n")
        raise TimeoutError("slow")

    rows = spark.createDataFrame([("a", "x")], "chunk_id string, content string").coalesce(1)
    out = I.embed(rows, flaky, first_wait=0.2, factor=2.0).collect()
    at = [float(x) for x in open(seen)]
    assert out[0]["error"].startswith("TimeoutError") and len(at) == 3 and at[1] - at[0] >= 0.2 and at[2] - at[1] >= 0.4


def test_running_index(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "o long")
    assert sorted((r["o"], r["n"]) for r in I.running_index(rows, [F.col("o")], "n").collect()) == [(i, i) for i in range(101)]
    assert I.running_index(rows.limit(0), [F.col("o")], "n").count() == 0


def test_upsert_stream(spark, tmp_path):
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]]):
        spark.createDataFrame(rows, "id int, t string, version int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        files = spark.readStream.schema("id int, t string, version int").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        SU.upsert_stream(files, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b).awaitTermination()
    assert sorted(tuple(r) for r in SU.latest(spark, str(tmp_path / "out")).collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert SU.latest(spark, str(tmp_path / "none")) is None


def test_turns_are_asked(spark):
    embed = I.hashing_embedder(32)
    docs = [("d1", "Reports are due within six hours of the incident"), ("d2", "Capital ratios are reviewed every year by the board")]
    corpus = spark.createDataFrame([(i, embed([t])[0], t, "f.txt", "S", 1) for i, t in docs], "id string, vec array<double>, text string, source_document string, section string, page_number int")
    turns = spark.createDataFrame([(1, 0, "user", "When are reports due within hours of the incident"), (1, 2, "user", "what about the deadline of it"), (2, 0, "user", "zzz")], "conv_id int, turn int, role string, text string")
    answers, after = P.ask_turns(turns, corpus, embed, P.extractive_generator, k=1, min_similarity=0.2)
    got = {(r["conv_id"], r["turn"]): (r["is_follow_up"], r["action"]) for r in answers.collect()}
    assert got[1, 0] == (False, "ANSWER") and got[1, 2][0] and got[2, 0] == (False, "REFUSE")
    assert {(r["conv_id"], r["turn"]) for r in after.filter("role = 'assistant'").collect()} == {(1, 1), (1, 3), (2, 1)}


def test_citation_accuracy(spark):
    answers = spark.createDataFrame([(1, "Reports are due in six hours [1]. Nothing else [2]."), (2, "There is insufficient information."), (3, "No markers at all."), (4, "Bad [7] and [7]."), (5, None)], "answer_id int, answer string")
    reg = spark.createDataFrame([(1, "[1]", "reports are due in six hours"), (1, "[2]", "unrelated"), (4, "[1]", "x")], "answer_id int, marker string, text string")
    got = {r["answer_id"]: tuple(r)[1:] for r in E.citation_accuracy(answers, reg).collect()}
    assert got == {1: (2, 0, 1, 0.5), 2: (0, 0, 0, 1.0), 3: (0, 0, 0, 0.0), 4: (2, 2, 0, 0.0), 5: (0, 0, 0, 0.0)}


def test_registries_of_all_shapes(spark):
    flat = spark.sql("SELECT 1 AS query_id, 'a' AS id, 't' AS text, 'f' AS filename, 's' AS section, 2 AS page_number, 0.5D AS score")
    mapped = spark.sql("SELECT 1 AS query_id, 'a' AS chunk_id, 't' AS document, 0.5D AS similarity_score, map('source', 'f', 'section', 's', 'page', '2') AS metadata")
    nested = spark.sql("SELECT 1 AS query_id, 'a' AS id, 't' AS verbatim_text, named_struct('filename', 'f', 'section', 's', 'page_number', 2, 'score', 0.5D) AS metadata")
    assert len({tuple(C.normalised(x).first()) for x in (flat, mapped, nested)}) == 1


def test_unwrapping_joins_hyphens(spark):
    rows = spark.createDataFrame([("first line\nsecond regu-\n lation\nthird -- \n last-",)], "t string")
    assert rows.select(K.unwrap(F.col("t"))).first()[0] == "first line second regulation third -- last-"
