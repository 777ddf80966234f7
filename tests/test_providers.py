"""Failing providers, row by row; the stage ledger; packing's parts; overlaps by borders."""

import random

from pyspark.sql import functions as F

from quarry.operators import chunking as H
from quarry.operators import context as X
from quarry.operators import conversation as V
from quarry.operators import pipeline as P
from quarry.operators import retrieval as R
from quarry.operators.ledger import StageLedger


def test_errors_by_row(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def provider(prompts, options):
        with open(seen, "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        if "poison" in prompts:
            raise RuntimeError("whole batch")
        return [ValueError("this row") if p.startswith("bad") else f"ok {p}" for p in prompts]

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "bad1", None, "b", "poison", "c", "d"])], "i int, prompt string").coalesce(1)
    out = {r["i"]: (r["answer"], r["error"]) for r in P.generate(rows, provider, batch=3, error="error").collect()}
    assert out == {0: ("ok a", None), 1: (None, "ValueError: this row"), 2: (None, None), 3: ("ok b", None), 4: (None, "RuntimeError: whole batch"), 5: (None, "RuntimeError: whole batch"), 6: (None, "RuntimeError: whole batch")}
    assert sorted(open(seen).read().split()) == sorted(["a", "bad1", "b", "poison", "c", "d"])
    few = {r["i"]: r["error"] for r in P.generate(rows.filter("i < 2"), lambda p, o: ["one"], error="error").collect()}
    assert few == dict.fromkeys((0, 1), "ValueError: 1 answers to 2 prompts")


def test_model_rerank_falls_back_by_row(spark):
    rows = [(1, "report in 6 hours", i, f"Entities report within {i} hours. " * 2, "Scope", 0.9 - 0.1 * i, i + 1) for i in range(6)]
    candidates = spark.createDataFrame(rows, "query_id int, query_text string, id int, text string, section string, score double, rank int")

    def scorer(prompts, options):
        return [TimeoutError("slow") if "within 2" in p or "within 4" in p else '{"score": 10}' if "within 5" in p else "no json" for p in prompts]

    out = {r["id"]: r for r in P.model_rerank(candidates, scorer, 6).collect()}
    cross = {r["id"]: r["rerank_score"] for r in R.rerank(candidates, 6).collect()}
    assert {i: r["scorer"] for i, r in out.items()} == {i: "fallback" if i in (2, 4) else "model" for i in range(6)}
    assert all(abs(out[i]["rerank_score"] - cross[i]) < 1e-12 and out[i]["scorer_error"] == "TimeoutError: slow" for i in (2, 4))
    assert out[5]["rerank_score"] == 1.0 and out[5]["final_rank"] == 1 and out[5]["status"] == "PROMOTED" and out[0]["rerank_score"] == 0.5


def test_model_rewrite_falls_back_by_row(spark):
    turns = spark.createDataFrame([(c, t, "user", x) for c in range(4) for t, x in ((0, "What are the reporting rules for banks?"), (2, "What about those penalties?"), (4, "Define liquidity coverage in full detail for readers"))], "conv_id int, turn int, role string, text string")

    def rewriter(prompts, options):
        out = []
        for k, _ in enumerate(prompts):
            out.append([ConnectionError("x"), 'Question: "What are the penalties for late reporting?"', "short", None][k % 4])
        return out

    plain = {(r["conv_id"], r["turn"]): r["rewritten"] for r in V.rewrite(turns).collect()}
    rows = P.model_rewrite(turns.coalesce(1), rewriter).collect()
    methods = {m: [r for r in rows if r["method"] == m] for m in ("unchanged", "model", "heuristic")}
    asked = [r for r in rows if r["is_follow_up"]]
    assert len(asked) >= 4 and len(methods["model"]) == len(asked) // 4 and all(r["rewritten"] == "What are the penalties for late reporting?" for r in methods["model"])
    assert all(r["rewritten"] == plain[r["conv_id"], r["turn"]] for r in methods["heuristic"] + methods["unchanged"]) and sum(r["error"] is not None for r in rows) == len(asked) // 4
    forced = P.model_rewrite(turns, lambda p, o: ["a long enough reply"] * len(p), force=True).collect()
    assert sum(r["method"] == "model" for r in forced) == 8 and all(r["method"] == "unchanged" for r in forced if r["turn"] == 0)


def test_stage_ledger(spark):
    ledger = StageLedger()
    rows = ledger.stage("load", spark.createDataFrame([(1, 5), (2, None)], "id int, tokens int"), "tokens")
    assert ledger.stage("drop", rows.filter("id > 9"), "tokens").count() == 0
    ledger.stage("bare", rows)
    out = [tuple(r) for r in ledger.rows(spark).orderBy("position").collect()]
    assert [r[1:4] for r in out] == [("load", 2, 5), ("drop", 0, 0), ("bare", 2, 0)] and all(r[4] > 0 for r in out) and abs(sum(r[5] for r in out) - 100) < 0.1


def test_packing_parts(spark):
    texts = [(1, 1, 10, "w " * 60), (1, 2, 11, "x " * 300), (1, 3, 12, "y " * 300), (1, 4, 13, "z"), (2, 1, 20, None), (2, 2, 21, "")]
    hits = spark.createDataFrame(texts, "query_id int, rank int, id int, text string")
    parts = {(r["query_id"], r["rank"]): r for r in X.pack_parts(hits, 200).collect()}
    assert [parts[1, k]["status"] for k in (1, 2, 3, 4)] == ["included", "cut", "dropped", "included"] and len(parts) == 6
    assert parts[1, 2]["text"] == " ".join(["x"] * 61) and parts[1, 3]["text"] == "" and parts[1, 1]["text"] == "w " * 60
    packed = {r["query_id"]: r for r in X.pack_greedy(hits, 200).collect()}
    for q in (1, 2):
        own = [parts[k] for k in sorted(parts) if k[0] == q]
        assert packed[q]["used"] == own[-1]["used"] == sum(p["tokens"] for p in own) and packed[q]["dropped"] == sum(p["status"] == "dropped" for p in own)
        assert [(p["id"], p["tokens"], p["truncated"]) for p in packed[q]["packed"]] == [(p["id"], p["tokens"], p["status"] == "cut") for p in own if p["status"] != "dropped"]


def test_borders():
    rng = random.Random(6)
    for _ in range(500):
        head, tail = ([rng.choice("ab") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        want = max((k for k in range(1, min(len(head), len(tail)) + 1) if head[:k] == tail[-k:]), default=0)
        assert H.longest_border(head, tail) == want


def test_overlaps_of_texts(spark):
    rows = [("d", 0, "c0", "one two three four"), ("d", 1, "c1", "three four five sixth"), ("d", 2, "c2", "th seven"), ("d", 3, "c3", None), ("d", 4, "c4", "x")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_id string, content string")
    out = [(r["chunk_a"], r["shared"], r["shared_text"], r["is_overlapping"]) for r in H.overlaps(chunks, 3).orderBy("chunk_a").collect()]
    assert out == [("c0", 2, "three four", True), ("c1", 1, "th", True), ("c2", 0, "", False), ("c3", 0, "", False)]
    placed = chunks.withColumns({"token_start": F.col("chunk_index") * 3, "token_end": F.col("chunk_index") * 3 + 5})
    assert [r["shared"] for r in H.overlaps(placed, 3).orderBy("chunk_a").collect()] == [2, 1, 2, 2]


def test_tokenizers(spark):
    from quarry.session import ship_package

    class Letters:
        def encode_batch(self, texts):
            return [[ord(c) for c in t] for t in texts]

        def decode(self, ids):
            return "".join(map(chr, ids))

    docs = spark.createDataFrame([(1, "abcdefghij"), (2, None), (3, "xy"), (4, ""), (5, "abcdef")], "doc_id int, text string")
    out = sorted((r["doc_id"], r["chunk_index"], r["total_chunks"], r["token_start"], r["token_end"], r["content"]) for r in H.chunk_tokens(docs, Letters(), 6, 2).collect())
    assert out == [(1, 0, 2, 0, 6, "abcdef"), (1, 1, 2, 4, 10, "efghij"), (3, 0, 1, 0, 2, "xy"), (5, 0, 1, 0, 6, "abcdef")]
    assert {r["doc_id"]: r["token_count"] for r in H.count_tokens(docs, Letters()).collect()} == {1: 10, 2: 0, 3: 2, 4: 0, 5: 6}
    import public_tokenizers

    ship_package(spark)
    real = H.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "The liquidity coverage ratio of banks. " * 40
    chunks = H.chunk_tokens(spark.createDataFrame([(1, text)], "doc_id int, text string"), real, 50, 0).orderBy("chunk_index").collect()
    assert "".join(r["content"] for r in chunks) == text and all(r["token_count"] == 50 for r in chunks[:-1]) and len(chunks) > 3


def test_audit_sources(spark):
    from quarry.operators import usage as U

    rows = [(" q one ", "a" * 200 + " ", None, None, False, [("[9]", "doc", 0.123456), None, (None, None, None)]), (None, None, 4, 5, True, None)]
    requests = spark.createDataFrame(rows, "question string, answer string, prompt_tokens int, completion_tokens int, cache_hit boolean, sources array<struct<marker:string,source_document:string,similarity_score:double>>")
    a, b = sorted(U.audit_records(requests, question_col="question", sources_col="sources").collect(), key=lambda r: r["cache_hit"])
    assert (a["question"], a["prompt_tokens"], a["completion_tokens"], a["total_tokens"]) == ("q one", 2, 1, 3) and a["answer_preview"] == "a" * 140 + "..."
    assert [tuple(s) for s in a["sources"]] == [("[9]", "doc", "N/A", "General", 1, 0.1235), ("[3]", "Unknown", "N/A", "General", 1, 0.0)]
    assert b["sources"] == [] and (b["total_tokens"], b["estimated_cost_usd"]) == (9, 0.0) and b["cost_saved_usd"] > 0


def test_before_after(spark):
    from quarry.operators.cleaning import before_after

    rows = spark.createDataFrame([("  a b\n\nc  ", "a b\nc"), (None, None), ("x" * 300, "x")], "text string, cleaned_text string")
    a, b, c = before_after(rows).collect()
    assert (a["raw_chars"], a["cleaned_chars"], a["raw_words"], a["raw_lines"], a["cleaned_lines"], a["raw_sample"], a["chars_removed"], a["reduction_pct"]) == (10, 5, 3, 3, 2, "a b\n\nc", 5, 50.0)
    assert (b["raw_lines"], b["raw_sample"], b["reduction_pct"]) == (1, "", 0.0) and len(c["raw_sample"]) == 250


def test_strict_loads_and_path_order(spark, tmp_path):
    import pytest

    from quarry.sources import files as S

    for name, text in {"b.txt": "x", "A.md": "# T\nbody", "c.exe": "x", "e.txt": "", "w.txt": " ", "bad.pdf": "no"}.items():
        (tmp_path / name).write_text(text)
    folder = str(tmp_path)
    assert S.load_file(spark, f"{folder}/b.txt").first()["text"] == "x"
    for name, error in {"none.txt": FileNotFoundError, "c.exe": NotImplementedError, "e.txt": ValueError, "w.txt": ValueError, "bad.pdf": ValueError, "": IsADirectoryError}.items():
        with pytest.raises(error):
            S.load_file(spark, f"{folder}/{name}")
    ordered = S.in_path_order(S.scan_folder(spark, folder).select("path")).orderBy("position").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in ordered] == ["A.md", "b.txt", "bad.pdf", "c.exe", "e.txt", "w.txt"] and [r["position"] for r in ordered] == list(range(6))


def test_embedded_corpus(spark, tmp_path):
    import pytest

    from quarry.sources import tables as S

    schema = "id string, embedding array<double>, document_id string, file_type string"
    rows = spark.createDataFrame([("a", [1.0, 2.0], "d1", ".txt"), ("b", [0.0, 1.0], "d2", ".pdf")], schema)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_embedded_corpus(spark, str(tmp_path / "c"), schema)
    summary = S.write_embedded_corpus(rows, str(tmp_path / "c"), "m").first()
    assert (summary["records"], summary["smallest"], summary["documents"], summary["file_types"], summary["status"], summary["embedding_model"]) == (2, 2, 2, ".pdf,.txt", "PASS", "m")
    assert sorted(map(tuple, S.read_embedded_corpus(spark, str(tmp_path / "c"), schema).collect())) == sorted(map(tuple, rows.collect()))
    S.write_run({"chunks": rows, "empty": rows.limit(0)}, str(tmp_path / "run"))
    S.write_run({"chunks": rows.limit(1)}, str(tmp_path / "run"))
    assert spark.read.schema(schema).json(str(tmp_path / "run/chunks")).count() == 1
