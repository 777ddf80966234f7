"""Column functions and operators against plain Python models."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import cleaning as C
from quarry.functions import lexical as L
from quarry.functions import rerank as K
from quarry.functions import vectors as V
from quarry.operators import chunking as H
from quarry.operators import citations as CI
from quarry.operators import context as P
from quarry.operators import evaluation as E
from quarry.operators import guardrail as G
from quarry.operators import ingest as I
from quarry.operators import retrieval as R
from quarry.operators import usage as U
from quarry.sources import files as S

few = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_cosine_limits(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0, 1.0], [-2.0, -2.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    df = spark.createDataFrame([(a, b, c) for a, b, c in pairs], "a array<double>, b array<double>, c double")
    for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("s"), V.euclidean(F.col("a"), F.col("b")).alias("d"), "a", "b", "c").collect():
        assert r["s"] == pytest.approx(r["c"]) and r["d"] == pytest.approx(math.dist(r["a"], r["b"]))


def test_null_vectors_and_texts_have_no_score(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vec array<double>")
    c = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [0.5, 0.5]), (4, [0.0, 0.0])], "id int, vec array<double>")
    assert [(r["id"], round(r["score"], 6)) for r in R.top_k(q, c, 5).orderBy("rank").collect()] == [(3, 0.707107), (4, 0.0)]
    assert R.top_k(q, c.limit(0), 5).count() == 0
    df = spark.createDataFrame([("a b", None)], "q string, t string")
    assert df.select(L.keyword_parts(F.col("q"), F.col("t")).alias("k")).first()["k"]["score"] == 0.0


def test_cleaning_cases(spark):
    cases = {
        "Page 1 of 5\nkeep this\n- 2 -\nPAGE 3/5\n--- Page 4 ---\nDO NOT DISTRIBUTE\nHome > a > b\nkeep too": "keep this keep too",
        "regu-\nlatory trans-\n action": "regulatory transaction",
        "“quoted” — ﬁne…​x": '"quoted" - fine...x',
        "- one\n- two\n| a | b |": "- one\n- two\n| a | b |",
        "a  b\t\tc  \n\n\n\n\nd": "a b c\n\nd",
        "a\r\nb": "a b",
        "": "",
    }
    assert column(spark, list(cases), C.clean) == list(cases.values())
    assert column(spark, [None], C.clean) == [None]


def test_tokens_and_salient_terms(spark):
    texts = ["What is the 6-hour limit, 95% (v.1)?", "the of and", "", "A-b_c. x"]
    model = lambda t: [w for w in (x.strip(".,;:!?()[]{}'\"") for x in re.findall(r"[a-z0-9_\-.%]+", t.lower())) if w]
    assert column(spark, texts, L.tokens) == [model(t) for t in texts]
    assert column(spark, texts, L.salient_terms)[:2] == [["6-hour", "limit", "95%", "v.1"], ["the", "of", "and"]]


def test_keyword_score(spark):
    df = spark.createDataFrame([("kyc audit rule", "The KYC audit rule applies; kyc again.")], "q string, t string")
    r = df.select(L.keyword_parts(F.col("q"), F.col("t")).alias("k")).first()["k"]
    tf = (2 / 3.2 + 1 / 2.2 + 1 / 2.2) / 3
    assert r["score"] == pytest.approx(0.5 + 0.3 * tf + 0.2 * 0.4) and r["matched"] == ["kyc", "audit", "rule"]


def test_entities_and_operative_text_wins(spark):
    assert column(spark, ["Within 6 hours or 95% by 8:00 am, severity 2, CERT-In"], K.entities)[0] == sorted(["6 hours", "95%", "8:00 am", "severity 2", "cert-in"])
    rows = [
        (1, "report within 6 hours", 1, "Preamble. This circular is about many things in general.", "Preamble", 0.9, 1),
        (1, "report within 6 hours", 2, "Entities shall report within 6 hours of detection.", "Section 2", 0.8, 2),
    ]
    df = spark.createDataFrame(rows, "query_id int, query_text string, id int, text string, section string, score double, rank int")
    out = R.rerank(df, 2).orderBy("final_rank").collect()
    assert [r["id"] for r in out] == [2, 1] and [r["status"] for r in out] == ["PROMOTED", "DEMOTED"]


@few
@given(st.integers(0, 40), st.integers(1, 9), st.integers(0, 8))
def test_word_windows(spark, n, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            H.check_window(size, overlap)
        return
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("a.txt", " ".join(words))], "doc_id string, text string")
    got = [(r["token_start"], r["token_end"], r["content"]) for r in H.chunk_words(df, size, overlap).orderBy("chunk_index").collect()]
    want, i = [], 0
    while n:
        want.append((i, min(i + size, n), " ".join(words[i : i + size])))
        if i + size >= n:
            break
        i += size - overlap
    assert got == want


def test_paragraphs_sections_pages(spark):
    text = "# Title\none two\n\nthree\n\n1.2. Scope here\nSection 4: Rules\nx"
    df = spark.createDataFrame([("d.md", text)], "doc_id string, text string")
    found = df.select(H.sections(F.col("text")).alias("s")).first()["s"]
    assert [(s["offset"], s["title"]) for s in found] == [(0, H.PREAMBLE), (0, "Title"), (text.index("1.2."), "1.2. Scope here"), (text.index("Section"), "Section 4: Rules")]
    active = df.select(H.active_section(H.sections(F.col("text")), F.lit(text.index("Scope"))).alias("a")).first()["a"]
    assert active == "1.2. Scope here"
    assert [r["content"] for r in H.chunk_paragraphs(df, most=7).orderBy("chunk_index").collect()][0].startswith("# Title")
    assert H.chunk_paragraphs(df, most=10_000).count() == 1
    pages = F.array(*(F.struct(F.lit(p).alias("page"), F.lit(a).alias("start"), F.lit(b).alias("end")) for p, a, b in ((1, 0, 10), (2, 12, 20))))
    got = [spark.range(1).select(H.page_of(F.lit(o), pages).alias("p")).first()["p"] for o in (0, 10, 11, 12, 99)]
    assert got == [1, 1, 1, 2, 2]


def greedy(tokens, words, budget):
    used, cut, dropped, packed = 0, False, 0, []
    for i, (t, n) in enumerate(zip(tokens, words, strict=True)):
        left = budget - used
        if t <= left:
            packed.append(i)
            used += t
        elif left > 60 and not cut:
            used += max(1, int(min(n, max(10, left // 2)) * 1.3))
            packed.append(i)
            cut = True
        else:
            dropped, cut = dropped + 1, True
    return used, dropped, packed


@few
@given(st.lists(st.integers(1, 150), min_size=1, max_size=6), st.integers(20, 300))
def test_greedy_packing(spark, sizes, budget):
    rows = [(1, k + 1, k, " ".join(["w"] * n)) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "query_id int, rank int, id int, text string")
    r = P.pack_greedy(df, budget).first()
    used, dropped, packed = greedy([max(1, int(n * 1.3)) for n in sizes], sizes, budget)
    assert (r["used"], r["dropped"], [x["id"] for x in r["packed"]]) == (used, dropped, packed)


def test_render_needs_all_values(spark):
    with pytest.raises(KeyError):
        P.render("{a} {b}", {"a": F.lit(1)})
    assert spark.range(1).select(P.render("x{a}y{a}", {"a": F.lit(1)}).alias("o")).first()["o"] == "x1y1"


def test_guardrail_statuses(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "query_id int")
    hits = spark.createDataFrame([(1, 0.4), (2, 0.6), (2, 0.1), (3, 0.7), (3, 0.6)], "query_id int, score double")
    got = {r["query_id"]: r["status"] for r in G.assess(q, hits, 0.5, 0.5, 2).collect()}
    assert got == {0: G.EMPTY, 1: G.LOW, 2: G.FEW, 3: G.SUFFICIENT}


def test_metrics_edges(spark):
    truth = spark.createDataFrame([(1, [10, 11]), (2, []), (3, [5])], "query_id int, relevant array<int>")
    hits = spark.createDataFrame([(1, 10, 1), (1, 9, 2), (1, 11, 3), (2, 4, 1)], "query_id int, id int, rank int")
    m = {r["query_id"]: r for r in E.retrieval_metrics(truth, hits).collect()}
    assert (m[1]["recall_1"], m[1]["recall_3"], m[1]["precision_3"], m[1]["reciprocal_rank"]) == (0.5, 1.0, pytest.approx(2 / 3), 1.0)
    assert m[1]["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert (m[2]["recall_1"], m[2]["precision_1"], m[2]["average_precision"]) == (1.0, 0.0, 1.0)
    assert (m[3]["recall_5"], m[3]["precision_5"], m[3]["reciprocal_rank"]) == (0.0, 0.0, 0.0)


def test_citation_audit(spark):
    answers = spark.createDataFrame([(1, "Entities report within 6 hours. [1] Also banks pay. [x.pdf]"), (2, "Zebras fly over mountains [1]. Bad [9]."), (3, "There is insufficient information.")], "answer_id int, answer string")
    reg = spark.createDataFrame([(a, "[1]", 1, "X.pdf", 7, "All entities report within 6 hours and banks pay fees.") for a in (1, 2, 3)], "answer_id int, marker string, rank int, filename string, id int, text string")
    claims = CI.extract_claims(answers)
    assert {(r["answer_id"], r["marker"]) for r in claims.collect()} == {(1, "[1]"), (1, "[x.pdf]"), (2, "[1]"), (2, "[9]")}
    out = {r["answer_id"]: r for r in CI.audit(answers, CI.verify(CI.resolve(claims, reg))).collect()}
    assert (out[1]["verified"], out[1]["verdict"], out[1]["citation_precision"]) == (2, "PASS", 1.0)
    assert (out[2]["fabricated"], out[2]["verdict"]) == (1, "REJECTED") and out[3]["verdict"] == "PASS"


def test_cache_key_is_that_of_sorted_json(spark):
    import hashlib
    import json

    for q in ('  What "is" IT?\n x', "grüße", "a\\b"):
        norm = re.sub(r"\s+", " ", q.strip()).lower()
        want = hashlib.sha256(json.dumps({"q": norm, "k": 3, "m": "m1", "f": "f"}, sort_keys=True).encode()).hexdigest()[:24]
        got = spark.createDataFrame([(q,)], "q string").select(U.cache_key(F.col("q"), F.lit(3), F.lit(" M1"), F.lit("f ")).alias("k")).first()["k"]
        assert got == want


def test_lru_and_ttl(spark):
    rows = [(i, k, f"2024-01-01 00:00:{i:02d}") for i, k in enumerate("abacbaac")]
    df = spark.createDataFrame(rows, "seq int, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = [r["outcome"] for r in U.simulate_lru(df, 2).orderBy("seq").collect()]
    assert got == ["MISS", "MISS", "HIT", "MISS", "MISS", "MISS", "HIT", "MISS"]
    got = [r["outcome"] for r in U.simulate_ttl(df, 3).orderBy("seq").collect()]
    assert got == ["MISS", "MISS", "HIT", "MISS", "HIT", "EXPIRED", "HIT", "EXPIRED"]


def test_ingestion_checks(spark):
    docs = spark.createDataFrame([(1,), (2,), (2,)], "d int")
    report = I.reconcile(docs, docs.filter("d = 1"), docs.filter("d = 9"), docs.filter("d = 1"), "d")
    r = report.first()
    assert (r["discovered"], r["unaccounted"], r["duplicates"], r["complete"]) == (3, 2, 1, False)
    with pytest.raises(ValueError):
        I.require_complete(report)
    with pytest.raises(ValueError):
        I.check_dimension(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2)


def test_embedding_retries(spark):
    chunks = spark.createDataFrame([(str(i), "bad" if i == 3 else f"t {i}") for i in range(6)], "chunk_id string, content string").coalesce(1)

    def provider(texts):
        if "bad" in texts:
            raise TimeoutError("slow")
        return I.hashing_embedder(8)(texts)

    out = {r["chunk_id"]: r for r in I.embed(chunks, provider, batch=2).collect()}
    assert out["2"]["error"] == out["3"]["error"] == "TimeoutError: slow" and len(out["0"]["embedding"]) == 8


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(" caf\xe9 ".encode("latin-1"))
    (tmp_path / "b.md").write_text("---\nx: 1\n---\n# T\nbody")
    (tmp_path / "c.html").write_text("<html><title>Q</title><script>x</script><p>hi</p></html>")
    (tmp_path / "d.bin").write_text("x")
    (tmp_path / "e.txt").write_text("")
    (tmp_path / "f.pdf").write_text("no pdf")
    out = {r["filename"]: r for r in S.load_documents(S.scan_folder(spark, str(tmp_path))).collect()}
    assert out["a.txt"]["text"] == "café" and (out["b.md"]["title"], out["b.md"]["text"]) == ("T", "# T\nbody")
    assert (out["c.html"]["title"], out["c.html"]["text"]) == ("Q", "hi")
    errors = {k: r["error_type"] for k, r in out.items() if r["error_type"]}
    assert errors == {"d.bin": "UNSUPPORTED_FORMAT", "e.txt": "EMPTY_FILE", "f.pdf": "CORRUPT_PDF"}


def test_plans(spark):
    """Batch top-k limits groups before the shuffle, and hot queries run no Python."""
    from quarry.plans import retrieval, texts

    plan = retrieval.topk_cosine(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for q in (retrieval.guardrail, texts.chunk_words, texts.keyword_score):
        assert "Python" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = retrieval.filtered_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "In(label" in plan or "PushedFilters: [In" in plan or "label" in plan.split("PushedFilters")[1][:200]
