"""Registered queries over whole small tables, against plain Python models."""

import hashlib
import json
import math
import random
import re

import pytest

from quarry.functions import lexical as L
from quarry.operators import conversation as V
from quarry.operators import retrieval as R
from quarry.plans import answers, retrieval, texts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """130 vectors of 3 labels and as many documents; every twentieth asks."""
    rng, d = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(130)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    docs = [(i, f"w{i} and more", "en", f"s{i % 40}", 12) for i in range(130)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    stored = {r["vec_id"]: (r["embedding"], r["label"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    return d, stored


def ranking(stored, q):
    """(id, score) of all but the query, best first."""
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return sorted(((i, cosine(stored[q][0], v)) for i, (v, _) in stored.items() if i != q), key=lambda x: (-x[1], x[0]))


def test_every_twentieth_vector_asks_all_others(spark, tables):
    d, stored = tables
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.topk_cosine(spark, d).collect()}
    assert got == {(q, k + 1): i for q in range(0, 130, 20) for k, (i, _) in enumerate(ranking(stored, q)[:5])}


def test_truth_is_every_other_row_of_the_label(spark, tables):
    d, stored = tables
    for r in retrieval.truth(spark, d).collect():
        want = [i for i, (_, label) in stored.items() if label == stored[r["query_id"]][1] and i != r["query_id"]]
        assert r["wanted"] == len(want)
    for r in retrieval.relevance_verdicts(spark, d).collect():
        q, i = r["query_id"], r["id"]
        same = [j for j, (_, label) in stored.items() if label == stored[q][1] and j != q]
        want = "relevant" if i in same else "peripheral" if i % 40 in {j % 40 for j in same} else "irrelevant"
        assert r["verdict"] == want


def test_margins_read_the_whole_ranking(spark, tables):
    d, stored = tables
    got = {r["query_id"]: (r["best_rank"], r["margin"]) for r in retrieval.sanity_margin(spark, d).collect()}
    for q in range(0, 130, 20):
        rows = [(k + 1, stored[i][1], s) for k, (i, s) in enumerate(ranking(stored, q))]
        own = stored[q][1]
        good = [(k, s) for k, label, s in rows if label == own]
        bad = [s for _, label, s in rows if label == (own + 1) % 10] or [rows[-1][2]]
        assert got[q][0] == good[0][0] and abs(got[q][1] - (good[0][1] - max(bad))) < 1e-4


def test_matrix_has_all_pairs_above_the_bound(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 4)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(11)], "id long, vec array<double>")
    got = [(r["a"], r["b"]) for r in R.similarity_matrix(df).collect()]
    assert sorted(got) == [(a, b) for a in range(11) for b in range(11)]


def test_matrix_query_takes_all_vectors(spark, tables):
    got = {(r["a"], r["b"]) for r in retrieval.similarity_matrix(spark, tables[0]).collect()}
    assert got == {(a, b) for a in range(130) for b in range(130)}


def test_keyword_scores_of_every_document(spark, tables):
    got = {(r["query_id"], r["id"]): (r["matched"], r["score"]) for r in texts.keyword_score(spark, tables[0]).collect()}
    assert set(got) == {(q, i) for q in range(0, 130, 20) for i in range(130)}
    for (q, i), (matched, score) in got.items():  # terms "wN" and "more", each once; a prefix such as w1 in w129 counts as contained
        terms = [t for t in (f"w{q}", "more") if t in f"w{i} and more"]
        want = 0.5 * len(terms) / 2 + 0.3 * len(terms) / 2.2 / 2 + (0.08 if f"w{q} and more" in f"w{i} and more" else 0)
        assert matched == len(terms) and abs(score - want) < 1e-5


@pytest.mark.parametrize("fold", [answers.token_fold, answers.stream_token_fold])
def test_folds_replay_every_document(spark, tables, fold):
    got = {r["request_id"]: (r["digest"], r["tokens"], r["status"]) for r in fold(spark, tables[0]).collect()}
    assert got == {i: (hashlib.md5(f"w{i} and more".encode()).hexdigest(), 3, "COMPLETE") for i in range(130)}


TEXTS = [
    (0, "Größe über alles, sagt it und Straße 12 heute noch einmal so", "de"), (1, 'Él dijo "sí" en c:\\x y luego nada más que eso hoy', "es"),
    (2, "one two three four five six seven eight nine ten", "en"), (3, "kurz", None), (4, "12 insufficient kyc words stand in here as a text", "en"),
]


@pytest.fixture(scope="module")
def languages(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("languages"))
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in TEXTS], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    turns = [(1, 0, "user", "Größe"), (1, 1, "user", "what about Köln"), (1, 2, "user", "naïveit héit"), (1, 3, "user", "it är ok")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_text_queries_take_every_language(spark, languages):
    for q in (texts.tokenize_terms, texts.statutory_entities, answers.correctness, answers.cache_key):
        assert q(spark, languages).count() == len(TEXTS), q.__name__
    for q in (answers.citation_extract, answers.citation_audit, answers.source_accuracy, answers.grounding):
        assert {r["answer_id"] for r in q(spark, languages).collect()} == set(range(len(TEXTS))), q.__name__
    assert answers.answer_verdicts(spark, languages).first()["cases"] == len(TEXTS)
    got = {r["doc_id"]: (r["tokens"], r["digest"]) for r in texts.tokenize_terms(spark, languages).collect()}
    for i, t, _ in TEXTS:
        terms = [x for x in (m.strip(".,;:!?()[]{}'\"") for m in re.findall(r"[a-z0-9_\-.%]+", t.lower())) if x]
        assert got[i] == (len(terms), hashlib.md5(" ".join(terms).encode()).hexdigest())
    keys = {r["doc_id"]: r["key"] for r in answers.cache_key(spark, languages).collect()}
    for i, t, _ in TEXTS:
        body = {"q": re.sub(r"\s+", " ", t.replace('"', "").strip()).lower(), "k": 3, "m": "gpt-x", "f": ""}
        assert keys[i] == hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:24]


def test_turns_of_every_alphabet(spark, languages):
    cue = lambda t: bool(set(re.findall(r"\b[a-z0-9_\-]+\b", t.lower())) & set(V.CUE_WORDS)) or any(p in t.lower() for p in V.CUE_PHRASES)
    said = ["Größe", "what about Köln", "naïveit héit", "it är ok"]
    assert {r["turn"]: r["cues"] for r in answers.followup_cues(spark, languages).collect()} == {k: cue(t) for k, t in enumerate(said)}
    got = {r["turn"]: r["digest"] for r in answers.rewritten_queries(spark, languages).collect()}
    want = [f"{t} regarding {said[k - 1][:50]}" if k and cue(t) else t for k, t in enumerate(said)]
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(want)}


def test_phrases_keep_their_letters(spark):
    row = spark.createDataFrame([("Größe, über!", "die größe über alles")], "q string, t string")
    assert row.select(L.phrase_bonus(row["q"], row["t"]).alias("b")).first()["b"] == 0.4
