"""Retrieval and evaluation queries: vectors of ids divisible by 20 ask, all but themselves answer; labels are the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import guardrail as G
from quarry.operators import ingest as I
from quarry.operators import retrieval as R
from quarry.plans.registry import query, table

ASKING = 20


def asks(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("vec_id") % ASKING == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("query_label"))


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def with_docs(hits: DataFrame, spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_document"), "n_chars")
    return hits.join(docs, "id")


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


_V = f"""
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, label AS ql FROM embeddings WHERE vec_id % {ASKING} = 0),
c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
p AS (SELECT query_id, id, label, ql, list_cosine_similarity(qv, v) AS score FROM q JOIN c ON query_id <> id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p)"""


def _top(k: int, **kw):
    return lambda spark, d: R.top_k(asks(spark, d).drop("query_label"), corpus(spark, d), k, skip_own=True, **kw)


@query(f"WITH {_V} SELECT query_id, rank, id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM r WHERE rank <= 5")
def topk_cosine(spark, d):
    hits = _top(5)(spark, d)
    return rounded(hits.select("query_id", "rank", "id", "score", (1 - F.col("score")).alias("distance")), "score", "distance")


_L2 = """1 / (1 + sqrt(list_sum(list_transform(list_zip(qv, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))"""


@query(f"""WITH {_V}, s AS (SELECT query_id, id, {_L2} AS score FROM q JOIN c ON query_id <> id),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM t WHERE rank <= 5""")
def topk_l2(spark, d):
    return rounded(_top(5, metric="l2")(spark, d).select("query_id", "rank", "id", "score"), "score")


@query(f"""WITH {_V}, s AS (SELECT query_id, id, list_inner_product(qv, v) AS score FROM q JOIN c ON query_id <> id),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM t WHERE rank <= 5""")
def topk_dot(spark, d):
    return rounded(_top(5, metric="ip")(spark, d).select("query_id", "rank", "id", "score"), "score")


@query(f"""WITH {_V}, b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INTEGER) AS br FROM p)
SELECT 'top' AS side, query_id, rank, id, round(score, 4) AS score FROM r WHERE rank <= 3
UNION ALL SELECT 'bottom', query_id, br, id, round(score, 4) FROM b WHERE br <= 3""")
def top_bottom_k(spark, d):
    best = _top(3)(spark, d).withColumn("side", F.lit("top"))
    worst = _top(3, bottom=True)(spark, d).withColumn("side", F.lit("bottom"))
    return rounded(best.unionByName(worst).select("side", "query_id", "rank", "id", "score"), "score", n=4)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE
round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) END AS similarity
FROM embeddings a, embeddings b""")
def similarity_matrix(spark, d):
    return R.similarity_matrix(corpus(spark, d).drop("label"), digits=4)


@query("""SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS smallest, CAST(max(len(embedding)) AS INTEGER) AS largest,
min(len(embedding)) = max(len(embedding)) AS uniform,
CAST(CASE WHEN min(len(embedding)) = max(len(embedding)) THEN min(len(embedding)) ELSE -1 END AS INTEGER) AS dimension FROM embeddings""")
def dimension_report(spark, d):
    return R.dimension_report(table(spark, d, "embeddings"), "embedding")


@query(f"""WITH {_V} SELECT query_id, CAST(count(*) FILTER (rank <= 2) AS INTEGER) AS common,
CAST(list_sort(list(id) FILTER (rank > 2)) AS VARCHAR) AS only_larger, round(max(score) - min(score), 6) AS score_drop FROM r WHERE rank <= 5 GROUP BY query_id""")
def k_variation(spark, d):
    out = rounded(R.k_variation(_top(5)(spark, d), 2, 5), "score_drop")
    return out.withColumn("only_larger", F.concat(F.lit("["), F.array_join(F.col("only_larger").cast("array<string>"), ", "), F.lit("]")))


@query(f"""WITH {_V}, f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS fr FROM p WHERE label IN (1, 2, 3))
SELECT query_id, fr AS rank, id, label, round(score, 6) AS score FROM f WHERE fr <= 5""")
def filtered_topk(spark, d):
    return rounded(_top(5, where=F.col("label").isin(1, 2, 3))(spark, d).select("query_id", "rank", "id", "label", "score"), "score")


@query(f"WITH {_V} SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10 AND score >= 0.25")
def threshold_gate(spark, d):
    return rounded(R.gate(_top(10)(spark, d), 0.25).select("query_id", "rank", "id", "score"), "score")


@query(f"""WITH {_V}, t AS (SELECT * FROM r WHERE rank <= 5),
f0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fr FROM p WHERE label = ql), f AS (SELECT * FROM f0 WHERE fr <= 5),
a AS (SELECT query_id, avg(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END) AS pp FROM t GROUP BY 1),
b AS (SELECT query_id, avg(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END) AS fp FROM f GROUP BY 1),
g AS (SELECT t.query_id, count(*) AS n FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.id = f.id WHERE f.id IS NULL GROUP BY 1)
SELECT a.query_id, coalesce(n, 0) AS eliminated, round(pp, 6) AS plain_precision, round(coalesce(fp, 0), 6) AS filtered_precision,
round(CASE WHEN pp = 0 THEN CASE WHEN coalesce(fp, 0) > 0 THEN 100.0 ELSE 0.0 END ELSE (coalesce(fp, 0) - pp) / pp * 100 END, 4) AS gain_pct
FROM a LEFT JOIN b USING (query_id) LEFT JOIN g USING (query_id)""")
def filtered_vs_unfiltered(spark, d):
    hits = lambda **more: R.top_k(asks(spark, d), corpus(spark, d), 5, skip_own=True, carry=("query_label",), **more)
    out = R.filter_effect(hits(), hits(match=("query_label", "label")), F.col("label") == F.col("query_label"))
    return rounded(rounded(out, "plain_precision", "filtered_precision"), "gain_pct", n=4)


@query(f"""WITH {_V}, t AS (SELECT r.*, d.source, d.n_chars FROM r JOIN documents d ON r.id = d.doc_id WHERE rank <= 5)
SELECT query_id, count(*) AS retrieved_count, round(max(score), 6) AS top_score, round(min(score), 6) AS lowest_score, round(avg(score), 6) AS mean_score,
CAST(sum(n_chars) AS BIGINT) AS total_tokens, array_to_string(list_transform(list_sort(list(struct_pack(r := first_rank, s := source)) FILTER (is_first)), lambda x: x.s), ',') AS sources
FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS first_rank, rank = min(rank) OVER (PARTITION BY query_id, source) AS is_first FROM t) GROUP BY query_id""")
def run_stats(spark, d):
    hits = with_docs(_top(5)(spark, d), spark, d)
    out = R.run_statistics(hits, token_col="n_chars")
    return rounded(out, "top_score", "lowest_score", "mean_score").withColumn("sources", F.array_join("sources", ","))


_GUARD = """g AS (SELECT query_id, count(*) AS found, max(score) AS top, count(*) FILTER (score >= 0.3) AS good, avg(score) FILTER (score >= 0.3) AS mean FROM r WHERE rank <= 5 GROUP BY 1),
s AS (SELECT *, CASE WHEN top < 0.3 THEN 'LOW_SIMILARITY_SCORE' WHEN good < 2 THEN 'TOO_FEW_RELEVANT_CHUNKS' ELSE 'SUFFICIENT_CONTEXT' END AS status FROM g)"""


def _assessed(spark, d):
    return G.assess(asks(spark, d), _top(5)(spark, d), min_similarity=0.3, min_top=0.2, min_chunks=2)


@query(f"""WITH {_V}, {_GUARD} SELECT query_id, status, round(top, 6) AS top_score, found AS chunks_found,
CASE WHEN status = 'LOW_SIMILARITY_SCORE' THEN 0 ELSE good END AS qualifying,
CASE WHEN status = 'SUFFICIENT_CONTEXT' THEN round(mean, 6) ELSE 0.0 END AS mean_qualifying_score,
CASE WHEN status = 'SUFFICIENT_CONTEXT' THEN 'ANSWER' ELSE 'REFUSE' END AS action FROM s""")
def guardrail(spark, d):
    return rounded(_assessed(spark, d), "top_score", "mean_qualifying_score")


@query(f"""WITH {_V}, {_GUARD} SELECT query_id, format('Insufficient context ({{}}): top score {{:.4f}} over {{}} chunks.', status, top, found) AS refusal FROM s WHERE status <> 'SUFFICIENT_CONTEXT'""")
def refusal_text(spark, d):
    return G.refusals(_assessed(spark, d))


_TRUTH = """truth AS (SELECT q.query_id, list(id) AS relevant, count(*) AS n FROM q JOIN c x ON x.label = q.ql AND x.id <> q.query_id GROUP BY 1),
allq AS (SELECT query_id, coalesce(relevant, []) AS relevant, coalesce(n, 0) AS n FROM q LEFT JOIN truth USING (query_id)),
h AS (SELECT r.query_id, r.id, r.rank, list_contains(a.relevant, r.id) AS hit, a.n FROM r JOIN allq a USING (query_id) WHERE rank <= 10),
hu AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM h),
m AS (SELECT query_id, max(n) AS n, count(*) AS ret, min(rank) FILTER (hit) AS fh, sum(CASE WHEN hit THEN upto / rank ELSE 0 END) AS gain,
 count(*) FILTER (hit AND rank <= 1) AS h1, count(*) FILTER (hit AND rank <= 3) AS h3, count(*) FILTER (hit AND rank <= 5) AS h5 FROM hu GROUP BY 1),
mm AS (SELECT query_id, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, h1 / n) END AS recall_1, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, h3 / n) END AS recall_3,
 CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, h5 / n) END AS recall_5, CASE WHEN n = 0 THEN 0.0 ELSE h1 / least(1, ret) END AS precision_1,
 CASE WHEN n = 0 THEN 0.0 ELSE h3 / least(3, ret) END AS precision_3, CASE WHEN n = 0 THEN 0.0 ELSE h5 / least(5, ret) END AS precision_5,
 coalesce(1 / fh, 0.0) AS reciprocal_rank, CASE WHEN n = 0 THEN 1.0 ELSE gain / n END AS average_precision FROM m)"""
_M = [*(f"recall_{k}" for k in (1, 3, 5)), *(f"precision_{k}" for k in (1, 3, 5)), "reciprocal_rank", "average_precision"]


def truth(spark, d) -> DataFrame:
    """Per query: how many other vectors have its label (these are wanted), and its type."""
    counts = table(spark, d, "embeddings").groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("wanted"))
    kind = F.when(F.col("query_id") % 3 == 1, "colloquial_phrasing").when(F.col("query_id") % 3 == 2, "cross_domain_ambiguity").otherwise("direct")
    return asks(spark, d).join(counts, "query_label", "left").select("query_id", "query_label", F.coalesce("wanted", F.lit(0).cast("long")).alias("wanted"), kind.alias("query_type"))


def flagged(hits: DataFrame, spark, d) -> DataFrame:
    """Ranked rows with `hit`: the row has its query's label. Queries without rows stay, with nulls."""
    rows = truth(spark, d).join(hits, "query_id", "left")
    return rows.withColumn("hit", F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)))


def acceptable(rows: DataFrame, spark, d) -> DataFrame:
    """Rows with `own_source`: the row's source is one of a document, not the query's, whose vector has the query's label."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    named = corpus(spark, d).select("id", F.col("label").alias("query_label")).join(docs, "id")
    found = named.groupBy("query_label", F.col("source").alias("source_document")).agg(F.count("*").alias("named"))
    own = docs.select(F.col("id").alias("query_id"), F.col("source").alias("query_source"))
    rows = rows.join(found, ["query_label", "source_document"], "left").join(own, "query_id", "left")
    others = F.col("named") - F.coalesce((F.col("query_source") == F.col("source_document")).cast("int"), F.lit(0))
    return rows.withColumn("own_source", F.coalesce(others > 0, F.lit(False))).drop("named", "query_source")


def _metrics(spark, d) -> DataFrame:
    return E.metrics_of_hits(flagged(_top(10)(spark, d), spark, d))


@query(f"WITH {_V}, {_TRUTH} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _M)} FROM mm")
def recall_precision_at_k(spark, d):
    return rounded(_metrics(spark, d), *_M)


@query(f"WITH {_V}, {_TRUTH} SELECT count(*) AS queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _M)} FROM mm")
def mrr_map(spark, d):
    return rounded(E.macro_means(_metrics(spark, d)), *_M)


_SRC = """src AS (SELECT q.query_id, list(DISTINCT d.source) AS sources FROM q JOIN c x ON x.label = q.ql AND x.id <> q.query_id JOIN documents d ON d.doc_id = x.id GROUP BY 1),
v AS (SELECT r.query_id, r.rank, r.id, CASE WHEN list_contains(a.relevant, r.id) THEN 'relevant' WHEN list_contains(coalesce(s.sources, []), d.source) THEN 'peripheral' ELSE 'irrelevant' END AS verdict
 FROM r JOIN allq a USING (query_id) LEFT JOIN src s USING (query_id) JOIN documents d ON d.doc_id = r.id WHERE rank <= 5)"""


def _judged(spark, d):
    rows = acceptable(flagged(with_docs(_top(5)(spark, d), spark, d), spark, d).filter("id IS NOT NULL"), spark, d)
    return rows.select("query_id", "rank", "id", E.verdict_of(F.col("hit"), F.col("own_source")).alias("verdict"))


@query(f"WITH {_V}, {_TRUTH}, {_SRC} SELECT * FROM v")
def relevance_verdicts(spark, d):
    return _judged(spark, d)


@query(f"""WITH {_V}, {_TRUTH}, {_SRC}, t AS (SELECT query_id, count(*) FILTER (verdict = 'relevant') AS good, count(*) FILTER (verdict = 'irrelevant') AS bad FROM v WHERE rank <= 3 GROUP BY 1),
f AS (SELECT a.query_id, CASE WHEN a.n = 0 THEN 'OUT_OF_CORPUS' WHEN coalesce(good, 0) = 0 THEN CASE a.query_id % 3 WHEN 1 THEN 'VOCABULARY_MISMATCH' WHEN 2 THEN 'AMBIGUOUS_QUERY' ELSE 'RANKING_MISS' END
 WHEN coalesce(bad, 0) >= 2 AND precision_3 < 0.34 THEN 'DILUTION' ELSE 'NONE' END AS failure FROM allq a LEFT JOIN t USING (query_id) LEFT JOIN mm USING (query_id))
SELECT query_id, failure, failure <> 'NONE' AS is_failure FROM f""")
def failure_taxonomy(spark, d):
    return E.failure_taxonomy(truth(spark, d), _judged(spark, d), _metrics(spark, d))


_CONFIGS = [(1, 2, 0.0, False), (2, 5, 0.0, False), (3, 5, 0.3, False), (4, 3, 0.0, True), (5, 3, 0.3, True)]
_GRID = f"""cfg(config_id, k, th, flt) AS (VALUES {', '.join(f'({a}, {b}, {c}, {str(e).lower()})' for a, b, c, e in _CONFIGS)}),
x AS (SELECT p.query_id, p.id, p.score, p.label, p.ql, d.source FROM p JOIN documents d ON d.doc_id = p.id),
z AS (SELECT false AS flt, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM x
 UNION ALL SELECT true, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM x WHERE label = ql),
y AS (SELECT cfg.config_id, z.query_id, z.rn, z.score, z.score >= th AS alive,
 z.score >= th AND (list_contains(a.relevant, z.id) OR list_contains(coalesce(s.sources, []), z.source)) AS good
 FROM cfg JOIN z ON z.flt = cfg.flt AND z.rn <= cfg.k JOIN allq a USING (query_id) LEFT JOIN src s USING (query_id)),
e AS (SELECT config_id, query_id, count(*) FILTER (alive) AS survivors, count(*) FILTER (NOT alive) AS noise, count(*) FILTER (good) AS g, min(rn) FILTER (good) AS f, sum(CASE WHEN alive THEN score ELSE 0 END) AS ss FROM y GROUP BY 1, 2),
grid AS (SELECT cfg.config_id, q.query_id, coalesce(survivors, 0) AS survivors, coalesce(noise, 0) AS noise_dropped, CASE WHEN coalesce(g, 0) > 0 THEN 1 ELSE 0 END AS hit,
 CASE WHEN f = 1 THEN 1 ELSE 0 END AS top1, coalesce(1 / f, 0.0) AS rr, CASE WHEN coalesce(survivors, 0) > 0 THEN g / survivors ELSE 0.0 END AS "precision", coalesce(ss, 0) AS ss
 FROM cfg CROSS JOIN q LEFT JOIN e USING (config_id, query_id)),
summ AS (SELECT config_id, avg(hit) AS hit_rate, avg(top1) AS top1_rate, avg(rr) AS mrr, avg("precision") AS "precision", CAST(sum(noise_dropped) AS BIGINT) AS noise_dropped,
 CASE WHEN sum(survivors) > 0 THEN sum(ss) / sum(survivors) ELSE 0.0 END AS mean_score FROM grid GROUP BY 1),
su AS (SELECT *, 0.35 * mrr + 0.30 * top1_rate + 0.25 * "precision" + 0.10 * hit_rate AS utility FROM summ)"""


def _grid(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_document"))
    there = corpus(spark, d).join(docs.select("id"), "id", "left_semi")
    ranking = lambda k, filtered: R.top_k(asks(spark, d), there, k, skip_own=True, carry=("query_label",), match=("query_label", "label") if filtered else None)
    configs = spark.createDataFrame(_CONFIGS, "config_id int, k int, score_threshold double, apply_filter boolean")
    deep = E.tuning_candidates(configs, ranking)
    deep = acceptable(deep.join(docs, "id"), spark, d)
    good = F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)) | F.col("own_source")
    return E.tuning_grid(configs, asks(spark, d).select("query_id"), deep.withColumn("good", good))


@query(f"""WITH {_V}, {_TRUTH}, {_SRC}, {_GRID} SELECT config_id, query_id, survivors, noise_dropped, hit, top1, round(rr, 6) AS rr, round("precision", 6) AS "precision" FROM grid""")
def tuning_grid(spark, d):
    return rounded(_grid(spark, d).drop("score_sum"), "rr", "precision")


_S = ["hit_rate", "top1_rate", "mrr", "precision", "mean_score", "utility"]


@query(f"""WITH {_V}, {_TRUTH}, {_SRC}, {_GRID} SELECT config_id, noise_dropped, {', '.join(f'round("{c}", 6) AS "{c}"' for c in _S)} FROM su""")
def tuning_summary(spark, d):
    return rounded(E.tuning_summary(_grid(spark, d)), *_S)


@query(f"""WITH {_V}, {_TRUTH}, {_SRC}, {_GRID} SELECT config_id, round(utility, 6) AS utility FROM su ORDER BY round(utility, 9) DESC, config_id LIMIT 1""")
def best_config(spark, d):
    return rounded(E.best_config(E.tuning_summary(_grid(spark, d))).select("config_id", "utility"), "utility")


@query(f"""WITH {_V}, w AS (SELECT query_id, min(rank) FILTER (label = ql) AS best_rank, max(score) FILTER (label = ql) AS gs, coalesce(max(score) FILTER (label = (ql + 1) % 10), min(score)) AS bs FROM r GROUP BY 1)
SELECT query_id, CAST(best_rank AS INTEGER) AS best_rank, round(gs - bs, 4) AS margin, coalesce(gs > bs AND best_rank <= 3, false) AS passes FROM w""")
def sanity_margin(spark, d):
    queries = asks(spark, d).select("query_id", "query_vec", F.col("query_label").alias("wanted"), ((F.col("query_label") + 1) % 10).alias("unwanted"))
    return E.margins_by_label(queries, corpus(spark, d))


@query("""WITH n AS (SELECT vec_id AS id, label, 1 AS version FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, label + 100, 2 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label + 200, 3 FROM embeddings WHERE vec_id % 9 = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM n) SELECT id, label, version FROM x WHERE r = 1""")
def upsert_latest(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    old = e.filter("id % 2 = 0").withColumn("version", F.lit(1))
    new = e.filter("id % 3 = 0").withColumns({"label": F.col("label") + 100, "version": F.lit(2)})
    newer = e.filter("id % 9 = 0").withColumns({"label": F.col("label") + 200, "version": F.lit(3)})
    return I.upsert(old, new.unionByName(newer))


@query("SELECT (SELECT count(*) FROM embeddings) AS stored, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AS confirmed")
def count_confirmation(spark, d):
    return I.count_confirmation(table(spark, d, "embeddings"), table(spark, d, "documents"))


@query("""WITH s AS (SELECT vec_id AS id, label, label AS doc, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
k AS (SELECT * FROM s WHERE f = 1 OR i IN (0, n // 2, n - 1)), t AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN label + 1 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0)
SELECT k.id, t.id IS NOT NULL AS found, CASE WHEN t.label IS DISTINCT FROM k.label THEN 'label' ELSE '' END AS mismatches FROM k LEFT JOIN t USING (id)""")
def spot_check(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("label").alias("doc"))
    stored = e.filter("id % 7 <> 0").withColumn("label", F.when(F.col("id") % 5 == 0, F.col("label") + 1).otherwise(F.col("label")))
    out = I.spot_check(e, stored, "id", "doc", "id", ["label"])
    return out.withColumn("mismatches", F.array_join("mismatches", ","))
