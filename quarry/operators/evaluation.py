"""Retrieval and answer evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.lexical import bound
from quarry.operators.ranking import best_rows, rows_before
from quarry.session import stored

# What a refusal says.
REFUSALS = [
    "does not contain sufficient information",
    "insufficient information",
    "insufficient context",
    "not contain enough information",
    "cannot advise on this matter",
    "outside verified regulatory compliance",
    "no information",
    "not provided in the regulatory",
]
# Words that carry no evidence in an answer's sentence.
WEAK_KEYWORDS = ["based", "provided", "regulatory", "context", "according", "must", "these", "their", "under"]


def retrieval_metrics(truth: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query: recall and precision at each k, reciprocal rank and average precision.

    truth: query_id, relevant ids (array); hits: query_id, id, rank. An empty truth has recall and average precision 1 and precision 0.
    """
    rows = truth.select("query_id", "relevant", F.size("relevant").alias("wanted")).join(hits.select("query_id", "id", "rank"), "query_id", "left")
    return metrics_of_hits(rows.withColumn("hit", F.coalesce(F.array_contains("relevant", F.col("id")), F.lit(False))), ks)


def metrics_of_hits(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """retrieval_metrics of rows (query_id, wanted, id, rank, hit) that say of themselves whether they are wanted, for truths too large for arrays.

    A query without rows has one with a null id.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.col("hit").cast("int")).over(order))
    aggs = [
        F.count("id").alias("retrieved"), F.first("wanted").alias("wanted"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("hit"), F.col("upto") / F.col("rank")).otherwise(0.0)).alias("gain"),
        *(F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks),
    ]
    per = rows.groupBy("query_id").agg(*aggs)
    none = F.col("wanted") == 0
    recall = lambda k: F.when(none, 1.0).otherwise(F.least(F.lit(1.0), F.col(f"hits_{k}") / F.col("wanted")))
    precision = lambda k: F.when(none | (F.col("retrieved") == 0), 0.0).otherwise(
        F.col(f"hits_{k}") / F.least(F.lit(k).cast("long"), F.col("retrieved"))
    )
    return per.select(
        "query_id",
        *(recall(k).alias(f"recall_{k}") for k in ks),
        *(precision(k).alias(f"precision_{k}") for k in ks),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(none, 1.0).otherwise(F.col("gain") / F.col("wanted")).alias("average_precision"),
    )


def macro_means(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in names))


def verdicts(truth: DataFrame, hits: DataFrame, source_col: str = "source") -> DataFrame:
    """relevant where the id is wanted, peripheral where its source is acceptable, else irrelevant. truth has relevant and sources (arrays)."""
    rows = hits.join(truth.select("query_id", "relevant", "sources"), "query_id")
    verdict = verdict_of(F.array_contains("relevant", F.col("id")), F.array_contains("sources", F.col(source_col)))
    return rows.select("query_id", "rank", "id", verdict.alias("verdict"))


def verdict_of(wanted: Column, from_source: Column) -> Column:
    return F.when(wanted, "relevant").when(from_source, "peripheral").otherwise("irrelevant")


def failure_taxonomy(truth: DataFrame, judged: DataFrame, metrics: DataFrame) -> DataFrame:
    """OUT_OF_CORPUS without wanted ids; else what the query type says if none of the wanted is in the top 3; DILUTION with two or more
    irrelevant rows there and precision below 0.34; else NONE. truth: query_id, wanted (how many ids), query_type."""
    top = judged.filter("rank <= 3").groupBy("query_id").agg(
        F.count_if(F.col("verdict") == "relevant").alias("good"), F.count_if(F.col("verdict") == "irrelevant").alias("bad")
    )
    rows = truth.join(top, "query_id", "left").join(metrics.select("query_id", "precision_3"), "query_id", "left")
    kind = (
        F.when(F.col("wanted") == 0, "OUT_OF_CORPUS")
        .when(F.coalesce("good", F.lit(0)) == 0,
              F.when(F.col("query_type") == "colloquial_phrasing", "VOCABULARY_MISMATCH").when(F.col("query_type") == "cross_domain_ambiguity", "AMBIGUOUS_QUERY").otherwise("RANKING_MISS"))
        .when((F.coalesce("bad", F.lit(0)) >= 2) & (F.col("precision_3") < 0.34), "DILUTION")
        .otherwise("NONE")
    )
    return rows.select("query_id", kind.alias("failure"), (kind != "NONE").alias("is_failure"))


def tuning_candidates(configs: DataFrame, ranking: Callable[[int, bool], DataFrame]) -> DataFrame:
    """The rows that each configuration reads: (config_id, query_id, id, score, r, alive, and the other columns of the rankings).

    configs: config_id, k, score_threshold, apply_filter (few rows: the largest k is read first, so that no ranking is deeper). ranking(k, filtered) gives the k best rows of each
    query: ranks don't depend on the threshold and are taken once with and once without the filter.
    """
    deepest = configs.agg(F.max("k")).first()[0] or 1
    read = lambda flag: ranking(deepest, flag).withColumnRenamed("rank", "r").withColumn("filtered", F.lit(flag))
    deep = read(False).unionByName(read(True)).join(F.broadcast(configs), (F.col("filtered") == F.col("apply_filter")) & (F.col("r") <= F.col("k")))
    return deep.withColumn("alive", F.col("score") >= F.col("score_threshold")).drop("filtered", "apply_filter", "k", "score_threshold")


def tuning_grid(configs: DataFrame, queries: DataFrame, deep: DataFrame) -> DataFrame:
    """Per configuration and query: survivors of top-k and threshold, re-ranked after the gate, hit, top-1, reciprocal rank, precision, noise.

    queries: query_id; deep: rows of tuning_candidates with `good`, whether a row is wanted or from an acceptable source.
    """
    deep = deep.withColumn("good", F.col("good") & F.col("alive"))
    # The gate keeps a prefix of the ranking, so that ranks after it are the ranks before it.
    per = deep.groupBy("config_id", "query_id").agg(
        F.count_if("alive").alias("survivors"), F.count_if(~F.col("alive")).alias("noise_dropped"),
        F.count_if("good").alias("good"), F.min(F.when(F.col("good"), F.col("r"))).alias("first"),
        F.sum(F.when(F.col("alive"), F.col("score")).otherwise(0.0)).alias("score_sum"),
    )
    every = queries.select("query_id").crossJoin(F.broadcast(configs.select("config_id")))  # few configurations
    out = every.join(per, ["config_id", "query_id"], "left").na.fill(0, ["survivors", "noise_dropped", "good", "score_sum"])
    return out.select(
        "config_id", "query_id", "survivors", "noise_dropped",
        (F.col("good") > 0).cast("int").alias("hit"), F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("top1"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("survivors") > 0, F.col("good") / F.col("survivors")).otherwise(0.0).alias("precision"), "score_sum",
    )


def tuning_summary(grid: DataFrame) -> DataFrame:
    """Macro means over queries, mean score over surviving rows, and the utility by which a configuration is chosen."""
    out = grid.groupBy("config_id").agg(
        F.avg("hit").alias("hit_rate"), F.avg("top1").alias("top1_rate"), F.avg("rr").alias("mrr"), F.avg("precision").alias("precision"),
        F.sum("noise_dropped").alias("noise_dropped"),
        F.when(F.sum("survivors") > 0, F.sum("score_sum") / F.sum("survivors")).otherwise(0.0).alias("mean_score"),
    )
    return out.withColumn(
        "utility", 0.35 * F.col("mrr") + 0.30 * F.col("top1_rate") + 0.25 * F.col("precision") + 0.10 * F.col("hit_rate")
    )


def best_config(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc(F.round("utility", 9)), "config_id").limit(1)


def sanity_margins(expected: DataFrame, ranking: DataFrame) -> DataFrame:
    """Per case: best relevant rank and score, best unrelated score (the lowest row's if none is named), margin, and whether it passes.

    expected: query_id, relevant, unrelated (arrays); ranking: query_id, id, score.
    """
    return margins(ranking.join(expected, "query_id"), F.array_contains("relevant", F.col("id")), F.array_contains("unrelated", F.col("id")))


def margins(rows: DataFrame, good: Column, bad: Column) -> DataFrame:
    """sanity_margins of scored rows by what is relevant and unrelated, for truths too large for arrays.

    The best relevant row's rank is one more than the rows before it, by score and then id: two partial aggregations, no sort of the corpus.
    """
    rows = rows.withColumns({"_good": F.coalesce(good, F.lit(False)), "_bad": F.coalesce(bad, F.lit(False))})
    best = F.max(F.when(F.col("_good"), F.struct("score", (-F.col("id")).alias("low"))))
    per = rows.groupBy("query_id").agg(best.alias("best"), F.coalesce(F.max(F.when(F.col("_bad"), F.col("score"))), F.min("score")).alias("bad_score"))
    before = (F.col("score") > F.col("best.score")) | ((F.col("score") == F.col("best.score")) & (-F.col("id") > F.col("best.low")))
    rank = rows.select("query_id", "id", "score").join(per, "query_id").groupBy("query_id", "best", "bad_score").agg((F.count_if(before) + 1).cast("int").alias("rank"))
    good_score, found = F.col("best.score"), F.col("best").isNotNull()
    passes = F.coalesce((good_score > F.col("bad_score")) & (F.col("rank") <= 3), F.lit(False))
    return rank.select("query_id", F.when(found, F.col("rank")).alias("best_rank"), F.round(good_score - F.col("bad_score"), 4).alias("margin"), passes.alias("passes"))


def margins_by_label(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """margins of all cosines of queries (query_id, query_vec, wanted, unwanted) and corpus rows (id, vec, label), a query's own row left out: rows of the label `wanted` are relevant, those of `unwanted` unrelated.

    Three rankings of one row a query and a count of the rows before the best relevant one, each by blocked products: no pair leaves its task.
    """
    best = lambda **more: best_rows(queries.select("query_id", "query_vec", "wanted", "unwanted"), corpus, 1, skip_own=True, **more)
    good = stored(best(match=("wanted", "label")).select("query_id", "id", "score"), "margins")  # it is read for the count and the result
    bad = best(match=("unwanted", "label")).select("query_id", F.col("score").alias("unrelated"))
    lowest = best(bottom=True).select("query_id", F.col("score").alias("lowest"))
    before = rows_before(queries.select("query_id", "query_vec").join(good, "query_id"), corpus, skip_own=True)
    rows = lowest.join(good, "query_id", "left").join(bad, "query_id", "left").join(before, "query_id", "left")
    bad_score, rank = F.coalesce("unrelated", "lowest"), (F.col("before") + 1).cast("int")
    passes = F.coalesce((F.col("score") > bad_score) & (rank <= 3), F.lit(False))
    return rows.select("query_id", rank.alias("best_rank"), F.round(F.col("score") - bad_score, 4).alias("margin"), passes.alias("passes"))


def is_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def correctness(answer: Column, facts: Column, answerable: Column) -> Column:
    """Share of key facts in the answer, 0.85 of the score, and 0.15 unless it is too short; for unanswerable questions 1 if it refuses."""
    answer, facts = F.coalesce(answer, F.lit("")), F.coalesce(facts, F.array().cast("array<string>"))
    low = F.lower(answer)
    bare = lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", "")
    met = F.filter(facts, lambda f: F.contains(low, F.lower(f)) | F.contains(bare(low), F.trim(bare(F.lower(f)))))
    words = F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))
    short = (words < 15) & (F.size(facts) > 2)
    score = F.size(met) / F.greatest(F.lit(1), F.size(facts)) * 0.85 + F.when(short, 0.0).otherwise(0.15)
    return F.when(~answerable, F.when(is_refusal(answer), 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), score))


def grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's sentences that the context supports: by keywords and numbers, or by three words in a row. 1 for refusals, 0 without context."""
    answer, context = F.coalesce(answer, F.lit("")), F.coalesce(context, F.lit(""))
    clean = F.transform(F.split(answer, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"\[[^\]]+\]", "")))
    split = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    audited = F.transform(F.filter(clean, lambda s: F.size(split(s)) >= 4), F.lower)
    weak = F.array(*(F.lit(w) for w in WEAK_KEYWORDS))

    def supported(s: Column, corpus: Column) -> Column:
        numbers = F.regexp_extract_all(s, F.lit(r"(?U)\b\d+\s*(?:hours?|days?|business days?|years?|months?|%|percent)?\b"), F.lit(0))
        words = F.filter(F.regexp_extract_all(s, F.lit(r"(?U)\b[a-z0-9_\-]{4,}\b"), F.lit(0)), lambda w: ~F.array_contains(weak, w))
        ratio = bound(words, lambda own: F.size(F.filter(own, lambda w: F.contains(corpus, w))) / F.greatest(F.lit(1), F.size(own)))
        three = bound(split(s), lambda parts: F.exists(
            F.sequence(F.lit(1), F.size(parts) - 2), lambda i: F.contains(corpus, F.array_join(F.slice(parts, i, F.lit(3)), " "))
        ))
        return ((ratio >= 0.35) & F.forall(numbers, lambda x: F.contains(corpus, x))) | three

    # The context is put in lower case once a row and the sentences are cut once: inside a lambda both would be computed again for every word that is looked for.
    def share(said: Column) -> Column:
        score = bound(F.lower(context), lambda corpus: F.size(F.filter(said, lambda s: supported(s, corpus)))) / F.size(said)
        return F.when(F.size(said) == 0, 1.0).otherwise(score)

    return F.when(is_refusal(answer), 1.0).when(context == "", 0.0).otherwise(bound(audited, share))


def answer_verdict(correct: Column, ground: Column, citation: Column, recall: Column, answerable: Column, refused: Column) -> Column:
    """struct(overall, verdict): 0.45 correctness, 0.35 grounding, 0.20 citations, and the first rung of the ladder that applies."""
    overall = 0.45 * correct + 0.35 * ground + 0.20 * citation
    verdict = (
        F.when(~answerable & ~refused, "HALLUCINATED_ANSWER")
        .when(~answerable, "PASS")
        .when(citation < 0.5, "FABRICATED_CITATIONS")
        .when(ground < 0.6, "UNGROUNDED_SPECULATION")
        .when(recall < 0.5, "RETRIEVAL_MISS")
        .when(correct < 0.7, "FACTUAL_OMISSION")
        .when(overall >= 0.85, "PASS")
        .otherwise("MARGINAL_QUALITY")
    )
    return F.struct(overall.alias("overall"), verdict.alias("verdict"))


def answer_summary(results: DataFrame) -> DataFrame:
    """Cases, pass rate, mean scores, share of unanswerable questions that were refused (1 if there are none), and failures by verdict."""
    means = ("overall", "correctness", "grounding")
    per = results.groupBy("verdict").agg(
        F.count("*").alias("n"), F.count_if(~F.col("answerable")).alias("asked"), F.count_if(~F.col("answerable") & F.col("refused")).alias("safe"),
        *(f(c).alias(f"{c}_{name}") for c in means for name, f in (("sum", F.sum), ("rows", F.count))),
    )
    failed = F.when(F.col("verdict") != "PASS", F.struct("verdict", "n"))
    mean = lambda c: (F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_rows"), F.lit(0))).alias(c)
    # One reading of the results: a row a verdict, and all from these.
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cases"), (F.sum(F.when(F.col("verdict") == "PASS", F.col("n")).when(F.col("verdict").isNotNull(), 0)) / F.nullif(F.sum(F.when(F.col("verdict").isNotNull(), F.col("n"))), F.lit(0))).alias("pass_rate"),
        *(mean(c) for c in means), F.when(F.sum("asked") > 0, F.sum("safe") / F.sum("asked")).otherwise(1.0).alias("safe_refusals"),
        F.map_from_entries(F.array_sort(F.collect_list(failed))).alias("failures"),
    )


CITED = r"\[(\d+|[\w.\-]+\.(?:pdf|txt|md|html|json))\]"


def citation_accuracy(answers: DataFrame, registry: DataFrame) -> DataFrame:
    """Per answer: markers (repeated ones count), fabricated and supported ones, and the share of supported ones.

    A marker's claim is the first sentence that holds it. It is supported by its row's text where three words in a row of the claim stand in it (a longer run holds
    one of three), else where 0.4 of the claim's words of four characters do. Without markers the share is 1 for refusals, else 0.
    answers: answer_id, answer; registry: answer_id, marker, text.
    """
    text = F.coalesce("answer", F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)), lambda m: F.concat(F.lit("["), m, F.lit("]")))
    said = F.split(text, r"(?<=[.!?])\s+")
    claim = lambda m: F.coalesce(F.get(F.filter(said, lambda s: F.contains(s, m)), F.lit(0)), F.lit(""))
    pairs = F.transform(found, lambda m: F.struct(m.alias("marker"), claim(m).alias("claim")))
    rows = answers.select("answer_id", F.explode(pairs).alias("p")).select("answer_id", "p.marker", "p.claim")
    rows = rows.join(registry.select("answer_id", "marker", F.lower("text").alias("low"), F.lit(True).alias("known")), ["answer_id", "marker"], "left")
    clean = F.lower(F.trim(F.regexp_replace("claim", r"\[[^\]]+\]", "")))
    rows = rows.withColumn("w", F.filter(F.split(clean, r"\s+"), lambda x: x != "")).withColumn("k", F.regexp_extract_all(clean, F.lit(r"(?U)\b[a-z0-9_\-]{4,}\b"), F.lit(0)))
    run = F.exists(F.transform("w", lambda _, i: F.array_join(F.slice("w", i + 1, F.lit(3)), " ")), lambda g: (F.size(F.split(g, " ")) == 3) & F.contains(F.col("low"), g))
    share = F.size(F.filter("k", lambda x: F.contains(F.col("low"), x))) / F.greatest(F.lit(1), F.size("k"))
    rows = rows.withColumn("good", F.coalesce(F.col("known") & (F.col("low") != "") & (run | (share >= 0.40)), F.lit(False)))
    per = rows.groupBy("answer_id").agg(F.count("*").alias("markers"), F.count_if(F.col("known").isNull()).alias("fabricated"), F.count_if("good").alias("supported"))
    out = answers.select("answer_id", is_refusal(text).alias("refusal")).join(per, "answer_id", "left").na.fill(0, ["markers", "fabricated", "supported"])
    precision = F.when(F.col("markers") > 0, F.col("supported") / F.col("markers")).when(F.col("refusal"), 1.0).otherwise(0.0)
    return out.select("answer_id", "markers", "fabricated", "supported", precision.alias("citation_precision"))


def source_recall(expected: Column, retrieved: Column, refused: Column) -> Column:
    """Share of the expected sources (repeated ones count) among the retrieved ones; without expected ones 1 if nothing was retrieved or the answer refuses, else 0."""
    met = F.size(F.filter(expected, lambda s: F.array_contains(retrieved, s)))
    return F.when(F.size(expected) > 0, met / F.size(expected)).otherwise(F.when((F.size(retrieved) == 0) | refused, 1.0).otherwise(0.0))


def evaluate_cases(cases: DataFrame) -> DataFrame:
    """Whole verdicts of answered cases: correctness, grounding, citation_precision, source_recall, overall, verdict.

    cases: test_id, answer, facts (array), answerable, context (the retrieved texts), expected_sources and retrieved_sources (arrays), citation_precision.
    """
    rows = cases.withColumns(
        {
            "refused": is_refusal(F.coalesce("answer", F.lit(""))), "correctness": correctness(F.col("answer"), F.col("facts"), F.col("answerable")),
            "grounding": grounding(F.col("answer"), F.col("context")),
        }
    )
    rows = rows.withColumn("source_recall", source_recall(F.col("expected_sources"), F.col("retrieved_sources"), F.col("refused")))
    v = answer_verdict(*(F.col(c) for c in ("correctness", "grounding", "citation_precision", "source_recall", "answerable", "refused")))
    rows = rows.withColumn("v", v)
    return rows.select("test_id", "answerable", "refused", "correctness", "grounding", "citation_precision", "source_recall", "v.overall", "v.verdict")
