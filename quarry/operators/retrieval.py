"""Exact retrieval: top-k by a similarity, filters, gates, run statistics, hybrid scores and re-ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.functions.lexical import keyword_parts
from quarry.functions.rerank import cross_parts
from quarry.operators.ranking import all_pairs as similarity_matrix  # noqa: F401
from quarry.operators.ranking import best_rows

BROADCAST_QUERIES = 4096  #: queries that are broadcast at a time


def pair_with_corpus(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each query beside each corpus row. Queries are broadcast in blocks of BROADCAST_QUERIES, so that what is broadcast has a bound."""
    out, corpus = None, once_a_row(corpus)
    for block in blocks_of(queries, "query_id"):
        part = corpus.crossJoin(F.broadcast(block))
        out = part if out is None else out.unionByName(part)
    return out


def once_a_row(rows: DataFrame) -> DataFrame:
    """The same rows, with their columns computed here: Spark would else compute a derived column of the streamed side anew for every pair of a nested loop join."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def blocks_of(rows: DataFrame, key: str) -> list[DataFrame]:
    """All rows in blocks of about BROADCAST_QUERIES, by hash of the key."""
    blocks = math.ceil(rows.count() / BROADCAST_QUERIES) or 1
    return [rows] if blocks == 1 else [rows.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]


def scored_pairs(queries: DataFrame, corpus: DataFrame, metric: str = "cosine", skip_own: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score) of all pairs. cosine: clipped cosine; l2: 1 / (1 + distance); ip: inner product.

    queries has query_id and query_vec, corpus has id and vec; corpus columns other than vec stay. Vectors that are null or hold nulls have no score and no row.
    skip_own leaves out the corpus row whose id is the query's. Columns of queries that are named in `carry` stay, too.
    """
    q = queries.select("query_id", *carry, V.doubles("query_vec").alias("query_vec")).withColumn("query_norm", V.norm(F.col("query_vec")))
    c = corpus.withColumn("vec", V.doubles("vec")).withColumn("vec_norm", V.norm(F.col("vec")))
    pairs = pair_with_corpus(q, c)
    if skip_own:
        pairs = pairs.filter(F.col("query_id") != F.col("id"))
    a, b = F.col("query_vec"), F.col("vec")
    score = {
        "cosine": V.cosine(a, b, F.col("query_norm"), F.col("vec_norm")),
        "l2": 1 / (1 + V.euclidean(a, b)),
        "ip": V.dot(a, b),
    }[metric]
    return pairs.withColumn("score", score).filter("score IS NOT NULL").drop("query_vec", "query_norm", "vec", "vec_norm")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 3, where: Column | None = None, metric: str = "cosine", skip_own: bool = False, **more) -> DataFrame:
    """The k best rows of each query (best_rows); `where` is applied before ranking, so it reaches the scan. An empty corpus gives no rows."""
    return best_rows(queries, corpus if where is None else corpus.filter(where), k, metric, skip_own, **more)


def gate(hits: DataFrame, min_score: float) -> DataFrame:
    """Rows of at least min_score, after the top-k."""
    return hits.filter(F.col("score") >= min_score)


def run_statistics(hits: DataFrame, source: str = "source_document", token_col: str = "token_count") -> DataFrame:
    """Per query: rows, top, lowest and mean score, tokens, and sources in order of their first rank."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", source))), lambda s: s[source])
    return hits.groupBy("query_id").agg(
        F.count("*").alias("retrieved_count"),
        F.max("score").alias("top_score"),
        F.min("score").alias("lowest_score"),
        F.avg("score").alias("mean_score"),
        F.sum(token_col).alias("total_tokens"),
        F.array_distinct(in_order).alias("sources"),
    )


def k_variation(hits: DataFrame, low: int, high: int) -> DataFrame:
    """One ranking read at two depths: common ids, ids of the deeper one alone, and the score drop between them."""
    ids = lambda k: F.array_sort(F.collect_set(F.when(F.col("rank") <= k, F.col("id"))))
    out = hits.filter(F.col("rank") <= high).groupBy("query_id").agg(
        ids(low).alias("low_ids"), ids(high).alias("high_ids"), F.max("score").alias("top"), F.min("score").alias("lowest")
    )
    return out.select(
        "query_id",
        F.size(F.array_intersect("low_ids", "high_ids")).alias("common"),
        F.array_except("high_ids", "low_ids").alias("only_larger"),
        (F.col("top") - F.col("lowest")).alias("score_drop"),
    )


def filter_effect(plain: DataFrame, filtered: DataFrame, relevant: Column) -> DataFrame:
    """Per query: ids that a filter eliminated, precision with and without it, and the gain in % (100 where precision was 0)."""
    share = F.avg(F.when(relevant, 1.0).otherwise(0.0))
    gone = plain.join(filtered.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("eliminated"))
    a = plain.groupBy("query_id").agg(share.alias("plain_precision"))
    b = filtered.groupBy("query_id").agg(share.alias("filtered_precision"))
    gain = (F.col("filtered_precision") - F.col("plain_precision")) / F.col("plain_precision") * 100
    return (
        a.join(b, "query_id", "left").join(gone, "query_id", "left")
        .select("query_id", F.coalesce("eliminated", F.lit(0).cast("long")).alias("eliminated"), "plain_precision",
                F.coalesce("filtered_precision", F.lit(0.0)).alias("filtered_precision"))
        .withColumn("gain_pct", F.when(F.col("plain_precision") == 0, F.when(F.col("filtered_precision") > 0, 100.0).otherwise(0.0)).otherwise(gain))
    )


def precision_cases(cases: dict[str, tuple[DataFrame, DataFrame]], relevant: Column) -> DataFrame:
    """A row a case: how a filter or a hybrid score changes what is retrieved. cases: name -> (plain rows, changed rows), each with query_id and id; `relevant` says of a row whether it is wanted.

    Mean precision over the queries of the plain ranking without and with the change (0 for a query that is left without rows), the gain in % (100 from nothing to something), and the rows that only the change has brought.
    """
    out = None
    share = F.avg(F.when(F.coalesce(relevant, F.lit(False)), 1.0).otherwise(0.0))
    for name, (plain, changed) in cases.items():
        both = plain.groupBy("query_id").agg(share.alias("a")).join(changed.groupBy("query_id").agg(share.alias("b")), "query_id", "left")
        means = both.agg(F.count("*").alias("queries"), F.avg("a").alias("plain_precision"), F.avg(F.coalesce("b", F.lit(0.0))).alias("changed_precision"))
        new = changed.join(plain.select("query_id", "id"), ["query_id", "id"], "left_anti").agg(F.count("*").alias("new_rows"))
        row = means.crossJoin(F.broadcast(new)).withColumn("case", F.lit(name))  # one row a side
        out = row if out is None else out.unionByName(row)
    gain = (F.col("changed_precision") - F.col("plain_precision")) / F.col("plain_precision") * 100
    nothing = F.when(F.col("changed_precision") > 0, 100.0).otherwise(0.0)
    return out.select("case", "queries", "plain_precision", "changed_precision", F.when(F.col("plain_precision") == 0, nothing).otherwise(gain).alias("gain_pct"), "new_rows")


def hybrid(candidates: DataFrame, k: int = 3, alpha: float = 0.7, pool_factor: int = 3, pool_most: int = 15) -> DataFrame:
    """Mix dense and keyword scores over the best min(k * pool_factor, pool_most) dense rows of each query.

    candidates: query_id, query_text, id, text, score and rank of the dense ranking. Ties go to the better dense rank.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is between 0 and 1")
    pool = candidates.filter(F.col("rank") <= min(k * pool_factor, pool_most))
    scored = pool.withColumn("keyword", keyword_parts(F.col("query_text"), F.col("text"))).withColumns(
        {"dense_score": F.greatest(F.lit(0.0), F.col("score")), "dense_rank": F.col("rank")}
    )
    mixed = scored.withColumn("keyword_score", F.col("keyword.score")).withColumn("matched", F.col("keyword.matched"))
    mixed = mixed.withColumn("hybrid_score", alpha * F.col("dense_score") + (1 - alpha) * F.col("keyword_score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "dense_rank")
    return mixed.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("keyword", "score")


def rank_movement(dense: DataFrame, mixed: DataFrame, k: int) -> DataFrame:
    """Old and new rank of each mixed row; promoted where it has risen or wasn't among the k dense rows."""
    old = dense.filter(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("old_rank"))
    out = mixed.select("query_id", "id", F.col("rank").alias("new_rank")).join(old, ["query_id", "id"], "left")
    return out.withColumn("promoted", F.coalesce(F.col("old_rank") > F.col("new_rank"), F.lit(True)))


def rerank(candidates: DataFrame, k: int = 3) -> DataFrame:
    """Re-rank candidates (query_id, query_text, id, text, section, score, rank) by the cross score, then the vector score.

    rank_delta is the initial minus the final rank; status PROMOTED, DEMOTED or UNCHANGED.
    """
    scored = candidates.withColumn("parts", cross_parts(F.col("query_text"), F.col("text"), F.col("section"), F.col("score")))
    return placed(scored.withColumn("rerank_score", F.col("parts.score")), k)


def placed(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by rerank_score, then the vector score, with their movement."""
    place = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "rank")
    out = scored.withColumn("final_rank", F.row_number().over(place)).withColumn("rank_delta", F.col("rank") - F.col("final_rank"))
    status = F.when(F.col("rank_delta") > 0, "PROMOTED").when(F.col("rank_delta") < 0, "DEMOTED").otherwise("UNCHANGED")
    return out.withColumn("status", status).filter(F.col("final_rank") <= k)


def dimension_report(vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Rows, smallest and largest dimension, whether they agree, and the common dimension (-1 if mixed)."""
    return vectors.agg(
        F.count("*").alias("n"), F.min(F.size(vec_col)).alias("smallest"), F.max(F.size(vec_col)).alias("largest")
    ).select("*", (F.col("smallest") == F.col("largest")).alias("uniform"),
             F.when(F.col("smallest") == F.col("largest"), F.col("smallest")).otherwise(-1).alias("dimension"))
