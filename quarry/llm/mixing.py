"""Mixing sources to temperature weights, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Workspace

BLOCKS_A_SOURCE, ROWS_A_BLOCK = 1024, 1 << 16  #: blocks at least, and about the rows of a block where there are more
PLAN_ROWS = 1 << 17  #: rows of the block plan up to which it is broadcast
NO_SOURCE = "\x00none"


def word_count(text_col: str) -> Column:
    """White-space separated words of a text; 0 without a text."""
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def weights_at(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised shares ** exponent; sources without tokens get none."""
    raw = {s: p**exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(raw[s] for s in sorted(raw))
    return {s: x / total for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for _, w in sorted(weights.items()) if w > 0)


def largest_ratio(weights: dict[str, float], shares: dict[str, float]) -> tuple[float, float]:
    """Smallest and largest weight / share."""
    ratios = [weights[s] / p for s, p in shares.items() if p > 0]
    return min(ratios), max(ratios)


def bisect_exponent(meets: Callable[[float], bool], rising: bool) -> float:
    """The end of the exponents in [0, 1] that meet a monotone condition: the smallest one if it holds from there on up (rising), else the largest."""
    low, high = 0.0, 1.0
    if meets(low if rising else high):
        return low if rising else high
    for _ in range(60):
        middle = (low + high) / 2
        if meets(middle) == rising:
            high = middle
        else:
            low = middle
    return high if rising else low


def temperature_weights(
    tokens: dict[str, int], target_entropy: float | None = None, max_repetition: float | None = None, cover: bool = False
) -> tuple[float, dict[str, float], float]:
    """(exponent, weights, epochs that the budget gives to a source whose weight is its share).

    target_entropy (a part of the logarithm of the number of sources) asks for the largest exponent with at least
    that entropy; max_repetition for the smallest with which no source is repeated more often. With both, the limit
    wins. With cover the budget is as large as needed for one whole epoch of every source, else it is the corpus.
    """
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n > 0}

    def repeats(a: float) -> float:
        low, high = largest_ratio(weights_at(shares, a), shares)
        return high / low if cover else high

    exponent = 1.0
    if target_entropy is not None:
        wanted = target_entropy * math.log(max(1, len(shares)))
        exponent = bisect_exponent(lambda a: entropy(weights_at(shares, a)) >= wanted - 1e-12, rising=False)
        if entropy(weights_at(shares, exponent)) < wanted - 1e-9:
            exponent = 0.0
    if max_repetition is not None:
        if max_repetition < 1:
            raise ValueError("max_repetition is 1 at least")
        limit = bisect_exponent(lambda a: repeats(a) <= max_repetition + 1e-12, rising=True)
        exponent = limit if target_entropy is None else max(exponent, limit)
    weights = weights_at(shares, exponent)
    return exponent, weights, 1 / largest_ratio(weights, shares)[0] if cover else 1.0


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = 4.0,
    cover: bool = False,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Repeat and thin out sources to temperature weights (see temperature_weights).

    A source's budget is the total budget times its weight: whole epochs, and a part of one more. Its texts are
    dealt to blocks by hash; every epoch is a permutation of the blocks by hash, the last one ends where its budget does, inside
    a block at the first text in hash order that doesn't fit. Blocks are as many as the rows ask for; only sums of blocks are ordered by source, and inside a cut block only hashes and counts.

    Returns all columns of `docs` but earlier ones of these names, mix_tokens, mix_epoch (from 0), mix_block, mix_place (the block's place in the epoch). A null source is a source
    of its own. Null and empty texts have no tokens and are in every whole epoch; if no text has tokens, every row comes once. Repeated rows and rows with null ids are mixed like others,
    those that fall together in a cut block by their whole row's hash. Only the number of sources is held by the driver.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    n_blocks = max(BLOCKS_A_SOURCE, math.ceil(docs.count() / ROWS_A_BLOCK))
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n_blocks)).alias("b")
    plain = docs.select(source.alias("s"), block, word_count(text_col).alias("n"))
    blocks = ws.save(plain.groupBy("s", "b").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "blocks")
    tokens = {r["s"]: r["n"] for r in blocks.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row a source
    total = sum(tokens.values())
    if total:
        _, weights, factor = temperature_weights(tokens, target_entropy, max_repetition, cover)
    else:
        weights, factor = {}, 1.0
    budget = []
    for s, n in sorted(tokens.items()):
        epochs = factor * weights[s] * total / n if n else 1.0
        whole = math.floor(epochs + 1e-9)
        budget.append((s, whole, max(0, round((epochs - whole) * n)) if n else 0))
    budgets = F.broadcast(spark.createDataFrame(budget, "s string, whole int, rest long"))
    places = Window.partitionBy("s", "epoch").orderBy(F.xxhash64("b", "epoch", F.lit(seed)), "b")
    upto = F.coalesce(F.sum("n").over(places.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = (
        blocks.join(budgets, "s")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .withColumn("place", F.row_number().over(places) - 1)
        .withColumn("room", F.when(F.col("epoch") < F.col("whole"), None).otherwise(F.col("rest") - upto))
        .filter("room IS NULL OR room > 0")
        .select("s", "b", "epoch", "place", F.when(F.col("room") >= F.col("n"), None).otherwise(F.col("room")).alias("room"))
    )
    plan = ws.save(plan, "plan")
    if plan.count() <= PLAN_ROWS:
        plan = F.broadcast(plan)
    rows = docs.select(
        *(F.col(c).alias(f"own_{k}") for k, c in enumerate(docs.columns)),
        source.alias("s"), block, word_count(text_col).alias("n"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    joined = rows.join(plan, ["s", "b"])
    own = [F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in ("mix_tokens", "mix_epoch", "mix_block", "mix_place")]
    new = [F.col("n").alias("mix_tokens"), F.col("epoch").alias("mix_epoch"), F.col("b").alias("mix_block"), F.col("place").alias("mix_place")]
    cut = plan.filter("room IS NOT NULL")
    # Rows of a cut block that are alike in hash and tokens stand for each other: so many of them fit, all but in one such group.
    near = docs.select(source.alias("s"), block, F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text")).join(cut, ["s", "b"])  # words are counted in cut blocks alone
    near = near.select("s", "b", "epoch", "room", word_count("own_text").alias("n"), F.xxhash64(F.lit(seed), "own_id", "own_text").alias("h"))
    alike = near.groupBy("s", "b", "epoch", "room", "h", "n").agg(F.count("*").alias("copies"))
    in_block = Window.partitionBy("s", "b", "epoch").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("room") - F.coalesce(F.sum(F.col("n") * F.col("copies")).over(in_block), F.lit(0))
    fits = F.when(free < 0, 0).when(F.col("n") == 0, F.col("copies")).otherwise(F.least(F.col("copies"), F.floor(free / F.col("n"))))
    fitting = ws.save(alike.withColumn("fits", fits).filter("fits > 0").select("s", "b", "epoch", "h", "n", "copies", "fits"), "fitting")
    inside = joined.filter("room IS NOT NULL").join(fitting, ["s", "b", "epoch", "h", "n"])
    whole = inside.filter("fits = copies")
    nth = F.row_number().over(Window.partitionBy("s", "b", "epoch", "h", "n").orderBy(F.xxhash64(*(c for c in rows.columns if c.startswith("own_")))))
    part = inside.filter("fits < copies").withColumn("nth", nth).filter("nth <= fits")  # copies of one text at most, in a block
    kept = joined.filter("room IS NULL").select(*own, *new).unionByName(whole.select(*own, *new))
    return kept.unionByName(part.select(*own, *new))
