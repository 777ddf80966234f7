"""Packing retrieved rows into a token budget, and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import estimated_tokens, words


def available_budget(total: Column, system: Column, query: Column, reserve: int = 450, margin: int = 50, cap: int | None = None) -> Column:
    left = total - system - query - F.lit(reserve) - F.lit(margin)
    return F.greatest(F.lit(0), left if cap is None else F.least(left, F.lit(cap)))


def block_text(index: Column, source: Column, section: Column, page: Column, chunk: Column, text: Column) -> Column:
    return F.format_string("SOURCE [%d]: %s\nSection: %s | Page: %d | Chunk ID: %s\nContent:\n%s", index, source, section, page, chunk, text)


def pack_until_full(hits: DataFrame, budget: int, token_col: str = "token_count") -> DataFrame:
    """Rows in rank order up to the first that overflows; the first row is always in."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("used", F.sum(token_col).over(order))
    # Running sums don't fall, so that a row is after an overflow exactly if its own sum overflows.
    return rows.filter((F.col("rank") == 1) | (F.col("used") <= budget))


def _packing(hits: DataFrame, budget: int, truncate: bool, with_text: bool) -> DataFrame:
    """A query's parts folded in rank order: query_id, and acc with used, dropped, cut and an entry a part.

    hits: query_id, rank, id, text. A query's rows are few (its k), so they are folded in one array.
    """
    split = words(F.col("text"))
    item = F.struct("rank", "id", estimated_tokens(F.col("text")).alias("tokens"), F.size(split).alias("n_words"), *([F.col("text"), split.alias("w")] if with_text else []))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = f"array<struct<rank:int,id:{hits.schema['id'].dataType.simpleString()},status:string,tokens:int,used:int{',text:string' if with_text else ''}>>"
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("dropped"), F.lit(False).alias("cut"), F.array().cast(kind).alias("parts"))

    def add(acc: Column, x: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        fits = x["tokens"] <= left
        cut = ~fits & F.lit(truncate) & (left > 60) & ~acc["cut"]
        kept = F.least(x["n_words"], F.greatest(F.lit(10), F.floor(left / 2).cast("int")))
        tokens = F.when(fits, x["tokens"]).when(cut, F.greatest(F.lit(1), F.floor(kept * 1.3).cast("int"))).otherwise(0)
        text = [F.when(fits, x["text"]).when(cut, F.array_join(F.slice(x["w"], F.lit(1), kept), " ")).otherwise("").alias("text")] if with_text else []
        status = F.when(fits, "included").when(cut, "cut").otherwise("dropped")
        entry = F.struct(x["rank"].cast("int").alias("rank"), x["id"].alias("id"), status.alias("status"), tokens.alias("tokens"), (acc["used"] + tokens).alias("used"), *text)
        return F.struct(
            (acc["used"] + tokens).alias("used"), (acc["dropped"] + F.when(fits | cut, 0).otherwise(1)).alias("dropped"), (acc["cut"] | ~fits).alias("cut"), F.array_append(acc["parts"], entry).alias("parts")
        )

    return rows.select("query_id", F.aggregate("items", start, add).alias("acc"))


def pack_greedy(hits: DataFrame, budget: int, truncate: bool = True) -> DataFrame:
    """Rows in rank order while they fit; the first that doesn't is cut to max(10, remaining / 2) words if more than 60 tokens remain; others are dropped, and smaller later ones still tried.

    hits: query_id, rank, id, text. Returns query_id, used, dropped, truncated, and packed (id, tokens, truncated).
    """
    packed = F.transform(F.filter("acc.parts", lambda p: p["status"] != "dropped"), lambda p: F.struct(p["id"].alias("id"), p["tokens"].alias("tokens"), (p["status"] == "cut").alias("truncated")))
    return _packing(hits, budget, truncate, with_text=False).select("query_id", "acc.used", "acc.dropped", F.col("acc.cut").alias("truncated"), packed.alias("packed"))


def pack_parts(hits: DataFrame, budget: int, truncate: bool = True) -> DataFrame:
    """pack_greedy's ledger, a row a part: query_id, rank, id, status (included, cut or dropped), the tokens it takes, the tokens used up to it, and the text that goes in."""
    return _packing(hits, budget, truncate, with_text=True).select("query_id", F.explode("acc.parts").alias("p")).select("query_id", "p.*")


def render(template: str, values: dict[str, Column]) -> Column:
    """A template whose {names} are replaced by columns; a name without a value is an error when the plan is built."""
    missing = sorted(set(re.findall(r"\{(\w+)\}", template)) - values.keys())
    if missing:
        raise KeyError(f"no value for {missing}")
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def messages(system: Column, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))
    )
