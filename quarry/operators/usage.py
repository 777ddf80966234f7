"""Cache keys and simulation, audit records, usage roll-ups, costs."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import estimated_tokens

# Dollars a million tokens.
PROMPT_RATE, COMPLETION_RATE = 0.20, 0.80
TIERS = [("premium", 2.50, 10.00), ("economy", 0.15, 0.60), ("balanced", 3.00, 15.00)]


def normalise_query(q: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(q, F.lit("")), r"\s+", " ")))


def _json(text: Column) -> Column:
    """A JSON string of ASCII characters; others of the BMP as \\u escapes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    chars = F.transform(F.split(out, ""), lambda c: F.when(F.ascii(c) > 126, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0")))).otherwise(c))
    return F.concat(F.lit('"'), F.array_join(chars, ""), F.lit('"'))


def cache_key(q: Column, top_k: Column, model: Column, filter_text: Column) -> Column:
    """First 24 hex characters of the SHA-256 of the sorted-key JSON of filter, k, model and normalised query."""
    body = F.concat(
        F.lit('{"f": '), _json(F.trim(F.coalesce(filter_text, F.lit("")))), F.lit(', "k": '), top_k.cast("string"),
        F.lit(', "m": '), _json(F.lower(F.trim(F.coalesce(model, F.lit(""))))), F.lit(', "q": '), _json(normalise_query(q)), F.lit("}"),
    )
    return F.substring(F.sha2(body, 256), 1, 24)


def request_cost(prompt: Column, completion: Column) -> Column:
    return F.round(prompt / 1e6 * PROMPT_RATE + completion / 1e6 * COMPLETION_RATE, 6)


def simulate_ttl(requests: DataFrame, ttl_seconds: float) -> DataFrame:
    """Mark each request HIT, MISS or EXPIRED (a miss too) by its key's state; an entry expires when it is older than the ttl, never for ttl <= 0.

    requests: key, ts, seq. Entries without a bound on their number don't affect each other, so that keys are folded apart.
    """
    order = Window.partitionBy("key").orderBy("ts", "seq")
    if ttl_seconds <= 0:
        return requests.withColumn("outcome", F.when(F.row_number().over(order) == 1, "MISS").otherwise("HIT"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"], kind="stable")
        born, out = None, []
        for t in frame["ts"]:
            if born is None:
                out.append("MISS")
                born = t
            elif (t - born).total_seconds() > ttl_seconds:
                out.append("EXPIRED")
                born = t
            else:
                out.append("HIT")
        return frame.assign(outcome=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", outcome string"
    return requests.groupBy("key").applyInPandas(fold, schema)


def simulate_lru(requests: DataFrame, capacity: int = 500, ttl_seconds: float = 0) -> DataFrame:
    """As simulate_ttl with at most `capacity` entries, the least recently used evicted.

    Evictions couple all keys, so that requests pass in order through one task, as a stream that holds the cache alone; shard
    the cache (one simulation a shard) where that is too slow.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict = OrderedDict()
        for frame in frames:
            out, evicted = [], []
            for key, t in zip(frame["key"], frame["ts"], strict=True):
                gone = None
                if key in held and (ttl_seconds <= 0 or (t - held[key]).total_seconds() <= ttl_seconds):
                    held.move_to_end(key)
                    out.append("HIT")
                else:
                    out.append("EXPIRED" if held.pop(key, None) is not None else "MISS")
                    if len(held) >= capacity:
                        gone = held.popitem(last=False)[0]
                    held[key] = t
                evicted.append(gone)
            yield frame.assign(outcome=out, evicted=evicted)

    key = requests.schema["key"].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + f", outcome string, evicted {key}"
    return requests.repartition(1).sortWithinPartitions("ts", "seq").mapInPandas(run, schema)


def cache_statistics(outcomes: DataFrame) -> DataFrame:
    n, hits = F.count("*"), F.count_if(F.col("outcome") == "HIT")
    return outcomes.agg(
        n.alias("requests"), hits.alias("hits"), (n - hits).alias("misses"), F.count_if(F.col("outcome") == "EXPIRED").alias("expirations"),
        F.when(n > 0, F.round(hits / n * 100, 2)).otherwise(0.0).alias("hit_rate_pct"),
    )


# What a source without a field is recorded with.
SOURCE_DEFAULTS = {"source_document": ("string", "Unknown"), "chunk_id": ("string", "N/A"), "section": ("string", "General"), "page_number": ("int", 1), "similarity_score": ("double", 0.0)}


def sanitised_sources(sources: Column, fields: list[str]) -> Column:
    """Sources (an array of structs with some of the fields) as an audit record keeps them: marker (its place in brackets where there is none), document, chunk, section, page and the score to four digits; null sources are left out, other fields go."""

    def one(s: Column, i: Column) -> Column:
        marker = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))
        parts = [(F.coalesce(s["marker"].cast("string"), marker) if "marker" in fields else marker).alias("marker")]
        for name, (kind, default) in SOURCE_DEFAULTS.items():
            value = F.coalesce(s[name].cast(kind), F.lit(default).cast(kind)) if name in fields else F.lit(default).cast(kind)
            parts.append((F.round(value, 4) if name == "similarity_score" else value).alias(name))
        return F.when(s.isNotNull(), F.struct(*parts))

    return F.array_compact(F.transform(F.coalesce(sources, F.array()), one))


def audit_records(requests: DataFrame, answer_col: str = "answer", question_col: str | None = None, sources_col: str | None = None) -> DataFrame:
    """Preview, totals, cost and what a hit saved, for requests with prompt_tokens, completion_tokens, cache_hit. Missing token counts are estimated from the trimmed question and answer, where the question is named;
    sources are sanitised, where they are."""
    answer = F.trim(F.coalesce(F.col(answer_col), F.lit("")))
    rows = requests
    if question_col is not None:
        question = F.trim(F.coalesce(F.col(question_col), F.lit("")))
        rows = rows.withColumns({question_col: question, "prompt_tokens": F.coalesce("prompt_tokens", estimated_tokens(question)), "completion_tokens": F.coalesce("completion_tokens", estimated_tokens(answer))})
    if sources_col is not None:
        fields = rows.schema[sources_col].dataType.elementType.fieldNames()
        rows = rows.withColumn(sources_col, sanitised_sources(F.col(sources_col), fields))
    cost = request_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    short = F.when(F.length(answer) > 140, F.concat(F.substring(answer, 1, 140), F.lit("..."))).otherwise(answer)
    return rows.withColumns(
        {
            "answer_preview": short,
            "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
            "estimated_cost_usd": F.when(F.col("cache_hit"), 0.0).otherwise(cost),
            "cost_saved_usd": F.when(F.col("cache_hit"), cost).otherwise(0.0),
        }
    )


def usage_summary(audit: DataFrame) -> DataFrame:
    """One row: counts, hit rate, tokens, costs, mean latency overall and by hit, and the reduction."""
    hit = F.col("cache_hit")
    out = audit.agg(
        F.count("*").alias("requests"), F.count_if(hit).alias("hits"), F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("total_tokens").alias("tokens"), F.round(F.sum("estimated_cost_usd"), 6).alias("cost"), F.round(F.sum("cost_saved_usd"), 6).alias("saved"),
        F.round(F.avg("latency"), 4).alias("avg_latency"), F.round(F.avg(F.when(hit, F.col("latency"))), 4).alias("avg_hit_latency"),
        F.round(F.avg(F.when(~hit, F.col("latency"))), 4).alias("avg_miss_latency"),
    )
    rate = F.when(F.col("requests") > 0, F.round(F.col("hits") / F.col("requests") * 100, 2)).otherwise(0.0)
    less = (F.col("avg_miss_latency") - F.col("avg_hit_latency")) / F.col("avg_miss_latency") * 100
    return out.withColumn("hit_rate_pct", rate).withColumn("latency_reduction_pct", F.when(F.col("avg_miss_latency") > 0, F.round(less, 2)).otherwise(0.0))


def timeline(audit: DataFrame) -> DataFrame:
    """Requests, hits, tokens and cost by hour."""
    return audit.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("requests"), F.count_if("cache_hit").alias("hits"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("estimated_cost_usd"), 6).alias("cost")
    )


def token_profile(text: Column, tokens: Column, words: Column) -> Column:
    per = lambda a, b: F.when(b > 0, F.round(a / b, 2)).otherwise(0.0)
    return F.struct(F.length(text).alias("chars"), words.alias("words"), tokens.alias("tokens"), per(F.length(text), tokens).alias("chars_per_token"), per(tokens, words).alias("tokens_per_word"))


def cost_projection(requests: DataFrame, volumes: list[int]) -> DataFrame:
    """Cost of each request's tokens in each pricing tier and at each number of queries."""
    tiers = requests.sparkSession.createDataFrame(TIERS, "tier string, in_rate double, out_rate double")
    grid = tiers.crossJoin(requests.sparkSession.createDataFrame([(v,) for v in volumes], "volume long"))  # fixed size
    each = F.col("prompt_tokens") / 1e6 * F.col("in_rate") + F.col("completion_tokens") / 1e6 * F.col("out_rate")
    return requests.crossJoin(F.broadcast(grid)).select("*", F.round(each * F.col("volume"), 6).alias("projected_cost"))


def invalidate(entries: DataFrame, keys: DataFrame | None = None, key_col: str = "key") -> tuple[DataFrame, DataFrame]:
    """(entries that stay, entries removed): those whose key is among `keys` go, all without `keys`. Hit and miss counters live in the requests and are kept."""
    if keys is None:
        return entries.filter(F.lit(False)), entries
    gone = keys.select(key_col).distinct()
    return entries.join(gone, key_col, "left_anti"), entries.join(gone, key_col, "left_semi")
