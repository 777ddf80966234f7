"""Conversation windows, token budgets and follow-up questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import estimated_tokens
from quarry.operators.context import render

# Single words and phrases that refer back.
CUE_WORDS = [
    "it", "its", "they", "them", "their", "that", "this", "these", "those", "such", "penalties", "rules", "deadline", "timeline", "logs", "stored",
    "retention",
]
CUE_PHRASES = ["after that", "the initial", "what about", "how long do", "supervisory penalties"]


def recent_turns(turns: DataFrame, k: int = 6) -> DataFrame:
    """The last k turns of each conversation; none for k <= 0."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= max(0, k)).drop("_n")


def history_before(turns: DataFrame, k: int = 6) -> DataFrame:
    """Each turn with the k turns before it as an array."""
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-k, -1)
    return turns.withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(frame))


def history_text(turns: DataFrame, k: int = 6) -> DataFrame:
    """Recent turns as text: long assistant texts are cut to 247 characters."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    short = F.when(F.length(flat) > 250, F.concat(F.substring(flat, 1, 247), F.lit("..."))).otherwise(flat)
    line = F.when(F.col("role") == "user", F.concat(F.format_string("Turn %d:\nUser: ", "turn"), F.col("text"))).otherwise(F.concat(F.format_string("Turn %d:\nAssistant: ", "turn"), short))
    rows = recent_turns(turns, k).withColumn("line", line)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return rows.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("history"))


def has_cues(q: Column) -> Column:
    low = F.lower(q)
    out = F.arrays_overlap(F.regexp_extract_all(low, F.lit(r"(?U)\b[a-z0-9_\-]+\b"), F.lit(0)), F.array(*(F.lit(w) for w in CUE_WORDS)))
    for p in CUE_PHRASES:
        out = out | F.contains(low, F.lit(p))
    return out


def rewrite(turns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """User turns with a stand-alone query: unchanged for the first one and without cues, else bound to the previous user turn. `keep` names columns that stay (text, previous)."""
    users = turns.filter("role = 'user'")
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    users = users.withColumn("previous", prev)
    bound = F.concat(F.col("text"), F.lit(" regarding "), F.substring("previous", 1, 50))
    follow = F.col("previous").isNotNull() & has_cues(F.col("text"))
    return users.select("conv_id", "turn", follow.alias("is_follow_up"), F.when(follow, bound).otherwise(F.col("text")).alias("rewritten"), *keep)


def message_tokens(role: Column, text: Column) -> Column:
    return F.lit(4) + estimated_tokens(role) + estimated_tokens(F.coalesce(text, F.lit("")))


def trim(turns: DataFrame, budget: int, reserve: int = 0) -> DataFrame:
    """Mark which messages stay: the first (system) and last always, of the others the longest suffix that fits max(100, budget - reserve) with 3 tokens for the reply."""
    room = max(100, budget - reserve)
    rows = turns.withColumn("tokens", message_tokens(F.col("role"), F.col("text")))
    up, down = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumns({"n_up": F.row_number().over(up), "n_down": F.row_number().over(down), "total": F.sum("tokens").over(whole) + 3})
    tail = F.sum("tokens").over(down.rowsBetween(Window.unboundedPreceding, 0))
    first = F.max(F.when(F.col("n_up") == 1, F.col("tokens"))).over(whole)
    rows = rows.withColumns({"tail": tail, "head": first})
    fits = F.col("tail") + F.col("head") + 3 <= room
    keep = (F.col("n_up") == 1) | (F.col("n_down") == 1) | (F.col("total") <= room) | fits
    return rows.select("conv_id", "turn", "role", "text", "tokens", "total", keep.alias("kept"))


def summarise(turns: DataFrame, budget: int, reserve: int = 0) -> DataFrame:
    """Per conversation over the budget with more than two messages: one summary of the user questions between the first and the last message."""
    room = max(100, budget - reserve)
    marked = trim(turns, budget, reserve).filter((F.col("total") > room))
    up, down = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    middle = marked.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)}).filter("a > 1 AND b > 1")
    topics = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.substring("text", 1, 60).alias("t"))))), lambda x: F.trim(x["t"]))
    text = F.concat(F.lit("[PREVIOUS TURNS SUMMARY: "), F.array_join(topics, "; "), F.lit("]"))
    return middle.groupBy("conv_id").agg(F.count("*").alias("compressed_turns"), text.alias("summary"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_message(question: Column, context: Column, template: str = "Context:\n{context}\n\nQuestion: {question}") -> Column:
    """struct(role, content, has_context, context_tokens): the stripped question, set into the template with its context where there is one."""
    question, context = F.trim(question), F.trim(F.coalesce(context, F.lit("")))
    has = context != ""
    text = F.when(has, render(template, {"context": context, "question": question})).otherwise(question)
    return F.struct(F.lit("user").alias("role"), text.alias("content"), has.alias("has_context"), F.when(has, estimated_tokens(context)).otherwise(0).alias("context_tokens"))


def api_messages(turns: DataFrame) -> DataFrame:
    """Per conversation: its messages as array<struct(role, content)> in order, their number, and the number of user turns. A conversation's turns are few."""
    item = F.struct("turn", F.struct("role", F.trim(F.coalesce("text", F.lit(""))).alias("content")).alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"])
    return turns.groupBy("conv_id").agg(listed.alias("messages"), F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("user_turns"))


def chat_messages(turns: DataFrame, system: str, k: int = 6) -> DataFrame:
    """For each user turn: the system message, the k messages before it, and the question itself as array<struct(role, content)>."""
    rows = history_before(turns, k).filter("role = 'user'")
    past = F.transform("history", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return rows.select("conv_id", "turn", F.concat(F.array(message("system", F.lit(system))), past, F.array(message("user", F.col("text")))).alias("messages"))
