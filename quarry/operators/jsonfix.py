"""Parsing, repairing and validating model output as JSON, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of the required fields, in order of preference.
ALIASES = {
    "answer": ["response", "summary", "result", "content", "compliance_answer", "text"],
    "source": ["reference", "circular", "citation", "section", "doc_reference", "source_document"],
    "applicable_rule": ["rule", "statutory_rule", "provision", "rule_number", "regulation"],
    "confidence": ["confidence_level", "certainty", "score"],
    "action_required": ["action", "operational_action", "recommendation", "next_step"],
}


def as_object(text: Column) -> Column:
    """A JSON object as map of raw texts; null if the text isn't one."""
    ok = F.call_function("try_parse_json", text)
    is_object = F.startswith(F.trim(text), F.lit("{")) & ok.isNotNull()
    strict = F.when(is_object, F.from_json(text, "map<string,string>"))
    return F.when(F.size(strict) >= 0, strict)


def parse(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add strategy, repaired, success and data: direct parse, code fence, outermost braces, then repair of commas, quotes and literals."""
    text = F.trim(F.coalesce(F.col(raw_col), F.lit("")))
    fence = F.trim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1))
    base = F.when(fence != "", fence).otherwise(text)
    brace = F.regexp_extract(base, r"(?s)(\{.*\})", 1)
    base = F.when(brace != "", brace).otherwise(base)
    fixed = F.regexp_replace(base, r",\s*([\]}])", "$1")
    quoted = F.when(F.contains(fixed, F.lit("'")) & ~F.contains(fixed, F.lit('"')), F.regexp_replace(fixed, "'([^']*)'", '"$1"')).otherwise(fixed)
    for word, json in (("True", "true"), ("False", "false"), ("None", "null")):
        quoted = F.regexp_replace(quoted, rf"\b{word}\b", json)
    rows = rows.withColumns({"_a": as_object(text), "_b": as_object(fence), "_c": as_object(brace), "_d": as_object(quoted)})
    strategy = (
        F.when(text == "", "none")
        .when(F.col("_a").isNotNull(), "direct_json_loads")
        .when(F.col("_b").isNotNull(), "markdown_fence_extraction")
        .when(F.col("_c").isNotNull(), "regex_bracket_extraction")
        .when(F.col("_d").isNotNull(), "syntax_normalization_repair")
        .otherwise("syntax_repair_failed")
    )
    data = F.coalesce("_a", "_b", "_c", "_d")
    rows = rows.withColumns({"strategy": strategy, "data": data})
    repaired = F.col("data").isNotNull() & (F.col("strategy") != "direct_json_loads")
    return rows.withColumns({"success": F.col("data").isNotNull(), "repaired": repaired}).drop("_a", "_b", "_c", "_d")


def validate(parsed: DataFrame, required: tuple[str, ...] = ("answer", "source")) -> DataFrame:
    """Add a column for each field that may be required, status VALID, RECOVERED or INVALID, missing fields, and confidence made HIGH, MEDIUM or LOW."""
    data = F.col("data")
    there = lambda k: F.when(F.trim(F.coalesce(data[k], F.lit(""))) != "", data[k])
    fields, missing, recovered = {}, [], []
    for f in required:
        alias = F.coalesce(*(there(a) for a in ALIASES.get(f, [])), F.lit(None).cast("string"))
        fields[f] = F.coalesce(there(f), alias)
        missing.append(F.when(fields[f].isNull(), F.lit(f)))
        recovered.append(F.when(there(f).isNull() & alias.isNotNull(), F.lit(f)))
    confidence = F.upper(F.trim(data["confidence"]))
    level = F.when(data["confidence"].isNotNull(), F.when(confidence.isin("HIGH", "MEDIUM", "LOW"), confidence).otherwise("MEDIUM"))
    out = parsed.withColumns({f"field_{f}": c for f, c in fields.items()} | {"confidence": level})
    out = out.withColumns({"missing_fields": F.array_compact(F.array(*missing)), "recovered_fields": F.array_compact(F.array(*recovered))})
    status = F.when(~F.col("success") | (F.size("missing_fields") > 0), "INVALID").when(F.size("recovered_fields") > 0, "RECOVERED").otherwise("VALID")
    return out.withColumn("status", status)
