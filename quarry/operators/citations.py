"""Citations of answers: registry, extraction, verification and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.chunking import unnested
from pyspark.sql import types as T

from quarry.operators.evaluation import is_refusal

# Citation markers, numbers with units, words that carry no evidence, and entities of factual claims.
MARKER = r"\[(\d+|[\w.\-]+\.(?:pdf|txt|md|html|json))[^\]]*\]"
NUMBER = r"\b\d+\s*(?:hours?|days?|business days?|calendar days?|years?|lakhs?|months?)\b"
WEAK = ["initial", "report", "based", "provided", "regulatory", "context", "according", "must", "the"]
CLAIMS = [
    r"\b\d+\s*(?:hours?|hrs?|days?|business days?|years?|months?)\b",
    r"\b(?:cert-in|rbi|csite|fiu-ind|v-cip|edd|cdd|pml rules?|kyc|soc|siem)\b",
    r"\b(?:severity\s*1|two-factor|2fa|totp|worm storage|47a)\b",
    r"\b(?:ten lakhs|10 lakhs|5 years|6 hours|7 business days|3 years)\b",
]


#: Names under which retrieved rows of any shape may hold a registry's fields.
SHAPES = {
    "id": ("id", "chunk_id"), "text": ("text", "document", "verbatim_text", "content", "source_text"), "filename": ("filename", "source_document", "source"),
    "section": ("section",), "page_number": ("page_number", "page"), "score": ("score", "similarity_score", "rerank_score", "hybrid_score"),
}


def registry(hits: DataFrame) -> DataFrame:
    """Marker [rank] of each retrieved row."""
    return hits.withColumn("marker", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")))


def normalised(hits: DataFrame) -> DataFrame:
    """Retrieved rows of any shape (columns, or a struct or map `metadata` beside them) with the registry's fields; a field that no name gives is null."""
    meta = hits.schema["metadata"].dataType if "metadata" in hits.columns else None
    inner = [f.name for f in meta.fields] if isinstance(meta, T.StructType) else None

    def first(names: tuple[str, ...]) -> Column:
        found = [F.col(n).cast("string") for n in names if n in hits.columns]
        if inner is not None:
            found += [F.col(f"metadata.{n}").cast("string") for n in names if n in inner]
        elif meta is not None:
            found += [F.col("metadata")[n].cast("string") for n in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    kinds = {"page_number": "int", "score": "double"}
    keep = [c for c in ("answer_id", "query_id", "rank") if c in hits.columns]
    return hits.select(*keep, *(first(names).cast(kinds.get(f, "string")).alias(f) for f, names in SHAPES.items()))


def _markers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda m: F.concat(F.lit("["), m, F.lit("]"))))


def extract_claims(answers: DataFrame) -> DataFrame:
    """A row for each sentence of an answer and marker cited in it: answer_id, claim_no, claim, marker_no, marker.

    Sentences end at . ! ? before white space that no marker follows. An answer whose markers stand in none of them is one claim.
    """
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    parts = F.flatten(F.transform(lines, lambda s: F.split(s, r"(?<=[.!?])\s+(?!\s*\[)")))
    claims = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.size(_markers(s)) > 0)
    whole = F.when(F.size(_markers(F.col("answer"))) > 0, F.array(F.trim("answer"))).otherwise(F.array().cast("array<string>"))
    claims = F.when(F.size(claims) > 0, claims).otherwise(whole)
    rows = unnested(answers.select("answer_id", claims.alias("claims")), "claims", "claim_no", "claim", "answer_id")
    return unnested(rows.withColumn("markers", _markers(F.col("claim"))), "markers", "marker_no", "marker", "answer_id", "claim_no", "claim")


def resolve(claims: DataFrame, reg: DataFrame) -> DataFrame:
    """Join claims to registry rows by marker, else by file name without regard to case, the first in rank order."""
    by_name = reg.groupBy("answer_id", F.lower(F.concat(F.lit("["), "filename", F.lit("]"))).alias("named")).agg(F.min_by("marker", "rank").alias("by_name"))
    rows = claims.withColumn("named", F.lower("marker"))
    rows = rows.join(reg.select("answer_id", "marker", F.lit(True).alias("known")), ["answer_id", "marker"], "left")
    rows = rows.join(by_name, ["answer_id", "named"], "left")
    rows = rows.select("answer_id", "claim_no", "claim", "marker_no", "marker", F.when(F.col("known"), F.col("marker")).otherwise(F.col("by_name")).alias("resolved"))
    own = reg.select("answer_id", F.col("marker").alias("resolved"), "id", "text")
    return rows.join(own, ["answer_id", "resolved"], "left")


def _informative(low: Column) -> Column:
    words = F.regexp_extract_all(low, F.lit(r"(?U)\b[a-z0-9_\-]{3,}\b"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(WEAK))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


RUNS = range(8, 2, -1)  #: words of a supporting run, longest first


def _longest_run(words: Column, run: Column) -> Column:
    """struct(span, words, at): the first of the longest runs of 8 to 3 of a claim's words that stand in a row in the text, and the text's word that it begins at; null without one.

    run: the text's words between blanks. Lengths are tried from the longest down, and the shorter ones only where no longer one was found.
    """

    def of(n: int) -> Column:
        part = lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")
        first = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.contains(run, F.concat(F.lit(" "), part(i), F.lit(" ")))), F.lit(0))
        before = lambda span: F.call_function("substring_index", run, F.concat(F.lit(" "), span, F.lit(" ")), F.lit(1))
        at = lambda span: F.length(before(span)) - F.length(F.replace(before(span), F.lit(" "), F.lit("")))
        found = F.transform(F.array(part(first)), lambda span: F.struct(span.alias("span"), F.lit(n).alias("words"), at(span).cast("int").alias("at")))
        return F.when((F.size(words) >= n) & first.isNotNull(), F.get(found, F.lit(0)))

    return F.coalesce(*(of(n) for n in RUNS))


def verify(resolved: DataFrame) -> DataFrame:
    """Hold each claim against its row: share of keywords found, numbers found, the longest run of words found with its place; status and confidence."""
    low = F.lower(F.trim(F.regexp_replace("claim", r"\[[^\]]+\]", "")))
    text = F.lower(F.col("text"))
    rows = resolved.withColumns({"_keys": _informative(low), "_numbers": F.regexp_extract_all(low, F.lit(NUMBER), F.lit(0))})
    rows = rows.withColumns(
        {
            "_words": F.regexp_extract_all(low, F.lit(r"(?U)\b[a-z0-9_\-]+\b"), F.lit(0)),
            "_run": F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(r"(?U)\b[a-z0-9_\-]+\b"), F.lit(0)), " "), F.lit(" ")),
        }
    )
    rows = rows.withColumn("_span", _longest_run(F.col("_words"), F.col("_run")))
    span = F.col("_span").isNotNull()
    ratio = F.size(F.filter("_keys", lambda k: F.contains(text, k))) / F.greatest(F.lit(1), F.size("_keys"))
    numbers = F.forall("_numbers", lambda x: F.contains(text, x))
    some = F.exists("_numbers", lambda x: F.contains(text, x))
    rows = rows.withColumn("keyword_ratio", ratio).withColumn("verified", ((F.col("keyword_ratio") >= 0.35) & numbers) | span | some)
    status = (
        F.when(F.col("resolved").isNull(), "FABRICATED_MARKER")
        .when(F.col("verified"), "VERIFIED")
        .when(F.col("keyword_ratio") >= 0.25, "PARTIALLY_SUPPORTED")
        .otherwise("UNSUPPORTED")
    )
    confidence = F.when(status == "FABRICATED_MARKER", 0.0).when(F.col("verified"), F.least(F.lit(1.0), F.col("keyword_ratio") + 0.3)).otherwise(F.col("keyword_ratio"))
    return rows.select("answer_id", "claim_no", "claim", "marker_no", "marker", status.alias("status"), confidence.alias("confidence"), "_span.span", F.col("_span.words").alias("span_words"), F.col("_span.at").alias("span_at"))


def audit(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """Per answer: citations, verified, fabricated and unsupported ones, precision and verdict; a refusal without markers passes."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    per = verified.groupBy("answer_id").agg(
        F.count("*").alias("citations"), is_("VERIFIED").alias("verified"), is_("FABRICATED_MARKER").alias("fabricated"),
        F.count_if(F.col("status").isin("UNSUPPORTED", "FABRICATED_MARKER")).alias("unsupported"),
        F.array_sort(F.collect_set("marker")).alias("markers"),
    )
    rows = answers.select("answer_id", is_refusal(F.col("answer")).alias("refusal")).join(per, "answer_id", "left")
    rows = rows.na.fill(0, ["citations", "verified", "fabricated", "unsupported"])
    verdict = (
        F.when(F.col("fabricated") > 0, "REJECTED")
        .when((F.col("citations") == 0) & ~F.col("refusal"), "FLAGGED")
        .when(F.col("unsupported") > 0, "FLAGGED")
        .otherwise("PASS")
    )
    precision = F.when(F.col("citations") > 0, F.col("verified") / F.col("citations")).otherwise(1.0)
    return rows.select("answer_id", "citations", "verified", "fabricated", "unsupported", precision.alias("citation_precision"), verdict.alias("verdict"))


def source_accuracy(answer: Column, sources: Column, query: Column) -> Column:
    """struct(claims, supported, fidelity, grounded): entities of the answer that stand in the sources or the query."""
    low = F.lower(answer)
    claims = F.array_distinct(F.concat(*(F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in CLAIMS)))
    good = F.filter(claims, lambda c: F.contains(F.lower(sources), c) | F.contains(F.lower(query), c))
    cited = F.size(F.regexp_extract_all(answer, F.lit(r"\[\d+\]"), F.lit(0))) > 0
    refused = F.contains(low, F.lit("not contain sufficient information")) | F.contains(low, F.lit("insufficient"))
    fidelity = F.when(refused, 1.0).when(F.size(claims) > 0, F.size(good) / F.size(claims)).when(cited, 1.0).otherwise(0.85)
    return F.struct(
        F.size(claims).alias("claims"), F.size(good).alias("supported"), fidelity.alias("fidelity"),
        (refused | ((fidelity >= 0.8) & cited)).alias("grounded"),
    )
