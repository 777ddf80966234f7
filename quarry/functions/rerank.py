"""Cross-scoring of a text against a query, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.lexical import salient_terms, tokens
from quarry.functions.vectors import clip

# Words of operative and of introductory text, and patterns of statutory entities.
OPERATIVE = [
    "shall", "must", "required", "mandate", "prohibited", "penalty", "sanction", "within", "exceeding", "minimum", "maximum", "between", "hours",
    "timeline", "obligation", "conduct", "strictly", "failure",
]
INTRODUCTORY = [
    "preamble", "preliminary", "circular no", "to all", "in exercise of the powers",
    "subject:", "reference:", "central office", "mumbai",
]
ENTITIES = [
    r"\b\d{1,2}(?::\d{2})?\s*(?:am|pm|hours)\b",
    r"\b\d+\s*%",
    r"\b\d+\s*(?:years|months|days|hours)\b",
    r"\b[a-z]{3,}\.[a-z0-9./-]+\b",
    r"\b(?:v-cip|edd|cdd|ovd|kfs|apr|pep|soc|cert-in)\b",
    r"\bseverity\s*[123]\b",
]


def entities(text: Column) -> Column:
    """Distinct times, percentages, durations, circular codes, acronyms and severities, in lower case and sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(0)) for p in ENTITIES))))


def sentences(text: Column) -> Column:
    """Stretches that end in . ! ? or a line break, of more than 10 characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?\n])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 10)


def cross_parts(query: Column, text: Column, section: Column, vector_score: Column) -> Column:
    """struct(sentence, entity, directness, vector, score): 0.4, 0.3, 0.2 and 0.1 of the four parts."""
    text, section = F.coalesce(text, F.lit("")), F.coalesce(section, F.lit(""))
    low = F.lower(text)
    wanted = F.array_distinct(salient_terms(query))
    shares = F.transform(
        sentences(low), lambda s: F.size(F.array_intersect(wanted, tokens(s))) / F.size(wanted).cast("double")
    )
    sentence = F.when(F.size(wanted) == 0, 0.0).otherwise(F.least(F.lit(1.0), 1.25 * F.coalesce(F.array_max(shares), F.lit(0.0))))
    asked, given = entities(query), entities(text)
    met = F.filter(asked, lambda e: F.exists(given, lambda g: F.contains(g, e) | F.contains(e, g)))
    entity = (
        F.when(F.size(asked) > 0, F.size(met) / F.size(asked))
        .when(F.size(given) > 0, 0.5)
        .otherwise(0.2)
    )
    operative = sum((F.contains(low, F.lit(m)).cast("int") for m in OPERATIVE), F.lit(0))
    head, where = F.substring(low, 1, 100), F.lower(section)
    intro = F.lit(False)
    for p in INTRODUCTORY:
        intro = intro | F.contains(where, F.lit(p)) | F.contains(head, F.lit(p))
    directness = 0.5 + F.least(F.lit(0.35), operative * 0.07) - F.when(intro, 0.35).otherwise(0.0)
    vector = clip(F.coalesce(vector_score, F.lit(0.0)), 0.0, 1.0)
    score = 0.4 * sentence + 0.3 * entity + 0.2 * directness + 0.1 * vector
    return F.struct(
        sentence.alias("sentence"), entity.alias("entity"), directness.alias("directness"), vector.alias("vector"),
        F.least(F.lit(1.0), score).alias("score"),
    )
