"""Text cleaning as Column expressions; NFKC alone needs an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.lexical import bound

# Characters and what replaces them.
LIGATURES = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st",
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe",
}
ONE_TO_ONE = {
    "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"',
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "`": "'",
    "–": "-", "—": "-", "‒": "-", "―": "-",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ",
}
ELLIPSIS = ("…", "...")
DELETED = "​‌‍﻿�"

# Whole lines that are boilerplate, whatever their case.
BOILERPLATE = [
    r"page\s+\d+(?:\s*(?:of|/)\s*\d+)?",
    r"-\s*\d+\s*-",
    r"\[?\s*\d+\s*(?:of|/)\s*\d+\s*\]?",
    r"---\s*page\s+\d+\s*(?:of\s+\d+)?\s*---",
    r"===+\s*page\s+\d+\s*===+",
    r"(?:confidential|restricted circulation|internal use only|for internal use only|strictly confidential)\b.*",
    r"do\s+not\s+distribute",
    r"uncontrolled\s+copy\s+when\s+printed",
    r".*department of supervision\s+[•·*]\s+reserve bank of india\s+[•·*]\s+confidential internal copy.*",
    r"home\s*>\s*.*",
    r"(?:skip to (?:main )?content|navigation menu|table of contents)",
    r"(?:back to top|print this page|share this page|download pdf)",
    r"copyright\s*(?:©|\(c\))\s*\d{4}.*all rights reserved\.?",
    r"all\s+rights\s+reserved\.?",
]
BOILERPLATE_LINE = "(?i)^(?:" + "|".join(BOILERPLATE) + ")$"
STRUCTURED_LINE = r"^(?:[#|\-*+>]|(?:\d+\.|\([a-z0-9]+\))\s)"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def harmonise(text: Column) -> Column:
    """Ligatures, quotes, dashes and spaces replaced; zero-width and control characters dropped, but for line breaks and tabs."""
    out = F.translate(text, "".join(ONE_TO_ONE) + DELETED, "".join(ONE_TO_ONE.values()))
    for one, many in [*LIGATURES.items(), ELLIPSIS]:
        out = F.replace(out, F.lit(one), F.lit(many))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def drop_boilerplate(text: Column) -> Column:
    """Lines that aren't boilerplate; blank lines stay."""
    keep = lambda line: ~F.rlike(strip(line), F.lit(BOILERPLATE_LINE))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def is_structured(lines: Column) -> Column:
    """Whether at least one line, and 0.3 of the lines, start like a list, table, heading or quotation."""
    n = F.size(F.filter(lines, lambda s: F.rlike(strip(s), F.lit(STRUCTURED_LINE))))
    return n >= F.greatest(F.lit(1.0), F.size(lines) * 0.3)


def _join_lines(lines: Column) -> Column:
    """Lines joined by blanks; one that ends with a hyphen, but not with a dash, is joined to the next without it."""

    def fixed(parts: Column) -> Column:
        hyphen = lambda line: F.endswith(line, F.lit("-")) & ~F.endswith(line, F.lit(" --")) & (line != "--")
        glued = lambda line, i: (
            F.when(i == F.size(parts) - 1, line).when(hyphen(line), F.regexp_replace(line, "-$", "")).otherwise(F.concat(line, F.lit(" ")))
        )
        return F.array_join(F.transform(parts, glued), "")

    return bound(F.filter(F.transform(lines, strip), lambda s: s != ""), fixed)


def unwrap(text: Column) -> Column:
    """Words hyphenated over a line break are joined, and so are the lines of paragraphs that have no structure."""
    whole = F.regexp_replace(text, r"([a-zA-Z]{2,})-\r?\n[ \t]*([a-zA-Z]{2,})", "$1$2")

    def paragraph(p: Column) -> Column:
        lines = F.split(p, "\n")
        return F.when((F.size(lines) <= 1) | is_structured(lines), p).otherwise(_join_lines(lines))

    return F.array_join(F.transform(F.split(whole, "\n\n"), paragraph), "\n\n")


def tidy_spaces(text: Column) -> Column:
    """LF line breaks, no blanks at line ends, one blank between words, at most one blank line, nothing around."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)[ \t]+$", "")
    out = F.regexp_replace(out, r"(?<=\S)[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def clean(text: Column, unicode: bool = True, boilerplate: bool = True, lines: bool = True, spaces: bool = True) -> Column:
    if unicode:  # ASCII texts are in normal form: only the others pass through Python
        text = harmonise(F.coalesce(nfkc(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)), text))
    if boilerplate:
        text = drop_boilerplate(text)
    if lines:
        text = unwrap(text)
    return tidy_spaces(text) if spaces else text


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def preview(text: Column, n: int) -> Column:
    """One line of at most n characters, with ... where it was cut."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("..."))).otherwise(line)
