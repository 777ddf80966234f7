"""Licence labels of documents: fixed phrases, and text blocks that contain a template by exact set similarity."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Template blocks and their labels.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software"
    ),
    "bsd-conditions": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met"
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation"
    ),
    "apache-notice": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    ),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at"
    ),
}

_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    """A template as the join sees it: its words from rare to frequent, its prefix, and the widest block that counts."""

    label: str
    rank: dict  # word: place in the global order
    need: int  # words of the template that a block must hold
    prefix: frozenset
    width: int  # words of a block at most


def order_templates(templates: dict[str, str], counts: dict[bytes, int], threshold: float) -> list[Template]:
    out = []
    for label, text in sorted(templates.items()):
        words = words_of(text)
        ordered = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        prefix = frozenset(ordered[: len(ordered) - need + 1])
        width = max(need, math.ceil(len(words) / threshold - 1e-9))
        out.append(Template(label, {w: i for i, w in enumerate(ordered)}, need, prefix, width))
    return out


def blocks_with(words: list[bytes], present: set[bytes], t: Template) -> Iterator[tuple[int, int, float]]:
    """(first word, words, containment) of the best block of each stretch of text in which blocks reach the threshold.

    Prefix filter: a block that holds `need` of the template's words holds one of the first size - need + 1 in
    the global order. Length filter: nor can a text of fewer words than `need`. Positional filter: the rarest word found stands at some place of the
    order, and only as many words as stand from there on can be held.
    """
    if len(words) < t.need or present.isdisjoint(t.prefix):
        return
    found = present & t.rank.keys()
    if len(found) < t.need or len(t.rank) - min(map(t.rank.__getitem__, found)) < t.need:
        return
    hits = [(i, t.rank[w]) for i, w in enumerate(words) if w in found]
    held: Counter = Counter()
    left, best = 0, None
    for right, (at, w) in enumerate(hits):
        held[w] += 1
        while hits[left][0] <= at - t.width:
            held[hits[left][1]] -= 1
            if not held[hits[left][1]]:
                del held[hits[left][1]]
            left += 1
        if len(held) < t.need:
            continue
        while held[hits[left][1]] > 1:  # the shortest block with these words
            held[hits[left][1]] -= 1
            left += 1
        start, size = hits[left][0], len(held)
        if best and start > best[0] + best[1]:
            yield best[0], best[1], best[2] / len(t.rank)
            best = None
        if best is None or size > best[2]:
            best = (start, hits[right][0] - start + 1, size)
    if best:
        yield best[0], best[1], best[2] / len(t.rank)


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Word positions at which the phrase's words stand one after another."""
    if phrase[0] not in words:
        return []
    n, out, at = len(phrase), [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


def _count(vocabulary: frozenset):
    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is not None:
                    seen.update(vocabulary.intersection(words_of(t)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


SCAN_SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "blocks array<struct<label: string, start: long, words: long, containment: double>>"
)


def _scan(templates: list[Template], phrases: dict[str, str]):
    listed = [(words_of(p), label) for p, label in sorted(phrases.items())]
    vocabulary = frozenset().union(*(t.rank.keys() for t in templates)) | {w for p, _ in listed for w in p}
    block = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())])
    kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.list_(block)]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py() or "")
                present = set(vocabulary.intersection(words))
                places, labels, blocks = [], set(), []
                for phrase, label in listed:
                    if present.issuperset(phrase) and (at := phrase_places(words, phrase)):
                        places += at
                        labels.add(label)
                for t in templates:
                    blocks += [{"label": t.label, "start": s, "words": n, "containment": c} for s, n, c in blocks_with(words, present, t)]
                rows.append((key.as_py(), len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), blocks))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Find licence phrases and template blocks in every whole text.

    A block is any stretch of consecutive words no longer than the template divided by `threshold`; it
    meets a template if it holds at least `threshold` of the template's distinct words. The templates' words are ordered by the number of
    documents that hold them, counted over all documents.

    Returns id, n_words, n_base (places of all phrases), first_word, last_word (their smallest and largest start; null without one),
    base_labels, blocks (label, start, words, containment of the best block of each stretch). Null and empty texts have no words;
    null ids and repeated rows each get their row; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    ws = Workspace(docs.sparkSession, "licences")
    vocabulary = frozenset(w for t in templates.values() for w in words_of(t))
    text = F.col(text_col).cast("string")
    counted = ws.save(docs.select(text.alias("text")).mapInArrow(_count(vocabulary), "word binary, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r["word"]): r["n"] for r in counted.collect()}  # a row a template word
    ordered = order_templates(templates, counts, threshold)
    found = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(_scan(ordered, phrases), SCAN_SCHEMA)
    return ws.save(found).withColumnRenamed("id", id_col)


def label_rows(found: DataFrame) -> DataFrame:
    """Base and all labels, comma-joined in order, and a score: the largest containment of a block, 1 where a phrase stands, else 0."""
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("blocks", lambda b: b["label"]))))
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return found.withColumns(
        {
            "labels": F.array_join(labels, ","),
            "base_labels": F.array_join("base_labels", ","),
            "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))),
        }
    ).drop("blocks")
