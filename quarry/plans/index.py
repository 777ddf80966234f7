"""Queries over chunk metadata, index records, collections, strategies, cases, caches and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chunking as H
from quarry.operators import citations as C
from quarry.operators import conversation as V
from quarry.operators import evaluation as E
from quarry.operators import ingest as I
from quarry.operators import metadata as M
from quarry.operators import usage as U
from quarry.plans.answers import made_answers, made_registry, requests, turns
from quarry.plans.registry import query, table
from quarry.plans.retrieval import asks, corpus, rounded
from quarry.plans.texts import _CC, _CW, _EST, _NW, docs
from quarry.session import fresh_folder
from quarry.sources import collections as L
from quarry.sources import tables as S
from quarry.streaming import usage as SU
from quarry.streaming.uploads import UploadIndex

#: Documents as loosely described chunks: paths of three extensions, some without a file name, section, page or strategy.
_LOOSE = """ch AS (SELECT doc_id, text, 'corpus/' || coalesce(source, 'none') || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.tar.pdf' ELSE '' END AS source, CASE WHEN doc_id % 5 = 0 THEN 'named-' || doc_id || '.md' WHEN doc_id % 5 = 1 THEN '' END AS filename,
CASE WHEN doc_id % 4 = 0 THEN 'Scope' END AS section, CAST(doc_id % 4 - 1 AS INTEGER) AS page_number, CAST(doc_id % 7 AS INTEGER) AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN 9 END AS total_chunks FROM documents),
nm AS (SELECT *, coalesce(nullif(filename, ''), regexp_extract(source, '([^/]+)$', 1)) AS name FROM ch),
md AS (SELECT doc_id, source, name AS filename, replace(name, '.', '_') AS document_id, regexp_extract(name, '[^.](\\.[^./]+)$', 1) AS file_type, coalesce(section, 'Preamble / Document Header') AS section,
 CASE WHEN page_number > 0 THEN page_number ELSE 1 END AS page_number, chunk_index, CAST(coalesce(total_chunks, 1) AS INTEGER) AS total_chunks, 0 AS char_start, 0 AS char_end, 0 AS char_count, 0 AS token_count, 'default' AS strategy FROM nm)"""


def _loose(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.lit("corpus/"), F.coalesce("source", F.lit("none")), F.when(i % 3 == 0, ".txt").when(i % 3 == 1, ".tar.pdf").otherwise(""))
    name = F.when(i % 5 == 0, F.concat(F.lit("named-"), i.cast("string"), F.lit(".md"))).when(i % 5 == 1, "")
    return docs(spark, d).select(
        "doc_id", "text", path.alias("source"), name.alias("filename"), F.when(i % 4 == 0, "Scope").alias("section"), (i % 4 - 1).cast("int").alias("page_number"),
        (i % 7).cast("int").alias("chunk_index"), F.when(i % 2 == 0, 9).alias("total_chunks"),
    )


@query(f"WITH {_LOOSE} SELECT * FROM md")
def chunk_metadata(spark, d):
    return M.chunk_metadata(_loose(spark, d)).select("doc_id", *M.FIELDS)


@query(f"""WITH {_LOOSE} SELECT doc_id, '[Source: ' || filename || ', Chunk: ' || chunk_index + 1 || '/' || total_chunks || CASE WHEN section = 'Scope' THEN ', Section: ''Scope''' ELSE '' END || ', Page: ' || page_number || ']' AS citation FROM md""")
def chunk_citations(spark, d):
    rows = M.chunk_metadata(_loose(spark, d))
    return rows.select("doc_id", M.citation(F.col("filename"), F.col("chunk_index"), F.col("total_chunks"), F.col("section"), F.col("page_number")).alias("citation"))


@query("""SELECT doc_id, coalesce(lang, '') AS lang, n_chars, n_chars > 500 AS long, '[' || n_chars || ',' || doc_id || ']' AS pages, '{"source":"' || source || '","n":' || doc_id || '}' AS origin, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '2020-01-01' END AS day FROM documents WHERE source IS NOT NULL
UNION ALL SELECT doc_id, coalesce(lang, ''), n_chars, n_chars > 500, '[' || n_chars || ',' || doc_id || ']', '{"n":' || doc_id || '}', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '2020-01-01' END FROM documents WHERE source IS NULL""")
def sanitised_metadata(spark, d):
    rows = docs(spark, d).select(
        "doc_id", "lang", "n_chars", (F.col("n_chars") > 500).alias("long"), F.array("n_chars", "doc_id").alias("pages"), F.struct("source", F.col("doc_id").alias("n")).alias("origin"),
        F.when(F.col("doc_id") % 2 == 1, F.lit("2020-01-01").cast("date")).alias("day"),
    )
    return M.sanitise(rows)


@query("""WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'a/doc.' || label || '.txt' WHEN vec_id % 3 = 1 THEN '' END AS filename, CASE WHEN vec_id % 3 = 1 THEN 'other' || label || '.pdf' END AS source_document, 'text ' || vec_id AS t FROM embeddings),
s AS (SELECT *, coalesce(nullif(filename, ''), nullif(source_document, ''), 'unknown_document') AS src FROM e)
SELECT 'c' || vec_id AS id, t AS document, src AS source_document, src AS filename, CAST(label AS INTEGER) AS chunk_index, 'Preamble / Document Header' AS section, 1 AS page_number, regexp_replace(regexp_extract(src, '([^/]+)$', 1), '(.)\\.[^.]+$', '\\1') AS document_id,
0 AS token_count, regexp_extract(src, '(\\.[^./]+)$', 1) AS file_type, 'token_aware' AS strategy, 1 AS total_chunks, '' AS relative_path, CAST(length(t) AS INTEGER) AS char_count FROM s""")
def index_records(spark, d):
    return _records(spark, d).drop("embedding")


def _records(spark, d):
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    rows = e.select(
        F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("text "), i.cast("string")).alias("source_text"), "embedding", F.col("label").alias("chunk_index"),
        F.when(i % 3 == 0, F.concat(F.lit("a/doc."), F.col("label").cast("string"), F.lit(".txt"))).when(i % 3 == 1, "").alias("filename"),
        F.when(i % 3 == 1, F.concat(F.lit("other"), F.col("label").cast("string"), F.lit(".pdf"))).alias("source_document"),
    )
    return M.index_record(rows, 64)


#: Chunks that stand at the hint, before it, in part, or nowhere.
_SPANS = """sp AS (SELECT doc_id, text AS t, substr(text, 41, 120) AS c, unnest([0, 1, 2, 3]) AS k FROM documents),
sq AS (SELECT doc_id, k, t, CASE k WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN left(c, 60) || '##' || substr(c, 61) ELSE '#nowhere#' END AS c, CASE k WHEN 1 THEN 100 ELSE 20 END AS hint FROM sp),
sr AS (SELECT *, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS cl, length(t) AS n, CASE WHEN strpos(substr(t, hint + 1), c) > 0 THEN strpos(substr(t, hint + 1), c) - 1 + hint ELSE -1 END AS h0, strpos(t, c) - 1 AS h1 FROM sq),
ss AS (SELECT *, left(cl, 50) AS hd, right(cl, 50) AS tl, greatest(0, hint - 200) AS lo FROM sr),
st AS (SELECT *, CASE WHEN strpos(substr(t, lo + 1), hd) > 0 THEN strpos(substr(t, lo + 1), hd) - 1 + lo ELSE strpos(t, hd) - 1 END AS b FROM ss),
su AS (SELECT *, CASE WHEN b >= 0 AND strpos(substr(t, b + 1), tl) > 0 THEN strpos(substr(t, b + 1), tl) - 1 + b ELSE -1 END AS l FROM st)"""


@query(f"""WITH {_SPANS} SELECT doc_id, k, CAST(CASE WHEN t = '' OR c = '' THEN 0 WHEN h0 >= 0 THEN h0 WHEN h1 >= 0 THEN h1 WHEN b >= 0 THEN b ELSE least(hint, n) END AS INTEGER) AS "start",
CAST(CASE WHEN t = '' OR c = '' THEN 0 WHEN h0 >= 0 THEN h0 + length(c) WHEN h1 >= 0 THEN h1 + length(c) WHEN b >= 0 AND l >= 0 THEN l + length(tl) WHEN b >= 0 THEN least(n, b + length(c)) ELSE least(least(hint, n) + length(c), n) END AS INTEGER) AS "end" FROM su""")
def chunk_spans(spark, d):
    c = F.substring("text", 41, 120)
    kinds = [(0, c, 20), (1, c, 100), (2, F.concat(F.substring(c, 1, 60), F.lit("##"), c.substr(F.lit(61), F.lit(120))), 20), (3, F.lit("#nowhere#"), 20)]
    forms = F.array(*(F.struct(F.lit(k).alias("k"), t.alias("c"), F.lit(h).alias("h")) for k, t, h in kinds))
    rows = docs(spark, d).select("doc_id", "text", F.explode(forms).alias("f"))
    return rows.select("doc_id", "f.k", M.find_span(F.col("text"), F.col("f.c"), F.col("f.h")).alias("s")).select("doc_id", "k", "s.start", "s.end")


@query(f"""WITH {_CC}, uf AS (SELECT doc_id, chunk_index, content, count(*) OVER (PARTITION BY doc_id) AS total, {_NW.format('content')} AS nw FROM cc)
SELECT doc_id, chunk_index, CAST(total AS INTEGER) AS total_chunks, CAST(length(content) AS INTEGER) AS char_count, {_EST.format(n='nw')} AS token_count, 1 AS page_number, 'document' AS filename, 'fixed' AS strategy, true AS slice_agrees FROM uf""")
def uniform_chunks(spark, d):
    """Fixed windows with all thirteen fields; the text at the span that was found is the chunk."""
    rows = M.with_provenance(H.chunk_chars(docs(spark, d), 300, 60), docs(spark, d).select("doc_id", "text"))
    cut = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    rows = rows.join(docs(spark, d).select("doc_id", "text"), "doc_id").withColumn("slice_agrees", cut == F.col("content"))
    return rows.select("doc_id", "chunk_index", "total_chunks", "char_count", "token_count", "page_number", "filename", "strategy", "slice_agrees")


#: Both chunkers' CTEs beside each other: those of the words get names of their own.
_BOTH = _CC + ", " + _CW.replace("s AS (SELECT", "ws AS (SELECT").replace("FROM s)", "FROM ws)").replace("e AS (SELECT", "we AS (SELECT").replace("FROM e)", "FROM we)")


@query(f"""WITH {_BOTH}, u AS (SELECT 'chars' AS strategy, content FROM cc UNION ALL SELECT 'words', content FROM cw), n AS (SELECT strategy, content, {_NW.format('content')} AS nw FROM u), t AS (SELECT strategy, content, {_EST.format(n='nw')} AS tc FROM n),
dn AS (SELECT {_NW.format("coalesce(text, '')")} AS nw FROM documents), o AS (SELECT sum({_EST.format(n='nw')}) AS own FROM dn), a AS (SELECT strategy, round(avg(tc), 1) AS m FROM t GROUP BY 1)
SELECT strategy, count(*) AS total_chunks, CAST(sum(length(content)) AS BIGINT) AS total_chars, CAST(sum(tc) AS BIGINT) AS total_tokens, round(avg(length(content)), 1) AS avg_chars, max(m) AS avg_tokens, CAST(min(tc) AS INTEGER) AS min_tokens, CAST(max(tc) AS INTEGER) AS max_tokens,
round(sqrt(avg((tc - m) * (tc - m))), 4) AS std_tokens, round(avg(CASE WHEN regexp_matches(regexp_replace(content, '\\s+$', ''), '[.?!:"'']$') THEN 1.0 ELSE 0.0 END) * 100, 2) AS sentence_end_pct, round((sum(tc) - max(own)) / max(own) * 100, 1) AS overlap_overhead_pct FROM t JOIN a USING (strategy), o GROUP BY strategy""")
def compare_strategies(spark, d):
    return H.compare_strategies(docs(spark, d), {"chars": H.chunk_chars(docs(spark, d), 300, 60), "words": H.chunk_words(docs(spark, d), 300, 50)})


@query(f"WITH {_CW} SELECT doc_id, replace(chunk_id, 'tokenaware', 'fixed') AS chunk_id, token_start, token_end, md5(content) AS digest FROM cw")
def chunk_fixed_tokens(spark, d):
    return H.chunk_fixed(docs(spark, d), 300, 50, "tokens").select("doc_id", "chunk_id", "token_start", "token_end", F.md5("content").alias("digest"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 100)
SELECT doc_id, CAST(n AS INTEGER) AS total_tokens, CAST(1 + ceil((n - 100) / 100) AS INTEGER) AS chunks_plain, CAST(1 + ceil((n - 100) / 75) AS INTEGER) AS chunks_overlapping, 25 AS shared_tokens,
contains(array_to_string(w[76:175], ' '), array_to_string(w[81:120], ' ')) AS boundary_intact FROM n""")
def boundary_preservation(spark, d):
    return H.boundary_preservation(docs(spark, d), 100, 25)


@query(f"""WITH {_CW}, n AS (SELECT doc_id, CAST(max(total_chunks) AS INTEGER) AS k FROM cw GROUP BY 1), g AS (SELECT * FROM n, (VALUES (8192), (4096)) a(w))
SELECT doc_id, CAST(w AS INTEGER) AS w, k, k * 300 AS retrieved, k * 300 + 1724 AS used, CAST(w - k * 300 - 1724 AS INTEGER) AS headroom, round((k * 300 + 1724) / w * 100, 1) AS utilisation_pct, round(50 / 250 * 100, 1) AS overhead_pct FROM g""")
def window_budget(spark, d):
    """What is left of two models' windows if all chunks of a document are retrieved."""
    whole = H.word_windows(docs(spark, d), 300, 50).filter("chunk_index = 0").select("doc_id", F.col("total_chunks").alias("k"), F.explode(F.array(F.lit(8192), F.lit(4096))).alias("w"))
    return whole.select("doc_id", "w", "k", H.window_budget(F.col("w"), F.lit(300), F.lit(50), F.col("k")).alias("b")).select("doc_id", "w", "k", "b.*")


_ACC = """ca AS (SELECT doc_id, list_extract(regexp_split_to_array(array_to_string(regexp_split_to_array(text, '\\s+')[1:9], ' '), '[.!?]\\s+'), -1) || '.' AS s1, lower(text) AS low FROM documents),
cm AS (SELECT doc_id, unnest(['[1]', '[9]']) AS marker, unnest(['it takes 6 hours to report this at all.', 'plain end']) AS claim, unnest([low, NULL]) AS low FROM ca),
cw2 AS (SELECT *, list_filter(regexp_split_to_array(claim, '\\s+'), lambda x: x <> '') AS w, regexp_extract_all(claim, '\\b[a-z0-9_\\-]{4,}\\b') AS k FROM cm),
cg AS (SELECT doc_id, marker, low IS NULL AS fab, coalesce(len(list_filter(range(1, len(w) - 1), lambda i: contains(low, array_to_string(w[i:i + 2], ' ')))) > 0 OR len(list_filter(k, lambda x: contains(low, x))) / greatest(1, len(k)) >= 0.4, false) AS good FROM cw2)"""


@query(f"""WITH {_ACC} SELECT doc_id AS answer_id, count(*) AS markers, count(*) FILTER (fab) AS fabricated, count(*) FILTER (good AND NOT fab) AS supported, round(count(*) FILTER (good AND NOT fab) / count(*), 6) AS citation_precision FROM cg GROUP BY 1""")
def citation_accuracy(spark, d):
    """Plain markers alone count, so that [2, Section 4] doesn't."""
    return rounded(E.citation_accuracy(made_answers(spark, d), made_registry(spark, d)), "citation_precision")


@query("""WITH q AS (SELECT vec_id AS query_id, label AS ql, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) DESC, vec_id) AS r FROM q JOIN embeddings ON query_id <> vec_id),
g AS (SELECT query_id, list(DISTINCT source) FILTER (source IS NOT NULL) AS got FROM p JOIN documents ON doc_id = id WHERE r <= 5 GROUP BY 1),
x AS (SELECT query_id, CASE WHEN query_id % 60 = 0 THEN [] WHEN query_id % 60 = 20 THEN ['web', 'news', 'books', 'code'] ELSE [d.source, 'nowhere'] END AS want FROM q LEFT JOIN documents d ON d.doc_id = query_id)
SELECT query_id, round(CASE WHEN len(want) > 0 THEN len(list_filter(want, lambda s: s IS NOT NULL AND list_contains(coalesce(got, []), s))) / len(want) WHEN len(coalesce(got, [])) = 0 THEN 1.0 ELSE 0.0 END, 6) AS source_recall FROM x LEFT JOIN g USING (query_id)""")
def source_recall(spark, d):
    from quarry.operators import retrieval as R

    own = docs(spark, d).select(F.col("doc_id").alias("id"), "source")
    hits = R.top_k(asks(spark, d).drop("query_label"), corpus(spark, d), 5, skip_own=True).join(own, "id").groupBy("query_id").agg(F.collect_set("source").alias("got"))
    rows = asks(spark, d).select("query_id").join(own.withColumnRenamed("id", "query_id"), "query_id", "left").join(hits, "query_id", "left")
    none = F.array().cast("array<string>")
    want = F.when(F.col("query_id") % 60 == 0, none).when(F.col("query_id") % 60 == 20, F.array(*map(F.lit, ("web", "news", "books", "code")))).otherwise(F.array("source", F.lit("nowhere")))
    return rounded(rows.select("query_id", E.source_recall(want, F.coalesce("got", none), F.lit(False)).alias("source_recall")), "source_recall")


@query("""WITH k AS (SELECT DISTINCT user_id AS key FROM events), gone AS (SELECT key FROM k WHERE key % 3 = 0) SELECT count(*) FILTER (key % 3 <> 0) AS kept, count(*) FILTER (key % 3 = 0) AS removed, 0::BIGINT AS after_clear FROM k""")
def cache_invalidate(spark, d):
    entries = requests(spark, d).select("key").distinct()
    kept, gone = U.invalidate(entries, entries.filter("key % 3 = 0"))
    none, _ = U.invalidate(entries)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(kept, "kept").crossJoin(F.broadcast(n(gone, "removed"))).crossJoin(F.broadcast(n(none, "after_clear")))  # a row each


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), u AS (SELECT * FROM h WHERE role = 'user')
SELECT u.conv_id, u.turn, md5('system:Answer.' || coalesce((SELECT string_agg('|' || p.role || ':' || p.text, '' ORDER BY p.turn) FROM h p WHERE p.conv_id = u.conv_id AND p.n BETWEEN u.n - 4 AND u.n - 1), '') || '|user:' || u.text) AS digest FROM u""")
def chat_messages(spark, d):
    rows = V.chat_messages(turns(spark, d), "Answer.", 4)
    return rows.select("conv_id", "turn", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("digest"))


@query("""SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS user_turns, md5(string_agg(role || ':' || trim(text), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def api_messages(spark, d):
    rows = V.api_messages(turns(spark, d))
    return rows.select("conv_id", "n_messages", "user_turns", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("digest"))


@query(f"""WITH x AS (SELECT conv_id, turn, trim(text) AS q, CASE WHEN turn % 4 = 0 THEN '' ELSE 'Rule ' || conv_id || ' holds' END AS c FROM conversations WHERE role = 'user'), y AS (SELECT *, {_NW.format('c')} AS nw FROM x)
SELECT conv_id, turn, c <> '' AS has_context, {_EST.format(n='nw')} AS context_tokens, md5(CASE WHEN c = '' THEN q ELSE 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || q END) AS digest FROM y""")
def user_messages(spark, d):
    context = F.when(F.col("turn") % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" Rule "), F.col("conv_id").cast("string"), F.lit(" holds ")))
    rows = turns(spark, d).filter("role = 'user'").select("conv_id", "turn", V.user_message(F.col("text"), context).alias("m"))
    return rows.select("conv_id", "turn", "m.has_context", "m.context_tokens", F.md5("m.content").alias("digest"))


@query("""SELECT 'c' || vec_id AS chunk_id, vec_id AS position, CASE WHEN vec_id % 3 = 0 THEN 'new' WHEN vec_id % 2 = 0 THEN 'cached' ELSE 'failed' END AS origin,
CASE WHEN vec_id % 3 = 0 OR vec_id % 2 = 0 THEN array_to_string(list_transform(embedding[1:8], lambda x: format('{:.4f}', CAST(x AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END)), ' ') END AS preview FROM embeddings""")
def merged_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("position"), F.col("embedding").cast("array<double>").alias("embedding"))
    twice = F.transform("embedding", lambda x: x * 2)
    out = I.merged_vectors(e, e.filter("position % 3 = 0"), e.filter("position % 2 = 0").withColumn("embedding", twice))
    head = F.transform(F.slice("embedding", 1, 8), lambda x: F.format_string("%.4f", x))
    return out.select("chunk_id", "position", "origin", F.array_join(head, " ").alias("preview"))


@query(f"""WITH {_CW}, pc AS (SELECT chunk_id, doc_id, token_end - token_start AS tc, row_number() OVER (PARTITION BY doc_id % 4 = 0 ORDER BY doc_id * 1000 + chunk_index, chunk_id) - 1 AS nth FROM cw)
SELECT CASE WHEN doc_id % 4 = 0 THEN 'SKIP' WHEN doc_id % 10 = 1 THEN 'FAILED' ELSE 'EMBED' END AS action, count(*) AS chunks, CAST(sum(tc) AS BIGINT) AS tokens, count(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN nth // 10 END) AS batches, round(sum(tc) / 1e6 * 0.02, 6) AS cost FROM pc GROUP BY 1""")
def embed_ledger_with_failures(spark, d):
    from quarry.plans.texts import _plan

    failed = H.word_windows(docs(spark, d), 300, 50).filter("doc_id % 10 = 1").select("chunk_id")
    return I.embedding_ledger(_plan(spark, d), failed=failed)


@query("""SELECT 'c' || vec_id AS id, vec_id % 11 <> 0 AS found, vec_id % 11 <> 0 AND vec_id % 7 <> 0 AS text_agrees, vec_id % 11 <> 0 AS dimension_agrees, vec_id % 11 <> 0 AND vec_id % 13 <> 0 AS vector_agrees,
vec_id % 11 <> 0 AND vec_id % 7 <> 0 AND vec_id % 13 <> 0 AS verified FROM embeddings""")
def collection_readback(spark, d):
    """A collection is created, records are added in batches, and what is stored is held against what should be: some rows are left out or altered on the way."""
    records = _records(spark, d)
    box = L.Collection.get_or_create(spark, fresh_folder(spark, "collection"), 64)
    number = F.substring("id", 2, 20).cast("long")
    turned = F.when(number % 13 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    written = records.filter(number % 11 != 0).withColumns({"document": F.when(number % 7 == 0, "else").otherwise(F.col("document")), "embedding": turned})
    box.add(written)
    return box.readback(records)


@query("""WITH e AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'doc.' || label WHEN vec_id % 3 = 1 THEN 'other' || label ELSE 'unknown_document' END AS doc, len(embedding) AS n, CASE WHEN vec_id % 3 = 0 THEN '.txt' WHEN vec_id % 3 = 1 THEN '.pdf' ELSE '' END AS ft FROM embeddings)
SELECT count(*) AS records, CAST(min(n) AS INTEGER) AS smallest, CAST(max(n) AS INTEGER) AS largest, min(n) = max(n) AS uniform, count(DISTINCT doc) AS documents, array_to_string(list_sort(list(DISTINCT ft)), ',') AS file_types FROM e""")
def vectors_verified(spark, d):
    return L.verify_vectors(_records(spark, d))


@query("""SELECT doc_id AS query_id, 'd' || doc_id AS id, left(text, 20) AS text, coalesce(source, lang) AS filename, 'S' || doc_id % 3 AS section, CAST(doc_id % 9 AS INTEGER) AS page_number, CAST(doc_id % 10 AS DOUBLE) / 10 AS score FROM documents""")
def normalised_registry(spark, d):
    i = F.col("doc_id")
    meta = F.struct(F.concat(F.lit("S"), (i % 3).cast("string")).alias("section"), (i % 9).alias("page"), F.col("lang").alias("source"))
    rows = docs(spark, d).select(i.alias("query_id"), F.concat(F.lit("d"), i.cast("string")).alias("chunk_id"), F.substring("text", 1, 20).alias("document"), F.col("source").alias("source_document"), ((i % 10).cast("double") / 10).alias("similarity_score"), meta.alias("metadata"))
    return C.normalised(rows)


@query("""SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(floor(abs(value) * 10) AS INTEGER)) AS BIGINT) AS prompt_tokens, max(event_id) AS last FROM events""")
def audit_round_trip(spark, d):
    """Requests appended as JSON Lines in two steps and read again."""
    rows = requests(spark, d).select(
        F.col("seq").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("q").alias("question"), "status", "prompt_tokens", "completion_tokens", F.col("latency").alias("latency_seconds"), "cache_hit"
    )
    path = fresh_folder(spark, "audit")
    S.append_audit(rows.filter("pmod(CAST(request_id AS BIGINT), 2) = 0"), path)
    S.append_audit(rows.filter("pmod(CAST(request_id AS BIGINT), 2) = 1"), path)
    back = S.read_audit(spark, path)
    return back.agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens"), F.max(F.col("request_id").cast("long")).alias("last"))


@query("""WITH u AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN lang || doc_id || '.exe' WHEN 2 THEN lang || '.MD' WHEN 3 THEN doc_id || '.tar.html' WHEN 4 THEN 'none' ELSE lang || '.txt' END AS name,
 CASE WHEN doc_id % 7 = 3 THEN 0 ELSE strlen(text) * CASE WHEN doc_id % 11 = 5 THEN 20000 ELSE 1 END END AS size, CAST(n_chars AS BIGINT) AS chunk, doc_id % 90 - 5 AS lap FROM documents)
SELECT doc_id, name, CASE WHEN trim(name) = '' THEN 'MISSING_NAME' WHEN NOT list_contains(['.txt', '.md', '.markdown', '.html', '.htm', '.pdf'], lower(regexp_extract(name, '(\\.[^.]+)$', 1))) THEN 'UNSUPPORTED_FORMAT' WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > 10485760 THEN 'TOO_LARGE'
 WHEN chunk < 50 OR chunk > 2000 THEN 'BAD_CHUNK_SIZE' WHEN lap < 0 OR lap >= chunk THEN 'BAD_OVERLAP' END AS problem FROM u""")
def upload_checks(spark, d):
    """Every document as an upload: its bytes are the size, its characters the chunk size asked for; names and overlaps follow from its id."""
    from quarry.sources.files import upload_problem

    i = F.col("doc_id")
    name = F.when(i % 6 == 0, " ").when(i % 6 == 1, F.concat("lang", i.cast("string"), F.lit(".exe"))).when(i % 6 == 2, F.concat("lang", F.lit(".MD"))).when(i % 6 == 3, F.concat(i.cast("string"), F.lit(".tar.html"))).when(i % 6 == 4, "none").otherwise(F.concat("lang", F.lit(".txt")))
    size = F.when(i % 7 == 3, 0).otherwise(F.octet_length("text") * F.when(i % 11 == 5, 20000).otherwise(1))
    rows = docs(spark, d).select("doc_id", name.alias("name"), size.alias("size"), (i % 90 - 5).alias("lap"), F.col("n_chars").alias("chunk"))
    return rows.select("doc_id", "name", upload_problem(F.col("name"), F.col("size"), F.col("chunk"), F.col("lap")).alias("problem"))


UPLOAD_DIMENSION = 64


@query()
def upload_to_searchable(spark, d):
    """The pages as uploaded files, streamed through checks, loading, cleaning, chunking and embedding into a keyed table that is searched at once: every twentieth page's first chunk has to find a record with its text."""
    index = UploadIndex(spark, fresh_folder(spark, "upload-index"), I.hashing_embedder(UPLOAD_DIMENSION), UPLOAD_DIMENSION)
    pages = SU.read_events(spark, f"{d}/pages.parquet", f"{d}/pages.parque[t]")  # a glob, since the table may be one file
    uploads = pages.select(F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    index.stream(uploads, fresh_folder(spark, "upload-checkpoint")).awaitTermination()
    records = index.records.read()
    asked = records.filter("chunk_index = 0 AND pmod(CAST(regexp_extract(filename, '([0-9]+)', 1) AS BIGINT), 20) = 0").select("filename", F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("document").alias("said"))
    hits = index.search(asked, 1, carry=("said",)).select("query_id", (F.col("document") == F.col("said")).alias("found"))
    found = asked.select("filename", "query_id").join(hits, "query_id", "left").select("filename", F.coalesce("found", F.lit(False)).alias("found"))
    return index.ledger.read().join(found, "filename", "left")
