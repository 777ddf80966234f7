"""Packing, citation, grounding, usage, conversation, JSON and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.cleaning import preview, word_count
from quarry.operators import citations as C
from quarry.operators import context as P
from quarry.operators import conversation as V
from quarry.operators import evaluation as E
from quarry.operators import jsonfix as J
from quarry.operators import usage as U
from quarry.operators.chunking import estimated_tokens
from quarry.operators.ledger import StageLedger
from quarry.plans.registry import query, table
from quarry.plans.retrieval import rounded
from quarry.plans.texts import candidates
from quarry.session import fresh_folder
from quarry.streaming import answers as SA
from quarry.streaming import usage as SU


def _hits(spark, d) -> DataFrame:
    return candidates(spark, d, 5).withColumn("token_count", estimated_tokens(F.col("text")))


_V = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, v) DESC, id) AS INTEGER) AS rank FROM q JOIN c ON query_id <> id),
nw AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
h AS (SELECT query_id, rank, id, text, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(floor(n * 1.3) AS INTEGER)) END AS tk FROM r JOIN nw ON nw.doc_id = r.id WHERE rank <= 5)"""


@query(f"""WITH {_V}, u AS (SELECT *, sum(tk) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM h), o AS (SELECT *, max(CASE WHEN used > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS ov FROM u)
SELECT query_id, rank, id, tk AS token_count, CAST(used AS BIGINT) AS used FROM o WHERE rank = 1 OR ov = 0""")
def pack_stop(spark, d):
    return P.pack_until_full(_hits(spark, d), 1500).select("query_id", "rank", "id", "token_count", "used")


_GREEDY = f"""WITH RECURSIVE {_V}, pw AS (SELECT h.*, nw.n AS words FROM h JOIN nw ON nw.doc_id = h.id),
pk(query_id, rank, used, dropped, cut, packed) AS (SELECT DISTINCT query_id, 0, 0, 0, false, CAST([] AS VARCHAR[]) FROM pw
 UNION ALL SELECT query_id, pw.rank, CASE WHEN tk <= 1500 - used THEN used + tk WHEN 1500 - used > 60 AND NOT cut THEN used + greatest(1, CAST(floor(least(words, greatest(10, (1500 - used) // 2)) * 1.3) AS INTEGER)) ELSE used END,
 dropped + CASE WHEN tk <= 1500 - used OR (1500 - used > 60 AND NOT cut) THEN 0 ELSE 1 END, cut OR tk > 1500 - used,
 CASE WHEN tk <= 1500 - used THEN list_append(packed, '{{"id":' || pw.id || ',"tokens":' || tk || ',"truncated":false}}')
  WHEN 1500 - used > 60 AND NOT cut THEN list_append(packed, '{{"id":' || pw.id || ',"tokens":' || greatest(1, CAST(floor(least(words, greatest(10, (1500 - used) // 2)) * 1.3) AS INTEGER)) || ',"truncated":true}}') ELSE packed END
 FROM pk JOIN pw USING (query_id) WHERE pw.rank = (SELECT min(x.rank) FROM pw x WHERE x.query_id = pk.query_id AND x.rank > pk.rank))
SELECT query_id, CAST(used AS INTEGER) AS used, CAST(dropped AS INTEGER) AS dropped, cut AS truncated, '[' || array_to_string(packed, ',') || ']' AS packed FROM pk WHERE rank = (SELECT max(x.rank) FROM pw x WHERE x.query_id = pk.query_id)"""


@query(_GREEDY)
def pack_greedy(spark, d):
    out = P.pack_greedy(_hits(spark, d), 1500)
    return out.select("query_id", "used", "dropped", "truncated", F.to_json("packed").alias("packed"))


_PARTS = f"""WITH RECURSIVE {_V}, pw AS (SELECT h.*, nw.n AS words, list_filter(regexp_split_to_array(h.text, '\\s+'), lambda x: x <> '') AS w FROM h JOIN nw ON nw.doc_id = h.id),
pk(query_id, rank, id, used, cut, status, tokens, kept) AS (SELECT DISTINCT query_id, 0, CAST(NULL AS BIGINT), 0, false, '', 0, '' FROM pw
 UNION ALL SELECT query_id, pw.rank, pw.id, CASE WHEN tk <= 1500 - used THEN used + tk WHEN 1500 - used > 60 AND NOT cut THEN used + greatest(1, CAST(floor(least(words, greatest(10, (1500 - used) // 2)) * 1.3) AS INTEGER)) ELSE used END, cut OR tk > 1500 - used,
 CASE WHEN tk <= 1500 - used THEN 'included' WHEN 1500 - used > 60 AND NOT cut THEN 'cut' ELSE 'dropped' END,
 CASE WHEN tk <= 1500 - used THEN tk WHEN 1500 - used > 60 AND NOT cut THEN greatest(1, CAST(floor(least(words, greatest(10, (1500 - used) // 2)) * 1.3) AS INTEGER)) ELSE 0 END,
 CASE WHEN tk <= 1500 - used THEN text WHEN 1500 - used > 60 AND NOT cut THEN array_to_string(w[1:greatest(10, (1500 - used) // 2)], ' ') ELSE '' END
 FROM pk JOIN pw USING (query_id) WHERE pw.rank = (SELECT min(x.rank) FROM pw x WHERE x.query_id = pk.query_id AND x.rank > pk.rank))
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, status, CAST(tokens AS INTEGER) AS tokens, CAST(used AS INTEGER) AS used, md5(kept) AS digest FROM pk WHERE rank > 0"""


@query(_PARTS)
def pack_parts(spark, d):
    """The packing's ledger: every part with what became of it, and the text that went in."""
    return P.pack_parts(_hits(spark, d), 1500).select("query_id", "rank", "id", "status", "tokens", "used", F.md5("text").alias("digest"))


@query("SELECT doc_id, 'Question: ' || left(text, 40) || chr(10) || 'Source: ' || source || ' (' || lang || ')' AS prompt, greatest(0, least(2048 - 100 - length(left(text, 40)) - 450 - 50, 1500)) AS budget FROM documents")
def prompt_render(spark, d):
    docs = table(spark, d, "documents")
    q = F.substring("text", 1, 40)
    prompt = P.render("Question: {q}\nSource: {source} ({lang})", {"q": q, "source": F.col("source"), "lang": F.col("lang")})
    return docs.select("doc_id", prompt.alias("prompt"), P.available_budget(F.lit(2048), F.lit(100), F.length(q), cap=1500).alias("budget"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 220 THEN left(t, 220) || '...' ELSE t END AS excerpt FROM f""")
def source_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", preview(F.col("text"), 220).alias("excerpt"))


#: Answers are made from documents: a sentence of their own, one of another document, and one whose marker nothing has.
def made_answers(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    first = F.array_join(F.slice(F.split("text", r"\s+"), 1, 9), " ")
    text = F.concat(first, F.lit(". [1] It takes 6 hours to report this at all. [2, Section 4] Nothing like that was said. [9] Plain end"))
    return docs.select(F.col("doc_id").alias("answer_id"), text.alias("answer"), F.col("text").alias("context"))


def made_registry(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    one = docs.select(F.col("doc_id").alias("answer_id"), F.lit("[1]").alias("marker"), F.lit(1).alias("rank"), F.col("source").alias("filename"), F.col("doc_id").alias("id"), "text")
    two = one.withColumns({"marker": F.lit("[2]"), "rank": F.lit(2), "id": F.col("id") + 1_000_000, "text": F.lit("Entities report within 6 hours.")})
    return one.unionByName(two)


@query("""WITH a AS (SELECT doc_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:9], ' ') AS f FROM documents)
SELECT doc_id AS answer_id, len(regexp_extract_all(f || '. [1] It takes 6 hours to report this at all. [2, Section 4] Nothing like that was said. [9] Plain end', '\\[(?:\\d+|[\\w.\\-]+\\.(?:pdf|txt|md|html|json))[^\\]]*\\]')) AS markers FROM a""")
def citation_extract(spark, d):
    """Markers of three sentences each; what stands in the documents' own words is kept free of markers by their alphabet."""
    return C.extract_claims(made_answers(spark, d)).groupBy("answer_id").agg(F.count("*").alias("markers"))


#: The made answer's claim with its three markers, held against both registry texts. Letters beyond ASCII become a capital, which bounds words but is in none.
_LETTERS = "'[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]', 'Z', 'g'"
#: The first of the longest runs of eight to three words.
_RUN = "coalesce(" + ", ".join(f"list_filter(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')), lambda x: contains(run, ' ' || x || ' '))[1]" for n in C.RUNS) + ")"
_CLAIM = f"""a AS (SELECT doc_id, text, list_extract(regexp_split_to_array(array_to_string(regexp_split_to_array(text, '\\s+')[1:9], ' '), '[.!?]\\s+'), -1) || '. [1] It takes 6 hours to report this at all. [2, Section 4] Nothing like that was said. [9] Plain end' AS claim FROM documents),
b AS (SELECT *, regexp_replace(lower(trim(regexp_replace(claim, '\\[[^\\]]+\\]', '', 'g'))), {_LETTERS}) AS c FROM a),
k AS (SELECT *, list_filter(regexp_extract_all(c, '\\b[a-z0-9_\\-]{{3,}}\\b'), lambda w: NOT list_contains({C.WEAK!r}, w)) AS keys, regexp_extract_all(c, '{C.NUMBER}') AS nums, regexp_extract_all(c, '\\b[a-z0-9_\\-]+\\b') AS w FROM b),
m AS (SELECT doc_id, claim, keys, nums, w, unnest([0, 1, 2]) AS marker_no, unnest(['[1]', '[2]', '[9]']) AS marker, unnest([lower(text), 'entities report within 6 hours.', NULL]) AS low FROM k),
r AS (SELECT *, len(list_filter(keys, lambda x: contains(low, x))) / greatest(1, len(keys)) AS ratio,
 ' ' || array_to_string(regexp_extract_all(regexp_replace(low, {_LETTERS}), '\\b[a-z0-9_\\-]+\\b'), ' ') || ' ' AS run FROM m),
v AS (SELECT *, (ratio >= 0.35 AND len(list_filter(nums, lambda x: NOT contains(low, x))) = 0) OR len(list_filter(nums, lambda x: contains(low, x))) > 0
 OR len(list_filter(range(1, len(w) - 1), lambda i: contains(run, ' ' || array_to_string(w[i:i + 2], ' ') || ' '))) > 0 AS ok FROM r),
sp AS (SELECT *, {_RUN} AS span FROM v),
s AS (SELECT doc_id AS answer_id, 0 AS claim_no, claim, CAST(marker_no AS INTEGER) AS marker_no, marker, CASE WHEN low IS NULL THEN 'FABRICATED_MARKER' WHEN ok THEN 'VERIFIED' WHEN ratio >= 0.25 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status,
 round(CASE WHEN low IS NULL THEN 0.0 WHEN ok THEN least(1.0, ratio + 0.3) ELSE ratio END, 6) AS confidence,
 span, CASE WHEN span IS NOT NULL THEN CAST(len(string_split(span, ' ')) AS INTEGER) END AS span_words, CASE WHEN span IS NOT NULL THEN CAST(length(left(run, strpos(run, ' ' || span || ' ') - 1)) - length(replace(left(run, strpos(run, ' ' || span || ' ') - 1), ' ', '')) AS INTEGER) END AS span_at FROM sp)"""


@query(f"""WITH {_CLAIM} SELECT answer_id, count(*) AS citations, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'FABRICATED_MARKER') AS fabricated, count(*) FILTER (status IN ('UNSUPPORTED', 'FABRICATED_MARKER')) AS unsupported,
round(count(*) FILTER (status = 'VERIFIED') / count(*), 6) AS citation_precision, CASE WHEN count(*) FILTER (status = 'FABRICATED_MARKER') > 0 THEN 'REJECTED' WHEN count(*) FILTER (status = 'UNSUPPORTED') > 0 THEN 'FLAGGED' ELSE 'PASS' END AS verdict FROM s GROUP BY answer_id""")
def citation_audit(spark, d):
    answers = made_answers(spark, d)
    verified = C.verify(C.resolve(C.extract_claims(answers), made_registry(spark, d)))
    return rounded(C.audit(answers, verified), "citation_precision")


@query(f"WITH {_CLAIM} SELECT * FROM s")
def citation_claims(spark, d):
    verified = C.verify(C.resolve(C.extract_claims(made_answers(spark, d)), made_registry(spark, d)))
    return rounded(verified, "confidence")


@query("""SELECT doc_id AS answer_id, 1 AS claims, CASE WHEN contains(lower(text), '6 hours') THEN 1 ELSE 0 END AS supported, CASE WHEN contains(lower(text), '6 hours') THEN 1.0 ELSE 0.0 END AS fidelity, contains(lower(text), '6 hours') AS grounded FROM documents""")
def source_accuracy(spark, d):
    return made_answers(spark, d).select("answer_id", C.source_accuracy(F.col("answer"), F.col("context"), F.lit("")).alias("s")).select("answer_id", "s.*")


_GROUND = f"""ga AS (SELECT doc_id, lower(text) AS low, array_to_string(regexp_split_to_array(text, '\\s+')[1:9], ' ') || '. [1] It takes 6 hours to report this at all. [2, Section 4] Nothing like that was said. [9] Plain end' AS answer FROM documents),
gs AS (SELECT *, list_transform(list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\\[[^\\]]+\\]', '', 'g'))), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) >= 4), lambda x: lower(x)) AS said FROM ga),
gt AS (SELECT doc_id, low, unnest(said) AS one FROM gs),
gw AS (SELECT doc_id, low, list_filter(regexp_extract_all(regexp_replace(one, {_LETTERS}), '\\b[a-z0-9_\\-]{{4,}}\\b'), lambda x: NOT list_contains({E.WEAK_KEYWORDS!r}, x)) AS w, regexp_extract_all(regexp_replace(one, {_LETTERS}), '\\b\\d+\\s*(?:hours?|days?|business days?|years?|months?|%|percent)?\\b') AS nums, list_filter(regexp_split_to_array(one, '\\s+'), lambda y: y <> '') AS p FROM gt),
gg AS (SELECT doc_id, (len(list_filter(w, lambda x: contains(low, x))) / greatest(1, len(w)) >= 0.35 AND len(list_filter(nums, lambda x: NOT contains(low, x))) = 0) OR len(list_filter(range(1, len(p) - 1), lambda i: contains(low, array_to_string(p[i:i + 2], ' ')))) > 0 AS ok FROM gw),
gr AS (SELECT ga.doc_id AS answer_id, CASE WHEN contains(lower(answer), 'insufficient information') THEN 1.0 WHEN low = '' THEN 0.0 ELSE coalesce(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 1.0) END AS grounding FROM ga LEFT JOIN gg USING (doc_id) GROUP BY ga.doc_id, answer, low)"""


@query(f"WITH {_GROUND} SELECT answer_id, round(grounding, 6) AS grounding FROM gr")
def grounding(spark, d):
    return rounded(made_answers(spark, d).select("answer_id", E.grounding(F.col("answer"), F.col("context")).alias("grounding")), "grounding")


_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')"


@query(f"""WITH x AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '') AS w, [substr(text, 1, 12), substr(text, 3, 12), 'no such fact anywhere', left(text, 6) || '#'] AS facts FROM documents),
y AS (SELECT doc_id, text, len(w) AS n, len(facts) AS f, len(list_filter(facts, lambda f: contains(lower(text), lower(f)) OR contains({_BARE.format('text')}, trim({_BARE.format('f')})))) AS met FROM x)
SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN CASE WHEN len(list_filter({E.REFUSALS!r}, lambda p: contains(lower(text), p))) > 0 THEN 1.0 ELSE 0.0 END
 ELSE least(1.0, met / greatest(1, f) * 0.85 + CASE WHEN n < 15 AND f > 2 THEN 0.0 ELSE 0.15 END) END, 6) AS correctness FROM y""")
def correctness(spark, d):
    """Facts: two that stand in the text, one that doesn't, one that does without its last character."""
    docs = table(spark, d, "documents")
    facts = F.array(F.substring("text", 1, 12), F.substring("text", 3, 12), F.lit("no such fact anywhere"), F.concat(F.substring("text", 1, 6), F.lit("#")))
    return rounded(docs.select("doc_id", E.correctness(F.col("text"), facts, F.col("doc_id") % 5 != 0).alias("correctness")), "correctness")


@query()
def answer_verdicts(spark, d):
    made = made_answers(spark, d).withColumns({"c": F.lit(0.8), "g": E.grounding(F.col("answer"), F.col("context")), "p": F.lit(2 / 3), "refused": E.is_refusal(F.col("answer")), "answerable": F.col("answer_id") % 7 != 0})
    made = made.select("answer_id", "answerable", "refused", "c", "g", "p")
    rows = made.withColumn("v", E.answer_verdict(F.col("c"), F.col("g"), F.col("p"), F.lit(1.0), F.col("answerable"), F.col("refused")))
    rows = rows.select("answer_id", "answerable", "refused", F.col("c").alias("correctness"), F.col("g").alias("grounding"), "v.overall", "v.verdict")
    return rounded(E.answer_summary(rows), "pass_rate", "overall", "correctness", "grounding", "safe_refusals").withColumn("failures", F.to_json("failures"))


_REQ = """rq AS (SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, CAST(floor(abs(value) * 10) AS INTEGER) AS pt, CAST(floor(abs(value) * 3) AS INTEGER) AS ct, abs(value) / 10 AS latency,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS hit FROM events),
au AS (SELECT *, round(pt / 1e6 * 0.20 + ct / 1e6 * 0.80, 6) AS cost FROM rq)"""


def requests(spark, d) -> DataFrame:
    """Events as requests: a user's first one is a miss."""
    ev = table(spark, d, "events")
    keyed = ev.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "ts", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.floor(F.abs("value") * 10).cast("int").alias("prompt_tokens"), F.floor(F.abs("value") * 3).cast("int").alias("completion_tokens"), (F.abs("value") / 10).alias("latency"),
    )
    return U.simulate_ttl(keyed, 0).withColumn("cache_hit", F.col("outcome") == "HIT")


def _audit(spark, d):
    return U.audit_records(requests(spark, d).withColumn("answer", F.lit("answer")))


@query(f"""WITH {_REQ}, s AS (SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (status = 'error') AS errors, CAST(sum(pt + ct) AS BIGINT) AS tokens, round(sum(CASE WHEN hit THEN 0 ELSE cost END), 6) AS cost, round(sum(CASE WHEN hit THEN cost ELSE 0 END), 6) AS saved,
round(avg(latency), 4) AS avg_latency, round(avg(latency) FILTER (hit), 4) AS avg_hit_latency, round(avg(latency) FILTER (NOT hit), 4) AS avg_miss_latency FROM au)
SELECT *, round(hits / requests * 100, 2) AS hit_rate_pct, CASE WHEN avg_miss_latency > 0 THEN round((avg_miss_latency - avg_hit_latency) / avg_miss_latency * 100, 2) ELSE 0.0 END AS latency_reduction_pct FROM s""")
def usage_summary(spark, d):
    return U.usage_summary(_audit(spark, d))


@query(f"WITH {_REQ} SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (hit) AS hits, CAST(sum(pt + ct) AS BIGINT) AS tokens, round(sum(CASE WHEN hit THEN 0 ELSE cost END), 6) AS cost FROM au GROUP BY 1")
def hourly_timeline(spark, d):
    return U.timeline(_audit(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f"WITH {_REQ} SELECT status, count(*) AS n FROM au GROUP BY 1")
def status_breakdown(spark, d):
    return _audit(spark, d).groupBy("status").agg(F.count("*").alias("n"))


_JSON = "array_to_string(list_transform(string_split(q, ''), lambda c: CASE WHEN c = '\\' THEN '\\\\' WHEN unicode(c) < 128 THEN c ELSE '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') END), '')"


@query(f"""WITH h AS (SELECT doc_id, lower(trim(regexp_replace(replace(text, '"', ''), '\\s+', ' ', 'g'))) AS q FROM documents)
SELECT doc_id, substr(sha256('{{"f": "", "k": 3, "m": "gpt-x", "q": "' || {_JSON} || '"}}'), 1, 24) AS key FROM h""")
def cache_key(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", U.cache_key(F.replace(F.col("text"), F.lit('"'), F.lit("")), F.lit(3), F.lit("GPT-x "), F.lit(None).cast("string")).alias("key"))


@query(f"""WITH {_REQ} SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, 0::BIGINT AS expirations, round(count(*) FILTER (hit) / count(*) * 100, 2) AS hit_rate_pct FROM au""")
def cache_simulation(spark, d):
    return U.cache_statistics(requests(spark, d))


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS seq, user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(key, seq, n, born, outcome) AS (SELECT key, seq, n, ts, 'MISS' FROM e WHERE n = 1
 UNION ALL SELECT e.key, e.seq, e.n, CASE WHEN epoch_us(e.ts) - epoch_us(f.born) > 3600000000 THEN e.ts ELSE f.born END, CASE WHEN epoch_us(e.ts) - epoch_us(f.born) > 3600000000 THEN 'EXPIRED' ELSE 'HIT' END
 FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1) SELECT seq, key, outcome FROM f""")
def cache_simulation_ttl(spark, d):
    return U.simulate_ttl(requests(spark, d).select("seq", "key", "ts"), 3600).select("seq", "key", "outcome")


@query()
def cache_simulation_lru(spark, d):
    return U.simulate_lru(requests(spark, d).select("seq", "key", "ts"), 50, 3600).select("seq", "key", "outcome", "evicted")


@query(f"""WITH {_REQ}, tiers(tier, a, b) AS (VALUES ('premium', 2.50, 10.00), ('economy', 0.15, 0.60), ('balanced', 3.00, 15.00)), vol(volume) AS (VALUES (1000::BIGINT), (100000::BIGINT)),
g AS (SELECT avg(pt) AS p, avg(ct) AS c FROM rq) SELECT tier, volume, round((round(p, 2) / 1e6 * a + round(c, 2) / 1e6 * b) * volume, 6) AS projected_cost FROM g, tiers, vol""")
def cost_projection(spark, d):
    mean = requests(spark, d).agg(F.round(F.avg("prompt_tokens"), 2).alias("prompt_tokens"), F.round(F.avg("completion_tokens"), 2).alias("completion_tokens"))
    return U.cost_projection(mean, [1000, 100000]).select("tier", "volume", "projected_cost")


@query("""WITH n AS (SELECT doc_id, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents), t AS (SELECT *, CASE WHEN w = 0 THEN 0 ELSE greatest(1, CAST(floor(w * 1.3) AS INTEGER)) END AS k FROM n)
SELECT doc_id, CAST(chars AS INTEGER) AS chars, CAST(w AS INTEGER) AS words, k AS tokens, CASE WHEN k > 0 THEN round(chars / k, 2) ELSE 0.0 END AS chars_per_token, CASE WHEN w > 0 THEN round(k / w, 2) ELSE 0.0 END AS tokens_per_word FROM t""")
def token_profile(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", U.token_profile(text, estimated_tokens(text), word_count(text)).alias("p")).select("doc_id", "p.*")


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role FROM x WHERE n <= 3")
def recent_turns(spark, d):
    return V.recent_turns(turns(spark, d), 3).select("conv_id", "turn", "role")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM conversations)
SELECT conv_id, array_to_string(list('Turn ' || turn || ':' || chr(10) || CASE WHEN role = 'user' THEN 'User: ' || text ELSE 'Assistant: ' || CASE WHEN length(f) > 250 THEN left(f, 247) || '...' ELSE f END END ORDER BY turn), chr(10)) AS history FROM x WHERE n <= 4 GROUP BY conv_id""")
def history_text(spark, d):
    return V.history_text(turns(spark, d), 4)


_TK = """tw AS (SELECT *, 4 + CASE WHEN role = '' THEN 0 ELSE 1 END + CASE WHEN nw = 0 THEN 0 ELSE greatest(1, CAST(floor(nw * 1.3) AS INTEGER)) END AS tokens FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS nw FROM conversations)),
tt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS dn, sum(tokens) OVER (PARTITION BY conv_id) + 3 AS total, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail, first_value(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM tw)"""


@query(f"WITH {_TK} SELECT conv_id, turn, CAST(tokens AS INTEGER) AS tokens FROM tw")
def message_tokens(spark, d):
    return turns(spark, d).select("conv_id", "turn", V.message_tokens(F.col("role"), F.col("text")).alias("tokens"))


@query(f"WITH {_TK} SELECT conv_id, turn, CAST(tokens AS INTEGER) AS tokens, up = 1 OR dn = 1 OR total <= 150 OR tail + head + 3 <= 150 AS kept FROM tt")
def trim_history(spark, d):
    return V.trim(turns(spark, d), 150).select("conv_id", "turn", "tokens", "kept")


@query(f"""WITH {_TK} SELECT conv_id, count(*) AS compressed_turns, '[PREVIOUS TURNS SUMMARY: ' || coalesce(array_to_string(list(trim(left(text, 60)) ORDER BY turn) FILTER (role = 'user'), '; '), '') || ']' AS summary FROM tt WHERE total > 150 AND up > 1 AND dn > 1 GROUP BY conv_id""")
def summarise_history(spark, d):
    return V.summarise(turns(spark, d), 150)


_CUE = "[" + ", ".join(f"'{w}'" for w in V.CUE_WORDS) + "]"
_CUES = f"(list_has_any(regexp_extract_all(lower(text), '\\b[a-z0-9_\\-]+\\b'), {_CUE}) OR " + " OR ".join(f"contains(lower(text), '{p}')" for p in V.CUE_PHRASES) + ")"


@query(f"SELECT conv_id, turn, {_CUES} AS cues FROM conversations")
def followup_cues(spark, d):
    return turns(spark, d).select("conv_id", "turn", V.has_cues(F.col("text")).alias("cues"))


@query(f"""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user'), x AS (SELECT *, p IS NOT NULL AND {_CUES} AS f FROM u)
SELECT conv_id, turn, f AS is_follow_up, md5(CASE WHEN f THEN text || ' regarding ' || left(p, 50) ELSE text END) AS digest FROM x""")
def rewritten_queries(spark, d):
    return V.rewrite(turns(spark, d)).select("conv_id", "turn", "is_follow_up", F.md5("rewritten").alias("digest"))


def raw_outputs(spark, d) -> DataFrame:
    """Model outputs of eight shapes around each document's source."""
    k = F.col("doc_id") % 8
    good = F.concat(F.lit('{"answer": "a '), F.col("doc_id").cast("string"), F.lit('", "source": "'), F.col("source"), F.lit('"}'))
    raw = (
        F.when(k == 0, good).when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), good, F.lit(" - done")))
        .when(k == 3, F.replace(good, F.lit("}"), F.lit(",}"))).when(k == 4, F.replace(good, F.lit('"'), F.lit("'")))
        .when(k == 5, F.lit("no json at all")).when(k == 6, F.replace(good, F.lit("answer"), F.lit("summary"))).otherwise(F.lit('{"answer": "x", "confidence": "sure"}'))
    )
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'markdown_fence_extraction' WHEN 2 THEN 'regex_bracket_extraction' WHEN 3 THEN 'syntax_normalization_repair' WHEN 4 THEN 'syntax_normalization_repair' WHEN 5 THEN 'syntax_repair_failed' ELSE 'direct_json_loads' END AS strategy,
doc_id % 8 <> 5 AS success, doc_id % 8 IN (1, 2, 3, 4) AS repaired FROM documents""")
def json_repair(spark, d):
    return J.parse(raw_outputs(spark, d)).select("doc_id", "strategy", "success", "repaired")


@query("""SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN 'RECOVERED' WHEN doc_id % 8 IN (5, 7) THEN 'INVALID' ELSE 'VALID' END AS status, CASE WHEN doc_id % 8 = 5 THEN NULL WHEN doc_id % 8 = 7 THEN 'x' ELSE 'a ' || doc_id END AS answer,
CASE doc_id % 8 WHEN 5 THEN 'answer,source' WHEN 7 THEN 'source' ELSE '' END AS missing, CASE WHEN doc_id % 8 = 7 THEN 'MEDIUM' END AS confidence FROM documents""")
def json_validate(spark, d):
    out = J.validate(J.parse(raw_outputs(spark, d)))
    return out.select("doc_id", "status", F.col("field_answer").alias("answer"), F.array_join("missing_fields", ",").alias("missing"), "confidence")


def _answers(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("answer"))


@query("SELECT doc_id AS request_id, md5(text) AS digest, CAST(len(string_split(text, ' ')) AS INTEGER) AS tokens, 'COMPLETE' AS status FROM documents")
def stream_token_fold(spark, d):
    """Events written as files, read as a stream, folded by request with state."""
    folder = fresh_folder(spark, "token-events")
    SA.replay(_answers(spark, d)).write.parquet(folder)
    folded = SU.run_to_end(SA.fold_stream(SU.read_events(spark, folder), timeout_ms=0), "append")
    return folded.select("request_id", F.md5("answer").alias("digest"), "tokens", "status")


@query("SELECT doc_id AS request_id, md5(text) AS digest, CAST(len(string_split(text, ' ')) AS INTEGER) AS tokens, 'COMPLETE' AS status FROM documents")
def token_fold(spark, d):
    return SA.fold(SA.replay(_answers(spark, d))).select("request_id", F.md5("answer").alias("digest"), "tokens", "status")


@query(f"""WITH {_CLAIM}, au AS (SELECT answer_id, count(*) AS citations, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'FABRICATED_MARKER') AS fabricated, count(*) FILTER (status IN ('UNSUPPORTED', 'FABRICATED_MARKER')) AS unsupported,
round(count(*) FILTER (status = 'VERIFIED') / count(*), 6) AS citation_precision, CASE WHEN count(*) FILTER (status = 'FABRICATED_MARKER') > 0 THEN 'REJECTED' WHEN count(*) FILTER (status = 'UNSUPPORTED') > 0 THEN 'FLAGGED' ELSE 'PASS' END AS verdict FROM s GROUP BY answer_id)
SELECT au.*, 'COMPLETE' AS status, CAST(len(string_split(array_to_string(regexp_split_to_array(text, '\\s+')[1:9], ' ') || '. [1] It takes 6 hours to report this at all. [2, Section 4] Nothing like that was said. [9] Plain end', ' ')) AS INTEGER) AS tokens, fabricated > 0 AS has_fabricated, false AS is_fallback FROM au JOIN documents ON doc_id = answer_id""")
def stream_citation_audit(spark, d):
    """Cited answers of all documents as events in files, every seventh event twice, read as a stream; each is audited against the sources that came first, once it is whole."""
    folder = fresh_folder(spark, "cited-events")
    registry = made_registry(spark, d).withColumnRenamed("answer_id", "request_id")
    events = SA.replay_cited(made_answers(spark, d).select(F.col("answer_id").alias("request_id"), "answer"), registry)
    times = F.when(F.pmod(F.xxhash64("request_id", "seq"), F.lit(7)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    events.withColumn("time", F.explode(times)).drop("time").repartition(F.xxhash64("request_id", "seq")).write.parquet(f"{folder}/in")
    SA.audited_answers(SU.read_events(spark, f"{folder}/in", batches=8), folder, timeout_ms=0).awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/audits").drop("batch"), "citation_precision")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, d):
    events = SU.read_events(spark, f"{d}/events.parquet", f"{d}/events.parque[t]")  # a glob, since the table may be one file
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return SU.run_to_end(SU.hourly(events)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query()
def question_runs(spark, d):
    """Retrieval, gate, packing, a stand-in generator and the citation audit in one plan."""
    return rounded(_run(spark, d), "citation_precision")


_STAGES = f"""WITH {_V}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT h.*, list_cosine_similarity(a.v, b.v) AS score FROM h JOIN e a ON a.vec_id = h.query_id JOIN e b ON b.vec_id = h.id WHERE h.query_id IN (SELECT doc_id FROM documents)),
g AS (SELECT query_id, max(score) AS top, count(*) FILTER (score >= 0.3) AS good FROM t GROUP BY 1),
w AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, sum(tk) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM t JOIN g USING (query_id) WHERE score >= 0.3 AND top >= 0.3 AND good >= 1),
p AS (SELECT * FROM w WHERE rank = 1 OR used <= 1500)
SELECT 'retrieve' AS stage, count(*) AS rows, CAST(sum(tk) AS BIGINT) AS tokens, true AS timed FROM t UNION ALL SELECT 'gate', count(*), CAST(sum(tk) AS BIGINT), true FROM w
UNION ALL SELECT 'pack', count(*), CAST(sum(tk) AS BIGINT), true FROM p"""


@query(_STAGES)
def stage_ledger(spark, d):
    """Rows and tokens of the first stages of question_runs, observed while they run; seconds are measured, so only that there are any is compared."""
    ledger = StageLedger()
    _run(spark, d, ledger)
    rows = ledger.rows(spark).filter("stage IN ('retrieve', 'gate', 'pack')")
    return rows.select("stage", "rows", "tokens", (F.col("latency_seconds") > 0).alias("timed"))


def _run(spark, d, ledger=None):
    from quarry.operators.pipeline import answer_questions, extractive_generator
    from quarry.plans.retrieval import asks, corpus
    from quarry.plans.texts import question_texts

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_document"))
    rows = corpus(spark, d).join(docs.select("id"), "id", "left_semi").select("id", "vec", F.col("label").cast("string").alias("section"), F.lit(1).alias("page_number"))
    questions = asks(spark, d).join(question_texts(spark, d).withColumnRenamed("query_text", "question"), "query_id")
    return answer_questions(questions, rows, extractive_generator, k=5, min_similarity=0.3, skip_own=True, ledger=ledger, texts=docs)
