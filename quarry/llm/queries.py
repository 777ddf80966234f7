"""The thin queries opN_<name> of the operators, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bestfit import pack_best_fit
from quarry.llm.language import identify_languages
from quarry.llm.licenses import label_rows, scan_licenses
from quarry.llm.mixing import mix_sources
from quarry.llm.negatives import mine_hard_negatives
from quarry.llm.neighbours import near_vectors
from quarry.llm.packing import pack_along_curve
from quarry.llm.repair import damage, digests_of_all
from quarry.llm.repeats import repeat_digests
from quarry.llm.sharding import shard_by_bytes
from quarry.llm.shingles import jaccard_components
from quarry.llm.topk import exact_top_k
from quarry.llm.warc import archive_pages

TOKENIZER_FILE = "byte_bpe_50k.json"
WORD_TOKENIZER_FILE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(file: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


def op1_warc_capture_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive_pages(_table(spark, sf_dir, "pages"), min_payload=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_rank")


def op2_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=16)


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), max_repetition=4.0, target_entropy=0.97)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_place")


def op4_hnsw_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_count_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), percent=80, size=5)


def op6_license_template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_rows(scan_licenses(_table(spark, sf_dir, "documents"), threshold=0.8))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_along_curve(_table(spark, sf_dir, "documents"), tokenizer_path(), length=1024, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    found = identify_languages(docs)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(_table(spark, sf_dir, "documents"), length=400, keep="none")


def op11_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=5, low=80, high=100, scale=256)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_best_fit(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER_FILE), capacity=2048, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return digests_of_all(damage(turns), turns)


_QUERIES = (
    op1_warc_capture_archive,
    op2_byte_balanced_shards,
    op3_temperature_mixing,
    op4_hnsw_near_vectors,
    op5_count_tree_jaccard,
    op6_license_template_join,
    op7_hilbert_packing,
    op8_segment_top_k,
    op9_kneser_ney_language,
    op10_suffix_repeats,
    op11_ball_tree_negatives,
    op12_best_fit_packing,
    op13_conversation_repair,
)

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(hex, {5 * k + 1}, 5) AS BIGINT) // {32 ** (3 - j)}) % 32, 1)"
    for k in range(8)
    for j in range(4)
)

def _crc_table() -> list[int]:
    """The 256 remainders of the CRC-32 polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


_CRC32 = f"xor(4294967295, list_reduce(list_transform(hex, lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor({_crc_table()}[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8), 4294967295))"

_SQL = {
    "op1_warc_capture_archive": f"""
        WITH h AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/?#]*)', 1) AS host, regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS rest FROM pages),
        u AS (SELECT page_id, CASE WHEN host = '' THEN '' ELSE lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' WHEN left(rest, 1) = '?' THEN '/' || rest ELSE rest END) END AS url_key FROM h),
        r AS (SELECT page_id, url_key, row_number() OVER (ORDER BY CAST(url_key AS BLOB), page_id % 1000000000, page_id) - 1 AS capture_rank FROM u),
        f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, url_key, capture_rank
        FROM h JOIN f USING (hex) JOIN r USING (page_id)""",
    "op2_byte_balanced_shards": f"""
        WITH h AS (SELECT doc_id, text, coalesce(sha1(text), '') AS grp, strlen(coalesce(text, '')) + 1 AS size,
                regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS hex FROM documents),
        g AS (SELECT grp, min(doc_id) AS lead, sum(size) AS held FROM h GROUP BY grp),
        o AS (SELECT doc_id, size, hex, grp, held, sum(size) OVER w - size / 2 AS middle, sum(size) OVER () AS total, row_number() OVER w - 1 AS i
              FROM h JOIN g USING (grp) WINDOW w AS (ORDER BY lead, grp, doc_id, size)),
        c AS (SELECT *, least(15, CAST(floor(middle * 16 / total) AS INTEGER)) AS cut FROM o),
        m AS (SELECT *, CASE WHEN count(*) OVER p > 1 AND held <= 0.01 * total / 16 AND min(cut) OVER p <> max(cut) OVER p
              THEN least(15, CAST(floor((min(middle) OVER p + max(middle) OVER p) / 2 * 16 / total) AS INTEGER)) ELSE cut END AS shard FROM c WINDOW p AS (PARTITION BY grp))
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({_CRC32} AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(i - min(i) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM m""",
    "op4_hnsw_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        r(u, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.c = l.u),
        k AS (SELECT u, min(c) AS component_id FROM r GROUP BY u),
        n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings e JOIN k ON k.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
    "op5_count_tree_jaccard": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        h AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
        l AS (SELECT x AS u, y AS v FROM h UNION ALL SELECT y, x FROM h),
        r(u, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.c = l.u),
        k AS (SELECT u, min(c) AS component_id FROM r GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d JOIN k ON k.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_segment_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_ball_tree_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.l = b.l AS same, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w) WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT * FROM n WHERE rank <= 5""",
    "op13_conversation_repair": f"""
        WITH RECURSIVE h AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..') AS hex FROM conversations),
        c AS (SELECT *, CAST({_CRC32} AS BIGINT) % 20 AS fault FROM h),
        m AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                     CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE fault <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS i FROM m),
        f AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                     CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
        p AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay,
                     CASE WHEN initial = 'u' THEN 0 ELSE 1 END AS as_u, CASE WHEN initial = 'a' THEN 0 ELSE 1 END AS as_a, CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END AS as_s FROM f),
        d(conv_id, i, t, s, u, a) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'l': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'l': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'l': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'l': ''}} FROM f
            UNION ALL
            SELECT p.conv_id, p.i, {{'c': t.c + 2, 'l': t.l || 'D'}},
                   list_sort([{{'c': s.c + 2, 'l': s.l || 'D'}}, {{'c': t.c + stay + as_s, 'l': t.l || 'K'}}])[1],
                   list_sort([{{'c': u.c + 2, 'l': u.l || 'D'}}, {{'c': t.c + stay + as_u, 'l': t.l || ['K', 'R'][as_u + 1]}}, {{'c': s.c + stay + as_u, 'l': s.l || ['K', 'R'][as_u + 1]}},
                              {{'c': u.c + 5 + stay + as_u, 'l': u.l || 'I' || ['K', 'R'][as_u + 1]}}, {{'c': a.c + stay + as_u, 'l': a.l || ['K', 'R'][as_u + 1]}}])[1],
                   list_sort([{{'c': a.c + 2, 'l': a.l || 'D'}}, {{'c': t.c + 5 + stay + as_a, 'l': t.l || 'I' || ['K', 'R'][as_a + 1]}}, {{'c': s.c + 5 + stay + as_a, 'l': s.l || 'I' || ['K', 'R'][as_a + 1]}},
                              {{'c': u.c + stay + as_a, 'l': u.l || ['K', 'R'][as_a + 1]}}, {{'c': a.c + 5 + stay + as_a, 'l': a.l || 'I' || ['K', 'R'][as_a + 1]}}])[1]
            FROM d JOIN p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i + 1),
        e AS (SELECT conv_id, list_sort([t, {{'c': s.c + 10, 'l': s.l || 'II'}}, {{'c': u.c + 5, 'l': u.l || 'I'}}, a])[1] AS best FROM d QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
        k AS (SELECT conv_id, best.c AS cost, best.l AS audit, unnest(range(1, len(best.l) + 1)) AS pos FROM e),
        l AS (SELECT *, substr(audit, pos, 1) AS letter, len(replace(left(audit, pos), 'I', '')) AS i, len(replace(left(audit, pos), 'D', '')) - len(replace(audit, 'D', '')) % 2 AS place FROM k),
        r AS (SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired
              FROM l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = greatest(l.i, 1) WHERE letter <> 'D' GROUP BY l.conv_id),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.c, 0) AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id
        LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
