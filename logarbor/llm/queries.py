"""The check queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logarbor.llm import (bpe_chunks, hard_negatives, lz_fingerprint, packing, perspectives, pii, simhash, spelling,
                          token_counts, topk, toxicity, warc_fixity, window_dedup)
from logarbor.llm.tools import table, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a damaged replica: some records altered, cut short, lost, or added."""
    pages = table(spark, sf_dir, "pages")
    bad_html = (F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("~"), F.col("html")))
                .when(F.col("page_id") % 103 == 7, F.substring("html", 1, 40)).otherwise(F.col("html")))
    # the replica's records keep their places; what they hold is hashed from its own bytes, in the row of the page
    both = written(warc_fixity.index(pages.withColumn("bad", bad_html), held="bad"))
    good = both.drop("held")
    lost = (F.col("page_id") % 101).eqNullSafe(F.lit(11))
    copy = both.where(~lost).select("archive", "page_id", "offset", "length", F.col("held").alias("digest"))
    added = good.where(F.col("page_id") % 107 == 13).select(
        "archive", "page_id", (F.col("offset") + 1).alias("offset"), "length", "digest")
    archives, damages = warc_fixity.audit(good, copy.unionByName(added))
    return archives.join(damages, "archive", "left").select(
        "archive", "root_a", "root_b", "offset", "page_id", "length", "kind")


def op2_lz_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return packing.pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32",
                                              "sequence_id", "offset", "bins", "bound")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, each_row=True)


def op5_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")

    # evidence from the words near an entity, in one document or more; marks in all documents that hold the entity
    found = pii.find_spans(table(spark, sf_dir, "documents"), everywhere=True, support=1)
    return found.select("doc_id", *(count(k) for k in range(pii.BASE_KINDS)), F.sha2(pii.span_text("base"), 256).alias("base_sha256"),
                        pii.span_text("spans").alias("spans"))


def op9_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_chunks.encode(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_frequency_vector_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op13_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_fixity": op1_merkle_fixity,
    "op2_lz_phrases": op2_lz_phrases,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_nb_ngram_toxicity": op5_nb_ngram_toxicity,
    "op6_trie_token_counts": op6_trie_token_counts,
    "op7_perspective_rotation": op7_perspective_rotation,
    "op8_pii_disclosure": op8_pii_disclosure,
    "op9_bpe_chunk_reuse": op9_bpe_chunk_reuse,
    "op10_simhash_vantage_point": op10_simhash_vantage_point,
    "op11_count_min_substrings": op11_count_min_substrings,
    "op12_frequency_vector_trie": op12_frequency_vector_trie,
    "op13_angular_hard_negatives": op13_angular_hard_negatives,
}

_TREE = """
{x}_leaf AS (
    SELECT archive, "offset" // 65536 AS leaf,
           sha256(string_agg("offset" || ':' || digest, ',' ORDER BY "offset", digest)) AS h
    FROM {x} GROUP BY ALL
), {x}_inner AS (
    SELECT archive, leaf // 16 AS n, sha256(string_agg(leaf || ':' || h, ',' ORDER BY leaf)) AS h
    FROM {x}_leaf GROUP BY ALL
), {x}_root AS (
    SELECT archive, sha256(string_agg(n || ':' || h, ',' ORDER BY n)) AS h FROM {x}_inner GROUP BY archive
)"""

ORACLE: dict[str, str] = {
    "op1_merkle_fixity": """
WITH page AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), bodies AS (
    SELECT *, CASE WHEN page_id % 97 = 5 THEN '~' || html WHEN page_id % 103 = 7 THEN substr(html, 1, 40)
              ELSE html END AS bad FROM page
), records AS (
    SELECT page_id,
        'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
        || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
        || html || chr(13) || chr(10) || chr(13) || chr(10) AS good,
        'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
        || chr(13) || chr(10) || 'Content-Length: ' || strlen(bad) || chr(13) || chr(10) || chr(13) || chr(10)
        || bad || chr(13) || chr(10) || chr(13) || chr(10) AS bad
    FROM bodies
), hashed AS (
    SELECT page_id, strlen(good) AS length, sha256(good) AS good, sha256(bad) AS bad FROM records
), dealt AS (
    SELECT *, coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1 - CAST('0x' || substr(good, 1, 2) AS BIGINT)) AS archive
    FROM hashed
), placed AS (
    SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, good
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM dealt
), a AS (
    SELECT archive, page_id, "offset", length, good AS digest FROM placed
), b AS (
    SELECT archive, page_id, "offset", length, bad AS digest FROM placed WHERE (page_id % 101) IS DISTINCT FROM 11
    UNION ALL
    SELECT archive, page_id, "offset" + 1, length, good FROM placed WHERE page_id % 107 = 13
), """ + _TREE.format(x="a") + "," + _TREE.format(x="b") + """, damage AS (
    SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a."offset", b."offset") AS "offset",
           coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.length, b.length) AS length,
           CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'altered' END AS kind
    FROM a FULL JOIN b ON a.archive = b.archive AND a."offset" = b."offset"
    WHERE a.digest IS DISTINCT FROM b.digest
)
SELECT coalesce(x.archive, y.archive) AS archive, x.h AS root_a, y.h AS root_b, d."offset", d.page_id,
       d.length, d.kind
FROM a_root x FULL JOIN b_root y ON x.archive = y.archive
LEFT JOIN damage d ON d.archive = coalesce(x.archive, y.archive)""",
    "op7_perspective_rotation": """
WITH m AS (
    SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
           replace(coalesce(text, ''), '<|', '< |') AS text, CASE WHEN turn IS NULL THEN r ELSE 0 END AS copy
    FROM (SELECT *, row_number() OVER () AS r FROM conversations)
), p AS (
    SELECT DISTINCT conv_id, role AS participant FROM m WHERE role <> 'system'
), parts AS (
    SELECT m.conv_id, participant, CAST(floor(turn / 64) AS BIGINT) AS segment, turn, role, text,
        '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant'
            ELSE 'user name=' || regexp_replace(role, '[[:space:]]+', '_', 'g') END || chr(10) AS head,
        text || '<|im_end|>' || chr(10) AS body, CAST(role = participant AS INTEGER) AS own,
        CAST((row_number() OVER (PARTITION BY m.conv_id, participant, floor(turn / 64)
                                 ORDER BY turn, role, text) - 1) // 4096 AS BIGINT) AS part
    FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
)
SELECT conv_id, participant, segment, part, count(*) AS n_messages,
       CAST(sum(own) AS BIGINT) AS n_own,
       string_agg(head || body, '' ORDER BY turn, role, text) AS text,
       string_agg(length(head) || ':0,' || length(body) || ':' || own, ',' ORDER BY turn, role, text) AS mask
FROM parts GROUP BY conv_id, participant, segment, part""",
    "op4_exact_top_k": """
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM kept q JOIN kept c ON c.r <> q.r
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_angular_hard_negatives": """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, * FROM (
        SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
), scored AS (
    SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = x.label AS same, x.vec_id,
           coalesce(CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
    FROM kept a JOIN kept x ON x.r <> a.r
    WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS p FROM scored WHERE same
), negative AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
           s.score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.ar, p.p ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM positive p JOIN scored s ON s.ar = p.ar
    WHERE p.p <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5""",
}
