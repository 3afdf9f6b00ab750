"""One query for each operator of this folder, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import block_naming, bloom_lookup, config_packing, context_pii, conversation_repair, noisy_or, padded_bpe, periodic_runs, sampled_splitters, segment_language, sentencepiece_backend, simhash_pivots, token_counts
from ._common import Workspace, read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    cache = Workspace(spark, "token-cache").path("counts")
    return token_counts.count_tokens(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op2_segment_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_language.identify_languages(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy_or.find_toxicity(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lookup.compare_with_edits(spark, read_table(spark, sf_dir, "documents"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.simhash_dedup(spark, read_table(spark, sf_dir, "documents"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_splitters.shard_by_bytes(spark, read_table(spark, sf_dir, "documents"), shards=8)


def op7_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_pii.find_personal_data(spark, read_table(spark, sf_dir, "documents"))


def op8_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_sentencepiece_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.encode_and_check(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(spark, read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(read_table(spark, sf_dir, "documents"))


def op12_padded_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return padded_bpe.encode_and_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(spark, conversation_repair.damage(read_table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_segment_language, op3_noisy_or, op4_bloom_lookup, op5_simhash_pivots, op6_sampled_splitters, op7_context_pii, op8_config_packing, op9_sentencepiece_backend, op10_exact_dedup,
        op11_periodic_runs, op12_padded_bpe, op13_conversation_repair,
    )
}

ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # One row a conversation walks its rows with the cheapest (cost, audit, lines) for each state of the grammar.
    "op13_conversation_repair": """
        WITH RECURSIVE marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
                       lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fault
            FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM marked WHERE fault <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
        judged AS (
            SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
            FROM placed),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id),
        walk AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]} AS n, NULL::STRUCT(c BIGINT, a VARCHAR, l VARCHAR[]) AS s,
                   {'c': 2::BIGINT, 'a': 'I', 'l': ['user:']} AS u, {'c': 4::BIGINT, 'a': 'II', 'l': ['user:', 'assistant:']} AS a
            FROM conversations
            UNION ALL
            SELECT conv_id, i, n, s,
                   list_min([w.u0, {'c': a0.c + 2, 'a': a0.a || 'I', 'l': list_append(a0.l, 'user:')}, {'c': n.c + 2, 'a': n.a || 'I', 'l': list_append(n.l, 'user:')}, {'c': s.c + 2, 'a': s.a || 'I', 'l': list_append(s.l, 'user:')}]),
                   list_min([w.a0, {'c': u0.c + 2, 'a': u0.a || 'I', 'l': list_append(u0.l, 'assistant:')},
                             {'c': n.c + 4, 'a': n.a || 'II', 'l': n.l || ['user:', 'assistant:']}, {'c': s.c + 4, 'a': s.a || 'II', 'l': s.l || ['user:', 'assistant:']}])
            FROM (
                SELECT w.conv_id, w.i + 1 AS i, {'c': n.c + 3, 'a': n.a || 'D', 'l': n.l} AS n,
                       list_min([{'c': s.c + 3, 'a': s.a || 'D', 'l': s.l}, CASE WHEN k AND r.c = 's' THEN {'c': n.c + t, 'a': n.a || 'K', 'l': list_append(n.l, own)} END]) AS s,
                       list_min([{'c': u.c + 3, 'a': u.a || 'D', 'l': u.l},
                                 CASE WHEN k THEN {'c': n.c + t + e.u, 'a': n.a || e.ul, 'l': list_append(n.l, e.ut)} END,
                                 CASE WHEN k THEN {'c': s.c + t + e.u, 'a': s.a || e.ul, 'l': list_append(s.l, e.ut)} END,
                                 CASE WHEN k THEN {'c': a.c + t + e.u, 'a': a.a || e.ul, 'l': list_append(a.l, e.ut)} END]) AS u0,
                       list_min([{'c': a.c + 3, 'a': a.a || 'D', 'l': a.l}, CASE WHEN k THEN {'c': u.c + t + e.a, 'a': u.a || e.al, 'l': list_append(u.l, e.at)} END]) AS a0
                FROM walk AS w JOIN (
                    SELECT conv_id, i, c, fault NOT IN ('blank', 'duplicate') AS k, (fault = 'truncated')::BIGINT AS t, role || ':' || text AS own,
                           {'u': CASE c WHEN 'u' THEN 0 ELSE 2 END, 'ul': CASE c WHEN 'u' THEN 'K' ELSE 'R' END, 'ut': CASE c WHEN 'u' THEN role ELSE 'user' END || ':' || text,
                            'a': CASE c WHEN 'a' THEN 0 ELSE 2 END, 'al': CASE c WHEN 'a' THEN 'K' ELSE 'R' END, 'at': CASE c WHEN 'a' THEN role ELSE 'assistant' END || ':' || text} AS e
                    FROM judged) AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1) AS w),
        ended AS (
            SELECT w.conv_id, list_min([w.n, w.a]) AS best, c.*
            FROM walk AS w LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0))
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.l, chr(10))) AS repaired_sha256
        FROM ended""",
}
