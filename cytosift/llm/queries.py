"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, encode, exact_dedup, langid, near_dup, packing, sharding, token_counts, tokens, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_slots(_table(spark, sf_dir, "documents"), 24)


def op3_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.read_back(chat.format_packs(rows, *vocabulary), *vocabulary)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.captures(spark, path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the ranks are the vocabulary of byte_bpe_50k.json; with that file's added token they give the ids of the tokenizers library
    added = tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end=2, added=added)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_kd_topk": op3_kd_topk,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_near_dup": op5_near_dup,
    "op6_token_counts": op6_token_counts,
    "op7_chat_tree": op7_chat_tree,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_kd_topk": """
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op5_near_dup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END) AS s FROM w),
        c AS (SELECT doc_id, count(*) AS n, bit_xor(hash(s)) AS x, sum(hash(s)) AS y FROM s GROUP BY doc_id),
        reps AS (SELECT min(doc_id) AS rep, n FROM c GROUP BY n, x, y),
        rs AS (SELECT rep, n, hash(s) AS h FROM s JOIN reps ON s.doc_id = rep),
        rare AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY df, h) AS k FROM (SELECT *, count(*) OVER (PARTITION BY h) AS df FROM rs)),
        prefix AS (SELECT rep, n, h FROM rare WHERE df > 1 AND k <= n - ceil(n * 0.8) + 1),
        near AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.h = b.h AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        links AS (SELECT a, b FROM near JOIN rs x ON x.rep = a JOIN rs y ON y.rep = b AND x.h = y.h GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
        both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT rep, rep AS other FROM reps UNION SELECT r.rep, e.b FROM reach r JOIN both_ e ON r.other = e.a),
        root AS (SELECT rep, min(other) AS root FROM reach GROUP BY rep),
        label AS (SELECT c.doc_id, c.n, root FROM c JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, x, y) AS rep FROM c) m USING (doc_id) JOIN root USING (rep))
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
        FROM documents d LEFT JOIN label USING (doc_id)""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT *, [('0x' || substr(h, 1 + 10 * i, 10))::BIGINT FOR i IN range(4)] AS v FROM p)
        SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((v[1 + k // 8] >> (35 - 5 * (k % 8))) & 31))::INT, 1) FOR k IN range(32)], '') AS payload_digest,
            CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
        FROM b WINDOW g AS (PARTITION BY h)""",
    "op7_chat_tree": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, length(replace(replace(replace(replace(replace(role || chr(1) || text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) - 1 AS escaped
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(escaped + length('<s>[INST] ' || ' [/INST]' || chr(10) || '</s>'))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
