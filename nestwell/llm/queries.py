"""Thin queries over the test tables: one for each operator, with production parameters and no limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.secret_scan import report, scan_secrets

    return report(scan_secrets(_table(spark, sf_dir, "documents")))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.token_store import open_store, verify_store

    return verify_store(open_store(spark, _table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.pii import find_pii, report

    return report(find_pii(_table(spark, sf_dir, "documents")))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.near_dedup import link_near

    return link_near(_table(spark, sf_dir, "documents"), threshold=0.8, size=4)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.decontaminate import decontaminate, report

    return report(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nestwell.llm.chat import ANSWER, TOOLS, as_calls, format_chat

    return format_chat(as_calls(_table(spark, sf_dir, "conversations")), tools=TOOLS | ANSWER, per_call=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secret_scan,
        "op2_token_counts": token_counts,
        "op3_token_store": token_store,
        "op4_packing": packing,
        "op5_pii": pii,
        "op6_exact_dedup": exact_dedup,
        "op7_near_dedup": near_dedup,
        "op8_decontamination": decontamination,
        "op9_quality": quality,
        "op10_chat_format": chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256, false AS in_history
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "op8_decontamination": r"""
            WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
            i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
            iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
                   FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 10 + 2))) AS k FROM i WHERE len(w) > 0)),
            sizes AS (SELECT DISTINCT size FROM iw),
            dw AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
                   FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
            hit AS (SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
            cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id),
            its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
        "op10_chat_format": """
            WITH t AS (SELECT conv_id, turn, lower(coalesce(role, 'unknown')) AS role, coalesce(text, '') AS text FROM conversations),
            a AS (SELECT t.conv_id, t.turn, t.text, u.text AS asked, 'answer-' || t.turn AS id,
                         t.turn // 2 - row_number() OVER (PARTITION BY t.conv_id, t.turn % 2 ORDER BY t.turn) AS run
                  FROM t LEFT JOIN t u ON u.conv_id = t.conv_id AND u.turn = t.turn - 1 AND u.role = 'user' WHERE t.role = 'assistant'),
            c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM a)
            SELECT conv_id, turn * 2 AS turn, -1 AS part, 'message' AS kind, NULL AS call_id, NULL AS name, -1 AS level, 'plain' AS status, '' AS errors,
                   CASE WHEN role = 'assistant' THEN '{"role":"assistant"}' ELSE json_object('content', text, 'role', role)::VARCHAR END AS json FROM t
            UNION ALL SELECT conv_id, turn * 2, 0, 'call', id, 'answer', level, 'linked', CASE WHEN asked IS NULL THEN 'missing:question' ELSE '' END,
                   json_object('arguments', CASE WHEN asked IS NULL THEN json_object('turn', turn) ELSE json_object('question', asked, 'turn', turn) END, 'id', id, 'name', 'answer', 'result', text)::VARCHAR FROM c
            UNION ALL SELECT conv_id, turn * 2 + 1, 0, 'result', id, NULL, NULL, 'linked', '', json_object('content', text, 'tool_call_id', id)::VARCHAR FROM c""",
    }
