"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, chat, decontaminate, exact_dedup, html_text, secrets, simhash, token_store, toxicity, url_filter
from quarry.llm.common import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary file of the public tokenizers is."""
    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_url_rules, op4_secrets, op5_html_text, op6_bpe, op7_token_store, op8_simhash, op9_decontaminate, op10_chat)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_url_rules": r"""
        WITH rules(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                              ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parsed AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        each AS (SELECT page_id, host, path, action, rh || rp AS rule,
                        row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, action DESC) AS k
                 FROM parsed LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM each WHERE k = 1""",
    "op10_chat": r"""
        WITH placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
        whole AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY n) AS turns FROM placed GROUP BY conv_id),
        once AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM whole GROUP BY turns),
        inner_prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM once)),
        maximal AS (SELECT * FROM once WHERE turns NOT IN (SELECT turns FROM inner_prefixes))
        SELECT conv_id, CAST(0 AS INTEGER) AS part, len(turns) AS n_turns, copies,
               list_aggregate(list_transform(turns, lambda t: '<|im_start|>' || coalesce(t.role, 'user') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
        FROM maximal""",
}
