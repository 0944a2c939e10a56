"""The operators of this subpackage applied to whole tables, and SQL for what SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, html_text, jaccard, licenses, pii, quality, toxicity, urls

URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)
URL_PARAMS = urls.Params(URL_RULES)
#: Tools whose calls are checked; others take any object.
TOOL_SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_PARAMS)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(table(spark, sf_dir, "conversations"), TOOL_SCHEMAS)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_chat_formatting,
        op3_ngram_jaccard,
        op4_license_scans,
        op5_quality_rules,
        op6_decontamination,
        op7_toxicity,
        op8_pii,
        op9_bpe,
        op10_html_extraction,
    )
}


def url_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1: host, path and rule, and the verdicts of rules."""
    found = urls.parsed(table(spark, sf_dir, "pages"), URL_PARAMS)
    return found.select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"))


def quality_counts_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op5: the counts and the base rules."""
    counts = quality.counted(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


QUERIES |= {f.__name__: f for f in (url_rules_base, quality_counts_base)}


def _rule_sql() -> tuple[str, str]:
    """The longest rule first, so that the first CASE that fits is the answer."""
    ordered = sorted(URL_RULES, key=lambda r: (-len(r.text), r.text))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN" for r in ordered]
    return tuple("CASE " + " ".join(f"{f} '{what(r)}'" for f, r in zip(fits, ordered, strict=True)) + " END" for what in (lambda r: r.text, lambda r: r.verdict))


_RULE, _VERDICT = _rule_sql()
ORACLES: dict[str, str] = {
    "url_rules_base": f"""SELECT page_id, host, path, {_RULE} AS rule, {_VERDICT} AS verdict FROM (SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages))""",
    "quality_counts_base": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
        p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w),
        g AS (SELECT doc_id, i, x || chr(1) || lead(x, 1) OVER o || chr(1) || lead(x, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
        c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
        b AS (SELECT doc_id, len(ws) AS n_words, length(list_aggregate(ws, 'string_agg', '')) AS chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM w)
        SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN c USING (doc_id)""",
}
