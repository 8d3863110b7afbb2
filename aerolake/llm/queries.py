"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chaining, chat, collocations, credentials, exact, infill, packing, pii, quality, simhash, suffix, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(tables.union(tricky)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_lost", "chars_lost"]
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents")).drop("removed")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def _span_digests(found: DataFrame, *kinds: str) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find(_table(spark, sf_dir, "documents")), "email", "ip", "card", "phone")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(_table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(credentials.find(_table(spark, sf_dir, "documents")), "assign", "access", "hex")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_repeats": op4_repeats,
    "op5_urls": op5_urls,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_passages": op10_passages,
    "op11_infill": op11_infill,
    "op12_secrets": op12_secrets,
    "op13_phrases": op13_phrases,
}

_CHAT_SQL = """
    with c as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'
    ),
    f as (
        select *, length('<turn>### :' || chr(10) || '</turn>' || chr(10)) + length(regexp_replace(role, '([\\\\<#:])', '\\\\\\1', 'g'))
            + length(regexp_replace(text, '([\\\\<#])', '\\\\\\1', 'g')) as n from c
    )
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        sum(n)::bigint as formatted_chars
    from f group by conv_id"""

ORACLE_SQL = {
    "op2_chat": _CHAT_SQL,
    "op3_quality": quality.oracle(),
    "op5_urls": urls.oracle(),
    "op11_infill": infill.oracle(),
    "op13_phrases": collocations.oracle(),
    "op6_exact_dedup": """
        with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(g.t) as text_sha256
        from documents d join g on coalesce(d.text, '') = g.t""",
}
