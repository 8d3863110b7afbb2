"""A training corpus from documents: quality rules, exact dedup, near dedup, personal data, packing.

Every stage takes and, but for packing, returns the columns of `docs`, of whatever other names. A null text
counts as empty and stays null where it stays; rows without a doc_id are documents of their own and come after
all others; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import common, exact, packing, pii, quality, simhash


def _key() -> Column:
    """doc_id, its lack a number of its own."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of those that stay, the lines that fail go.

    Each row is judged by itself, repeated rows alike; a null or empty text is rejected. The row travels
    in one column, so no name of the rules meets one of its own.
    The filter also looks at the partition's number, which is not deterministic and always passes:
    the optimizer then doesn't move it below the measures and evaluate all of them anew.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = quality.judge(row).withColumn("part", F.spark_partition_id()).where(F.col("kept") & (F.col("part") >= 0))
    clean = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[clean.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once; rows that repeat are one; texts that share a doc_id differ and stay."""
    key, sha = _free(docs, "id"), _free(docs, "sha")
    found = exact.duplicates(docs).where("kept")
    kept = found.select(_key().alias(key), F.col("text_sha256").alias(sha)).distinct()
    keyed = docs.withColumns({key: _key(), sha: F.sha2(F.coalesce("text", F.lit("")), 256)})
    return keyed.join(kept, [key, sha], "left_semi").dropDuplicates([key, sha]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word shingle similarity of 0.8 or more the one with the smallest doc_id stays.

    Texts of equal words count as one, and of several with that doc_id one stays; so do the empty ones. A text
    that only shares the doc_id of another is judged by itself.
    """
    key, node = _free(docs, "id"), _free(docs, "node")
    found = simhash.near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("keep_node")))
    kept = found.select(_key().alias(key), F.col("node").alias(node)).distinct()
    keyed = docs.withColumns({key: _key(), node: simhash.node(F.col("text"))})
    return keyed.join(kept, [key, node], "left_semi").dropDuplicates([key, node]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the label of its kind; every row stays, a null text null."""
    columns = docs.columns
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of fixed capacity, one row per piece of a document; a null or empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", pack),
]

#: Packing and near dedup have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again, and gone once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        given, docs = docs, common.persist(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if n:
            common.discard(given)
    return STAGES[-1][1](spark, docs, sf_dir)
