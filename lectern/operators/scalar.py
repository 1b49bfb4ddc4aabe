"""Scalar functions and small aggregates over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F


def content_hash(col):
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 16)


def heading_key(col):
    """Lower case, every run of other characters one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def progress_percent(done, total):
    return F.when(total > 0, F.least(F.lit(100), F.floor(100.0 * done / total + 0.5).cast("int"))).otherwise(0)


def f_content_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


def f_heading_key(spark, sf_dir):
    first = F.substring_index("text", "\n", 1)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", heading_key(first).alias("heading_key"))


def w1_nonspace_prefix(spark, sf_dir):
    """Non-space characters of the conversation before each turn."""
    from pyspark.sql import Window

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = F.length(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("")))
    return turns.select("conv_id", "turn", F.coalesce(F.sum(own).over(before), F.lit(0)).cast("long").alias("chars_before"))


QUERIES = {"f_content_hash": f_content_hash, "f_heading_key": f_heading_key, "w1_nonspace_prefix": w1_nonspace_prefix}

ORACLE_SQL = {
    "f_content_hash": "select doc_id, substring(sha256(text), 1, 16) as content_hash from documents",
    "f_heading_key": "select doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) as heading_key from documents",
    "w1_nonspace_prefix": """
        select conv_id, turn, cast(coalesce(sum(length(replace(coalesce(text, ''), ' ', ''))) over
            (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as chars_before
        from conversations
    """,
}
