"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is an append-only table. A batch's new digests are found by a sort-merge anti-join with it and appended; for
digests that it already holds, the batch's largest doc_id and row count are appended too, so the index stays current.
Of equal texts (after lower-casing A-Z) the row with the largest doc_id of all batches so far stays. Add a batch once:
rows added twice count twice. Null text counts as empty; a very long text is one digest; rows that repeat a doc_id
share its decision; a null doc_id loses to any other, and a group of null ids alone keeps them all; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"))


class DigestIndex:
    """A catalogue table text_sha256, keep_id, group_size; several rows of a digest are one group, see read()."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition(self.buckets, "text_sha256").write.mode(mode).bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        """One row per digest; the table's buckets spare the exchange."""
        return self.spark.table(self.name).groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Add a batch (doc_id, text_sha256); return the groups whose digest is new."""
        groups = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        if not self.spark.catalog.tableExists(self.name):
            self._write(groups, "errorifexists")
            return self.read()
        groups = materialize(groups, "groups")
        held = self.spark.table(self.name).select("text_sha256")
        fresh = materialize(groups.join(held.hint("merge"), "text_sha256", "left_anti"), "fresh")
        known = materialize(groups.join(held.hint("merge"), "text_sha256", "left_semi"), "known")
        self._write(fresh.union(known), "append")
        return fresh


def dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; the index grows by the documents.

    Without an index a new one is made. The documents are added in so many batches, dealt by a hash of doc_id.
    """
    rows = materialize(digests(docs), "digests")
    own = index or DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}", max(64, rows.count() // 5_000_000))
    for k in range(batches):
        own.add(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    groups = own.read().select(F.concat("text_sha256", F.lit("")).alias("_digest"), "keep_id", "group_size")
    # The key is an expression, so both sides are exchanged and a hot digest can be split.
    joined = rows.join(groups.hint("merge"), F.col("text_sha256") == F.col("_digest"), "left")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
