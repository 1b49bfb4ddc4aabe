"""The corpus pipeline: quality, line dedup, near dedup, mixing, packing. Each stage is written and read again.

A null text is an empty document. Extra columns of documents, whatever their names, pass through until the last stage. Rows
that repeat a doc_id share its fate in near_dedup and mixing. An empty table passes through every stage; very long texts
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, mixing, near_dedup, packing, quality
from lectern.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without a label there is no classifier, and all stay."""
    labels = table(spark, sf_dir, "labels")
    if labels.filter("quality is not null").isEmpty():
        return docs
    return docs.filter(quality.scorer(docs, labels)("text") >= quality.THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; a document left without text goes too, if it had any."""
    out = line_dedup.cleaned(docs).filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n", "")) != ""))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType))
    return unwrapped(out.select(row.alias("row")), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id."""
    kept = near_dedup.near_groups(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return unwrapped(wrapped(docs).join(kept.hint("merge"), F.col("row.doc_id").cast("long").eqNullSafe(F.col("_kept"))), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes its words, rounded; the chance of the last copy is the rest.

    The rest is compared with a hash of doc_id, so reruns agree and a source's words stay near its target.
    """
    taken = mixing.shares(docs).groupBy("doc_id").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    share = F.when(F.col("_size") > 0, F.col("_taken") / F.col("_size")).otherwise(F.lit(1.0))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1_000_000)) / 1e6
    times = taken.select(F.col("doc_id").alias("_id"), (F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("int").alias("_times"))
    out = wrapped(docs).join(times.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("_id"))).filter("_times > 0")
    return unwrapped(out.select("row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")), docs)


def wrapped(docs: DataFrame) -> DataFrame:
    """A document as one column, so that no name of its own can clash."""
    return docs.select(F.struct("*").alias("row"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

# The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
