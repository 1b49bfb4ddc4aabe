"""Helpers shared by the training-data operators: inputs, written tables, prefix sums that no hot key can block."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES = 2 << 20
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python at most BATCH_BYTES at a time, where the session doesn't ask for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and Spark runs in one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints"
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, known: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The rows joined with what is known of their key (a long), one row a key.

    The key is an expression, so both sides are exchanged for the join even where `known` is dealt by it already, and the rows of
    a hot key can be split over tasks.
    """
    flipped = F.col(key).bitwiseXOR(F.lit(1).cast("long"))
    own = known.select(flipped.alias("_flipped"), *[c for c in known.columns if c != key])
    return rows.join(own.hint("merge"), flipped == F.col("_flipped"), how).drop("_flipped")


def slices(batches, *names: str, rows: int = 256):
    """Columns of Arrow batches as Python lists, a few rows at a time: memory follows the slice, not the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(n).to_pylist() for n in names]


def arrow(schema: str, columns: list):
    """An Arrow batch of a flat schema such as "a long, b string"; columns are lists or numpy arrays."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split(" ", 1) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def cells_for(rows: int, each: int = 500, least: int = 64) -> int:
    """Cells of with_prefix_sum() that keep a window at about `each` rows, even of a key that holds all rows."""
    return max(least, -(-rows // each))


def with_prefix_sum(df: DataFrame, key: str, order: list[str], value: str, out: str, cells: int = 64) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same key that come before.

    Rows are ordered by (cell, order), where a cell is a hash of the order columns, so a key that holds
    a third of all rows is spread over `cells` windows; only cells x keys totals meet in the second window.
    """
    df = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    totals = df.groupBy(key, "_cell").agg(F.sum(value).alias("_total"))
    over_cells = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_total").over(over_cells), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = df.join(totals, (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_c")))
    return joined.withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_k", "_c", "_cell", "_in", "_base")
