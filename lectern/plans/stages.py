"""Stages written to the cluster's shared folder: what several later steps read is computed once, and plans stay small."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; a local one only where none is set and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back; zstd takes about a third less than the default."""
    at = shared(rows.sparkSession, name)
    rows.write.parquet(at, compression="zstd")
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def dealt(rows: DataFrame, keys: list[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows of each key in one partition, sorted by `keys` and then `order`.

    Dealt by a hash of the keys, not by the keys: Spark leaves out a move by the keys where a join or a union below already deals by
    them, and may then join small partitions of each side of the union, or split large ones of the join, as nothing above asks for whole keys.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def folded(rows: DataFrame, keys: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """fold(list of rows) for the rows of each key in order, streamed through sorted partitions: no frame per group.

    Rows come without their keys as tuples of the other columns in order; what fold returns gets its keys in front.
    Rows of a null key are one group. Keys and values are Python's own, so long keys stay exact.
    """
    rest, k = [c for c in rows.columns if c not in keys], len(keys)
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        key, held = None, []

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape, strict=True)], schema=shape)

        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[:k] != key:
                    out += [(*key, *x) for x in fold(held)]
                    held = []
                key = r[:k]
                held.append(r[k:])
            if out:
                yield packed(out)
        if held and (out := [(*key, *x) for x in fold(held)]):
            yield packed(out)

    return dealt(rows.select(*keys, *rest), keys, order).mapInArrow(run, schema)


def begins(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; a null is equal to a null. The first row begins."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        here, before = c.slice(1), c.slice(0, max(0, len(c) - 1))
        out[1:] |= pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
    return out


def folded_tables(rows: DataFrame, keys: list[str], fold, schema: str, gathered: bool = False) -> DataFrame:
    """As folded(), for folds over columns: fold(table, groups) for tables of many whole groups at once, in no order within a group.

    `groups` numbers each row's group from 0; fold returns the group of each row of its own and then its columns.
    `gathered` says that the rows of a key already lie one after the other in one partition: they are not dealt and sorted again.
    """
    shape = to_arrow_schema(StructType.fromDDL(schema))
    own = [f.name for f in shape][len(keys) :]

    def run(batches):
        held: list[pa.RecordBatch] = []  # all of one key, of which more may come

        def done(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            starts = begins([table[k].combine_chunks() for k in keys])
            group, *columns = fold(table, np.cumsum(starts) - 1)
            at = pa.array(np.flatnonzero(starts)[group])
            made = [table[k].take(at).combine_chunks().cast(shape.field(k).type) for k in keys]
            made += [c if isinstance(c, pa.Array) else pa.array(c, shape.field(n).type) for n, c in zip(own, columns, strict=True)]
            return pa.RecordBatch.from_arrays(made, schema=shape)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]
            starts = np.flatnonzero(begins([pa.concat_arrays([p.column(k) for p in parts]) for k in keys])[len(parts) - 1 :])
            if not len(starts):
                held.append(batch)
                continue
            last = int(starts[-1])
            whole, held = [*held, batch.slice(0, last)], [batch.slice(last)]
            if any(p.num_rows for p in whole):
                yield done(whole)
        if held:
            yield done(held)

    rows = rows if gathered else dealt(rows, keys)
    return rows.mapInArrow(run, schema)
