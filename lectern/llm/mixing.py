"""Mixing sources to target weights.

Words are packed into blocks of fixed length, source by source. Each output shard draws its source counts: a
multinomial draw without replacement, so that over all shards a source gets its quota exactly (a free draw could pass
the limit of three times a document's size). Draws go by halves of the range of shards, so each task draws its own
shards and knows how many slots of a source came before. A slot's index within its source runs through that source's
pseudorandom permutation (a keyed Feistel network), and blocks are joined by index. The result is the blocks by shard
and slot; what each document gave to them is counted from their words.

Null text counts as no words; a null source is a source of its own, last in order; repeated rows are separate
documents, alike ones in any order; the layout of files and the order of rows change nothing; an empty table gives no
rows; a very long text is cut into as many blocks as it fills; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, arrow, cells_for, materialize, slices, with_prefix_sum

BLOCK, CAP, WEIGHTS, SHARD_SLOTS = 64, 3, (5, 2, 1), 4096
SLOTS = "shard long, slot long, source_index int, block long"
PARTS = "source_index int, block long, at long, from long, doc_id long, said string"


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the whole by weight, each at most cap x its own size; what is cut is shared again."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / weight > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        rest -= sum(out[i] for i in over)
        open_ -= over
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1, element by element: four Feistel rounds, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    limit, key = size.astype(np.uint64), key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(4):
                f = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
            out[todo] = (left << h) | right
            todo[todo] = out[todo] >= limit[todo]
    return out.astype(np.int64)


def dealt_to_left(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of each source fall to n of the slots that hold `left`: multinomial counts without replacement."""
    out, rest, n = np.zeros(len(left), np.int64), int(left.sum()), int(n)
    for i, own in enumerate(left.tolist()):
        rest -= own
        lo, hi = max(0, n - rest), min(own, n)
        if lo == hi:
            out[i] = lo
        elif own + rest < 10**9:
            out[i] = rng.hypergeometric(own, rest, n)
        else:  # beyond the generator's range its normal limit
            p, total = own / (own + rest), own + rest
            out[i] = min(hi, max(lo, round(rng.normal(n * p, (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5))))
        n -= int(out[i])
    return out


def shard_counts(quotas: list[int], first: int, last: int, seed: int, shard_slots: int = SHARD_SLOTS):
    """(shard, its slots by source, slots by source before it) for shards first..last-1.

    The range of all shards is halved again and again; each half's draw depends on the seed and the range only, so any
    task finds the draw of any shard by itself, in as many steps as halvings.
    """
    total = int(sum(quotas))
    todo = [(0, -(-total // shard_slots), np.array(quotas, np.int64), np.zeros(len(quotas), np.int64))]
    while todo:
        lo, hi, own, before = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, own, before
            continue
        mid = (lo + hi) // 2
        left = dealt_to_left(np.random.default_rng([seed, lo, hi]), own, (mid - lo) * shard_slots)
        todo += [(mid, hi, own - left, before + left), (lo, mid, left, before)]


def slots(spark, blocks: list[int], quotas: list[int], seed: int) -> DataFrame:
    """One row per output slot: shard, slot, source_index, block."""
    n_blocks, shards = np.array(blocks, np.int64), -(-int(sum(quotas)) // SHARD_SLOTS)

    def draw(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            for shard, own, before in shard_counts(quotas, int(ids.min()), int(ids.max()) + 1, seed):
                source = np.repeat(np.arange(len(own)), own)
                k = np.arange(len(source)) + np.repeat(before - np.concatenate(([0], np.cumsum(own)[:-1])), own)
                slot = shard * SHARD_SLOTS + np.random.default_rng([seed, shard]).permutation(len(source))
                n = n_blocks[source]
                block = permute(k % n, n, source * 1000003 + (k // n) + seed)
                yield arrow(SLOTS, [np.full(len(source), shard), slot, source, block])

    return spark.range(shards).mapInArrow(draw, SLOTS)


class Plan(NamedTuple):
    sized: DataFrame  # doc_id, source, _h, size
    sources: DataFrame | None  # a row per source with its target; none for an empty table
    blocks: list[int]
    quotas: list[int]
    cells: int


def plan(docs: DataFrame, weights, cap: float, block: int) -> Plan:
    sized = materialize(with_size(docs), "sizes")
    rows = sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()  # a row per source
    totals = sorted(((r[0], int(r[1])) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(totals))]
    sizes = [s for _, s in totals]
    aims = targets(sizes, weight, cap)
    blocks = [-(-s // block) for s in sizes]
    # The last block of a source may be short: quotas count words a block holds on average, and stay within cap runs.
    quotas = [min(int(cap) * n, round(t * n / s)) if s else 0 for n, s, t in zip(blocks, sizes, aims, strict=True)]
    sources = docs.sparkSession.createDataFrame([(i, s, n, t) for i, ((s, n), t) in enumerate(zip(totals, aims, strict=True))], "source_index int, _source string, source_size long, target double") if totals else None
    return Plan(sized, sources, blocks, quotas, cells_for(sum(r[2] for r in rows)))


def with_size(docs: DataFrame, *more: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.xxhash64("text").alias("_h"), size.alias("size"), *more)


def placed(sized: DataFrame, known: Plan) -> DataFrame:
    """With `_from`, the place of a document's first word in its source; rows alike in doc_id and text take any order."""
    rows = sized.join(F.broadcast(known.sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")  # a row per source
    return with_prefix_sum(rows, "source_index", ["doc_id", "_h"], "size", "_from", known.cells)


def cut_blocks(known: DataFrame, block: int) -> DataFrame:
    """One row per block of a source: its parts (at, from, doc_id, said) in order; `from` tells rows of a source apart."""

    def cut(batches):
        words_of = re.compile(WORD_CLASS).findall
        for part in slices(batches, "source_index", "_from", "doc_id", "text"):
            rows = [[] for _ in range(6)]
            for source, first, doc_id, text in zip(*part, strict=True):
                words, at = words_of(text), first
                while at < first + len(words):
                    end = min(first + len(words), (at // block + 1) * block)
                    for column, value in zip(rows, (source, at // block, at, first, doc_id, " ".join(words[at - first : end - first])), strict=True):
                        column.append(value)
                    at = end
            yield arrow(PARTS, rows)

    rows = known.filter("size > 0").select("source_index", "_from", F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(cut, PARTS)
    return parts.groupBy("source_index", "block").agg(F.array_sort(F.collect_list(F.struct("at", "from", "doc_id", "said"))).alias("parts"))  # at most `block` parts


def dealt(docs: DataFrame, known: Plan, block: int, seed: int) -> DataFrame:
    words = cut_blocks(placed(with_size(docs, "text"), known), block)
    drawn = slots(docs.sparkSession, known.blocks, known.quotas, seed).join(words.hint("merge"), ["source_index", "block"])
    return drawn.select("shard", "slot", "source_index", "block", F.array_join(F.transform("parts", lambda p: p["said"]), " ").alias("text"), "parts")


def deal(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mixed corpus, one row per output slot: shard, slot, source, block, text, parts."""
    known = plan(docs, weights, cap, block)
    if known.sources is None:
        part = "array<struct<at: long, from: long, doc_id: long, said: string>>"
        return docs.sparkSession.createDataFrame([], f"shard long, slot long, source string, block long, text string, parts {part}")
    names = F.broadcast(known.sources.select("source_index", F.col("_source").alias("source")))  # a row per source
    return dealt(docs, known, block, seed).join(names, "source_index").select("shard", "slot", "source", "block", "text", "parts")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per document: its columns doc_id and source with size, source_size, target, taken (words in the dealt blocks)."""
    known = plan(docs, weights, cap, block)
    if known.sources is None:
        return known.sized.select("doc_id", "source", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    parts = dealt(docs, known, block, seed).select("source_index", F.explode("parts").alias("p"))
    taken = parts.groupBy(F.col("source_index").alias("_s"), F.col("p.from").alias("_f")).agg(F.sum(F.size(F.split("p.said", " "))).alias("taken"))
    rows = placed(known.sized, known)
    out = rows.join(taken.hint("merge"), (F.col("source_index") == F.col("_s")) & (F.col("_from") == F.col("_f")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shares(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, size, taken of mix(), one row per row of docs, for callers that need no words: the same slots are drawn, and
    each document's words are counted by the blocks that it spans, so no text moves."""
    known = plan(docs, weights, cap, block)
    if known.sources is None:
        return known.sized.select("doc_id", "size", F.col("size").alias("taken"))
    drawn = slots(docs.sparkSession, known.blocks, known.quotas, seed).groupBy("source_index", "block").agg(F.count("*").alias("times"))
    rows = placed(known.sized, known).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows.select("_row", "doc_id", "size", "source_index", "_from"), "places")
    spans = F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block))
    each = rows.filter("size > 0").select("_row", "source_index", "_from", "size", F.explode(spans).alias("block"))
    words = F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("_from", F.col("block") * block)
    taken = each.join(drawn.hint("merge"), ["source_index", "block"]).groupBy("_row").agg(F.sum(F.col("times") * words).alias("taken"))
    return rows.join(taken.hint("merge"), "_row", "left").select("doc_id", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
