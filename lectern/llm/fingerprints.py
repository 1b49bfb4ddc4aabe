"""Document fingerprints by SpotSigs.

A signature is a common word (anchor) and the chain of the next content words. A fingerprint is the sorted set of
32-bit signature hashes, eight hex digits each, so equal texts have equal fingerprints; texts without an anchor
use chains at every word. Likeness is the Jaccard similarity of two sets; pairs whose set lengths alone rule
out the asked likeness are pruned. near_pairs() finds all pairs of fingerprint classes that are alike enough: sets are
partitioned by length and meet over their rarest signatures, of which a pair shares one at least.

Null text counts as empty (empty fingerprint; two empty ones have likeness 1); rows are ordered by descending doc_id,
ties by text, null ids last by a hash of the text, so many of them spread; repeated rows follow each other; a table of
one row is its own next one; an empty table gives no rows; a very long text is read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, materialize, slices

# Frequent function words of English, French, German and Spanish.
ANCHORS = frozenset("the a an is was are be of to and in that it for with le la les un une des du de et en est que qui der die das ein eine und ist den dem nicht zu el los las una y es por para con".split())
CHAIN, SPACING = 2, 1
RANGE_BYTES, MOST_RANGES = 64 << 20, 4096  # text of a range of doc_id; beyond so many ranges they grow (and are sorted on disk)
CLASSES = "doc_id long, class string, signs array<long>"
words_of = re.compile(r"[^\W_]+").findall
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def signatures(text: str) -> frozenset[int]:
    words = words_of(text.lower())
    content = [w for w in words if w not in ANCHORS]
    out, seen, crc = set(), 0, zlib.crc32
    for w in words:
        if w in ANCHORS:
            if chain := content[seen : seen + CHAIN * SPACING : SPACING]:
                out.add(crc(f"{w}:{':'.join(chain)}".encode()))
        else:
            seen += 1
    return frozenset(out or {crc(":".join(words[i : i + CHAIN + 1]).encode()) for i in range(len(words))} or ({crc(text.encode())} if text else ()))


def likeness(a: frozenset, b: frozenset, least: float = 0.0) -> float:
    """Jaccard similarity; 0 where the set lengths rule out `least`."""
    if not a or not b:
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def written(signs: frozenset) -> str:
    return "".join(f"{x:08x}" for x in sorted(signs))


def looked_up(values: list, width: int, place):
    """Element `place` (from 0) of a long list of literals, through rows of `width`, so that no row of the plan is long."""
    rows = F.array(*[F.array(*map(F.lit, values[i : i + width])) for i in range(0, len(values), width)])
    return F.get(F.get(rows, F.floor(place / width).cast("int")), F.pmod(place, F.lit(width)).cast("int"))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """Rows dealt to ranges of (doc_id descending, null ids last by text hash), and the number of ranges.

    Columns doc_id, key (doc_id or hash), text, part, own; each range also gets the rows that may follow its last one
    (own = false). Ranges hold about `range_bytes` of text each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("void", F.col("doc_id").isNull())
    quantiles = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    seen = rows.groupBy("void").agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("key", quantiles, 10 * MOST_RANGES).alias("cuts")).orderBy("void").collect()
    if not seen:
        return rows.withColumn("part", F.lit(0)).withColumn("own", F.lit(True)), 1
    least, part, n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.lit(0), 0
    for r in seen:  # at most two groups: ids, null ids
        ranges = max(2, min(MOST_RANGES, max(least, -(-r["bytes"] // range_bytes))))
        cuts = sorted({r["cuts"][int(i * MOST_RANGES / ranges) - 1] for i in range(1, ranges)}, reverse=True)
        width = max(1, math.isqrt(len(cuts)))
        heads = F.array(*[F.lit(cuts[i]).cast("long") for i in range(0, len(cuts), width)])
        row = F.greatest(F.lit(0), F.size(F.filter(heads, lambda c: c >= F.col("key"))) - 1)  # the row of cuts that key falls in
        rest = F.array(*[F.array(*[F.lit(c).cast("long") for c in cuts[i : i + width]]) for i in range(0, len(cuts), width)])
        place = F.lit(n) + row * width + F.size(F.filter(F.get(rest, row), lambda c: c >= F.col("key")))
        part = F.when(F.col("void") == r["void"], place).otherwise(part)
        n += len(cuts) + 1
    rows = rows.withColumn("part", part.cast("int"))
    # The first key of each range reaches the driver, no texts.
    heads = rows.groupBy("part").agg(F.max("key").alias("top")).orderBy("part").collect()
    tops, before = [None] * n, [None] * n
    for i, r in enumerate(heads):
        tops[r["part"]], before[r["part"]] = r["top"], heads[i - 1]["part"]
    width = max(1, math.isqrt(n))
    is_head = F.col("key") == looked_up([None if t is None else int(t) for t in tops], width, F.col("part"))
    previous = looked_up(before, width, F.col("part"))
    one, two = (F.struct(p.cast("int").alias("part"), F.lit(own).alias("own")) for p, own in ((F.col("part"), True), (previous, False)))
    return rows.select("doc_id", "key", "text", F.explode(F.when(is_head, F.array(one, two)).otherwise(F.array(one))).alias("c")).select("doc_id", "key", "text", "c.part", "c.own"), n


def fingerprint(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document, by SCHEMA."""
    dealt, n = with_next(docs, range_bytes)

    def row(doc_id, text, signs, following, its_signs):
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        edited_signs = signatures(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(signs), written(edited_signs), likeness(signs, edited_signs), likeness(signs, its_signs)

    def run(batches):
        held = None
        for slice_ in slices(batches, "doc_id", "text", "part", "own"):
            out = []
            for doc_id, text, part, own in zip(*slice_, strict=True):
                if not own and (held is None or held[3] != part):
                    continue
                signs = signatures(text)
                if held is not None and held[3] == part:
                    out.append(row(*held[:3], text, signs))
                held = (doc_id, text, signs, part) if own else None
            yield arrow(SCHEMA, list(zip(*out, strict=True)) or [[]] * 7)

    # Own rows first, then the row that follows the range (the first of its copies: ties by text).
    return dealt.repartitionByRange(n, "part").sortWithinPartitions("part", F.desc("own"), F.desc("key"), "text").mapInArrow(run, SCHEMA)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class (digest of its fingerprint), signs."""

    def run(batches):
        for doc_ids, texts in slices(batches, "doc_id", "text"):
            signs = [signatures(t or "") for t in texts]
            yield arrow(CLASSES, [doc_ids, [hashlib.sha256(written(s).encode()).hexdigest() for s in signs], [sorted(s) for s in signs]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CLASSES)


def band(length: int, least: float) -> int:
    """The partition of a set length: lengths that allow `least` are in the same or in neighbouring ones."""
    return 0 if least >= 1 else math.floor(math.log(length) / -math.log(least) + 1e-9)


def near_pairs(members: DataFrame, least: float) -> DataFrame:
    """Pairs of different classes of classes() with likeness of `least` (over 0) or more: a, b, likeness; a < b."""
    sets = materialize(members.filter(F.size("signs") > 0).groupBy("class").agg(F.first("signs").alias("signs")), "classes")
    each = sets.select("class", F.size("signs").alias("size"), F.explode("signs").alias("sign"))
    often = each.groupBy("sign").agg(F.count("*").alias("often")).filter("often > 1")  # others meet nothing
    known = each.join(often.hint("merge"), "sign", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = known.groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("often", "sign"))).alias("rare"))

    def prefix(batches):
        for batch in batches:
            rows = []
            for c, size, rare in zip(batch["class"], batch["size"], batch["rare"], strict=True):
                # Sets alike by `least` share ceil(least * size) signatures at least, so one lies in each one's prefix.
                upto, own = size - math.ceil(least * size - 1e-9) + 1, band(size, least)
                rows += [(c, size, own, r["sign"]) for r in rare[:upto] if r["often"] > 1]
            yield pd.DataFrame(rows, columns=["class", "size", "band", "sign"])

    rare = materialize(ranked.mapInPandas(prefix, "class string, size int, band int, sign long"), "rare")
    # The shorter set looks in its own partition and the next one.
    short = rare.select(F.col("class").alias("x"), F.col("size").alias("x_size"), "sign", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    long = rare.select(F.col("class").alias("y"), F.col("size").alias("y_size"), "sign", "band")
    met = short.join(long.hint("merge"), ["sign", "band"]).filter((F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x") < F.col("y"))))
    met = met.filter(F.col("x_size") >= F.col("y_size") * least - 1e-9).select("x", "y").distinct()
    both = met.join(sets.select(F.col("class").alias("x"), F.col("signs").alias("xs")).hint("merge"), "x").join(sets.select(F.col("class").alias("y"), F.col("signs").alias("ys")).hint("merge"), "y")

    def verify(batches):
        for batch in batches:
            alike = [likeness(frozenset(a), frozenset(b), least) for a, b in zip(batch["xs"], batch["ys"], strict=True)]
            out = pd.DataFrame({"a": batch[["x", "y"]].min(axis=1), "b": batch[["x", "y"]].max(axis=1), "likeness": alike})
            yield out[out["likeness"] >= least]

    return both.mapInPandas(verify, "a string, b string, likeness double")
