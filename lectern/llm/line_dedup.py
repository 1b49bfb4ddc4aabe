"""Line dedup over overlapping windows of three lines.

Every three consecutive lines are hashed; a window's first occurrence over the corpus, by (doc_id, text hash,
position), stays, and the lines that later ones cover go. Windows of blank lines don't count. Documents with under
three lines and null texts stay as they are; rows that repeat both doc_id and text share one decision, and of windows that
tie the least (doc_id, text hash, position) is the first; a null doc_id comes before any other; an empty table gives no rows;
a very long text is hashed line by line; columns of any name are kept, but for n_removed, which dedup_lines() replaces.

repeated_passages() finds what such windows can't: runs of over 50 words that occur earlier, wherever lines begin. Any
51 words hold a run of 25 that is the least of its neighbours by hash, so only those are met over the corpus (winnowing),
and windows of 51 words are hashed only around the ones that repeat.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, hot_join, materialize

WINDOW = 3
PASSAGE, RUN = 51, 25  # words of a passage; words of the runs that meet


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """_id, _text (hash of the text), _at, _hash: each line is hashed once, then each run of `width` hashes."""
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.split("text", "\n", -1).alias("_lines")).filter(F.size("_lines") >= width)
    own = F.transform("_lines", lambda line: F.xxhash64(line)).alias("_own")
    rows = lines.select("_id", "_text", own, F.transform("_lines", lambda line: F.trim(line) == "").alias("_blank"))

    def run(i):
        blank = reduce(lambda x, y: x & y, [F.get("_blank", i + k) for k in range(width)])
        return F.when(~blank, F.xxhash64(*[F.get("_own", i + k) for k in range(width)]))

    runs = F.transform(F.sequence(F.lit(0), F.size("_own") - width), run)
    return rows.select("_id", "_text", F.posexplode(runs).alias("_at", "_hash")).filter("_hash is not null")


def cleaned(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """row (all columns of a document), text without the lines of repeated windows, n_removed."""
    seen = materialize(windows(docs, width), "windows")
    first = seen.groupBy("_hash").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_text", "_at")).alias("_first")).filter("_n > 1")
    here = F.struct("_id", "_text", "_at")
    later = hot_join(seen, first, "_hash").filter(~here.eqNullSafe(F.col("_first")))
    covered = later.groupBy("_id", "_text").agg(F.collect_set("_at").alias("_starts"))  # at most a document's lines
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_key"))
    out = rows.join(covered.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left")
    out = out.select("row", F.array_sort("_starts").alias("_starts"), F.split("row.text", "\n", -1).alias("_lines"))
    # What stays lies before the first window, between windows and after the last: slices, so long texts take time in proportion.
    since = F.concat(F.array(F.lit(0)), F.transform("_starts", lambda s: s + width))
    upto = F.concat(F.col("_starts"), F.array(F.size("_lines")))
    parts = F.filter(F.zip_with(since, upto, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] < p["b"])
    kept = F.flatten(F.transform(parts, lambda p: F.slice("_lines", p["a"] + 1, p["b"] - p["a"])))
    out = out.select("row", "_starts", "_lines", F.when(F.col("_starts").isNotNull(), kept).alias("_kept"))
    whole = F.col("_starts").isNull()
    return out.select("row", F.when(whole, F.col("row.text")).otherwise(F.array_join("_kept", "\n")).alias("text"), F.when(whole, 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without the lines of repeated windows, with n_removed (which replaces a column of that name)."""
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_removed"]
    return cleaned(docs, width).select(*columns, "n_removed")


@lru_cache(1_000_000)
def _word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive words."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return _mixed(out)


def _anchored(text: str, passage: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, run hashes, and for each passage's start the start of its run of least hash (the first of them)."""
    words = np.array([_word(w) for w in re.findall(WORD_CLASS, text or "")], np.uint64)
    runs = _hashes(words, run)
    if len(words) < passage:
        return words, runs, np.zeros(0, np.int64)
    around = np.lib.stride_tricks.sliding_window_view(runs, passage - run + 1)
    return words, runs, np.arange(len(around)) + around.argmin(axis=1)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, run: int = RUN) -> DataFrame:
    """One row per maximal run of words covered by passages with an earlier occurrence by (doc_id, text hash, position):
    doc_id, start, stop in words. Words are as written; rows that repeat both doc_id and text count once."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), "text").dropDuplicates(["_id", "_text"]), "passage-texts")

    def anchors(batches):
        for batch in batches:
            out = []
            for i, t, text in zip(batch["_id"], batch["_text"], batch["text"], strict=True):
                _, runs, at = _anchored(text, passage, run)
                out += [(None if pd.isna(i) else int(i), t, h) for h in runs[np.unique(at)].view(np.int64)]
            yield pd.DataFrame(out, columns=["_id", "_text", "_anchor"]).astype({"_id": "Int64"})

    met = materialize(rows.mapInPandas(anchors, "_id long, _text long, _anchor long"), "anchors")
    again = met.groupBy("_anchor").count().filter("count > 1").select("_anchor")
    own = hot_join(met, again, "_anchor").groupBy(F.col("_id").alias("_i"), F.col("_text").alias("_t")).agg(F.collect_set("_anchor").alias("_anchors"))
    texts = rows.join(own.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t"))).select("_id", "_text", "text", "_anchors")

    def around(batches):
        for batch in batches:
            out = []
            for i, t, text, own in zip(batch["_id"], batch["_text"], batch["text"], batch["_anchors"], strict=True):
                words, runs, at = _anchored(text, passage, run)
                hashes = _hashes(words, passage).view(np.int64)
                out += [(None if pd.isna(i) else int(i), t, int(k), hashes[k]) for k in np.flatnonzero(np.isin(runs[at].view(np.int64), own))]
            yield pd.DataFrame(out, columns=["_id", "_text", "_at", "_hash"]).astype({"_id": "Int64"})

    seen = materialize(texts.mapInPandas(around, "_id long, _text long, _at int, _hash long"), "passages")
    first = seen.groupBy("_hash").agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_text", "_at")).alias("_first")).filter("_n > 1")
    later = hot_join(seen, first, "_hash").filter(~F.struct("_id", "_text", "_at").eqNullSafe(F.col("_first")))
    starts = later.groupBy("_id", "_text").agg(F.array_sort(F.collect_set("_at")).alias("_starts"))  # at most a document's words

    def joined(batches):
        for batch in batches:
            out = []
            for i, starts in zip(batch["_id"], batch["_starts"], strict=True):
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > passage) + 1):
                    out.append((None if pd.isna(i) else int(i), int(part[0]), int(part[-1]) + passage))
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop"]).astype({"doc_id": "Int64"})

    return starts.mapInPandas(joined, "doc_id long, start int, stop int")
