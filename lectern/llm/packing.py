"""Packing by cutting-stock column generation.

Documents are cut at every 4096 tokens; the tails (1 to 4095 tokens) are the items. Their length histogram in
steps of 8 tokens (at most 512 counts, whatever the corpus) goes to the driver, where a linear program over
patterns is solved by column generation: a knapsack dynamic program prices new columns from the duals. Rounded
patterns, and a best-fit packing of the few items that rounding leaves, own consecutive ranks of each length
class; every tail finds its sequence from its rank. Nothing per document reaches the driver. Each piece keeps its
ids, and the pieces of a sequence in order of offset are its tokens.

Null text counts as empty and packs as the single end id; repeated rows pack once each, alike ones in any order; a null
doc_id stays null; a very long text is cut into as many pieces as it fills; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, cells_for, materialize, slices, with_prefix_sum

CAPACITY, STEP, END_ID = 4096, 8, 2
CACHE_ENTRIES = 150_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = byte_letters()


@lru_cache(2)
def word_model(tokenizer_path: str):
    """The tokenizer's merges as ranks over bytes (a zero byte ends a word), with its ids and the word ends by rank.

    Ranks know a merge by its result only. That is the same thing when every token, taken alone, is merged into
    itself: a split of a token that its merges never reach alone isn't reached inside a word either.
    """
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, back = model["vocab"], {letter: bytes([b]) for b, letter in LETTERS.items()}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    tokens = [*(LETTERS[b] + "</w>" for b in range(256)), *(LETTERS[b] for b in range(256)), *merged]
    ends = [t.endswith("</w>") for t in tokens]
    raw = [b"".join(map(back.__getitem__, t[:-4] if end else t)) + b"\0" * end for t, end in zip(tokens, ends, strict=True)]
    ranks = {r: k for k, r in enumerate(raw)}
    if len(ranks) != len(raw):
        raise ValueError("two merges of the tokenizer make the same token")
    return tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={}), np.array([vocabulary[t] for t in tokens], "<u4"), np.array(ends)


class ChunkEncoder:
    """Ids as packed bytes. The tokenizer drops white space, so chunks between ASCII white space encode alone.

    New chunks of ASCII and Latin-1 letters are cut into the tokenizer's own pieces here and merged many at a time;
    each piece's last token is a word end, so the ids are told apart again. Every other chunk (other letters, special
    tokens) goes through the whole tokenizer by itself.
    """

    plain = re.compile(r"[\n!-~À-ÖØ-öø-ÿ]+").fullmatch
    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(tokenizer_path), {}
        self.model, self.ids, self.ends = word_model(tokenizer_path)

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))

    def many(self, texts: list[str]):
        """The ids of each text, in turn."""
        # The tokenizer lower-cases too; only the strings of its special tokens must stay as written.
        raws = [t.encode("utf-8", "replace") for t in texts]
        chunks = [(raw if b"<|" in raw else raw.lower()).split() for raw in raws]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*chunks).difference(self.known))
        for at in range(0, len(new), 8192):
            self._learn(new[at : at + 8192])
        for own in chunks:
            yield b"".join(map(self.known.__getitem__, own))

    def _learn(self, chunks: list[bytes]) -> None:
        joined = b"\n".join(chunks).decode()
        if "<|" in joined or not self.plain(joined):
            texts = joined.split("\n")
            odd = [k for k, t in enumerate(texts) if "<|" in t or not self.plain(t)]
            for k, e in zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False), strict=True):
                self.known[chunks[k]] = array("I", e.ids).tobytes()
            odd = set(odd)
            chunks = [c for k, c in enumerate(chunks) if k not in odd]
            if not chunks:
                return
            joined = b"\n".join(chunks).decode()
        cut = list(map(self.pieces, joined.lower().split("\n")))
        last = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))) - 1  # a chunk's last piece
        ranks = np.array(self.model.encode_ordinary("\0".join(chain.from_iterable(cut)) + "\0"))
        stops = (4 * (np.flatnonzero(self.ends[ranks]) + 1)[last]).tolist()
        self.known.update(zip(chunks, map(self.ids[ranks].tobytes().__getitem__, map(slice, [0, *stops], stops))))


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most `capacity` ids, packed as little-endian 32-bit numbers."""

    def cut(batches):
        encode, end = ChunkEncoder(tokenizer_path), array("I", [END_ID]).tobytes()
        for doc_ids, texts in slices(batches, "doc_id", "text"):
            rows = [[], [], [], [], []]
            for doc_id, ids in zip(doc_ids, encode.many([t or "" for t in texts]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (doc_id, start, len(piece) // 4, n, piece), strict=True):
                        column.append(value)
            yield arrow(PIECES, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def price(units: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the pattern of the largest dual value. units ascend."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(units, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            values = best[c - units[:k]] + duals[:k]
            if values[i := int(values.argmax())] > best[c] + 1e-12:
                best[c], pick[c] = values[i], i
    pattern, c = np.zeros(len(units)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= units[pick[c]]
    return float(best[capacity]), pattern


def solve(units: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 1200) -> list[tuple[np.ndarray, int]]:
    """Whole-number patterns that cover the demand exactly: (count per class, times used)."""
    n = len(units)
    if not n:
        return []
    columns = np.diag(capacity // units).astype(float)
    inverse, x = np.diag(1.0 / np.diag(columns)), demand / np.diag(columns)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = price(units, duals, capacity)
        if value <= 1 + 1e-9 or x.sum() <= (1 + gap) * (duals @ demand) / value:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        inverse[out] /= step[out]
        x[out] = ratio[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        x[others] = np.maximum(x[others] - step[others] * ratio[out], 0)
        columns[:, out] = pattern
    left, used = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x):
        pattern = columns[:, k].astype(np.int64)
        own = pattern > 0
        if (times := min(int(x[k] + 1e-6), int((left[own] // pattern[own]).min()))) > 0:
            left -= times * pattern
            used.append((pattern, times))
    rooms: dict[int, list[np.ndarray]] = {}
    for k in range(n - 1, -1, -1):  # best fit of what rounding left, largest first
        for _ in range(left[k]):
            room = min((r for r in rooms if r >= units[k] and rooms[r]), default=None)
            pattern = rooms[room].pop() if room is not None else np.zeros(n, np.int64)
            pattern[k] += 1
            rooms.setdefault((capacity if room is None else room) - int(units[k]), []).append(pattern)
    return used + [(p, 1) for ps in rooms.values() for p in ps]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, ids."""
    found, written = places(docs, tokenizer_path, capacity)
    return found.join(written.select("_piece", "ids").hint("merge"), "_piece").drop("_piece")


def places(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The places of pack() without ids but with _piece, and the written pieces with _piece and ids."""
    cut = cut_pieces(docs, tokenizer_path, capacity).withColumn("ids_crc32", F.crc32("ids")).withColumn("_piece", F.monotonically_increasing_id())
    written = materialize(cut, "pieces")
    pieces = written.drop("ids")  # places are found without the ids, which join at the end
    tails = pieces.filter(F.col("length") < capacity).withColumn("_class", F.ceil(F.col("length") / STEP).cast("int")).withColumn("_one", F.lit(1))
    histogram = sorted((r[0], r[1]) for r in tails.groupBy("_class").count().collect())  # at most capacity / STEP rows
    total = sum(n for _, n in histogram)
    units, demand = np.array([u for u, _ in histogram], np.int64), np.array([d for _, d in histogram], float)
    patterns = solve(units, demand, capacity // STEP)
    starts: dict[int, list] = {int(u): [] for u in units}
    filled, sequences = dict.fromkeys(starts, 0), 0
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern):
            u, a = int(units[k]), int(pattern[k])
            starts[u].append((filled[u], a, sequences))
            filled[u] += a * times
        sequences += times
    segments = {u: np.array(rows, np.int64) for u, rows in starts.items()}

    def place(batches):
        for batch in batches:
            units_of, ranks = batch.column("_class").to_numpy(), batch.column("_rank").to_numpy()
            sequence = np.zeros(len(units_of), np.int64)
            for u in np.unique(units_of).tolist():
                at, own = np.flatnonzero(units_of == u), segments[u]
                seg = own[np.searchsorted(own[:, 0], ranks[at], side="right") - 1]
                sequence[at] = seg[:, 2] + (ranks[at] - seg[:, 0]) // seg[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    ranked = with_prefix_sum(tails, "_class", ["doc_id", "start", "ids_crc32"], "_one", "_rank", cells_for(total)).drop("_one")
    placed = ranked.mapInArrow(place, T.StructType([*ranked.schema, T.StructField("sequence_id", T.LongType())]))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_class", "_rank")
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.lit(sequences).cast("long") + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(whole), written


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of pack(): sequence_id, length, ids (binary), pieces (doc_id, start, offset, length)."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))  # at most `capacity` ids
    rows = packed.groupBy("sequence_id").agg(own.alias("_own"))
    ids = F.aggregate("_own", F.lit(b""), lambda joined, p: F.concat(joined, p["ids"]))
    pieces = F.transform("_own", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length")))
    return rows.select("sequence_id", (F.length(ids) / 4).cast("long").alias("length"), ids.alias("ids"), pieces.alias("pieces"))
