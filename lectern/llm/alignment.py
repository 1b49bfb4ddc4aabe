"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes. Repeating each token's index over its bytes gives an owner array per tokenizer; consecutive
distinct pairs of owners are the overlaps, and bytes where both owners change are the cuts. Between two cuts lies a group: the
fewest tokens of A and B that cover the same bytes. A link is a pair of tokens whose byte ranges end together; how often a pair
of ids is linked in the whole corpus tells how good a link is.

A document's links are counted by pair before anything is shuffled. Pairs are summed over the corpus; the commonest, at most
HOT_PAIRS, go to every task as sorted arrays, and links of the others, each of them rare, are joined by shuffle. Every link is
looked up one way or the other, at any size.

Texts that are null or empty, or whose tokens don't give back the bytes of space + text (unusual white space, or characters that
the second tokenizer replaces), have no tokens: zeros, and an empty digest. Special tokens inside a text are plain text. A null
doc_id stays and repeated rows keep a result each (their links count each time); an empty table gives no rows; a very long text
is one row of work; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, materialize, slices, small_batches

HOT_PAIRS, ROWS, CHARS = 1 << 20, 64, 1 << 17  # rows and characters of a call of a tokenizer
FACTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
LINK_TYPE = np.dtype([("pair", "<u4"), ("n", "<u4")])


class Aligned(NamedTuple):
    """Token ids of both sides, where the tokens end, overlaps (pairs of indices) and cuts (byte offsets after each group)."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray

    @property
    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = (np.diff(e, prepend=0) for e in (self.ends_a, self.ends_b))
        return tuple(np.repeat(np.arange(len(s)), s) for s in sizes)

    def overlaps_and_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.a):
            return np.empty((0, 2), np.int64), np.empty(0, np.int64)
        own_a, own_b = self.owners
        new_a, new_b = np.diff(own_a, prepend=-1) != 0, np.diff(own_b, prepend=-1) != 0
        at = np.flatnonzero(new_a | new_b)
        return np.stack([own_a[at], own_b[at]], axis=1), np.append(np.flatnonzero(new_a & new_b)[1:], len(own_a))


def byte_decoder() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how byte-level vocabularies of this kind cut a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def ranked(path: str):
    """The tokenizer of a file as merge ranks, which is several times as fast; none where that may give other ids.

    It gives the same where a token's id is its merge's rank and every token alone is merged into itself: then no other pair
    than a token's own two halves can ever stand side by side and make it (the tests hold both against each other).
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, cut = said["model"], said.get("pre_tokenizer") or {}
    plain = model.get("type") in (None, "BPE") and not said.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    halves = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in halves]
    byte, made = byte_decoder(), set(ids)
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in byte for c in t) and (len(t) == 1 or i in made)}
    if ids != sorted(set(ids)) or len(ranks) != 256 + len(ids) or max((i for b, i in ranks.items() if len(b) == 1)) > ids[0]:
        return None
    return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Both tokenizers of a task: ids of a text and each id's bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.ranked = ranked(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte, size_a = byte_decoder(), self.a.get_vocab_size()
        self.bytes_a = [bytes(map(byte.__getitem__, t)) if t is not None and all(c in byte for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(size_a))]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if single else p.replace("▁", " ").encode() for p, single in pieces]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, b)), np.int64) for b in (self.bytes_a, self.bytes_b))
        # Ids in decimal with what may follow them.
        self.names = [f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in range(max(size_a, len(pieces)))]

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def align(self, texts: list[str | None]) -> Iterator[Aligned]:
        """Texts one by one; the tokenizers see CHARS characters at a time, or one longer text."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at] or "")
            while end < len(texts) and size + len(texts[end] or "") <= CHARS:
                size += len(texts[end] or "")
                end += 1
            some = [t or "" for t in texts[at:end]]
            for t, a, b in zip(some, self.ids_a([" " + t for t in some]), self.b.encode(some, num_threads=1), strict=True):
                raw = b" " + t.encode("utf-8", "replace")
                if t and b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    yield Aligned(a, b, self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum())
                else:
                    none = np.empty(0, np.int64)
                    yield Aligned(none, none, none, none)
            at = end

    def linked(self, own: Aligned, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the A and B tokens that end at each cut."""
        return np.searchsorted(own.ends_a, cuts), np.searchsorted(own.ends_b, cuts)

    def digest(self, own: Aligned, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """SHA-256 of a1,a2|b1;a3|b2,b3: every token's place follows from the groups before it."""
        if not len(own.a):
            return ""
        ends = [np.zeros(len(ids), np.int64) for ids in (own.a, own.b)]
        group = []
        for end, last in zip(ends, (last_a, last_b), strict=True):
            end[last[:-1] + 1] = 1
            group.append(end.cumsum())
        until_a, until_b = last_a + 1, np.concatenate(([0], last_b[:-1] + 1))
        place_a, place_b = np.arange(len(own.a)) + until_b[group[0]], np.arange(len(own.b)) + until_a[group[1]]
        size, codes = len(self.names) // 4, np.empty(len(own.a) + len(own.b), np.int64)
        codes[place_a], codes[place_b] = own.a, own.b
        codes[place_a[last_a]] += size
        codes[place_b[last_b]] += 2 * size
        codes[-1] += size
        return hashlib.sha256(b"".join(map(self.names.__getitem__, codes.tolist()))).hexdigest()


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, ids_a, ids_b, overlap_a, overlap_b (token indices of each overlap), cuts (byte offsets in space + text)."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, ids_a array<long>, ids_b array<long>, overlap_a array<long>, overlap_b array<long>, cuts array<long>"

    def run(batches):
        both = Tokenizers(path_a, path_b)
        for ids, texts in slices(batches, "doc_id", "text", rows=ROWS):
            found = both.align(texts)
            parts = [(own, *own.overlaps_and_cuts()) for own in found]
            yield arrow(schema, [ids, [o.a for o, _, _ in parts], [o.b for o, _, _ in parts], [v[:, 0] for _, v, _ in parts], [v[:, 1] for _, v, _ in parts], [c for _, _, c in parts]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def facts(docs: DataFrame, path_a: str, path_b: str, width: int) -> DataFrame:
    """FACTS of each row; `links` are its linked id pairs (a * width + b) with their number, sorted and packed."""

    def run(batches):
        both = Tokenizers(path_a, path_b)
        if len(both.sizes_a) * width > 2**32:
            raise ValueError("vocabularies too large for a pair in 32 bits")
        for rows, ids, texts in slices(batches, "row", "doc_id", "text", rows=ROWS):
            out = []
            for own in both.align(texts):
                _, cuts = own.overlaps_and_cuts()
                last_a, last_b = both.linked(own, cuts)
                pairs, n = np.unique(own.a[last_a] * width + own.b[last_b], return_counts=True)
                links = np.empty(len(pairs), LINK_TYPE)
                links["pair"], links["n"] = pairs, n
                out.append((len(own.a), len(own.b), len(cuts), len(cuts), both.digest(own, last_a, last_b), packed(links)))
            yield arrow(FACTS, [rows, ids, *map(list, zip(*out, strict=True))])

    return _numbered(docs).mapInArrow(run, FACTS)


def packed(links: np.ndarray) -> bytes:
    """Differences of the sorted pairs, then the numbers: small values, which compress well."""
    pairs = links["pair"]
    return zlib.compress(np.diff(pairs, prepend=np.uint32(0)).astype("<u4").tobytes() + links["n"].tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), "<u4")
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.uint32), both[half:]


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, count, best: links of each id pair in the corpus, and whether none of the same B id has more.

    Tasks count their own pairs first and send them on when they have gathered HOT_PAIRS of them.
    """

    def run(batches):
        held, gathered = [], 0
        schema = "pair long, n long"

        def counted():
            pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, n.astype(np.int64))
            return keys, total

        for batch in batches:
            for raw in batch.column("links"):
                pairs, n = unpacked(raw.as_py())
                held.append((pairs, n))
                gathered += len(pairs)
                if gathered >= HOT_PAIRS:
                    keys, total = counted()
                    held, gathered = [(keys, total)], 0
                    if len(keys) >= HOT_PAIRS:
                        held = []
                        yield arrow(schema, [keys.astype(np.int64), total])
        if held:
            keys, total = counted()
            yield arrow(schema, [keys.astype(np.int64), total])

    counts = rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = materialize(counts, "pairs")
    most = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most"))
    # One row per B id at most, so the size of the vocabulary bounds what is sent to every task.
    return counts.join(F.broadcast(most), F.col("pair") % width == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def commonest(pairs: DataFrame, limit: int) -> int:
    """The least power of two so that at most `limit` pairs have as large a count."""
    tops = {r.p: r["n"] for r in pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    held, power = 0, 64
    while power > 0 and held + tops.get(power - 1, 0) <= limit:
        power -= 1
        held += tops.get(power, 0)
    return power


def scored(rows: DataFrame, pairs: DataFrame, limit: int = HOT_PAIRS) -> DataFrame:
    """Every row of facts() with n_best and count_sum over its links."""
    power = commonest(pairs, limit)
    is_hot = F.col("count") >= F.lit(2**power if power < 63 else 2**63 - 1).cast("long")
    hot = pairs.filter(is_hot).orderBy("pair").toArrow()  # at most `limit` rows
    known = rows.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "count", "best")))
    schema = "row long, n_best long, count_sum long, rest array<long>, times array<long>"

    def run(batches):
        keys, count, best = known.value
        for ids, raws in slices(batches, "row", "links", rows=4 * ROWS):
            out = []
            for raw in raws:
                own, n = unpacked(raw)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                met = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                n, at = n.astype(np.int64), at[met]
                out.append((int((n[met] * best[at]).sum()) if len(at) else 0, int((n[met] * count[at]).sum()) if len(at) else 0, own[~met].astype(np.int64), n[~met]))
            yield arrow(schema, [ids, *map(list, zip(*out, strict=True))])

    near = materialize(rows.select("row", "links").mapInArrow(run, schema), "links-near")
    far = near.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("l")).select("row", F.col("l.rest").alias("pair"), F.col("l.times").alias("times"))
    far = far.join(pairs.filter(~is_hot), "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
    total = near.select("row", "n_best", "count_sum").unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("links").join(total, "row").drop("row")


def align(docs: DataFrame, path_a: str, path_b: str, limit: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    import sentencepiece

    small_batches(docs.sparkSession)
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    rows = materialize(facts(docs, path_a, path_b, width), "alignments")
    return scored(rows, materialize(pair_counts(rows, width), "pair-counts"), limit)
