"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each text becomes its set of 5-word shingle hashes (64 bits); equal sets form a class, and only classes go on.
2. A sketch is the SKETCH smallest hashes. The first RETAINED of them that are not on a hot list go to inverted
   lists; a class with mostly hot values (a large group of near copies) lists its plain smallest ones, and one in
   between lists both, so that two linked classes always list by the same rule.
3. In each short list and size band every class is compared with the band's leader; the union sketch filters, then the
   full sets decide. Connected classes need no further comparison, so a large group is joined by stars and never
   by all its pairs.
4. In long lists, shingles that no other class of such lists has bound a class's overlap with any of them; a class
   whose bound excludes all links leaves those lists, twice over, as each leaving makes more shingles single. The
   rest of each long list is compared with its class of the highest bound, the most central of the copies.
5. The lists are joined once more, for classes of different components whose bounds allow a link, at the first of
   the values that they share in a row, which restores every other link. Lists with many such pairs for their
   length (form letters filled from a common pool: much shared, nothing linked) aren't joined: their classes get bands of many more values
   from their full sets, so wide that unlinked ones seldom meet, and so many that a link is missed with a chance of 1e-6.

Two sets of similarity 0.85 share none of 12 listed values with a chance of about 1e-10; a hot list can raise that to 1e-5.
Null text and a text without words have the empty set, linked with nothing; rows that repeat a doc_id share the
smallest component; a null doc_id forms no smallest id; of equal sets the smallest doc_id stands for the class; an empty
table gives no rows; a very long text is one set of its own length; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, materialize, slices

SHINGLE, THRESHOLD, SKETCH, RETAINED, HOT_LIST, LONG_LIST = 5, 85, 32, 12, 200, 64
ROUNDS = 2  # of the bound; more would only tighten it
CACHE_ENTRIES = 150_000
UNLIKE, MISSED = 0.6, 1e-6  # see band_shape()
BANDED = "value long, class_id binary, n_shingles long, most long, component binary"
CLASSES = "doc_id long, n_shingles long, class_id binary, sketch array<long>"
SIGN = np.uint64(2**63)  # flipped in sketches, so that signed longs sort as the unsigned hashes


class WordHashes(dict):
    """Hash of each word, computed when first asked for."""

    def __init__(self, hash_of):
        super().__init__()
        self.hash_of = hash_of

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.hash_of(word)
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, width: int = SHINGLE):
        import xxhash

        self.known, self.width = WordHashes(xxhash.xxh64_intdigest), width

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def classes_of(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (digest of the set, null if empty), sketch."""

    def run(batches):
        import xxhash

        shingles = Shingler()
        for doc_ids, texts in slices(batches, "doc_id", "text"):
            sets = list(map(shingles, texts))
            digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield arrow(CLASSES, [doc_ids, list(map(len, sets)), digests, [(s[:SKETCH] ^ SIGN).view(np.int64) for s in sets]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CLASSES)


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """class_id and full set (packed 64-bit hashes) for the classes in `needed` (class_id, rep)."""

    def run(batches):
        shingles = Shingler()
        for ids, texts in slices(batches, "class_id", "text", rows=64):
            yield arrow("class_id binary, shingles binary", [ids, [shingles(t).tobytes() for t in texts]])

    # A rep names one document of the class by doc_id and text, so a repeated doc_id can't bring another text.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    found = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("rep"))).select("class_id", "text")
    rows = found.mapInArrow(run, "class_id binary, shingles binary")

    @F.arrow_udf("binary")
    def digest(s: pa.Array) -> pa.Array:
        import xxhash

        return pa.array([xxhash.xxh128_digest(x.as_buffer()) for x in s], pa.binary())

    return rows.filter(digest("shingles") == F.col("class_id")).groupBy("class_id").agg(F.first("shingles").alias("shingles"))


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose union sketch leaves similarity 0.85 possible (over five standard errors of slack)."""
    a, b = (sketches.select(F.col("class_id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, F.least(F.lit(SKETCH), F.greatest(F.size("sa"), F.size("sb"))))
    both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * THRESHOLD).withColumn("union", union)
    shared = F.size(F.array_intersect("union", F.array_intersect("sa", "sb")))
    return both.filter(shared >= 0.5 * F.size("union")).select("a", "b")


def sets_for(classes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The written full sets of the classes (class_id)."""
    return materialize(full_sets(docs, classes.distinct().join(reps.select("class_id", "rep"), "class_id")), "sets")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("class_id"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= 85 * union."""

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        def one(p, q):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            return 100 * both >= THRESHOLD * (len(p) + len(q) - both)

        return pa.array([one(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())

    both = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("y")), "b")
    return materialize(both.filter(linked("x", "y")).select("a", "b"), "links")


def shared_bound(sets: DataFrame) -> DataFrame:
    """class_id, most: at most so many shingles are in another class of `sets` that may have a link here; 0 means no link."""

    def run(batches):
        for ids, sets in slices(batches, "class_id", "shingles", rows=64):
            halves = np.frombuffer(b"".join(ids), ">i8").reshape(-1, 2).astype(np.int64).repeat([len(s) // 8 for s in sets], axis=0)
            yield arrow("hi long, lo long, shingle long", [halves[:, 0], halves[:, 1], np.frombuffer(b"".join(sets), np.int64)])

    left = sets
    for _ in range(ROUNDS):
        rows = left.select("class_id", "shingles").mapInArrow(run, "hi long, lo long, shingle long")
        single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.max("hi").alias("hi"), F.max("lo").alias("lo")).filter("n = 1")
        owned = single.groupBy("hi", "lo").agg(F.count("*").alias("single"))
        key = [F.conv(F.hex(F.substring("class_id", i, 8)), 16, -10).cast("long").alias(k) for i, k in ((1, "hi"), (9, "lo"))]
        marked = left.select("class_id", "shingles", *key).join(owned, ["hi", "lo"], "left")
        size = F.octet_length("shingles") / 8
        marked = marked.withColumn("most", (size - F.coalesce("single", F.lit(0))).cast("long"))
        left = materialize(marked.filter(F.col("most") * 100 >= size * THRESHOLD).select("class_id", "shingles", "most"), "bounded")
    return sets.select("class_id").join(left.select("class_id", "most"), "class_id", "left").select("class_id", F.coalesce("most", F.lit(0)).alias("most"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """class_id, component: links are contracted to the smaller neighbour, with a pointer jump, until none is left."""
    labels, edges = nodes.select("class_id", F.col("class_id").alias("component")), links
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        best = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")), "best")
        second = best.toDF("v", "w")
        best = materialize(best.join(second, "v", "left").select("u", F.coalesce("w", "v").alias("to")), "best")
        labels = materialize(labels.join(best, labels["component"] == best["u"], "left").select("class_id", F.coalesce("to", "component").alias("component")), "labels")
        left, right = best.toDF("a", "x"), best.toDF("b", "y")
        edges = materialize(edges.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links between classes."""
    if links.isEmpty():
        return labels
    x, y = (labels.select(F.col("class_id").alias(a), F.col("component").alias(c)) for a, c in ("ax", "by"))
    bridges = links.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    bridges = materialize(bridges, "bridges")
    nodes = bridges.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    merged = components(nodes, bridges).toDF("component", "final")
    return materialize(labels.join(merged, "component", "left").select("class_id", F.coalesce("final", "component").alias("component")), "labels")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """value, before (the class's listed value before it), class_id, n_shingles, long: lists of two classes or more."""
    every = reps.select("class_id", "n_shingles", F.explode("sketch").alias("value"))
    hot = every.groupBy("value").count().filter(F.col("count") > HOT_LIST).select("value")
    hot_of = every.join(hot, "value").groupBy("class_id").agg(F.collect_set("value").alias("hot"))  # at most SKETCH values
    marked = reps.join(hot_of, "class_id", "left").withColumn("cool", F.when(F.col("hot").isNull(), F.col("sketch")).otherwise(F.array_except("sketch", "hot")))
    share = F.size("cool") / F.size("sketch")
    none = F.array().cast("array<long>")
    kept = F.array_union(F.when(share >= 0.4, F.slice("cool", 1, RETAINED)).otherwise(none), F.when(share < 0.65, F.slice("sketch", 1, RETAINED)).otherwise(none))
    listed = marked.select("class_id", "n_shingles", F.array_sort(kept).alias("kept"))
    rows = listed.select("class_id", "n_shingles", "kept", F.posexplode("kept").alias("at", "value"))
    rows = rows.select("value", F.get("kept", F.col("at") - 1).alias("before"), "class_id", "n_shingles")
    # The key is an expression, so both sides are exchanged and the list of a hot value can be split.
    shared = rows.groupBy("value").count().filter("count > 1").select("value", (F.col("count") > LONG_LIST).alias("long"))
    return with_lists(rows, shared).select("value", "before", "class_id", "n_shingles", "long")


def with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows joined with what is known of their list, one row a value.

    The key is an expression, so both sides are exchanged for the join and the list of a hot value can be split.
    """
    flipped = F.col("value").bitwiseXOR(F.lit(1).cast("long"))
    known = lists.select(flipped.alias("_v"), *[c for c in lists.columns if c != "value"])
    return rows.join(known.hint("merge"), flipped == F.col("_v")).drop("_v")


def bounded_lists(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """The lists with `most`, without the entries of long lists whose bound excludes all links."""
    crowd = lists.filter("long").select("class_id").distinct()
    if crowd.isEmpty():
        return lists.withColumn("most", F.col("n_shingles"))
    bounds = shared_bound(materialize(sets.join(crowd, "class_id", "left_semi"), "crowd"))
    most = F.when(F.col("long"), F.coalesce("most", "n_shingles")).otherwise(F.col("n_shingles"))
    return lists.join(bounds, "class_id", "left").withColumn("most", most).filter("most > 0")


def band_shape(n: int) -> tuple[int, int]:
    """(least values in a band, bands) for a crowd of n classes.

    Unlinked classes of a crowd agree in a value with a chance of about UNLIKE, so a band of so many values leaves
    about two of them; linked ones agree with 0.85 at least, and so many bands miss them with a chance of MISSED.
    """
    width = max(4, int(np.ceil(np.log(max(n / 2, 2)) / -np.log(UNLIKE))))
    return width, int(np.ceil(np.log(MISSED) / np.log1p(-((THRESHOLD / 100) ** width))))


def matchable(rows: DataFrame) -> DataFrame:
    """The entries of lists (value, n_shingles, most) whose bound allows a link with a set of some size in their list.

    x and y can be linked if min(most) * 185 >= (n_x + n_y) * 85, so the bound of x limits the size of y; sizes are held
    against the list's sizes in steps of two per cent, of which there are few.
    """
    step = lambda n: F.floor(F.log(F.greatest(n, F.lit(1.0))) / -np.log(0.98))
    sizes = rows.groupBy("value").agg(F.collect_set(step(F.col("n_shingles").cast("double"))).alias("_sizes"))
    largest = F.col("most") * ((100 + THRESHOLD) / THRESHOLD) - F.col("n_shingles")
    least = F.col("n_shingles") * (THRESHOLD / 100)
    fits = (largest >= least) & F.exists("_sizes", lambda s: (s >= step(least)) & (s <= step(largest)))
    return with_lists(rows, sizes).filter(fits).drop("_sizes")


def banded_lists(crowd: DataFrame, n: int, sets: DataFrame) -> DataFrame:
    """value (hash of a band), class_id, n_shingles, most, component: a row per class and band, bands of one class left out.

    The values of a band are minima of the full set's hashes under the one hash mixed with a number.
    """
    width, bands = band_shape(n)

    def run(batches):
        salts = np.random.default_rng(1).integers(1, 2**63, (bands, width), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for part in slices(batches, "class_id", "n_shingles", "most", "component", "shingles", rows=64):
            for c, n, most, component, s in zip(*part, strict=True):
                h, least = np.frombuffer(s, np.uint64)[:, None], np.empty((bands, width), np.uint64)
                for b in range(bands):
                    m = h * salts[b]
                    least[b] = ((m ^ (m >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)).min(axis=0)
                out = np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(width):
                    out = (out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                    out ^= out >> np.uint64(32)
                yield arrow(BANDED, [out.view(np.int64), [c] * bands, [n] * bands, [most] * bands, [component] * bands])

    rows = crowd.join(sets.hint("merge"), "class_id").mapInArrow(run, BANDED)
    rows = materialize(rows, "bands")
    shared = rows.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("value")
    return with_lists(rows, shared)


def prefix_lists(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """value (a shingle), class_id, n_shingles, most, component: an exact way for crowds. Linked sets share THRESHOLD of either one's
    shingles, so they share one of those left when that many less one are taken off; the rarest of the crowd are left, and shingles
    of one class alone take places but meet nothing."""
    schema = "class_id binary, n_shingles long, most long, component binary, shingle long"

    def run(batches):
        for c, n, most, component, own in (row for part in slices(batches, "class_id", "n_shingles", "most", "component", "shingles", rows=64) for row in zip(*part, strict=True)):
            h = np.frombuffer(own, np.int64)
            yield arrow(schema, [[c] * len(h), [n] * len(h), [most] * len(h), [component] * len(h), h])

    rows = crowd.join(sets.hint("merge"), "class_id").mapInArrow(run, schema)
    rows = materialize(rows, "crowd-shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    often = often.select(F.col("shingle").alias("value"), "often", (F.col("lo") != F.col("hi")).alias("meets"))
    known = with_lists(rows.withColumnRenamed("shingle", "value").withColumn("_shingle", F.col("value")), often).withColumnRenamed("_shingle", "shingle")
    one = F.struct("often", "shingle", "meets")
    own = known.groupBy("class_id", "n_shingles", "most", "component").agg(F.array_sort(F.collect_list(one)).alias("rare"))  # a class's own shingles
    upto = (F.col("n_shingles") - F.ceil(F.col("n_shingles") * THRESHOLD / 100) + 1).cast("int")
    met = own.select("class_id", "n_shingles", "most", "component", F.explode(F.slice("rare", F.lit(1), upto)).alias("r")).filter("r.meets")
    return met.select(F.col("r.shingle").alias("value"), "class_id", "n_shingles", "most", "component")


def near_groups(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    `exact` compares the classes of crowded lists by prefixes of their full sets, which miss no link, in place of bands, which miss one with
    a chance of MISSED; it takes more candidates where texts share much and are not alike.
    """
    rows = materialize(classes_of(docs), "classes")
    full = rows.filter("class_id is not null")
    reps = materialize(full.groupBy("class_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "reps")
    lists = materialize(inverted_lists(reps), "lists")

    def ordered(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    band = F.floor(F.log(F.col("n_shingles")) / -np.log(THRESHOLD / 100))
    banded = lists.filter("not long").withColumn("band", band)
    leaders = banded.groupBy("value", "band").agg(F.min("class_id").alias("leader"))
    stars = banded.join(leaders, ["value", "band"]).filter(F.col("class_id") != F.col("leader")).select(*ordered("class_id", "leader")).distinct()
    stars = materialize(estimated(stars, reps), "stars")
    sets = sets_for(ends(stars).union(lists.filter("long").select("class_id")), reps, docs)
    labels = components(reps, verified(stars, sets))

    bounded = materialize(bounded_lists(lists, sets).withColumn("band", band), "bounded")
    near = F.least("most_x", "most_y") * (100 + THRESHOLD) >= (F.col("n_x") + F.col("n_y")) * THRESHOLD
    fields = ("before", "class", "n", "most", "c")

    def placed(labels, lists):
        rows = lists.join(labels, "class_id")
        mixed = rows.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("value")
        return with_lists(rows, mixed).select("value", "band", "before", "class_id", "n_shingles", "most", "component")

    crowds = materialize(placed(labels, bounded.filter("long")), "crowds")
    if not crowds.isEmpty():
        central = crowds.groupBy("value", "band").agg(F.max(F.struct(F.col("most") / F.col("n_shingles"), "before", "class_id", "n_shingles", "most", "component")).alias("top"))
        central = central.select("value", "band", *(F.col(f"top.{c}").alias(f"{k}_y") for c, k in zip(("before", "class_id", "n_shingles", "most", "component"), fields, strict=True)))
        x = crowds.toDF("value", "band", *(f"{k}_x" for k in fields))
        spokes = x.join(central, ["value", "band"]).filter((F.col("c_x") != F.col("c_y")) & near).select(*ordered("class_x", "class_y")).distinct()
        labels = joined(labels, verified(estimated(spokes, reps), sets))

    rows_left = materialize(placed(labels, bounded), "placed").drop("band")
    # Only classes of different components meet. A list with too many such pairs for its length is crowded: its classes
    # meet again where many values at once agree.
    own = rows_left.groupBy("value", "component").count().groupBy("value").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("alike"))
    crowded = own.select("value", (F.col("n") * F.col("n") - F.col("alike") > LONG_LIST * F.col("n")).alias("crowded"))
    rows_left = materialize(with_lists(rows_left, crowded), "rest-lists")
    crowd = materialize(matchable(rows_left.filter("crowded")).groupBy("class_id", "n_shingles", "component").agg(F.max("most").alias("most")), "crowd")
    rows_left = rows_left.filter("not crowded").select("value", "before", "class_id", "n_shingles", "most", "component")
    if n := crowd.count():
        again = prefix_lists(crowd, sets) if exact else banded_lists(crowd, n, sets)
        rows_left = rows_left.unionByName(again.withColumn("before", F.lit(None).cast("long")))
    x, y = (rows_left.toDF("value", *(f"{k}_{side}" for k in fields)) for side in "xy")
    # With at most `most` shingles in common, similarity can reach the threshold; for whole sets this is the rule on sizes.
    first = F.coalesce(F.col("before_x") != F.col("before_y"), F.lit(True))  # else the pair meets at that value too
    rest = x.join(y, "value").filter((F.col("c_x") < F.col("c_y")) & near & first).select(*ordered("class_x", "class_y")).distinct()
    rest = materialize(estimated(rest, reps), "rest")
    labels = joined(labels, verified(rest, sets_for(ends(rest), reps, docs)))
    smallest = labels.join(reps.select("class_id", "rep"), "class_id").groupBy("component").agg(F.min("rep").alias("smallest"))
    ids = labels.join(smallest, "component").select("class_id", "smallest")
    out = rows.select("doc_id", "n_shingles", "class_id").join(ids.hint("merge"), "class_id", "left")
    component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
