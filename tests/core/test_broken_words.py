"""Words broken over blocks and lines against a plain fold; the Bloom filter never loses a key and lets few others through."""

import random
import re

from pyspark.sql import functions as F

from lectern.functions.bloom import Bloom
from lectern.operators import clean

KIND = "book string, section int, place int, kind string, text string"


def plain(blocks, vocabulary):
    """One section's blocks one after the other, each met with what came of those before."""
    out = []
    for kind, text in blocks:
        tail = re.search("([A-Za-z]{2,})-$", out[-1][1]) if out else None
        head = re.match("[a-z]{2,}", text)
        if tail and head and out[-1][0] == kind and (tail[1] + head[0]).lower() in vocabulary:
            out[-1] = (kind, out[-1][1][:-1] + text)
        else:
            out.append((kind, text))
    return out


def test_chains_of_broken_words(spark):
    rng = random.Random(7)
    parts, rows, want = ["ab", "cd", "ef", "Gh", "a", "abC"], [], {}
    words = {b: {"".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))).lower() for _ in range(60)} | {"abcd", "abcdef", "cdab"} for b in ("x", "y", None)}
    for book in words:
        for section in range(40):
            blocks = []
            for _ in range(rng.randrange(1, 9)):
                text = rng.choice(parts) + rng.choice(("-", "-", "-", " z ab-", "", " q"))
                blocks.append((rng.choice(("paragraph", "paragraph", "paragraph", "verse")), rng.choice(("", "", "", "Q ")) + text))
            rows += [(book, section, 3 * k, *b) for k, b in enumerate(blocks)]
            want[book, section] = plain(blocks, words[book])
    blocks = spark.createDataFrame(rows, KIND).repartition(5)
    vocabulary = spark.createDataFrame([(b, w) for b in words for w in sorted(words[b])], "book string, word string")
    got = {}
    for r in sorted(clean.joined_blocks(blocks, vocabulary, "book", "section", "place").collect(), key=lambda r: r.place):
        got.setdefault((r.book, r.section), []).append((r.kind, r.text))
    assert got == want and sum(map(len, want.values())) < len(rows) - 30
    assert clean.joined_blocks(blocks.limit(0), vocabulary, "book", "section", "place").count() == 0
    assert clean.joined_blocks(blocks, vocabulary.limit(0), "book", "section", "place").count() == len(rows)


def test_a_long_chain_of_single_tokens(spark):
    """One word over forty blocks, and a vocabulary that holds each of its beginnings."""
    tokens = [chr(97 + i % 26) * 2 for i in range(40)]
    rows = [("x", 0, i, "paragraph", t + ("-" if i < 39 else "")) for i, t in enumerate(tokens)]
    vocabulary = spark.createDataFrame([("x", "".join(tokens[: k + 1])) for k in range(1, 40)], "book string, word string")
    assert [r.text for r in clean.joined_blocks(spark.createDataFrame(rows, KIND), vocabulary, "book", "section", "place").collect()] == ["".join(tokens)]


def test_broken_words_within_blocks(spark):
    blocks = spark.createDataFrame([(1, "x", "any- thing red- and good- sized any- thing"), (2, "y", "any- thing"), (3, None, "any- thing"), (4, "x", "none")], "key int, book string, text string")
    vocabulary = spark.createDataFrame([("x", "anything"), ("x", "redand"), (None, "anything")], "book string, word string")
    got = {r.key: r.text for r in clean.dehyphenated(blocks, vocabulary, "book", "key").collect()}
    assert got == {1: "anything red- and good-sized anything", 2: "any-thing", 3: "anything", 4: "none"}


def test_bloom_filter(spark):
    keys = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id") * 3).alias("a"), F.lit("é").alias("b"))
    bloom = Bloom.of(keys)
    assert keys.filter(~bloom.may_hold("a", "b")).count() == 0
    others = spark.range(50_000).select((F.col("id") * 3 + 1).alias("a"), F.lit("é").alias("b"))
    assert others.filter(bloom.may_hold("a", "b")).count() < 5000
    assert others.filter(Bloom.of(keys.limit(0)).may_hold("a", "b")).count() == 0


def test_the_filter_goes_below_the_vocabulary_s_aggregation(spark):
    words = spark.createDataFrame([("x", f"w{i % 500}") for i in range(2000)], "book string, word string").groupBy("book", "word").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([("x", "w1"), ("x", "none")], "book string, word string")
    held = clean.held_words(asked, words, "book")
    assert [tuple(r) for r in held.collect()] == [("x", "w1")]
    plan = words.filter(Bloom.of(asked).may_hold("book", "word"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
