"""The pipeline's stages on awkward tables, and each of them against a plain version on the sample."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import mixing, quality

from .test_brute_force import plain_lines

SF = "/root/testdata/sf0.001"
CLASHES = "row struct<x: int>, _id int, _text int, _key int, _kept int, _times int, _copy int, _taken int, n_removed string, score string, predicted string, held_out string, taken int, size int, _h int, component_id int, kept int, class_id int, value int, _cell int, _at int, _hash int, _starts int, _gone int"
WORDS = "the river rose in the night and the lower road was closed until the water fell again"
ROWS = [(1, WORDS, "a"), (2, WORDS, "a"), (3, None, None), (4, "", "b"), (5, "x\ny\nz\nw", "b"), (6, "p\nx\ny\nz", None), (7, WORDS + " once", "a"), (None, WORDS, "a"), (1, WORDS, "a"), (8, "\n\n\n", "c")]
EARLY = [name for name, _ in corpus_pipeline.STAGES[:-1]]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    for field in CLASHES.split(", "):
        name, kind = field.split(" ", 1)
        docs = docs.withColumn(name, F.struct(F.lit(7).alias("x")) if kind.startswith("struct") else F.lit(7).cast(kind))
    return docs


@pytest.mark.parametrize("name", EARLY)
def test_stages_keep_columns_of_any_name(spark, awkward, name):
    out = STAGES[name](spark, awkward, SF)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert rows and all(r["row"].x == 7 and r["_id"] == 7 and r["score"] == "7" and r["n_removed"] == "7" and r["_cell"] == 7 for r in rows)


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_empty_tables(spark, awkward, name):
    assert STAGES[name](spark, awkward.limit(0), SF).count() == 0


def test_line_and_near_stages_on_nulls_and_repeats(spark, awkward):
    lines = {r.doc_id: (r.text, r.n_chars) for r in STAGES["line_dedup"](spark, awkward, SF).filter("doc_id <> 1").collect()}
    assert lines[3] == (None, None) and lines[4] == ("", 0) and lines[5] == ("x\ny\nz\nw", 7) and lines[6] == ("p", 1) and lines[8] == ("\n\n\n", 3)
    near = sorted((r.doc_id is None, r.doc_id or 0) for r in STAGES["near_dedup"](spark, awkward, SF).collect())
    assert near == [(False, 1), (False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 8)]  # 7 shares 13 of its 14 shingles with 1


def test_packing_stage_holds_every_row(spark, awkward):
    rows = STAGES["packing"](spark, awkward, SF).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS)


def plain_near(texts: dict) -> set:
    """Ids that stay: the least of each component, over all pairs."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    lead = {d: d for d in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            lo, hi = sorted((lead[a], lead[b]))
            lead = {d: lo if x == hi else x for d, x in lead.items()}
    return {d for d, x in lead.items() if d == x}


def test_the_pipeline_against_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    score = {d: float(model.score(quality.features(t or "")[None])[0]) for d, t in texts.items()}
    assert not any(abs(s - quality.THRESHOLD) < 1e-4 for s in score.values())
    texts = {d: t for d, t in texts.items() if score[d] >= quality.THRESHOLD}
    assert 0 < len(texts) < len(score)
    texts = {d: t for d, (t, n) in plain_lines(texts).items() if not n or t.replace("\n", "").strip(" ")}
    texts = {d: texts[d] for d in plain_near(texts)}
    kept = docs.drop("text", "n_chars").join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id")
    times = {}
    for r in mixing.mix(kept).collect():
        share = r.taken / r["size"] if r["size"] else 1.0
        chance = spark.range(1).select(F.pmod(F.xxhash64(F.lit(r.doc_id).cast("long"), F.lit("mix")), F.lit(1_000_000))).first()[0] / 1e6
        times[r.doc_id] = int(share) + (chance < share - int(share))
    tokenizer, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    rows = corpus_pipeline.run(spark, SF).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert {d: sum(r.start == 0 for r in own) for d, own in got.items()} == {d: n for d, n in times.items() if n}
    for d, own in got.items():
        ids = np.array(tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        assert all(r.doc_tokens == len(ids) and bytes(r.ids) == ids[r.start : r.start + r.length].tobytes() and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)
        assert sum(r.length for r in own) == times[d] * len(ids)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        own = list(own)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own[:-1])] and sum(r.length for r in own) <= 4096
