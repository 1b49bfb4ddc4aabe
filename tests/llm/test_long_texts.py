"""Texts of half a million characters and more are worked on whole: what counts stands at their ends. Ties of near copies."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import exact_dedup, fingerprints, licenses, line_dedup, mixing, near_dedup, secrets

LINES = 30_000
BODY = "\n".join(f"alpha{i} beta gamma{i % 7}" for i in range(LINES))
TAIL = "\npassword = abcdefgh1234\nthe mit license holds\nthe very end"
LONG = BODY + TAIL


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a", len(LONG)), (2, LONG + " x", "en", "b", len(LONG) + 2), (3, "Other words\n" + TAIL[1:], "en", "b", 70), (4, LONG.upper(), "en", "a", len(LONG))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def by_id(rows):
    return {r.doc_id: r for r in rows.collect()}


def test_secrets(docs):
    got = by_id(secrets.scan(docs, F.struct("source", "lang"), F.col("source")))
    at = LONG.index("password")
    assert got[1].n_assign == 1 and f"assign:{at}:{at + len('password = abcdefgh1234')}" in got[1].spans


def test_mixing(docs):
    got = by_id(mixing.mix(docs))
    assert got[1].size == len(LONG.split()) and got[1].taken <= 3 * got[1].size and sum(r.taken for r in got.values()) > 0


def test_exact_dedup(docs):
    got = by_id(exact_dedup.dedup(docs))
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, True, True, True] and got[1].keep_id == 4


def test_near_dedup(docs):
    got = by_id(near_dedup.near_groups(docs))
    words = LONG.lower().split()
    assert got[1].n_shingles == len(set(zip(*[words[i:] for i in range(5)], strict=False)))
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 1]


def test_line_dedup(docs):
    got = by_id(line_dedup.dedup_lines(docs))
    assert got[1].n_removed == 0 and got[2].n_removed == LINES + 2 and got[3].n_removed == 3 and got[3].text == "Other words"


def test_licenses(docs):
    got = by_id(licenses.scan(docs))
    assert got[1].n_base == 1 and got[1].base_labels == "mit" and got[1].first_word > 3 * LINES - 1


def test_fingerprints(docs):
    got = by_id(fingerprints.fingerprint(docs))
    assert got[1].n_chars == len(LONG) and len(got) == 4


def test_pipeline_stages(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert by_id(corpus_pipeline.near_stage(spark, docs, "")).keys() == {1, 3}
    cleaned = by_id(corpus_pipeline.line_stage(spark, docs, ""))
    assert cleaned[3].text == "Other words" and cleaned[1].text == LONG and cleaned[2].n_chars == len(cleaned[2].text)
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 12 and labels.isEmpty()


def test_ties_of_near_copies(spark):
    """Pairs at the threshold itself, equal sets in another order, and repeated ids: the smallest id of each group stays."""
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    half = [*words[:-8], *(f"z{i}" for i in range(8))]  # shares 92 of them: 92 of 108
    rows = [(9, " ".join(words)), (4, " ".join(words).upper()), (4, " ".join(half)), (7, " ".join(half)), (2, "a b c d e f"), (8, "a b c d e f"), (8, "a b c d e f")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (4, 4, True), (4, 4, True), (7, 4, False), (8, 2, False), (8, 2, False), (9, 4, False)]
    assert 100 * 92 >= 85 * 108
