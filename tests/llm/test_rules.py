"""Quality rules: figures by brute force, exact bounds, and cutoffs that keep their promise on rows of known make."""

import math
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, rules

SF = "/root/testdata/sf0.001"


def plain(text: str | None):
    """The base figures, word by word."""
    text, spaces = text or "", " \t\n\v\f\r"
    words, word = [], ""
    for c in text + " ":
        if c in spaces:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) for k in range(3) if windows.count(w) > 1} if len(words) < 2000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in spaces for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, covered if covered is None else len(covered)


TEXTS = ["", " \n\t", "a", "a b c a b c", "a a a a", "x\x0by\x0cz\r\nx\x0by\x0cz\r\n", "é|<>#*$%& ü ü 中文 𝒳", "l\nl\n\n \nl \nl", "one two three " * 30, "  \x1c a\x1cb"]


@pytest.mark.parametrize("text", TEXTS)
def test_figures_of_small_texts(text):
    assert tuple(rules.figures_of(text.encode()))[:5] == plain(text)


def test_figures_of_generated_texts():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab  \n\t#|é") for _ in range(rng.randrange(80)))
        assert tuple(rules.figures_of(text.encode()))[:5] == plain(text), text


def test_query_figures_and_base(spark):
    rows = queries.op11_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        assert want[4] is None or r.n_repeat_words == want[4]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 0, 0.02), (10, 3, 0.5), (229, 1, 0.02), (500, 4, 0.02), (2000, 20, 0.02), (50, 20, 0.9)]:
        q = Fraction(p)
        want = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
        assert rules.binomial_tail(k, n, p) == pytest.approx(float(want) if k < n * p else 1.0, rel=1e-9)
    assert rules.binomial_tail(-1, 5, 0.1) == 0 and rules.binomial_tail(0, 0, 0.1) == 1


def test_upper_bound_inverts_the_tail():
    assert rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    for k, n in ((1, 50), (7, 300)):
        assert rules.binomial_tail(k, n, rules.upper_bound(k, n, 0.01)) == pytest.approx(0.01, rel=1e-6)
    assert rules.upper_bound(0, 0, 0.05) == 1 and rules.upper_bound(5, 5, 0.05) == 1


def test_certificates_hold_at_the_promised_rate():
    """Draws whose true loss is just above alpha are certified at most as often as the share allows."""
    rng = random.Random(1)
    wrong = sum(rules.certified(400, [sum(rng.random() < 0.0201 for _ in range(400))], [1.0], 0.02, 0.05)[0] is not None for _ in range(2000))
    assert wrong <= 2000 * 0.05 + 3 * math.sqrt(2000 * 0.05 * 0.95)
    assert rules.certified(1000, [0, 0, 30, 0], [0.5, 0.9, 1.0, 1.0], 0.02, 0.05) == (1, 0)  # the path ends at its first failure
    assert rules.certified(1000, [0, 0], [0.7, 0.7], 0.02, 0.05) == (0, 0)  # the looser one of ties
    assert rules.certified(20, [0], [1.0], 0.02, 0.05) == (None, 0)  # too few rows for any certificate


def planted(spark, n=1600):
    """Clean texts, texts with symbols, and a language without labels."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(80)]
        bad, lang = i % 5 == 0, ("en", "de", None)[i % 3]
        rows.append((i, " ".join(w + "###" if bad else w for w in words), lang if i < n - 200 else "xx", "odd"))
        if i < n - 200:
            labels.append((i, 0 if bad else 1, "odd"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, badness string"), spark.createDataFrame(labels, "doc_id long, quality int, stratum string")


def test_verdicts_by_stratum(spark):
    docs, labels = planted(spark)
    got = {r.doc_id: r for r in rules.judge(docs, labels, F.col("lang")).collect()}
    assert len(got) == docs.count()
    assert all(got[i].kept == (i % 5 != 0 or i >= 1400) for i in got)  # nothing is certified for xx, so it keeps all
    assert "symbols" in got[0].failed_rules and got[1].failed_rules == []
    assert sum(zlib.crc32(str(i).encode()) % rules.FOLDS != rules.TUNING for i in range(1400) if i % 5) > 700
    cut = rules.fit(rules.figures(docs, F.col("lang")), labels)
    said = {r.stratum: r for r in cut.strata.collect()}
    assert set(said) == {"en", "de", None} and all(r.lost == 0 and r.bound <= rules.ALPHA for r in said.values())
    assert all(a >= b for x, y in zip(cut.path, cut.path[1:], strict=False) for a, b in zip(x, y, strict=True))


def test_awkward_rows(spark):
    long = "word other thing here\n" * 60_000
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 1), (1, "", "en", 1), (2, long, "en", 1), (3, "w " * 50, None, 1)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    rows = sorted(rules.judge(docs, labels, F.col("lang")).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.n_words, r.kept) for r in rows] == [(None, 0, False), (1, 0, False), (1, 0, False), (2, 240_000, False), (3, 50, False)]
    assert rows[3].n_dup_lines == 59_999 and rows[3].n_repeat_words == 240_000
    assert rules.judge(docs.limit(0), labels, F.col("lang")).count() == 0
    assert rules.judge(docs, labels.limit(0), F.col("lang")).count() == 5
