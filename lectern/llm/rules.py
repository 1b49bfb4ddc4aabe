"""Quality rules with risk-controlled cutoffs.

Every rule gives a text a badness of 0 to 1000. A path of cutoffs, from the loosest to the strictest, is laid out on labelled
rows of one fold (TUNING): first beyond all their good rows, then into their upper tail. The other folds are the holdout. In each
stratum the path is walked from its loose end, and a step is certified while the exact binomial tail says that a true share of
false rejections above ALPHA would hardly ever show so few in the holdout: P(X <= k | n, ALPHA) <= DELTA / strata. Walking in
a fixed order and stopping at the first failure keeps the error of a stratum's whole path at DELTA / strata, and the division
(Bonferroni) keeps that of all strata together at DELTA. Of the certified steps the one that tells the tuning rows apart best is taken;
a stratum where nothing is certified (too few good rows, or none) rejects nothing.

So with a chance of 1 - DELTA or more, no stratum loses over ALPHA of its good texts, of those that pass the base rules, as
long as labelled rows are drawn like the others.

Null text has no words and fails the base rules; a null stratum is one of its own; a null doc_id has no label; rows that
repeat a doc_id get a verdict each, by their own text, and count once in the fit (the least figures of them); a label that is
given twice counts as good if one is; an empty table gives no rows; a very long text is worked on whole; ties fall the same way on
every run; columns of other names are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, materialize, slices, small_batches

ALPHA, DELTA, TUNING, FOLDS = 0.02, 0.05, 2, 4  # doc_ids whose crc32 leaves TUNING of FOLDS lay out the path
LEAST_WORDS, MOST_REPEATED, ROWS = 50, 0.5, 64
# Steps: shares of the way from the worst good tuning row to the scale's end, then shares of good tuning rows beyond the cutoff.
MARGINS, TAILS = (0.75, 0.5, 0.25, 0.125, 0.0625, 0.0), (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)
RULES = ("symbols", "marks", "dup_lines", "repeats", "no_letters", "capitals", "few_distinct", "long_words", "short_words", "same_twice")
TOP = 1000
FIGURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, badness array<long>"
# Fixed values.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LETTERS = UPPER + LOWER + bytes(range(0x80, 0x100))


class Figures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    badness: list[int]


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a window of three words found twice or more."""
    if len(ids) < 4:
        return 0
    _, pairs = np.unique(ids[:-1] * len(ids) + ids[1:], return_inverse=True)
    _, at, n = np.unique(pairs[:-1] * len(ids) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[at] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def figures_of(raw: bytes) -> Figures:
    """Base figures and badness of a text in UTF-8."""
    chars = lambda b: len(b) - sum(np.count_nonzero((np.frombuffer(b, np.uint8, min(1 << 20, len(b) - at), at) & 0xC0) == 0x80) for at in range(0, len(b), 1 << 20))
    words = raw.split()
    n, joined = len(words), raw.translate(None, SPACES)
    n_chars, n_symbols = chars(joined), len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = repeated_words(ids)
    if not n:
        return Figures(0, 0, n_symbols, 0, 0, [0] * len(RULES))
    marks = len(joined) - len(joined.translate(None, MARKS))
    upper, lower = (len(joined) - len(joined.translate(None, c)) for c in (UPPER, LOWER))
    lettered = np.fromiter((bool(w.translate(None, MARKS + b"0123456789")) for w in seen), bool, len(seen))
    same = int(np.count_nonzero(ids[1:] == ids[:-1]))
    mean = n_chars / n
    shares = (
        n_symbols / n, marks / n_chars, dup / max(1, len(lines)), repeat / n, 1 - float(lettered[ids].mean()), upper / max(1, upper + lower),
        1 - len(seen) / n, mean / 40, 1 / max(1.0, mean), same / n,
    )
    return Figures(n, n_chars, n_symbols, dup, repeat, [min(TOP, int(TOP * s)) for s in shares])


def figures(docs: DataFrame, stratum: Column) -> DataFrame:
    """FIGURES of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for ids, strata, texts in slices(batches, "doc_id", "stratum", "raw", rows=ROWS):
            yield arrow(FIGURES, [ids, strata, *map(list, zip(*(figures_of(t or b"") for t in texts), strict=True))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.cast("string").alias("stratum"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, FIGURES)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws of chance p; terms are summed from the largest down. At or above the mean it's no evidence: 1."""
    if k < 0 or n == 0:
        return 0.0 if k < 0 else 1.0
    if k >= n * p:
        return 1.0
    term = total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a share of which k of n were seen: the least p with P(X <= k | p) <= delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    while high - low > 1e-12:
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def path_of(counts: dict[tuple[int, int], int]) -> list[list[int]]:
    """Cutoffs of each step, loosest first, from the counts of good tuning rows by (rule, badness); each step is as strict or stricter."""
    steps = []
    held = [np.zeros(TOP + 2, np.int64) for _ in RULES]
    for (rule, bad), n in counts.items():
        held[rule][bad] += n
    beyond = [h[::-1].cumsum()[::-1] for h in held]  # rows of so much badness or more
    worst = [int(np.flatnonzero(b)[-1]) if b[0] else TOP for b in beyond]
    for m in MARGINS:
        steps.append([w + 1 + int((TOP - w) * m) for w in worst])
    for t in TAILS:
        steps.append([int(np.flatnonzero(b <= t * b[0])[0]) for b in beyond])
    for before, step in zip(steps, steps[1:], strict=False):
        step[:] = map(min, before, step)
    return steps


class Cutoffs(NamedTuple):
    path: list[list[int]]
    strata: DataFrame  # stratum, step (null: nothing certified), good, lost, bound: what the certificate says


def step_of(path: list[list[int]]) -> Column:
    """The first step that rejects a row, or the number of steps."""
    out = F.lit(len(path))
    for i, cuts in reversed(list(enumerate(path))):
        hit = F.lit(False)
        for r, cut in enumerate(cuts):
            if cut <= TOP:
                hit = hit | (F.col("badness")[r] >= cut)
        out = F.when(hit, i).otherwise(out)
    return out


def certified(good: int, firsts: list[int], gains: list[float], alpha: float, share: float) -> tuple[int | None, int]:
    """(step, good rows lost at it): the best gain of the steps that pass in a row from the loosest on; the looser one of ties."""
    best, lost = None, 0
    for i in range(len(firsts)):
        lost_here = sum(firsts[: i + 1])
        if binomial_tail(lost_here, good, alpha) > share:
            break
        if best is None or gains[i] > gains[best]:
            best, lost = i, lost_here
    return best, lost


def fit(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> Cutoffs:
    """Of figures() and labels (doc_id, quality)."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    passed = rows.filter(~base_failed()).groupBy("doc_id").agg(F.min(F.struct("stratum", "badness")).alias("f")).select("doc_id", "f.*")
    tuning = F.crc32(F.col("doc_id").cast("string")) % FOLDS == TUNING
    labelled = materialize(passed.join(known, "doc_id").withColumn("tuning", tuning), "labelled")
    bins = labelled.filter("tuning").select("quality", F.posexplode("badness").alias("rule", "bad")).groupBy("quality", "rule", "bad").count().collect()
    path = path_of({(r.rule, r.bad): r["count"] for r in bins if r.quality == 1})
    # Rows by the step that rejects them first: a stratum gives a row for each quality, fold and step.
    by = labelled.withColumn("step", step_of(path)).groupBy("stratum", "quality", "tuning", "step").count()
    by = materialize(by, "steps")
    tune = {(r.quality, r.step): r["count"] for r in by.filter("tuning").groupBy("quality", "step").agg(F.sum("count").alias("count")).collect()}
    size = {q: max(1, sum(n for (own, _), n in tune.items() if own == q)) for q in (0, 1)}
    gains = [sum(tune.get((0, j), 0) for j in range(i + 1)) / size[0] - sum(tune.get((1, j), 0) for j in range(i + 1)) / size[1] for i in range(len(path))]
    good = by.filter("not tuning and quality = 1").groupBy("stratum").agg(F.sum("count").alias("good"), F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("firsts"))
    share = delta / max(1, good.count())

    @F.udf("struct<step:int,lost:long,bound:double>")  # a call for each stratum
    def chosen(n, firsts):
        step, lost = certified(n, [firsts.get(i, 0) for i in range(len(gains))], gains, alpha, share)
        return step, lost, None if step is None else upper_bound(lost, n, share)

    return Cutoffs(path, good.select("stratum", "good", chosen("good", "firsts").alias("c")).select("stratum", "good", "c.*"))


def judge(docs: DataFrame, labels: DataFrame, stratum: Column, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the base figures, base_failed, failed_rules (those of the stratum's step that a row breaks), kept."""
    rows = materialize(figures(docs, stratum), "figures")
    cut = fit(rows, labels, alpha, delta)
    steps = cut.strata.filter("step is not null").select(F.col("stratum").alias("_s"), F.col("step").alias("_step"))
    cuts = F.get(F.array(*[F.array(*map(F.lit, c)) for c in cut.path]), F.col("_step"))
    failed = F.filter(F.transform(F.array(*map(F.lit, RULES)), lambda r, i: F.when(F.get("badness", i) >= F.get(cuts, i), r)), lambda r: r.isNotNull())
    out = rows.join(steps, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
