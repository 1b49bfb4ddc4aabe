"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Spans come from the lengths of matches and of the text between them (split and regexp_extract_all see the same
leftmost matches). Values are hashed and counted by distinct owner and repository over the corpus: a value that several
owners hold is a copied example, one that a single owner holds looks live. Base spans always stay; a candidate of the
other kinds becomes a span only if its value is owner-specific and it meets no base span. Null text counts as empty; a
null owner is an owner of its own; a null doc_id and repeated rows keep their own result each; an empty table gives no
rows; a very long text is scanned whole, each run of characters once; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize

# Kind, pattern, group holding the value, least characters of the value.
BASE = [
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", "([0-9a-f]{32,})", 1, 32),
]
# Candidates: spans only where one owner alone holds the value.
CANDIDATES = [
    ("jwt", "(eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]*)", 1, 1),
    ("forge", "(gh[pousr]_[A-Za-z0-9]{36,})", 1, 1),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\\x20\\x09-\\x0D]+)", 1, 32),
    ("mixed", "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])([A-Za-z0-9+/_-]{20,})", 1, 20),
]
SHARED_OWNERS = 2  # a value of so many owners or more is a copied example


def spans_of(text, kind: str, order: int, pattern: str, group: int, least: int):
    """Array of struct(start, order, kind, end, value), by start."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    step = F.zip_with(gaps, F.arrays_zip(whole.alias("m"), value.alias("v")), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m["m"]).alias("m"), m["v"].alias("v")))
    step = F.filter(step, lambda s: s["m"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>").alias("out"))

    def add(acc, s):
        start = acc["at"] + s["g"]
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start + s["m"]).alias("end"), s["v"].alias("value"))
        return F.struct((start + s["m"]).alias("at"), F.when(F.length(s["v"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(step, zero, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(zero["out"])


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repository, owner) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, all spans, and how many values are copied or owner-specific."""
    rows = docs.select("doc_id", repository.alias("repository"), owner.alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = BASE + CANDIDATES
    for i, (kind, pattern, group, least) in enumerate(kinds):
        rows = rows.withColumn(f"_{kind}", spans_of(F.col("text"), kind, i, pattern, group, least))
    base = F.concat(*[F.col(f"_{k[0]}") for k in BASE])
    every = F.concat(base, *[F.filter(f"_{k[0]}", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))) for k in CANDIDATES])
    hashed = F.transform(F.array_sort(every), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("value")))
    counts = [F.size(f"_{k[0]}").cast("long").alias(f"n_{k[0]}") for k in BASE]
    # Only hashes of values are written.
    found = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "repository", "owner", *counts, hashed.alias("every")), "secrets")
    values = found.filter(F.size("every") > 0).select("_row", "repository", "owner", F.explode(F.transform("every", lambda s: s["value"])).alias("_value"))
    # Partial sums over (value, owner, repository) come first, so a value held everywhere stays small.
    held = values.groupBy("_value", "owner", "repository").count().groupBy("_value", "owner").agg(F.count("*").alias("r"))
    held = held.groupBy("_value").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    per_doc = hot_join(values.select("_row", "_value"), held, "_value").groupBy("_row").agg(
        F.collect_set(F.when(F.col("owners") >= SHARED_OWNERS, F.col("_value"))).alias("_copied"), F.max("repositories").alias("most_repositories")
    )  # at most a document's own values
    out = found.join(per_doc.hint("merge"), "_row", "left")
    copied = F.coalesce("_copied", F.array().cast("array<long>"))
    own = F.filter("every", lambda s: s["ord"] < len(BASE))
    spans = F.filter("every", lambda s: (s["ord"] < len(BASE)) | ~F.array_contains(copied, s["value"]))
    n_copied = F.size(F.filter("every", lambda s: F.array_contains(copied, s["value"])))
    return out.select(
        "doc_id", *[f"n_{k[0]}" for k in BASE], F.sha2(joined(own), 256).alias("base_sha256"), joined(spans).alias("spans"), n_copied.cast("long").alias("n_copied"),
        (F.size("every") - n_copied).cast("long").alias("n_owner_specific"), F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"),
    )
