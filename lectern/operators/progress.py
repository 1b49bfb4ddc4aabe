"""Reading progress: validation, sanitizing, merging, upserts and what is derived from positions.

A progress record has the columns of PROGRESS. Positions are structs (section, block, char) that compare in that order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import names as N

# Fixed values.
POSITION = "struct<section: bigint, block: bigint, char: bigint>"
LIFETIME = "struct<chars: bigint, errors: bigint, time_ms: bigint, sessions: bigint>"
PROGRESS = f"book_id string, position {POSITION}, completed bigint, total bigint, updated_at bigint, lifetime {LIFETIME}, best_wpm double, overrides map<string, boolean>"
SETTINGS = {
    "theme": "serika_dark", "font_family": "Roboto Mono", "font_size": 2.0, "caret_style": "line", "smooth_caret": True, "stop_on_error": "off",
    "fold_accents": True, "sound_on_click": False, "show_live_wpm": True,
}
CARETS, STOPS, FONT_SIZES, OLD_FONT_SIZE = ("line", "block", "underline", "off"), ("off", "letter", "word"), (0.8, 3.0), 1.5
OUTCOMES, PLANNER_VERSION, HISTORY = ("completed", "skipped", "recovered"), 1, 64
COUNTERS = ("chars", "errors", "time_ms", "sessions")


def position(section, block, char) -> Column:
    return F.struct(F.lit(section).cast("long").alias("section"), F.lit(block).cast("long").alias("block"), F.lit(char).cast("long").alias("char")) if isinstance(section, int) else F.struct(section.alias("section"), block.alias("block"), char.alias("char"))


def with_json(rows: DataFrame, raw: Column, name: str = "_json") -> DataFrame:
    """The rows with the JSON text parsed once, as a variant; null where it is no JSON or says a key twice.

    The parse is a step of its own, so no later filter or field parses again.
    """
    return rows.select("*", F.inline(F.array(F.struct(F.try_parse_json(raw).alias(name)))))


def kind_at(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def number_at(v: Column, path: str) -> Column:
    """A number, else null; "3" is not a number."""
    return F.when(kind_at(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def count_at(v: Column, path: str) -> Column:
    """A non-negative whole number, else null; 3.0 is whole."""
    n = number_at(v, path)
    return F.when((n >= 0) & (n == F.floor(n)), F.coalesce(F.when(kind_at(v, path) == "BIGINT", F.try_variant_get(v, path, "long")), n.try_cast("long")))


def text_at(v: Column, path: str) -> Column:
    return F.when(kind_at(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def flag_at(v: Column, path: str) -> Column:
    return F.when(kind_at(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def parsed_progress(v: Column) -> Column:
    """A progress record of its JSON as a variant; null where any field is missing, of the wrong kind or out of range."""
    best, raw = number_at(v, "$.bestWpm"), F.try_variant_get(v, "$.sectionOverrides", "map<string, variant>")
    flags = F.forall(F.map_values(raw), lambda x: F.schema_of_variant(x) == "BOOLEAN")
    fields = {
        "book_id": text_at(v, "$.bookId"), "position": F.struct(*[count_at(v, f"$.position.{k}Index").alias(k) for k in ("section", "block", "char")]),
        "completed": count_at(v, "$.charsCompleted"), "total": count_at(v, "$.totalChars"), "updated_at": count_at(v, "$.updatedAt"),
        "lifetime": F.struct(*[count_at(v, f"$.lifetime.{k}").alias(c) for k, c in (("charsTyped", "chars"), ("errors", "errors"), ("timeMs", "time_ms"), ("sessions", "sessions"))]),
        "best_wpm": F.when(best >= 0, best), "overrides": F.transform_values(raw, lambda k, x: F.try_variant_get(x, "$", "boolean")),
    }
    out = F.struct(*[c.alias(k) for k, c in fields.items()])
    numbers = [fields[k] for k in ("completed", "total", "updated_at", "best_wpm")] + [fields["position"][k] for k in ("section", "block", "char")] + [fields["lifetime"][k] for k in COUNTERS]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in numbers])
    return F.when(fields["book_id"].isNotNull() & known & (fields["completed"] <= fields["total"]) & flags, out)


def sanitized(records: DataFrame, key: str = "key", raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(valid records by PROGRESS, rejected rows): a bad record or a key that is not its own id is dropped, the rest kept."""
    rows = with_json(records, F.col(raw))
    rows = rows.withColumn("record", parsed_progress(F.col("_json"))).drop("_json")
    rows = rows.withColumn("fine", F.coalesce(F.col("record.book_id") == F.col(key), F.lit(False)))
    return rows.filter("fine").select("record.*"), rows.filter("not fine").select(key, raw)


def payload_is_valid(v: Column) -> Column:
    """The top level of a sync file: version 1, a whole time, and three objects."""
    objects = [F.coalesce(kind_at(v, f"$.{k}").startswith("OBJECT"), F.lit(False)) for k in ("progress", "knownBooks", "settings")]
    return reduce(lambda a, b: a & b, [F.coalesce(number_at(v, "$.version") == 1, F.lit(False)), count_at(v, "$.updatedAt").isNotNull(), *objects])


def settings_of(v: Column, root: str = "$") -> Column:
    """Settings of a variant: each field that is valid, else its default; unknown fields go."""
    path = lambda k: f"{root}." + "".join(p.title() if i else p for i, p in enumerate(k.split("_")))
    fields = []
    for k, default in SETTINGS.items():
        if isinstance(default, bool):
            own = flag_at(v, path(k))
        elif k == "font_size":
            own = number_at(v, path(k))
            own = F.when(own.between(*FONT_SIZES), own)
        else:
            own = text_at(v, path(k))
            if k in ("caret_style", "stop_on_error"):
                own = F.when(own.isin(*(CARETS if k == "caret_style" else STOPS)), own)
        fields.append(F.coalesce(own, F.lit(default)).alias(k))
    return F.struct(*fields, N.visible_lines(number_at(v, path("context_lines"))).alias("context_lines"), N.lesson_length(number_at(v, path("lesson_length"))).alias("lesson_length"))


def migrated(settings: Column, version: Column) -> Column:
    """The old default font size becomes the new one, once: not where a version from 1 on is stored."""
    old = (F.coalesce(version, F.lit(0)) < 1) & (settings["font_size"] == OLD_FONT_SIZE)
    return settings.withField("font_size", F.when(old, SETTINGS["font_size"]).otherwise(settings["font_size"]))


def union_of(older: Column, newer: Column) -> Column:
    """Overrides of both; the newer wins."""
    none = F.create_map().cast("map<string, boolean>")
    return F.map_zip_with(F.coalesce(older, none), F.coalesce(newer, none), lambda k, o, n: F.coalesce(n, o))


def merged_record(l: Column, r: Column) -> Column:
    """One record of two: position and counts of the newer (ties: the first), counters and best by maxima, overrides of both."""
    first = r.isNull() | (l.isNotNull() & (l["updated_at"] >= r["updated_at"]))
    newer, older = F.when(first, l).otherwise(r), F.when(first, r).otherwise(l)
    lifetime = F.struct(*[F.greatest(l["lifetime"][c], r["lifetime"][c]).alias(c) for c in COUNTERS])
    return F.struct(
        newer["book_id"].alias("book_id"), newer["position"].alias("position"), newer["completed"].alias("completed"), newer["total"].alias("total"), newer["updated_at"].alias("updated_at"),
        lifetime.alias("lifetime"), F.greatest(l["best_wpm"], r["best_wpm"]).alias("best_wpm"), union_of(older["overrides"], newer["overrides"]).alias("overrides"),
    )


def merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Records of either side, merged where both hold a book."""
    l, r = (d.select(F.col("book_id").alias("k"), F.struct(*d.columns).alias(s)) for d, s in ((local, "l"), (remote, "r")))
    return l.join(r, "k", "full").select(merged_record(F.col("l"), F.col("r")).alias("m")).select("m.*")


def merge_known(local: DataFrame, remote: DataFrame) -> DataFrame:
    """book_id, title, author of either side; the remote one wins."""
    r = remote.select("book_id", F.struct("title", "author").alias("r"))
    both = local.select("book_id", F.struct("title", "author").alias("l")).join(r, "book_id", "full")
    return both.select("book_id", F.coalesce("r", "l").alias("b")).select("book_id", "b.*")


def merged_settings(local: Column, remote: Column, local_at: Column, remote_at: Column, inbound_wins: bool = False) -> Column:
    """The remote ones only if strictly newer; an imported file's always."""
    return remote if inbound_wins else F.when(remote_at > local_at, remote).otherwise(local)


def initial(books: DataFrame) -> DataFrame:
    """Progress of books (book_id, total, overrides, at) that nobody has read."""
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTERS])
    none = F.create_map().cast("map<string, boolean>")
    return books.select("book_id", position(0, 0, 0).alias("position"), F.lit(0).cast("long").alias("completed"), F.col("total").cast("long").alias("total"), F.col("at").alias("updated_at"), zero.alias("lifetime"), F.lit(0.0).alias("best_wpm"), F.coalesce("overrides", none).alias("overrides"))


def reimport(existing: DataFrame, books: DataFrame) -> DataFrame:
    """Progress after books are imported: what was read stays, totals, overrides and times are new."""
    fresh = initial(books).select("book_id", F.struct("*").alias("n"))
    both = fresh.join(existing.select("book_id", F.struct("*").alias("e")), "book_id", "left")
    kept = F.col("e").withField("total", F.col("n.total")).withField("overrides", F.col("n.overrides")).withField("updated_at", F.col("n.updated_at"))
    return both.select(F.coalesce(kept, F.col("n")).alias("m")).select("m.*")


def accumulated(progress: DataFrame, runs: DataFrame) -> DataFrame:
    """Progress after scored runs (book_id, chars, errors, time_ms, wpm): counters grow, a run is a session, best wpm is the largest."""
    by = runs.filter("chars > 0").groupBy("book_id").agg(F.sum("chars").alias("c"), F.sum("errors").alias("e"), F.sum("time_ms").alias("t"), F.count("*").alias("s"), F.max("wpm").alias("w"))
    zero = F.lit(0)
    grown = F.struct(*[(F.col(f"lifetime.{c}") + F.coalesce(F.col(k), zero)).alias(c) for c, k in zip(COUNTERS, "cets", strict=True)])
    return progress.join(by, "book_id", "left").withColumn("lifetime", grown).withColumn("best_wpm", F.greatest("best_wpm", "w")).drop("c", "e", "t", "s", "w")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows put by key; of several rows of a key the last by `at` stays."""
    newest = Window.partitionBy(key).orderBy(F.desc("_own"), F.desc("at"))
    both = table.withColumn("_own", F.lit(0)).unionByName(rows.withColumn("_own", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_own")


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def anchor_is_valid(anchor: Column) -> Column:
    """start before end, a target on offer, a known planner version."""
    return (anchor["start"] < anchor["end"]) & anchor["target"].isin(*N.LESSON_LENGTHS) & anchor["version"].between(1, PLANNER_VERSION)


def result_is_valid(r: Column) -> Column:
    """No result, or finite numbers in range with errors within characters."""
    fine = [(r[c] >= 0) & (r[c] < float("inf")) for c in ("wpm", "raw_wpm", "accuracy", "consistency", "chars", "errors", "elapsed_ms")]
    return r.isNull() | F.coalesce(reduce(lambda a, b: a & b, fine) & (r["accuracy"] <= 100) & (r["consistency"] <= 100) & (r["errors"] <= r["chars"]), F.lit(False))


def history_is_valid(history: Column, frontier: Column) -> Column:
    """Of the newest 64 records (oldest first) each is valid, begins at or after the one before ends, and ends before the frontier."""
    kept = F.slice(history, F.greatest(F.lit(1), F.size(history) - HISTORY + 1), HISTORY)
    fine = F.forall(kept, lambda r: F.coalesce(anchor_is_valid(r["anchor"]) & r["outcome"].isin(*OUTCOMES) & (r["anchor"]["end"] <= frontier["start"]), F.lit(False)))
    pairs = F.transform(kept, lambda r, i: (i == 0) | (F.get(kept, i - 1)["anchor"]["end"] <= r["anchor"]["start"]))
    return fine & F.forall(pairs, lambda p: p)


def in_anchor(at: Column, anchor: Column) -> Column:
    """Half-open: a place at the end is beyond it."""
    return (at >= anchor["start"]) & (at < anchor["end"])


SECTION_BITS, BLOCK_BITS, CHAR_BITS = 18, 21, 24


def place_code(at: Column) -> Column:
    """A place as one number of the same order; what is beyond a field's bits counts as its largest, so order may tie but never turns."""
    cut = lambda c, bits: F.least(F.greatest(at[c], F.lit(0)), F.lit(2**bits - 1)).cast("long")
    return cut("section", SECTION_BITS) * 2 ** (BLOCK_BITS + CHAR_BITS) + cut("block", BLOCK_BITS) * 2**CHAR_BITS + cut("char", CHAR_BITS)


def places_in_anchors(places: DataFrame, anchors: DataFrame, book: str) -> DataFrame:
    """Each place (book, `at`) with each anchor (book, `start`, `end`) that holds it, half-open, and all columns of both.

    An interval join by buckets of its own size: an anchor belongs to the level whose buckets are as long as itself or up to
    twice, so it lies in two of them at most, and a place is looked up in one bucket of each level there is. No bucket is wider than
    its anchors, so short anchors stay apart however long others are, and a book of many rows spreads over its buckets. Rows of
    null books, places or ends, and anchors that end before they begin, meet nothing.
    """
    code = lambda c: place_code(F.col(c))
    own = anchors.filter(F.col(book).isNotNull() & (F.col("start") < F.col("end"))).withColumn("_low", code("start")).withColumn("_high", code("end"))
    own = own.withColumn("_level", F.ceil(F.log2(F.col("_high") - F.col("_low") + 1)).cast("int"))
    wide = lambda c: F.call_function("shiftright", F.col(c), F.col("_level"))
    own = own.withColumn("_cell", F.explode(F.array_distinct(F.array(wide("_low"), wide("_high"))))).withColumnRenamed(book, "_book").drop("_low", "_high")
    # At most as many levels as a code has bits.
    levels = sorted(r[0] for r in own.select("_level").distinct().collect())
    asked = places.filter(F.col(book).isNotNull() & F.col("at").isNotNull()).withColumn("_code", code("at"))
    asked = asked.withColumn("_l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_c", F.call_function("shiftright", F.col("_code"), F.col("_l"))).drop("_code")
    held = asked.join(own, (F.col(book) == F.col("_book")) & (F.col("_l") == F.col("_level")) & (F.col("_c") == F.col("_cell")))
    return held.filter(in_anchor(F.col("at"), F.struct("start", "end"))).drop("_l", "_c", "_level", "_cell", "_book")


# Queries: events are records of two devices, conversations are books of turns.


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _device(spark, sf_dir, k: int) -> DataFrame:
    """Events of ids that leave the rest k by 2, as progress records of a device."""
    e = _t(spark, sf_dir, "events").filter(F.col("event_id") % 2 == k).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    by = e.groupBy("user_id").agg(F.max("us").alias("at"), F.max_by("event_id", "us").alias("last"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("best"))
    flags = [x for i in range(k, k + 2) for x in (F.lit(f"s{i}"), (F.col("user_id") + i) % 2 == 0)]
    lifetime = F.struct(F.col("n").alias("chars"), F.col("errors").alias("errors"), (F.col("n") * 1000).alias("time_ms"), (F.col("user_id") % 7).alias("sessions"))
    return by.select(F.col("user_id").cast("string").alias("book_id"), position(F.col("last") % 5, F.col("last") % 11, F.col("last") % 90).alias("position"), F.col("n").alias("completed"), (F.col("n") * 2).alias("total"), F.col("at").alias("updated_at"), lifetime.alias("lifetime"), F.round("best", 6).alias("best_wpm"), F.create_map(*flags).alias("overrides"))


def shown_overrides(m: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")


def payload_merge(spark, sf_dir):
    m = merge(_device(spark, sf_dir, 0), _device(spark, sf_dir, 1))
    return m.select("book_id", "position.section", "position.block", "position.char", "completed", "total", "updated_at", *[F.col(f"lifetime.{c}").alias(c) for c in COUNTERS], "best_wpm", shown_overrides(F.col("overrides")).alias("overrides"))


_RAW = """concat('{"bookId":"', cast(user_id as varchar(9)), '","position":{"sectionIndex":', case when user_id % 11 = 0 then '-1' else cast(user_id % 5 as varchar(9)) end,
    ',"blockIndex":0,"charIndex":2},"charsCompleted":', cast(n as varchar(9)), ',"totalChars":', cast(case when user_id % 7 = 0 then n - 1 else n + 5 end as varchar(9)),
    ',"updatedAt":', case when user_id % 13 = 0 then '"5"' else '5' end, ',"lifetime":{"charsTyped":', cast(n as varchar(9)), ',"errors":1,"timeMs":2,"sessions":3},"bestWpm":',
    case when user_id % 17 = 0 then 'null' else '61.5' end, ',"extra":1,"sectionOverrides":{"s1":', case when user_id % 19 = 0 then '1' else 'true' end, '}}')"""


def _raw_records(spark, sf_dir):
    n = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.when(F.col("user_id") % 23 == 0, "other").otherwise(F.col("user_id").cast("string")).alias("key"), F.expr(_RAW).alias("raw"))


def valid_progress(spark, sf_dir):
    """JSON records with planted faults: the valid ones, typed."""
    good, _ = sanitized(_raw_records(spark, sf_dir))
    return good.select("book_id", "position.section", "completed", "total", "lifetime.chars", "best_wpm", shown_overrides(F.col("overrides")).alias("overrides"))


def rejected_progress(spark, sf_dir):
    _, bad = sanitized(_raw_records(spark, sf_dir))
    return bad.select("key", F.length("raw").alias("size"))


def payload_check(spark, sf_dir):
    """Top-level checks of sync files with planted faults, and settings filled with defaults and migrated."""
    n = _t(spark, sf_dir, "events").select("user_id").distinct()
    parts = [
        F.when(F.col("user_id") % 3 == 0, '{"version":2').otherwise('{"version":1'), F.when(F.col("user_id") % 5 == 0, ',"updatedAt":"x"').otherwise(',"updatedAt":9'),
        F.when(F.col("user_id") % 7 == 0, ',"progress":[]').otherwise(',"progress":{}'), F.lit(',"knownBooks":{},"settings":{"fontSize":'),
        F.when(F.col("user_id") % 2 == 0, "1.5").otherwise("9"), F.lit(',"caretStyle":"'), F.when(F.col("user_id") % 4 == 0, "block").otherwise("blob"), F.lit('","soundOnClick":true,"lessonLength":125,"contextLines":1,"zzz":1}}'),
    ]
    rows = with_json(n.select("user_id", F.concat(*parts).alias("raw")), F.col("raw"))
    s = migrated(settings_of(F.col("_json"), "$.settings"), F.when(F.col("user_id") % 8 == 0, 1))
    return rows.select("user_id", payload_is_valid(F.col("_json")).alias("valid"), s.alias("s")).select("user_id", "valid", "s.font_size", "s.caret_style", "s.sound_on_click", "s.lesson_length", "s.context_lines", "s.theme")


def known_books(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.col("lang").alias("title"), F.col("source").alias("author"))
    return merge_known(docs.filter("book_id % 3 <> 0"), docs.filter("book_id % 2 = 0").withColumn("title", F.upper("title")))


def settings_merge(spark, sf_dir):
    """Whose settings hold after a merge: the remote ones if strictly newer; an import takes them always."""
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("a"), F.max("event_id").alias("b"))
    l, r, at = F.lit("local"), F.lit("remote"), (F.col("a") * 7, F.col("b"))
    return e.select("user_id", merged_settings(l, r, *at).alias("merged"), merged_settings(l, r, *at, inbound_wins=True).alias("imported"), F.greatest(*at).alias("updated_at"))


def reimported(spark, sf_dir):
    """Half the books were read before; all are imported again."""
    books = _t(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 3).alias("total")).select(F.col("user_id").cast("string").alias("book_id"), "total", F.lit(None).cast("map<string, boolean>").alias("overrides"), F.lit(77).cast("long").alias("at"))
    rows = reimport(_device(spark, sf_dir, 0).filter("cast(book_id as int) % 2 = 0"), books)
    return rows.select("book_id", "completed", "total", "updated_at", "lifetime.chars", "best_wpm", shown_overrides(F.col("overrides")).alias("overrides"))


def lifetime_totals(spark, sf_dir):
    """One device's counters after the other device's events are runs of a day each."""
    e = _t(spark, sf_dir, "events").filter("event_id % 2 = 1")
    runs = e.groupBy(F.col("user_id").cast("string").alias("book_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("chars"), F.count_if(F.col("event_type") == "error").alias("errors"), (F.count("*") * 500).alias("time_ms"), F.round(F.max("value"), 6).alias("wpm"))
    rows = accumulated(_device(spark, sf_dir, 0), runs)
    return rows.select("book_id", *[F.col(f"lifetime.{c}").alias(c) for c in COUNTERS], "best_wpm")


def upserted(spark, sf_dir):
    """Documents put again under ids of their own or new ones, then some deleted."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit(1).alias("at"))
    more = docs.filter("id % 4 = 0").select((F.col("id") * F.when(F.col("id") % 8 == 0, 1).otherwise(-1)).alias("id"), F.upper("title").alias("title"), F.lit(2).alias("at"))
    return without(upsert(docs, more, "id"), docs.filter("id % 10 = 0"), "id")


def history_validity(spark, sf_dir):
    """Each user's events as lessons: (section, block, char) from ids; valid if in order, on offer and before the frontier."""
    e = _t(spark, sf_dir, "events")
    at = lambda x: position(F.lit(0).cast("long"), F.col("event_id").cast("long"), F.lit(x).cast("long"))
    anchor = F.struct(at(0).alias("start"), at(5).alias("end"), F.when(F.col("event_id") % 97 == 0, 110).otherwise(125).alias("target"), F.lit(1).alias("version"))
    record = F.struct(anchor.alias("anchor"), F.when(F.col("event_type") == "error", "recovered").otherwise("completed").alias("outcome"))
    by = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))).alias("all"), F.max("event_id").alias("last"))
    frontier = F.struct(position(F.lit(0).cast("long"), F.col("last") + F.when(F.col("user_id") % 5 == 0, -1).otherwise(1), F.lit(0).cast("long")).alias("start"))
    return by.select("user_id", history_is_valid(F.transform("all", lambda x: x["r"]), frontier).alias("valid"))


def navigation_results(spark, sf_dir):
    """Results of lessons with planted faults: none, or finite numbers in range."""
    e = _t(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("v"))
    k = F.col("event_id")
    numbers = {"wpm": F.when(k % 7 == 0, -1.0).otherwise(F.col("v")), "raw_wpm": F.when(k % 11 == 0, float("inf")).otherwise(F.col("v")), "accuracy": (k % 105).cast("double"), "consistency": (k % 103).cast("double"), "chars": k % 20, "errors": k % 13, "elapsed_ms": F.when(k % 17 != 0, 5.0)}
    result = F.when(k % 5 != 0, F.struct(*[v.alias(n) for n, v in numbers.items()]))
    return e.select("event_id", result_is_valid(result).alias("valid"))


def active_lesson(spark, sf_dir):
    """Which turns lie in a conversation's active lesson, half-open; the order of positions is that of their fields."""
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 7).alias("c"))
    at = position(F.lit(0).cast("long"), F.col("turn"), F.col("c"))
    anchor = F.struct(position(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(3).cast("long")).alias("start"), position(F.lit(0).cast("long"), F.lit(3).cast("long"), F.lit(3).cast("long")).alias("end"))
    return t.select("conv_id", "turn", in_anchor(at, anchor).alias("active"))


def active_anchors(spark, sf_dir):
    """Places in each line of each document against anchors over one to six lines, and over every text's first thousand lines."""
    docs = _t(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("b", "line")).select("doc_id", F.col("b").cast("long").alias("b"))
    zero = F.lit(0).cast("long")
    places = lines.select("doc_id", position(zero, F.col("b"), (F.col("b") * 5 + F.col("doc_id")) % 40).alias("at"))
    short = lines.select("doc_id", F.col("b").alias("anchor"), position(zero, F.col("b"), F.col("doc_id") % 7).alias("start"), position(zero, F.col("b") + F.col("b") % 6, (F.col("doc_id") + F.col("b")) % 30).alias("end"))
    long = docs.select("doc_id", F.lit(-1).cast("long").alias("anchor"), position(zero, zero, zero).alias("start"), position(zero, zero + 1000, zero).alias("end"))
    return places_in_anchors(places, short.unionByName(long), "doc_id").select("doc_id", F.col("at.block").alias("block"), F.col("at.char").alias("char"), "anchor")


def library_list(spark, sf_dir):
    """Conversations as books with progress where a user of that number has any: percent done, newest first."""
    books = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    read = _device(spark, sf_dir, 0).select(F.col("book_id").cast("long").alias("conv_id"), "completed", "total", "best_wpm", "updated_at")
    rows = books.join(read, "conv_id", "left")
    done = N.percent_done(F.coalesce("completed", F.lit(0)), F.coalesce("total", F.lit(0)))
    return rows.select("conv_id", "chars", done.alias("percent"), F.when(F.col("best_wpm") > 0, F.floor(F.col("best_wpm") + 0.5)).alias("best")).orderBy(F.desc_nulls_last("updated_at"), "conv_id")


QUERIES = {
    "payload_merge": payload_merge, "valid_progress": valid_progress, "rejected_progress": rejected_progress, "payload_check": payload_check, "known_books": known_books,
    "settings_merge": settings_merge, "reimported": reimported, "lifetime_totals": lifetime_totals, "upserted": upserted, "history_validity": history_validity,
    "active_lesson": active_lesson, "active_anchors": active_anchors, "library_list": library_list, "navigation_results": navigation_results,
}


def _sql_device(k: int) -> str:
    return f"""(select user_id, max(epoch_us(ts)) as at, max_by(event_id, ts) as last, count(*) as n, count(*) filter (where event_type = 'error') as errors, round(max(value), 6) as best
        from events where event_id % 2 = {k} group by user_id)"""


_SQL_BAD = "(user_id % 11 = 0 or user_id % 7 = 0 or user_id % 13 = 0 or user_id % 17 = 0 or user_id % 19 = 0 or user_id % 23 = 0)"

ORACLE_SQL = {
    "payload_merge": f"""
        with b as (select coalesce(l.user_id, r.user_id) as u, l.user_id is not null as hl, r.user_id is not null as hr, case when r.user_id is null or l.at >= r.at then 0 else 1 end as k,
            l.at as la, r.at as ra, l.last as ll, r.last as rl, l.n as ln, r.n as rn, l.errors as le, r.errors as re, l.best as lb, r.best as rb
            from {_sql_device(0)} l full join {_sql_device(1)} r on l.user_id = r.user_id),
        c as (select *, case when k = 0 then ll else rl end as last, case when k = 0 then ln else rn end as n from b)
        select cast(u as varchar) as book_id, last % 5 as section, last % 11 as block, last % 90 as char, n as completed, n * 2 as total, case when k = 0 then la else ra end as updated_at,
            greatest(ln, rn) as chars, greatest(le, re) as errors, greatest(ln, rn) * 1000 as time_ms, u % 7 as sessions, greatest(lb, rb) as best_wpm,
            array_to_string(list_filter([case when hl then concat('s0=', cast(u % 2 = 0 as varchar)) end, concat('s1=', cast(u % 2 = 1 as varchar)), case when hr then concat('s2=', cast(u % 2 = 0 as varchar)) end], lambda x: x is not null), ',') as overrides
        from c
    """,
    "valid_progress": f"select cast(user_id as varchar) as book_id, user_id % 5 as section, n as completed, n + 5 as total, n as chars, 61.5::double as best_wpm, 's1=true' as overrides from (select user_id, count(*) as n from events group by user_id) where not {_SQL_BAD}",
    "rejected_progress": f"select case when user_id % 23 = 0 then 'other' else cast(user_id as varchar) end as key, cast(length({_RAW}) as int) as size from (select user_id, count(*) as n from events group by user_id) where {_SQL_BAD}",
    "payload_check": """
        select distinct user_id, user_id % 3 <> 0 and user_id % 5 <> 0 and user_id % 7 <> 0 as valid, case when user_id % 8 = 0 then 1.5 else 2.0 end::double as font_size,
            case when user_id % 4 = 0 then 'block' else 'line' end as caret_style, true as sound_on_click, cast(125 as int) as lesson_length, cast(3 as int) as context_lines, 'serika_dark' as theme from events
    """,
    "known_books": """
        select coalesce(r.doc_id, l.doc_id) as book_id, case when r.doc_id is null then l.lang else upper(r.lang) end as title, case when r.doc_id is null then l.source else r.source end as author
        from (select * from documents where doc_id % 3 <> 0) l full join (select * from documents where doc_id % 2 = 0) r on l.doc_id = r.doc_id
    """,
    "settings_merge": "select user_id, case when max(event_id) > count(*) * 7 then 'remote' else 'local' end as merged, 'remote' as imported, greatest(count(*) * 7, max(event_id)) as updated_at from events group by user_id",
    "reimported": f"""
        with b as (select user_id, count(*) * 3 as total from events group by user_id)
        select cast(b.user_id as varchar) as book_id, coalesce(n, 0) as completed, b.total, cast(77 as bigint) as updated_at, coalesce(n, 0) as chars, coalesce(best, 0.0) as best_wpm, '' as overrides
        from b left join (select * from {_sql_device(0)} where user_id % 2 = 0) d on b.user_id = d.user_id
    """,
    "lifetime_totals": f"""
        with r as (select user_id, cast(ts as date) as day, count(*) as chars, count(*) filter (where event_type = 'error') as errors, max(value) as wpm from events where event_id % 2 = 1 group by all),
        s as (select user_id, sum(chars) as c, sum(errors) as e, count(*) as s, round(max(wpm), 6) as w from r group by user_id)
        select cast(d.user_id as varchar) as book_id, cast(n + coalesce(c, 0) as bigint) as chars, cast(d.errors + coalesce(e, 0) as bigint) as errors, cast(n * 1000 + coalesce(c, 0) * 500 as bigint) as time_ms,
            cast(d.user_id % 7 + coalesce(s, 0) as bigint) as sessions, greatest(best, w) as best_wpm from {_sql_device(0)} d left join s on d.user_id = s.user_id
    """,
    "upserted": """
        with m as (select case when doc_id % 8 = 0 then doc_id else -doc_id end as id, upper(lang) as title, 2 as "at" from documents where doc_id % 4 = 0)
        select * from (select id, title, "at" from m union all select doc_id, lang, 1 from documents where doc_id not in (select id from m)) where id not in (select doc_id from documents where doc_id % 10 = 0)
    """,
    "history_validity": """
        with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as k, max(event_id) over (partition by user_id) as last from events)
        select user_id, bool_and(event_id % 97 <> 0 and (user_id % 5 <> 0 or event_id < last - 1)) as valid from r where k <= 64 group by user_id
    """,
    "navigation_results": """
        select event_id, event_id % 5 = 0 or (event_id % 7 <> 0 and value >= 0 and event_id % 11 <> 0 and event_id % 105 <= 100 and event_id % 103 <= 100 and event_id % 17 <> 0 and event_id % 13 <= event_id % 20) as valid from events
    """,
    "active_anchors": """
        with l as (select doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as b from documents where text is not null),
        p as (select doc_id, b, (b * 5 + doc_id) % 40 as c from l),
        a as (select doc_id, b as anchor, b as sb, doc_id % 7 as sc, b + b % 6 as eb, (doc_id + b) % 30 as ec from l union all select distinct doc_id, -1, 0, 0, 1000, 0 from l)
        select p.doc_id, b as block, c as "char", anchor from p join a on a.doc_id = p.doc_id and (b > sb or (b = sb and c >= sc)) and (b < eb or (b = eb and c < ec))
    """,
    "active_lesson": "select conv_id, turn, (turn > 1 or (turn = 1 and conv_id % 7 >= 3)) and (turn < 3 or (turn = 3 and conv_id % 7 < 3)) as active from conversations",
    "library_list": f"""
        with b as (select conv_id, cast(sum(coalesce(length(text), 0)) as bigint) as chars from conversations group by conv_id)
        select conv_id, chars, cast(case when n > 0 then least(100, floor(100.0 * n / (n * 2) + 0.5)) else 0 end as int) as percent, case when best > 0 then cast(floor(best + 0.5) as bigint) end as best
        from b left join {_sql_device(0)} d on b.conv_id = d.user_id
    """,
}
