"""A keyed store of tables on any file system Spark writes to: puts, deletes, and commits of several tables at once.

Merge on read: a commit writes only the rows it puts (and a mark for each key it deletes) as a delta, dealt into buckets by
the key's hash; a read takes the newest row of each key over the base and the deltas, and a get reads one bucket of each.
compact() merges the deltas into a new base, vacuum() removes folders that no kept version names.

A version is a pointer file that lists each table's commits. A commit writes its delta and then replaces the pointer in one
rename: readers see all of a commit or nothing of it, and a lost executor or driver leaves the old version standing. The
pointer also holds the last batch of each stream, so a batch that comes again after a restart changes nothing. One writer at a time.

Rows have a column `at`; of rows of one key in one put the last by `at` stays, the greater row of ties; of two puts the later one wins,
unless the table is put `by` a column, whose largest value then wins. A null key is a key like others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from lectern.plans.stages import shared

# Tables and their keys.
TABLES = {"book_meta": "book_id", "books": "book_id", "progress": "book_id", "navigation": "book_id", "settings": "key", "sync_config": "key"}
POINTER, BUCKETS, VERSIONS = "_current", 16, 2


def _ordered(rows: DataFrame, column: str) -> bool:
    """Can rows be ordered by the column? Maps and variants have no order."""
    kind = rows.schema[column].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind


class Store:
    """`keys` names the tables and their keys; a table's number of buckets is fixed by its first commit."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys or TABLES, buckets
        hadoop = spark._jvm.org.apache.hadoop
        self.path = hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        """last commit, tables (schema, buckets, by, commits), streams (last batch), kept (commits of earlier versions)."""
        at = self.path(f"{self.root}/{POINTER}")
        if not self.fs.exists(at):
            return {"last": 0, "tables": {}, "streams": {}, "kept": []}
        stream = self.fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, pointer: dict) -> None:
        fresh = self.path(f"{self.root}/_next-{uuid.uuid4().hex}")
        stream = self.fs.create(fresh, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        rename[0] = options.Rename.OVERWRITE
        context.rename(fresh, self.path(f"{self.root}/{POINTER}"), rename)

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _scan(self, table: str, own: dict) -> DataFrame:
        """Every row of the table's commits, with _gone, commit and bucket; the last two are folders, so filters on them prune."""
        schema = StructType.fromJson(own["schema"]).add("_gone", BooleanType()).add("commit", IntegerType()).add("bucket", IntegerType())
        if not own["commits"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/commit={c}" for c in own["commits"]])

    def _merged(self, table: str, own: dict, rows: DataFrame) -> DataFrame:
        """The newest row of each key; a single commit has each key once, and is only scanned."""
        names = StructType.fromJson(own["schema"]).names
        if len(own["commits"]) > 1:
            # A put `by` a column never hides a row of a larger value; a deletion hides all that was put before it.
            newest = F.struct(F.col(own["by"]), "commit") if own["by"] else F.struct("commit", ~F.col("_gone"))
            rows = rows.withColumn("_key", F.col(self.keys[table]))
            if own["by"]:
                gone = rows.filter("_gone").groupBy("_key").agg(F.max("commit").alias("_until"))
                live = rows.filter("not _gone").join(gone.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left").filter("_until is null or commit >= _until")
                rows = live.select(*names, "_gone", "commit", "_key")
            rows = rows.groupBy("_key").agg(F.max_by(F.struct(*names, "_gone"), newest).alias("_r")).select("_r.*")
        return rows.filter("not _gone").select(*names)

    def read(self, table: str) -> DataFrame | None:
        """The table, or none before its first commit."""
        own = self.pointer()["tables"].get(table)
        return self._merged(table, own, self._scan(table, own)) if own else None

    def get(self, table: str, key) -> DataFrame | None:
        """The row of a key: one bucket of each commit is read."""
        own = self.pointer()["tables"].get(table)
        if own is None:
            return None
        name = self.keys[table]
        value = F.lit(key).cast(StructType.fromJson(own["schema"])[name].dataType)
        rows = self._scan(table, own).filter(F.col("bucket") == self._bucket(value, own["buckets"])).filter(F.col(name).eqNullSafe(value))
        return self._merged(table, own, rows)

    def commit(self, puts: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, by: dict[str, str] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Put rows into and delete keys (of frames with the key's column) from tables, all at once; deletions come before puts.

        A batch (stream, number) that was committed before is left out: false.
        """
        pointer, by, gone = self.pointer(), by or {}, gone or {}
        if batch and pointer["streams"].get(batch[0], -1) >= batch[1]:
            return False
        number, tables = pointer["last"] + 1, pointer["tables"]
        for table in {**puts, **gone}:
            key, rows, own = self.keys[table], puts.get(table), tables.get(table)
            if own is None:
                if rows is None:
                    continue
                own = {"schema": rows.schema.jsonValue(), "buckets": self.buckets, "by": by.get(table), "commits": []}
            names = StructType.fromJson(own["schema"]).names
            parts = []
            if rows is not None:
                first = own["by"] or "at"
                order = F.struct(*sorted((c for c in names if _ordered(rows, c)), key=lambda c: c != first))
                last = rows.withColumn("_key", F.col(key)).groupBy("_key").agg(F.max_by(F.struct(*names), order).alias("_r")).select("_r.*")
                parts.append(last.withColumn("_gone", F.lit(False)))
            if table in gone:
                marks = gone[table].select(key).distinct()
                kinds = StructType.fromJson(own["schema"])
                parts.append(marks.select(*[(F.col(c) if c == key else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in names], F.lit(True).alias("_gone")))
            whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            self._write(whole, table, number, own)
            tables[table] = {**own, "commits": [*own["commits"], number]}
        self._publish({**pointer, "last": number, "streams": {**pointer["streams"], **({batch[0]: batch[1]} if batch else {})}})
        return True

    def _write(self, rows: DataFrame, table: str, number: int, own: dict) -> None:
        """By bucket; AQE sizes the files, so neither a small put nor a large one makes many or huge ones."""
        dealt = rows.withColumn("bucket", self._bucket(F.col(self.keys[table]), own["buckets"])).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/commit={number}")

    def put(self, **tables: DataFrame) -> None:
        """Put rows by key into one or more tables, together."""
        self.commit(tables)

    def delete_books(self, gone: DataFrame) -> None:
        """Books with their content, progress and navigation."""
        self.commit({}, {name: gone.select("book_id") for name in ("book_meta", "books", "progress", "navigation")})

    def checkpoint(self, progress: DataFrame, navigation: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Progress and navigation together; a book without navigation loses what it had. Navigation of other books is an error."""
        if not navigation.join(progress, "book_id", "left_anti").isEmpty():
            raise ValueError("navigation of a book without progress")
        return self.commit({"progress": progress, "navigation": navigation}, {"navigation": progress.select("book_id")}, batch=batch)

    def compact(self, *tables: str, least: int = 2) -> None:
        """Tables of `least` commits or more become one; readers of earlier versions go on until vacuum()."""
        pointer = self.pointer()
        number, old = pointer["last"] + 1, {}
        for table in tables or tuple(pointer["tables"]):
            own = pointer["tables"][table]
            if len(own["commits"]) >= least:
                self._write(self._merged(table, own, self._scan(table, own)).withColumn("_gone", F.lit(False)), table, number, own)
                old[table] = own["commits"]
                pointer["tables"][table] = {**own, "commits": [number]}
        if old:
            self._publish({**pointer, "last": number, "kept": [*pointer["kept"], old][-VERSIONS:]})

    def vacuum(self, versions: int = 0) -> int:
        """Removes commits that neither the current version nor the last `versions` compacted ones name; how many."""
        pointer, removed = self.pointer(), 0
        for table, own in pointer["tables"].items():
            named = {*own["commits"], *(c for kept in pointer["kept"][len(pointer["kept"]) - versions :] for c in kept.get(table, []))}
            at = self.path(f"{self.root}/{table}")
            for status in self.fs.listStatus(at) if self.fs.exists(at) else []:
                number = int(status.getPath().getName().split("=")[1])
                if number not in named and number <= pointer["last"]:
                    self.fs.delete(status.getPath(), True)
                    removed += 1
        return removed

    def migrate(self, schemas: dict[str, str | StructType], by: dict[str, str] | None = None) -> None:
        """Tables that aren't there yet, empty; those that are stay as they are."""
        known = self.pointer()["tables"]
        missing = {name: self.spark.createDataFrame([], schema) for name, schema in schemas.items() if name not in known}
        if missing:
            self.commit(missing, by=by)


def books_with_content(meta: DataFrame, content: DataFrame) -> DataFrame:
    """Only books that have both."""
    return meta.join(content, "book_id")


def payload_json(progress: DataFrame, known: DataFrame, settings: DataFrame, updated_at: int) -> DataFrame:
    """One row `payload`: the sync file of a few readers' books, pretty JSON. A payload is a reader's, so it is small by nature."""
    by_book = lambda a, b: F.when(a["book_id"] < b["book_id"], -1).when(a["book_id"] > b["book_id"], 1).otherwise(0)
    books = progress.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("book_id", F.struct(*progress.columns).alias("r"))), by_book)).alias("progress"))
    names = known.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("book_id", F.struct("title", "author").alias("r"))), by_book)).alias("known_books"))
    one = settings.limit(1).select(F.struct(*settings.columns).alias("settings"))
    row = F.struct(F.lit(1).alias("version"), F.lit(updated_at).cast("long").alias("updated_at"), "progress", "known_books", "settings")
    return books.join(names).join(one).select(F.to_json(row, {"pretty": "true"}).alias("payload"))


def read_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A payload file by its schema; null fields where it is no valid JSON."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("p")).select("p.*")


PIECES = 8  # pieces of a payload written side by side, unless it is asked for more


def write_payload(progress: DataFrame, known: DataFrame, settings: DataFrame, updated_at: int, folder: str, pieces: int = PIECES) -> None:
    """A payload of any size as sorted files of JSON lines: its head, then entries by book id, dealt by ranges.

    A line is one entry ("head", "progress" or "known", its book id, its record), so no row or task holds more than its own
    part; a file that was lost half-way is a missing file, and the head, which names the counts, is written last.
    """
    entry = lambda rows, part: rows.select(F.lit(part).alias("part"), F.col("book_id").cast("string").alias("book_id"), F.to_json(F.struct(*[c for c in rows.columns])).alias("record"))
    entries = entry(progress, "progress").unionByName(entry(known, "known"))
    entries.repartitionByRange(pieces, "part", "book_id").sortWithinPartitions("part", "book_id").write.mode("overwrite").json(f"{folder}/entries")
    counts = {r.part: r["count"] for r in progress.sparkSession.read.schema("part string, book_id string, record string").json(f"{folder}/entries").groupBy("part").count().collect()}
    head = F.struct(F.lit(1).alias("version"), F.lit(updated_at).cast("long").alias("updated_at"), *[F.lit(counts.get(k, 0)).cast("long").alias(f"n_{k}") for k in ("progress", "known")], F.struct(*settings.columns).alias("settings"))
    settings.limit(1).select(F.to_json(head).alias("value")).write.mode("overwrite").text(f"{folder}/head")


def read_payload_pieces(spark: SparkSession, folder: str, record: str, settings: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(head, progress by the schema `record`, known books) of write_payload(); an error where entries are missing."""
    head = spark.read.text(f"{folder}/head").select(F.from_json("value", f"version int, updated_at long, n_progress long, n_known long, settings struct<{settings}>").alias("h")).select("h.*")
    entries = spark.read.schema("part string, book_id string, record string").json(f"{folder}/entries")
    said, found = head.first(), {r.part: r["count"] for r in entries.groupBy("part").count().collect()}
    if said is None or (said.n_progress, said.n_known) != (found.get("progress", 0), found.get("known", 0)):
        raise ValueError("the payload is not whole")
    of = lambda part, schema: entries.filter(F.col("part") == part).select(F.from_json("record", schema).alias("r")).select("r.*")
    return head, of("progress", record), of("known", "book_id string, title string, author string")


# Queries: documents are books of a store of its own, made for the query in the shared folder.


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("book_id"), F.lit(1).alias("at"), F.col("lang").alias("title"), "text")


def store_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put, put again in part, deleted in part, compacted, put again in part, and read from the base and its delta."""
    store, docs = Store(spark, shared(spark, "store"), {"book_meta": "book_id"}), _docs(spark, sf_dir).drop("text")
    store.put(book_meta=docs)
    store.put(book_meta=docs.filter("book_id % 4 = 0").select("book_id", F.lit(2).alias("at"), F.upper("title").alias("title")))
    store.commit({}, {"book_meta": docs.filter("book_id % 10 = 0")})
    store.compact()
    store.vacuum()
    store.put(book_meta=docs.filter("book_id % 15 = 0").select("book_id", F.lit(3).alias("at"), F.lit("again").alias("title")))
    return store.read("book_meta")


def store_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with their content, and progress where there is some, after some were deleted with all they had."""
    store, docs = Store(spark, shared(spark, "store")), _docs(spark, sf_dir)
    store.put(book_meta=docs.drop("text"), books=docs.filter("book_id % 13 <> 0").select("book_id", "at", "text"))
    store.put(progress=docs.filter("book_id % 3 = 0").select("book_id", "at", (F.col("book_id") % 100).alias("completed")))
    store.delete_books(docs.filter("book_id % 9 = 0"))
    store.migrate({"settings": "key string, at int", "books": "other string"})  # adds the one, leaves the other
    whole = books_with_content(store.read("book_meta"), store.read("books").drop("at"))
    whole = whole.join(store.read("progress").select("book_id", "completed"), "book_id", "left").join(store.read("settings"), F.col("key") == F.col("title"), "left_anti")
    return whole.select("book_id", "title", F.length("text").alias("chars"), "completed")


def payload_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as progress and titles, written as a payload of ranges and read back."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared(spark, "payload")
    progress = docs.select(F.col("doc_id").cast("string").alias("book_id"), F.col("n_chars").cast("long").alias("total"), F.create_map(F.concat(F.lit("s"), F.col("doc_id") % 3), F.col("doc_id") % 2 == 0).alias("overrides"))
    known = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("book_id"), F.col("lang").alias("title"), F.col("source").alias("author"))
    write_payload(progress, known, spark.range(1).select(F.lit("dark").alias("theme")), 77, folder)
    head, back, names = read_payload_pieces(spark, folder, "book_id string, total long, overrides map<string, boolean>", "theme string")
    said = head.first()
    rows = back.join(names, "book_id", "left").withColumn("updated_at", F.lit(said.updated_at).cast("long")).withColumn("theme", F.lit(said.settings.theme))
    return rows.select("book_id", "total", F.array_join(F.transform(F.map_entries("overrides"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("overrides"), "title", "author", "updated_at", "theme")


QUERIES = {"store_merged": store_merged, "store_library": store_library, "payload_pieces": payload_pieces}

ORACLE_SQL = {
    "payload_pieces": """
        select cast(doc_id as varchar) as book_id, n_chars as total, concat('s', cast(doc_id % 3 as varchar), '=', cast(doc_id % 2 = 0 as varchar)) as overrides,
            case when doc_id % 2 = 0 then lang end as title, case when doc_id % 2 = 0 then source end as author, cast(77 as bigint) as updated_at, 'dark' as theme from documents
    """,
    "store_merged": """
        select doc_id as book_id, case when doc_id % 15 = 0 then 3 when doc_id % 4 = 0 then 2 else 1 end as at, case when doc_id % 15 = 0 then 'again' when doc_id % 4 = 0 then upper(lang) else lang end as title
        from documents where doc_id % 10 <> 0 or doc_id % 15 = 0
    """,
    "store_library": """
        select doc_id as book_id, lang as title, length(text) as chars, case when doc_id % 3 = 0 then doc_id % 100 end as completed from documents where doc_id % 13 <> 0 and doc_id % 9 <> 0
    """,
}
