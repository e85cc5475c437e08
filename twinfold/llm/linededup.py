"""Line dedup with levelled sorted runs of line hashes; DataFrame functions only.

``LineRuns`` keeps, per distinct line key (two 64-bit hashes), in how many documents it was met and its keeper, as runs in
a shared folder: tables bucketed and sorted by hash, so that a new batch, dealt by hash once, is merge-joined with them
without another exchange.  Keys that no run holds yet (the anti-join) are added with their keeper, known keys with
their count only.  Two runs of a level are merged into one of the next, as binary digits are carried.  A manifest lists
the runs, so another session can open the index.  Batches come in descending id order, so the first document that brings
a key is the largest that holds it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.scalar import let
from twinfold.session import discard, file_system, fits_broadcast, materialize, shared_path

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches that documents are added in: with four, every level is filled and merged.
BATCHES = 4
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a drop list that every task gets (about 60 bytes each); a longer list is joined by a shuffle.
BROADCAST_ROWS = 20_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _first_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _second_hash(key: Column) -> Column:
    return F.xxhash64(F.lit("line"), key)


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Scans of runs count as sorted: a bucket of a run is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """An index of line keys that grows batch by batch, in ``folder``."""

    COLUMNS = "h1 BIGINT, h2 BIGINT, docs BIGINT, keeper BIGINT"

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark, self.folder = spark, folder or shared_path(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Name of the run of each level, the newest first; None where there is none.
        self.levels: list[str | None] = []
        self.tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The index that ``folder`` holds."""
        fs, path = file_system(spark, f"{folder}/manifest.json")
        stream = fs.open(path)
        held = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        out = cls(spark, folder, held["buckets"])
        out.levels = held["levels"]
        for run in filter(None, out.levels):
            table = f"line_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {table} ({cls.COLUMNS}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {out.buckets} BUCKETS LOCATION '{folder}/{run}'")
            out.tables[run] = table
        return out

    def _save(self) -> None:
        fs, path = file_system(self.spark, f"{self.folder}/manifest.json")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "levels": self.levels}).encode()))
        stream.close()

    def close(self) -> None:
        """Forget the tables; the folder stays and can be opened again."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}

    def run(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        self.tables[name] = table = f"line_{name.replace('-', '_')}"
        rows.write.option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(table)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        discard(self.spark, f"{self.folder}/{name}")

    def marked(self, batch: DataFrame) -> DataFrame:
        """``(h1, h2, docs, keeper)`` of ``batch(h1, h2, doc)``, with a keeper for keys that no run holds alone."""
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
        known = F.lit(False)
        for k, name in enumerate(self.runs()):
            there = self.run(name).select("h1", "h2", F.lit(True).alias(f"in{k}")).hint("merge")
            own = own.join(there, ["h1", "h2"], "left")
            known = known | F.coalesce(f"in{k}", F.lit(False))
        return own.select("h1", "h2", "docs", F.when(~known, F.col("keeper")).alias("keeper"))

    def merged(self, newer: str, older: str) -> DataFrame:
        a, b = (self.run(n).select("h1", "h2", F.col("docs").alias(f"docs{k}"), F.col("keeper").alias(f"keeper{k}")) for k, n in enumerate((newer, older)))
        both = a.hint("merge").join(b, ["h1", "h2"], "full")
        docs = F.coalesce("docs0", F.lit(0)) + F.coalesce("docs1", F.lit(0))
        return both.select("h1", "h2", docs.alias("docs"), F.coalesce("keeper1", "keeper0").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Add ``batch(h1, h2, doc)``, one row for each key and document, and merge runs of the same level."""
        with _sorted_scans(self.spark):
            name, level = self._write(self.marked(batch)), 0
            while level < len(self.levels) and self.levels[level]:
                older = self.levels[level]
                merged = self._write(self.merged(name, older))
                self.levels[level] = None
                self._drop(name)
                self._drop(older)
                name, level = merged, level + 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = name
        self._save()

    def totals(self) -> DataFrame:
        """One row a key over all runs; the oldest run that holds a key has its keeper."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long, keeper long")
        if len(names) == 1:
            return self.run(names[0])
        # read as plain files: a union of bucketed scans passes for dealt by key, which gave a key twice
        every = reduce(DataFrame.unionByName, [self.spark.read.schema(self.COLUMNS).parquet(f"{self.folder}/{n}") for n in names])
        return every.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h1, h2, doc)``: the distinct keys of at least ``min_chars`` code points of each row."""
    some = F.filter(lines_of(F.col("text")), lambda line: F.char_length(line) >= min_chars)
    keys = F.filter(F.transform(some, line_key), lambda k: F.char_length(k) >= min_chars)
    found = F.array_distinct(F.transform(keys, lambda k: F.struct(_first_hash(k).alias("h1"), _second_hash(k).alias("h2"))))
    return docs.select(F.col("id").alias("doc"), F.explode(found).alias("h")).select("h.h1", "h.h2", "doc")


def long_line_table(docs: DataFrame, path: str, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> tuple[DataFrame, int]:
    """``(h1, h2, doc, part)`` of ``docs(id, text)``, written to ``path``, and the number of parts; ids fall from part to part."""
    spark = docs.sparkSession
    cuts = [c for c in docs.select(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []]
    part = sum((F.when(F.col("doc") > c, 0).otherwise(1) for c in cuts), F.lit(0)).cast("int")
    # a document's keys are distinct row by row; rows that repeat an id are made one here
    rows = _long_lines(docs, min_chars).groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).drop("one")
    rows.withColumn("part", part).write.partitionBy("part").parquet(path)
    return spark.read.schema("h1 long, h2 long, doc long, part int").parquet(path), len(cuts) + 1


def index_lines(lines: DataFrame, parts: int, folder: str | None = None) -> LineRuns:
    """The runs of all ``lines(h1, h2, doc, part)``, added part by part."""
    runs = LineRuns(lines.sparkSession, folder)
    for k in range(parts):
        runs.add(lines.where(F.col("part") == k).select("h1", "h2", "doc"))
    return runs


def _table_of(drop: DataFrame, slots: int) -> Column:
    """The drop list (of checked size) as one constant: in slot ``h1 mod slots`` the ``[h1, h2, keeper]`` with that remainder."""
    table: list[list] = [[] for _ in range(slots)]
    for r in drop.collect():
        table[r["h1"] % slots].append([r["h1"], r["h2"], r["keeper"]])
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<array<bigint>>>")


def _kept_lines(lines: Column, min_chars: int, goes: Column) -> Column:
    """Lines without those whose key ``goes(key)`` says to drop; only long lines are asked."""
    drop = lambda line: (F.char_length(line) >= min_chars) & let(line_key(line), lambda k: (F.char_length(k) >= min_chars) & goes(k))
    return F.filter(lines, lambda line: ~drop(line))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``_kept`` (the text without dropped lines), ``_n_lines`` and ``_n_dropped``.

    A line goes if its key (blanks stripped, A-Z lower-cased) has ``min_chars`` code points, stands in ``min_docs``
    documents and this document is not the largest id that holds it.  Null and empty texts are one empty line.  Null
    ids count as one document, smaller than any other.  Rows that repeat an id are the same document, each keeps its
    own result.  Columns of ``docs`` may have any name and stay, but for the three new ones; a text of any length is
    one value; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("_kept", "_n_lines", "_n_dropped")]
    plain = docs.select(names).toDF(*[f"c{k}" for k in range(len(names))])  # no name of docs can clash with the new columns
    id_, text = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}")
    path = shared_path(spark, "lines")
    lines, parts = long_line_table(plain.select(id_.alias("id"), text.alias("text")), path, min_chars)
    runs = index_lines(lines, parts)
    drop = materialize(runs.totals().where(F.col("docs") >= min_docs).select("h1", "h2", "keeper"), "drop")
    runs.close()
    discard(spark, runs.folder)
    if fits_broadcast(drop, BROADCAST_ROWS):
        # no text is shuffled: every task looks its lines up in the drop list
        discard(spark, path)
        slots = 1 << (2 * drop.count()).bit_length()

        table = _table_of(drop, slots)
        entries = lambda h: F.element_at(table, (F.pmod(h, F.lit(slots)) + 1).cast("int"))
        match = lambda k, h: F.exists(entries(h), lambda e: (e[0] == h) & ~e[2].eqNullSafe(id_) & (e[1] == _second_hash(k)))
        out = plain.withColumn("_k", _kept_lines(lines_of(text), min_chars, lambda k: let(_first_hash(k), lambda h: match(k, h))))
    else:
        gone = lines.join(drop, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
        gone = gone.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("_gone"))
        joined = plain.join(gone, id_.eqNullSafe(F.col("doc")), "left")
        pair = lambda k: F.struct(_first_hash(k).alias("h1"), _second_hash(k).alias("h2"))
        kept_ = F.when(F.col("_gone").isNull(), lines_of(text)).otherwise(_kept_lines(lines_of(text), min_chars, lambda k: F.array_contains(F.col("_gone"), pair(k))))
        out = joined.withColumn("_k", kept_)
    n = F.size(lines_of(text)).cast("long")
    out = out.select(*plain.columns, F.array_join("_k", "\n").alias("_kept"), n.alias("_n_lines"), (n - F.size("_k")).alias("_n_dropped"))
    return out.toDF(*names, "_kept", "_n_lines", "_n_dropped")


def line_digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` for every row of ``docs(doc_id, text)``."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, i, ls[i] AS line FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5),
marked AS (SELECT l.r, l.doc_id, l.i, l.line, h.k IS NOT NULL AND l.doc_id IS DISTINCT FROM h.keeper AS gone FROM keyed l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
