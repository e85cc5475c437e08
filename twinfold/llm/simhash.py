"""SimHash near-dedup: 64-bit fingerprints, then tiled exact comparison of all distinct ones.

Distinct fingerprints are dealt into groups by population count; each pair of groups whose counts come within the radius
is one task that receives both, sorts them by population count and compares tile against tile with exclusive-or and bit
counts.  Group and tile pairs whose population counts differ by more than the radius hold no link and are skipped.  A task returns a spanning forest of the links it
finds - fewer edges than it has fingerprints - so a group of thousands of near copies never becomes all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm._words import bounded_batches, one_of_each, row_keys, text_slices
from twinfold.operators.components import connected_components
from twinfold.session import materialize

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE = 1024
#: Fingerprints of one group: a task holds two groups (8 bytes each) and one tile pair of working space.
GROUP_ROWS = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer; zero for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = len(found)
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n > words:
        a, b = starts[: n - words + 1].tolist(), ends[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64)
    else:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the fingerprint of every row's whole text, as BIGINT with the unsigned value's bits."""

    return _fingerprinted(docs, F.col(text_col), F.col(id_col).cast("long").alias("id"))


def _fingerprinted(docs: DataFrame, text: Column, *more: Column) -> DataFrame:
    """``(*more, fp)``; the BIGINT columns ``more`` pass through, long texts are read a few at a time."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, batch.num_columns - 1):
                fp = np.array([fingerprint(x) for x in texts], np.uint64)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(fp.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    narrow = docs.select(*more, text.alias("text"))
    return narrow.mapInArrow(run, ", ".join([*(f"{c} long" for c in narrow.columns[:-1]), "fp long"]))


def _links(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between x and y, both sorted by population count (as positions in x ++ y)."""
    px, py = np.bitwise_count(x), np.bitwise_count(y)
    n = len(x)
    root = np.arange(n if same else n + len(y))
    off = 0 if same else n

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    src, dst = [], []
    for i in range(0, n, TILE):
        a, lo, hi = x[i : i + TILE], int(px[i]) - radius, int(px[min(i + TILE, n) - 1]) + radius
        first, last = np.searchsorted(py, lo, "left"), np.searchsorted(py, hi, "right")
        first = max(i, first // TILE * TILE) if same else first // TILE * TILE
        for j in range(first, last, TILE):
            near = np.bitwise_count(a[:, None] ^ y[None, j : j + TILE]) <= radius
            if not near.any():
                continue
            r, c = np.nonzero(near)
            r, c = r + i, c + j + off
            while len(r):  # links inside a component found so far are dropped together
                ra, rc = root[r], root[c]
                while not np.array_equal(ra, up := root[ra]):
                    ra = up
                while not np.array_equal(rc, up := root[rc]):
                    rc = up
                open_ = ra != rc
                r, c, ra, rc = r[open_], c[open_], ra[open_], rc[open_]
                if not len(r):
                    break
                _, one = np.unique(np.maximum(ra, rc), return_index=True)
                for k in one.tolist():
                    u, v = find(int(r[k])), find(int(c[k]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        src.append(int(r[k]))
                        dst.append(int(c[k]))
    return np.array(src, np.int64), np.array(dst, np.int64)


class Bands:
    """Groups of fingerprints by population count: neighbouring counts share a group up to ``most`` rows, a count with
    more rows is split by hash.  Everything follows from the at most 65 numbers of rows by population count."""

    def __init__(self, rows_by_count: dict[int, int], most: int, radius: int):
        self.first, self.parts = [0] * 65, [1] * 65
        edges: list[tuple[int, int]] = []  # of each group the smallest and the largest count
        held = 0
        for p in range(65):
            n = rows_by_count.get(p, 0)
            if n > most:
                self.first[p], self.parts[p] = len(edges), -(-n // most)
                edges += [(p, p)] * self.parts[p]
                held = most
            else:
                if not edges or held + n > most:
                    edges.append((p, p))
                    held = 0
                held += n
                edges[-1] = (edges[-1][0], p)
                self.first[p] = len(edges) - 1
        #: Groups that a fingerprint's own group is compared with, from the first to the last.
        near = [[g for g, (lo, hi) in enumerate(edges) if lo - edges[self.first[p]][1] <= radius and edges[self.first[p]][0] - hi <= radius] for p in range(65)]
        self.low, self.high = [x[0] for x in near], [x[-1] for x in near]

    def dealt(self, fps: DataFrame) -> DataFrame:
        """``(fp, own, lo, hi)``: every fingerprint once for each pair of groups that it is needed in."""
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.bit_count("fp").cast("int") + 1)
        own = of(self.first) + F.pmod(F.xxhash64("fp", F.lit(7)), of(self.parts)).cast("int")
        out = fps.withColumn("own", own).withColumn("other", F.explode(F.sequence(of(self.low), of(self.high))))
        return out.select("fp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(src, dst)`` edges that connect all distinct fingerprints of ``fps(fp)`` within ``radius`` bits of each other."""
    fps = materialize(fps.select("fp").distinct(), "fingerprints")
    counts = {r["p"]: r["count"] for r in fps.groupBy(F.bit_count("fp").alias("p")).count().collect()}
    # groups of a tile at least, and about a dozen however few the rows; no more rows than a task can hold
    most = min(group_rows, max(min(TILE, group_rows), -(-sum(counts.values()) // 12)))
    dealt = Bands(counts, most, radius).dealt(fps)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in key)
        fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy()
        order = np.lexsort((fp, np.bitwise_count(fp)))
        fp, side = fp[order], side[order]
        x = fp[side == lo]
        y = x if lo == hi else fp[side == hi]
        s, d = _links(x, y, radius, lo == hi) if len(x) and len(y) else (np.zeros(0, np.int64),) * 2
        both = (x if lo == hi else np.concatenate([x, y])).view(np.int64)
        return pa.table({"src": both[s], "dst": both[d]})

    return dealt.groupBy("lo", "hi").applyInArrow(compare, "src long, dst long")


def _component_ids(classes: DataFrame, radius: int, group_rows: int) -> DataFrame:
    """``(fp, first)`` of ``classes(fp, least)``: the smallest ``least`` of all classes that a fingerprint reaches."""
    comp = connected_components(fingerprint_links(classes, radius, group_rows), thin=False).withColumnRenamed("node", "fp")
    named = classes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    best = named.groupBy("component").agg(F.min("least").alias("first"))
    return named.join(best, "component").select("fp", "first")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null and word-less texts have fingerprint zero and link like any other; texts of any length are read whole, shingles
    65,536 at a time.  Repeated rows give repeated results; rows with a null id carry a null component if they are
    linked with nothing, else the smallest id linked.  Other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    rows = materialize(with_fingerprints(docs, id_col, text_col), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    of = _component_ids(classes, radius, group_rows)
    # each class is one row here, but a class may hold a third of the documents: that join is left to skew handling
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` of each component: the smallest id, nulls last, then the smallest hash of the row.

    Rows with null or repeated ids, null and empty texts are judged like any other; of equal rows one stays.  All columns
    stay, whatever their names.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # no name of docs can clash with the new columns
    own, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    k1, k2 = row_keys(plain.columns)
    rows = materialize(_fingerprinted(plain, text, own.cast("long").alias("id"), k1.alias("k1"), k2.alias("k2")), "simhash")
    order = F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2")
    classes = materialize(rows.groupBy("fp").agg(F.min(order).alias("least")), "classes")
    keep = _component_ids(classes, radius, GROUP_ROWS).select("first.k1", "first.k2").distinct()
    keyed = one_of_each(plain.withColumn("k1", k1).withColumn("k2", k2), ("k1", "k2"))
    return keyed.join(keep, ["k1", "k2"], "left_semi").select(*plain.columns).toDF(*docs.columns)
