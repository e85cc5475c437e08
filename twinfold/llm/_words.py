"""A bounded memo of word -> result, filled for many missing words at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: what a Python worker holds at once, long texts included.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(name)).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
    return spark


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a model file of the driver, for every executor (a public vocabulary of a few MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def row_keys(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes of a row's values and of which of them are null: rows with the same keys are taken as equal."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return F.xxhash64(nulls, *columns), F.xxhash64(F.lit("row"), nulls, *columns)


def one_of_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key; copies go before the shuffle, so a row that is repeated without end moves once a partition."""
    return rows.dropDuplicates(list(keys))


class WordMemo:
    """Maps words to what ``fill`` makes of them.

    It holds a young and an old generation of at most ``limit // 2`` words and one batch each; a word of the old one
    that is met again moves to the young one, so frequent words stay.  What is held changes no result.
    """

    def __init__(self, fill: Callable[[list], Sequence[Any]], limit: int = 200_000):
        self.fill, self.limit, self.young, self.old = fill, limit, {}, {}

    def clear(self) -> None:
        """Forget everything: Python workers outlive a task."""
        self.young, self.old = {}, {}

    def look_up(self, texts: Sequence[Sequence]) -> dict:
        """The memo, holding all words of ``texts`` until the next call."""
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = {w for words in texts for w in words if w not in young}
        if missing:
            new = []
            for w in missing:
                if (found := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = found
            if new:
                young.update(zip(new, self.fill(new), strict=True))
        return young


def chunks(sizes: Sequence[int], budget: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring rows of about ``budget`` in total; a row beyond it stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > budget:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


class IntTable:
    """An open-addressing table from distinct non-negative 64-bit keys to integers, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.key, self.value, self.probes = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64), 0
        keys, values = keys.astype(np.uint64), values.astype(np.int64)
        at = self._slot(keys)
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.value[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.value[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._slot(keys)
        out = np.where(self.key[at] == keys, self.value[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.value[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = (self._slot(keys[open_]) + 1) & ((1 << self.bits) - 1) if _ == 0 else (at + 1) & ((1 << self.bits) - 1)
            hit = self.key[at] == keys[open_]
            out[open_[hit]] = self.value[at[hit]]
            go = ~hit & (self.value[at] >= 0)
            open_, at = open_[go], at[go]
        return out


def joined_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, up to about ``budget`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > budget:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def text_slices(batch: pa.RecordBatch, column: int, budget: int = 1_000_000) -> Iterator[tuple[int, int, list]]:
    """``(start, end, texts)`` of neighbouring rows of about ``budget`` bytes, turned into Python strings piece by piece."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in chunks(sizes, budget):
        yield a, b, texts.slice(a, b - a).to_pylist()
