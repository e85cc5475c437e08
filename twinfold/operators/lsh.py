"""Random-hyperplane LSH joins over vectors with one-bit probes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.session import materialize

# Fixed values of the generator of projection signs: its seed; only the lowest bit of each state is used.
SEED = 0xD1B54A32D192ED03
_MASK = (1 << 64) - 1


def signature_bits(items: int) -> int:
    """Bits of a signature for so many vectors: enough for one bucket each, from 8 to 16."""
    return min(16, max(8, (max(items, 1) - 1).bit_length()))


def signs(count: int) -> np.ndarray:
    """The first ``count`` projection signs, as int8 of -1 and 1."""
    out, s = np.empty(count, np.int8), SEED
    for i in range(count):
        s ^= s >> 12
        s = (s ^ (s << 25)) & _MASK
        s ^= s >> 27
        out[i] = 1 if s & 1 else -1
    return out


def signatures(rows: DataFrame, bits: int, dimension: int, tables: int = 12) -> DataFrame:
    """``(ord, sigs array<int>)`` of rows ``(ord, embedding)``: bit k of table t is set where the projection is not negative."""
    if dimension <= 0 or tables <= 0:
        raise ValueError("dimension and table count must be positive")
    planes = signs(tables * bits * dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = planes.reshape(tables * bits, dimension).astype(np.float64).T
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != len(batch) * dimension:
                raise ValueError("a vector has another dimension")
            sig = ((flat.reshape(-1, dimension) @ matrix >= 0).reshape(-1, tables, bits) @ weights).astype(np.int32)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(sig.ravel()))], ["ord", "sigs"])

    return rows.where("size(embedding) > 0").select("ord", "embedding").mapInArrow(run, "ord long, sigs array<int>")


def all_candidates(sigs: DataFrame, bits: int, columns: Sequence[str] = (), where: F.Column | None = None) -> DataFrame:
    """``(q, c)``: each row with every earlier row in its buckets or those one bit away, in any table.

    Of two rows one bit apart the one that has the bit looks for the other, so they meet once a table.  ``columns`` of ``sigs``
    go along as ``q_*`` and ``c_*``, and only pairs that meet ``where``, which must not tell the sides apart, leave the join.
    """
    masks = F.array(F.lit(0), *[F.lit(1 << k) for k in range(bits)])
    tables = sigs.select("ord", *columns, F.posexplode("sigs").alias("tbl", "sig"))
    side = lambda s: [F.col("ord").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns], "tbl"]
    held = lambda m: (m == 0) | (F.col("sig").bitwiseAND(m) != 0)
    q = tables.select(*side("q"), "sig", F.explode(F.filter(masks, held)).alias("mask"))
    q = q.withColumn("sig", F.col("sig").bitwiseXOR(F.col("mask")))
    met = q.join(tables.select(*side("c"), "sig").hint("merge"), ["tbl", "sig"]).where((F.col("mask") != 0) | (F.col("c") < F.col("q")))
    met = met if where is None else met.where(where)
    return met.select(F.greatest("q", "c").alias("q"), F.least("q", "c").alias("c")).distinct()


def lsh_candidates(sigs: DataFrame, bits: int, limit: int | None = 256) -> DataFrame:
    """``(q, c)``: each row with the earlier rows in its buckets or those one bit away, in any table.

    With ``limit`` a row keeps its first so many distinct candidates, in order of table, probe and position.  The
    candidates of one table are distinct, so a table adds no more than ``limit``, and none comes after a table that alone
    has so many: how many each probe meets is counted first, and the join makes only entries that can still count.

    Buckets meet by merge joins: their tables hold twelve rows a vector, but Spark goes by the size of the small file that
    they come from and would broadcast them through the driver.
    """
    if limit is None:
        return all_candidates(sigs, bits)
    if limit <= 0:
        raise ValueError("a limit must be positive")
    probes = F.array(F.lit(0), *[F.lit(1 << k) for k in range(bits)])
    tables = sigs.select("ord", F.posexplode("sigs").alias("tbl", "sig"))
    q = tables.select(F.col("ord").alias("q"), "tbl", "sig", F.posexplode(probes).alias("probe", "mask"))
    q = q.select("q", "tbl", "probe", F.col("sig").bitwiseXOR(F.col("mask")).alias("sig"))
    c = tables.select(F.col("ord").alias("c"), "tbl", "sig")
    place = F.row_number().over(Window.partitionBy("tbl", "sig").orderBy("c"))
    firsts = materialize(c.withColumn("n", place).where(F.col("n") <= limit), "firsts")
    held = firsts.groupBy("tbl", "sig").agg(F.collect_list("c").alias("held"))  # at most limit a bucket
    q = q.join(held.hint("merge"), ["tbl", "sig"]).withColumn("met", F.size(F.filter("held", lambda c: c < F.col("q")))).drop("held").where("met > 0")
    turn = Window.partitionBy("q").orderBy("tbl", "probe")
    earlier = turn.rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("all", F.coalesce(F.sum("met").over(earlier), F.lit(0)))
    q = q.withColumn("before", F.col("all") - F.min("all").over(Window.partitionBy("q", "tbl").orderBy("probe")))
    q = q.withColumn("most", F.coalesce(F.max(F.col("before") + F.col("met")).over(earlier), F.lit(0)))
    q = q.where(F.col("most") < limit).select("q", "tbl", "sig", "probe", F.least(F.col("met"), F.lit(limit) - F.col("before")).alias("take"))
    met = q.join(firsts.hint("merge"), ["tbl", "sig"]).where(F.col("n") <= F.col("take"))
    first = met.groupBy("q", "c").agg(F.min(F.col("tbl") * 64 + F.col("probe")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("at", "c"))
    return first.withColumn("_n", rank).where(F.col("_n") <= limit).select("q", "c")
