"""Multi-index hash joins: pairs of rows whose 64-bit hashes differ in at most r bits.

A hash is cut into r + 1 blocks; two hashes within r bits are equal in one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions import scalar as S
from twinfold.operators.components import smallest_reached
from twinfold.session import fits_broadcast, materialize

META = ("width", "height", "file_size")
#: Rows of a bucket that one task compares with as many others, and rows of a tile of working space.
BLOCK, TILE = 8_192, 1_024
#: Buckets whose sizes are broadcast (about 20 bytes each); more are joined by a shuffle.
BUCKETS = 100_000


def mih_blocks(rows: DataFrame, threshold: int) -> DataFrame:
    """``(ord, perceptual_hash, block, key)``: one row a block of every row that has a hash."""
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), S.hash_block(F.col("perceptual_hash"), threshold, b).alias("key")) for b in range(threshold + 1)])
    return rows.where("perceptual_hash IS NOT NULL").select("ord", "perceptual_hash", F.inline(blocks))


def mih_pairs(rows: DataFrame, threshold: int, max_checks: int | None = None) -> DataFrame:
    """``(q, c, distance)``: each row with the earlier rows that its search finds, each pair once.

    Without ``max_checks`` all pairs within the threshold are found: a pair is kept in the first block where it is
    equal, so none has to be made distinct.  With it a row inspects at most so many bucket entries, in order of block
    and position, repeats and misses included.  What each block adds follows from the row's place in its bucket, so the
    join makes those entries alone: never more than ``max_checks`` a row, and no bucket is read beyond its first ones.
    """
    S.block_layout(threshold)
    blocks = mih_blocks(rows, threshold)
    q = blocks.select(F.col("ord").alias("q"), F.col("perceptual_hash").alias("qh"), "block", "key")
    c = blocks.select(F.col("ord").alias("c"), F.col("perceptual_hash").alias("ch"), "block", "key")
    distance = S.hamming_distance(F.col("qh"), F.col("ch"))
    if max_checks is None:
        x = F.col("qh").bitwiseXOR(F.col("ch"))
        first = F.coalesce(*[F.when(S.hash_block(x, threshold, b) == 0, F.lit(b)) for b in range(threshold + 1)])
        pairs = q.join(c, ["block", "key"]).where(F.col("c") < F.col("q")).where((distance <= threshold) & (first == F.col("block")))
        return pairs.select("q", "c", distance.alias("distance"))
    if max_checks == 0:
        return q.limit(0).select("q", F.col("q").alias("c"), F.lit(0).alias("distance"))
    q, firsts = _inspected(blocks, max_checks)
    near = q.join(firsts.hint("merge"), ["block", "key"]).where((F.col("n") <= F.col("take")) & (distance <= threshold))
    return near.select("q", "c", distance.alias("distance")).distinct()


def _inspected(blocks: DataFrame, max_checks: int) -> tuple[DataFrame, DataFrame]:
    """``(q, qh, block, key, take)``: how many of a bucket's first entries a row inspects (more than 0); and ``(c, ch, block,
    key, n)``: the first ``max_checks`` entries of each bucket and their places.

    They meet others by merge joins: up to ``threshold + 1`` rows a hash, which Spark would broadcast through the driver
    for the small file that they come from.
    """
    q = blocks.select(F.col("ord").alias("q"), F.col("perceptual_hash").alias("qh"), "block", "key")
    c = blocks.select(F.col("ord").alias("c"), F.col("perceptual_hash").alias("ch"), "block", "key")
    place = F.row_number().over(Window.partitionBy("block", "key").orderBy("c"))
    firsts = materialize(c.withColumn("n", place).where(F.col("n") <= max_checks), "firsts")
    # a row that is not among the first of its bucket has at least so many before it
    own = firsts.select(F.col("c").alias("q"), "block", "key", (F.col("n") - 1).alias("met"))
    q = q.join(own.hint("merge"), ["q", "block", "key"], "left").withColumn("met", F.coalesce("met", F.lit(max_checks))).where(F.col("met") > 0)
    before = F.coalesce(F.sum("met").over(Window.partitionBy("q").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return q.withColumn("take", F.least(F.col("met"), F.lit(max_checks) - before)).where(F.col("take") > 0).drop("met"), firsts


def _accepts(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The metadata filter for every pair of these rows, as ``scalar.passes_metadata``."""
    w, h, size = (x[k] for k in META)
    known = ((w[i] > 0) & (h[i] > 0))[:, None] & ((w[j] > 0) & (h[j] > 0))[None, :]
    ratio = np.where((w > 0) & (h > 0), w / np.maximum(h, 1), 1.0)
    a, b = ratio[i][:, None], ratio[j][None, :]
    near = np.where(a > b, a / b, b / a) <= 1.2
    s, t = size[i][:, None], size[j][None, :]
    sized = (s > 0) & (t > 0) & (np.maximum(s, t) > np.minimum(s, t) * 10)
    return ~known | (near & ~sized)


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The roots of all rows once these pairs of rows are linked."""
    u, v = root[u], root[v]
    if not (u != v).any():
        return root
    nodes, low = smallest_reached(u[u != v], v[u != v])
    new = np.arange(len(root))
    new[nodes] = low
    return new[root]


def _cells(rows: DataFrame, metadata: bool) -> DataFrame:
    """``(ord, width, height, file_size)`` with 0 for null, or 0 all over without ``metadata``."""
    cells = [F.coalesce(c, F.lit(0)).cast("double" if c != "file_size" else "long").alias(c) if metadata else F.lit(0).alias(c) for c in META]
    return rows.where("perceptual_hash IS NOT NULL").select("ord", *cells)


def mih_forest(rows: DataFrame, threshold: int, metadata: bool = True) -> DataFrame:
    """``(q, c)`` edges that connect all rows within the threshold (and, with ``metadata``, alike in shape and size).

    Every bucket returns a spanning forest of its links, fewer edges than it has rows and never all its pairs; a bucket
    of more than ``BLOCK`` rows is compared block by block in tasks of their own.
    """
    S.block_layout(threshold)
    there = rows.where("perceptual_hash IS NOT NULL")
    blocks = mih_blocks(there, threshold).join(_cells(there, metadata), "ord")
    sizes = mih_blocks(there, threshold).groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = blocks.join(sizes, ["block", "key"]).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("ord"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("n", "parts", "other")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = (k.as_py() for k in key[2:])
        x = {c: table.column(c).to_numpy() for c in ("ord", "own", "perceptual_hash", *META)}
        bits = x["perceptual_hash"].view(np.uint64)
        left, right = np.flatnonzero(x["own"] == lo), np.flatnonzero(x["own"] == hi)
        root = np.arange(len(bits))
        for a in range(0, len(left), TILE):
            i = left[a : a + TILE]
            for b in range(a if lo == hi else 0, len(right), TILE):
                j = right[b : b + TILE]
                near = np.bitwise_count(bits[i][:, None] ^ bits[j][None, :]) <= threshold
                if metadata and near.any():
                    near &= _accepts(x, i, j)
                m, n = np.nonzero(near)
                root = _joined(root, i[m], j[n])
        some = np.flatnonzero(root != np.arange(len(bits)))
        return pa.table({"q": x["ord"][some], "c": x["ord"][root[some]]})

    return dealt.groupBy("block", "key", "lo", "hi").applyInArrow(compare, "q long, c long")


def capped_forest(rows: DataFrame, threshold: int, max_checks: int, metadata: bool = True) -> DataFrame:
    """``(q, c)`` edges that connect what the pairs of ``mih_pairs`` with ``max_checks`` connect (with ``metadata`` those of them
    that are alike in shape and size).

    The rows that inspect a bucket meet its first entries in blocks of about ``BLOCK`` rows, and each block returns a
    spanning forest, fewer edges than it has rows: pairs are never rows of a table.
    """
    S.block_layout(threshold)
    if max_checks == 0:
        return rows.limit(0).select(F.col("ord").alias("q"), F.col("ord").alias("c"))
    q, firsts = _inspected(mih_blocks(rows, threshold), max_checks)
    q = materialize(q, "inspected")
    cells = _cells(rows, metadata).hint("merge")
    parts = materialize(q.groupBy("block", "key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts")), "parts")
    parts = F.broadcast(parts) if fits_broadcast(parts, BUCKETS) else parts.hint("merge")  # so a hot bucket's rows are not brought together for it
    left = q.join(parts, ["block", "key"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).drop("parts")
    left = left.withColumnRenamed("q", "ord").join(cells, "ord")
    right = firsts.withColumnRenamed("c", "ord").join(cells, "ord").join(parts, ["block", "key"])
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    held = right.select(*[F.col(c).alias(f"held_{c}") for c in ("block", "key", "part", "ord", "ch", "n", *META)])

    def compare(asking: pa.Table, held: pa.Table) -> pa.Table:
        names = {"ord": "ord", "qh": "ch", "take": "n"} | {c: c for c in META}
        x = {a: np.concatenate([asking.column(a).to_numpy(), held.column(f"held_{b}").to_numpy()]) for a, b in names.items()}
        bits, j = x["qh"].view(np.uint64), np.arange(len(asking), len(asking) + len(held))
        root = np.arange(len(bits))
        for a in range(0, len(asking), TILE):
            i = np.arange(a, min(a + TILE, len(asking)))
            near = (x["take"][j][None, :] <= x["take"][i][:, None]) & (np.bitwise_count(bits[i][:, None] ^ bits[j][None, :]) <= threshold)
            if metadata and near.any():
                near &= _accepts(x, i, j)
            m, n = np.nonzero(near)
            root = _joined(root, i[m], j[n])
        some = np.flatnonzero(root != np.arange(len(bits)))
        return pa.table({"q": x["ord"][some], "c": x["ord"][root[some]]})

    return left.groupBy("block", "key", "part").cogroup(held.groupBy("held_block", "held_key", "held_part")).applyInArrow(compare, "q long, c long")
