"""Near-dedup of embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (``SAMPLE_VECTORS`` vectors with the smallest hash of the id): principal axes,
then alternating binary codes and the best rotation to them, from several starts.  The signs of the rotated vectors are
cut into substrings, one Hamming table each; two vectors of a label meet in a table if a substring is equal.  Width and
number of tables follow from the number of vectors of the largest label, so that a pair at the threshold is met with
probability ``RECALL``.  Signs are taken without subtracting the mean: around it the angle of a close pair would be wider
than the one that the number of tables follows from.  Inside a bucket the original vectors are compared in double precision; a pair counts in the
first table where it meets.  A bucket returns link counts and a spanning forest, never all of its pairs, and buckets of
more than ``BLOCK`` vectors are compared block by block in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.components import connected_components, smallest_reached
from twinfold.session import fits_broadcast, materialize

THRESHOLD = 0.93
SAMPLE_VECTORS = 8_192
CODE_BITS = 64
ROUNDS = 30
RECALL = 0.98
BLOCK = 2_048
TILE = 512
#: Hot buckets (32 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def rotations(sample: np.ndarray, count: int, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """``count`` projections ``[dim, bits]`` learned from unit vectors; orthogonal ones where there are none."""
    bits = min(dim, CODE_BITS)
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    axes = np.linalg.svd(centred, full_matrices=False)[2].T[:, :bits] if len(sample) >= dim else np.eye(dim)[:, :bits]
    low, out = centred @ axes, []
    for k in range(count):
        r = np.linalg.qr(np.random.default_rng(k).standard_normal((bits, bits)))[0]
        for _ in range(rounds if len(sample) else 0):
            u, _, vt = np.linalg.svd(np.where(low @ r >= 0, 1.0, -1.0).T @ low)
            r = (u @ vt).T
        out.append(axes @ r)
    return np.stack(out)


def table_plan(largest: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and number of tables for ``largest`` vectors in a label."""
    bits = min(dim, CODE_BITS)
    width = max(1, min(bits, 24, round(math.log2(max(2, largest) / 4))))
    met = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


class Tables:
    """Substrings of the codes of vectors, one column a table."""

    def __init__(self, sample: np.ndarray, dim: int, largest: int):
        self.width, self.count = table_plan(largest, dim)
        each = max(1, min(dim, CODE_BITS) // self.width)
        self.projections = rotations(sample, -(-self.count // each), dim)
        self.each = each

    def keys(self, unit: np.ndarray) -> np.ndarray:
        out, weights = [], 1 << np.arange(self.width, dtype=np.int64)
        for p in self.projections:
            code = unit @ p >= 0
            for k in range(self.each):
                out.append(code[:, k * self.width : (k + 1) * self.width] @ weights)
        return np.stack(out[: self.count], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v: str = "v") -> F.Column:
    """True for vectors that can be compared: components there, finite and not all zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _links(x: np.ndarray, kx: np.ndarray, wx: np.ndarray, y: np.ndarray, ky: np.ndarray, wy: np.ndarray, table: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of each row of x and of y, and forest edges as positions in x ++ y (in x if they are the same)."""
    cx, cy, off = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), 0 if same else len(x)
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(x), TILE):
        for j in range(i if same else 0, len(y), TILE):
            near = x[i : i + TILE] @ y[j : j + TILE].T >= threshold
            if same and i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a, b = a + i, b + j
            first = np.ones(len(a), bool)
            for t in range(table):
                first &= kx[a, t] != ky[b, t]
            a, b = a[first], b[first]
            np.add.at(cx, a, wy[b])
            np.add.at(cx if same else cy, b, wx[a])
            node, root = smallest_reached(a, b + off)
            src.append(node[node != root])
            dst.append(root[node != root])
    return cx, cy, np.concatenate(src), np.concatenate(dst)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows with a null label or a vector that is null, empty, zero or holds null or non-finite components link with
    nothing; so do vectors of different length.  Equal vectors of a label are one class, their links are counted and not
    compared.  A row with a null id takes no part: no links, component null, not kept.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    fit = rows.where(usable() & F.col("id").isNotNull() & F.col("label").isNotNull())
    classes = materialize(fit.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    sizes = {r["dim"]: r["most"] for r in classes.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most")).collect()}
    sample: dict[int, list] = {}
    for r in classes.select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_VECTORS).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    tables = {d: Tables(_unit(np.array(sample[d], float)) if d in sample else np.zeros((0, d)), d, most) for d, most in sizes.items()}
    shared = classes.sparkSession.sparkContext.broadcast(tables)

    def placed(with_vectors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array([len(x) for x in batch.column("v")], np.int64)
                for d in np.unique(dims).tolist():
                    some = batch.take(pa.array(np.flatnonzero(dims == d)))
                    keys = shared.value[d].keys(_unit(_matrix(some.column("v"))))
                    for t in range(keys.shape[1]):
                        columns = [some.column("label"), pa.array(np.full(len(some), d, np.int32)), pa.array(np.full(len(some), t, np.int32)), pa.array(keys[:, t]), some.column("rep")]
                        names = ["label", "dim", "tbl", "key", "rep"]
                        if with_vectors:
                            flat = pa.array(keys.astype(np.int32).ravel())
                            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1]), flat)
                            columns, names = [*columns, some.column("n"), some.column("v"), lists], [*names, "n", "v", "keys"]
                        yield pa.RecordBatch.from_arrays(columns, names)

        kind = dict(classes.dtypes)["v"]
        return run, "label string, dim int, tbl int, key long, rep long" + (f", n long, v {kind}, keys array<int>" if with_vectors else "")

    bucket = ["label", "dim", "tbl", "key"]
    hot = materialize(classes.mapInArrow(*placed(False)).groupBy(*bucket).count().where(F.col("count") > BLOCK), "hot")
    hot = hot.select(*bucket, F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    if fits_broadcast(hot, BROADCAST_ROWS):
        hot = F.broadcast(hot)
    dealt = classes.mapInArrow(*placed(True)).join(hot, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, _, t, _, lo, hi = (k.as_py() for k in key)
        table = table.combine_chunks()
        own = table.column("own").to_numpy()
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if len(own) < 2:
            return empty
        unit = _unit(_matrix(table.column("v").combine_chunks()))
        keys = _matrix(table.column("keys").combine_chunks()).astype(np.int64)
        rep, weight = table.column("rep").to_numpy(), table.column("n").to_numpy()
        x, y = own == lo, own == hi
        if not x.any() or not y.any():
            return empty
        cx, cy, s, d = _links(unit[x], keys[x], weight[x], unit[y], keys[y], weight[y], t, threshold, lo == hi)
        both, count = (rep[x], cx) if lo == hi else (np.concatenate([rep[x], rep[y]]), np.concatenate([cx, cy]))
        some = count > 0
        nothing = np.zeros(len(s), np.int64)
        return pa.table({"a": np.concatenate([both[some], both[s]]), "b": pa.array(np.concatenate([both[some], both[d]])), "links": np.concatenate([count[some], nothing])})

    found = materialize(dealt.groupBy(*bucket, "lo", "hi").applyInArrow(compare, "a long, b long, links long"), "links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("links = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = classes.join(counts, F.col("rep") == F.col("a"), "left").drop("a").join(comp, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = fit.join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~(usable() & F.col("id").isNotNull() & F.col("label").isNotNull()) | F.col("label").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
