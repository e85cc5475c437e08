"""Connected components of an edge table by randomised contraction.

Every round hooks each vertex on the neighbour (or itself) that is smallest under a fresh hash order, replaces
both ends of every edge by their hooks and drops loops and repeats.  A constant share of the vertices goes in each
round, so the number of rounds is logarithmic for any shape of graph (long chains included).  The per-vertex step is
a ``min`` aggregate, so a hub is combined map-side and no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.session import materialize

#: Edges that one task may finish by itself; the check is a count, larger graphs go through the rounds.
SINGLE_TASK_EDGES = 20_000


def smallest_reached(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex that each reaches, for one batch of edges."""
    nodes, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges that keep each batch of edges as connected as it was, one a vertex; roots have a loop."""
    for pdf in batches:
        nodes, root = smallest_reached(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        yield pd.DataFrame({"src": nodes, "dst": root})


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pdf = pd.concat([pd.DataFrame({"src": [], "dst": []}, dtype="int64"), *batches])
    nodes, root = smallest_reached(pdf["src"].to_numpy("int64"), pdf["dst"].to_numpy("int64"))
    yield pd.DataFrame({"node": nodes, "hook": root})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", thin: bool = True) -> DataFrame:
    """``(node, component)`` for every vertex of an edge; ``component`` is the smallest vertex it reaches.

    Edges are undirected BIGINT pairs.  Repeated edges and loops count once or not at all (a vertex with only a loop
    is its own component); rows with a null end are ignored; an empty table gives no rows.  ``thin`` cuts every batch of
    edges to a forest first; edges that come from forests already, out of a Python function, need no second one in
    the same task, which would hold a second Python worker.
    """
    ends = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    ends = ends.where("src IS NOT NULL AND dst IS NOT NULL")
    forest = materialize((ends.mapInPandas(_forest, "src long, dst long") if thin else ends).distinct(), "edges")
    left, loops = forest.where("src <> dst"), forest.where("src = dst").select(F.col("src").alias("node"))
    chain: list[DataFrame] = []
    spark = edges.sparkSession
    while (n := left.count()) > SINGLE_TASK_EDGES:
        seed = F.lit(len(chain) + 17)
        both = left.union(left.select("dst", "src"))
        key = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("v"))
        hooks = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min(key("dst")), F.min(key("src"))).getField("v").alias("hook"))
        hooks = materialize(hooks, "hooks")
        chain.append(hooks)
        a, b = hooks.toDF("src", "a"), hooks.toDF("dst", "b")
        # merge joins: Spark would broadcast a row a vertex through the driver for the small file that it comes from
        left = left.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("a <> b")
        left = materialize(left.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    last = left.coalesce(1).mapInPandas(_finish, "node long, hook long") if n else spark.createDataFrame([], "node long, hook long")
    # from the last contraction back: a vertex takes the root of its hook, or the hook itself where that vanished
    for hooks in reversed(chain):
        up = last.toDF("hook", "root")
        last = hooks.join(up.hint("merge"), "hook", "left").select("node", F.coalesce("root", "hook").alias("hook"))
    if chain:
        least = last.groupBy("hook").agg(F.min("node").alias("component"))
        last = last.join(least.hint("merge"), "hook").select("node", F.least("component", "hook").alias("component")).hint("merge")
    else:
        last = last.select("node", F.col("hook").alias("component"))
    alone = loops.join(last, "node", "left_anti").select("node", F.col("node").alias("component"))
    return last.unionByName(alone)
