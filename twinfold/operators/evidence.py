"""Pairwise evidence inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions import scalar as S

PAIRS = 20


def evidence_pairs(groups: DataFrame, rows: DataFrame, limit: int = PAIRS) -> DataFrame:
    """``(kind, group_id, left_id, right_id, exact_match, hamming_distance, cosine_similarity)`` of the first pairs of each group.

    Pairs come in row-major order of member position; members without a row in ``rows`` are skipped and do not count.
    Pairs are not filtered by any threshold.  The first ``limit`` pairs only reach the first ``limit + 1`` members, so
    groups are cut there before they meet themselves.  Members meet rows by merge joins: Spark would broadcast them through
    the driver for the small file that groups come from.
    """
    cells = rows.select("id", "content_hash", "perceptual_hash", "embedding")
    there = groups.join(rows.select("id").hint("merge"), "id", "left_semi")
    pos = F.row_number().over(Window.partitionBy("kind", "group_id").orderBy("member_pos"))
    few = there.withColumn("_n", pos).where(F.col("_n") <= limit + 1).select("kind", "group_id", "_n", "id")
    few = few.join(cells.hint("merge"), "id").withColumn("_norm", S.norm(F.col("embedding")))
    left = few.select("kind", "group_id", *[F.col(c).alias(f"l_{c}") for c in few.columns if c not in ("kind", "group_id")])
    right = few.select("kind", "group_id", *[F.col(c).alias(f"r_{c}") for c in few.columns if c not in ("kind", "group_id")])
    pairs = left.join(right, ["kind", "group_id"]).where(F.col("l__n") < F.col("r__n"))
    turn = F.row_number().over(Window.partitionBy("kind", "group_id").orderBy("l__n", "r__n"))
    pairs = pairs.withColumn("_turn", turn).where(F.col("_turn") <= limit)
    return pairs.select(
        "kind",
        "group_id",
        F.col("l_id").alias("left_id"),
        F.col("r_id").alias("right_id"),
        F.coalesce(F.col("l_content_hash") == F.col("r_content_hash"), F.lit(False)).alias("exact_match"),
        S.hamming_distance(F.coalesce("l_perceptual_hash", F.lit(0)), F.coalesce("r_perceptual_hash", F.lit(0))).alias("hamming_distance"),
        F.coalesce(S.cosine_of(F.col("l_embedding"), F.col("r_embedding"), F.col("l__norm"), F.col("r__norm")), F.lit(0.0).cast("float")).alias("cosine_similarity"),
    )


def with_names(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` with ``left_name`` and ``right_name`` from ``names(id, display_name)``; the id itself where there is none."""
    for side in ("left", "right"):
        of = names.select(F.col("id").alias(f"{side}_id"), F.col("display_name").alias(f"{side}_name"))
        pairs = pairs.join(of.hint("merge"), f"{side}_id", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", f"{side}_id"))
    return pairs
