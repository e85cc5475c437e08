"""Features and groups after rows were deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.evidence import evidence_pairs
from twinfold.operators.ranks import ranked
from twinfold.session import fits_broadcast, materialize

#: Groups that are broadcast (about 60 bytes each); more are joined by a shuffle.
GROUP_ROWS = 100_000


def delete_rows(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows without the deleted ids, which any share of the rows may be: they are not broadcast."""
    return rows.join(deleted.select("id").hint("merge"), "id", "left_anti")


def regroup(groups: DataFrame, deleted: DataFrame) -> DataFrame:
    """Groups without the deleted ids; groups of fewer than two go.  Nothing is clustered anew, so ``group_id`` stays."""
    left = materialize(delete_rows(groups, deleted), "left")
    big = materialize(left.groupBy("kind", "group_id").count().where("count >= 2").select("kind", "group_id"), "big")
    big = F.broadcast(big) if fits_broadcast(big, GROUP_ROWS) else big.hint("merge")  # so a large group's members are not brought together for it
    rest = left.join(big, ["kind", "group_id"], "left_semi").withColumnRenamed("member_pos", "_was")
    return ranked(rest, ["kind", "group_id"], "_was", "member_pos").select("kind", "group_id", "member_pos", "id")


def regroup_with_evidence(groups: DataFrame, rows: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the groups, and the evidence of it: pairs are made anew from the rows that stay."""
    left = regroup(groups, deleted)
    return left, evidence_pairs(left, delete_rows(rows, deleted))


def delete_message(outcomes: DataFrame) -> DataFrame:
    """One row ``message`` from ``outcomes(id, ok)``."""
    counts = outcomes.agg(F.count_if("ok").alias("good"), F.count("*").alias("n"))
    good, bad = F.col("good").cast("string"), (F.col("n") - F.col("good")).cast("string")
    text = (
        F.when(F.col("good") == 0, "No photos were deleted. The selected storage provider may not allow deletion.")
        .when(F.col("good") == F.col("n"), F.concat(F.lit("Deleted "), good, F.when(F.col("good") == 1, " photo.").otherwise(" photos.")))
        .otherwise(F.concat(F.lit("Deleted "), good, F.lit("; "), bad, F.lit(" could not be deleted.")))
    )
    return counts.select(text.alias("message"))
