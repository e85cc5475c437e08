"""Rows with the same content: groups and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.ranks import ranked
from twinfold.schema import EXACT

HAS_HASH = "content_hash IS NOT NULL AND content_hash <> ''"


def exact_members(rows: DataFrame) -> DataFrame:
    """``(kind, group_id, ord, id)`` of every row whose content hash another row has as well."""
    sizes = rows.where(HAS_HASH).groupBy("content_hash").agg(F.min("ord").alias("group_id"), F.count("*").alias("n")).where("n >= 2")
    return rows.where(HAS_HASH).join(sizes, "content_hash").select(F.lit(EXACT).alias("kind"), "group_id", "ord", "id")


def representatives(rows: DataFrame) -> DataFrame:
    """The first row of each content hash and every row without one, with all columns."""
    first = rows.where(HAS_HASH).groupBy("content_hash").agg(F.min("ord").alias("_first"))
    with_hash = rows.where(HAS_HASH).join(first, (rows["content_hash"] == first["content_hash"]) & (F.col("ord") == F.col("_first")), "left_semi")
    return with_hash.unionByName(rows.where(f"NOT coalesce({HAS_HASH}, false)"))


def positioned(members: DataFrame) -> DataFrame:
    """``(kind, group_id, member_pos, id)`` from ``(kind, group_id, ord, id)``; a group may hold any share of the rows."""
    return ranked(members, ["kind", "group_id"], "ord", "member_pos").select("kind", "group_id", "member_pos", "id")
