"""What a reader of the groups is shown: suggestions, counts, sums and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.ranks import ranked
from twinfold.schema import EXACT, GROUPS, MODIFIED_COPY, RELATED


def cleanup_suggestions(groups: DataFrame) -> DataFrame:
    """Distinct ids of all but the first member of every exact and modified group."""
    return groups.where(F.col("kind").isin(EXACT, MODIFIED_COPY) & (F.col("member_pos") > 1)).select("id").distinct()


def toggle(ids: DataFrame, one: str) -> DataFrame:
    """The set of ids with ``one`` removed if it is in it, else added."""
    other = ids.sparkSession.createDataFrame([(one,)], "id string")
    return ids.where(F.col("id") != one).unionByName(other.join(ids, "id", "left_anti"))


def selected_bytes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row ``bytes``: the sizes of the selected rows, unknown sizes as 0."""
    return rows.join(ids, "id", "left_semi").agg(F.coalesce(F.sum(F.coalesce("file_size", F.lit(0))), F.lit(0)).alias("bytes"))


def summary_counts(rows: DataFrame, groups: DataFrame, exposures: DataFrame) -> DataFrame:
    """One row: photos, duplicate groups (exact and modified), related groups, exposure warnings."""
    first = groups.where("member_pos = 1")
    counted = first.agg(F.count_if(F.col("kind").isin(EXACT, MODIFIED_COPY)).alias("duplicate_groups"), F.count_if(F.col("kind") == RELATED).alias("related_groups"))
    warned = exposures.agg(F.count_if(F.col("classification") != "NORMAL").alias("warnings"))
    return rows.agg(F.count("*").alias("photos")).join(counted).join(warned)  # three tables of one row each


def numbered_groups(groups: DataFrame) -> DataFrame:
    """``(kind, group_id, number)``: groups of a kind numbered from 1 in order of their first member."""
    return ranked(groups.select("kind", "group_id").distinct(), ["kind"], "group_id", "number")


def chunked(members: DataFrame, size: int = 2) -> DataFrame:
    """``members`` with the ``chunk`` of its position."""
    return members.withColumn("chunk", F.floor((F.col("member_pos") - 1) / size).cast("int"))


CODES = {EXACT: 0, MODIFIED_COPY: 1, RELATED: 2}


def flat_groups(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``(group_id, flat array<bigint>)``, one array a group: kind code, member count, then the members' positions (``ord``).

    Members meet rows by a merge join: Spark would broadcast them through the driver for the small file of the groups.
    """
    code = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c)) for k, c in CODES.items()]).cast("long")
    placed = groups.join(rows.select("id", "ord").hint("merge"), "id")
    members = F.transform(F.array_sort(F.collect_list(F.struct("member_pos", "ord"))), lambda m: m.ord)
    return placed.groupBy("kind", "group_id").agg(members.alias("m")).select("group_id", F.concat(F.array(code, F.size("m").cast("long")), "m").alias("flat"))


def decode_groups(flat: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups from ``flat(group_id, flat)``, the other way round.

    The query fails for an array without kind and count, a count below two or other than the members that follow, a
    position that ``rows`` has not, and an unknown kind.
    """
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<bigint>")
    n, count = F.size("flat"), F.get("flat", F.lit(1))
    kind = F.coalesce(*[F.when(F.get("flat", F.lit(0)) == c, F.lit(k)) for k, c in CODES.items()])
    members = (
        F.when(F.col("flat").isNull() | (n < 2), fail("a group's header is incomplete"))
        .when(F.coalesce((count < 2) | (n != count + 2), F.lit(True)), fail("a group's members are incomplete"))
        .when(kind.isNull(), fail("a group's kind is unknown"))
        .otherwise(F.slice("flat", F.lit(3), F.greatest(n - 2, F.lit(0))))
    )
    found = flat.select("group_id", kind.alias("kind"), F.posexplode(members).alias("pos", "ord")).join(rows.select("ord", "id").hint("merge"), "ord", "left")
    known = F.when(F.col("id").isNull(), F.raise_error(F.lit("a group's position is unknown")).cast("string")).otherwise(F.col("id"))
    return found.select("kind", "group_id", (F.col("pos") + 1).cast("int").alias("member_pos"), known.alias("id"))


def write_groups(groups: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write groups as Parquet, a folder for each kind."""
    groups.select(*GROUPS.names).write.mode(mode).partitionBy("kind").parquet(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """The groups that ``write_groups`` wrote; a kind's folder alone is read where the kind is asked for."""
    return spark.read.schema(GROUPS).parquet(path).select(*GROUPS.names)
