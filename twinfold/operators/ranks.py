"""Positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.session import materialize

#: Rows of a group that one task sorts; larger groups are cut into ranges.
ONE_TASK = 100_000


def ranked(rows: DataFrame, keys: list[str], order: str, name: str, most: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the position from 1 in ascending ``order`` among the rows of the same (not null) ``keys``.

    Groups of more than ``most`` rows are dealt by ranges of ``order``; each range counts its own rows, and those of the
    ranges before it in its group are added.
    """
    rows, most = materialize(rows, "ranked"), most or ONE_TASK
    own = lambda df, by: df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    large = materialize(rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys), "large")
    if large.isEmpty():
        return own(rows, keys)
    ranged = rows.join(large, keys, "left_semi").repartitionByRange(*keys, order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # a row a range of each large group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = own(ranged, [*keys, "_part"]).join(sizes.select(*keys, "_part", before.alias("_before")), [*keys, "_part"])
    many = many.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*rows.columns, name)
    return own(rows.join(large, keys, "left_anti"), keys).unionByName(many)
