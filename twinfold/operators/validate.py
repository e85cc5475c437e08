"""Validation of fingerprint rows in one aggregate pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PROBLEMS = {
    "empty_ids": "ids must not be empty",
    "repeated_ids": "ids must be unique",
    "mixed_dimensions": "vectors must have one dimension",
    "odd_values": "vectors must hold finite values",
}


def problems(rows: DataFrame) -> DataFrame:
    """One row of flags ``empty_ids, repeated_ids, mixed_dimensions, odd_values``, in the order in which they are reported."""
    size = F.when(F.size("embedding") > 0, F.size("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    per_id = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.max(odd.cast("int")).alias("odd"))
    flag = lambda c: F.coalesce(F.max(c.cast("int")) == 1, F.lit(False))
    return per_id.agg(
        flag(F.coalesce("id", F.lit("")) == "").alias("empty_ids"),
        flag(F.col("n") > 1).alias("repeated_ids"),
        F.coalesce(F.min("lo") != F.max("hi"), F.lit(False)).alias("mixed_dimensions"),
        flag(F.col("odd") == 1).alias("odd_values"),
    )


def validate(rows: DataFrame) -> None:
    """Raise ValueError for empty or repeated ids, vectors of different length, or values that are not finite."""
    found = problems(rows).first()
    for name, message in PROBLEMS.items():
        if found[name]:
            raise ValueError(message)
