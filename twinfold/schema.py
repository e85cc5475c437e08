"""Row types and options of the clustering API."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

#: Input rows. ``ord`` is the position of a row: it decides representatives, "earlier" candidates and member order.
FINGERPRINTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("perceptual_hash", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("file_size", T.LongType()),
    ]
)
#: Output rows, one for each member; ``group_id`` is the smallest ``ord`` of the group.
GROUPS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("group_id", T.LongType()),
        T.StructField("member_pos", T.IntegerType()),
        T.StructField("id", T.StringType()),
    ]
)
EXACT, MODIFIED_COPY, RELATED = "EXACT", "MODIFIED_COPY", "RELATED"
MAX_HAMMING = 15


@dataclass(frozen=True)
class ClusterOptions:
    """Thresholds, checked when they are made.

    ``max_checks`` bounds the bucket entries that one row inspects by hash, ``candidate_limit`` the distinct
    candidates by vector; None for either searches without the bound.
    """

    hamming_threshold: int = 8
    similarity_threshold: float = 0.85
    include_singletons: bool = False
    max_checks: int | None = 256
    table_count: int = 12
    candidate_limit: int | None = 256

    def __post_init__(self) -> None:
        if not 0 <= self.hamming_threshold <= MAX_HAMMING:
            raise ValueError(f"hamming_threshold must be in 0..{MAX_HAMMING}")
        if not math.isfinite(self.similarity_threshold) or not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must be in 0..1")
        if self.table_count <= 0 or (self.candidate_limit is not None and self.candidate_limit <= 0):
            raise ValueError("table_count and candidate_limit must be positive")
        if self.max_checks is not None and self.max_checks < 0:
            raise ValueError("max_checks must not be negative")
