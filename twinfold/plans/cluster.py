"""The three-phase clustering: exact, modified copies, related rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions import scalar as S
from twinfold.operators import exact, lsh, mih
from twinfold.operators.components import connected_components
from twinfold.operators.validate import validate
from twinfold.schema import EXACT, FINGERPRINTS, MODIFIED_COPY, RELATED, ClusterOptions
from twinfold.session import materialize

META = mih.META


def complete(rows: DataFrame) -> DataFrame:
    """Rows with every column of a fingerprint, null where there is none."""
    types = {"embedding": dict(rows.dtypes).get("embedding", "array<float>")}
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(types.get(f.name, f.dataType)).alias(f.name) for f in FINGERPRINTS])


def _sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs(q, c)`` with the columns of both rows, as ``q_*`` and ``c_*``."""
    for side in ("q", "c"):
        pairs = pairs.join(rows.select(F.col("ord").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in columns]), side)
    return pairs


def _metadata() -> F.Column:
    return S.passes_metadata(*[F.col(f"{s}_{c}") for s in ("q", "c") for c in META])


def _members(pairs: DataFrame, rows: DataFrame, kind: str, thin: bool = True) -> DataFrame:
    comp = connected_components(pairs, "q", "c", thin).withColumnRenamed("node", "ord")
    return rows.select("ord", "id").hint("merge").join(comp, "ord").select(F.lit(kind).alias("kind"), F.col("component").alias("group_id"), "ord", "id")


def modified_members(reps: DataFrame, options: ClusterOptions) -> DataFrame:
    """Components of representatives within the Hamming threshold that pass the metadata filter; none at threshold 0."""
    if options.hamming_threshold == 0:
        return reps.limit(0).select(F.lit(MODIFIED_COPY).alias("kind"), F.col("ord").alias("group_id"), "ord", "id")
    t = options.hamming_threshold
    edges = mih.mih_forest(reps, t) if options.max_checks is None else mih.capped_forest(reps, t, options.max_checks)
    return _members(edges, reps, MODIFIED_COPY, thin=False)


def related_comparisons(reps: DataFrame, modified: DataFrame, options: ClusterOptions) -> DataFrame:
    """``(q, c, cosine)``: candidate pairs by vector that are not in one modified group and pass the metadata filter."""
    whole = reps.where("size(embedding) > 0").withColumn("norm", S.norm(F.col("embedding")))
    shape = whole.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if shape["n"] < 2:
        return reps.limit(0).select(F.col("ord").alias("q"), F.col("ord").alias("c"), F.lit(0.0).cast("float").alias("cosine"))
    bits = lsh.signature_bits(shape["n"])
    sigs = materialize(lsh.signatures(whole, bits, shape["d"], options.table_count), "signatures")
    of = modified.select("ord", F.col("group_id").alias("mod"))
    narrow = whole.select("ord", *META).join(of.hint("merge"), "ord", "left")
    # cheap filters first; vectors only follow for pairs that are left, by merge joins: a file tells little of their size
    apart = ~F.coalesce(F.col("q_mod") == F.col("c_mod"), F.lit(False)) & _metadata()
    if options.candidate_limit is None:  # no pair counts against another, so none has to leave its bucket to be filtered
        pairs = lsh.all_candidates(sigs.join(narrow.hint("merge"), "ord"), bits, (*META, "mod"), apart)
    else:
        pairs = _sides(lsh.lsh_candidates(sigs, bits, options.candidate_limit), narrow, *META, "mod").where(apart).select("q", "c")
    pairs = _sides(pairs, whole.hint("merge"), "embedding", "norm")
    return pairs.select("q", "c", S.cosine_of(F.col("q_embedding"), F.col("c_embedding"), F.col("q_norm"), F.col("c_norm")).alias("cosine"))


def related_members(reps: DataFrame, modified: DataFrame, options: ClusterOptions) -> DataFrame:
    pairs = related_comparisons(reps, modified, options).where(F.col("cosine") >= F.lit(options.similarity_threshold).cast("float"))
    return _members(pairs, reps, RELATED)


def singletons(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of no group as groups of one: of each kind that they have a feature for, or exact if they have none."""
    alone = rows.join(grouped.select("ord").distinct().hint("merge"), "ord", "left_anti")  # any share of the rows: not broadcast
    has = lambda c, kind: F.when(c, kind)
    hashed = F.coalesce(F.expr(exact.HAS_HASH), F.lit(False))
    kinds = F.array_compact(F.array(has(F.col("perceptual_hash").isNotNull(), MODIFIED_COPY), has(F.size("embedding") > 0, RELATED), has(hashed, EXACT)))
    kinds = F.when(F.size(kinds) == 0, F.array(F.lit(EXACT))).otherwise(kinds)
    return alone.select(F.explode(kinds).alias("kind"), F.col("ord").alias("group_id"), "ord", "id")


def cluster_duplicates(rows: DataFrame, options: ClusterOptions | None = None, check: bool = True) -> DataFrame:
    """``(kind, group_id, member_pos, id)`` of all groups of fingerprint rows; ``group_id`` is the smallest ord of a group.

    A row without content hash stands for itself; rows without perceptual hash or vector take no part in that phase.
    Only the first row of each content enters the later phases.
    """
    options = options or ClusterOptions()
    rows = materialize(complete(rows), "rows")
    if check:
        validate(rows)
    reps = materialize(exact.representatives(rows), "representatives")
    same = exact.exact_members(rows)
    modified = materialize(modified_members(reps, options), "modified")
    found = same.unionByName(modified).unionByName(related_members(reps, modified, options))
    if options.include_singletons:
        found = materialize(found, "groups")
        found = found.unionByName(singletons(rows, found))
    return exact.positioned(found)


def comparison_count(rows: DataFrame, options: ClusterOptions | None = None) -> DataFrame:
    """One row ``embedding_comparisons``: pairs that reach the cosine test."""
    options = options or ClusterOptions()
    reps = materialize(exact.representatives(complete(rows)), "representatives")
    modified = materialize(modified_members(reps, options), "modified")
    return related_comparisons(reps, modified, options).agg(F.count("*").alias("embedding_comparisons"))


def find_duplicate_groups(rows: DataFrame, hamming_threshold: int = 8, similarity_threshold: float = 0.85) -> DataFrame:
    """The call of an application: no groups for fewer than two rows or if the first row has no vector, never singletons."""
    rows = complete(rows)
    first = rows.orderBy("ord").select(F.size("embedding").alias("n")).limit(2).collect()
    options = ClusterOptions(hamming_threshold, similarity_threshold)
    if len(first) < 2 or (first[0]["n"] or 0) <= 0:
        return exact.positioned(rows.limit(0).select(F.lit(EXACT).alias("kind"), F.col("ord").alias("group_id"), "ord", "id"))
    return cluster_duplicates(rows, options)
