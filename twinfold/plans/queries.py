"""The registered queries: every operator over the supplied tables.

Documents serve as rows with a content hash, a hash of all their words and dimensions; ``embeddings`` as rows with a vector.
The similarity threshold is 0.40, as no two of the supplied vectors reach the default of 0.85.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold import sources
from twinfold.functions import scalar as S
from twinfold.operators import evidence, exact, lsh, mih, regroup, report
from twinfold.operators.components import connected_components
from twinfold.operators.validate import problems
from twinfold.plans import cluster
from twinfold.schema import ClusterOptions
from twinfold.session import file_system, materialize, shared_path, written

OPTIONS = ClusterOptions(hamming_threshold=8, similarity_threshold=0.40)
UNCAPPED = ClusterOptions(hamming_threshold=8, similarity_threshold=0.40, max_checks=None, candidate_limit=None)


def _docs(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    return sources.document_fingerprints(spark, d, vectors)


def _reps(spark: SparkSession, d: str) -> DataFrame:
    return materialize(exact.representatives(_docs(spark, d)), "representatives")


#: Rows of the last tables, by session, folder and state of their files, and their clustering by options: many queries start from it.
_SHARED: dict[tuple, dict[ClusterOptions | None, DataFrame]] = {}


def _state(spark: SparkSession, d: str) -> tuple:
    """Sizes and times of the files of the tables that the clustering reads."""
    out = []
    for name in ("documents", "embeddings"):
        fs, path = file_system(spark, f"{d}/{name}.parquet")
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(sorted(out))


def _clustered(spark: SparkSession, d: str, options: ClusterOptions = OPTIONS) -> tuple[DataFrame, DataFrame]:
    """Rows and groups of the documents, computed once for as long as the files and the intermediate data stay."""
    key = (spark.sparkContext.applicationId, d, _state(spark, d))
    if key not in _SHARED or not all(written(x) for x in _SHARED[key].values()):
        rows = materialize(_docs(spark, d, True), "rows")
        _SHARED.clear()
        _SHARED[key] = {None: rows}
    held = _SHARED[key]
    if options not in held:
        held[options] = materialize(cluster.cluster_duplicates(held[None], options), "clusters")
    return held[None], held[options]


def _deleted(rows: DataFrame) -> DataFrame:
    return rows.where("ord % 3 = 0").select("id")


def exact_groups(spark, d):
    return exact.positioned(exact.exact_members(_docs(spark, d)))


def representatives(spark, d):
    return exact.representatives(_docs(spark, d)).select("id", "ord")


def sha256_hash(spark, d):
    return _docs(spark, d).select("id", "content_hash")


def dhash(spark, d):
    return sources.document_grids(spark, d).select("id", S.difference_hash(S.checked_grid(F.col("luminance"))).alias("perceptual_hash"))


def exposure(spark, d):
    grids = sources.document_grids(spark, d, sources.text_codes).select("id", S.exposure(F.col("luminance")).alias("e"))
    return grids.select("id", "e.classification", F.round("e.mean_luminance", 6).alias("mean_luminance"), F.round("e.dark_pixel_ratio", 6).alias("dark_pixel_ratio"), F.round("e.bright_pixel_ratio", 6).alias("bright_pixel_ratio"))


def exposure_labels(spark, d):
    return exposure(spark, d).select("id", S.exposure_label(F.col("classification")).alias("label"))


def _triples(of: Callable) -> Callable:
    """``of(red, green, blue)`` of every three values of a text in turn, with 0 past the end."""
    def all_of(codes: F.Column) -> F.Column:
        at = lambda k: F.coalesce(F.get(codes, k), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 3).cast("int")), lambda k: of(at(k * 3), at(k * 3 + 1), at(k * 3 + 2)))

    return lambda text: S.let(sources.text_codes(text), all_of)


def _digest(values: F.Column) -> list[F.Column]:
    return [F.size(values).alias("n"), F.md5(F.array_join(F.transform(values, lambda v: v.cast("string")), ",")).alias("digest")]


def luminance(spark, d):
    g = sources.document_grids(spark, d, _triples(S.luminance))
    return g.select("id", *_digest(F.col("luminance")))


def rgb_normalise(spark, d):
    g = sources.document_grids(spark, d, _triples(lambda r, g, b: r * 65536 + g * 256 + b))
    millionths = F.transform(S.normalised_rgb(F.col("luminance")), lambda v: F.floor(v.cast("double") * 1000000 + 0.5))
    return g.select("id", millionths.alias("v")).select("id", *_digest(F.col("v")))


def hamming_pairs(spark, d):
    return mih.mih_pairs(_reps(spark, d), 4)


def mih_blocks(spark, d):
    return mih.mih_blocks(_reps(spark, d), 8).select("ord", "block", "key")


def mih_candidates_exact(spark, d):
    return mih.mih_pairs(_reps(spark, d), 8)


def mih_candidates_capped(spark, d):
    return mih.mih_pairs(_reps(spark, d), 8, 256)


def mih_candidates_tight(spark, d):
    """A budget that many rows of the supplied tables use up."""
    return mih.mih_pairs(_reps(spark, d), 8, 32)


def lsh_candidates_tight(spark, d):
    return lsh.lsh_candidates(*_signatures(spark, d), 24)


def metadata_filter_pairs(spark, d):
    reps = _reps(spark, d)
    return cluster._sides(mih.mih_pairs(reps, 8), reps, *cluster.META).select("q", "c", cluster._metadata().alias("passes"))


def _signatures(spark, d) -> tuple[DataFrame, int]:
    rows = sources.embedding_fingerprints(spark, d)
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    bits = lsh.signature_bits(shape["n"])
    return materialize(lsh.signatures(rows, bits, shape["d"]), "signatures"), bits


def lsh_signatures(spark, d):
    sigs, _ = _signatures(spark, d)
    return sigs.select("ord", F.posexplode("sigs").alias("tbl", "sig"))


def lsh_candidates(spark, d):
    return lsh.lsh_candidates(*_signatures(spark, d), None)


def lsh_candidates_capped(spark, d):
    return lsh.lsh_candidates(*_signatures(spark, d))


def cosine_pairs(spark, d):
    rows = sources.embedding_fingerprints(spark, d)
    pairs = cluster.related_comparisons(rows, rows.limit(0).select("ord", F.col("ord").alias("group_id")), OPTIONS)
    return pairs.where(F.col("cosine") >= F.lit(0.40).cast("float")).select("q", "c", F.round(F.col("cosine").cast("double"), 5).alias("cosine"))


def modified_groups(spark, d):
    return exact.positioned(cluster.modified_members(_reps(spark, d), OPTIONS))


def modified_groups_uncapped(spark, d):
    return exact.positioned(cluster.modified_members(_reps(spark, d), UNCAPPED))


def related_groups_uncapped(spark, d):
    return cluster.cluster_duplicates(sources.embedding_fingerprints(spark, d), UNCAPPED)


def cluster_all_uncapped(spark, d):
    return cluster.cluster_duplicates(_docs(spark, d, True), UNCAPPED)


def related_groups(spark, d):
    return cluster.cluster_duplicates(sources.embedding_fingerprints(spark, d), OPTIONS)


def cluster_all(spark, d):
    return _clustered(spark, d, UNCAPPED)[1]


def singletons(spark, d):
    rows = materialize(_docs(spark, d, True), "rows")
    options = ClusterOptions(8, 0.40, include_singletons=True)
    out = cluster.cluster_duplicates(rows, options)
    alone = out.groupBy("kind", "group_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return alone.select("kind", "id")


def evidence_pairs(spark, d):
    rows, groups = _clustered(spark, d)
    out = evidence.evidence_pairs(groups, rows)
    return out.withColumn("cosine_similarity", F.round(F.col("cosine_similarity").cast("double"), 5))


def cleanup_suggestions(spark, d):
    return report.cleanup_suggestions(_clustered(spark, d, UNCAPPED)[1])


def selected_bytes(spark, d):
    rows, groups = _clustered(spark, d, UNCAPPED)
    return report.selected_bytes(rows, report.cleanup_suggestions(groups))


def summary_counts(spark, d):
    rows, groups = _clustered(spark, d)
    return report.summary_counts(rows, groups, exposure(spark, d))


def numbered_groups(spark, d):
    return report.numbered_groups(_clustered(spark, d)[1])


def delete_regroup(spark, d):
    rows, groups = _clustered(spark, d)
    return regroup.regroup(groups, _deleted(rows))


def delete_rows(spark, d):
    rows = _docs(spark, d)
    return regroup.delete_rows(rows, _deleted(rows)).select("id")


def embedding_comparisons(spark, d):
    return cluster.comparison_count(_docs(spark, d, True), OPTIONS)


def l2_normalise(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    scaled = F.transform("embedding", lambda x: x * F.lit(3).cast("float"))
    return e.select("vec_id", F.posexplode(S.l2_normalise(scaled)).alias("pos", "v")).select("vec_id", "pos", F.round(F.col("v").cast("double"), 5).alias("value"))


def format_bytes(spark, d):
    return _docs(spark, d).select("id", S.format_bytes(F.col("file_size") * 97 - 9700).alias("text"))


def format_number(spark, d):
    return _docs(spark, d).select("id", S.format_number(F.col("file_size")).alias("text"))


def preview_size(spark, d):
    p = S.preview_size(F.col("width"), F.col("height"))
    return _docs(spark, d).select("id", p.getField("width").alias("width"), p.getField("height").alias("height"))


def hash_components(spark, d):
    return connected_components(mih.mih_forest(_reps(spark, d), 4, metadata=False), "q", "c", thin=False)


def application_groups(spark, d):
    return cluster.find_duplicate_groups(_docs(spark, d, True), 8, 0.40)


def evidence_preview(spark, d):
    rows, groups = _clustered(spark, d, UNCAPPED)
    return evidence.evidence_pairs(groups, rows, 3).select("kind", "group_id", "left_id", "right_id", "hamming_distance")


def evidence_labels(spark, d):
    rows, groups = _clustered(spark, d, UNCAPPED)
    label = S.evidence_label(F.col("kind"), F.col("hamming_distance"), F.col("cosine_similarity"))
    return evidence.evidence_pairs(groups, rows).select("kind", "group_id", "left_id", "right_id", label.alias("label"))


def selection_evidence(spark, d):
    rows = _docs(spark, d, True)
    whole = rows.select(F.lit("ALL").alias("kind"), F.lit(0).cast("long").alias("group_id"), F.col("ord").alias("member_pos"), "id")
    return evidence.evidence_pairs(whole, rows).select("left_id", "right_id", "exact_match", "hamming_distance")


def evidence_missing(spark, d):
    """Groups as they were, where every third member's row is gone."""
    rows, groups = _clustered(spark, d)
    out = evidence.evidence_pairs(groups, regroup.delete_rows(rows, _deleted(rows)))
    return out.select("kind", "group_id", "left_id", "right_id", "exact_match", "hamming_distance")


def evidence_names(spark, d):
    rows, groups = _clustered(spark, d, UNCAPPED)
    names = rows.where("ord % 2 = 0").select("id", F.concat(F.lit("name of "), "id").alias("display_name"))
    return evidence.with_names(evidence.evidence_pairs(groups, rows), names).select("kind", "group_id", "left_id", "right_id", "left_name", "right_name")


def flat_groups(spark, d):
    rows, groups = _clustered(spark, d)
    return report.flat_groups(groups, rows).select("group_id", F.array_join("flat", ",").alias("flat"))


def decoded_groups(spark, d):
    rows, groups = _clustered(spark, d, UNCAPPED)
    return report.decode_groups(report.flat_groups(groups, rows), rows)


def written_groups(spark, d):
    path = shared_path(spark, "groups")
    report.write_groups(_clustered(spark, d, UNCAPPED)[1], path)
    return report.read_groups(spark, path)


def delete_regroup_evidence(spark, d):
    rows, groups = _clustered(spark, d)
    out = regroup.regroup_with_evidence(groups, rows, _deleted(rows))[1]
    return out.select("kind", "group_id", "left_id", "right_id", "exact_match", "hamming_distance")


def known_dimensions(spark, d):
    odd = _docs(spark, d).select("id", (F.col("width") - 500).alias("width"), F.when(F.col("ord") % 3 > 0, F.col("height")).alias("height"), (F.col("file_size") - 700).alias("file_size"))
    return sources.known_dimensions(odd)


def validation_report(spark, d):
    """What validation finds in the vectors as they are and with one fault each."""
    rows = sources.embedding_fingerprints(spark, d)
    some = F.col("ord") % 100 == 7
    faulty = {
        "clean": rows,
        "empty": rows.withColumn("id", F.when(some, "").otherwise(F.col("id"))),
        "repeated": rows.withColumn("id", F.concat(F.lit("v"), F.floor(F.col("ord") / 2).cast("string"))),
        "dimension": rows.withColumn("embedding", F.when(some, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))),
        "odd": rows.withColumn("embedding", F.when(some, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))),
    }
    parts = [problems(x).select(F.lit(name).alias("fixture"), "*") for name, x in faulty.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def member_chunks(spark, d):
    return report.chunked(_clustered(spark, d, UNCAPPED)[1]).select("kind", "group_id", "id", "chunk")


def toggled_selection(spark, d):
    return report.toggle(_deleted(_docs(spark, d)), "d1")


def delete_message(spark, d):
    return regroup.delete_message(_docs(spark, d).select("id", (F.col("ord") % 3 == 0).alias("ok")))


def display_names(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name, path = F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.concat(F.lit("files/"), F.col("lang"))
    return docs.select("doc_id", S.display_name(name, path).alias("display_name"))


def selected_files(spark, d):
    rows = _docs(spark, d).select("id", "ord", F.col("content_hash").alias("uri"))
    return sources.select_first(rows, limit=100).select("id", "ord")


def columnar_source(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    four = lambda c: F.array_repeat(c, 4)
    names = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat_ws("-", F.col("vec_id"), k))
    sized = [four(F.lit(n)).alias(c) for n, c in ((9, "widths"), (8, "heights"), (72, "file_sizes"))]
    batches = e.select(F.col("vec_id").alias("batch"), names.alias("hashes"), four(F.col("vec_id")).alias("perceptual_hashes"), F.col("embedding").alias("vectors"), F.lit(16).alias("dimension"), *sized)
    rows = sources.from_columns(batches, "batch")
    return rows.select("id", "content_hash", "perceptual_hash", "width", "file_size", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"))


def progress_ratio(spark, d):
    return _docs(spark, d).select("id", F.round(S.progress_ratio(F.col("ord"), F.col("file_size")).cast("double"), 4).alias("ratio"))


def plural_labels(spark, d):
    return _docs(spark, d).select("id", S.plural(F.col("ord"), "photo").alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_groups, representatives, sha256_hash, dhash, exposure, exposure_labels, luminance, rgb_normalise, hamming_pairs, mih_blocks,
        mih_candidates_exact, mih_candidates_capped, mih_candidates_tight, metadata_filter_pairs, lsh_signatures, lsh_candidates, lsh_candidates_capped,
        lsh_candidates_tight, cosine_pairs, modified_groups, modified_groups_uncapped, related_groups, related_groups_uncapped, cluster_all, cluster_all_uncapped,
        singletons, evidence_pairs, evidence_missing, evidence_names, cleanup_suggestions, selected_bytes, summary_counts, numbered_groups, delete_regroup,
        delete_regroup_evidence, delete_rows, embedding_comparisons, l2_normalise, format_bytes, format_number, preview_size, hash_components,
        application_groups, evidence_preview, evidence_labels, selection_evidence, flat_groups, decoded_groups, written_groups, member_chunks,
        toggled_selection, delete_message, display_names, selected_files, columnar_source, known_dimensions, validation_report, progress_ratio, plural_labels,
    )
}
