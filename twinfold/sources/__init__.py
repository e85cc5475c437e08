"""Where rows come from: image files, columns of arrays, and the supplied tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions import scalar as S
from twinfold.session import materialize


def image_files(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,webp,gif,bmp}") -> DataFrame:
    """``(id, uri, display_name, content_hash, file_size)`` of the files below ``path``; contents never leave the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("id"), F.col("path").alias("uri"), S.display_name(F.lit(None).cast("string"), F.col("path")).alias("display_name"), S.sha256_hex(F.col("content")).alias("content_hash"), F.coalesce("length", F.lit(0)).alias("file_size"))


def rescaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """``[height, width, channels]``: pixels ``[h, w, channels]`` rescaled bilinearly, aspect not kept."""
    h, w = pixels.shape[:2]

    def axis(n: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, old - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = axis(height, h), axis(width, w)
    p = pixels.astype(np.float64)
    rows = p[y0] * (1 - fy)[:, None, None] + p[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def luminance_grid(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Luminance (0 to 255, cut to integers) of pixels rescaled to a grid, row by row."""
    small = np.rint(rescaled(pixels, width, height))
    return np.trunc(small @ np.array([0.299, 0.587, 0.114])).astype(np.int32).ravel()


THUMBNAIL, HASH_GRID, EXPOSURE_GRID = (224, 224), (9, 8), (64, 64)


def image_features(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray], load_model: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, pattern: str = "*.{jpg,jpeg,png,webp,gif,bmp}") -> DataFrame:
    """Fingerprint rows of image files, with ``display_name``, ``exposure`` and ``issue``.

    ``decode`` turns a file's bytes into pixels ``[height, width, 3]`` of 0 to 255, upright; no image library is assumed.
    ``load_model`` is called once a task and gives a function from a thumbnail ``[224, 224, 3]`` of floats from 0 to 1 to a
    vector, which is normalised; without it vectors are null.  A file that cannot be read or a vector that is not finite
    gives a row whose ``issue`` says why; such rows have no features (``readable`` and ``issues`` part them).  Paths
    give the order.  Files are read a few at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("path").alias("id"), S.display_name(F.lit(None).cast("string"), F.col("path")).alias("display_name"), S.sha256_hex(F.col("content")).alias("content_hash"), F.coalesce("length", F.lit(0)).cast("long").alias("file_size"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model() if load_model else None
        for batch in batches:
            for k in range(len(batch)):
                cells: dict = {"width": 0, "height": 0, "grid": None, "light": None, "embedding": None, "issue": None}
                try:
                    pixels = np.asarray(decode(batch.column("content")[k].as_py()))
                    if pixels.ndim != 3 or pixels.shape[2] != 3 or 0 in pixels.shape:
                        raise ValueError("not an image")
                    thumbnail = np.rint(rescaled(pixels, *THUMBNAIL))
                    found = {"height": pixels.shape[0], "width": pixels.shape[1], "grid": luminance_grid(thumbnail, *HASH_GRID).tolist(), "light": luminance_grid(thumbnail, *EXPOSURE_GRID).tolist()}
                    if model:
                        vector = np.asarray(model((thumbnail / 255).astype(np.float32)), np.float32)
                        if not np.isfinite(vector).all():
                            raise ValueError("the model gave values that are not finite")
                        found["embedding"] = vector.tolist()
                    cells |= found
                except Exception as e:  # noqa: BLE001  whatever a decoder raises becomes the row's issue
                    cells["issue"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:-1]), *(pa.array([cells[f.name]], f.type) for f in extra)], [*batch.schema.names[:-1], *extra.names])

    extra = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("grid", pa.list_(pa.int32())), ("light", pa.list_(pa.int32())), ("embedding", pa.list_(pa.float32())), ("issue", pa.string())])
    out = rows.mapInArrow(run, "id string, display_name string, content_hash string, file_size long, width int, height int, grid array<int>, light array<int>, embedding array<float>, issue string")
    has = F.col("issue").isNull()
    vector = F.when(F.size("embedding") > 0, S.l2_normalise(F.col("embedding")))
    out = out.withColumns({"perceptual_hash": F.when(has, S.difference_hash(F.col("grid"))), "exposure": F.when(has, S.exposure(F.col("light"))), "embedding": vector})
    # positions in the order of paths: ranges of paths are counted, and each adds what stands before it
    out = materialize(out.drop("grid", "light").repartitionByRange("id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id()), "images")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = out.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    return known_dimensions(out.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn("ord", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before"))


def readable(features: DataFrame) -> DataFrame:
    return features.where("issue IS NULL").drop("issue")


def issues(features: DataFrame) -> DataFrame:
    """``(image_name, message)`` of the files that gave no features."""
    return features.where("issue IS NOT NULL").select(F.col("display_name").alias("image_name"), F.col("issue").alias("message"))


def decode_ppm(content: bytes) -> np.ndarray:
    """Pixels of a binary portable pixmap (P6, 8 bits), as an example of a decoder."""
    head = re.match(rb"P6\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+255\s", content)
    if not head:
        raise ValueError("no portable pixmap")
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(content, np.uint8, width * height * 3, head.end()).reshape(height, width, 3)


def select_first(rows: DataFrame, key: str = "uri", order: str = "ord", limit: int | None = None) -> DataFrame:
    """The first row of each key in order; with ``limit`` only the first so many of those."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return first if limit is None else first.orderBy(order).limit(limit)


def known_dimensions(rows: DataFrame) -> DataFrame:
    """Width, height and file size with 0 for what is null or negative."""
    clean = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias(c)
    sized = {"width", "height", "file_size"}
    return rows.select(*[clean(c) if c in sized else F.col(c) for c in rows.columns])


def from_columns(batches: DataFrame, key: str | None = None) -> DataFrame:
    """Fingerprint rows from one row of parallel arrays; of several such rows ``key`` names the column that tells them
    apart, which then leads ids and stays as ``batch``: each is a table of its own.

    ``batches(hashes, perceptual_hashes, vectors, dimension, widths, heights, file_sizes)``: vectors lie one after the
    other in one flat array.  The position becomes id and ord.  Arrays of other lengths, a dimension that is not positive
    and null hashes fail the query.
    """
    n = F.size("hashes")
    fits = (F.col("dimension") > 0) & (n > 0) & (F.size("perceptual_hashes") == n) & (F.size("vectors") == n * F.col("dimension")) & (F.size("widths") == n) & (F.size("heights") == n) & (F.size("file_sizes") == n) & ~F.exists("hashes", lambda h: h.isNull())
    ok = F.when(F.coalesce(fits, F.lit(False)), F.col("hashes")).otherwise(F.raise_error(F.lit("arrays do not match")).cast("array<string>"))
    rows = batches.select("*", F.posexplode(ok).alias("pos", "content_hash"))
    at = lambda c: F.element_at(c, F.col("pos") + 1)
    vector = F.slice("vectors", F.col("pos") * F.col("dimension") + 1, F.col("dimension"))
    named = [F.concat_ws("-", F.col(key).cast("string"), "pos").alias("id"), F.col(key).alias("batch")] if key else [F.col("pos").cast("string").alias("id")]
    return rows.select(*named, F.col("pos").cast("long").alias("ord"), "content_hash", at("perceptual_hashes").alias("perceptual_hash"), vector.alias("embedding"), at("widths").cast("int").alias("width"), at("heights").cast("int").alias("height"), at("file_sizes").cast("long").alias("file_size"))


def text_codes(text) -> F.Column:
    """The low byte of every character of a text; one 0 for an empty text."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).bitwiseAND(255))


def word_grid(text) -> F.Column:
    """72 values of a text: how many of its distinct words (cut at single spaces) fall in each of 72 cells by their MD5.

    The whole text counts wherever its words stand, so copies with a few changed words keep nearly all order between cells.
    """
    cell = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 72
    # a letter a word, so that a cell is counted by taking its letter out
    letters = F.array_join(F.transform(F.array_distinct(F.split(text, " ", -1)), lambda w: F.char(cell(w) + 48)), "")
    count = lambda s, k: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(chr(48 + k)), F.lit("")))
    return S.let(letters, lambda s: F.array(*[count(s, k) for k in range(72)]))


def document_grids(spark: SparkSession, sf_dir: str, values: Callable = word_grid) -> DataFrame:
    """``(id, ord, luminance)`` of the documents, with what ``values`` makes of a text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("doc_id").alias("ord"), values(F.col("text")).alias("luminance"))


def document_fingerprints(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Documents as fingerprint rows, hashed by ``word_grid``; with ``vectors`` those of ``embeddings`` with the same number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    rows = docs.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        F.col("doc_id").alias("ord"),
        S.sha256_hex(text).alias("content_hash"),
        S.difference_hash(word_grid(text)).alias("perceptual_hash"),
        F.char_length(text).alias("width"),
        F.size(F.split(text, "\n", -1)).alias("height"),
        F.octet_length(text).cast("long").alias("file_size"),
    )
    if vectors:
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ord"), "embedding")
        rows = rows.join(e.hint("merge"), "ord", "left")
    return rows


def embedding_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as fingerprint rows without hashes and dimensions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    none = lambda t: F.lit(None).cast(t)
    return e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.col("vec_id").alias("ord"), none("string").alias("content_hash"), none("long").alias("perceptual_hash"), "embedding", none("int").alias("width"), none("int").alias("height"), none("long").alias("file_size"))
