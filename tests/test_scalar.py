import math

import pytest
from pyspark.sql import functions as F

from twinfold import sources
from twinfold.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def big(n):
    return F.lit(n).cast("long")


def vec(*xs):
    return F.array(*[F.lit(float(x)).cast("float") for x in xs]) if xs else F.array().cast("array<float>")


@pytest.mark.parametrize("a,b,want", [(0, 0, 0), (0, 15, 4), (0, -1, 64), (0, 11, 3)])
def test_hamming(spark, a, b, want):
    assert one(spark, S.hamming_distance(big(a), big(b))) == want


@pytest.mark.parametrize("a,b,want", [((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((), (1, 0), 0), ((0, 0), (1, 0), 0), ((0.6, 0.8), (0.6, 0.8), 1), ((1, 0), (1, 0, 0), 0)])
def test_cosine(spark, a, b, want):
    assert one(spark, S.cosine_similarity(vec(*a), vec(*b))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("r,widths", [(1, [32, 32]), (2, [21, 21, 22]), (8, [7] * 8 + [8]), (15, [4] * 16)])
def test_block_layout(spark, r, widths):
    assert [w for _, w in S.block_layout(r)] == widths
    blocks = one(spark, F.array(*[S.hash_block(big(-2), r, b) for b in range(r + 1)]))
    assert sum(v << s for v, (s, _) in zip(blocks, S.block_layout(r))) == 2**64 - 2


@pytest.mark.parametrize("r", [0, 16])
def test_block_layout_bounds(r):
    with pytest.raises(ValueError):
        S.block_layout(r)


@pytest.mark.parametrize("left,right,want", [((0, 10, 1), (10, 10, 1000), True), ((120, 100, 1), (100, 100, 1), True), ((121, 100, 1), (100, 100, 1), False), ((10, 10, 10), (10, 10, 1), True), ((10, 10, 11), (10, 10, 1), False), ((10, 10, 0), (10, 10, 5), True), ((None, 10, 1), (10, 10, 99), True)])
def test_metadata_filter(spark, left, right, want):
    cells = [F.lit(v).cast("long") for v in (*left, *right)]
    assert one(spark, S.passes_metadata(*cells)) is want


@pytest.mark.parametrize("grid,want", [([i % 9 for i in range(72)], 0), ([9 - i % 9 for i in range(72)], -1), ([5] * 72, 0)])
def test_difference_hash(spark, grid, want):
    assert one(spark, S.difference_hash(S.checked_grid(F.array(*map(F.lit, grid))))) == want


def test_difference_hash_bit_order(spark):
    grid = [0] * 72
    grid[0], grid[9 * 7 + 7] = 3, 4
    assert one(spark, S.difference_hash(F.array(*map(F.lit, grid)))) == 1 + (1 << 63) - 2**64
    with pytest.raises(Exception, match="72 values"):
        one(spark, S.difference_hash(S.checked_grid(F.array(F.lit(1)))))


def grid_of(*runs):
    return F.flatten(F.array(*[F.array_repeat(F.lit(v), n) for v, n in runs]))


@pytest.mark.parametrize("runs,want", [([(10, 4096)], "UNDEREXPOSED"), ([(250, 4096)], "OVEREXPOSED"), ([(128, 4096)], "NORMAL"), ([(50, 10)], "NORMAL"), ([(205, 10)], "NORMAL"), ([(206, 10)], "OVEREXPOSED"), ([(49, 10)], "UNDEREXPOSED"), ([(15, 6), (200, 4)], "NORMAL"), ([(15, 7), (255, 3)], "UNDEREXPOSED"), ([(16, 7), (255, 3)], "NORMAL"), ([(240, 6), (0, 4)], "NORMAL"), ([(240, 7), (0, 3)], "OVEREXPOSED"), ([(239, 7), (0, 3)], "NORMAL")])
def test_exposure(spark, runs, want):
    assert one(spark, S.exposure(grid_of(*runs)).getField("classification")) == want


def test_exposure_numbers(spark):
    e = one(spark, S.exposure(grid_of((10, 4096))))
    assert (e.mean_luminance, e.dark_pixel_ratio, e.bright_pixel_ratio) == (10.0, 1.0, 0.0)
    with pytest.raises(Exception, match="no luminance"):
        one(spark, S.exposure(F.array().cast("array<int>")))


@pytest.mark.parametrize("n,want", [(0, "Size unavailable"), (None, "Size unavailable"), (1023, "1023 B"), (1024, "1.0 KB"), (1 << 20, "1.0 MB"), (1 << 30, "1.0 GB")])
def test_format_bytes(spark, n, want):
    assert one(spark, S.format_bytes(F.lit(n).cast("long"))) == want


@pytest.mark.parametrize("n,want", [(24_832, "24.2 KB"), (24_833, "24.3 KB"), (25_344, "24.8 KB"), (223_488, "218.2 KB"), (1_310_720, "1.2 MB"), (1_835_008, "1.8 MB"), (5 << 28, "1.2 GB"), ((1 << 20) - 1, "1024.0 KB")])
def test_format_bytes_ties(spark, n, want):
    assert one(spark, S.format_bytes(F.lit(n).cast("long"))) == want


def test_texts(spark):
    assert one(spark, S.format_percent(F.lit(0.8525))) in ("85.2%", "85.3%")
    assert one(spark, S.format_number(F.lit(12.6))) == "13"
    assert one(spark, S.plural(F.lit(1), "photo")) == "1 photo" and one(spark, S.plural(F.lit(3), "photo")) == "3 photos"
    assert one(spark, S.progress_ratio(F.lit(1), F.lit(0))) == 0 and one(spark, S.progress_ratio(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, S.evidence_label(F.lit("MODIFIED_COPY"), F.lit(3), F.lit(0.5))) == "dHash 3/64 (passes at ≤ 8) • MobileNet 50.0%"
    assert one(spark, S.evidence_label(F.lit("RELATED"), F.lit(3), F.lit(0.5))) == "MobileNet 50.0% (passes at ≥ 85.0%) • dHash 3/64"
    assert one(spark, S.evidence_label(F.lit("EXACT"), F.lit(0), F.lit(1.0))) == "Matching SHA-256 file hashes"
    assert [one(spark, S.exposure_label(F.lit(c))) for c in ("UNDEREXPOSED", "OVEREXPOSED", "NORMAL")] == ["Possibly underexposed", "Possibly overexposed", "Normal exposure"]
    assert one(spark, S.display_name(F.lit(None).cast("string"), F.lit("a/b/c.jpg"))) == "c.jpg"
    assert one(spark, S.display_name(F.lit(None).cast("string"), F.lit("a/"))) == "Unnamed image"


@pytest.mark.parametrize("w,h,want", [(1024, 512, (512, 256)), (100, 50, (100, 50)), (5000, 1, (512, 1)), (0, 0, (1, 1))])
def test_preview_size(spark, w, h, want):
    assert tuple(one(spark, S.preview_size(F.lit(w), F.lit(h)))) == want


def test_normalise(spark):
    got = one(spark, S.l2_normalise(vec(3, 4)))
    assert got == pytest.approx([0.6, 0.8]) and one(spark, S.l2_normalise(vec(0, 0))) == [0.0, 0.0]
    with pytest.raises(Exception, match="finite"):
        one(spark, S.l2_normalise(vec(math.inf, 1)))
    assert one(spark, S.normalised_rgb(F.array(F.lit(0xFF0080)))) == pytest.approx([1.0, 0.0, 128 / 255])
    assert one(spark, S.luminance(F.lit(255), F.lit(255), F.lit(254))) == 254


def test_columnar_source(spark):
    cols = "hashes array<string>, perceptual_hashes array<long>, vectors array<float>, dimension int, widths array<int>, heights array<int>, file_sizes array<long>"
    df = spark.createDataFrame([(["a", "b"], [1, -1], [1.0, 0.0, 0.5, 0.5], 2, [1, 2], [3, 4], [5, 6])], cols)
    assert [tuple(r) for r in sources.from_columns(df).orderBy("ord").collect()] == [("0", 0, "a", 1, [1.0, 0.0], 1, 3, 5), ("1", 1, "b", -1, [0.5, 0.5], 2, 4, 6)]
    bad = spark.createDataFrame([(["a", None], [1, -1], [1.0] * 4, 2, [1, 2], [3, 4], [5, 6])], cols)
    with pytest.raises(Exception, match="do not match"):
        sources.from_columns(bad).collect()


def test_file_source_and_selection(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"no")
    (row,) = sources.image_files(spark, str(tmp_path)).collect()
    assert (row.display_name, row.file_size) == ("a.jpg", 3) and len(row.content_hash) == 64
    df = spark.createDataFrame([("x", 2), ("y", 1), ("x", 0)], "uri string, ord long")
    assert [tuple(r) for r in sources.select_first(df).orderBy("ord").collect()] == [("x", 0), ("y", 1)]
    assert sources.select_first(df, limit=1).collect()[0].uri == "x"
    sized = spark.createDataFrame([(-1, None, 5)], "width int, height int, file_size long")
    assert tuple(sources.known_dimensions(sized).first()) == (0, 0, 5)
