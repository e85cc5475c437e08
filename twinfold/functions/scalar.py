"""Scalar functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes held as BIGINT."""
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_of(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine as FLOAT from vectors and their norms; 0 for vectors that are null, empty, zero or of other sizes."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm_a * norm_b != 0)
    return F.when(usable, dot(a, b) / (norm_a * norm_b)).otherwise(F.lit(0.0)).cast("float")


def cosine_similarity(a: Column, b: Column) -> Column:
    return cosine_of(a, b, norm(a), norm(b))


def block_layout(threshold: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of the ``threshold + 1`` blocks of a 64-bit hash; the last takes what is left over."""
    if not 1 <= threshold <= 15:
        raise ValueError("threshold must be in 1..15")
    width = 64 // (threshold + 1)
    starts = [b * width for b in range(threshold + 1)]
    return [(s, width) for s in starts[:-1]] + [(starts[-1], 64 - starts[-1])]


def hash_block(value: Column, threshold: int, block: int) -> Column:
    start, width = block_layout(threshold)[block]
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def passes_metadata(lw: Column, lh: Column, ls: Column, rw: Column, rh: Column, rs: Column) -> Column:
    """Whether two rows may be copies by shape and size; unknown (not positive or null) dimensions pass at once."""
    positive = lambda c: F.coalesce(c, F.lit(0)) > 0
    known = positive(lw) & positive(lh) & positive(rw) & positive(rh)
    a, b = lw.cast("double") / F.when(positive(lh), lh), rw.cast("double") / F.when(positive(rh), rh)
    ratio = F.when(a > b, a / F.when(b > 0, b)).otherwise(b / F.when(a > 0, a))
    sized = positive(ls) & positive(rs)
    return F.when(~known, True).when(ratio > F.lit(1.2), False).when(sized & (F.greatest(ls, rs) > F.least(ls, rs) * 10), False).otherwise(True)


def difference_hash(luminance: Column) -> Column:
    """BIGINT hash of a 9 x 8 grid: bit 8 * row + column is set where a value is above its right neighbour."""

    def bits(grid: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(64):
            at = i // 8 * 9 + i % 8
            one = (1 << i) - (1 << 64 if i == 63 else 0)
            out = out.bitwiseOR(F.when(F.get(grid, F.lit(at)) > F.get(grid, F.lit(at + 1)), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return let(luminance, bits)


def checked_grid(luminance: Column) -> Column:
    """The grid itself; a grid that has not 72 values fails the query."""
    return F.when(F.size(luminance) == 72, luminance).otherwise(F.raise_error(F.lit("a luminance grid has 72 values")))


def exposure(luminance: Column) -> Column:
    """``struct(classification, mean_luminance, dark_pixel_ratio, bright_pixel_ratio)`` of a grid that is not empty."""
    def of(g: Column) -> Column:
        n = F.when(F.size(g) > 0, F.size(g)).otherwise(F.raise_error(F.lit("no luminance values")).cast("int")).cast("double")
        mean = F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + x) / n
        dark = F.size(F.filter(g, lambda x: x <= 15)) / n
        bright = F.size(F.filter(g, lambda x: x >= 240)) / n
        kind = F.when((mean < 50) | (dark > 0.6), "UNDEREXPOSED").when((mean > 205) | (bright > 0.6), "OVEREXPOSED").otherwise("NORMAL")
        return F.struct(kind.alias("classification"), mean.alias("mean_luminance"), dark.alias("dark_pixel_ratio"), bright.alias("bright_pixel_ratio"))

    return let(luminance, of)


def channels(pixel: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a packed pixel."""
    part = lambda n: F.shiftright(pixel, n).bitwiseAND(F.lit(255))
    return part(16), part(8), pixel.bitwiseAND(F.lit(255))


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return (F.lit(0.299) * red + F.lit(0.587) * green + F.lit(0.114) * blue).cast("int")


def normalised_rgb(pixels: Column) -> Column:
    """Red, green, blue of each packed pixel in turn, from 0 to 1."""
    return F.flatten(F.transform(pixels, lambda p: F.array(*[(c / F.lit(255.0)).cast("float") for c in channels(p)])))


def l2_normalise(v: Column) -> Column:
    """The vector at length 1 as FLOATs; a zero vector stays, one with values that are not finite fails the query."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = norm(v).cast("float")
    scaled = F.transform(v, lambda x: (x.cast("float") / size).cast("float"))
    return F.when(~finite, F.raise_error(F.lit("values must be finite")).cast("array<float>")).when(size == 0, v.cast("array<float>")).otherwise(scaled)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def display_name(name: Column, path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(name, F.when(last != "", last), F.lit("Unnamed image"))


def format_number(x: Column) -> Column:
    return F.format_string("%.0f", x.cast("double"))


def format_percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", (ratio.cast("float") * F.lit(100).cast("float")).cast("double"))


def format_bytes(n: Column) -> Column:
    """A size in words; a value just between two tenths takes the even one, as C's printf does and Java's formatter does not."""
    unit = lambda size, name: F.format_string(f"%.1f {name}", F.bround(n.cast("double") / F.lit(float(size)), 1))
    return (
        F.when(n.isNull() | (n <= 0), "Size unavailable")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, unit(1 << 10, "KB"))
        .when(n < 1 << 30, unit(1 << 20, "MB"))
        .otherwise(unit(1 << 30, "GB"))
    )


def exposure_label(classification: Column) -> Column:
    return F.when(classification == "UNDEREXPOSED", "Possibly underexposed").when(classification == "OVEREXPOSED", "Possibly overexposed").otherwise("Normal exposure")


def evidence_label(kind: Column, distance: Column, similarity: Column, threshold: int = 8, least: float = 0.85) -> Column:
    """What a pair of a group shows: the feature that its kind is judged by first, with the threshold it passes at."""
    bits = F.concat(F.lit("dHash "), distance.cast("string"), F.lit("/64"))
    model = F.concat(F.lit("MobileNet "), format_percent(similarity))
    modified = F.concat(bits, F.lit(f" (passes at ≤ {threshold}) • "), model)
    related = F.concat(model, F.lit(" (passes at ≥ "), format_percent(F.lit(least)), F.lit(") • "), bits)
    return F.when(kind == "EXACT", "Matching SHA-256 file hashes").when(kind == "MODIFIED_COPY", modified).otherwise(related)


def progress_ratio(done: Column, total: Column) -> Column:
    return F.when(total > 0, done.cast("double") / total).otherwise(F.lit(0.0)).cast("float")


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def preview_size(width: Column, height: Column, longest: int = 512) -> Column:
    """``struct(width, height)`` scaled so that the longer side fits; never enlarged, never below 1."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height, F.lit(1)))
    side = lambda c: F.greatest(F.lit(1), F.floor(c * scale + F.lit(0.5)).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))
