import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold import sources
from twinfold.plans import cluster
from twinfold.schema import ClusterOptions


def ppm(pixels):
    h, w, _ = pixels.shape
    return f"P6\n# made here\n{w} {h}\n255\n".encode() + pixels.astype(np.uint8).tobytes()


def picture(seed, h=90, w=120):
    r = np.random.default_rng(seed)
    return np.kron(r.integers(0, 255, (9, 12, 3)), np.ones((h // 9, w // 12, 1)))


def brute_bilinear(pixels, width, height):
    h, w, _ = pixels.shape
    out = np.zeros((height, width, 3))
    for y in range(height):
        for x in range(width):
            sy, sx = min(max((y + 0.5) * h / height - 0.5, 0), h - 1), min(max((x + 0.5) * w / width - 0.5, 0), w - 1)
            y0, x0 = int(sy), int(sx)
            y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - y0, sx - x0
            out[y, x] = pixels[y0, x0] * (1 - fy) * (1 - fx) + pixels[y0, x1] * (1 - fy) * fx + pixels[y1, x0] * fy * (1 - fx) + pixels[y1, x1] * fy * fx
    return out


@pytest.mark.parametrize("width, height", [(9, 8), (200, 3), (120, 90)])
def test_bilinear(width, height):
    assert np.allclose(sources.rescaled(picture(1), width, height), brute_bilinear(picture(1), width, height))


def test_luminance_is_cut_to_integers():
    grey = sources.luminance_grid(np.full((5, 5, 3), 128), 9, 8)
    assert grey.tolist() == [int(0.299 * 128 + 0.587 * 128 + 0.114 * 128)] * 72


def load_model():
    return lambda thumbnail: thumbnail.mean((0, 1)) - 0.5


def test_files_become_groups(spark, tmp_path):
    a, b = picture(1), picture(2)
    files = {"a.ppm": ppm(a), "a-copy.ppm": ppm(a), "a-small.ppm": ppm(a[::2, ::2]), "b.ppm": ppm(b), "dark.ppm": ppm(b * 0), "bad.ppm": b"no image"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    features = sources.image_features(spark, str(tmp_path), sources.decode_ppm, load_model, "*.ppm")
    found = {r["display_name"]: r for r in features.collect()}
    assert [found[n]["ord"] for n in sorted(files)] == list(range(6))
    assert [tuple(r) for r in sources.issues(features).collect()] == [("bad.ppm", "no portable pixmap")]
    assert found["bad.ppm"]["perceptual_hash"] is None and found["bad.ppm"]["width"] == 0 and found["bad.ppm"]["file_size"] == 8
    assert (found["a.ppm"]["width"], found["a.ppm"]["height"], found["a-small.ppm"]["width"]) == (120, 90, 60)
    assert found["dark.ppm"]["exposure"]["classification"] == "UNDEREXPOSED"
    assert np.isclose(np.linalg.norm(found["b.ppm"]["embedding"]), 1)
    groups = cluster.cluster_duplicates(sources.readable(features), ClusterOptions(8, 0.999))
    name = F.element_at(F.split("id", "/"), -1)
    got = {(r["kind"], r["n"]) for r in groups.where("kind <> 'RELATED'").select("kind", name.alias("n")).collect()}
    assert got == {("EXACT", "a.ppm"), ("EXACT", "a-copy.ppm"), ("MODIFIED_COPY", "a-copy.ppm"), ("MODIFIED_COPY", "a-small.ppm")}


def test_no_model_and_no_files(spark, tmp_path):
    (tmp_path / "x.ppm").write_bytes(ppm(picture(3)))
    assert sources.image_features(spark, str(tmp_path), sources.decode_ppm, None, "*.ppm").first()["embedding"] is None
    bad = sources.image_features(spark, str(tmp_path), sources.decode_ppm, lambda: lambda t: np.array([np.nan]), "*.ppm").first()
    assert "finite" in bad["issue"] and bad["embedding"] is None
