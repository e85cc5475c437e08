"""Queries over the groups of documents find what lies behind more than 256 bucket entries or candidates."""

import random

import numpy as np
import pytest

from tests.test_whole import body, brute_grid
from twinfold.operators import lsh
from twinfold.plans.queries import QUERIES

CROWD, DIMENSION, BITS = 300, 8, 9


def bits(text):
    grid = brute_grid(text)
    return sum(1 << i for i in range(64) if grid[i // 8 * 9 + i % 8] > grid[i // 8 * 9 + i % 8 + 1])


def copies(text, n):
    """Texts of the same words, and so of the same hash, in another order."""
    words = text.split(" ")
    return [" ".join(random.Random(i).sample(words, len(words))) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A crowd of 300 documents of one hash and one vector; d300 and d301 are copies of each other that meet the crowd in their first
    block and are none of its copies; d302 and d303 have one vector that shares the crowd's first bucket and is not like it."""
    crowd = body(0, 120)
    seen = bits(crowd)
    text = next(t for t in (body(i, 120) for i in range(1, 5000)) if (bits(t) ^ seen) % 128 == 0 and (bits(t) ^ seen).bit_count() > 8)
    apart = []
    for i in range(9000, 9500):
        if all((bits(body(i, 120)) ^ b).bit_count() > 8 for b in (seen, bits(text), *map(bits, apart))) and len(apart) < 2:
            apart.append(body(i, 120))
    r, planes = np.random.default_rng(1), lsh.signs(BITS * DIMENSION).reshape(BITS, DIMENSION)
    common = r.normal(size=DIMENSION)
    cosine = lambda v: v @ common / np.linalg.norm(v) / np.linalg.norm(common)
    other = next(v for v in r.normal(size=(20000, DIMENSION)) if ((planes @ v >= 0) == (planes @ common >= 0)).all() and cosine(v) < 0.35)
    texts = [*copies(crowd, CROWD), *copies(text, 2), *apart]
    vectors = [common] * CROWD + [None] * 2 + [other] * 2
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors) if v is not None]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


WANT = sorted(
    [("MODIFIED_COPY", 0, i + 1, f"d{i}") for i in range(CROWD)]
    + [(kind, first, i + 1, f"d{first + i}") for kind, first in (("MODIFIED_COPY", 300), ("RELATED", 302)) for i in range(2)]
)


def rows(spark, tables, name):
    return sorted(map(tuple, QUERIES[name](spark, tables).collect()))


def test_cluster_all(spark, tables):
    assert rows(spark, tables, "cluster_all") == WANT


def test_cleanup_suggestions(spark, tables):
    assert rows(spark, tables, "cleanup_suggestions") == sorted((f"d{i}",) for i in (*range(1, CROWD), 301))


def test_decoded_groups(spark, tables):
    assert rows(spark, tables, "decoded_groups") == WANT


def found(spark, tables, name):
    """The rows of the groups that a cap would lose."""
    return [r for r in rows(spark, tables, name) if r[1] >= CROWD]


def apart(spark, tables):
    """How many bits d302 and d303 differ by."""
    a, b = (bits(r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").where("doc_id >= 302").collect())
    return (a ^ b).bit_count()


def test_evidence_labels(spark, tables):
    modified, related = "dHash 0/64 (passes at ≤ 8) • MobileNet 0.0%", f"MobileNet 100.0% (passes at ≥ 85.0%) • dHash {apart(spark, tables)}/64"
    assert found(spark, tables, "evidence_labels") == [("MODIFIED_COPY", 300, "d300", "d301", modified), ("RELATED", 302, "d302", "d303", related)]


def test_evidence_names(spark, tables):
    want = [("MODIFIED_COPY", 300, "d300", "d301", "name of d300", "d301"), ("RELATED", 302, "d302", "d303", "name of d302", "d303")]
    assert found(spark, tables, "evidence_names") == want


def test_evidence_preview(spark, tables):
    want = [("MODIFIED_COPY", 300, "d300", "d301", 0), ("RELATED", 302, "d302", "d303", apart(spark, tables))]
    assert found(spark, tables, "evidence_preview") == want


def test_member_chunks(spark, tables):
    assert rows(spark, tables, "member_chunks") == sorted((kind, group, id_, (pos - 1) // 2) for kind, group, pos, id_ in WANT)


def test_selected_bytes(spark, tables):
    sizes = {r["doc_id"]: len(r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert rows(spark, tables, "selected_bytes") == [(sum(sizes[i] for i in (*range(1, CROWD), 301)),)]


def test_written_groups(spark, tables):
    assert rows(spark, tables, "written_groups") == WANT
