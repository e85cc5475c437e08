import math

import numpy as np
import pytest

from twinfold.llm import maxscore as sut

SCHEMA = "vec_id long, embedding array<double>, rank string"


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    raw = {}
    for i, v, _ in rows:
        if i is not None and i % every == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v):
            raw[i] = min(raw.get(i, v), v)
    out = []
    for q, v in raw.items():
        qv = [math.floor(1024 * x) for x in v]
        scores = sorted((-sum(a * b for a, b in zip(qv, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def corpus(n=900, dim=12, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    x = (r.standard_normal((n, dim)) * scale).round(2)
    x[r.random((n, dim)) < 0.3] = 0
    rows = [(i, v, "x") for i, v in enumerate(x.tolist())]
    rows += [(1000 + i, rows[200][1], "x") for i in range(25)]  # ties
    return rows + [(1100, None, "x"), (1200, [None] + [1.0] * (dim - 1), "x"), (1300, [float("nan")] * dim, "x"), (None, [1.0] * dim, "x"), (1400, [0.0] * dim, "x"), (1500, [], "x"), (1600, [9.0, -9.0], "x"), (200, rows[7][1], "x"), (31, rows[31][1], "x")]


@pytest.mark.parametrize("scale", [1.0, 0.01, 1e5])
def test_against_brute_force(spark, scale):
    rows = corpus(scale=scale)
    got = sut.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_search_is_exact_and_prunes(seed):
    r = np.random.default_rng(seed)
    values = np.floor(r.standard_normal((800, 16)) * [200] * 16)
    values[r.random(values.shape) < (0.8 if seed % 2 else 0.0)] = 0
    shard = sut.Shard(np.arange(800), values)
    for q in range(0, 800, 40):
        want = sorted((-int(s), i) for i, s in enumerate(values @ values[q]) if i != q)[:10]
        assert shard.search(q, values[q]) == [(i, -s) for s, i in want]


def test_few_rows_and_empty(spark):
    assert sut.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1.0], "x"), (1, [-1.0], "x"), (2, [2.0], "x")]
    assert sorted(map(tuple, sut.top_k(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_huge_components_do_not_crash(spark):
    rows = [(0, [1e30, 1.0], "x"), (1, [1e30, 2.0], "x"), (2, [-1e30, 2.0], "x")]
    got = sut.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]
