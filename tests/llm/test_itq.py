import numpy as np
import pytest

from twinfold.llm import itq as sut

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def brute(rows, threshold=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)
    n = len(rows)
    comp, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is None or a[2] != b[2] or not ok(a[1]) or not ok(b[1]) or len(a[1]) != len(b[1]) or a[0] is None or b[0] is None:
                continue
            x, y = (np.array(v, np.float32).astype(float) for v in (a[1], b[1]))
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = comp[i], comp[j]
                comp = [min(p, q) if c in (p, q) else c for c in comp]
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], k, least.get(c), r[0] is not None and least.get(c) == r[0]) for r, k, c in zip(rows, links, comp)), key=str)


def corpus(n=160, dim=64, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = r.standard_normal(dim)
        for k in range(r.integers(1, 5)):
            v = base + (r.standard_normal(dim) * 0.12 if k else 0)
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(i % 3), 5))
    rows += [(len(rows) + k, rows[4][1], rows[4][2], 5) for k in range(30)]
    b = len(rows)
    return rows + [(b, None, 1, 0), (b + 1, [], 1, 0), (b + 2, [0.0] * dim, 1, 0), (b + 3, [None] + [1.0] * (dim - 1), 1, 0), (b + 4, [float("nan")] * dim, 1, 0), (b + 5, [float("inf")] * dim, 1, 0), (b + 6, rows[0][1], None, 0), (b + 7, [1.0, 2.0], 1, 0), (b + 8, [2.0, 4.0], 1, 0), (None, rows[0][1], 0, 0), (b + 9, [float(np.float32(x * 1e-30)) for x in rows[0][1]], rows[0][2], 0)]


@pytest.mark.parametrize("block", [2048, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sut, "BLOCK", block)
    rows = corpus()
    got = sorted((tuple(r) for r in sut.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) <= links and sum(g[1] for g in got) >= 0.9 * links  # an approximate index: recall
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1] <= w[1]
    assert sum(g == w for g, w in zip(got, want)) >= 0.9 * len(want)


def test_repeated_rows_and_empty(spark):
    rows = [(3, [1.0, 0.0], 1, 0), (3, [1.0, 0.0], 1, 0), (9, [0.0, 1.0], 1, 0)]
    got = sorted(map(tuple, sut.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(3, 1, 3, True), (3, 1, 3, True), (9, 0, 9, True)]
    assert sut.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = sut.near_duplicates(spark.createDataFrame([(1, None, None, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_plan_reaches_recall():
    for largest in (2, 1000, 10**6, 10**9):
        width, count = sut.table_plan(largest, 64)
        met = (1 - np.arccos(0.93) / np.pi) ** width
        assert 1 - (1 - met) ** count >= 0.98


@pytest.mark.parametrize("mean", [0.0, 0.8, 0.9])
def test_recall_where_vectors_share_a_direction(mean):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    around = lambda n: unit(r.standard_normal((n, 63)))
    height = np.sqrt(1 - mean**2)
    x = around(20_000)
    u, other = x[:1000], around(1000)
    turn = np.arccos(1 - (1 - 0.93) / height**2)  # between the parts across the shared direction, for a cosine of 0.93
    v = np.cos(turn) * u + np.sin(turn) * unit(other - (other * u).sum(1, keepdims=True) * u)
    cone = lambda y: np.hstack([height * y, np.full((len(y), 1), mean)])
    a, b = cone(u), cone(v)
    assert np.allclose((a * b).sum(1), 0.93)
    tables = sut.Tables(cone(x)[:8192], 64, 60_000)
    assert (tables.keys(a) == tables.keys(b)).any(1).mean() >= 0.97
