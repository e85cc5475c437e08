import random

import pytest

from twinfold.operators import lsh, mih
from twinfold.operators.components import connected_components


def hashes(seed, n=260):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(6)]
    out = []
    for i in range(n):
        h = r.choice(base) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 6)):
            h ^= 1 << r.randrange(64)
        out.append(h - (1 << 64 if h >> 63 else 0))
    return out


def scan(values, threshold, budget):
    """The search one row after the other: buckets by block, entries in order, each inspection counts."""
    width, found, index = 64 // (threshold + 1), set(), {}
    for q, h in enumerate(values):
        left = budget
        u = h % 2**64
        keys = [(b, (u >> b * width) & ((1 << (width if b < threshold else 64 - b * width)) - 1)) for b in range(threshold + 1)]
        for key in keys:
            for c in index.get(key, ()):
                if left is not None:
                    if not left:
                        break
                    left -= 1
                d = ((values[c] ^ h) % 2**64).bit_count()
                if d <= threshold:
                    found.add((q, c, d))
        for key in keys:
            index.setdefault(key, []).append(q)
    return found


@pytest.mark.parametrize("threshold, budget", [(8, 256), (8, 40), (8, 1), (8, 0), (8, None), (3, 17), (15, 30), (1, 5)])
def test_capped_search_equals_a_scan(spark, threshold, budget):
    values = hashes(threshold)
    df = spark.createDataFrame(list(enumerate(values)), "ord long, perceptual_hash long").repartition(3)
    assert {tuple(r) for r in mih.mih_pairs(df, threshold, budget).collect()} == scan(values, threshold, budget)


def test_capped_join_makes_no_more_rows_than_the_budget(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(900)], "ord long, perceptual_hash long")
    plan = mih.mih_pairs(df, 8, 10)
    assert plan.groupBy("q").count().where("count > 10").count() == 0
    assert plan.count() <= 9000


@pytest.mark.parametrize("limit", [1, 5, 40, None])
def test_capped_candidates_equal_a_scan(spark, limit):
    r, bits, tables = random.Random(4), 8, 3
    rows = [(i, [r.choice([3, 7, 200, r.randrange(256)]) for _ in range(tables)]) for i in range(150)]
    want = set()
    for q, sigs in rows:
        found = []
        for t in range(tables):
            for mask in (0, *(1 << k for k in range(bits))):
                found += [c for c, other in rows[:q] if other[t] == sigs[t] ^ mask]
        want |= {(q, c) for c in list(dict.fromkeys(found))[:limit]}
    df = spark.createDataFrame(rows, "ord long, sigs array<int>").repartition(3)
    assert {tuple(r) for r in lsh.lsh_candidates(df, bits, limit).collect()} == want


def test_a_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        lsh.lsh_candidates(spark.createDataFrame([], "ord long, sigs array<int>"), 8, 0)


@pytest.mark.parametrize("block, metadata", [(8192, True), (7, True), (8192, False), (7, False)])
def test_forest_connects_what_pairs_connect(spark, monkeypatch, block, metadata):
    monkeypatch.setattr(mih, "BLOCK", block)
    monkeypatch.setattr(mih, "TILE", 5)
    r = random.Random(9)
    sizes = [(None, 3, 5), (0, 3, 5), (100, 10, 50), (119, 10, 50), (121, 10, 600), (100, 10, None), (30, 9, -1)]
    rows = [(i, h, *r.choice(sizes)) for i, h in enumerate(hashes(5))] + [(900, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "ord long, perceptual_hash long, width int, height int, file_size long")
    from twinfold.plans import cluster

    pairs = cluster._sides(mih.mih_pairs(df, 8), df, *mih.META)
    want = connected_components(pairs.where(cluster._metadata()) if metadata else pairs, "q", "c")
    forest = mih.mih_forest(df, 8, metadata)
    assert sorted(map(tuple, connected_components(forest, "q", "c").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("block, metadata, budget", [(8192, True, 256), (7, True, 40), (8192, False, 3), (7, False, 1), (7, True, 0)])
def test_capped_forest_connects_what_capped_pairs_connect(spark, monkeypatch, block, metadata, budget):
    monkeypatch.setattr(mih, "BLOCK", block)
    monkeypatch.setattr(mih, "TILE", 5)
    r = random.Random(9)
    sizes = [(None, 3, 5), (0, 3, 5), (100, 10, 50), (119, 10, 50), (121, 10, 600), (100, 10, None), (30, 9, -1)]
    rows = [(i, h, *r.choice(sizes)) for i, h in enumerate(hashes(5))] + [(900, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "ord long, perceptual_hash long, width int, height int, file_size long")
    from twinfold.plans import cluster

    pairs = cluster._sides(mih.mih_pairs(df, 8, budget), df, *mih.META)
    want = connected_components(pairs.where(cluster._metadata()) if metadata else pairs, "q", "c")
    forest = mih.capped_forest(df, 8, budget, metadata)
    assert sorted(map(tuple, connected_components(forest, "q", "c").collect())) == sorted(map(tuple, want.collect()))
