import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from twinfold.llm import mixing as sut

SCHEMA = "doc_id long, source string, text string, size string, target string"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s] - 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
        left -= sum(target[s] for s in over)
    return target


def corpus(n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "a", "a", "b", "ç", "d", None]), " ".join(["w\u00a0x"] * r.choice([0, 1, 3, 20, 60, 200])), "s", "t") for i in range(n)]
    rows += [(n, "a", None, None, None), (n + 1, "a", "\t \n", None, None), (n + 2, "zero", "", None, None), (n + 3, "b", "long " * 40_000, None, None)]
    return [*rows, rows[3], rows[3], (None, "b", "no id here", None, None)]


def test_targets_and_bounds(spark):
    rows = corpus()
    got = sut.mix_sizes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[2])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += size(r[2])
    want = brute_targets(sizes)
    of = {r[0]: r[1] for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[of[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(40, 0.02 * t), (s, taken[s], t)
    again = sut.mix_sizes(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def brute_seats(weights, seats):
    won = Counter()
    for _ in range(seats):
        best = max((w / (2 * won[c] + 1), -c) for c, w in weights.items() if w > 0)
        won[-best[1]] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_equals_highest_quotients(spark, seed):
    r = random.Random(seed)
    cases = []
    for p in range(12):
        weights = {c: r.choice([0, 1, 2, 2, 7, 50, 1000, 10**6]) for c in range(r.randint(1, 30))}
        cases.append((p, weights, r.choice([0, 1, 5, 100, 701]) if any(weights.values()) else 0))
    df = spark.createDataFrame([(p, c, float(w), s) for p, ws, s in cases for c, w in ws.items()], "p long, c long, w double, s long")
    got = {(x.p, x.c): x.quota for x in sut.apportion(df, ["p"], "c", "w", "s").collect()}
    assert got == {(p, c): brute_seats(ws, s)[c] for p, ws, s in cases for c in ws}


def test_mixed_documents(spark):
    rows = [r for r in corpus(150) if r[1] != "zero"]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    taken = Counter()
    for r in sut.mix_sizes(df).collect():
        taken[r.doc_id] += r.taken
    out = sut.mix_documents(df).collect()
    assert out[0].__fields__ == df.columns
    words = Counter()
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[2])
    for r in out:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
        assert r.text in texts[r.doc_id] or set(r.text.split()) <= {w for t in texts[r.doc_id] for w in (t or "").split()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_mixed_documents_with_equal_rows_and_clashing_names(spark):
    """Copies that are equal row by row, long texts, null sources and ids, and columns named like the operator's own."""
    rows = [(None, None, "same words in this text", "a"), *[(4, "s", "same words in this text", "a")] * 9, (4, "s", "same words in this text", "b"), (5, "s", None, "a"), (6, "t", "", "a"), (7, "t", "long " * 30_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _k1 string").withColumn("quota", F.lit(1))
    size = lambda t: len((t or "").split())
    got, again = (sorted(map(str, sut.mix_documents(df.repartition(n)).collect())) for n in (2, 5))
    assert got == again
    out = sut.mix_documents(df)
    assert out.columns == df.columns
    total = Counter()
    for r in out.collect():
        assert r.quota == 1 and r._k1 in "ab"
        total[r.source] += size(r.text)
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += size(r[2])
    for s, t in brute_targets(sizes).items():
        assert abs(total[s] - t) <= 40


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sut.mix_sizes(df).count() == 0 and sut.mix_documents(df).count() == 0
    none = spark.createDataFrame([(1, "a", None, None, None), (2, None, "", None, None)], SCHEMA)
    assert {(r.doc_id, r.target, r.taken) for r in sut.mix_sizes(none).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
