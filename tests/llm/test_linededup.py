import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinfold.llm import linededup as sut

SCHEMA = "doc_id long, text string, _kept string, h1 string"


def brute(rows, min_docs=5, n=40):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            docs[key(line)].add(-(10**9) if r[0] is None else r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        own = -(10**9) if r[0] is None else r[0]
        kept = [x for x in lines if not (len(key(x)) >= n and len(docs[key(x)]) >= min_docs and own != max(docs[key(x)]))]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    common = "This exact line of boilerplate is in very many documents."
    rows = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nlast\n{common}", None, "x") for i in range(12)]
    rows += [(20 + i, "É" * 40 + "\n" + "é" * 40, None, None) for i in range(6)]
    rows += [(40 + i, "x" * 39 + "\n" + "four documents only share this one line here\n" * 3, None, None) for i in range(4)]
    rows += [(60, None, None, None), (61, "", None, None), (62, "\n\n", None, None), (63, common + "\r\n" + "a\x0b", None, None)]
    return rows + [(None, common, None, None), (64, (common + "\n") * 4000, None, None), (11, "again\n" + common, None, None), (3, "again\n" + common, None, None)]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(sut, "BROADCAST_ROWS", limit)
    rows = corpus() + corpus()[:2]
    got = sut.line_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sut.line_digests(df).count() == 0
    assert sut.dedup_lines(df.withColumn("lang", F.lit("x"))).columns[:3] == ["doc_id", "text", "lang"]


def test_clashing_columns_stay(spark):
    common = "This exact line of boilerplate is in very many documents."
    df = spark.createDataFrame([(i, common, i, "x", "y", "z") for i in range(6)], "doc_id long, text string, id long, doc string, _gone string, c0 string")
    got = sut.dedup_lines(df)
    assert got.columns == [*df.columns, "_kept", "_n_lines", "_n_dropped"]
    assert sorted((r.doc_id, r.id, r.c0, r._kept, r._n_dropped) for r in got.collect()) == [(i, i, "z", common if i == 5 else "", int(i < 5)) for i in range(6)]


def batch(spark, k):
    return spark.createDataFrame([(1, 1, k), (k, 9, k), (k, 9, k + 10)], "h1 long, h2 long, doc long")


def test_runs_compact_and_tell_fresh_from_seen(spark):
    runs = sut.LineRuns(spark)
    for k, levels in ((5, "1"), (4, "01"), (3, "11"), (2, "001"), (1, "101")):
        runs.add(batch(spark, k))
        assert "".join("1" if x else "0" for x in runs.levels) == levels
    got = {(r.h1, r.h2): (r.docs, r.keeper) for r in runs.totals().collect()}
    assert got == {(1, 1): (5, 5)} | {(k, 9): (2, k + 10) for k in range(1, 6)}
    newest = runs.run(runs.levels[0])
    assert sorted(map(tuple, newest.collect())) == [(1, 1, 1, None), (1, 9, 2, 11)]
    runs.close()
    assert sut.LineRuns(spark).totals().count() == 0


def test_runs_are_sorted_and_joined_without_exchange(spark):
    runs = sut.LineRuns(spark)
    for k in (3, 2, 1):
        runs.add(spark.range(400).selectExpr("xxhash64(id) AS h1", "id AS h2", f"{k}L AS doc"))
    for name in runs.runs():
        for file in runs.run(name).inputFiles():
            held = [tuple(r) for r in spark.read.parquet(file).select("h1", "h2").collect()]
            assert held == sorted(held) and held
    with sut._sorted_scans(spark):
        own = spark.range(5).selectExpr("id AS h1", "id AS h2", "id AS doc")
        plan = runs.marked(own)._jdf.queryExecution().executedPlan().toString()
        merge = runs.merged(*runs.runs())._jdf.queryExecution().executedPlan().toString()
    # the batch is dealt once and sorted; the runs are neither
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2 and plan.count("Sort [") == 1
    assert "Exchange" not in merge and "Sort [" not in merge and "SortMergeJoin" in merge


def test_an_index_is_opened_again(spark):
    runs = sut.LineRuns(spark)
    for k in (5, 4, 3):
        runs.add(batch(spark, k))
    runs.close()
    again = sut.LineRuns.open(spark, runs.folder)
    assert again.levels == runs.levels and again.buckets == runs.buckets
    again.add(batch(spark, 2))
    assert {(r.h1, r.h2): (r.docs, r.keeper) for r in again.totals().collect()} == {(1, 1): (4, 5)} | {(k, 9): (2, k + 10) for k in range(2, 6)}
    again.close()
