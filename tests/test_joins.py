"""Joins of as many rows as the input has: no side is broadcast for the small file that it comes from."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_cluster import rows
from twinfold import sources
from twinfold.operators import components, evidence, ranks, regroup, report
from twinfold.plans import cluster
from twinfold.schema import ClusterOptions
from twinfold.session import materialize


def static_plans(monkeypatch, *modules):
    """The plans of all that these modules write from now on, as chosen before it runs."""
    found, write = [], materialize
    for m in modules:
        monkeypatch.setattr(m, "materialize", lambda df, name="step": found.append(plan_of(df)) or write(df, name))
    return found


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def deletable(spark):
    table = materialize(rows(spark, [(f"r{i}", f"c{i // 3}", i // 3, [1.0, i / 9]) for i in range(30)]))
    return table, materialize(cluster.cluster_duplicates(table))


def test_contractions_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "SINGLE_TASK_EDGES", 4)
    found = static_plans(monkeypatch, components)
    edges = materialize(spark.range(300).selectExpr("id AS src", "id + 1 AS dst").where("dst % 100 <> 0"))
    out = components.connected_components(edges)
    assert out.groupBy("component").count().orderBy("component").collect() == [(0, 100), (100, 100), (200, 100)]
    ids = spark.range(301).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"))
    members = cluster._members(edges.toDF("q", "c"), materialize(ids), "RELATED")
    assert members.count() == 300
    assert len(found) > 4 and not any("BroadcastHashJoin" in p for p in [*found, plan_of(out), plan_of(members)])


def test_vectors_are_not_broadcast(spark, monkeypatch):
    plan = plan_of(sources.document_fingerprints(spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    table, _ = deletable(spark)
    modified = materialize(table.select("ord", F.col("ord").alias("group_id")))
    pairs = cluster.related_comparisons(table, modified, ClusterOptions(similarity_threshold=0.4))
    assert pairs.count() > 0
    plan = plan_of(pairs)
    vectors = [line for line in plan.split("\n") if "Join" in line and "LeftOuter" not in line][:2]
    assert all("SortMergeJoin" in line for line in vectors) and not re.search("BroadcastHashJoin.*LeftOuter", plan)


def test_grouped_rows_are_not_broadcast(spark):
    table, groups = deletable(spark)
    plan = plan_of(cluster.singletons(table, groups.join(table.select("id", "ord"), "id").select("ord", "id")))
    assert re.search("SortMergeJoin.*LeftAnti", plan) and not re.search("BroadcastHashJoin.*LeftAnti", plan)


def test_evidence_is_not_broadcast(spark):
    table, groups = deletable(spark)
    some = table.where("ord % 2 = 0").select("id", F.col("id").alias("display_name"))
    for rest in (table, regroup.delete_rows(table, some)):
        pairs = evidence.with_names(evidence.evidence_pairs(groups, rest), some)
        plan = plan_of(pairs)
        assert pairs.count() > 0
        assert re.search(r"SortMergeJoin \[id#", plan) and not re.search(r"BroadcastHashJoin \[\w*id#", plan)


def test_flat_groups_are_not_broadcast(spark):
    table, groups = deletable(spark)
    out = report.decode_groups(report.flat_groups(groups, table), table)
    assert sorted(out.collect()) == sorted(groups.select(*out.columns).collect())
    assert "SortMergeJoin" in plan_of(out) and "Broadcast" not in plan_of(out)


@pytest.mark.parametrize("few", [100_000, 0])
def test_deleted_rows_are_not_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(regroup, "GROUP_ROWS", few, raising=False)
    table, groups = deletable(spark)
    deleted = table.where("ord % 3 = 0")
    found = static_plans(monkeypatch, ranks, *([regroup] if hasattr(regroup, "materialize") else []))
    out = regroup.regroup(groups, deleted)
    left = {tuple(r) for r in groups.join(deleted, "id", "left_anti").select("kind", "group_id", "id").collect()}
    sizes = Counter(r[:2] for r in left)
    assert {tuple(r) for r in out.select("kind", "group_id", "id").collect()} == {r for r in left if sizes[r[:2]] > 1}
    # groups alone, where they are bounded by a count
    assert len(found) > 1 and "".join(found).count("BroadcastHashJoin") == (1 if few else 0)
