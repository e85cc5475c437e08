import numpy as np
import pytest

from twinfold.operators import evidence, exact, lsh, mih, regroup, report
from twinfold.operators.validate import validate
from twinfold.plans import cluster
from twinfold.schema import ClusterOptions
from twinfold.session import materialize

SCHEMA = "id string, ord long, content_hash string, perceptual_hash long, embedding array<float>, width int, height int, file_size long"


def rows(spark, cells):
    return spark.createDataFrame([(c[0], i, c[1], c[2], c[3], *(c[4:] or (0, 0, 0))) for i, c in enumerate(cells)], SCHEMA)


def groups(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.kind, r.group_id), []).append((r.member_pos, r.id))
    return sorted((kind, [i for _, i in sorted(m)]) for (kind, _), m in found.items())


def run(spark, cells, **options):
    return groups(cluster.cluster_duplicates(rows(spark, cells), ClusterOptions(**options)))


def test_exact_and_related(spark):
    cells = [("original", "same-sha", 0, [1.0, 0.0]), ("copy", "same-sha", 0, [1.0, 0.0]), ("similar", "other-sha", 0xFFFF, [0.95, 0.05])]
    assert run(spark, cells, hamming_threshold=0, similarity_threshold=0.9) == [("EXACT", ["original", "copy"]), ("RELATED", ["original", "similar"])]


def test_modified_copy(spark):
    cells = [("original", "one", 0, [1.0, 0.0]), ("resized", "two", 3, [0.0, 1.0]), ("unrelated", "three", 0xFFFF, [0.0, 0.0])]
    assert run(spark, cells, hamming_threshold=2, similarity_threshold=0.99) == [("MODIFIED_COPY", ["original", "resized"])]


def test_chain(spark):
    cells = [("first", "one", None, [1.0, 0.0]), ("second", "two", None, [0.9, 0.4]), ("third", "three", None, [0.7, 0.7]), ("unrelated", "four", None, [0.0, 1.0])]
    assert run(spark, cells, similarity_threshold=0.8) == [("RELATED", ["first", "second", "third"])]


def test_missing_features_and_singletons(spark):
    cells = [("unknown", "", None, []), ("known", "known-hash", 42, [1.0, 0.0])]
    assert run(spark, cells) == []
    assert run(spark, cells, include_singletons=True) == [("EXACT", ["known"]), ("EXACT", ["unknown"]), ("MODIFIED_COPY", ["known"]), ("RELATED", ["known"])]


def test_modified_is_not_repeated_as_related(spark):
    cells = [("original", "one", 0, [1.0, 0.0]), ("resized", "two", 1, [1.0, 0.0])]
    assert run(spark, cells, hamming_threshold=1, similarity_threshold=0.9) == [("MODIFIED_COPY", ["original", "resized"])]
    third = [*cells, ("other", "three", None, [1.0, 0.01])]
    assert run(spark, third, hamming_threshold=1, similarity_threshold=0.9) == [("MODIFIED_COPY", ["original", "resized"]), ("RELATED", ["original", "resized", "other"])]


def test_threshold_zero_and_empty_hashes(spark):
    assert run(spark, [("a", "", 5, None), ("b", "", 5, None)], hamming_threshold=0) == []
    assert run(spark, [("a", "", 5, None), ("b", None, 5, None)], hamming_threshold=1) == [("MODIFIED_COPY", ["a", "b"])]
    assert exact.representatives(rows(spark, [("a", "", 5, None), ("b", "", 5, None), ("c", "h", 5, None), ("d", "h", 5, None)])).count() == 3


def test_dense_bucket_is_one_group(spark):
    cells = [(f"v{i}", f"h{i}", None, [1.0, 0.5, 0.25, 0.125]) for i in range(600)]
    found = run(spark, cells, similarity_threshold=0.99)
    assert len(found) == 1 and len(found[0][1]) == 600


def test_bounded_search(spark):
    cells = [(f"v{i}", f"h{i}", None, [((i * 7919 + v * 104729) % 1009) / 1009 for v in range(32)]) for i in range(2000)]
    n = cluster.comparison_count(rows(spark, cells), ClusterOptions(similarity_threshold=1.0)).first()[0]
    assert n <= 512_000 and n < 999_500 and abs(n - 478_870) < 2_000


@pytest.mark.parametrize("limit", [None, 256, 3])
def test_buckets_are_not_broadcast(spark, limit):
    cells = [(f"v{i}", f"h{i}", None, [((i * 7919 + v * 104729) % 1009) / 1009 - 0.5 for v in range(8)]) for i in range(60)]
    sigs = materialize(lsh.signatures(rows(spark, cells), 8, 8))
    pairs = lsh.lsh_candidates(sigs, 8, limit)
    assert pairs.count() == len({tuple(r) for r in pairs.collect()}) > 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("buckets", [100_000, 0])
def test_first_entries_are_not_broadcast(spark, monkeypatch, buckets):
    monkeypatch.setattr(mih, "BUCKETS", buckets)
    plans, write = [], mih.materialize
    note = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df
    monkeypatch.setattr(mih, "materialize", lambda df, name="step": write(note(df), name))
    table = write(rows(spark, [(f"h{i}", f"c{i}", i * 0x9E3779B97F4A7C15 % 2**16 * 0x10001, None) for i in range(80)]))
    assert note(mih.mih_pairs(table, 8, 16)).count() == 55
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in "".join(plans)
    plans.clear()
    assert note(mih.capped_forest(table, 8, 16)).count() > 0
    # the sizes of buckets alone, for both sides, where they are bounded by a count
    assert "SortMergeJoin" in plans[-1] and "".join(plans).count("BroadcastHashJoin") == (2 if buckets else 0)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cluster.cluster_duplicates(empty).count() == 0
    assert cluster.find_duplicate_groups(empty).count() == 0
    one = rows(spark, [("a", "h", 1, []), ("b", "h", 1, [])])
    assert cluster.find_duplicate_groups(one).count() == 0


@pytest.mark.parametrize("options", [{"hamming_threshold": 16}, {"hamming_threshold": -1}, {"similarity_threshold": -0.1}, {"similarity_threshold": float("nan")}, {"similarity_threshold": 1.1}, {"table_count": 0}, {"candidate_limit": 0}])
def test_invalid_options(options):
    with pytest.raises(ValueError):
        ClusterOptions(**options)


@pytest.mark.parametrize("cells,match", [([("", "h", 1, None)], "empty"), ([("a", "h", 1, None), ("a", "i", 1, None)], "unique"), ([("a", "h", 1, [1.0]), ("b", "i", 1, [1.0, 2.0])], "dimension"), ([("a", "h", 1, [float("nan")])], "finite")])
def test_invalid_rows(spark, cells, match):
    with pytest.raises(ValueError, match=match):
        validate(rows(spark, cells))


def found_pairs(spark, hashes, r, checks=None):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "ord long, perceptual_hash long")
    return {(x.q, x.c) for x in mih.mih_pairs(df, r, checks).collect()}


@pytest.mark.parametrize("checks", [None, 256])
def test_mih_fixtures(spark, checks):
    a = 0xAAAAAAAAAAAAAAAA - 2**64
    assert found_pairs(spark, [a, a], 8, checks) == {(1, 0)}
    assert {c for q, c in found_pairs(spark, [0, 7, -1, 0], 4, checks) if q == 3} == {0, 1}
    assert {c for q, c in found_pairs(spark, [0, 7, 0], 2, checks) if q == 2} == {0}
    assert {c for q, c in found_pairs(spark, [0, 7, 0], 3, checks) if q == 2} == {0, 1}
    assert found_pairs(spark, [], 8, checks) == set()


def test_mih_cap_equals_sequential_search(spark):
    a = 0xAAAAAAAAAAAAAAAA - 2**64
    assert len({c for q, c in found_pairs(spark, [a] * 300, 8, 64) if q == 299}) == 64
    assert found_pairs(spark, [a, a], 8, 0) == set()
    r = np.random.default_rng(3)
    hashes = [int(x) for x in r.integers(0, 2**20, 300)]
    layout = [(s, (1 << w) - 1) for s, w in __import__("twinfold.functions.scalar", fromlist=["x"]).block_layout(3)]
    want, tables = set(), [{} for _ in layout]
    for q, h in enumerate(hashes):
        checks = 0
        for t, (s, m) in zip(tables, layout):
            for c in t.get(h >> s & m, []):
                if checks < 40:
                    checks += 1
                    if (h ^ hashes[c]).bit_count() <= 3:
                        want.add((q, c))
        for t, (s, m) in zip(tables, layout):
            t.setdefault(h >> s & m, []).append(q)
    assert found_pairs(spark, hashes, 3, 40) == want


def test_lsh_parts(spark):
    assert lsh.signs(12).tolist() == [-1, 1, 1, 1, 1, 1, -1, -1, 1, -1, 1, -1]
    assert [lsh.signature_bits(n) for n in (0, 1, 256, 257, 2000, 10**6)] == [8, 8, 8, 9, 11, 16]
    with pytest.raises(ValueError):
        lsh.signatures(rows(spark, [("a", "h", 1, [1.0])]), 8, 0)
    r = np.random.default_rng(1)
    sigs = r.integers(0, 8, (120, 3))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sigs.tolist())], "ord long, sigs array<int>")
    want = set()
    for q in range(120):
        seen = []
        for t in range(3):
            for key in [sigs[q, t], *[sigs[q, t] ^ (1 << b) for b in range(3)]]:
                for c in range(q):
                    if sigs[c, t] == key and c not in seen and len(seen) < 20:
                        seen.append(c)
        want |= {(q, c) for c in seen}
    assert {(x.q, x.c) for x in lsh.lsh_candidates(df, 3, 20).collect()} == want
    whole = {(q, c) for q in range(120) for c in range(q) if any((int(sigs[q, t]) ^ int(sigs[c, t])).bit_count() <= 1 for t in range(3))}
    assert {(x.q, x.c) for x in lsh.lsh_candidates(df, 3, None).collect()} == whole


def test_evidence_cap_order_and_missing(spark):
    cells = [(f"m{i}", "h", i, [1.0, float(i)]) for i in range(8)]
    df = rows(spark, cells)
    g = cluster.cluster_duplicates(df, ClusterOptions(similarity_threshold=1.0))
    got = {(r.left_id, r.right_id) for r in evidence.evidence_pairs(g, df).collect()}
    order = [(f"m{a}", f"m{b}") for a in range(8) for b in range(a + 1, 8)]
    assert got == set(order[:20])
    left = df.where("id <> 'm0'")
    got = {(r.left_id, r.right_id) for r in evidence.evidence_pairs(g, left).collect()}
    assert got == set([p for p in order if "m0" not in p][:20])


def test_regroup_report(spark):
    cells = [("a", "h", None, None, 1, 1, 5), ("b", "h", None, None, 1, 1, 7), ("c", "i", None, None), ("d", "i", None, None), ("e", "i", None, None)]
    df = rows(spark, cells)
    g = cluster.cluster_duplicates(df)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert groups(regroup.regroup(g, ids("a", "d"))) == [("EXACT", ["c", "e"])]
    assert regroup.delete_rows(df, ids("a")).count() == 4
    tips = report.cleanup_suggestions(g)
    assert {r.id for r in tips.collect()} == {"b", "d", "e"}
    assert report.selected_bytes(df, tips).first().bytes == 7
    assert {r.id for r in report.toggle(tips, "b").collect()} == {"d", "e"} and report.toggle(tips, "a").count() == 4
    assert [tuple(r) for r in report.numbered_groups(g).orderBy("number").collect()] == [("EXACT", 0, 1), ("EXACT", 2, 2)]
    assert sorted(r.flat for r in report.flat_groups(g, df).collect()) == [[0, 2, 0, 1], [0, 3, 2, 3, 4]]
    message = lambda *ok: regroup.delete_message(spark.createDataFrame([(str(i), x) for i, x in enumerate(ok)], "id string, ok boolean")).first().message
    assert message(True, True) == "Deleted 2 photos." and message(True, False) == "Deleted 1; 1 could not be deleted." and message(False).startswith("No photos were deleted.")
    exposures = spark.createDataFrame([("NORMAL",), ("OVEREXPOSED",)], "classification string")
    assert tuple(report.summary_counts(df, g, exposures).first()) == (5, 2, 0, 1)
    assert [r.chunk for r in report.chunked(g.where("group_id = 2")).orderBy("member_pos").collect()] == [0, 0, 1]


def test_groups_are_decoded_and_checked(spark, tmp_path):
    df = rows(spark, [("a", "h", None, None), ("b", "h", None, None), ("c", "i", None, None), ("d", "i", None, None), ("e", "i", None, None)])
    g = cluster.cluster_duplicates(df)
    key = lambda x: sorted(tuple(r) for r in x.select("kind", "group_id", "member_pos", "id").collect())
    assert key(report.decode_groups(report.flat_groups(g, df), df)) == key(g)
    report.write_groups(g, f"{tmp_path}/groups")
    assert key(report.read_groups(spark, f"{tmp_path}/groups")) == key(g)
    for flat, message in (([0], "header"), (None, "header"), ([0, 1, 2], "members"), ([0, 3, 1, 2], "members"), ([0, 2, 1, 9], "position"), ([3, 2, 0, 1], "kind")):
        bad = spark.createDataFrame([(0, flat)], "group_id long, flat array<long>")
        with pytest.raises(Exception, match=message):
            report.decode_groups(bad, df).collect()


def test_regroup_with_evidence_and_names(spark):
    df = rows(spark, [("a", "h", None, None), ("b", "h", None, None), ("c", "i", None, None), ("d", "i", None, None), ("e", "i", None, None)])
    gone = spark.createDataFrame([("a",), ("d",)], "id string")
    left, pairs = regroup.regroup_with_evidence(cluster.cluster_duplicates(df), df, gone)
    assert groups(left) == [("EXACT", ["c", "e"])]
    assert [(r["left_id"], r["right_id"], r["exact_match"]) for r in pairs.collect()] == [("c", "e", True)]
    names = spark.createDataFrame([("c", "Sea")], "id string, display_name string")
    assert [(r["left_name"], r["right_name"]) for r in evidence.with_names(pairs, names).collect()] == [("Sea", "e")]


@pytest.mark.parametrize("oks, text", [([True], "Deleted 1 photo."), ([True, True], "Deleted 2 photos."), ([True, False, False], "Deleted 1; 2 could not be deleted."), ([False], "No photos were deleted. The selected storage provider may not allow deletion.")])
def test_delete_messages(spark, oks, text):
    df = spark.createDataFrame([(str(i), ok) for i, ok in enumerate(oks)], "id string, ok boolean")
    assert regroup.delete_message(df).first()["message"] == text


def test_many_groups_are_numbered_in_order(spark):
    df = spark.range(500).selectExpr("IF(id % 3 = 0, 'EXACT', 'RELATED') AS kind", "id * 7 AS group_id", "1 AS member_pos", "string(id) AS id")
    got = {(r["kind"], r["group_id"]): r["number"] for r in report.numbered_groups(df.repartition(7)).collect()}
    for kind in ("EXACT", "RELATED"):
        ids = sorted(g for k, g in got if k == kind)
        assert [got[kind, g] for g in ids] == list(range(1, len(ids) + 1))
