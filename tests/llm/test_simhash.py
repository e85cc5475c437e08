import re

import xxhash
from pyspark.sql import functions as F

from twinfold.llm import simhash

DOCS = "doc_id long, text string, lang string, component_id string"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    ids = {}
    for (d, _), c in zip(fps, comp):
        ids[c] = min(ids.get(c, d), d)
    return sorted((d, f"{f:016x}", ids[c]) for (d, f), c in zip(fps, comp))


def corpus():
    base = "the quick brown fox jumps over the lazy dog while many small birds sing in the old tree near our house".split()
    rows = [(i, " ".join(base[i % 7 :] * 9), "en", "x") for i in range(14)]
    rows += [(20 + i, " ".join(base * 12 + [f"w{i}"]), "en", "x") for i in range(12)]
    rows += [(40, None, None, None), (41, "", "en", None), (42, " \t\n", "en", None), (43, "One", "en", None), (44, "ONE", "en", None), (45, "É é x y", "fr", None)]
    return rows + [(46, "long " * 50_000, "en", None), (12, "repeat of an id", "en", None), (47, "a b c d", "en", None), (48, "a b c", "en", None)]


def test_against_brute_force(spark):
    rows = corpus()
    got = simhash.simhash_components(spark.createDataFrame(rows + rows[:3], DOCS), group_rows=5)
    assert sorted(map(tuple, got.collect())) == brute(rows + rows[:3])


def test_fingerprint_equals_spark_xxhash(spark):
    assert simhash.fingerprint("b") == spark.range(1).select(F.xxhash64(F.lit("b"))).first()[0] % 2**64


def test_empty_and_null_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "alone here", None, None), (None, None, None, None), (3, None, None, None)]
    got = sorted(map(str, (r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, DOCS)).collect())))
    assert got == ["3", "3", "None"]


def test_deduplicate_keeps_one_of_each(spark):
    rows = corpus()
    kept = simhash.deduplicate(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "component_id"]
    firsts = {c for _, _, c in brute(rows)}
    assert {r.doc_id for r in kept.collect()} == firsts


def test_deduplicate_judges_null_and_repeated_ids_and_equal_rows(spark):
    rows = [(None, "one two three", "en", "a"), (None, "one two three", "en", "a"), (5, "one two three", "de", "a"), (5, "one two three", "en", "a"), (5, "one two three", "en", "a")]
    rows += [(None, "something else", None, "a"), (None, "something else", None, None), (7, None, None, None), (None, "", None, None), (5, "another text", "en", "x")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(kept) == 4  # one of each of four groups
    by = {r.text: r for r in kept}
    assert by["one two three"].doc_id == 5 and by["another text"].doc_id == 5 and by["something else"].doc_id is None
    assert by[None].doc_id == 7


def test_bands_compare_every_pair_within_the_radius():
    import random

    r = random.Random(5)
    for most in (3, 10, 1000):
        counts = {p: r.choice([0, 0, 1, 2, 5, 40]) for p in range(65)}
        b = simhash.Bands(counts, most, 4)
        groups = {p: range(b.first[p], b.first[p] + b.parts[p]) for p, n in counts.items() if n}
        held = {}
        for p, gs in groups.items():
            for g in gs:
                held.setdefault(g, 0)
                held[g] += counts[p] / len(gs)
        assert max(held.values()) <= most
        for p, gs in groups.items():
            for q, hs in groups.items():
                if abs(p - q) <= 4:
                    assert all(b.low[p] <= h <= b.high[p] for h in hs)
