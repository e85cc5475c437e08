import hashlib
import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline as sut
from tests.llm import test_mixing, test_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BOILER = "This very same line of boilerplate text is found in many documents here."


def corpus():
    en = "the quick brown fox jumps over the lazy dog while small birds sing in the old tree".split()
    de = "der schnelle braune fuchs springt über den faulen hund während kleine vögel im alten baum singen".split()
    rows = []
    for i in range(120):
        words, lang = (en, "en") if i % 3 else (de, "de")
        body = " ".join(f"{words[(i * 7 + k * (i % 5 + 1)) % len(words)]}{'x' * ((i + k) % 3)}" for k in range(30 + i))
        text = body + ("\n" + BOILER if i % 4 == 0 else "")
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(200 + k, rows[6][1], "en", "s0", 5) for k in range(4)]
    return rows + [(300, None, None, None, None), (301, "12 34 !!", "en", "s1", 8), (302, "", "de", "s2", 0), (303, BOILER, "en", None, len(BOILER))]


def brute_lines(rows):
    docs = {}
    for r in rows:
        for line in set((r[1] or "").split("\n")):
            docs.setdefault(line.strip(" \t\x0b\x0c\r").lower(), set()).add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(" \t\x0b\x0c\r").lower()) >= 40 and len(docs[k]) >= 5 and r[0] != max(docs[k]))]
        text = r[1] if len(kept) == len(lines) else "\n".join(kept)
        out.append((r[0], text, r[2], r[3], r[4] if text == r[1] else len(text)))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    stage = dict(sut.STAGES)
    assert len(sut.STAGES) == 5
    seen = {}
    for k, (name, f) in enumerate(sut.STAGES):
        docs = f(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = [tuple(r) for r in docs.collect()]
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r[0] for r in seen["language_id"]} == {r[0] for r in rows} - {300, 301, 302}
    assert Counter(seen["language_id"]) == Counter(r for r in rows if r[0] not in (300, 301, 302))
    assert Counter(seen["line_dedup"]) == Counter(brute_lines(seen["language_id"]))
    firsts = {c for _, _, c in test_simhash.brute([(r[0], r[1]) for r in seen["line_dedup"]])}
    assert Counter(seen["simhash_dedup"]) == Counter(r for r in seen["line_dedup"] if r[0] in firsts)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, got = Counter(), Counter()
    for r in seen["simhash_dedup"]:
        sizes[r[3]] += size(r[1])
    for r in seen["mixing"]:
        got[r[3]] += size(r[1])
    for s, t in test_mixing.brute_targets(sizes).items():
        assert abs(got[s] - t) <= max(40, 0.02 * t)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sut.PIECES))
    want = Counter()
    for r in seen["mixing"]:
        ids = [*lib.encode(r[1]), 2]
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    assert Counter(seen["sentencepiece"]) == want
    assert stage["mixing"] is sut.mix_sources


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sut.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sut.run(spark, f"{tmp_path}/none").count() == 0
