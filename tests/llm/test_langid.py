import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from twinfold.llm import langid as sut

MODEL = public_tokenizers.path("piece_bpe_32k.model")
OWN = sut.pieces(open(MODEL, "rb").read())
INDEX = {p: i for i, p in enumerate(OWN.pieces)}


def segmentations(word):
    """Every way to cut a word into pieces, as lists of piece numbers."""
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        bounds = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(bounds)]
        if all(p in INDEX or len(p) == 1 for p in parts):
            yield [INDEX.get(p, OWN.unknown) for p in parts]


def brute(word, p):
    return sum(math.prod(p[i] for i in s) for s in segmentations(word))


def brute_learn(counts, rounds=sut.ROUNDS):
    p = np.zeros(OWN.none + 1)
    p[: OWN.unknown], p[OWN.unknown] = 1 / OWN.unknown, sut.UNKNOWN
    for _ in range(rounds):
        c = np.zeros(OWN.unknown + 1)
        for w, n in counts.items():
            ways = [(s, math.prod(p[i] for i in s)) for s in segmentations("▁" + w)]
            z = sum(x for _, x in ways)
            for s, x in ways:
                for i in s:
                    c[i] += n * x / z
        c = c[:-1] + sut.PRIOR
        p[: OWN.unknown] = c / c.sum()
    return p


def test_all_pieces_of_the_vocabulary_are_used():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    assert set(OWN.pieces) == plain and OWN.longest == max(map(len, plain)) > 8
    at, size, piece = OWN.edges("▁international", np.arange(14, 0, -1))
    found = {("▁international"[a : a + n], OWN.pieces[i]) for a, n, i in zip(at, size, piece) if i < OWN.unknown}
    assert all(a == b for a, b in found) and {b for _, b in found} == {"▁international"[a:b] for a in range(14) for b in range(a + 1, 15)} & set(OWN.pieces)


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(1)
    prob = np.concatenate([r.random((OWN.unknown, 2)) / 1000, [[sut.UNKNOWN] * 2, [0.0] * 2]])
    words = ["▁the", "▁station", "▁x\U0001f600y", "▁", "▁ünder", "▁responsibility"]
    got = OWN.log_probabilities(words, prob)
    for w, row in zip(words, got):
        for k in (0, 1):
            assert row[k] == pytest.approx(math.log(brute(w, prob[:, k])), rel=1e-9)


def test_long_words_equal_short_ones(monkeypatch):
    """A word of any length is one lattice: the rescaled pass gives what the plain one gives, also over many parts."""
    r = np.random.default_rng(2)
    prob = np.concatenate([r.random((OWN.unknown, 2)) / 1000, [[sut.UNKNOWN] * 2, [0.0] * 2]])
    words = ["▁internationalisation", "▁the" * 7, "▁x\U0001f600yyyyyyyyyyyyyyyyyyyyyyyy"]
    plain = OWN.log_probabilities(words, prob)
    monkeypatch.setattr(sut, "SHORT", 3)
    assert OWN.log_probabilities(words, prob) == pytest.approx(plain, rel=1e-9)
    monkeypatch.undo()
    long = "▁" + "donaudampfschiff" * 700
    one = OWN.log_probabilities([long], prob)[0]
    alpha = np.full((len(long) + 1, 2), -np.inf)
    alpha[0] = 0
    for i in range(1, len(long) + 1):
        for n in range(1, min(OWN.longest, i) + 1):
            k = INDEX.get(long[i - n : i], OWN.unknown if n == 1 else None)
            if k is not None:
                alpha[i] = np.logaddexp(alpha[i], alpha[i - n] + np.log(prob[k]))
    assert one == pytest.approx(alpha[-1], rel=1e-9)


@pytest.mark.parametrize("short", [32, 2])
def test_learning_equals_enumeration(monkeypatch, short):
    monkeypatch.setattr(sut, "SHORT", short)
    counts = {"the": 5, "of": 2, "station": 3, "üx": 1, "aé漢": 2}
    assert sut.learn(counts, OWN) == pytest.approx(brute_learn(counts), rel=1e-9)


def test_expected_counts_cover_every_character():
    words = ["▁the", "▁cat", "▁und"]
    p = np.zeros(OWN.none + 1)
    p[: OWN.unknown], p[OWN.unknown] = 1 / OWN.unknown, sut.UNKNOWN
    c = OWN.expected(words, np.array([2.0, 1.0, 1.0]))(p)
    lengths = np.array([len(x) for x in OWN.pieces] + [1, 0])
    assert (c * lengths).sum() == pytest.approx(16)


SMALL = [
    (0, "the cat of the", "en"), (2, "the　cat, CAT", "en"), (3, "der hund", "de"), (4, "und\x1cder", "de"), (6, "le chat", "fr"),
    (7, "the und", "xa"), (8, "the und", "xb"), (9, "the und", None), (10, "12 ..", "en"), (11, "", "de"), (12, None, "fr"), (13, "Der Hund", None),
]


def test_query_against_brute_force(spark):
    """All segmentations by enumeration, for learning and for prediction; xa and xb learn the same and tie."""
    rows = [*SMALL, SMALL[0], (None, "le chat", None)]
    learned = {}
    for d, t, lang in rows:
        if zlib.crc32((str(d) if d is not None else "").encode()) % 3 != 1 and t is not None and lang is not None:
            learned.setdefault(lang, {})[t] = Counter(t.lower().split())  # copies count once
    models = {lang: brute_learn(sum(texts.values(), Counter())) for lang, texts in sorted(learned.items()) if sum(texts.values(), Counter())}
    want = []
    for d, t, _ in rows:
        words = [w for w in (t or "").lower().split() if any(c.isalpha() for c in w)]
        total = {lang: sum(math.log(brute("▁" + w, p)) for w in words) for lang, p in models.items()}
        best = min(total, key=lambda k: (-round(total[k], 9), k))
        score = 1 / sum(math.exp(x - total[best]) for x in total.values()) if words else 0.0
        want.append((d, zlib.crc32((str(d) if d is not None else "").encode()) % 3 == 1, best if words else "und", pytest.approx(score, abs=1e-9)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, sut.language_digests(df.repartition(3), MODEL).collect()), key=key) == sorted(want, key=key)


SOUNDS = {"en": "the of and tion ing that with was her this from".split(), "de": "der die und ung nicht schaft ein ich zu auf".split(), "fr": "le la les que ment est une pas dans eau".split()}


def text(lang, n, r):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus():
    r = random.Random(2)
    return [(i, text(lang := r.choice(list(SOUNDS)), r.randint(5, 60), r), lang, "s") for i in range(300)]


def test_held_out_accuracy_and_cases(spark):
    rows = corpus()
    odd = [(1000, None, "en", None), (1001, "", None, None), (1002, "123 ... 4", "de", None), (1003, "é" * 5000, None, None), (None, "the and of", None, None), (7, rows[7][1], rows[7][2], None), (1004, "the of " * 60_000, None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, _lang string")
    got = sut.language_digests(df.repartition(3), MODEL).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1004].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    held = [r for r in rows if by[r[0]].held_out]
    assert sum(by[d].lang_pred == lang for d, _, lang, _ in held) / len(held) > 0.97
    kept = sut.keep_identified(df, MODEL)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())


def test_sample_is_bounded(spark):
    df = spark.range(4000).selectExpr("concat('w', id) AS text", "if(id % 10 = 0, 'few', 'many') AS lang")
    by = {r["lang"]: r["n"] for r in sut.sample_words(df, docs=100, words=150).groupBy("lang").agg({"n": "sum"}).toDF("lang", "n").collect()}
    assert 50 <= by["few"] <= 150 and 50 <= by["many"] <= 150
    assert sut.sample_words(df, docs=100, words=20).groupBy("lang").count().where("count > 20").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert sut.language_digests(df, MODEL).count() == 0
    none = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert sut.language_digests(none, MODEL).first().lang_pred == "und"
