import math
import random
import re

import pytest

from twinfold.llm import licenses as sut


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_places(words):
    return sorted(((label, i) for p, label in sut.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()), key=lambda x: (x[1], x[0]))


def brute_labels(words):
    """Labels and best containment over every window of every template's width."""
    labels, best = set(), 0.0
    for label, text in sut.TEMPLATES.items():
        of = set(brute_words(text))
        own = brute_words(text)
        width = len(own) if len(of) < 15 else math.ceil(1.5 * (len(own) if len(own) > 1.5 * len(of) else len(of)))
        need = len(of) if len(of) < 15 else math.ceil(0.8 * len(of) - 1e-9)
        for i in range(max(1, len(words) - width + 1)):
            k = len(of & set(words[i : i + width]))
            if k >= need:
                labels.add(label)
                best = max(best, k / len(of))
    return labels, best


def texts():
    r = random.Random(4)
    vocabulary = [w for t in sut.TEMPLATES.values() for w in t.split()] + "one two three of the été".split()
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120))) for _ in range(60)]
    out += [f"Intro words here. {t}. And the end." for t in sut.TEMPLATES.values()]
    out += ["x CC BY-NC 4.0, GNU General Public License apache license MIT License mit license.", "cc by cc by CC\nBY", "", None, "…¿", "licensed under " * 20_000 + "cc by nc 4 0"]
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "MIT License", "x"), (2, "MIT License", "x"), (2, "MIT License", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted(map(str, sut.license_digests(df.repartition(3)).collect()))
    want = []
    for d, t, _ in rows:
        words = brute_words(t)
        places, (labels, best) = brute_places(words), brute_labels(words)
        base = sorted({p[0] for p in places})
        first, last = (places[0][1], places[-1][1]) if places else (None, None)
        want.append(f"Row(doc_id={d}, n_words={len(words)}, n_base={len(places)}, first_word={first}, last_word={last}, base_labels={','.join(base)!r}, labels={','.join(sorted(labels | set(base)))!r}, score={best})")
    assert got == sorted(want)


def test_every_template_is_found_and_filters_use_corpus_order(spark):
    for label, text in sut.TEMPLATES.items():
        assert label in {b[0] for b in sut.Matcher({}).blocks(sut.words_of("start " + text + " end"))}
    order = sut.token_documents(spark.createDataFrame([("the MIT license",), ("the the",), (None,)], "text string"))
    assert order == {b"the": 2, b"mit": 1, b"license": 1}


@pytest.mark.parametrize("order", [{}, {b"mozilla": 9, b"of": -1}])
def test_order_changes_no_result(order):
    plain, other = sut.Matcher({}), sut.Matcher(order)
    for t in texts():
        assert plain.blocks(sut.words_of(t)) == other.blocks(sut.words_of(t))


def test_empty(spark):
    assert sut.license_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bodies_disclaimers_and_templates_of_the_caller(spark):
    rows = ["x without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so y", "own terms " * 9 + "hold here"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in sut.license_digests(docs).collect()} == {0: "mit-body", 1: ""}
    repeated = "own terms " * 9 + "hold here"  # 20 words of 4 tokens
    found = {r["doc_id"]: [b["label"] for b in r["blocks"]] for r in sut.scan_licenses(docs, templates={"own": repeated}).collect()}
    assert found == {0: [], 1: ["own"]}
    far = sut.words_of("own " + "x " * 15 + "terms hold here")
    assert [b[0] for b in sut.Matcher({}, {"own": repeated}).blocks(far)] == ["own"]


@pytest.mark.parametrize("text", ["Licensed under CC BY 4.0", "Licensed under CC BY-NC-SA 4.0", "Code is released under the BSD license.", "Code is released under the Apache license.", "This work is under the Mozilla terms", "the software is provided with a notice", "This work is licensed under the GNU General Public License, version 2", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"])
def test_short_notices_of_other_licenses_get_no_label(text):
    assert sut.Matcher({}).blocks(sut.words_of(text)) == []


@pytest.mark.parametrize("text, label", [("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("(Released under the MIT License)", "mit-notice"), ("licensed under the apache license version 2.0", "apache-2.0")])
def test_short_notices_are_found(text, label):
    assert {b[0] for b in sut.Matcher({}).blocks(sut.words_of("a word " + text + " more"))} == {label}


def test_many_places_take_linear_time():
    import time

    words = sut.words_of("mit license " * 200_000)
    began = time.perf_counter()
    places = sut.Matcher({}).places(words)
    assert len(places) == 200_000 and places[-1] == ("mit", 399_998) and time.perf_counter() - began < 5


def test_edited_license_texts_are_found():
    r = random.Random(8)
    for label in ("mit-license", "isc-license", "bsd-license"):
        words = sut.TEMPLATES[label].split()
        edited = [w for w in words if r.random() > 0.03]
        found = {b[0]: b for b in sut.Matcher({}).blocks(sut.words_of("one two " * 50 + " ".join(edited) + " three" * 50))}
        assert label in found and found[label][3] >= 0.8 and found[label][1] >= 90
