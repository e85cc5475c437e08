import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.llm import sentencepieces as sut

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = open(MODEL, "rb").read()
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n\na", "\t x", "a▁b", "ﬁ Ａ", "日本\U0001f600\x00z", " " * 40 + "x" + " " * 17, "</s> <0x0A> <unk>", "aaaaaaaaaaaaaaaaaaa" * 30, "éèç déjà", "==========" * 9, "\r\n", "...." * 21]


def same(texts):
    own = sut.codec(BYTES)
    for t, ids in zip(texts, own.encode(texts)):
        want = [*LIB.encode(t), LIB.eos_id()]
        assert ids.tolist() == want, repr(t)
        assert own.decode(ids) == LIB.decode(want), repr(t)


def test_odd_texts():
    same(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab cd▁ \n.,eEéthe=-_0123中\U0001f600")), max_size=4))
def test_equals_library(texts):
    same(texts)


def test_real_like_texts():
    r = random.Random(3)
    parts = "the of and tion ing er on en for that with 2024 , . \n - ( ) http :// License Lizenz straße".split(" ")
    same(["".join(r.choice(parts) + r.choice(["", "", " "]) for _ in range(400)) for _ in range(30)])


def test_very_long_word_and_memo_limit():
    same(["x" * 30_000, "ab" * 20_000 + " " * 3000])
    small = sut.PieceCodec(BYTES, memo_words=5)
    assert small.encode(["a b c d e f g", "h i j a b"])[0].tolist() == [*LIB.encode("a b c d e f g"), 2]


@pytest.mark.parametrize("ids", [[13, 13], [231, 156, 2, 300], [259, 1, 2], [], [200, 300, 0, 5]])
def test_decode_any_ids(ids):
    if 0 not in ids:
        assert sut.codec(BYTES).decode(np.array(ids, np.int32)) == LIB.decode(ids)


def test_query_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, None, None), (3, "again", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sut.round_trip_digests(df, MODEL).collect())
    want = []
    for d, t, _ in rows:
        ids = [*LIB.encode(t or ""), 2]
        want.append((-1 if d is None else d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert sut.round_trip_digests(df.limit(0), MODEL).count() == 0
    assert {r.doc_id: r.ids for r in sut.encode_documents(df, MODEL).collect()}[4] == [*LIB.encode(ODD[4]), 2]
