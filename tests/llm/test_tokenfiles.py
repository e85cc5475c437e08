import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinfold.llm import tokenfiles as sut

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(FILE)
BPE = sut.ByteBpe(open(FILE, "rb").read())


def want(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab' stdé1. \n\t  \x1c_-\U0001f600")))
def test_chunks_equal_whole_text(text):
    assert np.frombuffer(BPE.encode([text])[0], BPE.dtype).tolist() == want(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ éßñ.,!ªº²1\u0250'\n")), max_size=6))
def test_batches_equal_whole_texts(texts):
    assert [np.frombuffer(x, BPE.dtype).tolist() for x in BPE.encode(texts)] == [want(t) for t in texts]


def made(frame_tokens=10):
    out = io.BytesIO()
    w = sut.TokenFileWriter(out, np.uint16, frame_tokens)
    docs = [(None, [1]), (2, [5, 6, 7]), (2, [8]), (5, list(range(30))), (9, []), (12, [3] * 12), (40, [9])]
    for i, ids in docs:
        w.write(i, np.array(ids, "<u2").tobytes())
    w.close()
    return out.getvalue(), docs


def test_round_trip_and_seek():
    data, docs = made()
    r = sut.TokenFileReader(io.BytesIO(data))
    assert [(i, x.tolist()) for i, x in r] == docs
    assert r.frames > 2
    seen = []
    r._frame, plain = lambda k: seen.append(k) or plain(k), r._frame
    assert {k: v.tolist() for k, v in r.read([40, 39]).items()} == {40: [9]}
    assert len(seen) < r.frames
    assert r.read([9])[9].tolist() == [] and r.read([]) == {}
    assert len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()) > 0


def test_damage_is_found():
    data, _ = made()
    bad = bytearray(data)
    bad[len(data) - 9 - 1] ^= 1  # the checksum of the index
    with pytest.raises(ValueError):
        sut.TokenFileReader(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        sut.TokenFileReader(io.BytesIO(b"short"))


def digest(ids):
    """Spark's xxhash64 of the ids of a document, which orders rows of one id."""
    h = xxhash.xxh64_intdigest(np.array(ids, "<u2").tobytes(), 42)
    return h - (1 << 64 if h >> 63 else 0)


def in_order(rows):
    coded = [(d, [*want(t), 0]) for d, t, *_ in rows]
    return sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1]), np.array(r[1], "<u2").tobytes()))


def test_query_rows(spark):
    texts = ["", None, "a b", " lead", "tail ", "x  y\n\n z", "<|endoftext|>", "word " * 40_000, "same", "same", "é漢字\U0001f600"]
    rows = [(i * 3 % 17, t, "u") for i, t in enumerate(texts)] + [(None, "no id", "u"), (3, "again", "u"), (3, "again", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sut.token_file_digests(df.repartition(4), FILE).collect()
    start, expect = 0, []
    for d, ids in in_order(rows):
        expect.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expect
    assert sut.token_file_digests(df.limit(0), FILE).count() == 0


@pytest.mark.parametrize("text", ["one.\ntwo", "one\ntwo\nthree four\n", "\none\n\ntwo", "é.\nß, a1\n'll", "a\r\nb \n c\n　d", "x\ny x\ny " * 3])
def test_chunks_are_cut_at_single_line_feeds(text):
    assert np.frombuffer(BPE.encode([text, "y", text])[2], BPE.dtype).tolist() == want(text)


TOKEN = "<|endoftext|>"


@pytest.mark.parametrize("text", [f"a {TOKEN} b", TOKEN, TOKEN * 3, f"{TOKEN}\n x", f"x {TOKEN}", f" {TOKEN}{TOKEN} ", "<|endoftext|", "<|endoftext|> and <|endoftext|", f"a.\nb{TOKEN}c d"])
def test_special_tokens_are_the_librarys(text):
    assert np.frombuffer(BPE.encode([text, "y"])[0], BPE.dtype).tolist() == want(text)
    assert (50256 in want(text)) == (TOKEN in text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([TOKEN, " ", "\n", "ab", "é.", "  ", "<|"]), max_size=8).map("".join))
def test_texts_around_special_tokens(text):
    assert np.frombuffer(BPE.encode([text])[0], BPE.dtype).tolist() == want(text)


def test_a_task_that_runs_again_leaves_one_whole_file_in_the_manifest(spark, tmp_path):
    """Files of an attempt that failed stay unread: here one attempt dies after it wrote, and files of others lie there."""
    df = spark.createDataFrame([(i, f"word {i} " * (i % 5)) for i in range(200)], "doc_id long, text string")
    folder = f"file://{tmp_path}/tokens"
    first = sut.write_token_files(df, folder, FILE)
    again = sut.write_token_files(df.repartition(3), folder, FILE)  # the same folder, with final files in it
    rows = lambda m: sorted(map(tuple, sut.read_digests(m).collect()))
    assert rows(first) == rows(again) and len(rows(first)) == 200
    assert {r["file"] for r in first.collect()}.isdisjoint(r["file"] for r in again.collect())


def test_one_id_may_hold_most_rows(spark):
    rows = [(7, f"w{i} text") for i in range(300)] + [(None, f"n{i}") for i in range(100)] + [(i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = sut.by_ranges(df, sut.encode_documents(df, FILE), 8)
    sizes = [r["count"] for r in parts.groupBy(sut.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 300 and sum(sizes) == 420
    start, expect = 0, []
    for d, ids in in_order(rows):
        expect.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, sut.token_file_digests(df, FILE).collect()), key=lambda r: r[1]) == expect


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé漢1 \n\n\r\t.,!$_-'\\]^[\u00a0ǆ\U0001f600"), max_size=12), min_size=1, max_size=5))
def test_punctuation_line_feeds_and_blanks(texts):
    assert [np.frombuffer(x, BPE.dtype).tolist() for x in BPE.encode(texts)] == [want(t) for t in texts]


def test_stores_that_roll_over_change_no_result():
    small = sut.ByteBpe(open(FILE, "rb").read(), 8)
    texts = [" ".join(f"{w}{i % 7}{p}" for w, p in zip("one two é three".split(), [".", "", "!!", "$$$"])) + f"\nnew{i % 5}" for i in range(60)]
    for i in range(0, 60, 3):
        assert [np.frombuffer(x, BPE.dtype).tolist() for x in small.encode(texts[i : i + 3])] == [want(t) for t in texts[i : i + 3]]
