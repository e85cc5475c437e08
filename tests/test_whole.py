import hashlib
import random

import pytest
from pyspark.sql import functions as F

from twinfold import sources
from twinfold.functions import scalar as S
from twinfold.plans.queries import QUERIES


def brute_grid(text):
    cells = [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 72 for w in set(text.split(" "))]
    return [cells.count(k) for k in range(72)]


def body(seed, n=300):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(n))


def distance(spark, a, b):
    h = [S.difference_hash(S.checked_grid(sources.word_grid(F.col(c)))) for c in "ab"]
    return spark.createDataFrame([(a, b)], "a string, b string").select(S.hamming_distance(*h).alias("d")).first()["d"]


@pytest.mark.parametrize("text", ["", "a", "  ", "été \U0001f600 a a a\nb", body(1), "\\ \\\\ $ . *"])
def test_word_grid(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(sources.word_grid(F.col("t")).alias("x")).first()["x"] == brute_grid(text)


def test_the_whole_text_counts(spark):
    opening = "The same opening of two texts that are longer than seventy-two characters. "
    assert distance(spark, opening + body(1), opening + body(2)) > 8
    assert distance(spark, "Draft of May " + body(3), "Final (June) " + body(3)) <= 8
    assert distance(spark, body(4) + " the end", body(4) + " an end") <= 8


def test_exposure_and_triples_take_every_character(spark, tmp_path):
    texts = ["\x01" * 72 + "\xf5" * 600, "abcdefg", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: {r["id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("exposure")["d0"]["classification"] == "OVEREXPOSED"
    assert got("exposure")["d0"]["mean_luminance"] == round((72 + 0xF5 * 600) / 672, 6)
    codes = [ord(c) for c in "abcdefg"] + [0, 0]
    digest = lambda values: hashlib.md5(",".join(map(str, values)).encode()).hexdigest()
    grey = [int(0.299 * r + 0.587 * g + 0.114 * b) for r, g, b in zip(*[iter(codes)] * 3)]
    assert tuple(got("luminance")["d1"])[1:] == (3, digest(grey))
    assert tuple(got("rgb_normalise")["d1"])[1:] == (9, digest([round(c / 255 * 1e6) for c in codes]))
    assert got("luminance")["d0"]["n"] == 224 and got("luminance")["d2"]["n"] == 1
