"""Counts of words, word runs and character runs against brute force."""

import re
import time
from collections import Counter

from pyspark.sql import functions as F

from granary.functions import text

TEXTS = [None, "", " ", "a", "ab", "B a b, A (b) a!", "x  y\nx y x", "é😀é😀é ab", "!!! ?"]


def _maps(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.map_entries(f(F.col("t"))).alias("m")).collect()
    return [None if r["m"] is None else dict(map(tuple, r["m"])) for r in sorted(rows, key=lambda r: r["i"])]


def test_counts_against_brute_force(spark):
    trim = lambda w: re.sub(r"^[^\w]+|[^\w]+$", "", w)
    grams = lambda x, n, mid: dict(Counter(mid.join(x[i : i + n]) for i in range(len(x) - n + 1)))
    for f, want in (
        (text.bag_of_words, lambda t: dict(Counter(w for w in map(trim, t.lower().split()) if w))),
        (text.word_ngrams, lambda t: grams(t.lower().split(), 2, " ")),
        (text.char_ngrams, lambda t: grams(list(t.lower()), 2, "")),
    ):
        got = _maps(spark, TEXTS, f)
        assert got == [None if t is None else want(t) for t in TEXTS]
        assert [list(m) for m in got if m] == [list(want(t)) for t, m in zip(TEXTS, got) if m]  # in order of first appearance


def test_long_texts_are_counted_in_linear_time(spark):
    long = " ".join(f"w{i % 15000}" for i in range(20000))
    began = time.perf_counter()
    for f in (text.bag_of_words, text.word_ngrams, text.char_ngrams):
        assert sum(_maps(spark, [long], f)[0].values()) > 19000
    assert time.perf_counter() - began < 30
