"""Column builders against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import segments as S
from textloom.functions import text as X
from textloom.functions import vectors as V

WORDS = ["İstanbul", "IŞIK", "ışık", "kitap", "a", "x" * 30, "x" * 31, "ab3c", "é́a", "gel-di", "", "_", "naïve", "😀ok"]


def tr_lower(s):
    return s.replace("İ", "i").replace("I", "ı").lower()


def rows(spark, values, name="w"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_case_and_cleaners(spark):
    df = rows(spark, WORDS).select("w", X.tr_lower(F.col("w")).alias("low"), *[X.clean_word(F.col("w"), k).alias(k) for k in X.CLEANERS])
    word = re.compile(r"[^\w]")
    for r in df.collect():
        assert r["low"] == tr_lower(r["w"])
        kept = "".join(c for c in r["w"] if c.isalpha() or c.isnumeric() or c == "_")
        assert r["tokens"] == (kept if 1 <= len(kept) <= 30 else None)
        letters = re.sub("[0-9]", "", kept)
        assert r["letters"] == (letters if 2 <= len(letters) <= 30 and letters.isalpha() else None)
        assert r["harvest"] == (tr_lower(kept) if 1 <= len(kept) <= 40 else None)
    assert word


def test_split_words_unicode_space(spark):
    got = rows(spark, ["a b  c\n", "", " ", None]).select(X.split_words(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == [["a", "b", "c"], [], [], []]


def test_harden_and_lemma(spark):
    got = rows(spark, ["kitab", "ağac", "ROK", "", "gelmek", "mek"]).select(X.harden(F.col("w")).alias("h"), X.lemma_root(F.col("w"), F.lit(True)).alias("l")).collect()
    assert [r["h"] for r in got] == ["kitap", "ağaç", "rok", "", "gelmek", "mek"]
    assert [r["l"] for r in got][-2:] == ["gel", "mek"]


def test_char_ids(spark):
    table = X.char_table()
    assert len(table) == 76 and table["a"] == 4
    got = rows(spark, ["Ab", "q", "x" * 40]).select(X.char_ids(F.col("w")).alias("c")).collect()
    assert got[0]["c"]["ids"][:5] == [2, table["a"], table["b"], 3, 0] and got[0]["c"]["flags"][:3] == [0, 1, 0] and got[0]["c"]["len"] == 4
    assert got[1]["c"]["ids"][1] == 1
    assert got[2]["c"]["len"] == 32 and got[2]["c"]["ids"][-1] == 3


@pytest.mark.parametrize("segs,want", [(["a", "bc", "d"], [1, 3]), (["abc"], []), (["", "ab"], [0]), ([], [])])
def test_boundaries(spark, segs, want):
    df = spark.createDataFrame([(segs,)], "s array<string>").select(S.boundaries(F.col("s")).alias("b"), S.boundaries(F.col("s"), drop_empty=True).alias("d")).first()
    assert df["b"] == want
    assert df["d"] == [b for b in want if b > 0]


def test_segment_round_trip_and_labels(spark):
    df = spark.createDataFrame([("abcdefg", ["ab", "cde", "fg"])], "word string, segs array<string>")
    got = df.select(S.from_boundaries(F.col("word"), S.boundaries(F.col("segs"))).alias("back"), S.labels(S.boundaries(F.col("segs")), 8).alias("labels"), S.confidence(F.col("segs"), F.col("word")).alias("c")).first()
    assert got["back"] == ["ab", "cde", "fg"] and got["labels"] == [0, 0, 1, 0, 0, 1, 0, 0] and abs(got["c"] - 7 / 3 / 4) < 1e-12


def test_root_correction(spark):
    df = spark.createDataFrame([("abcdefg", ["ab", "cde", "fg"], 5), ("abcdefg", ["ab", "cde", "fg"], 4), ("abcdefg", ["ab", "cde", "fg"], None)], "word string, segs array<string>, r int")
    got = df.select(S.correct_root(S.labels(S.boundaries(F.col("segs")), 8), F.col("r"), F.col("word"), 8).alias("x")).collect()
    assert [r["x"] for r in got] == [[0, 0, 0, 0, 0, 1, 0, 0], [0, 0, 1, 0, 0, 1, 0, 0], [0, 0, 1, 0, 0, 1, 0, 0]]


def test_root_flags(spark):
    df = spark.createDataFrame([(["kita", "b", "ı"], "kitap"), (["kitabı"], "kitap"), ([], "kitap")], "s array<string>, r string")
    got = df.select(S.root_is_prefix(F.col("s"), F.col("r")).alias("p"), S.first_is_root(F.col("s"), F.col("r")).alias("f")).collect()
    assert [(r["p"], r["f"]) for r in got] == [(True, False), (False, False), (False, False)]


def test_soft_membership_and_vectors(spark):
    df = spark.createDataFrame([([0.5, 1.0, 0.5],)], "p array<double>")
    assert df.select(V.soft_membership(F.col("p"), 3).alias("f")).first()["f"] == [0.0, 0.25, 0.75]
    a = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    got = a.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.pair_features(F.col("a"), F.col("b")).alias("f")).first()
    assert abs(got["c"] - 24 / 25) < 1e-8 and got["f"] == [3, 4, 4, 3, 1, 1, 12, 12]


def test_clean_words_is_clean_word_of_each(spark):
    texts = [" ".join(WORDS), "don't stop, 3rd İl Işık x_y ٣ab", "", None, "ΑΣ. ΑΣ ΣΑ"]
    for kind in X.CLEANERS:
        for lower in (True, False):
            each = F.filter(F.transform(X.split_words(F.col("w")), lambda w: X.clean_word(w, kind)), lambda w: w.isNotNull())
            want = F.transform(each, X.tr_lower) if lower else each
            for r in rows(spark, texts).select(X.clean_words(F.col("w"), kind, lower).alias("got"), want.alias("want")).collect():
                assert r["got"] == r["want"]
