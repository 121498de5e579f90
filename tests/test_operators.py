"""Operators on hand-made tables with known answers."""

import itertools
import math
import random

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import corpus, learners, metrics, ranking, reports, retrieval, vocab


def test_clean_lines_reasons(spark):
    good = "bu kitap çok güzel ve herkes okumalı diye"
    lines = ["kısa", good, good + " http://x.y", "a" * 40 + " bu ve de çok güzel bir", "qqq www xxx qqq www xxx qqq www xxx qwx", "okul yolu uzun taş köprü dere tepe düz", "1234 5678 9012 bir ve 3456 7890 1234 56"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, line string")
    got = {r["line_no"]: r["reason"] for r in corpus.clean_lines(df).collect()}
    assert got == {0: "length", 1: None, 2: "markup", 3: "long_token", 4: "alphabet", 5: "no_stopword", 6: "other_chars"}


def test_exact_split_and_dedup(spark):
    df = spark.createDataFrame([(0, i, f"line {i % 7}") for i in range(103)], "doc_id int, line_no int, line string")
    split = corpus.split_lines(df)
    assert split.filter("split = 'train'").count() == int(103 * 0.9)
    assert sorted(r["line_no"] for r in corpus.dedup_lines(df, ["doc_id", "line_no"]).collect()) == list(range(7))
    ranked = ranking.hashed_rank(df, F.col("line_no").cast("string"), ["line_no"])
    assert sorted(r["position"] for r in ranked.collect()) == list(range(1, 104))


def test_batches_drop_last(spark):
    df = spark.range(25)
    assert ranking.batches(df, ["id"], 10).groupBy("batch").count().collect().__len__() == 2
    assert ranking.batches(df, ["id"], 10, drop_last=False).count() == 25


def test_vocab_ids_and_fallback(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "word string, freq long")
    ids = {r["word"]: r["id"] for r in vocab.ranked_vocab(counts, 4, 2).collect()}
    assert ids == {"<UNK>": 0, "c": 1, "a": 2, "b": 3}
    tokens = spark.createDataFrame([(1, 0, X.MARKER + "ev"), (1, 1, X.MARKER + "qa"), (1, 2, "ler")], "doc_id int, pos int, token string")
    table = spark.createDataFrame([(X.MARKER + "ev", 5), ("a", 6), ("ler", 7), ("<UNK>", 0)], "token string, id int")
    encoded = vocab.encode_with_chars(tokens, table)
    assert [r["id"] for r in encoded.orderBy("pos", "sub").collect()] == [5, 0, 6, 7]
    assert vocab.decode_tokens(encoded, table, [0]).first()["text"] == "evaler"


def test_root_splits_longest(spark):
    words = spark.createDataFrame([("kitabı",), ("kitaplar",), ("yol",), ("zzz",)], "word string")
    roots = spark.createDataFrame([("kitap",), ("yol",), ("kit",)], "root string")
    suffixes = spark.createDataFrame([("ı",), ("lar",), ("aplar",)], "suffix string")
    got = {r["word"]: r["root_end"] for r in vocab.root_splits(words, roots, suffixes, X.harden).collect()}
    assert got == {"kitabı": 5, "kitaplar": 5, "yol": 3}


def test_context_pairs_are_a_band_join(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate("abcd")], "doc_id int, pos int, word string")
    got = sorted((r["word"], r["context"]) for r in vocab.context_pairs(df, 2).collect())
    want = sorted((a, b) for (i, a), (j, b) in itertools.product(enumerate("abcd"), repeat=2) if i != j and abs(i - j) <= 2)
    assert got == want


def test_verification_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.3, False)], "sim double, same boolean")
    got = retrieval.verification(df).first()
    assert abs(got["average_precision"] - 0.8333333) < 1e-6 and abs(got["best_f1"] - 0.8) < 1e-9 and got["best_threshold"] == 0.8
    assert abs(got["roc_auc"] - 0.875) < 1e-9


def test_retrieval_counts_queries_without_relevant(spark):
    rows = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.9, 0.1]), (2, 1, [0.0, 1.0])], "vec_id int, label int, embedding array<double>")
    unit = retrieval.unit_vectors(rows, "vec_id", "embedding", "label")
    got = retrieval.retrieval_metrics(unit, unit, 1).first()
    assert abs(got["map"] - 2 / 3) < 1e-9 and abs(got["purity"] - 1.0) < 1e-9


def test_coherence_is_exact(spark):
    rng = random.Random(1)
    data = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(12)]
    unit = retrieval.unit_vectors(spark.createDataFrame(data, "vec_id int, label int, embedding array<double>"), "vec_id", "embedding", "label")
    got = retrieval.coherence(unit).first()
    vectors = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, _, v in data}
    cos = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    means = []
    for g in range(3):
        members = [i for i in range(12) if i % 3 == g]
        pairs = [cos(a, b) for a, b in itertools.permutations(members, 2)]
        means.append(sum(pairs) / len(pairs))
    other = [cos(a, b) for a, b in itertools.permutations(range(12), 2) if a % 3 != b % 3]
    assert abs(got["intra"] - sum(means) / 3) < 1e-6 and abs(got["inter"] - sum(other) / len(other)) < 1e-6


def test_morph_scores_guards(spark):
    data = [("evler", ["ev", "ler"], ["ev", "ler"], 1.0), ("evde", ["ev", "de"], ["evde"], 3.0), ("bad", ["b", "x"], ["b", "ad"], 1.0)]
    df = spark.createDataFrame(data, "word string, gold array<string>, predicted array<string>, freq double").withColumn("model", F.lit("m"))
    got = metrics.morph_scores(df, ["model"]).first()
    assert got["n_words"] == 2 and got["macro_recall"] == 0.5 and got["single_rate"] == 0.5 and got["weighted_recall"] == 0.25
    skipped = metrics.morph_scores(df, ["model"], skip_single=True).first()
    assert skipped["n_words"] == 1 and skipped["single_rate"] == 1.0


def test_entropies(spark):
    got = metrics.entropies(spark.createDataFrame([("x", "a", 1), ("x", "b", 1)], "g string, token string, n long"), ["g"]).first()
    assert abs(got["shannon"] - 1) < 1e-12 and abs(got["renyi"] - 1) < 1e-12 and abs(got["renyi_efficiency"] - 1) < 1e-12


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 6.0), ("c", 0.5, 7.0)], "name string, acc double, ms double")
    assert sorted(r["name"] for r in reports.pareto_frontier(df, "acc", "ms").collect()) == ["a", "b"]
    flat = reports.unpivot_suffix(spark.createDataFrame([("s", 1.0, 2.0)], "stratum string, x_mas double, y_mas double"), ["stratum"], "mas")
    assert sorted((r["model"], r["value"]) for r in flat.collect()) == [("x", 1.0), ("y", 2.0)]
    const = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "name string, m double")
    assert {r["weighted_score"] for r in reports.weighted_ranking(const, {"m": 2.0}, ()).collect()} == {2.0}
    steps = spark.createDataFrame([("g", i, v) for i, v in enumerate([5.0, 4.0, 6.0, 7.0, 3.0])], "g string, i int, v double")
    assert [(r["best"], r["since_best"]) for r in reports.running_best(steps, ["g"], ["i"], "v").orderBy("i").collect()] == [(5.0, 0), (4.0, 0), (4.0, 1), (4.0, 2), (3.0, 0)]


def plain_bpe(counts, n):
    words = {w: (list(w), f) for w, f in counts.items()}
    out = []
    for _ in range(n):
        pairs = {}
        for segs, f in words.values():
            for p in zip(segs, segs[1:]):
                pairs[p] = pairs.get(p, 0) + f
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        for w, (segs, f) in words.items():
            new, i = [], 0
            while i < len(segs):
                if tuple(segs[i : i + 2]) == best:
                    new.append("".join(best))
                    i += 2
                else:
                    new.append(segs[i])
                    i += 1
            words[w] = (new, f)
    return out, {w: s for w, (s, _) in words.items()}


def test_merges_equal_a_plain_loop(spark):
    counts = {"banana": 4, "bandana": 3, "anan": 5, "nan": 2, "b": 1, "aaaa": 2}
    df = spark.createDataFrame(list(counts.items()), "word string, freq long")
    merges, state = learners.learn_merges(df, 5)
    want, segs = plain_bpe(counts, 5)
    assert merges == want
    assert {r["word"]: r["segs"] for r in state.collect()} == segs
    assert {r["word"]: r["segs"] for r in learners.apply_merges(df, merges).collect()} == segs


def test_longest_match_and_cheapest_path(spark):
    pieces = spark.createDataFrame([(t,) for t in ("un", "##a", "##ff", "##aff", "##able")], "token string")
    words = spark.createDataFrame([("unaffable",), ("xyz",)], "word string")
    got = {r["word"]: r["segs"] for r in learners.longest_match(pieces, words).collect()}
    assert got == {"unaffable": ["un", "##aff", "##able"], "xyz": ["[UNK]"]}
    costs = {"a": 3.0, "b": 3.0, "ab": 4.0, "ba": 5.5, "aba": 9.5}
    table = spark.createDataFrame(list(costs.items()), "token string, cost double")
    found = {r["word"]: r["segs"] for r in learners.cheapest_path(table, spark.createDataFrame([("abab",), ("aba",)], "word string")).collect()}
    for word, segs in found.items():
        best = min(sum(costs[s] for s in cut) for cut in cuts(word) if all(s in costs for s in cut))
        assert abs(sum(costs[s] for s in segs) - best) < 1e-9 and "".join(segs) == word


def cuts(word):
    for n in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), n):
            edges = [0, *at, len(word)]
            yield [word[a:b] for a, b in zip(edges, edges[1:])]


def test_unigram_and_failing_segmenter(spark):
    df = spark.createDataFrame([("evler", 5), ("evde", 4), ("ev", 9)], "word string, freq long")
    lexicon = learners.learn_unigram(df, 6, rounds=2)
    assert lexicon.count() >= 6
    later = spark.createDataFrame([("kolde", 7), ("evde", 4)], "word string, freq long")
    refined = learners.refine_unigram(lexicon, later, 6)
    assert set("kolevd") <= {r["token"] for r in refined.collect()}
    assert {"".join(r["segs"]) for r in learners.cheapest_path(refined, later).collect()} == {"kolde", "evde"}

    def broken(word):
        raise ValueError(word)

    assert {(r["segs"][0], r["failed"]) for r in learners.segment_words(df, broken).collect()} == {("evler", True), ("evde", True), ("ev", True)}
