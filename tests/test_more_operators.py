"""Adapters, probe sets, learners and the smaller operators against plain Python."""

import itertools
import json
import os
import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.functions import segments as S
from textloom.functions import text as X
from textloom.operators import adapters, learners, metrics, probes, ranking, reports, retrieval, vocab
from textloom.sources import files
from textloom.streaming import streams


def plain_merges(words, merges, join, least=1):
    """One merge after another: the most frequent pair, ties to the smaller."""
    state, found = dict(words), []
    for _ in range(merges):
        counts = Counter()
        for segs, n in state.items():
            for pair in zip(segs, segs[1:]):
                counts[pair] += n
        counts = {p: n for p, n in counts.items() if n >= least}
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        found.append(best)
        after = Counter()
        for segs, n in state.items():
            after[tuple(learners.merged(list(segs), {best: join(*best)}))] += n
        state = after
    return found


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcd", min_size=1, max_size=6), st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 12))
def test_rounds_of_merges_are_merges_one_by_one(words, merges):
    state, found = {tuple(w): n for w, n in words.items()}, []
    symbols = {c for w in words for c in w}
    while len(found) < merges:
        counts = Counter()
        for segs, n in state.items():
            for pair in zip(segs, segs[1:]):
                counts[pair] += n
        best = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda p: (-p[2], p[0], p[1]))
        some = learners.safe_merges(best, symbols, merges - len(found), str.__add__)
        if not some:
            break
        found += some
        after = Counter()
        for segs, n in state.items():
            after[tuple(learners.merged(list(segs), {p: p[0] + p[1] for p in some}))] += n
        state = after
    assert found == plain_merges({tuple(w): n for w, n in words.items()}, merges, str.__add__)


def test_merges_and_wordpieces_of_a_table(spark):
    rng = random.Random(3)
    words = Counter("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300))
    frame = spark.createDataFrame(list(words.items()), "word string, freq long")
    merges, state = learners.learn_merges(frame, 40)
    assert merges == plain_merges({tuple(w): n for w, n in words.items()}, 40, str.__add__)
    assert all("".join(r["segs"]) == r["word"] for r in state.collect())
    plain = Counter()
    for w, n in words.items():
        plain["".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn")] += n
    start = {tuple([w[0], *("##" + c for c in w[1:])]): n for w, n in plain.items()}
    join = lambda a, b: a + b.removeprefix("##")
    first = ["[UNK]", *sorted({s for segs in start for s in segs})]
    want = list(dict.fromkeys([*first, *(join(*p) for p in plain_merges(start, 50, join, 2))]))[:45]
    got = learners.learn_wordpiece(frame, 45).orderBy("id").collect()
    assert [r["token"] for r in got][: len(want)] == want[: len(got)] and len(got) == 45
    segs = learners.longest_match(learners.learn_wordpiece(frame, 45), learners.plain_words(frame).select("word"))
    assert all("".join(s.removeprefix("##") for s in r["segs"]) == r["word"] for r in segs.collect())


def test_vocabularies_that_are_too_large_are_an_error(spark, monkeypatch):
    with pytest.raises(ValueError):
        learners.bounded(spark.range(5), 4)


def test_codecs(spark):
    words = spark.createDataFrame([("evler",), ("çay",), ("quiz",), ("evler",), ("日本",)], "word string")
    got = {r["word"]: (r["decoded"], r["failed"]) for r in adapters.coded_words(words, adapters.character_codec).collect()}
    assert got == {"evler": ("evler", False), "çay": ("çay", False), "quiz": ("uiz", False), "日本": ("", False)}
    got = {r["word"]: r["decoded"] for r in adapters.coded_words(words, adapters.byte_codec).collect()}
    assert all(w == d for w, d in got.items())
    broken = lambda: adapters.Codec(lambda t: [1 // (len(t) - 3)], lambda ids: "x")
    got = {r["word"]: (r["decoded"], r["failed"]) for r in adapters.coded_words(words, broken).collect()}
    assert got["çay"] == (None, True) and got["quiz"] == ("x", False)
    ids = adapters.token_ids(spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string"), adapters.byte_codec)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {1: [195, 169], 2: []}
    assert tuple(adapters.observed_vocabulary(ids, 100).first()) == (100, 196, 196)
    assert tuple(adapters.observed_vocabulary(ids.limit(0), 7).first()) == (7, 0, 7)


def test_pieces_vectors_and_inventory(spark):
    lines = spark.createDataFrame([("a b",), (None,), ("c",)], "line string")
    got = adapters.line_pieces(lines, lambda: lambda some: [w for line in some for w in line.split()])
    assert sorted(r["piece"] for r in got.collect()) == ["a", "b", "c"]
    words = spark.createDataFrame([("ab",), ("abc",), ("ab",)], "word string")
    vectors = adapters.word_embeddings(words, lambda: lambda some: [[len(w), 0.5] for w in some], batch_words=1)
    assert {r["word"]: r["vector"] for r in vectors.collect()} == {"ab": [2.0, 0.5], "abc": [3.0, 0.5]}

    def analyser():
        known = {"Evler": [("Noun", "ev:Noun+ler:A3pl", "Ev")], "xx": [("Unk", "xx:Unk", "xx")], "gel": [(None, None, None)]}
        return lambda w: known[w]

    found = adapters.analyses(spark.createDataFrame([("Evler",), ("xx",), ("gel",), ("bad",)], "word string"), analyser)
    assert {r["word"] for r in found.filter("failed").collect()} == {"bad"}
    got = {(r["kind"], r["entry"]) for r in adapters.inventory(found).collect()}
    assert got == {("morpheme", "ev"), ("morpheme", "ler"), ("word", "Evler"), ("word", "gel")}


def test_probe_sets(spark):
    rows = [(f"w{i}", ["N", "SG" if i % 2 else "PL"]) for i in range(12)] + [("both", ["SG", "PL"]), ("none", [])]
    frame = spark.createDataFrame(rows, "word string, features array<string>")
    sets = probes.tagged(frame, {"number": ["SG", "PL"], "kind": ["N"]})
    kept = probes.large_classes(sets, 6)
    assert {(r["word"], r["label"]) for r in kept.collect()} == {(f"w{i}", "SG" if i % 2 else "PL") for i in range(12)}
    assert probes.large_classes(sets, 7).count() == 0
    assert probes.resolved(probes.large_classes(sets, 7), sets).count() == sets.count()
    bins = spark.range(0, 9).select(probes.count_bin(F.col("id")).alias("b"))
    assert [r["b"] for r in bins.collect()] == [0, 0, 1, 2, 3, 4, 5, 5, 5]


def test_probe_accuracy_is_what_the_labels_allow(spark):
    """Separable vectors are learnt, in every fold; shuffled labels are not."""
    rng = random.Random(1)
    rows = [(i, i % 2, [2.0 * (i % 2) + rng.gauss(0, 0.1), rng.gauss(0, 1)], rng.randint(0, 1)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, label int, vector array<double>, noise int")
    folds = ranking.stratified_folds(frame, "label", ["id"])
    got = learners.linear_probe(folds, "label", "vector", balanced=True).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2, 3, 4] and sum(r["n"] for r in got) == 120 and all(r["correct"] == r["n"] for r in got)
    got = learners.linear_probe(ranking.stratified_folds(frame, "noise", ["id"]), "noise", "vector").collect()
    assert sum(r["correct"] for r in got) < 85


def test_ranks_folds_and_batches_in_many_ranges(spark):
    frame = spark.range(500).select("id", (F.col("id") % 3).alias("label"))
    import hashlib

    order = sorted(range(500), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
    for digits in (1, 2, None):
        got = ranking.hashed_rank(frame, ranking.seeded(42, "id"), ["id"], digits=digits).collect()
        assert {r["id"]: r["position"] for r in got} == {i: at + 1 for at, i in enumerate(order)}
    got = {r["id"]: r["fold"] for r in ranking.stratified_folds(frame, "label", ["id"]).collect()}
    for label in range(3):
        assert [got[i] for i in order if i % 3 == label] == [at % 5 for at in range(len([i for i in order if i % 3 == label]))]
    assert [r["id"] for r in ranking.seeded_sample(frame, ["id"], 4).orderBy(F.md5(ranking.seeded(42, "id"))).collect()] == order[:4]
    top = reports.best_per_group(frame, ["label"], [F.desc("id")], 2)
    assert sorted(r["id"] for r in top.collect()) == [494, 495, 496, 497, 498, 499]


def plain_retrieval(units, queries, k=5):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    aps, rrs, pures = [], [], []
    for q in queries:
        ranked = sorted((i for i in units if i != q), key=lambda i: (-dot(units[q][0], units[i][0]), i))
        rel = [units[i][1] == units[q][1] for i in ranked]
        hits = list(itertools.accumulate(rel))
        aps.append(sum(h / (at + 1) for at, (r, h) in enumerate(zip(rel, hits)) if r) / max(1, sum(rel)))
        rrs.append(1 / (rel.index(True) + 1) if any(rel) else 0)
        if any(rel):
            pures.append(sum(rel[:k]) / k)
    return sum(aps) / len(aps), sum(rrs) / len(rrs), sum(pures) / len(pures)


def test_retrieval_in_ranges_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"l{i % 4}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(99, "alone", [1.0] * 6)]
    frame = retrieval.unit_vectors(spark.createDataFrame(rows, "i long, l string, v array<double>"), "i", "v", "l")
    units = {r["id"]: (r["unit"], r["label"]) for r in frame.collect()}
    asked = [0, 7, 30, 99]
    for most in (64 << 20, 100):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", most)
        got = retrieval.retrieval_metrics(frame.filter(F.col("id").isin(asked)), frame).first()
        assert all(abs(a - b) < 1e-9 for a, b in zip(plain_retrieval(units, asked), (got["map"], got["mrr"], got["purity"])))
    pairs = retrieval.negative_pairs(frame, 30, bucket_rows=20).collect()
    assert 0 < len(pairs) <= 30 and all(units[r["one"]][1] != units[r["other"]][1] for r in pairs)
    both = retrieval.side_by_side(retrieval.nearest(frame.filter("id = 0"), frame, 3), retrieval.nearest(frame.filter("id = 0"), frame, 2))
    assert [(r["rank"], r["one_id"] is None, r["two_id"] is None) for r in both.orderBy("rank").collect()] == [(1, False, False), (2, False, False), (3, False, True)]
    masked = spark.createDataFrame([(2.0, 1), (4.0, 1), (100.0, 0)], "x double, m int").agg(retrieval.masked_mean(F.col("x"), F.col("m")).alias("m"))
    assert masked.first()["m"] == 3.0
    batch = spark.createDataFrame([(0, 1, 5), (0, 2, 5), (0, 3, 0), (1, 4, 5)], "batch int, id int, root int")
    assert {tuple(r) for r in retrieval.batch_positives(batch).collect()} == {(1, 2), (2, 1)}


def test_analogies(spark):
    rows = [(r + s, [r, s] if s else [r]) for r in ("ev", "kol", "göz") for s in ("", "ler", "de")]
    frame = spark.createDataFrame(rows, "word string, segs array<string>")
    got = retrieval.analogy_pairs(frame, least=3, most=100).collect()
    assert len(got) == 4 and all(r["a2"] == r["a"] + r["suffix"] and r["b2"] == r["b"] + r["suffix"] for r in got)


def test_reports(spark):
    rows = [("r1", "fertility", "tokens_per_word", "seen", "own", 1.5), ("r1", "fertility", "tokens_per_word", "oov", "other", 9.0), ("r2", "coherence", "delta", "oov", "x", 0.3), ("r2", "coherence", "delta", "oov", "x", 0.2)]
    merged = spark.createDataFrame(rows, "run string, category string, metric string, stratum string, model string, value double")
    tables = reports.ablation_report(merged, ["seen", "oov"], "own")
    assert [tuple(r) for r in tables["fertility"].collect()] == [("r1", 1.5, None)] and [tuple(r) for r in tables["coherence"].collect()] == [("r2", None, 0.2)]
    assert reports.stacked(tables).count() == 2
    assert reports.subset(merged, "run", " r2, r3").count() == 2 and reports.subset(merged, "run", "").count() == 4
    names = spark.createDataFrame([("bpe-64K", 64), ("bpe-32K", 32), ("uni-32000", 32)], "name string, vocab_size int")
    assert {r["name"] for r in reports.named(names, "32K|32000").collect()} == {"bpe-32K", "uni-32000"}
    assert {(r["method"], r["step"], r["name"]) for r in reports.curves(names, "vocab_size").collect()} == {("bpe", 1, "bpe-32K"), ("bpe", 2, "bpe-64K"), ("uni", 1, "uni-32000")}
    rates = reports.inference_rates(spark.createDataFrame([(100.0, 2.0, 0.25), (1.0, 1.0, 0.0)], "tokens_per_sec double, ms_per_token double, tokens_per_char double"))
    assert [(r["chars_per_sec"], r["ms_per_char"]) for r in rates.collect()] == [(400.0, 0.5), (None, 0.0)]


def test_diagnosis_entropy_and_small_columns(spark):
    rows = spark.createDataFrame([("evler", ["ev", "ler"], ["evl", "er"]), ("ev", ["ev"], ["ev"])], "word string, gold array<string>, predicted array<string>")
    got = {r["word"]: (r["true_cuts"], r["model_cuts"], r["output"], r["shifted"]) for r in metrics.boundary_diagnosis(rows).collect()}
    assert got == {"evler": ("2", "3", "evl | er", True), "ev": ("", "", "ev", False)}
    counts = spark.createDataFrame([("a", 1), ("b", 1)], "token string, n long")
    assert abs(metrics.entropies(counts, [], vocab_size=16).first()["renyi_efficiency_vocab"] - 0.25) < 1e-9
    one = spark.createDataFrame([("▁ev##ler Ġ", "Byte_BPE-64k", ["V", "PST", "1"], "nan")], "piece string, name string, features array<string>, part string")
    got = one.select(X.strip_markers(F.col("piece")), X.clean_piece(F.col("piece")), X.canonical_name(F.col("name")), S.feature_count(F.col("features"), files.STRUCTURAL), S.gold_parts(F.lit("ev"), F.col("part"), F.lit(""), F.lit(None))).first()
    assert tuple(got) == ("evler", "evlerĠ", "ByteBPE", 2, ["ev"])
    names = spark.createDataFrame([("bpe-64k",), ("my-bpe",), ("Turkish_Tokenizer",)], "n string").select(X.canonical_name(F.col("n")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["BPE", "my-bpe", "TurkishTokenizer"]
    assert {r["ch"] for r in vocab.segment_characters(rows.select(F.col("gold").alias("segs"))).collect()} == set("evlr")
    assert [r["word"] for r in vocab.first_columns(spark.createDataFrame([("İki a",), ("",)], "value string"), X.tr_lower).collect()] == ["iki"]


def test_masks_and_word_vectors(spark):
    words = spark.range(1000).select((F.col("id") % 10).alias("doc_id"), F.col("id").alias("pos"))
    share = learners.masked_positions(words, ["doc_id", "pos"]).filter("masked").count()
    assert 150 < share < 250 and share == learners.masked_positions(words, ["doc_id", "pos"]).filter("masked").count()
    sentences = spark.createDataFrame([(["a", "b", "c"],)] * 20, "words array<string>")
    vectors = learners.word_vectors(sentences, size=4, min_count=1).collect()
    assert {r["word"] for r in vectors} == {"a", "b", "c"} and all(len(r["vector"]) == 4 for r in vectors)


def test_more_sources(spark, tmp_path):
    spark.createDataFrame([("a\nb",), ("c",), ("c",)], "text string").coalesce(1).write.parquet(str(tmp_path / "articles"))
    rows = files.read_articles(spark, str(tmp_path / "articles")).collect()
    assert sorted((r["line_no"], r["line"]) for r in rows) == [(0, "a"), (0, "c"), (0, "c"), (1, "b")] and len({r["article"] for r in rows}) == 3
    assert {r["line"] for r in files.read_articles(spark, str(tmp_path / "articles"), limit=1).collect()} == {"a", "b"}
    spark.createDataFrame([("q1", ["x", "y"]), ("q2", None), (None, ["", "z"])], "soru string, secenekler array<string>").write.parquet(str(tmp_path / "questions"))
    assert sorted(r["text"] for r in files.read_questions(spark, str(tmp_path / "questions"), "soru", "secenekler").collect()) == ["q1", "q2", "x", "y", "z"]
    (tmp_path / "inventory.json").write_text(json.dumps({"morphemes": ["ler", "ev", "ler"], "words": ["evler"]}))
    morphemes, words = files.read_inventory(spark, str(tmp_path / "inventory.json"))
    assert {r["word"] for r in morphemes.collect()} == {"ler", "ev"} and {r["word"] for r in words.collect()} == {"evler"}
    spark.createDataFrame([(["a", "b"], [0, 1]), (["c"], [2])], "tokens array<string>, ner_tags array<int>").write.parquet(str(tmp_path / "ner"))
    assert sorted((r["pos"], r["token"], r["tag"]) for r in files.read_tagged_sentences(spark, str(tmp_path / "ner")).collect()) == [(0, "a", 0), (0, "c", 2), (1, "b", 1)]
    assert files.read_tagged_sentences(spark, str(tmp_path / "ner"), cap=1).select("sentence").distinct().count() == 1
    (tmp_path / "lex.txt").write_text("Ev house\nIŞIK light\n")
    assert {r["word"] for r in files.read_lexicon(spark, str(tmp_path / "lex.txt"), both_cases=True).collect()} == {"Ev", "ev", "IŞIK", "ışık"}
    sizes = spark.createDataFrame([("bpe", "p32", 32), ("bpe", "p64", 64), ("uni", "u8", 8)], "kind string, path string, size int")
    assert {tuple(r) for r in files.nearest_size(sizes, 60).collect()} == {("bpe", "p64"), ("uni", "u8")}


def test_files_by_preference_and_once(spark, tmp_path):
    folder = tmp_path / "ck"
    folder.mkdir()
    for at, name in enumerate(("old.pt", "new.pt", "best.pt")):
        (folder / name).write_text("x" * (at + 1))
        os.utime(folder / name, (1_700_000_000 + at * 100 if name != "best.pt" else 1_600_000_000,) * 2)
    found = files.files_of(spark, str(folder))
    name = lambda preferred: files.preferred_file(found, preferred).first()["path"].rsplit("/", 1)[-1]
    assert name(["none.pt", "best.pt"]) == "best.pt" and name([]) == "new.pt"
    source, target = tmp_path / "a.txt", tmp_path / "b.txt"
    source.write_text("abc")
    assert files.ingest_once(spark, str(source), str(target)) and not files.ingest_once(spark, str(source), str(target))
    source.write_text("abcd")
    assert files.ingest_once(spark, str(source), str(target)) and target.read_text() == "abcd"


def test_written_lines_and_reports(spark, tmp_path):
    rows = [(d, p, 0, 10 * d + p) for d in (2, 0, 1) for p in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, sub int, id int").repartition(3)
    stats = files.write_token_lines(frame, str(tmp_path / "ids")).first()
    assert (stats["documents"], stats["tokens"], stats["distinct_ids"]) == (3, 9, 9)
    lines = [line for p in sorted((tmp_path / "ids").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["0 1 2", "10 11 12", "20 21 22"]
    files.write_lines(spark.range(2), "id", str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["0", "1"]
    files.write_report(spark.range(2), str(tmp_path / "csv"))
    files.write_report(spark.range(2), str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2


def test_streams_with_progress_windows_and_bounded_state(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b\nc d", "2024-01-01 00:00:00"), (2, "a b\n\ne", "2024-01-01 00:30:00")], "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "docs.parquet")
    docs.write.parquet(path)
    stream = lambda: streams.stream_table(spark, path, docs.schema)
    found, progress = streams.kept_lines_with_progress(stream())
    assert found.count() == 0 and sum(r["lines_in"] for r in progress.collect()) == 4 and {r["keep_rate"] for r in progress.collect() if r["lines_in"]} == {0.0}
    lines = streams.run_to_end(streams.distinct_lines_within(stream(), "ts", "1 hour").select("line"))
    assert sorted(r["line"] for r in lines.collect()) == ["", "a b", "c d", "e"]
    events = spark.createDataFrame([(1, "x", 1.0, "2024-01-01 00:00:00"), (1, "x", 2.0, "2024-01-01 00:30:00"), (1, "x", 4.0, "2024-01-01 05:00:00"), (2, "x", 8.0, "2024-01-02 00:00:00")], "user_id long, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: streams.stream_table(spark, str(tmp_path / "events.parquet"), events.schema)
    assert sorted((r["user_id"], r["n"]) for r in streams.run_to_end(streams.sessions(stream()), "complete").collect()) == [(1, 1), (1, 2), (2, 1)]
    slid = streams.run_to_end(streams.sliding_windows(stream()), "complete")
    assert slid.agg(F.sum("n")).first()[0] == 16


def test_late_events_are_dropped_after_the_delay(spark, tmp_path):
    """One file a batch: the third holds one event within the delay and one beyond it."""
    schema = "event_type string, value double, ts timestamp"
    for at, rows in enumerate(([("x", 1.0, "2024-01-10 00:00:00")], [("x", 16.0, "2024-01-10 01:00:00")], [("x", 2.0, "2024-01-09 12:00:00"), ("x", 4.0, "2024-01-01 00:00:00")], [("x", 8.0, "2024-02-01 00:00:00")])):
        frame = spark.createDataFrame(rows, "event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
        for p in (tmp_path / "late").glob("part-*"):
            if p.stat().st_mtime > 1_700_000_050:
                os.utime(p, (1_700_000_000 + at,) * 2)
    stream = streams.stream_table(spark, str(tmp_path / "late"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = streams.run_to_end(streams.event_windows(stream, "1 day", "1 day"))
    assert sorted(r["total"] for r in got.collect()) == [2.0, 17.0]
