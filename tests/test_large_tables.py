"""Operators on forms that stay small on large tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import segments as S
from textloom.functions import text as X
from textloom.operators import adapters, corpus, learners, retrieval, similar, vocab


def test_nearest_and_counts_send_no_pairs(spark):
    """Ties by id, nulls and NaN as in SQL; the plan joins no query with a row."""
    rows = [(i, i % 3 if i % 7 else None, [float((i * j) % 5) - 2.0 for j in range(1, 6)]) for i in range(300)]
    rows[5] = (5, 2, [1.0, None, 0.0, 0.0, 1.0])
    rows[9] = (9, 0, [float("nan"), 1.0, 0.0, 0.0, 1.0])
    unit = retrieval.unit_vectors(spark.createDataFrame(rows, "id long, label int, v array<double>"), "id", "v", "label").repartition(3)
    asked = unit.filter("id % 50 = 0")
    pairs = [(a, b, sum_of(a["unit"], b["unit"])) for a in asked.collect() for b in unit.collect() if a["id"] != b["id"]]
    key = lambda s: -math.inf if s is None else math.inf if math.isnan(s) else s
    found = retrieval.nearest(asked, unit, 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for a in {a["id"] for a, _, _ in pairs}:
        want = sorted(((-key(s), b["id"]) for q, b, s in pairs if q["id"] == a))[:4]
        assert [r["id"] for r in found.filter(F.col("query") == a).orderBy("rank").collect()] == [b for _, b in want]
    counts = similar.counts(asked, unit).groupBy("sim").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    same = [(a["label"] == b["label"]) for a, b, _ in pairs if a["label"] is not None and b["label"] is not None]
    assert (sum(r["pos"] for r in counts), sum(r["neg"] for r in counts)) == (sum(same), len(same) - sum(same))
    assert {round(key(r["sim"]), 6) for r in counts} == {round(key(s), 6) for _, _, s in pairs}
    got = retrieval.retrieval_metrics(asked, unit, 5).first()
    total = 0.0
    for a in {a["id"] for a, _, _ in pairs}:
        ranked = sorted(((-key(s), b["id"], q["label"] is not None and q["label"] == b["label"]) for q, b, s in pairs if q["id"] == a))
        at = [i for i, x in enumerate(ranked, 1) if x[2]]
        total += sum(h / i for h, i in enumerate(at, 1)) / max(len(at), 1)
    assert abs(got["map"] - total / asked.count()) < 1e-12


def test_nearest_are_exact_behind_rough_products(spark):
    """Copies tie by id, near ties are told apart, and what leaves the tasks does not grow with the parts of the table."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 8))
    vectors[100:200] = vectors[100] + rng.normal(size=(100, 8)) * 1e-12  # closer than single precision
    vectors[300:650] = vectors[300]  # copies, over a quarter of a block
    vectors[700:720] *= 1e9  # longer than is taken in single precision
    ids = rng.permutation(900)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "id long, unit array<double>")
    asked = rows.filter("id % 4 = 0")
    found = similar.nearest(asked, rows.repartition(40), 6)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = {}
    for r in retrieval.nearest(asked, rows, 6).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["sim"]))
    for i in range(900):
        if ids[i] % 4 == 0:
            sims = similar.dots(vectors[i : i + 1], vectors)[0]
            order = [j for j in np.lexsort((ids, -sims)) if j != i][:6]
            assert got[ids[i]] == [(ids[j], sims[j]) for j in order]
    best = similar.Nearest(4, 2)
    rough = (vectors[:4].astype(np.float32) @ vectors[:100].astype(np.float32).T).astype(np.float32)
    best.add_rough(rough, 1e-5, vectors[:4], vectors[:100], np.arange(100))
    assert best.id.reshape(4, 2).tolist() == np.argsort(-similar.dots(vectors[:4], vectors[:100]), axis=1)[:, :2].tolist()


def test_places_are_counted_by_sorted_values():
    rng = np.random.default_rng(7)
    for digits in (16, 1):  # without and with ties
        sim = -np.sort(-np.round(rng.normal(size=50), digits))
        ids = np.arange(50) * 3  # ascending, as within runs of equal similarities
        sims, others = np.round(rng.normal(size=400), digits), rng.permutation(400) * 3 + 1
        before = np.zeros(51, dtype=np.int32)
        similar.count_places(before, sim, -sim, ids, sims, others)
        want = Counter(sum((a > s) or (a == s and i < o) for a, i in zip(sim, ids)) for s, o in zip(sims, others))
        assert {i: n for i, n in enumerate(before.tolist()) if n} == want


def sum_of(a, b):
    out = 0.0
    for x, y in zip(a, b):
        if x is None or y is None:
            return None
        out += x * y
    return out


def test_documents_are_encoded_without_a_row_a_word(spark):
    texts = ["ev evler qa", "", "qa", "ab ev ab", None]
    docs = spark.createDataFrame([(i, t.split() if t is not None else []) for i, t in enumerate(texts)], "doc_id long, words array<string>")
    tokens = spark.createDataFrame([(X.MARKER + "ev", 5), ("a", 6), (X.MARKER + "a", 8), ("b", 9), ("<UNK>", 0)], "token string, id int")
    words = docs.select("doc_id", F.posexplode("words").alias("pos", "word"))
    rows = vocab.encode_with_chars(words.select("doc_id", "pos", F.concat(F.lit(X.MARKER), "word").alias("token")), tokens)
    want = {}
    for r in rows.orderBy("doc_id", "pos", "sub").collect():
        want.setdefault(r["doc_id"], []).append(r["id"])
    encoded = vocab.encode_documents(docs, tokens)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    decoded = vocab.decode_documents(encoded, tokens, [0])
    assert text(decoded) == text(vocab.decode_tokens(rows, tokens, [0]))
    assert "Exchange" not in decoded._jdf.queryExecution().executedPlan().toString()


def test_words_are_looked_up_in_arrays(spark, monkeypatch):
    """As word by word, also across parts; ids that a query sums or decodes do not leave Python."""
    monkeypatch.setattr(vocab, "PART_WORDS", 7)
    rng = random.Random(11)
    letters = "abçığ😀漢▁"
    lists = [["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n)] for n in (0, 1, 6, 7, 8, 40, 90)]
    docs = spark.createDataFrame([*enumerate(lists), (90, None)], "doc_id long, words array<string>").coalesce(1)
    known = ["<UNK>", "a", "b", "😀", *[X.MARKER + t for t in ("a", "ç", "漢", "ab", "b😀", "ığa")], "ab"]
    tokens = spark.createDataFrame([(t, 3 * i) for i, t in enumerate(known)], "token string, id int")
    ids = {t: 3 * i for i, t in enumerate(known)}
    coded = lambda w: [ids[X.MARKER + w]] if X.MARKER + w in ids else [ids.get(X.MARKER * (i == 0) + c, 0) for i, c in enumerate(w)]
    want = {i: [x for w in words for x in coded(w)] for i, words in enumerate(lists) if words}
    joined = docs.withColumn("words", F.concat(F.lit(" "), F.array_join("words", "  ")))
    for form in (docs, docs.withColumn("words", F.array_join("words", " ")), joined):
        assert {r["doc_id"]: r["ids"] for r in vocab.encode_documents(form, tokens).collect()} == want
        sums = vocab.encoded_sums(form, tokens)
        assert {r["doc_id"]: (r["n"], r["unknown"], r["id_sum"]) for r in sums.collect()} == {i: (len(x), x.count(0), sum(x)) for i, x in want.items()}
        text = vocab.recoded_documents(form, tokens.filter("token <> 'b'"), [0])
        assert sorted(text.collect()) == sorted(vocab.decode_documents(vocab.encode_documents(docs, tokens.filter("token <> 'b'")), tokens, [0]).collect())
        for df in (sums, text):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    odd = spark.createDataFrame([(1, [3, 99, 0, -1, 12]), (2, [0]), (3, [77]), (4, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in vocab.decode_documents(odd, tokens, [0]).collect()} == {1: "a a", 3: ""}


def test_chunks_blocks_and_pairs_stay_in_their_row(spark):
    rng = random.Random(3)
    lists = [[rng.choice("abcd") for _ in range(n)] for n in (0, 1, 2, 3, 32, 33, 35, 64, 65, 100)]
    docs = spark.createDataFrame(list(enumerate(lists)), "doc_id long, words array<string>")
    words = docs.select("doc_id", F.posexplode("words").alias("pos", "word"))
    key = lambda df: sorted((r["doc_id"], r["chunk"], r["words"]) for r in df.select("doc_id", "chunk", "words").collect())
    chunks = vocab.document_chunks(docs)
    assert key(chunks) == key(vocab.sentence_chunks(words))
    ids = spark.createDataFrame([(c, i) for i, c in enumerate("abc", 1)], "word string, id int")
    blocks = vocab.document_blocks(vocab.encode_documents(docs, ids, "word"), 32)
    want = {}
    for r in vocab.token_blocks(vocab.with_ids(words, ids).select("doc_id", "pos", "id"), 32).orderBy("doc_id", "pos").collect():
        got = want.setdefault((r["doc_id"], r["block"]), ([], []))
        got[0].append(r["id"])
        if r["target"] is not None:
            got[1].append(r["target"])
    assert {(r["doc_id"], r["block"]): (r["ids"], r["targets"]) for r in blocks.collect()} == want
    pairs = vocab.pairs_of_arrays(docs, 2)
    assert Counter((r["word"], r["context"]) for r in pairs.collect()) == Counter((x[i], x[j]) for x in lists for i in range(len(x)) for j in range(len(x)) if 0 < abs(i - j) <= 2)
    for df in (chunks, blocks, pairs):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_ids_of_texts_leave_in_parts(spark, monkeypatch):
    texts = ["x" * n for n in (700, 10, 600, 3, 2500, 0)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(adapters, "PART_IDS", 1000)
    ids = adapters.token_ids(df, adapters.byte_codec)
    assert [len(r["ids"]) for r in ids.orderBy("doc_id").collect()] == [len(t or "") for t in texts]
    assert ids._jdf.queryExecution().executedPlan().toString().startswith("MapInArrow")  # pandas would hold all lists of a batch


def test_texts_are_cleaned_once(spark, monkeypatch):
    """Queries that use the word counts several times read the documents once."""
    from textloom.plans import vocab_queries as Q

    docs = spark.createDataFrame([(1, "evler evde yollar yolda")], "doc_id long, text string")
    read = []
    monkeypatch.setattr(Q, "table", lambda *a: read.append(a) or docs)
    for query in (Q.boundary_labels, Q.unigram_segments, Q.wordpiece_vocabulary):
        read.clear()
        plan = query(spark, "")._jdf.queryExecution().executedPlan().toString()
        assert len(read) == 1 and "text#" not in plan


def test_documents_are_not_cleaned_for_a_filter(spark):
    docs = spark.createDataFrame([(1, "evler evde"), (2, "?")], "doc_id long, text string").select("doc_id", X.clean_words(F.col("text")).alias("words"))
    ids = spark.createDataFrame([("evde", 4)], "word string, id int")
    coded = vocab.encode_documents(docs, ids, "word")
    assert [(r["doc_id"], r["ids"]) for r in coded.collect()] == [(1, [0, 4])]
    assert "Filter" not in coded._jdf.queryExecution().executedPlan().toString()


def test_labels_compute_their_cuts_once(spark):
    df = spark.createDataFrame([(["ev", "ler", "de"],), (["ev"],), (None,)], "segs array<string>")
    plan = df.select(S.labels(S.boundaries(F.col("segs")), 8).alias("l"))
    assert [r["l"] and "".join(map(str, r["l"])) for r in plan.collect()][:2] == ["00100100", "00000000"]
    assert [r[0] for r in df.select(S.labels(F.lit(None).cast("array<int>"), 2)).collect()][0] == [None, None]
    text = plan._jdf.queryExecution().analyzed().toString()
    assert "transform(array(transform(slice(segs" in text  # the cuts stand outside the positions' function


def test_rules_share_what_they_read(spark):
    """Letters are looked up, and a line is cleaned, lowered and split once, not once a rule."""
    rows = [(1, 0, "Bu bir  deneme satırıdır ve çok uzun bir [1] cümledir 😀."), (1, 1, "wax qix quiz the lazy fox jumps over it"), (2, 0, "ßéÿ ĞİŞ ve"), (2, 1, None)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    for chars in (corpus.LETTERS, "qwx", "a-f", "😀é"):
        got = lines.select(corpus.characters_of(F.col("line"), chars).alias("n"), F.length(F.regexp_replace("line", f"[^{chars}]", "")).alias("want")).collect()
        assert all(r["n"] == r["want"] for r in got)
    cleaned = corpus.clean_lines(lines)
    want = lines.withColumn("line", corpus.cleaned_line(F.col("line"))).withColumn("reason", corpus.reject_reason(F.col("line")))
    assert cleaned.columns == want.columns and sorted(map(str, cleaned.collect())) == sorted(map(str, want.collect()))
    plan = cleaned.filter("reason is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("kaynak belirtilmeli") == 1 and plan.count(corpus.LETTERS) == 1 and f"[^{corpus.LETTERS}]" not in plan


def test_pairs_are_counted_in_blocks_of_words():
    """As a loop over words, with runs of one symbol, inner marks and few or many symbols."""
    rng = random.Random(5)
    for letters, marker in (("ab", ""), ("abé😀", "##"), ([chr(c) for c in range(0x4E00, 0x4E00 + 3000)], "")):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
        freq = np.array([rng.randint(1, 9) for _ in words])
        join = lambda a, b: a + b.removeprefix(marker) if marker else a + b
        a, b = letters[0], marker + letters[0]
        merges = [(a, b), (join(a, b), marker + letters[1])]
        symbols = learners.Symbols(merges, join, marker)
        pairs, sums = symbols.pairs(pa.array(words), freq)
        want = Counter()
        for w, n in zip(words, freq):
            segs = [w[0], *(marker + c for c in w[1:])]
            for pair in merges:
                segs = learners.merged(segs, {pair: join(*pair)})
            for pair in zip(segs, segs[1:]):
                want[pair] += int(n)
        assert {(symbols.name(int(p) >> 32), symbols.name(int(p) & 0xFFFFFFFF)): int(n) for p, n in zip(pairs, sums)} == want
