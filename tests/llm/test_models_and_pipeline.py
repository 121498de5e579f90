"""Classifiers by held-out accuracy, the mix against its SQL and targets, the pipeline stage by stage."""

import hashlib
import heapq
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing, quality, toxicity
from textloom.llm.common import fold_of

SF = "/root/testdata/sf0.001"


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = noise(rng, rng.randint(5, 60)) + (" vile brute " if bad else " ") + noise(rng, 5)
        docs.append((i, text.replace(" ", "## ") if i % 3 == 0 else text, 1))
        labels.append((i, int(i % 3 != 0), int(bad)))
    docs += [(9000, "", 1), (9001, None, 1), (None, "vile brute", 1), (9002, noise(rng, 30000), 1), (0, docs[0][1], 1)]
    labels += [(1, None, None), (None, 1, 1), (77777, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter(F.col("held_out") & F.col(label).isNotNull())
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_toxicity(spark, labelled):
    docs, labels = labelled
    scored = toxicity.score_documents(docs, labels)
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows}[5] == (fold_of(5, 3) == 1)
    assert accuracy(scored, labels, "toxic") > 0.95
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in rows if not r["predicted"]} == {r["doc_id"] for r in kept.collect()}
    none = toxicity.score_documents(docs.limit(0), labels)
    assert none.count() == 0
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    """FTRL-proximal a coordinate at a time, as published."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(zi, ni, l1):
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = {i: weight(z.get(i, 0.0), n.get(i, 0.0), l1) for i in at}
            b = weight(*bias, 0.0)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in at:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
            s = (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / alpha
            bias = [bias[0] + g - s * b, bias[1] + g * g]
    return weight(*bias, 0.0), {i: weight(z[i], n[i], l1) for i in z if abs(z[i]) > l1}


def test_ftrl_is_the_published_one_and_sparse():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 1000, 20), i % 2)) for i in range(400)]
    labels = [i % 2 for i in range(400)]
    state = toxicity.Ftrl(10)
    for _ in range(3):
        for at, y in zip(rows, labels):
            state.learn(at, y)
    model = state.model()
    bias, weights = plain_ftrl([r.tolist() for r in rows], labels, 3, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    assert model.coordinates.tolist() == sorted(weights) and abs(model.bias - bias) < 1e-9
    assert np.allclose(model.weights, [weights[i] for i in model.coordinates], atol=1e-5)
    assert len(model.weights) < 300 and model.dense()[1] > 1 > -1 > model.dense()[0]


def test_toxicity_query_against_a_plain_model(spark, labelled):
    """Scores of the operator from features, order and sums written out."""
    from textloom.llm.words import word_hashes

    docs, labels = labelled
    y = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and fold_of(r["doc_id"], 3) != 1:
            y[r["doc_id"]] = max(r["toxic"], y.get(r["doc_id"], 0))
    texts = {}
    for r in docs.collect():
        if r["doc_id"] in y:
            texts[r["doc_id"]] = max(r["text"] or "", texts.get(r["doc_id"], ""))

    def plain_features(text):
        h, odd = [int(x) for x in word_hashes(text or "")], [int(x) for x in toxicity._ODD]
        found = [*h, *(a * odd[1] + b * odd[2] for a, b in zip(h, h[1:])), *(a * odd[3] + b * odd[4] for a, b in zip(h, h[2:]))]
        return sorted({(x * odd[0] & (1 << 64) - 1) >> 64 - toxicity.BITS for x in found})

    ids = [i for epoch in range(1, toxicity.EPOCHS + 1) for _, i in sorted((hashlib.md5(f"toxic|{epoch}|{i}".encode()).hexdigest(), i) for i in texts)]
    bias, weights = plain_ftrl([plain_features(texts[i]) for i in ids], [y[i] for i in ids], 1, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    want = sorted((str(r["doc_id"]), 1 / (1 + math.exp(-bias - sum(weights.get(i, 0.0) for i in plain_features(r["text"]))))) for r in docs.collect())
    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score_documents(docs, labels).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-4)


@pytest.mark.parametrize("at", [[], [0], [0, 1, 70_000], [65_535, 65_536], [65_536], [(1 << 21) - 1]])
def test_coordinates_round_trip(at):
    assert toxicity.unpacked(toxicity.packed(np.array(at, dtype=np.int64))).tolist() == at


def test_a_score_at_the_threshold_is_predicted(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    model = toxicity.Model(float(np.log(0.7 / 0.3)), np.zeros(0, np.int64), np.zeros(0, np.float32), 4)
    exact = toxicity.score(rows, model).first()["score"]
    assert {r["predicted"] for r in toxicity.score(rows, model, exact).collect()} == {1}
    assert {r["predicted"] for r in toxicity.score(rows, model, exact + 1e-12).collect()} == {0}


def plain_probability(net, text):
    """The network's forward pass in loops."""
    raw = (text or "").encode()
    raw += bytes(max(0, quality.WIDTH - len(raw)))
    response = [[sum(float(net.taps[j][raw[i + j]][f]) for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for i in range(len(raw) - quality.WIDTH + 1)]
    starts = range(0, len(response), quality.HALF)
    chunks = [response[s : s + 2 * quality.HALF] for s in (starts if len(starts) == 1 else starts[:-1])]
    pooled = [[max(0.0, max(r[f] for r in c) + float(net.offset[f])) for f in range(quality.FILTERS)] for c in chunks]
    z = float(net.bias[0])
    for f in range(quality.FILTERS):
        z += max(c[f] for c in pooled) * float(net.peak[f]) + sum(c[f] for c in pooled) / len(pooled) * float(net.mean[f])
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 130, 131, 132, 259, 260, 700, 1500])
def test_network_against_loops(n, monkeypatch):
    rng, net = random.Random(n), quality.Network.random(5)
    net.offset[:] = np.linspace(-0.5, 0.5, quality.FILTERS)
    text = "".join(rng.choice("abcé ,.") for _ in range(n))
    want = plain_probability(net, text)
    assert abs(quality.probability(net, text) - want) < 1e-4
    top, place = quality._halves(net.taps, quality._bytes(text), places=True)
    monkeypatch.setattr(quality, "PIECE", 2 * quality.HALF)
    assert abs(quality.probability(net, text) - want) < 1e-4
    again, where = quality._halves(net.taps, quality._bytes(text), places=True)
    assert np.array_equal(top, again) and np.array_equal(place, where)


def test_quality(spark, labelled):
    docs, labels = labelled
    scored = quality.score_documents(docs, labels)
    assert scored.count() == docs.count() and accuracy(scored, labels, "quality") > 0.95
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_network_reads_every_byte_and_gradient_is_right():
    net = quality.Network.random(3)
    text = "x" * 5000 + "Q" * 8 + "x" * 5000
    assert quality.probability(net, text) != quality.probability(net, text.replace("Q", "x"))
    raw, grads = quality._bytes("some text " * 60), [np.zeros_like(p) for p in net.parameters()]
    quality._gradient(net, raw, 1.0, grads)
    loss = lambda: -np.log(quality.probability(net, "some text " * 60))
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.1 * abs(g[at]) + 1e-2


def seats_by_heap(votes, seats):
    won, heap = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def test_seats_go_to_the_highest_quotients(spark):
    rng = random.Random(8)
    cases = [[64_000] + [17] * 100, [5, 5, 5], [0, 0], [1], [10**6, 3, 3, 3, 0], [7] * 50]
    cases += [[rng.choice([1, 3, 10, 500, 10**5]) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    seats = [1540, 7, 5, 9, 4, 3] + [rng.choice([0, 1, 5, 77, 900]) for _ in range(30)]
    rows = [(c, i, float(v), s) for c, (votes, s) in enumerate(zip(cases, seats)) for i, v in enumerate(votes)]
    frame = spark.createDataFrame(rows, "c int, i int, votes double, s long")
    got = {(r["c"], r["i"]): r["quota"] for r in mixing.apportioned(frame, ["c"], "votes", F.col("s"), ["i"]).collect()}
    assert got == {(c, i): q for c, (votes, s) in enumerate(zip(cases, seats)) for i, q in enumerate(seats_by_heap(votes, s))}


def by_source(rows):
    found = {}
    for r in rows:
        key = (r["source_size"], r["target"])
        found[key] = found.get(key, 0) + r["taken"]
    return found


def test_small_sources_and_small_corpora_come_near_their_targets(spark):
    rng = random.Random(4)
    many = [(i, "big", noise(rng, 1000)) for i in range(64)] + [(100 + i, f"s{i:03}", noise(rng, 17 + i % 5)) for i in range(100)]
    for rows in (many, [(1, "a", "one two three")], [(1, "a", "one two three four"), (2, "b", "x"), (3, None, "")]):
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        got = mixing.mix_words(docs).collect()
        taken = {}
        for r, (i, source, _) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
            n, target = taken.get(source, (0, 0))
            taken[source] = (n + r["taken"], r["target"])
            assert r["doc_id"] == i and 0 <= r["taken"] <= 2 * r["size"]
        assert all(abs(n - target) <= max(1, 0.06 * target) for n, target in taken.values()), taken


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), noise(rng, rng.randint(0, 300))) for i in range(300)]
    rows += [(3, "a", rows[3][2]), (None, "b", "x y"), (None, "b", "z " * 90), (400, "b", None), (401, "empty", ""), (402, "a", noise(rng, 30_000))]
    docs = spark.createDataFrame([(*r, 9, "clash", 1) for r in rows], "doc_id long, source string, text string, size int, mix string, pieces int")
    got = mixing.mix_words(docs, shard_words=2000).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = by_source(got)
    for (size, target), taken in by.items():
        assert target <= 2 * size and abs(taken - target) <= 64 * (2 + size // 2000)
    total = sum(r["size"] for r in got)
    assert abs(sum(t for (_, t) in by) - 1.5 * total) < 1e-6 * total
    again = mixing.mix_words(docs.repartition(7), shard_words=2000).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    mixed = mixing.mix_documents(docs, shard_words=2000)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert abs(sum(len((r["text"] or "").split()) for r in rows) - sum(by.values())) <= 2 and {r["mix"] for r in rows} == {"clash"}
    assert mixing.mix_words(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_sql_of_this_subpackage(spark):
    import duckdb

    from textloom.llm import queries

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted((tuple(plain(x) for _, x in sorted(zip(names, row))) for row in found.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == want, name


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        if name in ("toxicity", "near duplicates"):
            assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(last.columns)


def plain_training(rows, epochs):
    """Adam on the log loss of (epoch, bytes, label), each gradient from the whole response matrix."""
    net = quality.Network.random()
    parameters = net.parameters()
    first, second, step = [np.zeros(p.shape) for p in parameters], [np.zeros(p.shape) for p in parameters], 0
    for start in [(e, at) for e in range(1, epochs + 1) for at in range(0, len(rows[e]), quality.BATCH)]:
        some = rows[start[0]][start[1] : start[1] + quality.BATCH]
        grads = [np.zeros(p.shape) for p in parameters]
        for raw, y in some:
            n = len(raw) - quality.WIDTH + 1
            response = sum(net.taps[j][raw[j : j + n]] for j in range(quality.WIDTH))
            cuts = range(0, n, quality.HALF)
            bounds = [(c, c + 2 * quality.HALF) for c in (cuts if len(cuts) == 1 else cuts[:-1])]
            at = np.array([a + response[a:b].argmax(axis=0) for a, b in bounds])
            pooled = np.maximum(np.array([response[a:b].max(axis=0) for a, b in bounds]) + net.offset, 0)
            peak, mean = pooled.max(axis=0), pooled.mean(axis=0)
            g = 1 / (1 + np.exp(-(peak @ net.peak + mean @ net.mean + net.bias[0]))) - y
            grads[2] += g * peak
            grads[3] += g * mean
            grads[4] += g
            for f in range(quality.FILTERS):
                back = np.full(len(bounds), g * net.mean[f] / len(bounds))
                back[pooled[:, f].argmax()] += g * net.peak[f]
                for c in np.flatnonzero(pooled[:, f] > 0):
                    grads[1][f] += back[c]
                    for j in range(quality.WIDTH):
                        grads[0][j, raw[at[c, f] + j], f] += back[c]
        step += 1
        pace = quality.RATE * (1 - (start[0] - 1) / epochs)
        for p, g, m, v in zip(parameters, grads, first, second):
            g /= len(some)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= pace * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + quality.DECAY * p)
    return net


def test_quality_query_against_a_plain_network(spark):
    rng = random.Random(12)
    docs = [(i, (noise(rng, rng.randint(1, 90)) + " é good" * (i % 2)) if i != 5 else None) for i in range(90)] + [(3, "another text of three"), (None, "x")]
    labels = [(i, i % 2, 0) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    y = {i: q for i, q, _ in labels if fold_of(i, 4) != 2}
    texts = {}
    for i, t in docs:
        if i in y:
            texts[i] = max(t or "", texts.get(i, ""))
    order = lambda e: [i for _, i in sorted((hashlib.md5(f"quality|{e}|{i}".encode()).hexdigest(), i) for i in texts)]
    net = plain_training({e: [(quality._bytes(texts[i]), y[i]) for i in order(e)] for e in (1, 2)}, 2)
    want = sorted((str(i), plain_probability(net, t)) for i, t in docs)
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality.score_documents(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), epochs=2).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=2e-3)


def messy_documents(spark):
    """Clean, toxic, repeated, near-equal, null, empty and very long documents, repeated rows, clashing columns."""
    rng = random.Random(77)
    texts = ["\n".join(noise(rng, rng.randint(6, 12)) for _ in range(rng.randint(2, 6))) for _ in range(40)]
    passage = "\n".join(noise(rng, 30) for _ in range(3))
    texts += [f"{noise(rng, 9)}\n{passage}\n{noise(rng, 9)}" for _ in range(6)]
    texts += [t + " vile brute" for t in texts[:12]]
    texts += [texts[20], texts[20], texts[21].replace(" ", "  ", 3), texts[22] + " tail", "", None, "one", "\n".join(noise(rng, 40) for _ in range(4000))]
    rows = [(i, t, f"src{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [rows[25], rows[25], (None, texts[30], "src0"), (None, None, None)]
    rows = [(i, t, s, None if t is None else len(t), 1, "x", b"y") for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size int, mix string, digest binary")
    labels = spark.createDataFrame([(i, int("vile brute" in (t or "")), 1) for i, t, *_ in rows if i is not None], "doc_id long, toxic int, quality int")
    return docs, labels


def plain_stage_two(rows):
    """Rows (doc_id, text, ...) without repeated pairs of neighbouring lines."""
    from textloom.llm import line_dedup

    first, gone = {}, {}
    order = {r["text"]: r["h"] for r in rows[0]}
    for i, t in sorted({(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows[1] if r["text"] is not None}, key=lambda x: (x[0], order[x[1]])):
        lines = t.encode().split(b"\n")
        for start, n in line_dedup.cut(lines):
            first.setdefault(b"\n".join(lines[start : start + n]), (i, t, start))
    for i, t in {(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows[1] if r["text"] is not None}:
        lines = t.encode().split(b"\n")
        for start, n in line_dedup.cut(lines):
            origin = first[b"\n".join(lines[start : start + n])]
            if origin != (i, t, start):
                begin = max(start, origin[2] + n) if origin[:2] == (i, t) else start
                gone.setdefault((i, t), set()).update(range(begin, start + n))
    out = []
    for r in rows[1]:
        key = (-1 if r["doc_id"] is None else r["doc_id"], r["text"])
        lost = gone.get(key, ())
        text = r["text"] if not lost else "\n".join(x for j, x in enumerate(r["text"].split("\n")) if j not in lost)
        out.append({**r, "text": text, "n_chars": r["n_chars"] if not lost else len(text)})
    return out


def plain_stage_three(rows):
    """Rows but for near copies of a row with a smaller id."""
    from textloom.llm.alignment import similar
    from textloom.llm.words import word_hashes

    known = sorted({(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None})
    words = [word_hashes(t) for _, t in known]
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            if known[a][1] == known[b][1] or len(words[a]) and len(words[b]) and similar(words[a], words[b], 0.8):
                one, two = sorted((find(a), find(b)))
                parent[two] = one
    kept = {known[find(i)] for i in range(len(known))}
    return [r for r in rows if r["doc_id"] is None or (r["doc_id"], r["text"] or "") in kept]


def plain_stage_four(rows, tmp_path):
    """The mix by its SQL, cut into texts here."""
    import duckdb
    import pyarrow as pa
    import re

    from textloom.llm.mixing_sql import MIX_SQL

    documents = pa.table({c: [r[c] for r in rows] for c in ("doc_id", "text", "source")}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]))
    con = duckdb.connect()
    con.register("documents", documents)
    sql = MIX_SQL.replace("SELECT doc_id, size, source_size, target,", "SELECT doc_id, digest, size,").replace("d.doc_id, d.size, s.place", "d.doc_id, d.digest, d.size, s.place")
    counts = {}
    for doc, digest, size, taken in con.execute(sql).fetchall():
        counts.setdefault((doc, digest), []).append((size, taken))
    out = []
    for r in rows:
        found = counts[r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()]
        size, taken = found[0][0], sum(t for _, t in found) // len(found)
        if not taken:
            continue
        texts = [r["text"]] * (taken // size)
        if taken % size:
            texts.append(re.match(r"(?s)[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){%d}" % (taken % size), r["text"])[0])
        out += [{**r, "text": t, "n_chars": len(t)} for t in texts]
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage on its predecessor's rows, and the last result, against loops, the library and SQL."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from textloom.llm import bpe

    docs, labels = messy_documents(spark)
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    key = lambda r: repr(sorted((k, str(v)) for k, v in r.items()))
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=key)

    scored = {(r["doc_id"]): r["predicted"] for r in toxicity.score_documents(docs, labels).collect()}
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == columns and 0 < clean.count() < docs.count()
    assert {r["doc_id"] for r in clean.collect() if r["doc_id"] is not None} == {i for i, p in scored.items() if i is not None and not p}
    clean.write.parquet(f"{sf}/1")
    clean = spark.read.parquet(f"{sf}/1")

    hashes = [r.asDict() for r in clean.select("text", F.xxhash64("text").alias("h")).distinct().collect()]
    deduped = stages["line dedup"](spark, clean, sf)
    want = sorted(plain_stage_two((hashes, rows(clean))), key=key)
    assert deduped.columns == columns and rows(deduped) == want and want != rows(clean)
    deduped.write.parquet(f"{sf}/2")
    deduped = spark.read.parquet(f"{sf}/2")

    single = stages["near duplicates"](spark, deduped, sf)
    want = sorted(plain_stage_three(rows(deduped)), key=key)
    assert single.columns == columns and rows(single) == want and len(want) < deduped.count()
    single.write.parquet(f"{sf}/3")
    single = spark.read.parquet(f"{sf}/3")

    mixed = stages["mixing"](spark, single, sf)
    want = sorted(plain_stage_four(rows(single), tmp_path), key=key)
    assert mixed.columns == columns and rows(mixed) == want
    mixed.write.parquet(f"{sf}/4")

    library, expected = Tokenizer.from_file(bpe.default_vocabulary()), []
    for r in want:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((str(r["doc_id"]), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(expected)


def test_pipeline_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, labels = messy_documents(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for empty in (docs.limit(0), docs.filter("text is null")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, empty, str(tmp_path))
            assert out.count() <= 2 and (name == "bpe" or out.columns == docs.columns), name


def test_every_query_takes_nulls_repeats_and_long_texts(spark):
    from textloom.llm import bpe, fingerprints, line_dedup, near_dups, token_files

    docs, labels = messy_documents(spark)
    n = docs.count()
    results = {
        "toxicity": toxicity.score_documents(docs, labels), "quality": quality.score_documents(docs, labels), "files": token_files.file_round_trip(docs),
        "fingerprints": fingerprints.edited_neighbours(docs), "mix": mixing.mix_words(docs), "lines": line_dedup.remove_repeats(docs, counts=True),
        "copies": near_dups.groups(docs), "bpe": bpe.encode_documents(docs),
    }
    for name, df in results.items():
        assert df.count() == n, name
