"""Near-duplicate operators against brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from textloom.llm import embedding_dups, fingerprints, line_dedup, near_dups
from textloom.llm.alignment import banded_distance, similar
from textloom.llm.components import components
from textloom.llm.words import word_hashes


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 16))
def test_banded_distance(a, b, k):
    d = levenshtein(a, b)
    assert banded_distance(a, b, k) == (d if d <= k else k + 1)
    longer = max(len(a), len(b))
    assert similar(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 0.8) == (d <= int(0.2 * longer + 1e-9))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300), (500, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + [(None, 1)], "src long, dst long")).collect()}
    assert got == union(edges, {n for e in edges for n in e})


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "".join(rng.choice("xyz") for _ in range(4))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.randint(80, 200)) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(edited(rng, b, rng.randint(1, 4))) for b in base for _ in range(3)]
    passage = words(rng, 60)
    texts += [" ".join(words(rng, 100) + passage + words(rng, 100)) for _ in range(15)]
    texts += [texts[0], texts[0], "", "", "one two three", "one two three", " ".join(words(rng, 4000))]
    return list(enumerate(texts))


def test_op9_against_all_pairs(spark, corpus):
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in corpus] + [(None, corpus[0][1], b""), (200, None, b"")], "doc_id long, text string, digest binary")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dups.groups(docs).collect()}
    hashed = {i: word_hashes(t) for i, t in corpus} | {200: word_hashes("")}
    text = dict(corpus) | {200: ""}
    pairs = [(a, b) for a, b in itertools.combinations(text, 2) if text[a] == text[b] or (len(hashed[a]) and similar(hashed[a], hashed[b], 0.8))]
    want = union(pairs, text)
    assert {i: c for i, (c, _) in got.items() if i is not None} == want
    assert got[None] == (None, True) and all(k == (i == c) for i, (c, k) in got.items() if i is not None)
    kept = near_dups.keep_representatives(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None} | {i for i, c in want.items() if i == c}
    assert near_dups.groups(docs.limit(0)).count() == 0


def test_op9_links_texts_at_the_rim_of_a_group(spark):
    rng = random.Random(23)
    base = words(rng, 100)
    member = [f"m{i}" if i % 7 == 3 else w for i, w in enumerate(base)]
    rim = [f"r{i}" if i % 7 == 5 else w for i, w in enumerate(member)]
    texts = dict(enumerate(map(" ".join, (base, member, rim, words(rng, 100)))))
    rows = [(k, band, n, 100) for n, t in texts.items() for band, k in enumerate(near_dups.order_min_hash(word_hashes(t)).tolist())]
    buckets = spark.createDataFrame(rows, "key long, band int, node long, n_words int")
    frame = spark.createDataFrame(list(texts.items()), "node long, text string")
    got = {r["node"]: r["root"] for r in near_dups.links(buckets, frame).collect()}
    assert got == {i: 0 for i in range(3)}


@pytest.mark.parametrize("block_rows", [1, 3, 128])
def test_op9_blocks_meet_all_pairs(spark, block_rows):
    rng, rows = random.Random(29), []
    base = words(rng, 40)
    for i in range(24):
        text = base[: rng.randint(20, 40)] + words(rng, rng.randint(0, 10))
        rows.append((i, " ".join(edited(rng, text, rng.randint(0, 3)))))
    hashed = {i: word_hashes(t) for i, t in rows}
    keys = {i: set(near_dups.order_min_hash(w).tolist()) for i, w in hashed.items()}
    pairs = [(a, b) for a, b in itertools.combinations(hashed, 2) if keys[a] & keys[b] and similar(hashed[a], hashed[b], 0.8)]
    live = [(k, i, len(hashed[i]), min(i, 20)) for i in keys for k in keys[i]]  # 20 to 23 are linked
    live = spark.createDataFrame(live, "key long, node long, n_words int, root long")
    found = near_dups.remaining(live, spark.createDataFrame(rows, "node long, text string"), block_rows=block_rows).collect()
    linked = [(20, 21), (20, 22), (20, 23)]
    got = [tuple(sorted((r["node"], r["leader"]))) for r in found]
    assert set(got) <= set(pairs) and union(got + linked, hashed) == union(pairs + linked, hashed)


def scattered(rng, words, edits):
    out = words.tolist()
    for _ in range(edits):
        at, kind = rng.integers(len(out)), rng.integers(3)
        if kind == 0:
            out[at] = int(rng.integers(1 << 62))
        elif kind == 1:
            out.insert(at, int(rng.integers(1 << 62)))
        else:
            del out[at]
    return np.array(out, dtype=np.uint64)


@pytest.mark.parametrize("n", [6, 10, 16, 22, 30, 45, 60, 120, 400])
@pytest.mark.parametrize("low, high", [(0.8, 0.85), (0.85, 0.9), (0.9, 1.0)])
def test_similar_texts_share_a_key(n, low, high):
    rng, met = np.random.default_rng(29), []
    for _ in range(150):
        one = rng.integers(0, 1 << 62, n).astype(np.uint64)
        two = scattered(rng, one, int(rng.uniform(1 - high, 1 - low) * n + 1e-9))
        if similar(one, two, low) and not (high < 1 and similar(one, two, high)):
            met.append(bool(np.intersect1d(near_dups.order_min_hash(one), near_dups.order_min_hash(two)).size))
    assert not met or sum(met) / len(met) >= 0.9


def test_occurrence_labels_and_order():
    plain = word_hashes(" ".join(map(str, range(100))))
    assert set(near_dups.kmers(plain, 5)) < set(near_dups.kmers(np.concatenate([plain, plain[:9]]), 5))
    repeated = near_dups.kmers(word_hashes("a b c d e " * 6), 5)
    assert len(set(repeated.tolist())) == len(repeated)
    one, two = (near_dups.order_min_hash(word_hashes(t)) for t in ("a b c d e f g h i j k l", "g h i j k l a b c d e f"))
    assert len(one) == 24 and not np.array_equal(one, two)


def test_op9_recall_by_similarity(spark):
    """Linked pairs of 40 a band: words replaced, inserted and deleted in texts of 12 to 300 words."""
    rng = np.random.default_rng(31)
    rows, bands = [], {}
    for band, (low, high) in enumerate(((0.8, 0.85), (0.85, 0.9), (0.9, 0.99))):
        while len(bands.get(band, ())) < 40:
            n = int(rng.choice([12, 24, 45, 100, 300]))
            one = rng.integers(0, 1 << 62, n).astype(np.uint64)
            two = scattered(rng, one, int(rng.uniform(1 - high, 1 - low) * n))
            if similar(one, two, low) and not similar(one, two, high):
                bands.setdefault(band, []).append(len(rows))
                rows += [(len(rows), " ".join(map(str, one))), (len(rows) + 1, " ".join(map(str, two)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dups.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(sum(got[i + 1] == i for i in ids) >= 0.9 * len(ids) for ids in bands.values()), bands
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_op7_against_a_plain_loop(spark):
    rng = random.Random(7)
    passage = [" ".join(words(rng, 8)) for _ in range(12)]
    rows = []
    for i in range(30):
        own = [" ".join(words(rng, 6)) for _ in range(rng.randint(1, 15))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + passage * (i % 3 == 0) + own[at:])))
    rows += [(40, rows[4][1]), (41, ""), (42, None), (None, rows[4][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_chars int, spans string")
    got = line_dedup.remove_repeats(docs, counts=True)
    first, gone = {}, {}
    versions = sorted({(-1 if i is None else i, t) for i, t in rows if t is not None})
    for i, t in versions:
        lines = t.encode().split(b"\n")
        for start, n in line_dedup.cut(lines):
            if n > 1:
                where = (i, start)
                if first.setdefault(b"\n".join(lines[start : start + n]), where) != where:
                    gone.setdefault((i, t), set()).update(range(start, start + n))
    want = []
    for i, t in rows:
        out = gone.get((-1 if i is None else i, t), set())
        want.append((i, t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in out), len(out)))
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "", r[2])
    assert sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert len(gone) >= 9 and line_dedup.remove_repeats(docs).columns == docs.columns
    assert line_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_op7_boundaries_follow_the_lines(spark):
    rng = random.Random(41)
    lines = [rng.getrandbits(64) for _ in range(400)]
    for divisor in (1, 3, 8):
        ends = line_dedup.boundaries(lines, divisor)
        rolled = [sum(h * pow(line_dedup._FACTOR, j) for j, h in enumerate(reversed(lines[max(0, i - 1) : i + 1]))) % (1 << 64) for i in range(400)]
        assert ends == [i for i, r in enumerate(rolled) if (r >> 17) % divisor == 0]
        assert divisor == 1 and ends == list(range(400)) or 400 / divisor / 2 < len(ends) < 400 / divisor * 2
        shifted = line_dedup.boundaries([5, *lines], divisor)
        assert [e + 1 for e in ends if e > 1] == [e for e in shifted if e > 2]
    texts = [f"line {x}" for x in lines[:60]]
    docs = spark.createDataFrame([(1, "\n".join(texts)), (2, "\n".join(["own", *texts, "end"]))], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.remove_repeats(docs, divisor=4).collect()}
    assert kept[1] == texts and kept[2][0] == "own" and kept[2][-1] == "end" and 2 <= len(kept[2]) < 30


def test_op7_removes_whole_passages(spark):
    rng = random.Random(17)
    long = lambda n: [" ".join(words(rng, 30)) for _ in range(n)]
    passages = [long(2 + i % 3) for i in range(20)]
    rows, want = [], {}
    for i, passage in enumerate(passages):
        for j in range(3):
            head, tail = long(3), long(3)
            rows.append((3 * i + j, "\n".join(head + passage + tail)))
            want[3 * i + j] = "\n".join(head + passage * (j == 0) + tail)
    a, b, c = long(3)
    rows += [(100, "\n".join([a] * 5)), (101, f"{b}\n\n{c}\nx"), (102, f"y\n{b}\n\n{c}\n"), (103, f"{b}\n\nz"), (104, "\n\n\nu"), (105, "\n\n\nv")]
    want |= {100: f"{a}\n{a}", 101: rows[-5][1], 102: "y\n", 103: rows[-3][1], 104: "\n\n\nu", 105: "\n\n\nv"}
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_op1_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows, centres = [], rng.normal(size=(25, 8))
    for i in range(160):
        v = centres[i % 25] + rng.normal(size=8) * rng.choice([0.02, 0.2, 0.6])
        rows.append((i, (v * rng.choice([1.0, 3.0])).tolist(), int(rng.integers(0, 3))))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, None, 1), (203, [0.0] * 8, 1), (204, [float("nan")] * 8, 1), (205, [1.0, None], 1), (206, rows[0][1], None), (207, [], 1), (208, [1.0] * 4, 1)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    pairs = [(a, b) for a, b in itertools.combinations(unit, 2) if label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    want = union(pairs, label)
    for options in ({}, {"cell_rows": 0.5, "block_rows": 5, "placed_rows": 20}, {"cell_rows": 100, "block_rows": 7}):
        got = {r["vec_id"]: r for r in embedding_dups.near_duplicates(frame, **options).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in pairs) for i in label}
        assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert embedding_dups.near_duplicates(frame.limit(0)).count() == 0


def shingles(text):
    parts = text.replace("\n", " ").split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def test_op4_against_exact_sets(spark, corpus):
    rows = [(i, t) for i, t in corpus] + [(500, None), (500, "twice"), (501, "a b c d e " * 400), (502, "日本語" * 100)]
    rows += [(7, f"seven {i}") for i in range(60)] + [(None, f"nothing {i}") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string")
    got = fingerprints.edited_neighbours(docs).collect()
    hashes = {r["text"]: r["h"] for r in docs.na.fill("").select("text", fingerprints.F.xxhash64("text").alias("h")).collect()}
    order = sorted(((-1 if i is None else i, hashes[t or ""], t or "") for i, t in rows), reverse=True)
    order = [(None if i < 0 else i, t) for i, _, t in order]
    bounds, parts = fingerprints.id_bounds(docs, 16)
    assert parts[0] > 1 and max(parts[1:]) > 1 and len(parts) == len(bounds) + 2
    assert len(got) == len(rows)
    found = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    import hashlib

    prints = {}
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1]
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = found[i, hashlib.sha256(edit.encode()).hexdigest()]
        assert r["n_chars"] == len(t)
        for near, other in ((r["near_edited"], edit), (r["near_next"], nxt)):
            a, b = shingles(t), shingles(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.12
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.edited_neighbours(docs.limit(0)).count() == 0


def test_fingerprint_estimates(spark):
    from pyspark.sql import functions as F

    parts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 900), (300, 1300), (0, 1300))]
    df = fingerprints.with_fingerprint(spark.createDataFrame([(0, *parts)], "i int, a string, b string, c string"), "a", "fa")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "b", "fb"), "c", "fc")
    both = fingerprints.merge(F.col("fa"), F.col("fb"))
    r = df.select(fingerprints.resemblance(F.col("fa"), F.col("fb")).alias("j"), fingerprints.containment(F.col("fa"), F.col("fc")).alias("c"), fingerprints.distinct_shingles(both).alias("n"), (both == F.col("fc")).alias("m")).first()
    assert abs(r["j"] - 596 / 1296) < 0.12 and r["c"] > 0.85 and abs(r["n"] - 1296) < 260 and r["m"]
