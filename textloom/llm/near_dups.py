"""Near-duplicate documents by Order MinHash and banded alignment.

A text's k-mers are its runs of five words, each labelled with its occurrence.
For each of 64 hash functions the two smallest labelled k-mers, kept in text
order, make one key; texts agree in a key the likelier the higher their edit
similarity. Five-word runs are too few in short texts, which therefore have keys
of shorter runs (``CLASSES``; a text near a border has both kinds, so that similar
texts always have one kind in common). Texts that share a key are candidates; they
are similar if their word sequences align with 1 - distance / longer length >=
``least``, found exactly within a band.

Exact copies are one node from the start (aggregated before any shuffle). First
each text is aligned with the leaders of its buckets, of a few keys and then of
more, unless links found before connect the two; that joins a large group at a few
alignments a text. Then, in buckets that links do not wholly connect, all texts of
different components meet, block by block: those that share no smaller key, and
whose lengths and words do not rule a link out, are aligned until connected. Links
make components; each keeps the document with the smallest id.

Defined results: a null text is the empty text. Texts without words are linked
only to their exact copies. Rows with equal id and text are one document. Rows
with a null id are kept, with a null component. Extra columns are ignored (kept
by :func:`keep_representatives`); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.alignment import similar
from textloom.llm.common import materialize, release
from textloom.llm.components import components
from textloom.llm.words import word_hashes

#: Word counts of a profile; nodes of a bucket, and their words, that are compared at once; words that a worker keeps.
PROFILE, BLOCK_ROWS, BLOCK_WORDS, KNOWN_WORDS = 512, 256, 200_000, 4_000_000
NO_KEY = np.int64(-(2**63))
#: Words of a text from and to, words of a k-mer, keys.
CLASSES = ((0, 24, 2, 24), (20, 50, 3, 32), (40, 1 << 31, 5, 64))
PICKED, LEAST = 2, 0.8
#: Keys that are met in turn, each with what the ones before have connected.
SLICES = ((0, 2), (2, 8), (8, 1 << 31))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the k-mers in text order, each labelled with its occurrence."""
    k = min(shingle, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        place = np.arange(n)
        occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
        label = np.empty(n, dtype=np.uint64)
        label[order] = occurrence
        h = np.where(label, _mixed(h + label * np.uint64(0xC2B2AE3D27D4EB4F)), h)  # first ones as in texts without repeats
    return h


def _keys(h: np.ndarray, sketches: int, picked: int) -> np.ndarray:
    odd = _mixed(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    size, step = min(picked, len(h)), max(1, (1 << 20) // len(h))
    keys = _mixed(odd)
    for first in range(0, sketches, step):  # few functions at once for long texts
        some = slice(first, first + step)
        hashed = h[None, :] * odd[some, None]
        row, at = np.arange(len(hashed)), np.empty((len(hashed), size), dtype=np.int64)
        for j in range(size):
            at[:, j] = hashed.argmin(axis=1)
            hashed[row, at[:, j]] = np.uint64(2**64 - 1)
        at.sort(axis=1)
        for j in range(size):
            keys[some] = _mixed(keys[some] ^ h[at[:, j]])
    return keys


def order_min_hash(words: np.ndarray, classes: tuple = CLASSES, picked: int = PICKED) -> np.ndarray:
    """The int64 keys of each class of lengths that the text is in; none for a text without words."""
    n = len(words)
    found = [_keys(kmers(words, k), sketches, picked) for low, high, k, sketches in classes if n and low <= n <= high]
    return np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)


def signatures(docs: DataFrame, classes: tuple = CLASSES, picked: int = PICKED) -> DataFrame:
    """doc_id, node (the text's digest), n_words, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, sizes, keys = [], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    words = word_hashes(text)
                    nodes.append(hashlib.md5(text.encode()).digest())
                    sizes.append(len(words))
                    keys.append(order_min_hash(words, classes, picked))
                columns = [part.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n_words", "keys"])

    ready = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ready.mapInArrow(run, "doc_id long, node binary, n_words int, keys array<long>")


def aligned(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """``pairs`` (node, leader) with ``near``; ``texts`` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, last, words = [], None, np.zeros(0, dtype=np.uint64)
            for leader, text, leader_text in zip(batch.column(1), batch.column(2), batch.column(3)):
                if leader.as_py() != last:
                    last, words = leader.as_py(), word_hashes(leader_text.as_py())
                near.append(similar(words, word_hashes(text.as_py()), least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["node", "leader", "near"])

    own = texts.select("node", "text")
    other = texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text"))
    both = pairs.join(own, "node").join(other, "leader").select("node", "leader", "text", "leader_text")
    return both.mapInArrow(run, "node long, leader long, near boolean")


def _shared(rows: DataFrame, what: str) -> DataFrame:
    """The rows (key, ...) whose key has several values of ``what``."""
    several = rows.groupBy("key").agg(F.min(what).alias("lo"), F.max(what).alias("hi")).filter("lo <> hi").select(F.col("key").alias("_key"))
    return rows.join(several, F.col("key") == F.col("_key"), "left_semi")


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with ``root``: of the node's component in the links found so far."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(known, rows["node"] == known["_node"], "left").select(*rows.columns, F.coalesce("_root", "node").alias("root"))


class _Known(dict):
    """Words, keys (one column a class and function) and profile of the texts last met, by node.

    A worker keeps one for its later tasks; ``run`` tells the node numbers of
    different calls apart.
    """

    def __init__(self, run: str, classes: tuple, picked: int):
        super().__init__()
        self.run, self.classes, self.picked, self.size = run, classes, picked, 0

    def add(self, node: int, text: str) -> tuple:
        if node not in self:
            words = word_hashes(text)
            self.size += len(words) + 300
            if self.size > KNOWN_WORDS:
                self.clear()
                self.size = len(words) + 300
            keys = np.full(sum(c[3] for c in self.classes), NO_KEY)
            at = 0
            for c in self.classes:
                found = order_min_hash(words, (c,), self.picked)
                keys[at : at + len(found)] = found
                at += c[3]
            counts = np.bincount((words % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE)
            self[node] = words, keys, np.minimum(counts, 255).astype(np.int16)
        return self[node]

    def block(self, rows: list[dict]) -> dict:
        found = [self.add(r["node"], r["text"]) for r in rows]
        words, keys, profile = zip(*found)
        return {"node": [r["node"] for r in rows], "root": np.array([r["root"] for r in rows]), "n": np.array([len(w) for w in words]), "words": words, "keys": np.stack(keys), "profile": np.stack(profile)}


_known: list[_Known] = []


def known_texts(run: str, classes: tuple, picked: int) -> _Known:
    if not _known or _known[0].run != run:
        _known[:] = [_Known(run, classes, picked)]
    return _known[0]


def block_links(key: int, one: dict, two: dict, least: float) -> Iterator[tuple[int, int]]:
    """Similar pairs that join the components of two blocks of a bucket, or of one.

    All pairs count that are in different components, have ``key`` as the
    smallest they share (so each pair is met in one bucket), and whose lengths and
    profiles allow them to be similar: an edit changes two of a profile's counts
    by one at most, so texts are at least half the sum of the differences apart.
    Those are aligned, nearest profiles first, unless pairs found before connect them.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, (n, root, keys) in enumerate(zip(one["n"], one["root"], one["keys"])):
        mask = (np.minimum(two["n"], n) >= np.maximum(two["n"], n) * least) & (two["root"] != root)
        if two is one:
            mask[: i + 1] = False
        at = np.flatnonzero(mask)
        common = (two["keys"][at] == keys) & (keys != NO_KEY)
        at = at[np.where(common, keys, np.iinfo(np.int64).max).min(axis=1) == key] if len(at) else at
        apart = np.abs(two["profile"][at] - one["profile"][i]).sum(axis=1, dtype=np.int64)
        open_ = apart <= np.maximum(two["n"][at], n) * (2 * (1 - least)) + 1e-9
        for j in at[open_][np.argsort(apart[open_], kind="stable")]:
            a, b = find(int(root)), find(int(two["root"][j]))
            if a != b and similar(one["words"][i], two["words"][j], least):
                parent[max(a, b)] = min(a, b)
                yield one["node"][i], two["node"][j]


def remaining(live: DataFrame, texts: DataFrame, classes: tuple = CLASSES, picked: int = PICKED, least: float = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node, leader of similar pairs that join the components in each bucket of ``live`` (key, node, n_words, root).

    A bucket of more than ``block_rows`` nodes is cut by lengths, of which only
    neighbouring ones can be similar, and by hash. Pairs of blocks are met, but
    for those of the bucket's largest component with each other.
    """

    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_texts(call, classes, picked)
        for batch in batches:
            found = []
            for key, rows, others in zip(*(batch.column(i) for i in range(3))):
                one = known.block(rows.as_py())
                two = one if others.as_py() is None else known.block(others.as_py())
                found += block_links(key.as_py(), one, two, least)
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "leader"])

    by_root = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    main = by_root.agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    main = main.select(F.col("key").alias("_key"), F.col("main.root").alias("main"), (F.col("n") > block_rows).alias("large"))
    span = F.floor(F.log(F.greatest("n_words", F.lit(1))) / math.log(1.0001 / least)).cast("int")
    cut = live.join(main, F.col("key") == F.col("_key")).select("key", "node", "root", "n_words", F.when(F.col("large"), span).otherwise(0).alias("span"), (F.col("large") & (F.col("root") == F.col("main"))).alias("main"))
    cut = materialize(cut, "near-cut")
    sizes = cut.groupBy("key", "span", "main").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n_words") / BLOCK_WORDS)).alias("parts"))
    sizes = sizes.select(F.struct("key", "span", "main").alias("_cut"), "parts")
    dealt, cut = cut, cut.join(sizes, (F.struct("key", "span", "main") == F.col("_cut"))).withColumn("part", F.pmod(F.xxhash64("key", "node"), F.col("parts")))
    cut = cut.join(texts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    cut = cut.groupBy("key", "span", "main", "part").agg(F.collect_list(F.struct("node", "root", "text")).alias("rows"))
    cut = materialize(cut, "near-blocks")
    place = F.struct("span", "main", "part").alias("place")
    two = cut.filter("not main").select(F.col("key").alias("_key"), place.alias("_place"), F.col("rows").alias("others"))
    order = F.when(F.col("main"), F.abs(F.col("span") - F.col("_place.span")) <= 1).otherwise((place < F.col("_place")) & (F.col("_place.span") - F.col("span") <= 1))
    crossed = cut.join(two, (F.col("key") == F.col("_key")) & order).select("key", "rows", "others")
    alone = cut.filter("not main").select("key", "rows", F.lit(None).cast(two.schema["others"].dataType).alias("others"))
    found = materialize(alone.unionByName(crossed).mapInArrow(run, "node long, leader long"), "near-rest")
    release(cut, dealt)
    return found


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` of one key of each set of nodes; keys with the same nodes say the same."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    sets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *marks).filter("size > 1")
    kept = sets.groupBy("size", "mark1", "mark2").agg(F.min("key").alias("_key")).select("_key")
    return rows.join(kept, F.col("key") == F.col("_key"), "left_semi")


def links(buckets: DataFrame, texts: DataFrame, classes: tuple = CLASSES, picked: int = PICKED, least: float = LEAST) -> DataFrame:
    """node, root of the nodes that similar pairs connect.

    ``buckets`` (key, band, node, n_words) are met in slices of bands with one
    leader a bucket. Buckets whose nodes are all connected by then are dropped. In
    the others all nodes stay, as a node unlike the leader may be similar to one
    connected with it, and all pairs of different components are met.
    """
    near: DataFrame | None = None
    known: DataFrame | None = None
    roots: DataFrame | None = None

    def connect(found: DataFrame) -> None:
        nonlocal near, roots
        near = found if near is None else near.unionByName(found)
        if found.limit(1).count():
            roots = components(near.select(F.col("node").alias("src"), F.col("leader").alias("dst")))

    def living(rows: DataFrame) -> DataFrame:
        rooted = materialize(_rooted(rows, roots), "near-rooted")
        live = materialize(_shared(rooted, "root"), "near-live")
        release(rooted)
        return live

    rest: list[DataFrame] = []
    for low, high in SLICES:
        live = living(buckets.filter((F.col("band") >= low) & (F.col("band") < high)).drop("band"))
        lead = live.groupBy("key").agg(F.min(F.struct("node", "n_words", "root")).alias("lead"))
        lead = lead.select(F.col("key").alias("_key"), F.col("lead.node").alias("leader"), F.col("lead.n_words").alias("_n"), F.col("lead.root").alias("_root"))
        lead = materialize(lead, "near-leaders", small=True)
        alike = F.least("n_words", "_n") >= F.greatest("n_words", "_n") * least
        open_pair = (F.col("key") == F.col("_key")) & (F.col("root") != F.col("_root")) & alike
        # Of several leaders of one component one is tried; the last part meets the others.
        fresh = live.join(lead, open_pair).groupBy("node", "_root").agg(F.min("leader").alias("leader")).select("node", "leader").distinct()
        if known is not None:
            fresh = fresh.join(known, ["node", "leader"], "left_anti")
        met = materialize(aligned(fresh, texts, least), "near-aligned")
        known = met if known is None else known.unionByName(met)
        connect(met.filter("near").select("node", "leader"))
        release(lead)
        rest.append(live.drop("root"))
    live = living(_distinct_buckets(functools.reduce(DataFrame.unionByName, rest)))
    if live.limit(1).count():
        connect(remaining(live, texts, classes, picked, least))
    return buckets.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def groups(docs: DataFrame, classes: tuple = CLASSES, picked: int = PICKED, least: float = LEAST) -> DataFrame:
    """doc_id, digest (of the text), n_words, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = materialize(signatures(docs, classes, picked).withColumnRenamed("node", "digest"), "near-signatures")
    nodes = signed.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    nodes = materialize(nodes.select(F.col("digest").alias("_digest"), "first_id", F.monotonically_increasing_id().alias("node")), "near-nodes", small=True)
    one_each = signed.join(nodes, (signed["doc_id"] == nodes["first_id"]) & (signed["digest"] == nodes["_digest"]))
    exploded = one_each.select("node", "n_words", F.posexplode("keys").alias("band", "key"))
    exploded = materialize(exploded, "near-keys")
    buckets = materialize(_shared(exploded, "node").distinct(), "near-buckets")
    release(exploded)
    wanted = buckets.select(F.col("node").alias("_wanted")).distinct()
    wanted = nodes.join(wanted, F.col("node") == F.col("_wanted")).select("first_id", "_digest", "node")
    texts = docs.withColumn("digest", F.unhex(F.md5("text"))).join(wanted, (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("_digest")))
    texts = materialize(texts.groupBy("doc_id", "digest").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "near-texts")
    found = links(buckets, texts, classes, picked, least)
    linked = found.join(nodes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).select("node", "root", "first_id")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lowest = materialize(lowest.select(F.col("root").alias("_root"), "component_id"), "near-lowest", small=True)
    linked = linked.join(lowest, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component_id")
    named = nodes.join(linked, F.col("node") == F.col("_node"), "left").select("_digest", F.coalesce("component_id", "first_id").alias("component_id"))
    named = materialize(named, "near-named", small=True)
    release(buckets, texts, nodes)
    out = signed.join(named, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "digest", "n_words", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each group, with all their columns."""
    gone = groups(docs, **options).filter("not kept").select(F.struct("doc_id", "digest").alias("gone"))
    gone = materialize(gone.distinct(), "near-gone", small=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    digest = F.unhex(F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    same = (F.col("row.doc_id").cast("long") == F.col("gone.doc_id")) & (digest == F.col("gone.digest"))
    return rows.join(gone, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
