"""Learned segmenters over distinct words, and simple classifiers.

Learners see (word, freq) tables, never running text. Merge learning reads one
row a distinct word and counts pairs in numpy blocks; only the most frequent pairs
of a round, a bounded list, reach the driver.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.functions.text import characters
from textloom.sources.scratch import forget, saved


#: Most frequent pairs that are looked at in one round.
ROUND_PAIRS = 1000


def safe_merges(pairs: list[tuple[str, str, int]], symbols: set[str], most: int, join: Callable[[str, str], str]) -> list[tuple[str, str]]:
    """How many of the most frequent pairs (a, b, n), in order, merge at once as they would one after another.

    A merge changes only counts of pairs that share a symbol with it, and makes
    pairs no more frequent than those were. So the next pair follows as long as
    no pair as frequent or more shares a symbol with the merges before it. A merge
    that makes a known symbol ends the round.
    """
    out: list[tuple[str, str]] = []
    dirty: set[str] = set()
    for at, (a, b, n) in enumerate(pairs):
        tied = [p for p in pairs[at:] if p[2] == n]
        cut = len(pairs) == ROUND_PAIRS and pairs[-1][2] == n
        if out and (cut or any({x, y} & dirty for x, y, _ in tied)):
            break
        out.append((a, b))
        dirty |= {a, b}
        if len(out) == most or join(a, b) in symbols:
            break
        symbols.add(join(a, b))
    return out


#: Words whose pairs are counted at once.
PART_WORDS = 1 << 18


class Symbols:
    """Numbers of symbols: characters by code point, inner ones (``marker`` before them) after those, then merged ones."""

    POINTS = 0x110000

    def __init__(self, merges: list[tuple[str, str]], join: Callable[[str, str], str], marker: str = ""):
        self.marker, self.names = marker, {}
        self.merges = [(self.number(a), self.number(b), self.number(join(a, b))) for a, b in merges]

    def number(self, symbol: str) -> int:
        bare = symbol.removeprefix(self.marker) if self.marker and len(symbol) > len(self.marker) else symbol
        if len(bare) == 1:
            return ord(bare) + self.POINTS * (bare != symbol)
        return self.names.setdefault(symbol, 2 * self.POINTS + len(self.names))

    def name(self, number: int) -> str:
        if number < 2 * self.POINTS:
            return self.marker * (number >= self.POINTS) + chr(number % self.POINTS)
        return list(self.names)[number - 2 * self.POINTS]

    def spelled(self, words: pa.Array) -> np.ndarray:
        """The symbols of all words after the merges, each word behind a -1."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.full(int(sizes.sum()) + len(sizes), -1, dtype=np.int32)
        inside = np.ones(len(points), dtype=bool)
        inside[np.cumsum(sizes + 1) - sizes - 1] = False
        points[inside] = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.int32)
        if self.marker:
            points[1:][inside[1:] & inside[:-1]] += self.POINTS
        for a, b, whole in self.merges:
            at = np.flatnonzero(points[:-1] == a)
            at = at[points[at + 1] == b]
            if a == b and len(at):  # from the left: every second of a run
                start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))) % 2 == 0]
            if len(at):
                points[at] = whole
                kept = np.ones(len(points), dtype=bool)
                kept[at + 1] = False
                points = points[kept]
        return points

    def pairs(self, words: pa.Array, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair of neighbours of the spelled words as one number, and its words' summed ``freq``."""
        points = self.spelled(words)
        word = np.cumsum(points < 0) - 1
        at = np.flatnonzero((points[:-1] >= 0) & (points[1:] >= 0))
        there = np.zeros(2 * self.POINTS + len(self.names), dtype=bool)
        there[points[at]], there[points[at + 1]] = True, True
        used = np.flatnonzero(there)
        place = np.zeros(len(there), dtype=np.int64)
        place[used] = np.arange(len(used))
        code, own = place[points[at]] * len(used) + place[points[at + 1]], freq[word[at]]
        if len(used) ** 2 <= 1 << 22 and float(np.abs(own).astype(float).sum()) < 2.0**52:  # whole numbers are exact in doubles
            sums = np.bincount(code, own, len(used) ** 2).astype(np.int64)
            every = np.flatnonzero(np.bincount(code, minlength=len(used) ** 2))
            sums = sums[every]
        else:
            every, back = np.unique(code, return_inverse=True)
            sums = np.zeros(len(every), dtype=np.int64)
            np.add.at(sums, back, own)
        n = max(1, len(used))
        return (used[every // n] << 32) | used[every % n], sums


def pair_counts(counts: DataFrame, merges: list[tuple[str, str]], join: Callable[[str, str], str], marker: str = "") -> DataFrame:
    """a, b, n: neighbouring symbols of (word, freq) after ``merges``, each summed within its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(merges, join, marker)
        pairs, sums = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def add(table: pa.Table) -> None:
            nonlocal pairs, sums
            table = table.combine_chunks()
            own, freq = symbols.pairs(table.column("word").combine_chunks(), table.column("freq").to_numpy())
            every, at = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            total = np.zeros(len(every), dtype=np.int64)
            np.add.at(total, at, np.concatenate([sums, freq]))
            pairs, sums = every, total

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PART_WORDS:
                add(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            add(pa.Table.from_batches(held))
        name = {int(i): symbols.name(int(i)) for i in np.unique(np.concatenate([pairs >> 32, pairs & 0xFFFFFFFF]))}
        for i in range(0, len(pairs), 1 << 16):
            some = pairs[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([name[int(x)] for x in some >> 32]), pa.array([name[int(x)] for x in some & 0xFFFFFFFF]), pa.array(sums[i : i + (1 << 16)])], ["a", "b", "n"])

    found = counts.select("word", F.col("freq").cast("long")).mapInArrow(run, "a string, b string, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _learn(counts: DataFrame, merges: int, join: Callable[[str, str], str], least: int = 1, marker: str = "", room: bool = False) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges of the words of (word, freq), and the characters they start from; with ``room`` both are ``merges`` together.

    Words are read anew each round and spelled by the merges so far, in blocks of
    numbers; nothing is written but the words, once.
    """
    words = saved(counts.select("word", "freq"), "words")
    rest = F.expr("substring(word, 2)")
    chars = words.select(F.explode(F.array_distinct(F.concat(characters(F.substring("word", 1, 1)), F.transform(characters(rest), lambda c: F.concat(F.lit(marker), c))))))
    first = sorted(r[0] for r in bounded(chars.distinct()))
    symbols = set(first)
    merges = max(0, merges - len(first)) if room else merges
    found: list[tuple[str, str]] = []
    while len(found) < merges:
        pairs = pair_counts(words, list(found), join, marker).filter(F.col("n") >= least)
        best = [(r["a"], r["b"], r["n"]) for r in pairs.orderBy(F.desc("n"), "a", "b").limit(ROUND_PAIRS).collect()]
        some = safe_merges(best, symbols, merges - len(found), join)
        if not some:
            break
        found += some
    forget(words)
    return found, first


def merged(segs: list[str], wanted: dict[tuple[str, str], str]) -> list[str]:
    """``segs`` with each adjacent wanted pair, from the left, joined."""
    out, at = [], 0
    while at < len(segs):
        whole = wanted.get(tuple(segs[at : at + 2]))
        out.append(segs[at] if whole is None else whole)
        at += 1 if whole is None else 2
    return out


def learn_merges(counts: DataFrame, merges: int) -> tuple[list[tuple[str, str]], DataFrame]:
    """The first ``merges`` BPE merges of (word, freq), and word, freq, segs after them.

    Ties go to the smaller pair. Several merges that cannot affect each other are
    made in one round; the result is that of one at a time.
    """
    found, _ = _learn(counts, merges, str.__add__)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            segs = [list(word) for word in batch["word"]]
            for a, b in found:
                segs = [merged(s, {(a, b): a + b}) if a in s else s for s in segs]
            yield batch.assign(segs=segs)

    kinds = counts.select("word", "freq", characters(F.col("word")).alias("segs")).schema
    return found, counts.select("word", "freq").mapInPandas(run, kinds)


def plain_words(counts: DataFrame) -> DataFrame:
    """word, freq in canonical decomposition and lower case, without accents; counts of equal ones summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = ["".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFD", w).lower()) if unicodedata.category(c) != "Mn") for w in batch["word"]]
            yield batch.assign(word=words)

    plain = counts.select("word", "freq").mapInPandas(run, "word string, freq long")
    return plain.filter("word <> ''").groupBy("word").agg(F.sum("freq").alias("freq"))


def learn_wordpiece(counts: DataFrame, size: int, least: int = 2, marker: str = "##") -> DataFrame:
    """token, id of a WordPiece vocabulary: the unknown token, characters, then merges, up to ``size``.

    Words are :func:`plain_words`; pieces inside a word carry ``marker``; pairs
    under ``least`` are not merged. :func:`longest_match` encodes with it.
    """
    join = lambda a, b: a + b.removeprefix(marker)
    # As many merges as there is room beside the unknown token; the characters take some of it.
    merges, first = _learn(plain_words(counts), size - 1, join, least, marker, room=True)
    tokens = list(dict.fromkeys(["[UNK]", *first, *(join(*p) for p in merges)]))[:size]
    return counts.sparkSession.createDataFrame(list(enumerate(tokens)), "id int, token string").select("token", "id")


def apply_merges(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """word, segs of distinct words under learned merges, by rank; once a distinct word."""
    rank = {p: i for i, p in enumerate(merges)}

    def segment(word: str) -> list[str]:
        segs = list(word)
        while len(segs) > 1:
            best = min(range(len(segs) - 1), key=lambda i: rank.get((segs[i], segs[i + 1]), math.inf))
            pair = (segs[best], segs[best + 1])
            if pair not in rank:
                break
            out, i = [], 0
            while i < len(segs):
                if i + 1 < len(segs) and (segs[i], segs[i + 1]) == pair:
                    out.append(segs[i] + segs[i + 1])
                    i += 2
                else:
                    out.append(segs[i])
                    i += 1
            segs = out
        return segs

    return segment_words(words, segment)


def segment_words(words: DataFrame, segment: Callable[[str], list[str]], cache: bool = True) -> DataFrame:
    """word, segs, failed by any callable, once for each distinct word, in Arrow batches.

    A word on which the callable fails is its own single piece, marked as failed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word in batch["word"]:
                try:
                    out.append((word, list(segment(word)), False))
                except Exception:  # an external segmenter may fail in any way
                    out.append((word, [word], True))
            yield pd.DataFrame(out, columns=["word", "segs", "failed"])

    return words.select("word").distinct().mapInPandas(run, "word string, segs array<string>, failed boolean")


#: Entries of a vocabulary or lexicon that is broadcast.
MOST_ENTRIES = 2_000_000


def bounded(entries: DataFrame, most: int = MOST_ENTRIES) -> list:
    """The rows of a vocabulary on the driver; an error if there are more than ``most``."""
    found = entries.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} entries")
    return found


def longest_match(pieces: DataFrame, words: DataFrame, marker: str = "##", longest: int = 30) -> DataFrame:
    """word, segs by greedy longest match; a word with a gap is ['[UNK]'].

    ``pieces`` has token (inner ones with ``marker``), a bounded vocabulary.
    """
    shared = words.sparkSession.sparkContext.broadcast(frozenset(r["token"] for r in bounded(pieces.select("token").distinct())))

    def segment(word: str) -> list[str]:
        known, out, at = shared.value, [], 0
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                piece = (marker if at else "") + word[at:end]
                if piece in known:
                    out.append(piece)
                    at = end
                    break
            else:
                return ["[UNK]"]
        return out

    return segment_words(words, segment).drop("failed")


def segment_costs(segments: DataFrame) -> DataFrame:
    """token, cost: -ln of each segment's share of (segment, freq)."""
    total = segments.agg(F.sum("freq").alias("total"))
    return segments.crossJoin(F.broadcast(total)).select(F.col("segment").alias("token"), (-F.log(F.col("freq") / F.col("total"))).alias("cost"))  # one row


def cheapest_path(costs: DataFrame, words: DataFrame, unknown: float = 20.0, longest: int = 30) -> DataFrame:
    """word, segs of least total cost (Viterbi); unlisted single characters cost ``unknown``.

    Ties go to the longer last piece. ``costs`` is a bounded lexicon.
    """
    shared = words.sparkSession.sparkContext.broadcast({r["token"]: r["cost"] for r in bounded(costs.select("token", "cost"))})

    def segment(word: str) -> list[str]:
        cost, best = shared.value, [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - longest), end):
                own = cost.get(word[start:end], unknown if end - start == 1 else None)
                if own is not None:
                    options.append((best[start][0] + own, start))
            best.append(min(options))
        out, at = [], len(word)
        while at:
            out.append(word[best[at][1] : at])
            at = best[at][1]
        return out[::-1]

    return segment_words(words, segment).drop("failed")


def learn_unigram(counts: DataFrame, size: int, longest: int = 8, rounds: int = 3, min_freq: int = 2) -> DataFrame:
    """token, cost of a unigram lexicon by a few rounds of hard EM over (word, freq).

    Starts from the most frequent substrings and all characters; each round
    segments by least cost, recounts and keeps the ``size`` best.
    """
    n = F.length("word")
    spans = F.explode(F.sequence(F.lit(1), n)).alias("at")
    starts = counts.select("word", "freq", spans)
    subs = starts.select("freq", "at", "word", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("at") + 1))).alias("len"))
    pieces = subs.select(F.substring(F.col("word"), F.col("at"), F.col("len")).alias("segment"), "freq").groupBy("segment").agg(F.sum("freq").alias("freq"))
    pieces = saved(pieces, "pieces")
    single = F.length("segment") == 1
    seeds = pieces.filter(single | (F.col("freq") >= min_freq)).orderBy(F.desc(F.col("freq") * F.length("segment")), "segment").limit(4 * size)
    lexicon = segment_costs(seeds.unionByName(pieces.filter(single)).distinct())
    return refine_unigram(lexicon, counts, size, longest, rounds)


def refine_unigram(costs: DataFrame, counts: DataFrame, size: int, longest: int = 8, rounds: int = 1) -> DataFrame:
    """token, cost after further rounds from a lexicon (token, cost) on (word, freq).

    The online form of :func:`learn_unigram`: as words arrive, their merged counts
    (see ``streams.merge_counts``) refine the lexicon that is there. Characters
    that are new to it join it; all characters stay.
    """
    chars = counts.select(F.explode(characters(F.col("word"))).alias("segment"), "freq").groupBy("segment").agg(F.sum("freq").alias("freq"))
    for _ in range(rounds):
        segs = cheapest_path(costs, counts, longest=longest).join(counts, "word")
        used = segs.select(F.explode("segs").alias("segment"), "freq").groupBy("segment").agg(F.sum("freq").alias("freq"))
        kept = used.orderBy(F.desc("freq"), "segment").limit(size)
        rest = chars.join(kept.select("segment"), "segment", "left_anti")
        costs = segment_costs(saved(kept.unionByName(rest), "lexicon"))
    return costs


def linear_probe(rows: DataFrame, label: str, vector: str, fold: str = "fold", balanced: bool = False) -> DataFrame:
    """fold, n, correct of a logistic probe fitted on the other folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    weight = F.lit(1.0)
    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), fold)
    if balanced:
        sizes = data.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        data = data.join(F.broadcast(sizes), "label")  # one row a class
        weight = 1.0 / F.col("_n")
    data = data.withColumn("weight", weight).select("label", "features", fold, "weight")
    out = None
    for k in sorted(r[0] for r in data.select(fold).distinct().collect()):  # a handful of folds
        model = LogisticRegression(maxIter=50, regParam=0.01, weightCol="weight").fit(data.filter(F.col(fold) != k))
        hit = (F.col("prediction") == F.col("label")).cast("int")
        part = model.transform(data.filter(F.col(fold) == k)).agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"))
        out = part if out is None else out.unionByName(part)
    return out


def word_vectors(sentences: DataFrame, size: int = 64, window: int = 5, min_count: int = 5, seed: int = 42) -> DataFrame:
    """word, vector by skip-gram over an array column ``words``."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="words", outputCol="out").fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def masked_positions(words: DataFrame, keys: list[str], percent: int = 20, seed: int = 42) -> DataFrame:
    """``words`` with ``masked``: a seeded share of the positions."""
    return words.withColumn("masked", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(100)) < percent)

