"""Column builders for segmentations: arrays of a word's pieces and their boundaries.

A boundary is the number of characters before a cut. Empty pieces count as
pieces (they add a boundary at their place) unless ``drop_empty`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.text import harden, tr_lower


def _ints() -> Column:
    return F.array().cast("array<int>")


def boundaries(segs: Column, drop_empty: bool = False) -> Column:
    """Running lengths of all pieces but the last."""
    segs = F.filter(segs, lambda s: s != "") if drop_empty else segs
    head = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    return F.transform(head, lambda s, i: F.aggregate(F.slice(segs, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)))


def boundary_set(segs: Column) -> Column:
    return F.array_sort(F.array_distinct(boundaries(segs)))


def from_boundaries(word: Column, cuts: Column) -> Column:
    """The pieces of ``word`` between sorted inner cuts."""
    inner = F.array_sort(F.array_distinct(F.filter(cuts, lambda b: (b > 0) & (b < F.length(word)))))
    starts, ends = F.concat(F.array(F.lit(0)), inner), F.concat(inner, F.array(F.length(word)))
    return F.zip_with(starts, ends, lambda a, b: F.substring(word, a + 1, b - a))


def from_probabilities(word: Column, probabilities: Column, threshold: float = 0.5) -> Column:
    """Pieces cut after every character whose probability is above ``threshold``."""
    cuts = F.transform(probabilities, lambda p, i: F.when(p > threshold, i + 1))
    return from_boundaries(word, F.filter(cuts, lambda b: b.isNotNull()))


def every(word: Column, n: int) -> Column:
    """Pieces of ``n`` characters, the rule-based stand-in for a learned segmenter."""
    count = F.ceil(F.length(word) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(word, i * n + 1, F.lit(n)))


def with_suffix(word: Column, suffixes: list[str]) -> Column:
    """Root and longest of the suffixes that leaves a root of two characters or more."""
    out = F.array(word)
    for s in sorted(suffixes, key=lambda s: (len(s), s)):
        cut = F.length(word) - len(s)
        out = F.when(word.endswith(s) & (cut >= 2), F.array(F.substring(word, F.lit(1), cut), F.lit(s))).otherwise(out)
    return out


def labels(cuts: Column, size: int = 31) -> Column:
    """0/1 for each position below ``size``: whether a boundary lies there."""
    # An array of one binds the cuts, which each position would compute again.
    return F.get(F.transform(F.array(cuts), lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(own, i).cast("int"))), F.lit(0))


def confidence(segs: Column, word: Column) -> Column:
    """1 for an unsegmented word, else its mean piece length over 4, within 0.3 and 1."""
    mean = F.length(word) / F.size(segs)
    return F.when(F.size(segs) <= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.3), mean / 4.0)))


def correct_root(label: Column, root_end: Column, word: Column, size: int = 31) -> Column:
    """No labels before the root's end, where that is itself a boundary inside the word."""
    applies = root_end.isNotNull() & (root_end < F.length(word)) & (root_end <= size - 2) & (F.get(label, root_end) == 1)
    return F.when(applies, F.transform(label, lambda x, i: F.when((i >= 1) & (i < root_end), F.lit(0)).otherwise(x))).otherwise(label)


def piped(segs: Column) -> Column:
    return F.array_join(segs, " | ")


def root_is_prefix(segs: Column, root: Column) -> Column:
    """Whether some run of leading pieces is the root, hardened alike."""
    runs = F.transform(segs, lambda s, i: F.array_join(F.slice(segs, F.lit(1), i + 1), ""))
    hit = F.exists(runs, lambda r: (F.length(r) <= F.length(root)) & (harden(r) == harden(root)))
    return F.coalesce(hit & (F.length(root) > 0), F.lit(False))


def root_in(segs: Column, root: Column) -> Column:
    return F.coalesce(F.exists(segs, lambda s: harden(s) == harden(root)), F.lit(False))


def first_is_root(segs: Column, root: Column) -> Column:
    return F.coalesce(harden(F.get(segs, F.lit(0))) == harden(root), F.lit(False))


def gold_parts(*parts: Column) -> Column:
    """The gold morphemes that are there: not null, empty or 'nan'."""
    return F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "") & (F.lower(p) != "nan"))


def marked(segs: Column, marker: str) -> Column:
    """The pieces with the word marker before the first."""
    return F.transform(segs, lambda s, i: F.when(i == 0, F.concat(F.lit(marker), s)).otherwise(s))


def feature_count(features: Column, structural: list[str]) -> Column:
    """How many features are not structural; repeats count."""
    return F.size(F.filter(features, lambda f: ~f.isin(structural)))


def overlaps(gold: Column, predicted: Column) -> Column:
    """struct(matched, n_gold, n_predicted) of two boundary arrays."""
    return F.struct(F.size(F.array_intersect(gold, predicted)).alias("matched"), F.size(gold).alias("n_gold"), F.size(predicted).alias("n_predicted"))


def confusion(gold: Column, predicted: Column, word: Column) -> Column:
    """struct(tp, fp, fn, tn) over all inner positions of the word."""
    tp = F.size(F.array_intersect(gold, predicted))
    fp, fn = F.size(F.array_except(predicted, gold)), F.size(F.array_except(gold, predicted))
    inner = F.greatest(F.length(word) - 1, F.lit(0))
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (inner - tp - fp - fn).alias("tn"))


def lower(segs: Column) -> Column:
    return F.transform(segs, tr_lower)
