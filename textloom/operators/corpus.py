"""Lines, cleaning, deduplication, splits and statistics of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import SPACE, LETTERS, characters, collapse_space, line_key, split_words
from textloom.operators.ranking import exact_split, first_per_key

# The cleaner's default function words and patterns.
STOPWORDS = (
    "ve", "bir", "bu", "da", "de", "ki", "ile", "için", "çok", "daha", "en", "gibi", "ama", "ya", "veya", "ne", "şu",
    "her", "hem", "ise", "ancak", "çünkü", "kadar", "sonra", "önce", "olarak", "olan", "var", "yok", "değil", "mi",
    "mı", "mu", "mü", "ben", "sen", "biz", "siz", "onlar", "bütün", "olduğu", "olduğunu", "tarafından", "arasında",
    "üzerine", "göre", "değildir",
)
MARKUP = r"https?://|www\.|\[\[|\]\]|\{\{|\}\}|\||={2,}|&[a-z]+;|<[^>]+>"
REFERENCES = r"\[\d+\]|\[düzenle\]|\[kaynak belirtilmeli\]"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line cleaner; alphabet and function words name its language."""

    min_chars: int = 30
    max_chars: int = 600
    max_token: int = 34
    min_tokens: int = 3
    min_letters: float = 0.92
    max_other: float = 0.20
    max_foreign: float = 0.02
    alphabet: str = LETTERS
    foreign: str = "qwx"
    stopwords: tuple[str, ...] = STOPWORDS


def document_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, line: trimmed lines that are not blank."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    trimmed = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return lines.withColumn("line", trimmed).filter(F.col("line") != "")


def cleaned_line(line: Column) -> Column:
    return collapse_space(F.regexp_replace(line, REFERENCES, ""))


def reject_reason(c: Column, rules: LineRules = LineRules()) -> Column:
    """Name of the first rule that the cleaned line ``c`` breaks, or null."""
    return first_broken(c, F.lower(c), split_words(c), rules)


def characters_of(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are in ``chars``, the inside of a character class."""
    if set(chars) & set(r"\-[]^&"):
        return F.length(F.regexp_replace(c, f"[^{chars}]", ""))
    # A class of letters beyond Latin-1 tries one after another for each character; this looks each up.
    return F.length(c) - F.length(F.translate(c, chars, ""))


def first_broken(c: Column, low: Column, tokens: Column, rules: LineRules) -> Column:
    """As :func:`reject_reason`, of a line whose lower case and words are given."""
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    inside, foreign = characters_of(low, rules.alphabet), characters_of(low, rules.foreign)
    other = F.length(F.regexp_replace(F.regexp_replace(c, SPACE, ""), r"[\p{L}]", ""))
    checks = [
        ("length", ~F.length(c).between(rules.min_chars, rules.max_chars)),
        ("markup", F.regexp_like(c, F.lit(MARKUP))),
        ("few_tokens", F.size(tokens) < rules.min_tokens),
        ("long_token", F.exists(tokens, lambda t: F.length(t) > rules.max_token)),
        ("no_letters", letters == 0),
        ("alphabet", inside / F.greatest(letters, F.lit(1)) < rules.min_letters),
        ("foreign", foreign / F.greatest(letters, F.lit(1)) > rules.max_foreign),
        ("other_chars", other / F.greatest(F.length(c), F.lit(1)) > rules.max_other),
        ("no_stopword", ~F.arrays_overlap(split_words(low), F.array(*map(F.lit, rules.stopwords)))),
    ]
    out = F.lit(None).cast("string")
    for name, broken in reversed(checks):
        out = F.when(broken, name).otherwise(out)
    return out


def clean_lines(lines: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``lines`` with the cleaned line and ``reason`` (null where it is kept)."""
    # Each step is a row of its own array: what several rules use is then computed once, not written into each of them.
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    cleaned = once(lines.withColumnRenamed("line", "_line"), line=cleaned_line(F.col("_line")))
    parted = once(cleaned, _low=F.lower("line"), _tokens=split_words(F.col("line")))
    reason = first_broken(F.col("line"), F.col("_low"), F.col("_tokens"), rules)
    return once(parted, reason=reason).select(*lines.columns, "reason")


def dedup_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """The first line of each md5 prefix."""
    return first_per_key(lines, line_key(F.col("line")), order)


def split_lines(lines: DataFrame, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    return exact_split(lines, ["doc_id", "line_no"], ratio, seed)


def corpus_stats(lines: DataFrame) -> DataFrame:
    """Lines, words, characters (with joining blanks), distinct words and bytes, in one row."""
    words = split_words(F.col("line"))
    sums = lines.agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size(words)).alias("words"),
        (F.sum(F.length("line")) + F.count(F.lit(1)) - 1).alias("chars"), F.sum(F.octet_length("line")).alias("bytes"),
    )
    distinct = lines.select(F.explode(words).alias("word")).distinct().agg(F.count(F.lit(1)).alias("distinct_words"))
    return sums.crossJoin(distinct)  # one row each


def char_histogram(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(characters(F.col("line"))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def word_extremes(lines: DataFrame) -> DataFrame:
    """Mean length of words, and the longest (ties: the smallest)."""
    words = lines.select(F.explode(split_words(F.col("line"))).alias("word"))
    size = F.length("word")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    mean = (F.sum(size * F.col("n")) / F.sum("n")).alias("mean_length")
    longest = counted.agg(F.max(size).alias("longest_length"), mean)
    return counted.join(F.broadcast(longest), size == F.col("longest_length")).agg(F.min("word").alias("longest_word"), F.first("longest_length").alias("longest_length"), F.first("mean_length").alias("mean_length"))


def counted_chars(lines: DataFrame, order: list[str], most: int | None = None) -> DataFrame:
    """Characters of the first ``most`` lines."""
    lines = lines.orderBy(*order).limit(most) if most else lines
    return lines.agg(F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("chars"))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id and text without tags and scripts."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return pages.select("page_id", collapse_space(F.regexp_replace(body, r"<[^>]+>", " ")).alias("text"))
