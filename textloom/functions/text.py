"""Column builders for text: locale-aware case, words, cleaners, characters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_CHARS = r"\p{L}\p{N}_"
SPACE = r"(?U)\s+"
MARKER = "▁"  # stands before a word's first piece

# The alphabet whose characters have ids, in id order.
LETTERS = "abcçdefgğhıijklmnoöprsştuüvyz"
CHARACTERS = LETTERS + "0123456789" + " .,!?;:'\"-()[]{}/@#%&*+=<>~`^_\\" + "\n\t"
PAD_ID, UNK_ID, BOS_ID, EOS_ID, CHAR_OFFSET = 0, 1, 2, 3, 4

#: Lower and upper length of a cleaned word, by cleaner.
CLEANERS = {"tokens": (1, 30), "letters": (2, 30), "harvest": (1, 40)}


def tr_lower(c: Column) -> Column:
    """Lower case with Turkish dotted and dotless i."""
    return F.lower(F.translate(c, "İI", "iı"))


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def split_words(c: Column) -> Column:
    """Words between Unicode white space, without empty ones; null gives none."""
    return F.coalesce(F.filter(F.split(c, SPACE), lambda w: w != ""), F.array().cast("array<string>"))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_word(c: Column, kind: str = "letters") -> Column:
    """A word without its punctuation, or null if the cleaner rejects it.

    tokens: 1-30 word characters, digits kept. letters: digits go too, then 2-30
    letters. harvest: 1-40 word characters, Turkish lower case.
    """
    low, high = CLEANERS[kind]
    word = F.regexp_replace(c, f"[^{WORD_CHARS}]", "")
    if kind == "letters":
        word = F.regexp_replace(word, "[0-9]", "")
        return F.when(F.regexp_like(word, F.lit(rf"^\p{{L}}{{{low},{high}}}$")), word)
    word = F.when(F.length(word).between(low, high), word)
    return tr_lower(word) if kind == "harvest" else word


def clean_words(c: Column, kind: str = "letters", lower: bool = True) -> Column:
    """All cleaned words of a text, in order: :func:`clean_word` of each.

    Characters to drop are dropped from the whole text at once, which leaves the
    white space and so the words, and costs one pass instead of one a word.
    """
    low, high = CLEANERS[kind]
    text = F.regexp_replace(c, rf"[^{WORD_CHARS}\p{{IsWhite_Space}}]" + "|[0-9]" * (kind == "letters"), "")
    words = split_words(tr_lower(text) if lower or kind == "harvest" else text)
    if kind == "letters":
        return F.filter(words, lambda w: F.regexp_like(w, F.lit(rf"^\p{{L}}{{{low},{high}}}$")))
    return F.filter(words, lambda w: F.length(w).between(low, high))


def strip_markers(c: Column) -> Column:
    """A subword piece without the usual start and continuation marks."""
    return F.trim(F.regexp_replace(c, "▁|##|Ġ|Ċ", ""))


def clean_piece(c: Column) -> Column:
    return F.regexp_replace(c, "▁|##| ", "")


def harden(c: Column) -> Column:
    """Turkish lower case with the final consonant hardened (b c d g ğ to p ç t k k)."""
    word = tr_lower(c)
    last = F.translate(F.right(word, F.lit(1)), "bcdgğ", "pçtkk")
    return F.when(F.length(word) > 0, F.concat(F.substring(word, F.lit(1), F.length(word) - 1), last)).otherwise(word)


def lemma_root(lemma: Column, is_verb: Column) -> Column:
    """A verb's lemma without its infinitive ending."""
    stripped = F.substring(lemma, F.lit(1), F.length(lemma) - 3)
    return F.when(is_verb & F.regexp_like(lemma, F.lit("(mak|mek)$")) & (F.length(lemma) > 4), stripped).otherwise(lemma)


def line_key(c: Column) -> Column:
    """16 hex digits of the md5, the key of exact line dedup."""
    return F.substring(F.md5(c), 1, 16)


def characters(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def char_table() -> dict[str, int]:
    table = {"<PAD>": PAD_ID, "<UNK>": UNK_ID, "<BOS>": BOS_ID, "<EOS>": EOS_ID}
    return table | {ch: CHAR_OFFSET + i for i, ch in enumerate(CHARACTERS)}


def char_id(ch: Column) -> Column:
    at = F.instr(F.lit(CHARACTERS), ch)
    return F.when((F.length(ch) == 1) & (at > 0), at + (CHAR_OFFSET - 1)).otherwise(UNK_ID)


def pad(c: Column, size: int, fill: int = 0) -> Column:
    """An integer array cut or filled to ``size``."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill), size)), 1, size)


def char_ids(word: Column, size: int = 32, ends: bool = True) -> Column:
    """struct(ids, flags, len): character ids of a word in lower case, upper-case flags, used length."""
    chars = F.slice(characters(word), 1, size - 2 if ends else size)
    ids = F.transform(chars, lambda ch: char_id(tr_lower(ch)).cast("int"))
    flags = F.transform(chars, lambda ch: (tr_lower(ch) != ch).cast("int"))
    if ends:
        ids = F.concat(F.array(F.lit(BOS_ID)), ids, F.array(F.lit(EOS_ID)))
        flags = F.concat(F.array(F.lit(0)), flags, F.array(F.lit(0)))
    return F.struct(pad(ids, size).alias("ids"), pad(flags, size).alias("flags"), F.size(ids).alias("len"))


# Patterns of tokenizer names, the first that matches counts.
TOKENIZER_NAMES = (
    ("morfessor", "Morfessor"),
    ("byte", "ByteBPE"),
    ("^bpe", "BPE"),
    ("unigram", "Unigram"),
    ("wordpiece", "WordPiece"),
    ("turkish-tokenizer|turkishtokenizer", "TurkishTokenizer"),
)


def canonical_name(c: Column, rules: tuple[tuple[str, str], ...] = TOKENIZER_NAMES) -> Column:
    """The name of the first rule whose pattern matches the value in lower case with hyphens, else the value."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(F.regexp_like(F.translate(F.lower(c), "_", "-"), F.lit(pattern)), F.lit(name)).otherwise(out)
    return F.coalesce(out, c)
