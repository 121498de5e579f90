"""Extension points for tokenizers, analysers and encoders that are Python objects.

Each takes a function that makes the object, called once a worker process and
task, so a model is loaded once and never shipped with the rows. Rows move in
Arrow batches. Codecs and word encoders see each distinct word once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.functions.text import UNK_ID, char_table, tr_lower


@dataclass(frozen=True)
class Codec:
    """A tokenizer's two directions; ``vocab_size`` is what it declares."""

    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]
    vocab_size: int = 0


def character_codec() -> Codec:
    """The character table as a codec: others are unknown on the way in and dropped on the way out."""
    ids = char_table()
    names = {i: c for c, i in ids.items() if len(c) == 1}
    return Codec(lambda text: [ids.get(c, UNK_ID) for c in text], lambda found: "".join(names.get(i, "") for i in found), len(ids))


def byte_codec() -> Codec:
    """UTF-8 bytes as ids: loses nothing."""
    return Codec(lambda text: list(text.encode()), lambda found: bytes(found).decode("utf-8", "replace"), 256)


def _tried(call: Callable, value, otherwise):
    try:
        return call(value), False
    except Exception:  # an external tokenizer may fail in any way
        return otherwise, True


def coded_words(words: DataFrame, make: Callable[[], Codec]) -> DataFrame:
    """word, ids, decoded, failed of each distinct word through a codec.

    A word on which the codec fails has no ids and decodes to null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = make()

        def both(word: str) -> tuple[list[int], str]:
            ids = [int(i) for i in codec.encode(word)]
            return ids, codec.decode(ids)

        for batch in batches:
            rows = [(word, *_tried(both, word, ([], None))) for word in batch["word"]]
            yield pd.DataFrame([(w, ids, text, bad) for w, (ids, text), bad in rows], columns=["word", "ids", "decoded", "failed"])

    return words.select("word").distinct().mapInPandas(run, "word string, ids array<int>, decoded string, failed boolean")


#: Ids that a batch of texts has at most, but for a longer text of its own.
PART_IDS = 1 << 20


def token_ids(texts: DataFrame, make: Callable[[], Codec]) -> DataFrame:
    """doc_id, ids of each whole text through a language model's tokenizer; null is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()

        def part(doc_ids: list, found: list) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], ["doc_id", "ids"])

        for batch in batches:
            doc_ids, found, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                # Python numbers of one text at a time; the ids of a part of bounded size.
                ids = np.fromiter((int(i) for i in codec.encode(text.as_py() or "")), dtype=np.int32)
                if doc_ids and held + len(ids) > PART_IDS:
                    yield part(doc_ids, found)
                    doc_ids, found, held = [], [], 0
                doc_ids.append(doc_id.as_py())
                found.append(ids)
                held += len(ids)
            if doc_ids:
                yield part(doc_ids, found)

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def observed_vocabulary(ids: DataFrame, declared: int) -> DataFrame:
    """declared, observed (largest id + 1) and size, the larger of both, in one row."""
    largest = F.coalesce(F.max(F.array_max("ids")), F.lit(-1)) + 1
    out = ids.agg(F.lit(declared).cast("long").alias("declared"), largest.cast("long").alias("observed"))
    return out.withColumn("size", F.greatest("declared", "observed"))


def line_pieces(lines: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], batch_lines: int = 256) -> DataFrame:
    """piece: all pieces of the lines (column ``line``), from an adapter of lists of lines to lists of pieces.

    The adapter may give any number of pieces a batch, in which lines are not told apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = make()
        for batch in batches:
            for at in range(0, len(batch), batch_lines):
                yield pd.DataFrame({"piece": list(adapter(batch["line"].iloc[at : at + batch_lines].tolist()))})

    return lines.select("line").filter("line is not null").mapInPandas(run, "piece string")


def word_embeddings(words: DataFrame, make: Callable[[], Callable[[list[str]], object]], batch_words: int = 256) -> DataFrame:
    """word, vector of each distinct word, from an encoder of lists of words to an (n, dim) array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for batch in batches:
            for at in range(0, len(batch), batch_words):
                some = batch["word"].iloc[at : at + batch_words].tolist()
                vectors = [[float(x) for x in v] for v in encoder(some)]
                yield pd.DataFrame({"word": some, "vector": vectors})

    return words.select("word").distinct().mapInPandas(run, "word string, vector array<double>")


# Parts of speech that say that a word is unknown, and a surface in a formatted analysis.
UNKNOWN = ("unk", "unknown", "punc")
SURFACE = "([a-zçğıöşü]+):"


def analyses(words: DataFrame, make: Callable[[], Callable[[str], list[tuple[str, str, str]]]]) -> DataFrame:
    """word, pos, formatted, lemma: each analysis of each distinct word, and one empty row with ``failed`` where the analyser fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyse = make()
        for batch in batches:
            rows = []
            for word in batch["word"]:
                found, failed = _tried(lambda w: [tuple(x) for x in analyse(w)], word, [])
                rows += [(word, *x, False) for x in found] + [(word, None, None, None, True)] * failed
            yield pd.DataFrame(rows, columns=["word", "pos", "formatted", "lemma", "failed"])

    return words.select("word").distinct().mapInPandas(run, "word string, pos string, formatted string, lemma string, failed boolean")


def inventory(analysed: DataFrame) -> DataFrame:
    """kind ('morpheme' or 'word'), entry: surfaces and lemmas of the known analyses, and the words that have one."""
    known = analysed.filter("not failed").filter(~F.coalesce(F.lower("pos").isin(*UNKNOWN), F.lit(False)))
    surfaces = F.regexp_extract_all(tr_lower(F.coalesce("formatted", F.lit(""))), F.lit(SURFACE), F.lit(1))
    lemma = F.when(F.coalesce(F.length("lemma"), F.lit(0)) > 0, F.array(tr_lower(F.col("lemma")))).otherwise(F.array().cast("array<string>"))
    morphemes = known.select(F.lit("morpheme").alias("kind"), F.explode(F.concat(surfaces, lemma)).alias("entry"))
    return morphemes.union(known.select(F.lit("word"), "word")).distinct()
