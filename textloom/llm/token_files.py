"""Token ids in binary files: frequency-ranked, variable-length, byte-aligned.

Format. A file is a series of blocks, each ended by one newline byte. A block is
a header (magic, counts of documents, tokens, control and data bytes), the ids
of its documents (int64, with one null flag byte each), their token counts
(int64), the control bytes and the data bytes. The token stream holds, instead
of ids, their ranks by falling corpus frequency (ties: by id); four ranks share
a control byte of four 2-bit lengths and take 1 to 4 data bytes each, lowest
byte first. The rank table lies beside the files. Decoding looks the lengths of
a control byte up in a 256-row table and gathers the bytes with numpy.

Steps: encode each text once (compressed ids go to the shared folder until the
files are written); count ids over all of them (one row an id and task is
shuffled); part the documents by ranges of ascending id, and within an id by a hash
of the tokens, so that a frequent id is several parts; and write the blocks through
Spark's text sink, which takes any bytes and commits each task's file once. A block
ends at ``block_tokens`` tokens and a file at ``file_blocks`` blocks, so a file is
under 300 MB unless one text is longer; it is read by one task with Spark's binary
source, a block at a time. The rank table is broadcast: it has one entry a
vocabulary id.

Defined results: a null text is the empty text (only the end id); null ids come
first; repeated ids stay together, ordered by a hash of their tokens. An empty
table gives no blocks and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import string
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textloom.llm.common import materialize, release
from textloom.sources.scratch import shared_path

END_ID, BLOCK_TOKENS, FILE_BLOCKS, MAGIC = 1, 4_000_000, 16, b"TLTOKEN1"
HEADER = struct.Struct("<8sqqqq")
#: Words that a worker remembers, and documents that it encodes at once.
CACHE_WORDS, BATCH_DOCS = 300_000, 4096

#: LENGTHS[c]: the data bytes of each of the four ranks of control byte c.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).view(np.uint8)
    if values.max(initial=0) > 0xFFFF:
        extra = extra + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    quads[: len(values)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    starts = np.arange(len(values)) + np.cumsum(extra, dtype=np.int64) - extra
    data = np.empty(len(values) + int(extra.sum(dtype=np.int64)), dtype=np.uint8)
    data[starts] = values.astype(np.uint8)
    for more in range(1, int(extra.max(initial=0)) + 1):
        longer = np.flatnonzero(extra >= more)
        data[starts[longer] + more] = (values[longer] >> np.uint32(8 * more)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values that :func:`pack` packed."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, dtype=np.uint8)
    values = raw[starts].astype(np.uint32)
    for more in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > more)
        values[longer] |= raw[starts[longer] + more].astype(np.uint32) << np.uint32(8 * more)
    return values


class _Known(dict):
    """Words to rows of a flat id list; unknown words are encoded on the way."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self.ends) - 1
        self.ids.extend(self.encode(word))
        self.ends.append(len(self.ids))
        return row


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... (sizes[i] of them), for each i in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word of a batch once.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words (cut at blanks and line feeds) one after another. A
    word of letters alone is one pre-token, and the ASCII punctuation after it
    another; these go to the library's model at once, all others through its
    whole chain. Up to ``cache_words`` words are remembered for later batches.
    """

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._model, self._cache_words = self.tokenizer.model, cache_words
        self._letter = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = [b for b in range(256) if b not in self._letter]
        self._letter |= {b: chr(256 + i) for i, b in enumerate(rest)}
        self._known = _Known(self._encode_word)

    def _pretoken(self, text: str) -> list[int]:
        if not text.isascii():
            text = "".join(map(self._letter.__getitem__, text.encode()))
        return [t.id for t in self._model.tokenize(text)]

    def _encode_word(self, word: str) -> list[int]:
        if word.isascii():
            if word.isalpha() or word and word.strip(string.punctuation) == "" and "'" not in word:
                return self._pretoken(word.lower())
            return self.tokenizer.encode(word, add_special_tokens=False).ids if word else []
        core = word.rstrip(string.punctuation)
        # Letter by letter, as the library does: no final sigma.
        low = unicodedata.normalize("NFC", core).replace("\u03a3", "\u03c3").lower()
        if low.isalpha():
            return self._pretoken(low) + self._pretoken(word[len(core) :]) if len(core) < len(word) else self._pretoken(low)
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array without nulls."""
        known = self._known
        if len(known) > self._cache_words or len(known.ids) > 16 * self._cache_words:
            known = self._known = _Known(self._encode_word)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        # ASCII words of letters, with punctuation after them or not, are looked
        # up in lower case and without it; all others as they are.
        core = pc.utf8_rtrim(words, characters=string.punctuation)
        plain = pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(core))
        cores = pc.if_else(plain, pc.ascii_lower(core), words).dictionary_encode()
        rows = np.fromiter(map(known.__getitem__, cores.dictionary.to_pylist()), dtype=np.int64, count=len(cores.dictionary))
        rows = rows[cores.indices.to_numpy(zero_copy_only=False)]
        tailed = np.flatnonzero(pc.and_(plain, pc.not_equal(words, core)).to_numpy(zero_copy_only=False))
        tails = [w[n:] for w, n in zip(words.take(pa.array(tailed)).to_pylist(), pc.binary_length(core).take(pa.array(tailed)).to_pylist())]
        tail_rows = np.fromiter(map(known.__getitem__, tails), dtype=np.int64, count=len(tails))
        # The ids of each distinct word: those of its core and, if any, its tail.
        bounds, flat = np.frombuffer(known.ends, dtype=np.int64), np.frombuffer(known.ids, dtype=np.uint32)
        parts = np.stack([rows, np.full(len(rows), -1)], axis=1)
        parts[tailed, 1] = tail_rows
        first, sizes = bounds[parts], np.where(parts < 0, 0, bounds[parts + 1] - bounds[parts])
        ids, sizes = flat[_spread(first.ravel(), sizes.ravel())], sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        stream = ids[_spread(starts[at], sizes[at])]
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [stream[a:b] for a, b in zip(ends[:-1], ends[1:])]


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, vocab_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (compressed, little-endian) of every text, with the end id.

    Each task adds one row without ids whose ``counts`` holds how often it wrote
    each id, for :func:`count_ids`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, squeeze, total = encoder(vocab_path), zstandard.ZstdCompressor(level=3).compress, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                encoded = [np.append(ids, np.uint32(end_id)) for ids in own.encode(pc.fill_null(part.column(1), ""))]
                found = np.bincount(np.concatenate(encoded), minlength=len(total))
                found[: len(total)] += total
                total = found
                packed = [squeeze(_planes(ids)) for ids in encoded]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())], names=["doc_id", "ids", "counts"])
        seen = np.flatnonzero(total)
        counts = np.stack([seen, total[seen]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([counts], pa.binary())], names=["doc_id", "ids", "counts"])

    ready = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ready.mapInArrow(run, "doc_id long, ids binary, counts binary")


def _planes(ids: np.ndarray) -> bytes:
    """Two or four bytes an id; the first byte of the result says which."""
    narrow = ids.max(initial=0) < 1 << 16
    return (b"\x02" if narrow else b"\x04") + ids.astype("<u2" if narrow else "<u4").tobytes()


def _ids(packed: bytes, expand) -> np.ndarray:
    raw = expand(packed)
    return np.frombuffer(raw, dtype="<u2" if raw[0] == 2 else "<u4", offset=1)


def count_ids(encoded: DataFrame) -> DataFrame:
    """id, n over all documents, from the counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                ids, counts = np.frombuffer(value.as_py(), dtype="<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n"])

    counts = encoded.filter(F.col("counts").isNotNull()).select("counts")
    return counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _block(ids: list, counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    known = np.array([i or 0 for i in ids], dtype="<i8").tobytes()
    nulls = bytes(i is None for i in ids)
    header = HEADER.pack(MAGIC, len(ids), len(ranks), len(control), len(data))
    return header + known + nulls + np.array(counts, dtype="<i8").tobytes() + control + data


def write_files(encoded: DataFrame, ranked: np.ndarray, path: str, block_tokens: int = BLOCK_TOKENS, file_blocks: int = FILE_BLOCKS) -> None:
    """``ranked``: the ids from rank 0 on."""
    spark = encoded.sparkSession
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, ranks = zstandard.ZstdDecompressor().decompress, shared.value
        ids, parts, waiting = [], [], 0

        def flush():
            block = _block(ids, [len(p) for p in parts], ranks[np.concatenate(parts)])
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

        for batch in batches:
            for doc, packed in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                parts.append(_ids(packed.as_py(), expand))
                waiting += len(parts[-1])
                if waiting >= block_tokens:
                    yield flush()
                    ids, parts, waiting = [], [], 0
        if ids:
            yield flush()

    rows = encoded.filter(F.col("counts").isNull()).select("doc_id", "ids")
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    ordered = rows.withColumn("hash", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order, "ids").select("doc_id", "ids")
    lines = ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string"))
    lines.write.option("maxRecordsPerFile", file_blocks).text(f"{path}/tokens")
    table = spark.createDataFrame(pa.table({"rank": pa.array(range(len(ranked)), pa.int64()), "id": pa.array(ranked, pa.int64())}))
    table.coalesce(1).write.parquet(f"{path}/ranks")


def blocks(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, token counts and ranks of each block of a file."""
    at = 0
    while at < len(content):
        magic, n_docs, n_tokens, n_control, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        ids = np.frombuffer(content, "<i8", n_docs, at).tolist()
        nulls = content[at + 8 * n_docs : at + 9 * n_docs]
        counts = np.frombuffer(content, "<i8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        control, data = content[at : at + n_control], content[at + n_control : at + n_control + n_data]
        yield [None if z else i for i, z in zip(ids, nulls)], counts, unpack(control, data, n_tokens)
        at += n_control + n_data + 1


def token_count(content: bytes) -> int:
    """The tokens in all blocks of a file, from their headers."""
    at = total = 0
    while at < len(content):
        _, n_docs, n_tokens, n_control, n_data = HEADER.unpack_from(content, at)
        at += HEADER.size + 17 * n_docs + n_control + n_data + 1
        total += n_tokens
    return total


def read_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document in the files."""
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()  # one row a vocabulary id
    shared = spark.sparkContext.broadcast(table["id"].to_numpy(dtype="<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                place = 0
                for ids, counts, ranks in blocks(content.as_py()):
                    stream, ends = shared.value[ranks], np.cumsum(counts)
                    starts = ends - counts
                    parts = [stream[a:b] for a, b in zip(starts, ends)]
                    columns = [pa.array([file.as_py()] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(starts + place, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    names = ["file", "doc_id", "place", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.array(parts, pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    place += int(ends[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [token_count(content.as_py()) for content in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "tokens"])

    schema = "file string, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/tokens")
    rows = files.select("path", "content").mapInArrow(run, schema)
    totals = materialize(files.select("path", "content").mapInArrow(count, "file string, tokens long"), "token-totals")  # one row a file
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")  # noqa: E731  of the task, and of its file
    order = W.orderBy(number(r"/part-(\d+)-[^/]*$"), number(r"-c(\d+)\.txt$")).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("file").alias("_file"), F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    joined = rows.join(before, rows["file"] == before["_file"])
    return joined.select("doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def token_files(docs: DataFrame, path: str, vocab_path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, file_blocks: int = FILE_BLOCKS) -> None:
    """Encode ``docs`` and write the files under ``path``."""
    encoded = materialize(encode_documents(docs, vocab_path, end_id), "token-ids")
    counts = count_ids(encoded).toPandas()  # one row a vocabulary id
    ranked = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.int64)
    write_files(encoded, ranked, path, block_tokens, file_blocks)
    release(encoded)


def file_round_trip(docs: DataFrame, **options) -> DataFrame:
    path = shared_path(docs.sparkSession, "tokens")
    token_files(docs, path, **options)
    return read_files(docs.sparkSession, path)
