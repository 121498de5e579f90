"""Encoders, file formats and archives: exact round trips and library results."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import bpe, token_files, warc

TEXTS = ["", " ", "don't  stop\n\n\tnow", "Ünïcode ΣΑΣ İI ŉ́ J̌", "a" * 3000, "漢字 🎉🎉", "<|endoftext|>x<|endoftext|>", "x\x1c\x85\xa0​y", "1234567 !!??.. 's't", "the " * 50]
ALPHABET = st.text(st.sampled_from(list("abcTHE  \n\t'sdt.,!?é漢🎉\x1c\xa0Σİ7_")), max_size=40)


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(token_files.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_backtracking_is_merging_by_rank(text):
    codec, library = bpe.codec(), _library(bpe.default_vocabulary())
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want and codec.decode(want) == library.decode(want, skip_special_tokens=False)


_libraries = {}


def _library(path):
    if path not in _libraries:
        _libraries[path] = Tokenizer.from_file(path)
    return _libraries[path]


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4))
def test_word_encoder_is_the_library(texts):
    own = token_files.encoder()
    library = _library(token_files.default_vocabulary())
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decode_of_broken_bytes(byte_tokenizer):
    ids = byte_tokenizer.encode("é🎉", add_special_tokens=False).ids[:-1]
    assert bpe.codec().decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)


def test_op10_rows(spark, byte_tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "x"), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs).collect())
    want = []
    for i, t in rows:
        ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(byte_tokenizer.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    kept = bpe.encode_documents(docs.filter("doc_id = 2"), keep_ids=True).first()
    assert kept["decoded"] == TEXTS[2] and kept["ids"] == byte_tokenizer.encode(TEXTS[2], add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_pack_round_trip(values):
    control, data = token_files.pack(np.array(values, dtype=np.uint32))
    assert token_files.unpack(control, data, len(values)).tolist() == values and len(control) == -(-len(values) // 4)


def test_op3_rows(spark, word_tokenizer):
    rows = [(7, "b c"), (2, None), (5, "the thing, the THING."), (5, "again"), (None, "null id"), (9, "z" * 500 + " y"), (10, "long " * 200_000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, start double")
    got = sorted(tuple(r) for r in token_files.file_round_trip(docs, block_tokens=8, file_blocks=1).select(F.coalesce("doc_id", F.lit(-1)), "start", "n_tokens", "ids_crc32").collect())
    start, want = 0, []
    encoded = [(-1 if i is None else i, word_tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    for i, ids in sorted(encoded, key=lambda x: x[0]):
        want.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted(want)
    for doc, begin, n, _ in sorted(got, key=lambda g: g[1]):
        assert begin == start
        start += n
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == [-1, 2, 5, 5, 7, 9, 10]
    assert token_files.file_round_trip(docs.limit(0)).count() == 0


def test_token_files_end_at_their_blocks(spark, tmp_path):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).coalesce(1)
    token_files.token_files(docs, str(tmp_path / "t"), block_tokens=8, file_blocks=2)
    sizes = [len(list(token_files.blocks(p.read_bytes()))) for p in (tmp_path / "t/tokens").glob("part-*")]
    assert max(sizes) == 2 and sum(sizes) >= 30
    got = token_files.read_files(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == [4 * i for i in range(60)]


def test_op8_ties_nulls_and_clashes(spark):
    big = "<p>x\r\n\r\nWARC/1.1 é</p>" * 10
    rows = [(5, "u\r\n5", big), (3, "u3", big), (3, "u3", big), (None, None, big), (9, None, None), (10, "u", "small"), (11, "u", "small"), (12, "z", big + "1")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, row string")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]): r["payload_digest"] for r in warc.archive_round_trip(pages).collect()}
    size = len(big.encode())
    assert set(got) == {(5, "revisit", 3, size), (3, "response", None, size), (None, "revisit", 3, size), (9, "response", None, 0), (10, "response", None, 5), (11, "response", None, 5), (12, "response", None, size + 1)}
    assert got[(5, "revisit", 3, size)] == hashlib.sha256(big.encode()).hexdigest()
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_records_are_well_formed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "h" * 200), (2, "http://b/", "h" * 200)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), date="2024-05-06T07:08:09Z")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    records = list(warc.parse(raw))
    assert [r["warc-type"] for r in records] == ["response", "revisit"]
    assert records[1]["warc-refers-to"] == records[0]["warc-record-id"] and records[1]["warc-refers-to-target-uri"] == "http://a/"
    assert records[0]["block"].endswith(b"\r\n\r\n" + b"h" * 200) and b"h" * 10 not in records[1]["block"]
    assert {r["warc-date"] for r in records} == {"2024-05-06T07:08:09Z"} == {records[1]["warc-refers-to-date"]}


def test_warc_record_ids_are_unique_and_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc.pieces, "__defaults__", (1000,))
    rows = [(None, "u", "h" * 300)] * 20 + [(7, "u", "h" * 300)] * 20 + [(8, "v", "x" * 50_000), (9, "v", "y" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), pieces_per_file=2)
    files = list((tmp_path / "w").glob("part-*"))
    records = [r for p in files for r in warc.parse(p.read_bytes())]
    ids = {r["warc-record-id"]: r for r in records}
    assert len(ids) == len(records) == len(rows) and len(files) > 5
    assert all(ids[r["warc-refers-to"]]["warc-type"] == "response" for r in records if r["warc-type"] == "revisit")
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert got.filter("refers_to = 7").count() == 20 and got.filter("record_type = 'response'").count() == 22
