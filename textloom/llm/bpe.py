"""Byte-level BPE encoding and decoding.

The encoder is the backtracking one: an Aho-Corasick automaton finds the
longest vocabulary entry at every byte of a pre-token; a candidate is taken if
it forms a compatible pair with the token before it (no merge of higher
priority would cross their border), else shorter prefixes are tried and, when
none is left, the last token is taken back. Each border is given up at most
once, so a pre-token costs time linear in its bytes and the tokens are those of
merging by rank. Decoding gathers bytes through an offset table.

Defined results: a null text is the empty text; the empty text has no tokens.
The special token's string inside a text becomes its id, as in the tokenizer
file; it is ordinary text nowhere. Rows are independent, so repeated rows,
clashing extra columns and empty tables need no rule.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed by the byte-level scheme: how a text falls into pre-tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose encoding a worker remembers, and their longest length.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Encodes and decodes with one vocabulary file (merges in rank order)."""

    def __init__(self, path: str | None = None, cache_entries: int = CACHE_ENTRIES):
        import ahocorasick
        import regex

        with open(path or default_vocabulary(), encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a byte-level vocabulary with the usual pre-tokens")
        letters, model = _byte_letters(), spec["model"]
        vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        rank_of = {bytes([b]): b for b in range(256)}
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        parts = [bytes([b]) for b in range(256)]
        for merge in model["merges"]:
            left, right = (bytes(letters[c] for c in t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, whole = rank_of[left], rank_of[right], left + right
            if whole not in rank_of:
                rank_of[whole] = len(parts)
                parts.append(whole)
                self.split.append((a, b))
                self.pair[a, b] = rank_of[whole]
        # Ranks order the merges; ids are what the file calls the tokens.
        self.parts = parts
        self.id_text = [str(vocab[p]) for p in parts]
        self.length = [len(p) for p in parts]
        self.shorter = [next((rank_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in rank_of), -1) for p in parts]
        self.automaton = ahocorasick.Automaton()
        for p, r in rank_of.items():
            self.automaton.add_word(p.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._pretokens = regex.compile(PRETOKEN).findall
        tokens = {vocab[p]: p for p in parts} | {i: t.encode() for t, i in self.special.items()}
        size = max(tokens) + 1
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(tokens.get(i, b"")) for i in range(size)])]).astype(np.int64)
        self._cache: dict[str, str] = {}
        self._cache_entries = cache_entries

    def compatible(self, one: int, two: int) -> bool:
        """Whether merging by rank leaves the border between two tokens alone."""
        pair, split, limit = self.pair, self.split, 1 << 31
        while True:
            if pair.get((one, two), limit) < limit:
                return False
            if one > two:
                limit, one = one, split[one][1]
                if one == limit:
                    limit, two = two + 1, split[two][0]
                    if two + 1 == limit:
                        return True
            else:
                limit, two = two + 1, split[two][0]
                if two + 1 == limit:
                    limit, one = one, split[one][1]
                    if one == limit:
                        return True

    def ranks(self, word: bytes) -> list[int]:
        """The tokens of one pre-token, as merge ranks."""
        size, length = len(word), self.length
        longest = [-1] * size
        for end, r in self.automaton.iter(word.decode("latin-1")):
            start = end + 1 - length[r]
            if longest[start] < 0 or length[longest[start]] < length[r]:
                longest[start] = r
        if length[longest[0]] == size:
            return [longest[0]]
        open_at = bytearray(b"\x01") * (size + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = tokens[-1] if tokens else -1
            while True:
                end = at + length[token]
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    tokens.append(token)
                    if end == size:
                        return tokens
                    at, token = end, longest[end]
                    break
                token = self.shorter[token]
                if token < 0:
                    open_at[at] = 0
                    tokens.pop()
                    at -= length[last]
                    token = last
                    break

    def _word(self, word: str) -> str:
        text = ",".join([self.id_text[r] for r in self.ranks(word.encode())])
        if len(word) <= CACHE_CHARS:
            if len(self._cache) >= self._cache_entries:
                self._cache.clear()
            self._cache[word] = text
        return text

    def encode_text(self, text: str) -> str:
        """The ids of ``text`` in decimal, joined by commas."""
        out: list[str] = []
        pieces = self._special.split(text) if any(t in text for t in self.special) else [text]
        cached, word = self._cache.get, self._word
        for piece in pieces:
            if piece in self.special:
                out.append(str(self.special[piece]))
            elif piece:
                out += [cached(w) or word(w) for w in self._pretokens(piece)]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_text(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", errors="replace")


_codecs: dict[str | None, BytePairCodec] = {}


def codec(path: str | None = None) -> BytePairCodec:
    """One codec a worker process; later tasks find it again."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, vocab_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    With ``keep_ids`` also the ids and the decoded text. One narrow pass: no
    shuffle, and a worker holds one batch and a bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab_path)
        for batch in batches:
            n, ids_sha, text_sha, kept, decoded = [], [], [], [], []
            for value in batch.column(1):
                joined = own.encode_text(value.as_py() or "")
                ids = np.fromstring(joined, dtype=np.int64, sep=",") if joined else np.zeros(0, np.int64)
                raw = own.decode_bytes(ids)
                text = raw.decode("utf-8", errors="replace")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
                    decoded.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(kept, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
