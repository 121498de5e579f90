"""Removal of repeated passages of several lines.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines chooses boundaries:
a line ends a segment where the hash is divisible by ``divisor``, which depends on
those lines alone, so an insertion elsewhere shifts nothing. A chunk is every two
neighbouring segments; blank lines count for neither hash nor chunk but stay
inside. With the divisor 1 every line ends a segment and chunks are all pairs of
neighbouring lines: a repeated passage, mostly two to four lines, then goes whole,
while sparser boundaries would leave most (a larger divisor moves fewer rows).

Chunks whose 128-bit hash occurs more than once are fetched and compared byte by
byte with the first occurrence (smallest doc_id, then line); occurrences equal to
it are removed, the first stays. As chunks overlap, all lines of a repeated
passage between its outer boundaries go, wherever it stands.

Only hashes and line numbers are counted over the corpus; texts move in two
joins by document (in the first only those likely to hold repeats), and the text
of repeated chunks in one by chunk, in which one side has a single row a chunk, so that adaptive execution can split hot ones.

Defined results: a null text stays null; an empty text, and a text whose lines
all go, is ''. Rows with equal doc_id and text are one document and stay alike;
a null doc_id is an id of its own, before all others. Line feeds alone end
lines. Extra columns stay as they are; ``n_chars``, if there, follows the text.
An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import materialize

#: Most rows of the broadcast set that filters documents before they are shuffled.
FILTER_BUCKETS = 1 << 20
#: Lines that a rolling hash covers; one hash in so many is a boundary.
WINDOW, DIVISOR = 2, 1
_FACTOR, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def boundaries(hashes: list[int], divisor: int = DIVISOR, window: int = WINDOW) -> list[int]:
    """The places after which a segment ends: where the rolling hash of the last ``window`` hashes is divisible."""
    ends, rolling, leaving = [], 0, pow(_FACTOR, window, 1 << 64)
    for i, h in enumerate(hashes):
        rolling = (rolling * _FACTOR + h - (hashes[i - window] * leaving if i >= window else 0)) & _MASK
        if (rolling >> 17) % divisor == 0:
            ends.append(i)
    return ends


def cut(lines: list[bytes], divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk: two neighbouring segments of several lines in all."""
    from xxhash import xxh3_64_intdigest

    at = [i for i, line in enumerate(lines) if line.strip()]
    ends = boundaries([xxh3_64_intdigest(lines[i]) for i in at], divisor)
    ends = [-1, *ends, *([len(at) - 1] if at and (not ends or ends[-1] < len(at) - 1) else [])]
    pairs = zip(ends, ends[2:] if len(ends) > 2 else ends[1:])
    return [(at[a + 1], at[b] + 1 - at[a + 1]) for a, b in pairs if b - a > 1]


def chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, version, first, n, key of every chunk; ``docs`` has version and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, versions, first, sizes, keys = [], [], [], [], []
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lines = (text.as_py() or "").encode().split(b"\n")
                for start, n in cut(lines, divisor):
                    ids.append(doc)
                    versions.append(version)
                    first.append(start)
                    sizes.append(n)
                    keys.append(xxh3_128_digest(b"\n".join(lines[start : start + n])))
            columns = [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(first, pa.int32()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "first", "n", "key"])

    return docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id long, version long, first int, n int, key binary")


def _of_document(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    spans = spans.withColumnsRenamed({"doc_id": "_doc_id", "version": "_version"})
    same = docs["doc_id"].eqNullSafe(spans["_doc_id"]) & (docs["version"] == spans["_version"])
    return docs.join(spans, same, how).drop("_doc_id", "_version")


def repeated_spans(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, version, spans (first, n) to remove; ``docs`` has doc_id, version, text."""
    found = materialize(chunks(docs, divisor), "line-chunks")
    at = F.struct("doc_id", "version", "first")
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("origin")).filter("times > 1")
    shared = materialize(shared.select(F.col("key").alias("_key"), "origin"), "line-shared")
    places = found.join(shared, found["key"] == shared["_key"])
    # A copy that begins within its first occurrence leaves the lines of that one.
    here = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("version") == F.col("origin.version"))
    start = F.when(here, F.greatest("first", F.col("origin.first") + F.col("n"))).otherwise(F.col("first"))
    place = F.struct("first", "n", "key", start.alias("start"), at.eqNullSafe(F.col("origin")).alias("original"))
    places = materialize(places.groupBy("doc_id", "version").agg(F.collect_set(place).alias("places")), "line-places")
    # Before the shuffle of texts, most documents without repeats are dropped
    # by a bounded set: the buckets that the ids with repeats hash to.
    bucket = F.pmod(F.xxhash64("doc_id", "version"), F.lit(FILTER_BUCKETS)).alias("bucket")
    buckets = F.broadcast(places.select(bucket).distinct())
    likely = docs.withColumn("bucket", bucket).join(buckets, "bucket", "left_semi").drop("bucket")
    piece = lambda lines, p: F.array_join(F.slice(lines, p["first"] + 1, p["n"]), "\n").alias("piece")
    of = lambda lines: F.transform("places", lambda p: F.struct(*[p[c].alias(c) for c in ("first", "n", "key", "start", "original")], piece(lines, p)))
    cuts = F.flatten(F.transform(F.array(F.split("text", "\n")), of))  # a text is split once
    pieces = _of_document(likely, places, "inner").select("doc_id", "version", F.explode(cuts).alias("cut"))
    pieces = materialize(pieces.select("doc_id", "version", "cut.*"), "line-pieces")
    originals = pieces.filter("original").select(F.col("key").alias("_key"), F.col("piece").alias("_piece"))
    copies = pieces.filter("not original")
    equal = copies.join(originals, (copies["key"] == originals["_key"]) & (copies["piece"] == originals["_piece"]))
    return equal.groupBy("doc_id", "version").agg(F.collect_set(F.struct(F.col("start").alias("first"), (F.col("first") + F.col("n") - F.col("start")).alias("n"))).alias("spans"))


def remove_repeats(docs: DataFrame, counts: bool = False, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` without repeated chunks; with ``counts`` also n_lines and removed_lines."""
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    ready = docs.select(row, F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    spans = repeated_spans(ready.drop("row"), divisor)
    lines = F.split("text", "\n")
    joined = _of_document(ready, spans, "left").withColumn("lines", lines)
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    joined = joined.withColumn("kept", F.when(F.col("spans").isNotNull(), kept))
    rebuilt = F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")
    changed = F.col("kept").isNotNull()
    joined = joined.withColumn("new_text", F.when(changed, rebuilt).otherwise(F.col("text")))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("new_text").cast(kind)).otherwise(F.col("row")["n_chars"])
    out = [(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns]
    if counts:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
        out += [n.cast("long").alias("n_lines"), F.when(changed, n - F.size("kept")).otherwise(0).cast("long").alias("removed_lines")]
    return joined.select(*out)


#: The query's rows, for tables in which an id has one text.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
w AS (SELECT doc_id, lines, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS chunk FROM w WHERE b IS NOT NULL),
o AS (SELECT *, first_value(doc_id) OVER f AS first_id, first_value(a) OVER f AS first_a FROM c WINDOW f AS (PARTITION BY chunk ORDER BY doc_id NULLS FIRST, a)),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id IS NOT DISTINCT FROM first_id THEN greatest(a, first_a + b + 1 - a) ELSE a END, b + 1)) AS i
  FROM o WHERE doc_id IS DISTINCT FROM first_id OR a <> first_a),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS gone
  FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN k.gone > 0 THEN coalesce(k.kept, '') ELSE d.text END AS text, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(k.gone, 0)::BIGINT AS removed_lines
FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""
