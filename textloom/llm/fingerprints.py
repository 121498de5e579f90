"""Bottom-k fingerprints of documents.

A text's shingles are its runs of five whitespace-separated words (all its words
if it has fewer); each is hashed to 63 bits and the ``k`` smallest distinct
hashes are the fingerprint. Fingerprints merge (smallest k of the union), and
estimate resemblance, containment and the number of distinct shingles.

Built-in functions only. A document is hashed in the task that reads it; only
hashes under a bound that leaves about 2k of them are sorted (all of them where
that leaves fewer than k, as in repetitive texts), so the cost is linear.

Defined results: a null text is the empty text; it has the empty fingerprint.
Two empty fingerprints are alike (1.0), an empty and another are not (0.0).
Fingerprints depend on the text alone, so equal texts and repeated rows have
equal ones. Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.llm.common import materialize

K, SHINGLE = 256, 5
HASHES = 1 << 63
#: Buckets of consecutive ids, and the bytes of their first texts that may be broadcast.
MOST_BUCKETS, BROADCAST_BYTES = 32_768, 32 << 20


def with_word_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    tokens = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return df.withColumn(out, F.transform(tokens, lambda w: F.xxhash64(w)))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sorted bottom-k hashes of column ``text`` as ``out``."""
    words, hashes, low = f"_{out}_words", f"_{out}_hashes", f"_{out}_low"
    df = with_word_hashes(df, text, words)
    n = F.size(words)
    run = lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(shingle)])
    positive = F.lit(HASHES - 1)
    shingles = F.when(n >= shingle, F.transform(F.sequence(F.lit(0), n - shingle), lambda i: run(i).bitwiseAND(positive)))
    short = F.when(n > 0, F.array(run(F.lit(0)).bitwiseAND(positive))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(hashes, F.coalesce(shingles, short)).drop(words)
    count = F.size(hashes)
    bound = (F.lit(float(HASHES)) * F.least(F.lit(1.0), F.lit(2.0 * k + 64) / count)).cast("bigint")
    df = df.withColumn("_bound", bound)
    df = df.withColumn(low, F.array_distinct(F.filter(F.col(hashes), lambda h: h <= F.col("_bound"))))
    full = F.when((F.size(low) >= k) | (count <= 2 * k + 64), F.col(low)).otherwise(F.array_distinct(F.col(hashes)))
    return df.withColumn(out, F.slice(F.sort_array(full), 1, k)).drop(hashes, low, "_bound")


def merge(one: Column, two: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(one, two)), 1, k)


def resemblance(one: Column, two: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: shared among the k smallest of the union."""
    union = merge(one, two, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, one), two))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_shingles(fingerprint: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    size = F.size(fingerprint)
    return F.when(size < k, size.cast("double")).otherwise(F.lit((k - 1.0) * HASHES) / F.element_at(fingerprint, k))


def containment(one: Column, two: Column, k: int = K) -> Column:
    """Estimated part of the shingles of ``one`` that ``two`` has too."""
    both = resemblance(one, two, k) * distinct_shingles(merge(one, two, k), k)
    return F.when(F.size(one) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(one, k)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), ",")


def id_bounds(docs: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Ids that part ``docs`` into about equal ranges, and how many parts each range has; bounded driver-side lists.

    An id that fills several ranges is a range of its own in several parts, and so
    are the null ids, the first range.
    """
    steps = [i / buckets for i in range(1, buckets)]
    row = docs.agg(F.percentile_approx("doc_id", steps, 100_000), F.count(F.lit(1)), F.count("doc_id")).first()
    times = Counter(row[0] or [])
    bounds = sorted({*times, *(v + 1 for v, n in times.items() if n > 1)})
    nulls = -(-(row[1] - row[2]) * buckets // max(1, row[1]))
    return bounds, [max(1, nulls), 1, *[1 + times[v] if times[v] > 1 else 1 for v in bounds]]


def bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are at most ``doc_id``, by binary search; null: -1."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    top = 1 << (len(bounds).bit_length() - 1)
    padded = F.lit(bounds + [None] * (2 * top - 1 - len(bounds)))
    steps = F.lit([top >> i for i in range(top.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(padded, at + step - 1) <= doc_id, step).otherwise(F.lit(0)))
    return F.when(doc_id.isNull(), -1).otherwise(found)


def edited_neighbours(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Every document against its edit and against the next document.

    "Next" is by descending id (ties: descending hash of the text, then text;
    null ids last), after the last the first. Ids are parted into ranges of about
    equal count, and ranges of one id by the hash; each part is a window partition,
    and its last document finds its next among the first documents of the parts,
    one small table. The text is shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds, parts = id_bounds(docs, buckets)
    docs = docs.withColumns({"hash": F.xxhash64("text"), "range": bucket_of(F.col("doc_id"), bounds)})
    of_range = F.get(F.lit(parts), F.col("range") + 1)
    part = F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * of_range), of_range - 1)
    docs = docs.withColumn("bucket", (F.col("range") + 1) * (1 << 20) + part).drop("range")
    tops = F.broadcast(docs.groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("top")))  # one row a bucket
    tops = tops.withColumnRenamed("bucket", "_bucket")
    at_top = (docs["bucket"] == tops["_bucket"]) & F.struct("doc_id", "hash").eqNullSafe(F.col("top"))
    first = docs.join(tops, at_top, "left_semi").groupBy("bucket").agg(F.max("text").alias("text"))
    order = W.orderBy(F.col("bucket").desc())
    following = [F.coalesce(F.lead(c).over(order), F.first(c).over(order)).alias(f"first_{c}") for c in ("text",)]
    heads = materialize(with_fingerprint(first.select("bucket", *following), "first_text", "first_fp", k, shingle), "fingerprint-heads")
    size = heads.agg(F.sum(F.octet_length("first_text") + 8 * F.size("first_fp"))).first()[0] or 0
    heads = heads.withColumnRenamed("bucket", "_at")
    heads = F.broadcast(heads) if size <= BROADCAST_BYTES else heads

    line = W.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc())
    own = with_fingerprint(docs.repartition("bucket"), "text", "fp", k, shingle)
    own = own.withColumns({"next_text": F.lead("text").over(line), "next_fp": F.lead("fp").over(line)})
    # Only a range's last document looks its next up; the others get keys that
    # match nothing, spread so that no join partition collects them.
    key = F.when(F.col("next_text").isNull(), F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 20))).cast("long")
    both = own.withColumn("_key", key).join(heads, F.col("_key") == heads["_at"], "left")
    both = both.withColumns({"next_text": F.coalesce("next_text", "first_text"), "next_fp": F.coalesce("next_fp", "first_fp")})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    both = with_fingerprint(both, "edited", "edited_fp", k, shingle)
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
        distinct_shingles(F.col("fp"), k).alias("distinct_shingles"), containment(F.col("fp"), F.col("edited_fp"), k).alias("contained_in_edited"),
    )
