"""Mixing sources to target weights, in whole blocks of words.

Each source has a weight by its place in code-point order (5, 2, 1, repeating,
null last). The sources share ``share`` times all words in proportion to their
weights, but none gets more than ``most`` times its own words; what a stopped
source leaves is reshared among the others by weight.

Targets become whole blocks of equal size by Sainte-Lague: each seat goes to the
highest quotient votes / (2 * seats + 1), first among sources (votes: targets),
then among the shards of a source (votes: words). A block has ``block_words``
words, or fewer where a small source's target would be under ``least_blocks``
blocks. In a shard the documents lie end to end in a seeded order; the shard's
quota is a run of blocks from a seeded starting block, going round at the end. So
all but the two documents at the run's ends are taken whole, and a second time
round takes them twice.

All seats compete. With S seats, V votes and M rows, the divisor at which
rounding deals S seats lies between V / (S + M / 2) and V / (S - M / 2), as
rounding moves a row by half a seat at most. Seats below the one end are won and
above the other lost whatever the rest, so only those between, at most about four
a row, are ranked by quotient.

Only built-in functions; documents are reduced to (id, digest of the text,
source, size) in the first pass. Windows run over one row a source, a few rows a
shard of one source, and the documents of one shard. Shards hold ``shard_words``
words, or 16 times the root of their source's words where that is more, so both
their number and their size stay far below the source's. A hot source is many shards.

Defined results: a null text has size 0; null is a source of its own, the last;
a null id orders as ''. Size 0 takes 0. Rows with equal id and text are
interchangeable: each gets one of the group's counts (their mean, rounded down,
in :func:`mix_documents`). No documents: no rows. Extra columns are ignored by
:func:`mix_words` and kept by :func:`mix_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST, BLOCK_WORDS, LEAST_BLOCKS, SHARD_WORDS, SEED = 1.5, 2, 64, 16, 250_000, "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row a source: place, source_size, target; from (source, size) rows."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, order = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    placed = totals.withColumn("place", F.row_number().over(order).cast("long")).withColumn("total", F.sum("source_size").over(everything))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    # In order of cap / weight those that stop come first: source k stops if,
    # with all before it stopped, its share of the rest is above its cap.
    filled = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place"))
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("total") * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    filled = filled.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(final * F.col("weight"))
    return filled.select("source", "place", "source_size", "total", target.alias("target"))


def apportioned(df: DataFrame, per: list[str], votes: str, seats: Column, ties: list[str]) -> DataFrame:
    """``df`` with ``quota``: ``seats`` dealt by highest quotients votes / (2 * n + 1) among the rows of ``per``.

    Ties go by ``ties``. Rows without votes get nothing.
    """
    every = W.partitionBy(*per)
    count, total = F.sum((F.col(votes) > 0).cast("long")).over(every), F.sum(votes).over(every).cast("double")
    half, part = count / 2, F.col(votes) / F.greatest(total, F.lit(1e-9))
    # One seat further than the bounds, against rounding.
    low = F.greatest(F.floor(part * (seats - half) + 0.5) - 1, F.lit(0)).cast("long")
    high = F.greatest(F.ceil(part * (seats + half) + 0.5) + 1, F.lit(0)).cast("long")
    based = df.withColumns({"_seats": seats.cast("long"), "_low": low, "_high": high})
    open_ = F.col("_seats") - F.sum("_low").over(every)
    tried = based.withColumn("_open", open_).withColumn("_seat", F.explode(F.sequence("_low", "_high")))
    tried = tried.withColumn("_quotient", F.col(votes) / (F.col("_seat") * 2 + 1))
    best = every.orderBy(F.col("_quotient").desc(), *ties, "_seat")
    won = (F.row_number().over(best) <= F.col("_open")) & (F.col(votes) > 0)
    ranked = tried.withColumn("_won", won)
    return ranked.groupBy(*df.columns).agg((F.first("_low") + F.count_if("_won")).alias("quota"))


def block_size(sources: DataFrame, block_words: int, least_blocks: int) -> DataFrame:
    """``sources`` with ``block``: words of a block, so that the smallest target has ``least_blocks``."""
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy())
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(smallest / least_blocks)))
    return sources.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))


def _intervals(docs: DataFrame, block_words: int, least_blocks: int, shard_words: int, seed: str) -> DataFrame:
    """``docs`` (doc_id, digest, source, size) with target, lo, hi, whole, start, run, shard_size."""
    shards = F.greatest(F.ceil(F.col("source_size") / F.greatest(F.lit(float(shard_words)), F.sqrt("source_size") * 16)), F.lit(1))
    sources = block_size(source_targets(docs), block_words, least_blocks).withColumn("shards", shards.cast("long"))
    sources = apportioned(sources, [], "target", F.round(F.col("total") * F.lit(SHARE) / F.col("block")), ["place"])
    sources = materialize(sources.withColumnRenamed("quota", "seats"), "mix-sources", small=True)
    same = docs["source"].eqNullSafe(sources["source"])
    dealt = docs.join(sources.select("source", "place", "source_size", "target", "shards"), same).drop(sources["source"])
    dealt = dealt.withColumn("order", _seeded(seed, F.col("doc_id"), F.col("digest"))).withColumn("shard", _number(F.col("order"), 17) % F.col("shards"))
    sized = dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size")).join(sources.select("place", "seats", "block"), "place")
    quotas = apportioned(sized, ["place"], "shard_size", F.col("seats"), ["shard"])
    block, size = F.col("block"), F.col("shard_size")
    start = (_number(_seeded(seed, F.col("place"), F.col("shard")), 1) % F.greatest(F.ceil(size / block), F.lit(1))) * block
    taken = F.least(F.col("quota") * block, size * MOST)
    quotas = quotas.withColumn("start", start).withColumn("whole", F.floor(taken / F.greatest(size, F.lit(1)))).withColumn("run", taken - F.col("whole") * size)
    quotas = materialize(quotas.select("place", "shard", "shard_size", "start", "whole", "run"), "mix-quotas", small=True)
    line = W.partitionBy("place", "shard").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = dealt.withColumn("hi", F.sum("size").over(line)).withColumn("lo", F.col("hi") - F.col("size"))
    return laid.join(quotas, ["place", "shard"])


def _overlap(lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(F.col("hi"), hi) - F.greatest(F.col("lo"), lo), F.lit(0))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _counts(docs: DataFrame, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, digest, size, source_size, target, taken of every document."""
    text = F.col("text").cast("string")
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), _digest(text).alias("digest"), words(text).alias("size"))
    laid = _intervals(materialize(sizes, "mix-sizes"), block_words, least_blocks, shard_words, seed)
    end = F.col("start") + F.col("run")
    taken = F.col("whole") * F.col("size") + _overlap(F.col("start"), F.least(end, F.col("shard_size"))) + _overlap(F.lit(0), end - F.col("shard_size"))
    return laid.select("doc_id", "digest", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return _counts(docs, **options).drop("digest")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``.

    A document taken n times is n rows; of one taken in part the row holds its
    first words, as many as are taken. ``n_chars``, where there is one, follows
    the text.
    """
    counts = _counts(docs, **options).groupBy("doc_id", "digest").agg(F.floor(F.avg("taken")).cast("long").alias("taken"), F.max("size").alias("size"))
    counts = counts.filter("taken > 0").select(F.struct("doc_id", "digest", "taken", "size").alias("mix"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    joined = rows.join(counts, F.col("row.doc_id").eqNullSafe(F.col("mix.doc_id")) & (_digest(text) == F.col("mix.digest")))
    size, taken = F.greatest(F.col("mix.size"), F.lit(1)), F.col("mix.taken")
    rest = (taken % size).cast("int")
    joined = joined.withColumn("pieces", F.when(rest > 0, F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")))
    lead = F.when(F.regexp_like(F.element_at("pieces", 1), F.lit("[^\x20\x09-\x0d]")), 0).otherwise(1)
    part = F.array_join(F.slice(F.col("pieces"), 1, rest + lead), "")
    texts = F.concat(F.array_repeat(text, F.floor(taken / size).cast("int")), F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    mixed = joined.select("row", F.explode(texts).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return mixed.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
