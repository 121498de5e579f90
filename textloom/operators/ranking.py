"""Global ranks and splits without a single-task sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Rows that a range of hashes should hold.
RANGE_ROWS = 250_000


def hashed_rank(df: DataFrame, key: Column, ties: list[str], by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``df`` with ``position`` (1, 2, ... in each group of ``by``) in the order of the md5 of ``key``, then ``ties``.

    md5 is uniform, so its first digits part the rows into 16 ** digits even
    ranges: rows are ranked within a range (a window partition each) and ranges
    are offset by their counts. The number of digits follows the number of rows.
    """
    by = by or []
    if digits is None:
        digits = max(1, min(6, math.ceil(math.log(max(1, df.count() / RANGE_ROWS), 16))))
    df = df.withColumn("_h", F.md5(key)).withColumn("_part", F.substring("_h", 1, digits))
    order = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.struct(*by, "_part").alias("_range"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_h", *ties))
    ranked = df.withColumn("_own", own).join(before, F.struct(*by, "_part").eqNullSafe(F.col("_range")))
    return ranked.withColumn("position", F.col("_own") + F.col("_before")).drop("_h", "_part", "_own", "_before", "_range")


def seeded(seed: int, *keys: str) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])


def exact_split(df: DataFrame, keys: list[str], ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: 'train' for int(n * ratio) rows in seeded order, else 'test'."""
    total = df.count()
    ranked = hashed_rank(df, seeded(seed, *keys), keys)
    return ranked.withColumn("split", F.when(F.col("position") <= int(total * ratio), "train").otherwise("test")).drop("position")


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by smallest seeded hash; a distributed top-n."""
    return df.orderBy(F.md5(seeded(seed, *keys)), *keys).limit(n)


def stratified_folds(df: DataFrame, label: str, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: labels dealt evenly in seeded order; a frequent label is many ranges."""
    ranked = hashed_rank(df, seeded(seed, *keys), keys, [label])
    return ranked.withColumn("fold", ((F.col("position") - 1) % k).cast("int")).drop("position")


def batches(df: DataFrame, keys: list[str], size: int, seed: int = 42, drop_last: bool = True) -> DataFrame:
    """``df`` with ``batch``: shuffled groups of ``size`` rows, the incomplete last one dropped."""
    ranked = hashed_rank(df, seeded(seed, *keys), keys).withColumn("batch", F.floor((F.col("position") - 1) / size)).drop("position")
    if not drop_last:
        return ranked
    return ranked.filter(F.col("batch") < df.count() // size)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each task's rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def first_per_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """First occurrence of each key by ``order``; one aggregated struct a key, combined map-side."""
    rest = [c for c in df.columns if c not in order]
    picked = df.groupBy(key.alias("_key")).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return picked.select("_first.*").select(*df.columns)
