"""Reshaping of metric tables: unions, pivots, rankings, frontiers, running bests."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.operators.ranking import top_per_group

# Weight of each normalised metric, and those where less is better.
WEIGHTS = {"fertility": 0.35, "compression": 0.20, "subword_entropy": 0.15, "vocab_coverage": 0.15, "morfem_alignment": 0.10, "oov_rate": 0.03, "encode_ms": 0.02}
LESS_IS_BETTER = ("fertility", "oov_rate", "encode_ms")


def merge_runs(runs: dict[str, DataFrame], tag: str = "run") -> DataFrame:
    """All runs in one table, named by ``tag``; missing columns are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in runs.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def pivot_metric(long: DataFrame, rows: str, columns: str, values: list[str], value: str = "value") -> DataFrame:
    """One value of each (row, column) cell; ``values`` names the columns, so one pass is enough.

    Of several values in a cell the smallest is taken, so reruns agree.
    """
    return long.groupBy(rows).pivot(columns, values).agg(F.min(value))


#: The ablation report's tables: name, category, metric, and whether one model's rows are meant.
ABLATIONS = (
    ("coherence", "coherence", "delta", False),
    ("boundary_f1", "boundary", "f1", False),
    ("fertility", "fertility", "tokens_per_word", True),
    ("agreement", "agreement", "boundary_agreement_pct", True),
)


def ablation_report(merged: DataFrame, strata: list[str], model: str, tables: tuple = ABLATIONS) -> dict[str, DataFrame]:
    """Pivots of the run by the stratum, one a table of ``tables``; ``merged`` has run, category, metric, stratum, model, value."""
    out = {}
    for name, category, metric, one_model in tables:
        rows = merged.filter((F.col("category") == category) & (F.col("metric") == metric))
        rows = rows.filter(F.col("model") == model) if one_model else rows
        out[name] = pivot_metric(rows, "run", "stratum", strata)
    return out


def stacked(tables: dict[str, DataFrame]) -> DataFrame:
    """Pivots with the same columns as one table, named by ``report``."""
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("report"), "*") for name, df in tables.items()])


def subset(df: DataFrame, name: str, wanted: str | None) -> DataFrame:
    """The rows whose ``name`` is in a comma list; an empty list or None keeps all."""
    names = [x.strip() for x in (wanted or "").split(",") if x.strip()]
    return df.filter(F.col(name).isin(names)) if names else df


def named(df: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """The rows whose name contains the pattern, such as '32K|32000'."""
    return df.filter(F.regexp_like(name, F.lit(pattern)))


def curves(df: DataFrame, order: str, name: str = "name") -> DataFrame:
    """``df`` with ``method`` (the name up to its first hyphen) and ``step``, the place in its method by ``order``."""
    method = F.get(F.split(name, "-"), F.lit(0))
    step = F.row_number().over(W.partitionBy("method").orderBy(order, name))
    return df.withColumn("method", method).withColumn("step", step)


def inference_rates(df: DataFrame) -> DataFrame:
    """``df`` (tokens_per_sec, ms_per_token, tokens_per_char) with characters a second and milliseconds a character."""
    fertility = F.col("tokens_per_char")
    rate = F.when(fertility > 0, F.col("tokens_per_sec") / fertility)
    return df.withColumns({"chars_per_sec": rate, "ms_per_char": F.col("ms_per_token") * fertility})


def unpivot(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(ids, metrics, "metric", "value")


def unpivot_suffix(wide: DataFrame, ids: list[str], suffix: str, name: str = "model") -> DataFrame:
    """ids, model, value from columns <model>_<suffix>."""
    columns = [c for c in wide.columns if c.endswith(f"_{suffix}")]
    return wide.select(*ids, *columns).unpivot(ids, columns, name, "value").withColumn(name, F.regexp_replace(name, f"_{suffix}$", ""))


def normalised(c: str, less_is_better: bool) -> Column:
    everything = W.partitionBy()
    low, high = F.min(c).over(everything), F.max(c).over(everything)
    share = (F.col(c) - low) / (high - low)
    return F.when(high > low, 1 - share if less_is_better else share).otherwise(1.0)


def weighted_ranking(df: DataFrame, weights: dict[str, float] = WEIGHTS, less: tuple[str, ...] = LESS_IS_BETTER) -> DataFrame:
    """``df`` with ``<metric>_norm`` (min-max) and ``weighted_score``; one row a model."""
    scored = df.withColumns({f"{c}_norm": normalised(c, c in less) for c in weights})
    score = functools.reduce(lambda a, b: a + b, [F.col(f"{c}_norm") * w for c, w in weights.items()])
    return scored.withColumn("weighted_score", score)


def leaderboard(df: DataFrame, metric: str, name: str) -> DataFrame:
    """``df`` with its place by falling metric, ties by name."""
    return df.withColumn("place", F.row_number().over(W.orderBy(F.desc(metric), name)))


def best_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return top_per_group(df, group, order, n).drop("rank")


def in_order(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``df`` with ``place`` in a caller's list; unknown names come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    return df.withColumn("place", F.when(at == 0, len(order) + 1).otherwise(at).cast("int"))


def pareto_frontier(df: DataFrame, more: str, less: str) -> DataFrame:
    """Rows that no other row beats in one measure without losing in the other; one pass in order."""
    before = W.orderBy(F.asc(less), F.desc(more)).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(more).over(before)
    return df.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col(more) > F.col("_best"))).drop("_best")


def running_best(df: DataFrame, by: list[str], order: list[str], value: str, lowest: bool = True) -> DataFrame:
    """``df`` with the best value so far and the number of rows since it was reached."""
    past = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    best = (F.min if lowest else F.max)(value).over(past)
    before = (F.min if lowest else F.max)(value).over(past.rowsBetween(W.unboundedPreceding, -1))
    better = F.col(value) < F.col("_before") if lowest else F.col(value) > F.col("_before")
    marked = df.withColumn("best", best).withColumn("_before", before).withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    last = F.max(F.when(F.col("_before").isNull() | better, F.col("_at"))).over(past)
    return marked.withColumn("since_best", F.col("_at") - last).drop("_before", "_at")


def lossy(accuracy: Column, least: float = 0.999) -> Column:
    return F.when(accuracy < least, "lossy").otherwise("lossless")


def schedule(step: Column, start: float, decay: float, end: float) -> Column:
    """Geometric decay applied at the end of each epoch, with a floor."""
    return F.greatest(F.lit(end), F.lit(start) * F.pow(F.lit(decay), F.greatest(step - 1, F.lit(0))))


def winner(df: DataFrame, name: str = "name", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The row with the highest weighted score, ties by name."""
    return weighted_ranking(df, weights).orderBy(F.desc("weighted_score"), name).limit(1)


def wide_segments(long: DataFrame, models: list[str]) -> DataFrame:
    """word with one column of pieces and one of their number a model."""
    return long.groupBy("word").pivot("model", models).agg(F.first("seg").alias("seg"), F.first("n").alias("n"))
