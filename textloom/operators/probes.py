"""Probe sets from tagged gold rows: labels by tag, class sizes, bins, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def count_bin(count: Column, most: int = 6) -> Column:
    """A count as a class: 1 to ``most``, from 0 on."""
    return F.least(F.greatest(count, F.lit(1)), F.lit(most)) - 1


def tagged(rows: DataFrame, tasks: dict[str, list[str]], features: str = "features") -> DataFrame:
    """``rows`` with ``task`` and ``label``, once for each task of whose tags a row has exactly one."""
    found = [F.struct(F.lit(task).alias("task"), F.array_intersect(features, F.array(*map(F.lit, tags))).alias("tags")) for task, tags in tasks.items()]
    each = rows.withColumn("_task", F.explode(F.filter(F.array(*found), lambda t: F.size(t["tags"]) == 1)))
    return each.select(*rows.columns, F.col("_task.task").alias("task"), F.get("_task.tags", F.lit(0)).alias("label"))


def large_classes(rows: DataFrame, least: int = 20, classes: int = 2) -> DataFrame:
    """``rows`` (task, label, ...) of labels with ``least`` rows, in tasks that keep ``classes`` such labels.

    Counts are one row a label, so the join is a broadcast and rows do not move.
    """
    sizes = rows.groupBy("task", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    tasks = sizes.groupBy("task").agg(F.count(F.lit(1)).alias("labels")).filter(F.col("labels") >= classes)
    kept = sizes.join(tasks, "task").select("task", "label")
    return rows.join(kept, ["task", "label"], "left_semi").select(*rows.columns)


def resolved(gold: DataFrame, fallback: DataFrame) -> DataFrame:
    """``gold`` if it has a row, else ``fallback`` (the same columns)."""
    return gold if gold.limit(1).count() else fallback.select(*gold.columns)
