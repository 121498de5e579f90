"""Connected components of a large graph, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node in ``edges`` (src, dst); root is the component's smallest node.

    Each round lets every node point at its smallest neighbour if that is below
    itself, follows the pointers to their ends and contracts the edges to those
    ends, until no edge is left: a number of rounds logarithmic in the nodes, one
    or two where groups are linked to leaders. Every step is an aggregation with
    map-side combining or an equi-join of two written tables, which adaptive
    execution can split on a skewed key; nothing but counts reaches the driver.
    Self-loops give a node of its own; nulls are dropped.
    """
    edges = edges.select("src", "dst").filter("src is not null and dst is not null")
    labels: DataFrame | None = None
    while True:
        both = edges.union(edges.select("dst", "src"))
        lowest = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        parents = written = materialize(lowest.select("node", F.least("node", "low").alias("root")), "component-parents", small=True)
        while True:
            up = parents.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
            jumped = materialize(parents.join(up, parents["root"] == up["_node"]).select("node", F.col("_root").alias("root"), (F.col("_root") != F.col("root")).alias("moved")), "component-jumps", small=True)
            release(written)
            written, parents = jumped, jumped.drop("moved")
            if not jumped.filter("moved").limit(1).count():
                break
        before, labels = labels, parents if labels is None else _follow(labels, parents)
        release(before)
        one, two = (parents.select(F.col("node").alias(f"_{x}"), F.col("root").alias(x)) for x in ("a", "b"))
        contracted = edges.join(one, edges["src"] == one["_a"]).select("a", "dst").join(two, F.col("dst") == two["_b"]).filter("a <> b")
        edges = materialize(contracted.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "component-edges", small=True)
        if not edges.limit(1).count():
            return labels


def _follow(labels: DataFrame, parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = labels.join(up, labels["root"] == up["_node"], "left")
    return materialize(joined.select("node", F.coalesce("_root", "root").alias("root")), "component-labels", small=True)
