"""Nearest neighbours, retrieval and verification metrics, coherence, analogies.

Vector tables have id, label and unit (array<double> of length one, see
:func:`unit_vectors`). Searches compare a stated, bounded query table with all
rows, in numpy blocks (:mod:`textloom.operators.similar`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions import vectors as V
from textloom.operators import similar

#: Most bytes of queries that are broadcast at once.
BROADCAST_BYTES = similar.BROADCAST_BYTES
#: Ranges of similarity to a unit of cosine.
RANGES = 2048


def unit_vectors(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """id, label, unit of the rows that have a vector."""
    return df.filter(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(label).alias("label"), V.unit(V.doubles(F.col(vector))).alias("unit"))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query, rank, id, sim of the ``k`` nearest rows, ties by id."""
    order = W.partitionBy("query").orderBy(F.desc("sim"), "id")
    found = similar.nearest(queries, rows, k, BROADCAST_BYTES).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query", "rank", "id", "sim")


def neighbour_purity(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """n and share: of the ``k`` nearest of each query, how many have its label."""
    found = nearest(queries, rows, k).join(rows.select("id", "label"), "id").join(queries.select(F.col("id").alias("query"), F.col("label").alias("query_label")), "query")
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("query_label")).cast("int")).alias("share"))


def side_by_side(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two neighbour lists by query and rank; missing neighbours are empty."""
    a, b = (x.select("query", "rank", F.col("id").alias(f"{n}_id"), F.col("sim").alias(f"{n}_sim")) for x, n in ((one, "one"), (two, "two")))
    return a.join(b, ["query", "rank"], "full")


def retrieval_metrics(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """MAP, MRR, R@1, R@5, precision at R and purity, in one row.

    Queries without a relevant row add nothing but count in every mean but purity.
    """
    each = similar.ranks(queries, rows, k, BROADCAST_BYTES)
    some = F.col("n_rel") > 0
    n = queries.agg(F.count(F.lit(1)).alias("n"))
    sums = each.agg(F.sum("ap").alias("ap"), F.sum(1.0 / F.col("first")).alias("rr"), F.sum("r1").alias("r1"), F.sum("r5").alias("r5"), F.sum("pr").alias("pr"), F.sum(F.when(some, F.col("pure"))).alias("pure"), F.count_if(some).alias("some"))
    mean = lambda c, name: (F.coalesce(F.col(c), F.lit(0)) / F.greatest("n", F.lit(1))).cast("double").alias(name)
    return sums.crossJoin(n).select(mean("ap", "map"), mean("rr", "mrr"), mean("r1", "recall_1"), mean("r5", "recall_5"), mean("pr", "precision_r"), (F.coalesce(F.col("pure"), F.lit(0)) / F.greatest(F.col("some") * k, F.lit(1))).alias("purity"))  # one row each


def verification(pairs: DataFrame) -> DataFrame:
    """:func:`counted_verification` of (sim, same) pairs."""
    same = F.col("same").cast("long")
    return counted_verification(pairs.select("sim", F.coalesce(same, F.lit(0)).alias("pos"), F.coalesce(1 - same, F.lit(0)).alias("neg")))


def counted_verification(counts: DataFrame) -> DataFrame:
    """ROC AUC, average precision, best F1 and its threshold of (sim, pos, neg) counts, in one row.

    Counts of equal similarities are summed, so the running sums go over distinct
    scores, within ranges that are offset by those before; null is the lowest. The
    best threshold is the lowest with the highest F1 (to 12 places), chosen on the
    pairs that are scored.
    """
    place = F.when(F.col("sim").isNull(), 4 * RANGES).when(F.isnan("sim"), -4 * RANGES).otherwise(F.floor((1 - F.col("sim")) * RANGES)).cast("long")
    scores = counts.groupBy("sim").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("range", place)
    ranges = scores.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above, everything = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()  # a row a range
    offset = lambda c, name: F.coalesce(F.sum(c).over(above), F.lit(0)).alias(name)
    ranges = ranges.select("range", offset("pos", "_tp"), offset("neg", "_fp"), F.sum("pos").over(everything).alias("p"), F.sum("neg").over(everything).alias("n"))
    down = W.partitionBy("range").orderBy(F.desc("sim")).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = scores.withColumns({"_own_tp": F.sum("pos").over(down), "_own_fp": F.sum("neg").over(down)}).join(ranges, "range")
    run = own.select("sim", "pos", "neg", (F.col("_own_tp") + F.col("_tp")).alias("tp"), (F.col("_own_fp") + F.col("_fp")).alias("fp"), "p", "n")
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest("p", F.lit(1))
    f1 = F.when(F.col("tp") > 0, F.round(2 * precision * recall / (precision + recall), 12)).otherwise(0.0)
    run = run.withColumns({"f1": f1, "area": F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2.0), "step": precision * F.col("pos") / F.greatest("p", F.lit(1))})
    out = run.agg(F.sum("area").alias("area"), F.sum("step").alias("ap"), F.max(F.struct(F.col("f1"), (-F.col("sim")).alias("low"))).alias("best"), F.max("p").alias("p"), F.max("n").alias("n"))
    return out.select((F.col("area") / F.greatest(F.col("p") * F.col("n"), F.lit(1))).alias("roc_auc"), F.col("ap").alias("average_precision"), F.col("best.f1").alias("best_f1"), (-F.col("best.low")).alias("best_threshold"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def same_label_pairs(rows: DataFrame) -> DataFrame:
    """one, other, label of the pairs of each label, smaller id first."""
    a, b = rows.select(F.col("id").alias("one"), "label"), rows.select(F.col("id").alias("other"), "label")
    return a.join(b, "label").filter(F.col("one") < F.col("other")).select("one", "other", "label")


def batch_positives(rows: DataFrame) -> DataFrame:
    """one, other: ordered pairs of a training batch's rows (batch, id, root) with the same known root.

    Batches have a fixed size, which bounds the pairs of a row.
    """
    a = rows.filter("root > 0").select("batch", "root", F.col("id").alias("one"))
    b = rows.filter("root > 0").select("batch", "root", F.col("id").alias("other"))
    return a.join(b, ["batch", "root"]).filter(F.col("one") != F.col("other")).select("one", "other")


def coherence(rows: DataFrame, least: int = 2) -> DataFrame:
    """Mean cosine inside labels (mean of label means), between labels, and the difference.

    The cosines of a group's n unit vectors sum to |sum|^2 - n over its ordered
    pairs, so both means come from one sum of vectors a label: linear, and exact
    for all pairs where a sample would only estimate.
    """
    dims = rows.filter("label is not null").select("label", F.posexplode("unit").alias("dim", "x"))
    sums = dims.groupBy("label", "dim").agg(F.sum("x").alias("x"))
    sizes = rows.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    squares = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("square")).join(sizes, "label")
    whole = sums.groupBy("dim").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all_square"))
    inside = F.avg(F.when(F.col("n") >= least, (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))))
    sums_of = squares.agg(inside.alias("intra"), F.count_if(F.col("n") >= least).alias("groups"), F.sum("square").alias("own"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("own_pairs"))
    between = (F.col("all_square") - F.col("own")) / F.greatest(F.col("rows") * F.col("rows") - F.col("own_pairs"), F.lit(1))
    out = sums_of.crossJoin(whole).withColumn("inter", between)  # one row each
    return out.select("groups", "intra", "inter", (F.col("intra") - F.col("inter")).alias("delta"))


def analogy_pairs(segmented: DataFrame, least: int = 8, most: int = 100) -> DataFrame:
    """suffix, a, a2, b, b2: words root + suffix whose root is itself an unsegmented word.

    Up to ``most`` ordered pairs a suffix with ``least`` words or more, by hash.
    """
    two = segmented.filter(F.size("segs") == 2).select("word", F.get("segs", F.lit(0)).alias("root"), F.get("segs", F.lit(1)).alias("suffix"))
    plain = segmented.filter((F.size("segs") == 1) & (F.get("segs", F.lit(0)) == F.col("word"))).select(F.col("word").alias("root"))
    examples = two.join(plain, "root", "left_semi")
    # Each example meets the next few in hash order: bounded, without a self-join.
    order = W.partitionBy("suffix").orderBy(F.md5("word"), "word")
    size = F.count(F.lit(1)).over(W.partitionBy("suffix"))
    paired = examples.select("suffix", "root", "word", F.row_number().over(order).alias("at"), size.alias("n"), F.lead("root").over(order).alias("b"), F.lead("word").over(order).alias("b2"))
    return paired.filter((F.col("n") >= least) & F.col("b").isNotNull() & (F.col("at") <= most)).select("suffix", F.col("root").alias("a"), F.col("word").alias("a2"), "b", "b2")


def analogy_accuracy(analogies: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """Share of analogies whose answer is among the ``k`` nearest, and its mean rank.

    ``analogies`` has a, a2, b, b2 ids; ``rows`` id and unit. The targets are the
    bounded query side; ranks are counts of nearer rows, so no list is sorted.
    """
    named = analogies.select("a", "a2", "b", "b2").distinct()
    for c in ("a", "a2", "b", "b2"):
        named = named.join(rows.select(F.col("id").alias(c), F.col("unit").alias(f"{c}_unit")), c)
    target = V.unit(V.offset(F.col("a_unit"), F.col("a2_unit"), F.col("b_unit")))
    asked = named.select("a", "a2", "b", "b2", target.alias("target"), F.col("b2_unit"))
    asked = asked.withColumn("gold", V.dot(F.col("target"), F.col("b2_unit"))).drop("b2_unit")
    nearer = similar.counts_above(asked, rows, ["a", "a2", "b", "b2"], ["a", "a2", "b"], "target", "gold", BROADCAST_BYTES)
    ranks = nearer.withColumn("rank", F.col("nearer") + 1)
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") <= k).cast("int")).alias("accuracy"), F.avg("rank").alias("mean_rank"))


def mean_pool(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector of each group."""
    dims = rows.select(*by, F.posexplode(V.doubles(F.col(vector))).alias("dim", "x"))
    means = dims.groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return means.groupBy(*by).agg(vectors.alias("mean"))


def negative_pairs(rows: DataFrame, n: int, bucket_rows: int = 10_000) -> DataFrame:
    """Up to ``n`` hash-chosen pairs with different labels, within hash buckets of about ``bucket_rows`` rows."""
    buckets = max(1, rows.count() // bucket_rows)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    order = W.partitionBy("bucket").orderBy(F.md5(F.col("id").cast("string")), "id")
    ahead = F.array(*[F.struct(F.lead("id", j).over(order).alias("id"), F.lead("label", j).over(order).alias("label")) for j in range(1, 9)])
    met = dealt.withColumn("ahead", ahead).select("id", "label", F.explode("ahead").alias("o")).filter(F.col("o.id").isNotNull() & (F.col("label") != F.col("o.label")))
    chosen = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("o.id").cast("string")))
    return met.select(F.col("id").alias("one"), F.col("o.id").alias("other"), chosen.alias("_h")).orderBy("_h").limit(n).drop("_h")


def log_sum_exp(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Stable log-sum-exp a group: the value of contrastive losses over a table."""
    top = rows.groupBy(*by).agg(F.max(value).alias("_top"))
    summed = rows.join(top, by).groupBy(*by).agg(F.first("_top").alias("_top"), F.sum(F.exp(F.col(value) - F.col("_top"))).alias("_sum"))
    return summed.select(*by, (F.col("_top") + F.log("_sum")).alias("log_sum_exp"))


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(value * mask) / F.greatest(F.sum(mask), F.lit(1))
