"""Queries on embeddings. Searches ask every id divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import learners, ranking, retrieval, similar
from textloom.plans import sqlparts as P
from textloom.plans.registry import query, table

_SIMS = f"""{P.UNITS}, sims AS (SELECT q.id AS query, q.label AS query_label, r.id, r.label, list_dot_product(q.unit, r.unit) AS sim
  FROM units q JOIN units r ON q.id <> r.id WHERE q.id % 50 = 0)"""


def _rows(spark, sf_dir):
    return retrieval.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _asked(rows):
    return rows.filter(F.col("id") % 50 == 0)


@query(f"WITH {_SIMS} SELECT query, rank::INT AS rank, id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM sims) WHERE rank <= 5")
def cosine_knn(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return retrieval.nearest(_asked(rows), rows, 5).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER w AS rank, (label = query_label)::INT AS rel FROM sims WINDOW w AS (PARTITION BY query ORDER BY sim DESC, id)),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS hits, sum(rel) OVER (PARTITION BY query) AS n_rel FROM r),
e AS (SELECT query, any_value(n_rel) AS n_rel, sum(rel * hits / rank) / greatest(any_value(n_rel), 1) AS ap, min(rank) FILTER (WHERE rel = 1) AS first, sum(rel) FILTER (WHERE rank <= 1) AS r1,
  sum(rel) FILTER (WHERE rank <= 5) / greatest(least(5, any_value(n_rel)), 1) AS r5, sum(rel) FILTER (WHERE rank <= n_rel) / greatest(any_value(n_rel), 1) AS pr, sum(rel) FILTER (WHERE rank <= 5) AS pure FROM h GROUP BY query)
SELECT round(sum(ap) / count(*), 9) AS map, round(sum(1.0 / first) / count(*), 9) AS mrr, round(sum(r1) / count(*), 9) AS recall_1, round(sum(r5) / count(*), 9) AS recall_5, round(sum(coalesce(pr, 0)) / count(*), 9) AS precision_r,
  round(sum(pure) FILTER (WHERE n_rel > 0) / greatest(5 * count(*) FILTER (WHERE n_rel > 0), 1), 9) AS purity FROM e""")
def retrieval_metrics(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = retrieval.retrieval_metrics(_asked(rows), rows, 5)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"""WITH {_SIMS}, s AS (SELECT round(sim, 6) AS sim, sum((label = query_label)::INT) AS pos, sum((label <> query_label)::INT) AS neg FROM sims GROUP BY 1),
r AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s WINDOW d AS (ORDER BY sim DESC)),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / greatest(p, 1)) / (tp / (tp + fp) + tp / greatest(p, 1)) ELSE 0 END AS f1 FROM r)
SELECT round(sum(pos * (n - fp + neg / 2)) / greatest(max(p) * max(n), 1), 9) AS roc_auc, round(sum(tp / (tp + fp) * pos / greatest(p, 1)), 9) AS average_precision, round(max(f1), 9) AS best_f1,
  (SELECT sim FROM f ORDER BY round(f1, 12) DESC, sim LIMIT 1) AS best_threshold, max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives FROM f""")
def pair_verification(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = retrieval.counted_verification(similar.counts(_asked(rows), rows, 6))
    return out.select(*[F.round(c, 9).alias(c) for c in ("roc_auc", "average_precision", "best_f1")], "best_threshold", "positives", "negatives")


@query(f"""WITH {P.UNITS}, p AS (SELECT a.label AS one, b.label AS other, list_dot_product(a.unit, b.unit) AS sim FROM units a JOIN units b ON a.id <> b.id),
i AS (SELECT one, avg(sim) AS m FROM p WHERE one = other GROUP BY one)
SELECT (SELECT count(*) FROM i) AS groups, round((SELECT avg(m) FROM i), 6) AS intra, round((SELECT avg(sim) FROM p WHERE one <> other), 6) AS inter, round((SELECT avg(m) FROM i) - (SELECT avg(sim) FROM p WHERE one <> other), 6) AS delta""")
def label_coherence(spark, sf_dir):
    out = retrieval.coherence(_rows(spark, sf_dir))
    return out.select("groups", *[F.round(c, 6).alias(c) for c in ("intra", "inter", "delta")])


@query("SELECT label, n * (n - 1) // 2 AS pairs FROM (SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY label) WHERE n > 1")
def same_label_pairs(spark, sf_dir):
    pairs = retrieval.same_label_pairs(_rows(spark, sf_dir))
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"))


@query("""SELECT label, dim::INT AS dim, round(avg(x), 9) AS x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL""")
def mean_pooling(spark, sf_dir):
    means = retrieval.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("dim", "x")).withColumn("x", F.round("x", 9))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, 4 * len(a) AS size, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 6) AS distance, round(list_dot_product(a, b), 6) AS product FROM p""")
def pair_features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    made = rows.join(after, "vec_id").select("vec_id", V.pair_features(F.col("a"), F.col("b")).alias("f"), F.size("a").alias("n"))
    part = lambda k: F.aggregate(F.slice("f", F.col("n") * k + 1, F.col("n")), F.lit(0.0), lambda s, x: s + x)
    return made.select("vec_id", F.size("f").cast("long").alias("size"), F.round(part(2), 6).alias("distance"), F.round(part(3), 6).alias("product"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: [1 / (1 + exp(-x))]) AS p FROM embeddings),
r AS (SELECT vec_id, list_reduce(p, lambda f, q: [f[1] * (1 - q[1]), f[2] * (1 - q[1]) + f[1] * q[1], f[3] + f[2] * q[1]], [1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS f FROM p)
SELECT vec_id, round(f[1], 9) AS first, round(f[2], 9) AS second, round(f[3], 9) AS third FROM r""")
def soft_membership(spark, sf_dir):
    probabilities = F.transform(V.doubles(F.col("embedding")), V.sigmoid)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.soft_membership(probabilities, 3).alias("f"))
    return rows.select("vec_id", *[F.round(F.get("f", F.lit(i)), 9).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query(f"""WITH {P.UNITS}, q AS (SELECT a.id AS a, b.id AS a2, c.id AS b, d.id AS b2, list_transform(range(1, 65), lambda i: b.unit[i] - a.unit[i] + c.unit[i]) AS t, d.unit AS gold
  FROM units a JOIN units b ON b.id = a.id + 1 JOIN units c ON c.id = a.id + 2 JOIN units d ON d.id = a.id + 3 WHERE a.id % 50 = 0),
r AS (SELECT a, 1 + count(*) FILTER (WHERE list_dot_product(u.unit, t) > list_dot_product(gold, t)) AS rank FROM q, units u WHERE u.id NOT IN (a, a2, b) GROUP BY a)
SELECT count(*) AS n, avg((rank <= 10)::INT) AS accuracy, avg(rank) AS mean_rank FROM r""")
def analogy_accuracy(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    quads = _asked(rows).select(F.col("id").alias("a"), (F.col("id") + 1).alias("a2"), (F.col("id") + 2).alias("b"), (F.col("id") + 3).alias("b2"))
    return retrieval.analogy_accuracy(quads, rows, 10)


@query("""WITH o AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings) SELECT vec_id, label, fold::INT AS fold FROM o""")
def stratified_folds(spark, sf_dir):
    return ranking.stratified_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", ["vec_id"])


@query()
def probe_accuracy(spark, sf_dir):
    """Five-fold accuracy of a logistic probe of the label; an iterative fit, tested for its invariants."""
    rows = ranking.stratified_folds(table(spark, sf_dir, "embeddings"), "label", ["vec_id"])
    return learners.linear_probe(rows, "label", "embedding")


@query("""WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(max(x) + ln(sum(exp(x))) - max(x), 9) AS log_sum_exp FROM d GROUP BY vec_id""")
def log_sum_exp(spark, sf_dir):
    dims = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(V.doubles(F.col("embedding"))).alias("x"))
    return retrieval.log_sum_exp(dims, ["vec_id"], "x").withColumn("log_sum_exp", F.round("log_sum_exp", 9))
