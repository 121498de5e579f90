"""Queries for tokenizer-quality metrics and reports.

Two rule-based segmenters stand in for learned ones: pieces of three characters,
and root plus longest suffix.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import segments as S
from textloom.functions import text as X
from textloom.operators import metrics, reports, vocab
from textloom.plans import sqlparts as P
from textloom.plans.registry import query, table
from textloom.plans.vocab_queries import SUFFIXES, _flags, _ROOTS, counts_of, words_of

_SUFFIXED = "CASE " + " ".join(f"WHEN word LIKE '%{s}' AND length(word) >= {len(s) + 2} THEN [left(word, length(word) - {len(s)}), '{s}']" for s in sorted(SUFFIXES, key=lambda s: (len(s), s), reverse=True)) + " ELSE [word] END"
_PAIRS = f"""pairs AS (SELECT word, freq, CASE WHEN freq >= 10 THEN 'frequent' WHEN freq >= 2 THEN 'some' ELSE 'rare' END AS stratum,
  {_SUFFIXED} AS gold, {P.every('word', 3)} AS predicted FROM counts),
cuts AS (SELECT *, {P.boundaries('gold')} AS g, {P.boundaries('predicted')} AS q FROM pairs),
cells AS (SELECT *, len(list_intersect(g, q)) AS m FROM cuts)"""


def _pairs(spark, sf_dir):
    word = F.col("word")
    stratum = F.when(F.col("freq") >= 10, "frequent").when(F.col("freq") >= 2, "some").otherwise("rare")
    return counts_of(spark, sf_dir).select("word", "freq", stratum.alias("stratum"), S.with_suffix(word, SUFFIXES).alias("gold"), S.every(word, 3).alias("predicted"))


def _rounded(df, *columns, digits: int = 9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _lang_counts(spark, sf_dir, name):
    """lang, word and the word's count; the language stays in the document's row."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    words = docs.select("lang", F.explode(X.clean_words(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias(name))


@query(f"""WITH {P.WORDS}, c AS (SELECT lang, word, count(*) AS n FROM words JOIN documents USING (doc_id) GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p FROM c),
s AS (SELECT lang, sum(n)::BIGINT AS tokens, count(*) AS types, -sum(p * log2(p)) AS shannon, log2(sum(pow(p, 2.5))) / -1.5::DOUBLE AS renyi FROM p GROUP BY lang)
SELECT lang, tokens, types, round(shannon, 9) AS shannon, round(renyi, 9) AS renyi, round(renyi / log2(greatest(types, 2)), 9) AS renyi_efficiency FROM s""")
def token_entropy_renyi(spark, sf_dir):
    counts = _lang_counts(spark, sf_dir, "n")
    return _rounded(metrics.entropies(counts, ["lang"]), "shannon", "renyi", "renyi_efficiency")


@query(f"""WITH {P.WORDS}, c AS (SELECT lang, word, count(*) AS freq FROM words JOIN documents USING (doc_id) GROUP BY ALL),
s AS (SELECT lang, sum(freq)::BIGINT AS words, sum(ceil(length(word) / 3) * freq)::BIGINT AS tokens, sum(length(word) * freq)::BIGINT AS chars FROM c GROUP BY lang)
SELECT *, tokens / greatest(words, 1) AS fertility, tokens / greatest(chars, 1) AS tokens_per_char, chars / greatest(tokens, 1) AS compression FROM s""")
def fertility_by_lang(spark, sf_dir):
    counts = _lang_counts(spark, sf_dir, "freq")
    return metrics.fertility(counts.withColumn("segs", S.every(F.col("word"), 3)), ["lang"])


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS}, s AS (SELECT stratum, count(*) AS n_words, sum(m)::BIGINT AS tp, sum(len(q) - m)::BIGINT AS fp, sum(len(g) - m)::BIGINT AS fn,
  sum(greatest(length(word) - 1, 0) - len(q) - len(g) + m)::BIGINT AS tn FROM cells GROUP BY stratum),
r AS (SELECT *, (tp + tn) / greatest(tp + fp + fn + tn, 1) AS accuracy, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM s)
SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-8) AS f1 FROM r WHERE n_words >= 5""")
def boundary_prf(spark, sf_dir):
    return metrics.boundary_scores(_pairs(spark, sf_dir), ["stratum"], least_words=5)


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS} SELECT stratum, sum(m)::BIGINT AS matched, sum(len(g))::BIGINT AS n_gold, 100.0::DOUBLE * sum(m) / greatest(sum(len(g)), 1) AS mas
FROM cells WHERE length(word) >= 4 GROUP BY stratum""")
def mas(spark, sf_dir):
    return metrics.alignment_score(_pairs(spark, sf_dir), ["stratum"], least_chars=4)


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS}, v AS (SELECT *, len(predicted) <= 1 AS single FROM cells WHERE len(gold) >= 2),
s AS (SELECT count(*) AS n, sum(CASE WHEN single THEN 0 ELSE m / len(g) END) AS r, sum(CASE WHEN single THEN 0 ELSE m / greatest(len(q), 1) END) AS p,
  sum(CASE WHEN single THEN 0 ELSE m / len(g) END * freq) AS wr, sum(CASE WHEN single THEN 0 ELSE m / greatest(len(q), 1) END * freq) AS wp, sum(freq)::DOUBLE AS w,
  sum(CASE WHEN single THEN 0 ELSE m END) AS m, sum(len(g)) AS g, sum(CASE WHEN single THEN 0 ELSE len(q) END) AS q, count(*) FILTER (WHERE single) AS ns FROM v),
t AS (SELECT *, r / n AS mr, p / n AS mp, m / greatest(q, 1) AS up, m / greatest(g, 1) AS ur FROM s)
SELECT 'thirds' AS model, n AS n_words, round(mr, 9) AS macro_recall, round(mp, 9) AS macro_precision, round(2 * mp * mr / greatest(mp + mr, 1e-9), 9) AS macro_f1, round(up, 9) AS micro_precision, round(ur, 9) AS micro_recall,
  round(2 * up * ur / greatest(up + ur, 1e-9), 9) AS micro_f1, round(wr / w, 9) AS weighted_recall, round(wp / w, 9) AS weighted_precision, round(ns / n, 9) AS single_rate, 0.0::DOUBLE AS mismatch_rate FROM t""")
def morph_scores(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("model", F.lit("thirds"))
    out = metrics.morph_scores(rows, ["model"])
    return _rounded(out, *[c for c in out.columns if c not in ("model", "n_words")])


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS}, e AS (SELECT stratum, gold[1] AS root, predicted AS segs, gold[2] IS NOT NULL AS is_verb, len(gold) - 1 AS n FROM pairs),
f AS (SELECT stratum, is_verb, n, len(segs) - 1 AS k, len(list_filter(range(1, len(segs) + 1), lambda i: length(array_to_string(segs[1:i], '')) <= length(root)
    AND {P.harden("array_to_string(segs[1:i], '')")} = {P.harden('root')})) > 0 AS prefix,
  len(list_filter(segs, lambda s: {P.harden('s')} = {P.harden('root')})) > 0 AS inside, {P.harden('segs[1]')} = {P.harden('root')} AS first FROM e)
SELECT stratum, count(*) AS n_words, avg(prefix::INT) AS prefix_rate, coalesce(avg(prefix::INT) FILTER (WHERE is_verb), 0) AS prefix_rate_verb, coalesce(avg(prefix::INT) FILTER (WHERE NOT is_verb), 0) AS prefix_rate_noun,
  avg(inside::INT) AS root_in_rate, avg(first::INT) AS first_rate, avg((k = n)::INT) AS exact_count_rate, avg(k) AS mean_suffixes, avg(abs(k - n)) AS mean_abs_diff FROM f GROUP BY stratum""")
def inflection_rates(spark, sf_dir):
    gold = F.col("gold")
    rows = _pairs(spark, sf_dir).select("stratum", F.col("predicted").alias("segs"), F.get(gold, F.lit(0)).alias("root"), (F.size(gold) > 1).alias("is_verb"), (F.size(gold) - 1).alias("n_features"))
    return metrics.inflection_rates(rows, ["stratum"])


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS} SELECT stratum, count(*) AS n_words, 100.0::DOUBLE * avg((gold[1] = predicted[1])::INT) AS root, 100.0::DOUBLE * avg((len(gold) = len(predicted))::INT) AS count,
  100.0::DOUBLE * avg((list_transform(gold, lambda s: length(s)) = list_transform(predicted, lambda s: length(s)))::INT) AS length, 100.0::DOUBLE * avg((gold = predicted)::INT) AS exact FROM pairs GROUP BY stratum""")
def qualitative_exactness(spark, sf_dir):
    return metrics.exactness(_pairs(spark, sf_dir), ["stratum"])


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_ROOTS}, lex AS (SELECT root AS word FROM roots UNION SELECT suffix FROM sfx),
flags AS (SELECT word, word IN (SELECT word FROM lex) AS pure, word IN (SELECT word FROM lex) OR word IN (SELECT word FROM splits) AS valid FROM counts),
t AS (SELECT lang, word, count(*) AS n FROM words JOIN documents USING (doc_id) GROUP BY ALL)
SELECT lang, count(*) AS types, sum(n)::BIGINT AS tokens, 100.0::DOUBLE * avg(valid::INT) AS valid_types, 100.0::DOUBLE * sum(valid::INT * n) / sum(n) AS valid_tokens,
  100.0::DOUBLE * avg(pure::INT) AS pure_types, 100.0::DOUBLE * sum(pure::INT * n) / sum(n) AS pure_tokens FROM t JOIN flags USING (word) GROUP BY lang""")
def validity_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    words = words_of(spark, sf_dir)
    flags = _flags(vocab.word_counts(words)).withColumnRenamed("word", "token")
    return metrics.validity(words.join(docs, "doc_id").withColumnRenamed("word", "token"), flags, ["lang"])


@query(f"""WITH {P.WORDS}, {P.COUNTS}, m AS (SELECT word, -ln(freq / (SELECT sum(freq) FROM counts)) AS nll FROM counts),
d AS (SELECT lang, sum(nll) AS nll, count(*) AS n_tokens, sum(length(word))::BIGINT AS chars FROM words JOIN m USING (word) JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n_tokens, chars, round(nll / 0.6931471805599453::DOUBLE / greatest(chars, 1), 9) AS bpc, round(nll / greatest(n_tokens, 1), 9) AS nll_per_token, round(exp(nll / greatest(n_tokens, 1)), 6) AS perplexity FROM d""")
def bits_per_char(spark, sf_dir):
    """Bits a character of each language under one unigram model of all words."""
    words = words_of(spark, sf_dir)
    costs = vocab.word_counts(words)
    total = costs.agg(F.sum("freq").alias("total"))
    costs = costs.crossJoin(F.broadcast(total)).select("word", (-F.log(F.col("freq") / F.col("total"))).alias("nll"))  # one row
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = words.join(costs, "word").join(docs, "doc_id").select("lang", "nll", F.lit(1).alias("n_tokens"), F.length("word").alias("chars"))
    out = metrics.bits_per_char(rows, ["lang"])
    return _rounded(_rounded(out, "bpc", "nll_per_token"), "perplexity", digits=6)


@query("""WITH r AS (SELECT quality AS t, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS g FROM labels JOIN documents d USING (doc_id)),
c AS (SELECT l AS label, count(*) FILTER (WHERE t = l) AS gold, count(*) FILTER (WHERE g = l) AS guessed, count(*) FILTER (WHERE t = l AND g = l) AS tp FROM r, (VALUES (0), (1)) v(l) GROUP BY l)
SELECT sum(gold)::BIGINT AS n, sum(tp) / sum(gold) AS accuracy, avg(2.0::DOUBLE * tp / greatest(gold + guessed, 1)) AS macro_f1, 2.0::DOUBLE * sum(tp) / sum(gold + guessed) AS micro_f1 FROM c""")
def classification_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("guess"))
    return metrics.classification(table(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "guess")


@query("SELECT event_type, count(value) AS runs, median(value) AS median, round(stddev_samp(value), 9) AS stdev FROM events GROUP BY event_type")
def timing_summary(spark, sf_dir):
    return _rounded(metrics.timings(table(spark, sf_dir, "events"), ["event_type"], "value"), "stdev")


@query("SELECT count(*) AS groups, min(n) AS smallest, avg(n) AS mean, max(n) AS largest FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def group_sizes(spark, sf_dir):
    return metrics.group_sizes(table(spark, sf_dir, "conversations"), "conv_id")


_STATS = """stats AS (SELECT source, lang, avg(n_chars) AS mean_chars, count(*) AS docs FROM documents GROUP BY ALL)"""


def _stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.avg("n_chars").alias("mean_chars"), F.count(F.lit(1)).alias("docs"))


@query(f"""WITH {_STATS} SELECT source, max(mean_chars) FILTER (WHERE lang = 'de') AS de, max(mean_chars) FILTER (WHERE lang = 'en') AS en, max(mean_chars) FILTER (WHERE lang = 'es') AS es,
  max(mean_chars) FILTER (WHERE lang = 'fr') AS fr FROM stats GROUP BY source""")
def pivot_metric(spark, sf_dir):
    return reports.pivot_metric(_stats(spark, sf_dir), "source", "lang", ["de", "en", "es", "fr"], "mean_chars")


@query(f"WITH {_STATS} SELECT source, lang, 'mean_chars' AS metric, mean_chars AS value FROM stats UNION ALL SELECT source, lang, 'docs', docs::DOUBLE FROM stats")
def unpivot_metric(spark, sf_dir):
    return reports.unpivot(_stats(spark, sf_dir).withColumn("docs", F.col("docs").cast("double")), ["source", "lang"], ["mean_chars", "docs"])


@query("""WITH s AS (SELECT source, avg(n_chars) AS fertility, count(*)::DOUBLE AS compression, max(n_chars)::DOUBLE AS subword_entropy, count(DISTINCT lang)::DOUBLE AS vocab_coverage, min(n_chars)::DOUBLE AS morfem_alignment,
  avg(length(lang)) AS oov_rate, sum(n_chars)::DOUBLE AS encode_ms FROM documents GROUP BY source),
n AS (SELECT source, """ + ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN {'1 - ' if c in reports.LESS_IS_BETTER else ''}({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 1 END AS {c}" for c in reports.WEIGHTS) + """ FROM s)
SELECT source, round(""" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in reports.WEIGHTS.items()) + """, 9) AS weighted_score FROM n""")
def weighted_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.avg("n_chars").alias("fertility"), F.count(F.lit(1)).cast("double").alias("compression"), F.max("n_chars").cast("double").alias("subword_entropy"), F.countDistinct("lang").cast("double").alias("vocab_coverage"),
        F.min("n_chars").cast("double").alias("morfem_alignment"), F.avg(F.length("lang")).alias("oov_rate"), F.sum("n_chars").cast("double").alias("encode_ms"),
    )
    return _rounded(reports.weighted_ranking(docs).select("source", "weighted_score"), "weighted_score")


@query(f"WITH {_STATS}, s AS (SELECT source, max(mean_chars) AS best FROM stats GROUP BY source) SELECT source, best, row_number() OVER (ORDER BY best DESC, source)::INT AS place FROM s")
def leaderboard(spark, sf_dir):
    best = _stats(spark, sf_dir).groupBy("source").agg(F.max("mean_chars").alias("best"))
    return reports.leaderboard(best, "best", "source")


@query("SELECT DISTINCT lang, coalesce(nullif(list_position(['fr', 'en'], lang), 0), 3)::INT AS place FROM documents")
def caller_order(spark, sf_dir):
    return reports.in_order(table(spark, sf_dir, "documents").select("lang").distinct(), "lang", ["fr", "en"])


@query(f"""WITH {_STATS}, s AS (SELECT source, lang, mean_chars, docs FROM stats) SELECT a.source, a.lang, a.mean_chars, a.docs FROM s a WHERE NOT EXISTS (
  SELECT 1 FROM s b WHERE b.mean_chars >= a.mean_chars AND b.docs <= a.docs AND (b.mean_chars > a.mean_chars OR b.docs < a.docs))""")
def pareto_frontier(spark, sf_dir):
    return reports.pareto_frontier(_stats(spark, sf_dir), "mean_chars", "docs")


@query("""SELECT 'first' AS run, lang, count(*) AS docs, NULL::DOUBLE AS mean_chars FROM documents GROUP BY lang UNION ALL SELECT 'second', lang, NULL, avg(n_chars) FROM documents GROUP BY lang""")
def merge_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("lang")
    return reports.merge_runs({"first": docs.agg(F.count(F.lit(1)).alias("docs")), "second": docs.agg(F.avg("n_chars").alias("mean_chars"))})


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER w AS k, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, best, (k - max(CASE WHEN earlier IS NULL OR value < earlier THEN k END) OVER (PARTITION BY user_id ORDER BY k))::INT AS since_best FROM o""")
def running_best(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return reports.running_best(events, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "best", "since_best")


@query("""SELECT lang, CASE WHEN avg((n_chars >= 100)::INT) < 0.999::DOUBLE THEN 'lossy' ELSE 'lossless' END AS kind FROM documents GROUP BY lang""")
def lossy_flags(spark, sf_dir):
    rate = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg((F.col("n_chars") >= 100).cast("int")).alias("accuracy"))
    return rate.select("lang", reports.lossy(F.col("accuracy")).alias("kind"))


@query("""WITH v AS (SELECT unnest([8000, 16000, 32000, 64000]) AS vocab), d AS (SELECT vocab, (-(vocab + 512) + sqrt((vocab + 512)::DOUBLE * (vocab + 512) + 4 * 72.0 * 58000000)) / 144.0 AS raw FROM v),
w AS (SELECT vocab, greatest(128, least(1024, greatest(8, round_even(raw / 8, 0) * 8)))::INT AS dim FROM d)
SELECT vocab, dim, (vocab::BIGINT * dim + 72 * dim::BIGINT * dim + 512 * dim)::BIGINT AS parameters FROM w""")
def equal_parameter_dims(spark, sf_dir):
    sizes = spark.createDataFrame([(8000,), (16000,), (32000,), (64000,)], "vocab int")
    dims = sizes.withColumn("dim", metrics.equal_parameter_dim(F.col("vocab"), 58_000_000, 6, 512, 8))
    return dims.withColumn("parameters", metrics.parameters(F.col("vocab").cast("long"), F.col("dim").cast("long"), 6, 512))


@query("""SELECT epoch, greatest(0.1::DOUBLE, 0.5::DOUBLE * pow(0.8::DOUBLE, greatest(epoch - 1, 0))) AS weight FROM (SELECT unnest(range(0, 10)) AS epoch)""")
def loss_schedule(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("epoch"), reports.schedule(F.col("id"), 0.5, 0.8, 0.1).alias("weight"))


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS} SELECT word, array_to_string(gold, ' | ') AS suffixed_seg, len(gold)::INT AS suffixed_n, array_to_string(predicted, ' | ') AS thirds_seg, len(predicted)::INT AS thirds_n FROM pairs WHERE freq >= 5""")
def wide_segments(spark, sf_dir):
    rows = _pairs(spark, sf_dir).filter("freq >= 5")
    one = rows.select("word", F.lit("suffixed").alias("model"), S.piped(F.col("gold")).alias("seg"), F.size("gold").alias("n"))
    two = rows.select("word", F.lit("thirds").alias("model"), S.piped(F.col("predicted")).alias("seg"), F.size("predicted").alias("n"))
    return reports.wide_segments(one.union(two), ["suffixed", "thirds"])


