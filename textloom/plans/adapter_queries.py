"""Queries through extension points (codecs, encoders, analysers), probe sets, bundles and ablations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import segments as S
from textloom.functions import text as X
from textloom.operators import adapters, corpus, metrics, probes, reports, retrieval, vocab
from textloom.plans import sqlparts as P
from textloom.plans.corpus_queries import _REASON
from textloom.plans.metric_queries import _PAIRS, _pairs
from textloom.plans.registry import query, table
from textloom.plans.vector_queries import _asked, _rows
from textloom.plans.vocab_queries import SUFFIXES, arrays_of, counts_of, words_of
from textloom.streaming import streams

_DECODED = f"regexp_replace(word, '[^{X.LETTERS}]', '', 'g')"


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS}, d AS (SELECT stratum, word, {_DECODED} AS decoded FROM pairs)
SELECT stratum, count(*) AS n, count(*) FILTER (WHERE decoded = word) / greatest(count(*), 1) AS accuracy, 100.0::DOUBLE * count(*) FILTER (WHERE decoded <> word) / greatest(count(*), 1) AS fail_percent FROM d GROUP BY stratum""")
def roundtrip_rate(spark, sf_dir):
    """Words through the character codec, which drops letters outside its table."""
    pairs = _pairs(spark, sf_dir).select("stratum", "word")
    decoded = adapters.coded_words(pairs, adapters.character_codec).select("word", "decoded")
    return metrics.round_trips(pairs.join(decoded, "word"), ["stratum"])


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS}, d AS (SELECT stratum, word, {_DECODED} AS decoded FROM pairs)
SELECT stratum, word, decoded FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY word) AS r FROM d WHERE decoded <> word) WHERE r <= 200""")
def roundtrip_failures(spark, sf_dir):
    """The first 200 failures a stratum, the report's own limit."""
    pairs = _pairs(spark, sf_dir).select("stratum", "word")
    decoded = adapters.coded_words(pairs, adapters.character_codec).select("word", "decoded")
    return metrics.failures(pairs.join(decoded, "word"), ["stratum"])


@query(f"WITH {P.WORDS}, {P.COUNTS} SELECT word, octet_length(encode(word))::INT AS n_ids, word AS decoded, false AS failed FROM counts")
def byte_codec_words(spark, sf_dir):
    coded = adapters.coded_words(counts_of(spark, sf_dir), adapters.byte_codec)
    return coded.select("word", F.size("ids").alias("n_ids"), "decoded", "failed")


@query("""WITH c AS (SELECT DISTINCT hex(encode(ch)) AS h FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)),
b AS (SELECT max(list_max(list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT))) + 1 AS b FROM c)
SELECT 200::BIGINT AS declared, b AS observed, greatest(200, b) AS size FROM b""")
def observed_vocabulary(spark, sf_dir):
    """The largest byte id of all texts against a declared size of 200."""
    ids = adapters.token_ids(table(spark, sf_dir, "documents"), adapters.byte_codec)
    return adapters.observed_vocabulary(ids, 200)


@query("SELECT doc_id, octet_length(encode(text))::INT AS n_ids FROM documents")
def token_id_lengths(spark, sf_dir):
    ids = adapters.token_ids(table(spark, sf_dir, "documents"), adapters.byte_codec)
    return ids.select("doc_id", F.size("ids").alias("n_ids"))


def _thirds():
    return lambda lines: [w[i : i + 3] for line in lines for w in line.split(" ") if w for i in range(0, len(w), 3)]


@query(f"""WITH {P.LINES}, w AS (SELECT unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) AS word FROM lines)
SELECT piece, count(*) AS n FROM (SELECT unnest({P.every('word', 3)}) AS piece FROM w) GROUP BY piece""")
def piece_counts(spark, sf_dir):
    lines = corpus.document_lines(table(spark, sf_dir, "documents"))
    return adapters.line_pieces(lines, _thirds).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def _letter_counts():
    return lambda words: [[float(len(w)), float(sum(c in "aeiou" for c in w)), float(ord(w[0]))] for w in words]


@query(f"""WITH {P.WORDS}, {P.COUNTS} SELECT word, length(word)::DOUBLE AS size, length(regexp_replace(word, '[^aeiou]', '', 'g'))::DOUBLE AS vowels, unicode(word)::DOUBLE AS first FROM counts""")
def word_encoder_vectors(spark, sf_dir):
    vectors = adapters.word_embeddings(counts_of(spark, sf_dir), _letter_counts)
    return vectors.select("word", *[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate(("size", "vowels", "first"))])


def _suffix_analyser():
    def analyse(word: str) -> list[tuple[str, str, str]]:
        if len(word) < 4:
            return [("Unk", f"{word}:Unk", word)]
        fits = [s for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 2]
        if not fits:
            return [("Noun", f"{word}:Noun", word)]
        last = max(fits, key=lambda s: (len(s), s))
        root = word[: -len(last)]
        return [("Noun", f"{root}:Noun+{last}:Suffix", root)]

    return analyse


_SUFFIXED = "CASE " + " ".join(f"WHEN word LIKE '%{s}' AND length(word) >= {len(s) + 2} THEN [left(word, length(word) - {len(s)}), '{s}']" for s in sorted(SUFFIXES, key=lambda s: (len(s), s), reverse=True)) + " ELSE [word] END"


@query(f"""WITH {P.WORDS}, {P.COUNTS}, a AS (SELECT word, {_SUFFIXED} AS segs FROM counts WHERE length(word) >= 4),
s AS (SELECT unnest(segs) AS seg FROM a)
SELECT DISTINCT 'morpheme' AS kind, entry FROM (SELECT regexp_extract(seg, '[a-zçğıöşü]+$') AS entry FROM s UNION ALL SELECT segs[1] FROM a) WHERE entry <> ''
UNION ALL SELECT 'word', word FROM a""")
def harvested_inventory(spark, sf_dir):
    return adapters.inventory(adapters.analyses(counts_of(spark, sf_dir), _suffix_analyser))


_TASKS = {"lang": ["en", "fr", "de"], "source": ["src0", "src1", "src2"], "both": ["en", "src0"], "none": ["xx"]}


@query("""WITH r AS (SELECT doc_id, [lang, source] AS f FROM documents),
t AS (SELECT doc_id, task, list_filter(f, lambda x: list_contains(tags, x)) AS hit FROM r, (VALUES ('lang', ['en', 'fr', 'de']), ('source', ['src0', 'src1', 'src2']), ('both', ['en', 'src0']), ('none', ['xx'])) v(task, tags)),
o AS (SELECT doc_id, task, hit[1] AS label FROM t WHERE len(hit) = 1), s AS (SELECT task, label FROM o GROUP BY ALL HAVING count(*) >= 20),
k AS (SELECT task FROM s GROUP BY task HAVING count(*) >= 2)
SELECT doc_id, task, label FROM o WHERE (task, label) IN (SELECT (task, label) FROM s) AND task IN (SELECT task FROM k)""")
def probe_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("features"))
    sets = probes.large_classes(probes.tagged(rows, _TASKS), 20, 2)
    return probes.resolved(sets, rows.select("doc_id", "features", F.lit("x").alias("task"), F.lit("x").alias("label"))).select("doc_id", "task", "label")


@query(f"WITH {P.WORDS}, {P.COUNTS} SELECT least(greatest(len({P.every('word', 3)}), 1), 6)::INT - 1 AS bin, count(*) AS n FROM counts GROUP BY 1")
def piece_count_bins(spark, sf_dir):
    bins = counts_of(spark, sf_dir).select(probes.count_bin(F.size(S.every(F.col("word"), 3))).alias("bin"))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_PAIRS} SELECT word, array_to_string(g, ',') AS true_cuts, array_to_string(q, ',') AS model_cuts, array_to_string(predicted, ' | ') AS output,
  len(g) > 0 AND list_transform(g, lambda b: b + 1) = q AS shifted FROM cuts""")
def boundary_diagnosis(spark, sf_dir):
    return metrics.boundary_diagnosis(_pairs(spark, sf_dir))


@query(f"WITH {P.WORDS} SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM words")
def segment_characters(spark, sf_dir):
    return vocab.segment_characters(counts_of(spark, sf_dir).select(S.every(F.col("word"), 3).alias("segs")))


@query(f"""WITH {P.WORDS}, c AS (SELECT doc_id, pos // 32 AS chunk, count(*) AS n, sum(length(word)) AS chars, sum(ceil(length(word) / 3)) AS pieces FROM words GROUP BY ALL HAVING n >= 3)
SELECT count(*) AS n_sentences, sum(n)::BIGINT AS n_words, sum(n) / count(*) AS words_per_sentence, sum(chars) / sum(n) AS word_length, sum(pieces) / sum(n) AS pieces_per_word, 1000::BIGINT AS word_vocab, 500::BIGINT AS root_vocab FROM c""")
def sentence_cache_stats(spark, sf_dir):
    return vocab.chunk_stats(vocab.document_chunks(arrays_of(spark, sf_dir)), 3, 1000, 500)


_BUNDLE = f"""g AS (SELECT word, freq, {_SUFFIXED} AS gold FROM counts),
models AS (SELECT word, freq, gold, 'thirds-32K' AS name, {P.every('word', 3)} AS segs FROM g UNION ALL SELECT word, freq, gold, 'halves-32K', {P.every('word', 5)} FROM g UNION ALL SELECT word, freq, gold, 'thirds-16K', {P.every('word', 2)} FROM g),
pieces AS (SELECT name, unnest(segs) AS seg, freq FROM models),
top AS (SELECT seg AS token, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, seg) AS r, name FROM (SELECT name, seg, sum(freq) AS n FROM pieces GROUP BY ALL)),
known AS (SELECT name, token FROM top WHERE r <= 500),
base AS (SELECT name, sum(freq) AS words, sum(len(segs) * freq) AS tokens, sum(length(word) * freq) AS chars FROM models GROUP BY name),
unk AS (SELECT name, sum(n) AS unknown FROM top WHERE r > 500 GROUP BY name),
ent AS (SELECT name, -sum(n / t * log2(n / t)) AS e FROM (SELECT name, n, sum(n) OVER (PARTITION BY name) AS t FROM top) GROUP BY name),
al AS (SELECT name, 100.0::DOUBLE * sum(len(list_intersect({P.boundaries('gold')}, {P.boundaries('segs')})) * freq) / greatest(sum((len(gold) - 1) * freq), 1) AS a FROM models WHERE length(word) >= 4 GROUP BY name),
bundle AS (SELECT base.name, tokens / greatest(words, 1) AS fertility, chars / greatest(tokens, 1) AS compression, round(e, 9) AS subword_entropy, a AS morfem_alignment, 100.0::DOUBLE * coalesce(unknown, 0) / greatest(tokens, 1) AS oov_rate,
  100.0::DOUBLE - 100.0::DOUBLE * coalesce(unknown, 0) / greatest(tokens, 1) AS vocab_coverage, (SELECT count(*) FROM known k WHERE k.name = base.name) AS vocab_size, tokens::BIGINT AS n_tokens
  FROM base JOIN ent USING (name) JOIN al USING (name) LEFT JOIN unk USING (name))"""
_SIZES = {"thirds-32K": 3, "halves-32K": 5, "thirds-16K": 2}


def _bundle(spark, sf_dir):
    """Three rule-based segmenters with the 500 most frequent pieces of each as its vocabulary."""
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), S.every(F.col("word"), n).alias("segs")) for name, n in _SIZES.items()])).alias("m")
    words = counts_of(spark, sf_dir).select("word", "freq", S.with_suffix(F.col("word"), SUFFIXES).alias("gold"), named).select("m.name", "word", "freq", "m.segs", "gold")
    pieces = words.select("name", F.explode("segs").alias("token"), "freq").groupBy("name", "token").agg(F.sum("freq").alias("n"))
    known = reports.best_per_group(pieces, ["name"], [F.desc("n"), F.col("token")], 500)
    return metrics.tokenizer_bundle(words, known.select("name", "token")).withColumn("subword_entropy", F.round("subword_entropy", 9))


@query(f"WITH {P.WORDS}, {P.COUNTS}, {_BUNDLE} SELECT * FROM bundle")
def tokenizer_bundle(spark, sf_dir):
    return _bundle(spark, sf_dir)


_WINNER_WEIGHTS = {"fertility": 0.4, "compression": 0.2, "subword_entropy": 0.15, "vocab_coverage": 0.15, "morfem_alignment": 0.1}


def _norm(c: str, less: bool) -> str:
    share = f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
    return f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN {'1 - ' if less else ''}{share} ELSE 1.0 END"


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_BUNDLE}, s AS (SELECT name, {' + '.join(f"{w} * ({_norm(c, c == 'fertility')})" for c, w in _WINNER_WEIGHTS.items())} AS score FROM bundle)
SELECT name, round(score, 9) AS score FROM s ORDER BY round(score, 9) DESC, name LIMIT 1""")
def tokenizer_winner(spark, sf_dir):
    best = reports.winner(_bundle(spark, sf_dir), weights=_WINNER_WEIGHTS)
    return best.select("name", F.round("weighted_score", 9).alias("score"))


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_BUNDLE} SELECT name, string_split(name, '-')[1] AS method, row_number() OVER (PARTITION BY string_split(name, '-')[1] ORDER BY n_tokens, name)::INT AS step, fertility FROM bundle WHERE regexp_matches(name, '32K|32000')""")
def metric_curves(spark, sf_dir):
    return reports.curves(reports.named(_bundle(spark, sf_dir), "32K|32000"), "n_tokens").select("name", "method", "step", "fertility")


@query(f"""WITH {P.WORDS}, {P.COUNTS}, {_BUNDLE} SELECT name, fertility / 6.0::DOUBLE AS tokens_per_char, 1000.0::DOUBLE / (fertility / 6.0::DOUBLE) AS chars_per_sec, 2.0::DOUBLE * (fertility / 6.0::DOUBLE) AS ms_per_char FROM bundle""")
def inference_rates(spark, sf_dir):
    """Rates a character from given rates a token (1000 a second, 2 ms each)."""
    rows = _bundle(spark, sf_dir).select("name", (F.col("fertility") / 6.0).alias("tokens_per_char"), F.lit(1000.0).alias("tokens_per_sec"), F.lit(2.0).alias("ms_per_token"))
    return reports.inference_rates(rows).select("name", "tokens_per_char", "chars_per_sec", "ms_per_char")


_LANGS = ["de", "en", "es", "fr"]
_ABLATED = f"""w AS (SELECT lang AS run, word, count(*) AS freq FROM words JOIN documents USING (doc_id) GROUP BY ALL),
p AS (SELECT run, word, CASE WHEN freq >= 5 THEN 'seen' ELSE 'oov' END AS stratum, {_SUFFIXED} AS gold, {P.every('word', 3)} AS predicted FROM w),
c AS (SELECT *, {P.boundaries('gold')} AS g, {P.boundaries('predicted')} AS q FROM p),
b AS (SELECT run, stratum, sum(len(list_intersect(g, q)))::BIGINT AS tp, sum(len(g))::BIGINT AS ng, sum(len(q))::BIGINT AS nq, sum(len(predicted))::BIGINT AS tokens, count(*) AS n FROM c GROUP BY ALL),
f AS (SELECT run, stratum, 2 * (tp / greatest(nq, 1)) * (tp / greatest(ng, 1)) / greatest(tp / greatest(nq, 1) + tp / greatest(ng, 1), 1e-8) AS f1, 100.0::DOUBLE * tp / greatest(ng, 1) AS mas, tokens / greatest(n, 1) AS fertility FROM b),
l AS (SELECT run, stratum, unnest(['boundary_f1', 'fertility', 'agreement']) AS report, unnest([f1, fertility, mas]) AS value FROM f)"""


@query(f"""WITH {P.WORDS}, {_ABLATED} SELECT report, run, max(value) FILTER (WHERE stratum = 'seen') AS seen, max(value) FILTER (WHERE stratum = 'oov') AS oov FROM l GROUP BY ALL""")
def ablation_report(spark, sf_dir):
    """Languages as runs, frequent and rare words as strata, pieces of three as the model; no vectors, so no coherence table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("run"))
    counts = words_of(spark, sf_dir).join(docs, "doc_id").groupBy("run", "word").agg(F.count(F.lit(1)).alias("freq"))
    word, by = F.col("word"), ["run", "stratum"]
    pairs = counts.select("run", "word", F.when(F.col("freq") >= 5, "seen").otherwise("oov").alias("stratum"), S.with_suffix(word, SUFFIXES).alias("gold"), S.every(word, 3).alias("predicted"))
    long = lambda df, category, metric, c: df.select("run", F.lit(category).alias("category"), F.lit(metric).alias("metric"), "stratum", F.lit("thirds").alias("model"), F.col(c).alias("value"))
    merged = long(metrics.boundary_scores(pairs, by), "boundary", "f1", "f1")
    merged = merged.unionByName(long(metrics.alignment_score(pairs, by), "agreement", "boundary_agreement_pct", "mas"))
    merged = merged.unionByName(long(metrics.fertility(pairs.withColumnRenamed("predicted", "segs"), by), "fertility", "tokens_per_word", "fertility"))
    merged = reports.subset(merged, "run", ",".join(_LANGS))
    return reports.stacked(reports.ablation_report(merged, ["seen", "oov"], "thirds", reports.ABLATIONS[1:]))


_RANDOM = "list_transform(range(1, 9), lambda i: ('0x' || substr(md5(vec_id || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5)"
_TAGGED = f"""v AS (SELECT 'random' AS tag, vec_id AS id, label, {_RANDOM} AS e FROM embeddings WHERE embedding IS NOT NULL UNION ALL SELECT 'trained', vec_id, label, embedding::DOUBLE[] FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT tag, id, label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS unit FROM v),
s AS (SELECT q.tag, q.id AS query, r.id, q.label = r.label AS rel, list_dot_product(q.unit, r.unit) AS sim FROM u q JOIN u r ON q.tag = r.tag AND q.id <> r.id WHERE q.id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY tag, query ORDER BY sim DESC, id) AS rank FROM s)"""


def _hashed(spark, sf_dir):
    """Eight numbers of the id's hash as the vector of each row that has one."""
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("vec_id").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    return retrieval.unit_vectors(rows.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(8)), number)), "vec_id", "embedding", "label")


@query(f"WITH {_TAGGED} SELECT tag, count(*) AS n, avg(rel::INT) AS share FROM k WHERE rank <= 5 GROUP BY tag")
def trained_and_random(spark, sf_dir):
    """Share of the five nearest with the query's label, for the vectors and for hashed ones."""
    tables = {"trained": _rows(spark, sf_dir), "random": _hashed(spark, sf_dir)}
    return reports.merge_runs({tag: retrieval.neighbour_purity(_asked(rows), rows, 5) for tag, rows in tables.items()}, "tag")


@query(f"WITH {_TAGGED} SELECT query, rank::INT AS rank, max(id) FILTER (WHERE tag = 'trained') AS one_id, max(id) FILTER (WHERE tag = 'random') AS two_id FROM k WHERE rank <= 5 GROUP BY query, rank")
def neighbours_side_by_side(spark, sf_dir):
    one, two = _rows(spark, sf_dir), _hashed(spark, sf_dir)
    both = retrieval.side_by_side(retrieval.nearest(_asked(one), one, 5), retrieval.nearest(_asked(two), two, 5))
    return both.select("query", "rank", "one_id", "two_id")


@query("""WITH r AS (SELECT doc_id // 64 AS batch, doc_id, CASE WHEN lang = 'en' THEN 0 ELSE length(lang) + ascii(lang[1]) END AS root FROM documents)
SELECT a.doc_id, count(*) AS positives FROM r a JOIN r b ON a.batch = b.batch AND a.root = b.root AND a.doc_id <> b.doc_id WHERE a.root > 0 GROUP BY a.doc_id""")
def batch_positives(spark, sf_dir):
    root = F.when(F.col("lang") == "en", 0).otherwise(F.length("lang") + F.ascii("lang"))
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 64).alias("batch"), F.col("doc_id").alias("id"), root.alias("root"))
    pairs = retrieval.batch_positives(rows)
    return pairs.groupBy(F.col("one").alias("doc_id")).agg(F.count(F.lit(1)).alias("positives"))


@query(f"WITH {P.LINES}, {_REASON} SELECT count(*) AS lines_in, count(*) FILTER (WHERE reason IS NULL) AS kept, 100.0::DOUBLE * count(*) FILTER (WHERE reason IS NULL) / count(*) AS keep_rate FROM reasons")
def stream_keep_rate(spark, sf_dir):
    """Lines seen and kept by a stream, summed over the progress of its batches."""
    docs = table(spark, sf_dir, "documents")
    _, progress = streams.kept_lines_with_progress(streams.stream_table(spark, f"{sf_dir}/documents.parquet", docs.schema))
    sums = progress.agg(F.sum("lines_in").alias("lines_in"), F.sum("kept").alias("kept"))
    return sums.withColumn("keep_rate", 100.0 * F.col("kept") / F.greatest("lines_in", F.lit(1)))


@query("""WITH h AS (SELECT event_type, value, unnest(range(0, 4)) AS k, ts FROM events),
w AS (SELECT event_type, value, (date_trunc('day', ts) + to_hours(6 * (hour(ts) // 6)) - to_hours(6 * k))::TIMESTAMP AS start FROM h)
SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""")
def stream_sliding_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = streams.sliding_windows(streams.stream_table(spark, f"{sf_dir}/events.parquet", events.schema))
    out = streams.run_to_end(counts, "complete")
    return out.select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, count(DISTINCT session) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def stream_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = streams.run_to_end(streams.sessions(streams.stream_table(spark, f"{sf_dir}/events.parquet", events.schema)), "complete")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))
