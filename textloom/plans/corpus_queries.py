"""Queries on lines, pages, conversations, and their streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import clean_word, split_words
from textloom.operators import corpus, ranking
from textloom.operators.corpus import LineRules
from textloom.plans import sqlparts as P
from textloom.plans.registry import query, table
from textloom.streaming import streams

_REASON = f"""reasons AS (
  SELECT doc_id, line_no, c AS line, CASE
    WHEN NOT length(c) BETWEEN 30 AND 600 THEN 'length'
    WHEN regexp_matches(c, '{corpus.MARKUP}') THEN 'markup'
    WHEN len({P.split('c')}) < 3 THEN 'few_tokens'
    WHEN len(list_filter({P.split('c')}, lambda t: length(t) > 34)) > 0 THEN 'long_token'
    WHEN letters = 0 THEN 'no_letters'
    WHEN inside / greatest(letters, 1) < 0.92::DOUBLE THEN 'alphabet'
    WHEN odd / greatest(letters, 1) > 0.02::DOUBLE THEN 'foreign'
    WHEN other / greatest(length(c), 1) > 0.2::DOUBLE THEN 'other_chars'
    WHEN NOT list_has_any({P.split('low')}, {list(corpus.STOPWORDS)!r}) THEN 'no_stopword' END AS reason
  FROM (SELECT *, length(regexp_replace(low, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(low, '[^abcçdefgğhıijklmnoöprsştuüvyz]', '', 'g')) AS inside,
      length(regexp_replace(low, '[^qwx]', '', 'g')) AS odd, length(regexp_replace(regexp_replace(c, '{P.SPACE}', '', 'g'), '\\p{{L}}', '', 'g')) AS other
    FROM (SELECT *, lower(c) AS low FROM (
      SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '{corpus.REFERENCES}', '', 'g'), '{P.SPACE}', ' ', 'g')) AS c FROM lines))))"""


@query(f"WITH {P.LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM lines GROUP BY doc_id")
def document_lines(spark, sf_dir):
    lines = corpus.document_lines(table(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query(f"WITH {P.LINES}, {_REASON} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1")
def clean_lines_by_reason(spark, sf_dir):
    lines = corpus.clean_lines(corpus.document_lines(table(spark, sf_dir, "documents")))
    return lines.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P.LINES}, {_REASON} SELECT doc_id, line_no, line FROM reasons WHERE reason IS NULL")
def clean_lines_kept(spark, sf_dir):
    lines = corpus.clean_lines(corpus.document_lines(table(spark, sf_dir, "documents")), LineRules())
    return lines.filter("reason is null").select("doc_id", "line_no", "line")


@query(f"""WITH {P.LINES} SELECT doc_id, line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY md5(line)[1:16] ORDER BY doc_id, line_no) AS r FROM lines) WHERE r = 1""")
def line_dedup_first(spark, sf_dir):
    return corpus.dedup_lines(corpus.document_lines(table(spark, sf_dir, "documents")), ["doc_id", "line_no"])


@query(f"""WITH {P.LINES} SELECT doc_id, line_no, CASE WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT doc_id, line_no, row_number() OVER (ORDER BY md5('42|' || doc_id || '|' || line_no), doc_id, line_no) AS r, count(*) OVER () AS n FROM lines)""")
def split_exact(spark, sf_dir):
    lines = corpus.document_lines(table(spark, sf_dir, "documents"))
    return corpus.split_lines(lines).select("doc_id", "line_no", "split")


@query(f"""WITH {P.LINES}, w AS (SELECT unnest({P.split('line')}) AS word FROM lines)
SELECT count(*) AS lines, sum(len({P.split('line')}))::BIGINT AS words, (sum(length(line)) + count(*) - 1)::BIGINT AS chars, sum(strlen(line))::BIGINT AS bytes,
  (SELECT count(DISTINCT word) FROM w) AS distinct_words FROM lines""")
def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(corpus.document_lines(table(spark, sf_dir, "documents")))


@query(f"WITH {P.LINES} SELECT char, count(*) AS n FROM (SELECT unnest(string_split(line, '')) AS char FROM lines) GROUP BY char")
def char_histogram(spark, sf_dir):
    return corpus.char_histogram(corpus.document_lines(table(spark, sf_dir, "documents")))


@query(f"""WITH {P.LINES}, w AS (SELECT unnest({P.split('line')}) AS word FROM lines)
SELECT min(word) FILTER (WHERE length(word) = (SELECT max(length(word)) FROM w)) AS longest_word, max(length(word)) AS longest_length, avg(length(word)) AS mean_length FROM w""")
def word_extremes(spark, sf_dir):
    return corpus.word_extremes(corpus.document_lines(table(spark, sf_dir, "documents")))


@query(f"""WITH {P.LINES} SELECT sum(length(line))::BIGINT AS chars FROM (SELECT line FROM lines ORDER BY doc_id, line_no LIMIT 1000)""")
def first_lines_chars(spark, sf_dir):
    return corpus.counted_chars(corpus.document_lines(table(spark, sf_dir, "documents")), ["doc_id", "line_no"], 1000)


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{P.SPACE}', ' ', 'g')) AS text FROM pages""")
def page_text_clean(spark, sf_dir):
    return corpus.page_text(table(spark, sf_dir, "pages"))


@query(f"""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(len({P.split('text')}))::BIGINT AS words,
  sum(len({P.split('text')})) / count(*) AS words_per_turn, max(turn) AS last_turn FROM conversations GROUP BY role""")
def conversation_token_stats(spark, sf_dir):
    n = F.size(split_words(F.col("text")))
    turns = table(spark, sf_dir, "conversations").groupBy("role")
    return turns.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(n).alias("words"), (F.sum(n) / F.count(F.lit(1))).alias("words_per_turn"), F.max("turn").alias("last_turn"))


@query(f"""SELECT word, count(*) AS n FROM (SELECT regexp_replace(unnest({P.split('text')}), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS word FROM conversations)
WHERE length(word) BETWEEN 1 AND 30 GROUP BY word""")
def conversation_words(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(split_words(F.col("text"))).alias("raw"))
    words = words.select(clean_word(F.col("raw"), "tokens").alias("word")).filter("word is not null")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {P.LINES}, r AS (SELECT doc_id, line_no, (row_number() OVER (ORDER BY md5('42|' || doc_id || '|' || line_no), doc_id, line_no) - 1) // 256 AS batch, count(*) OVER () AS n FROM lines)
SELECT doc_id, line_no, batch FROM r WHERE batch < n // 256""")
def shuffled_batches(spark, sf_dir):
    lines = corpus.document_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no")
    return ranking.batches(lines, ["doc_id", "line_no"], 256)


@query(f"WITH {P.LINES} SELECT md5(line)[1:16] AS key FROM lines GROUP BY 1")
def stream_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = streams.distinct_lines(streams.stream_table(spark, f"{sf_dir}/documents.parquet", docs.schema))
    return streams.run_to_end(lines.select("key"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_event_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = streams.event_windows(streams.stream_table(spark, f"{sf_dir}/events.parquet", events.schema))
    out = streams.run_to_end(counts, "complete")
    return out.select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"WITH {P.LINES}, {_REASON} SELECT doc_id, line FROM reasons WHERE reason IS NULL")
def stream_clean_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = streams.kept_lines(streams.stream_table(spark, f"{sf_dir}/documents.parquet", docs.schema))
    return streams.run_to_end(lines.select("doc_id", "line"))
