"""The mix of :mod:`textloom.llm.mixing` in DuckDB SQL, with every seat's quotient written out."""

from textloom.llm.mixing import BLOCK_WORDS, LEAST_BLOCKS, MOST, SEED, SHARD_WORDS, SHARE

MIX_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place, sum(source_size) OVER ()::BIGINT AS total FROM totals),
weighed AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, source_size * {MOST} AS cap FROM placed),
levels AS (
  SELECT *, (total * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (
  SELECT source, place, source_size, total,
    CASE WHEN level * weight > cap THEN cap::DOUBLE
         ELSE (max(CASE WHEN NOT level * weight > cap THEN level END) OVER ()) * weight END AS target,
    greatest(ceil(source_size / greatest({SHARD_WORDS}::DOUBLE, sqrt(source_size) * 16))::BIGINT, 1) AS shards
  FROM levels),
sources AS (
  SELECT *, coalesce(greatest(1, least({BLOCK_WORDS}, floor(min(target) FILTER (WHERE target > 0) OVER () / {LEAST_BLOCKS})::BIGINT)), 1)::BIGINT AS block FROM targets),
source_quotients AS (
  SELECT s.place, s.target / (2 * n + 1) AS quotient, n, round(s.total * {SHARE}::DOUBLE / s.block)::BIGINT AS seats
  FROM sources s, (SELECT unnest(range(max(ceil(total * {SHARE} / block))::BIGINT + 1)) AS n FROM sources) WHERE s.target > 0),
source_seats AS (
  SELECT place, count(*) FILTER (WHERE rank <= seats) AS seats
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, place, n) AS rank FROM source_quotients) GROUP BY place),
dealt AS (
  SELECT d.doc_id, d.size, s.place, s.source_size, s.target, s.block, md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.digest) AS ord,
    ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.digest), 17, 8))::BIGINT % s.shards AS shard
  FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
sized AS (
  SELECT z.*, coalesce(q.seats, 0) AS seats
  FROM (SELECT place, shard, sum(size)::BIGINT AS shard_size, any_value(block) AS block FROM dealt GROUP BY place, shard) z LEFT JOIN source_seats q USING (place)),
shard_quotients AS (
  SELECT place, shard, seats, shard_size / (2 * n + 1)::DOUBLE AS quotient, n
  FROM sized, (SELECT unnest(range(max(seats) + 1)) AS n FROM sized) WHERE n < seats AND shard_size > 0),
shard_seats AS (
  SELECT place, shard, count(*) FILTER (WHERE rank <= seats) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard, n) AS rank FROM shard_quotients) GROUP BY place, shard),
runs AS (
  SELECT place, shard, shard_size, least(coalesce(quota, 0) * block, shard_size * {MOST})::BIGINT AS words,
    (('0x' || substr(md5('{SEED}|' || place || '|' || shard), 1, 8))::BIGINT % greatest(ceil(shard_size / block)::BIGINT, 1)) * block AS first
  FROM sized LEFT JOIN shard_seats USING (place, shard)),
cut AS (SELECT *, words // greatest(shard_size, 1) AS whole, words - (words // greatest(shard_size, 1)) * shard_size AS run FROM runs),
laid AS (
  SELECT *, (sum(size) OVER (PARTITION BY place, shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS hi FROM dealt)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(least(hi, least(first + run, shard_size)) - greatest(hi - size, first), 0)
   + greatest(least(hi, first + run - shard_size) - greatest(hi - size, 0), 0))::BIGINT AS taken
FROM laid JOIN cut USING (place, shard)
"""
