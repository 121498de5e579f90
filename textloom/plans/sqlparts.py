"""Pieces of DuckDB SQL that several oracles share."""

SPACE = r"[\s\v\p{Z}\x{85}]+"


def split(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SPACE}'), lambda x: x <> '')"


def lower(c: str) -> str:
    return f"lower(translate({c}, 'İI', 'iı'))"


def harden(c: str) -> str:
    low = lower(c)
    return f"(CASE WHEN length({c}) > 0 THEN left({low}, length({low}) - 1) || translate(right({low}, 1), 'bcdgğ', 'pçtkk') ELSE {low} END)"


def letters(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '[0-9]', '', 'g')"


#: doc_id, pos, word: the words of the 'letters' cleaner in lower case.
WORDS = f"""words AS (
  SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (
    SELECT doc_id, list_transform(list_filter(list_transform({split('text')}, lambda w: {letters('w')}),
      lambda w: regexp_full_match(w, '\\p{{L}}{{2,30}}')), lambda w: {lower('w')}) AS ws FROM documents) )"""

#: doc_id, line_no, line.
LINES = r"""lines AS (
  SELECT doc_id, line_no, line FROM (
    SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, regexp_replace(unnest(ls), '^[\s\v\p{Z}\x{85}]+|[\s\v\p{Z}\x{85}]+$', '', 'g') AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE line <> '')"""

COUNTS = "counts AS MATERIALIZED (SELECT word, count(*) AS freq FROM words GROUP BY word)"


def every(c: str, n: int) -> str:
    """Pieces of n characters."""
    return f"list_transform(range(0, greatest(ceil(length({c}) / {n})::BIGINT, 1)), lambda i: substr({c}, (i * {n} + 1)::BIGINT, {n}))"


def boundaries(segs: str) -> str:
    return f"list_sort(list_distinct(list_transform(range(1, len({segs})), lambda i: list_sum(list_transform({segs}[1:i], lambda s: length(s)))::BIGINT)))"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


#: id, label, unit.
UNITS = """units AS (
  SELECT vec_id AS id, label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS unit
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL))"""
