"""The quality query and its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm.common import table
from palaver.llm.quality_divergence import (
    COMMON_WORDS,
    MAX_CLASS_DISTANCE,
    MAX_WORD_DISTANCE,
    MIN_CHARS,
    MIN_WORDS,
    quality,
)

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(*COLUMNS)


_LISTED = ", ".join(f"'{w}'" for w in dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))
_LANGUAGES = ", ".join(f"'{x}'" for x in COMMON_WORDS)


def _class_columns() -> str:
    kinds, out, seen = ["a-z", r" \t\n\x0B\f\r", "A-Z", "0-9", r"\p{L}"], [], ""
    for kind in kinds:
        out.append(f"length(regexp_replace(t, '[{seen}]+', '', 'g'))" if seen else "length(t)")
        seen += kind
    out.append(f"length(regexp_replace(t, '[{seen}]+', '', 'g'))")
    return ", ".join([f"({a}) - ({b})" for a, b in zip(out, out[1:])] + [out[-1]])


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM win) WHERE n > 1),
covered AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row),
base AS (
  SELECT d.row, doc_id, lang, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (row) LEFT JOIN covered USING (row)),
classes AS (
  SELECT row, lang, unnest([{_class_columns()}]) AS c, unnest(range(6)) AS bin FROM base),
hits AS (
  SELECT row, lower(x) AS x, count(*) AS c FROM (SELECT row, unnest(w) AS x FROM d)
  WHERE lower(x) IN ({_LISTED}) GROUP BY ALL),
common AS (
  SELECT b.row, lang, coalesce(c, 0) AS c, x AS bin
  FROM base b CROSS JOIN (SELECT unnest([{_LISTED}]) AS x) LEFT JOIN hits h USING (row, x)
  UNION ALL
  SELECT b.row, lang, n_words - coalesce(n, 0), '' FROM base b
  LEFT JOIN (SELECT row, sum(c) AS n FROM hits GROUP BY row) USING (row)),
hist AS (
  SELECT 'class' AS kind, row, lang, bin::VARCHAR AS bin, c::BIGINT AS c FROM classes
  UNION ALL SELECT 'word', row, lang, bin, c::BIGINT FROM common),
p AS (SELECT *, CASE WHEN sum(c) OVER w > 0 THEN c / (sum(c) OVER w) END AS p FROM hist WINDOW w AS (PARTITION BY kind, row)),
ref AS (
  SELECT kind, lang AS ref, bin, sum(c) / (sum(sum(c)) OVER (PARTITION BY kind, lang)) AS q
  FROM hist WHERE lang IN ({_LANGUAGES}) GROUP BY kind, lang, bin),
js AS (
  SELECT kind, row, lang, ref,
         sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                         + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS dist
  FROM p JOIN ref USING (kind, bin) WHERE p IS NOT NULL GROUP BY kind, row, lang, ref),
far AS (
  SELECT row, max(dist) FILTER (kind = 'class') AS cd, max(dist) FILTER (kind = 'word') AS wd FROM (
    SELECT kind, row, coalesce(max(dist) FILTER (ref = lang), min(dist)) AS dist FROM js GROUP BY kind, row)
  GROUP BY row),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(length(t) >= {MIN_CHARS} AND cd > {MAX_CLASS_DISTANCE}, false)
         AND NOT coalesce(n_words >= {MIN_WORDS} AND wd > {MAX_WORD_DISTANCE}, false) AS kept
FROM judged LEFT JOIN far USING (row)
"""
