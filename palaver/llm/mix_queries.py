"""The mixing query and its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.apportion import BLOCK_WORDS, SEED, SHARD_WORDS, mix
from palaver.llm.common import table


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken")
    )


# The quotients are written out in full and the largest taken; the level of the
# targets comes from running sums instead of rounds.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tx,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
  FROM documents),
src AS (
  SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 2 * s AS most FROM (
    SELECT source, sum(size)::BIGINT AS s, count(*) AS n,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM sized GROUP BY source)),
tot AS (SELECT sum(s)::BIGINT * 150 / 100 AS total FROM src),
o AS (
  SELECT *, row_number() OVER w AS k,
         coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
         (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM src WINDOW w AS (ORDER BY most / weight, rank)),
lv AS (
  SELECT (total - held) / rest AS level FROM o, tot
  WHERE weight * ((total - held) / rest) <= most ORDER BY k LIMIT 1),
target AS (SELECT src.*, least(most::DOUBLE, weight * level) AS target FROM src, lv),
seats AS (SELECT floor(round(sum(target), 3) / {BLOCK_WORDS} + 0.5)::BIGINT AS seats, count(*) AS sources FROM target),
quotient AS (
  SELECT rank, target / (2 * k - 1) AS q, seats FROM (
    SELECT rank, target, seats, unnest(range(1, ceil(target / {BLOCK_WORDS})::BIGINT + sources + 2)) AS k FROM target, seats)),
quota AS (
  SELECT rank, count(*) AS quota FROM (
    SELECT rank, seats, row_number() OVER (ORDER BY q DESC, rank) AS r FROM quotient)
  WHERE r <= seats GROUP BY rank),
plan AS (
  SELECT t.*, coalesce(quota, 0) AS quota, ceil((s + n) / {SHARD_WORDS})::BIGINT AS shards
  FROM target t LEFT JOIN quota USING (rank)),
placed AS (
  SELECT *, ('0x' || substr(md5(draw), 1, 15))::BIGINT % greatest(shards, 1) AS shard FROM (
    SELECT d.doc_id, d.size, p.rank, p.s, p.target, p.quota, p.shards,
           md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '-') || '|' || d.tx) AS draw
    FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)),
part AS (
  SELECT rank, shard, sum(size)::BIGINT AS words, max(quota) AS quota, count(*) OVER (PARTITION BY rank) AS n
  FROM placed GROUP BY rank, shard),
won AS (
  SELECT rank, shard, count(*) AS picked FROM (
    SELECT rank, shard, quota, row_number() OVER (PARTITION BY rank ORDER BY words / (2 * k - 1) DESC, shard) AS r
    FROM (SELECT *, unnest(range(1, ceil(2 * words / {BLOCK_WORDS})::BIGINT + n + 2)) AS k FROM part))
  WHERE r <= quota GROUP BY rank, shard),
shard AS (
  SELECT rank, shard, words, ceil(words / {BLOCK_WORDS})::BIGINT AS blocks,
         least(coalesce(picked, 0), 2 * ceil(words / {BLOCK_WORDS})::BIGINT) AS picked
  FROM part LEFT JOIN won USING (rank, shard)),
doc AS (
  SELECT d.*, blocks, CASE WHEN blocks > 0 THEN picked // blocks ELSE 0 END AS rounds,
         CASE WHEN blocks > 0 THEN picked % blocks ELSE 0 END AS r,
         ('0x' || substr(md5('{SEED}|phase|' || d.rank || '|' || d.shard), 1, 15))::BIGINT % greatest(blocks, 1) AS phase,
         coalesce(sum(size) OVER (PARTITION BY d.rank, d.shard ORDER BY draw, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed d JOIN shard USING (rank, shard)),
block AS (
  SELECT doc_id, draw, start, size, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS b, r, blocks, phase
  FROM doc WHERE size > 0 AND r > 0),
part_taken AS (
  SELECT doc_id, draw, start, sum(least((b + 1) * {BLOCK_WORDS}, start + size) - greatest(b * {BLOCK_WORDS}, start))::BIGINT AS words
  FROM block WHERE (r * (b + 1) + phase) // blocks > (r * b + phase) // blocks GROUP BY doc_id, draw, start)
SELECT doc.doc_id, size::BIGINT AS size, s AS source_size, target,
       (rounds * size + coalesce(words, 0))::BIGINT AS taken
FROM doc LEFT JOIN part_taken p
  ON doc.doc_id IS NOT DISTINCT FROM p.doc_id AND doc.draw = p.draw AND doc.start = p.start
"""
