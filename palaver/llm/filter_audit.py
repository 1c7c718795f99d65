"""Filter interaction audit: what every order of a set of filters removes, and each filter's Shapley share.

A document matters only by the set of filters it fails, its mask. Orders are
paths through the lattice of filter subsets, from none applied to all: the step
of filter f behind the subset S is the edge (S, f), and a document goes there
exactly if its mask holds f and nothing of S. So documents are counted by mask in
one pass, masks are spread over the edges, and

* forward counting gives the orders that reach a state, backward counting those
  that leave it for the end; their product over an edge is the number of orders
  through it, the weight of its removals in the Shapley sum;
* an order's steps are read from the same edges.

The lattice hangs on the number of filters alone (5: 32 states, 80 edges, 120 orders).

Repeated texts come without a join of texts: a text's least doc_id is one
aggregate, the rows that hold it are found by (doc_id, digest), and all other rows
with an id have the text as a repeat.

Defined cases: null text is empty; a null source is the part ''; rows without a
doc_id have no label, repeat nothing and are repeated by nothing; rows that share doc_id and text
do not repeat each other, as neither id is smaller; several labels for one doc_id
count as 1 if any is; an empty table has no parts and gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import SEPARATORS, let, stored, table

REPEATED = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself, by filter letter."""
    held = F.array_remove(F.split(text, SEPARATORS), "")
    counts = let(held, lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "A": counts["words"] < 200,
        "B": 100 * counts["distinct"] < 50 * counts["words"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def lattice(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and that lead from it to the full one."""
    states = sorted(range(1 << n), key=int.bit_count)
    forward, backward = [0] * (1 << n), [0] * (1 << n)
    forward[0] = backward[-1] = 1
    for s in states:
        for f in range(n):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(states):
        for f in range(n):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: the k-th filter fails), documents, good, toxic: counted rows."""
    text = F.coalesce("text", F.lit(""))
    plain = sum(F.when(c, 1 << "ABCD".index(k)).otherwise(0) for k, c in text_failures(F.col("t")).items())
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    # Texts are read once; what goes on is a short row for each.
    rows = stored(rows.select("id", "part", plain.cast("int").alias("plain"), F.unhex(F.sha2("t", 256)).alias("digest")), "masks")
    # Repeats of a row fold before they are shuffled.
    own = rows.where("id is not null").groupBy("id", "digest", "part", "plain").agg(F.count("*").alias("n"))
    least = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(0))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic")).where("id is not null")
    repeat = F.coalesce("first", F.lit(1 << "ABCDE".index(REPEATED)))
    n = F.sum("n").alias("documents")
    good, toxic = (F.sum(F.col("n") * F.coalesce(c, F.lit(0))) for c in ("quality", "toxic"))
    with_id = (
        own.join(least, ["id", "digest"], "left")
        .join(marked, "id", "left")
        .groupBy("part", (F.col("plain") + repeat).alias("mask"))
        .agg(n, good.alias("good"), toxic.alias("toxic"))
    )
    zero = F.lit(0).cast("long")
    without = rows.where("id is null").groupBy("part", F.col("plain").alias("mask")).agg(
        F.count("*").alias("documents"), zero.alias("good"), zero.alias("toxic")
    )
    sums = [F.sum(c).alias(c) for c in ("documents", "good", "toxic")]
    return with_id.union(without).groupBy("part", "mask").agg(*sums)


def audit(counted: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Every order and step of ``filters`` within each part, from the masks counted by part."""
    spark, n = counted.sparkSession, len(filters)
    if not 1 <= n <= 7:
        raise ValueError("from one to seven filters: their orders are rows of the result")
    forward, backward = lattice(n)
    edges = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    # What the edge (state, filter) does to documents of a mask; 0 and 1 as flags.
    effects = [
        (m, s, filters[f], forward[s] * backward[s | 1 << f],
         int(not m & (s | 1 << f)), int(m >> f & 1 and not m & s), int(m >> f & 1 and m & s > 0), int(m == 1 << f))
        for m in range(1 << n) for s, f in edges
    ]
    names = ("kept", "removed", "redundant", "unique_fails")
    schema = "mask int, state int, filter string, orders long, " + ", ".join(f"is_{c} int" for c in names)
    effects = spark.createDataFrame(effects, schema)
    sums = [F.sum(F.col("documents") * F.col(f"is_{c}")).alias(c) for c in names]
    lost = [F.sum(F.col(c) * F.col("is_removed")).alias(f"{c}_lost") for c in ("good", "toxic")]
    # At most 2^n masks for a part meet a table of fixed size.
    flows = counted.join(F.broadcast(effects), "mask").groupBy("part", "state", "filter", "orders").agg(*sums, *lost)
    flows = stored(flows, "flows")
    shares = flows.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = [
        ("".join(order), k + 1, sum(1 << filters.index(x) for x in order[:k]), order[k])
        for order in permutations(filters) for k in range(n)
    ]
    steps = spark.createDataFrame(steps, "filter_order string, step int, state int, filter string")
    long = [F.col(c).cast("long") for c in (*names, "good_lost", "toxic_lost", "shapley")]
    return (
        flows.join(F.broadcast(steps), ["state", "filter"])
        .join(shares, ["part", "filter"])
        .select("part", "filter_order", "step", *long)
    )


def op11_filter_audit(spark, sf_dir):
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


# Every order is written out, and the first failing letter of each mask looked for in it.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x
    AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
gone AS (
  SELECT part, fails, n, good, toxic, filter_order,
    list_min([CASE WHEN contains(fails, y) THEN strpos(filter_order, y) ELSE 6 END FOR y IN ['A', 'B', 'C', 'D', 'E']]) AS hit
  FROM m, o),
r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
    sum(CASE WHEN hit > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) GROUP BY part, filter_order, step),
s AS (SELECT part, filter, sum(removed) AS shapley FROM r GROUP BY part, filter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM r JOIN s USING (part, filter)
"""
