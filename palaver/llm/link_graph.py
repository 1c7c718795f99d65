"""URL filters: rules for hosts and paths, and trust that travels along links.

Where no rule fits, a host is judged by the link graph. Hosts that an allow rule
names pass on trust along links, hosts that a rule blocks as a whole pass on
distrust against them (who links to a blocked host is suspect), both by walks
with restarts over distinct host edges. Trust is personalised PageRank: a host
shares it out among the hosts it links to. Distrust is a mean over the hosts a
host links to, so it hangs on that host's own links and not on how many others
link to the blocked one. Both are measured against the same walk from all hosts:
a host's share of trust is the part of its rank that comes from trusted hosts, its
share of distrust the part of its own walk that ends at blocked ones. A host is
blocked if its share of distrust reaches ``min_percent`` and exceeds that of trust: a host that links
to a blocked one and three others is, and one at the fifth link of a chain. Masses
are whole numbers, so the result does not hang on the order of sums. A round brings what is
still missing down to 85 percent, so the number of rounds follows from the ``tolerance``.

Everything is built from column functions; a round is one join and one partial
sum, and is stored. Links without a host stay on their page's host and are no edges;
links that leave out the scheme (``//host/``) name a host.

Defined cases: a null url, or one without ``://``, has an empty host and path, no
rule, and is allowed; null html has no links; rows that repeat get the same
verdict and add no edges; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import stored

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TOLERANCE = 0.05
DAMPING_PERCENT = 85
UNIT = 1_000_000_000_000
MIN_PERCENT = 10
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rounds_for(tolerance: float) -> int:
    return math.ceil(math.log(tolerance) / math.log(DAMPING_PERCENT / 100))


def host_of(url: Column, before: str = "://") -> Column:
    found = F.regexp_extract(url, rf"(?s)^.*?{before}([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits_host(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith("." + rule_host)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(text, verdict) of the longest rule that fits, else null."""
    # Longest first; of equally long ones the first given.
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = reduce(
        lambda c, r: c.when(
            _fits_host(host, r[1]) & path.startswith(r[2]), F.struct(F.lit(r[1] + r[2]).alias("text"), F.lit(r[0]).alias("verdict"))
        ),
        ordered,
        F,
    )
    return cases.otherwise(F.lit(None).cast("struct<text:string,verdict:string>"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) over hosts, without loops."""
    links = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    rows = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(links, lambda x: host_of(x, "//")))).alias("dst"))
    return rows.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(hosts: DataFrame, edges: DataFrame, seed: str, rounds: int, divided_by: str = "src") -> DataFrame:
    """(host, mass, whole): each seed host starts with, and is given back, ``UNIT``; mass moves along (src, dst). ``whole`` is the same from all hosts.

    Divided by the edges of "src", a host's mass is shared out; by those of "dst", a host gets the mean of what it hangs on.
    """
    degree = edges.groupBy(divided_by).agg(F.count("*").alias("degree"))
    out = stored(edges.join(degree, divided_by).select("src", "dst", "degree"), "edges")
    given = F.when(F.col(seed), F.lit(UNIT)).otherwise(F.lit(0)).cast("long")
    ranks = hosts.select("host", given.alias("mass"), F.lit(UNIT).alias("whole"))
    if out.isEmpty():
        return ranks
    start = hosts.select("host", given.alias("given"))
    for _ in range(rounds):
        moved = (
            out.join(ranks, F.col("src") == F.col("host"))
            .groupBy("dst")
            .agg(F.sum(F.expr("mass div degree")).alias("moved"), F.sum(F.expr("whole div degree")).alias("moved_whole"))
            .withColumnRenamed("dst", "_dst")
        )
        kept = lambda back, x: F.expr(f"{100 - DAMPING_PERCENT} * {back} div 100 + {DAMPING_PERCENT} * coalesce({x}, 0) div 100")
        ranks = start.join(moved, F.col("host") == F.col("_dst"), "left").select(
            "host", kept("given", "moved").alias("mass"), kept(f"{UNIT}L", "moved_whole").alias("whole")
        )
        ranks = stored(ranks, "ranks")
    return ranks


def judge(pages: DataFrame, rules=RULES, *, tolerance: float = TOLERANCE, min_percent: int = MIN_PERCENT) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rounds = rounds_for(tolerance)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    edges = stored(host_edges(pages), "links")
    whole = reduce(lambda a, r: a | _fits_host(F.col("host"), r[1]), [r for r in rules if r[0] == "block" and r[2] == "/"], F.lit(False))
    own = ruled.groupBy("host").agg(F.bool_or(F.coalesce(F.col("_rule.verdict") == "allow", F.lit(False))).alias("allowed"))
    linked = edges.select(F.col("dst").alias("host"), F.lit(False).alias("allowed"))
    hosts = own.union(linked).where("host <> ''").groupBy("host").agg(F.bool_or("allowed").alias("allowed"))
    hosts = stored(hosts.withColumn("bad", whole).withColumn("good", F.col("allowed") & ~F.col("bad")), "hosts")
    trust = propagate(hosts, edges, "good", rounds)
    # Against the links, and divided by the links of the host that gets it: a blocked host's in-degree takes nothing off.
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(hosts, against, "bad", rounds, divided_by="dst")
    exact = lambda c, name: F.col(c).cast("decimal(19,0)").alias(name)
    judged = trust.select("host", exact("mass", "trust"), exact("whole", "rank")).join(
        distrust.select("host", exact("mass", "distrust"), exact("whole", "walk")), "host"
    )
    # Only hosts that the graph blocks are looked up; the rest is allowed.
    blocked = judged.where(f"100 * distrust >= {min_percent} * walk and distrust * rank > trust * walk").select(F.col("host").alias("_host"))
    rows = ruled.join(blocked, F.col("host") == F.col("_host"), "left")
    by_graph = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("_rule.text").alias("rule"), F.coalesce("_rule.verdict", by_graph).alias("verdict")
    )


def _oracle() -> str:
    fits = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h)} AND starts_with(path, '{p}') THEN {what(v, h, p)}" for v, h, p in ordered) + " END"
    whole = " OR ".join(fits(h) for v, h, p in RULES if v == "block" and p == "/") or "false"
    step = []
    rounds = rounds_for(TOLERANCE)
    for kind, (a, b), seed in (("t", ("src", "dst"), "allowed AND NOT bad"), ("d", ("dst", "src"), "bad")):
        # Both walks are divided by the links of the page's own host.
        step.append(f"{kind}deg AS MATERIALIZED (SELECT {a} AS s, {b} AS t, count(*) OVER (PARTITION BY src) AS n FROM edge)")
        given = f"CASE WHEN {seed} THEN {UNIT} ELSE 0 END::BIGINT"
        step.append(f"{kind}0 AS MATERIALIZED (SELECT host, {given} AS given, {given} AS m, {UNIT}::BIGINT AS w FROM hosts)")
        back = f"{100 - DAMPING_PERCENT} * given // 100 + {DAMPING_PERCENT} * coalesce(x, 0) // 100"
        for k in range(rounds):
            step.append(
                f"{kind}{k + 1} AS MATERIALIZED (SELECT host, given, CASE WHEN (SELECT count(*) FROM edge) = 0 THEN m ELSE {back} END::BIGINT AS m,"
                f" CASE WHEN (SELECT count(*) FROM edge) = 0 THEN w ELSE {back.replace('given', str(UNIT)).replace('x,', 'y,')} END::BIGINT AS w"
                f" FROM {kind}{k} LEFT JOIN (SELECT t, sum(m // n)::BIGINT AS x, sum(w // n)::BIGINT AS y"
                f" FROM {kind}deg JOIN {kind}{k} ON s = host GROUP BY t) ON t = host)"
            )
    return f"""
WITH u AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT page_id, html, host, path, {case(lambda v, h, p: f"'{h}{p}'")} AS rule, {case(lambda v, h, p: f"'{v}'")} AS verdict FROM u),
edge AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(regexp_extract(link, '(?s)^.*?//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst FROM (
      SELECT host, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS link FROM u))
  WHERE src <> '' AND dst <> '' AND src <> dst),
hosts AS (
  SELECT host, bool_or(allowed) AS allowed, ({whole}) AS bad FROM (
    SELECT host, coalesce(verdict = 'allow', false) AS allowed FROM r UNION ALL SELECT dst, false FROM edge)
  WHERE host <> '' GROUP BY host),
{", ".join(step)}
SELECT page_id, r.host, path, rule,
       coalesce(verdict, CASE WHEN 100 * d.m::HUGEINT >= {MIN_PERCENT} * d.w::HUGEINT AND d.m::HUGEINT * t.w > t.m::HUGEINT * d.w THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN d{rounds} d ON d.host = r.host LEFT JOIN t{rounds} t ON t.host = r.host
"""


ORACLE = _oracle()
