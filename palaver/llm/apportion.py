"""Mixing sources to target weights by Sainte-Laguë apportionment.

A mix takes ``share`` times the words of the table. Sources get target words by
weight, none beyond ``repeat_limit`` times its own words. The total is cut into
equal blocks, and blocks go to sources by highest quotients target / (2k - 1);
then, by the same rule, each source's blocks go to its shards. Within a shard the
texts stand in an order drawn from the seed and are read as one stream of blocks;
the shard's quota of blocks is spread evenly over the stream from a seeded start,
in whole rounds first where a source is repeated. So what a text gives follows
from its place and its shard's quota alone, and nothing is sorted by block.

A quota is a divisor rule, so counts of blocks need no list of all quotients: a
divisor a little too large and one a little too small bound every part's blocks,
and only the few quotients between them are ranked.

Defined cases: texts without words take part with size 0 and give nothing; a null
source is a source of its own and comes last; rows with one id and one text are
one text that occurs several times, and share its draw; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import SEPARATORS, WORD, held, let, ranked, released, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
REPEAT_LIMIT = 2
BLOCK_WORDS = 32
SHARD_WORDS = 500_000
SALTS = 32
SEED = "mix-1"


def source_targets(
    sources: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    repeat_limit: int = REPEAT_LIMIT,
) -> DataFrame:
    """Add rank, weight, target and total_target to rows (source, source_size).

    Excess over a source's limit is reshared by weight until no source is above:
    each round adds the sources at their limit, and only the sums travel.
    """
    order = ranked(sources, F.col("source").asc_nulls_last(), name="source_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    rows = order.withColumn("weight", weight.cast("long")).withColumn("_most", repeat_limit * F.col("source_size"))
    total = F.sum(F.col("source_size")) * share_percent / F.lit(100)
    level, capped = None, -1
    while True:
        at_limit = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("_most")
        found = rows.agg(
            total.alias("total"),
            F.sum(F.when(at_limit, F.col("_most")).otherwise(0)).alias("held"),
            F.sum(F.when(at_limit, 0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(at_limit).alias("n"),
        ).first()
        if found["total"] is None or found["n"] == capped or not found["weights"]:
            break
        level, capped = (found["total"] - found["held"]) / found["weights"], found["n"]
    level = 0.0 if level is None else level
    # With a limit below the share every source ends at its limit.
    target = F.least(F.col("_most").cast("double"), F.col("weight") * F.lit(float(level)))
    return rows.withColumn("target", target).drop("_most")


def apportion(parts: DataFrame, group: str, part: str, weight: str, seats: str, name: str) -> DataFrame:
    """Sainte-Laguë seats of every part within its group; ties go to the smaller ``part``.

    ``seats`` is the group's number of seats, repeated in its rows.
    """
    sums = parts.groupBy(group).agg(F.sum(weight).alias("_sum"), F.count("*").alias("_n"))
    rows = _joined(parts, sums, group)
    w, n, total, want = F.col(weight), F.col("_n"), F.col("_sum"), F.col(seats)
    # sum(floor(w / d + 1/2)) lies within n / 2 of total / d.
    few = F.when(want > n / 2, want - n / 2 - 1).otherwise(F.lit(0.0))
    low = F.when(total > 0, F.greatest(F.floor(w * few / total + 0.5) - 1, F.lit(0))).otherwise(0)
    high = F.when(w > 0, F.floor(w * (want + n / 2 + 1) / total + 0.5) + 1).otherwise(0)
    bounded = stored(rows.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")), "seats")
    open_seats = bounded.groupBy(group).agg((F.max(seats) - F.sum("_low")).alias("_open"))
    k = F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))))
    quotients = bounded.select(group, part, F.col(weight).alias("_w"), k.alias("_k")).withColumn(
        "_q", F.col("_w") / (2 * F.col("_k") - 1)
    )
    order = ranked(
        quotients, F.col(group).asc_nulls_last(), F.col("_q").desc(), F.col(part).asc_nulls_last(), F.col("_k"), name="_r"
    )
    first = order.groupBy(group).agg(F.min("_r").alias("_first"))
    won = (
        _joined(_joined(order, first, group), open_seats, group)
        .where(F.col("_r") - F.col("_first") < F.col("_open"))
        .groupBy(group, part)
        .agg(F.count("*").alias("_won"))
    )
    won = won.select(F.col(group).alias("_wg"), F.col(part).alias("_wp"), "_won")
    match = F.col(group).eqNullSafe(F.col("_wg")) & F.col(part).eqNullSafe(F.col("_wp"))
    return (
        bounded.join(won, match, "left")
        .withColumn(name, F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_sum", "_n", "_low", "_high", "_wg", "_wp", "_won")
    )


def _joined(rows: DataFrame, per_group: DataFrame, group: str) -> DataFrame:
    """Inner join on a key that may be null."""
    other = per_group.withColumnRenamed(group, "_group")
    return rows.join(other, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _number(hexed: Column) -> Column:
    """A whole number from the first 15 digits of a hex digest."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def draw(seed: str, *what: Column) -> Column:
    """A digest that orders rows as the seed says."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("-")) for c in what]))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    repeat_limit: int = REPEAT_LIMIT,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, and what the mix takes.

    ``rounds`` whole readings of the text, then the blocks that the shard's
    ``picked`` of ``blocks`` put into it: block j of the shard is taken if
    floor((picked * (j + 1) + phase) / blocks) exceeds the same for j. The text's
    words begin at ``start`` in the shard. ``taken`` is the number of words in all.
    """
    sized = stored(
        docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("_text"), word_count(F.col("text")).alias("size")),
        "sizes",
    )
    # Partial sums before the shuffle: a hot source arrives as one row for each task.
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sources, weights, share_percent, repeat_limit)
    whole = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    blocks_in_all = math.floor(round(whole, 3) / block_words + 0.5)  # rounded: sums of doubles have no fixed order
    quotas = apportion(
        targets.withColumn("_all", F.lit(0)).withColumn("_seats", F.lit(blocks_in_all)),
        "_all", "source_rank", "target", "_seats", "quota",
    )
    shards = F.ceil((F.col("source_size") + F.col("_rows")) / shard_words)
    plan = stored(
        quotas.select("source", "source_rank", "source_size", "target", "quota", shards.alias("_shards")), "plan"
    )
    # Each source's row is copied to every salt, so that no task gets a whole source.
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    placed = _place(sized, salted, seed)
    parts = placed.groupBy("source_rank", "_shard").agg(F.sum("size").alias("_words"), F.max("quota").alias("quota"))
    seats = apportion(parts, "source_rank", "_shard", "_words", "quota", "_picked").select(
        F.col("source_rank").alias("_sr"), F.col("_shard").alias("_ss"), F.col("_words"), "_picked"
    )
    blocks = F.ceil(F.col("_words") / block_words).cast("long")
    rows = placed.join(seats, (F.col("source_rank") == F.col("_sr")) & (F.col("_shard") == F.col("_ss")))
    picked = F.least(F.col("_picked"), repeat_limit * F.greatest(blocks, F.lit(0)))
    start = F.expr(
        "coalesce(sum(size) over (partition by source_rank, _shard order by _draw, doc_id"
        " rows between unbounded preceding and 1 preceding), 0)"
    )
    phase = F.pmod(_number(draw(seed, F.lit("phase"), F.col("source_rank"), F.col("_shard"))), F.greatest(blocks, F.lit(1)))
    rows = (
        rows.withColumn("blocks", blocks)
        .withColumn("start", start)
        .withColumn("rounds", F.when(F.col("blocks") > 0, F.floor(picked / F.col("blocks"))).otherwise(0))
        .withColumn("picked", F.when(F.col("blocks") > 0, picked % F.col("blocks")).otherwise(0))
        .withColumn("phase", phase)
    )
    rows = rows.withColumn("taken", F.col("rounds") * F.col("size") + _partial(block_words))
    return rows.select(
        "doc_id", "source", F.col("_text").alias("text_md5"), "size", "source_size", "target",
        "taken", "rounds", "picked", "blocks", "phase", "start",
    )


def _place(sized: DataFrame, salted: DataFrame, seed: str) -> DataFrame:
    """Join documents with their source's plan and deal them to its shards."""
    plan = salted.withColumnRenamed("_salt", "_plan_salt")
    rows = sized.withColumn("_draw", draw(seed, F.col("doc_id"), F.col("_text"))).withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(SALTS)).cast("int")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_plan_salt"))
    shard = _number(F.md5(F.col("_draw"))) % F.greatest("_shards", F.lit(1))
    return rows.join(plan, same).withColumn("_shard", shard).drop("_source", "_plan_salt", "_salt", "_shards")


def _before(block: Column) -> Column:
    """Taken blocks of the shard before this one."""
    return F.floor((F.col("picked") * block + F.col("phase")) / F.col("blocks"))


def _partial(block_words: int) -> Column:
    """Words of a text in the shard's taken blocks: its first and last block in part, those between whole."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    first, last = F.floor(start / block_words), F.floor((end - 1) / block_words)
    taken = lambda b: _before(b + 1) - _before(b)
    inside = F.when(first == last, taken(first) * F.col("size")).otherwise(
        taken(first) * ((first + 1) * block_words - start)
        + (_before(last) - _before(first + 1)) * block_words
        + taken(last) * (end - last * block_words)
    )
    return F.when((F.col("size") > 0) & (F.col("picked") > 0), inside).otherwise(0).cast("long")


def mixed_texts(docs: DataFrame, mixed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents as the mix reads them: a row for each whole round, and one with the words of taken blocks.

    Columns are those of ``docs``; ``n_chars`` is set to the new text's length. Rows
    alike in doc_id, source and text are all read as the first of them in the shard is.
    """
    names = ("start", "size", "taken", "rounds", "picked", "blocks", "phase")
    key = mixed.groupBy("doc_id", "source", "text_md5").agg(F.min(F.struct(*names)).alias("plan"))
    key = key.where("plan.taken > 0").select("doc_id", "source", "text_md5", "plan.*")
    doc = F.col("doc")
    same = (
        doc["doc_id"].eqNullSafe(F.col("doc_id"))
        & (F.md5(F.coalesce(doc["text"], F.lit(""))) == F.col("text_md5"))
        & doc["source"].eqNullSafe(F.col("source"))
    )
    rows = held(docs).join(key, same).withColumn("text", doc["text"])
    start, end = F.col("start"), F.col("start") + F.col("size")
    first, last = F.floor(start / block_words), F.floor((end - 1) / block_words)
    words = F.regexp_extract_all("text", F.lit(f"{SEPARATORS[:-1]}*{WORD}"), F.lit(0))
    chosen = F.filter(F.sequence(first, last), lambda b: _before(b + 1) > _before(b))
    cut = lambda w, b: F.slice(
        w,
        (F.greatest(b * block_words, F.col("start")) - F.col("start") + 1).cast("int"),
        (F.least((b + 1) * block_words, F.col("start") + F.col("size")) - F.greatest(b * block_words, F.col("start"))).cast("int"),
    )
    rest = F.col("taken") - F.col("rounds") * F.col("size")
    part = let(words, lambda w: F.array_join(F.flatten(F.transform(chosen, lambda b: cut(w, b))), ""))
    rows = rows.withColumn("_part", F.when(rest > 0, part))
    copies = F.concat(
        F.array_repeat("text", F.col("rounds").cast("int")), F.when(rest > 0, F.array("_part")).otherwise(F.array())
    )
    rows = rows.withColumn("text", F.explode(copies))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*released(docs, **changed))
