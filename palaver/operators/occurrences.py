"""Where in a thread something occurs first, for ranking ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_SEEN = "first_seen"

# More than any array has entries. The product needs a decimal, which holds every
# post number; unlike a pair's, its minimum stays in a hash aggregate.
POSITIONS = 1 << 31


def appearance(post_num: str = "post_num", pos: str = "pos") -> Column:
    """Order of an array or map entry among all entries of a thread, exact for any numbers."""
    place = F.col(post_num).cast("decimal(19,0)") * F.lit(POSITIONS).cast("decimal(10,0)")
    return place + F.col(pos)


def seen_at(column: str = FIRST_SEEN) -> list[Column]:
    """``seen_post`` and ``seen_pos``: the post an appearance stands for, and the position in it."""
    size = F.lit(POSITIONS).cast("decimal(10,0)")
    pos = F.pmod(F.col(column), size)
    post = (F.col(column) - pos) / size
    return [post.cast("bigint").alias("seen_post"), pos.cast("bigint").alias("seen_pos")]
