"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each block of vectors
has an inverted file: for every pivot the vectors that have it among their
``prefix`` nearest, with its place in their order. A query reads the lists of its
own nearest pivots and adds up, for each vector met, how much the two orders have
in common: the part of the footrule distance that differs between vectors (a
pivot missing in an order counts as the place behind its end). Orders know angles
only, and the measure is the inner product: a line through the footrules and cosines of a few queries
turns a footrule into a cosine and its spread, and the vector's length times both
is what a block ranks by (with equal lengths that is the footrule's order). The best ``share``
of a block is reranked by the true measure, and blocks' results merge.

Pivots are drawn from the vectors by hash, at most ``pivots`` of them, the only
sample; every vector is indexed, every query answered. Queries and blocks meet in
tiles of bounded size.

Defined cases: null vectors, zero vectors and those with null or non-finite
components take no part, nor do vectors of another than the most common length
(the smaller one on a tie); equal scores are ordered by smaller id; rows that
repeat an id each take part; fewer candidates than asked for are all returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.llm.common import stored

PIVOTS = 512
PREFIX = 32
SHARE = 0.25
NEAREST = 20
#: Queries of a tile whose footrules are compared with cosines.
FITTED = 16
BLOCK_ROWS = 16_384
QUERY_ROWS = 1_024


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v an array of doubles, all of the most common length."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null and v is not null").where(fine)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (most[0]["d"] if most else 0))


class Block:
    """Inverted files of one block of vectors."""

    def __init__(self, ids, vectors, pivots, prefix: int):
        import numpy as np

        order = np.argsort(ids, kind="stable")  # among equals the smaller id comes first
        self.np, self.ids, self.vectors, self.prefix = np, ids[order], vectors[order], min(prefix, len(pivots))
        nearest = self.orders(self.vectors, pivots)
        # Postings by pivot: which vectors, and how near the pivot is to them.
        flat, rows = nearest.ravel(), np.repeat(np.arange(len(ids)), self.prefix)
        weight = np.tile(self.prefix - np.arange(self.prefix), len(ids))
        by = np.argsort(flat, kind="stable")
        self.rows, self.weight = rows[by].astype("i4"), weight[by].astype("f8")
        self.at = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        self.lengths = np.linalg.norm(self.vectors, axis=1)
        self.line = (1.0, 0.0, 0.0)

    def fit(self, queries, orders) -> None:
        """The line from agreement to cosine, and the spread around it, by the first queries."""
        np = self.np
        x = np.concatenate([self.common(o) for o in orders[:FITTED]])
        y = np.concatenate([self.vectors @ q / (self.lengths * np.linalg.norm(q)) for q in queries[:FITTED]])
        slope = np.cov(x, y, bias=True)[0, 1] / x.var() if x.var() > 0 else 0.0
        if slope > 0:
            base = y.mean() - slope * x.mean()
            self.line = (slope, base, float((y - base - slope * x).std()))

    def orders(self, vectors, pivots):
        """Numbers of each vector's nearest pivots, nearest first."""
        np = self.np
        near = vectors @ pivots.T
        near /= np.linalg.norm(pivots, axis=1)  # the angle decides
        return np.argsort(-near, axis=1, kind="stable")[:, : self.prefix]

    def common(self, order):
        """For each vector of the block, how far its order agrees with this one: twice this, taken from a constant, is the footrule."""
        np = self.np
        lists = [slice(self.at[p], self.at[p + 1]) for p in order]
        rows = np.concatenate([self.rows[s] for s in lists])
        least = np.concatenate([np.minimum(self.weight[s], self.prefix - k) for k, s in enumerate(lists)])
        return np.bincount(rows, least, len(self.ids))

    def search(self, query_id: int, query, order, share: float, nearest: int):
        """Ids and scores of the best of this block, the query's own row left out."""
        np = self.np
        n = len(self.ids)
        most = max(4 * nearest, int(np.ceil(share * n)))
        if most < n:
            slope, base, spread = self.line
            key = self.lengths * (slope * self.common(order) + base + spread)
            least = -np.partition(-key, most - 1)[most - 1]
            best = np.flatnonzero(key > least)
            # Ties go to smaller ids.
            best = np.concatenate([best, np.flatnonzero(key == least)[: most - len(best)]])
        else:
            best = np.arange(n)
        best = np.sort(best[self.ids[best] != query_id])
        scores = self.vectors[best] @ query
        first = np.lexsort((self.ids[best], -scores))[:nearest]
        return self.ids[best][first], scores[first]


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    nearest: int = NEAREST,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = SHARE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the nearest found by inner product. ``is_query`` is over ``id``."""
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    n, n_queries = rows.count(), rows.where(is_query).count()
    blocks, tiles = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    drawn = rows.select("id", "v").orderBy(F.xxhash64("v"), "id").limit(pivots).collect()
    centres = [r["v"] for r in drawn]
    if not centres:
        empty = "query_id long, rank int, vec_id long, score double"
        return vectors.sparkSession.createDataFrame([], empty)

    place = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("long")
    # A tile holds one block and one group of queries.
    index = rows.select("id", "v", place(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    asked = rows.where(is_query).select(
        "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), place(tiles).cast("int").alias("tile")
    )

    def searched(left, right):
        import numpy as np
        import pandas as pd

        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="f8" if c == "score" else "i8") for c in columns})
        points = np.array(centres)
        block = Block(left["id"].to_numpy(), np.stack(left["v"].to_numpy()), points, prefix)
        queries = np.stack(right["v"].to_numpy())
        orders = block.orders(queries, points)
        fitted = np.argsort(right["id"].to_numpy(), kind="stable")[:FITTED]
        block.fit(queries[fitted], orders[fitted])
        out = []
        for k, key in enumerate(right["id"].tolist()):
            ids, scores = block.search(key, queries[k], orders[k], share, nearest)
            out.append(pd.DataFrame({"query_id": key, "vec_id": ids, "score": scores}))
        return pd.concat(out)

    found = (
        index.groupBy("block", "tile")
        .cogroup(asked.groupBy("block", "tile"))
        .applyInPandas(searched, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
