"""N-gram Jaccard join with an R-tree over count vectors; exact, and whole groups at once.

A text's set holds the hashes of its word shingles. Hashes fall into groups; the
number of a set's shingles in each group is its point. Two sets cannot share more
than the sum of the smaller counts, so a box of points that cannot share enough
with another box is passed over, and so are pairs of points. Survivors are
verified on their sets.

Sets that could link are brought together by prefixes: of two sets with Jaccard t
or more, each one's first n - ceil(t n) + 1 shingles, in any order common to all,
share one. Shingles that many texts hold come last in that order, so buckets stay
small; which ones do is an estimate and bears on speed only.

Groups of copies are never expanded into pairs. Equal sets are one class from the
start. Then, in a few rounds, every class is compared with one class of another
component that leads one of its buckets; what these links join is one component,
and the trees then look for pairs of different components only. A link left out
lies within a component already found.

A pair may meet in many buckets. Each class carries the first few of its buckets,
and a pair is listed only where no earlier one is in both lists, so nearly every pair is listed once.
Nodes of the tree hold neighbouring groups added up; pairs of points that pass these
are tested again on the fine groups, where chance hides little.

A bucket beyond ``BLOCK_ROWS`` rows or ``BLOCK_CELLS`` counts is cut into blocks of
one width, ordered by component and size. Each block has one box; pairs of blocks
that could share enough, and are not of one component, go to tasks of their own.
So a task holds two blocks at most, however large the bucket.

Defined cases: null text and texts without words have an empty set and link with
nothing; fewer words than a shingle are one shingle; rows that repeat are copies;
rows with one doc_id and several texts are one document, linked by any of them; a
null doc_id takes the component of a set like its own, or null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import held, ranked, released, stored
from palaver.llm.components import components
from palaver.session import at_most

SHINGLE_WORDS = 5
MIN_PERCENT = 75
#: Shingles in a group, on average; groups are 2^bits. Nodes of trees hold the sums of COARSE groups.
GROUP_MEAN, MIN_BITS, MAX_BITS, COARSE = 2, 4, 14, 8
#: The most frequent shingles, ordered last: at most this many (hash, count) pairs go to the driver and to tasks.
FREQUENT = 262_144
FREQUENT_IN_CHUNK = 4
CHUNK_HASHES = 1_000_000
LEAF = 32
#: What one task holds of a bucket: larger ones are cut into blocks. Cells are rows times groups.
BLOCK_ROWS, BLOCK_CELLS = 1024, 1 << 21
PAIRS_IN_BATCH = 65_536
#: Rounds of comparing with one leader, and buckets that a class carries; both bear on speed only.
STAR_ROUNDS, EARLY = 2, 12
ID_BITS = 20

PIECE_BYTES = 1 << 20
#: Rows handed to a Python worker at once: whole texts, two of them when pairs are verified.
ARROW_ROWS = 512
_ODD = 0x9E3779B97F4A7C15


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles, by whole arrays.

    A word's hash is a sum of random numbers for its bytes times powers of an odd
    number; sums over words come from one running sum over the text.
    """

    def __init__(self, size: int = SHINGLE_WORDS):
        import numpy as np

        self.np, self.size = np, size
        self.values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
        self.values[65:91] = self.values[97:123]  # A-Z as a-z
        self.gap = np.zeros(256, bool)
        self.gap[[32, 9, 10, 11, 12, 13]] = True
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(x: int):
            out = self.np.full(n + 1, x, "u8")
            out[0] = 1
            return self.np.multiply.accumulate(out)

        self.powers, self.inverses = powers(_ODD), powers(pow(_ODD, -1, 1 << 64))

    def _words(self, text: bytes):
        np = self.np
        data = np.frombuffer(text, "u1")
        if len(data) >= len(self.powers):
            self._grow(2 * len(data))
        solid = np.zeros(len(data) + 2, "i1")
        solid[1:-1] = ~self.gap[data]
        edges = np.flatnonzero(np.diff(solid))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        hashed = (sums[ends] - sums[starts]) * self.inverses[starts]
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        return hashed ^ (hashed >> np.uint64(29))

    def __call__(self, text: str | None):
        np = self.np
        data = (text or "").encode()
        parts, at = [], 0
        while at < len(data):  # pieces end at blanks, so no word is cut
            end = at + PIECE_BYTES
            while end < len(data) and not self.gap[data[end]]:
                end += 1
            parts.append(self._words(data[at:end]))
            at = end
        words = np.concatenate(parts) if parts else np.empty(0, "u8")
        if not len(words):
            return words
        width = min(self.size, len(words))
        acc = np.full(len(words) - width + 1, width, "u8")
        for k in range(width):
            acc = acc * np.uint64(_ODD) + words[k : k + len(acc)]
        acc ^= acc >> np.uint64(31)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(29)
        return np.unique(acc)


def _digest(hashes) -> bytes:
    from hashlib import blake2b

    return blake2b(hashes.tobytes(), digest_size=16).digest()


def group_bits(n: int) -> int:
    """Groups grow with the set, about two shingles each: with more, chance alone would hide what differs."""
    return min(max((max(n, 1) // GROUP_MEAN).bit_length(), MIN_BITS), MAX_BITS)


def count_vector(hashes):
    """The set's point: its shingles in each group of hashes."""
    import numpy as np

    bits = group_bits(len(hashes))
    return np.bincount((hashes >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits).astype("<u4")


def packed(point) -> bytes:
    """Four bytes for each count, or, if a byte holds them all, one for each and one in front: an odd length tells."""
    return b"\0" + point.astype("u1").tobytes() if point.max(initial=0) < 256 else point.astype("<u4").tobytes()


def unpacked(vec: bytes):
    import numpy as np

    return np.frombuffer(vec, "u1", offset=1).astype("<u4") if len(vec) % 2 else np.frombuffer(vec, "<u4")


def folded(point, groups: int):
    """The same point over fewer groups: neighbours added up."""
    return point if len(point) == groups else point.reshape(groups, -1).sum(1)


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with a partner."""
    return -(-n * percent // 100)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """A row for each text (doc_id, n, digest, c, vec) and, with ``hash`` set, rows of shingles that are frequent in a chunk."""

    def signed(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "text_md5", "n", "digest", "c", "vec", "hash", "count"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        held, total, shingled = [], 0, Shingler(size)

        def frequent():
            if not held:
                return None
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT_IN_CHUNK
            n = int(often.sum())
            columns = [pa.nulls(n, t) for t in types[:6]] + [pa.array(hashes[often].astype("i8")), pa.array(counts[often])]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            rows = []
            for key, text, name in zip(*[column.to_pylist() for column in batch.columns]):
                hashes = shingled(text)
                digest = _digest(hashes) if len(hashes) else None
                c = int.from_bytes(digest[:8], "little", signed=True) if digest else None
                rows.append((key, name, len(hashes), digest, c, packed(count_vector(hashes)) if digest else None, None, None))
                held.append(hashes)
                total += len(hashes)
                if total >= CHUNK_HASHES:
                    yield frequent()
                    held, total = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)
        if held:
            yield frequent()

    schema = "doc_id long, text_md5 string, n long, digest binary, c long, vec binary, hash long, count long"
    return docs.select(F.col("doc_id").cast("long"), "text", F.md5(F.coalesce("text", F.lit("")))).mapInArrow(signed, schema)


def _postings(docs: DataFrame, size: int, percent: int, often, times) -> DataFrame:
    """(shingle, c): the prefix of each set, once for each set and task. ``often`` are frequent shingles in order, ``times`` how often."""

    def posted(batches):
        import numpy as np
        import pyarrow as pa

        seen: set[bytes] = set()
        shingled = Shingler(size)
        for batch in batches:
            shingles, owners = [], []
            for text in batch.column(0).to_pylist():
                hashes = shingled(text)
                if not len(hashes):
                    continue
                digest = _digest(hashes)
                if digest in seen:
                    continue
                seen.add(digest)
                order = hashes
                if len(often):
                    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                    count = np.where(often[at] == hashes, times[at], 0)
                    order = hashes[np.argsort(count, kind="stable")]
                first = order[: len(hashes) - needed(len(hashes), percent) + 1]
                shingles.append(first.astype("i8"))
                owners.append(np.full(len(first), int.from_bytes(digest[:8], "little", signed=True), "i8"))
            if shingles:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingles)), pa.array(np.concatenate(owners))], ["shingle", "c"]
                )

    return docs.select("text").mapInArrow(posted, "shingle long, c long")


def _enough(shared, n_a, n_b, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points could share enough."""
    side = lambda x: points.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("vec").alias(f"vec_{x}"))

    def kept(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
            least = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y = unpacked(x), unpacked(y)
                groups = min(len(x), len(y))
                least.append(int(np.minimum(folded(x, groups), folded(y, groups)).sum()))
            good = _enough(np.array(least, "i8"), n_a, n_b, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "vec_a", "vec_b")
    return joined.mapInArrow(kept, "a long, b long")


def _texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``pairs``, and of few others.

    Ids are cut to ``ID_BITS`` bits, so what is broadcast has a fixed bound; it
    only spares texts the way to a join that decides exactly.
    """
    cut = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS)).alias("_cut")
    cuts = pairs.select(cut(F.col("a"))).union(pairs.select(cut(F.col("b")))).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("_cut", cut(F.col("id")))
    return rows.join(F.broadcast(cuts), "_cut", "left_semi").select("id", "text")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, computed anew from their texts."""
    pairs = stored(pairs, "pairs")
    texts = _texts_of(pairs, docs)
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    def kept(batches):
        import numpy as np
        import pyarrow as pa

        shingled, last, x = Shingler(size), None, None
        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(*[c.to_pylist() for c in batch.columns]):
                if (a, text_a) != last:
                    last, x = (a, text_a), shingled(text_a)
                y = shingled(text_b)
                if len(x) and len(y) and _enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    out.append((a, b))
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])

    # The many go first: each carries its own text to its leader's.
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(kept, "a long, b long")


class CountTree:
    """R-tree over points: leaves of close points, every node with the largest count of each group, its sizes and its components."""

    def __init__(self, points, sizes, comp=None):
        import numpy as np

        self.fine, self.sizes, self.np = points.astype("i4"), sizes, np
        width = points.shape[1]
        self.points = self.fine.reshape(len(points), -1, COARSE).sum(2) if width >= 4 * COARSE else self.fine
        self.comp = np.arange(len(sizes)) if comp is None else comp
        self.root = self._build(np.arange(len(sizes)))

    def _build(self, rows):
        np = self.np
        top, least, most = self.points[rows].max(0), int(self.sizes[rows].min()), int(self.sizes[rows].max())
        span = (int(self.comp[rows].min()), int(self.comp[rows].max()))
        if len(rows) <= LEAF:
            return (top, least, most, rows, None, span)
        # Sizes spread widest as long as they differ by more than partners may.
        spread = self.points[rows].max(0) - self.points[rows].min(0)
        key = self.sizes[rows] if 4 * least < 3 * most else self.points[rows, int(spread.argmax())]
        order = rows[np.argsort(key, kind="stable")]
        half = len(order) // 2
        return (top, least, most, None, (self._build(order[:half]), self._build(order[half:])), span)

    def pairs(self, percent: int, other: CountTree | None = None) -> Iterator[tuple]:
        """Arrays (i, j) of all pairs of different components whose summed minima suffice.

        Without ``other``, i < j in no order; else i is a row of this tree and j one of the other.
        """
        np, right_ = self.np, other or self
        stack = [(self.root, right_.root)]
        while stack:
            a, b = stack.pop()
            if a[5] == b[5] and a[5][0] == a[5][1]:
                continue  # all of one component
            most = min(int(np.minimum(a[0], b[0]).sum()), a[2], b[2])
            if not _enough(most, a[1], b[1], percent):
                continue
            if a[4] is None and b[4] is None:
                shared = np.minimum(self.points[a[3]][:, None, :], right_.points[b[3]][None, :, :]).sum(2)
                good = _enough(shared, self.sizes[a[3]][:, None], right_.sizes[b[3]][None, :], percent)
                good &= self.comp[a[3]][:, None] != right_.comp[b[3]][None, :]
                i, j = np.nonzero(good)
                i, j = a[3][i], b[3][j]
                if a is b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    shared = np.minimum(self.fine[i], right_.fine[j]).sum(1)
                    good = _enough(shared, self.sizes[i], right_.sizes[j], percent)
                    i, j = i[good], j[good]
                if len(i):
                    yield i, j
            elif a is b:
                left, right = a[4]
                stack += [(left, left), (left, right), (right, right)]
            elif b[4] is None or (a[4] is not None and a[2] >= b[2]):
                stack += [(x, b) for x in a[4]]
            else:
                stack += [(a, x) for x in b[4]]


def _first_met(bucket: int, early, i, j):
    """Whether no bucket before this one is in both lists; ``early`` has a sorted row for each class."""
    import numpy as np

    out = np.ones(len(i), bool)
    for at in range(0, len(i), 8192):
        x, y = early[i[at : at + 8192]], early[j[at : at + 8192]]
        out[at : at + 8192] = ~((x[:, :, None] == y[:, None, :]) & (x < bucket)[:, :, None]).any((1, 2))
    return out


def _close(percent: int, bucket: int, side, ids, comp, n, vec, early) -> Iterator[tuple]:
    """Arrays (x, y) of the ids of pairs: within one block, or, where ``side`` has both 0 and 1, between two."""
    import numpy as np

    points = [unpacked(v) for v in vec]
    groups = np.array([len(p) for p in points])
    first = np.full((len(ids), EARLY), np.iinfo("i8").max)
    for k, buckets in enumerate(early):
        first[k, : len(buckets)] = buckets
    tree = lambda rows, width: CountTree(np.stack([folded(points[k], width) for k in rows]), n[rows], comp[rows])

    def listed(i, j):
        new = _first_met(bucket, first, i, j)
        return ids[i[new]], ids[j[new]]

    if side.any():
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(one) and len(two):
            width = int(groups.min())
            for i, j in tree(one, width).pairs(percent, tree(two, width)):
                yield listed(one[i], two[j])
        return
    for width in np.unique(groups).tolist():
        # Partners have as many groups, or twice as many: their sizes differ by less than a factor of two.
        rows = np.flatnonzero((groups == width) | (groups == 2 * width))
        if len(rows) < 2:
            continue
        for i, j in tree(rows, width).pairs(percent):
            i, j = rows[i], rows[j]
            own = np.minimum(groups[i], groups[j]) == width
            yield listed(i[own], j[own])


def _tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components by trees, for each task (bucket, a, b); rows (bucket, a, b, side, id, comp, n, vec, early)."""

    def found(batches):
        import numpy as np
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()

        def batch_of(pairs):
            columns = list(zip(*pairs)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])

        def starts(table):
            """Where tasks begin."""
            keys = [table.column(k).to_numpy() for k in ("bucket", "a", "b")]
            return [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], 0)) + 1).tolist()]

        def emitted(table):
            ids, comp, n, side, bucket = (table.column(k).to_numpy() for k in ("id", "comp", "n", "side", "bucket"))
            vec, early, out = table.column("vec"), table.column("early"), []
            cuts = [*starts(table), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                if e - s < 2:
                    continue
                held = [c[s:e] for c in (side, ids, comp, n)] + [c.slice(s, e - s).to_pylist() for c in (vec, early)]
                for x, y in _close(percent, int(bucket[s]), *held):
                    for pair in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()):
                        if pair not in seen:
                            seen.add(pair)
                            out.append(pair)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    if len(out) >= PAIRS_IN_BATCH:
                        yield batch_of(out)
                        out = []
            yield batch_of(out)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = starts(held)[-1]
            if last:  # else one task so far: wait for its end
                yield from emitted(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from emitted(held)

    dealt = rows.select("bucket", "a", "b", "side", "id", "comp", "n", "vec", "early")
    dealt = dealt.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return dealt.mapInArrow(found, "a long, b long").distinct()


def _boxes(blocks: DataFrame) -> DataFrame:
    """A row for each (bucket, block): its groups, the range of its components and sizes, and the largest count of each group."""

    def boxed(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        top = np.max([unpacked(v) for v in table.column("vec").to_pylist()], 0)
        first = lambda k: table.column(k)[0].as_py()
        row = {"bucket": first("bucket"), "block": first("block"), "groups": first("groups")}
        for k, (low, high) in {"comp": ("lo", "hi"), "n": ("least", "most")}.items():
            row[low], row[high] = pc.min_max(table.column(k)).as_py().values()
        return pa.Table.from_pylist([{**row, "box": packed(top)}])

    schema = "bucket long, block long, groups long, lo long, hi long, least long, most long, box binary"
    rows = blocks.select("bucket", "block", "groups", "comp", "n", "vec")
    return rows.groupBy("bucket", "block").applyInArrow(boxed, schema)


def _block_pairs(boxes: DataFrame, percent: int) -> DataFrame:
    """(bucket, a, b), a <= b: blocks that may hold a pair of different components that share enough."""
    side = lambda x: boxes.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in boxes.columns[1:]])

    def kept(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            least = []
            for x, y in zip(batch.column("box_a").to_pylist(), batch.column("box_b").to_pylist()):
                x, y = unpacked(x), unpacked(y)
                groups = min(len(x), len(y))
                # Folded boxes hold folded points.
                least.append(int(np.minimum(folded(x, groups), folded(y, groups)).sum()))
            n_a, n_b, most_a, most_b = (batch.column(k).to_numpy() for k in ("least_a", "least_b", "most_a", "most_b"))
            good = pa.array(_enough(np.minimum(np.array(least, "i8"), np.minimum(most_a, most_b)), n_a, n_b, percent))
            columns = [batch.column(k).filter(good) for k in ("bucket", "block_a", "block_b")]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "a", "b"])

    near = (
        "block_a <= block_b and not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b) and groups_a <= 2 * groups_b and groups_b <= 2 * groups_a"
        f" and 100 * most_a >= {percent} * least_b and 100 * most_b >= {percent} * least_a"
    )
    return side("a").join(side("b"), "bucket").where(near).mapInArrow(kept, "bucket long, a long, b long")


def _dealt(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The rows of ``_tree_pairs`` for (bucket, id, comp, n, groups): a small bucket is one task, a large one goes by pairs of blocks."""
    cells = F.count("*") * F.max("groups")
    sizes = members.groupBy("bucket").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), ((F.count("*") > BLOCK_ROWS) | (cells > BLOCK_CELLS)).alias("large")
    )
    open_ = members.join(sizes.where("lo < hi").select("bucket", "large"), "bucket")
    # In a small bucket only those stay that another component's set of a like size is in; large ones see to sizes by blocks.
    like = math.log(100 / percent) + 1e-9
    near = f"over (partition by bucket order by ln(n) range between {like} preceding and {like} following)"
    small = open_.where("not large").selectExpr("*", f"min(comp) {near} < max(comp) {near} as partner").where("partner").drop("partner")
    open_ = stored(small.union(open_.where("large")), "open")
    # A class is in no more buckets than its prefix has shingles.
    early = open_.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("bucket")), 1, EARLY).alias("early"))
    points = stored(points.select("id", "vec").join(early, "id"), "open-points")
    small = open_.where("not large").join(points, "id").selectExpr(
        "bucket", "-1L as a", "-1L as b", "0 as side", "id", "comp", "n", "vec", "early"
    )
    large = open_.where("large")
    if large.isEmpty():
        return small
    # Places are numbered over all buckets: a block ends with its bucket, its width, or at a round number.
    placed = ranked(large.drop("large"), F.col("bucket"), F.col("groups"), F.col("comp"), F.col("n"), F.col("id"), name="place")
    held = f"least({BLOCK_ROWS}, greatest(1, {BLOCK_CELLS} div groups))"
    # Numbers of blocks of one bucket differ by width as well.
    placed = placed.withColumn("block", F.expr(f"(place div {held}) * {MAX_BITS + 1} + cast(round(log2(groups)) as long)"))
    blocks = stored(placed.join(points, "id").drop("place"), "blocks")
    pairs = stored(_block_pairs(stored(_boxes(blocks), "boxes"), percent), "block-pairs")
    sides = pairs.selectExpr("bucket", "a as block", "a", "b", "0 as side").union(
        pairs.where("a < b").selectExpr("bucket", "b as block", "a", "b", "1 as side")
    )
    return small.union(blocks.join(sides, ["bucket", "block"]).select(*small.columns))


def _stars(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): each class b that shares a bucket with another component, and one leader a of such a bucket."""
    held = members.join(labels.select("id", "comp"), "id")
    leads = held.groupBy("bucket").agg(F.min(F.struct("comp", "id")).alias("lead"), F.max("comp").alias("hi")).where("lead.comp < hi")
    others = held.join(leads, "bucket").where("comp <> lead.comp")
    return others.groupBy(F.col("id").alias("b")).agg(F.min("lead.id").alias("a")).select("a", "b")


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by Jaccard of min_percent or more, in components."""
    return named_rows(docs, **settings).drop("text_md5")


def named_rows(
    docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, min_percent: int = MIN_PERCENT, frequent: int = FREQUENT
) -> DataFrame:
    """The rows of ``near_duplicates`` with their texts' digests, text_md5."""
    # All steps in Python are stored before this returns.
    with at_most(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS):
        return _named_rows(docs, shingle_words, min_percent, frequent)


def _named_rows(docs: DataFrame, shingle_words: int, min_percent: int, frequent: int) -> DataFrame:
    import numpy as np

    signed = stored(_signatures(docs, shingle_words), "signatures")
    often = signed.where("hash is not null").groupBy("hash").agg(F.sum("count").alias("n"))
    last = often.orderBy(F.desc("n"), "hash").limit(frequent).toArrow()
    hashes, times = last.column("hash").to_numpy().astype("i8").view("u8"), last.column("n").to_numpy().astype("i8")
    order = np.argsort(hashes)
    sigs = signed.where("hash is null")
    # Copies of one set meet as one row for each task.
    rep = F.min(F.struct("doc_id", "c", "n", "vec")).alias("rep")
    named = sigs.where("n > 0 and doc_id is not null").groupBy("digest").agg(rep)
    classes = stored(named.select("digest", F.col("rep.doc_id").alias("id"), "rep.c", "rep.n", "rep.vec"), "classes")
    # Texts that share a passage share many shingles: buckets with the same classes become one.
    of_shingle = "over (partition by shingle)"
    same = f"xxhash64(bit_xor(xxhash64(c)) {of_shingle}, sum(c & 2147483647) {of_shingle}, count(*) {of_shingle})"
    shared = (
        _postings(docs, shingle_words, min_percent, hashes[order], times[order])
        .selectExpr("c", f"min(c) {of_shingle} as least", f"max(c) {of_shingle} as last", f"{same} as bucket")
        .where("least < last")
        .select("bucket", "c")
        .distinct()
    )
    points = classes.select("id", "n", "vec")
    members = stored(shared.join(classes.select("c", "id"), "c").select("bucket", "id"), "buckets")

    labels, links = points.select("id", F.col("id").alias("comp")), None
    for _ in range(STAR_ROUNDS):
        found = stored(_verified(_bounded(_stars(members, labels), points, min_percent), docs, shingle_words, min_percent), "links")
        links = found if links is None else links.union(found)
        joined = components(links)
        labels = stored(points.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("comp")), "labels")

    # Pairs of components that meet in a bucket.
    long = F.octet_length("vec")
    groups = F.when(long % 2 == 1, long - 1).otherwise(long / 4)
    sized = labels.join(points.select("id", "n", groups.cast("long").alias("groups")), "id")
    rows = _dealt(members.join(sized, "id"), points, min_percent)
    more = _verified(_tree_pairs(rows, min_percent), docs, shingle_words, min_percent)
    final = components(links.union(more))

    named = classes.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("comp"))
    return sigs.join(named, "digest", "left").select(
        "doc_id", "text_md5", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """One row of each component, of the document with the least id, with all its columns.

    Of several rows of that document the one with the least digest of its text
    stays, and of equal ones one. Rows without an id are no document's: one of each text
    stays unless a document has a set like it.
    """
    named = named_rows(docs, **settings)
    none = F.col("doc_id").isNull()
    chosen = named.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # A row of short values for each document; those that stand for several rows are told apart.
    chosen = stored(
        chosen.groupBy("doc_id", F.when(none, F.col("text_md5")).alias("of_none"))
        .agg(F.min("text_md5").alias("text_md5"), F.count("*").alias("rows"))
        .drop("of_none"),
        "chosen",
    )
    doc = F.col("doc")
    same = doc["doc_id"].cast("long").eqNullSafe(F.col("doc_id")) & (F.md5(F.coalesce(doc["text"], F.lit(""))) == F.col("text_md5"))
    single = held(docs).join(chosen.where("rows = 1"), same, "left_semi")
    several = held(docs).join(chosen.where("rows > 1"), same)
    mark = F.xxhash64(F.to_json("doc"))
    several = several.groupBy("doc_id", "text_md5").agg(F.min_by("doc", mark).alias("doc")).select("doc")
    return single.union(several).select(*released(docs))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
