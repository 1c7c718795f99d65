"""Best-fit packing: token sequences of a fixed size, as full as best-fit decreasing makes them.

Texts are encoded whole, closed with a separator id, and cut only if longer than
a sequence. Pieces are dealt to shards of a fixed mean size by a hash; each shard
packs its pieces, longest first, into the tightest open sequence. Which one that
is comes from a segment tree over remaining capacities (one leaf for each
capacity, a node counts the open sequences below it), in logarithmic time for
each piece however many sequences are open. A shard leaves one badly filled
sequence or so behind, a few thousandths of a percent.

Defined cases: null text counts as empty and becomes one piece with the separator
alone; an empty table gives no rows; rows that repeat are packed as often as they
come; ties in length are ordered by id, piece and checksum. Vocabularies that keep
blanks in their tokens are encoded by the library, all others by words.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.tokens import WordIds, splits_at_blanks, tokenizer, worker_cache

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR_ID = 0
SHARD_PIECES = 16384
CACHE_WORDS = 1_000_000

PIECES = "id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>"


class WordEncoder:
    """Ids of whole texts by words between blanks, each encoded once and then remembered.

    For vocabularies that drop white space and split at it, the ids of a text are
    those of its words one after another: no pattern, normalizer or special string
    reaches across a blank. What is remembered is bounded; a full cache starts anew.
    """

    def __init__(self, tok, known: dict[str, bytes] | None = None, size: int = CACHE_WORDS):
        self.ids, self.size, self.known = WordIds(tok), size, {} if known is None else known

    def learn(self, words: set[str]) -> None:
        fresh = list(words.difference(self.known))
        if not fresh:
            return
        if len(self.known) + len(fresh) > self.size:
            self.known.clear()
            fresh = list(words)
        for w, ids in zip(fresh, self.ids(fresh)):
            self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.replace("\n", " ").split(" ")
        self.learn(set(words))
        return b"".join(map(self.known.__getitem__, words))


class LibraryEncoder:
    """Ids of whole texts by the library, for all other vocabularies."""

    def __init__(self, tok, known: dict | None = None):
        self.tok = tok

    def __call__(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Encode every text and cut it: id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        tok = tokenizer(vocabulary)
        by_words = splits_at_blanks(tok)
        encode = (WordEncoder if by_words else LibraryEncoder)(tok, worker_cache(f"words of {vocabulary}"))
        end = struct.pack("<I", separator)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    kept = np.frombuffer(part, "<u4").astype("i4") if keep_ids else None
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), kept))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut_rows = rows.mapInArrow(cut, PIECES.format(kind=docs.schema[id_col].dataType.simpleString()))
    return (cut_rows if keep_ids else cut_rows.drop("ids")).withColumnRenamed("id", id_col)


class CapacityTree:
    """Counts of open bins by remaining capacity; ``tightest(n)`` is the least capacity of n or more."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, by: int) -> None:
        node = self.leaves + remaining
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, need: int) -> int | None:
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:  # up to the first ancestor with a bin to the right
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset for lengths that do not increase. Among equally tight bins the newest is taken."""
    tree, open_bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets, opened = [], [], 0
    for length in lengths:
        room = tree.tightest(length) if length else 0
        if room is None or (length == 0 and not open_bins[0]):
            room, bin_id, opened = capacity, opened, opened + 1
        else:
            bin_id = open_bins[room].pop()
            tree.add(room, -1)
        bins.append(bin_id)
        offsets.append(capacity - room)
        open_bins[room - length].append(bin_id)
        tree.add(room - length, 1)
    return bins, offsets


def pack(
    rows: DataFrame,
    *,
    id_col: str = "doc_id",
    length_col: str = "length",
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Give every row a sequence_id and its offset in there. Lengths must lie within 0 and capacity.

    ``rows`` is read twice (once to count), so store it first if it is costly.
    Columns named sequence_id or offset are replaced. Rows are dealt by what they
    hold and where they are read, so that equal ones spread over the shards too.
    """
    rows = rows.drop("sequence_id", "offset")
    number = "shard"
    while number in rows.columns:
        number += "_"
    shards = max(1, round(rows.count() / shard_pieces))
    tie = [c for c in (id_col, "piece", "ids_crc32") if c in rows.columns]

    def packed(key, frame):
        frame = frame.sort_values([length_col, *tie], ascending=[False, *[True] * len(tie)], kind="stable")
        bins, offsets = best_fit_decreasing(frame[length_col].tolist(), capacity)
        frame["sequence_id"] = [key[0] * (1 << 32) + b for b in bins]
        frame["offset"] = offsets
        return frame.drop(columns=number)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    key = [F.col(f"`{c}`") for c in (tie or rows.columns)]
    shard = F.pmod(F.xxhash64(*key, F.monotonically_increasing_id()), F.lit(shards))
    return (
        rows.withColumn(number, shard.cast("long"))
        .groupBy(number)
        .applyInPandas(packed, f"{fields}, sequence_id long, offset long")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids, one row for each sequence; ``packed`` must hold ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
