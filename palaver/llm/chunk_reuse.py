"""BPE encoding and decoding of whole texts, with the ids of chunks that texts share computed once.

Texts are cut where a rolling hash of the last characters says so, so equal
passages are cut alike wherever they stand. Chunks are encoded by themselves:

* those that occur once, in the task that reads their text;
* those that texts share, once for all: their text goes to one task by digest, and
  their ids from there to the texts;
* those with more than one in ``HOT_SHARE`` of all occurrences (no more than
  ``HOT_SHARE`` can be) once in each task that meets them, so no key of the shuffles is heavy.

Then the joins are repaired. Around each cut a window is encoded anew, from a
pre-token start of the left chunk to behind one of the right chunk; where window
and right chunk have a start in common, the window's ids take over from the left
chunk's and hand over to the right chunk's. Without such a place the window is widened, in
the end to both chunks and those that follow. Agreement is exact, not likely:

* the splitting pattern reads from left to right and never looks back, so a split
  depends on where it began and on the text up to its end;
* a start counts only on an ASCII character, in front of which no normal form
  reaches, and at a distance from cuts that no special string bridges.

For vocabularies that drop blanks and split at them (this is checked) only starts
behind blanks are used, and a worker remembers the ids of words; all others go
through the library's own starts and offsets.

Decoding joins the ids' entries of the vocabulary, as the library does for
vocabularies without a decoder; it is called itself for others.

Defined cases: null and empty texts have no ids and decode to ''; special strings
in texts become their ids, as by the library's default; repeated rows give
repeated results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b, sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import stored, table
from palaver.llm.tokens import WordIds, splits_at_blanks, tokenizer, worker_cache

VOCABULARY = "word_bpe_49k.json"
#: Chunk lengths in characters: a cut every 2^CUT_BITS characters on average, after the first MIN_CHARS.
MIN_CHARS, CUT_BITS, MAX_CHARS = 256, 9, 8192
ROLLING = 32
HOT_SHARE = 65_536
#: Bits that say which chunks occur more than once; a bit set by chance only sends a chunk the longer way.
SHARED_BITS = 25
#: Starts kept with a chunk that travels, at each end.
MARKS = 12
REACH = 64
CACHE_WORDS = 1_000_000
BATCH_CHARS = 1 << 20
_ODD = 0x9E3779B97F4A7C15


class Chunker:
    """Cuts of a text by a rolling hash of its last ``ROLLING`` characters."""

    def __init__(self, least: int = MIN_CHARS, bits: int = CUT_BITS, most: int = MAX_CHARS):
        import numpy as np

        self.np, self.least, self.bits, self.most = np, least, bits, most
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(x: int):
            out = self.np.full(n + 1, x, "u8")
            out[0] = 1
            return self.np.multiply.accumulate(out)

        self.powers, self.inverses = powers(_ODD), powers(pow(_ODD, -1, 1 << 64))

    def __call__(self, text: str) -> list[int]:
        """Chunk ends, the last one the text's."""
        np, n = self.np, len(text)
        if n <= max(self.least, ROLLING):
            return [n] if n else []
        if n >= len(self.powers):
            self._grow(2 * n)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")
        sums = np.zeros(n + 1, "u8")
        np.cumsum((code + np.uint64(1)) * self.powers[:n], out=sums[1:])
        rolled = (sums[ROLLING:] - sums[:-ROLLING]) * self.inverses[: n - ROLLING + 1]
        rolled ^= rolled >> np.uint64(32)
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        ends, last = [], 0
        for at in (np.flatnonzero(rolled >> np.uint64(64 - self.bits) == 0) + ROLLING).tolist():
            while at - last > self.most:
                last += self.most
                ends.append(last)
            if at - last >= self.least:
                ends.append(at)
                last = at
        while n - last > self.most:
            last += self.most
            ends.append(last)
        if last < n:
            ends.append(n)
        return ends


def digest(chunk: str) -> bytes:
    return blake2b(chunk.encode(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


class Piece:
    """Ids (an array) of a part of a text encoded by itself, and its outer pre-token starts: (place in the part, number of the token)."""

    __slots__ = ("ids", "starts", "length")

    def __init__(self, ids, starts: list[tuple[int, int]], length: int):
        self.ids, self.length = ids, length
        self.starts = starts if len(starts) <= 2 * MARKS else starts[:MARKS] + starts[-MARKS:]


def _array(ids: list[int]):
    import numpy as np

    return np.array(ids, "<u4")


class Library:
    """Pieces by the tokenizer library, whatever the vocabulary."""

    def __init__(self, tok, margin: int):
        self.tok, self.margin = tok, margin

    def one(self, text: str) -> Piece:
        return self._piece(self.tok.encode(text, add_special_tokens=False), len(text))

    def many(self, texts: list[str]) -> list[Piece]:
        encodings = self.tok.encode_batch(texts, add_special_tokens=False)
        return [self._piece(e, len(t)) for e, t in zip(encodings, texts)]

    def _piece(self, encoding, length: int) -> Piece:
        return Piece(_array(encoding.ids), self._starts(encoding), length)

    def _starts(self, encoding) -> list[tuple[int, int]]:
        starts, last, offsets = [], None, encoding.offsets
        for k, word in enumerate(encoding.word_ids):
            if word is None or word != last:
                starts.append((offsets[k][0], k))
            last = word
        return starts

    def window(self, text: str, place: int, known: dict[int, int], right: Piece, cut: int, end: int):
        """(ids, number of them to use, common start) of the text from ``place`` to a start in ``known``, or None."""
        reach, last = max(REACH, 2 * self.margin), max(known)
        while True:
            stop = min(cut + reach, len(text))
            encoding = self.tok.encode(text[place:stop], add_special_tokens=False)
            limit = stop if stop == len(text) else stop - self.margin - 1
            for at, k in self._starts(encoding):
                if place + at in known and place + at <= limit:
                    return _array(encoding.ids), k, place + at
            if limit >= last or stop >= end:
                return None
            reach *= 2


class Words:
    """Pieces by words between blanks, for vocabularies that split there.

    Encoded words are remembered in two generations: when the younger one is full it
    becomes the older one, and words still in use are taken over from there.
    """

    def __init__(self, tok, known: dict[str, dict[str, bytes]], size: int = CACHE_WORDS):
        self.ids, self.size, self.known = WordIds(tok), size, known
        known.setdefault("young", {})
        known.setdefault("old", {})

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        young, old = self.known["young"], self.known["old"]
        missing = words.difference(young)
        if 2 * (len(young) + len(missing)) > self.size:
            young, old = {}, young
            self.known.update(young=young, old=old)
            missing = words
        if not missing:
            return young
        fresh = []
        for w in missing:
            held = old.get(w)
            if held is None:
                fresh.append(w)
            else:
                young[w] = held
        for w, ids in zip(fresh, self.ids(fresh)):
            young[w] = struct.pack(f"<{len(ids)}I", *ids)
        return young

    def many(self, texts: list[str]) -> list[Piece]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self._learn(set().union(*split))
        return [self._piece(words, known, len(t)) for words, t in zip(split, texts)]

    def one(self, text: str) -> Piece:
        return self.many([text])[0]

    def _piece(self, words: list[str], known: dict[str, bytes], length: int) -> Piece:
        import numpy as np

        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
        tail, place, token = [], length + 1, len(ids)
        for w in reversed(words[2 * MARKS :][-MARKS:]):
            tokens = len(known[w]) // 4
            place, token = place - len(w) - 1, token - tokens
            if tokens:
                tail.append((place, token))
        starts, place, token = [], 0, 0
        for w in words[: 2 * MARKS]:
            tokens = len(known[w]) // 4
            if tokens:
                starts.append((place, token))
                if len(starts) == len(tail) == MARKS:
                    break  # all that are kept
            place, token = place + len(w) + 1, token + tokens
        return Piece(ids, starts + tail[::-1], length)

    def window(self, text: str, place: int, known: dict[int, int], right: Piece, cut: int, end: int):
        """As of ``Library``; the window ends where a word begins, and what follows the common start must be the right chunk's ids."""
        places = sorted(known)
        for start, stop in zip(places, [*places[1:], None]):
            token, upto = known[start], known.get(stop, len(right.ids))
            if stop is None and end < len(text):
                return None  # what follows may be cut
            ids = self.one(text[place:stop]).ids
            k = len(ids) - (upto - token)
            if k >= 0 and (ids[k:] == right.ids[token:upto]).all():
                return ids, k, start
        return None


class Joiner:
    """The ids of a whole text from its chunks'."""

    def __init__(self, tok, known: dict | None = None, by_words: bool | None = None):
        self.tok = tok
        self.margin = max([len(t.content) for t in tok.get_added_tokens_decoder().values()], default=0)
        words = splits_at_blanks(tok) if by_words is None else by_words
        self.pieces = Words(tok, {} if known is None else known) if words else Library(tok, self.margin)

    def __call__(self, text: str, ends: list[int], pieces: list[Piece]) -> list[int]:
        """``pieces`` are the chunks of ``text`` that end at ``ends``, each encoded by itself."""
        if not ends:
            return []
        import numpy as np

        out = []
        held, begin = pieces[0], 0
        # Ids of the text before ``origin`` are in ``out``; ``origin`` is a true start and token ``first`` of ``held`` begins there.
        origin, first, k = 0, 0, 1
        while k < len(pieces):
            cut = ends[k - 1]
            place, token = self._last_start(text, held, begin, cut, origin, first)
            right = pieces[k]
            known = {cut + p: t for p, t in right.starts if p >= max(self.margin, 1) and text[cut + p].isascii()}
            found = self.pieces.window(text, place, known, right, cut, ends[k]) if known else None
            out.append(held.ids[first:token])
            if found:
                window, upto, start = found
                out.append(window[:upto])
                held, begin, origin, first = right, cut, start, known[start]
                k += 1
                continue
            # No common start in the right chunk: encode from the last true start on, twice as far each time.
            goal = cut + max(ends[k] - cut, cut - place)
            while k < len(pieces) and ends[k - 1] < goal:
                k += 1
            held, begin, origin, first = self.pieces.one(text[place : ends[k - 1]]), place, place, 0
        return np.concatenate([*out, held.ids[first:]]).tolist()

    def _last_start(self, text, held, begin, cut, origin, first):
        """The last true start in front of ``cut`` that no special string bridges; at worst ``origin``."""
        for place, token in reversed(held.starts):
            at = begin + place
            if token <= first:
                break
            if at <= cut - self.margin and text[at].isascii():
                return at, token
        return origin, first


class Digests:
    """Token number and digests of ids and of the decoded text."""

    def __init__(self, tok):
        self.tok = tok
        self.plain = tok.decoder is None
        n = tok.get_vocab_size(with_added_tokens=True)
        self.words = [tok.id_to_token(k) or "" for k in range(n)] if self.plain else []
        self.numbers = [str(k) for k in range(n)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.words[k] for k in ids]) if self.plain else self.tok.decode(ids, skip_special_tokens=False)

    def __call__(self, ids: list[int]) -> tuple[int, str, str]:
        written = " ".join([self.numbers[k] for k in ids])
        return len(ids), sha256(written.encode()).hexdigest(), sha256(self.decode(ids).encode()).hexdigest()


def _encoded(joiner: Joiner, chunks: dict[bytes, str]) -> dict[bytes, Piece]:
    """Every chunk by itself."""
    return dict(zip(chunks, joiner.pieces.many(list(chunks.values())))) if chunks else {}


def _joiner(vocabulary: str) -> Joiner:
    return Joiner(tokenizer(vocabulary), worker_cache(f"ids of words of {vocabulary}"))


def _slices(batch, column: int) -> Iterator:
    """Parts of an Arrow batch or table with about ``BATCH_CHARS`` bytes of text, a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(int(np.searchsorted(sizes, done + BATCH_CHARS)), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _packed(piece: Piece) -> tuple[bytes, bytes]:
    """Ids and starts as bytes."""
    import numpy as np

    width = "<u2" if piece.ids.max(initial=0) < 1 << 16 else "<u4"
    return width[-1].encode() + piece.ids.astype(width).tobytes(), np.array(piece.starts, "<i4").tobytes()


def _unpacked(ids: bytes, starts: bytes, length: int) -> Piece:
    import numpy as np

    values = np.frombuffer(ids[1:], "<u" + ids[:1].decode())
    return Piece(values.astype("<u4"), [tuple(s) for s in np.frombuffer(starts, "<i4").reshape(-1, 2).tolist()], length)


class Shared:
    """What all tasks know of the chunks: which are hot, and which may occur more than once."""

    def __init__(self, hot: set[int], bits: bytes):
        self.hot, self.bits = hot, bits

    def travels(self, key: bytes) -> bool:
        short = _short(key)
        place = short & ((1 << SHARED_BITS) - 1)
        return bool(self.bits[place >> 3] >> (place & 7) & 1) and short not in self.hot


def _counts(texts: DataFrame, settings: tuple) -> DataFrame:
    """(chunk, n): occurrences of each chunk by the first 64 bits of its digest."""

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        def rows(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["chunk", "n"]
            )

        cuts, counts = Chunker(*settings), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                start = 0
                for end in cuts(text):
                    counts[_short(digest(text[start:end]))] += 1
                    start = end
            if len(counts) > 1_000_000:
                yield rows(counts)
                counts.clear()
        yield rows(counts)

    return texts.mapInArrow(counted, "chunk long, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def _shared(texts: DataFrame, settings: tuple, hot_share: int) -> Shared:
    import numpy as np

    counts = stored(_counts(texts.select("text"), settings), "chunk-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    repeated = counts.where("n > 1")
    # Fewer than hot_share chunks can have such a share.
    hot = {r[0] for r in repeated.where(F.col("n") * hot_share > total).select("chunk").collect()}
    # A fixed number of bits, or-ed by words of 32: 2^20 rows at most.
    place = F.col("chunk").bitwiseAND((1 << SHARED_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(chunk & 31 as int))")
    words = repeated.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (SHARED_BITS - 5), "<u4")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype("<u4")
    return Shared(hot, bits.tobytes())


def _in_place(texts: DataFrame, shared: Shared, vocabulary: str, settings: tuple, kind: str) -> DataFrame:
    """Results of the texts none of whose chunks travels."""

    def finished(batches):
        import pyarrow as pa

        cuts, joiner = Chunker(*settings), _joiner(vocabulary)
        digests = Digests(joiner.tok)
        kept: dict[bytes, Piece] = {}  # hot ones
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            work, chunks = [], {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = cuts(text)
                keys = [digest(text[a:b]) for a, b in zip([0, *ends], ends)]
                if any(shared.travels(k) for k in keys):
                    continue
                work.append((key, text, ends, keys))
                chunks.update({k: text[a:b] for k, a, b in zip(keys, [0, *ends], ends) if k not in kept})
            pieces = _encoded(joiner, chunks)
            kept.update({k: p for k, p in pieces.items() if _short(k) in shared.hot})
            pieces.update(kept)
            out = [(key, *digests(joiner(text, ends, [pieces[k] for k in keys]))) for key, text, ends, keys in work]
            columns = list(zip(*out)) or [[]] * 4
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return texts.mapInArrow(finished, RESULT.format(kind=kind))


RESULT = "id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _travelling(texts: DataFrame, shared: Shared, settings: tuple, kind: str) -> tuple[DataFrame, DataFrame]:
    """(text_key, id, text) of texts with a chunk that travels, and (chunk, text_key, text) of these chunks.

    A text is named by its digest; both texts are null where the task has sent them before.
    """

    def scanned(batches, of_chunks: bool):
        import pyarrow as pa

        cuts, sent = Chunker(*settings), set()

        def once(key, text):
            if key in sent:
                return None
            if len(sent) > 1_000_000:
                sent.clear()
            sent.add(key)
            return text

        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = cuts(text)
                spans = {digest(text[a:b]): (a, b) for a, b in zip([0, *ends], ends)}
                far = [k for k in spans if shared.travels(k)]
                if not far:
                    continue
                name = digest(text)
                if not of_chunks:
                    out.append((name, key, once(name, text)))
                elif once(name, text) is not None:
                    out += [(k, name, once(b"c" + k, text[spans[k][0] : spans[k][1]])) for k in far]
            columns = list(zip(*out)) or [[]] * 3
            second = pa.binary() if of_chunks else batch.schema.field(0).type
            names = ["chunk", "text_key", "text"] if of_chunks else ["text_key", "id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.binary(), second, pa.string()])], names)

    def whole(batches):
        return scanned(batches, False)

    def chunks(batches):
        return scanned(batches, True)

    return (
        texts.mapInArrow(whole, f"text_key binary, id {kind}, text string"),
        texts.mapInArrow(chunks, "chunk binary, text_key binary, text string"),
    )


def _runs(batches, key: str) -> Iterator:
    """Tables of whole runs of one value of ``key`` or several; the batches are sorted by it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table_ = pa.Table.from_batches([batch])
        held = table_ if held is None else pa.concat_tables([held, table_])
        last = held.column(key)[-1]
        open_ = pc.index(held.column(key), last).as_py()
        if open_:
            yield held.slice(0, open_)
            held = held.slice(open_)
    if held is not None:
        yield held


def _encoded_once(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """(text_key, chunk, ids, starts, length): each chunk encoded where its rows meet, for every text that holds it."""

    def encoded(batches):
        import pyarrow as pa

        joiner = _joiner(vocabulary)
        names = ["text_key", "chunk", "ids", "starts", "length"]
        types = [*[pa.binary()] * 4, pa.int64()]
        for part in _runs(batches, "chunk"):
            keys, texts = part.column("chunk").to_pylist(), part.column("text").to_pylist()
            packed, chunks = {}, list({k: t for k, t in zip(keys, texts) if t}.items())
            for at in range(0, len(chunks), 1024):
                found = _encoded(joiner, dict(chunks[at : at + 1024]))
                packed.update({k: (*_packed(p), p.length) for k, p in found.items()})
            owners = part.column("text_key").to_pylist()
            for at in range(0, len(keys), 4096):
                out = [(o, k, *packed[k]) for o, k in zip(owners[at : at + 4096], keys[at : at + 4096])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    dealt = chunks.repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(encoded, "text_key binary, chunk binary, ids binary, starts binary, length long")


def _assembled(texts: DataFrame, encoded: DataFrame, vocabulary: str, settings: tuple, kind: str) -> DataFrame:
    """Results of texts (text_key, id, text) whose travelling chunks are in ``encoded``."""

    def joined(batches):
        import pyarrow as pa

        cuts, joiner = Chunker(*settings), _joiner(vocabulary)
        digests = Digests(joiner.tok)
        for part in _runs(batches, "text_key"):
            known: dict[bytes, dict[bytes, Piece]] = {}
            texts, ids = {}, []
            columns = [part.column(c).to_pylist() for c in ("text_key", "id", "text", "chunk", "ids", "starts", "length")]
            for name, key, text, chunk, data, starts, length in zip(*columns):
                if chunk is not None:
                    known.setdefault(name, {})[chunk] = (data, starts, length)
                    continue
                ids.append((key, name))
                if text is not None:
                    texts[name] = text
            results = {}
            for name, text in texts.items():
                ends, far = cuts(text), known.get(name, {})
                spans = [(digest(text[a:b]), text[a:b]) for a, b in zip([0, *ends], ends)]
                near = _encoded(joiner, {k: t for k, t in spans if k not in far})
                pieces = [near[k] if k in near else _unpacked(*far[k]) for k, _ in spans]
                results[name] = digests(joiner(text, ends, pieces))
            types = [part.schema.field("id").type, pa.int64(), pa.string(), pa.string()]
            out = list(zip(*[(key, *results[name]) for key, name in ids])) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(out, types)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = texts.select("text_key", "id", "text", *[none("binary", c) for c in ("chunk", "ids", "starts")], none("long", "length"))
    more = encoded.select("text_key", none(kind, "id"), none("string", "text"), "chunk", "ids", "starts", "length")
    return rows.union(more).repartition("text_key").sortWithinPartitions("text_key").mapInArrow(joined, RESULT.format(kind=kind))


def encode_decode(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    least: int = MIN_CHARS,
    bits: int = CUT_BITS,
    most: int = MAX_CHARS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text.

    Texts of which every chunk is hot or occurs once are finished where they are
    read; the others, and the chunks that travel, are shuffled once.
    """
    settings, kind = (least, bits, most), docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = _shared(texts, settings, hot_share)
    whole, chunks = _travelling(texts, shared, settings, kind)
    far = _assembled(whole, _encoded_once(chunks, vocabulary), vocabulary, settings, kind)
    return _in_place(texts, shared, vocabulary, settings, kind).union(far).withColumnRenamed("id", id_col)


def op13_chunk_reuse(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"))
