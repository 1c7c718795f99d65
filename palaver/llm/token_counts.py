"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both agree.

A text beyond the chunk length is encoded in chunks that overlap. Two
neighbours are joined at a position in their overlap where a pre-token begins in
both. That place is proven, not likely: the splitting pattern reads from left to
right and never looks back, so

* the left chunk splits exactly as the whole text up to any boundary that lies
  ``margin`` characters before its end and is followed by another boundary
  (its truncated end is then out of reach of the pattern's look-ahead and of any
  special string), and
* from a boundary of the whole text on, the right chunk splits exactly as the
  whole text, if it has that boundary too and no special string is cut by its start.

If the overlap holds no such place (one run of letters without a break, say) it
is doubled, in the end over the whole rest of the text.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
give repeated results; other columns are kept only if asked for by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.tokens import tokenizer

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 65536
OVERLAP_CHARS = 1024
BATCH_CHARS = 1 << 20
LIMIT = 512


def _boundaries(encoding, start: int) -> dict[int, int]:
    """Pre-token starts of a chunk: position in the text -> number of the token that begins there."""
    found, last = {}, None
    words, offsets = encoding.word_ids, encoding.offsets
    for k, word in enumerate(words):
        if word is None or word != last:
            found[start + offsets[k][0]] = k
        last = word
    return found


def _specials(tok) -> int:
    return max([len(t.content) for t in tok.get_added_tokens_decoder().values()], default=0)


def count_huge(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of one text, by overlapping chunks."""
    n, margin = len(text), _specials(tok) + 2
    overlap = max(overlap, 4 * margin)
    step = max(chunk - overlap, overlap)
    total, at, first = 0, 0, 0  # tokens before the current chunk's token ``first``; the chunk begins at ``at``
    end = min(n, at + step + overlap)
    left = tok.encode(text[at:end], add_special_tokens=False)
    while end < n:
        wide = overlap
        while True:
            begin = end - wide
            if begin <= at:  # the overlap covers the whole left chunk: longer chunks
                end = min(n, end + max(wide, step))
                left = tok.encode(text[at:end], add_special_tokens=False)
                if end == n:
                    break
                begin = end - wide
            right_end = min(n, begin + step + wide)
            right = tok.encode(text[begin:right_end], add_special_tokens=False)
            a, b = _boundaries(left, at), _boundaries(right, begin)
            ordered = sorted(a)
            # The last boundary of the left chunk may come from its cut end.
            common = [
                p
                for p, after in zip(ordered, ordered[1:])
                if p in b and p >= begin + margin and after <= end - margin and a[p] >= first
            ]
            if common:
                p = common[len(common) // 2]
                total += a[p] - first
                at, first, end, left = begin, b[p], right_end, right
                break
            wide *= 2
        if end == n:
            break
    return total + len(left.ids) - first


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_texts(tok, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Tokens of each text; those of one chunk are encoded as they are."""
    counts = [0] * len(texts)
    short = [k for k, t in enumerate(texts) if 0 < len(t) <= chunk]
    at = 0
    for batch in _batches([texts[k] for k in short]):
        for encoding in tok.encode_batch_fast(batch, add_special_tokens=False):
            counts[short[at]] = len(encoding)
            at += 1
    for k, t in enumerate(texts):
        if len(t) > chunk:
            counts[k] = count_huge(tok, t, chunk, overlap)
    return counts


def token_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Bytes and tokens of every text: id, n_bytes, n_tokens, over_limit. No shuffle."""

    def counted(batches):
        import pyarrow as pa

        tok = tokenizer(vocabulary)
        for batch in batches:
            counts = count_texts(tok, batch.column(1).to_pylist(), chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
