"""Toxicity by subword bags: character n-gram embeddings, averaged, under a linear softmax.

A word is the bag of its character n-grams and itself, hashed to rows of an
embedding table; a passage of a few dozen words is the average of its words'
bags, and a linear softmax over the average gives its score. Table and softmax are
trained together, in numpy. A text scores as its worst passage does, so a few bad
words count alike in short and in very long texts. A misspelt word shares most of
its n-grams with the word that was meant.

Once trained, the softmax of an average is a sum of one number for each n-gram, so
tasks get that vector alone and remember numbers of words.

Training reads a bounded sample: of each label at most ``per_label`` texts of at
most ``max_train_chars`` characters, chosen by a hash of the id. It is the only
thing sampled; every whole text is scored, and only the text is looked at.

Defined cases: null and empty texts score as a passage without words (the
prior); labels that are null or stand for no document are left out; with one kind
of label alone, every text scores as that prior; rows that repeat score alike; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_BITS = 17
DIM = 8
NGRAMS = (3, 5)
PASSAGE_WORDS = 24
SHARPEST = 4.0
RATES = (0.02, 0.05, 0.1)
STEPS = 150
MIN_TEXTS = 4
PER_LABEL = 4_000
MAX_TRAIN_CHARS = 40_000
CHARS_PER_LABEL = 12_000_000
KNOWN_WORDS = 300_000
HELD_OUT_OF = 5

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Rows of a word's n-grams, its ends marked, and of the word itself."""
    marked, mask = f"<{word}>", (1 << BUCKET_BITS) - 1
    grams = [marked[k : k + n] for n in range(NGRAMS[0], NGRAMS[1] + 1) for k in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) & mask for g in [*grams, marked]]


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 1):
    """(bias, number for each n-gram row): the log-odds of a passage are the bias plus the mean of its words' numbers."""
    import numpy as np

    rng, rows = np.random.default_rng(seed), 1 << BUCKET_BITS
    vocabulary: dict[str, int] = {}
    tokens, passages, owners = [], [], []
    for k, text in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        for at in range(0, len(ids), PASSAGE_WORDS):
            part = ids[at : at + PASSAGE_WORDS]
            passages.append(len(part))
            owners.append(k)
            tokens.extend(part)
    y = np.array(labels, "f8")
    prior = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    if not tokens or y.min() == y.max():
        return float(np.log(prior / (1 - prior))), np.zeros(rows, "f4")
    grams = [subwords(w) for w in vocabulary]
    sizes = np.array([len(g) for g in grams])
    flat = np.array([x for g in grams for x in g], "i4")
    word_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    tokens, lengths, owners = np.array(tokens, "i4"), np.array(passages), np.array(owners)
    passage_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    passage_of = np.repeat(np.arange(len(lengths)), lengths)
    text_at = np.flatnonzero(np.diff(owners, prepend=-1))
    here = owners[text_at]  # texts that have words
    # Rows that few texts reach stay out: they would learn texts by heart.
    texts_of = np.bincount(np.unique(owners[passage_of].astype("i8") * len(sizes) + tokens) % len(sizes), minlength=len(sizes))
    known = np.bincount(flat, np.repeat(texts_of, sizes), rows) >= MIN_TEXTS

    table = ((rng.random((rows, DIM), dtype="f4") - 0.5) / DIM) * known[:, None]
    softmax = (rng.random(DIM) - 0.5).astype("f4")  # of two classes only the difference matters
    per_text = np.diff(np.append(text_at, len(lengths)))
    bias, moments = 0.0, None
    for step in range(1, steps + 1):
        number = table @ softmax
        word = np.add.reduceat(number[flat], word_at) / sizes
        logit = np.add.reduceat(word[tokens], passage_at) / lengths
        # From the average of all passages, step by step, to the worst one.
        sharp = SHARPEST * max(0.0, 2 * step / steps - 0.5)
        pull = np.exp(sharp * (logit - np.repeat(np.maximum.reduceat(logit, text_at), per_text)))
        pull /= np.repeat(np.add.reduceat(pull, text_at), per_text)
        pooled = np.add.reduceat(pull * logit, text_at)
        error = (1 / (1 + np.exp(-(pooled + bias))) - y[here]) / len(here)
        share = np.repeat(error, per_text) * pull
        to_word = np.bincount(tokens, (share / lengths)[passage_of], len(sizes)) / sizes
        to_row = np.bincount(flat, np.repeat(to_word, sizes), rows).astype("f4") * known
        slopes = [np.outer(to_row, softmax), to_row @ table, np.array([error.sum()])]
        values = [table, softmax, np.array([bias])]
        moments = moments or [[np.zeros_like(x), 0.0] for x in slopes]
        # Momentum, scaled by each array's mean square: rows keep their proportions, so noise stays small beside signal.
        for held, slope, value, rate in zip(moments, slopes, values, RATES):
            held[0] += 0.1 * (slope - held[0])
            held[1] += 0.02 * (float(np.mean(slope * slope)) - held[1])
            value -= rate * (held[0] / (1 - 0.9**step)) / (np.sqrt(held[1] / (1 - 0.98**step)) + 1e-30)
        bias = float(values[2][0])
    return bias, (table @ softmax).astype("f4")


class Scorer:
    """Scores of texts; numbers of words are remembered, up to a bound."""

    def __init__(self, bias: float, numbers):
        import numpy as np

        self.np, self.bias, self.numbers = np, bias, numbers.tolist()
        self.known: dict[str, float] = {}

    def __call__(self, text: str | None) -> float:
        np, known = self.np, self.known
        words = words_of(text)
        worst = 0.0
        if words:
            try:
                found = [known[w] for w in words]
            except KeyError:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        rows = subwords(w)
                        known[w] = sum(map(self.numbers.__getitem__, rows)) / len(rows)
                found = [known[w] for w in words]
            at = np.arange(0, len(found), PASSAGE_WORDS)
            lengths = np.diff(np.append(at, len(found)))
            worst = float((np.add.reduceat(np.array(found), at) / lengths).max())
        return float(1 / (1 + np.exp(-np.clip(worst + self.bias, -50, 50))))


def held_out(doc_id: Column, of: int = HELD_OUT_OF) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = PER_LABEL,
    max_train_chars: int = MAX_TRAIN_CHARS,
    chars_per_label: int = CHARS_PER_LABEL,
) -> tuple[float, bytes]:
    """Train in one task on the bounded sample; the model is a bias and 2^17 numbers.

    A document counts as toxic if any of its labels says so; of several texts with
    its id the one with the least md5 is learnt from. So the sample, and the model, do not
    hang on the order or the partitions in which rows arrive.
    """
    learnt = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    learnt = learnt.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    # Ids are chosen first, so that only the sample's texts travel.
    short = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= max_train_chars)).select("doc_id")
    chosen = [
        learnt.where(F.col("toxic") == k).join(short, "doc_id", "left_semi").orderBy(order, "doc_id").limit(per_label)
        for k in (0, 1)
    ]
    texts = docs.where(F.char_length("text") <= max_train_chars).select("doc_id", "text")
    sample = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # 2 * per_label rows
    # Repeats fold before they travel; the first of a label's texts, in the order of the choice, fill its share.
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.md5("text")).alias("text"))
    held = F.sum(F.char_length("text")).over(W.partitionBy("toxic").orderBy(order, "doc_id"))
    sample = sample.withColumn("held", held).where(F.col("held") <= chars_per_label).drop("held")

    def trained(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("doc_id")
        bias, numbers = train(frame["text"].tolist(), frame["toxic"].tolist())
        return pd.DataFrame({"bias": [bias], "numbers": [np.asarray(numbers, "<f4").tobytes()]})

    model = sample.groupBy(F.lit(0).alias("all")).applyInPandas(trained, "bias double, numbers binary").collect()
    return (model[0]["bias"], bytes(model[0]["numbers"])) if model else (0.0, bytes(4 << BUCKET_BITS))


def score(docs: DataFrame, model: tuple[float, bytes]) -> DataFrame:
    """doc_id, held_out, score, predicted. No shuffle."""
    spark = docs.sparkSession
    numbers = spark.sparkContext.broadcast(model[1])  # half a MB, whatever the data
    bias = model[0]

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(bias, np.frombuffer(numbers.value, "<f4"))
        for batch in batches:
            scores = [scorer(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
