"""What keeps tasks small and cheap."""

from palaver.llm import count_vector_join as C
from palaver.llm.best_fit import WordEncoder
from palaver.llm.chunk_reuse import MARKS, Words
from palaver.llm.tokens import WordIds, tokenizer

LATIN = "Éreaué, ñdoez Keitüver. istößtz ÇOUCH eenberü### plain Words, too."


class Counted:
    """A tokenizer that tells which words went through the whole library."""

    def __init__(self, tok):
        self.tok, self.sent = tok, []

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, words, **settings):
        self.sent += words
        return self.tok.encode_batch_fast(words, **settings)


def _ids(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def test_latin_words_go_to_the_model():
    import numpy as np

    tok = Counted(tokenizer("word_bpe_49k.json"))
    assert np.frombuffer(WordEncoder(tok)(LATIN), "<u4").tolist() == _ids(tok, LATIN)
    assert Words(tok, {}).one(LATIN).ids.tolist() == _ids(tok, LATIN)
    assert tok.sent == []
    odd = ["éa", "İa", "ẞa", "aé'", "é's", "é1", "×a", "a÷", "é<|endoftext|>", "", "éa\ta", "日é", "!é"]
    assert WordIds(tok)(odd) == [_ids(tok, w) for w in odd]


def test_starts_of_pieces():
    tok = tokenizer("word_bpe_49k.json")
    for text in ("", " ", "a b", LATIN * 9, "  ".join(LATIN.split() * 5), " " * 40 + LATIN, LATIN + " " * 40, f"{LATIN} " * 3):
        piece, starts, place, token = Words(tok, {}).one(text), [], 0, 0
        words = text.split(" ")
        for k, word in enumerate(words):
            n = len(_ids(tok, word))
            if n and (k < 2 * MARKS or k >= len(words) - MARKS):
                starts.append((place, token))
            place, token = place + len(word) + 1, token + n
        assert piece.ids.tolist() == _ids(tok, text)
        assert piece.starts == (starts if len(starts) <= 2 * MARKS else starts[:MARKS] + starts[-MARKS:])


def test_python_workers_get_few_texts_at_once(spark, monkeypatch):
    key, seen, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", [], C.stored

    def noted(df, label):
        seen.append(int(spark.conf.get(key)))
        return stored(df, label)

    monkeypatch.setattr(C, "stored", noted)
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")], "doc_id long, text string")
    rows = {r.doc_id: r.component_id for r in C.near_duplicates(docs).collect()}
    assert rows == {1: 1, 2: 1, 3: 3}
    assert seen and max(seen) <= C.ARROW_ROWS <= 512
    assert spark.conf.get(key) == before
