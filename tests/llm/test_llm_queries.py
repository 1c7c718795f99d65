"""Queries against their SQL counterparts, and against brute force where SQL has none."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import connect, differences
from palaver.llm.queries import ORACLES, QUERIES
from palaver.llm.tokens import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert differences(spark, duck, name, QUERIES[name], ORACLES[name], SF) is None


def _texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    return {k: t or "" for k, t in rows}


def test_token_counts_equal_the_library(spark):
    tok, texts = tokenizer("byte_bpe_50k.json"), _texts()
    for r in QUERIES["op6_token_counts"](spark, SF).collect():
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_packing_holds_every_token_once(spark):
    tok, texts = tokenizer("word_bpe_49k.json"), _texts()
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    parts, seqs = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(parts) == set(texts)
    for key, own in parts.items():
        ids = [*tok.encode(texts[key], add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            part = ids[r.piece * 2048 : r.piece * 2048 + 2048]
            assert (r.start, r.length) == (r.piece * 2048, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for held in seqs.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(seqs) <= 1.05 * -(-total // 2048) + 1


def test_search_recall_and_scores(spark):
    found = QUERIES["op5_permutation_index"](spark, SF).toPandas()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8")
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = v @ v[ids == q][0]
        own = found[found.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        assert np.allclose(own.score, [scores[ids == x][0] for x in own.vec_id], rtol=1e-12)
        scores[ids == q] = -np.inf
        hits += len(set(own.vec_id) & set(ids[np.lexsort((ids, -scores))[:20]]))
        total += 20
    assert hits / total >= 0.9


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions, on its own input, by plain Python."""
    import corpus_pipeline as c

    from palaver.llm.apportion import mix
    from test_operators import plain_components, plain_line_dedup, plain_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for k, (name, stage) in enumerate(c.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = (before, docs)
        if k < 4:
            assert docs.columns == before.columns
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    before, after = map(text, rows["quality rules"])
    failed = {k for k, t in before.items() if plain_quality(t)["base_failed"]}
    assert failed and not failed & set(after) and len(after) > 0.9 * (len(before) - len(failed))
    before, after = map(text, rows["line dedup"])
    cut = plain_line_dedup(before)
    assert after == {k: t for k, t in cut.items() if t.split() or not before[k].split()}
    before, after = map(text, rows["n-gram Jaccard join"])
    assert set(after) == {k for k, root in plain_components(before).items() if k == root}
    source, mixed = rows["mixing sources"]
    taken = {r.doc_id: r.taken for r in mix(source).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({k: n for k, n in taken.items() if n})
    packed, tok = rows["best-fit packing"][1].collect(), tokenizer("word_bpe_49k.json")
    assert sum(r.length for r in packed) == sum(
        len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect()
    )


def test_toxicity_held_out():
    from palaver.llm.toxicity import Scorer, train

    rows = duckdb.sql(
        "SELECT doc_id, text, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet'"
        " USING (doc_id) ORDER BY doc_id"
    ).fetchall()
    rows = [r for r in rows if len(r[1]) < 3000]
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    held = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 5]
    scorer = Scorer(*train([r[1] for r in learnt], [r[2] for r in learnt]))
    toxic = [scorer(r[1]) for r in held if r[2] == 1]
    clean = [scorer(r[1]) for r in held if r[2] == 0]
    # Probability that a toxic text scores above a clean one.
    assert np.mean([np.mean(np.array(clean) < t) for t in toxic]) > 0.85
    # A misspelling that no label showed is nearer to its word than to others.
    assert scorer("you worthlesss idi0t, disgustingg stupidd scumm") > scorer("you are the and of that with this")
