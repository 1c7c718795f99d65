"""Every stage and operator on documents whose extra columns carry the operators' own names, with repeated rows and null ids."""

import corpus_pipeline
import pytest
from palaver.llm import apportion, chunk_reuse, count_vector_join, filter_audit, line_windows, quality_divergence, token_counts
from palaver.llm.best_fit import pack, pieces
from palaver.llm.tokens import splits_at_blanks, tokenizer

NAMES = (
    "_id _md5 _left _starts _part _text _draw _salt _shard _shards _rows _all _seats _words _picked _cut _place _before _n _sum _low "
    "_high _won _most _level _chars size start starts taken rounds picked blocks phase target quota source_size source_rank words rank "
    "n_lines n_removed doc doc2 text_md5 plan left kept classes common n digest c vec hash count bucket id comp component a b u v m "
    "n_shingles component_id piece length offset sequence_id ids_crc32 shard part mask first rows of_none chunk text_key"
).split()


def value(name):
    return f"x{NAMES.index(name)}"


@pytest.fixture(scope="module")
def docs(spark):
    prose = " ".join(f"w{k * 7919 % 389}" for k in range(300))
    lines = "\n".join(" ".join(f"w{k * 31 % 97 + j}" for k in range(12)) for j in range(9))
    texts = [prose, lines, prose + " end", lines + "\nanother line that is new", None, "", "short"]
    rows = [(k, t, "en", f"s{k % 3}", None) for k, t in enumerate(texts * 3)]
    rows += [rows[0]] * 25 + [(None, prose, "en", "s1", 3)] * 4 + [(None, "own " * 3 + lines[::-1], "xx", None, 3)] * 3
    rows += [(2, lines + "\nmore", "en", "s2", 1), (0, prose + " other", "de", "s0", 1)]
    return spark.createDataFrame(
        [(*r, *[f"x{k}" for k in range(len(NAMES))]) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES),
    ).repartition(3)


def test_stages(spark, docs, tmp_path):
    counts, left = [docs.count()], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, left.limit(0), None)
        out = stage(spark, left, None)
        assert empty.count() == 0 and empty.columns == out.columns
        if k < 4:
            assert out.dtypes == docs.dtypes
            assert out.where(f"_id <> '{value('_id')}' or size <> '{value('size')}' or start <> '{value('start')}'").count() == 0
        out.write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(left.count())
    assert all(counts)


def test_representatives_keep_one_row(spark, docs):
    out = count_vector_join.representatives(docs).select("doc_id", "text").collect()
    named = {r.doc_id for r in out if r.doc_id is not None}
    # Null and empty texts link with nothing; document 2 has a text like 0's and one like 1's.
    assert named == {0, 4, 5, 6, 11, 12, 18, 19} and len(named) == sum(r.doc_id is not None for r in out)
    assert sum(r.doc_id is None for r in out) == 1


def test_repeated_rows_mix_alike(docs):
    mixed = apportion.mix(docs)
    texts = [sorted(map(str, apportion.mixed_texts(d, apportion.mix(d)).select("doc_id", "source", "text").collect())) for d in (docs, docs.repartition(7))]
    assert texts[0] == texts[1] and mixed.count() == docs.count()


def test_packing_spreads_equal_rows(spark):
    rows = spark.range(4).selectExpr("1L as doc_id", "explode(sequence(1, 10000)) as x", "0 as piece", "7L as length", "5L as ids_crc32", "'a' as shard")
    packed = pack(rows, shard_pieces=10_000).selectExpr("sequence_id >> 32 as shard_no").groupBy("shard_no").count().collect()
    assert len(packed) == 4 and max(r["count"] for r in packed) < 12_000


def test_packing_with_any_vocabulary(spark, docs):
    tok = tokenizer("byte_bpe_50k.json")
    assert splits_at_blanks(tokenizer("word_bpe_49k.json")) and not splits_at_blanks(tok)
    got = pieces(docs, vocabulary="byte_bpe_50k.json", capacity=1 << 20, keep_ids=True).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == want


def test_operators(spark, docs):
    n = docs.count()
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_divergence.quality(docs).count() == n
    out = line_windows.dedup_lines(docs)
    assert out.where(f"_left = '{value('_left')}' and starts = '{value('starts')}'").count() == n
    assert token_counts.token_counts(docs).count() == n
    assert chunk_reuse.encode_decode(docs).count() == n
    assert filter_audit.audit(filter_audit.masks(docs, labels)).count() == 600 * docs.select("source").distinct().count()
