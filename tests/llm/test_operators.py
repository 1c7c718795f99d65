"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, case by case."""

import random
import re

import numpy as np
import pytest
from palaver.llm import chat_format, count_vector_join, line_windows, link_graph, permutation_index, quality_divergence
from palaver.llm.apportion import mix
from palaver.llm.best_fit import best_fit_decreasing, pack, pieces, sequences
from palaver.llm.token_counts import count_huge, token_counts
from palaver.llm.tokens import tokenizer
from palaver.llm.toxicity import fit, score
from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, size long, id string"
LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))
TEXTS = [
    None, "", "   \n\t", "one", "a b c d e f g h\nsecond line here\nthird line is here\nfourth", LONG,
    "Same text again and again\nwith three lines of\nwords in it\nand one more", "Same text again and again\nwith three lines of\nwords in it\nand one more",
    "a b c d e f g h\nsecond line here\nthird line is here\nchanged", "x\x1cy \x85z  <|endoftext|> é ǅ",
]


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", None, "xx"][k % 3], ["s1", None, "s2"][k % 3], None, 7, 8, "i") for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all", "en", None, None, None, None, None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, SCHEMA)


def plain_quality(text):
    w = words_of(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def plain_line_dedup(texts):
    seen, out = set(), {}
    for key in sorted(texts):
        if texts[key] is None:
            out[key] = None
            continue
        lines = texts[key].split("\n")
        solid = [i for i, x in enumerate(lines) if words_of(x)]
        gone = set()
        for a in range(max(len(solid) - 2, 1 if solid else 0)):
            window = tuple(lines[i] for i in solid[a : a + 3])
            if window in seen:
                gone |= {*solid[a : a + 3]}
            seen.add(window)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def plain_components(texts):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in texts.items():
        w = words_of((t or "").translate(table))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {k: find(k) for k in keys}


def test_quality(docs):
    for r in quality_divergence.quality(docs).collect():
        text = "no id at all" if r.doc_id is None else TEXTS[r.doc_id]
        want = plain_quality(text)
        assert {k: getattr(r, k) for k in want} == want
        assert not (r.base_failed and r.kept)


def test_line_windows(docs):
    got = line_windows.dedup_lines(docs.where("doc_id is not null"))
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == plain_line_dedup(dict(enumerate(TEXTS)))
    again = line_windows.dedup_lines(docs)
    assert again.count() == docs.count()


def test_line_windows_of_short_texts(spark):
    texts = ["a b", "a b\nc", "a b", "\na b\n\nc", "c", "a b\nc\nd", "c\na b", "", " \n", None, "x\na b\nc\nd\ny", "c"]
    got = line_windows.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = dict(enumerate(texts)) | {2: "", 3: "\n", 10: "x\ny", 11: ""}
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert plain_line_dedup(dict(enumerate(texts))) == want


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in count_vector_join.near_duplicates(docs).collect()}
    want = plain_components(dict(enumerate(TEXTS)))
    assert {k: v[1] for k, v in got.items() if k is not None} == want and got[0] == (0, 0) and got[3] == (1, 3)


def test_near_duplicates_of_graded_copies(spark):
    """Chains of copies that differ a little from one to the next, and groups that share a passage."""
    rng, texts = random.Random(3), {}
    passage = [f"p{k}" for k in range(40)]
    for g in range(12):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(14):
            texts[len(texts)] = " ".join(w + (passage if g % 2 else []))
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(4000)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in count_vector_join.near_duplicates(df).collect()}
    assert got == plain_components(texts)


def test_count_tree_finds_all_pairs():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 12, (300, 16))
    points[150:] = points[:150] + rng.integers(0, 2, (150, 16))
    sizes = points.sum(1)
    got = {tuple(sorted(p)) for i, j in count_vector_join.CountTree(points, sizes).pairs(75) for p in zip(i.tolist(), j.tolist())}
    least = np.minimum(points[:, None], points[None]).sum(2)
    want = 100 * least >= 75 * (sizes[:, None] + sizes[None] - least)
    assert got == {(i, j) for i, j in zip(*np.nonzero(want)) if i < j}


def _tasks(spark, members, vectors):
    """Rows of each task that the trees get."""
    rows = spark.createDataFrame(members, "bucket long, id long, comp long, lead boolean, n long, groups long")
    points = spark.createDataFrame(vectors, "id long, vec binary")
    tasks = {}
    for r in count_vector_join._dealt(rows, points, 75).collect():
        tasks.setdefault((r.bucket, r.a, r.b), []).append((r.side, r.id))
    return tasks


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    """One bucket of near copies in a component and a stray: bounded tasks, and none of one component alone."""
    monkeypatch.setattr(count_vector_join, "BLOCK_ROWS", 16)
    vec = lambda k: np.bincount([k % 16], minlength=16).astype("<u4") + np.uint32(4)
    vectors = [(k, vec(k).astype("<u4").tobytes()) for k in range(202)]
    members = [(7, k, 0 if k < 200 else k, k == 0, 65, 16) for k in range(201)] + [(8, 200, 200, True, 65, 16), (8, 201, 201, False, 65, 16)]
    tasks = _tasks(spark, members, vectors)
    assert max(map(len, tasks.values())) <= 2 * 16 and set(tasks[(8, -1, -1)]) == {(0, 200), (0, 201)}
    own = {key: {k for _, k in rows} for key, rows in tasks.items() if key[0] == 7}
    assert all(200 in ids for ids in own.values()) and set().union(*own.values()) == set(range(201))


def test_near_duplicates_by_blocks(spark, monkeypatch):
    """The same components when every bucket is cut into small blocks."""
    monkeypatch.setattr(count_vector_join, "BLOCK_ROWS", 4)
    test_near_duplicates_of_graded_copies(spark)


def test_count_tree_passes_over_one_component():
    points, sizes = np.full((400, 16), 5), np.full(400, 80)
    comp = np.zeros(400, int)
    comp[399] = 1
    found = list(count_vector_join.CountTree(points, sizes, comp).pairs(75))
    assert sum(len(i) for i, _ in found) == 399
    one, two = (count_vector_join.CountTree(points[s], sizes[s], comp[s]) for s in (slice(0, 200), slice(200, 400)))
    assert sum(len(i) for i, _ in one.pairs(75, two)) == 200 and all((j == 199).all() for _, j in one.pairs(75, two))


def test_shingler_splits_long_texts_alike(monkeypatch):
    text = "Äb  c\td\n" * 500 + LONG
    whole = count_vector_join.Shingler()(text)
    monkeypatch.setattr(count_vector_join, "PIECE_BYTES", 1000)
    assert np.array_equal(whole, count_vector_join.Shingler()(text))


def test_mix(docs):
    rows = mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 64
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))


def test_packing(docs):
    rows = pieces(docs, keep_ids=True)
    packed = pack(rows).cache()
    assert packed.count() == rows.count()
    lengths = {r.sequence_id: len(r.ids) for r in sequences(packed).collect()}
    assert sum(lengths.values()) == sum(r.length for r in rows.collect()) and max(lengths.values()) <= 2048
    assert {r.doc_id: r.length for r in packed.where("doc_id < 3").collect()} == {0: 1, 1: 1, 2: 1}


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 60) for _ in range(400)), reverse=True)
    bins, offsets = best_fit_decreasing(lengths, 64)
    room = {}
    for length, b, offset in zip(lengths, bins, offsets):
        fitting = [r for r in room.values() if r >= length]
        assert room.get(b, 64) == (min(fitting) if fitting else 64) and offset == 64 - room.get(b, 64)
        room[b] = room.get(b, 64) - length


def test_token_counts(docs):
    tok = tokenizer("byte_bpe_50k.json")
    for r in token_counts(docs, chunk=300, overlap=64).where("doc_id is not null").collect():
        assert r.n_tokens == len(tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids)


def test_chunks_splice_exactly():
    tok, rng = tokenizer("byte_bpe_50k.json"), random.Random(5)
    bits = ["the ", "  ", "\n\n", "don't", "<|endoftext|>", "<|endof", "éßñ", "12345 ", "́", "aaaaaaaaaaaa", "\t", "漢字", "!?!"]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([50, 400, 1500])))
        assert count_huge(tok, text, 200, 64) == len(tok.encode(text, add_special_tokens=False).ids)
    run = "z" * 3000 + " end " + " " * 900  # no boundary in any overlap: it widens
    assert count_huge(tok, run, 200, 64) == len(tok.encode(run, add_special_tokens=False).ids)


def test_chat_format_parts(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    rows = [
        (1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", 9), None, ("text", "|im_end|> & &lt;", None, None)]),
        (1, 1, "assistant", [("text", "<|image|>\n<", None, None), ("audio", None, "b.wav", None)]),
        (1, 1, "assistant", None),
        (None, None, None, [("odd kind", None, "c", None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")
    done = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    one = done[1]
    assert [(a.turn, a.position, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, 1, "image", "a.png", 9), (2, 1, "audio", "b.wav", 128)]
    assert one.expanded_tokens == 137 and one.formatted.count("<|im_start|>") == 3 and one.formatted.count("<|image|>") == 1
    assert [(t.length, t.loss) for t in one.turns][1] == (0, True)
    assert "<|odd_kind|>" in done[None].formatted and done[None].expanded_tokens == 512


def test_search_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0]), (8, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.search(df, F.col("id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 8, -1.0)]
    assert permutation_index.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_link_graph(spark):
    link = lambda *to: "".join(f"<a class=x href='{u}'>l</a>" for u in to)
    rows = [
        (0, "http://a.org/fr/x", link("http://c.io/", "/own")), (1, "https://b.net/", link("http://e.io")),
        (2, "http://d.io/y", link("http://b.net/z", "http://b.net/w")), (3, "HTTP://C.IO", None), (4, None, None), (5, "nourl", ""),
        (6, "http://x.example.net/en/", None), (7, "http://my.example.com/de/?q", None), (8, "http://notnet/", None), (9, "http://b.net", None),
        (2, "http://d.io/y", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in link_graph.judge(df).collect()}
    assert got[0] == ("a.org", "org/fr/", "allow") and got[1] == ("b.net", "net/", "block") and got[2] == ("d.io", None, "block")
    assert got[3] == ("c.io", None, "allow") and got[4] == got[5] == ("", None, "allow") and got[8][1:] == (None, "allow")
    assert got[6][1] == "example.net/en/" and got[7][1:] == ("example.com/de/", "block") and got[9] == ("b.net", None, "block")


def test_link_graph_blocks_linkers_of_much_linked_hosts(spark):
    """A blocked host with 5, 50 and 5,000 linkers; and one link of 40 to such a host is no ground."""
    link = lambda *to: "".join(f"<a href='http://{u}/'>l</a>" for u in to)
    rows = [(f"l{k}.of{n}.io", link(f"b{n}.net")) for n in (5, 50, 5000) for k in range(n)]
    rows += [("mixed.io", link("b5000.net", "c.io")), ("portal.io", link("b5000.net", *[f"c{k}.io" for k in range(39)]))]
    df = spark.createDataFrame([(k, f"http://{h}/", html) for k, (h, html) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in link_graph.judge(df).collect()}
    assert got.pop("portal.io") == "allow" and len(got) == 5056 and set(got.values()) == {"block"}


def test_toxicity_defined_cases(spark, docs):
    labels = spark.createDataFrame([(k, None, k % 2) for k in range(9)] + [(None, 1, 1), (77, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    one_kind = fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in score(docs, one_kind).collect()} == {0}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(chats.withColumn("parts", chat_format.text_parts(F.col("text"))))
    for df in (
        quality_divergence.quality(none), line_windows.dedup_lines(none), count_vector_join.near_duplicates(none), mix(none),
        pack(pieces(none)), token_counts(none), score(none, fit(none, labels)), link_graph.judge(pages), chat_format.read_back(formatted),
    ):
        assert df.count() == 0
