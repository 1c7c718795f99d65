"""Filter audit, centroid clustering and chunk reuse: defined cases, plain versions, and the tokenizer library."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from palaver.llm import chunk_reuse, filter_audit, walsh_clusters
from palaver.llm.queries import QUERIES
from palaver.llm.tokens import tokenizer

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    """Rows (part, order, step) -> figures, by applying every order to every document."""
    first = {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    rows = []
    for key, text, source in docs:
        text = text or ""
        w = [x for x in SPACE.split(text) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": key is not None and key > first[text],
        }
        rows.append((source or "", {f for f in fails if fails[f]}, key in good, key in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shares = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = own
            for k, f in enumerate(order):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                before = set(order[:k])
                out[part, "".join(order), k + 1] = [
                    len(alive), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
                shares[f] += len(gone)
        for (p, *_), v in out.items():
            if p == part and isinstance(v[-1], str):
                v[-1] = shares[v[-1]]
    return out


def test_audit(spark):
    rng = random.Random(4)
    words = ["a", "b", "c#", "The", "QUICK", "x y", "\x0b", "ç"] + [f"w{k}" for k in range(300)]
    texts = [None, "", " \n", "A" * 50, "# $"] + [" ".join(rng.choices(words, k=rng.choice([3, 150, 250, 400]))) for _ in range(40)]
    docs = [(k, rng.choice(texts), rng.choice(["s1", None, "", "s2"])) for k in range(150)]
    docs += [(None, texts[7], "s1"), (None, None, None), docs[3], docs[3], (docs[5][0], "another text", "s2")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(
        [(*d, 9, 8, "m", 7) for d in docs], "doc_id long, text string, source string, mask int, n long, part string, id long"
    )
    labelled = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, id int")
    got = filter_audit.audit(filter_audit.masks(frame, labelled)).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == plain_audit(docs, labels)
    assert len(got) == 600 * 3
    empty = filter_audit.audit(filter_audit.masks(frame.limit(0), labelled))
    assert empty.count() == 0
    assert filter_audit.audit(filter_audit.masks(frame, labelled.limit(0))).count() == 600 * 3


@pytest.mark.parametrize("n", [1, 3, 6])
def test_lattice_counts_orders(n):
    forward, backward = filter_audit.lattice(n)
    for s in range(1 << n):
        size = s.bit_count()
        assert (forward[s], backward[s]) == (math.factorial(size), math.factorial(n - size))


def plain_clusters(rows, clusters=40, rounds=5):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [int(x) * 256 if abs(x) > 2**60 else math.floor(x * 256) for x in v]))
    digest = lambda k: hashlib.sha256(f"2:{k}".encode()).hexdigest()
    chosen = sorted([r for r in kept if r[0] is not None], key=lambda r: digest(r[0])) + [r for r in kept if r[0] is None]
    centroids = [v for _, v in chosen[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for _ in range(rounds + 1):
        placed = [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
        final = list(centroids)
        for k in range(len(centroids)):
            own = [v for (_, v), (_, j) in zip(kept, placed) if j == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    inertia = {}
    for d, k in placed:
        inertia[k] = inertia.get(k, 0) + d
    name = lambda k: hashlib.sha256(",".join(map(str, final[k])).encode()).hexdigest()
    long = lambda x: x if x < 2**63 else None
    return sorted(
        (str(key), k, str(long(d)), str(long(inertia[k])), str(long(sum(inertia.values()))), name(k)) for (key, _), (d, k) in zip(kept, placed)
    )


def as_rows(df):
    return sorted((str(r[0]), r[1], str(r[2]), str(r[3]), str(r[4]), r[5]) for r in df.collect())


@pytest.mark.parametrize("scale", [0.2, 900.0, 1e5, 1e9])
def test_clusters(spark, scale):
    rng = np.random.default_rng(int(scale))
    centers = rng.normal(size=(12, 64)) * scale
    rows = [(k, (centers[k % 12] + rng.normal(size=64) * scale / 3).tolist()) for k in range(300)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (900, [0.0] * 64), (901, [0.0] * 64), (902, [-0.0] * 64)]
    rows += [(903, None), (904, []), (905, [1.0] * 63), (906, [math.nan] * 64), (907, [math.inf] * 64), (908, [None] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, id int, cluster int, distance int")
    assert as_rows(walsh_clusters.cluster(df)) == plain_clusters(rows)
    assert walsh_clusters.cluster(df.limit(0)).count() == 0


def test_clusters_few_ties_and_huge_components(spark):
    few = [(k, [float(k)] * 64) for k in range(7)]
    schema = "vec_id long, embedding array<double>"
    assert as_rows(walsh_clusters.cluster(spark.createDataFrame(few, schema))) == plain_clusters(few)
    # Every vector twice, centroids in between: ties go to the smaller number.
    grid = [(k, [float(a), float(b)] + [0.0] * 62) for k, (a, b) in enumerate(itertools.product(range(8), range(8)))]
    assert as_rows(walsh_clusters.cluster(spark.createDataFrame(grid * 2, schema))) == plain_clusters(grid * 2)
    huge = few + [(50, [1e300] * 64), (51, [-1e18] + [2.5] * 63), (52, [1e12] * 64), (53, [-1e12 - 0.3] * 64)]
    assert as_rows(walsh_clusters.cluster(spark.createDataFrame(huge, schema), clusters=4)) == plain_clusters(huge, 4)


def test_search_is_exhaustive_where_nothing_can_be_thrown_out():
    h = walsh_clusters.transform()
    assert (h @ h.T == 64 * np.eye(64, dtype=int)).all()
    assert ((np.diff(h, axis=1) != 0).sum(1) == np.arange(64)).all()
    rng = np.random.default_rng(1)
    x, c = rng.integers(-5, 6, (500, 64)), rng.integers(-5, 6, (40, 64))
    col, dist = walsh_clusters.nearest((x @ h.T).astype("f8"), (c @ h.T).astype("f8"))
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (col == all_.argmin(1)).all() and (dist == all_.min(1)).all()


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(tok.decode(ids, skip_special_tokens=False))


def test_chunk_reuse_equals_the_library(spark):
    tok = tokenizer("word_bpe_49k.json")
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op13_chunk_reuse"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {k: expected(tok, t) for k, t in texts.items()}
    assert len(got) == len(texts)


@pytest.mark.parametrize("hot_share", [2, 64, 1 << 40])
@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_reuse_cases(spark, hot_share, vocabulary):
    """Chunks that are hot, travel or stay, whatever the share; cuts in special strings, in marks and in endless words."""
    rng, tok = random.Random(8), tokenizer(vocabulary)
    letters = list("ab c's\n\t 12,.!ẹ̣́́İ각日本\x85\x1c\xa0") + ["<|endoftext|>", "<|start", "oftext|>"]
    passage = "".join(rng.choices(letters, k=300))
    texts = [None, "", " ", "a" * 3000, "́" * 900, "<|endoftext|>" * 90, " " * 2000, "ab" * 20_000]
    for _ in range(120):
        own = "".join(rng.choices(letters, k=rng.choice([5, 60, 400])))
        texts.append(own + passage[: rng.choice([0, 200, 300])] + "".join(rng.choices(letters, k=30)))
    texts += texts[20:40]
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts)] + [(None, texts[30], "x", 1, "y"), (3, texts[3], "x", 1, "y"), (9, texts[8], "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string, id int, chunk string").repartition(3)
    got = chunk_reuse.encode_decode(docs, vocabulary=vocabulary, least=33, bits=4, most=200, hot_share=hot_share).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(str((r[0], *expected(tok, r[1]))) for r in rows)
    assert chunk_reuse.encode_decode(docs.limit(0)).count() == 0


def test_chunks_follow_the_content():
    """What stands before a passage moves its cuts along, and does not change them."""
    rng, cuts = random.Random(2), chunk_reuse.Chunker(40, 5, 400)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(2000))
    chunks = lambda t: [t[a:b] for a, b in zip([0, *cuts(t)], cuts(t))]
    plain, moved = chunks(text), chunks("something else stands in front " + text)
    assert "".join(plain) == text and max(map(len, plain)) <= 400
    assert len(set(plain) & set(moved)) >= len(set(plain)) - 3
