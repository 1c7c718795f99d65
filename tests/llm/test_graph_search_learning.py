"""Link graphs with edges against SQL, search over vectors of unlike lengths, and the toxicity query against a plain version."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from palaver.llm import link_graph, permutation_index, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def link(*hosts):
    return "".join(f'<a class="x" href="{h}">y</a>' for h in hosts)


PAGES = [
    ("http://one.de/", link("http://bad.net/x")),
    ("http://no-scheme.de/", link("//bad.net/x")),
    ("http://three.de/", link("http://bad.net", *[f"http://o{k}.de/" for k in range(3)])),
    ("http://nine.de/", link("http://bad.net", *[f"http://o{k}.de/" for k in range(9)])),
    ("http://five.de/", link("http://bad.net", "https://sub.worse.net/a", *[f"http://o{k}.de/" for k in range(9)])),
    *[(f"http://chain{k}.de/", link("http://bad.net" if k == 0 else f"http://chain{k - 1}.de/")) for k in range(9)],
    ("http://cycle1.de/", link("http://cycle2.de/", "/local")),
    ("http://cycle2.de/", link("http://cycle1.de/", "http://bad.net")),
    ("https://good.org/fr/a", link("http://trusted.de/")),
    ("http://trusted.de/", link("http://bad.net", "http://o1.de", "http://o2.de", "http://o3.de")),
    *[(f"http://fan{k}.de/p?q", link("http://hub.net/")) for k in range(60)],
    ("http://hub.de/", link(*[f"http://fan{k}.de" for k in range(60)])),
    ("http://one.de/", link("http://bad.net/x")), (None, link("http://bad.net")), ("no host", None), ("http://alone.de", None),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(PAGES)], "page_id long, url string, html string")
    return {tuple(r) for r in link_graph.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()}


def test_link_graph_equals_sql(verdicts):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(k, *p) for k, p in enumerate(PAGES)])
    assert set(con.execute(link_graph.ORACLE).fetchall()) == verdicts


def test_link_graph_verdicts(verdicts):
    host = {h: v for _, h, _, _, v in verdicts}
    blocked = {h for h in host if host[h] == "block" and not h.endswith(".net")}
    assert {"one.de", "no-scheme.de", "three.de", "cycle1.de", "cycle2.de", "hub.de"} <= blocked
    assert {f"fan{k}.de" for k in range(60)} <= blocked and {f"chain{k}.de" for k in range(5)} <= blocked
    assert not blocked & {"nine.de", "chain8.de", "trusted.de", "good.org", "alone.de", "", *[f"o{k}.de" for k in range(9)]}


@pytest.mark.parametrize("kind", ["unit", "half", "one", "giants"])
def test_search_recall_on_lengths(spark, kind):
    rng = np.random.default_rng(3)
    n, centres = 10_000, rng.normal(size=(100, 64))
    v = centres[rng.integers(0, 100, n)] + rng.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    length = {"unit": np.ones(n), "half": rng.lognormal(0, 0.5, n), "one": rng.lognormal(0, 1, n), "giants": np.where(np.arange(n) < 20, 100.0, 1.0)}
    v = (v * length[kind][:, None]).astype("f4")
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    found = permutation_index.search(df, F.col("id") % 200 == 0).toPandas()
    hits = 0
    for q in range(0, n, 200):
        scores = v.astype("f8") @ v[q].astype("f8")
        scores[q] = -np.inf
        hits += len(set(found[found.query_id == q].vec_id) & set(np.lexsort((np.arange(n), -scores))[:20].tolist()))
    assert hits / (20 * n / 200) >= 0.9


def test_toxicity_query_equals_a_plain_version(spark):
    """The split, the choice of texts and labels, and the scores; and nothing hangs on how rows are dealt."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    rows += [(k, t + " repeated") for k, t in rows[:40]] + rows[10:30]
    labels += [(k, 1 - t) for k, t in labels[:5]] + [(None, 1), (labels[7][0], None)]
    crc = lambda k: zlib.crc32(str(k).encode()) % 5
    toxic, texts = {}, {}
    for k, t in labels:
        if k is not None and t in (0, 1) and crc(k):
            toxic[k] = max(t, toxic.get(k, 0))
    for k, t in rows:
        if k in toxic and t is not None and len(t) <= toxicity.MAX_TRAIN_CHARS:
            texts[k] = min(t, texts.get(k, t), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    keys = sorted(texts)
    plain = toxicity.Scorer(*toxicity.train([texts[k] for k in keys], [toxic[k] for k in keys]))
    want = sorted((k, crc(k) == 0, plain(t)) for k, t in rows)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    runs = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        runs.append(sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, labelled.repartition(parts))).collect())))
    assert runs[0] == runs[1], "bit for bit"
    # Tasks and this process may split sums of doubles differently.
    assert [r[:2] for r in runs[0]] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in runs[0]], [r[2] for r in want], rtol=0, atol=1e-4)
    assert all(r[3] == int(r[2] >= 0.5) for r in runs[0])
