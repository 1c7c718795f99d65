"""Statistics against plain Python on a small random table of several threads."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.operators import authors as A
from palaver.operators import emojis as E
from palaver.operators import references as R
from palaver.operators import select as S
from palaver.operators.frontier import frontier_pages
from palaver.operators.letters import char_counts, filter_chars
from palaver.operators.ranking import top_n
from palaver.plans import markup, reports
from palaver.plans.reports import REPORTS, report
from palaver.plans.views import as_posts

THREAD = ["thread_id"]
KINDS = [":a:", ":b:", ":c:", ":d:", ":e:"]


def make_posts():
    rnd = random.Random(7)
    rows = []
    for thread in ("t1", "t2"):
        time = dt.datetime(2018, 11, 5)
        for num in range(1, 181):
            if num == 100:
                time += dt.timedelta(days=800)
            time += dt.timedelta(hours=rnd.randrange(60))
            # One author writes a third of all posts.
            author = "hot" if rnd.random() < 0.34 else f"a{rnd.randrange(12)}"
            emojis = rnd.sample(KINDS, rnd.randrange(4))
            words = ["".join(rnd.choices("abcÄßxyZ", k=3)) for _ in range(rnd.randrange(6))]
            rows.append(
                {
                    "thread_id": thread,
                    "post_num": num,
                    "page_num": (num + 19) // 20,
                    "author": author,
                    "author_id": "0" if author == "a3" else author.replace("a", "1"),
                    "creation_ts": time,
                    "creation_local": time,
                    "word_count": len(words),
                    "words": words,
                    "quoted_list": rnd.choices(["hot", "a1", "a2", ""], k=rnd.randrange(3)),
                    "mentioned_list": rnd.choices(["0", "11", "12", "99"], k=rnd.randrange(3)),
                    "emoji_frequency_mapping": {e: rnd.randrange(1, 4) for e in emojis},
                    "is_rules_compliant": rnd.random() < 0.7,
                }
            )
    for r in rows:
        r["quote_count"] = len(r["quoted_list"])
        r["mentions_count"] = len(r["mentioned_list"])
        r["emoji_count"] = sum(r["emoji_frequency_mapping"].values())
    return rows


ROWS = make_posts()
SCHEMA = (
    "thread_id string, post_num long, page_num int, author string, author_id string, "
    "creation_ts timestamp, creation_local timestamp_ntz, word_count int, "
    "words array<string>, quoted_list array<string>, mentioned_list array<string>, "
    "emojis array<string>, uses array<int>, is_rules_compliant boolean, "
    "quote_count int, mentions_count int, emoji_count int"
)


@pytest.fixture(scope="module")
def posts(spark):
    # Spread over partitions out of order: nothing may rely on row order.
    rows = random.Random(1).sample(ROWS, len(ROWS))
    for r in rows:
        # A map built from a Python dict would lose the order of its keys.
        r["emojis"] = list(r["emoji_frequency_mapping"])
        r["uses"] = list(r["emoji_frequency_mapping"].values())
    tuples = [tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows]
    df = spark.createDataFrame(tuples, SCHEMA).repartition(5)
    emojis = F.map_from_arrays("emojis", "uses")
    return as_posts(df.withColumn("emoji_frequency_mapping", emojis)).cache()


def one_thread(posts, thread="t1"):
    return posts.filter(F.col("thread_id") == thread)


def rows_of(thread="t1"):
    return [r for r in ROWS if r["thread_id"] == thread]


def ranked(counter):
    """Counts descending, equal ones in order of first appearance."""
    return sorted(counter.items(), key=lambda item: -item[1])


def test_author_table(posts):
    rows = rows_of()
    messages = Counter(r["author"] for r in rows)
    bad = Counter(r["author"] for r in rows if not r["is_rules_compliant"])
    expected = [(a, n, bad[a], bad[a] / n * 100) for a, n in ranked(messages)]
    table = reports.author_table(one_thread(posts))
    got = [(r.author, r.messages, r.violations, r.violation_pct) for r in table.collect()]
    assert got == expected


def test_violation_table(posts):
    rows = rows_of()
    messages = Counter(r["author"] for r in rows)
    bad = Counter(r["author"] for r in rows if not r["is_rules_compliant"])
    rates = {a: bad[a] / n for a, n in messages.items()}
    expected = [a for a, _ in sorted(rates.items(), key=lambda i: i[1]) if messages[a] >= 9]
    assert [r.author for r in reports.violation_table(one_thread(posts), n=9).collect()] == expected


@pytest.mark.parametrize("criterion", ["messages", "words", "anything"])
@pytest.mark.parametrize("n", [0, 3, 50])
def test_top_share(posts, criterion, n):
    amounts = Counter()
    for r in rows_of():
        amounts[r["author"]] += 1 if criterion == "messages" else r["word_count"]
    total = sum(amounts.values())
    top = ranked(amounts)[:n]
    expected = [("Rest", (total - sum(v for _, v in top)) / total)]
    expected += [(a, v / total) for a, v in top]
    shares = reports.top_share(one_thread(posts), n, criterion).collect()
    assert [(r.author, r.share) for r in shares] == expected
    assert sum(r.share for r in shares) == pytest.approx(1)
    grouped = reports.top_share(posts, n, criterion, by=THREAD)
    assert [(r.author, r.share) for r in grouped.collect() if r.thread_id == "t1"] == expected


def test_yearly_top_share(posts):
    shares = reports.yearly_top_share(posts, 2, by=THREAD).collect()
    for thread in ("t1", "t2"):
        rows = rows_of(thread)
        years = [r["creation_local"].year for r in rows]
        expected = []
        for year in range(min(years), max(years) + 1):
            counts = Counter(r["author"] for r in rows if r["creation_local"].year == year)
            total = sum(counts.values())
            top = ranked(counts)[:2]
            rest = (total - sum(v for _, v in top)) / total * 100 if total else 100
            expected.append((year, "Rest", pytest.approx(rest)))
            expected += [(year, a, pytest.approx(v / total * 100)) for a, v in top]
        got = [(r.year, r.author, r.pct) for r in shares if r.thread_id == thread]
        assert got == expected


def test_year_without_posts(posts):
    empty = {r.year: r for r in reports.authors_per_year(one_thread(posts)).collect()}
    years = {r["creation_local"].year for r in rows_of()}
    gap = set(range(min(years), max(years) + 1)) - years
    assert gap and all(empty[y].authors == 0 for y in gap)
    ratios = reports.messages_per_author_per_year(one_thread(posts)).collect()
    for r in ratios:
        rows = [x for x in rows_of() if x["creation_local"].year == r.year]
        expected = len(rows) / len({x["author"] for x in rows}) if rows else None
        assert r.messages_per_author == expected


def emoji_totals(rows):
    totals = Counter()
    for r in rows:
        for e, n in r["emoji_frequency_mapping"].items():
            totals[e] += n
    return totals


def test_emoji_reports(posts):
    totals = emoji_totals(rows_of())
    everything = sum(totals.values())
    table = reports.emoji_table(one_thread(posts)).collect()
    assert [(r.emoji, r["count"]) for r in table] == ranked(totals)
    share = reports.emoji_share(one_thread(posts), 3).collect()
    assert [(r.emoji, r.share) for r in share] == [
        (e, n / everything) for e, n in ranked(totals)[:3]
    ]
    first = reports.emoji_share(one_thread(posts), 3, rank_by="first_seen").collect()
    assert [r.emoji for r in first] == list(totals)[:3]
    used = E.used_emojis(one_thread(posts)).collect()
    assert [r.emoji for r in used] == list(totals)
    with pytest.raises(ValueError):
        reports.emoji_share(posts, rank_by="x")


@pytest.mark.parametrize("n_emojis", [2, 0])
def test_emoji_distribution(posts, n_emojis):
    rows = rows_of()
    per_author = defaultdict(Counter)
    for r in rows:
        per_author[r["author"]].update(r["emoji_frequency_mapping"])
    users = [
        a for a, _ in ranked({a: sum(c.values()) for a, c in per_author.items()})
    ][:4]
    merged = emoji_totals(
        {"emoji_frequency_mapping": per_author[u]} for u in users
    )
    shown = [e for e, _ in ranked(merged)][: n_emojis or None]
    cells = reports.emoji_distribution(one_thread(posts), 4, n_emojis).collect()
    got = defaultdict(dict)
    for r in cells:
        got[r.author][r.emoji] = r.n
    assert list(got) == users
    for u in users:
        expected = {e: per_author[u][e] for e in shown if per_author[u][e]}
        rest = sum(n for e, n in per_author[u].items() if e not in shown)
        assert got[u] == ({**expected, "Andere": rest} if rest else expected)


def test_references(posts):
    rows = rows_of()
    mentioned = Counter(i for r in rows for i in r["mentioned_list"])
    del mentioned["0"]
    names = {"11": "a1", "12": "a2"}
    top = reports.top_mentioned(one_thread(posts), 2).collect()
    assert [(r.user_id, r.name, r.times) for r in top] == [
        (i, names.get(i, i), n) for i, n in ranked(mentioned)[:2]
    ]
    quoted = Counter(q for r in rows for q in r["quoted_list"])
    del quoted[""]
    assert [
        (r.user_name, r.times) for r in reports.top_quoted(one_thread(posts), 9).collect()
    ] == ranked(quoted)
    for make, column in (
        (reports.top_mentioners, "mentioned_list"),
        (reports.top_quoters, "quoted_list"),
    ):
        counts = Counter(r["author"] for r in rows if r[column])
        got = [(r.author, r.messages) for r in make(one_thread(posts), 5).collect()]
        assert got == ranked(counts)[:5]


def test_nobody(spark):
    """A user may be called 0, and an empty id is not the id of nobody."""
    rows = [("0", ["", "0", "x"], ["", "0"]), ("", ["x"], ["7"])]
    df = spark.createDataFrame(
        rows, "author string, quoted_list array<string>, mentioned_list array<string>"
    ).withColumns({"post_num": F.lit(1), "quote_count": F.lit(1), "mentions_count": F.lit(1)})
    assert {r.user_name for r in R.times_quoted(df).collect()} == {"0", "x"}
    assert {r.user_id for r in R.times_mentioned(df).collect()} == {"", "7"}
    assert R.messages_with_mention_by_author(df).count() == 0
    assert [r.author for r in R.messages_with_quote_by_author(df).collect()] == ["0"]


def test_names_of_nobody(spark, posts):
    ids = spark.createDataFrame([("0",), ("11",), ("77",)], "user_id string")
    got = {r.user_id: r.name for r in R.lookup_author_name(ids, posts).collect()}
    assert got == {"0": "0", "11": "a1", "77": "77"}


def test_words_per_message(posts):
    words, messages = Counter(), Counter()
    for r in rows_of():
        words[r["author"]] += r["word_count"]
        messages[r["author"]] += 1
    rates = {a: words[a] / n for a, n in messages.items()}
    expected = [("Gesamt", sum(words.values()) / 180), *ranked(rates)[:4]]
    for table in (
        reports.words_per_message(one_thread(posts), 4),
        reports.words_per_message(posts, 4, by=THREAD).filter("thread_id = 't1'"),
    ):
        assert [(r.author, r.words_per_message) for r in table.collect()] == expected


@pytest.mark.parametrize("mode", ["count_all", "count_first", "count_last"])
@pytest.mark.parametrize("chars", [None, "aäß", "Z"])
@pytest.mark.parametrize("fold", [True, False])
def test_letters(posts, mode, chars, fold):
    counts = Counter()
    for r in rows_of():
        for w in r["words"]:
            counts.update({"count_all": w, "count_first": w[0], "count_last": w[-1]}[mode])
    if chars:
        keep = chars.lower() if fold else chars
        counts = {c: n for c, n in counts.items() if (c.lower() if fold else c) in keep}
    expected = Counter()
    for c, n in counts.items():
        expected[c.lower() if fold else c] += n
    got = reports.letters(one_thread(posts), mode, chars, fold).collect()
    assert {r.char: r["count"] for r in got} == dict(expected)
    assert [r["count"] for r in got] == sorted(expected.values(), reverse=True)


def test_letter_arguments(posts):
    with pytest.raises(ValueError):
        char_counts(posts, "count_middle")
    counts = char_counts(posts, "count_all")
    assert filter_chars(counts, "").count() == counts.count()


def test_list_authors_and_spans(posts):
    order = list(dict.fromkeys(r["author"] for r in rows_of()))
    assert [r.author for r in A.list_authors(one_thread(posts)).collect()] == order
    span = A.span_bounds(one_thread(posts)).first()
    times = [r["creation_local"] for r in rows_of()]
    assert (span.first_year, span.last_year) == (times[0].year, times[-1].year)


@pytest.mark.parametrize("n", [0, 1, 5, 70, 5000])
def test_top_n_per_group_is_the_same_in_slices(spark, n):
    rows = [(g, f"x{i}", (i * 37) % 50, i) for g in ("p", "q") for i in range(100)]
    df = spark.createDataFrame(rows, "g string, name string, m long, first long").repartition(7)
    got = {(r.g, r.name): r["rank"] for r in top_n(df, "m", n, ("first", "name"), ["g"]).collect()}
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        sliced = top_n(df, "m", n, ("first", "name"), ["g"])
        assert got == {(r.g, r.name): r["rank"] for r in sliced.collect()}
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    for g in ("p", "q"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[3]))[:n]
        assert {k[1]: v for k, v in got.items() if k[0] == g} == {
            r[1]: i + 1 for i, r in enumerate(order)
        }


def test_negative_n_is_refused(posts):
    with pytest.raises(ValueError):
        reports.top_share(posts, -1)


def test_selections(posts):
    def nums(df):
        return sorted(r.post_num for r in df.collect())

    t1 = one_thread(posts)
    assert nums(S.filter_post_range(t1, range(5, 40, 9))) == [5, 14, 23, 32]
    assert nums(S.filter_post_range(t1, range(32, 4, -9))) == [5, 14, 23, 32]
    assert nums(S.filter_page_range(t1, range(1, 4, 2))) == [*range(1, 21), *range(41, 61)]
    assert nums(S.filter_page_span(t1, range(1, 4, 2))) == list(range(1, 61))
    assert nums(S.select_span(t1, posts=range(5, 40, 9))) == list(range(5, 33))
    assert S.select_span(t1, range(0), range(3, 3)).count() == 180
    with pytest.raises(ValueError):
        S.select_span(t1, range(1, 2), range(1, 2))
    year = rows_of()[0]["creation_local"].year
    expected = [r["post_num"] for r in rows_of() if r["creation_local"].year == year]
    assert nums(S.filter_year(t1, year)) == expected


def test_year_is_the_local_year(spark):
    rows = [
        (1, "2019-12-31T23:30:00-1200", "2019-12-31 23:30:00"),
        (2, "2020-01-01T00:30:00+1400", "2020-01-01 00:30:00"),
    ]
    df = spark.createDataFrame(rows, "post_num long, iso string, local string").selectExpr(
        "post_num", "to_timestamp(iso, \"yyyy-MM-dd'T'HH:mm:ssXX\") AS creation_ts",
        "cast(local AS timestamp_ntz) AS creation_local",
    )
    assert [r.post_num for r in S.filter_year(df, 2019).collect()] == [1]
    assert [r.post_num for r in S.filter_year(df, 2020).collect()] == [2]


def test_frontier(spark):
    known = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 4), ("b", 3), ("b", 3)], "thread_id string, page_num int"
    )
    last = spark.createDataFrame(
        [("a", 6), ("b", 3), ("c", 2)], "thread_id string, last_page int"
    )

    def pages(**kwargs):
        rows = frontier_pages(known, last, **kwargs).collect()
        return sorted((r.thread_id, r.page_num) for r in rows)

    tail = [("a", 4), ("a", 5), ("a", 6)], [("b", 3), ("c", 1), ("c", 2)]
    assert pages() == [*tail[0], *tail[1]]
    assert pages(fill_gaps=True) == [("a", 3), *tail[0], ("b", 1), ("b", 2), *tail[1]]


def test_markup(spark, posts):
    table = reports.author_table(one_thread(posts))
    lines = [
        r.line
        for r in markup.markup_table(table, markup.AUTHOR_HEADINGS, markup.by_messages()).collect()
    ]
    assert lines[0] == (
        "[TABLE=full][TR][TD]Spieler[/TD][TD]Anzahl Beiträge[/TD]"
        "[TD]Anzahl nicht regelkonformer Beiträge[/TD]"
        "[TD]Prozentanzahl nicht regelkonformer Beiträge[/TD][/TR]"
    )
    assert lines[-1] == "[/TABLE]"
    body = [
        f"[TR][TD]{r.author}[/TD][TD]{r.messages}[/TD][TD]{r.violations}[/TD]"
        f"[TD]{r.violation_pct}%[/TD][/TR]"
        for r in table.collect()
    ]
    assert lines[1:-1] == body


def test_emoji_names(spark, posts):
    names = spark.createDataFrame([(":a:", "😀"), (":zz:", "x")], "shortcode string, symbol string")
    table = reports.emoji_table(one_thread(posts), names).collect()
    assert {r.emoji for r in table} == {"😀", *KINDS[1:]}


def test_reports_by_name(posts):
    assert report("letters", posts, mode="count_first").columns == ["char", "count", "first_post"]
    with pytest.raises(ValueError):
        report("pie", posts)
    assert len(REPORTS) == 17


def test_empty_table(spark, posts):
    empty = posts.filter("false")
    needs = {"goal": 5, "start": 0, "end": 1, "kind": "timestamp"}
    for name, make in REPORTS.items():
        if not name.startswith("forecast"):
            rows = [r.asDict() for r in make(empty).collect()]
            assert all(r.get("is_rest") or r.get("is_overall") for r in rows)
    with pytest.raises(ValueError):
        reports.forecast(empty, **needs)
