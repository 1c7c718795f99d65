"""Page parsing, the special cases of every field, ranges and quarantine."""

import datetime as dt

import pytest

from palaver.schema import POSTS_COLUMNS
from palaver.sources.pages import (
    accepted,
    extract,
    extract_generic,
    extract_posts,
    quarantined,
    read_packed_pages,
    read_pages,
    write_pages,
)

LIKES = '<a class="reactionsBar-link">{}</a>'


def post(
    body="Text",
    author="Ann",
    post_id="post-7",
    number="#1",
    user='<a class="username" data-user-id="42">Ann</a>',
    time='<time class="u-dt" datetime="2020-05-11T18:22:33+0200"></time>',
    after="",
    content='<div class="message-content">{}</div>',
):
    name = "" if author is None else f' data-author="{author}"'
    return (
        f'<article class="message message--post"{name} data-content="{post_id}">'
        f"{user}<ul><li>a<li>b<li>c<li> {number} </ul>{time}"
        f"{content.format(body)}{after}</article>"
    )


def frame(spark, *posts, page=1, thread="t"):
    html = "<html><body>" + "".join(posts) + "</body></html>"
    return spark.createDataFrame(
        [(thread, page, f"{thread}/{page}", dt.datetime(2024, 1, 1), html)],
        "thread_id string, page_num int, source_path string, ingested_at timestamp, html string",
    )


def read(spark, *args, **kwargs):
    rows = extract_posts(frame(spark, post(*args, **kwargs))).collect()
    assert len(rows) == 1
    return rows[0]


def test_all_columns(spark):
    assert extract_posts(frame(spark, post())).columns == POSTS_COLUMNS
    row = read(spark, "Hallo <b>du</b>da &amp; dort&nbsp;!")
    assert row.post_id == "7" and row.post_num == 1 and row.page_num == 1
    assert row.author == "Ann" and row.author_id == "42"
    assert row.content == "Hallo duda & dort !"
    assert row.words == ["Hallo", "duda", "&", "dort"][:2] + ["dort"]
    assert row.creation_datetime == "2020-05-11T18:22:33+0200"
    assert row.creation_local == dt.datetime(2020, 5, 11, 18, 22, 33)
    assert row.creation_ts.timestamp() == 1589214153


@pytest.mark.parametrize("zone", ["+0200", "+02:00", "Z", "-0330"])
def test_offsets(spark, zone):
    tag = f'<time class="u-dt" datetime="2020-05-11T18:22:33{zone}"></time>'
    row = read(spark, time=tag + '<time class="u-dt" datetime="2021-01-01T00:00:00Z"></time>')
    assert row.creation_local == dt.datetime(2020, 5, 11, 18, 22, 33)
    expected = dt.datetime.fromisoformat(f"2020-05-11T18:22:33{zone}")
    assert row.creation_ts.timestamp() == expected.timestamp()


def test_post_number_with_thousands(spark):
    assert read(spark, number="#1.234").post_num == 1234


@pytest.mark.parametrize("user", ["", '<a class="username">Ann</a>', '<span class="username">'])
def test_author_without_id(spark, user):
    row = read(spark, user=user)
    assert row.author_id == "0" and row.mentioned_list == []


@pytest.mark.parametrize(
    "bar, likes",
    [
        ("", 0),
        (LIKES.format("<bdi>a</bdi>"), 1),
        (LIKES.format("<bdi>a</bdi> und <bdi>b</bdi> 99"), 2),
        (LIKES.format("<bdi>a1</bdi>, <bdi>b2</bdi> und <bdi>c3</bdi>"), 3),
        (LIKES.format("<bdi>a1</bdi>, <bdi>b</bdi>, <bdi>c</bdi> und 5 weitere"), 8),
        (LIKES.format("<bdi>a</bdi>, <bdi>b</bdi>, <bdi>c</bdi> und 1.234 weitere"), 4),
    ],
)
def test_likes(spark, bar, likes):
    assert read(spark, after=bar).like_count == likes


def test_quotes_mentions_spoilers_edits(spark):
    body = (
        '<blockquote class="bbCodeBlock bbCodeBlock--quote" data-quote="Bob">Zitat '
        '<a class="username" data-user-id="8">@c</a><img class="smilie" data-shortname=":a:">'
        "</blockquote>"
        '<blockquote class="bbCodeBlock--quote" data-quote=""></blockquote>'
        "<blockquote>no quote</blockquote>"
        '<a class="username" data-user-id="9">@d</a><a class="username">@e</a>'
        '<div class="bbCodeSpoiler"><div class="bbCodeSpoiler">x</div></div>'
        '<div class="message-lastEdit">edited</div>'
    )
    row = read(spark, body)
    assert row.quote_count == 2 and row.quoted_list == ["Bob", ""]
    assert row.mentioned_list == ["8", "9", "0"] and row.mentions_count == 3
    assert row.spoiler_count == 2 and row.is_edited
    assert row.content == "@d@ex"
    assert row.emoji_count == 0 and row.emoji_frequency_mapping == {}
    assert not read(spark).is_edited


def test_emojis(spark):
    smile = '<img class="smilie smilie--sprite" data-shortname=":s:" alt="x">'
    other = '<img class="smilie" data-shortname=":o:">'
    row = read(spark, f"Hallo {smile}{other} {smile}<img class='big'>")
    assert row.emoji_frequency_mapping == {":s:": 2, ":o:": 1}
    assert list(row.emoji_frequency_mapping) == [":s:", ":o:"]
    assert row.emoji_count == 3 and row.content == "Hallo .. ."
    # A smilie outside of the content counts but adds no text.
    row = read(spark, "Hi", after=smile)
    assert row.emoji_count == 1 and row.content == "Hi"


def test_noise(spark):
    body = (
        "A<p>Ansehen auf</p><p>Ansehen auf <b> </b></p><p>Ansehen auf X</p><script>s</script>"
        "<style>t</style><table><tr><td>u</td></tr></table><button>v</button><!-- w -->"
        "<template>y</template>Z"
    )
    assert read(spark, body).content == "AAnsehen auf XZ"


def test_empty_content_breaks_all_rules(spark):
    row = read(spark, "<blockquote>x</blockquote> ")
    assert row.content == "" and row.words == [] and row.word_count == 0
    assert row.rulebreak_reasons == ["word_count", "first_letter", "punctuation"]
    assert not row.is_rules_compliant


def test_unclosed_and_stray_tags(spark):
    row = read(spark, "<p><b>Eins</i></span><p>Zwei<br>Drei<p/>")
    assert row.content == "EinsZweiDrei"
    rows = extract_posts(frame(spark, post("<div><b>a"), post("b", post_id="post-8"))).collect()
    assert {r.post_id for r in rows} == {"7", "8"}


def test_blank_text_and_empty_attributes(spark):
    body = "a<b>  \t </b>c<i> \n  </i>d<pre>   </pre>e&nbsp;<u> </u>f<!-- -->  <!-- -->g"
    assert read(spark, body).content == "a c\nd   e\xa0 f g"
    row = read(spark, "1 < 2", user="<a class='username' data-user-id>Ann</a>")
    assert row.author_id == "" and row.content == "1 < 2"


def test_class_is_matched_by_token(spark):
    page = post() + '<article class="message-body"></article><article></article>'
    assert extract_posts(frame(spark, page)).count() == 1


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"post_id": "thread-7"}, "post_id"),
        ({"number": "#x"}, "post_num"),
        ({"author": None}, "author"),
        ({"time": ""}, "datetime"),
        ({"time": '<time class="u-dt" datetime="soon">'}, "datetime"),
        ({"content": "<div>{}</div>"}, "content"),
        ({"body": '<blockquote class="bbCodeBlock--quote">x</blockquote>'}, "quote"),
        ({"body": '<img class="smilie">'}, "emoji"),
    ],
)
def test_quarantine(spark, change, problem):
    both = extract(frame(spark, post(post_id="post-1"), post(**change)))
    assert [r.post_id for r in accepted(both).collect()] == ["1"]
    assert [r.problems for r in quarantined(both).collect()] == [[problem]]
    with pytest.raises(Exception, match="unreadable post"):
        accepted(both, strict=True).collect()


def thread(spark, last_post):
    pages = None
    for page in range(1, (last_post + 19) // 20 + 1):
        numbers = range(page * 20 - 19, min(page * 20, last_post) + 1)
        html = [post(post_id=f"post-{n}", number=f"#{n}") for n in numbers]
        one = frame(spark, *html, page=page)
        pages = one if pages is None else pages.union(one)
    return pages


def test_ranges(spark):
    pages = thread(spark, 65)

    def numbers(**kwargs):
        return sorted(r.post_num for r in extract_posts(pages, **kwargs).collect())

    assert numbers() == list(range(1, 66))
    assert numbers(page_range=range(2, 4)) == list(range(21, 61))
    assert numbers(page_range=range(1, 5, 3)) == [*range(1, 21), *range(61, 66)]
    assert numbers(post_range=range(5, 11)) == list(range(5, 11))
    assert numbers(post_range=range(15, 50, 10)) == [15, 25, 35, 45]
    with pytest.raises(ValueError):
        extract_posts(pages, range(1, 2), range(1, 2))


def test_page_files(spark, tmp_path):
    folder = tmp_path / "mein thread+1"
    (folder / "sub9").mkdir(parents=True)
    (folder / "page_0002.html").write_text(post("Zwei ü", number="#21"), "utf-8")
    (folder / "page_0010.html").write_text(post("Zehn\nZeilen", number="#181"), "utf-8")
    (folder / "my page 3-4.html").write_text(post("Drei", number="#41"), "utf-8")
    (folder / "sub9" / "page_0001.html").write_text(post("x"), "utf-8")
    pages = read_pages(spark, str(folder))
    found = {r.page_num: r for r in pages.collect()}
    assert sorted(found) == [2, 3, 10]
    assert {r.thread_id for r in found.values()} == {"mein thread+1"}
    posts = extract_posts(pages).orderBy("page_num").collect()
    assert [p.content for p in posts] == ["Zwei ü", "Drei", "Zehn\nZeilen"]

    packed = str(tmp_path / "packed")
    write_pages(pages, packed)
    again = extract_posts(read_packed_pages(spark, packed)).orderBy("page_num").collect()
    assert [p.content for p in again] == ["Zwei ü", "Drei", "Zehn\nZeilen"]


def test_page_without_number_is_quarantined(spark, tmp_path):
    (tmp_path / "index.html").write_text(post(), "utf-8")
    both = extract(read_pages(spark, str(tmp_path)))
    assert [r.problems for r in quarantined(both).collect()] == [["page_num"]]


def test_generic_outline(spark):
    html = "<p>a <a href=x>b</a><script><a></script><table><p><a>c</a></table><p>d"
    df = spark.createDataFrame([(5, html), (6, None)], "page_id long, html string")
    rows = {r.page_id: r for r in extract_generic(df).collect()}
    assert (rows[5].text, rows[5].links, rows[5].paragraphs) == ("a bd", 1, 2)
    assert (rows[6].text, rows[6].links) == ("", 0)


def test_pages_outside_the_range_are_not_read(spark, tmp_path):
    """Extraction shuffles nothing, and files outside the range stay closed."""
    for n in range(1, 6):
        (tmp_path / f"page_{n}.html").write_text(post(number=f"#{20 * n}"), "utf-8")
    pages = read_pages(spark, str(tmp_path))
    for df in (
        extract_posts(pages, page_range=range(2, 4)),
        extract_posts(pages, post_range=range(25, 61)),
    ):
        plan = df._jdf.queryExecution().executedPlan()
        assert "Exchange" not in plan.toString()
        assert df.count() == 2
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        metrics = plan.collectLeaves().head().metrics()
        assert metrics.apply("numFiles").value() == 2
