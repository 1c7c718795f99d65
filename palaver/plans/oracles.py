"""SQL counterparts of the catalog for DuckDB, written without the Spark code.

The common table expressions define the same views of the supplied tables;
``_sql`` puts those a query names in front of it.
"""

from __future__ import annotations

import re

import regex

ORACLES: dict[str, str] = {}

# --- fixed values: what separates words or ends a sentence, what is stripped ---
_PUNCTUATION = ".?!\"„“‚‘»«‹›,;:'’–—‐-·/()[]<>{}…☞‽¡¿⸘、"
_UNSEEN = [ord(c) for c in "\u034f\u115f\u1160\u17b4\u17b5 "]
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_INFORMATION_SEPARATORS = [*range(0x1C, 0x20)]
# ------------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in_class(codes) -> str:
    return "".join(f"\\x{{{c:x}}}" for c in codes)


def _characters(codes) -> str:
    return "||".join(f"chr({c})" for c in codes)


# Emojis on their own: no key-cap bases, no regional indicators.
_EMOJIS = [
    c for c in range(0x80, 0x20000) if not 0x1F1E6 <= c < 0x1F200 and regex.match(r"\p{Emoji}", chr(c))
]
_ENDS = [ord(c) for c in _PUNCTUATION]
_SEPARATORS = _text(f"[{_in_class(_BLANKS + _ENDS)}]")
_WORD = r"'[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]'"
_STRIP = _characters(_BLANKS + _INFORMATION_SEPARATORS)
_STRIP_MORE = _characters(_UNSEEN)
_LAST = _text(f"[{_in_class([*_ENDS, ord(chr(92)), *_EMOJIS])}]")

VIEWS = {
    "doc_text": f"""
        SELECT doc_id + 1 AS post_num, CAST(ceil((doc_id + 1) / 20) AS BIGINT) AS page_num,
               lang AS thread_id, source AS author, trim(text, {_STRIP}) AS content,
               TIMESTAMP '2020-01-01' + to_hours(6 * doc_id) AS creation_local
        FROM documents""",
    "doc_words": f"""
        SELECT *, trim(content, {_STRIP_MORE}) AS stripped,
               list_filter(string_split_regex(content, {_SEPARATORS}),
                           lambda w: regexp_matches(w, {_WORD})) AS words
        FROM doc_text""",
    "doc_rules": f"""
        SELECT *, len(words) AS word_count,
               stripped <> '' AND len(words) >= 5 AS enough_words,
               stripped <> '' AND regexp_matches(regexp_extract(stripped, '\\p{{L}}'), '^\\p{{Lu}}$')
                   AS capital,
               stripped <> '' AND regexp_matches(right(stripped, 1), {_LAST}) AS ended
        FROM doc_words""",
    "doc": """
        SELECT *, enough_words AND capital AND ended AS is_rules_compliant,
               concat_ws(',', CASE WHEN NOT enough_words THEN 'word_count' END,
                         CASE WHEN NOT capital THEN 'first_letter' END,
                         CASE WHEN NOT ended THEN 'punctuation' END) AS reasons
        FROM doc_rules""",
    "doc_authors": """
        SELECT author, count(*) AS messages, CAST(sum(word_count) AS BIGINT) AS words,
               count(*) FILTER (NOT is_rules_compliant) AS violations,
               min(post_num) AS first_post
        FROM doc GROUP BY author""",
    "doc_thread_authors": """
        SELECT thread_id, author, count(*) AS messages, CAST(sum(word_count) AS BIGINT) AS words,
               count(*) FILTER (NOT is_rules_compliant) AS violations,
               min(post_num) AS first_post
        FROM doc GROUP BY thread_id, author""",
    "evt": """
        SELECT event_id + 1 AS post_num, CAST(ceil((event_id + 1) / 20) AS BIGINT) AS page_num,
               'user' || user_id AS author, CAST(user_id AS VARCHAR) AS author_id,
               ts AS creation_local, CAST(floor(value) AS BIGINT) AS word_count,
               CASE WHEN event_type = 'click'
                    THEN [json_extract_string(props, '$.k'), CAST(event_id % 150 AS VARCHAR)]
                    ELSE CAST([] AS VARCHAR[]) END AS mentioned_list,
               CASE WHEN event_type = 'view' THEN ['user' || json_extract_string(props, '$.k')]
                    WHEN event_type = 'purchase' THEN ['']
                    ELSE CAST([] AS VARCHAR[]) END AS quoted_list
        FROM events""",
    "mentions": """
        SELECT post_num, unnest(mentioned_list) AS who,
               generate_subscripts(mentioned_list, 1) - 1 AS pos FROM evt""",
    "quotes": """
        SELECT post_num, unnest(quoted_list) AS who,
               generate_subscripts(quoted_list, 1) - 1 AS pos FROM evt""",
    "mentioned": """
        SELECT who, count(*) AS times, min({'post': post_num, 'pos': pos}) AS first_seen
        FROM mentions WHERE who NOT IN ('0', '') GROUP BY who""",
    "quoted": """
        SELECT who, count(*) AS times, min({'post': post_num, 'pos': pos}) AS first_seen
        FROM quotes WHERE who NOT IN ('0', '') GROUP BY who""",
    "emo_posts": """
        SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) + 1 AS post_num,
               'user' || user_id AS author FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "emo_counts": """
        SELECT user_id, CAST(ts AS DATE) AS day, event_type AS emoji, count(*) AS n
        FROM events GROUP BY user_id, CAST(ts AS DATE), event_type""",
    "emo": """
        SELECT p.post_num, p.author, c.emoji, c.n,
               {'post': p.post_num, 'pos':
                 row_number() OVER (PARTITION BY p.post_num, p.author ORDER BY c.emoji) - 1} AS seen
        FROM emo_posts p JOIN emo_counts c ON p.user_id = c.user_id AND p.day = c.day""",
    "emo_freq": """
        SELECT emoji, CAST(sum(n) AS BIGINT) AS count, min(seen) AS first_seen
        FROM emo GROUP BY emoji""",
    "emo_authors": """
        SELECT author, CAST(sum(n) AS BIGINT) AS total, min(post_num) AS first_post
        FROM emo GROUP BY author""",
    "emo_top": """
        SELECT * FROM emo_authors ORDER BY total DESC, first_post, author LIMIT 10""",
    "emo_used": """
        SELECT e.*, t.total, t.first_post FROM emo e JOIN emo_top t ON e.author = t.author""",
    "ord": """
        SELECT o_orderpriority AS thread_id, o_orderkey + 1 AS post_num,
               'c' || o_custkey AS author, o_orderdate AS creation_local,
               CAST(floor(o_totalprice) AS BIGINT) AS word_count, year(o_orderdate) AS year
        FROM orders""",
    "ord_years": """
        SELECT CAST(unnest(generate_series(min(year), max(year))) AS BIGINT) AS year FROM ord""",
    "ord_author_years": """
        SELECT year, author, count(*) AS messages, CAST(sum(word_count) AS BIGINT) AS words,
               min(post_num) AS first_post FROM ord GROUP BY year, author""",
    "ord_per_year": """
        SELECT y.year, count(DISTINCT o.author) AS authors, count(o.post_num) AS messages
        FROM ord_years y LEFT JOIN ord o ON y.year = o.year GROUP BY y.year""",
    "ord_thread_years": """
        SELECT thread_id, CAST(unnest(generate_series(min(year), max(year))) AS BIGINT) AS year
        FROM ord GROUP BY thread_id""",
    "char_rows": """
        SELECT post_num, unnest(string_split(array_to_string(words, ''), '')) AS char
        FROM doc_words WHERE len(words) > 0""",
    "word_rows": "SELECT post_num, unnest(words) AS word FROM doc_words",
    "known_pages": "SELECT DISTINCT author AS thread_id, page_num FROM doc_text",
    "newest_pages": """
        SELECT thread_id, max(page_num) AS newest FROM known_pages GROUP BY thread_id""",
    "forum": """
        SELECT CAST(conv_id AS VARCHAR) AS thread_id, turn, turn + 1 AS post_num,
               role, conv_id, TIMESTAMP '2020-05-11' + to_minutes(conv_id) + to_seconds(turn)
                 AS creation_local,
               CASE WHEN role = 'system' THEN '1' WHEN role = 'user' THEN '2' ELSE '3' END
                 AS author_id,
               trim(text || repeat('.', (turn % 3 + turn % 2)::INT), """
    + _STRIP
    + """) AS content
        FROM conversations""",
    "forum_words": f"""
        SELECT *, trim(content, {_STRIP_MORE}) AS stripped,
               list_filter(string_split_regex(content, {_SEPARATORS}),
                           lambda w: regexp_matches(w, {_WORD})) AS words FROM forum""",
    "long_words": """
        SELECT * REPLACE ('long' || conv_id % 2 AS thread_id, conv_id // 2 * 33 + turn + 1 AS post_num)
        FROM forum_words""",
    "ord_period": """
        SELECT * FROM ord WHERE creation_local BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-06-30 12:00:00'""",
    "evt_page_period": "SELECT * FROM evt WHERE page_num BETWEEN 10 AND 40",
    "evt_time_period": """
        SELECT * FROM evt WHERE creation_local BETWEEN TIMESTAMP '2024-01-03'
                                               AND TIMESTAMP '2024-01-17 14:00:00'""",
}


def _rate(period: str) -> str:
    return f"""
        SELECT count(*) AS posts,
               CAST(floor((epoch_us(max(creation_local)) - epoch_us(min(creation_local)))
                          / 1000000) AS BIGINT) AS seconds,
               max(creation_local) AS end_ts FROM {period}"""


def _outlook(period: str) -> str:
    return f"""
        SELECT *, (SELECT 3 * count(*) - count(*) FROM evt) / posts_per_day AS days
        FROM (SELECT *, posts / seconds * 86400 AS posts_per_day FROM ({_rate(period)}))"""


def _outlook_row(period: str) -> str:
    return f"""
        SELECT posts, seconds, strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_local,
               posts_per_day, days,
               strftime(end_ts + to_seconds(CAST(floor(days * 86400) AS BIGINT)),
                        '%Y-%m-%d %H:%M:%S') AS eta
        FROM ({_outlook(period)})"""


def _histogram(period: str) -> str:
    return f"""
        SELECT d.day, count(p.post_num) AS posts
        FROM (SELECT CAST(unnest(generate_series(min(CAST(creation_local AS DATE)),
                     max(CAST(creation_local AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
              FROM {period}) d
        LEFT JOIN {period} p ON CAST(p.creation_local AS DATE) = d.day GROUP BY d.day"""


def _series(period: str) -> str:
    return f"""
        SELECT strftime(day, '%Y-%m-%d') AS day, CAST(posts AS DOUBLE) AS posts,
               false AS is_forecast FROM ({_histogram(period)})
        UNION ALL
        SELECT strftime(CAST(end_ts AS DATE) + CAST(ahead AS INT), '%Y-%m-%d'), posts_per_day, true
        FROM (SELECT end_ts, posts_per_day,
                     unnest(generate_series(1, CAST(ceil(days) AS BIGINT))) AS ahead
              FROM ({_outlook(period)}))"""


def _sql(name: str, body: str) -> None:
    """Register a query, preceded by the views it uses, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b(FROM|JOIN)\s+{view}\b", text):
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(body)
    parts = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    ORACLES[name] = (f"WITH {parts}\n" if parts else "") + body.strip()


_SEEN = "first_seen.post AS seen_post, first_seen.pos AS seen_pos"
_FACTS = """
    SELECT thread_id, CAST(post_num - 1 AS VARCHAR) AS post_id, post_num, page_num, author,
           regexp_extract(author, '[0-9]+') AS author_id,
           strftime(creation_local, '%Y-%m-%dT%H:%M:%S+0000') AS creation_datetime, content,
           post_num % 7 AS like_count, post_num % 3 AS quote_count,
           CASE post_num % 3 WHEN 1 THEN author WHEN 2 THEN author || '|x' END AS quoted_list,
           post_num % 5 AS spoiler_count,
           CASE WHEN post_num % 2 = 0 THEN CAST(2 AS BIGINT) ELSE 0 END AS mentions_count,
           CASE WHEN post_num % 2 = 0 THEN author || '|x' ELSE '' END AS mentioned_list,
           word_count, array_to_string(words, '|') AS words, post_num % 4 AS emoji_count,
           ':a:=' || post_num % 4 AS emoji_frequency_mapping, post_num % 11 = 0 AS is_edited,
           is_rules_compliant, replace(reasons, ',', '|') AS rulebreak_reasons,
           epoch_us(creation_local) // 1000000 AS creation_ts,
           strftime(creation_local, '%Y-%m-%d %H:%M:%S') AS creation_local,
           post_num AS ingested_at, thread_id || '/' || page_num AS source_path FROM doc"""
_AUTHOR_TABLE = """
    SELECT author, messages, violations, violations / messages * 100 AS violation_pct,
           violations / messages AS violation_rate, first_post FROM doc_authors"""


def _shares(stats: str, metric: str, n: int, total: str, keys: str = "", years: str = "") -> str:
    """Top n and rest; ``keys`` like ``thread_id, `` and the table of all groups."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    using = keys.rstrip(", ")
    groups = years or (f"(SELECT DISTINCT {using} FROM {stats})" if keys else "(SELECT 1 AS one)")
    join = f"LEFT JOIN totals USING ({using})" if keys else "CROSS JOIN totals"
    join_top = f"LEFT JOIN sums USING ({using})" if keys else "CROSS JOIN sums"
    top_join = f"JOIN totals USING ({using})" if keys else "CROSS JOIN totals"
    group = f"GROUP BY {using}" if keys else ""
    rank = ", r AS rank" if keys else ""
    return f"""
    SELECT * FROM (
      WITH ranked AS (SELECT *, row_number() OVER ({part} ORDER BY {metric} DESC, first_post, author) AS r
                      FROM {stats}),
           totals AS (SELECT {keys}CAST({total} AS BIGINT) AS total, min(first_post) AS first
                      FROM {stats} {group}),
           sums AS (SELECT {keys}CAST(sum({metric}) AS BIGINT) AS shown FROM ranked WHERE r <= {n} {group})
      SELECT {keys}author, {metric} AS amount, {metric} / total AS share, false AS is_rest, first_post{rank}
      FROM ranked {top_join} WHERE r <= {n}
      UNION ALL
      SELECT {keys}'Rest', coalesce(total, 0) - coalesce(shown, 0),
             CASE WHEN coalesce(total, 0) = 0 THEN 1.0
                  ELSE (total - coalesce(shown, 0)) / total END, true, first{", NULL" if keys else ""}
      FROM {groups} {join} {join_top})"""


# --- sources and sinks
_sql("src_html_pages", """
    SELECT thread_id, (post_num + 19) // 20 AS page_num, count(*) AS posts
    FROM forum GROUP BY thread_id, (post_num + 19) // 20""")
_sql("src_posts", _FACTS)
_sql("sink_posts", _FACTS)
_sql("sink_report", _AUTHOR_TABLE)
_sql("concat_parts", """
    SELECT post_num, author, thread_id FROM doc_text""")
_sql("sort_posts", "SELECT post_num, author FROM doc_text")

# --- extraction
_EXTRACTED = f"""
    SELECT thread_id, post_num, (post_num + 19) // 20 AS page_num,
           CAST(conv_id * 100 + turn AS VARCHAR) AS post_id, role AS author, author_id,
           strftime(creation_local, '%Y-%m-%dT%H:%M:%S') || '+0200' AS creation_datetime,
           strftime(creation_local, '%Y-%m-%d %H:%M:%S') AS creation_local,
           epoch_us(creation_local) // 1000000 - 7200 AS epoch, content,
           CASE WHEN turn > 3 THEN 3 + turn ELSE turn END AS like_count,
           CAST(turn > 0 AS BIGINT) AS quote_count, turn % 2 AS spoiler_count,
           CAST(turn > 0 AS BIGINT) + turn % 2 AS mentions_count, len(words) AS word_count,
           turn % 3 + turn % 2 AS emoji_count, turn = 2 AS is_edited,
           stripped <> '' AND len(words) >= 5
             AND regexp_matches(regexp_extract(stripped, '\\p{{L}}'), '^\\p{{Lu}}$')
             AND regexp_matches(right(stripped, 1), {_LAST}) AS is_rules_compliant
    FROM """
_sql("extract_posts", _EXTRACTED + "forum_words")
_sql("extract_long_threads", _EXTRACTED + "long_words")
_sql("extract_page_range", f"""
    SELECT * FROM ({_EXTRACTED}long_words) WHERE page_num BETWEEN 3 AND 999999 AND page_num % 2 = 1""")
_sql("extract_post_range", f"""
    SELECT * FROM ({_EXTRACTED}long_words) WHERE post_num BETWEEN 30 AND 9999999 AND (post_num - 30) % 7 = 0""")
_sql("extract_lists", """
    SELECT thread_id, post_num, 'user' AS item, 'quote' AS kind, CAST(1 AS BIGINT) AS n
    FROM forum WHERE turn > 0
    UNION ALL SELECT thread_id, post_num, '2', 'mention', 1 FROM forum WHERE turn > 0
    UNION ALL SELECT thread_id, post_num, '0', 'mention', 1 FROM forum WHERE turn % 2 = 1
    UNION ALL SELECT thread_id, post_num, ':smile:', 'emoji', turn % 3 FROM forum WHERE turn % 3 > 0
    UNION ALL SELECT thread_id, post_num, ':joy:', 'emoji', 1 FROM forum WHERE turn % 2 = 1""")
_sql("extract_generic", """
    SELECT page_id, len(regexp_extract_all(body, '<a[ >]')) AS links,
           len(regexp_extract_all(body, '<p[ >]')) AS paragraphs
    FROM (SELECT page_id, regexp_replace(html,
            '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<table.*?</table>'
            || '|<blockquote.*?</blockquote>|<button.*?</button>', '', 'g') AS body FROM pages)""")

# --- text and row-level functions
_sql("split_words", "SELECT post_num, array_to_string(words, '|') AS words FROM doc_words")
_sql("word_count", "SELECT post_num, word_count FROM doc_rules")
_sql("strip_content", "SELECT post_num, stripped FROM doc_words")
_sql("rule_word_count", "SELECT post_num, enough_words AS kept FROM doc_rules")
_sql("rule_first_letter", "SELECT post_num, capital AS kept FROM doc_rules")
_sql("rule_punctuation", "SELECT post_num, ended AS kept FROM doc_rules")
_sql("rulebreak_reasons", "SELECT post_num, reasons FROM doc")
_sql("is_rules_compliant", "SELECT post_num, is_rules_compliant FROM doc")
_sql("page_of_post", "SELECT post_num, (post_num + 19) // 20 AS page FROM evt")
_sql("page_post_bounds", """
    SELECT DISTINCT page_num, page_num * 20 - 19 AS first_post, page_num * 20 AS last_post FROM evt""")
_sql("page_from_url", """
    SELECT page_id, CASE WHEN url LIKE '%/' THEN 1
           ELSE TRY_CAST(regexp_extract(url, '[0-9]+$') AS BIGINT) END AS page FROM pages""")
_sql("url_for_page", """
    SELECT page_id, 'https://forum.example/threads/t.1/page-' || (page_id + 1) || '/' AS url,
           page_id + 1 AS page FROM pages""")
_sql("year_of", "SELECT post_num, year FROM ord")
_sql("epoch_of", "SELECT post_num, epoch_us(creation_local) // 1000000 AS epoch FROM evt")
_sql("shortcode_to_emoji", """
    SELECT CASE emoji WHEN 'click' THEN chr(128433) WHEN 'view' THEN chr(128064)
           WHEN 'purchase' THEN chr(128722) ELSE emoji END AS emoji, count FROM emo_freq""")

# --- selections
_sql("filter_page_range", """
    SELECT post_num, page_num FROM evt
    WHERE page_num >= 3 AND page_num < 400 AND (page_num - 3) % 7 = 0""")
_sql("filter_post_range", """
    SELECT post_num, page_num FROM evt
    WHERE post_num >= 50 AND post_num < 5000 AND (post_num - 50) % 3 = 0""")
_sql("filter_page_span", "SELECT post_num, page_num FROM evt WHERE page_num BETWEEN 3 AND 395")
_sql("filter_post_span", "SELECT post_num, page_num FROM evt WHERE post_num BETWEEN 50 AND 4997")
_sql("filter_author", "SELECT post_num, author FROM doc_text WHERE author = 'src7'")
_sql("filter_time_range", "SELECT post_num FROM evt_time_period")
_sql("filter_year", "SELECT post_num, author FROM ord WHERE year = 1997")
_sql("filter_violations", "SELECT post_num, author FROM doc WHERE NOT is_rules_compliant")
_sql("having_min_messages", """
    SELECT author, messages, first_post FROM doc_authors WHERE messages >= 50""")
_sql("filter_unknown", """
    SELECT post_num, who FROM mentions WHERE who NOT IN ('0', '')
    UNION ALL SELECT post_num, who FROM quotes WHERE who NOT IN ('0', '')""")
_sql("filter_chars", """
    SELECT char, count(*) AS count FROM char_rows
    WHERE contains('aeiouäöü', lower(char)) GROUP BY char""")

# --- joins
_sql("lookup_author_name", """
    SELECT i.who AS user_id, coalesce(n.name, i.who) AS name
    FROM (SELECT DISTINCT who FROM mentions) i
    LEFT JOIN (SELECT author_id, arg_min(author, post_num) AS name FROM evt
               WHERE author_id <> '0' GROUP BY author_id) n ON n.author_id = i.who""")
_sql("frontier_pages", """
    SELECT thread_id, page_num
    FROM (SELECT thread_id, newest, unnest(generate_series(1, newest + 5)) AS page_num
          FROM newest_pages) p
    WHERE page_num = newest OR NOT EXISTS (
      SELECT 1 FROM known_pages k WHERE k.thread_id = p.thread_id AND k.page_num = p.page_num)""")
_sql("frontier_pages_newest", """
    SELECT thread_id, unnest(generate_series(newest, newest + 5)) AS page_num FROM newest_pages""")

# --- aggregates
_sql("total_messages", "SELECT count(*) AS messages FROM doc_text")
_sql("total_words", "SELECT CAST(sum(word_count) AS BIGINT) AS words FROM doc_rules")
_sql("words_per_message", """
    SELECT count(*) AS messages, CAST(sum(word_count) AS BIGINT) AS words,
           sum(word_count) / count(*) AS words_per_message FROM doc_rules""")
_sql("words_per_message_by_thread", """
    SELECT thread_id, count(*) AS messages, CAST(sum(word_count) AS BIGINT) AS words,
           sum(word_count) / count(*) AS words_per_message FROM doc_rules GROUP BY thread_id""")
_sql("distinct_authors", "SELECT count(DISTINCT author) AS authors FROM evt")
_sql("distinct_authors_by_thread", """
    SELECT thread_id, count(DISTINCT author) AS authors FROM ord GROUP BY thread_id""")
_sql("list_authors", """
    SELECT author, min(post_num) AS first_post FROM evt GROUP BY author""")
_sql("span_bounds", """
    SELECT year(min(creation_local)) AS first_year, year(max(creation_local)) AS last_year,
           epoch_us(min(creation_local)) // 1000000 AS first_timestamp,
           epoch_us(max(creation_local)) // 1000000 AS last_timestamp FROM evt""")
_sql("messages_by_author", "SELECT author, messages, first_post FROM doc_authors")
_sql("words_by_author", "SELECT author, words, first_post FROM doc_authors")
_sql("words_per_message_by_author", """
    SELECT author, messages, words, words / messages AS words_per_message, first_post
    FROM doc_authors""")
_sql("violations_by_author", "SELECT author, violations, first_post FROM doc_authors")
_sql("violation_rate_by_author", """
    SELECT author, messages, violations, violations / messages AS violation_rate, first_post
    FROM doc_authors""")
_sql("messages_with_mention_by_author", """
    SELECT author, count(*) AS messages, min(post_num) AS first_post FROM evt
    WHERE len(mentioned_list) > 0 GROUP BY author""")
_sql("messages_with_quote_by_author", """
    SELECT author, count(*) AS messages, min(post_num) AS first_post FROM evt
    WHERE len(quoted_list) > 0 GROUP BY author""")
_sql("emojis_by_author", "SELECT author, total AS emojis, first_post FROM emo_authors")
_sql("total_emojis", "SELECT count(*) AS total FROM events")
_sql("authors_per_year", "SELECT year, authors, messages FROM ord_per_year")
_sql("messages_per_author_per_year", """
    SELECT y.thread_id, y.year, count(DISTINCT o.author) AS authors,
           count(o.post_num) AS messages,
           count(o.post_num) / nullif(count(DISTINCT o.author), 0) AS messages_per_author
    FROM ord_thread_years y LEFT JOIN ord o ON y.thread_id = o.thread_id AND y.year = o.year
    GROUP BY y.thread_id, y.year""")
_sql("overall_plus_groups", """
    SELECT author, false AS is_overall, messages, words, first_post,
           words / messages AS words_per_message FROM doc_authors
    UNION ALL
    SELECT 'Gesamt', true, count(*), CAST(sum(word_count) AS BIGINT), min(post_num),
           sum(word_count) / count(*) FROM doc_rules""")
_sql("mean", "SELECT avg(word_count) AS mean FROM doc_rules")

# --- arrays and maps
_sql("used_emojis", f"SELECT emoji, {_SEEN} FROM emo_freq")
_sql("emoji_frequency", f"SELECT emoji, count, {_SEEN} FROM emo_freq")
_sql("emoji_map_by_author", f"""
    SELECT author, emoji, n, {_SEEN}
    FROM (SELECT author, emoji, CAST(sum(n) AS BIGINT) AS n, min(seen) AS first_seen
          FROM emo GROUP BY author, emoji)""")
_sql("merge_maps", """
    SELECT post_num, author, emoji, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT post_num, author, emoji, n FROM emo
          UNION ALL SELECT post_num, author, 'error', 1 FROM emo_posts
          UNION ALL SELECT post_num, author, 'other', 2 FROM emo_posts)
    GROUP BY post_num, author, emoji""")
_sql("sum_map_values", """
    SELECT post_num, author, CAST(sum(n) AS BIGINT) AS total FROM emo GROUP BY post_num, author""")
_sql("times_mentioned", f"SELECT who AS user_id, times, {_SEEN} FROM mentioned")
_sql("times_quoted", f"SELECT who AS user_name, times, {_SEEN} FROM quoted")
_sql("char_counts_all", """
    SELECT char, count(*) AS count, min(post_num) AS first_post FROM char_rows GROUP BY char""")
_sql("char_counts_first", """
    SELECT left(word, 1) AS char, count(*) AS count, min(post_num) AS first_post
    FROM word_rows GROUP BY left(word, 1)""")
_sql("char_counts_last", """
    SELECT right(word, 1) AS char, count(*) AS count, min(post_num) AS first_post
    FROM word_rows GROUP BY right(word, 1)""")

# --- ranking
_sql("yearly_top_n", """
    SELECT year, author, messages, words, first_post,
           row_number() OVER (PARTITION BY year ORDER BY words DESC, first_post, author) AS rank
    FROM ord_author_years QUALIFY rank <= 10""")
_sql("yearly_top_n_large", """
    SELECT year, author, messages, words, first_post,
           row_number() OVER (PARTITION BY year ORDER BY messages DESC, first_post, author) AS rank
    FROM ord_author_years QUALIFY rank <= 1200""")
_sql("share_of_total", """
    SELECT year, author, messages, messages / sum(messages) OVER (PARTITION BY year) * 100 AS share
    FROM ord_author_years""")
_sql("top_n", """
    SELECT author, messages, first_post FROM doc_authors
    ORDER BY messages DESC, first_post, author LIMIT 5""")
_sql("top_n_with_rest", _shares("doc_authors", "words", 5, "sum(words)"))

# --- reports
_sql("rep_author_table", _AUTHOR_TABLE)
_sql("rep_author_table_by_thread", """
    SELECT thread_id, author, messages, violations, violations / messages * 100 AS violation_pct,
           violations / messages AS violation_rate, first_post FROM doc_thread_authors""")
_sql("rep_violation_table", _AUTHOR_TABLE + " WHERE messages >= 50")
_sql("rep_emoji_table", f"SELECT emoji, count, {_SEEN} FROM emo_freq")
_sql("rep_top_share", _shares("doc_authors", "messages", 10, "sum(messages)"))
_sql("rep_top_share_words_by_thread",
     _shares("doc_thread_authors", "words", 3, "sum(words)", "thread_id, "))
_sql("rep_yearly_top_share", f"""
    SELECT year, rank, author, amount, share * 100 AS pct, is_rest, first_post
    FROM ({_shares("ord_author_years", "messages", 10, "sum(messages)", "year, ", "ord_years")})""")
VIEWS["ord_thread_author_years"] = """
        SELECT thread_id, year, author, CAST(sum(word_count) AS BIGINT) AS words,
               min(post_num) AS first_post FROM ord GROUP BY thread_id, year, author"""
_sql("rep_yearly_top_share_words_by_thread", f"""
    SELECT thread_id, year, rank, author, amount, share * 100 AS pct, is_rest, first_post
    FROM ({_shares("ord_thread_author_years", "words", 5, "sum(words)", "thread_id, year, ",
                   "ord_thread_years")})""")
_sql("rep_emoji_share", f"""
    SELECT emoji, count, count / (SELECT count(*) FROM events) AS share, {_SEEN}
    FROM emo_freq ORDER BY count DESC, first_seen, emoji LIMIT 3""")
_sql("rep_emoji_share_first_seen", f"""
    SELECT emoji, count, count / (SELECT count(*) FROM events) AS share, {_SEEN}
    FROM emo_freq ORDER BY first_seen, emoji LIMIT 3""")
_sql("rep_emoji_distribution", """
    SELECT u.author, u.total, u.first_post, coalesce(s.emoji, 'Andere') AS emoji,
           s.emoji IS NULL AS is_others, CAST(sum(u.n) AS BIGINT) AS n,
           min(u.seen).post AS seen_post, min(u.seen).pos AS seen_pos
    FROM emo_used u
    LEFT JOIN (SELECT emoji FROM emo_used GROUP BY emoji
               ORDER BY sum(n) DESC, min(seen), emoji LIMIT 3) s ON u.emoji = s.emoji
    GROUP BY u.author, u.total, u.first_post, s.emoji""")
_sql("rep_emoji_distribution_all", """
    SELECT author, total, first_post, emoji, false AS is_others, CAST(sum(n) AS BIGINT) AS n,
           min(seen).post AS seen_post, min(seen).pos AS seen_pos
    FROM emo_used GROUP BY author, total, first_post, emoji""")
_sql("rep_top_mentioned", f"""
    SELECT t.who AS user_id, coalesce(n.name, t.who) AS name, t.times, {_SEEN}
    FROM (SELECT * FROM mentioned ORDER BY times DESC, first_seen LIMIT 10) t
    LEFT JOIN (SELECT author_id, arg_min(author, post_num) AS name FROM evt GROUP BY author_id) n
      ON n.author_id = t.who""")
_sql("rep_top_mentioners", """
    SELECT author, count(*) AS messages, min(post_num) AS first_post FROM evt
    WHERE len(mentioned_list) > 0 GROUP BY author ORDER BY messages DESC, first_post LIMIT 10""")
_sql("rep_top_quoted", f"""
    SELECT who AS user_name, times, {_SEEN} FROM quoted ORDER BY times DESC, first_seen LIMIT 10""")
_sql("rep_top_quoters", """
    SELECT author, count(*) AS messages, min(post_num) AS first_post FROM evt
    WHERE len(quoted_list) > 0 GROUP BY author ORDER BY messages DESC, first_post LIMIT 10""")
_sql("rep_authors_per_year", "SELECT year, authors FROM ord_per_year")
_sql("rep_messages_per_author_per_year", """
    SELECT year, messages / nullif(authors, 0) AS messages_per_author FROM ord_per_year""")
_sql("rep_words_per_message", """
    SELECT * FROM (SELECT author, words / messages AS words_per_message, false AS is_overall,
                          first_post FROM doc_authors
                   ORDER BY words_per_message DESC, first_post, author LIMIT 10)
    UNION ALL
    SELECT 'Gesamt', sum(word_count) / count(*), true, min(post_num) FROM doc_rules""")
_sql("rep_letters", """
    SELECT lower(char) AS char, count(*) AS count, min(post_num) AS first_post FROM char_rows
    WHERE contains('abcdefghijklmnopqrstuvwxyzäöüß', lower(char)) GROUP BY lower(char)""")
_sql("rep_letters_first_any", """
    SELECT left(word, 1) AS char, count(*) AS count, min(post_num) AS first_post
    FROM word_rows GROUP BY left(word, 1)""")
_MARKUP_TABLE = """
    SELECT '[TR][TD]' || author || '[/TD][TD]' || messages || '[/TD][TD]' || violations
           || '[/TD][TD]' || CAST(violations / messages * 100 AS VARCHAR) || '%[/TD][/TR]' AS line
    FROM doc_authors WHERE messages >= {n}
    UNION ALL SELECT '[TABLE=full][TR][TD]Spieler[/TD][TD]Anzahl Beiträge[/TD]'
           || '[TD]Anzahl nicht regelkonformer Beiträge[/TD]'
           || '[TD]Prozentanzahl nicht regelkonformer Beiträge[/TD][/TR]'
    UNION ALL SELECT '[/TABLE]'"""
_sql("fmt_markup_table", _MARKUP_TABLE.format(n=0))
_sql("fmt_markup_violations", _MARKUP_TABLE.format(n=50))
_sql("fmt_markup_table_emojis", """
    SELECT '[TR][TD]' || emoji || '[/TD][TD]' || count || '[/TD][/TR]' AS line FROM emo_freq
    UNION ALL SELECT '[TABLE=full][TR][TD]Emoji[/TD][TD]Anzahl[/TD][/TR]'
    UNION ALL SELECT '[/TABLE]'""")

# --- forecast
_sql("period_select", "SELECT post_num FROM evt_page_period")
_sql("posting_rate", """
    SELECT posts, seconds, strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_local,
           posts / seconds * 86400 AS posts_per_day
    FROM (""" + _rate("(SELECT * FROM evt WHERE post_num BETWEEN 100 AND 4000)") + ")")
_sql("days_to_goal", _outlook_row("evt_time_period"))
_sql("daily_histogram", f"SELECT strftime(day, '%Y-%m-%d') AS day, posts FROM ({_histogram('evt')})")
_sql("forecast_series", _series("evt_page_period"))
_sql("rep_forecast", _series("evt_time_period"))
_sql("rep_forecast_by_thread", """
    SELECT thread_id, strftime(day, '%Y-%m-%d') AS day, CAST(count(p.post_num) AS DOUBLE) AS posts, false AS is_forecast
    FROM (SELECT thread_id, CAST(unnest(generate_series(CAST(min(creation_local) AS DATE), CAST(max(creation_local) AS DATE),
                 INTERVAL 1 DAY)) AS DATE) AS day FROM ord_period GROUP BY thread_id) d
    LEFT JOIN ord_period p USING (thread_id) WHERE p.post_num IS NOT NULL AND CAST(p.creation_local AS DATE) = day
    GROUP BY thread_id, day
    UNION ALL
    SELECT thread_id, strftime(day, '%Y-%m-%d'), 0.0, false
    FROM (SELECT thread_id, CAST(unnest(generate_series(CAST(min(creation_local) AS DATE), CAST(max(creation_local) AS DATE),
                 INTERVAL 1 DAY)) AS DATE) AS day FROM ord_period GROUP BY thread_id)
    WHERE (thread_id, day) NOT IN (SELECT thread_id, CAST(creation_local AS DATE) FROM ord_period)
    UNION ALL
    SELECT thread_id, strftime(CAST(end_ts AS DATE) + CAST(ahead AS INT), '%Y-%m-%d'), rate, true
    FROM (SELECT thread_id, end_ts, rate, unnest(generate_series(1, CAST(ceil(2 * total / rate) AS BIGINT))) AS ahead
          FROM (SELECT thread_id, max(creation_local) AS end_ts, any_value(total) AS total,
                       count(*) / CAST(floor((epoch_us(max(creation_local)::TIMESTAMP) - epoch_us(min(creation_local)::TIMESTAMP)) / 1000000)
                                       AS BIGINT) * 86400 AS rate
                FROM ord_period JOIN (SELECT thread_id, count(*) AS total FROM ord GROUP BY thread_id) USING (thread_id)
                GROUP BY thread_id))""")
_sql("rep_forecast_problems", """
    SELECT thread_id, CASE WHEN thread_id < '3' THEN 'the goal of ' || count(*) || ' is already reached'
                           ELSE 'the period must end in 2..' || count(*) END AS problem
    FROM ord GROUP BY thread_id""")
_sql("rep_forecast_summary", _outlook_row("evt_page_period"))

# --- incremental ingest
_sql("ingest_incremental", "SELECT thread_id, post_num, role AS author, content FROM forum")
_sql("ingest_compacted", """
    SELECT thread_id, post_num, role AS author, content FROM forum WHERE conv_id % 3 <> 0""")
_sql("quarantined", """
    SELECT DISTINCT CAST(conv_id AS VARCHAR) AS thread_id, 1 AS page_num, CAST(NULL AS BIGINT) AS post_num,
           CASE WHEN conv_id % 7 = 3 THEN 'page: no html' ELSE 'page: broken markup' END AS problems
    FROM conversations WHERE conv_id % 7 IN (3, 5)""")
_sql("latest_version", """
    SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS version FROM events
    QUALIFY floor(value) = max(floor(value)) OVER (PARTITION BY user_id, event_type)""")
