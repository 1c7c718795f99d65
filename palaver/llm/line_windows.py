"""Line dedup by overlapping windows of three lines.

Lines with a word count, blank ones are passed over. Every three consecutive
lines form a window; a window found again, in another text or later in the same
one, marks its three lines there, and overlapping marks merge. The first place of
a window, by smallest doc_id and then position, keeps its lines. A text of fewer than
three lines with a word has one window of all of them, found again only in texts
that hold just these lines.

The first place of each window is a partial minimum before the shuffle, so a
window that a third of all texts share arrives as one row for each task. Texts
travel once, to meet the starts of their repeated windows.

Defined cases: null text has no lines and stays null; a text without a word has no
window and stays; rows with one doc_id and one text hold the same
places and stay alike; null doc_id comes first; all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import WORD, held, let, released, stored

WINDOW = 3


def _solid(text):
    """Numbers of the lines that hold a word."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(WORD), i))
    return F.array_compact(lines)


def repeated_windows(docs: DataFrame, lines: int = WINDOW) -> DataFrame:
    """doc_id, text_md5 and ``starts``: where, among the lines with a word, windows begin that were seen before.

    A window never equals a shorter one: it has more line breaks.
    """
    # The lines with a word, in order.
    solid = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    window = lambda held, i: F.struct(
        F.unhex(F.md5(F.concat_ws("\n", *[F.get(held, i + k) for k in range(lines)]))).alias("h"), i.alias("i")
    )
    windows = let(
        solid,
        lambda held: F.when(
            F.size(held) > 0,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(held) - lines, F.lit(0))), lambda i: window(held, i)),
        ),
    )
    places = stored(
        docs.select("doc_id", F.md5("text").alias("text_md5"), F.explode(windows).alias("w")).select(
            "doc_id", "text_md5", "w.h", "w.i"
        ),
        "windows",
    )
    # Rows alike in doc_id and text share their places, so a window is repeated only if its places differ.
    place = F.struct(F.col("doc_id"), F.col("text_md5"), F.col("i"))
    first = places.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = places.join(first.select("h", "first"), "h").where(place > F.col("first"))
    # Each later place is one row; a text gathers its own.
    return later.groupBy("doc_id", "text_md5").agg(F.collect_set("i").alias("starts"))


def _cut(docs: DataFrame, lines: int) -> DataFrame:
    """doc (all columns of ``docs``), text, n_lines and n_removed."""
    found = repeated_windows(docs, lines)
    doc = F.col("doc")
    same = doc["doc_id"].eqNullSafe(F.col("doc_id")) & (F.md5(doc["text"]) == F.col("text_md5"))
    # Sets of places, not a search for each line: time stays in proportion to the text.
    marked = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + lines - 1))))
    everyone = lambda held_: F.sequence(F.lit(0), F.size(held_) - 1)
    gone = let(_solid(doc["text"]), lambda n: F.transform(marked, lambda k: F.get(n, k)))
    left = let(
        F.split(doc["text"], "\n"),
        lambda held_: F.transform(F.array_except(everyone(held_), gone), lambda i: F.get(held_, i)),
    )
    cut = F.col("starts").isNotNull()
    rows = held(docs).join(found, same, "left").withColumn("left", F.when(cut, left))
    count = F.size(F.split(doc["text"], "\n"))
    return rows.select(
        "doc",
        F.when(cut, F.array_join("left", "\n")).otherwise(doc["text"]).alias("text"),
        F.when(doc["text"].isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.when(cut, count - F.size("left")).otherwise(0).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, lines: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text``, and n_lines, n_removed beside (in place of columns so named)."""
    own = docs.drop("n_lines", "n_removed")
    return _cut(docs, lines).select(*released(own, text=F.col("text")), "n_lines", "n_removed")


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The same columns; ``n_chars`` follows the text, and texts that lose every line with a word go."""
    rows = _cut(docs, WINDOW)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    rows = rows.where(~F.coalesce(emptied, F.lit(False)))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("doc")["n_chars"])
    return rows.select(*released(docs, **changed))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT row, doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS x FROM d),
solid AS (
  SELECT row, doc_id, k, x, row_number() OVER (PARTITION BY row ORDER BY k) - 1 AS i
  FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
win AS (
  SELECT a.row, a.doc_id, a.i, a.x || chr(10) || b.x || chr(10) || c.x AS w
  FROM solid a JOIN solid b ON a.row = b.row AND b.i = a.i + 1 JOIN solid c ON a.row = c.row AND c.i = a.i + 2
  UNION ALL
  SELECT row, any_value(doc_id), 0, string_agg(x, chr(10) ORDER BY i) FROM solid GROUP BY row HAVING count(*) < 3),
later AS (
  SELECT row, i FROM (SELECT row, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (
  SELECT DISTINCT s.row, s.k FROM later t JOIN solid s ON s.row = t.row AND s.i BETWEEN t.i AND t.i + 2),
kept AS (
  SELECT line.row, string_agg(x, chr(10) ORDER BY k) AS text, count(*) AS n
  FROM line LEFT JOIN gone USING (row, k) WHERE gone.k IS NULL GROUP BY line.row)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, coalesce(kept.text, '') AS text
FROM d LEFT JOIN kept USING (row)
"""
