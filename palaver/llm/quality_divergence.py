"""Quality rules: base counts of a text, and how far its histograms lie from its language's.

Two histograms are compared with a reference by Jensen-Shannon distance: classes
of characters, and common words (each word of the lists a bin, all others one). A
language's reference sums the histograms of all its documents. A text is judged
by its own language's reference, or by the nearest where its language has none.
Short texts are left alone: their histograms say little (``min_chars``,
``min_words``). Everything is built from column functions; each text is read once.

Defined cases: null and empty texts have all counts 0 and fail the base rule;
rows that repeat get the same verdict; a table without any reference rejects by
the base rule alone; other columns stay out of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import WORD, held, released, stored

# Frequent short words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for it was on with".split(),
    "de": "der die und den von zu das mit sich auf für ist".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y los se del las por con".split(),
}
PLACE_BITS = 28  # more words than a row can hold

MIN_WORDS = 50
MIN_CHARS = 300
# Distances lie within 0 and 1.
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.6
MAX_REPEAT_PERCENT = 50

CLASSES = ["c_lower", "c_space", "c_upper", "c_digit", "c_letter", "c_other"]


def _listed(common: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(w for words in common.values() for w in words))


def base_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and ``_joined``, the words with one blank between.

    No lambda runs for each word where a pattern over the whole string does: Spark
    interprets lambdas element by element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    blanks = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    rows = docs.withColumn("_joined", F.trim(F.regexp_replace(blanks, " {2,}", " "))).withColumn("_lines", lines)
    rows = rows.withColumn("_solid", F.replace("_joined", F.lit(" "), F.lit("")))
    chars = F.char_length("_solid")
    n = F.when(chars > 0, F.char_length("_joined") - chars + 1).otherwise(0)
    # Windows as numbers: low bits of a hash above the place in the text. Sorted, equal ones stand side by side.
    word = lambda i: F.get("_list", i.cast("int"))
    number = lambda i: F.shiftleft(F.xxhash64(word(i), word(i + 1), word(i + 2)), PLACE_BITS).bitwiseOR(i)
    rows = rows.withColumn("_list", F.split("_joined", " ")).withColumn("n_words", n.cast("long"))
    places = F.sequence(F.lit(0).cast("long"), F.col("n_words") - 3)
    rows = rows.withColumn("_at", F.when(F.col("n_words") > 3, F.sort_array(F.transform(places, number))))
    next_to = F.arrays_zip(F.col("_at").alias("a"), F.slice("_at", F.lit(2), F.size("_at") - 1).alias("b"))
    rows = rows.withColumn(
        "_alike", F.filter(next_to, lambda x: F.shiftright(x["a"], PLACE_BITS) == F.shiftright(x["b"], PLACE_BITS))
    )
    place = lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1)
    alike = F.array_distinct(F.concat(F.transform("_alike", lambda x: place(x["a"])), F.transform("_alike", lambda x: place(x["b"]))))
    # The few with equal hashes once more by their words.
    window = lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i"))
    rows = rows.withColumn("_at", F.when(F.size("_alike") > 0, F.sort_array(F.transform(alike, window))))
    next_to = F.arrays_zip(F.col("_at").alias("a"), F.slice("_at", F.lit(2), F.size("_at") - 1).alias("b"))
    rows = rows.withColumn("_same", F.filter(next_to, lambda x: x["a"]["w"] == x["b"]["w"]))
    starts = F.sort_array(F.array_distinct(F.concat(F.col("_same.a.i"), F.col("_same.b.i"))))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(3).cast("long"))).alias("n")),
        lambda acc: acc["n"],
    )
    return (
        rows.withColumn("word_chars", chars.cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_lines", "_list", "_at", "_alike", "_same", "_solid")
    )


def histograms(rows: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """Add ``classes`` and ``common`` (arrays of longs) to rows with ``text``, ``_joined`` and ``n_words``."""
    rest = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("_rest", rest).withColumn("_chars", F.char_length("_rest"))
    for name, kind in zip(CLASSES, ("a-z", r"\s", "A-Z", "0-9", r"\p{L}")):
        # Each class is taken out, so later patterns see little text.
        rows = (
            rows.withColumn("_less", F.regexp_replace("_rest", f"[{kind}]+", ""))
            .withColumn(name, F.char_length("_rest") - F.char_length("_less"))
            .drop("_rest")
            .withColumnRenamed("_less", "_rest")
        )
    rows = rows.withColumn("c_other", F.char_length("_rest"))
    listed = _listed(common)
    found = F.regexp_extract_all(F.lower("_joined"), F.lit(f"(?<![^ ])({'|'.join(listed)})(?![^ ])"), F.lit(1))
    rows = rows.withColumn("_found", found).withColumn("_hits", F.concat(F.lit("|"), F.array_join("_found", "||"), F.lit("|")))
    each = [
        ((F.octet_length("_hits") - F.octet_length(F.replace("_hits", F.lit(f"|{w}|"), F.lit("")))) / (len(w.encode()) + 2)).cast("long")
        for w in listed
    ]
    return rows.withColumn("common", F.array(*each, F.col("n_words") - F.size("_found"))).withColumn(
        "classes", F.array(*[F.col(c).cast("long") for c in CLASSES])
    )


def references(features: DataFrame, languages: list[str]) -> dict[str, tuple[list[int], list[int]]]:
    """Summed histograms of each listed language: at most one small row for each."""
    n_classes, n_common = len(CLASSES), len(_listed(COMMON_WORDS)) + 1
    sums = [F.sum(F.get(name, F.lit(i))) for name, n in (("classes", n_classes), ("common", n_common)) for i in range(n)]
    rows = features.where(F.col("lang").isin(languages)).groupBy("lang").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])
    found = {r[0]: ([*r[1 : n_classes + 1]], [*r[n_classes + 1 :]]) for r in rows.collect()}
    return {k: v for k, v in sorted(found.items()) if sum(v[0]) and sum(v[1])}


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram with this sum from a reference of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def term(c: Column, q: Column) -> Column:
        p = c / total
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    summed = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, x: a + x)
    # Rounding may leave a tiny negative sum for equal histograms.
    return F.sqrt(F.greatest(summed / 2, F.lit(0.0)))


def nearest_distance(counts: Column, total: Column, known: dict[str, list[int]]) -> Column:
    """Distance from the own language's reference, or the least of all; null for an empty histogram."""
    if not known:
        return F.lit(None).cast("double")
    shares = {lang: F.array(*[F.lit(x / sum(ref)) for x in ref]) for lang, ref in known.items()}
    own = reduce(lambda c, x: c.when(F.col("lang") == x[0], F.array(x[1])), shares.items(), F)
    refs = own.otherwise(F.array(*shares.values()))
    return F.when(total > 0, F.array_min(F.transform(refs, lambda r: js_distance(counts, total, r))))


def quality(
    docs: DataFrame,
    *,
    languages: list[str] | None = None,
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """doc_id, lang, text_md5, base counts, base_failed, class_distance, word_distance, kept."""
    rows = histograms(base_counts(docs.select("doc_id", "lang", "text")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    features = stored(
        rows.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), *counts, "classes", "common", F.col("_chars").cast("long").alias("n_chars")),
        "quality",
    )
    known = references(features, languages or list(COMMON_WORDS))

    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = ((F.col("n_chars") >= min_chars) & (F.col("class_distance") > max_class_distance)) | (
        (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance)
    )
    return (
        features.withColumn("class_distance", nearest_distance(F.col("classes"), F.col("n_chars"), {k: v[0] for k, v in known.items()}))
        .withColumn("word_distance", nearest_distance(F.col("common"), F.col("n_words"), {k: v[1] for k, v in known.items()}))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
        .select("doc_id", "lang", "text_md5", *counts, "base_failed", "class_distance", "word_distance", "kept")
    )


def kept_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns."""
    good = quality(docs, **settings).where("kept").select("doc_id", "lang", "text_md5").distinct()
    doc = F.col("doc")
    same = (
        doc["doc_id"].eqNullSafe(F.col("doc_id"))
        & (F.md5(F.coalesce(doc["text"], F.lit(""))) == F.col("text_md5"))
        & doc["lang"].eqNullSafe(F.col("lang"))
    )
    return held(docs).join(good, same, "left_semi").select(*released(docs))
