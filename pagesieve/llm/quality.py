"""Quality rules: distance of a document's histograms from those of its language.

Every document is counted into two histograms: characters by class, and the most common
words of its language, of any length. Both are compared with the same histograms over all
documents of that language by the Jensen-Shannon distance (base 2, so 0 to 1). A document
far from its language is rejected; one with few words is not judged by distance.

The text and its counts go to a stored table, and both the references and the verdicts
come from there. Words are summed by language before they are shuffled. Only built-in functions are used.

Defined results
    null text                    no words, all counts 0, base rules apply
    null language                a language of its own, with its own reference
    fewer words than the guard   no distances, the base rules alone decide
    language below the guard     no distances, the base rules alone decide
    repeated rows, null ids      every row is judged by itself and comes back once
    column of the same name      replaced by the new struct, see ``judged``
    empty table                  no rows
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.storage import fresh_name, stored

#: White space and words, as the whole subpackage understands them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Characters counted by class. The first class is lower-case letters and blanks, which
#: are taken out of a text before the others are counted; the last is all the rest.
PLAIN = "a-z "
CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "space": r"\x09-\x0D",
    "mark": ".,;:?'\"()-",
    "symbol": r"!#$%&*+/<=>@\[\\\]^_`{|}~",
}

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5

#: Parameters of the method.
COMMON_WORDS = 16
GUARD_WORDS = 50
GUARD_LANGUAGE_WORDS = 1000
MOST_CLASS_DISTANCE = 0.3
MOST_WORD_DISTANCE = 0.4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of ``text`` in order."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def window_hashes(words: Column) -> Column:
    """A hash of every five words in a row, in order: pairs, then fours, then fives."""

    def joined(a: Column, b: Column, by: int) -> Column:
        rest = F.slice(b, by + 1, F.greatest(F.size(b) - by, F.lit(0)))
        return F.slice(
            F.zip_with(a, rest, lambda x, y: F.xxhash64(x, y)), F.lit(1), F.size(rest)
        )

    single = F.transform(words, lambda x: F.xxhash64(x))
    return bound(
        single,
        lambda h: bound(
            bound(joined(h, h, 1), lambda p: joined(p, p, 2)), lambda q: joined(q, h, 4)
        ),
    )


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found at least twice among ``words``."""
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        bound(
            window_hashes(words),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                bound(
                    F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                    _covered,
                )
            ),
        )
    )


def _covered(ordered: Column) -> Column:
    """Words under the windows of which ``ordered`` (hash, place) has the hash twice."""
    twice = F.filter(
        ordered,
        lambda x, i: (F.get(ordered, i - 1)["h"].eqNullSafe(x["h"]))
        | (F.get(ordered, i + 1)["h"].eqNullSafe(x["h"])),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return bound(
        places,
        lambda p: F.aggregate(
            F.transform(
                p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
            ),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )


def measured(text: Column, words: Column) -> Column:
    """Everything that is counted in one document, as a struct."""
    size = lambda x: F.char_length(x).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    residue = F.regexp_replace(text, f"[{PLAIN}]++", "")
    classes = bound(
        residue,
        lambda r: bound(
            F.array(*(size(F.regexp_replace(r, f"[^{c}]++", "")) for c in CLASSES.values())),
            lambda x: F.concat(
                F.array(size(text) - size(r)),
                x,
                F.array(size(r) - F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)),
            ),
        ),
    )
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        size(F.array_join(words, "")).alias("word_chars"),
        size(F.regexp_replace(residue, f"[^{SYMBOLS}]++", "")).alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("long")
        .alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
    )


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two lists of counts; null if either is all zero."""

    def shares(x: Column, body: Callable[[Column], Column]) -> Column:
        total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, b: a + b)
        return bound(
            x,
            lambda v: bound(
                F.nullif(total(v), F.lit(0).cast("long")),
                lambda n: F.when(n > 0, body(F.transform(v, lambda y: y.cast("double") / n))),
            ),
        )

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p * 2 / (p + q))).otherwise(F.lit(0.0))

    def distance(p: Column, q: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
        total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
        return F.sqrt(F.greatest(total / 2, F.lit(0.0)))

    return shares(counts, lambda p: shares(reference, lambda q: distance(p, q)))


def word_counts(words: Column, n_words: Column, common: Column, longest: Column) -> Column:
    """How often each of the ``common`` words occurs, then all other words.

    No common word has more bytes than ``longest``, so longer words need no comparison.
    """
    return bound(
        F.filter(words, lambda x: F.octet_length(x) <= longest),
        lambda w: _word_counts(w, n_words, common),
    )


def _word_counts(words: Column, n_words: Column, common: Column) -> Column:
    found = [
        F.coalesce(F.size(words) - F.size(F.array_remove(words, F.get(common, F.lit(k)))), F.lit(0))
        for k in range(COMMON_WORDS)
    ]
    return bound(
        F.array(*(x.cast("long") for x in found)),
        lambda x: F.concat(
            x, F.array(n_words - F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))
        ),
    )


def references(counted: DataFrame, text: str, lang: str, measures: str) -> DataFrame:
    """``lang, common, longest, word_reference, class_reference`` over all documents.

    One row for each language, however many documents it has: counts are summed before
    they are shuffled, and the common words are picked from partial rankings.
    """
    m = F.col(measures)
    rows = counted.select(F.col(lang).alias("lang"), F.col(text).alias("text"), m.alias("m"))
    sums = rows.groupBy("lang").agg(
        F.sum("m.n_words").alias("total"),
        F.array(
            *(F.sum(F.col("m.classes")[i]) for i in range(len(CLASSES) + 2))
        ).alias("class_reference"),
    )
    ranked = (
        rows.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        )
        .filter(F.col("rank") <= COMMON_WORDS)
    )
    common = ranked.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top")
    )
    known = sums.filter(F.col("total") >= GUARD_LANGUAGE_WORDS)
    counts = F.concat(
        F.col("top.n"),
        F.array_repeat(F.lit(0).cast("long"), F.lit(COMMON_WORDS) - F.size("top")),
        F.array(
            F.col("total") - F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        ),
    )
    return known.join(common, known["lang"].eqNullSafe(common["lang"]), "left").select(
        known["lang"],
        F.col("top.word").alias("common"),
        F.array_max(F.transform("top.word", F.octet_length)).alias("longest"),
        counts.alias("word_reference"),
        "class_reference",
        F.lit(True).alias("known"),
    )


def judged(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", into: str = "quality"
) -> DataFrame:
    """``docs`` with one more column, the struct ``into``.

    Its fields are the base counts, ``base_failed``, the two distances (null where a
    guard holds) and ``kept``. An older column of that name is replaced. The references
    are written before they are joined, so that Spark knows their size and broadcasts
    them only if they are small.
    """
    docs = docs.drop(into) if into not in (text, lang) else docs
    w, m, r = (fresh_name(docs, x) for x in ("words", "measures", "reference"))
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = stored(
        docs.withColumn(w, words_of(whole)).withColumn(m, measured(whole, F.col(w))).drop(w),
        "quality-counts",
    )
    known = stored(references(counted, text, lang, m), "quality-references").select(
        F.struct("*").alias(r)
    )
    rows = counted.join(known, counted[lang].eqNullSafe(known[r]["lang"]), "left")
    q, ref = F.col(m), F.col(r)
    judge = (q["n_words"] >= GUARD_WORDS) & ref["known"]
    by_class = F.when(judge, js_distance(q["classes"], ref["class_reference"]))
    by_word = F.when(
        judge,
        js_distance(
            word_counts(words_of(F.col(text)), q["n_words"], ref["common"], ref["longest"]),
            ref["word_reference"],
        ),
    )
    failed = (q["n_words"] < LEAST_WORDS) | (
        100 * q["n_repeat_words"] > MOST_REPEATED_PERCENT * q["n_words"]
    )
    found = F.struct(
        *(q[k].alias(k) for k in BASE),
        failed.alias("base_failed"),
        by_class.alias("class_distance"),
        by_word.alias("word_distance"),
    )
    far = F.coalesce(
        (F.col(into)["class_distance"] > MOST_CLASS_DISTANCE)
        | (F.col(into)["word_distance"] > MOST_WORD_DISTANCE),
        F.lit(False),
    )
    return (
        rows.withColumn(into, found)
        .drop(m, r)
        .withColumn(into, F.col(into).withField("kept", ~F.col(into)["base_failed"] & ~far))
    )


def kept_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    into = fresh_name(docs, "quality")
    return judged(docs, into=into, **columns).filter(F.col(into)["kept"]).drop(into)
