"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.llm.common import strip_white

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent short words of the languages that the stop-word rule knows.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "with", "as", "on", "are", "be", "by"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "nicht", "ein", "eine", "auf", "für"),
    "fr": ("le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "est", "pour", "par"),
    "es": ("el", "la", "los", "las", "de", "del", "y", "en", "que", "un", "una", "por", "para", "con", "es", "se"),
}


class Threshold(NamedTuple):
    """A document fails if `measure` lies outside [least, most]; None is no bound. A measure that is null passes."""

    measure: str
    least: float | None
    most: float | None


THRESHOLDS = (
    Threshold("mean_word_length", 2.0, 18.0),
    Threshold("symbols_per_word", None, 0.2),
    Threshold("exclamations_per_word", None, 0.5),
    Threshold("stop_word_share", 0.02, None),
    Threshold("duplicate_line_share", None, 0.6),
)


def _removed(text: Column, characters: str) -> Column:
    """How many of the given ASCII characters the text holds."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("bigint")


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with the counts of the contract and the measures of the threshold table.

    Null text counts as no words at all. Rows are judged one by one: repeated rows give repeated results.
    Without a language column, or for a language without stop words, the stop-word share is null.
    """
    kept = [c for c in docs.columns if c not in (text,)]
    stop = F.lit(None).cast("double")
    if lang in docs.columns:
        for name, words in STOP_WORDS.items():
            listed = ", ".join(f"'{w}'" for w in words)
            found = F.size(F.expr(f"filter(_words, w -> lower(w) IN ({listed}))"))
            stop = F.when(
                (F.col(f"_d.{lang}") == name) & (F.col("n_words") > 0), found / F.col("n_words")
            ).otherwise(stop)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_d"), F.coalesce(text, F.lit("")).alias("_text"))
    df = df.withColumn("_trimmed", strip_white(F.col("_text")))
    df = df.withColumn(
        "_words",
        F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(
            F.split("_trimmed", r"[\x20\x09-\x0D]+")
        ),
    )
    df = df.withColumn("n_words", F.size("_words").cast("bigint"))
    df = df.withColumn(
        "_lines", F.expr(r"filter(split(_text, '\n'), l -> btrim(l, ' \t\n\u000B\f\r') != '')")
    )
    # Windows of eight words, by hash of two, of four and of eight. Only texts with a repeated window go through the sort by hash and position.
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    pairs = "zip_with({0}, slice({0}, {1}, size({0})), (a, b) -> xxhash64(a, b))"
    for name, of, start in (("_two", "_hashes", 2), ("_four", "_two", 3)):
        df = df.withColumn(name, F.expr(pairs.format(of, start)))
    df = df.withColumn(
        "_windows",
        F.expr(
            f"CASE WHEN n_words >= {WINDOW} THEN "
            f"slice({pairs.format('_four', 5)}, 1, CAST(n_words AS INT) - {WINDOW - 1}) END"
        ),
    )
    df = df.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_windows)) < size(_windows) "
            "THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    )
    df = df.withColumn(
        "_starts",
        F.expr(
            "sort_array(transform(filter(_sorted, (e, k) -> e.h = get(_sorted, k - 1).h OR e.h = get(_sorted, k + 1).h),"
            " e -> e.i))"
        ),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.expr(
            "CAST(coalesce(aggregate(transform(_starts, (s, k) -> "
            f"least({WINDOW}, coalesce(get(_starts, k + 1) - s, {WINDOW}))), 0, (a, x) -> a + x), 0) AS BIGINT)"
        ),
    )
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words"))
    return (
        df.withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("bigint"))
        .withColumn("n_symbols", _removed(F.col("_text"), SYMBOLS))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("mean_word_length", per_word(F.col("word_chars")))
        .withColumn("symbols_per_word", per_word(F.col("n_symbols")))
        .withColumn("exclamations_per_word", per_word(_removed(F.col("_text"), "!")))
        .withColumn("stop_word_share", stop)
        .withColumn(
            "duplicate_line_share",
            F.when(F.size("_lines") > 0, F.col("n_dup_lines") / F.size("_lines")),
        )
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compile_thresholds(thresholds: Sequence[Threshold]) -> Column:
    """True for rows within all bounds."""
    passed = F.lit(True)
    for t in thresholds:
        c = F.col(t.measure)
        if t.least is not None:
            passed = passed & F.coalesce(c >= t.least, F.lit(True))
        if t.most is not None:
            passed = passed & F.coalesce(c <= t.most, F.lit(True))
    return passed


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def quality_rules(
    docs: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per row of `docs`: doc_id, the counts, the measures, base_failed and kept.

    The base fails a document with fewer than 20 words or with over 30 % of its words in repeated 8-word
    windows; the threshold table judges the others. No shuffle, no Python. Null or empty text has no words
    and so fails. Further columns of `docs`, whatever their names, are left out of the result.
    """
    failed = base_failed()
    return measured(docs, text, lang).select(
        F.col("_d.doc_id").alias("doc_id"),
        *MEASURES,
        *[t.measure for t in THRESHOLDS],
        failed.alias("base_failed"),
        (~failed & compile_thresholds(thresholds)).alias("kept"),
    )


def keep_good(docs: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`. A text that passes is not null."""
    whole = [F.col("_text" if c == "text" else f"_d.`{c}`").alias(c) for c in docs.columns]
    judged = measured(docs).withColumn("_kept", ~base_failed() & compile_thresholds(thresholds))
    # A filter would be pushed down through the steps of `measured`, and each of them written out where it is used.
    # It stops at a column that is not deterministic.
    fixed = judged.withColumn("_row", F.monotonically_increasing_id())
    return fixed.filter("_kept AND _row >= 0").select(*whole)
