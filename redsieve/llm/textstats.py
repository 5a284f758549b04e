"""Counts over whole documents, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsieve.llm.common import SPACES, let, occurrences, removed, text_of, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

PUNCTUATION = ".,;:!?"
DIGITS = "0123456789"


def _covered(starts: Column) -> Column:
    """How many positions lie in windows of three that begin at the ascending ``starts``."""
    steps = F.transform(starts, lambda s, j: F.coalesce(F.least(F.lit(3), F.get(starts, j + 1) - s), F.lit(3)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_window_words(ws: Column) -> Column:
    """Words that lie in a window of three words found twice or more in ``ws``, the first window included.

    Hashes of the windows rule out the texts that repeat nothing; the others compare the windows themselves."""
    places = F.sequence(F.lit(0), F.size(ws) - 3)

    def exact(_: Column) -> Column:
        keyed = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("g"), i.alias("i"))))

        def twice(s: Column) -> Column:
            alike = F.transform(s, lambda x, j: F.when((F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False))), x["i"]))
            return let(F.sort_array(F.filter(alike, lambda i: i.isNotNull())), _covered)

        return let(keyed, twice)

    hashes = F.transform(places, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(ws) >= 4, some).otherwise(F.lit(0).cast("long"))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of its whole texts (a null text counts as an empty one):
    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words, n_distinct_words,
    n_upper, n_letters, n_punct, n_exclaim, n_digits."""
    t = F.col("_text")
    df = df.withColumn("_text", text_of(text)).withColumn("_words", words(t))
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(removed(line, SPACES)) > 0)
    size = lambda c: F.size(c).cast("long")
    return df.withColumns(
        {
            "n_words": size(F.col("_words")),
            "word_chars": F.length(removed(t, SPACES)).cast("long"),
            "n_symbols": occurrences(t, SYMBOLS),
            "n_lines": size(lines),
            "n_dup_lines": let(lines, lambda x: size(x) - size(F.array_distinct(x))),
            "n_repeat_words": repeated_window_words(F.col("_words")),
            "n_distinct_words": size(F.array_distinct(F.col("_words"))),
            "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
            "n_punct": occurrences(t, PUNCTUATION),
            "n_exclaim": occurrences(t, "!"),
            "n_digits": occurrences(t, DIGITS),
        }
    ).drop("_text", "_words")


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
