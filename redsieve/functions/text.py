"""Tokens, labels, chunks and JSON objects as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode-aware splitting takes for white space, and the marks around a token.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
TERM_MARKS = ".,;:()[]{}\"'`"
WORD_MARKS = TERM_MARKS + "$"

#: A JSON object that holds objects of one further level at most; possessive, as a long one would exhaust the stack.
JSON_OBJECT = r"(?s)\{(?:[^{}]++|\{[^{}]*+\})*+\}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row: as a column of its own, the planner would move it into lambdas."""
    return F.transform(F.array(value), body)[0]


def stripped(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda t: t != "")


def normalized_word(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(WORD_MARKS)))


def term_tokens(term: Column) -> Column:
    """The tokens of a term. Marks alone become an empty token; ``$`` stays, unlike in words."""
    return F.transform(split_words(term), lambda t: F.lower(F.btrim(t, F.lit(TERM_MARKS))))


def safe_label(label: Column) -> Column:
    """A label for file names; ``run`` if nothing is left."""
    kept = F.btrim(F.regexp_replace(F.coalesce(label, F.lit("")), "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(kept == "", F.lit("run")).otherwise(kept)


def file_timestamp(iso: Column) -> Column:
    """yyyymmdd-hhmmss of the digits of an ISO timestamp."""
    digits = F.substring(F.regexp_replace(iso, "[^0-9]", ""), 1, 14)
    digits = F.when(digits == "", F.lit("0" * 14)).otherwise(digits)
    return F.when(F.length(digits) >= 14, F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 6))).otherwise(digits)


def chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters without overlap; those of white space alone are left out."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("chunk"))), lambda c: F.length(F.regexp_replace(c["chunk"], SPACE, "")) > 0)


def json_objects(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + JSON_OBJECT + ")"))


def last_object_with(text: Column, names: tuple[str, ...]) -> Column:
    """The last JSON object of ``text`` that parses and has one of ``names`` at its top; null if there is none."""
    has = lambda o: F.coalesce(F.arrays_overlap(F.json_object_keys(o), F.array(*[F.lit(n) for n in names])), F.lit(False))
    whole = lambda o: F.try_parse_json(o).isNotNull()
    return F.try_element_at(F.filter(json_objects(text), lambda o: whole(o) & has(o)), F.lit(-1))
