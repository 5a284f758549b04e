"""Words and their marks: listings, spans, term sweeps, text views.

Words have doc_id, page, idx, text and a box; marks have doc_id, page, idx and are distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsieve.config import DEFAULT, REDACTED
from redsieve.functions.payload import WORD_KEYS, read_index_payload
from redsieve.functions.text import let, normalized_word, term_tokens

KEY = ["doc_id", "page", "idx"]


def flagged(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with ``redacted``."""
    return rows.join(marks.select(*KEY, F.lit(True).alias("redacted")), KEY, "left").withColumn("redacted", F.coalesce("redacted", F.lit(False)))


def visible(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return rows.join(marks, KEY, "left_anti")


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return rows.join(marks, KEY, "left_semi")


def add_marks(marks: DataFrame, new: DataFrame) -> DataFrame:
    """Both, each key once; adding marks twice changes nothing."""
    return marks.select(*KEY).unionByName(new.select(*KEY)).dropDuplicates(KEY)


def newly_marked(marks: DataFrame, new: DataFrame) -> DataFrame:
    return new.select(*KEY).dropDuplicates(KEY).join(marks, KEY, "left_anti")


def list_words(words: DataFrame, marks: DataFrame, only_unredacted: bool = False) -> DataFrame:
    """doc_id, page, words (idx, text, redacted in order): a row per page that has any to list."""
    rows = flagged(words, marks)
    rows = rows.where(~F.col("redacted")) if only_unredacted else rows
    return rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "redacted"))).alias("words"))


def word_spans(payloads: DataFrame) -> DataFrame:
    """doc_id, ok, dropped, invalid, keys of each payload (doc_id, spans_json)."""
    return payloads.select("doc_id", read_index_payload(F.col("spans_json"), WORD_KEYS, ("word_indices",)).alias("p")).select("doc_id", "p.*")


def apply_spans(rows: DataFrame, marks: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New marks, and doc_id, added, invalid: keys that ``rows`` (words or regions) don't have are invalid, each time they occur."""
    wanted = spans.select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.page", "k.idx")
    known = rows.select(*KEY)
    found = wanted.join(known, KEY, "left_semi")
    new = newly_marked(marks, found)
    missing = wanted.join(known, KEY, "left_anti").groupBy("doc_id").agg(F.count("*").alias("missing"))
    added = new.groupBy("doc_id").agg(F.count("*").alias("added"))
    result = spans.groupBy("doc_id").agg(F.sum("invalid").alias("invalid")).join(missing, "doc_id", "left").join(added, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return new, result.select("doc_id", zero("added").alias("added"), (zero("invalid") + zero("missing")).alias("invalid"))


def sweep(words: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, page, idx, k, label, term_no: each place in a page where the ``k`` tokens of a term stand in a row, overlapping ones
    included. terms: term_no, term, and doc_id where a term is of one document. A word is joined with the terms that begin
    with it; the words after it decide."""
    tokens = term_tokens(F.col("term"))
    t = terms.withColumn("tokens", tokens).where(F.size("tokens") > 0)
    t = t.select(*[c for c in terms.columns if c != "term"], "tokens", F.col("tokens")[0].alias("first"), F.size("tokens").alias("k"), F.array_join("tokens", " ").alias("label"))
    most = t.agg(F.max("k")).first()[0] or 1
    ahead = Window.partitionBy("doc_id", "page").orderBy("idx").rowsBetween(0, most - 1)
    w = words.select(*KEY, normalized_word(F.col("text")).alias("first")).withColumn("ahead", F.collect_list("first").over(ahead))
    on = ["first", "doc_id"] if "doc_id" in terms.columns else ["first"]
    return w.join(t, on).where(F.slice("ahead", F.lit(1), F.col("k")) == F.col("tokens")).select(*KEY, "k", "label", "term_no")


def swept_marks(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "page", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("k") - 1)).alias("idx")).dropDuplicates(KEY)


def swept_places(tokens: Column, terms: Column) -> Column:
    """swept_marks() of one page: ``tokens`` are its words as normalized_word() gives them, ``terms`` the tokens of each term."""
    at = lambda firsts: F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.array_contains(firsts, tokens[i]))
    found = lambda i: F.filter(terms, lambda t: F.slice(tokens, i + 1, F.size(t)) == t)
    places = lambda starts: F.flatten(F.transform(starts, lambda i: F.flatten(F.transform(found(i), lambda t: F.sequence(i, i + F.size(t) - 1)))))
    swept = let(F.transform(terms, lambda t: t[0]), lambda firsts: F.array_distinct(places(at(firsts))))
    return F.when((F.size(tokens) > 0) & (F.size(terms) > 0), swept).otherwise(F.array().cast("array<int>"))


def term_list(terms: DataFrame) -> Column:
    """The tokens of each of ``terms`` (term), which hold for all documents, as a constant."""
    tokens = term_tokens(F.col("term"))
    found = terms.select(tokens.alias("t")).where(F.size("t") > 0).distinct().collect()
    return F.array(*[F.array(*map(F.lit, r.t)) for r in found]).cast("array<array<string>>")


def sweep_counts(hits: DataFrame) -> DataFrame:
    """doc_id, label, matches: terms that are given twice count twice; terms without a match have no row."""
    return hits.groupBy("doc_id", "label").agg(F.count("*").alias("matches"))


def _page_texts(rows: DataFrame, token: Column) -> DataFrame:
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx"), token.alias("t")))), lambda w: w["t"]), " ").alias("t"))


def _headed(page: Column, text: Column) -> Column:
    return F.concat(F.lit("\n--- Page "), (page + 1).cast("string"), F.lit(" ---\n "), text)


def redacted_pages(texts: Column, marks: Column, most: int) -> Column:
    """redacted_text() of one document: ``texts`` are the words of each page, ``marks`` the places that are marked there."""
    shown = lambda words, places: F.array_join(F.transform(words, lambda w, i: F.when(F.array_contains(places, i), F.lit(REDACTED)).otherwise(w)), " ")
    pages = lambda t, m: F.transform(t, lambda words, no: _headed(no, shown(words, m[no])))
    return F.substring(F.array_join(let(texts, lambda t: let(marks, lambda m: pages(t, m))), " \n "), 1, most)


def redacted_text(words: DataFrame, marks: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, text: the words in order with REDACTED in place of marked ones, a header before each page that has words; of each
    text the first ``most`` characters, if given."""
    pages = _page_texts(flagged(words, marks), F.when(F.col("redacted"), F.lit(REDACTED)).otherwise(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda p: _headed(p["page"], p["t"])), " \n ")
    return pages.groupBy("doc_id").agg((joined if most is None else F.substring(joined, 1, most)).alias("text"))


def evidence_text(words: DataFrame, sizes: DataFrame, front: int = DEFAULT.front_pages, back: int = DEFAULT.back_pages, most: int = DEFAULT.evidence_chars) -> DataFrame:
    """doc_id, evidence: the first and last pages that have words, cut with a note. sizes: all pages of a document."""
    total = sizes.groupBy("doc_id").agg(F.count("*").alias("n"))
    pages = _page_texts(words.join(total, "doc_id").where((F.col("page") < front) | ((F.col("page") >= F.col("n") - back) & (F.col("page") < F.col("n")))), F.col("text"))
    part = lambda p: F.concat(F.lit("[Page "), (p["page"] + 1).cast("string"), F.lit("]\n"), p["t"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), part), "\n\n")
    cut = F.when(F.length("e") > most, F.concat(F.substring("e", 1, most), F.lit("\n... [truncated]"))).otherwise(F.col("e"))
    return pages.groupBy("doc_id").agg(text.alias("e")).select("doc_id", cut.alias("evidence"))
