"""Words, pages and detections derived from plain documents: a made-up layout, which says nothing about real pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsieve.functions.text import let, split_words

PAGE_WORDS, COLUMNS = 200, 10
WIDTH, HEIGHT = 612.0, 792.0


def words(documents: DataFrame) -> DataFrame:
    """doc_id, page, idx, text, x0, top, x1, bottom: ten words a line, twenty lines a page."""
    o = F.col("o")
    rows = documents.select("doc_id", F.posexplode(split_words(F.col("text"))).alias("o", "text"))
    return rows.select("doc_id", F.floor(o / PAGE_WORDS).cast("int").alias("page"), *_placed(o % PAGE_WORDS, F.col("text")))


def _placed(idx: Column, text: Column) -> list[Column]:
    """idx, text, x0, top, x1, bottom of a page's word."""
    x0 = F.lit(36.0) + 54 * (idx % COLUMNS)
    top = F.lit(36.0) + 36 * F.floor(idx / COLUMNS)
    return [idx.cast("int").alias("idx"), text.alias("text"), x0.alias("x0"), top.alias("top"), (x0 + F.least(F.lit(50), 5 * F.length(text))).alias("x1"), (top + 10).alias("bottom")]


def page_texts(text: Column) -> Column:
    """The texts of the words of each page, in order."""
    return let(split_words(text), _paged)


def _paged(texts: Column) -> Column:
    starts = F.when(F.size(texts) > 0, F.sequence(F.lit(1), F.size(texts), F.lit(PAGE_WORDS))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(texts, at, F.lit(PAGE_WORDS)))


def pages(documents: DataFrame) -> DataFrame:
    """doc_id, page, width, height, words (idx, text, box), detections (source, seq, box, conf, label): what words(), page_sizes() and
    detections() have as rows, a row per page."""
    rows = documents.select("doc_id", F.explode(F.array(split_words(F.col("text")))).alias("t"))
    rows = rows.select("doc_id", F.posexplode(_paged(F.col("t"))).alias("page", "texts"))
    placed = F.transform("texts", lambda t, i: F.struct(*_placed(i, t)))
    found = F.filter(F.expr(_MARKS), lambda d: d["source"].isNotNull())
    return rows.selectExpr("*", *_PLACE).select("doc_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), placed.alias("words"), found.alias("detections"))


def page_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, page, width, height for each page that has words."""
    n = F.ceil(F.size(split_words(F.col("text"))) / PAGE_WORDS).cast("int")
    pages = documents.select("doc_id", n.alias("n")).where("n > 0")
    return pages.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


_PLACE = ("36e0 + 54 * ((doc_id + page) % 8) as ax", "36e0 + 36 * ((3 * doc_id + page) % 16) as ay", "54e0 * (1 + doc_id % 3) as aw", "36e0 * (1 + page % 3) as ah")
#: A figure, a background, a small mark with gaps, and a mark near the figure.
_MARKS = """array(
  named_struct('source', 'layout', 'seq', 0, 'x0', ax, 'top', ay, 'x1', ax + aw, 'bottom', ay + ah, 'conf', 1e0, 'label', cast(null as string)),
  named_struct('source', if(doc_id % 7 = 0, 'layout', null), 'seq', 1, 'x0', 50e0, 'top', 50e0, 'x1', 562e0, 'bottom', 742e0, 'conf', 1e0, 'label', cast(null as string)),
  named_struct('source', if((doc_id + page) % 3 <> 0, 'vision', null), 'seq', 0, 'x0', 500e0, 'top', 10e0, 'x1', 560e0, 'bottom', 30e0, 'conf', 9e-1, 'label', 'brand logo'),
  named_struct('source', 'vision', 'seq', 1, 'x0', ax + 6, 'top', ay + 6, 'x1', ax + aw + 6, 'bottom', ay + ah + 6, 'conf', 5e-1 + 1e-1 * (page % 4), 'label', if(page % 2 = 1, 'logo', null)))"""


def detections(sizes: DataFrame) -> DataFrame:
    """doc_id, page, source (layout or vision), seq, x0, top, x1, bottom, conf, label: up to four a page."""
    return sizes.selectExpr("doc_id", "page", *_PLACE).selectExpr("doc_id", "page", f"inline({_MARKS})").where("source is not null")
