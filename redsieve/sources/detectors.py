"""Detections of layout and vision services as input relations; calling such services is left to plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsieve.config import DEFAULT
from redsieve.functions.geometry import polygon_box, unit_scale


def layout_figures(polygons: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """doc_id, page, source, seq, box, conf, label of polygons (doc_id, page, seq, unit, polygon) with four points or more.
    With ``sizes``, pages that a document doesn't have are left out, as at extraction; without, as at review, they stay."""
    b = polygon_box(F.col("polygon"), unit_scale(F.col("unit")))
    out = polygons.where(F.size("polygon") >= 8)
    if sizes is not None:
        out = out.join(sizes.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    return out.select("doc_id", "page", F.lit("layout").alias("source"), "seq", *[c.alias(n) for n, c in b._asdict().items()], F.lit(1.0).alias("conf"), F.lit(None).cast("string").alias("label"))


def vision_marks(objects: DataFrame, captions: DataFrame, keywords: tuple[str, ...] = DEFAULT.logo_keywords, least: float = DEFAULT.logo_min_confidence, dpi: int = DEFAULT.vision_dpi) -> DataFrame:
    """Objects (doc_id, page, seq, tags array of name and confidence, x, y, w, h in pixels) with a tag that names a mark, labelled by
    the last such tag and as sure as the surest, and captions (text, confidence) that name one; in points."""
    named = lambda name: F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(name), k))
    hits = F.filter("tags", lambda t: named(t["name"]))
    o = objects.withColumn("hits", hits).where(F.size("hits") > 0)
    o = o.select("doc_id", "page", "seq", "x", "y", "w", "h", F.array_max(F.transform("hits", lambda t: t["confidence"])).alias("conf"), F.try_element_at("hits", F.lit(-1))["name"].alias("label"), F.lit(0).alias("_k"))
    c = captions.where(named(F.col("text"))).select("doc_id", "page", "seq", "x", "y", "w", "h", F.col("confidence").alias("conf"), F.col("text").alias("label"), F.lit(1).alias("_k"))
    pt = 72.0 / dpi
    both = o.unionByName(c).where(F.col("conf") >= least)
    return both.select("doc_id", "page", F.lit("vision").alias("source"), (F.col("seq") * 2 + F.col("_k")).alias("seq"), (F.col("x") * pt).alias("x0"), (F.col("y") * pt).alias("top"), ((F.col("x") + F.col("w")) * pt).alias("x1"), ((F.col("y") + F.col("h")) * pt).alias("bottom"), "conf", "label")


def ocr_words(polygons: DataFrame) -> DataFrame:
    """Words of an OCR service (doc_id, page, idx, text, unit, polygon) as words with boxes in points."""
    b = polygon_box(F.col("polygon"), unit_scale(F.col("unit")))
    return polygons.where(F.size("polygon") >= 8).select("doc_id", "page", "idx", "text", *[c.alias(n) for n, c in b._asdict().items()])


WORDS = "path string, page int, idx int, text string, x0 double, top double, x1 double, bottom double, width double, height double"


def pdf_words(spark: SparkSession, path: str, read: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Words of PDF files under ``path``. read: the words of one file's bytes as rows of WORDS without the path; it needs a PDF
    library, which this package doesn't bring."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WORDS.split(", ")]
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(p, *row) for row in read(content)], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, WORDS)


def usable_text_layer(words: DataFrame, least: float = DEFAULT.min_word_height_points) -> DataFrame:
    """doc_id, median_height, usable: whether the words of a document are as high as words are; one row per document with words."""
    return words.groupBy("doc_id").agg(F.median(F.col("bottom") - F.col("top")).alias("median_height")).withColumn("usable", F.col("median_height") >= least)
