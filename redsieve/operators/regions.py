"""Visual regions: strategy, fusion, propagation, listing, spans, boxes, and the filter of findings.

Regions have doc_id, page, idx, kind, a box, confidence, label and strategy. Detections have doc_id, page, source, seq, a box,
conf and label; seq orders them, as fusion depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsieve.config import DEFAULT
from redsieve.functions import geometry as g
from redsieve.functions.payload import REGION_KEYS, read_box_payload, read_index_payload
from redsieve.operators.words import KEY, flagged

_BOX = [f"{f}" for f in g.FIELDS]
_REGION = ["doc_id", "page", "idx", "kind", *_BOX, "confidence", "label", "strategy"]


def enclosed_words(boxes: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` with n_words, the words of their page whose centres they hold. keys: what tells the boxes of a page apart."""
    w = words.select("doc_id", "page", *[F.col(f).alias(f"w_{f}") for f in _BOX])
    inside = boxes.join(w, ["doc_id", "page"]).where(g.center_in(g.box("w_"), g.box())).groupBy("doc_id", "page", *keys).agg(F.count("*").alias("n_words"))
    return boxes.join(inside, ["doc_id", "page", *keys], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))


def strategy(b: g.Box, width: Column, height: Column, n_words: Column) -> Column:
    """``page_split`` for what lies behind a page's text, else ``inline``."""
    page = width * height
    behind = (F.try_divide(g.area(b), page) >= DEFAULT.background_area_ratio) | (n_words >= DEFAULT.background_words)
    return F.when((F.coalesce(width, F.lit(0.0)) > 0) & (F.coalesce(height, F.lit(0.0)) > 0) & behind, F.lit("page_split")).otherwise(F.lit("inline"))


def classified(boxes: DataFrame, words: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    rows = enclosed_words(boxes, words, keys).join(sizes, ["doc_id", "page"], "left")
    return rows.withColumn("strategy", strategy(g.box(), F.col("width"), F.col("height"), F.col("n_words"))).drop("width", "height")


def enclosed(b: g.Box, words: Column) -> Column:
    """n_words of a box of one page, whose words are an array."""
    return F.size(F.filter(words, lambda w: g.center_in(g.box_in(w), b)))


def fused(detections: DataFrame) -> DataFrame:
    """doc_id, page, idx, box, conf, label: the layout boxes of a page in order, into which its vision boxes go one after the other.
    A vision box grows the first box that it matches, grown ones included, and gives it its label, or else is added."""
    entry = F.struct("seq", *_BOX, "conf", F.nullif("label", F.lit("")).alias("label"))
    of = lambda source: F.transform(F.array_sort(F.filter(F.collect_list(F.struct(F.col("source").alias("s"), entry.alias("e"))), lambda x: x["s"] == source)), lambda x: x["e"])
    pages = detections.groupBy("doc_id", "page").agg(of("layout").alias("layout"), of("vision").alias("vision"))

    def merge(boxes: Column, v: Column) -> Column:
        match = lambda c: g.iou(g.box_in(v), g.box_in(c)) >= DEFAULT.fusion_iou
        at = F.array_position(F.transform(boxes, match), True)
        u = lambda c: g.union(g.box_in(v), g.box_in(c))
        grown = lambda c: F.struct(c["seq"].alias("seq"), *[x.alias(f) for f, x in u(c)._asdict().items()], F.greatest(v["conf"], c["conf"]).alias("conf"), F.coalesce(v["label"], c["label"]).alias("label"))
        return F.when(at > 0, F.transform(boxes, lambda c, i: F.when(i + 1 == at, grown(c)).otherwise(c))).otherwise(F.concat(boxes, F.array(v)))

    boxes = pages.select("doc_id", "page", F.posexplode(F.aggregate("vision", F.col("layout"), merge)).alias("idx", "b"))
    return boxes.select("doc_id", "page", "idx", *[F.col(f"b.{f}") for f in (*_BOX, "conf", "label")])


def detected_regions(detections: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fused detections as regions, before propagation."""
    rows = classified(fused(detections), words, sizes, ["idx"])
    kind = F.when(F.col("label").isNotNull() | (F.col("strategy") == "inline"), F.lit("logo")).otherwise(F.lit("figure"))
    return rows.withColumn("kind", kind).withColumnRenamed("conf", "confidence").select(*_REGION)


def small_marks(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    page = F.col("width") * F.col("height")
    ratio = F.try_divide(g.area(g.box()), page)
    return regions.join(sizes, ["doc_id", "page"]).where((page > 0) & (ratio <= DEFAULT.template_max_area_ratio)).select(*regions.columns)


def clusters(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """``regions`` that are small marks, with ``cluster``: a document's marks in order of page and idx, each in the first cluster whose
    head it matches, or the head of a new one. A document's marks are one row."""
    mark = F.struct("page", "idx", *_BOX, "confidence", "label")
    docs = small_marks(regions, sizes).groupBy("doc_id").agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    box = lambda m: F.struct(*[m[f].alias(f) for f in _BOX])

    def place(state: Column, m: Column) -> Column:
        match = lambda h: g.iou(g.box_in(m), g.box_in(h)) >= DEFAULT.template_iou
        at = F.array_position(F.transform(state["heads"], match), True)
        heads = F.when(at > 0, state["heads"]).otherwise(F.concat(state["heads"], F.array(box(m))))
        cluster = F.when(at > 0, at - 1).otherwise(F.size(state["heads"])).cast("long")
        return F.struct(heads.alias("heads"), F.concat(state["of"], F.array(cluster)).alias("of"))

    nothing = F.struct(F.array().cast(f"array<struct<{','.join(f'{f}:double' for f in _BOX)}>>").alias("heads"), F.array().cast("array<bigint>").alias("of"))
    docs = docs.withColumn("of", F.aggregate("marks", nothing, place)["of"])
    rows = docs.select("doc_id", F.explode(F.arrays_zip("marks", "of")).alias("z"))
    return rows.select("doc_id", *[F.col(f"z.marks.{f}") for f in ("page", "idx", *_BOX, "confidence", "label")], F.col("z.of").alias("cluster"))


def propagated(regions: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions to add: marks that recur at one place on enough pages, on the pages that lack them. Boxes that are added don't keep
    others away."""
    return classified(recurring(regions, sizes), words, sizes, ["idx"]).withColumn("kind", F.lit("logo")).select(*_REGION)


def recurring(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """The boxes of propagated()."""
    order = F.struct("page", "idx")
    label = F.nullif("label", F.lit(""))
    named = F.min(F.when(label.isNotNull(), F.struct("page", "idx", label.alias("label"))))["label"]
    means = [F.avg(F.col(f)).alias(f) for f in _BOX]
    c = clusters(regions, sizes)
    marks = c.groupBy("doc_id", "cluster").agg(F.collect_set("page").alias("pages"), *means, F.min("confidence").alias("confidence"), F.coalesce(named, F.lit("template-logo")).alias("label"), F.min(order).alias("_o")).where(F.size("pages") >= DEFAULT.template_min_pages).drop("_o")
    wanted = marks.join(sizes.select("doc_id", "page"), "doc_id").where(~F.array_contains("pages", F.col("page"))).drop("pages")
    there = regions.select(F.col("doc_id").alias("r_doc_id"), F.col("page").alias("r_page"), *[F.col(f).alias(f"r_{f}") for f in _BOX])
    on = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & (g.iou(g.box(), g.box("r_")) >= DEFAULT.template_iou)
    missing = wanted.join(there, on, "left_anti")
    next_idx = regions.groupBy("doc_id", "page").agg((F.max("idx") + 1).alias("_next"))
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("cluster")) - 1
    return missing.join(next_idx, ["doc_id", "page"], "left").withColumn("idx", (F.coalesce("_next", F.lit(0)) + place).cast("int")).drop("_next", "cluster")


def extracted_regions(detections: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """All regions of the documents: fused detections and what propagates from them."""
    found = detected_regions(detections, words, sizes)
    return found.unionByName(propagated(found, words, sizes))


def extracted_counts(detections: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, n: how many extracted_regions() there are; it takes no words to tell."""
    found = fused(detections).withColumnRenamed("conf", "confidence")
    return found.select("doc_id").unionByName(recurring(found, sizes).select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))


def list_regions(regions: DataFrame, marks: DataFrame, only_unredacted: bool = False) -> DataFrame:
    """doc_id, page, regions (in order): a row per page that has any to list."""
    rows = flagged(regions, marks)
    rows = rows.where(~F.col("redacted")) if only_unredacted else rows
    item = F.struct("idx", "kind", F.array(*_BOX).alias("bbox"), F.bround("confidence", 3).alias("confidence"), "label", "strategy", "redacted")
    return rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("regions"))


def region_spans(payloads: DataFrame) -> DataFrame:
    """As word_spans(), for region_indices, else indices."""
    return payloads.select("doc_id", read_index_payload(F.col("spans_json"), REGION_KEYS, ("region_indices", "indices")).alias("p")).select("doc_id", "p.*")


def split_pages(regions: DataFrame, new_marks: DataFrame) -> DataFrame:
    """doc_id, page of newly marked regions that lie behind the text."""
    return regions.where("strategy = 'page_split'").join(new_marks, KEY, "left_semi").select("doc_id", "page").distinct()


def box_spans(payloads: DataFrame) -> DataFrame:
    return payloads.select("doc_id", read_box_payload(F.col("spans_json")).alias("p")).select("doc_id", "p.*")


def _next_index(regions: DataFrame) -> DataFrame:
    """doc_id, page, next: a count that goes up with each region in order, and past each region's index."""
    idx = F.transform(F.array_sort(F.collect_list(F.struct("page", "idx"))), lambda r: r["idx"])
    return regions.groupBy("doc_id", "page").agg(F.aggregate(idx, F.lit(-1), lambda n, i: F.greatest(n + 1, i + 1)).alias("next"))


def apply_boxes(regions: DataFrame, sizes: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New regions, each to be marked, and doc_id, added, invalid. Boxes grow on each side, as far as the page goes."""
    b = spans.select("doc_id", F.explode("boxes").alias("b")).select("doc_id", "b.*").join(sizes, ["doc_id", "page"], "left")
    good = F.col("width").isNotNull() & (F.col("x1") > F.col("x0")) & (F.col("bottom") > F.col("top"))
    b = b.withColumn("good", F.coalesce(good, F.lit(False)))
    grown = g.inflated(g.box(), DEFAULT.bbox_inflate_points, F.col("width"), F.col("height"))
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")) - 1
    new = b.where("good").withColumn("_p", place).join(_next_index(regions), ["doc_id", "page"], "left")
    new = new.select("doc_id", "page", (F.coalesce("next", F.lit(0)) + F.col("_p")).cast("int").alias("idx"), F.lit("logo").alias("kind"), *[c.alias(f) for f, c in grown._asdict().items()], "confidence", "label", F.lit("inline").alias("strategy"))
    bad = b.groupBy("doc_id").agg(F.count_if("good").alias("added"), F.count_if(~F.col("good")).alias("bad"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    result = spans.groupBy("doc_id").agg(F.sum("invalid").alias("invalid")).join(bad, "doc_id", "left").select("doc_id", zero("added").alias("added"), (zero("invalid") + zero("bad")).alias("invalid"))
    return new, result


def source_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("source").agg(F.count("*").alias("n"))


def region_summary(regions: DataFrame) -> DataFrame:
    """doc_id, regions, pages, inline, page_split."""
    return regions.groupBy("doc_id").agg(F.count("*").alias("regions"), F.count_distinct("page").alias("pages"), F.count_if(F.col("strategy") == "inline").alias("inline"), F.count_if(F.col("strategy") == "page_split").alias("page_split"))


def page_map(sizes: DataFrame, supplemental: DataFrame) -> DataFrame:
    """doc_id, rendered_page, source_page: each page is followed by its supplemental one, which has no source page."""
    p = sizes.select("doc_id", "page").join(supplemental.select("doc_id", "page", F.lit(1).alias("s")), ["doc_id", "page"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("rendered_page", (F.col("page") + before).cast("int"))
    own = p.select("doc_id", "rendered_page", F.col("page").alias("source_page"))
    return own.unionByName(p.where("s = 1").select("doc_id", (F.col("rendered_page") + 1).alias("rendered_page"), F.lit(None).cast("int").alias("source_page")))


def remapped(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """findings with the source page; those on supplemental pages go, and pages that aren't in the map stay as they are."""
    m = pages.select("doc_id", F.col("rendered_page").alias("page"), "source_page", F.lit(True).alias("_m"))
    j = findings.join(m, ["doc_id", "page"], "left").where("_m is null or source_page is not null")
    return j.withColumn("page", F.coalesce("source_page", "page")).select(*findings.columns)


def reviewed_findings(findings: DataFrame, regions: DataFrame, marks: DataFrame, words: DataFrame, preparer: DataFrame) -> DataFrame:
    """``findings`` (doc_id, fid, page, box, confidence, label) with ``outcome``: dedupe (a marked region covers it), label or text
    (it is the preparer's own, by its label or by the words in it), else kept. A finding without a page or box is kept.
    preparer: doc_id, terms (lower case)."""
    marked = regions.join(marks, KEY, "left_semi").select("doc_id", "page", *[F.col(f).alias(f"r_{f}") for f in _BOX])
    whole = F.col("page").isNotNull() & F.col("x0").isNotNull() & F.col("top").isNotNull() & F.col("x1").isNotNull() & F.col("bottom").isNotNull()
    f = findings.withColumn("_whole", whole)
    covered = f.where("_whole").join(marked, ["doc_id", "page"]).where(g.iou(g.box(), g.box("r_")) >= DEFAULT.logo_dedupe_iou).select("doc_id", "fid").distinct().withColumn("_covered", F.lit(True))
    w = words.select("doc_id", "page", "idx", "text", *[F.col(x).alias(f"w_{x}") for x in _BOX])
    inside = f.where("_whole").join(preparer.select("doc_id"), "doc_id", "left_semi").join(w, ["doc_id", "page"]).where(g.center_in(g.box("w_"), g.box()))
    inside = inside.groupBy("doc_id", "fid").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")).alias("_text"))
    j = f.join(covered, ["doc_id", "fid"], "left").join(inside, ["doc_id", "fid"], "left").join(preparer.select("doc_id", "terms"), "doc_id", "left")
    has = lambda text: F.coalesce(F.exists("terms", lambda t: F.contains(text, t)), F.lit(False))
    label = F.lower(F.coalesce("label", F.lit("")))
    outcome = F.when(~F.col("_whole"), F.lit("kept")).when(F.col("_covered"), F.lit("dedupe")).when((label != "") & has(label), F.lit("label")).when(F.coalesce(F.col("_text"), F.lit("")) != "", F.when(has(F.col("_text")), F.lit("text")).otherwise(F.lit("kept"))).otherwise(F.lit("kept"))
    return j.withColumn("outcome", outcome).select(*findings.columns, "outcome")
