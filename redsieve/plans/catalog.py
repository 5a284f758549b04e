"""The registered queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redsieve.cli import initial_state
from redsieve.config import DEFAULT
from redsieve.operators import identity, metrics, regions, render, review, words
from redsieve.plans.loop import rule_history, rule_reviewer, run_loop, term_redactor
from redsieve.plans.oracles import ORACLES
from redsieve.plans.relations import Relations, table, told_apart
from redsieve.sources import detectors

__all__ = ["ORACLES", "QUERIES", "flagship"]

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    return words.redacted_text(r.words, r.word_marks)


def _reviewer_view(r: Relations) -> DataFrame:
    """What the reviewer's tool shows: texts are cut."""
    return words.redacted_text(r.words, r.word_marks, DEFAULT.reviewer_text_chars)


def _of(f: Callable[[Relations], DataFrame], written: bool = False) -> Query:
    return lambda spark, sf_dir: f(Relations(spark, sf_dir, written))


def _written(f: Callable[[Relations], DataFrame]) -> Query:
    """For queries that read marks or regions more than once."""
    return _of(f, written=True)


def _listing(rows: DataFrame, column: str, *fields: str) -> DataFrame:
    """A nested listing as one text a page."""
    item = lambda w: F.concat_ws(":", *[w[f].cast("string") for f in fields])
    return rows.select("doc_id", "page", F.array_join(F.transform(column, item), " ").alias("listing"))


def _span_apply(r: Relations) -> DataFrame:
    none = r.word_marks.limit(0)
    return words.apply_spans(r.words, none, words.word_spans(r.word_payloads))[1]


def _region_span_apply(r: Relations) -> DataFrame:
    new, result = words.apply_spans(r.regions, r.region_marks.limit(0), regions.region_spans(r.region_payloads))
    pages = regions.split_pages(r.regions, new).groupBy("doc_id").agg(F.count("*").alias("split_pages"))
    return result.join(pages, "doc_id", "left").withColumn("split_pages", F.coalesce("split_pages", F.lit(0)))


def _supplemental(r: Relations) -> DataFrame:
    return render.supplemental_pages(r.words, r.word_marks, r.regions, r.region_marks, r.split)


def _counter_difference(r: Relations) -> DataFrame:
    return metrics.counter_difference(metrics.tool_counters(r.tool_events), metrics.tool_counters(r.tool_events.where("iteration < 3")))


def _findings(r: Relations, findings: DataFrame) -> DataFrame:
    terms = identity.preparer_terms(r.parties)
    return regions.reviewed_findings(findings, r.regions, r.region_marks, r.words, terms).select("doc_id", "fid", "outcome")


def _finding_review(r: Relations) -> DataFrame:
    """The whole pipeline: all findings, brought to their source pages first."""
    return _findings(r, regions.remapped(r.findings, regions.page_map(r.sizes, _supplemental(r))))


def _runs(r: Relations) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp")
    return r.history.select("run_id").distinct().withColumns({"run_label": F.lit("nightly run"), "input_pdf": F.lit("/data/in.pdf"), "started_at": at("2024-01-02 03:04:05"), "finished_at": at("2024-01-02 03:04:17.346"), "total_words_redacted": F.lit(0).cast("long"), "total_regions_redacted": F.lit(0).cast("long")})


def _run_summary(r: Relations) -> DataFrame:
    return metrics.run_summary(_runs(r), r.history, r.tool_events).drop("run_label", "total_words_redacted", "total_regions_redacted")


def _run_metrics(r: Relations) -> DataFrame:
    """The parts of the nested structure that its flat summary hasn't."""
    runs = _runs(r).withColumn("page_split_pages", F.array(F.lit(3), (F.col("run_id") % 3).cast("int")))
    m = metrics.run_metrics(runs, r.history, r.tool_events)
    last = [F.col(f"metrics.reviewer_misses.final_iteration_by_type.{b}").alias(f"last_{b}") for b in metrics.BUCKETS]
    pages = F.array_join(F.col("metrics.totals.page_split_pages").cast("array<string>"), ",")
    return m.select("run_id", F.col("metrics.input_pdf").alias("input_pdf"), pages.alias("split_pages"), *last, F.size("metrics.per_iteration").cast("long").alias("iterations"), F.col("metrics.reviewer_misses.total_flagged_across_iterations").alias("flagged"))


def _draw_list(r: Relations) -> DataFrame:
    """Page by page; documents that share a doc_id, whose pages run into each other, by joins."""
    single, rest = told_apart(r.documents)
    drawn = render.drawn_pages(r.pages(single))
    if rest is None:
        return drawn
    o = Relations(r.spark, r.sf_dir, True, rest)
    return drawn.unionByName(render.draw_list(o.words, o.word_marks, o.regions, o.region_marks, o.split, o.sizes))


def _loop(r: Relations) -> DataFrame:
    """Document by document; those that share a doc_id, whose pages run into each other, by joins."""
    columns = ["run_id", "iteration", "verdict", "missed_count", "word_delta", "region_delta", "stall_streak", "decision"]
    single, rest = told_apart(r.documents)
    history = rule_history(single, r.terms).select(columns)
    if rest is None:
        return history
    return history.unionByName(run_loop(initial_state(r.spark, rest), term_redactor(r.terms), rule_reviewer())[1].select(columns))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, answer, n: each turn as a reviewer's answer, in whose middle a verdict stands."""
    t = table(spark, sf_dir, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    answer = F.format_string('%s {"verdict": "%s", "missed": [{"page": %d, "type": "logo", "bbox": [1, 2, 3, 4.5]}], "feedback": "again"} end', F.coalesce("text", F.lit("")), F.when(F.col("n") % 2 == 0, "APPROVED").otherwise("REVISE"), F.col("n") % 9)
    return t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), answer.alias("answer"), "n")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the redactor gets after each answer; approvals are taken for too early."""
    v = review.parsed_verdicts(_answers(spark, sf_dir))
    return review.feedback(v, F.col("verdict") == "APPROVED")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = review.parsed_verdicts(_answers(spark, sf_dir))
    return review.missed_entries(v).join(v.select("doc_id", "verdict", "feedback"), "doc_id").select("doc_id", "verdict", "feedback", "page", "type", F.size("bbox").alias("corners"))


QUERIES: dict[str, Query] = {
    "words_scan": _of(lambda r: r.words),
    "page_sizes": _of(lambda r: r.sizes),
    "text_layer_gate": _of(lambda r: detectors.usable_text_layer(r.words)),
    "degenerate_layout": _of(lambda r: render.degenerate_pages(r.words)),
    "term_sweep_counts": _of(lambda r: words.sweep_counts(r.hits)),
    "term_sweep_marks": _of(lambda r: r.word_marks),
    "words_listing": _of(lambda r: _listing(words.list_words(r.words, r.word_marks), "words", "idx", "text", "redacted")),
    "visible_words": _of(lambda r: words.visible(r.words, r.word_marks).select("doc_id", "page", "idx", "text")),
    "redacted_text_view": _of(_reviewer_view),  # cut, as its SQL has it; redacted_documents is whole
    "redacted_documents": flagship,
    "span_apply": _of(_span_apply),
    "region_strategy": _of(lambda r: r.regions),
    "region_listing": _written(lambda r: _listing(regions.list_regions(r.regions, r.region_marks), "regions", "idx", "kind", "strategy", "redacted")),
    "region_span_apply": _written(_region_span_apply),
    "bbox_inflate": _written(lambda r: regions.apply_boxes(r.regions, r.sizes, regions.box_spans(r.box_payloads))[0].select("doc_id", "page", "idx", "x0", "top", "x1", "bottom", "label")),
    "detection_fusion": _of(lambda r: regions.fused(r.detections)),
    "detection_sources": _of(lambda r: regions.source_counts(r.detections)),
    "template_propagation": _written(lambda r: regions.propagated(r.detected, r.words, r.sizes)),
    "region_summary": _of(lambda r: regions.region_summary(r.regions)),
    "occluded_words": _written(lambda r: render.occluded(r.words, r.word_marks, r.regions, r.region_marks).select(*words.KEY)),
    "supplemental_pages": _written(_supplemental),
    "page_map": _written(lambda r: regions.page_map(r.sizes, _supplemental(r))),
    "overlay_rects": _written(lambda r: render.overlay(r.words, r.word_marks, r.regions, r.region_marks)),
    "draw_list": _of(_draw_list),
    "finding_filter": _written(lambda r: _findings(r, r.findings)),
    "finding_review": _written(_finding_review),
    "identity_terms": _of(lambda r: identity.identity_terms(r.parties)),
    "evidence_text": _of(lambda r: words.evidence_text(r.words, r.sizes)),
    "text_chunks": _of(lambda r: review.text_chunks(r.documents)),
    "pii_rule_entities": _of(lambda r: review.rule_entities(review.text_chunks(r.documents))),
    "verdict_entries": _verdicts,
    "feedback_payload": _feedback,
    "miss_buckets": _of(lambda r: review.miss_buckets(r.misses, "run_id")),
    "tool_counters": _of(lambda r: metrics.tool_counters(r.tool_events)),
    "counter_difference": _of(_counter_difference),
    "history_deltas": _of(lambda r: metrics.deltas(r.totals)),
    "stall_streak": _of(lambda r: metrics.streaks(r.history).select("run_id", "iteration", "stall_streak", "zero_streak")),
    "loop_decisions": _of(lambda r: metrics.decisions(r.history).select("run_id", "iteration", "decision")),
    "loop_exit": _of(lambda r: metrics.exits(r.history)),
    "attribution": _of(lambda r: metrics.attribution(r.history)),
    "words_and_regions_by_tool": _of(lambda r: metrics.by_tool(r.tool_events)),
    "run_summary": _of(_run_summary),
    "run_metrics": _of(_run_metrics),
    "redaction_loop": _of(_loop),
}
