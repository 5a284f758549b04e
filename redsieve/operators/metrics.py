"""Iteration history, tool counters, loop control and run metrics.

History has run_id, iteration, verdict, missed_count, word_delta, region_delta (what an iteration added) and miss buckets; tool
events have run_id, iteration, tool, words_added, regions_added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from redsieve.config import DEFAULT, MISS_TYPES, REGION_TOOLS, WORD_TOOLS

BUCKETS = tuple(t.lower() for t in MISS_TYPES)


def _run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("iteration")


def tool_counters(events: DataFrame, *keys: str) -> DataFrame:
    """keys (run_id by default), tool, calls, words_added, regions_added."""
    return events.groupBy(*(keys or ("run_id",)), "tool").agg(F.count("*").alias("calls"), F.sum("words_added").alias("words_added"), F.sum("regions_added").alias("regions_added"))


def counter_difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """What each tool of ``after`` has more than in ``before``; tools without any change are left out."""
    names = ("calls", "words_added", "regions_added")
    b = before.select("run_id", "tool", *[F.col(n).alias(f"_{n}") for n in names])
    j = after.join(b, ["run_id", "tool"], "left").select("run_id", "tool", *[(F.col(n) - F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names])
    return j.where(" or ".join(f"{n} <> 0" for n in names))


def deltas(totals: DataFrame) -> DataFrame:
    """``totals`` (run_id, iteration, words_total, regions_total) with word_delta and region_delta."""
    step = lambda c: F.col(c) - F.lag(c, 1, 0).over(_run())
    return totals.withColumn("word_delta", step("words_total")).withColumn("region_delta", step("regions_total"))


def _streak(df: DataFrame, holds: Column, name: str) -> DataFrame:
    """``name``: how many rows in a row ``holds``, up to and with this one."""
    df = df.withColumn("_h", F.coalesce(holds, F.lit(False)))
    df = df.withColumn("_g", F.sum((~F.col("_h")).cast("int")).over(_run()))
    return df.withColumn(name, F.sum(F.col("_h").cast("int")).over(Window.partitionBy("run_id", "_g").orderBy("iteration")).cast("int")).drop("_h", "_g")


def streaks(history: DataFrame) -> DataFrame:
    """``history`` with stall_streak (nothing was added and no fewer misses than before) and zero_streak (nothing was added)."""
    added = F.col("word_delta") + F.col("region_delta")
    before = F.lag("missed_count").over(_run())
    df = history.withColumn("_stalled", (F.col("missed_count") >= before) & (added == 0))
    return _streak(_streak(df, F.col("_stalled"), "stall_streak").drop("_stalled"), added == 0, "zero_streak")


def approved(verdict: Column) -> Column:
    return F.coalesce(verdict.isin("APPROVED", "APPROVED_WITH_ISSUES"), F.lit(False))


def decisions(history: DataFrame, most: int | None = None, least: int = DEFAULT.min_iterations) -> DataFrame:
    """``history`` with streaks and decision: approved, forced (approved too early: go on), stalled, limit or feedback."""
    most = max(1, DEFAULT.max_iterations if most is None else most)
    least = min(least, most)
    return streaks(history).withColumn("decision", decided(F.col("iteration"), F.col("verdict"), F.col("stall_streak"), most, least))


def decided(it: Column, verdict: Column, stall_streak: Column, most: int, least: int) -> Column:
    ok = approved(verdict)
    return F.when(ok & (it >= least), "approved").when(ok, "forced").when((stall_streak >= DEFAULT.stall_limit) & (it >= least), "stalled").when(it >= most, "limit").otherwise("feedback")


def exits(history: DataFrame, most: int | None = None, least: int = DEFAULT.min_iterations) -> DataFrame:
    """run_id, iteration, decision: where each run stops; runs that never do aren't there."""
    last = decisions(history, most, least).where(F.col("decision").isin("approved", "stalled", "limit"))
    return last.groupBy("run_id").agg(F.min(F.struct("iteration", "decision")).alias("e")).select("run_id", "e.iteration", "e.decision")


def attribution(history: DataFrame) -> DataFrame:
    """run_id and what the first iteration found by itself, and what later ones, which a review asked for, added."""
    part = lambda c, first: F.coalesce(F.sum(F.when((F.col("iteration") == 1) == first, F.col(c))), F.lit(0)).cast("long")
    return history.groupBy("run_id").agg(part("word_delta", True).alias("proactive_words"), part("region_delta", True).alias("proactive_regions"), part("word_delta", False).alias("reviewer_driven_words"), part("region_delta", False).alias("reviewer_driven_regions"))


def by_tool(events: DataFrame) -> DataFrame:
    """run_id and what each of the four tools added, 0 where it wasn't used."""
    total = lambda tool, c: F.coalesce(F.sum(F.when(F.col("tool") == tool, F.col(c))), F.lit(0)).cast("long")
    return events.groupBy("run_id").agg(*[total(t, "words_added").alias(f"words_via_{t}") for t in WORD_TOOLS], *[total(t, "regions_added").alias(f"regions_via_{t}") for t in REGION_TOOLS])


def misses(history: DataFrame) -> DataFrame:
    """run_id, misses of each bucket over all iterations, their sum, and the count and verdict of the last iteration."""
    sums = [F.coalesce(F.sum(b), F.lit(0)).cast("long").alias(f"misses_{b}") for b in BUCKETS]
    out = history.groupBy("run_id").agg(*sums, F.max_by("missed_count", "iteration").cast("long").alias("final_missed_count"), F.max_by("verdict", "iteration").alias("final_verdict"), F.count("*").alias("iterations_run"))
    return out.withColumn("total_misses_flagged", sum((F.col(f"misses_{b}") for b in BUCKETS), F.lit(0).cast("long")))


def base_name(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(F.coalesce(path, F.lit("")), "[/\\\\]"), -1), F.lit(""))


#: The columns of a run's summary, in the order in which they are written.
SUMMARY = (
    "timestamp", "run_label", "input_pdf", "iterations_run", "final_verdict", "duration_seconds", "total_words_redacted", "total_regions_redacted", "proactive_words", "proactive_regions", "reviewer_driven_words", "reviewer_driven_regions",
    *(f"words_via_{t}" for t in WORD_TOOLS), *(f"regions_via_{t}" for t in REGION_TOOLS), "final_missed_count", "total_misses_flagged", *(f"misses_{b}" for b in BUCKETS),
)


def run_summary(runs: DataFrame, history: DataFrame, events: DataFrame) -> DataFrame:
    """run_id and SUMMARY: a row per run. runs: run_id, run_label, input_pdf, started_at, finished_at, total_words_redacted,
    total_regions_redacted."""
    j = runs.join(misses(history), "run_id", "left").join(attribution(history), "run_id", "left").join(by_tool(events), "run_id", "left")
    seconds = F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6, 2)
    j = j.withColumns({"timestamp": F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss"), "duration_seconds": seconds, "input_pdf": base_name(F.col("input_pdf"))})
    zero = [c for c in SUMMARY if c.startswith(("proactive", "reviewer", "words_via", "regions_via", "misses_", "total_misses", "final_missed", "iterations"))]
    return j.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero}).select("run_id", *SUMMARY)


def run_metrics(runs: DataFrame, history: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, run_label, timestamp and metrics: one nested structure a run, with its iterations in order. runs: as run_summary() takes
    them, and page_split_pages (an array) if it is known."""
    s = run_summary(runs, history, events).drop("input_pdf")
    iteration = F.struct("iteration", "verdict", "missed_count", "word_delta", "region_delta", F.struct(*BUCKETS).alias("missed_by_type"))
    per = history.groupBy("run_id").agg(F.array_sort(F.collect_list(iteration)).alias("per_iteration"), *[F.max_by(b, "iteration").cast("long").alias(f"last_{b}") for b in BUCKETS])
    raw = tool_counters(events).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("tool", "calls", "words_added", "regions_added"))).alias("raw_counters"))
    pages = F.coalesce("page_split_pages", F.array().cast("array<int>")) if "page_split_pages" in runs.columns else F.array().cast("array<int>")
    own = runs.select("run_id", "input_pdf", F.array_sort(pages).alias("page_split_pages"), F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"))
    j = s.join(per, "run_id", "left").join(raw, "run_id", "left").join(own, "run_id")
    named = lambda prefix, names: F.struct(*[F.coalesce(f"{prefix}{n}", F.lit(0)).alias(n) for n in names])
    nested = F.struct(
        "run_label", "timestamp", "finished_at", "duration_seconds", "input_pdf", "iterations_run", "final_verdict",
        F.struct(F.col("total_words_redacted").alias("words_redacted"), F.col("total_regions_redacted").alias("regions_redacted"), "page_split_pages", "final_missed_count").alias("totals"),
        F.struct(named("proactive_", ("words", "regions")).alias("proactive"), named("reviewer_driven_", ("words", "regions")).alias("reviewer_driven")).alias("redactor_attribution"),
        F.struct(named("words_via_", WORD_TOOLS).alias("words_by_tool"), named("regions_via_", REGION_TOOLS).alias("regions_by_tool"), "raw_counters").alias("redactor_by_tool"),
        F.struct(F.col("total_misses_flagged").alias("total_flagged_across_iterations"), named("misses_", BUCKETS).alias("by_type_across_iterations"), F.col("final_missed_count").alias("final_iteration_count"), named("last_", BUCKETS).alias("final_iteration_by_type")).alias("reviewer_misses"),
        "per_iteration",
    )
    return j.select("run_id", "run_label", "timestamp", nested.alias("metrics"))
