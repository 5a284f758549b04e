"""Where results go: audit trails, metrics, summaries, reports, rasters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redsieve.functions.text import file_timestamp, safe_label
from redsieve.operators.metrics import SUMMARY

_NULLS = {"ignoreNullFields": "false"}


def audit_rows(audits: DataFrame) -> DataFrame:
    """run_id, value: a JSON text a run, nulls written."""
    return audits.select("run_id", F.to_json(F.struct(*[c for c in audits.columns if c != "run_id"]), _NULLS).alias("value"))


def write_audits(audits: DataFrame, path: str) -> None:
    """A folder per run, in it the run's audit trail."""
    audit_rows(audits).write.mode("append").partitionBy("run_id").text(path)


def metrics_rows(metrics: DataFrame) -> DataFrame:
    """name, value: ``run_<timestamp>_<label>`` and the metrics as JSON. metrics: as run_metrics() returns them."""
    name = F.concat_ws("_", F.lit("run"), file_timestamp(F.col("timestamp")), safe_label(F.col("run_label")))
    return metrics.select(name.alias("name"), F.to_json("metrics", _NULLS).alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics_rows(metrics).write.mode("append").partitionBy("name").text(path)


def append_summary(summary: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files, each with the header."""
    summary.select(*SUMMARY).write.mode("append").option("header", True).csv(path)


def report(row: dict) -> str:
    """A run's summary as text; ``row`` is one row of run_summary()."""
    width = max(map(len, SUMMARY))
    return "\n".join(f"{c.replace('_', ' '):<{width}}  {'' if row.get(c) is None else row[c]}" for c in SUMMARY)


def tool_results(results: DataFrame) -> DataFrame:
    """doc_id, value: what a tool tells the agent, as JSON."""
    return results.select("doc_id", F.to_json(F.struct(*[c for c in results.columns if c != "doc_id"]), _NULLS).alias("value"))


def render_rasters(draw: DataFrame, render: Callable[[int, pd.DataFrame], bytes]) -> DataFrame:
    """doc_id, page, image. render: a page's number and its draw list in order to an image; it needs an imaging library, which this
    package doesn't bring. One page of one document is in memory at a time."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "page": [key[1]], "image": [render(key[1], rows.sort_values(["layer", "z", "idx"]))]})

    return draw.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, image binary")
