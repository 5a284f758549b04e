"""Command line: the loop over a folder of documents."""

from __future__ import annotations

import argparse
import datetime
import os
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from redsieve.config import read_env_file, settings
from redsieve.operators import regions, words
from redsieve.plans.loop import State, rule_reviewer, run_loop, term_redactor
from redsieve.sources import fixture, sinks


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="redsieve", description=__doc__)
    p.add_argument("--input", required=True, help="Parquet of doc_id and text, in any store that Spark reads")
    p.add_argument("--output", required=True, help="folder of the redacted texts, the history and the audit trails")
    p.add_argument("--term", action="append", default=[], help="a phrase to redact everywhere; may be given again")
    p.add_argument("--run-label", default=None)
    p.add_argument("--max-iterations", type=int, default=None)
    return p.parse_args(argv)


def initial_state(spark: SparkSession, documents) -> State:
    """Words in the made-up layout, regions of its detections, nothing marked."""
    w, s = fixture.words(documents), fixture.page_sizes(documents)
    r = regions.extracted_regions(fixture.detections(s), w, s)
    none = spark.createDataFrame([], "doc_id long, page int, idx int")
    return State(w, s, r, none, none, none.select("doc_id", "page"))


def main(argv: Sequence[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("redsieve").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        documents = spark.read.parquet(a.input)
    except Exception as e:
        print(f"can't read {a.input}: {e}", file=sys.stderr)
        return 2
    label = a.run_label or datetime.datetime.now().strftime("%Y%m%d-%H%M%S")
    terms = spark.createDataFrame([(k, t) for k, t in enumerate(a.term)], "term_no int, term string")
    env = read_env_file(Path.cwd()) | os.environ
    state, history = run_loop(initial_state(spark, documents), term_redactor(terms), rule_reviewer(), settings(env), a.max_iterations)
    words.redacted_text(state.words, state.word_marks).write.parquet(f"{a.output}/text")
    history = history.withColumn("run_label", F.lit(label))
    history.write.parquet(f"{a.output}/history")
    step = F.struct(*[c for c in history.columns if c not in ("run_id", "run_label")])
    sinks.write_audits(history.groupBy("run_id", "run_label").agg(F.array_sort(F.collect_list(step)).alias("history")), f"{a.output}/audit")
    return 0


if __name__ == "__main__":
    sys.exit(main())
