"""Quality classifier: quadratic discriminant with shrunk class covariances over transformed document statistics.

The moments of both classes come from one aggregation over all labelled rows that aren't held out; the factors of the two
covariances are computed once on the driver (a few dozen numbers, whatever the size of the corpus) and scoring is arithmetic
on columns. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null or empty text is scored as a text of no words. Labels other than 0 and 1 and null labels are left out;
a document labelled twice counts twice in training, but is returned once. Without labels of both classes, every score is the
share of label 1 among those there are, or 0.5 without any. An empty table gives an empty one."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsieve.llm.common import KEY, row_key, saved, without
from redsieve.llm.textstats import with_statistics

#: Words, characters or lines that are added to what a rate is a part of, so that short texts get no extreme rates.
PRIOR = 30


def features() -> list[Column]:
    n, c = F.col("n_words"), F.col("word_chars")
    part = lambda x, of, prior: F.sqrt(F.col(x) / (of + prior))
    return [
        F.log1p(n),
        (c + 5 * PRIOR) / (n + PRIOR),
        part("n_symbols", c, 5 * PRIOR),
        part("n_punct", c, 5 * PRIOR),
        part("n_upper", F.col("n_letters"), 5 * PRIOR),
        part("n_exclaim", n, PRIOR),
        part("n_repeat_words", n, PRIOR),
        (F.log1p("n_distinct_words") + 1) / (F.log1p(n) + 1),
        part("n_dup_lines", F.col("n_lines"), 4),
        part("n_digits", c, 5 * PRIOR),
    ]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


@dataclass
class Discriminant:
    """Prior log odds, and mean, inverse lower factor and log determinant of each class. factors is empty if a class is missing."""

    odds: float
    factors: list[tuple[np.ndarray, np.ndarray, float]]

    def log_odds(self, x: list[Column]) -> Column:
        total = F.lit(self.odds)
        for sign, (mean, inverse, log_det) in zip((0.5, -0.5), self.factors, strict=False):
            total = total + sign * log_det
            for i in range(len(mean)):
                z = sum((float(inverse[i, k]) * (x[k] - float(mean[k])) for k in range(i + 1)), F.lit(0.0))
                total = total + sign * z * z
        return total


def fit(rows: DataFrame, d: int, shrinkage: float, floor: float) -> Discriminant:
    """rows: x (array of ``d`` doubles) and quality. The covariance of a class is drawn by ``shrinkage`` to the diagonal of the
    mean of both, and no direction gets a variance below ``floor`` squared."""
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, k) for i in range(d) for k in range(i + 1)]
    got = rows.where(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(x)], *[F.avg(x[i] * x[k]).alias(f"p{i}_{k}") for i, k in pairs])
    by = {r["quality"]: r for r in got.collect()}  # two rows
    n = [by[q]["n"] if q in by else 0 for q in (0, 1)]
    if not all(n):
        return Discriminant(math.inf if n[1] else -math.inf if n[0] else 0.0, [])
    means, scatters = [], []
    for q in (0, 1):
        mean, s = np.array([by[q][f"a{i}"] for i in range(d)]), np.zeros((d, d))
        for i, k in pairs:
            s[i, k] = s[k, i] = by[q][f"p{i}_{k}"] - mean[i] * mean[k]
        means.append(mean)
        scatters.append(s)
    target = np.diag(np.diag(scatters[0] + scatters[1]) / 2)
    factors = []
    for mean, s in zip(means, scatters, strict=True):
        lower = np.linalg.cholesky((1 - shrinkage) * s + shrinkage * target + floor**2 * np.eye(d))
        factors.append((mean, np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum())))
    return Discriminant(math.log(n[1] / n[0]), factors)


def _scored(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.05, floor: float = 0.01, threshold: float = 0.7) -> DataFrame:
    x = features()
    counts = with_statistics(docs.select("doc_id", "text", *row_key("doc_id", "text")))
    rows = saved(counts.select("doc_id", *KEY, F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in x]).alias("x")), "qda")
    model = fit(rows.where("not held_out").join(labels.select("doc_id", "quality"), "doc_id"), len(x), shrinkage, floor)
    odds = model.log_odds([F.col("x")[i] for i in range(len(x))])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))
    return rows.select("doc_id", *KEY, "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per document, learnt from the labelled documents that aren't held out."""
    return _scored(docs, labels, **parameters).drop(*KEY)


def without_low_quality(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows that are predicted to be of quality 1, in their own columns: each by its own text."""
    return without(docs, _scored(docs, labels, **parameters).where("predicted = 0"), "doc_id", "text")
