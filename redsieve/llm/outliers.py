"""Quality rules: robust multivariate outliers by minimum covariance determinant, built-in functions only.

Each language and source gets the location and scatter of those three quarters of its documents whose covariance has the least
determinant. The search has four deterministic starts for every group (medians and quartiles, all documents, the scatter of
hyperbolic tangents, the scatter of directions). Each takes two concentration steps; the start of least determinant goes on until no
group's determinant falls any more. A document whose squared Mahalanobis distance is over the quantile of chi-squared that a clean
one exceeds with a chance of FALSE_ALARM is rejected. Only rows of counts move; a group's state is its moments, so a source with a
third of all rows costs no more than others. The three quarters are counted to a hundredth of a percent (percentile_approx).

Defined results: a null or empty text has no words, fails the base rules and takes no part in the estimates. A null language
or source is a group of its own. Groups under ``min_rows`` pool their rows by language, then over all; where even that pool is
under ``min_rows``, it is judged by the estimates of all documents. Where the whole table is under it, only the base rules decide, as
five statistics have no scatter then. Ties and repeated rows count as they are. An empty table gives an empty one."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsieve.llm.common import KEY, row_key, saved, without
from redsieve.llm.textstats import base_failed, with_statistics

#: Words of the language's own mean that are added to a document's, so that short documents don't stand out by chance.
PRIOR_WORDS = 100
#: Least standard deviation of each statistic; a statistic that is the same in nearly all documents gets it.
FLOORS = {"x_length": 0.25, "x_word": 0.15, "x_symbol": 0.04, "x_punct": 0.015, "x_upper": 0.02}
#: Chance that a clean document is rejected, by which the cut is set.
FALSE_ALARM = 1e-7
#: Reciprocal of the error of ranks.
RANKS = 10_000
#: Concentration steps at most, and the fall of a logarithm of a determinant that counts as none.
MOST_STEPS, SAME = 40, 1e-9
#: What a verdict depends on, besides the other documents.
JUDGED = ("doc_id", "text", "lang", "source")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_punct")


def chi2_quantile(above: float, degrees: int) -> float:
    """What chi-squared with so many degrees of freedom exceeds with a chance of ``above``."""

    def chance(x: float) -> float:
        d, q = (1, math.erfc(math.sqrt(x / 2))) if degrees % 2 else (2, math.exp(-x / 2))
        while d < degrees:
            q += (x / 2) ** (d / 2) * math.exp(-x / 2) / math.gamma(d / 2 + 1)
            d += 2
        return q

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chance(middle) > above else (low, middle)
    return high


def statistics_table(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, the row key, the group keys, the counts and base_failed."""
    return with_statistics(docs.select("doc_id", "text", "lang", "source", *row_key(*JUDGED))).select("doc_id", *KEY, F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), *COUNTS).withColumn("base_failed", base_failed())


def _vectors(counts: DataFrame) -> DataFrame:
    """The transformed statistics; rates are shrunk towards those of the language."""
    ok = ~F.col("base_failed")
    total = lambda c: F.sum(F.when(ok, F.col(c)))
    rates = saved(counts.groupBy(F.col("_lang").alias("_l")).agg(total("n_words").alias("_w"), total("word_chars").alias("_c"), total("n_punct").alias("_p"), total("n_upper").alias("_u")), "rates", files=1)
    n, prior = F.col("n_words"), PRIOR_WORDS
    shrunk = lambda c, t: (F.col(c) + prior * F.try_divide(F.col(t), F.col("_w"))) / (n + prior)
    return counts.join(rates, F.col("_lang").eqNullSafe(F.col("_l"))).select(
        *counts.columns,
        F.log1p(n).alias("x_length"),
        shrunk("word_chars", "_c").alias("x_word"),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 2 * prior)).alias("x_symbol"),
        F.sqrt(shrunk("n_punct", "_p")).alias("x_punct"),
        F.sqrt(shrunk("n_upper", "_u")).alias("x_upper"),
    )


#: The pool of all documents.
_ALL = "[]"


def _pooled(v: DataFrame, min_rows: int) -> DataFrame:
    """``v`` with its group ``_g``, JSON of language and source, or the pool of small ones; null where the table is too small."""
    name = lambda *c: F.to_json(F.array(*[F.col(x) for x in c]))
    n = F.count(F.when(~F.col("base_failed"), 1))
    sizes = v.groupBy("_lang", "_source").agg(n.alias("_n"))  # a row per group
    sizes = sizes.withColumn("_g", F.when(F.col("_n") >= min_rows, name("_lang", "_source")))
    rest = F.sum(F.when(F.col("_g").isNull(), F.col("_n"))).over(Window.partitionBy("_lang"))
    sizes = sizes.withColumn("_g", F.coalesce("_g", F.when(rest >= min_rows, name("_lang"))))
    everything = F.sum("_n").over(Window.partitionBy())
    sizes = sizes.withColumn("_g", F.coalesce("_g", F.when(everything >= min_rows, F.lit(_ALL)))).select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), "_g")
    return v.join(saved(sizes, "groups", files=1), F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))).drop("_l", "_s")


def _estimated(v: DataFrame, min_rows: int) -> DataFrame:
    """The rows that estimates are made of, each in its group: all documents in the last pool, if its own are too few."""
    rows = v.where("not base_failed and _g is not null")
    own = rows.where(F.col("_g") == _ALL).count()
    return rows.withColumn("_g", F.explode(F.array_distinct(F.array("_g", F.lit(_ALL))))) if 0 < own < min_rows else rows


def _distance(v: DataFrame, fit: DataFrame, names: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """``v`` with ``_d2``, the squared Mahalanobis distance, by forward substitution in the stored factor. A row for each fit of
    the row's group."""
    d = len(names)
    df = v.join(fit, "_g", "left")
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"_z{k}")
        df = df.withColumn(f"_z{i}", rest / F.col(f"l{i}{i}"))
    return df.select(*v.columns, *keep, sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(d)), F.lit(0.0)).alias("_d2"))


def _factored(df: DataFrame, s: dict[tuple[int, int], Column], names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """_g, _s, the centre (columns m0, ... of ``df``), the factor of ``s`` and the logarithm of its determinant. A projection for
    each column of the factor, as the driver plans each of them."""
    d = len(names)
    s = {(i, k): e + (F.lit(FLOORS[names[i]] ** 2) if i == k else F.lit(0.0)) for (i, k), e in s.items()}
    for j in range(d):
        rest = {i: s[i, j] for i in range(j, d)}
        for i in rest:
            for k in range(j):
                rest[i] = rest[i] - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumns({f"l{i}{j}": F.sqrt(e) if i == j else e / F.sqrt(rest[j]) for i, e in rest.items()})
    det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(d)), F.lit(0.0))
    return df.select("_g", "_s", *[f"m{i}" for i in range(d)], *[f"l{i}{k}" for i in range(d) for k in range(i + 1)], det.alias("_det"), *keep)


def _starts(v: DataFrame, names: list[str]) -> DataFrame:
    """Four fits of each group, told apart by ``_s``."""
    d = len(names)
    pairs = [(i, k) for i in range(d) for k in range(i + 1)]
    q = v.groupBy("_g").agg(*[F.percentile_approx(name, [0.25, 0.5, 0.75], RANKS).alias(f"q{i}") for i, name in enumerate(names)])
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[names[i]]))  # noqa: E731  1.349: of a normal, in deviations
    q = saved(q.select("_g", *[F.col(f"q{i}")[1].alias(f"c{i}") for i in range(d)], *[spread(i).alias(f"w{i}") for i in range(d)]), "mcd-quartiles", files=1)
    z = v.join(q, "_g").select("_g", *[((F.col(name) - F.col(f"c{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i, name in enumerate(names)])
    z = z.withColumn("r2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(d)), F.lit(0.0)))
    avg = lambda e, name: F.avg(e).alias(name)
    got = z.groupBy("_g").agg(
        *[avg(F.col(f"z{i}"), f"a{i}") for i in range(d)],
        *[avg(F.col(f"z{i}") * F.col(f"z{k}"), f"p{i}{k}") for i, k in pairs],
        *[avg(F.tanh(f"z{i}") * F.tanh(f"z{k}"), f"t{i}{k}") for i, k in pairs],
        *[avg(F.when(F.col("r2") > 0, F.col(f"z{i}") * F.col(f"z{k}") / F.col("r2")), f"u{i}{k}") for i, k in pairs],
    )
    got = got.join(q, "_g")
    scaled = lambda e, i, k: F.coalesce(e, F.lit(0.0)) * F.col(f"w{i}") * F.col(f"w{k}")
    forms = (
        lambda i, k: F.lit(1.0 if i == k else 0.0),
        lambda i, k: F.col(f"p{i}{k}") - F.col(f"a{i}") * F.col(f"a{k}"),
        lambda i, k: F.col(f"t{i}{k}"),
        lambda i, k: F.col(f"u{i}{k}") * d,
    )
    centre = lambda at, i: F.col(f"c{i}") + (F.col(f"a{i}") * F.col(f"w{i}") if at == 1 else F.lit(0.0))
    fits = F.array(*[F.struct(*[centre(at, i).alias(f"m{i}") for i in range(d)], *[scaled(form(i, k), i, k).alias(f"s{i}{k}") for i, k in pairs]) for at, form in enumerate(forms)])
    each = got.select("_g", F.posexplode(fits).alias("_s", "_f")).select("_g", "_s", "_f.*")
    return saved(_factored(each, {(i, k): F.col(f"s{i}{k}") for i, k in pairs}, names), "mcd-start", files=1)


def _step(v: DataFrame, fit: DataFrame, names: list[str], share: float) -> DataFrame:
    """One concentration step of each fit: the moments of the ``share`` of the group that lies closest to it. _last: the logarithm of
    the determinant before the step. A fit's columns go along with its rows, so each pass over them has one join."""
    d = len(names)
    of = [c for c in fit.columns if c != "_g"]
    cut = saved(_distance(v, fit, names, of).groupBy("_g", *of).agg(F.percentile_approx("_d2", share, RANKS).alias("_cut")), "mcd-cut", files=1)
    near = _distance(v, cut, names, ("_s", "_det", "_cut", *[f"m{i}" for i in range(d)])).where("_d2 <= _cut")
    x = [F.col(name) - F.col(f"m{i}") for i, name in enumerate(names)]  # about the last centre, so that nothing cancels
    got = near.groupBy("_g", "_s").agg(*[F.avg(x[i]).alias(f"a{i}") for i in range(d)], *[F.avg(x[i] * x[k]).alias(f"p{i}{k}") for i in range(d) for k in range(i + 1)], *[F.first(f"m{i}").alias(f"o{i}") for i in range(d)], F.first("_det").alias("_last"))
    # the truncated scatter is too small by a constant for each share; _calibrated() makes up for it
    s = {(i, k): F.col(f"p{i}{k}") - F.col(f"a{i}") * F.col(f"a{k}") for i in range(d) for k in range(i + 1)}
    return saved(_factored(got.withColumns({f"m{i}": F.col(f"a{i}") + F.col(f"o{i}") for i in range(d)}), s, names, ("_last",)), "mcd-fit", files=1)


def least_determinant(v: DataFrame, names: list[str], share: float) -> DataFrame:
    """A fit per group. v: _g and the statistics of the rows that estimates are made of."""
    fit = _starts(v, names)
    for _ in range(2):
        fit = _step(v, fit, names, share)
    best = F.min(F.struct("_det", "_s", *[c for c in fit.columns if c not in ("_g", "_s", "_det")]))
    fit = saved(fit.groupBy("_g").agg(best.alias("_f")).select("_g", "_f.*"), "mcd-best", files=1)
    for _ in range(MOST_STEPS):
        fit = _step(v, fit, names, share)
        fall = fit.agg(F.max(F.col("_last") - F.col("_det"))).first()[0]
        if fall is None or fall <= SAME:
            break
    return fit


def _calibrated(v: DataFrame, fit: DataFrame, names: list[str]) -> DataFrame:
    """``fit`` with the factor that brings the median distance of a group to that of chi-squared."""
    of = [c for c in fit.columns if c != "_g"]
    scale = F.greatest(F.percentile_approx("_d2", 0.5, RANKS) / chi2_quantile(0.5, len(names)), F.lit(0.5))
    return saved(_distance(v, fit, names, of).groupBy("_g", *of).agg(scale.alias("_scale")), "mcd-final", files=1)


def _verdicts(docs: DataFrame, share: float = 0.75, min_rows: int = 60, false_alarm: float = FALSE_ALARM) -> DataFrame:
    names = list(FLOORS)
    v = saved(_pooled(_vectors(saved(statistics_table(docs), "statistics")), min_rows), "vectors")
    rows = _estimated(v, min_rows).select("_g", *names)
    fit = _calibrated(rows, least_determinant(rows, names, share), names)
    judged = _distance(v, fit, names, ("_scale",)).withColumn("distance", F.when(~F.col("base_failed"), F.col("_d2") / F.col("_scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(false_alarm, len(names)), F.lit(True))
    return judged.select("doc_id", *KEY, *COUNTS, "base_failed", "distance", kept.alias("kept"))


def outlier_verdicts(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared, null where it isn't judged) and kept, a row per document of ``docs``.

    share: part of a group whose covariance is taken; false_alarm: chance that a clean document is rejected."""
    return _verdicts(docs, **parameters).drop(*KEY)


def without_outliers(docs: DataFrame, **parameters) -> DataFrame:
    """The rows that stay, in their own columns: each by its own verdict, also where rows repeat a doc_id or have none."""
    return without(docs, _verdicts(docs, **parameters).where("not kept"), *JUDGED)
