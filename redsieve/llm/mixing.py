"""Mixing sources to target weights, by hash thresholds found in histograms.

Each document has a fixed hash. A source takes the documents with the smallest hashes until its budget is used, so that the
documents of a smaller budget are among those of a larger one. The threshold comes from sums of tokens by source and hash
bucket: the bucket in which the budget ends is split again, first by 16 and then by 32 more bits of the hash, and only its rows
are read for that. Nothing is sorted, and a source of any share of the rows is summed in parts.

Sources go by code point, null last, and weigh 3, 1, 2, repeating. Targets share 150 % of all tokens by weight; a target stops
at twice its source's size, and the excess goes to the others by weight until none is above. A budget over a source's size takes
every document once (or twice) and the threshold decides on the rest.

Defined results: a null or empty text has size 0 and takes 0. A null source is a source. Rows that repeat a doc_id have one hash
and are taken together; so are all with a null doc_id. At the threshold, the document (or such a group) on which the budget ends
is taken if that brings the sum nearer. An empty table gives an empty one. Only one row per source meets in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redsieve.llm.common import SPACES, fresh, saved, text_of

#: Fixed values of the mix.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_COPIES = 2

#: Bits of the hash and of each level of the histogram, the highest first.
HASH_BITS = 60
LEVELS = (12, 16, 32)


def n_words(text: Column) -> Column:
    """Words of a text, without an array of them: the places where a word begins."""
    plain = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def _hash(seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """_s, source_size, target: a row per source. sizes: source, _s (its key), size.

    With sources by capacity per weight, the first that can take its share of what those before it leave sets the level."""
    s = sizes.groupBy("_s", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("capacity", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("capacity") / F.col("w"), "source", "_s")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(budget)
    s = s.withColumn("level", (total - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("w").over(after))
    level = F.min(F.when(F.col("capacity") / F.col("w") >= F.col("level"), F.struct(F.col("capacity") / F.col("w"), "level"))).over(everything)["level"]
    target = F.least(F.col("capacity").cast("double"), F.coalesce(F.col("w") * level, F.col("capacity").cast("double")))
    return s.select("_s", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """_s, last: the documents whose hash is at most ``last`` use up the source's budget. rows: _s, size, h; budgets: _s, budget."""
    at = saved(budgets.withColumns({"base": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long")}), "budgets", files=1)
    shift = HASH_BITS
    for bits in LEVELS:
        above, shift = shift, shift - bits
        inside = rows.join(at.select("_s", "prefix"), "_s").where(F.shiftright("h", above) == F.col("prefix") if above < HASH_BITS else F.lit(True))
        sums = inside.groupBy("_s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("t"))
        running = F.sum("t").over(Window.partitionBy("_s").orderBy("bucket"))
        sums = sums.withColumn("upto", running).join(at.select("_s", "budget", "base"), "_s").withColumn("upto", F.col("upto") + F.col("base"))
        # the bucket in which the budget ends; where it never ends, the source is taken whole
        end = sums.where("upto > budget").groupBy("_s").agg(F.min(F.struct("bucket", "upto", "t")).alias("e"))
        at = at.select("_s", "budget").join(end, "_s").select("_s", "budget", (F.col("e.upto") - F.col("e.t")).alias("base"), F.col("e.bucket").alias("prefix"), F.col("e.t").alias("t"))
        at = saved(at, "boundary", files=1)
    nearer = F.col("base") + F.col("t") - F.col("budget") < F.col("budget") - F.col("base")
    return at.select("_s", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), _key().alias("_s"), n_words(text_of()).alias("size"), _hash(seed).alias("h"))
    return saved(rows, "sizes")


def _goals(rows: DataFrame) -> DataFrame:
    """_s, source_size, target, whole (copies of every document) and last (largest hash of which there is one more)."""
    goal = saved(targets(rows), "targets", files=1)
    whole = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    last = _threshold(rows, goal.where("source_size > 0").select("_s", "budget"))
    return saved(goal.join(last, "_s", "left").withColumn("last", F.coalesce("last", F.lit(-1))).select("_s", "source_size", "target", "whole", "last"), "goals", files=1)


def _copies(size: Column, h: Column, whole: Column, last: Column) -> Column:
    return F.when(size > 0, whole + (h <= last).cast("long")).otherwise(F.lit(0)).cast("int")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (size times copies): a row per document."""
    rows = _sizes(docs, seed)
    goal = _goals(rows)
    out = rows.join(goal, "_s").withColumn("copies", _copies(*map(F.col, ("size", "h", "whole", "last"))))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix in their own columns, each as often as it is taken. A document's hash and its source's threshold
    tell how often that is, so documents are joined with a row per source and not with one another."""
    key, size, h, number = (fresh(docs, n) for n in ("_key", "_size", "_h", "_number"))
    own = _goals(_sizes(docs, seed))
    goal = own.select(*[F.col(c).alias(fresh(docs, f"_goal_{c}")) for c in ("_s", "whole", "last")])
    _, whole, last = (F.col(c) for c in goal.columns)
    out = docs.withColumns({key: _key(), size: n_words(text_of()), h: _hash(seed)}).join(goal, F.col(key) == F.col(goal.columns[0]))
    copies = _copies(F.col(size), F.col(h), whole, last)
    return out.withColumn(number, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*docs.columns)


#: The same rows by a running sum over sorted hashes.
ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from d group by source),
r as (
  select *, 2 * source_size as capacity, 2 * source_size / w as ratio from s),
l as (
  select *, (1.5::double * (select sum(source_size) from s) - coalesce(sum(capacity) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by ratio, source rows between current row and unbounded following) as level
  from r),
g as (
  select source, source_size, least(capacity::double, coalesce(w * (select min_by(level, ratio) from l where ratio >= level), capacity::double)) as target from l),
b as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from g),
c as (
  select d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size as budget,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
         sum(d.size) over (partition by d.source, d.h) as here
  from d join b on d.source is not distinct from b.source),
k as (
  select *, whole + case when upto <= budget or (upto - here <= budget and upto - budget < budget - (upto - here)) then 1 else 0 end as times from c)
select doc_id, size, source_size, target, (case when size > 0 then times else 0 end)::int as copies,
       (size * case when size > 0 then times else 0 end)::bigint as taken
from k
"""
