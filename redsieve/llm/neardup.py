"""Near duplicates by bottom-k sketches from one hash function.

A document's set is its distinct word shingles under one 64-bit hash; its sketch is the k least of them. Documents with equal
sets become one class first, so that a group of copies is one row from there on. Retained values that several classes share form
inverted lists; a class enters only the lists of its rarest retained values, as many as two sketches of similar sets can't all
miss. A list is not taken pair by pair. Its hub, the member whose values are the commonest, meets each other member: the sketch of
the union tells whether they are near, and the full sets of near ones give the exact Jaccard and what they differ in.

What is left of a list are pairs without a link to the hub. Jaccard distance is a metric, so a member that is far from the hub has
no link to one that is linked with it. Near members are searched by their differences from the hub (``deltas``), which few of them
share. Members that aren't linked with the hub form a list again if some of them are far from it, with hubs among those (32, 1,024, ... a
list and round), until none is left; so no link is lost to the choice of a hub.

Chance of missing a link: MISS for each of a pair's sketches, if its Jaccard is just at the threshold; sets that their sketches hold
whole are compared without any.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; fewer words than a shingle form one
shingle. Each row is linked by its own text, also where rows repeat a doc_id or have none. component_id is the least doc_id that
the links of the row's text reach, null where no such row has one. kept is doc_id = component_id; of rows without any doc_id in
their component, one. An empty table gives an empty one. Other columns of the input play no part."""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsieve.llm.common import KEY, bounded, discard, let, row_key, saved, text_of, thinned, without, words
from redsieve.llm.components import components
from redsieve.llm.deltas import linked, links_by_difference

#: Retained values of a sketch.
SKETCH = 64
#: Chance that a sketch tells wrongly that two sets are below a bound when they are just at it.
MISS = 2e-8
#: Longs of a bitmap of a sketch, 64 bits each.
MAP = 8
#: Sketches that may be broadcast, half a kilobyte each, and bitmaps, under a hundred bytes each.
MOST_SKETCHES, MOST_BITMAPS = 20_000, 200_000


def least_shared(k: int, share: float, miss: float = MISS) -> int:
    """How many of ``k`` values drawn from a union at least lie in both sets, but for a chance of ``miss``, if ``share`` of it does."""
    below, n = 0.0, 0
    while n < k:
        below += math.comb(k, n) * share**n * (1 - share) ** (k - n)
        if below > miss:
            break
        n += 1
    return n


def shingle_set(text: Column, size: int) -> Column:
    """The ascending distinct hashes of the shingles of ``size`` words; A-Z count as a-z."""

    def hashed(w: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        whole = F.array(F.xxhash64(F.size(w), F.concat_ws(" ", w)))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < size, whole).otherwise(F.sort_array(F.array_distinct(shingles)))

    return let(words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)), hashed)


def _rows(docs: DataFrame, size: int) -> DataFrame:
    """A row per document: its number, doc_id, row key, n_shingles, a 128-bit key of the set, and the sketch."""
    sets = docs.select("doc_id", *row_key("doc_id", "text"), text_of().alias("_t")).select("doc_id", *KEY, shingle_set(F.col("_t"), size).alias("set"))
    numbered = F.monotonically_increasing_id().alias("row")  # written with the rows, so it stays
    return sets.select(numbered, "doc_id", *KEY, F.size("set").cast("long").alias("n_shingles"), F.xxhash64("set").alias("s1"), F.xxhash64(F.lit(1), "set").alias("s2"), F.slice("set", 1, SKETCH).alias("sketch"))


def _lists(reps: DataFrame, percent: int) -> DataFrame:
    """v, rep, typical: the rarest shared retained values of each class. reps: rep, n, sketch; typical: how common its values are."""
    linkable = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62  # smaller sets are linked with equal ones alone
    entries = reps.where(F.col("n") >= linkable).select("rep", F.least("n", F.lit(SKETCH + 1)).cast("int").alias("n"), F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    common = entries.join(shared, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("common"))  # as many as a sketch holds
    retained = F.least("n", F.lit(SKETCH))
    # a set that its sketch holds whole, as it does those of its links, misses as few values as the threshold says
    whole = F.col("n") <= math.floor(SKETCH * percent / 100)
    least = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(least_shared(SKETCH, percent / 100))).cast("int")
    first = (retained - least + 1) - (retained - F.size("common"))  # values that no other class has come first of all
    typical = F.aggregate("common", F.lit(0.0), lambda a, x: a + F.log(x["df"].cast("double"))) / retained
    rows = common.withColumn("first", first).where("first > 0")
    typical = F.round(typical * 64).cast("int")  # whole numbers shuffle in fewer bytes
    return rows.select("rep", typical.alias("typical"), F.explode(F.slice("common", F.lit(1), F.col("first"))).alias("c")).select(F.col("c.v").alias("v"), "rep", "typical")


def _hubs(lists: DataFrame, parts: int) -> DataFrame:
    """v, hub, hub_comp, open: for each part of a list, the member with the commonest values among those that are to be hubs (``far``).
    A list is open unless its hubs take part in all pairs that are left; then open is true for the commonest of its hubs."""
    hub = F.max(F.when(F.col("far"), F.struct("typical", "rep", "comp"))).alias("hub")
    by = ["v"] if parts == 1 else ["v", F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("part")]
    part = lists.groupBy(*by).agg(F.count("*").alias("m"), F.count_if("far").alias("f"), hub)
    open_ = lambda hubs: (F.col("f") > hubs) & (F.col("m") > hubs + 1)
    if parts == 1:
        return part.where("m > 1").select("v", F.col("hub.rep").alias("hub"), F.col("hub.comp").alias("hub_comp"), open_(1).alias("open"))
    part = saved(part, "parts")
    each = part.groupBy("v").agg(F.sum("m").alias("m"), F.sum("f").alias("f"), F.count("hub").alias("hubs"), F.max("hub")["rep"].alias("wide"))
    each = each.select("v", "wide", open_(F.col("hubs")).alias("open"))
    return part.where("hub is not null").join(each, "v").select("v", F.col("hub.rep").alias("hub"), F.col("hub.comp").alias("hub_comp"), (F.col("open") & (F.col("hub.rep") == F.col("wide"))).alias("open"))


def _bits() -> list[Column]:
    """The longs of a bitmap of the retained values."""
    one = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), v.bitwiseAND(63).cast("int"))

    def long(j: int) -> Column:
        return F.aggregate("sketch", F.lit(0).cast("bigint"), lambda m, v: F.when(F.pmod(F.shiftrightunsigned(v, 6), F.lit(MAP)) == j, m.bitwiseOR(one(v))).otherwise(m))

    return [long(j).alias(f"m{j}") for j in range(MAP)]


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with ``possible``: whether sizes and bitmaps of the sketches allow them to be near (see _judged)."""
    ids = saved(pairs.select("rep").union(pairs.select("hub")).distinct(), "ids")
    narrow = saved(reps.join(bounded(ids), "rep", "left_semi").select("rep", "n", *_bits()), "bitmaps")
    hubs = narrow.select(F.col("rep").alias("hub"), F.col("n").alias("nh"), *[F.col(f"m{j}").alias(f"h{j}") for j in range(MAP)])
    j = pairs.join(bounded(narrow, MOST_BITMAPS), "rep").join(bounded(hubs, MOST_BITMAPS), "hub")
    bar, shared = _bars(percent)
    apart = sum((F.bit_count(F.col(f"m{j}").bitwiseXOR(F.col(f"h{j}"))) for j in range(MAP)), F.lit(0))
    kept = F.least("n", F.lit(SKETCH)) + F.least("nh", F.lit(SKETCH))
    whole = (F.col("n") <= SKETCH) & (F.col("nh") <= SKETCH)
    # of sets that the sketches hold whole, the symmetric difference itself is bounded
    fits = F.when(whole, (kept - apart) * 100 >= (kept + apart) * bar).otherwise(kept - apart >= 2 * shared)
    out = saved(j.select("hub", "rep", "open", ((F.least("n", "nh") * 100 >= F.greatest("n", "nh") * bar) & fits).alias("possible")), "possible")
    discard(ids, narrow)
    return out


def _bars(percent: int) -> tuple[Column, Column]:
    """The least Jaccard, in percent, of pairs to be looked at, and how many values of the union's sketch both sets hold then."""
    far = max(0, 2 * percent - 100)
    of = lambda wide, strict: F.when(F.col("open"), F.lit(wide)).otherwise(F.lit(strict))
    return of(far, percent), of(least_shared(SKETCH, far / 100), least_shared(SKETCH, percent / 100))


def _judged(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """hub, rep, open and near of each pair: whether sizes and the sketch of the union leave it open that they are linked, or, for
    pairs of open lists, that their Jaccard reaches 1 less twice the distance of linked sets."""
    bar, shared = _bars(percent)
    every = _possible(pairs, reps, percent)
    pairs = every.where("possible").drop("possible")
    ids = saved(pairs.select("rep").union(pairs.select("hub")).distinct(), "ids")
    hubs = saved(pairs.select("hub").distinct(), "hub-ids")
    narrow = reps.select("rep", "n", "sketch")
    of_hubs = saved(narrow.join(bounded(hubs.withColumnRenamed("hub", "rep")), "rep", "left_semi").select(F.col("rep").alias("hub"), F.col("n").alias("nh"), F.col("sketch").alias("sh")), "hub-sketches")
    j = pairs.join(narrow.join(bounded(ids), "rep", "left_semi"), "rep").join(bounded(of_hubs, MOST_SKETCHES), "hub")
    union = F.sort_array(F.array_union("sketch", "sh"))
    whole = (F.col("n") <= SKETCH) & (F.col("nh") <= SKETCH)
    sample = F.when(whole, union).otherwise(F.slice(union, 1, SKETCH))
    both = F.size(F.array_intersect(F.array_intersect("sketch", "sh"), sample))
    near = F.when(whole, both * 100 >= F.size(sample) * bar).otherwise(both >= shared)
    rest = every.where("not possible").select("hub", "rep", "open", F.lit(False).alias("near"))
    out = saved(j.select("hub", "rep", "open", near.alias("near")).unionByName(rest), "judged")
    discard(ids, hubs, of_hubs, every)
    return out


def _compared(near: DataFrame, docs: DataFrame, keys: DataFrame, size: int, percent: int) -> DataFrame:
    """hub, rep, open, n, nh, more (what rep has and hub hasn't), less and linked, from full sets; only texts of documents in ``near``
    are read again. keys: rep and row key."""
    ids = saved(near.select("rep").union(near.select("hub")).distinct(), "ids")
    wanted = saved(keys.join(bounded(ids), "rep", "left_semi").select("rep", *KEY), "wanted")
    texts = docs.select(*row_key("doc_id", "text"), text_of().alias("_t")).join(bounded(wanted), list(KEY))
    sets = saved(texts.select("rep", shingle_set(F.col("_t"), size).alias("set")), "sets")
    hubs = saved(near.select("hub").distinct(), "hub-ids")
    of_hubs = saved(sets.join(bounded(hubs.withColumnRenamed("hub", "rep")), "rep", "left_semi").select(F.col("rep").alias("hub"), F.col("set").alias("hs")), "hub-sets")
    j = sets.join(bounded(near), "rep").join(of_hubs, "hub")
    j = j.select("hub", "rep", "open", F.size("set").alias("n"), F.size("hs").alias("nh"), F.array_except("set", "hs").alias("more"), F.array_except("hs", "set").alias("less"))
    out = saved(j.withColumn("linked", linked(F.col("n") + F.col("nh"), F.size("more") + F.size("less"), percent)), "compared")
    if out.count() > near.count():  # rows that are alike have one key, and so gave their set each
        out = saved(out.dropDuplicates(["hub", "rep"]), "compared")
    discard(ids, wanted, sets, hubs, of_hubs)
    return out


def _left(met: DataFrame, hubs: DataFrame, status: DataFrame) -> DataFrame:
    """v, rep, comp, typical and far of the members of open lists that have pairs left: neither hubs nor linked with the open hub, where
    some of them (``far``) are far from it. All others are near it, and their differences from it are searched.
    status: hub, rep, and linked: true, or false for a member that is far."""
    met = met.where("open").join(bounded(status), ["hub", "rep"], "left").where("rep <> hub and not coalesce(linked, false)")
    met = met.select("v", "rep", "comp", "typical", (~F.coalesce("linked", F.lit(True))).alias("far"))
    others = hubs.where("not open").select("v", F.col("hub").alias("rep")).join(saved(hubs.where("open").select("v"), "open"), "v", "left_semi")
    met = saved(met.join(bounded(saved(others, "others")), ["v", "rep"], "left_anti"), "left-met")
    some = saved(met.where("far").select("v").distinct(), "left-lists")
    return met.join(bounded(some), "v", "left_semi")


def _links(lists: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """a, b: links whose components are those of all links. lists: v, rep, comp (the component, as far as
    it is known), typical, and far: whether it may be a hub."""
    compared: list[DataFrame] = []
    step = 0

    def labels() -> DataFrame:
        links = [c.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")) for c in compared]
        return components(reduce(DataFrame.union, links))

    while True:
        hubs = saved(_hubs(lists, 32 ** min(step, 6)), "hubs")
        met = saved(lists.select("v", "rep", "comp", "typical").join(hubs, "v"), "met")
        pairs = met.where("rep <> hub and (open or comp <> hub_comp)").groupBy("hub", "rep").agg(F.max("open").alias("open"))
        judged = _judged(saved(pairs, "pairs"), reps, percent)
        near = saved(judged.where("near").select("hub", "rep", "open"), "near")
        status = judged.where("open and not near").select("hub", "rep", F.lit(False).alias("linked"))
        if not near.isEmpty():
            compared.append(_compared(near, docs, reps, size, percent))
            status = status.union(compared[-1].where("open and linked").select("hub", "rep", "linked"))
        status = saved(status, "status")
        if status.where("not linked").isEmpty():
            break
        left = _left(met, hubs, status)
        if compared:
            of = saved(labels(), "components").select(F.col("id").alias("rep"), "component")
            left = left.join(bounded(of), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        left = saved(left, "left")
        mixed = left.groupBy("v").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where("_l <> _h").select("v")
        lists = saved(left.join(mixed, "v").select("v", "rep", "comp", "typical", "far"), "lists")
        discard(hubs, met, judged, near, status, left)
        if lists.isEmpty():
            break
        step += 1
    if not compared:
        return None
    deltas = saved(reduce(DataFrame.union, compared).where("open"), "deltas")
    of = saved(labels(), "components")
    more = links_by_difference(deltas, of, percent)
    links = of.select(F.col("component").alias("a"), F.col("id").alias("b"))
    return links if more is None else links.union(more)


def _documents(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """doc_id, the row key, n_shingles, component_id, and keeper: whether the row is the one of its component that stays."""
    rows = saved(_rows(docs, shingle_words), "sketches")
    key = ["n_shingles", "s1", "s2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))  # rows without a doc_id come last
    classes = saved(rows.where("n_shingles > 0").groupBy(*key).agg(F.min("row").alias("rep"), first.alias("first")), "classes")
    of = rows.select(F.col("row").alias("rep"), *KEY, F.col("n_shingles").alias("n"), "sketch").join(bounded(classes.select("rep")), "rep", "left_semi")
    reps = saved(of, "reps")
    links = _links(saved(_lists(reps, percent), "lists").select("v", "rep", F.col("rep").alias("comp"), "typical", F.lit(True).alias("far")), reps, docs, shingle_words, percent)
    labelled = classes.withColumn("component", F.col("rep"))
    if links is not None:
        labels = saved(components(links).withColumnRenamed("id", "rep"), "components")
        labelled = classes.join(bounded(labels), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    labelled = saved(labelled.join(least, "component").select(*key, "least"), "labels")
    out = rows.select("row", "doc_id", *KEY, *key).join(labelled, key, "left")
    mine = F.col("n_shingles") == 0
    return out.select("doc_id", *KEY, "n_shingles", F.when(mine, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), (mine | (F.col("least.row") == F.col("row"))).alias("keeper"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach, its own included), kept (doc_id = component_id): a row
    per document. Documents are linked if 100 * intersection >= percent * union of their shingle sets."""
    out = _documents(docs, shingle_words, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNull(), F.col("keeper")).otherwise(F.col("doc_id") == F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, one with the least doc_id, and every unlinked row, in their own columns."""
    rows = _documents(docs, shingle_words, percent).groupBy(*KEY).agg(F.max("keeper").alias("stays"), F.count("*").alias("n"))
    rows = saved(rows, "verdicts")
    left = without(docs, rows.where("not stays"), "doc_id", "text")
    return thinned(left, rows.where("stays and n > 1"), "doc_id", "text")
