"""Links among sets that are near one hub, by what they differ in from what most of them have.

A hub's group is centred first: the centre is the hub with each element turned that most members have otherwise. For sets a and b
with differences A and B from any centre, the symmetric difference of a and b has |A| + |B| - 2 |A and B| elements, so the
differences alone decide a link, and a pair without enough of them in common needs no look. The weight of a set is the size of its
difference less its part of what linked sets may differ in: sets whose weights add up to nothing or less are linked, and others
have to share half the sum of their weights. The lightest set of a group is linked with all that it can be linked with without any
sharing; a set that is still apart from it shares at least one element with any set that it is linked with.

So pairs come from inverted lists of elements of the differences, a prefix of the rarest for each set, and only of elements that
sets of two components differ in. Sets that have too little in common with the centre and with sets of other components together
are dropped before; in a family of copies these are all that changed more than a link allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsieve.llm.common import bounded, discard, saved
from redsieve.llm.components import components


def linked(total: Column, apart: Column, percent: int) -> Column:
    """Whether sets of ``total`` elements together, that differ in ``apart`` of them, have a Jaccard of ``percent``."""
    return (total - apart) * 100 >= (total + apart) * percent


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    of = bounded(labels.select(F.col("id").alias("rep"), F.col("component").alias("comp")))
    return rows.join(of, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _both() -> Column:
    """The differences of a set as d and own: whether the set has the element and the centre hasn't, or the other way round."""
    side = lambda c, own: F.transform(c, lambda d: F.struct(d.alias("d"), F.lit(own).alias("own")))
    return F.concat(side("more", True), side("less", False))


def _centred(deltas: DataFrame) -> DataFrame:
    """hub, rep, n, more, less, from the centre of the group in place of the hub."""
    each = deltas.select("hub", F.explode(_both()).alias("e")).groupBy("hub", "e.d", "e.own").agg(F.count("*").alias("with"))
    sizes = deltas.groupBy("hub").agg(F.count("*").alias("members"))
    turned = each.join(bounded(saved(sizes, "sizes")), "hub").where("2 * with > members")
    # no more than twice the mean difference
    turned = turned.groupBy("hub").agg(F.collect_list(F.when(F.col("own"), F.col("d"))).alias("has"), F.collect_list(F.when(~F.col("own"), F.col("d"))).alias("lacks"))
    none = F.array().cast("array<bigint>")
    j = deltas.join(saved(turned, "turned"), "hub", "left").withColumns({"has": F.coalesce("has", none), "lacks": F.coalesce("lacks", none)})
    more = F.concat(F.array_except("more", "has"), F.array_except("lacks", "less"))
    less = F.concat(F.array_except("less", "lacks"), F.array_except("has", "more"))
    return saved(j.select("hub", "rep", "n", more.alias("more"), less.alias("less")), "centred")


def _mixed(entries: DataFrame) -> DataFrame:
    """hub, d, df, sets (64 bits that tell which sets differ in it) of the elements that sets of two components differ in."""
    mixed = entries.groupBy("hub", "d").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("rep")).alias("sets"), F.min("comp").alias("_l"), F.max("comp").alias("_h"), F.max("apart").alias("_a"))
    return mixed.where("_a and _l <> _h").select("hub", "d", "df", "sets")


def _survivors(deltas: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The members that are apart and may still be linked: what they share with the centre, and of the rest what sets of other
    components share, is enough for the smallest set that they can be linked with."""
    entries = saved(deltas.join(bounded(members.select("hub", "rep", "comp", "apart")), ["hub", "rep"]).select("hub", "rep", "comp", "apart", F.explode("more").alias("d")), "more")
    shared = entries.where("apart").join(_mixed(entries), ["hub", "d"]).groupBy("hub", "rep").agg(F.count("*").alias("shared"))
    least = members.groupBy("hub").agg(F.min("n").alias("least"))
    m = members.where("apart").join(shared, ["hub", "rep"], "left").join(least, "hub")
    other = F.greatest(F.floor(F.col("n") * percent / 100), F.col("least"))
    out = saved(m.where((F.col("kept") + F.coalesce("shared", F.lit(0))) * (100 + percent) >= (F.col("n") + other) * percent).select(*members.columns), "survivors")
    discard(entries)
    return out


def _prefixes(deltas: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """hub, sets, at (its place among the mixed elements of the member, the rarest first) and x (rep, comp, apart, n, most: elements that
    it can share with another, mixed, weight) for the rarest mixed elements of each member. Elements in which the same sets differ,
    as those of a passage, are one."""
    entries = deltas.select("hub", "rep", _both().alias("both")).join(bounded(members.select("hub", "rep", "comp", "apart")), ["hub", "rep"])
    entries = saved(entries.select("hub", "rep", "comp", "apart", F.explode("both").alias("e")).select("hub", "rep", "comp", "apart", "e.d", "e.own"), "entries")
    mixed = saved(_mixed(entries), "mixed")
    common = entries.join(mixed, ["hub", "d"]).groupBy("hub", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "sets"))).alias("common"), F.count_if("own").alias("own"))  # no more than a set holds
    least = members.groupBy("hub").agg(F.min("weight").alias("any"), F.min(F.when(F.col("apart"), F.col("weight"))).alias("far"))
    m = members.join(common, ["hub", "rep"]).join(least, "hub")
    # members that are not apart are of one component: they only seek those that are
    shared = F.ceil((F.col("weight") + F.when(F.col("apart"), F.col("any")).otherwise(F.col("far"))) / (2 * (100 + percent)))
    m = m.withColumn("take", F.size("common") - F.greatest(shared, F.lit(1)).cast("int") + 1).where("take > 0")
    # a set has to share its part, at least, with what the centre and the others offer
    m = m.withColumns({"most": F.col("kept") + F.col("own"), "mixed": F.size("common")}).where(F.col("most") * 100 >= F.col("n") * percent)
    x = F.struct("rep", "comp", "apart", "n", "most", "mixed", "weight")
    first = lambda c, i: (i == 0) | (F.get("common", i - 1)["sets"] != c["sets"])
    places = F.filter(F.transform(F.slice("common", F.lit(1), F.col("take")), lambda c, i: F.struct(c["sets"].alias("sets"), i.alias("at"), first(c, i).alias("first"))), lambda c: c["first"])
    out = saved(m.select("hub", x.alias("x"), F.explode(places).alias("c")).select("hub", "c.sets", "c.at", "x"), "prefixes")
    discard(entries, mixed)
    return out


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """a < b, and one hub of both, of the pairs that share an element of their prefixes and that nothing rules out."""
    a = prefixes.where("x.apart").select("hub", "sets", F.col("at").alias("there"), F.col("x").alias("y"))
    x, y = (lambda f: F.col(f"x.{f}")), (lambda f: F.col(f"y.{f}"))
    fits = (x("comp") != y("comp")) & (~x("apart") | (x("rep") > y("rep")))
    enough = F.least(x("most"), y("most")) * (100 + percent) >= (x("n") + y("n")) * percent
    # the first element that a pair has in common has no more after it than the shorter rest
    shared = x("weight") + y("weight") <= F.least(x("mixed") - F.col("at"), y("mixed") - F.col("there")) * 2 * (100 + percent)
    pairs = a.join(prefixes, ["hub", "sets"]).where(fits & enough & shared)
    return pairs.select("hub", F.least(x("rep"), y("rep")).alias("a"), F.greatest(x("rep"), y("rep")).alias("b")).groupBy("a", "b").agg(F.min("hub").alias("hub"))


def links_by_difference(deltas: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """a, b: links that join with ``labels`` all members near one hub that are linked; None if no group has members of two components.
    deltas: hub, rep, n, more, less, a written table; labels: id and component, as the links with hubs make them, a written table."""
    members = saved(_with_component(deltas.select("hub", "rep"), labels), "members")
    open_ = saved(members.groupBy("hub").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where("_l <> _h").select("hub"), "open")
    if open_.isEmpty():
        return None
    deltas = _centred(deltas.join(bounded(open_), "hub", "left_semi"))
    differing = F.size("more") + F.size("less")
    weight = differing * (100 + percent) - F.col("n") * (100 - percent)  # in whole numbers
    members = saved(deltas.select("hub", "rep", "n", (F.col("n") - F.size("more")).alias("kept"), weight.alias("weight")), "members")
    lightest = saved(members.groupBy("hub").agg(F.min(F.struct("weight", "rep")).alias("l")).select("hub", F.col("l.rep").alias("light"), F.col("l.weight").alias("_w")), "lightest")
    sure = saved(members.join(bounded(lightest), "hub").where("rep <> light and weight + _w <= 0").select(F.col("light").alias("a"), F.col("rep").alias("b")), "sure")
    labels = saved(components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).union(sure)), "components")
    own = _with_component(lightest.select("hub", F.col("light").alias("rep")), labels).select("hub", F.col("comp").alias("_c"))
    members = _with_component(members, labels).join(bounded(saved(own, "own")), "hub").withColumn("apart", F.col("comp") != F.col("_c")).drop("_c")
    members = saved(members, "members")
    survivors = _survivors(deltas, members, percent)
    if survivors.isEmpty():
        return sure
    hubs = saved(survivors.select("hub").distinct(), "open")
    rest = members.where("not apart").join(bounded(hubs), "hub", "left_semi")
    prefixes = _prefixes(deltas, saved(survivors.union(rest.select(*survivors.columns)), "members"), percent)
    pairs = saved(_candidates(prefixes, percent), "candidates")
    ends = saved(pairs.select("hub", F.col("a").alias("rep")).union(pairs.select("hub", "b")).distinct(), "ends")
    of = saved(deltas.join(bounded(ends), ["hub", "rep"], "left_semi").select("hub", "rep", "n", F.concat("more", "less").alias("d")), "differences")
    side = lambda k: of.select("hub", F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("d").alias(f"d{k}"))
    j = pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    out = saved(j.where(linked(F.col("na") + F.col("nb"), apart, percent)).select("a", "b"), "links")
    discard(members, survivors, hubs, prefixes, pairs, ends, of, deltas)
    return sure.union(out)
