"""Operators on documents against plain versions, and on odd and empty tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redsieve.llm import deltas, ids, mixing, neardup, outliers, packing, qda, textstats, tokenbin
from redsieve.llm.common import saved, shared_path
from redsieve.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENT, odd_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# quality rules


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def assert_base(df, verdicts):
    want = Counter((i, *(c := base_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows_of(df))
    got = verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, got)) == want
    assert verdicts.where("kept and base_failed or kept is null").count() == 0


def test_outliers_counts(documents, odd, empty):
    for df in (documents, odd):
        assert_base(df, saved(outliers.outlier_verdicts(df), "t"))
    assert outliers.outlier_verdicts(empty).count() == 0 and outliers.without_outliers(empty).count() == 0
    kept = outliers.without_outliers(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {5, 6, 7, 8, None}


FLOORS = np.array(list(outliers.FLOORS.values()))


def plain_mcd(x, share=0.75, starts=300, seed=0):
    """Logarithm of the least determinant, centre and scatter, of concentration from random subsets until nothing changes."""
    r, (n, d) = np.random.default_rng(seed), x.shape
    h = math.ceil(share * n)
    moments = lambda at: (x[at].mean(axis=0), np.cov(x[at].T, bias=True) + np.diag(FLOORS**2))
    best = (math.inf, None, None)
    for _ in range(starts):
        centre, cov = moments(r.choice(n, d + 1, replace=False))
        last = math.inf
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            centre, cov = moments(d2 <= np.sort(d2)[h - 1])
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-12:
                break
            last = det
        best = min(best, (det, centre, cov), key=lambda t: t[0])
    return best


def contaminated(seed, n, share):
    """Statistics of a group of which a ``share`` lies elsewhere, in one cluster, spread out or along a line."""
    r = np.random.default_rng(seed)
    a = r.normal(size=(5, 5)) * 0.3 + np.eye(5)
    x = r.normal(size=(n, 5)) @ a * [0.5, 0.3, 0.1, 0.05, 0.05] + [5, 4, 0.2, 0.3, 0.1]
    bad = np.arange(n) < share * n
    move = ([2, 3, 1, 0.5, 0.4], r.normal(size=(n, 5)) * 3, r.normal(size=(n, 1)) * [3, 0, 1, 0, 1])[seed % 3]
    return x + np.where(bad[:, None], move, 0), bad


def test_outliers_are_those_of_the_least_determinant(spark):
    groups = {f"g{k}": contaminated(k, n, share) for k, (n, share) in enumerate([(150, 0.0), (200, 0.1), (120, 0.2), (300, 0.24), (90, 0.15), (180, 0.2)])}
    names = list(outliers.FLOORS)
    rows = [(g, *map(float, r)) for g, (x, _) in groups.items() for r in x]
    v = spark.createDataFrame(rows, ["_g", *names])
    fit = outliers.least_determinant(v, names, 0.75)
    got = {r._g: r for r in fit.collect()}
    assert fit.count() == len(groups)
    distance = {}
    for r in outliers._distance(v, outliers._calibrated(v, fit, names), names, ("_scale",)).collect():
        distance.setdefault(r._g, []).append(r._d2 / r._scale)
    cut = outliers.chi2_quantile(outliers.FALSE_ALARM, 5)
    for g, (x, bad) in groups.items():
        det, centre, cov = plain_mcd(x)
        assert got[g]._det <= det + 0.02  # few starts against many; here two subsets that differ in a row or two
        if abs(got[g]._det - det) <= 1e-6:  # the same subset
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            d2 /= max(np.sort(d2)[math.ceil(len(x) / 2) - 1] / outliers.chi2_quantile(0.5, 5), 0.5)
            assert np.allclose(sorted(distance[g]), sorted(d2), rtol=1e-6)
        assert np.mean(np.array(sorted(distance[g]))[: int((~bad).sum())] <= cut) > 0.98


def test_plans_of_fits_stay_small(spark, monkeypatch):
    """The driver plans each step anew and keeps room for it, so each table of fits joins the documents once."""
    x, _ = contaminated(1, 150, 0.1)
    names, plans = list(outliers.FLOORS), {}
    v = spark.createDataFrame([("g", *map(float, r)) for r in x], ["_g", *names])

    def noted(df, name, files=None):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return saved(df, name, files)

    monkeypatch.setattr(outliers, "saved", noted)
    outliers._calibrated(v, outliers.least_determinant(v, names, 0.75), names)
    joins = {name: max(len(re.findall(r"\bJoin ", p)) for p in each) for name, each in plans.items()}
    assert joins["mcd-start"] <= 2 and all(n <= 1 for name, n in joins.items() if name != "mcd-start")
    assert sum(len(each) for each in plans.values()) <= 2 * (len(plans["mcd-fit"]) + 2)  # two tables a step, and four


def test_outliers_of_documents(spark):
    r = random.Random(3)
    junk = lambda t: re.sub(r"(\w+)", r"\1%%%", t)
    rows = [(i, (junk if i % 20 == 19 else str)(prose(r, r.randint(60, 400))), "en", "a", 0) for i in range(140)]
    got = {x.doc_id: x for x in outliers.outlier_verdicts(spark.createDataFrame(rows, DOCUMENT)).collect()}
    assert all(got[i].kept == (i % 20 != 19) for i in got)


def test_cut_is_a_quantile():
    for above, degrees, want in ((0.5, 5, 4.351), (0.001, 5, 20.515), (0.05, 1, 3.841), (0.01, 4, 13.277)):
        assert outliers.chi2_quantile(above, degrees) == pytest.approx(want, abs=1e-3)


def test_outliers_pools(spark):
    r = random.Random(4)
    vectors = lambda rows, n=60: outliers._pooled(outliers._vectors(outliers.statistics_table(spark.createDataFrame(rows, DOCUMENT))), n)
    groups = lambda v: {x._g: x["count"] for x in v.groupBy("_g").count().collect()}
    rows = [(i, prose(r, 100), "en" if i < 70 else f"l{i}", f"s{i}", 0) for i in range(100)]
    v = vectors(rows)
    assert groups(v) == {'["en"]': 70, "[]": 30}
    assert groups(outliers._estimated(v, 60)) == {'["en"]': 70, "[]": 100}  # too few of their own
    assert groups(vectors(rows[:30])) == {None: 30}
    # names that hold what joins them, and nulls, are groups of their own
    names = [("en", "a/=b"), ("en/=a", "b"), ("en", None), (None, "en"), ("en", ""), ("[en]", None)]
    assert len(groups(vectors([(i, prose(r, 60), *names[i % 6], 0) for i in range(60)], 10))) == 6


def test_small_groups_are_judged(spark):
    r = random.Random(6)
    rows = [(i, prose(r, r.randint(60, 300)), "en", "a", 0) for i in range(120)]
    rows += [(200, prose(r, 100), "xx", "b", 0), (201, re.sub(r"(\w+)", r"\1%%%", prose(r, 100)), "yy", "b", 0)]
    got = {x.doc_id: x.kept for x in outliers.outlier_verdicts(spark.createDataFrame(rows, DOCUMENT)).collect()}
    assert got[200] and not got[201]


def test_outliers_are_native(documents):
    plan = outliers.outlier_verdicts(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)


def test_rows_are_judged_one_by_one(spark):
    """A row that shares its doc_id with another, or has none, goes or stays by its own text."""
    r = random.Random(9)
    good, junk = prose(r, 200), "x " * 200
    df = spark.createDataFrame([(1, good, "en", "a", 1), (1, junk, "en", "a", 2), (None, junk, "en", "a", 3), (None, good, "en", "a", 4)], DOCUMENT)
    texts = lambda out: sorted((x.doc_id or 0, x.text) for x in out.collect())
    assert texts(outliers.without_outliers(df)) == [(0, good), (1, good)]
    assert texts(neardup.without_near_duplicates(df)) == [(1, good), (1, junk)]
    again = df.union(df)
    assert texts(neardup.without_near_duplicates(again)) == [(1, good), (1, junk)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert texts(qda.without_low_quality(df, labels)) == texts(df)


# quality classifier


def plain_features(t):
    w = words(t)
    n, c, p = len(w), sum(map(len, w)), qda.PRIOR
    lines = [x for x in (t or "").split("\n") if words(x)]
    text = t or ""
    root = lambda a, b, k: math.sqrt(a / (b + k))
    import unicodedata

    kind = [unicodedata.category(ch) for ch in text]
    letters, upper = sum(k[0] == "L" for k in kind), sum(k == "Lu" for k in kind)
    count = lambda s: sum(ch in s for ch in text)
    return [math.log1p(n), (c + 5 * p) / (n + p), root(count("#*$%&|<>"), c, 5 * p), root(count(".,;:!?"), c, 5 * p), root(upper, letters, 5 * p), root(text.count("!"), n, p), root(base_counts(t)[4], n, p), (math.log1p(len(set(w))) + 1) / (math.log1p(n) + 1), root(len(lines) - len(set(lines)), len(lines), 4), root(count("0123456789"), c, 5 * p)]


def test_quadratic_discriminant(spark, sf_dir, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    x = {i: np.array(plain_features(t)) for i, t in rows_of(documents)}
    by = [np.array([x[i] for i in x if labels.get(i) == q and not held(i)]) for q in (0, 1)]
    cov = [np.cov(b.T, bias=True) for b in by]
    target = np.diag(np.diag(cov[0] + cov[1]) / 2)
    shrunk = [0.95 * c + 0.05 * target + 0.01**2 * np.eye(len(c)) for c in cov]
    log = [-0.5 * np.linalg.slogdet(s)[1] for s in shrunk]
    density = lambda v, q: log[q] - 0.5 * (v - by[q].mean(axis=0)) @ np.linalg.solve(shrunk[q], v - by[q].mean(axis=0))
    got = {r.doc_id: r for r in QUERIES["op3_quadratic_discriminant"](spark, sf_dir).collect()}
    assert got.keys() == x.keys()
    for i, r in got.items():
        odds = density(x[i], 1) - density(x[i], 0) + math.log(len(by[1]) / len(by[0]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, odds)))), rel=1e-4, abs=1e-9)
        assert r.held_out == held(i) and r.predicted == (r.score >= 0.7)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quadratic_discriminant"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.93


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (9, 0, 0), (10, 0, 0), (8, 1, 0), (5, None, None), (None, 1, 0), (7, 5, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = qda.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert qda.quality_scores(empty, labels).count() == 0
    assert {r.score for r in qda.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in qda.quality_scores(odd, labels.where("quality = 1")).collect()} == {1.0}
    assert qda.without_low_quality(odd, labels).columns == odd.columns


# near duplicates


def plain_components(rows, n, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = set(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    both = Counter(p for m in by.values() for p in itertools.combinations(sorted(m), 2))
    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), i == root(i)) for i in sets}


def assert_components(df, n, percent=80):
    rows = [x for x in rows_of(df) if x[0] is not None]
    got = neardup.near_duplicates(df, n, percent).collect()
    assert len(got) == df.count()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == plain_components(rows, n, percent)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def families(seed, groups=6):
    """Groups of near copies around bases, chains whose ends aren't alike, small sets, and a passage that many share."""
    r = random.Random(seed)
    rows, passage = [], prose(r, 60)

    def change(w, share):
        return [r.choice("qxyz") + r.choice("aeiou") * 3 + str(r.randint(0, 999)) if r.random() < share else x for x in w]

    for _ in range(groups):
        base = prose(r, r.randint(20, 300)).split()
        rows += [" ".join(change(base, r.choice((0.01, 0.03, 0.06, 0.1)))) for _ in range(r.randint(2, 25))]
        link = base
        for _ in range(8):
            link = change(link, 0.04)
            rows.append(" ".join(link))
    rows += [prose(r, 30) + " " + passage for _ in range(15)]
    rows += [" ".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(40)]
    rows += [rows[k] for k in range(0, len(rows), 7)]
    r.shuffle(rows)
    return [(i * 3 + 1, t, "en", "a", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_families(spark, seed):
    assert_components(spark.createDataFrame(families(seed), DOCUMENT), 2)


def test_near_duplicates_documents(documents, odd, empty):
    for n in (2, 5):
        assert_components(documents, n)
    assert_components(odd, 2)
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.without_near_duplicates(odd)
    assert left.columns == odd.columns and 7 not in {r.doc_id for r in left.collect()}


def test_one_common_value_among_unlike_documents(spark):
    """Many members of one list, none alike: each is compared, none linked, and the search ends."""
    r = random.Random(8)
    rows = [(i, f"same pair same pair {prose(r, 3)}", "en", "a", 0) for i in range(60)]
    assert_components(spark.createDataFrame(rows, DOCUMENT), 2)


def star(seed, n, size, most):
    """Near copies of one text in which each changed its own share of words, up to ``most``: many alike but not linked."""
    r = random.Random(seed)
    base = prose(r, size).split()
    copies = []
    for _ in range(n):
        share = r.random() * most
        copies.append(" ".join(f"w{r.randint(0, 10**9)}" if r.random() < share else w for w in base))
    return copies


def test_near_duplicates_large_family(spark):
    """2,000 members, of which two in three pairs have a Jaccard between 0.4 and 0.8; few are looked at."""
    texts = star(3, 2000, 120, 0.16)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    sets = [frozenset(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    r = random.Random(0)
    share = lambda a, b: len(a & b) / len(a | b)
    between = [0.4 <= share(*r.sample(sets, 2)) < 0.8 for _ in range(500)]
    assert sum(between) > 250
    looked = []
    plain = deltas._candidates

    def counted(*args):
        out = saved(plain(*args), "candidates")
        looked.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(deltas, "_candidates", counted)
        got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, DOCUMENT), 2).collect()}
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if root(i) != root(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            top[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(sets))}
    assert sum(looked) < 20_000  # of two million pairs


def test_near_duplicates_without_a_centre(spark):
    """All members changed as much, so no document is the centre; and two families, one derived from the other."""
    r = random.Random(12)
    base = prose(r, 150).split()
    other = [w if r.random() > 0.1 else f"v{k}" for k, w in enumerate(base)]
    change = lambda b, p: " ".join(f"w{r.randint(0, 10**9)}" if r.random() < p else w for w in b)
    texts = [change(base, 0.05) for _ in range(60)] + [change(other, 0.03) for _ in range(60)] + [change(base, 0.02) for _ in range(40)]
    assert_components(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCUMENT), 2)


def test_two_texts_of_one_doc_id(spark):
    """Each row is linked by its own text; both texts' links are found, in whatever order the rows come."""
    r = random.Random(2)
    a, b = prose(r, 200), prose(r, 200)
    last = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows = [(5, a, "en", "a", 0), (5, b, "en", "a", 0), (7, last(b), "en", "a", 0), (8, last(a), "en", "a", 0), (9, prose(r, 90), "en", "a", 0), (None, last(a) + " x", "en", "a", 0)]
    for some in (rows, rows[::-1]):
        got = neardup.near_duplicates(spark.createDataFrame(some, DOCUMENT), 2).collect()
        assert sorted((x.doc_id or 0, x.component_id, x.kept) for x in got) == [(0, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]
        left = neardup.without_near_duplicates(spark.createDataFrame(some, DOCUMENT), 2).collect()
        assert sorted((x.doc_id, x.text) for x in left) == sorted([(5, a), (5, b), (9, rows[4][1])])


def test_sketches_miss_next_to_nothing():
    assert neardup.least_shared(neardup.SKETCH, 0.8) == 32 and neardup.least_shared(10, 1.0) == 10 and neardup.least_shared(10, 0.0) == 0
    r = np.random.default_rng(1)
    assert (r.binomial(neardup.SKETCH, 0.8, 1_000_000) >= 32).all()


# token ids


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_kept_parts_give_the_ids_of_the_whole(name):
    t, e = tokenizer(name), ids.Encoder(name)
    texts = [x[1] or "" for x in odd_documents()] + ["a  b", " a", "a ", "\n\n a\n\nb", "don't can't", "U.S.A., e.g.", "ẞß İi ΑΣ ΑΣ.", "é é ́x", "a b　c", "\x1c\x1d a\x1fb", "tab\tand\r\nline", "1,000.50 ,.", "日本語 テキスト", "😀 👍🏽.", "a,b. c,", "'s 's x's"]
    for _ in range(2):
        assert e.encode(texts) == [np.asarray(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_full_table_of_parts(monkeypatch):
    monkeypatch.setattr(ids, "MOST_PARTS", 5)
    t, e = tokenizer("word_bpe_49k.json"), ids.Encoder("word_bpe_49k.json")
    texts = [prose(random.Random(k), 50) for k in range(4)]
    assert e.encode(texts) == [np.asarray(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    assert len(e.known) <= 6


def assert_shards(spark, df, **parameters):
    t = tokenizer("word_bpe_49k.json")
    path = shared_path(spark, "shards-test")
    tokenbin.write_shards(df, path, **parameters)
    got = tokenbin.read_shards(spark, path).collect()
    want, start = [], 0
    for i, x in sorted(rows_of(df), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((i, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    return path


def test_token_shards(spark, documents, odd, empty):
    assert_shards(spark, documents)
    path = assert_shards(spark, odd, shard_ids=500)
    from redsieve.llm.blobs import read_blobs

    shards = [tokenbin.from_bytes(bytes(r.content)) for r in read_blobs(spark, path).collect()]
    assert len(shards) > 2 and sum(len(s.doc_ids) for s in shards) == odd.count()
    for s in shards:
        for k, (_, whole) in enumerate(s.documents()):
            assert (s.document(k) == whole).all()
            for a, b in ((0, len(whole)), (len(whole) // 3, len(whole) // 2), (len(whole) - 1, len(whole))):
                assert (s.ids_at(k, a, b) == whole[a:b]).all()
    assert tokenbin.token_shards(empty).count() == 0


def test_no_frequent_pair_stays():
    """Shards of copies are replaced to the end, and nonterminals beyond two bytes are written."""
    r = np.random.default_rng(3)
    text = r.integers(0, 900, 300)
    copies = np.concatenate([np.append(text, 901) for _ in range(1500)]).astype(np.uint32)
    ends = np.arange(301, len(copies) + 1, 301)
    mixed = np.concatenate([np.tile(r.permutation(1000), 8) for _ in range(20)]).astype(np.uint32)
    for ids, stops, first in ((copies, ends, 1000), (copies, ends, (1 << 16) - 100), (mixed, np.array([len(mixed)]), (1 << 16) - 50)):
        symbols, offsets, rules = tokenbin.compress(ids, stops, first)
        pairs = Counter((a, b) for at, to in itertools.pairwise(offsets.tolist()) for a, b in itertools.pairwise(symbols[at:to].tolist()))
        assert all(n < tokenbin.LEAST for n in pairs.values())
        s = tokenbin.from_bytes(tokenbin.to_bytes(0, 0, list(range(len(stops))), ids, stops, first))
        assert np.array_equal(np.concatenate([x for _, x in s.documents()]), ids)
        assert s.symbols.tolist() == symbols.tolist()
        assert (first == 1000) == (first + len(rules) <= 1 << 16)
    assert len(tokenbin.compress(copies, ends, 1000)[0]) == len(ends)


@pytest.mark.parametrize("seed", range(4))
def test_repair_round_trip(seed):
    r = np.random.default_rng(seed)
    x = r.zipf(1.4, 5000).clip(1, 300).astype("<u4") if seed else np.full(3000, 7, dtype="<u4")
    ends = np.unique(np.append(r.integers(1, len(x), 40), len(x)))
    s = tokenbin.from_bytes(tokenbin.to_bytes(3, 4, list(range(len(ends))), x, ends, first=1000))
    assert (s.partition, s.number, s.n_ids) == (3, 4, len(x)) and len(s.rules) and len(s.symbols) < len(x)
    assert (np.concatenate([d for _, d in s.documents()]) == x).all()
    assert [len(d) for _, d in s.documents()] == np.diff(ends, prepend=0).tolist()


# packing


def assert_packed(got, df, capacities=(2048, 2048, 2048 * 2048), name="byte_bpe_50k.json"):
    t = tokenizer(name)
    want = Counter()
    for i, x in rows_of(df):
        data = np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        n, cap = len(data), capacities[0]
        cuts = [0, *range(n % cap or cap, n, cap), n] if n > cap else [0, n]
        want.update((i, k, a, b - a, zlib.crc32(data[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacities[0] and len(b) <= capacities[1] and sum(n * n for _, n in b) <= capacities[2]
    return bins


def test_packing(documents, odd, empty):
    bins = assert_packed(packing.pack(documents).collect(), documents)
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= math.ceil(total / 2048) * 1.02 + 1
    assert_packed(packing.pack(odd).collect(), odd)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_under_three_capacities(documents, rule):
    short = documents.where(F.length("text") < 1500)
    bins = assert_packed(packing.pack(short, documents=3, cost=2048 * 1024, rule=rule).collect(), short, (2048, 3, 2048 * 1024))
    assert max(map(len, bins.values())) == 3


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_runs_place_each_rank_once(rule):
    r = random.Random(1)
    counts = {r.randint(1, 100): r.randint(1, 50) for _ in range(60)}
    runs = packing.plan_runs(counts, (100, 7, 6000), rule) if max(counts) ** 2 <= 6000 else packing.plan_runs(counts, (100, 7, 10_000), rule)
    seen = Counter((n, k) for n, first, many, _, _ in runs.tolist() for k in range(first, first + many))
    assert seen == Counter((n, k) for n, c in counts.items() for k in range(c))
    with pytest.raises(ValueError, match="capacity"):
        packing.plan_runs({101: 1}, (100, 7, 20_000))


def test_three_capacities_decide(spark):
    """With the query's own weights and capacities, documents and cost change placements, and cost no sequence."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = {r.length: r.n for r in packing.pieces(docs, "byte_bpe_50k.json", 0, 2048).groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(n * k for n, k in counts.items())
    runs = {w: packing.plan_runs(counts, (2048, 2048, 2048**2), "norm", w) for w in (packing.WEIGHTS, (1.0, 0.0, 0.0))}
    last = {w: int((r[:, 2] + r[:, 3]).max()) for w, r in runs.items()}
    assert not np.array_equal(runs[packing.WEIGHTS], runs[1.0, 0.0, 0.0])
    assert last[packing.WEIGHTS] <= last[1.0, 0.0, 0.0] and last[packing.WEIGHTS] <= math.ceil(total / 2048) * 1.01 + 1


# mixing


def test_mixing_is_the_sql(spark, sf_dir, documents):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = sorted(map(tuple, mixing.mix(documents).collect()))
    assert got == sorted(c.execute(mixing.ORACLE).fetchall())


def test_mixing_targets(spark):
    sizes = {"b": 100, "a": 1000, "é": 500, "z": 0, None: 50}
    df = spark.createDataFrame([(s, "-" if s is None else "=" + s, n) for s, n in sizes.items()], "source string, _s string, size long")
    got = {r._s: r.target for r in mixing.targets(df).collect()}
    weights = dict(zip(("=a", "=b", "=z", "=é", "-"), (3, 1, 2, 3, 1), strict=True))
    cap = {"-" if s is None else "=" + s: 2 * n for s, n in sizes.items()}
    left, free, want = 1.5 * sum(sizes.values()), set(weights), {}
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > cap[s]}
        if not over:
            want |= {s: weights[s] * level for s in free}
            break
        want |= {s: float(cap[s]) for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    assert got == pytest.approx(want)


def test_mixing_odd(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    want = Counter((i, len(words(t))) for i, t in rows_of(odd))
    assert Counter((r.doc_id, r.size) for r in got) == want and all(r.taken == r.size * r.copies and 0 <= r.copies <= 2 for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_rows(documents, odd):
    copies = {r.doc_id: r.copies for r in mixing.mix(documents).collect()}
    got = Counter(r.doc_id for r in mixing.mixed(documents).collect())
    assert got == Counter({i: n for i, n in copies.items() if n})
    assert mixing.mixed(odd).columns == odd.columns


def test_smaller_budgets_are_nested(spark, documents):
    rows = documents.select(F.lit("=a").alias("_s"), mixing.n_words(F.col("text")).alias("size"), mixing._hash("s").alias("h"))
    last = [mixing._threshold(rows, spark.createDataFrame([("=a", float(b))], "_s string, budget double")).first()["last"] for b in (0, 500, 5000, 50_000)]
    assert last == sorted(last)
    for b, at in zip((500, 5000, 50_000), last[1:], strict=True):
        taken = rows.where(F.col("h") <= at).agg(F.sum("size")).first()[0] or 0
        assert abs(taken - b) <= rows.agg(F.max("size")).first()[0] / 2


# counts


def test_statistics_are_native(documents):
    plan = textstats.with_statistics(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
