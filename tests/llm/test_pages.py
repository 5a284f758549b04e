"""Operators on pages and vectors against plain versions, and on odd and empty tables."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from redsieve.llm import dom, extraction, topk, urls, warc
from redsieve.llm.blobs import read_blobs, write_blobs
from redsieve.llm.common import shared_path
from redsieve.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import CLASHES

PAGE = "page_id long, url string, html string"
#: How much slower this machine may be than the one of the bounds of time in these tests.
PACE = 3
BIG = "<p>" + "long text " * 20_000


def odd_pages():
    same = "x" * 1500
    rows = [(1, None, None), (2, "http://a.org", ""), (3, "https://b.com/fr/x?y#z", same), (4, "nothing", same), (9, "http://c.example.org/es/1", same), (9, "http://c.example.org/es/1", same), (None, "http://d.net/", same)]
    return [*rows, (5, "http://ü.example.net/é\r\nX: y", "é" * 700), (6, "", "short"), (7, "http://e.org/", "short"), (8, "://", BIG), (10, "http://f.com", "a\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\nb" * 3)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_pages(), PAGE).select("*", *[F.lit("clash").alias(c) for c in CLASHES], F.lit(1).alias("sha1"), F.lit(2).alias("bytes"), F.lit(3).alias("rule"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], PAGE)


def db(sf_dir):
    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op2_warc_segments", "op10_threshold_top_k"])
def test_same_rows_as_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db(sf_dir).execute(ORACLES[name])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# archives


def plain_archive(rows):
    groups = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= 1000:
            groups.setdefault(p, []).append(i)
    out = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = max(groups.get(p, [-1])) if i is not None else -1
        revisit = first >= 0 and i < first
        out[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


@pytest.mark.parametrize("size", [{}, {"segment": 100, "file": 5000}])
def test_archives(spark, odd, empty, size):
    got = warc.archived(odd, **size).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain_archive(odd_pages())
    assert warc.archived(empty, **size).count() == 0


def test_archives_are_valid(spark, odd):
    """Ids are unique, each Refers-To is the id of a response with the same digest, and a file is gzip members of one record each."""
    path = shared_path(spark, "valid")
    warc.write_archives(warc.with_originals(odd), path, segment=4000, file=20_000)
    seen = []
    for r in read_blobs(spark, path).collect():
        data = bytes(r.content)
        assert gzip.decompress(data) == warc._plain(data)
        while data:
            member = zlib.decompressobj(31)
            of = list(warc.parsed(member.decompress(data)))
            data = member.unused_data
            assert member.eof and len(of) == (1 if data else 0)
            seen += [fields for fields, _ in of]
    ids = {f["warc-record-id"]: f for f in seen}
    assert len(ids) == len(seen) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    revisits = [f for f in seen if f["warc-type"] == "revisit"]
    assert len(revisits) == sum(n for (_, _, _, kind, _), n in plain_archive(odd_pages()).items() if kind == "revisit") > 0
    for f in revisits:
        assert ids[f["warc-refers-to"]]["warc-type"] == "response" and ids[f["warc-refers-to"]]["warc-payload-digest"] == f["warc-payload-digest"]


def test_revisits_of_nothing_are_errors(spark):
    path = shared_path(spark, "lost")
    made = warc.records("<a>", 5, "u", b"abc", "<b>", hashlib.sha1(b"abc").hexdigest())
    write_blobs(spark.createDataFrame([(made[0],)], "file binary"), "file", path)
    with pytest.raises(Exception, match="no record is <b>"):
        warc.read_archives(spark, path).collect()


def test_segments_come_together_across_files(spark):
    payload = bytes(random.Random(1).randbytes(50_000))
    made = warc.records("<a>", 5, "http://a/", payload, None, hashlib.sha1(payload).hexdigest(), segment=1000)
    assert len(made) > 50
    random.Random(2).shuffle(made)
    path = shared_path(spark, "segments")
    write_blobs(spark.createDataFrame([(b"".join(made[k::7]),) for k in range(7)], "file binary").repartition(3), "file", path)
    r = warc.read_archives(spark, path).collect()
    assert len(r) == 1 and (r[0].page_id, r[0].payload_bytes, r[0].payload_digest) == (5, 50_000, hashlib.sha1(payload).hexdigest())


@pytest.mark.parametrize("fault", ["missing", "last", "length"])
def test_faulty_segments_are_found(spark, fault):
    payload = b"abc" * 1000
    made = warc.records("<a>", 5, "u", payload, None, hashlib.sha1(payload).hexdigest(), segment=500)
    if fault == "missing":
        del made[2]
    elif fault == "last":
        del made[-1]
    else:
        made[-1] = made[-1].replace(b"Total-Length: 3", b"Total-Length: 4")
    path = shared_path(spark, "faulty")
    write_blobs(spark.createDataFrame([(b"".join(made),)], "file binary"), "file", path)
    with pytest.raises(Exception, match="segments are|last segment says"):
        warc.read_archives(spark, path).collect()


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        p = random.Random(n).randbytes(n)
        assert warc.dechunked(warc.chunked(p)) == p
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nab"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_blobs_keep_all_bytes(spark):
    made = [bytes(range(256)) * 10, b"\n", b"\xff\xfe\x00", b"\r\n\r\n"]
    path = shared_path(spark, "blobs")
    write_blobs(spark.createDataFrame([(b,) for b in made], "file binary").repartition(2), "file", path)
    assert sorted(bytes(r.content) for r in read_blobs(spark, path).collect()) == sorted(b + b"\n" for b in made)


# extraction


@pytest.fixture(scope="session")
def model():
    return extraction.train(list(extraction.labelled_pages()))


def test_held_out_layouts(model):
    right = total = 0
    for tree in extraction.labelled_pages(200, seed=123):
        for node, p in zip(tree.nodes, model.marginals(tree.nodes), strict=True):
            if node.letters:
                total, right = total + 1, right + ((p > 0.5) == bool(node.label))
    assert right / total > 0.98


def test_marginals_are_those_of_all_labelings(model):
    r = random.Random(3)
    for _ in range(20):
        nodes = [dom.Node("#root", -1, [])]
        for k in range(1, 9):
            nodes.append(dom.Node(r.choice(("div", "p", "nav", "article", "ul", "li")), r.randrange(k), r.choice(([], ["ad"], ["content"])), r.choice((0, 10, 200)), r.choice((0, 5))))
        weight, content = 0.0, np.zeros(len(nodes))
        for y in itertools.product((0, 1), repeat=len(nodes)):
            score = sum((-20.0 if v == 0 else model.evidence(n)) * y[v] for v, n in enumerate(nodes)) + sum(model.tie[y[n.parent]][y[v]] for v, n in enumerate(nodes) if v)
            weight += math.exp(score)
            content += math.exp(score) * np.array(y)
        assert np.allclose(model.marginals(nodes), content / weight, atol=1e-9)


PAGE_HTML = (
    "<html><head><title>t</title><style>p{}</style><script>var t='</p><p>no</p>';</script></head><body><header class='site-header'><a href='/'>Home</a></header>"
    "<div id=cookie-notice><p>We use cookies to make this site better for all of the people here.</p></div><nav><ul><li><a>x</a><li><a>y</a></ul></nav><!-- <p>no</p> -->"
    "<main><article><h1>A &amp; B</h1><p>Some long\n text&nbsp;stands <b>here, it<br>is what <p>matters to all of us.<div class='ad'><p>buy now buy now</p></div><p>More &lt;text&gt;.</p></article>"
    "<section class=comments><h2>Comments</h2>" + "<div class=comment><p>I really think that this is a long reader comment which goes on.</p></div>" * 12 + "</section></main>"
    "<aside class=sidebar><p>About us</p></aside><form><label>mail</label><input></form><footer>&copy; me</footer></body></html>"
)


def test_page_by_hand(model):
    assert extraction.main_text(PAGE_HTML, model) == "A & B\nSome long text stands here, it is what\nmatters to all of us.\nMore <text>."


@pytest.mark.parametrize("page", ["", "<", "<p", "</", "<!--", "<script>", "<a href='x", "&", "&#0;&#x110000;", "<p>" * 3000, "<div>" * 5000 + "x", "</p></div></x>", "\x00<p>\x00", "<b><i><p></i>"])
def test_broken_pages(model, page):
    assert isinstance(extraction.main_text(page, model), str)


@pytest.mark.parametrize("page", ["<foo>" * 200_000, "<div>" * 100_000 + "</foo></div></p>" * 100_000, "<div>" * 100_000 + "</span></bar>" * 100_000, "<td><p>" * 100_000, "<li><ul>" * 100_000 + "</li>" * 100_000])
def test_broken_pages_take_time_in_proportion(page):
    began = time.process_time()
    dom.parse(page)
    assert time.process_time() - began < 2 * PACE


def test_noscript():
    """Shown where it stands among the blocks, unseen in a head."""
    texts = lambda page: [t for _, t in dom.parse(page).blocks]
    assert texts("<body><article><p>a</p><noscript><p>b</p></noscript><p>c</p></article>") == ["a", "b", "c"]
    assert texts("<head><noscript><p>b</p></noscript><title>t</title></head><body><p>c") == ["c"]
    assert texts("<head><noscript><p>b</p><body>x<p>c") == ["x", "c"]
    assert texts("<head><noscript><p>b</p></head>x<p>c") == ["x", "c"]
    assert texts("<head><noscript><p>b</p>") == []


def test_extract(spark, sf_dir, odd, empty, model):
    rows = {r.page_id: r for r in QUERIES["op6_tree_marginals"](spark, sf_dir).collect()}
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert rows.keys() == pages.keys()
    for i, r in rows.items():
        assert r.text == extraction.main_text(pages[i].html, model) and r.n_chars == len(r.text) and r.url == pages[i].url
        article = dom.parse(pages[i].html[pages[i].html.index("<article>") : (pages[i].html + "</article>").index("</article>")])
        assert r.text == "\n".join(t for _, t in article.blocks)
    assert extraction.extract(odd, model).count() == odd.count() and extraction.extract(empty, model).count() == 0


# URL filters


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark, sf_dir, odd, empty):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    more = ["HTTP://A.EXAMPLE.ORG/es/", "http://example.org/es", "http://example.org", "http://xexample.org/es/", "http://example.org/en/1", "http://example.org/en/2", "x://com/fr/", "http://a.com/de/?://b.org/", "http://a.com?x=/fr/", "a://b://c.org/", "http://user@h.org:80/p#q"]
    extra = spark.createDataFrame([(100_000 + k, u, None) for k, u in enumerate(more)], PAGE)
    for df in (pages.unionByName(extra), odd):
        got = urls.url_verdicts(df).collect()
        url = Counter((r.page_id, *plain_rule(r.url)) for r in df.collect())
        assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == url
        assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.url_verdicts(empty).count() == 0


def test_segmentation_is_the_best_split():
    counts = {"the": 50, "re": 20, "there": 5, "ring": 9, "thering": 1, "in": 30, "her": 8, "g": 3, "the re": 1}
    segment = urls.segmenter(counts)
    total = sum(counts.values()) + 1
    cost = lambda w: -math.log(counts[w] / total) if len(w) > 1 and w in counts else math.log(total) + 4 if len(w) == 1 else math.inf
    for name in ("thering", "therethe", "inthe", "xthe", "qqq", "rethering", ""):
        splits = [[name[a:b] for a, b in itertools.pairwise((0, *cuts, len(name)))] for k in range(len(name)) for cuts in itertools.combinations(range(1, len(name)), k)] if name else [[]]
        best = min(sum(map(cost, s)) for s in splits)
        got = segment(name)
        assert "".join(got) == name
        assert sum(cost(w) if w in counts and len(w) > 1 else sum(map(cost, w)) for w in got) == pytest.approx(best)


def test_naive_bayes_counts(spark):
    rows = spark.createDataFrame([("allow", ["a", "b", "a"]), ("block", ["b"]), ("block", ["c", "b"])], "verdict string, tokens array<string>")
    prior, odds = urls.naive_bayes(rows)
    assert prior == pytest.approx(math.log(2 / 3))
    assert odds == pytest.approx({"a": math.log(3 / 6 / (1 / 6)), "b": math.log(2 / 6 / (3 / 6)), "c": math.log(1 / 6 / (2 / 6))})
    assert urls.naive_bayes(rows.limit(0)) == (0.0, {})


def test_models_are_whole(spark):
    """Rare and long title words, long labels and rare tokens count, however many others are more frequent."""
    name = lambda k: "".join("bcdfghjklmnpqrst"[k >> 4 * i & 15] for i in range(4))
    many = " ".join(name(k) for k in range(51_000))
    long = "antidisestablishmentarianismus"
    title = lambda t: f"<title>{t}</title>"
    rows = [(1, "http://x.org/" + many.replace(" ", "/"), title(many)), (2, "http://x.org/" + many.replace(" ", "/"), title(many)), (3, "http://example.org/es/zebu", title(f"zebu {long}"))]
    rows += [(4, f"http://zebu{long}.org/es/", None), (5, f"http://{'zebu' * 80}.example.org/es/", None), (6, f"http://{long}zebu.net/", None), (7, "http://a.net/zebu", None), (8, f"http://{'zebu' * 80}.net", None)]
    got = {r.page_id: r for r in urls.url_verdicts(spark.createDataFrame(rows, PAGE)).collect()}
    counts = Counter(w for _, _, h in rows for w in re.findall(r"[a-z]+", (h or "")[7:-8]))
    hosts = " ".join(u.split("/")[2] for _, u, _ in rows)
    segment = urls.segmenter({w: n for w, n in counts.items() if w in hosts}, sum(counts.values()))
    assert segment(f"zebu{long}") == ("zebu", long)
    tokens = {i: [t for x in urls.parts(*plain_rule(u)[:2]) for t in ([f"h:{w}" for w in segment(x[2:])] if x[:2] == "l:" else [x])] for i, u, _ in rows}
    said = {i: plain_rule(u)[3] for i, u, _ in rows}
    n = {v: Counter(t for i, ts in tokens.items() if said[i] == v for t in ts) for v in ("allow", "block")}
    total = {v: sum(n[v].values()) + len(n["allow"] | n["block"]) for v in n}
    logs = lambda v, t: math.log((n[v][t] + 1) / total[v])
    prior = math.log((1 + sum(v == "allow" for v in said.values())) / (1 + sum(v == "block" for v in said.values())))
    for i, ts in tokens.items():
        want = prior + sum(logs("allow", t) - logs("block", t) for t in ts if t in n["allow"] or t in n["block"])
        assert got[i].score == pytest.approx(want) and got[i].verdict == (said[i] or ("allow" if want >= 0 else "block"))
    assert {i: got[i].verdict for i in (7, 8)} == {7: "block", 8: "block"}


def test_heads_without_end_tags():
    model = extraction.train(list(extraction.labelled_pages()))
    body = "<div class=article>" + "".join(f"<p>A sentence of some length stands here, number {k}, and goes on for a while.</p>" for k in range(8)) + "</div>"
    want = extraction.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>", model)
    assert want.count("sentence") == 8
    for head in ("<head><title>t</title><body>", "<head><title>t</title><meta name=x><body>", "<head><title>t</title>", "<HEAD><style>p {}</style>\n<noscript><p>no</p></noscript>"):
        assert extraction.main_text(f"<html>{head}{body}", model) == want
    tree = dom.parse("<html><head><title>t</title>first <b>words</b></head><p>then")
    assert [(tree.nodes[v].tag, t) for v, t in tree.blocks] == [("html", "first words"), ("p", "then")]
    assert [tree.nodes[n.parent].tag for n in dom.parse("<html><head><frameset><frame></frameset>").nodes if n.tag == "frameset"] == ["html"]


# top-k


def plain_top(ids, c, every, k):
    out = []
    for i, q in zip(ids, c, strict=True):
        if i % every == 0:
            best = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v, strict=True))), j) for j, v in zip(ids, c, strict=True) if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_threshold_search(spark, monkeypatch, seed):
    r = np.random.default_rng(seed)
    n, d = 120, 6
    x = (r.normal(size=(n, d)) * r.choice([0.01, 1.0, 5.0], size=(n, 1))).round(2)
    x[r.integers(0, n, 30)] = x[3]  # many equal vectors
    x[r.integers(0, n, 5)] = 0.0
    monkeypatch.setattr(topk, "VECTORS", 40)
    monkeypatch.setattr(topk, "QUERIES", 5)
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, topk.top_k(df, every=7).collect()))
    assert got == sorted(plain_top(list(range(n)), np.floor(256 * x).astype(int), 7, 5))


def test_search_stops_early(monkeypatch):
    """One vector is far ahead: the others beyond the bound are never scored."""
    r = np.random.default_rng(0)
    c = r.integers(-9, 10, size=(5000, 4))
    c[:6] = 1000
    scored = []
    plain = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda k: scored.append(len(k[0])) or plain(k))
    got = topk.threshold_search(np.arange(5000), c, np.array([-1]), np.array([[3, 1, 2, 1]]), 5)
    assert [i for _, i, _ in got] == [0, 1, 2, 3, 4] and sum(scored) < 1000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (50, [1.0, nan], 0), (100, None, 0), (150, [1.0, None], 0), (1, [inf, 1.0], 0), (2, [1.0, 1.0], 0), (3, [1.0, 1.0, 1.0], 0), (200, [0.0, 0.0], 0), (None, [1.0, 1.0], 0), (250, [], 0), (300, [], 0), (0, [1.0, 2.0], 0), (4, [1e12, -1e12], 0), (350, [1e30, 1.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, v int, cb int, score int")
    got = {}
    for q, rank, i, s in sorted(map(tuple, topk.top_k(df).collect())):
        got.setdefault(q, []).append((i, s))
        assert rank == len(got[q])
    assert got.keys() == {0, 200, 250, 300, 350}
    assert got[250] == [(300, 0)] and [i for i, _ in got[200]] == [0, 0, 2, 4, 350]
    assert all(s == 0 for _, s in got[200]) and got[0][0][0] == 350
    assert topk.top_k(df.limit(0)).count() == 0


def test_compressed_archives():
    made = warc.records("<a>", 5, "u", b"abc", None, hashlib.sha1(b"abc").hexdigest())
    made += warc.records("<b>", 6, "v", b"", None, hashlib.sha1(b"").hexdigest())
    want = list(warc.parsed(b"".join(made)))
    assert len(want) == 2
    assert list(warc.parsed(gzip.compress(b"".join(made)))) == want
    assert list(warc.parsed(b"".join(map(gzip.compress, made)) + b"\n")) == want
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(gzip.compress(b"".join(made))[:-9]))
