"""Traps of single operators, and folds against plain versions of them."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from redsieve.cli import initial_state
from redsieve.operators import identity, metrics, regions, render, review, words
from redsieve.plans.catalog import QUERIES
from redsieve.plans.loop import State, rule_reviewer, run_loop, supplemental, term_redactor
from redsieve.plans.relations import Relations
from redsieve.sources import detectors, sinks
from redsieve.streaming.intake import documents_stream, start_intake

WORD = "doc_id long, page int, idx int, text string, x0 double, top double, x1 double, bottom double"
DETECTION = "doc_id long, page int, source string, seq int, x0 double, top double, x1 double, bottom double, conf double, label string"


def page_words(spark, *pages: str, doc_id: int = 1):
    rows = [(doc_id, p, i, w, 10.0 * i, 0.0, 10.0 * i + 8, 10.0) for p, t in enumerate(pages) for i, w in enumerate(t.split())]
    return spark.createDataFrame(rows, WORD)


def sizes(spark, n: int, doc_id: int = 1):
    return spark.createDataFrame([(doc_id, p, 600.0, 800.0) for p in range(n)], "doc_id long, page int, width double, height double")


def keys(df):
    return sorted((r.page, r.idx) for r in df.collect())


def test_sweep_overlaps_pages_and_duplicates(spark):
    w = page_words(spark, "a a a x", "x", "y $TRB , .")
    t = lambda *terms: spark.createDataFrame(list(enumerate(terms)), "term_no int, term string")
    assert keys(words.sweep(w, t("a a"))) == [(0, 0), (0, 1)]
    assert keys(words.swept_marks(words.sweep(w, t("a a")))) == [(0, 0), (0, 1), (0, 2)]
    assert keys(words.sweep(w, t("x x"))) == []  # phrases don't cross pages
    assert {(r.label, r.matches) for r in words.sweep_counts(words.sweep(w, t("a", "a", "zzz"))).collect()} == {("a", 6)}
    assert keys(words.sweep(w, t("$TRB"))) == []
    assert keys(words.sweep(w, t(","))) == [(2, 2), (2, 3)]
    assert keys(words.sweep(w, t(""))) == []


def test_sweep_terms_of_a_document(spark):
    w = page_words(spark, "a b", doc_id=1).union(page_words(spark, "a b", doc_id=2))
    t = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "doc_id long, term_no int, term string")
    assert sorted((r.doc_id, r.idx) for r in words.sweep(w, t).collect()) == [(1, 0), (2, 1)]


def test_text_views(spark):
    w = page_words(spark, "a b", "c")
    m = spark.createDataFrame([(1, 0, 1)], "doc_id long, page int, idx int")
    assert words.redacted_text(w, m).first().text == "\n--- Page 1 ---\n a [REDACTED] \n \n--- Page 2 ---\n c"
    assert words.redacted_text(w, m, 5).first().text == "\n--- "
    far = page_words(spark, "a", "b", "c", "d", "e")
    assert words.evidence_text(far, sizes(spark, 5)).first().evidence == "[Page 1]\na\n\n[Page 2]\nb\n\n[Page 5]\ne"
    assert words.evidence_text(far, sizes(spark, 5), most=4).first().evidence == "[Pag\n... [truncated]"


def test_marks_are_added_once(spark):
    m = spark.createDataFrame([(1, 0, 1), (1, 0, 1)], "doc_id long, page int, idx int")
    assert words.add_marks(m, m).count() == 1 and words.newly_marked(m, m).count() == 0


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def random_detections(seed, docs=6, pages=4):
    r = random.Random(seed)
    rows = []
    for d in range(docs):
        for p in range(pages):
            for source in ("layout", "vision"):
                for seq in range(r.randint(0, 6)):
                    x, y = r.randint(0, 30), r.randint(0, 30)
                    rows.append((d, p, source, seq, float(x), float(y), float(x + r.randint(5, 40)), float(y + r.randint(5, 40)), r.random(), r.choice([None, "", "logo", "mark"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_fusion_is_the_fold(spark, seed):
    rows = random_detections(seed)
    want = {}
    for d, p in {(r[0], r[1]) for r in rows}:
        of = lambda s: [[r[4:8], r[8], r[9] or None] for r in rows if r[:3] == (d, p, s)]  # noqa: B023, E731
        boxes = of("layout")
        for v in of("vision"):
            for c in boxes:
                if plain_iou(v[0], c[0]) >= 0.5:
                    c[:] = [(min(v[0][0], c[0][0]), min(v[0][1], c[0][1]), max(v[0][2], c[0][2]), max(v[0][3], c[0][3])), max(v[1], c[1]), v[2] or c[2]]
                    break
            else:
                boxes.append(v)
        want |= {(d, p, k): (tuple(b[0]), b[1], b[2]) for k, b in enumerate(boxes)}
    got = regions.fused(spark.createDataFrame(rows, DETECTION)).collect()
    assert {(r.doc_id, r.page, r.idx): ((r.x0, r.top, r.x1, r.bottom), r.conf, r.label) for r in got} == want


def region(page, idx, box, label=None, confidence=0.5, strategy="inline", doc_id=1):
    return (doc_id, page, idx, "logo", *map(float, box), confidence, label, strategy)


REGION = "doc_id long, page int, idx int, kind string, x0 double, top double, x1 double, bottom double, confidence double, label string, strategy string"


def test_propagation(spark):
    mark, near = (10, 10, 50, 30), (11, 10, 51, 30)
    rows = [region(0, 0, mark, "", 0.9), region(1, 0, near, "brand", 0.4), region(3, 0, mark, None, 0.8), region(4, 2, (12, 10, 52, 30), None), region(0, 1, (0, 0, 600, 790)), region(1, 1, (0, 0, 600, 790)), region(3, 1, (0, 0, 600, 790))]
    got = regions.propagated(spark.createDataFrame(rows[:3] + rows[4:], REGION), page_words(spark, "a"), sizes(spark, 6)).collect()
    assert sorted((r.page, r.idx) for r in got) == [(2, 0), (4, 0), (5, 0)]  # the large ones never spread
    assert all(r.x0 == pytest.approx(31 / 3) and r.confidence == 0.4 and r.label == "brand" for r in got)
    got = regions.propagated(spark.createDataFrame(rows[:2], REGION), page_words(spark, "a"), sizes(spark, 6))
    assert got.count() == 0  # two pages aren't enough
    twice = spark.createDataFrame([*rows[:2], region(0, 5, near)], REGION)
    assert regions.propagated(twice, page_words(spark, "a"), sizes(spark, 6)).count() == 0  # pages count, not boxes


def test_strategy_limits(spark):
    w = page_words(spark, " ".join("abcdefgh"))
    boxes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 600.0, 280.0), (1, 0, 1, 0.0, 0.0, 600.0, 279.0), (1, 0, 2, 0.0, 100.0, 60.0, 110.0), (1, 0, 3, 0.0, 0.0, 60.0, 10.0)], "doc_id long, page int, idx int, x0 double, top double, x1 double, bottom double")
    got = {r.idx: (r.n_words, r.strategy) for r in regions.classified(boxes, w, sizes(spark, 1), ["idx"]).collect()}
    assert got == {0: (8, "page_split"), 1: (8, "page_split"), 2: (0, "inline"), 3: (6, "inline")}


def test_page_map_and_remap(spark):
    m = regions.page_map(sizes(spark, 3), spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page int"))
    assert sorted((r.rendered_page, r.source_page) for r in m.collect() if r.source_page is not None) == [(0, 0), (2, 1), (4, 2)]
    f = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 9), (1, "d", None)], "doc_id long, fid string, page int")
    assert {r.fid: r.page for r in regions.remapped(f, m).collect()} == {"b": 1, "c": 9, "d": None}


def test_findings_order(spark):
    reg = spark.createDataFrame([region(0, 0, (0, 0, 10, 10))], REGION)
    marks = spark.createDataFrame([(1, 0, 0)], "doc_id long, page int, idx int")
    f = spark.createDataFrame([(1, "same", 0, 0.0, 0.0, 10.0, 10.0, "Acme"), (1, "label", 0, 200.0, 200.0, 210.0, 210.0, "the ACME mark"), (1, "text", 0, 20.0, 0.0, 39.0, 10.0, None), (1, "kept", 0, 300.0, 300.0, 310.0, 310.0, "x"), (1, "odd", None, 1.0, 1.0, 2.0, 2.0, "acme")], "doc_id long, fid string, page int, x0 double, top double, x1 double, bottom double, label string")
    p = spark.createDataFrame([(1, ["acme"])], "doc_id long, terms array<string>")
    got = regions.reviewed_findings(f, reg, marks, page_words(spark, "a b The Acme"), p)
    assert {r.fid: r.outcome for r in got.collect()} == {"same": "dedupe", "label": "label", "text": "text", "kept": "kept", "odd": "kept"}


def test_detectors(spark):
    o = spark.createDataFrame([(1, 0, 0, [("Company LOGO", 0.4), ("cat", 0.9), ("brand", 0.3)], 150.0, 0.0, 75.0, 75.0), (1, 0, 1, [("dog", 0.9)], 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, seq int, tags array<struct<name:string,confidence:double>>, x double, y double, w double, h double")
    c = spark.createDataFrame([(1, 0, 0, "a watermark", 0.7, 0.0, 0.0, 150.0, 150.0)], "doc_id long, page int, seq int, text string, confidence double, x double, y double, w double, h double")
    got = {r.label: (r.conf, r.x0, r.x1) for r in detectors.vision_marks(o, c).collect()}
    assert got == {"brand": (0.4, 72.0, 108.0), "a watermark": (0.7, 0.0, 72.0)}
    p = spark.createDataFrame([(1, 0, 0, "inch", [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]), (1, 7, 0, "inch", [0.0] * 8), (1, 0, 1, "inch", [1.0, 2.0])], "doc_id long, page int, seq int, unit string, polygon array<double>")
    assert detectors.layout_figures(p, sizes(spark, 2)).count() == 1 and detectors.layout_figures(p, None).count() == 2


def test_supplement_rules(spark):
    w = page_words(spark, "a b", "c", "d")
    reg = spark.createDataFrame([region(0, 0, (5, 0, 9, 9)), region(1, 0, (500, 500, 510, 510)), region(2, 0, (0, 0, 9, 9))], REGION)
    none = spark.createDataFrame([], "doc_id long, page int, idx int")
    all_marks = reg.select(*words.KEY)
    pages = lambda m, r, s: sorted(x.page for x in render.supplemental_pages(w, m, reg, r, s).collect())
    no_split, split = none.select("doc_id", "page"), spark.createDataFrame([(1, 1)], "doc_id long, page int")
    assert pages(none, all_marks, no_split) == [0, 2]
    assert pages(none, all_marks, split) == [0, 1, 2]
    assert pages(none, none, split) == []  # a split page without a marked region has none
    assert pages(w.where("page = 2").select(*words.KEY), all_marks, split) == [0, 1]  # nothing is left to show on the third


def test_degenerate_and_wrapping(spark):
    w = page_words(spark, " ".join("x" * 26), " ".join("x" * 25))
    assert {r.page: r.degenerate for r in render.degenerate_pages(w).collect()} == {0: True, 1: False}
    lines = render.wrapped_lines(["aa", "bb", "cc"], 200, 400, 0, lambda t: 25.0 * len(t), scale=1.0)
    assert lines == [(14, 14, "aa bb"), (14, 26, "cc")]
    assert len(render.wrapped_lines(["aaaaaaaa"] * 50, 200, 100, 0, lambda t: 20.0 * len(t), scale=1.0)) < 50


def test_identity(spark):
    raw = 'noise {"client": {"name": " Acme ", "aliases": ["ACME", "A", 5, null, " "], "tickers": ["TRB"], "people": ["Bo"]}, "preparer": {"name": null}, "confidence": "HIGH"}'
    c = identity.parsed_context(spark.createDataFrame([(1, raw), (2, "none")], "doc_id long, response string"))
    got = {r.doc_id: r for r in c.collect()}
    assert got[1].client.name == "Acme" and got[1].client.aliases == ["ACME", "A", "5"] and got[1].preparer.name == "" and got[1].confidence == "high"
    assert got[2].client.name == "" and got[2].confidence == "low"
    t = identity.identity_terms(c.select("doc_id", F.col("client").alias("party")))
    assert [r.term for r in t.orderBy("pos").collect()] == ["Acme", "A", "5", "TRB"]
    assert "Client: Acme" in identity.rendered_context(c).where("doc_id = 1").first().block
    assert json.loads(identity.seed_terms(c).first().terms) == ["Acme", "A", "5", "TRB"]


def test_verdicts_and_misses(spark):
    raw = 'a {"verdict": "APPROVED"} then {"verdict": "REVISE", "missed": [{"page": 1, "type": " LOGO ", "bbox": [1, 2, 3, 4]}, {"page": 0, "type": "logo", "bbox": [1, 2, 3, 4]}, {"type": "logo", "bbox": [1, 2]}, 7], "feedback": "f"}'
    v = review.parsed_verdicts(spark.createDataFrame([(1, raw), (2, "nothing"), (3, '{"verdict": "APPROVED", "missed": 5}')], "doc_id long, answer string"))
    got = {r.doc_id: (r.verdict, r.feedback) for r in v.collect()}
    assert got == {1: ("REVISE", "f"), 2: ("REVISE", review.FEEDBACK_UNPARSED), 3: ("APPROVED", "")}
    m = review.missed_entries(v)
    assert m.count() == 4
    b = review.miss_buckets(m, "doc_id").first()
    assert (b.logo, b.other, b.pii) == (3, 1, 0)
    assert json.loads(review.logo_block(m).first().block) == [{"page": 0, "bbox": [1.0, 2.0, 3.0, 4.0], "reason": "logo"}]


def test_rules(spark):
    text = "mail a.b@c.org, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130, $5.3 million, 10.0.0.1 and +1 (348) 555-6455"
    got = review.rule_entities(review.text_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert {r.category for r in got} == {"Email", "USSocialSecurityNumber", "IBAN", "CurrencyAmount", "IPAddress", "PhoneNumber"}


HISTORY = "run_id long, iteration int, verdict string, missed_count int, word_delta int, region_delta int"


@pytest.mark.parametrize(
    ("rows", "most", "want"),
    [
        ([("APPROVED", 0, 5), ("APPROVED", 0, 0)], None, (2, "approved")),
        ([("REVISE", 3, 5), ("REVISE", 3, 0), ("REVISE", 3, 0), ("REVISE", 3, 0)], None, (3, "stalled")),
        ([("REVISE", 3, 5)], 1, (1, "limit")),
        ([("APPROVED", 3, 5)], 1, (1, "approved")),
        ([("REVISE", 3, 5), ("REVISE", 2, 0), ("REVISE", 2, 1)], 3, (3, "limit")),
    ],
)
def test_exit_rules(spark, rows, most, want):
    h = spark.createDataFrame([(1, k + 1, v, m, w, 0) for k, (v, m, w) in enumerate(rows)], HISTORY)
    e = metrics.exits(h, most).first()
    assert (e.iteration, e.decision) == want


def test_redacted_texts_are_whole(spark, tmp_path):
    from redsieve import cli
    from redsieve.plans.catalog import QUERIES, flagship

    spark.createDataFrame([(1, "of the " + "word " * 20_000 + "end")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = flagship(spark, str(tmp_path)).first().text
    assert len(whole) > 100_000 and whole.endswith(" end") and whole.count("[REDACTED]") == 2
    assert QUERIES["redacted_documents"](spark, str(tmp_path)).first().text == whole
    assert QUERIES["redacted_text_view"](spark, str(tmp_path)).first().text == whole[:60_000]
    assert cli.main(["--input", str(tmp_path / "documents.parquet"), "--output", str(tmp_path / "out"), "--term", "of the"]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "text")).first().text == whole
    audit = json.loads(spark.read.text(str(tmp_path / "out" / "audit")).first().value)
    assert [x["iteration"] for x in audit["history"]] == [1, 2] and audit["history"][-1]["decision"] == "approved"


def test_loop(spark):
    w = page_words(spark, "call a.b@c.org now", doc_id=1).union(page_words(spark, "the plain text", doc_id=2))
    reg = spark.createDataFrame([region(0, 0, (0, 0, 9, 9), strategy="page_split", doc_id=2)], REGION)
    none = spark.createDataFrame([], "doc_id long, page int, idx int")
    s = State(w, sizes(spark, 1, 1).union(sizes(spark, 1, 2)), reg, none, none, none.select("doc_id", "page"))
    s, h = run_loop(s, term_redactor(spark.createDataFrame([(0, "plain")], "term_no int, term string")), rule_reviewer())
    text = {r.doc_id: r.text for r in words.redacted_text(s.words, s.word_marks).collect()}
    assert text[1].endswith("call [REDACTED] now") and text[2].endswith("the [REDACTED] text")
    assert {(r.run_id, r.iteration, r.decision) for r in h.collect()} == {(1, 1, "feedback"), (1, 2, "approved"), (2, 1, "forced"), (2, 2, "approved")}
    assert supplemental(s).count() == 1


def test_loop_with_logos(spark):
    """The reviewer's logos become marked boxes, the preparer's own and covered ones don't; identity terms seed the first pass."""
    from redsieve.plans.loop import both, logo_reviewer

    w = page_words(spark, "Acme builds rockets", doc_id=1).union(page_words(spark, "all is plain here", doc_id=2))
    none = spark.createDataFrame([], "doc_id long, page int, idx int")
    reg = spark.createDataFrame([region(0, 0, (0, 0, 9, 9), doc_id=2)], REGION)
    party = "doc_id long, party struct<name:string,aliases:array<string>,tickers:array<string>,subsidiaries:array<string>,people:array<string>,industry:string,evidence:string>"
    of = lambda i, name: (i, (name, [], [], [], [], "", ""))
    parties = spark.createDataFrame([of(1, "acme")], party)
    preparers = spark.createDataFrame([of(1, "Printer"), of(2, "Printer")], party)
    finding = "doc_id long, fid string, page int, x0 double, top double, x1 double, bottom double, confidence double, label string"
    rows = [(1, "a", 0, 300.0, 300.0, 400.0, 340.0, 0.9, "brand logo"), (1, "b", 0, 300.0, 400.0, 400.0, 440.0, 0.9, "Printer logo"), (2, "c", 0, 0.0, 0.0, 9.0, 9.0, 0.9, "logo")]
    s = State(w, sizes(spark, 1, 1).union(sizes(spark, 1, 2)), reg, none, none, none.select("doc_id", "page"))
    reviewer = both(rule_reviewer(), logo_reviewer(spark.createDataFrame(rows, finding), preparers))
    s, h = run_loop(s, term_redactor(spark.createDataFrame([], "term_no int, term string"), parties=parties), reviewer)
    got = {(r.run_id, r.iteration): r for r in h.collect()}
    assert {k: r.decision for k, r in got.items()} == {(1, 1): "feedback", (1, 2): "approved", (2, 1): "forced", (2, 2): "approved"}
    assert got[1, 1].logo == 1 and got[1, 2].region_delta == 1
    asked = json.loads(got[1, 1].feedback_json)
    assert json.loads(asked["missed"]) == [{"type": "Logo", "text": "brand logo", "page": 0, "bbox": [300.0, 300.0, 400.0, 340.0]}]
    assert json.loads(got[2, 1].feedback_json)["missed"] == "[]" and got[1, 2].feedback_json is None
    new = s.regions.where("doc_id = 1").collect()
    assert [(r.idx, r.kind, r.x0, r.top, r.x1, r.bottom) for r in new] == [(0, "logo", 295.0, 295.0, 405.0, 345.0)]
    assert s.region_marks.where("doc_id = 1").count() == 1
    assert words.redacted_text(s.words, s.word_marks).where("doc_id = 1").first().text.endswith("[REDACTED] builds rockets")


def test_sinks(spark, tmp_path, sf_dir):
    from redsieve.plans.catalog import _runs
    from redsieve.plans.relations import Relations

    r = Relations(spark, sf_dir)
    summary = metrics.run_summary(_runs(r), r.history, r.tool_events)
    assert len(metrics.SUMMARY) == 24
    for _ in range(2):
        sinks.append_summary(summary, str(tmp_path / "summary"))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 2 * summary.count()
    row = sinks.metrics_rows(metrics.run_metrics(_runs(r), r.history, r.tool_events)).first()
    assert row.name == "run_20240102-030405_nightly-run" and json.loads(row.value)["duration_seconds"] == 12.35
    sinks.write_metrics(metrics.run_metrics(_runs(r), r.history, r.tool_events).limit(1), str(tmp_path / "metrics"))
    assert "run label" in sinks.report(summary.first().asDict())
    audits = spark.createDataFrame([(1, None, 2)], "run_id long, verdict string, iterations int")
    assert sinks.audit_rows(audits).first().value == '{"verdict":null,"iterations":2}'


def test_intake(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    q = start_intake(documents_stream(spark, str(tmp_path / "in")), review.text_chunks, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id", "start", "chunk").count() == review.text_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet")).count()


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents that share an id or have none, without words, with terms at the ends of pages, and with findings that go on and on."""
    long = " ".join(["w"] * 199 + ["of", "the"] * 150 + ["MIT", "License."] + ["a@b.org", "x"] * 60)
    rows = [(1, long), (2, None), (3, "  \n"), (4, ", , The $TRB 12-34"), (5, "same"), (5, "same"), (None, "of the"), (None, "a@b.org"), (7, "IP 1.2.3.4, call 1.2.3.4 $ 5 or $5 de la"), (14, "one " * 700), (21, "$5 $ 5,000 million 123-45-6789 of the")]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_pages_are_drawn_alone(spark, sf_dir, odd_folder):
    got = QUERIES["draw_list"](spark, sf_dir)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = QUERIES["draw_list"](spark, odd_folder)
    r = Relations(spark, odd_folder, True)
    want = render.draw_list(r.words, r.word_marks, r.regions, r.region_marks, r.split, r.sizes)
    assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)


def test_documents_are_judged_alone(spark, odd_folder):
    columns = ["run_id", "iteration", "verdict", "missed_count", "word_delta", "region_delta", "stall_streak", "decision"]
    r = Relations(spark, odd_folder)
    got = QUERIES["redaction_loop"](spark, odd_folder)
    want = run_loop(initial_state(spark, r.documents), term_redactor(r.terms), rule_reviewer())[1].select(columns)
    assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)
