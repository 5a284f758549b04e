"""Cases worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from redsieve.config import Settings, settings
from redsieve.functions import geometry as g
from redsieve.functions import text
from redsieve.functions.payload import BOX_KEYS, WORD_KEYS, box_entries, index_entries, loads_tolerant, unwrapped


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (0, 0, 5, 10), 0.5), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)],
)
def test_iou(spark, a, b, want):
    boxes = [g.Box(*(F.lit(float(v)) for v in x)) for x in (a, b)]
    row = spark.range(1).select(g.iou(*boxes).alias("x"), g.iou(*boxes[::-1]).alias("y")).first()
    assert row.x == pytest.approx(want) and row.x == row.y


def test_bounds(spark):
    unit = g.Box(*(F.lit(float(v)) for v in (0, 0, 10, 10)))
    at = lambda *v: g.Box(*(F.lit(float(x)) for x in v))
    row = spark.range(1).select(g.center_in(at(8, 8, 12, 12), unit).alias("edge"), g.center_in(at(9, 9, 12, 12), unit).alias("out"), g.overlaps(at(10, 0, 12, 3), unit).alias("touch"), g.overlaps(at(9, 0, 12, 3), unit).alias("over")).first()
    assert (row.edge, row.out, row.touch, row.over) == (True, False, False, True)


def test_polygon_and_units(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 2.0, 3.0, 4.0, 1.0, 4.0], "inch"), ([1.0, 2.0], "pixel"), ([0.0, 0.0, 96.0, 0.0, 96.0, 96.0, 0.0, 96.0], "pixel"), ([0.0] * 8, None)], "p array<double>, unit string")
    b = g.polygon_box(F.col("p"), g.unit_scale(F.col("unit")))
    assert [tuple(r) for r in df.select(*b).collect()] == [(72.0, 144.0, 216.0, 288.0), (None,) * 4, (0.0, 0.0, 72.0, 72.0), (0.0,) * 4]


@pytest.mark.parametrize("blank", ["\t", "\x0b", "\x1c", "\x1f", " ", "\x85", "\xa0", " ", " ", " ", " ", " ", "　"])
def test_white_space_as_python_has_it(spark, blank):
    raw = f"a{blank}b{blank}{blank}c{blank}"
    got = spark.createDataFrame([(raw,)], "t string").select(text.split_words(F.col("t")).alias("w")).first().w
    assert got == raw.split() == ["a", "b", "c"]


def test_terms_and_words(spark):
    got = spark.createDataFrame([("Foo , Inc",), ("$TRB",), (",",), ("",), (None,)], "t string").select(text.term_tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [["foo", "", "inc"], ["$trb"], [""], [], []]
    got = spark.createDataFrame([("$TRB.",), ('("Word")',), ("...",)], "t string").select(text.normalized_word(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == ["trb", "word", ""]


def test_labels_timestamps_chunks(spark):
    got = spark.createDataFrame([("a b/c",), ("--",), (None,), ("x_1.y-z",)], "t string").select(text.safe_label(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == ["a-b-c", "run", "run", "x_1.y-z"]
    got = spark.createDataFrame([("2026-06-09T14:23:45",), ("",), ("2026",)], "t string").select(text.file_timestamp(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == ["20260609-142345", "00000000-000000", "2026"]
    got = spark.createDataFrame([("abcde",), ("",), ("ab   ",)], "t string").select(text.chunks(F.col("t"), 2).alias("c")).collect()
    assert [[tuple(c) for c in r.c] for r in got] == [[(0, "ab"), (2, "cd"), (4, "e")], [], [(0, "ab")]]


def test_last_object(spark):
    rows = [('x {"verdict": "A"} y {"verdict": "B", "k": {"z": 1}} {"other": 1}',), ("none",), ('{"a": {"b": {"verdict": 1}}}',), ('{"verdict": "{" }',), ('{"verdict": "' + "x" * 50_000 + '"}',)]
    got = spark.createDataFrame(rows, "t string").select(text.last_object_with(F.col("t"), ("verdict",)).alias("o")).collect()
    assert json.loads(got[0].o)["verdict"] == "B"
    assert got[1].o is None and got[3].o is None
    assert got[2].o is None or json.loads(got[2].o) == {"verdict": 1}  # only one further level is seen
    assert len(got[4].o) > 50_000


def test_tolerant_payloads():
    assert loads_tolerant('[{"page": 0}]') == ([{"page": 0}], 0)
    value, dropped = loads_tolerant('[{"page": 0, "s": "}\\"{"}, {"page": 1, "x": [1')
    assert value == [{"page": 0, "s": '}"{'}] and dropped == len(', {"page": 1, "x": [1')
    assert loads_tolerant('{"spans": [{"page": 0}, {"page"') == (None, 0)
    assert loads_tolerant("nothing") == (None, 0)
    assert unwrapped({"x": [3], "items": [1], "spans": 2}, WORD_KEYS) == [1]
    assert unwrapped({"x": [3]}, WORD_KEYS) == [3] and unwrapped({}, WORD_KEYS) == [] and unwrapped(7, WORD_KEYS) is None
    assert unwrapped({"missed": [1], "boxes": [2]}, BOX_KEYS) == [2]


def test_entries():
    got = index_entries('[{"page":"1","word_indices":[0,"2",3.7,"3.7",null]},{"word_indices":[1]},5,{"page":2,"word_indices":null}]', WORD_KEYS, ("word_indices",))
    assert got["keys"] == [{"page": 1, "idx": 0}, {"page": 1, "idx": 2}, {"page": 1, "idx": 3}] and got["invalid"] == 4
    got = index_entries('{"regions":[{"page":0,"region_indices":[],"indices":[4]}]}', ("regions",), ("region_indices", "indices"))
    assert got["keys"] == [{"page": 0, "idx": 4}]
    assert index_entries("{oops", WORD_KEYS, ("word_indices",))["ok"] is False
    got = box_entries('[{"page":0,"bbox":["1",2,3,4],"confidence":null,"label":"l"},{"page":0,"bbox":[1,2,3]},{"bbox":[1,2,3,4]}]')
    assert got["invalid"] == 2 and got["boxes"][0]["confidence"] == 1.0 and got["boxes"][0]["label"] == "l" and got["boxes"][0]["x0"] == 1.0


@pytest.mark.parametrize(("raw", "want"), [(None, 8), ("5", 5), ("1", 2), ("many", 8)])
def test_iteration_cap(raw, want):
    assert settings({} if raw is None else {"REDACTION_MAX_ITERATIONS": raw}) == Settings(max_iterations=want)
