"""JSON that agents send: lists of entries, perhaps wrapped in an object, perhaps cut off."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which each tool looks for a wrapped list, in this order.
WORD_KEYS = ("spans", "redactions", "items", "data")
REGION_KEYS = ("spans", "regions", "items", "data")
BOX_KEYS = ("spans", "boxes", "items", "data", "missed")


def loads_tolerant(raw: str) -> tuple[Any, int]:
    """The value and the number of characters given up. Of a list that is cut off, the entries up to the last complete object
    are read; of anything else that doesn't parse, None."""
    try:
        return json.loads(raw), 0
    except ValueError:
        pass
    end = _end_of_last_object(raw)
    if end is None:
        return None, 0
    try:
        return json.loads(raw[:end] + ("]" if raw.lstrip()[:1] == "[" else "")), len(raw) - end
    except ValueError:
        return None, 0


def _end_of_last_object(raw: str) -> int | None:
    """The place after the last brace, outside strings, that brings the depth to zero."""
    depth, end, quoted, at = 0, None, False, 0
    while at < len(raw):
        c = raw[at]
        if c == "\\":
            at += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if c == "}" and depth == 0:
                end = at + 1
        at += 1
    return end


def unwrapped(value: Any, keys: tuple[str, ...]) -> list | None:
    """The list itself, the first of ``keys`` that holds one, else the first list of the object, else an empty one."""
    if isinstance(value, dict):
        lists = [value[k] for k in keys if isinstance(value.get(k), list)] or [v for v in value.values() if isinstance(v, list)]
        return lists[0] if lists else []
    return value if isinstance(value, list) else None


def _whole(value: Any) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def index_entries(raw: str | None, keys: tuple[str, ...], fields: tuple[str, ...]) -> dict:
    """ok, dropped, invalid and keys (page and idx) of a payload of pages and indices. An entry that can't be used counts once,
    a bad index counts each; null or missing indices are no indices."""
    value, dropped = loads_tolerant(raw or "")
    entries = unwrapped(value, keys)
    if entries is None:
        return {"ok": False, "dropped": dropped, "invalid": 0, "keys": []}
    found, invalid = [], 0
    for e in entries:
        page = _whole(e.get("page")) if isinstance(e, dict) and "page" in e else None
        if page is None:
            invalid += 1
            continue
        indices = next((e[f] for f in fields if isinstance(e.get(f), list) and e[f]), [])
        for i in map(_whole, indices):
            if i is None or abs(i) >= 1 << 31 or abs(page) >= 1 << 31:
                invalid += 1
            else:
                found.append({"page": page, "idx": i})
    return {"ok": True, "dropped": dropped, "invalid": invalid, "keys": found}


def box_entries(raw: str | None) -> dict:
    """ok, dropped, invalid and boxes of a payload of pages and boxes; sizes of pages are looked at later."""
    value, dropped = loads_tolerant(raw or "")
    entries = unwrapped(value, BOX_KEYS)
    if entries is None:
        return {"ok": False, "dropped": dropped, "invalid": 0, "boxes": []}
    found, invalid = [], 0
    for seq, e in enumerate(entries):
        page = _whole(e.get("page")) if isinstance(e, dict) else None
        b = e.get("bbox") if isinstance(e, dict) else None
        try:
            x0, top, x1, bottom = (float(v) for v in b) if isinstance(b, list) and len(b) == 4 else ()
            confidence = float(e.get("confidence", 1.0) or 1.0)
        except (TypeError, ValueError):
            page = None
        if page is None or abs(page) >= 1 << 31:
            invalid += 1
            continue
        label = str(e.get("reason") or e.get("label") or "bbox")[:120]
        found.append({"seq": seq, "page": page, "x0": x0, "top": top, "x1": x1, "bottom": bottom, "confidence": confidence, "label": label})
    return {"ok": True, "dropped": dropped, "invalid": invalid, "boxes": found}


_INDEX = "ok boolean, dropped int, invalid int, keys array<struct<page:int,idx:int>>"
_BOX = "ok boolean, dropped int, invalid int, boxes array<struct<seq:int,page:int,x0:double,top:double,x1:double,bottom:double,confidence:double,label:string>>"


def read_index_payload(raw: Column, keys: tuple[str, ...], fields: tuple[str, ...]) -> Column:
    """index_entries() of each payload, in Arrow batches: a scan with a state, which no built-in function has."""

    @F.pandas_udf(f"struct<{_INDEX}>".replace(" boolean", ":boolean").replace(" int", ":int").replace(" array", ":array").replace(", ", ","))
    def read(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index_entries(r, keys, fields) for r in rows], columns=["ok", "dropped", "invalid", "keys"])

    return read(raw)


def read_box_payload(raw: Column) -> Column:
    @F.pandas_udf(f"struct<{_BOX}>".replace(" boolean", ":boolean").replace(" int", ":int").replace(" array", ":array").replace(", ", ","))
    def read(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([box_entries(r) for r in rows], columns=["ok", "dropped", "invalid", "boxes"])

    return read(raw)
