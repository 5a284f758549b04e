"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

_WORDS = r"""
toks as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') as t from documents),
flat as (select doc_id, unnest(t) as text, unnest(range(len(t)))::int as o from toks),
words as (select doc_id, (o // 200)::int as page, (o % 200)::int as idx, text, 36e0 + 54 * ((o % 200) % 10) as x0, 36e0 + 36 * ((o % 200) // 10) as top,
  36e0 + 54 * ((o % 200) % 10) + least(50, 5 * length(text)) as x1, 36e0 + 36 * ((o % 200) // 10) + 10 as bottom from flat),
sizes as (select distinct doc_id, page, 612e0 as width, 792e0 as height from words)"""

_SWEEP = r"""
terms as (
  select term_no, tokens, array_to_string(tokens, ' ') as label from (
    select unnest(range(6))::int as term_no, unnest([['of', 'the'], ['mit', 'license'], ['de', 'la'], ['the'], [''], ['$trb']]) as tokens)),
normal as (select doc_id, page, idx, lower(trim(text, '.,;:()[]{}"''`$')) as n from words),
lines as (select doc_id, page, list(n order by idx) as a from normal group by all),
hits as (
  select w.doc_id, w.page, w.idx, len(t.tokens)::int as k, t.label, t.term_no from normal w join terms t on w.n = t.tokens[1] join lines l on l.doc_id = w.doc_id and l.page = w.page
  where l.a[w.idx + 1 : w.idx + len(t.tokens)] = t.tokens),
word_marks as (select distinct doc_id, page, (idx + unnest(range(k)))::int as idx from hits)"""

_DETECTIONS = """
places as (select doc_id, page, 36e0 + 54 * ((doc_id + page) % 8) as ax, 36e0 + 36 * ((3 * doc_id + page) % 16) as ay, 54e0 * (1 + doc_id % 3) as aw, 36e0 * (1 + page % 3) as ah from sizes),
detections as (
  select doc_id, page, 'layout' as source, 0 as seq, ax as x0, ay as top, ax + aw as x1, ay + ah as bottom, 1e0 as conf, null::varchar as label from places
  union all select doc_id, page, 'layout', 1, 50e0, 50e0, 562e0, 742e0, 1e0, null from places where doc_id % 7 = 0
  union all select doc_id, page, 'vision', 0, 500e0, 10e0, 560e0, 30e0, 9e-1, 'brand logo' from places where (doc_id + page) % 3 <> 0
  union all select doc_id, page, 'vision', 1, ax + 6, ay + 6, ax + aw + 6, ay + ah + 6, 5e-1 + 1e-1 * (page % 4), case when page % 2 = 1 then 'logo' end from places)"""


def _strategy(box: str, width: str = "width", height: str = "height") -> str:
    return f"case when greatest({box}x1 - {box}x0, 0) * greatest({box}bottom - {box}top, 0) / ({width} * {height}) >= 0.35e0 or n_words >= 8 then 'page_split' else 'inline' end"


_REGIONS = f"""
numbered as (select *, case when source = 'layout' then seq else seq + 2 end as idx from detections),
counted as (
  select d.*, count(w.idx) as n_words from numbered d left join words w on w.doc_id = d.doc_id and w.page = d.page
    and (w.x0 + w.x1) / 2 between d.x0 and d.x1 and (w.top + w.bottom) / 2 between d.top and d.bottom group by all),
regions as (
  select doc_id, page, idx, case when label is not null or strategy = 'inline' then 'logo' else 'figure' end as kind, x0, top, x1, bottom, conf as confidence, label, strategy
  from (select c.*, {_strategy("")} as strategy from counted c join sizes using (doc_id, page))),
region_marks as (select doc_id, page, idx from regions where (doc_id + page + idx) % 2 = 0),
marked as (select r.* from regions r semi join region_marks m on r.doc_id = m.doc_id and r.page = m.page and r.idx = m.idx),
split as (select distinct doc_id, page from marked where strategy = 'page_split')"""

_VISIBLE = """
visible as (select w.* from words w anti join word_marks m on w.doc_id = m.doc_id and w.page = m.page and w.idx = m.idx)"""

_SUPPLEMENT = f"""{_VISIBLE},
occluded as (
  select w.* from visible w semi join marked r on w.doc_id = r.doc_id and w.page = r.page and w.x0 < r.x1 and w.x1 > r.x0 and w.top < r.bottom and w.bottom > r.top),
supplemental as (
  select distinct doc_id, page from marked
  where (doc_id, page) in (select doc_id, page from occluded union select doc_id, page from split) and (doc_id, page) in (select doc_id, page from visible))"""

_HISTORY = """
history as (
  select conv_id as run_id, turn + 1 as iteration, case when n % 7 = 0 then 'APPROVED' when n % 7 = 1 then 'APPROVED_WITH_ISSUES' else 'REVISE' end as verdict,
    (n % 5)::bigint as missed_count, (n % 3)::bigint as word_delta, 0::bigint as region_delta,
    (n % 2)::bigint as pii, (n % 3)::bigint as mnpi, (n % 4)::bigint as logo, (n % 5)::bigint as consistency, (n % 6)::bigint as structure, (n % 7)::bigint as other
  from (select *, length(coalesce(text, '')) as n from conversations)),
flags as (
  select *, coalesce(missed_count >= lag(missed_count) over (partition by run_id order by iteration) and word_delta + region_delta = 0, false) as s, word_delta + region_delta = 0 as z from history),
islands as (select *, sum((not s)::int) over (partition by run_id order by iteration) as gs, sum((not z)::int) over (partition by run_id order by iteration) as gz from flags),
streaks as (
  select * exclude (s, z, gs, gz), (sum(s::int) over (partition by run_id, gs order by iteration))::int as stall_streak, (sum(z::int) over (partition by run_id, gz order by iteration))::int as zero_streak
  from islands),
decisions as (
  select *, case when verdict like 'APPROVED%' and iteration >= 2 then 'approved' when verdict like 'APPROVED%' then 'forced' when stall_streak >= 2 and iteration >= 2 then 'stalled'
    when iteration >= 8 then 'limit' else 'feedback' end as decision from streaks)"""

_EVENTS = """
tool_events as (
  select user_id as run_id, event_id % 3 + 1 as iteration,
    case event_id % 4 when 0 then 'redact_all_matching_terms' when 1 then 'apply_redactions' when 2 then 'redact_visual_regions' else 'redact_bbox' end as tool,
    case when event_id % 4 < 2 then floor(value)::bigint else 0 end as words_added, case when event_id % 4 < 2 then 0 else floor(value)::bigint end as regions_added
  from events)"""

_SUMMARY = """
flagged as (
  select run_id, count(*) as iterations_run, sum(pii)::bigint as misses_pii, sum(mnpi)::bigint as misses_mnpi, sum(logo)::bigint as misses_logo, sum(consistency)::bigint as misses_consistency,
    sum(structure)::bigint as misses_structure, sum(other)::bigint as misses_other, arg_max(missed_count, iteration)::bigint as final_missed_count, arg_max(verdict, iteration) as final_verdict
  from history group by run_id),
credited as (
  select run_id, coalesce(sum(word_delta) filter (iteration = 1), 0)::bigint as proactive_words, coalesce(sum(region_delta) filter (iteration = 1), 0)::bigint as proactive_regions,
    coalesce(sum(word_delta) filter (iteration <> 1), 0)::bigint as reviewer_driven_words, coalesce(sum(region_delta) filter (iteration <> 1), 0)::bigint as reviewer_driven_regions
  from history group by run_id),
tooled as (
  select run_id, coalesce(sum(words_added) filter (tool = 'redact_all_matching_terms'), 0)::bigint as words_via_redact_all_matching_terms,
    coalesce(sum(words_added) filter (tool = 'apply_redactions'), 0)::bigint as words_via_apply_redactions,
    coalesce(sum(regions_added) filter (tool = 'redact_visual_regions'), 0)::bigint as regions_via_redact_visual_regions,
    coalesce(sum(regions_added) filter (tool = 'redact_bbox'), 0)::bigint as regions_via_redact_bbox
  from tool_events group by run_id)"""


def _iou(a: str, b: str) -> str:
    w = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    h = f"(least({a}.bottom, {b}.bottom) - greatest({a}.top, {b}.top))"
    area = lambda x: f"greatest({x}.x1 - {x}.x0, 0) * greatest({x}.bottom - {x}.top, 0)"
    return f"case when {w} <= 0 or {h} <= 0 then 0e0 else {w} * {h} / ({area(a)} + {area(b)} - {w} * {h}) end"


def _with(*parts: str) -> str:
    return "with recursive " + ",".join(parts) + "\n"


_TEXTS = "array_to_string(list(case when m.idx is not null then '[REDACTED]' else w.text end order by w.idx), ' ')"
_MARKED = "words w left join word_marks m on w.doc_id = m.doc_id and w.page = m.page and w.idx = m.idx"
_PII = {
    "Email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "IPAddress": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "CreditCardNumber": r"\b\d{13,19}\b",
    "PhoneNumber": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "USSocialSecurityNumber": r"\b\d{3}-\d{2}-\d{4}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "CurrencyAmount": r"[$€£] ?\d[\d,.]*(?: ?(?:million|billion|m|bn|k))?",
}
_CHUNKS = r"""
pieces as (
  select doc_id, start, chunk from (
    select doc_id, (5000 * unnest(range((length(text) + 4999) // 5000)))::int as start, text from (select doc_id, coalesce(text, '') as text from documents)) s,
    lateral (select substr(s.text, s.start + 1, 5000) as chunk) where regexp_replace(chunk, '\s+', '', 'g') <> '')"""

_FUSE = f"""
pages as (
  select doc_id, page, list({{'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom, 'conf': conf, 'label': label}} order by seq) filter (source = 'layout') as layout,
    list({{'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom, 'conf': conf, 'label': label}} order by seq) filter (source = 'vision') as vision
  from detections group by all),
fold as (
  select doc_id, page, 0 as i, coalesce(layout, []) as boxes, coalesce(vision, []) as vision from pages
  union all
  select doc_id, page, i + 1, case when place is null or place = 0 then list_append(boxes, v) else list_transform(boxes, lambda c, k: case when k = place then
      {{'x0': least(v.x0, c.x0), 'top': least(v.top, c.top), 'x1': greatest(v.x1, c.x1), 'bottom': greatest(v.bottom, c.bottom), 'conf': greatest(v.conf, c.conf), 'label': coalesce(v.label, c.label)}} else c end) end, vision
  from (select *, vision[i + 1] as v, list_position(list_transform(boxes, lambda c: ({_iou("vision[i + 1]", "c")}) >= 0.5e0), true) as place from fold where i < len(vision))),
fused as (
  select doc_id, page, (unnest(range(len(boxes))))::int as idx, unnest(boxes) as b from fold where i = len(vision))"""

_PROPAGATED = f"""
found_words as (
  select f.doc_id, f.page, f.idx, count(w.idx) as n_words from fused f left join words w on w.doc_id = f.doc_id and w.page = f.page
    and (w.x0 + w.x1) / 2 between f.b.x0 and f.b.x1 and (w.top + w.bottom) / 2 between f.b.top and f.b.bottom group by all),
found as (select f.doc_id, f.page, f.idx, f.b.x0 as x0, f.b.top as top, f.b.x1 as x1, f.b.bottom as bottom, f.b.conf as confidence, nullif(f.b.label, '') as label from fused f join found_words using (doc_id, page, idx)),
small as (select * from found join sizes using (doc_id, page) where greatest(x1 - x0, 0) * greatest(bottom - top, 0) / (width * height) <= 0.25e0),
marks as (select doc_id, list({{'page': page, 'idx': idx, 'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom, 'confidence': confidence, 'label': label}} order by page, idx) as marks from small group by doc_id),
placed as (
  select doc_id, 0 as i, marks, marks[1:0] as heads, []::bigint[] as clusters from marks
  union all
  select doc_id, i + 1, marks, case when place is null or place = 0 then list_append(heads, m) else heads end,
    list_append(clusters, case when place is null or place = 0 then len(heads) else place - 1 end)
  from (select *, marks[i + 1] as m, list_position(list_transform(heads, lambda h: ({_iou("marks[i + 1]", "h")}) >= 0.6e0), true) as place from placed where i < len(marks))),
clustered as (select doc_id, unnest(marks) as m, unnest(clusters) as cluster from placed where i = len(marks)),
stamps as (
  select doc_id, cluster, list(distinct m.page) as pages, avg(m.x0) as x0, avg(m.top) as top, avg(m.x1) as x1, avg(m.bottom) as bottom, min(m.confidence) as confidence,
    coalesce(arg_min(m.label, m.page * 100000 + m.idx) filter (m.label is not null), 'template-logo') as label
  from clustered group by all having count(distinct m.page) >= 3),
lacking as (
  select s.doc_id, z.page, s.cluster, s.x0, s.top, s.x1, s.bottom, s.confidence, s.label from stamps s join sizes z on z.doc_id = s.doc_id and not list_contains(s.pages, z.page)
  where not exists (select 1 from found f where f.doc_id = s.doc_id and f.page = z.page and ({_iou("s", "f")}) >= 0.6e0)),
stamped as (
  select l.doc_id, l.page, (coalesce((select max(f.idx) + 1 from found f where f.doc_id = l.doc_id and f.page = l.page), 0) + row_number() over (partition by l.doc_id, l.page order by l.cluster) - 1)::int as idx,
    l.x0, l.top, l.x1, l.bottom, l.confidence, l.label from lacking l),
stamped_words as (
  select s.doc_id, s.page, s.idx, s.x0, s.top, s.x1, s.bottom, s.confidence, s.label, count(w.idx) as n_words from stamped s left join words w on w.doc_id = s.doc_id and w.page = s.page
    and (w.x0 + w.x1) / 2 between s.x0 and s.x1 and (w.top + w.bottom) / 2 between s.top and s.bottom group by all)"""

_ANSWERS = """
answers as (
  select conv_id || '-' || turn as doc_id, case when n % 2 = 0 then 'APPROVED' else 'REVISE' end as verdict, 'again' as feedback, (n % 9)::int as page
  from (select conv_id, turn, length(coalesce(text, '')) as n from conversations))"""

_TERM_LISTS = r"""
firsts as (
  select doc_id, regexp_extract(coalesce(text, ''), '^(?:\S+\s+){0}(\S+)', 1) as a, regexp_extract(coalesce(text, ''), '^(?:\S+\s+){1}(\S+)', 1) as b,
    regexp_extract(coalesce(text, ''), '^(?:\S+\s+){2}(\S+)', 1) as c from documents),
listed as (select doc_id, unnest(range(7))::int as pos, trim(unnest([a, '  The ', lower(a), '', b, 'Logo', c])) as term from firsts),
identity as (select doc_id, pos, term from (select *, row_number() over (partition by doc_id, lower(term) order by pos) as n from listed where term <> '') where n = 1)"""

ORACLES: dict[str, str] = {
    "words_scan": _with(_WORDS) + "select * from words",
    "page_sizes": _with(_WORDS) + "select * from sizes",
    "text_layer_gate": _with(_WORDS) + "select doc_id, median(bottom - top) as median_height, median(bottom - top) >= 3 as usable from words group by doc_id",
    "degenerate_layout": _with(_WORDS) + "select doc_id, page, count(*) as n_words, count(distinct round_even(top, 0)) as n_rows, count(*) / greatest(1, count(distinct round_even(top, 0))) > 25 as degenerate from words group by all",
    "term_sweep_counts": _with(_WORDS, _SWEEP) + "select doc_id, label, count(*) as matches from hits group by all",
    "term_sweep_marks": _with(_WORDS, _SWEEP) + "select * from word_marks",
    "words_listing": _with(_WORDS, _SWEEP) + f"select w.doc_id, w.page, string_agg(w.idx || ':' || w.text || ':' || (m.idx is not null)::varchar, ' ' order by w.idx) as listing from {_MARKED} group by all",
    "visible_words": _with(_WORDS, _SWEEP, _VISIBLE) + "select doc_id, page, idx, text from visible",
    "redacted_text_view": _with(_WORDS, _SWEEP)
    + f"select doc_id, substr(string_agg(e'\\n--- Page ' || (page + 1) || e' ---\\n ' || t, e' \\n ' order by page), 1, 60000) as text from (select w.doc_id, w.page, {_TEXTS} as t from {_MARKED} group by all) group by doc_id",
    "redacted_documents": _with(_WORDS, _SWEEP)
    + f"select doc_id, string_agg(e'\\n--- Page ' || (page + 1) || e' ---\\n ' || t, e' \\n ' order by page) as text from (select w.doc_id, w.page, {_TEXTS} as t from {_MARKED} group by all) group by doc_id",
    "span_apply": _with(_WORDS)
    + """, wanted as (
  select doc_id, unnest([0, 0, 0, 0, 1])::int as page, unnest([0, (doc_id % 5)::int, 4, 99999, 0])::int as idx, 3 as bad from documents where doc_id % 10 <> 0
  union all select doc_id, 0, unnest([0, 1])::int, 0 from documents where doc_id % 10 = 0)
select v.doc_id, count(distinct case when w.idx is not null then v.page * 1000000 + v.idx end)::bigint as added, (any_value(bad) + count(*) filter (w.idx is null))::bigint as invalid
from wanted v left join words w on w.doc_id = v.doc_id and w.page = v.page and w.idx = v.idx group by v.doc_id""",
    "region_strategy": _with(_WORDS, _DETECTIONS, _REGIONS) + "select * from regions",
    "region_listing": _with(_WORDS, _DETECTIONS, _REGIONS)
    + "select r.doc_id, r.page, string_agg(r.idx || ':' || r.kind || ':' || r.strategy || ':' || (m.idx is not null)::varchar, ' ' order by r.idx) as listing from regions r left join region_marks m on r.doc_id = m.doc_id and r.page = m.page and r.idx = m.idx group by all",
    "region_span_apply": _with(_WORDS, _DETECTIONS, _REGIONS)
    + """, wanted as (select doc_id, unnest([0, 0, 1, 1])::int as page, unnest([0, 7, 1, 3])::int as idx from documents)
select v.doc_id, (count(r.idx))::bigint as added, (1 + count(*) filter (r.idx is null))::bigint as invalid, (count(distinct case when r.strategy = 'page_split' then r.page end))::bigint as split_pages
from wanted v left join regions r on r.doc_id = v.doc_id and r.page = v.page and r.idx = v.idx group by v.doc_id""",
    "bbox_inflate": _with(_WORDS, _DETECTIONS, _REGIONS)
    + """, boxes as (
  select doc_id, 0 as page, unnest([0, 1]) as seq, unnest([(doc_id % 50)::double, 580e0]) as x0, unnest([2e0, 700e0]) as top, unnest([300e0, 611e0]) as x1, unnest([40e0, 790.5e0]) as bottom, unnest(['logo', 'bbox']) as label from documents),
nexts as (select doc_id, page, max(idx) as m, count(*) as c, list(idx order by idx) as l from regions group by all)
select b.doc_id, b.page, (coalesce((select max(l[j] - j) + len(l) + 1 from (select unnest(range(1, len(n.l) + 1)) as j)), 0) + b.seq)::int as idx, greatest(0, b.x0 - 5) as x0, greatest(0, b.top - 5) as top, least(612e0, b.x1 + 5) as x1, least(792e0, b.bottom + 5) as bottom, b.label
from boxes b join sizes s on s.doc_id = b.doc_id and s.page = b.page left join nexts n on n.doc_id = b.doc_id and n.page = b.page""",
    "detection_fusion": _with(_WORDS, _DETECTIONS, _FUSE) + "select doc_id, page, idx, b.x0, b.top, b.x1, b.bottom, b.conf, b.label from fused",
    "template_propagation": _with(_WORDS, _DETECTIONS, _FUSE, _PROPAGATED)
    + f"select doc_id, page, idx, 'logo' as kind, x0, top, x1, bottom, confidence, label, {_strategy('')} as strategy from stamped_words join sizes using (doc_id, page)",
    "region_summary": _with(_WORDS, _DETECTIONS, _REGIONS)
    + "select doc_id, count(*) as regions, count(distinct page) as pages, count(*) filter (strategy = 'inline') as inline, count(*) filter (strategy = 'page_split') as page_split from regions group by doc_id",
    "verdict_entries": _with(_ANSWERS) + "select doc_id, verdict, feedback, page, 'logo' as type, 4 as corners from answers",
    "feedback_payload": _with(_ANSWERS)
    + r"""select doc_id, case when verdict = 'APPROVED'
  then '{"missed":"[]","feedback":"Approved, but the least number of passes isn''t reached: scan once more under the custom rules, borderline names, addresses and identifiers above all."}'
  else '{"missed":"[{\"bbox\":[1,2,3,4.5],\"page\":' || page || ',\"type\":\"logo\"}]","feedback":"again"}' end as feedback_json from answers""",
    "draw_list": _with(_WORDS, _SWEEP, _DETECTIONS, _REGIONS, _SUPPLEMENT)
    + """, chosen as (
  select w.doc_id, w.page, 0 as z, w.idx, w.x0, w.top, w.x1, w.bottom from words w semi join word_marks m on w.doc_id = m.doc_id and w.page = m.page and w.idx = m.idx
  union all select doc_id, page, 1, idx, x0, top, x1, bottom from marked),
dense as (select doc_id, page, count(*) / greatest(1, count(distinct round_even(top, 0))) > 25 as degenerate from visible semi join supplemental using (doc_id, page) group by all),
scales as (select 200e0 / 72e0 as k, greatest(1, floor(22 * (200e0 / 72e0)))::int as banner)
select doc_id, page, 0 as layer, 'rect' as op, z, idx, (x0 - 1) * k as x0, (top - 1) * k as y0, (x1 + 1) * k as x1, (bottom + 1) * k as y1, null::int as font, null::varchar as text from chosen, scales
union all select doc_id, page, 1, 'rect', 2, 0, 0e0, 0e0, greatest(1, floor(width * k))::double, banner::double, null, null from supplemental join sizes using (doc_id, page), scales
union all select doc_id, page, 1, 'text', 3, 0, floor(6 * k), floor(banner * 0.22e0), null, null, greatest(6, floor(banner * 0.55e0))::int, 'SUPPLEMENTAL - non-redacted text from page ' || (page + 1) from supplemental join sizes using (doc_id, page), scales
union all select v.doc_id, v.page, 1, case when d.degenerate then 'flow' else 'text' end, 4, v.idx, v.x0 * k, banner + v.top * k * ((greatest(1e0, height * k) - banner) / greatest(1e0, height * k)), null, null,
  greatest(6, floor(greatest(1e0, v.bottom - v.top) * k * 0.95e0 * ((greatest(1e0, height * k) - banner) / greatest(1e0, height * k))))::int, v.text
from visible v join dense d on d.doc_id = v.doc_id and d.page = v.page join sizes s on s.doc_id = v.doc_id and s.page = v.page, scales""",
    "detection_sources": _with(_WORDS, _DETECTIONS) + "select source, count(*) as n from detections group by source",
    "occluded_words": _with(_WORDS, _SWEEP, _DETECTIONS, _REGIONS, _SUPPLEMENT) + "select doc_id, page, idx from occluded",
    "supplemental_pages": _with(_WORDS, _SWEEP, _DETECTIONS, _REGIONS, _SUPPLEMENT) + "select * from supplemental",
    "page_map": _with(_WORDS, _SWEEP, _DETECTIONS, _REGIONS, _SUPPLEMENT)
    + """, shifted as (
  select z.doc_id, z.page, s.page is not null as sup, (z.page + coalesce(sum((s.page is not null)::int) over (partition by z.doc_id order by z.page rows between unbounded preceding and 1 preceding), 0))::int as rendered
  from sizes z left join supplemental s on s.doc_id = z.doc_id and s.page = z.page)
select doc_id, rendered as rendered_page, page as source_page from shifted union all select doc_id, rendered + 1, null from shifted where sup""",
    "overlay_rects": _with(_WORDS, _SWEEP, _DETECTIONS, _REGIONS)
    + """, chosen as (
  select w.doc_id, w.page, 0 as z, w.idx, w.x0, w.top, w.x1, w.bottom from words w semi join word_marks m on w.doc_id = m.doc_id and w.page = m.page and w.idx = m.idx
  union all select doc_id, page, 1, idx, x0, top, x1, bottom from marked)
select doc_id, page, z, idx, (x0 - 1) * (200e0 / 72e0) as x0, (top - 1) * (200e0 / 72e0) as y0, (x1 + 1) * (200e0 / 72e0) as x1, (bottom + 1) * (200e0 / 72e0) as y1 from chosen""",
    "finding_filter": _with(_WORDS, _SWEEP, _DETECTIONS, _REGIONS, _TERM_LISTS)
    + f""", findings as (select doc_id, page || '-' || source || '-' || seq as fid, page, x0, top, x1, bottom, label from detections),
lists as (select doc_id, list(lower(term)) as terms from identity group by doc_id),
covered as (select distinct f.doc_id, f.fid from findings f join marked r on r.doc_id = f.doc_id and r.page = f.page where ({_iou("f", "r")}) >= 0.4e0),
inside as (
  select f.doc_id, f.fid, lower(string_agg(w.text, ' ' order by w.idx)) as t from findings f join words w on w.doc_id = f.doc_id and w.page = f.page
    and (w.x0 + w.x1) / 2 between f.x0 and f.x1 and (w.top + w.bottom) / 2 between f.top and f.bottom group by all)
select f.doc_id, f.fid, case when c.fid is not null then 'dedupe' when f.label is not null and len(list_filter(l.terms, lambda t: contains(lower(f.label), t))) > 0 then 'label'
  when i.t is not null and len(list_filter(l.terms, lambda t: contains(i.t, t))) > 0 then 'text' else 'kept' end as outcome
from findings f left join covered c on c.doc_id = f.doc_id and c.fid = f.fid left join inside i on i.doc_id = f.doc_id and i.fid = f.fid left join lists l on l.doc_id = f.doc_id""",
    "finding_review": _with(_WORDS, _SWEEP, _DETECTIONS, _REGIONS, _SUPPLEMENT, _TERM_LISTS)
    + f""", shifted as (
  select z.doc_id, z.page, s.page is not null as sup, (z.page + (select count(*) from supplemental p where p.doc_id = z.doc_id and p.page < z.page))::int as rendered
  from sizes z left join supplemental s on s.doc_id = z.doc_id and s.page = z.page),
rendered_pages as (select doc_id, rendered, page from shifted union all select doc_id, rendered + 1, null from shifted where sup),
findings as (
  select d.doc_id, d.page || '-' || source || '-' || seq as fid, coalesce(m.page, d.page) as page, x0, top, x1, bottom, label
  from detections d left join rendered_pages m on m.doc_id = d.doc_id and m.rendered = d.page where m.rendered is null or m.page is not null),
lists as (select doc_id, list(lower(term)) as terms from identity group by doc_id),
covered as (select distinct f.doc_id, f.fid from findings f join marked r on r.doc_id = f.doc_id and r.page = f.page where ({_iou("f", "r")}) >= 0.4e0),
inside as (
  select f.doc_id, f.fid, lower(string_agg(w.text, ' ' order by w.idx)) as t from findings f join words w on w.doc_id = f.doc_id and w.page = f.page
    and (w.x0 + w.x1) / 2 between f.x0 and f.x1 and (w.top + w.bottom) / 2 between f.top and f.bottom group by all)
select f.doc_id, f.fid, case when c.fid is not null then 'dedupe' when f.label is not null and len(list_filter(l.terms, lambda t: contains(lower(f.label), t))) > 0 then 'label'
  when i.t is not null and len(list_filter(l.terms, lambda t: contains(i.t, t))) > 0 then 'text' else 'kept' end as outcome
from findings f left join covered c on c.doc_id = f.doc_id and c.fid = f.fid left join inside i on i.doc_id = f.doc_id and i.fid = f.fid left join lists l on l.doc_id = f.doc_id""",
    "identity_terms": _with(_TERM_LISTS) + "select * from identity",
    "evidence_text": _with(_WORDS)
    + r""", total as (select doc_id, count(*) as n from sizes group by doc_id),
texts as (select w.doc_id, w.page, string_agg(w.text, ' ' order by w.idx) as t from words w join total using (doc_id) where w.page < 2 or w.page >= n - 1 group by all),
joined as (select doc_id, string_agg('[Page ' || (page + 1) || e']\n' || t, e'\n\n' order by page) as e from texts group by doc_id)
select doc_id, case when length(e) > 8000 then substr(e, 1, 8000) || e'\n... [truncated]' else e end as evidence from joined""",
    "text_chunks": _with(_CHUNKS) + "select doc_id, start, chunk from pieces",
    "pii_rule_entities": _with(_CHUNKS) + " union all ".join(f"select doc_id, start, '{c}' as category, unnest(regexp_extract_all(chunk, '{r}')) as text from pieces" for c, r in _PII.items()),
    "miss_buckets": """
with m as (select user_id as run_id, case event_type when 'purchase' then 'PII' when 'view' then 'MNPI' when 'click' then 'Logo' when 'signup' then 'Structure' else 'Other' end as t from events)
select run_id, count(*) filter (t = 'PII') as pii, count(*) filter (t = 'MNPI') as mnpi, count(*) filter (t = 'Logo') as logo, 0::bigint as consistency,
  count(*) filter (t = 'Structure') as structure, count(*) filter (t = 'Other') as other from m group by run_id""",
    "tool_counters": _with(_EVENTS) + "select run_id, tool, count(*) as calls, sum(words_added)::bigint as words_added, sum(regions_added)::bigint as regions_added from tool_events group by all",
    "counter_difference": _with(_EVENTS)
    + """, a as (select run_id, tool, count(*) as c, sum(words_added) as w, sum(regions_added) as r from tool_events group by all),
b as (select run_id, tool, count(*) as c, sum(words_added) as w, sum(regions_added) as r from tool_events where iteration < 3 group by all)
select run_id, tool, (a.c - coalesce(b.c, 0))::bigint as calls, (a.w - coalesce(b.w, 0))::bigint as words_added, (a.r - coalesce(b.r, 0))::bigint as regions_added
from a left join b using (run_id, tool) where a.c <> coalesce(b.c, 0) or a.w <> coalesce(b.w, 0) or a.r <> coalesce(b.r, 0)""",
    "history_deltas": _with(_HISTORY)
    + "select run_id, iteration, (sum(word_delta) over w)::bigint as words_total, (sum(region_delta) over w)::bigint as regions_total, word_delta, region_delta from history window w as (partition by run_id order by iteration)",
    "stall_streak": _with(_HISTORY) + "select run_id, iteration, stall_streak, zero_streak from streaks",
    "loop_decisions": _with(_HISTORY) + "select run_id, iteration, decision from decisions",
    "loop_exit": _with(_HISTORY) + "select run_id, min(iteration) as iteration, arg_min(decision, iteration) as decision from decisions where decision in ('approved', 'stalled', 'limit') group by run_id",
    "attribution": _with(_HISTORY, _EVENTS, _SUMMARY) + "select * from credited",
    "words_and_regions_by_tool": _with(_HISTORY, _EVENTS, _SUMMARY) + "select * from tooled",
    "run_summary": _with(_HISTORY, _EVENTS, _SUMMARY)
    + """select f.run_id, f.iterations_run, f.final_verdict, f.final_missed_count, (misses_pii + misses_mnpi + misses_logo + misses_consistency + misses_structure + misses_other)::bigint as total_misses_flagged,
  misses_pii, misses_mnpi, misses_logo, misses_consistency, misses_structure, misses_other, c.* exclude (run_id),
  coalesce(words_via_redact_all_matching_terms, 0) as words_via_redact_all_matching_terms, coalesce(words_via_apply_redactions, 0) as words_via_apply_redactions,
  coalesce(regions_via_redact_visual_regions, 0) as regions_via_redact_visual_regions, coalesce(regions_via_redact_bbox, 0) as regions_via_redact_bbox,
  '2024-01-02T03:04:05' as timestamp, 12.35e0 as duration_seconds, 'in.pdf' as input_pdf
from flagged f join credited c using (run_id) left join tooled t using (run_id)""",
    "run_metrics": _with(_HISTORY)
    + """select run_id, '/data/in.pdf' as input_pdf, case when run_id % 3 = 0 then '0,3' when run_id % 3 = 1 then '1,3' else '2,3' end as split_pages,
  arg_max(pii, iteration) as last_pii, arg_max(mnpi, iteration) as last_mnpi, arg_max(logo, iteration) as last_logo, arg_max(consistency, iteration) as last_consistency,
  arg_max(structure, iteration) as last_structure, arg_max(other, iteration) as last_other, count(*) as iterations, sum(pii + mnpi + logo + consistency + structure + other)::bigint as flagged
from history group by run_id""",
}
