"""DuckDB SQL for the queries whose rows SQL can express."""

from __future__ import annotations

from evalmill.llm.licenses import TEMPLATES, template_table
from evalmill.llm.quality import RULES, STOP_WORDS, written
from evalmill.llm.secrets import ALLOWED, CANDIDATE, CLASSES

ORACLES: dict[str, str] = {}

SPACES = "[\\x20\\x09-\\x0D]"


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACES}+'), lambda w: w <> '')"


def quality_sql() -> str:
    checks = []
    for r in RULES:
        if r.least is not None:
            checks.append(f"coalesce({r.feature} < {r.least}, false)")
        if r.most is not None:
            checks.append(f"coalesce({r.feature} > {r.most}, false)")
    return f"""
with base as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as body, {WORDS} as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
counted as (
  select rid, doc_id, body, ws, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
         list_filter(ws, lambda w: list_contains({text_list(written(STOP_WORDS))}, w)) as known
  from base),
grams as (
  select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
  from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from counted where len(ws) >= 3)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from grams) where n > 1),
covered as (select rid, count(distinct i + d) as n from again, (values (0), (1), (2)) as t(d) group by rid),
feature as (
  select c.*, coalesce(v.n, 0)::bigint as n_repeat_words, word_chars / nullif(n_words, 0) as word_length, n_symbols / nullif(n_words, 0) as symbol_ratio,
         len(known) / nullif(n_words, 0) as stop_ratio, len(list_distinct(known)) as stop_kinds, n_dup_lines / nullif(n_lines, 0) as dup_line_ratio
  from counted c left join covered v using (rid)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from feature)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({' or '.join(checks)}) as kept
from failed
"""


def license_sql() -> str:
    rows = ", ".join(f"({i}, '{name}', {text_list(grams)})" for i, (name, grams) in enumerate(template_table(TEMPLATES)))
    return f"""
with templates(tid, license, grams) as (values {rows}),
docs as (select row_number() over () as rid, doc_id, lower(coalesce(text, '')) as body from documents),
segments as (
  select distinct rid, segment from (
    select rid, unnest(string_split(body, chr(10))) as segment from docs
    union all select rid, unnest(string_split_regex(body, '\\n[\\x20\\t\\r]*\\n')) from docs)),
listed as (select rid, list_filter(string_split_regex(segment, '[^a-z0-9]+'), lambda w: w <> '') as ws from segments),
pairs as (
  select rid, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as grams from listed where len(ws) > 1),
hits as (
  select rid, license, max(dice) as dice from (
    select rid, license, 2 * len(list_intersect(p.grams, t.grams)) / (len(p.grams) + len(t.grams)) as dice
    from pairs p join templates t on len(p.grams) between 1 and 400 and list_has_any(p.grams, t.grams))
  where dice >= 0.8 group by rid, license)
select d.doc_id, count(h.license)::bigint as n_licenses, coalesce(string_agg(h.license, ',' order by h.license), '') as licenses,
       round(max(h.dice), 6) as best_dice
from docs d left join hits h using (rid) group by d.rid, d.doc_id
"""


def spans_sql(name: str, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans by the lengths of the pieces between the matches."""
    p = pattern.replace("'", "''")
    return f"""
{name}_parts as (
  select rid, body, string_split_regex(body, '{p}') as gaps, regexp_extract_all(body, '{p}', 0) as hits, regexp_extract_all(body, '{p}', {group}) as held
  from docs where regexp_matches(body, '{p}')),
{name}_rows as (
  select rid, body, i, length(gaps[i]) as gap, length(hits[i]) as hit, length(held[i]) as size
  from (select *, unnest(range(1, len(hits) + 1)) as i from {name}_parts)),
{name} as (
  select rid, body, '{kind}' as kind, e - hit as s, e from (
    select *, (sum(gap + hit) over (partition by rid order by i))::bigint as e from {name}_rows) where size >= {least})"""


def secrets_sql() -> str:
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    quiet = " or ".join(f"regexp_matches(v, '{a}')" for a in ALLOWED)
    kinds = "case " + " ".join(f"when regexp_full_match(v, '{c.pattern}') then {i}" for i, c in enumerate(CLASSES)) + " end"
    classes = ", ".join(f"({i}, '{c.kind}', {c.window}, {c.bits})" for i, c in enumerate(CLASSES))
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from documents),
{spans_sql("assign", "assign", assign, 2, 6)},
{spans_sql("access", "access", "AKIA[A-Z0-9]+", 0, 20)},
{spans_sql("hexa", "hex", "[0-9a-f]+", 0, 24)},
{spans_sql("cand", "", CANDIDATE, 0, 20)},
base as (select rid, kind, s, e from assign union all select rid, kind, s, e from access union all select rid, kind, s, e from hexa),
classes(cid, kind, win, bits) as (values {classes}),
strings as (select rid, s, e, v, {kinds} as cid from (select rid, s, e, substring(body, s + 1, e - s) as v from cand) where not ({quiet})),
windows as (
  select t.rid, t.s, t.v, c.kind, c.win, c.bits, unnest(range(0, e - s - c.win + 1)) as place from strings t join classes c using (cid) where e - s >= c.win),
letters as (select *, substring(v, place + k + 1, 1) as x from (select *, unnest(range(0, win)) as k from windows)),
counts as (select rid, s, kind, win, bits, place, x, count(*) as n from letters group by all),
hot as (select rid, s, kind, win, place from counts group by rid, s, kind, win, bits, place having log2(win) - sum(n * log2(n)) / win >= bits - 1e-9),
added as (select rid, kind, s + min(place) as s, s + max(place) + win as e from hot group by rid, s, kind, win),
spans as (
  select * from base union all
  select * from added a where not exists (select 1 from base b where b.rid = a.rid and b.s < a.e and a.s < b.e)),
ranked as (select *, list_position(['assign', 'access', 'hex', 'entropy_hex', 'entropy'], kind) as r, kind || ':' || s || ':' || e as w from spans)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
       sha256(coalesce(string_agg(w, ',' order by s, r) filter (r <= 3), '')) as base_sha256,
       coalesce(string_agg(w, ',' order by s, r), '') as spans
from docs d left join ranked using (rid) group by d.rid, d.doc_id
"""


TOP_K = """
with held as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
  from held q join held c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""

NEAR = f"""
with recursive docs as (
  select row_number() over () as rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}+'), lambda w: w <> '') as ws
  from documents),
sets as (
  select rid, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
         else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as shingles from docs),
sized as (select rid, len(shingles) as n from sets),
each as materialized (select rid, md5(unnest(shingles)) as s from sets),
common as (select a.rid as a, b.rid as b, count(*) as c from each a join each b on a.s = b.s and a.rid < b.rid group by a.rid, b.rid),
links as materialized (
  select a, b from common join sized x on x.rid = a join sized y on y.rid = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(rid, other) as (select rid, rid from docs union select r.rid, l.b from reach r join both_ways l on l.a = r.other),
least as (select r.rid, min(d.doc_id) as component_id from reach r join docs d on d.rid = r.other group by r.rid)
select d.doc_id, s.n::bigint as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from docs d join sized s using (rid) join least l using (rid)
"""

ORACLES["op4_bayes_minhash"] = NEAR
ORACLES["op8_ball_tree_top_k"] = TOP_K
ORACLES["op9_quality_rules"] = quality_sql()
ORACLES["op6_license_dice"] = license_sql()
ORACLES["op7_entropy_secrets"] = secrets_sql()
