"""SQL of queries that fold the rows of a key in their order: a list reduced by a lambda whose state is a struct.

Every fold ends in a list of what it gave out, which is unnested again."""

from __future__ import annotations

from ..operators.stateful import EDGES
from .stream_queries import R


def fold(keys: str, rows: str, order: str, start: str, step: str, source: str = "r", out: str = "z.o") -> str:
    """y(keys, o): for each key the list that the fold of its rows (a struct r each) gives; `a` is the state, its member o the output."""
    return f"l AS (SELECT {keys}, list({rows} ORDER BY {order}) AS l FROM {source} GROUP BY ALL), f AS (SELECT * EXCLUDE (l), list_reduce(l, lambda a, r: {step}, {start}) AS z FROM l), y AS (SELECT * EXCLUDE (z), unnest({out}) AS o FROM f)"


_T = "struct_pack(s := seq, t := epoch_us(ts))"
DAY = 86_400_000_000

COOLDOWN = f"WITH {R}, " + fold(
    "source, scope", _T, "seq", "struct_pack(at := NULL::BIGINT, o := []::BIGINT[])",
    f"CASE WHEN a.at IS NULL OR r.t >= a.at + {DAY} THEN struct_pack(at := r.t, o := list_append(a.o, r.s)) ELSE a END",
) + " SELECT o AS seq FROM y"

_SEEN = "STRUCT(seq BIGINT, duplicate BOOLEAN)[]"
EVENT_DEDUP = f"WITH {R}, " + fold(
    "sig", _T, "seq", f"struct_pack(at := NULL::BIGINT, o := []::{_SEEN})",
    f"CASE WHEN a.at IS NULL OR r.t >= a.at + {DAY} THEN struct_pack(at := r.t, o := list_append(a.o, struct_pack(seq := r.s, duplicate := false))) ELSE struct_pack(at := a.at, o := list_append(a.o, struct_pack(seq := r.s, duplicate := true))) END",
) + " SELECT o.seq, o.duplicate FROM y"

_BLOCK = "struct_pack(s := a.s, t := a.t, e := a.e, n := a.n)"
FOLD_WINDOWS = f"WITH {R}, " + fold(
    "sig", _T, "seq", "struct_pack(s := NULL::BIGINT, t := NULL::BIGINT, e := NULL::BIGINT, n := 0::BIGINT, o := []::STRUCT(s BIGINT, t BIGINT, e BIGINT, n BIGINT)[])",
    f"CASE WHEN a.s IS NULL THEN struct_pack(s := r.s, t := r.t, e := r.t, n := 1::BIGINT, o := a.o) WHEN r.t >= a.t + {6 * 3_600_000_000} THEN struct_pack(s := r.s, t := r.t, e := r.t, n := 1::BIGINT, o := list_append(a.o, {_BLOCK})) ELSE struct_pack(s := a.s, t := a.t, e := r.t, n := a.n + 1, o := a.o) END",
    out="list_append(z.o, struct_pack(s := z.s, t := z.t, e := z.e, n := z.n))",
) + " SELECT sig, o.s AS first_seq, make_timestamp(o.t) AS first_ts, make_timestamp(o.e) AS last_ts, o.n FROM y"

_LEVEL = "least(2.0::DOUBLE, a.level + CASE WHEN a.at IS NULL THEN 0 ELSE (r.t - a.at) / 1e6 * 0.001 / 60 END)"
TOKEN_BUCKET = f"WITH {R}, " + fold(
    "scope", _T, "seq", "struct_pack(level := 2.0::DOUBLE, at := NULL::BIGINT, o := []::STRUCT(seq BIGINT, admitted BOOLEAN)[])",
    f"CASE WHEN {_LEVEL} >= 1 THEN struct_pack(level := {_LEVEL} - 1, at := r.t, o := list_append(a.o, struct_pack(seq := r.s, admitted := true))) ELSE struct_pack(level := {_LEVEL}, at := r.t, o := list_append(a.o, struct_pack(seq := r.s, admitted := false))) END",
) + " SELECT scope, o.seq, o.admitted FROM y"

_MADE = "len(list_filter(a.made, lambda x: x > r.t - {}))"
_VIOLATED = f"CASE WHEN {_MADE.format(DAY)} >= 2 THEN 'day' WHEN {_MADE.format(7 * DAY)} >= 8 THEN 'week' END"
CREATE_CAPS = f"WITH {R}, " + fold(
    "scope", _T, "seq", "struct_pack(made := []::BIGINT[], o := []::STRUCT(seq BIGINT, violated VARCHAR)[])",
    f"struct_pack(made := CASE WHEN {_VIOLATED} IS NULL THEN list_append(a.made, r.t) ELSE a.made END, o := list_append(a.o, struct_pack(seq := r.s, violated := {_VIOLATED})))",
) + " SELECT scope, o.seq, o.violated IS NULL AS created, o.violated FROM y"

# cap 2 a minute, 120 s, waits of 600 s doubled up to 7200 s; a probe's verdict follows at once, so a circuit is closed or open
_RATE = "len(list_filter(a.seen, lambda x: x > r.t - 60000000))"
_BEFORE = "len(list_filter(a.seen, lambda x: x > r.t - 60000000 AND x < r.t))"
_NEXT = "struct_pack(until := {until}, pressed := {pressed}, doublings := {doublings}, trips := {trips}, seen := list_append(a.seen, r.t), o := list_append(a.o, struct_pack(seq := r.s, allowed := {allowed}, probe := {probe}, state := '{state}', trips := {trips})))"


def _move(allowed: str, probe: str, state: str, until: str = "NULL::BIGINT", pressed: str = "NULL::BIGINT", doublings: str = "a.doublings", trips: str = "a.trips") -> str:
    return _NEXT.format(until=until, pressed=pressed, doublings=doublings, trips=trips, allowed=allowed, probe=probe, state=state)


_TRIP = {"until": "(r.t + least(600.0 * power(2, greatest(a.doublings + 1, 0)), 7200.0)::BIGINT * 1000000)::BIGINT", "doublings": "a.doublings + 1", "trips": "a.trips + 1"}
#: A rush: a record every seven seconds, so that breakers trip, probe and close.
BREAKER = f"WITH {R}, x AS (SELECT source, seq, make_timestamp(seq * 7000000) AS ts FROM r), " + fold(
    "source", _T, "seq", "struct_pack(until := NULL::BIGINT, pressed := NULL::BIGINT, doublings := -1::INTEGER, trips := 0::INTEGER, seen := []::BIGINT[], o := []::STRUCT(seq BIGINT, allowed BOOLEAN, probe BOOLEAN, state VARCHAR, trips INTEGER)[])",
    f"CASE WHEN a.until IS NOT NULL AND r.t < a.until THEN {_move('false', 'false', 'open', until='a.until')} WHEN a.until IS NOT NULL AND {_BEFORE} >= 2 THEN {_move('true', 'true', 'open', **_TRIP)} WHEN a.until IS NOT NULL THEN {_move('true', 'true', 'closed', doublings='0')} "
    f"WHEN {_RATE} < 2 THEN {_move('true', 'false', 'closed')} WHEN r.t - coalesce(a.pressed, r.t) >= 120000000 THEN {_move('false', 'false', 'open', **_TRIP)} ELSE {_move('false', 'false', 'closed', pressed='coalesce(a.pressed, r.t)')} END",
    source="x",
) + " SELECT source, o.seq, o.allowed, o.probe, o.state, o.trips FROM y"

_LOWEST: dict[str, tuple[str, str]] = {}
for _edge, _from, _to, _trigger in EDGES:
    for _state in _from.split():
        _LOWEST.setdefault(f"{_state}|{_trigger}", (_edge, _to))
_MAP = "MAP {" + ", ".join(f"'{k}': '{e}|{t}'" for k, (e, t) in _LOWEST.items()) + "}"
_HIT = f"({_MAP})[a.state || '|' || r.trigger]"
_OUT = "list_append(a.o, struct_pack(seq := r.s, edge := {}, f := a.state, t := {}, refused := {}))"
_TRIGGERS = "[" + ", ".join(f"'{e[3]}'" for e in EDGES) + "]"
TRANSITIONS = f"WITH {R}, x AS (SELECT 'inc_' || scope AS inc, seq, {_TRIGGERS}[k % {len(EDGES)} + 1] AS trigger FROM r), " + fold(
    "inc", "struct_pack(s := seq, trigger := trigger)", "seq", "struct_pack(state := 'detected'::VARCHAR, illegal := 0::INTEGER, o := []::STRUCT(seq BIGINT, edge VARCHAR, f VARCHAR, t VARCHAR, refused BOOLEAN)[])",
    f"CASE WHEN {_HIT} IS NOT NULL THEN struct_pack(state := split_part({_HIT}, '|', 2), illegal := a.illegal, o := {_OUT.format(f"split_part({_HIT}, '|', 1)", f"split_part({_HIT}, '|', 2)", 'false')}) "
    f"WHEN a.illegal >= 2 AND a.state <> 'quarantined' THEN struct_pack(state := 'quarantined', illegal := a.illegal + 1, o := {_OUT.format("'T47'", "'quarantined'", 'true')}) ELSE struct_pack(state := a.state, illegal := a.illegal + 1, o := {_OUT.format('NULL', 'a.state', 'true')}) END",
    source="x",
) + " SELECT inc, o.seq, o.edge, o.f AS from_state, o.t AS to_state, o.refused FROM y"

# one live incident a key, reopened within a day of its resolution
_STRUCT = "STRUCT(seq BIGINT, outcome VARCHAR, incident VARCHAR, n BIGINT)[]"


def _desk(outcome: str, **change: str) -> str:
    now = {"seen": "CASE WHEN r.resolves THEN a.seen ELSE list_append(a.seen, r.id) END", "state": "a.state", "number": "a.number", "sigs": "a.sigs", "resolved": "a.resolved", "n": "a.n"} | change
    given = f"struct_pack(seq := r.s, outcome := {outcome}, incident := CASE WHEN {now['number']} > 0 THEN r.key || '/' || ({now['number']}) END, n := {now['n']})"
    return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in now.items()) + f", o := list_append(a.o, {given}))"


ADMISSION = f"WITH {R}, x AS (SELECT 'k' || (scope % 20) AS key, seq, ts, (seq % 700)::VARCHAR AS id, sig, source = 'view' AS suppressed, source = 'signup' AND k % 5 = 0 AS resolves FROM r), " + fold(
    "key", "struct_pack(key := key, s := seq, t := epoch_us(ts), id := id, sig := sig, suppressed := suppressed, resolves := resolves)", "seq",
    f"struct_pack(seen := []::VARCHAR[], state := ''::VARCHAR, number := 0::INTEGER, sigs := []::VARCHAR[], resolved := NULL::BIGINT, n := 0::BIGINT, o := []::{_STRUCT})",
    f"CASE WHEN r.resolves AND a.state = 'open' THEN {_desk("'resolved'", state="'resolved'", resolved='r.t')} WHEN r.resolves THEN {_desk("'resolved'")} WHEN list_contains(a.seen, r.id) THEN {_desk("'duplicate'")} WHEN r.suppressed THEN {_desk("'suppressed'")} "
    f"WHEN a.state = 'open' THEN {_desk("CASE WHEN list_contains(a.sigs, r.sig) THEN 'folded' ELSE 'merged' END", sigs='list_append(a.sigs, r.sig)', n='a.n + 1')} "
    f"WHEN a.state = 'resolved' AND r.t - a.resolved <= {DAY} THEN {_desk("'reopened'", state="'open'", n='a.n + 1', sigs='list_append(a.sigs, r.sig)')} ELSE {_desk("'created'", state="'open'", number='a.number + 1', n='1::BIGINT', sigs='[r.sig]')} END",
    source="x",
) + " SELECT key, o.seq, o.outcome, o.incident, o.n FROM y"

#: Blocks of lines: a line that neither begins nor goes on ends a block; sizes stay below the limit here.
LOG_BLOCKS = """
WITH x AS (SELECT doc_id::VARCHAR AS source, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
m AS (SELECT *, regexp_matches(text, '^[A-Z]') AS begins, regexp_matches(text, '^[a-z]|^$') AS goes_on FROM x),
b AS (SELECT *, sum(CASE WHEN begins OR NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS block FROM m)
SELECT source, min(line_no) AS first_line, count(*) AS lines, string_agg(text, chr(10) ORDER BY line_no) AS text FROM b GROUP BY source, block HAVING arg_min(begins, line_no)
"""

JITTER = "SELECT s_suppkey, 60000000000 + 3000000 * (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode(s_name))), lambda i: ('0x' || substr(hex(encode(s_name)), 2 * i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 41 - 20) AS interval_ns FROM supplier"

_OUTCOME = "STRUCT(seq BIGINT, outcome VARCHAR)[]"


def _said(outcome: str) -> str:
    return f"o := list_append(a.o, struct_pack(seq := r.s, outcome := {outcome}))"


#: x: inc, seq, ts
LEASES = fold(
    "inc", _T, "seq", f"struct_pack(until := NULL::BIGINT, o := []::{_OUTCOME})",
    f"CASE WHEN a.until IS NOT NULL AND r.t < a.until THEN struct_pack(until := a.until, {_said("'refused'")}) ELSE struct_pack(until := r.t + {DAY}, {_said("'acquired'")}) END", source="x",
)
#: x: key, seq, ts, move
GATE = fold(
    "key", "struct_pack(s := seq, t := epoch_us(ts), m := move)", "seq", f"struct_pack(until := NULL::BIGINT, done := false, o := []::{_OUTCOME})",
    f"CASE WHEN r.m = 'claim' AND a.until IS NOT NULL AND r.t < a.until THEN struct_pack(until := a.until, done := a.done, {_said("'duplicate'")}) WHEN r.m = 'claim' THEN struct_pack(until := r.t + {DAY}, done := false, {_said("'claimed'")}) "
    f"WHEN a.until IS NULL OR r.t >= a.until OR a.done THEN struct_pack(until := a.until, done := a.done, {_said("'ignored'")}) WHEN r.m = 'commit' THEN struct_pack(until := r.t + {DAY}, done := true, {_said("'committed'")}) ELSE struct_pack(until := NULL::BIGINT, done := a.done, {_said("'released'")}) END", source="x",
)
_CAP = f"CASE WHEN a.made[-1] IS NOT NULL AND r.t - a.made[-1] < {DAY // 4} THEN 'interval' WHEN {_MADE.format(DAY)} >= 2 THEN 'day' WHEN {_MADE.format(7 * DAY)} >= 6 THEN 'week' ELSE 'allowed' END"
#: x: sig, seq, ts
COMMENTS = fold("sig", _T, "seq", f"struct_pack(made := []::BIGINT[], o := []::{_OUTCOME})", f"struct_pack(made := CASE WHEN {_CAP} = 'allowed' THEN list_append(a.made, r.t) ELSE a.made END, {_said(_CAP)})", source="x")
_RECENT = f"list_append(list_filter(a.seen, lambda x: x > r.t - {DAY}), r.t)"
ESCALATIONS = fold("scope", _T, "seq", f"struct_pack(seen := []::BIGINT[], o := []::{_OUTCOME})", f"CASE WHEN len({_RECENT}) >= 3 THEN struct_pack(seen := []::BIGINT[], {_said("'escalated'")}) ELSE struct_pack(seen := {_RECENT}, {_said("'counted'")}) END", source="x")
#: x: sig, seq, ts, move
DESK = fold(
    "sig", "struct_pack(s := seq, t := epoch_us(ts), m := move)", "seq", f"struct_pack(state := ''::VARCHAR, closed := NULL::BIGINT, made := 0::INTEGER, o := []::{_OUTCOME})",
    f"CASE WHEN r.m = 'close' AND a.state <> 'open' THEN struct_pack(state := a.state, closed := a.closed, made := a.made, {_said("'ignored'")}) WHEN r.m = 'close' THEN struct_pack(state := 'closed', closed := r.t, made := a.made, {_said("'closed'")}) "
    f"WHEN a.state = 'open' THEN struct_pack(state := a.state, closed := a.closed, made := a.made, {_said("'folded'")}) WHEN a.state = 'closed' AND r.t - a.closed <= {DAY} THEN struct_pack(state := 'open', closed := a.closed, made := a.made, {_said("'reopened'")}) "
    f"WHEN a.made >= 3 THEN struct_pack(state := a.state, closed := a.closed, made := a.made, {_said("'capped'")}) ELSE struct_pack(state := 'open', closed := a.closed, made := a.made + 1, {_said("CASE WHEN a.made > 0 THEN 'superseded' ELSE 'created' END")}) END", source="x",
)
RETRIES = fold(
    "sig", _T, "seq", "struct_pack(at := NULL::BIGINT, f := NULL::BIGINT, o := []::STRUCT(seq BIGINT, first BIGINT)[])",
    f"CASE WHEN a.at IS NOT NULL AND r.t < a.at + {DAY} THEN struct_pack(at := a.at, f := a.f, o := list_append(a.o, struct_pack(seq := r.s, first := a.f))) ELSE struct_pack(at := r.t, f := r.s, o := list_append(a.o, struct_pack(seq := r.s, first := NULL::BIGINT))) END",
)
_CLOSE = f"CASE WHEN a.s IS NULL THEN a.o ELSE list_append(a.o, {_BLOCK}) END"
#: Windows that a record which can't be folded (k % 10 = 0) ends before its time: x has sig, seq, ts, k.
CUT_WINDOWS = f"WITH {R}, " + fold(
    "sig", "struct_pack(s := seq, t := epoch_us(ts), foldable := k % 10 <> 0)", "seq", "struct_pack(s := NULL::BIGINT, t := NULL::BIGINT, e := NULL::BIGINT, n := 0::BIGINT, o := []::STRUCT(s BIGINT, t BIGINT, e BIGINT, n BIGINT)[])",
    f"CASE WHEN NOT r.foldable THEN struct_pack(s := NULL::BIGINT, t := NULL::BIGINT, e := NULL::BIGINT, n := 0::BIGINT, o := {_CLOSE}) WHEN a.s IS NULL OR r.t >= a.t + {6 * 3_600_000_000} THEN struct_pack(s := r.s, t := r.t, e := r.t, n := 1::BIGINT, o := {_CLOSE}) ELSE struct_pack(s := a.s, t := a.t, e := r.t, n := a.n + 1, o := a.o) END",
    out="CASE WHEN z.s IS NULL THEN z.o ELSE list_append(z.o, struct_pack(s := z.s, t := z.t, e := z.e, n := z.n)) END",
) + " SELECT sig, o.s AS first_seq, make_timestamp(o.t) AS first_ts, make_timestamp(o.e) AS last_ts, o.n FROM y"

#: Arrivals of units (5 s, 300 s, 1800 s, 3600 s); x: unit, seq, ts, path, substate, result.
_FAILS = "CASE r.path WHEN 'properties_changed' THEN r.sub IN ('failed', 'auto-restart') WHEN 'job_removed' THEN coalesce(r.res IN ('failed', 'timeout', 'dependency', 'canceled'), false) ELSE r.sub = 'failed' END"
_FAILED = f"CASE WHEN {_FAILS} THEN list_append(list_filter(a.fails, lambda x: x > r.t - 300000000), r.t) ELSE a.fails END"
_LOOP = f"({_FAILS} AND len({_FAILED}) >= 3)"
_LIVE = "(a.began IS NOT NULL AND NOT coalesce(r.t >= a.absorbs, false) AND NOT coalesce(r.t - a.resolved > 3600000000, false))"
_REL = "CASE WHEN a.absorbs IS NOT NULL THEN 'absorbed' WHEN r.t - a.began <= 5000000 THEN 'attached' WHEN a.resolved IS NOT NULL THEN 'reopened' ELSE 'counted' END"


def _unit(outcome: str, kind: str, n: str, given_kind: str | None = None, given_n: str | None = None, **change: str) -> str:
    now = {"fails": "a.fails", "began": "a.began", "absorbs": "a.absorbs", "resolved": "a.resolved"} | change
    return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in now.items()) + f", kind := {kind}, n := {n}, o := list_append(a.o, struct_pack(seq := r.s, outcome := {outcome}, kind := {given_kind or kind}, n := {given_n or n})))"


_NEWKIND = f"CASE WHEN {_LOOP} THEN 'crash_loop' WHEN r.res IS NOT NULL THEN 'job:' || r.res ELSE coalesce(nullif(r.sub, ''), 'failed') END"
_KIND = f"CASE WHEN a.absorbs IS NOT NULL THEN a.kind WHEN {_LOOP} THEN 'crash_loop' WHEN {_REL} = 'attached' AND r.path = 'job_removed' AND r.res IS NOT NULL THEN 'job:' || r.res ELSE a.kind END"
_ABSORB = f"CASE WHEN {_LOOP} THEN r.t + 1800000000 END"
ARRIVALS = (
    f"WITH {R}, x AS (SELECT 'unit' || (scope % 9) AS unit, seq, ts, CASE source WHEN 'error' THEN 'properties_changed' WHEN 'click' THEN 'job_removed' WHEN 'view' THEN 'journald' WHEN 'signup' THEN 'resolved' ELSE 'reconcile' END AS path, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'active' END AS substate, CASE WHEN source = 'click' THEN CASE WHEN k % 2 = 0 THEN 'failed' ELSE 'done' END END AS result FROM r), "
    + fold(
        "unit", "struct_pack(s := seq, t := epoch_us(ts), path := path, sub := substate, res := result)", "ts, seq",
        "struct_pack(fails := []::BIGINT[], began := NULL::BIGINT, absorbs := NULL::BIGINT, resolved := NULL::BIGINT, kind := ''::VARCHAR, n := 0::BIGINT, o := []::STRUCT(seq BIGINT, outcome VARCHAR, kind VARCHAR, n BIGINT)[])",
        f"CASE WHEN r.path = 'resolved' THEN {_unit("'resolved'", 'a.kind', 'a.n', resolved='CASE WHEN a.began IS NULL THEN NULL ELSE r.t END')} "
        f"WHEN r.path = 'journald' AND (a.began IS NULL OR (a.resolved IS NOT NULL AND r.t - a.began > 5000000)) THEN {_unit("'alone'", 'a.kind', 'a.n', "''", '0')} WHEN r.path = 'journald' THEN {_unit("'attached'", 'a.kind', 'a.n + 1')} "
        f"WHEN NOT {_LIVE} THEN {_unit("'opened'", _NEWKIND, '1::BIGINT', fails=_FAILED, began='r.t', absorbs=_ABSORB, resolved='NULL::BIGINT')} "
        f"ELSE {_unit(_REL, _KIND, 'a.n + 1', fails=_FAILED, absorbs=f'CASE WHEN a.absorbs IS NOT NULL THEN a.absorbs ELSE {_ABSORB} END', resolved=f"CASE WHEN {_REL} = 'reopened' THEN NULL ELSE a.resolved END")} END",
        source="x",
    )
    + " SELECT unit, o.seq, o.outcome, o.kind AS class, o.n FROM y"
)
