"""Operators whose answer depends on the order of a key's rows: folds, limiters, breakers, machines.

fold_by_key() deals rows by key, sorts each partition and streams it through a small state
machine, so a key of any size needs only its state, and the same step functions serve the
streaming versions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..shipping import ship

Step = Callable[[object, dict], Iterable[dict]]


def fold_by_key(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Step, schema: str, finish: Callable[[object], Iterable[dict]] = lambda s: ()) -> DataFrame:
    """Rows that step(state, row) and finish(state) give, each key in its order. Rows are dicts, times are datetimes in UTC."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    if key is not None:
                        out += finish(state)
                    key, state = now, start()
                out += step(state, row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if key is not None and (out := [*out, *finish(state)]):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


def _seconds(n: float) -> timedelta:
    return timedelta(seconds=n)


# ---------------------------------------------------------------- folds of fixed windows
@dataclass
class Fold:
    """An open window: it begins with its first row and lasts `window` seconds whatever comes."""

    window: float
    first: dict | None = None
    last: datetime | None = None
    n: int = 0

    def closed(self) -> list[dict]:
        out = [{**{k: self.first[k] for k in ("sig",)}, "first_seq": self.first["seq"], "first_ts": self.first["ts"], "last_ts": self.last, "n": self.n}] if self.first else []
        self.first, self.n = None, 0
        return out

    def add(self, row: dict) -> list[dict]:
        out = self.closed() if self.first and row["ts"] >= self.first["ts"] + _seconds(self.window) else []
        if row.get("foldable") is False:  # such a row ends the fold and isn't part of one
            return out + self.closed()
        if self.first is None:
            self.first = row
        self.last, self.n = row["ts"], self.n + 1
        return out


FOLDED = "sig string, first_seq long, first_ts timestamp, last_ts timestamp, n long"


def folded(records: DataFrame, window: float = 300) -> DataFrame:
    """One row for each window of a signature."""
    return fold_by_key(records, ["sig"], ["seq"], lambda: Fold(window), lambda s, r: s.add(r), FOLDED, lambda s: s.closed())


def deduplicated(records: DataFrame, key: str, seconds: float = 600) -> DataFrame:
    """records with `duplicate`: seen within the time from the first one; a duplicate doesn't lengthen it."""
    fields = [f.simpleString().replace(":", " ", 1) for f in records.schema.fields]

    def step(state: dict, row: dict) -> list[dict]:
        again = state.get("at") is not None and row["ts"] < state["at"] + _seconds(seconds)
        if not again:
            state["at"] = row["ts"]
        return [row | {"duplicate": again}]

    return fold_by_key(records, [key], ["seq"], dict, step, ", ".join(fields) + ", duplicate boolean")


# ---------------------------------------------------------------- limiters
def cooled(records: DataFrame, seconds: float, key: list[str]) -> DataFrame:
    """The rows that fire: at most one of a key in each cooldown, which begins with a fire."""
    schema = ", ".join(f.simpleString().replace(":", " ", 1) for f in records.schema.fields)

    def step(state: dict, row: dict) -> list[dict]:
        if state.get("at") is not None and row["ts"] < state["at"] + _seconds(seconds):
            return []
        state["at"] = row["ts"]
        return [row]

    return fold_by_key(records, key, ["seq"], dict, step, schema)


def token_bucket(records: DataFrame, per_minute: float, burst: float, key: str = "scope") -> DataFrame:
    """(key, seq, admitted): a bucket that fills evenly and holds `burst`."""
    kind = records.schema[key].dataType.simpleString()

    def step(state: dict, row: dict) -> list[dict]:
        level = state.get("level", burst)
        if "at" in state:
            level = min(burst, level + (row["ts"] - state["at"]).total_seconds() * per_minute / 60)
        ok = level >= 1
        state["level"], state["at"] = level - ok, row["ts"]
        return [{key: row[key], "seq": row["seq"], "admitted": ok}]

    return fold_by_key(records, [key], ["seq"], dict, step, f"{key} {kind}, seq long, admitted boolean")


def create_caps(records: DataFrame, caps: list[tuple[str, float, int]], key: str = "scope") -> DataFrame:
    """(key, seq, created, violated): only created rows count towards the caps (name, seconds, most); the first violated one is named."""
    kind = records.schema[key].dataType.simpleString()
    longest = max(s for _, s, _ in caps)

    def step(made: list, row: dict) -> list[dict]:
        made[:] = [t for t in made if t > row["ts"] - _seconds(longest)]
        broken = next((name for name, seconds, most in caps if sum(t > row["ts"] - _seconds(seconds) for t in made) >= most), None)
        if broken is None:
            made.append(row["ts"])
        return [{key: row[key], "seq": row["seq"], "created": broken is None, "violated": broken}]

    return fold_by_key(records, [key], ["seq"], list, step, f"{key} {kind}, seq long, created boolean, violated string")


# ---------------------------------------------------------------- breakers
class Trailing:
    """Times of the last `span` seconds."""

    def __init__(self, span: float):
        self.span, self.times = _seconds(span), deque()

    def count(self, now: datetime) -> int:
        """How many lie within the span before now, now excluded."""
        while self.times and self.times[0] <= now - self.span:
            self.times.popleft()
        return sum(t < now for t in self.times)

    def add(self, now: datetime) -> None:
        self.times.append(now)


@dataclass(frozen=True)
class Circuit:
    """What is remembered of a scope: `pressed` since when it has been over its cap without a pause, `doublings` of the wait."""

    phase: str = "closed"
    until: datetime | None = None
    pressed: datetime | None = None
    doublings: int = -1
    trips: int = 0


@dataclass(frozen=True)
class Breaker:
    """A table of guarded moves. Over its cap for `sustain` seconds a scope opens; it waits `base` seconds, twice as long each
    further time up to `longest`; then one arrival probes it. The rate counts whatever arrived in the 60 seconds before, allowed
    or not: were only allowed arrivals counted, a blocked scope's rate would fall by itself and never stay over its cap."""

    cap: int
    sustain: float = 120
    base: float = 60
    longest: float = 1800

    def wait(self, c: Circuit) -> float:
        return min(self.base * 2 ** max(c.doublings, 0), self.longest)

    def over(self, rate: int) -> bool:
        return 0 < self.cap <= rate

    def lasting(self, c: Circuit, now: datetime) -> bool:
        return now - (c.pressed or now) >= _seconds(self.sustain)

    def tripped(self, c: Circuit, now: datetime) -> Circuit:
        after = Circuit("open", None, None, c.doublings + 1, c.trips + 1)
        return replace(after, until=now + _seconds(self.wait(after)))

    #: (phase, guard, allowed, probe, what the circuit becomes), the first that applies.
    ARRIVAL = (
        ("open", lambda b, c, now, rate: now < c.until, False, False, lambda b, c, now: c),
        ("open", lambda b, c, now, rate: True, True, True, lambda b, c, now: replace(c, phase="half_open", pressed=None)),
        ("half_open", lambda b, c, now, rate: True, False, True, lambda b, c, now: c),
        ("closed", lambda b, c, now, rate: not b.over(rate), True, False, lambda b, c, now: replace(c, pressed=None)),
        ("closed", lambda b, c, now, rate: b.lasting(c, now), False, False, lambda b, c, now: b.tripped(c, now)),
        ("closed", lambda b, c, now, rate: True, False, False, lambda b, c, now: replace(c, pressed=c.pressed or now)),
    )

    def decide(self, c: Circuit, now: datetime, rate: int) -> tuple[Circuit, bool, bool]:
        """(the circuit after an arrival, allowed, probe)."""
        for phase, guard, allowed, probe, move in self.ARRIVAL:
            if phase == c.phase and guard(self, c, now, rate):
                return move(self, c, now), allowed, probe
        raise ValueError(c.phase)

    def verdict(self, c: Circuit, now: datetime, rate: int) -> Circuit:
        """After a probe: a scope still over its cap opens again, another one closes and starts over with the shortest wait."""
        if c.phase != "half_open":
            return c
        return self.tripped(c, now) if self.over(rate) else replace(c, phase="closed", until=None, doublings=0)


def breaker(records: DataFrame, cap: int, key: str = "source", **limits: float) -> DataFrame:
    """(key, seq, allowed, probe, state, trips) of every arrival; a probe's verdict follows at once."""
    kind, rules = records.schema[key].dataType.simpleString(), Breaker(cap, **limits)

    def step(s: dict, row: dict) -> list[dict]:
        seen, now = s.setdefault("seen", Trailing(60)), row["ts"]
        # an arrival at the same instant counts towards the rate of the next one
        rate = seen.count(now) + sum(t == now for t in seen.times)
        circuit, allowed, probe = rules.decide(s.get("circuit", Circuit()), now, rate)
        seen.add(now)
        s["circuit"] = circuit = rules.verdict(circuit, now, seen.count(now)) if allowed and probe else circuit
        return [{key: row[key], "seq": row["seq"], "allowed": allowed, "probe": probe, "state": circuit.phase, "trips": circuit.trips}]

    return fold_by_key(records, [key], ["seq"], dict, step, f"{key} {kind}, seq long, allowed boolean, probe boolean, state string, trips int")


# ---------------------------------------------------------------- arrivals of a unit
#: Seconds: merge window, crash-loop window, absorption, storm window.
MERGE, CRASH, ABSORB, STORM = 5, 300, 1800, 3600
#: Failures within the crash-loop window that make a loop.
LOOP = 3
#: What counts as a failure, by path: (column, values).
FAILURES = {"properties_changed": ("substate", ("failed", "auto-restart")), "reconcile": ("substate", ("failed",)), "job_removed": ("job_result", ("failed", "timeout", "dependency", "canceled"))}


@dataclass(frozen=True)
class Outage:
    """The incident of one unit."""

    began: datetime
    kind: str
    n: int = 1
    absorbs_until: datetime | None = None
    resolved: datetime | None = None

    def over(self, at: datetime) -> bool:
        """Too old to take anything in: a loop after its absorption, another one a storm window after it was resolved."""
        return (self.absorbs_until is not None and at >= self.absorbs_until) or (self.resolved is not None and at - self.resolved > _seconds(STORM))

    def relation(self, at: datetime) -> str:
        return "absorbed" if self.absorbs_until else "attached" if at - self.began <= _seconds(MERGE) else "reopened" if self.resolved else "counted"


def _named(row: dict, fresh: bool) -> str | None:
    """The class that an arrival gives its incident: a job's result, or for a new incident what else it says."""
    if row["job_result"] and (fresh or row["path"] == "job_removed"):
        return f"job:{row['job_result']}"
    return (row["substate"] or "failed") if fresh else None


def _arrival(s: dict, row: dict) -> tuple[str, str, int]:
    """(outcome, class, count) of one arrival: the incident is found or dropped, then what relates the two decides."""
    at, path, outage = row["ts"], row["path"], s.get("outage")
    if path == "resolved":
        s["outage"] = outage and replace(outage, resolved=at)
        return "resolved", outage.kind if outage else "", outage.n if outage else 0
    if path == "journald":  # log lines never open anything
        if not outage or (outage.resolved and at - outage.began > _seconds(MERGE)):
            return "alone", "", 0
        s["outage"] = outage = replace(outage, n=outage.n + 1)
        return "attached", outage.kind, outage.n
    column, values = FAILURES.get(path, ("substate", ("failed",)))
    recent, loop = s.setdefault("failures", Trailing(CRASH)), False
    if row[column] in values:
        recent.add(at)
        loop = recent.count(at) + sum(t == at for t in recent.times) >= LOOP
    if outage and outage.over(at):
        outage = None
    absorbs = at + _seconds(ABSORB) if loop else None
    if outage is None:
        s["outage"] = outage = Outage(at, "crash_loop" if loop else _named(row, True), absorbs_until=absorbs)
        return "opened", outage.kind, 1
    outcome, kind = outage.relation(at), outage.kind
    if outcome != "absorbed":
        if loop:
            kind = "crash_loop"
        elif outcome == "attached":
            kind = _named(row, False) or kind
    else:
        absorbs = outage.absorbs_until
    s["outage"] = outage = replace(outage, n=outage.n + 1, kind=kind, absorbs_until=absorbs, resolved=None if outcome == "reopened" else outage.resolved)
    return outcome, outage.kind, outage.n


def merged_arrivals(arrivals: DataFrame) -> DataFrame:
    """(unit, seq, outcome, class, n) of arrivals (unit, seq, ts, path, substate, job_result): opened, absorbed, attached, reopened or
    counted; resolved for the end of an incident, alone for a log line without one."""

    def step(s: dict, row: dict) -> list[dict]:
        outcome, kind, n = _arrival(s, row)
        return [{"unit": row["unit"], "seq": row["seq"], "outcome": outcome, "class": kind, "n": n}]

    return fold_by_key(arrivals, ["unit"], ["ts", "seq"], dict, step, "unit string, seq long, outcome string, class string, n long")


# ---------------------------------------------------------------- admission of observations
@dataclass
class Desk:
    """Incidents of one correlation key: at most one is live."""

    reopen: float | None
    seen: set = field(default_factory=set)
    state: str = ""
    number: int = 0
    sigs: set = field(default_factory=set)
    resolved: datetime | None = None
    n: int = 0


def admitted(observations: DataFrame, reopen_window: float | None = None) -> DataFrame:
    """(key, seq, outcome, incident, n): duplicate, suppressed, folded, merged, reopened or created, of observations
    (key, seq, ts, event_id, sig, suppressed, resolves). An incident is named by its key and number."""

    def step(d: Desk, row: dict) -> list[dict]:
        out = lambda outcome: [{"key": row["key"], "seq": row["seq"], "outcome": outcome, "incident": f"{row['key']}/{d.number}" if d.number else None, "n": d.n}]
        if row["resolves"]:
            if d.state == "open":
                d.state, d.resolved = "resolved", row["ts"]
            return out("resolved")
        if row["event_id"] in d.seen:
            return out("duplicate")
        d.seen.add(row["event_id"])
        if row["suppressed"]:
            return out("suppressed")
        if d.state == "open":
            known = row["sig"] in d.sigs
            d.sigs.add(row["sig"])
            d.n += 1
            return out("folded" if known else "merged")
        if d.state == "resolved" and (d.reopen is None or row["ts"] - d.resolved <= _seconds(d.reopen)):
            d.state, d.n = "open", d.n + 1
            d.sigs.add(row["sig"])
            return out("reopened")
        d.state, d.number, d.n, d.sigs = "open", d.number + 1, 1, {row["sig"]}
        return out("created")

    return fold_by_key(observations, ["key"], ["seq"], lambda: Desk(reopen_window), step, "key string, seq long, outcome string, incident string, n long")


# ---------------------------------------------------------------- the transition system
#: Edge, states it leaves from, state it leads to, trigger.
_WORK = "detected recorded play:drafted play:check_only play:applied play:failed research:requested research:returned research:degraded research:skipped"
EDGES = [
    ("T01", "detected", "recorded", "observation_admitted"), ("T02", "detected", "suppressed", "suppression_open_at_commit"), ("T03", "recorded", "play:drafted", "rung_advance_play"),
    ("T04", "recorded", "research:requested", "rung_advance_research"), ("T05", "recorded", "agent:running", "rung_advance_agent"), ("T06", "recorded", "verifying", "outlets_complete"),
    ("T07", "recorded", "escalated", "budget_exhausted_before_work"), ("T08", "play:drafted", "play:check_only", "run_started_check"), ("T09", "play:drafted", "play:failed", "no_runnable_task"),
    ("T10", "play:check_only", "play:applied", "apply_decision"), ("T11", "play:check_only", "play:failed", "check_failed"), ("T12", "play:applied", "verifying", "applied_run_complete"),
    ("T13", "play:failed", "play:drafted", "retry_play"), ("T14", "play:failed", "research:requested", "rung_advance_research"), ("T15", "play:failed", "research:skipped", "research_unavailable"),
    ("T16", "play:failed", "agent:running", "rung_advance_agent"), ("T17", "play:failed", "quarantined", "rollback_failed_twice"), ("T18", "play:failed", "escalated", "ceiling_reached_nothing_applied"),
    ("T19", "research:requested", "research:returned", "brief_validated"), ("T20", "research:requested", "research:degraded", "research_degraded"), ("T21", "research:requested", "research:skipped", "research_skipped"),
    ("T22", "research:returned", "play:drafted", "research_short_circuit"), ("T23", "research:returned", "agent:running", "brief_without_play"), ("T24", "research:degraded", "agent:running", "proceed_degraded"),
    ("T25", "research:skipped", "agent:running", "proceed_without_research"), ("T26", "research:returned research:degraded research:skipped", "escalated", "research_ceiling_or_budget"),
    ("T27", "agent:running", "agent:done", "agent_run_finished"), ("T28", "agent:running", "agent:failed", "agent_run_failed"), ("T29", "agent:running", "agent:suspended", "two_strikes"),
    ("T30", "agent:running", "escalated", "agent_tool_outside_allowlist"), ("T31", "agent:failed", "agent:running", "retry_agent"), ("T32", "agent:failed", "agent:suspended", "two_strikes_reached"),
    ("T33", "agent:failed", "escalated", "agent_budget_or_strikes"), ("T34", "agent:suspended", "agent:running", "suspension_elapsed"), ("T35", "agent:suspended", "escalated", "third_failure_while_suspended"),
    ("T36", "agent:done", "verifying", "agent_applied_something"), ("T37", "agent:done", "escalated", "diagnosis_only"), ("T38", "verifying", "resolved", "window_passed"),
    ("T39", "verifying", "play:drafted", "window_failed"), ("T40", "verifying", "escalated", "window_failed_or_invalid_twice"), ("T41", "verifying", "quarantined", "evaluation_impossible"),
    ("T42", "resolved", "recorded", "recurrence_after_resolve"), ("T43", "escalated", "recorded", "recurrence_after_escalation"), ("T44", "suppressed", "recorded", "suppression_window_closed"),
    ("T45", "suppressed", "resolved", "quiet_close"), ("T46", f"{_WORK} agent:suspended", "suppressed", "suppression_declared"),
    ("T47", f"{_WORK} agent:running agent:done agent:failed agent:suspended acknowledged verifying resolved escalated suppressed", "quarantined", "illegal_transitions_or_corrupt_snapshot"),
    ("T48", f"{_WORK} agent:running agent:done agent:failed agent:suspended acknowledged verifying", "recorded", "scope_breaker_open_fold"),
    ("T49", "detected recorded", "acknowledged", "human_ack"), ("T50", "acknowledged", "resolved", "human_close"),
]
_BY_TRIGGER: dict[tuple[str, str], tuple[str, str]] = {}
for _edge, _from, _to, _trigger in reversed(EDGES):  # the lowest edge wins
    for _state in _from.split():
        _BY_TRIGGER[_state, _trigger] = (_edge, _to)


def transitions(moves: DataFrame) -> DataFrame:
    """(inc, seq, edge, from_state, to_state, refused) of (inc, seq, trigger): an illegal move is refused, the third one quarantines."""

    def step(s: dict, row: dict) -> list[dict]:
        state = s.setdefault("state", "detected")
        found = _BY_TRIGGER.get((state, row["trigger"]))
        if found:
            s["state"] = found[1]
            return [{"inc": row["inc"], "seq": row["seq"], "edge": found[0], "from_state": state, "to_state": found[1], "refused": False}]
        s["illegal"] = s.get("illegal", 0) + 1
        if s["illegal"] >= 3 and state != "quarantined":
            s["state"] = "quarantined"
        return [{"inc": row["inc"], "seq": row["seq"], "edge": "T47" if s["state"] != state else None, "from_state": state, "to_state": s["state"], "refused": True}]

    return fold_by_key(moves, ["inc"], ["seq"], dict, step, "inc string, seq long, edge string, from_state string, to_state string, refused boolean")


def legal_edges(spark) -> DataFrame:
    """The transition table: edge, from_state, to_state, trigger."""
    rows = [(e, f, t, g) for e, fs, t, g in EDGES for f in fs.split()]
    return spark.createDataFrame(rows, "edge string, from_state string, to_state string, trigger string")


# ---------------------------------------------------------------- lines that belong together
def assembled(lines: DataFrame, start: str, more: str, silence: float = 2.0, most_bytes: int = 65536, key: str = "source") -> DataFrame:
    """(key, first_line, lines, text): a block begins at a line that `start` matches and takes the lines that `more`
    matches; another start, another line, silence or its size ends it."""
    import re

    kind = lines.schema[key].dataType.simpleString()
    begins, goes_on = re.compile(start), re.compile(more)

    def close(s: dict) -> list[dict]:
        block = s.pop("block", None)
        return [{key: block[0][key], "first_line": block[0]["line_no"], "lines": len(block), "text": "\n".join(r["text"] for r in block)}] if block else []

    def step(s: dict, row: dict) -> list[dict]:
        out, block = [], s.get("block")
        if block and (row["ts"] - block[-1]["ts"] > _seconds(silence) or begins.search(row["text"]) or not goes_on.search(row["text"]) or s["bytes"] + len(row["text"].encode()) + 1 > most_bytes):
            out, block = close(s), None
        if begins.search(row["text"]):
            s["block"], s["bytes"] = [row], len(row["text"].encode())
        elif block:
            block.append(row)
            s["bytes"] += len(row["text"].encode()) + 1
        return out

    return fold_by_key(lines, [key], ["line_no"], dict, step, f"{key} {kind}, first_line long, lines long, text string", close)


# ---------------------------------------------------------------- leases, gates, caps, escalations: small machines of one key
def _outcomes(records: DataFrame, key: str, start: Callable[[], object], decide: Callable[[object, dict], str]) -> DataFrame:
    """(key, seq, outcome) of machines that only say what became of each row."""
    kind = records.schema[key].dataType.simpleString()
    return fold_by_key(records, [key], ["seq"], start, lambda s, r: [{key: r[key], "seq": r["seq"], "outcome": decide(s, r)}], f"{key} {kind}, seq long, outcome string")


def leases(requests: DataFrame, seconds: float, key: str = "inc") -> DataFrame:
    """acquired or refused: a lease lasts `seconds` from the request that got it, and nobody else gets one meanwhile."""

    def decide(s: dict, row: dict) -> str:
        if s.get("until") is not None and row["ts"] < s["until"]:
            return "refused"
        s["until"] = row["ts"] + _seconds(seconds)
        return "acquired"

    return _outcomes(requests, key, dict, decide)


def dedup_gate(moves: DataFrame, seconds: float, key: str = "key") -> DataFrame:
    """Two phases of a key (move: claim, commit or release): claimed, duplicate, committed, released or ignored. A claim holds until it is
    released or the time is over; a commit starts the time anew."""

    def decide(s: dict, row: dict) -> str:
        held = s.get("until") is not None and row["ts"] < s["until"]
        if row["move"] == "claim":
            if held:
                return "duplicate"
            s["until"], s["done"] = row["ts"] + _seconds(seconds), False
            return "claimed"
        if not held or s["done"]:
            return "ignored"
        if row["move"] == "commit":
            s["until"], s["done"] = row["ts"] + _seconds(seconds), True
            return "committed"
        s["until"] = None
        return "released"

    return _outcomes(moves, key, dict, decide)


def comment_caps(comments: DataFrame, caps: list[tuple[str, float, int]], interval: float, key: str = "sig") -> DataFrame:
    """allowed, interval or the first violated cap (name, seconds, most); only allowed comments count, and they stand `interval` seconds apart."""
    longest = max(s for _, s, _ in caps)

    def decide(made: list, row: dict) -> str:
        made[:] = [t for t in made if t > row["ts"] - _seconds(longest)]
        if made and row["ts"] - made[-1] < _seconds(interval):
            return "interval"
        broken = next((name for name, seconds, most in caps if sum(t > row["ts"] - _seconds(seconds) for t in made) >= most), None)
        if broken is None:
            made.append(row["ts"])
        return broken or "allowed"

    return _outcomes(comments, key, list, decide)


def escalations(reopenings: DataFrame, most: int = 4, seconds: float = 86_400, key: str = "scope") -> DataFrame:
    """escalated or counted: the re-opening that makes `most` of them within the time escalates and uses them up."""

    def decide(seen: list, row: dict) -> str:
        seen[:] = [t for t in seen if t > row["ts"] - _seconds(seconds)] + [row["ts"]]
        if len(seen) < most:
            return "counted"
        seen.clear()
        return "escalated"

    return _outcomes(reopenings, key, list, decide)


def issue_desk(moves: DataFrame, reopen: float, most: int, key: str = "sig") -> DataFrame:
    """What becomes of an arrival (move: arrive or close) at the issue of its signature: created, folded, reopened within the window after
    it was closed, superseded by a new one after it, or capped when the key has had its share of issues; closed and ignored for closings."""

    def decide(s: dict, row: dict) -> str:
        if row["move"] == "close":
            if s.get("state") != "open":
                return "ignored"
            s["state"], s["closed"] = "closed", row["ts"]
            return "closed"
        if s.get("state") == "open":
            return "folded"
        if s.get("state") == "closed" and row["ts"] - s["closed"] <= _seconds(reopen):
            s["state"] = "open"
            return "reopened"
        if s.get("made", 0) >= most:
            return "capped"
        outcome = "superseded" if s.get("made") else "created"
        s["state"], s["made"] = "open", s.get("made", 0) + 1
        return outcome

    return _outcomes(moves, key, dict, decide)


def retry_folds(records: DataFrame, key: str, seconds: float = 600) -> DataFrame:
    """(key, seq, first): the record that opened the window a retry falls into; null for the one that opens it."""
    kind = records.schema[key].dataType.simpleString()

    def step(s: dict, row: dict) -> list[dict]:
        again = s.get("at") is not None and row["ts"] < s["at"] + _seconds(seconds)
        if not again:
            s["at"], s["first"] = row["ts"], row["seq"]
        return [{key: row[key], "seq": row["seq"], "first": s["first"] if again else None}]

    return fold_by_key(records, [key], ["seq"], dict, step, f"{key} {kind}, seq long, first long")
