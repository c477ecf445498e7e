"""The rule language: text to a typed tree to a Spark column.

    some_avg10 >= 35 and scope in ["io", "memory"] and not (msg ~ "(?i)panic")

Types are number, string, bool and lists of one of the first two; nothing is coerced. Names
come from a closed namespace of the rule's source. A comparison with a missing value is
false, also under !=, so `not (missing == 1)` is true: every leaf is made two-valued before
and, or and not apply. The column has no UDF, so Catalyst can push it down and prune by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the language.
MAX_BYTES, MAX_DEPTH, MAX_NAMES, MAX_REGEX = 4096, 16, 64, 512
_N, _S, _B = "number", "string", "bool"


def _fields(text: str) -> dict[str, str]:
    return {n: {"n": _N, "s": _S, "b": _B}[t] for n, t in (x.split(":") for x in text.split())}


#: The fields of every source, and those of each.
COMMON = _fields("value:n unit:s scope:s sensor:s source:s count:n window_s:n age_s:n severity:s substr:s msg:s enabled:b")
FIELDS = {
    "psi": _fields("metric:s band:s some_avg10:n some_avg60:n some_avg300:n full_avg10:n full_avg60:n full_avg300:n some_total:n full_total:n stall_us:n wake:b"),
    "journald": _fields("unit:s comm:s priority:n priority_name:s non_utf8:b truncated:b"),
    "dbus": _fields("unit_key:s unit_active_state:s unit_substate:s unit_result:s exit_code:n crash_loop:b arrival_path:s"),
    "disk": _fields("mount:s fstype:s free_pct:n free_bytes:n total_bytes:n inode_free_pct:n read_only:b"),
    "timers": _fields("timer_unit:s missed_runs:n next_elapse_in_s:n last_run_age_s:n"),
    "inotify": _fields("path:s mask_class:s overflow:b"),
    "sentinel": _fields("level:s release:s env:s culprit:s release_diff:n"),
}


class PredicateError(ValueError):
    """The text isn't a predicate of the language."""


@dataclass(frozen=True)
class Node:
    kind: str  # or, and, not, compare, name, literal, list
    type: str = _B
    value: object = None
    parts: tuple[Node, ...] = ()


_TOKEN = re.compile(r"""\s*(?:(?P<number>-?\d+(?:\.\d+)?(?![\w.]))|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>==|!=|>=|<=|>|<|~|\(|\)|\[|\]|,)|(?P<word>[A-Za-z_][A-Za-z0-9_.]*))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = ("==", "!=", ">=", "<=", ">", "<", "~", "in")


def _tokens(text: str) -> list[tuple[str, str]]:
    if len(text.encode()) > MAX_BYTES:
        raise PredicateError(f"longer than {MAX_BYTES} bytes")
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise PredicateError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, type_of: Callable[[str], str | None]):
        self.tokens, self.at, self.type_of, self.names = _tokens(text), 0, type_of, set()

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise PredicateError(f"{what} expected at token {self.at}")

    def whole(self) -> Node:
        out = self.either(0)
        if self.at < len(self.tokens):
            raise PredicateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _chain(self, word: str, below: Callable[[int], Node], depth: int) -> Node:
        parts = [below(depth)]
        while self.take(word):
            parts.append(below(depth))
        return parts[0] if len(parts) == 1 else Node(word, parts=tuple(parts))

    def either(self, depth: int) -> Node:
        if depth > MAX_DEPTH:
            raise PredicateError("nested too deep")
        return self._chain("or", lambda d: self._chain("and", self.negated, d), depth)

    def negated(self, depth: int) -> Node:
        if self.take("not"):
            if depth >= MAX_DEPTH:
                raise PredicateError("nested too deep")
            return Node("not", parts=(self.negated(depth + 1),))
        if self.take("("):
            inner = self.either(depth + 1)
            self.need(")")
            return inner
        return self.comparison()

    def comparison(self) -> Node:
        left = self.operand()
        op = self.peek()
        if op not in _COMPARE:
            if left.type not in (_B, "any"):
                raise PredicateError(f"a {left.type} is no condition")
            return Node("compare", value="bare", parts=(left,))
        self.at += 1
        right = self.operand()
        return Node("compare", value=op, parts=_checked(op, left, right))

    def operand(self) -> Node:
        if self.at >= len(self.tokens):
            raise PredicateError("operand expected at the end")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Node("literal", _N, float(text))
        if kind == "string":
            return Node("literal", _S, re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1] if m[1] in "\"'\\" else m[0]), text[1:-1], flags=re.S))
        if text == "[":
            items = []
            while not self.take("]"):
                if items:
                    self.need(",")
                items.append(self.operand())
            kinds = {x.type for x in items}
            if len(kinds) > 1 or not kinds <= {_N, _S} or any(x.kind != "literal" for x in items):
                raise PredicateError("a list holds numbers or strings")
            return Node("list", f"list of {kinds.pop()}" if kinds else "empty list", tuple(x.value for x in items))
        if kind != "word" or text in ("and", "or", "not", "in"):
            raise PredicateError(f"unexpected {text!r}")
        if text in ("true", "false"):
            return Node("literal", _B, text == "true")
        found = self.type_of(text)
        if found is None:
            raise PredicateError(f"unknown name {text!r}")
        self.names.add(text)
        if len(self.names) > MAX_NAMES:
            raise PredicateError(f"more than {MAX_NAMES} names")
        return Node("name", found, text)


def _checked(op: str, left: Node, right: Node) -> tuple[Node, Node]:
    loose = "any" in (left.type, right.type)
    if op == "in":
        if not right.type.endswith("list") and not right.type.startswith("list"):
            raise PredicateError("in needs a list")
        if right.type != "empty list" and not loose and right.type != f"list of {left.type}":
            raise PredicateError(f"a {left.type} is never in a {right.type}")
    elif op == "~":
        if right.kind != "literal" or right.type != _S or left.type not in (_S, "any"):
            raise PredicateError("~ needs a string and a pattern")
        if len(str(right.value).encode()) > MAX_REGEX:
            raise PredicateError(f"a pattern has at most {MAX_REGEX} bytes")
        try:
            re.compile(str(right.value))
        except re.error as e:
            raise PredicateError(f"bad pattern: {e}") from None
    elif not loose and left.type != right.type:
        raise PredicateError(f"{left.type} {op} {right.type}: nothing is coerced")
    elif op in (">", "<", ">=", "<=") and not loose and left.type != _N:
        raise PredicateError(f"a {left.type} has no order")
    elif "list" in left.type or "list" in right.type:
        raise PredicateError("a list stands on the right of in")
    return left, right


def java_pattern(pattern: str) -> str:
    """A pattern with this language's meaning of white space, line ends and case, for Java."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            out.append({"\\s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]", "\\S": r"\S" if inside else r"[^\t\n\f\r ]"}.get(pair, pair))
            i += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        out.append("\\z" if c == "$" and not inside else c)
        i += 1
    body = "".join(out)
    folded = re.sub(r"\(\?i\)", "(?iu)", body)
    return "(?d)" + folded


def _column(node: Node, value_of: Callable[[str, str], Column]) -> Column:
    if node.kind == "literal":
        return F.lit(node.value)
    return value_of(str(node.value), node.type)


def numbers_equal(a: Column, b: Column) -> Column:
    """Equal up to a relative 1e-9."""
    return (a == b) | (F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b)))


def _leaf(node: Node, value_of: Callable[[str, str], Column]) -> Column:
    op = node.value
    left = _column(node.parts[0], value_of)
    if op == "bare":
        return left.try_cast("boolean") if node.parts[0].type == "any" else left
    right_node = node.parts[1]
    if op == "in":
        values = right_node.value
        if not values:
            return F.lit(False)
        if right_node.type == f"list of {_N}":
            number = left.try_cast("double") if node.parts[0].type == "any" else left
            out = numbers_equal(number, F.lit(values[0]))
            for v in values[1:]:
                out = out | numbers_equal(number, F.lit(v))
            return out
        return left.isin(*values)
    if op == "~":
        return left.rlike(java_pattern(str(right_node.value)))
    right = _column(right_node, value_of)
    kinds = {node.parts[0].type, right_node.type} - {"any"}
    if _N in kinds:
        left, right = (c.try_cast("double") for c in (left, right))
    if op in ("==", "!="):
        equal = numbers_equal(left, right) if _N in kinds else left == right
        return equal if op == "==" else ~equal
    return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[str(op)]


def _compiled(node: Node, value_of: Callable[[str, str], Column]) -> Column:
    if node.kind in ("and", "or"):
        out = _compiled(node.parts[0], value_of)
        for part in node.parts[1:]:
            more = _compiled(part, value_of)
            out = out & more if node.kind == "and" else out | more
        return out
    if node.kind == "not":
        return ~_compiled(node.parts[0], value_of)
    return F.coalesce(_leaf(node, value_of), F.lit(False))


def parse(text: str, source: str | None = None, scopes: tuple[str, ...] = (), names: Mapping[str, str] | None = None, open_names: bool = False) -> Node:
    """The typed tree; names: a namespace instead of the source's; open_names: unknown names are allowed and their types aren't checked."""
    known = dict(names) if names is not None else COMMON | FIELDS.get(source or "", {})

    def type_of(name: str) -> str | None:
        if source == "psi" and name.startswith("full_") and "cpu" in scopes:
            raise PredicateError(f"the cpu scope has no {name}")
        return known.get(name, "any" if open_names else None)

    return _Parser(text, type_of).whole()


def compile_predicate(text: str, source: str | None = None, columns: Mapping[str, Column] | None = None, **more) -> Column:
    """A boolean column without nulls. columns: where the names are found; a name that isn't among them is missing."""
    tree = parse(text, source, **more)

    def value_of(name: str, kind: str) -> Column:
        if columns is None:
            return F.col(name)
        return columns.get(name, F.lit(None).cast({_N: "double", _B: "boolean"}.get(kind, "string")))

    return _compiled(tree, value_of)


def bound(detail: str, source: str, columns: Mapping[str, Column]) -> dict[str, Column]:
    """Columns for all names of a source: given ones, else the entry of a map column."""
    kinds = {_N: "double", _B: "boolean", _S: "string"}
    return {n: columns[n] if n in columns else F.try_element_at(F.col(detail), F.lit(n)).try_cast(kinds[t]) for n, t in (COMMON | FIELDS.get(source, {})).items()}


# ---------------------------------------------------------------- rules
@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str
    value_type: str = "string"

    def text(self) -> str:
        quote = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        number = re.fullmatch(r"-?\d+(\.\d+)?", self.value) is not None
        if self.op == "in":
            items = [x.strip().strip("\"'") for x in self.value.strip().removeprefix("[").removesuffix("]").split(",") if x.strip()]
            literal = "[" + ", ".join(x if self.value_type == "number" else quote(x) for x in items) + "]"
        elif self.value_type == "number":
            if not number:
                raise PredicateError(f"{self.value!r} is no number")
            literal = self.value
        elif self.value_type == "bool":
            literal = self.value
        else:
            literal = quote(self.value)
        return f"{self.field} {self.op} {literal}"


@dataclass(frozen=True)
class Rule:
    name: str
    source: str
    match: tuple[Condition, ...]
    hold: str = "0s"
    enabled: bool = True
    severity: str = "medium"
    entry_rung: str = "record"
    cooldown: str = "0s"
    max_runs: int = 0
    verify_window: str = "10m"
    scopes: tuple[str, ...] = field(default=())

    def text(self) -> str:
        return " and ".join(f"({c.text()})" for c in self.match)

    def fingerprint(self) -> str:
        """Changes when the source, the hold or a condition does."""
        return hashlib.sha256("\x1f".join([self.source, self.hold, *(f"{c.field}\x1e{c.op}\x1e{c.value}\x1e{c.value_type}" for c in self.match)]).encode()).hexdigest()[:16]

    def inferred_scopes(self) -> tuple[str, ...]:
        """Scopes that full_ fields exist in, unless the rule names its own."""
        if self.scopes or self.source != "psi":
            return self.scopes
        return ("io", "memory") if any(c.field.startswith("full_") for c in self.match) else ("cpu", "io", "memory")

    def column(self, columns: Mapping[str, Column] | None = None) -> Column:
        return compile_predicate(self.text(), self.source, columns, scopes=self.inferred_scopes())


def validate(rules: list[Rule], per_source: int = 256, in_all: int = 1024) -> list[str]:
    """All that is wrong with a rule set; it is taken as a whole or not at all."""
    from ..functions.classify import go_duration

    problems, seen, counts = [], set(), {}
    for r in rules:
        if r.name in seen:
            problems.append(f"{r.name}: the name is taken")
        seen.add(r.name)
        counts[r.source] = counts.get(r.source, 0) + 1
        if r.source not in FIELDS:
            problems.append(f"{r.name}: unknown source {r.source}")
            continue
        if not r.match or len(r.match) > 32:
            problems.append(f"{r.name}: 1 to 32 conditions are needed")
        if go_duration(r.cooldown) > 86400:
            problems.append(f"{r.name}: a cooldown lasts 24 h at most")
        if go_duration(r.verify_window) > 3600:
            problems.append(f"{r.name}: a verify window lasts 1 h at most")
        try:
            parse(r.text(), r.source, r.inferred_scopes())
        except PredicateError as e:
            problems.append(f"{r.name}: {e}")
    problems += [f"{s}: more than {per_source} rules" for s, n in counts.items() if n > per_source]
    return problems + ([f"more than {in_all} rules"] if len(rules) > in_all else [])


def load_rules(folder: str) -> list[Rule]:
    """Rules of all TOML files of a folder, sorted by file name; raises if any is wrong."""
    import tomllib
    from pathlib import Path

    rules = []
    for path in sorted(Path(folder).glob("*.toml")):
        for r in tomllib.loads(path.read_text()).get("rule", []):
            unknown = set(r) - {"name", "source", "match", "for", "enabled", "severity", "entry_rung", "cooldown", "max_runs", "verify_window", "scopes"}
            if unknown:
                raise PredicateError(f"{path.name}: unknown keys {sorted(unknown)}")
            match = tuple(Condition(str(m["field"]), m["op"], str(m["value"]), m.get("value_type", "string")) for m in r.get("match", []))
            rest = {k: v for k, v in r.items() if k not in ("name", "source", "match", "for", "scopes")}
            rules.append(Rule(r["name"], r["source"], match, r.get("for", "0s"), scopes=tuple(r.get("scopes", ())), **rest))
    if problems := validate(rules):
        raise PredicateError("; ".join(problems))
    return rules


def matched(rules: list[Rule], columns: Mapping[str, Column] | None = None, source: Column | None = None) -> Column:
    """array<string> of the enabled rules that match a row, in rule order."""
    source = F.col("source") if source is None else source
    hits = [F.when((source == r.source) & r.column(columns), F.lit(r.name)) for r in rules if r.enabled]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
