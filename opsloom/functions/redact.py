"""Redaction: an ordered rule table, markers that are never redacted again, byte budgets, statistics by rule.

Rules run one after the other over the text that the earlier ones left; a rule replaces its one group, or the whole
match if it has none or several, by `[REDACTED:rule]`. Order and marker skipping can't be a chain of plain regex
replacements, so this is an Arrow UDF. Inside it a text without any rule's signs is passed over, and a rule is tried only
on texts that have its own (plain searches of words, which cost a hundredth of one regular expression for all).

Assignments leave to the flag and header rules what those would take; DSNs, key blocks, high-entropy tokens and paths have
scanners of their own. Public keys of a project's DSNs are put aside during a pass. The rule `path_disclosure` (paths
of three or more segments outside the allowed folders) is only in the table if asked for.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in evaluation order; the first 13 are mandatory.
ORDER = (
    "private_key_block", "private_key_inline", "dsn_secret", "dsn_any", "conn_string_password", "url_basic_auth", "env_assign", "kv_secret_assign", "cli_flag_secret", "auth_header", "bearer_token", "jwt",
    "cloud_key_shape", "entropy_token", "pii_email_ip", "pii_identity_kv", "path_home_root", "path_disclosure",
)
MANDATORY = 13
#: Patterns of the rules that have one.
PATTERNS = dict([
    ("private_key_inline", r"""(?i)(?:^|[^A-Za-z0-9])(?:private[_-]?key|secret[_-]?key|ssh[_-]?key|key[_-]?material|keystore[_-]?(?:password|pass))\s*[:=]\s*("[^"\n]{16,}"|'[^'\n]{16,}'|[A-Za-z0-9+/=_-]{16,})"""),
    ("conn_string_password", r"(?i)\b(?:postgresql|postgres|mysql|mariadb|mongodb\+srv|mongodb|rediss|redis|amqps|amqp|clickhouse|kafka|mssql|ftps|ftp|ldaps|ldap|memcached)://(?:[^:@/\s]{1,64}):([^@/\s]+)@"),
    ("url_basic_auth", r"(?i)\b[a-z][a-z0-9+.\-]{1,15}://(?:[^:@/\s]{1,64}):([^@/\s]+)@"),
    ("env_assign", r"""(?i)(?:^|[^A-Za-z0-9])(?:PASSPHRASE|PASSWORD|PASSWD|PWD|SECRET_KEY|SECRET|API[_-]?KEY|ACCESS[_-]?KEY|PRIVATE[_-]?KEY|CLIENT[_-]?SECRET|SESSION[_-]?KEY|ENCRYPTION[_-]?KEY|SIGNING[_-]?KEY|CONNECTION[_-]?STRING|CONN[_-]?STR|CREDENTIALS|CREDENTIAL|AUTHORIZATION|AUTH|TOKEN|DSN|BEARER)\s*=\s*("[^"\n]*"|'[^'\n]*'|[^\s;,&]+)"""),
    ("kv_secret_assign", r"""(?i)(?:^|[^A-Za-z0-9])(?:passphrase|password|passwd|pwd|secret_key|secret|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|session[_-]?key|encryption[_-]?key|signing[_-]?key|token|dsn|connection[_-]?string|conn[_-]?str|credentials?|authorization|auth[_-]?token)["']?\s*[:=]\s*("[^"\n]*"|'[^'\n]*'|[^\s,}\]&;]+)"""),
    ("cli_flag_secret", r"""(?i)(?:^|\s)--?(?:[a-z][a-z0-9_\-]{0,29})?(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[a-z0-9_\-]{0,8}(?:=|\s+)("[^"\n]*"|[^\s"]+)"""),
    ("auth_header", r"(?im)^[ \t]*(?:authorization|proxy-authorization|x-api-key|x-auth-token|x-sentry-auth|x-amz-security-token|api-key|cookie|set-cookie)[ \t]*:[ \t]*(.+)$"),
    ("bearer_token", r"(?i)(?:^|[^A-Za-z0-9])bearer\s+([A-Za-z0-9\-._~+/]{8,}={0,2})"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*"),
    ("cloud_key_shape", r"(?i)(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|sk-(?:proj-)?[A-Za-z0-9_\-]{20,}|AIza[0-9A-Za-z_\-]{35}|ya29\.[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{36,}|pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_\-]{20,}|dckr_pat_[A-Za-z0-9_\-]{20,}|SG\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}|hf_[A-Za-z0-9]{30,}|tvly-[A-Za-z0-9]{20,}|shpat_[0-9a-f]{32}|eyJr[A-Za-z0-9_\-]{20,})"),
    ("pii_email_ip", r"(?:[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})|(?:\b\d{1,3}(?:\.\d{1,3}){3}\b)"),
    ("pii_identity_kv", r"""(?i)(?:^|[^A-Za-z0-9])(?:user|username|user_name|email|e_mail|ip_address|client_ip|remote_addr|cookie|session_id)["']?\s*[:=]\s*("[^"\n]*"|'[^'\n]*'|[^\s,}\]&;]+)"""),
])
#: Folders that path_disclosure leaves, and roots of home folders (a star is one segment).
ALLOWED_PATHS = ("/srv/src", "/opt/apps", "/usr/lib", "/var/log")
HOME_ROOTS = ("/home/*", "/Users/*", "/root", "/var/home/*")
#: By rule: lower-case words of which a match has at least one, and characters all of which it has.
_NAMES = ("pass", "pwd", "secret", "key", "conn", "credential", "auth", "token", "dsn", "bearer")
SIGNS: dict[str, tuple[tuple[str, ...], str]] = {
    "private_key_block": (("-----begin", "putty-user-key-file-"), ""), "private_key_inline": (("key",), ""), "dsn_secret": (("://",), "@"), "dsn_any": (("://",), "@"),
    "conn_string_password": (("://",), "@"), "url_basic_auth": (("://",), "@"), "env_assign": (_NAMES, "="), "kv_secret_assign": (_NAMES, ""), "cli_flag_secret": (("pass", "pwd", "secret", "token", "key"), "-"),
    "auth_header": (("authorization", "api-key", "x-auth-token", "x-sentry-auth", "x-amz-security-token", "cookie"), ":"), "bearer_token": (("bearer",), ""), "jwt": (("eyj",), "."),
    "cloud_key_shape": (("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "aiza", "ya29.", "npm_", "pypi-", "dckr_pat_", "sg.", "hf_", "tvly-", "shpat_", "eyjr"), ""),
    "pii_identity_kv": (("user", "email", "e_mail", "ip_address", "client_ip", "remote_addr", "cookie", "session_id"), ""), "path_home_root": (("/home/", "/users/", "/root"), ""), "path_disclosure": (("/",), ""),
}
MARKER = re.compile(r"""["']?\[(?:REDACTED:[a-z][a-z0-9_]{2,31}|SCRUB-TRUNCATED:[0-9]+)\]["']?""")
_ASSIGNED, _QUAD = re.compile("[:=]"), re.compile(r"[0-9]\.[0-9]")

def is_marker(c: Column) -> Column:
    """Whether a text is a marker, bare or quoted."""
    return c.rlike(f"^(?:{MARKER.pattern})\\z")


Span = tuple[int, int, str | None]  # begin, end, what stands there afterwards if not the rule's marker


# ---------------------------------------------------------------- values
def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def random_looking(text: str, least: int = 40, bits: float = 3.5) -> bool:
    """Long, with lower case, upper case and digits, unevenly spread; hex of one case has only two of these."""
    return len(text) >= least and all(re.search(kind, text) for kind in ("[a-z]", "[A-Z]", "[0-9]")) and entropy(text) >= bits


def quad(text: str) -> list[int] | None:
    parts = text.split(".")
    return [int(p) for p in parts] if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts) else None


def exempt(text: str) -> bool:
    """Loopback, private and link-local addresses aren't personal."""
    q = quad(text.strip("\"'"))
    return q is not None and (q[0] in (127, 10, 0) or (q[0] == 172 and 16 <= q[1] <= 31) or q[:2] in ([192, 168], [169, 254]))


def path_shaped(text: str) -> bool:
    """A flag's value that is plainly a path: after ~/, ./ or ../ anything in a path's characters, after / also another / or a dot."""
    text = text[1:-1] if len(text) >= 2 and text[0] in "\"'" and text[-1] == text[0] else text
    return bool(re.fullmatch(r"(?:~|\.\.?)/[A-Za-z0-9._/-]+|/(?=[^./]*[./])[A-Za-z0-9._/-]+", text))


# ---------------------------------------------------------------- scanners
@dataclass(frozen=True)
class Settings:
    """What scanners need besides the text."""

    public_keys: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ALLOWED_PATHS
    homes: tuple[str, ...] = HOME_ROOTS

    def is_public(self, text: str) -> bool:
        return bool(re.fullmatch(r"[0-9a-f]{32}", text)) or (text[:2] == "\0S" and text[-1:] == "\0")


_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|PuTTY-User-Key-File-")
_BLOCK_END = {"-": re.compile(r"^-----END .*$", re.M), "P": re.compile(r"^[ \t\r]*$", re.M)}


def key_blocks(text: str, settings: Settings) -> Iterator[Span]:
    """From a first line to the end of its last one (PuTTY: up to a blank line), else to the end of the text."""
    at = 0
    while begin := _BLOCK.search(text, at):
        end = _BLOCK_END[text[begin.start()]].search(text, begin.end())
        at = end.end() if end else len(text)
        yield begin.start(), at, None


_URI = re.compile(r"""(?<![A-Za-z0-9+.\-])([A-Za-z][A-Za-z0-9+.\-]*://)([^ \t\n\r"'<>`;,)\[\]}/@]*(?:@[^ \t\n\r"'<>`;,)\[\]}/@]*)*@)?([^ \t\n\r"'<>`;,)\[\]}/@]+)([^ \t\n\r"'<>`;,)\[\]}]*)""")


def _users(text: str) -> Iterator[tuple[re.Match[str], list[str]]]:
    for m in _URI.finditer(text):
        if m[2]:
            yield m, m[2][:-1].split(":")


def dsn_secrets(text: str, settings: Settings) -> Iterator[Span]:
    """The secret half of publickey:secret@."""
    for m, user in _users(text):
        if len(user) == 2 and settings.is_public(user[0]) and re.fullmatch("[0-9a-f]{32}", user[1]):
            yield m.end(2) - 33, m.end(2) - 1, None


def dsn_forms(text: str, settings: Settings) -> Iterator[Span]:
    """DSNs become scheme://publickey@host/project; a marker stands for a key that isn't one."""
    for m, user in _users(text):
        public = settings.is_public(user[0])
        # a marker before the @ ends a URI's token at its bracket, so what earlier rules did is never met here
        if public or (m[1].lower() == "sentry://" and m[2] != "@"):
            project = re.match(r"/([^/?#]+)", m[4])
            plain = f"{m[1]}{user[0] if public else '[REDACTED:dsn_any]'}@{m[3]}{'/' + project[1] if project else ''}"
            if plain != m[0]:
                yield m.start(), m.end(), plain


_TOKEN = re.compile(r"[A-Za-z0-9_\-+/]{40,}")


def tokens(text: str, settings: Settings) -> Iterator[Span]:
    for m in _TOKEN.finditer(text):
        if random_looking(m[0]):
            yield m.start(), m.end(), None


_PATH = re.compile(r"""(?<![^\s"'`(=:,])/[A-Za-z0-9._\-]{1,255}(?:/[A-Za-z0-9._\-]{1,255}){0,15}""")


def home_roots(text: str, settings: Settings) -> Iterator[Span]:
    roots = re.compile("|".join(re.escape(r.removesuffix("*")) + ("[^/]+" if r.endswith("/*") else "(?=/|$)") for r in sorted(settings.homes, key=len, reverse=True)))
    for m in _PATH.finditer(text):
        if root := roots.match(m[0]):
            yield m.start(), m.start() + root.end(), None


def disclosed_paths(text: str, settings: Settings) -> Iterator[Span]:
    for m in _PATH.finditer(text):
        if m[0].rstrip("/").count("/") >= 3 and not any(m[0] == a or m[0].startswith(f"{a}/") for a in settings.allowed):
            yield m.start(), m.end(), None


_SCANNERS: dict[str, Callable[[str, Settings], Iterator[Span]]] = {
    "private_key_block": key_blocks, "dsn_secret": dsn_secrets, "dsn_any": dsn_forms, "entropy_token": tokens, "path_home_root": home_roots, "path_disclosure": disclosed_paths
}
_ADMITS: dict[str, Callable[[str], bool]] = {
    "pii_email_ip": lambda t: "@" in t or (quad(t) is not None and not exempt(t)), "pii_identity_kv": lambda t: not exempt(t), "cli_flag_secret": lambda t: not path_shaped(t)
}
#: Rules that leave to others what these would take.
_YIELDS = {"env_assign": ("cli_flag_secret",), "kv_secret_assign": ("cli_flag_secret", "auth_header"), "pii_identity_kv": ("auth_header",)}


# ---------------------------------------------------------------- the table
@dataclass(frozen=True)
class Rule:
    name: str
    pattern: re.Pattern[str] | None = None
    words: tuple[str, ...] = ()
    needs: str = ""
    optional: bool = False
    yields: tuple[Rule, ...] = field(default=(), repr=False)

    def may_match(self, text: str, lower: str) -> bool:
        if not all(c in text for c in self.needs) or (self.words and not any(w in lower for w in self.words)):
            return False
        if self.name in ("private_key_inline", "kv_secret_assign", "pii_identity_kv"):
            return bool(_ASSIGNED.search(text))
        if self.name == "entropy_token":
            return max(map(len, text.split()), default=0) >= 40
        return self.name != "pii_email_ip" or "@" in text or bool(_QUAD.search(text))

    def spans(self, text: str, settings: Settings) -> list[Span]:
        """What the rule takes: neither markers nor what it leaves to others."""
        if self.pattern is None:
            found = list(_SCANNERS[self.name](text, settings))
        else:
            one = self.pattern.groups == 1
            found = [(*m.span(1 if one and m[1] is not None else 0), None) for m in self.pattern.finditer(text)]
            admits = _ADMITS.get(self.name)
            found = [s for s in found if s[0] < s[1] and (admits is None or admits(text[s[0] : s[1]]))]
        if not found:
            return found
        taken = [m.span() for m in MARKER.finditer(text)] if "[REDACTED:" in text or "[SCRUB-TRUNCATED:" in text else []
        lower = text.lower() if self.yields else ""
        taken += [s[:2] for other in self.yields if other.may_match(text, lower) for s in other.spans(text, settings)]
        return [s for s in found if not any(a < s[1] and s[0] < b for a, b in taken)]


def rules(extra: Iterable[tuple[str, str]] = (), mandatory_only: bool = False, disclosure: bool = False) -> list[Rule]:
    """The built-in table, and up to 46 rules of a project after it."""
    extra = list(extra)
    if len(extra) > 46 or any(not re.fullmatch(r"[a-z][a-z0-9_]{2,31}", n) for n, _ in extra):
        raise ValueError("a project has at most 46 rules with names of 3 to 32 lower-case letters, digits and _")
    made: dict[str, Rule] = {}

    def make(name: str) -> Rule:
        pattern = re.compile(PATTERNS[name], re.ASCII) if name in PATTERNS else None
        return Rule(name, pattern, *SIGNS.get(name, ((), "")), optional=name in ORDER[MANDATORY:], yields=tuple(made.setdefault(o, make(o)) for o in _YIELDS.get(name, ())))

    names = ORDER[:MANDATORY] if mandatory_only else ORDER if disclosure else ORDER[:-1]
    return [*(make(n) for n in names), *(Rule(n, re.compile(p, re.ASCII), optional=True) for n, p in extra)]


def may_hold(text: str, lower: str, words: tuple[str, ...]) -> bool:
    """Whether any rule could find something: one of the words, an address, or a long run without blanks."""
    return any(w in lower for w in words) or "@" in text or bool(_QUAD.search(text)) or max(map(len, text.split()), default=0) >= 40


def words_of(table: list[Rule]) -> tuple[str, ...] | None:
    """The words of all rules of a table; None if one of them has no words, so that every text is looked at."""
    if any(not r.words and r.name not in ("entropy_token", "pii_email_ip") for r in table):
        return None
    return tuple(dict.fromkeys(w for r in table for w in r.words))


def redact(text: str, table: list[Rule], settings: Settings = Settings(), optional: bool = True) -> tuple[str, dict[str, int]]:
    """The text with markers, and how often each rule replaced something; without optional rules for headers and DSNs."""
    found: Counter[str] = Counter()
    for i, key in enumerate(settings.public_keys):
        text = text.replace(key, f"\0S{i}\0")
    lower = text.lower()
    for rule in table:
        if (rule.optional and not optional) or not rule.may_match(text, lower):
            continue
        spans = rule.spans(text, settings)
        if spans:
            out, at = [], 0
            for a, b, instead in spans:
                out += [text[at:a], instead or f"[REDACTED:{rule.name}]"]
                at = b
            text = "".join([*out, text[at:]])
            lower = text.lower()
            found[rule.name] += len(spans)
    for i, key in enumerate(settings.public_keys):
        text = text.replace(f"\0S{i}\0", key)
    return text, dict(found)


def within_budget(text: str, budget: int) -> tuple[str, str]:
    """What of a text is redacted, and the mark for the rest: a text over the budget is cut after its last line feed within it."""
    raw = text.encode() if 4 * len(text) > budget else b""
    if len(raw) <= budget:
        return text, ""
    head = raw[: raw.rfind(b"\n", 0, budget) + 1]
    return head.decode(), f"[SCRUB-TRUNCATED:{len(raw) - len(head)}]"


# ---------------------------------------------------------------- columns
_RESULT = "text string, redactions int, by_rule map<string,int>, error string"


def redacted(c: Column, extra: Iterable[tuple[str, str]] = (), budget: int = 262_144, settings: Settings = Settings(), disclosure: bool = False) -> Column:
    """struct<text, redactions, by_rule, error>. A text over the budget is cut at a line end and marked; null stays null."""
    table = rules(extra, disclosure=disclosure)
    words = words_of(table)

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            # what stays as it is comes back as null, so it isn't copied again
            if text is None or (len(text) < budget // 4 and words is not None and not may_hold(text, text.lower(), words)):
                out.append((None, 0, None, None))
                continue
            head, mark = within_budget(text, budget)
            new, found = redact(head, table, settings)
            out.append((new + mark if mark or found else None, sum(found.values()), found or None, None))
        return pd.DataFrame(out, columns=["text", "redactions", "by_rule", "error"])

    done = run(c)
    return F.struct(F.coalesce(done["text"], c).alias("text"), done["redactions"].alias("redactions"), F.coalesce(done["by_rule"], F.expr("cast(map() as map<string,int>)")).alias("by_rule"), done["error"].alias("error"))


#: Classes of fields that optional rules don't look at.
PLAIN_TARGETS = ("header", "dsn")


def redacted_fields(fields: Column, targets: dict[str, str], extra: Iterable[tuple[str, str]] = (), budget: int = 262_144, settings: Settings = Settings()) -> Column:
    """struct<fields, redactions, by_rule> of a map<string,string>: the fields that `targets` names (name to class) are redacted and
    counted together, the others pass as they are; null values stay null."""
    table = rules(extra)

    @F.pandas_udf("fields map<string,string>, redactions int, by_rule map<string,int>")
    def run(maps: pd.Series) -> pd.DataFrame:
        out = []
        for held in maps:
            held = held if held is None else dict(held)
            total: Counter[str] = Counter()
            for name in sorted(held or ()):
                if name in targets and held[name] is not None:
                    head, mark = within_budget(held[name], budget)
                    new, found = redact(head, table, settings, targets[name] not in PLAIN_TARGETS)
                    held[name] = new + mark
                    total.update(found)
            out.append((held, sum(total.values()), dict(total)))
        return pd.DataFrame(out, columns=["fields", "redactions", "by_rule"])

    return run(fields)


def redacted_record(payload: Column, targets: dict[str, str], extra: Iterable[tuple[str, str]] = (), budget: int = 262_144, settings: Settings = Settings()) -> Column:
    """struct<text, redactions, by_rule, error> of a JSON object: the strings at the dotted paths of `targets` are redacted, and
    its key `scrub` says by which rules; what isn't an object stays and is an error."""
    table = rules(extra)

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                held = None if text is None else json.loads(text)
            except ValueError:
                held = False
            if not isinstance(held, dict):
                out.append((text, 0, {}, None if text is None else "not an object"))
                continue
            total: Counter[str] = Counter()
            before = after = 0
            truncated = False
            for path in sorted(targets):
                *way, last = path.split(".")
                place = held
                for step in way:
                    place = place.get(step) if isinstance(place, dict) else None
                if isinstance(place, dict) and isinstance(place.get(last), str):
                    head, mark = within_budget(place[last], budget)
                    new, found = redact(head, table, settings, targets[path] not in PLAIN_TARGETS)
                    before, truncated = before + len(place[last].encode()), truncated or bool(mark)
                    place[last] = new + mark
                    after += len(place[last].encode())
                    total.update(found)
            held["scrub"] = {"by_rule": dict(total), "bytes_in": before, "bytes_out": after, "truncated": truncated}
            out.append((json.dumps(held, ensure_ascii=False, separators=(",", ":")), sum(total.values()), dict(total), None))
        return pd.DataFrame(out, columns=["text", "redactions", "by_rule", "error"])

    return run(payload)


def scrub(df: DataFrame, text: str, extra: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """df with the text redacted and `redactions`, `by_rule`."""
    from ..shipping import ship

    ship(df.sparkSession)
    done = df.withColumn("_r", redacted(F.col(text), list(extra)))
    return done.withColumn(text, F.col("_r.text")).withColumn("redactions", F.col("_r.redactions")).withColumn("by_rule", F.col("_r.by_rule")).drop("_r")


def leaks(c: Column) -> Column:
    """Whether a mandatory rule still finds something: to be checked before a sink."""
    table = rules(mandatory_only=True)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and any(r.may_match(t, low) and bool(r.spans(t, Settings())) for low in [t.lower()] for r in table))

    return run(c)


def by_rule(df: DataFrame) -> DataFrame:
    """Totals of each rule over rows of scrub()."""
    return df.select(F.explode("by_rule").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n"))
