"""PII (7): format-preserving Feistel pseudonyms, DataFrame and SQL functions only.

A text is split at the matches of one pattern; every match is validated (Luhn for cards,
mod 97 for IBANs, octets, calendar days, number ranges) and, if valid, replaced by the value
that a keyed Feistel network assigns to it within the same format, so equal values stay equal
in every document and different values stay different. Digits are permuted as two halves of a
mixed-radix number, so no cycle walking is needed: a card keeps its length, separators and a
right check digit, a date becomes another day of the same 400-year cycle in the same notation.
E-mail addresses, which aren't numbers, become keyed addresses of the reserved domain.

A match that fails may hide a valid value (a card before an expiry date, an IBAN before a word in
capitals). Texts with such a match are split at a pattern of their own valid values instead,
which come from candidates of every length at every place.

Edge cases: a null text stays null, an empty one empty; a value that fails its validation is
left alone, but for valid values inside it; all other columns pass unchanged, whatever their names; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_scans, unused

#: The session's setting with the secret (Spark redacts settings of such names), and what stands in for it in demonstrations and tests:
#: pseudonyms made with that can be reversed by anyone who reads this file.
SECRET, DEMONSTRATION = "spark.opsloom.pii.secret", "opsloom"
_SHOWN = "pii-[0-9a-f]{64}"
ROUNDS = 8
#: Kinds and their patterns, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}-])[\p{L}\p{N}.-]*(?<!\.)\.\p{L}{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "day": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\1[0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9]|[0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{3,4}){1,2}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What must stand before and after a value of these kinds, and its forms, one for each length that
#: a greedy match may overrun; \\2 because a candidate is the first group.
_FORMS = {
    "iban": (r"(?<![A-Za-z0-9])", [rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n in range(30, 10, -1)], r"(?![A-Za-z0-9])"),
    "day": (r"(?<![0-9./-])", [r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2[0-9]{4}"], r"(?![0-9]|[./-][0-9])"),
    "ip": (r"(?<![0-9]|[0-9]\.)", [r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"], r"(?!\.?[0-9])"),
    "ssn": (r"(?<![0-9-])", [r"[0-9]{3}-[0-9]{2}-[0-9]{4}"], r"(?![0-9]|-[0-9])"),
    "card": (r"(?<![0-9])", [rf"[0-9](?:[ -]?[0-9]){{{n}}}" for n in range(18, 11, -1)], r"(?![0-9])"),
    "phone": (
        r"(?<![0-9+])",
        [
            *(rf"(?:\+[0-9]{{1,3}}[ .-]?)?\([0-9]{{2,4}}\)[ .-]?[0-9]{{3,4}}(?:[ .-]?[0-9]{{3,4}}){{{n}}}" for n in (2, 1)),
            r"(?:\+[0-9]{1,3}[ .-]?)?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
            *(rf"\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{{n}}}" for n in (4, 3, 2)),
        ],
        r"(?![0-9])",
    ),
}
_MAYBE = r"@|[0-9][0-9. ()/-]{5,}[0-9]|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _feistel(kind: str, key: str, left: str, right: str, a: str, b: str, tweak: str = "''") -> str:
    """SQL for struct<l, r>: a keyed permutation of the pairs in [0, a) x [0, b)."""

    def draw(part: str, modulus: str) -> str:
        return f"pmod(cast(conv(substr(sha2(concat('{key}|{kind}|', {tweak}, '|', i, '|', {part}), 256), 1, 15), 16, 10) as bigint), {modulus})"

    step = f"named_struct('l', if(i % 2 = 1, pmod(s.l + {draw('s.r', a)}, {a}), s.l), 'r', if(i % 2 = 0, pmod(s.r + {draw('s.l', b)}, {b}), s.r))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step})"


def _digits(kind: str, key: str, digits: str) -> str:
    """SQL for a permuted string of as many digits (2 to 36)."""
    power = lambda n: f"cast(concat('1', repeat('0', {n})) as bigint)"
    left, right = "cast(ceil(length(ds) / 2) as int)", "cast(floor(length(ds) / 2) as int)"
    pair = _feistel(kind, key, f"substr(ds, 1, {left})", f"substr(ds, {left} + 1)", power(left), power(right), "length(ds)")
    return _let("ds", digits, _let("f", pair, f"concat(lpad(cast(f.l as string), {left}, '0'), lpad(cast(f.r as string), {right}, '0'))"))


def _filled(shape: str, digits: str) -> str:
    """SQL: the characters of shape with its digits replaced in order."""
    chars = "sequence(1, length(sh))"
    seen = "length(regexp_replace(substr(sh, 1, c), '[^0-9]', ''))"
    return _let("sh", shape, _let("nd", digits, f"array_join(transform({chars}, c -> if(substr(sh, c, 1) between '0' and '9', substr(nd, {seen}, 1), substr(sh, c, 1))), '')"))


def _luhn(digits: str, double_last: bool) -> str:
    """SQL for the Luhn sum; double_last if the check digit is still to come."""
    d = "cast(substr(ln, c, 1) as int)"
    doubled = f"((length(ln) - c) % 2 = {0 if double_last else 1})"
    return _let("ln", digits, f"aggregate(sequence(1, length(ln)), 0, (acc, c) -> acc + if({doubled}, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))")


def _mod97(text: str) -> str:
    """SQL for the remainder of a text of digits and letters (A is 10) by 97."""
    ch = "substr(mt, c, 1)"
    value = f"if({ch} between '0' and '9', cast({ch} as int), ascii({ch}) - 55)"
    return _let("mt", text, f"aggregate(sequence(1, length(mt)), 0, (acc, c) -> (acc * if({ch} between '0' and '9', 10, 100) + {value}) % 97)")


def _email(m: str, key: str) -> str:
    # labels may not be empty; a pattern that says so needs a repeated group, which overflows the stack on long texts
    return f"if(substring_index({m}, '@', -1) like '%..%', null, concat('u', substr(sha2(concat('{key}|email|', lower({m})), 256), 1, 16), '@example.invalid'))"


def _card(m: str, key: str) -> str:
    body = _digits("card", key, "substr(cd, 1, length(cd) - 1)")
    check = f"cast(pmod(10 - pmod({_luhn('pb', True)}, 10), 10) as string)"
    good = f"{_luhn('cd', False)} % 10 = 0 and cd rlike '[1-9]'"
    return _let("cd", f"regexp_replace({m}, '[^0-9]', '')", f"if({good}, {_filled(m, _let('pb', body, f'concat(pb, {check})'))}, null)")


def _iban(m: str, key: str) -> str:
    digits = "regexp_replace(substr(ib, 5), '[^0-9]', '')"
    inner = _filled("substr(ib, 5)", _digits("iban", key, digits))
    check = f"lpad(cast(98 - {_mod97('''concat(bb, substr(ib, 1, 2), '00')''')} as string), 2, '0')"
    whole = _let("bb", inner, f"concat(substr(ib, 1, 2), {check}, bb)")
    # spaces go back where they were: every character of the shape is taken from the new value in order
    seen = "length(replace(substr(sp, 1, c), ' ', ''))"
    spaced = _let("sp", m, _let("nv", whole, f"array_join(transform(sequence(1, length(sp)), c -> if(substr(sp, c, 1) = ' ', ' ', substr(nv, {seen}, 1))), '')"))
    good = f"length({digits}) between 2 and 30 and {_mod97('concat(substr(ib, 5), substr(ib, 1, 4))')} = 1"
    return _let("ib", f"replace({m}, ' ', '')", f"if({good}, {spaced}, null)")


def _ip(m: str, key: str) -> str:
    good = "forall(oc, o -> o <= 255)"
    pair = _feistel("ip", key, "oc[0] * 256 + oc[1]", "oc[2] * 256 + oc[3]", "65536", "65536")
    out = _let("f", pair, "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)")
    return _let("oc", f"transform(split({m}, '[.]'), o -> cast(o as int))", f"if({good}, {out}, null)")


def _ssn(m: str, key: str) -> str:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    good = "sn[0] between 1 and 899 and sn[0] <> 666 and sn[1] > 0 and sn[2] > 0"
    area = "(sn[0] - if(sn[0] > 666, 2, 1))"
    pair = _feistel("ssn", key, f"{area} * 99 + sn[1] - 1", "sn[2] - 1", "88902", "9999")
    back = "f.l div 99 + if(f.l div 99 >= 665, 2, 1)"
    out = _let("f", pair, f"concat(lpad(cast({back} as string), 3, '0'), '-', lpad(cast(f.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(f.r + 1 as string), 4, '0'))")
    return _let("sn", f"transform(split({m}, '-'), o -> cast(o as int))", f"if({good}, {out}, null)")


def _day(m: str, key: str) -> str:
    """Days of 1800 to 2199: 146,097 of them, which is 189 x 773."""
    first = "date'1800-01-01'"
    part = "transform(split(dt, '[./-]'), o -> cast(o as int))"
    year_first = "length(split(dt, '[./-]')[0]) = 4"
    # (year, month, day, order): a two-digit start is day first if that is a day, else month first
    last = lambda y, mo: f"day(last_day(make_date({y}, {mo}, 1)))"
    fits = lambda y, mo, d: f"({y} between 1800 and 2199 and {mo} between 1 and 12 and {d} >= 1 and {d} <= if({mo} between 1 and 12 and {y} between 1800 and 2199, {last(y, f'if({mo} between 1 and 12, {mo}, 1)')}, 0))"
    index = (
        f"case when {year_first} then if({fits('dp[0]', 'dp[1]', 'dp[2]')}, named_struct('n', datediff(make_date(dp[0], dp[1], dp[2]), {first}), 'o', 1), null)"
        f" when {fits('dp[2]', 'dp[1]', 'dp[0]')} then named_struct('n', datediff(make_date(dp[2], dp[1], dp[0]), {first}), 'o', 2)"
        f" when {fits('dp[2]', 'dp[0]', 'dp[1]')} then named_struct('n', datediff(make_date(dp[2], dp[0], dp[1]), {first}), 'o', 3) end"
    )
    pair = _feistel("day", key, "ix.n div 773", "ix.n % 773", "189", "773")
    sep = "regexp_extract(dt, '[./-]', 0)"
    text = lambda a, b, c: f"concat_ws({sep}, date_format(nw, '{a}'), date_format(nw, '{b}'), date_format(nw, '{c}'))"
    out = f"case ix.o when 1 then {text('yyyy', 'MM', 'dd')} when 2 then {text('dd', 'MM', 'yyyy')} else {text('MM', 'dd', 'yyyy')} end"
    moved = _let("f", pair, _let("nw", f"date_add({first}, cast(f.l * 773 + f.r as int))", out))
    return _let("dt", m, _let("dp", part, _let("ix", index, f"if(ix is null, null, {moved})")))


def _phone(m: str, key: str) -> str:
    good = "length(pd) between 8 and 15"
    return _let("pd", f"regexp_replace({m}, '[^0-9]', '')", f"if({good}, {_filled(m, _digits('phone', key, 'pd'))}, null)")


_MAKE = {"email": _email, "iban": _iban, "day": _day, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def _replaced(key: str) -> str:
    """SQL for struct<kind, new> of a match m; new is null if it isn't valid as any kind it looks like."""
    cases = [f"if(m rlike r'^(?:{PATTERNS[k]})$', {_MAKE[k]('m', key)}, null)" for k in KINDS]
    tried = f"array({', '.join(cases)})"
    return _let("tr", tried, "named_struct('kind', array_position(transform(tr, o -> o is not null), true), 'new', coalesce(" + ", ".join(f"tr[{i}]" for i in range(len(KINDS))) + "))")


def _pattern(text: str, key: str) -> str:
    """SQL for a pattern of the e-mail addresses of a text and of exactly those other values in it that are valid.

    Candidates of every form are taken at every place, also inside each other, so none is hidden by
    one that starts earlier or reaches further and isn't valid."""
    kinds = [f"'{PATTERNS['email']}'"]
    for kind, (before, forms, after) in _FORMS.items():
        found = ", ".join(f"regexp_extract_all({text}, r'{before}(?=({form}){after})', 1)" for form in forms)
        good = f"filter(array_distinct(flatten(array({found}))), m -> {_MAKE[kind]('m', key)} is not null)"
        kinds.append(_let("gv", good, f"if(size(gv) = 0, null, concat(r'{before}(?:\\Q', array_join(gv, r'\\E|\\Q'), r'\\E){after}'))"))
    kinds[0] = "r" + kinds[0]
    return f"concat_ws('|', {', '.join(kinds)})"


def secret_of(spark: SparkSession) -> str:
    """The session's secret; without one that of demonstrations, with a warning."""
    secret = spark.conf.get(SECRET, None)
    if not secret:
        warnings.warn(f"{SECRET} isn't set: these pseudonyms are only good for demonstrations", stacklevel=3)
    return secret or DEMONSTRATION


def _hidden_key(spark: SparkSession, secret: str) -> str:
    """What stands in the plan: a digest of the secret, in a form that Spark is told to redact where it shows plans."""
    setting = "spark.sql.redaction.string.regex"
    known = spark.conf.get(setting, None)
    if not known or _SHOWN not in known:
        spark.conf.set(setting, f"{known}|{_SHOWN}" if known else _SHOWN)
    return f"pii-{hashlib.sha256(secret.encode()).hexdigest()}"


def pseudonymised(docs: DataFrame, secret: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the text replaced; `found` names a further column for the array of replaced kinds, in order (it replaces a column of that name)."""
    if not secret:
        raise ValueError("pseudonyms need a secret")
    bound_scans(docs.sparkSession)
    key = _hidden_key(docs.sparkSession, secret)
    column = F.col(text)
    maybe = F.coalesce(column.rlike(_MAYBE), F.lit(False))
    names = unused(docs, "_pii_gaps", "_pii_matches", "_pii_made", "_pii_pattern")
    step = docs.withColumn(names[1], F.when(maybe, F.regexp_extract_all(column, F.lit(_ANY), F.lit(0))))
    made = F.expr(f"transform({names[1]}, m -> {_replaced(key)})")
    step = step.withColumn(names[2], made)
    # a match that isn't valid may hide values that are: such texts are split at their valid values only
    step = step.withColumn(names[3], F.expr(f"if(exists({names[2]}, n -> n.new is null), {_pattern(f'`{text}`', key)}, null)"))
    hidden = F.col(names[3]).isNotNull()
    step = step.withColumn(names[1], F.when(hidden, F.regexp_extract_all(column, F.col(names[3]), F.lit(0))).otherwise(F.col(names[1])))
    step = step.withColumn(names[2], F.when(hidden, made).otherwise(F.col(names[2])))
    step = step.withColumn(names[0], F.when(hidden, F.split(column, F.col(names[3]), -1)).when(maybe, F.split(column, _ANY, -1)))
    joined = F.expr(f"array_join(zip_with({names[0]}, zip_with({names[1]}, {names[2]}, (m, n) -> coalesce(n.new, m)), (g, n) -> concat(g, coalesce(n, ''))), '')")
    out = step.withColumn(text, F.coalesce(joined, column))
    if found:
        kinds = ", ".join(f"'{k}'" for k in KINDS)
        out = out.withColumn(found, F.expr(f"coalesce(transform(filter({names[2]}, n -> n.new is not null), n -> element_at(array({kinds}), cast(n.kind as int))), array())"))
    return out.drop(*names)
