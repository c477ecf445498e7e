"""Content signatures and keys: field cleaning, canonical bytes, SHA-256 names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit and record separators, and the sources that a signature may name.
UNIT, RECORD = "\x1f", "\x1e"
SOURCES = ("sentinel", "journald", "dbus", "psi", "disk", "timers", "inotify", "collector", "generic", "unknown")
#: The field list of each source, in the order in which it is hashed.
SOURCE_FIELDS = {
    "sentinel": ("project", "culprit", "fingerprint"), "journald": ("unit", "message_norm"), "dbus": ("manager", "unit", "state"), "psi": ("scope", "signal", "bucket"), "disk": ("mount", "kind"),
    "timers": ("unit", "kind"), "inotify": ("path", "class"), "collector": ("parser", "class", "message"), "generic": ("project", "app", "message"), "unknown": ("raw",),
}
#: White space that trimming removes: all that Unicode calls white space.
_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), f"^{_BLANK}+|{_BLANK}+\\z", "")


def clean_field(c: Column | str) -> Column:
    """NUL and the separators become blanks, then the edges go."""
    return trimmed(F.translate(_text(c), "\x00\x1f\x1e", "   "))


def canonical(source: Column | str, *fields: Column | str) -> Column:
    """source, the cleaned fields between unit separators, and a record separator."""
    head = F.lit(source) if isinstance(source, str) else source
    joined = F.concat_ws(UNIT, head, *(clean_field(f) for f in fields))
    return F.concat(joined, F.lit(RECORD))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def short(hex_digest: Column) -> Column:
    return F.substring(hex_digest, 1, 16)


def signature(source: Column | str, *fields: Column | str) -> Column:
    """`source:sha256v1:` and 16 hex digits."""
    head = F.lit(source) if isinstance(source, str) else source
    return F.concat(head, F.lit(":sha256v1:"), short(digest(canonical(source, *fields))))


def parsed(sig: Column | str) -> Column:
    """struct<source, digest> of a valid signature, else null."""
    c = _text(sig)
    source = F.regexp_extract(c, r"^([a-z]+):sha256v1:([0-9a-f]{16})\z", 1)
    return F.when(source.isin(*SOURCES), F.struct(source.alias("source"), F.substring_index(c, ":", -1).alias("digest")))


def merge_key(kind: Column | str, subject: Column | str, domain: str = "merge.v1") -> Column:
    """Key under which observations of different sources meet; the domain keeps key families apart."""
    return short(digest(canonical(domain, kind, subject)))


def correlation_key(kind: Column | str, subject: Column | str, taxonomy: Column | str, app_kind: Column | str) -> Column:
    return F.concat(F.lit("ink_"), short(digest(F.concat_ws(UNIT, _text(kind), _text(subject), _text(taxonomy), _text(app_kind)))))


def content_key(kind: Column | str, payload: Column | str, domain: str = "content.v1") -> Column:
    """Idempotency key of a record's content."""
    return F.concat(F.lit("content:sha256v1:"), short(digest(F.concat(F.concat_ws(UNIT, F.lit(domain), _text(kind), _text(payload)), F.lit(RECORD)))))


def signature_key(sig: Column | str, norm: Column | str, host: Column | str) -> Column:
    return F.concat_ws("|", _text(sig), _text(norm), _text(host))


def group_key(digest_: Column | str, merge: Column | str, sig: Column | str) -> Column:
    """The digest, else `mk:` and the merge key, else `sig:` and the signature."""
    some = lambda c: F.nullif(_text(c), F.lit(""))
    return F.coalesce(some(digest_), F.concat(F.lit("mk:"), some(merge)), F.concat(F.lit("sig:"), some(sig)))


def sampled(event_id: Column | str, one_in: int) -> Column:
    """One in n events, decided by the first four bytes of the id's SHA-256."""
    return F.conv(F.substring(digest(_text(event_id)), 1, 8), 16, 10).cast("long") % one_in == 0


def payload_hash(payload: Column | str, least: int = 4096) -> Column:
    """Hash member of payloads of at least `least` bytes, else null."""
    c = _text(payload)
    return F.when(F.octet_length(c) >= least, short(digest(c)))


def stable_id(prefix: str, *seed: Column | str) -> Column:
    """A reproducible identifier: the prefix and 26 characters of the seed's hash."""
    return F.concat(F.lit(prefix), F.upper(F.substring(digest(F.concat_ws(UNIT, *map(_text, seed))), 1, 26)))


def valid_ulid(prefix: str, c: Column | str) -> Column:
    return _text(c).rlike(f"^{prefix}[0-9A-HJKMNP-TV-Z]{{26}}\\z")


def ip_hash(ip: Column | str) -> Column:
    return short(digest(_text(ip)))


def taxonomy_of(text: Column, rules: list[tuple[str, str]], otherwise: str = "error") -> Column:
    """The first rule whose pattern is found names the class."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def canonical_json(fields: Column, order: tuple[str, ...], sorted_lists: tuple[str, ...] = ()) -> Column:
    """JSON of a struct with its members in the given order and the named lists sorted."""
    return F.to_json(F.struct(*((F.array_sort(fields[n]) if n in sorted_lists else fields[n]).alias(n) for n in order)))
