"""What an observation is about: subjects, titles, kinds, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classify, textnorm
from .signature import _text, trimmed

#: Suffixes of units, and how long a subject and a slug may be.
UNIT_SUFFIXES = ("service", "timer", "socket", "scope", "target", "mount", "device", "path")
SUBJECT_CHARS, SLUG_CHARS = 40, 64
#: Which fact names the subject of each source.
FACTS = {"journald": ("unit",), "dbus": ("object_path", "unit"), "sentinel": ("project",), "collector": ("app",), "disk": ("mount",), "inotify": ("path",), "timers": ("unit",), "psi": ("scope",)}


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def subject(source: Column, facts: dict[str, Column], origin: Column, given: Column | None = None) -> Column:
    """A given subject, else the source's fact, else what follows the first colon of the origin."""
    read = {"object_path": classify.unit_of_object_path, "path": textnorm.base_name}
    out = F.coalesce(*(_some(given) for given in [given] if given is not None), F.lit(None).cast("string"))
    for name, wanted in FACTS.items():
        found = F.coalesce(*(_some(read.get(w, _text)(facts[w])) for w in wanted if w in facts), F.lit(None).cast("string"))
        out = F.coalesce(out, F.when(source == name, found))
    return F.coalesce(out, F.regexp_extract(_text(origin), "^[^:]*:(.+)", 1))


def kebab_subject(raw: Column, app_kind: Column) -> Column:
    """A subject for slugs: a container's id gives way to the kind, a unit loses its suffix and its instance."""
    s = trimmed(raw)
    plain = F.regexp_replace(s, rf"(?i)\.(?:{'|'.join(UNIT_SUFFIXES)})\z", "")
    named = textnorm.cut_at_dash(textnorm.kebab(classify.collapse_instance(plain)), SUBJECT_CHARS)
    return F.when(s.rlike(r"^[0-9a-f]{12,64}\z"), F.coalesce(_some(app_kind), F.lit("container"))).otherwise(named)


def app_kind(given: Column, origin: Column, unit: Column, source: Column, markers: tuple[str, ...] = ()) -> Column:
    """A given kind, else container by a marker in the origin, else unit, script or unknown by source."""
    low = F.lower(_text(origin))
    container = F.lit(False)
    for m in (*markers, "docker", "podman", "containerd"):
        container |= F.contains(low, F.lit(m.lower()))
    by_source = classify.chosen(source, [(("journald", "dbus", "timers"), "unit"), (("collector", "generic"), "script")], "unknown")
    return F.coalesce(_some(given), F.when(container, "container"), F.when(_text(unit) != "", "unit"), by_source)


def facts_text(message: Column, stack: Column, sig: Column) -> Column:
    """What a classifier reads: the message, the first line of the stack that isn't blank, and the signature."""
    top = F.get(F.filter(F.transform(F.split(_text(stack), "\n", -1), trimmed), lambda line: line != ""), F.lit(0))
    return F.concat_ws("\n", _text(message), F.when(_text(stack) != "", F.coalesce(top, F.lit(""))), _some(_text(sig)))


def slug(source: Column, subject_: Column, taxonomy: Column, listed: Column) -> Column:
    """A listed slug, else subject and class, else the class unless it is the general one, else `unknown`."""
    composed = F.when(subject_ != "", F.concat_ws("-", subject_, textnorm.kebab(taxonomy))).when(~taxonomy.isin("", "error"), taxonomy).otherwise("unknown")
    return textnorm.cut_at_dash(textnorm.kebab(F.coalesce(listed, composed)), SLUG_CHARS)


def merge_subject_of(source: Column, raw: Column, aliases: Column) -> Column:
    """A unit's name, an application's unit by the alias map (else its project), a resource as it is."""
    kind = classify.source_class(source)
    alias = _some(F.try_element_at(aliases, raw))
    app = F.when(alias.isNotNull(), F.concat(F.lit("unit:"), alias)).when(raw == "", "").otherwise(F.concat(F.lit("project:"), raw))
    return F.when(kind == "unit", trimmed(raw)).when(kind == "app", app).otherwise(raw)


def subject_line(identifier: Column, message: Column) -> Column:
    """`identifier: message`, or the one that there is."""
    return F.concat_ws(": ", _some(trimmed(identifier)), _some(_text(message)))


def title(culprit: Column, message: Column, exception: Column, level: Column) -> Column:
    """The first of culprit, message and exception that isn't empty, else `level event`; at most 200 bytes."""
    return textnorm.byte_cut(trimmed(F.coalesce(_some(culprit), _some(message), _some(exception), F.concat(_text(level), F.lit(" event")))), 200)


def scalar_text(json: Column, path: str) -> Column:
    """A JSON value as text: strings bare, numbers and booleans as written, null and what isn't there empty."""
    return F.coalesce(F.get_json_object(json, path), F.lit(""))


def is_mutating(module: Column) -> Column:
    """Modules that change something; of some families only one member doesn't."""
    head = F.substring_index(module, ".", 1)
    return F.when(head == "config", ~module.isin("config.get", "config.list")).when(head == "service", module != "service.status").when(head.isin("file", "flow"), module != "file.read").otherwise(False)


def is_canary(source_kind: Column, fingerprint: Column, mark: str = "canary") -> Column:
    return F.coalesce(source_kind == "canary", F.lit(False)) | F.coalesce(F.array_contains(fingerprint, mark), F.lit(False))


def generic_fold_applies(source_kind: Column, no_group: Column, explicit_id: Column, reason: Column) -> Column:
    return (source_kind == "generic") & ~no_group & ~explicit_id & (reason != "spool_replay")


def page_token(token: Column) -> Column:
    """struct<generation, offset, seq> of `generation::offset::seq`; empty is the start, null what isn't a token."""
    p = F.split(token, "::", -1)
    good = (F.size(p) == 3) & p[1].rlike(r"^[0-9]+\z") & p[2].rlike(r"^[0-9]+\z")
    return F.when(good, F.struct(p[0].alias("generation"), p[1].try_cast("long").alias("offset"), p[2].try_cast("long").alias("seq")))
