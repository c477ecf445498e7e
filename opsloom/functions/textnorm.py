r"""Text normalisation: ordered masks, line limits, byte budgets at a character's edge.

Patterns are written for Java: `\s` of the source language means [\t\n\f\r ], `$` means the very end, and case
folding goes beyond ASCII only where it is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signature import _BLANK, _text, trimmed

SPACE = r"[\t\n\f\r ]"
#: The ordered masks of a message, of a displayed message and of an error line.
MESSAGE_MASKS = (
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"[0-9a-fA-F]{8,}", "<h>"),
    (r"[0-9]+", "#"),
    (SPACE + "+", " "),
)
DISPLAY_MASKS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"\b\d{6,}\b", "<n>"),
    (r"(?iu)\b(?:pid|tid|thread)[ =:]+(\d+)\b", "pid=<n>"),
    (r"(?iu)\b(?:port|listen)[ =:]+(\d+)\b", "port=<n>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"[0-9a-fA-F]{8,}", "<h>"),
    # no repeated group: it would take a stack frame a segment. A slash after a slash can only begin where the first one failed
    (r"(?<!/)/[A-Za-z0-9._/-]*(?<=/)([A-Za-z0-9._-]+)/*", "$1"),
    (r"/home/[A-Za-z0-9_.-]+", "/home/<user>"),
    (SPACE + "+", " "),
)
LINE_MASKS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "UUID"),
    (r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "TS"),
    (r"(?:(?<![\w./\-])|\G)(?:[\w./\-]*/)?([\w.\-]+\.(?:go|py|js|ts|java|rb|rs|php|cs|c|cpp|h)):\d+(?::\d+)?", "$1:LINE"),
    (r":(?:6[0-9]{4}|[1-9][0-9]{3,4})\b", ":PORT"),
    (r"0x[0-9a-fA-F]{4,}", "0xADDR"),
    (r"goroutine \d+", "goroutine N"),
    (r"(?iu)\bpid[=: ]" + SPACE + r"*\d+", "pid=PID"),
    (r"\b[0-9a-f]{8,}\b", "HEXID"),
    (r"\b\d+(?:\.\d+)?(?:ns|µs|us|ms|s|m|h)\b", "DUR"),
    (r"\b\d{3,}\b", "N"),
    (r"/(?:tmp|var/tmp)/[^\t\n\f\r ]*\d+", "/TMP"),
    (SPACE + "+", " "),
)


def masked(c: Column, masks: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in masks:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(by))
    return c


def byte_cut(c: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, cut where a character begins."""
    raw = c.cast("binary")
    continues = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")
    size = F.lit(most - 3)
    for back in (2, 1, 0):
        size = F.when(continues(most + 1 - back), size).otherwise(F.lit(most - back))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), size), "UTF-8"))


def message_norm(c: Column | str, lines: int = 3, budget: int = 512) -> Column:
    """The first non-blank lines, each masked, within the byte budget."""
    # only as much of the text is looked at as the lines need: blanks before each of them may hold blank lines
    pattern = rf"\A{_BLANK}*+([^\n]*)" + rf"(?:\n{_BLANK}*+([^\n]*))?" * (lines - 1)
    kept = F.filter(F.array(*(F.regexp_extract(_text(c), pattern, i + 1) for i in range(lines))), lambda x: trimmed(x) != "")
    return byte_cut(F.array_join(F.transform(kept, lambda x: trimmed(masked(x, MESSAGE_MASKS))), "\n"), budget)


def mask_message(c: Column | str) -> Column:
    """Display-safe message: times, numbers, ids, paths as base names."""
    return trimmed(masked(_text(c), DISPLAY_MASKS))


def mask_line(c: Column | str, budget: int = 512) -> Column:
    """One error line; the budget cuts raw bytes."""
    out = F.regexp_replace(masked(_text(c), LINE_MASKS), r"[ \t\r\f\x0B]+\z", "")
    return F.when(F.octet_length(out) <= budget, out).otherwise(F.decode(F.substring(out.cast("binary"), 1, budget), "UTF-8"))


def mask_text(c: Column | str) -> Column:
    """Several lines: line ends made one kind, each line trimmed and masked."""
    lines = F.split(F.regexp_replace(_text(c), "\r\n|\r", "\n"), "\n", -1)
    return trimmed(F.array_join(F.transform(lines, lambda x: mask_line(trimmed(x))), "\n"))


def mask_context(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(mask_text(F.substring_index(_text(c), "\n", 1)), SPACE + "+", " "))


def base_name(c: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(_text(c), "/+\\z", ""), "/", -1)


def file_stem(c: Column | str) -> Column:
    """Base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(base_name(c), r"^(.+)\.[^.]*\z", "$1")


def module_of(module: Column | str, file: Column | str) -> Column:
    return F.coalesce(F.nullif(mask_text(module), F.lit("")), file_stem(mask_text(file)))


def kebab(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")


def cut_at_dash(c: Column | str, most: int) -> Column:
    """At most so many characters, back to the last dash that leaves something."""
    head = F.substring(_text(c), 1, most)
    whole = F.regexp_extract(head, "^(.+)-[^-]*\\z", 1)
    return F.when(F.length(_text(c)) <= most, _text(c)).otherwise(F.coalesce(F.nullif(whole, F.lit("")), F.regexp_replace(head, "-+\\z", "")))


def frame_line(frame: Column) -> Column:
    """`app|module|function|file|LINE|context` of struct<filename, function, module, lineno, in_app, context_line>."""
    file = mask_text(frame["filename"])
    return F.concat_ws(
        "|", F.when(frame["in_app"], "app").otherwise("lib"), module_of(frame["module"], frame["filename"]), mask_text(frame["function"]), base_name(file), F.lit("LINE"), mask_context(frame["context_line"])
    )


def frame_lines(frames: Column, most: int = 8) -> Column:
    """Lines of the first frames, and `frames_over=+N` for the rest."""
    shown = F.transform(F.slice(frames, 1, most), frame_line)
    over = F.greatest(F.size(frames) - most, F.lit(0))
    return F.when(over > 0, F.concat(shown, F.array(F.concat(F.lit("frames_over=+"), over.cast("string"))))).otherwise(shown)


def stack_text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def frame_of_line(line: Column) -> Column:
    """The struct that a rendered frame line came from."""
    part = F.split(line, r"\|", -1)
    at = lambda i: F.coalesce(F.get(part, F.lit(i)), F.lit(""))
    return F.struct((at(0) == "app").alias("in_app"), at(1).alias("module"), at(2).alias("function"), at(3).alias("filename"), at(5).alias("context_line"))


def fingerprint(parts: Column, default: Column) -> Column:
    """A given fingerprint with `{{ default }}` expanded, null if it has no part."""
    kept = F.filter(parts, lambda p: trimmed(p) != "")
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda p: F.regexp_replace(trimmed(p), r"\{\{\s*default\s*\}\}", default)), "\n"))


def corpus_terms(c: Column | str, stop: tuple[str, ...] = ("with", "from", "this", "that", "error", "failed"), most: int = 3) -> Column:
    """The first different words of four letters or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9_]{4,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*stop))), 1, most)


def count_terms(text: Column, terms: Column) -> Column:
    """How many of the terms the text contains."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))


def frame_symbol(frame: Column) -> Column:
    """The last name before a bracket or the end."""
    return F.regexp_extract(frame, r"([A-Za-z_][A-Za-z0-9_]*)(?:\(|\z)", 1)


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    chars = F.split(c, "")
    each = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars))
    return F.when(F.length(c) > 0, F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


def chunks(lengths: Column, most: int) -> Column:
    """Group numbers of pieces in order: a piece opens the next group if it doesn't fit; no piece is split."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + n > most)
        group = F.when(full, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.when(full, n).otherwise(acc["used"] + n).alias("used"), group.alias("group"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(F.transform(lengths, lambda n: n.cast("int")), start, step, lambda acc: acc["out"])
