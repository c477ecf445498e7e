"""DuckDB SQL for those queries of the ten operators that SQL can express."""

from __future__ import annotations

OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND (p.page_id IS NULL OR p.page_id > f.first_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND (p.page_id IS NULL OR p.page_id > f.first_id) THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

#: Windows as joined words: one equality join for each window length that occurs.
OP4 = r"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), hits AS (
  SELECT d.doc_id, d.i, win.n, win.item
  FROM (SELECT doc_id, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS k FROM docs, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - l.n + 2)) AS r(i)) AS d
  JOIN win ON d.n = win.n AND d.k = win.k
), words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS r(j) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY 1)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Components of a similarity of 0.8 or more between multisets of five-word shingles (5 o >= 4 (m + n - o) for an overlap o).
OP1 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, array_to_string(w[i:i + 4], ' ') AS g, count(*) AS c FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0 GROUP BY 1, 2),
n AS (SELECT r, sum(c) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS u, b.r AS v, sum(least(a.c, b.c)) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n AS x ON x.r = u JOIN n AS y ON y.r = v WHERE 9 * o >= 4 * (x.n + y.n)),
l AS (SELECT r, r AS label FROM d UNION SELECT e.v, l.label FROM l JOIN e ON e.u = l.r),
m AS (SELECT r, min(label) AS label FROM l GROUP BY 1),
k AS (SELECT label, min(doc_id) AS class_id, count(*) AS class_size FROM m JOIN d USING (r) GROUP BY 1)
SELECT doc_id, class_id, class_size FROM d JOIN m USING (r) JOIN k USING (label)
"""

#: Sizes and targets; sources are filled in the order in which they reach three times their size, and the rest shares what is left by weight.
TARGETS6 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s),
q AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(weight) OVER (ORDER BY 3.0 * source_size / weight, weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
a AS (SELECT arg_min((total - filled)::DOUBLE / rest, 3.0 * source_size / weight) FILTER (WHERE (total - filled)::DOUBLE / rest <= 3.0 * source_size / weight) AS share FROM q)
SELECT doc_id, size, source_size, round(least(3.0 * source_size, share * weight), 6)::DOUBLE AS target FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source, a
"""

#: Spans of the kinds that the contract fixes: gaps and matches alternate, so starts are sums of their lengths.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return (
        f"SELECT r, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b, length(ms[i]) AS n "
        f"FROM (SELECT r, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs FROM d), unnest(range(1, len(ms) + 1)) AS u(i) WHERE length(gs[i]) >= {least}"
    )


BASE8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans(0, 'assign', _ASSIGN, 2, 8)} UNION ALL {_spans(1, 'access', 'AKIA[A-Z0-9]+', 0, 16)} UNION ALL {_spans(2, 'hex', '[0-9a-f]+', 0, 32)}),
g AS (SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, string_agg(kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT, ',' ORDER BY b, rank) AS base FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)
"""

#: The five counts and the base verdict; windows of three words are told apart by their words.
OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i:i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM h, unnest(range(0, 3)) AS u(j) GROUP BY 1),
l AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN l USING (r) LEFT JOIN p USING (r)
"""

#: Windows of 200 bytes as digests of their hexadecimal text; runs of their starts are the removed spans.
OP10 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, n - 199)) AS u(i) WHERE n >= 200),
c AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
m AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM c)),
s AS (SELECT r, run, min(i) AS b, max(i) + 200 AS e FROM m GROUP BY 1, 2),
g AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS prev FROM s),
t AS (SELECT r, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, string_agg(substr(h, 2 * prev + 1, 2 * (b - prev)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM g JOIN d USING (r) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""

ORACLES: dict[str, str] = {
    "op1_near_dedup": OP1, "op3_warc": OP3, "op4_decontamination": OP4, "op10_suffix_array": OP10,
    "targets6_mixing": TARGETS6, "base8_secrets": BASE8, "counts9_quality_rules": OP9,
}
