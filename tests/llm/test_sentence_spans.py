import re
from collections import defaultdict

from opsloom.llm import sentence_spans as s


def sentences(text):
    """Lists of words: a sentence ends at a line feed, or at white space after . ! or ?."""
    out, current, before = [], [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        if current and ("\n" in text[before:m.start()] or current[-1][-1] in ".!?"):
            out.append(current)
            current = []
        current.append(m[0])
        before = m.end()
    return out + [current] * bool(current)


def brute(rows):
    """Removed sentences of each row (doc_id, text)."""
    spans = []
    for i, (doc, text) in enumerate(rows):
        own = sentences(text)
        for k in range(len(own)):
            for n in range(k + 1, len(own) + 1):
                words = sum(own[k:n], [])
                if n - k > 1 and len(words) >= s.LEAST_WORDS:
                    spans.append((tuple(words), i, k, n))
                    break
            if len(own[k]) >= s.LONG_WORDS:
                spans.append((tuple(own[k]), i, k, k + 1))
    first = {}
    for words, i, k, _ in spans:
        doc = rows[i][0]
        if doc is not None and (words not in first or first[words] > doc):
            first[words] = doc
    gone, seen = defaultdict(set), set()
    for words, i, k, n in sorted(spans, key=lambda x: (x[1], x[2])):
        doc = rows[i][0]
        if (words, i) in seen or (words in first and (doc is None or doc > first[words])):
            gone[i] |= set(range(k, n))
        seen.add((words, i))
    return [(len(sentences(t)), len(gone[i])) for i, (_, t) in enumerate(rows)]


def test_matches_brute_force(spark, awkward, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = sorted((str(r[0]), *n) for r, n in zip(rows, brute(rows), strict=True))
    for docs in (awkward, clashing):
        assert sorted((str(r.doc_id), r.n_sentences, r.n_removed) for r in s.deduplicated(docs).collect()) == want
    assert s.deduplicated(nothing).count() == 0
    few = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in s.deduplicated(spark.createDataFrame(few, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in few] == brute(few)


def test_passages_go_and_clean_text_stays(spark):
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    line = lambda tag, *sizes: " ".join(" ".join(words(f"{tag}{k}x", n)) + "." for k, n in enumerate(sizes))
    passages = [line("p", 26, 26), line("q", 51), line("r", 10, 10, 10, 10, 11), line("s", 17, 17, 18)]
    texts = [f"{line(f'a{i}{k}', 12, 9)}\n{p}\n{line(f'b{i}{k}', 8, 30)}" for k, p in enumerate(passages) for i in range(3)]
    rows = s.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        p = passages[r.doc_id // 3]
        assert (p in r.text) == (r.doc_id % 3 == 0)
        assert r.text == texts[r.doc_id] if r.doc_id % 3 == 0 else r.text == texts[r.doc_id].replace(p + "\n", "")


def all_runs(rows):
    """Removed sentences of each row (doc_id, text): every run of two or more sentences with enough words, long sentences and whole short documents."""
    found = []
    for i, (_, text) in enumerate(rows):
        own = sentences(text)
        runs = [(k, n) for k in range(len(own)) for n in range(k + 1, len(own) + 1) if sum(map(len, own[k:n])) >= (s.LEAST_WORDS if n - k > 1 else s.LONG_WORDS)]
        found += [(tuple(sum(own[k:n], [])), i, k, n) for k, n in runs or [(0, len(own))] * bool(own)]
    least = {}
    for words, i, _, _ in found:
        least[words] = min(rows[i][0], least.get(words, rows[i][0]))
    gone, seen = defaultdict(set), set()
    for words, i, k, n in sorted(found, key=lambda x: (x[1], x[2])):
        if (words, i) in seen or rows[i][0] > least[words]:
            gone[i] |= set(range(k, n))
        seen.add((words, i))
    return {rows[i][0]: (len(sentences(t)), len(gone[i])) for i, (_, t) in enumerate(rows)}


def test_query_removes_every_repeated_run(spark, tmp_path):
    from opsloom.llm import queries

    line = lambda tag, *sizes: " ".join(" ".join(f"{tag}{k}x{i}" for i in range(n)) + "." for k, n in enumerate(sizes))
    passages = [line("p", 30, 15, 9), line("q", 14, 14, 14, 10), line("r", 10, 10, 10), line("s", 5, 40, 3, 3)]
    texts = [f"{line(f'a{i}{k}', 12, 9)}\n{p}\n{line(f'b{i}{k}', 8, 30)}" for k, p in enumerate(passages) for i in range(3)]
    texts += [f"{line(f'c{i}', 12, 9)}\n{passages[0]}" for i in range(2)] + [line("t", 20, 20, 4)] * 2 + [line("u", 6, 7)] * 2 + [line("v", 30)] * 2 + [line("w", 3), ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_sentence_spans(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in rows} == all_runs(list(enumerate(texts)))
    by = {r.doc_id: r.text for r in rows}
    for i in range(12):
        p = passages[i // 3]
        assert by[i] == (texts[i] if i % 3 == 0 else texts[i].replace(p + "\n", ""))
    assert [by[i] for i in (14, 16, 18)] == texts[14:20:2] and [by[i] for i in (15, 17, 19)] == [""] * 3


def test_query_on_the_smallest_tables(spark, tmp_path):
    from opsloom.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = [(d, t) for d, t in docs if len(sentences(t)) <= 60]  # all runs of the others are many
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in queries.op5_sentence_spans(spark, str(tmp_path)).collect()}
    assert got == all_runs(docs)


def test_patterned_passages_differ(spark):
    from opsloom.llm import sentence_spans

    from .conftest import thue_morse

    x, y = (" ".join(t) + "." for t in thue_morse("red", "blue", 512))
    rows = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sentence_spans.deduplicated(rows, both_ends=True).collect()} == {1: 0, 2: 0, 3: 1}
