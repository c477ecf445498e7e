import re

import corpus_pipeline as c
from opsloom.llm import quality_rules

from .test_decontaminate import brute as contamination
from .test_near_dedup import bag, brute


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in c.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        seen[name] = (before, {r.doc_id: r for r in rows})
        assert len(rows) == len(seen[name][1])
        if name != "mixing":
            assert docs.columns == columns
    before, after = seen["quality_rules"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).where("kept").collect()}
    assert set(after) == want
    before, after = seen["near_duplicates"]
    rows = list(before.items())
    assert set(after) == {d for (d, _), least in zip(rows, brute(rows), strict=True) if d == least}
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = {d: contamination(t, items) for d, t in before.items()}
    assert set(after) == {d for d, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    before, after = seen["pii"]
    assert set(after) == set(before)
    for d, r in after.items():
        assert (r.text == before[d]) or re.search("[0-9@]", before[d])
        assert not re.search(r"@mail\d\.example\.com", r.text)
    before, after = seen["mixing"]
    assert {d: r.size for d, r in after.items()} == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in before.items()}
    assert all(bag(t) for t in before.values())


def test_run_equals_stages(spark):
    rows = c.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken"}


def test_stages_take_awkward_rows(spark, awkward, nothing):
    for name, stage in c.STAGES:
        for docs in (awkward, nothing):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.count() <= docs.count()
            if name != "mixing":
                assert out.columns == docs.columns
