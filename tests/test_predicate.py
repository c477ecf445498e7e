import pytest
from opsloom.plans import predicate as p
from pyspark.sql import functions as F

#: (expression, source, scopes, variables, result or None if it must be refused)
VECTORS = [
    ("some_avg10 >= 35", "psi", ("io",), {"some_avg10": 41.7}, True),
    ('some_avg10 >= 35 and scope in ["io","memory"]', "psi", ("io", "memory"), {"some_avg10": 41.7, "scope": "io"}, True),
    ("free_pct < 10 or inode_free_pct < 10", "disk", (), {"free_pct": 22.0, "inode_free_pct": 30.0}, False),
    ('unit_substate == "failed"', "dbus", (), {"unit_substate": "failed"}, True),
    ('msg ~ "(?i)panic|segfault"', "psi", (), {"msg": "kernel: SEGFAULT in worker"}, True),
    ("not (value > 100)", "psi", (), {"value": 41.7}, True),
    ("count in [1,2,3]", "psi", (), {"count": 3.0}, True),
    ("enabled", "psi", (), {"enabled": True}, True),
    ("full_avg60 >= 5", "psi", ("cpu",), {"full_avg60": 12.0}, None),
    ("value", "psi", (), {"value": 41.7}, None),
    ('release > "1.0"', "sentinel", (), {"release": "2.0"}, None),
    ('some_avg10 >= "35"', "psi", (), {"some_avg10": 41.7}, None),
    ("some_avg10 >= 35 and", "psi", (), {}, None),
    ('msg ~ "([unclosed"', "psi", (), {}, None),
    ("value != 3", "psi", (), {}, False), ("not (value == 3)", "psi", (), {}, True), ("scope in []", "psi", (), {"scope": "io"}, False),
    ("value == 0.3", "psi", (), {"value": 0.1 + 0.2}, True), ("nope == 1", "psi", (), {}, None), ('scope in ["a", 1]', "psi", (), {}, None),
    ("((((((((((((((((((value > 1))))))))))))))))))", "psi", (), {}, None), ("not not enabled", "psi", (), {"enabled": True}, True),
    ('value > 1 or value < 0 and msg == "x"', "psi", (), {"value": 2.0}, True), ('msg ~ "end$"', "psi", (), {"msg": "the end\n"}, False),
    ('msg == "a \\"b\\""', "psi", (), {"msg": 'a "b"'}, True), ("value >= 1 value", "psi", (), {}, None),
]


@pytest.mark.parametrize("text,source,scopes,values,want", VECTORS)
def test_vectors(spark, text, source, scopes, values, want):
    if want is None:
        with pytest.raises(p.PredicateError):
            p.parse(text, source, scopes)
        return
    column = p.compile_predicate(text, source, {k: F.lit(v) for k, v in values.items()}, scopes=scopes)
    assert spark.range(1).select(column.alias("x")).first().x is want


def test_open_names_and_map_binding(spark):
    assert spark.range(1).select(p.compile_predicate("anything == 3 or other", None, {}, open_names=True).alias("x")).first().x is False
    rows = spark.createDataFrame([({"free_pct": "4.5", "mount": "/"},), ({},)], "detail map<string,string>")
    column = p.compile_predicate('free_pct < 10 and mount == "/"', "disk", p.bound("detail", "disk", {}))
    assert [r.x for r in rows.select(column.alias("x")).collect()] == [True, False]


def test_rule_sets(spark, tmp_path):
    (tmp_path / "b.toml").write_text('[[rule]]\nname="full"\nsource="disk"\nseverity="high"\n[[rule.match]]\nfield="free_pct"\nop="<"\nvalue=10\nvalue_type="number"\n')
    (tmp_path / "a.toml").write_text('[[rule]]\nname="io"\nsource="psi"\nfor="1m"\n[[rule.match]]\nfield="scope"\nop="in"\nvalue="io, memory"\n[[rule.match]]\nfield="full_avg60"\nop=">="\nvalue="5"\nvalue_type="number"\n')
    rules = p.load_rules(str(tmp_path))
    assert [r.name for r in rules] == ["io", "full"] and rules[0].inferred_scopes() == ("io", "memory")
    rows = spark.createDataFrame([("disk", 4.0, None, None), ("psi", None, "io", 7.0), ("psi", 4.0, "cpu", 9.0)], "source string, free_pct double, scope string, full_avg60 double")
    assert [r.m for r in rows.select(p.matched(rules).alias("m")).collect()] == [["full"], ["io"], []]
    assert rules[0].fingerprint() != rules[1].fingerprint()
    bad = [rules[0], rules[0], p.Rule("x", "disk", (p.Condition("free_pct", "==", "a", "number"),), cooldown="48h")]
    assert len(p.validate(bad)) == 3
