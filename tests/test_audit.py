import math
import random

import pytest

from gainsay.operators import audit, evidence as E, rows as R, verify
from gainsay.plans import discover as D
from gainsay.sources import tables
from tests import brute
from tests.test_dominance import CLASSES, NAMES, SCHEMA, data

DCS = {
    "fd": [("g", "=="), ("s", "!=")], "key": [("g", "=="), ("a", "==")], "two": [("g", "=="), ("s", "!="), ("t", "!=")], "real": [("r", "!="), ("g", "==")],
    "order": [("g", "=="), ("b", "<")], "weak": [("g", "=="), ("s", "!="), ("b", "<=")], "alone": [("a", ">")], "unequal": [("t", "!=")], "nan": [("r", "=="), ("b", ">=")],
    "same": [("g", "=="), ("s", "!=")], "orders": [("g", "=="), ("a", "<"), ("d", ">")], "three": [("g", "=="), ("a", "<"), ("d", ">"), ("id", "<")],
    "never": [("id", "=="), ("s", "!=")],
}


@pytest.mark.parametrize("wide", [1, 3, 8])
def test_all_constraints_at_once(spark, monkeypatch, wide):
    monkeypatch.setattr(audit, "WIDE", wide)
    rows = data(4, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    enc = [tuple(brute.encode(v, c) for v, c in zip(r, CLASSES)) for r in rows]
    listed = spark.createDataFrame([(n, [{"col": c, "op": o} for c, o in dc]) for n, dc in DCS.items()], "denial_constraint string, predicates array<struct<col:string,op:string>>")
    got = {r.denial_constraint: r for r in audit.check_all(df, listed).collect()}
    assert set(got) == set(DCS)
    for name, dc in DCS.items():
        want = len(brute.violating(enc, [(NAMES.index(c), o) for c, o in dc]))
        assert got[name].holds == (want == 0) and (got[name].violations is None if name == "three" else int(got[name].violations) == want), name
    assert audit.check_all(df, listed.limit(0)).collect() == []
    assert all(r.holds for r in audit.check_all(df.limit(1), listed).collect())


def test_sets_are_gathered_under_few():
    sets = {frozenset(s) for s in ("a", "ab", "abc", "cd", "d", "", "efghi", "fg", "xy")}
    tops = audit.gathered(sets, 4)
    assert {s for held in tops.values() for s in held} == sets and all(s <= t for t, held in tops.items() for s in held)
    assert len(tops) == 3 and frozenset("efghi") in tops


@pytest.mark.parametrize("dc", [[("g", "=="), ("s", "!=")], [("g", "=="), ("s", "!="), ("t", "!=")], [("r", "!=")], [("g", "=="), ("r", "!="), ("t", "!=")]], ids=str)
def test_classes_expand_to_the_pairs(spark, dc):
    rows = data(8, 70)
    enc = [tuple(brute.encode(v, c) for v, c in zip(r, CLASSES)) for r in rows]
    want = {(rows[i][0], rows[j][0]) for i, j in brute.violating(enc, [(NAMES.index(c), o) for c, o in dc])}
    got = verify.violation_classes(spark.createDataFrame(rows, SCHEMA).repartition(3), dc, "id").collect()
    pairs = {(x.id, y.id) for x in got for y in got if x.id != y.id and x.group == y.group and all(a != b for a, b in zip(x.classes, y.classes))}
    assert pairs == want and len({r.id for r in got}) == len(got)
    assert all(r.n_partners == sum(p[0] == r.id for p in want) for r in got)


def test_bitmaps_hold_the_supports_of_all_levels(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, r.randint(0, 3), r.choice("abc"), r.choice([1.0, 2.0, math.nan]), r.randint(0, 5)) for i in range(120)],
                               "k int, g int, s string, x double, q int")
    sample = D.sample_table(R.index_rows(df, ["k"]), 1e-2)
    held = [(p.anchor, p.w0, p.cnt) for p in sample.anchored.collect()]
    index = D._index(sample)
    masks = E.all_patterns(index).collect()
    assert sum(bin(m.mask & (2**64 - 1)).count("1") for m in masks) == sum(c > 0 for _, _, c in held)
    seen = 0
    for level in D.lattice_levels(sample, 4):
        for node in level.collect():
            meets = [c for a, w, c in held if a == node.members[0] and all(w & E.allowed_bits(sample.states[m].pred)[1] for m in node.members)]
            assert node.a == 1 + sum(meets)
            seen += 1
    assert seen > 100


def test_cells_and_records_that_do_not_fit(spark, tmp_path):
    typed = tmp_path / "typed.csv"
    typed.write_text("id(Integer),name(String),price(Double)\n1,'a',1.5\nx,'b',2\n3,'c','cheap'\n,'d',\n")
    assert sorted(map(tuple, tables.typed_csv_rejects(spark, str(typed)).collect())) == [("id", "bigint", "x"), ("price", "double", "cheap")]
    assert tables.read_typed_csv(spark, str(typed)).count() == 4
    plain = tmp_path / "plain.csv"
    plain.write_text("1,2.5\nx,1\n1,2,3\n4\n5,6\n")
    schema = "a bigint, b double"
    bad = {r.line: r.cause for r in tables.explicit_csv_rejects(spark, str(plain), schema).collect()}
    assert bad["x,1"] == "empty or unfit: a" and bad["1,2,3"] == "number of fields" and bad["4"] == "empty or unfit: b"
    assert len(tables.read_explicit_csv(spark, str(plain), schema).collect()) == 5 - len(bad)
