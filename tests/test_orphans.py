from datetime import datetime

from sparkloom.operators.orphans import Parent, Reference, find_orphans, orphan_report

T = [datetime(2024, m, 1) for m in range(1, 13)]
CHILD = "k string, refs array<string>, recorded_at timestamp_ntz, target_id string, reason string"
PARENT = "id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz, ref_table string"


def found(spark, children, parents):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    return find_orphans([Reference("c", c, "k", "refs", "p")], [Parent("p", p, "id")])


def test_reasons_tidying_and_time(spark):
    children = [
        ("a", [" x1 ", "X1", None, "  ", "x2"], T[4], "clash", "clash"),
        ("a", ["X9"], T[6], None, None),
        ("a", ["X9"], T[3], None, None),  # the earliest row that holds it counts
        ("b", ["X3", "X4"], T[1], None, None),
        ("c", None, T[1], None, None),
        (None, ["X9"], None, None, None),
    ]
    parents = [("X1", T[0], None, "t"), ("X2", T[0], T[5], "t"), ("X2", T[1], None, "t"), ("X3", T[8], None, "t"), ("X4", T[1], None, "t"), (None, T[0], None, "t")]
    got = {tuple(r) for r in found(spark, children, parents).collect()}
    assert got == {
        ("c", "2024-05", "a", "X2", "deleted"),
        ("c", "2024-04", "a", "X9", "missing"),
        ("c", "2024-02", "b", "X3", "late"),
        ("c", None, None, "X9", "missing"),
    }


def test_empty_tables(spark):
    assert found(spark, [], []).count() == 0
    assert [r.reason for r in found(spark, [("a", ["Z"], T[0], None, None)], []).collect()] == ["missing"]


def test_report_and_hot_target(spark):
    children = [(f"k{i}", ["GONE"], T[0], None, None) for i in range(500)] + [("k1", ["GONE"], T[0], None, None)]
    report = orphan_report(found(spark, children, [("A", T[0], None, "t")])).collect()
    assert [(r.ref_month, r.reason, r.n_references, r.n_targets) for r in report] == [("2024-01", "missing", 500, 1)]
