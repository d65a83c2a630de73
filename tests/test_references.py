from datetime import datetime

from corvina.operators.references import Reference, count_orphans, find_orphans

REF = Reference("child.parent_id", ("parent_id",), ("id",), "parent")
NUMBERED = Reference("child.pair", ("parent_id", "n"), ("parent_id", "n"))
T = [datetime(2020, 1, d) for d in range(1, 6)]
CHILD = "id string, parent_id string, n int, created_at timestamp_ntz, extra string"
PARENT = "id string, created_at timestamp_ntz, extra string"


def rows(df):
    return sorted((r.child_id, r.status) for r in df.collect())


def test_statuses(spark):
    child = spark.createDataFrame(
        [
            ("a", " P1 ", 1, T[2], "x"),  # there
            ("b", "p2", 1, T[0], "x"),  # the parent came later
            ("c", "p3", 1, T[2], "x"),  # deleted
            ("d", "p4", 1, T[2], "x"),  # missing
            ("d", "p4", 1, T[2], "x"),  # delivered twice
            ("e", None, 1, T[2], "x"),  # no reference
            ("f", "p5", 1, T[2], "x"),  # deleted, then loaded again
            ("g", "p2", 1, None, "x"),  # time unknown
            ("h", "", 1, T[2], "x"),  # blank keys are keys
        ],
        CHILD,
    )
    parent = spark.createDataFrame([("p1", T[1], "y"), ("P2", T[3], "y"), ("p2", T[2], "y"), ("p5", T[0], "y")], PARENT)
    gone = spark.createDataFrame([("parent", "P3"), ("parent", "p5"), ("other", "p4")], "table_name string, record_id string")
    found = find_orphans(child, parent, REF, deletions=gone)
    assert rows(found) == [("b", "late"), ("c", "deleted"), ("d", "missing"), ("h", "missing")]
    assert {(r.month, r.status, r.n_rows) for r in count_orphans(found).collect()} == {("2020-01", "late", 1), ("2020-01", "deleted", 1), ("2020-01", "missing", 2)}


def test_pairs_and_empty(spark):
    child = spark.createDataFrame([("a", "p1", 1, T[2], ""), ("b", "p1", 2, T[2], ""), ("c", "p1", None, T[2], "")], CHILD)
    parent = spark.createDataFrame([("P1 ", 1, T[0])], "parent_id string, n int, created_at timestamp_ntz")
    assert rows(find_orphans(child, parent, NUMBERED)) == [("b", "missing")]
    assert rows(find_orphans(child.limit(0), parent, NUMBERED)) == []
    assert len(rows(find_orphans(child, parent.limit(0), NUMBERED))) == 2


def test_hot_key(spark):
    """One key that most rows share gives the same as a key of its own for each row."""
    child = spark.range(3000).selectExpr(
        "cast(id as string) as id", "if(id % 3 = 0, 'hot', concat('k', id)) as parent_id", "1 as n", "timestamp_ntz'2020-01-03' as created_at", "'' as extra"
    )
    parent = spark.range(3000).where("id % 2 = 0").selectExpr("concat('k', id) as id", "timestamp_ntz'2020-01-01' as created_at")
    found = {r.child_id for r in find_orphans(child, parent, REF).collect()}
    assert found == {str(i) for i in range(3000) if i % 3 == 0 or i % 2 == 1}
