from pyspark.sql import functions as F

from spanlode.functions.paths import resolved
from spanlode.operators.orphans import Reference, orphans
from tests.conftest import rows

CHILD = "ref_id long, parent long"


def chain(spark, parents, kids, grandkids):
    files = spark.createDataFrame([(1,)], "id long")
    notes = spark.createDataFrame(parents, "ref_id long, file long")
    a, b = spark.createDataFrame(kids, CHILD), spark.createDataFrame(grandkids, CHILD)
    return [
        Reference("notes", notes, files, {"file": "id"}, name="file"),
        Reference("kids", a, notes.select(F.col("ref_id").alias("id"), "ref_id"), {"parent": "id"}, parent="notes", name="note"),
        Reference("grandkids", b, a.select(F.col("ref_id").alias("id"), "ref_id"), {"parent": "id"}, parent="kids", name="kid"),
    ]


def test_direct_and_inherited_reach_down(spark):
    got = orphans(chain(spark, [(10, 1), (11, 2), (11, 2)], [(20, 10), (21, 11), (22, 99)], [(30, 20), (31, 21), (32, 22), (33, None)]))
    assert rows(got, "tbl", "ref_id", "orphan") == [
        ("grandkids", 31, "inherited"), ("grandkids", 32, "inherited"), ("grandkids", 33, "direct"), ("kids", 21, "inherited"), ("kids", 22, "direct"), ("notes", 11, "direct"),
    ]


def test_empty_tables(spark):
    assert orphans(chain(spark, [], [], [])).collect() == []
    assert rows(orphans(chain(spark, [], [(1, 2)], [])), "tbl", "orphan") == [("kids", "direct")]


def test_inherited_only_if_all_targets_are_orphans(spark):
    """Name 1 has two definitions, one of them in a lost file; name 2 has two, both lost; name 3 has none."""
    files = spark.createDataFrame([(1,)], "id long")
    defs = spark.createDataFrame([(10, 1, 1), (11, 9, 1), (12, 8, 2), (13, 9, 2)], "ref_id long, file long, name long")
    uses = spark.createDataFrame([(20, 1), (21, 2), (22, 3)], "ref_id long, name long")
    got = orphans([Reference("defs", defs, files, {"file": "id"}), Reference("uses", uses, defs, {"name": "name"}, parent="defs")])
    assert rows(got, "tbl", "ref_id", "orphan") == [("defs", 11, "direct"), ("defs", 12, "direct"), ("defs", 13, "direct"), ("uses", 21, "inherited"), ("uses", 22, "direct")]


def test_cycle_ends(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (4, 3)], CHILD)
    got = orphans([Reference("a", a, a.select(F.col("ref_id").alias("id"), "ref_id"), {"parent": "id"}, parent="a")])
    assert rows(got, "ref_id", "orphan") == [(3, "direct"), (4, "inherited")]


def test_deep_chain_is_followed_to_its_end(spark):
    a = spark.createDataFrame([(i, i - 1) for i in range(1, 54)], CHILD).coalesce(1).cache()
    got = orphans([Reference("a", a, a.select(F.col("ref_id").alias("id"), "ref_id"), {"parent": "id"}, parent="a")])
    assert rows(got, "ref_id", "orphan") == [(1, "direct")] + [(i, "inherited") for i in range(2, 54)]


def test_paths_are_resolved(spark):
    cases = {"./a/b.go": "a/b.go", "a//b.go": "a/b.go", "x/../a/b.go": "a/b.go", "A/b.go": "A/b.go", "../a": "a", "a/./b/../c": "a/c", "": "", None: None}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", resolved(F.col("p")).alias("r"))
    assert {r.p: r.r for r in df.collect()} == cases
