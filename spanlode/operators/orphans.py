"""References to records that do not exist, found by a fixpoint over the foreign-key graph.

A row is a direct orphan of a reference if the reference's own target is missing. It is an inherited orphan if its
target exists but is itself an orphan; where several rows are its target, if all of them are. The second kind is found
by rounds of semi-joins that go down the graph until a round adds nothing; each round looks only at references whose
targets the last one has made orphans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlode.plans.runtime import cut


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` name a target by ``on`` ({child column: target column}, compared null-safe).

    ``rows`` has the child's column ``ref_id``, those in ``on`` and no others that matter; ``targets`` the target
    columns. ``parent`` is the name of the table whose orphans are handed down along this reference, or "" where the
    target has no references of its own; then ``targets`` must also have ``ref_id`` of the parent's rows.
    """

    child: str
    rows: DataFrame
    targets: DataFrame
    on: dict[str, str]
    parent: str = ""
    name: str = field(default="")


def _renamed(targets: DataFrame, on: dict[str, str], *more: str) -> DataFrame:
    return targets.select(*[F.col(t).alias(f"_t{i}") for i, t in enumerate(on.values())], *more)


def _met(on: dict[str, str]):
    met = F.lit(True)
    for i, c in enumerate(on):
        met &= F.col(c).eqNullSafe(F.col(f"_t{i}"))
    return met


def _same(n: int):
    met = F.lit(True)
    for i in range(n):
        met &= F.col(f"_t{i}").eqNullSafe(F.col(f"_s{i}"))
    return met


def orphans(references: Sequence[Reference]) -> DataFrame:
    """(tbl, ref_id, reason, orphan): every orphan row once per reason.

    ``orphan`` is ``direct`` or ``inherited``; ``reason`` is the reference's name. A row whose key columns are null
    has no target unless the target table has the same nulls. Copies of a row count once, targets may repeat. An empty
    child table gives no rows, an empty target table makes every child row a direct orphan. Cycles end, since a round
    joins only orphans that are new.
    """
    found = None
    for r in references:
        keys = _renamed(r.targets, r.on).distinct()  # one row a key: a key with many targets can't swell the join
        direct = r.rows.select("ref_id", *r.on).join(keys, _met(r.on), "left_anti").select(F.lit(r.child).alias("tbl"), "ref_id", F.lit(r.name or r.child).alias("reason"), F.lit("direct").alias("orphan"))
        found = direct if found is None else found.unionByName(direct)
    found = cut(found.distinct())
    handed = [r for r in references if r.parent]
    fresh = found.select("tbl", "ref_id").distinct()
    while True:
        lately = {r.tbl for r in fresh.select("tbl").distinct().collect()}  # names of tables
        grown, lost = None, found.select("tbl", "ref_id").distinct()
        for r in [r for r in handed if r.parent in lately]:
            of_parent = lambda df: df.where(F.col("tbl") == r.parent).select(F.col("ref_id").alias("_lost"))  # noqa: E731, B023
            gone = r.targets.join(of_parent(fresh), F.col("ref_id") == F.col("_lost"), "left_semi")
            standing = r.targets.join(of_parent(lost), F.col("ref_id") == F.col("_lost"), "left_anti")
            keys = _renamed(gone, r.on).distinct()
            keys = keys.join(_renamed(standing, r.on).distinct().select(*[F.col(f"_t{i}").alias(f"_s{i}") for i in range(len(r.on))]), _same(len(r.on)), "left_anti")
            below = r.rows.select("ref_id", *r.on).join(keys, _met(r.on), "left_semi").select(F.lit(r.child).alias("tbl"), "ref_id", F.lit(r.name or r.child).alias("reason"), F.lit("inherited").alias("orphan"))
            grown = below if grown is None else grown.unionByName(below)
        if grown is None:
            return found
        known = found.select("tbl", "ref_id", "reason")
        grown = cut(grown.distinct().join(known, ["tbl", "ref_id", "reason"], "left_anti"))
        fresh = cut(grown.select("tbl", "ref_id").distinct().join(lost, ["tbl", "ref_id"], "left_anti"))
        found = cut(found.unionByName(grown))
