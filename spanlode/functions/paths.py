"""Path expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved(path: Column) -> Column:
    """``path`` without ``.``, empty segments and what ``..`` takes back; case is kept. Null stays null.

    A ``..`` with nothing to take back is dropped, so a path never leaves its root.
    """
    steps = F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s != "..", F.concat(done, F.array(s))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))),
    )
    return F.when(path.isNotNull(), F.array_join(kept, "/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The part before the last slash; ``.`` for a file in the root."""
    cut = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(cut == "", F.lit(".")).otherwise(cut)


def ancestors(path: Column) -> Column:
    """All directories that hold the path, from the outermost; none for a file in the root."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.array_join(F.slice(steps, 1, F.least(n, F.size(steps) - 1)), "/"))


def shortened(path: Column, most: int) -> Column:
    """At most ``most`` characters: a third from the beginning, dots, and the end."""
    head = most // 3
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.left(path, F.lit(head)), F.lit("..."), F.right(path, F.lit(most - head - 3))))


def node_name(text: Column) -> Column:
    """Letters, digits and underscores only, not beginning with a digit; ``node`` for an empty text."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9]", "_")
    return F.when(plain == "", "node").when(plain.rlike("^[0-9]"), F.concat(F.lit("n"), plain)).otherwise(plain)


def symbol_of_node(node: Column) -> Column:
    """The name in a node's id path:name:line; the whole of an id that isn't one."""
    parts = F.split(node, ":")
    return F.when(F.size(parts) > 2, F.get(parts, F.size(parts) - 2)).otherwise(node)
