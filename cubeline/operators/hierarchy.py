"""Roll leaves up into a tree, and flatten the tree in pre-order.

Every prefix of a leaf's path is a node with the sum and the latest time of its leaves.  A
leaf that lacks a field skips that level: the node keeps the level of its own field and hangs
on the last ancestor there is.  Nodes are told apart by field and value.  Leaves without any
field have no node.  There is no grand total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeline.model import FlatGroupsQuery
from cubeline.operators.rollup import exact_sum


def path(levels: list[str]) -> Column:
    """The fields a row has, in order, as (lvl, x)."""
    return F.filter(F.array(*[F.struct(F.lit(i).alias("lvl"), F.col(f"`{g}`").cast("string").alias("x")) for i, g in enumerate(levels)]), lambda e: e["x"].isNotNull())


def nodes(leaves: DataFrame, levels: list[str], scale: int | None = None) -> DataFrame:
    """node (path), value, timestamp, has_children, from leaves with _v and _t: one aggregation of path prefixes."""
    p = leaves.select(path(levels).alias("p"), "_v", "_t").where(F.size("p") > 0)
    each = p.select("p", "_v", "_t", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    return each.groupBy(F.slice("p", 1, F.col("i")).alias("node")).agg(exact_sum(F.col("_v"), scale).alias("value"), F.max("_t").alias("timestamp"), F.max(F.size("p") > F.col("i")).alias("has_children"))


def _at(level: int) -> Column:
    """The node's value of a level, null if it has none."""
    return F.get(F.transform(F.filter("node", lambda e: e["lvl"] == level), lambda e: e["x"]), F.lit(0))


def tree(leaves: DataFrame, levels: list[str], q: FlatGroupsQuery, scale: int | None = None) -> DataFrame:
    """rank, id, $parent_id (array, null at a root), $group_by, $group_level, $is_group_root, the fields, <metric>, timestamp.

    Nodes are numbered below each root apart, and begin where the roots before it end: what is sorted in one
    task is the nodes of one root, and the list of roots.
    """
    n = nodes(leaves, levels, scale)
    word = (lambda c: c) if q.binary_order else (lambda c: F.collate(c, "UNICODE"))
    # ties in the collation are broken by bytes, then by level, so the order is total
    order = F.transform("node", lambda e: F.struct(word(e["x"]).alias("a"), e["x"].alias("b"), e["lvl"].alias("c")))
    n = n.withColumn("_root", F.get("node", F.lit(0)))
    before = Window.orderBy(word(F.col("_root.x")), "_root.x", "_root.lvl").rowsBetween(Window.unboundedPreceding, -1)
    roots = n.groupBy("_root").agg(F.count("*").alias("_n")).select("_root", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # in pre-order, a node's ancestor of a depth is the last node of that depth before it
    below = Window.partitionBy("_root").orderBy(order)
    depth = F.size("node")
    numbered = n.withColumn("_own", F.row_number().over(below))
    seen = below.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ups = [F.last(F.when(depth == k, F.col("_own")), ignorenulls=True).over(seen) for k in range(1, len(levels))]
    numbered = numbered.select("*", F.array(*ups).cast("array<long>").alias("_ups")).join(roots, "_root")
    name = lambda c: F.concat(F.lit(f"{q.id_prefix}-"), c.cast("string"))
    rank = (F.col("_own") + F.col("_before")).cast("int")
    parents = F.when(depth > 1, F.transform(F.slice("_ups", 1, F.greatest(depth - 1, F.lit(0))), lambda r: name(r + F.col("_before"))))
    last = F.element_at("node", -1)
    fields = [_at(i).alias(g) for i, g in enumerate(levels)]
    group = reduce(lambda w, i: w.when(F.col("_l") == i, levels[i]), range(len(levels)), F.when(F.lit(False), F.lit("")))
    return (
        numbered.withColumn("_l", last["lvl"])
        .select(
            rank.alias("rank"), name(rank).alias("id"), parents.alias("$parent_id"), group.alias("$group_by"), F.col("_l").alias("$group_level"),
            F.col("has_children").alias("$is_group_root"), *fields, F.col("value").alias(q.metric), "timestamp",
        ).orderBy("rank")
    )
