"""Version lineage and containment: walks with a depth cap, nearest values, paths."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .relational import positions
from .selectors import SPATIAL


def walk(edges: DataFrame, starts: DataFrame, depth: int | None, up: bool, distinct: bool = False) -> DataFrame:
    """(start, node, depth): ancestors (``up``) or descendants of the start nodes over edges (parent_id, child_id).

    One row per path, so a diamond gives two; ``distinct`` keeps the least depth of each node. Without a ``depth`` paths go
    as far as there are edges, and none takes a node twice.
    """
    here, there = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    step = edges.select(F.col(here).alias("_at"), F.col(there).alias("_to"))
    first = starts.select(F.col("id").alias("start")).join(step, F.col("start") == F.col("_at")).select("start", F.col("_to").alias("node"), F.lit(1).alias("depth"))
    if depth is None:
        new, seen = ~F.array_contains("seen", F.col("_to")), F.concat("seen", F.array("_to")).alias("seen")
        first = first.where("start <> node").withColumn("seen", F.array("start", "node"))
        more = lambda front: front.join(step, F.col("node") == F.col("_at")).where(new).select("start", F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth"), seen)
        out = levels(first, more, None).drop("seen")
    else:
        out = levels(first, lambda front: front.join(step, F.col("node") == F.col("_at")).select("start", F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth")), depth)
    return out.groupBy("start", "node").agg(F.min("depth").alias("depth")) if distinct else out


def levels(first: DataFrame, following, depth: int | None) -> DataFrame:
    """The rows of the first level and of up to ``depth`` in all, or of all there are, ``following`` making each from the one before.

    Each is written to the shared folder before the next, however many rows it has, until one is empty; the last one
    that the depth allows is read by nothing else and stays lazy.
    """
    done, level = [], first
    for _ in count() if depth is None else range(1, depth):
        level = written(level, "level")
        done.append(level)
        if not level.head(1):
            break
        level = following(level)
    else:
        done.append(level)
    return reduce(DataFrame.unionByName, done)


def nearest_with_value(ancestors: DataFrame, values: DataFrame, order: Column | None = None) -> DataFrame:
    """Per start the value of the nearest ancestor that has one; ties by the least id, or another ``order`` of the rows."""
    rows = ancestors.join(values.where("value IS NOT NULL").withColumnRenamed("id", "node"), "node")
    return rows.groupBy("start").agg(F.min_by("value", F.struct("depth", "node") if order is None else order).alias("value"))


def children_list(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(child_id, parents): the parents of each child with their names, by id."""
    rows = edges.join(names.select(F.col("id").alias("parent_id"), F.col("name")), "parent_id")
    return rows.groupBy("child_id").agg(F.array_sort(F.collect_list(F.struct("parent_id", "name"))).alias("parents"))


def tree_paths(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth, path) from the roots down; a path never takes a node twice."""
    step = edges.select(F.col("parent_id").alias("_at"), F.col("child_id").alias("_to"))
    first = roots.select(F.col("id").alias("node"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"), F.array("id").alias("seen"))

    def following(front):
        rows = front.join(step, F.col("node") == F.col("_at")).where(~F.array_contains("seen", F.col("_to")))
        return rows.select(F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), F.col("_to").cast("string")).alias("path"), F.concat("seen", F.array("_to")).alias("seen"))

    return levels(first, following, depth + 1).select("node", "depth", "path")


def topological_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level, on_cycle, position): an order in which every node comes after all its parents.

    ``level`` is the longest way from a node without parents. Nodes with parents still open are taken level by level,
    as many rounds as the longest way has steps, each over the edges that are left; no path is walked twice. What a cycle
    keeps from ever being ready comes last, one level further than all others, marked ``on_cycle``. ``position`` counts
    from 1 by level, then id.
    """
    open_ = cut_lineage(nodes.select("id").distinct())
    left = cut_lineage(edges.select("parent_id", "child_id").where("parent_id <> child_id").distinct())
    done, level = None, 0
    while open_.head(1):
        blocked = left.select(F.col("child_id").alias("id")).distinct()
        ready = cut_lineage(open_.join(blocked, "id", "left_anti").select("id", F.lit(level).alias("level"), F.lit(False).alias("on_cycle")))
        if not ready.head(1):
            ready = open_.select("id", F.lit(level).alias("level"), F.lit(True).alias("on_cycle"))
            done = ready if done is None else done.unionByName(ready)
            break
        done = ready if done is None else done.unionByName(ready)
        open_ = cut_lineage(open_.join(ready, "id", "left_anti"))
        left = cut_lineage(left.join(ready.select(F.col("id").alias("parent_id")), "parent_id", "left_anti"))
        level += 1
    if done is None:
        return nodes.select("id", F.lit(0).alias("level"), F.lit(False).alias("on_cycle"), F.lit(0).cast("long").alias("position")).limit(0)
    return positions(done, ["level", "id"])


def traverse(tree: DataFrame, kind: str, starts: DataFrame, types: DataFrame | None = None, depth: int = 32) -> DataFrame:
    """(start, node, depth) of a containment tree (parent_id, child_id) for ids ``starts`` (id).

    ``parent`` and ``children`` are one step, ``ancestors`` and ``descendants`` up to ``depth``; ``storey_of`` and
    ``building_of`` are the nearest ancestor of that type (types: id, entity), ``products_in`` the descendants that are
    products. Starts that lead nowhere give no row.
    """
    if kind in ("parent", "children"):
        return walk(tree, starts, 1, up=kind == "parent")
    if kind in ("ancestors", "descendants"):
        return walk(tree, starts, depth, up=kind == "ancestors", distinct=True)
    if types is None:
        raise ValueError(f"{kind} needs the types of the nodes")
    named = types.select(F.col("id").alias("node"), "entity")
    if kind == "products_in":
        return walk(tree, starts, depth, up=False, distinct=True).join(named.where(~F.col("entity").isin(*SPATIAL)), "node").select("start", "node", "depth")
    entity = {"storey_of": "IfcBuildingStorey", "building_of": "IfcBuilding"}.get(kind)
    if entity is None:
        raise ValueError(f"no such traversal: {kind!r}")
    of_type = named.where(F.col("entity") == entity).select(F.col("node").alias("parent_id"), F.lit(True).alias("_found")).distinct()
    step = tree.join(of_type, "parent_id", "left").select(F.col("child_id").alias("_at"), F.col("parent_id").alias("_to"), F.coalesce("_found", F.lit(False)).alias("found"))
    first = starts.select(F.col("id").alias("start")).join(step, F.col("start") == F.col("_at")).select("start", F.col("_to").alias("node"), F.lit(1).alias("depth"), "found")
    # a way ends at the first node of the type: what lies beyond is further than that
    more = lambda front: front.where(~F.col("found")).drop("found").join(step, F.col("node") == F.col("_at")).select("start", F.col("_to").alias("node"), (F.col("depth") + 1).alias("depth"), "found")
    up = levels(first, more, depth).where("found")
    return up.groupBy("start").agg(F.min(F.struct("depth", "node")).alias("n")).select("start", "n.node", "n.depth")


def subset_with_ancestors(tree: DataFrame, kept: DataFrame, dropped: DataFrame, depth: int) -> DataFrame:
    """(id, parent_id) of kept nodes and their ancestors; dropped ancestors are skipped, children hang on the next one kept."""
    ups = walk(tree, kept, depth, up=True)
    closure = kept.select("id").union(ups.select(F.col("node").alias("id"))).distinct().join(dropped.select("id"), "id", "left_anti")
    chain = walk(tree, closure, depth, up=True).join(dropped.select(F.col("id").alias("node")), "node", "left_anti")
    parent = chain.groupBy("start").agg(F.min_by("node", F.struct("depth", "node")).alias("parent_id"))
    return closure.join(parent.withColumnRenamed("start", "id"), "id", "left")


def consecutive(df: DataFrame, group: list[str], order: list, key: str) -> DataFrame:
    """(from, to) of neighbours within a group, by an order made total."""
    nxt = F.lead(key).over(Window.partitionBy(*group).orderBy(*order))
    return df.select(*group, F.col(key).alias("from_id"), nxt.alias("to_id")).where("to_id IS NOT NULL")
