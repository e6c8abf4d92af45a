"""Joins, aggregates and winner picks over pairs, values and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import number
from ..session import cut_lineage


def orient_pairs(pairs: DataFrame, source: DataFrame, forced: str | None = None) -> DataFrame:
    """(pos, source, target) of pairs (pos, a, b): a if it is a source, else b if that is, else dropped.

    ``forced`` 'a' or 'b' takes that side without a look.
    """
    if forced:
        other = "b" if forced == "a" else "a"
        return pairs.select("pos", F.col(forced).alias("source"), F.col(other).alias("target"))
    ids = source.select(F.col("guid")).distinct()
    marked = pairs.join(ids.select(F.col("guid").alias("a"), F.lit(True).alias("_a")), "a", "left").join(ids.select(F.col("guid").alias("b"), F.lit(True).alias("_b")), "b", "left")
    out = marked.where("_a OR _b")
    return out.select("pos", F.when(F.col("_a"), F.col("a")).otherwise(F.col("b")).alias("source"), F.when(F.col("_a"), F.col("b")).otherwise(F.col("a")).alias("target"))


def unordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair of different ends once, as (low, high)."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def winners(pairs: DataFrame, group: str, value: str, pos: str, descending: bool = False) -> DataFrame:
    """Per group the row of the winning value: numbers before texts, missing never beats present, ties by ``pos``.

    A group in which nobody has a value is kept whole.
    """
    num = number(F.col(value))
    kind = F.when(num.isNotNull(), 0).otherwise(1)
    w = Window.partitionBy(group)
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    text = F.when(num.isNull(), F.col(value))
    order = [F.col(value).isNull().asc(), turn(kind), turn(num), turn(text), F.col(pos).asc()]
    out = pairs.withColumn("_any", F.count(value).over(w) > 0).withColumn("_n", F.row_number().over(w.orderBy(*order)))
    return out.where("NOT _any OR _n = 1").drop("_any", "_n")


def first_value(df: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.min_by(value, pos).alias("value"))


def joined_values(df: DataFrame, group: str, value: str, pos: str, separator: str = ", ") -> DataFrame:
    """Distinct values in the order of their first place."""
    first = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(pos).alias("_p"))
    listed = F.array_sort(F.collect_list(F.struct("_p", value)))
    return first.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x[value]), separator).alias("value"))


def agreed_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """The value of groups that agree; others are left out."""
    return df.groupBy(group).agg(F.min(value).alias("value"), F.max(value).alias("_high")).where(F.col("value") == F.col("_high")).drop("_high")


def varies(df: DataFrame, group: list[str], columns: list[str], literal: str = "VARIES") -> DataFrame:
    """Per group the common value of each column, or the literal where it differs."""
    one = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c).cast("string")).otherwise(literal).alias(c)
    return df.groupBy(*group).agg(*[one(c) for c in columns])


def propagate(oriented: DataFrame, source: DataFrame, value: str, mode: str = "first") -> DataFrame:
    """(target, value) over oriented pairs, the sources' values taken by mode first, join or skip_conflicts."""
    rows = oriented.join(source.select(F.col("guid").alias("source"), F.col(value).alias("_v")), "source").where("_v IS NOT NULL")
    if mode == "first":
        return first_value(rows, "target", "_v", "pos")
    if mode == "join":
        return joined_values(rows, "target", "_v", "pos")
    return agreed_value(rows, "target", "_v")


def lookup_with_fallback(edges: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Edges (child, key, pin) to the pinned version, else the newest of the key; edges without any are dropped."""
    pinned = versions.select(F.col(key), F.col("version").alias("pin"), F.col("id").alias("_pinned"))
    head = versions.groupBy(key).agg(F.max_by("id", F.struct("created_at", "id")).alias("_head"))
    out = edges.join(pinned, [key, "pin"], "left").join(head, key, "left")
    return out.withColumn("parent_id", F.coalesce("_pinned", "_head")).where("parent_id IS NOT NULL").drop("_pinned", "_head")


def members_of(members: DataFrame, group: str, member: str) -> DataFrame:
    """Distinct members per group, sorted."""
    return members.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"))


def opening_chain(fills: DataFrame, voids: DataFrame, hosts: DataFrame) -> DataFrame:
    """(element, host): element fills opening, opening voids host; of several hosts a wall wins, then the least guid."""
    two = fills.join(voids, "opening").join(hosts.withColumnRenamed("guid", "host"), "host")
    best = F.min(F.struct((~F.col("is_wall")).alias("other"), F.col("host")))
    return two.groupBy("element").agg(best.alias("b")).select("element", F.col("b.host").alias("host"))


def inherit(type_values: DataFrame, own_values: DataFrame, type_of: DataFrame) -> DataFrame:
    """(guid, prop, value): what the occurrence sets overrides what its type sets."""
    inherited = type_of.join(type_values, "type_guid").select("guid", "prop", "value", F.lit(0).alias("_rank"))
    every = inherited.unionByName(own_values.select("guid", "prop", "value", F.lit(1).alias("_rank")))
    return every.groupBy("guid", "prop").agg(F.max_by("value", "_rank").alias("value"))


def code_ladder(df: DataFrame, raw: str, prefix: Column, klass: str, exact: DataFrame, paired: DataFrame, default: DataFrame) -> DataFrame:
    """Code by the whole raw text (a null code there ends the search), else by (prefix, class), else by prefix.

    The three tables are mapping modules of fixed size, kept small by hand, so they are broadcast.
    """
    out = df.withColumn("_prefix", prefix)
    out = out.join(F.broadcast(exact.select(F.col("raw").alias(raw), F.col("code").alias("_c1"), F.lit(True).alias("_known"))), raw, "left")
    out = out.join(F.broadcast(paired.select(F.col("prefix").alias("_prefix"), F.col("class").alias(klass), F.col("code").alias("_c2"))), ["_prefix", klass], "left")
    out = out.join(F.broadcast(default.select(F.col("prefix").alias("_prefix"), F.col("code").alias("_c3"))), "_prefix", "left")
    code = F.when(F.col("_known"), F.col("_c1")).otherwise(F.coalesce("_c2", "_c3"))
    return out.withColumn("code", code).drop("_prefix", "_known", "_c1", "_c2", "_c3")


def best_parents(candidates: DataFrame, child: str, parent: str, score: Column, distance: Column) -> DataFrame:
    """Per child the parent of the highest score; then the nearest (unknown distances last), then the least id."""
    ranked = candidates.withColumn("score", score).where("score > 0").withColumn("_d", distance)
    w = Window.partitionBy(child).orderBy(F.col("score").desc(), F.col("_d").asc_nulls_last(), F.col(parent).asc())
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_d")


def votes(hits: DataFrame, element: str, room: str, points: Column) -> DataFrame:
    """Per element: dominant room, votes, share, margin to the second, coverage of its points."""
    tally = hits.groupBy(element, room).agg(F.count("*").alias("_v"))
    w = Window.partitionBy(element).orderBy(F.col("_v").desc(), F.col(room).asc())
    ranked = tally.withColumn("_n", F.row_number().over(w))
    out = ranked.groupBy(element).agg(
        F.max(F.when(F.col("_n") == 1, F.col(room))).alias("room"),
        F.max(F.when(F.col("_n") == 1, F.col("_v"))).alias("dominant"),
        F.coalesce(F.max(F.when(F.col("_n") == 2, F.col("_v"))), F.lit(0)).alias("second"),
        F.sum("_v").alias("total"),
    )
    covered = hits.groupBy(element).agg(F.count_distinct("point").alias("covered"))
    out = out.join(covered, element)
    return out.select(element, "room", "dominant", "second", "total", (F.col("dominant") / F.col("total")).alias("confidence"), ((F.col("dominant") - F.col("second")) / F.col("total")).alias("margin"), (F.col("covered") / points).alias("coverage"))


def precedence(df: DataFrame, key: str, rules: list[tuple[Column, str]], taken: Column | None = None) -> DataFrame:
    """The first rule that holds per element; rows where ``taken`` already holds a value keep it and meet no rule."""
    out = F.lit(None).cast("string")
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    if taken is not None:
        out = F.when(taken.isNotNull(), taken).otherwise(out)
    return df.withColumn("assigned", out)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """sha256 over the sorted rows' JSON hashes: equal for equal multisets of rows.

    Equal rows are counted first. Hashes are combined per bucket of their first 16 bits, those per 8 bits, then all, so
    no task gathers more than about a 65,536th of the distinct rows.
    """
    digest = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    rows = df.groupBy(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")).agg(F.count("*").alias("n"))
    part = rows.select(F.substring("h", 1, 4).alias("b"), F.concat("h", F.lit(":"), F.col("n").cast("string")).alias("x")).groupBy("b").agg(F.concat("b", digest("x")).alias("x"))
    part = part.select(F.substring("b", 1, 2).alias("b"), "x").groupBy("b").agg(F.concat("b", digest("x")).alias("x"))
    return part.agg(digest("x").alias("fingerprint"))


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """The rows with their place in a total order, from 1, without gathering them: sorted by ranges, counted by range.

    The sorted rows are written to the checkpoint folder, so both uses see the same ranges.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """The rows with the rank of a value; equal ones share the least place."""
    places = positions(df.select(value), [value], "_place").groupBy(value).agg(F.min("_place").alias(name))
    return df.join(places, df[value].eqNullSafe(places[value])).drop(places[value])
