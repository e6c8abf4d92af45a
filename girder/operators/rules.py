"""Specification checks, property writes, space functions, egress relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug_ladder

#: Function slugs of spaces and the patterns of their labels, in order.
SPACE_FUNCTIONS = [
    ("ELCENTRAL", "centralort"),
    ("UNDERCENTRAL", "centralort"),
    ("FLÄKTRUM", "centralort"),
    ("FLAKTRUM", "centralort"),
    ("TEKNICENTRAL", "centralort"),
    (r"EL\s*CENTRAL", "centralort"),
    ("KORRIDOR", "korridor"),
    ("TRAPPHUS", "trapphus"),
    ("HISSHALL", "hisshall"),
    (r"\bHIS\b", "hisshall"),
    ("SCHAKT", "schakt"),
    ("SHAFT", "schakt"),
    ("SOPRUM", "soprum"),
    (r"\bLOKAL\b", "lokal"),
    ("COMMERCIAL", "lokal"),
    (r"\bBOSTAD\b", "bostad"),
    (r"ROK\b", "bostad"),
]


def space_function(long_name: Column, name: Column, reference: Column) -> Column:
    """The slug of the first rule whose pattern is found in the labels, taken together; blank labels don't count."""
    labels = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in (long_name, name, reference)])
    return slug_ladder(F.upper(labels), SPACE_FUNCTIONS)


def assign_by_rules(elements: DataFrame, key: str, rules: list[tuple[Column, str]], owner: Column, current: Column, overwrite: bool = False) -> DataFrame:
    """(key, assigned, written, reason): the value of the first rule that fits, in their order.

    Elements with another owner (a reference that isn't blank or ``undefined``) are skipped; unless ``overwrite``, those
    with a value keep it. Rules without a value don't count.
    """
    owned = ~F.coalesce(F.lower(F.trim(owner)).isin("", "undefined"), F.lit(True))
    fits = F.lit(None).cast("string")
    for where, value in reversed([r for r in rules if r[1]]):
        fits = F.when(F.coalesce(where, F.lit(False)), F.lit(value)).otherwise(fits)
    kept = F.nullif(F.trim(current), F.lit(""))
    rows = elements.select(F.col(key), fits.alias("_fits"), owned.alias("_owned"), kept.alias("_kept"))
    stays = F.col("_kept").isNotNull() & F.lit(not overwrite)
    reason = F.when(F.col("_fits").isNull(), "no_rule").when(F.col("_owned"), "duplicate_owned").when(stays, "has_value").otherwise("written")
    return rows.select(key, F.when(reason == "written", F.col("_fits")).otherwise(F.col("_kept")).alias("assigned"), (reason == "written").alias("written"), reason.alias("reason"))


def unfilled_passages(openings: DataFrame, fills: DataFrame, max_sill: float, least_width: float, least_height: float) -> DataFrame:
    """Openings (guid, sill, width, height) that no door or window fills, low enough above their storey and large enough;
    unknown measures pass."""
    free = openings.join(fills.select("guid").distinct(), "guid", "left_anti")
    return free.where(F.coalesce(F.col("sill") <= max_sill, F.lit(True)) & F.coalesce(F.col("width") >= least_width, F.lit(True)) & F.coalesce(F.col("height") >= least_height, F.lit(True)))


def check_specs(elements: DataFrame, key: str, specs: list[tuple[str, str, Column, Column, str]]) -> DataFrame:
    """Long results (guid, rule, passed, reason) of specs (specification, requirement, applies, holds, reason).

    All specs are checked in one pass over the elements. Rule and reason are cut at 500 characters; a requirement that
    can't be decided (null) fails.
    """
    entries = [
        F.when(applies, F.struct(F.substring(F.lit(f"{spec}|{req}"), 1, 500).alias("rule"), F.coalesce(holds, F.lit(False)).alias("passed"), F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason[:500])).alias("reason")))
        for spec, req, applies, holds, reason in specs
    ]
    return elements.select(F.col(key).alias("guid"), F.explode(F.array_compact(F.array(*entries))).alias("r")).select("guid", "r.*")


REPORT = "struct<specifications:array<struct<name:string,requirements:array<struct<description:string,passed_entities:array<string>,failed_entities:array<struct<guid:string,reason:string>>>>>>>"


def report_rows(reports: DataFrame, column: str) -> DataFrame:
    """(guid, rule, passed, reason) of a checker's nested report."""
    spec = reports.select(F.explode(F.from_json(column, REPORT)["specifications"]).alias("s")).select(F.col("s.name").alias("spec"), F.explode("s.requirements").alias("q"))
    rule = F.substring(F.concat(F.trim("spec"), F.lit("|"), F.trim("q.description")), 1, 500)
    passed = spec.select(rule.alias("rule"), F.explode("q.passed_entities").alias("guid")).select("guid", "rule", F.lit(True).alias("passed"), F.lit(None).cast("string").alias("reason"))
    failed = spec.select(rule.alias("rule"), F.explode("q.failed_entities").alias("e")).select("e.guid", "rule", F.lit(False).alias("passed"), F.substring("e.reason", 1, 500).alias("reason"))
    return passed.unionByName(failed)


def write_property(properties: DataFrame, selected: DataFrame, pset: str, prop: str, value: Column, overwrite: bool = True) -> DataFrame:
    """Properties (guid, pset, prop, value) with one set on the selected guids; without ``overwrite`` old values stay."""
    here = (F.col("pset") == pset) & (F.col("prop") == prop)
    new = selected.select("guid", F.lit(pset).alias("pset"), F.lit(prop).alias("prop"), value.alias("_new")).dropDuplicates(["guid"])
    merged = properties.where(here).join(new, ["guid", "pset", "prop"], "full_outer")
    merged = merged.select("guid", "pset", "prop", (F.coalesce("_new", "value") if overwrite else F.coalesce("value", "_new")).alias("value"))
    return properties.where(~here).select("guid", "pset", "prop", "value").unionByName(merged)


def nearest_storey(points: DataFrame, z: str, storeys: DataFrame, tolerance: float, most: int = 10_000) -> DataFrame:
    """Each row's storey of nearest elevation within a tolerance; ties by the lower one.

    The storeys of a model are a list of at most ``most``, which is checked before it goes beside every row.
    """
    if storeys.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} storeys")
    listed = storeys.agg(F.array_sort(F.collect_list(F.struct("elevation", "guid"))).alias("_s"))
    rows = points.join(F.broadcast(listed))
    near = F.array_min(F.transform("_s", lambda s: F.struct(F.abs(s["elevation"] - F.col(z)).alias("d"), s["elevation"].alias("e"), s["guid"].alias("guid"))))
    return rows.withColumn("_n", near).withColumn("storey", F.when(F.col("_n.d") <= tolerance, F.col("_n.guid"))).drop("_s", "_n")


def storey_tops(storeys: DataFrame, building: str) -> DataFrame:
    """The next higher elevation of the building as top; null at the highest."""
    return storeys.withColumn("top", F.lead("elevation").over(Window.partitionBy(building).orderBy("elevation", "guid")))


#: Methods of links over stairs and lifts.
VERTICAL = ("stair_element", "transport_element", "transport_element_namefallback")


def egress_summary(edges: DataFrame) -> DataFrame:
    """Distinct portals, links, the methods' label, links that cross storeys and links over stairs and lifts, of edges
    (portal, space, method, crosses)."""
    label = F.array_join(F.array_sort(F.collect_set("method")), "+")
    return edges.agg(F.count_distinct("portal").alias("portals"), F.count("*").alias("links"), F.when(F.count("method") > 0, label).otherwise("none").alias("method"), F.count_if("crosses").alias("cross_storey"), F.count_if(F.col("method").isin(*VERTICAL)).alias("stair_links"))
