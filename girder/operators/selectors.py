"""Filters: entity types, simple selectors, keep lists, routes, optional predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import matches_any_glob, same_value

#: Entity types of the spatial structure, which are products but no elements.
SPATIAL = ("IfcProject", "IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcSpace")


def select_columns(df: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Project (label, source) pairs; a missing source is an error that names it."""
    missing = [source for _, source in wanted if source not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(source).alias(label) for label, source in wanted])


def of_type(df: DataFrame, query: str, column: str = "entity", spatial: tuple[str, ...] = SPATIAL) -> DataFrame:
    """IfcProduct: all; IfcElement: all but the spatial types; else one type."""
    if query == "IfcProduct":
        return df
    if query == "IfcElement":
        return df.where(~F.col(column).isin(*spatial))
    return df.where(F.col(column) == query)


def by_types(df: DataFrame, types: list[str], key: str, column: str) -> DataFrame:
    """Union of types, once a key; types that don't occur give nothing."""
    return df.where(F.col(column).isin(*types)).dropDuplicates([key])


def where_given(df: DataFrame, **values: object) -> DataFrame:
    """AND of equalities for the values that aren't None."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


@dataclass(frozen=True)
class Selector:
    """``Class, Pset.Prop=value, ...``; without a class every element."""

    entity: str
    conditions: tuple[tuple[str, str, str], ...]

    @classmethod
    def parse(cls, text: str) -> Selector:
        entity, conditions = "IfcElement", []
        for part in re.findall(r"""(?:[^,"']|"[^"]*"|'[^']*')+""", text):
            part = part.strip()
            if "=" in part:
                path, value = (x.strip() for x in part.split("=", 1))
                pset, _, prop = path.rpartition(".")
                conditions.append((pset, prop, value.strip("\"'")))
            elif part:
                entity = part
        return cls(entity, tuple(conditions))


def select_guids(elements: DataFrame, properties: DataFrame, selector: Selector, spatial: tuple[str, ...] = SPATIAL) -> DataFrame:
    """Guids whose entity fits and for which every condition holds in ``properties`` (guid, pset, prop, value)."""
    out = of_type(elements, selector.entity, spatial=spatial).select("guid")
    if not selector.conditions:
        return out
    wanted = [(F.col("pset") == p) & (F.col("prop") == q) & same_value(F.col("value"), F.lit(v)) for p, q, v in selector.conditions]
    hits = properties.select("guid", *[F.coalesce(w, F.lit(False)).alias(f"c{i}") for i, w in enumerate(wanted)])
    held = hits.groupBy("guid").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(wanted))])
    every = held.where(" AND ".join(f"c{i}" for i in range(len(wanted)))).select("guid")
    return out.join(every, "guid", "left_semi")


def select_union(elements: DataFrame, properties: DataFrame, text: str, spatial: tuple[str, ...] = SPATIAL) -> DataFrame:
    """Union of selectors joined by ``+``; equal ones count once."""
    selectors = dict.fromkeys(Selector.parse(s) for s in text.split("+") if s.strip())
    out = None
    for s in selectors:
        own = select_guids(elements, properties, s, spatial)
        out = own if out is None else out.union(own)
    return out.distinct()


def source_mode(df: DataFrame, mode: str, selected: DataFrame, key: str, features: Column) -> DataFrame:
    """Clash sources: all (a), only the selected (i) or all but them (e); never feature elements."""
    base = df.where(~features)
    if mode == "a":
        return base
    return base.join(selected.select(key).distinct(), key, {"i": "left_semi", "e": "left_anti"}[mode])


def keep_listed(df: DataFrame, keep: DataFrame, key: str, removed: bool = False) -> DataFrame:
    """Rows on the keep list, or those that it removes."""
    return df.join(keep.select(key).distinct(), key, "left_anti" if removed else "left_semi")


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a property matches a pattern: its whole ``pset.prop`` path, the property behind ``*.``, or the set before
    ``.*``. A path is parted at its last dot."""
    prop, pset = F.substring_index(path, ".", -1), F.regexp_extract(path, r"(?s)^(.*)\.[^.]*$", 1)
    return matches_any_glob(path, globs) | matches_any_glob(prop, [g[2:] for g in globs if g.startswith("*.")]) | matches_any_glob(pset, [g[:-2] for g in globs if g.endswith(".*")])


def route(name: Column, prefixes: dict[str, str], default: str | None = None) -> Column:
    """The route of the first prefix a file name starts with."""
    out = F.lit(default).cast("string")
    for prefix, target in reversed(prefixes.items()):
        out = F.when(name.startswith(prefix), F.lit(target)).otherwise(out)
    return out


#: What may follow a discipline's code in a file name, and the mark of a registered upload before it.
CODE_ENDS, UPLOAD_MARK = "[_\\- \\t]", "(?i)^dd[0-9a-f]{8}-"


def longest_prefix(df: DataFrame, text: str, key: str, prefixes: DataFrame, prefix: str, delimiters: str = CODE_ENDS, mark: str = UPLOAD_MARK) -> DataFrame:
    """Per key the longest prefix of its file name that ends there or before a delimiter; none gives null.

    The folder, the extension and an upload's mark don't count. Failing that, the name's first token (before an
    underscore, then a dash), trimmed, where it is on the list. ``prefixes`` is a lookup table. The join is on equal
    prefixes: each text is cut at its delimiters (a handful of cuts), so no rows are compared without an equal key.
    """
    base = F.regexp_replace(F.col(text), "^.*/", "")
    rest = F.regexp_replace(F.regexp_replace(base, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1"), mark, "")
    rows = df.select(key, rest.alias("_rest"))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_rest"), F.lit(1))), lambda n: F.substring(F.col("_rest"), F.lit(1), n))
    ends = F.filter(cuts, lambda c: (F.length(c) == F.length("_rest")) | F.substring(F.col("_rest"), F.length(c) + 1, F.lit(1)).rlike(f"^{delimiters}$"))
    tokens = [F.when(F.col("_rest").contains(s), F.struct(F.lit(-i).alias("order"), F.trim(F.substring_index("_rest", s, 1)).alias("cut"))) for i, s in enumerate(("_", "-"), 1)]
    tried = F.concat(F.transform(ends, lambda c: F.struct(F.length(c).alias("order"), c.alias("cut"))), F.array_compact(F.array(*tokens)))
    hit = rows.select(key, F.explode(tried).alias("t")).select(key, "t.*").join(prefixes.select(F.col(prefix).alias("cut")).distinct(), "cut")
    best = hit.groupBy(key).agg(F.max_by("cut", "order").alias(prefix))
    return df.join(best, key, "left")


def search(df: DataFrame, text: str | None, columns: list[str], **equals: object) -> DataFrame:
    """Optional equalities and a case-blind search over several columns."""
    df = where_given(df, **equals)
    if text:
        any_of = F.lit(False)
        for c in columns:
            any_of = any_of | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        df = df.where(any_of)
    return df


def history_page(df: DataFrame, order: str, allowed: list[str], descending: bool, key: str, limit: int, offset: int) -> DataFrame:
    """One page by an allow-listed column, nulls last, ties by key."""
    if order not in allowed:
        raise ValueError(f"can't order by {order!r}")
    c = F.col(order)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key).asc()).offset(offset).limit(limit)


def newest(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
