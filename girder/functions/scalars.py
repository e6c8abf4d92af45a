"""Scalar expressions: text, numbers, geometry of boxes, time, JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments that count as blank, and texts that count as true.
BLANK = ("", "none", "null", "undefined")
TRUE = ("true", "1", "yes", "y", "on")


def blank_to_null(c: Column) -> Column:
    """Null where the trimmed argument is blank, else the trimmed argument."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin(*BLANK), text)


def to_bool(c: Column, default: bool = False) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isNull() | text.isin(*BLANK), F.lit(default)).otherwise(text.isin(*TRUE))


def number(c: Column) -> Column:
    """The number a text holds, else null."""
    return F.trim(c).try_cast("double")


def same_value(a: Column, b: Column) -> Column:
    """Equal as numbers where both are numbers, else as trimmed texts."""
    x, y = number(a.cast("string")), number(b.cast("string"))
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.trim(a.cast("string")) == F.trim(b.cast("string")))


def first_positive(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def scale_round(c: Column, factor: float, decimals: int) -> Column:
    """Scaled, then rounded half to even."""
    return F.bround(c * factor, decimals)


def slug_ladder(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The slug of the first pattern that is found, ignoring case."""
    out = F.lit(None).cast("string")
    for pattern, slug in reversed(rules):
        out = F.when(c.rlike(f"(?i){pattern}"), F.lit(slug)).otherwise(out)
    return out


def glob_pattern(glob: str) -> str:
    """A whole-string regular expression for patterns of *, ?, [set] and [!set]; letters keep their case."""
    body, at = [], 0
    while at < len(glob):
        ch, at = glob[at], at + 1
        end = glob.find("]", at + (glob[at : at + 1] == "!") + 1) if ch == "[" else -1
        if ch == "*":
            body.append(".*")
        elif ch == "?":
            body.append(".")
        elif end > 0:
            negated, members = glob[at] == "!", glob[at + (glob[at] == "!") : end]
            body.append("[" + "^" * negated + "".join(f"\\{c}" if c in "\\[]^&" else c for c in members) + "]")
            at = end + 1
        else:
            body.append(re.escape(ch))
    return f"(?s)^{''.join(body)}$"


def matches_any_glob(c: Column, globs: list[str]) -> Column:
    return c.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def tokens(c: Column, pattern: str) -> Column:
    """Distinct matches in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1))


def local_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/#]*)$", 1)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length two intervals share; negative is the gap between them."""
    return F.least(hi1, hi2) - F.greatest(lo1, lo2)


def midpoint(a: Column, b: Column) -> Column:
    """The point half way between two points, as arrays; null where either is."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def box_distance(x: Column, y: Column, z: Column, box: str) -> Column:
    """Distance of a point to a box given by the prefix of its columns."""
    axis = lambda p, a: F.greatest(F.col(f"{box}min_{a}") - p, p - F.col(f"{box}max_{a}"), F.lit(0.0))
    dx, dy, dz = axis(x, "x"), axis(y, "y"), axis(z, "z")
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def footprint_ratio(a: str, b: str, floor: float = 1e-9) -> Column:
    """Shared footprint of two boxes over the first one's."""
    c = F.col
    ox = F.greatest(overlap(c(f"{a}min_x"), c(f"{a}max_x"), c(f"{b}min_x"), c(f"{b}max_x")), F.lit(0.0))
    oy = F.greatest(overlap(c(f"{a}min_y"), c(f"{a}max_y"), c(f"{b}min_y"), c(f"{b}max_y")), F.lit(0.0))
    area = (c(f"{a}max_x") - c(f"{a}min_x")) * (c(f"{a}max_y") - c(f"{a}min_y"))
    return ox * oy / F.greatest(area, F.lit(floor))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("int")


def quantised(c: Column, step: float) -> Column:
    return F.bround(c / step) * step


def closeness_confidence(distance: Column, reach: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least(distance, F.lit(reach)) / reach)


def storey_key(elevation: Column, guid: Column, room: Column, z: Column) -> Column:
    """elev: of the containing storey, else gid:, else the room number's prefix, else z:, else null."""
    prefix = F.regexp_extract(room, r"\b(\d{3})-\d{3,}", 1)
    return F.coalesce(
        F.when(guid.isNotNull() & elevation.isNotNull(), F.concat(F.lit("elev:"), F.format_string("%.2f", elevation))),
        F.when(guid.isNotNull(), F.concat(F.lit("gid:"), guid)),
        F.when(prefix != "", F.concat(F.lit("prefix:"), prefix)),
        F.when(z.isNotNull(), F.concat(F.lit("z:"), F.format_string("%.1f", z))),
    )


def merge_json(old: Column, new: Column) -> Column:
    """Union of two flat JSON objects of texts; the new one wins."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (old, new))
    merged = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    entries = F.array_sort(F.map_entries(merged))
    return F.to_json(F.map_from_entries(entries))

