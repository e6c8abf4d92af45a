"""Boxes and points, from the vectors: the first three values are a centre, the next three half extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import ladders as D
from ..operators import rules as V
from ..operators import spatial as P
from .catalog import query

CELL = 0.25
_ENTITY = ("IfcSpace", "IfcDuctSegment", "IfcFlowTerminal", "IfcWall", "IfcSlab")
B = """b AS (SELECT vec_id AS guid, label, CASE vec_id % 5 WHEN 0 THEN 'IfcSpace' WHEN 1 THEN 'IfcDuctSegment' WHEN 2 THEN 'IfcFlowTerminal' WHEN 3 THEN 'IfcWall' ELSE 'IfcSlab' END AS entity,
  c1 - h1 AS min_x, c2 - h2 AS min_y, c3 - h3 AS min_z, c1 + h1 AS max_x, c2 + h2 AS max_y, c3 + h3 AS max_z, c1 AS x, c2 AS y, c3 AS z
  FROM (SELECT *, CAST(embedding[1] AS DOUBLE) AS c1, CAST(embedding[2] AS DOUBLE) AS c2, CAST(embedding[3] AS DOUBLE) AS c3, abs(CAST(embedding[4] AS DOUBLE)) AS h1, abs(CAST(embedding[5] AS DOUBLE)) AS h2, abs(CAST(embedding[6] AS DOUBLE)) AS h3 FROM embeddings))"""
_OVER = "least(a.max_{0}, c.max_{0}) - greatest(a.min_{0}, c.min_{0})"
OX, OY, OZ = (_OVER.format(x) for x in "xyz")
GAP = f"greatest(0, -({OX}), -({OY}), -({OZ}))"


def boxes(t):
    e = lambda i: F.col("embedding")[i].cast("double")
    entity = F.element_at(F.array(*[F.lit(x) for x in _ENTITY]), (F.col("vec_id") % 5 + 1).cast("int"))
    corners = [(e(i) + (-1 if side == "min" else 1) * F.abs(e(i + 3))).alias(f"{side}_{ax}") for side in ("min", "max") for i, ax in enumerate("xyz")]
    return t.embeddings.select(F.col("vec_id").alias("guid"), "label", entity.alias("entity"), *corners, e(0).alias("x"), e(1).alias("y"), e(2).alias("z"))


_BOX = ["guid", "label", "entity", *P.CORNERS]


@query(f"""WITH {B}, p AS (SELECT a.guid AS guid_a, c.guid AS guid_b, CASE
  WHEN c.entity = 'IfcSpace' THEN CASE WHEN a.entity <> 'IfcSpace' AND (a.min_x + a.max_x)/2 BETWEEN c.min_x AND c.max_x AND (a.min_y + a.max_y)/2 BETWEEN c.min_y AND c.max_y AND (a.min_z + a.max_z)/2 BETWEEN c.min_z AND c.max_z THEN 'sits_in' END
  WHEN a.entity IN ('IfcSpace', 'IfcWall', 'IfcSlab') THEN NULL
  WHEN {OX} > 0 AND {OY} > 0 AND {OZ} > 0 AND a.entity = 'IfcDuctSegment' THEN 'penetrates'
  WHEN abs(a.min_z - c.max_z) <= 0.05 AND {OX} > 0 AND {OY} > 0 THEN 'mounted_on'
  WHEN {OX} > 0 AND {OY} > 0 AND {OZ} > 0 THEN 'intersects'
  WHEN {GAP} > 0 AND {GAP} <= 0.01 THEN 'within_clearance' END AS relation
  FROM b a JOIN b c ON c.entity IN ('IfcSpace', 'IfcWall', 'IfcSlab') AND a.guid <> c.guid)
  SELECT guid_a, guid_b, relation FROM p WHERE relation IS NOT NULL""")
def box_pairs(t):
    b = boxes(t).select("guid", "entity", *P.CORNERS)
    return P.related_boxes(b, b.where(F.col("entity").isin("IfcSpace", "IfcWall", "IfcSlab")), CELL, 0.01).where("guid_a <> guid_b")


@query(f"WITH {B} SELECT a.guid AS guid_a, c.guid AS guid_b, round({GAP}, 6) AS distance FROM b a JOIN b c ON a.guid < c.guid AND {GAP} <= 0.005 WHERE a.label = c.label AND a.entity = 'IfcWall' AND c.entity = 'IfcWall'")
def clearance_pairs(t):
    walls = boxes(t).where("entity = 'IfcWall'").select(*_BOX)
    out = P.clashes(walls, None, "clearance", CELL, clearance=0.005)
    label = walls.select("guid", "label")
    out = out.join(label.withColumnsRenamed({"guid": "guid_a", "label": "la"}), "guid_a").join(label.withColumnsRenamed({"guid": "guid_b", "label": "lb"}), "guid_b")
    return out.where("la = lb").select("guid_a", "guid_b", F.round("distance", 6).alias("distance"))


@query(f"WITH {B} SELECT a.guid AS guid_a, c.guid AS guid_b FROM b a JOIN b c ON a.entity = 'IfcWall' AND c.entity = 'IfcSlab' WHERE least({OX}, {OY}, {OZ}) > 0.1")
def intersections(t):
    b = boxes(t).select(*_BOX)
    return P.clashes(b.where("entity = 'IfcWall'"), b.where("entity = 'IfcSlab'"), "intersection", CELL, tolerance=0.1).select("guid_a", "guid_b")


_INSIDE = "e.x BETWEEN s.min_x AND s.max_x AND e.y BETWEEN s.min_y AND s.max_y AND e.z BETWEEN s.min_z AND s.max_z"


@query(f"WITH {B} SELECT e.guid, s.guid AS space FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity <> 'IfcSpace' AND {_INSIDE}")
def point_in_box(t):
    b = boxes(t)
    hits = P.point_in_box(b.where("entity <> 'IfcSpace'").select("guid", "x", "y", "z"), b.where("entity = 'IfcSpace'").select(*_BOX), CELL)
    return hits.select("guid", F.col("s_guid").alias("space"))


_DIST = "sqrt(power(greatest(s.min_x - e.x, e.x - s.max_x, 0), 2) + power(greatest(s.min_y - e.y, e.y - s.max_y, 0), 2) + power(greatest(s.min_z - e.z, e.z - s.max_z, 0), 2))"


@query(f"WITH {B} SELECT guid, round(d, 6) AS distance FROM (SELECT e.guid, {_DIST} AS d, row_number() OVER (PARTITION BY e.guid ORDER BY {_DIST}, s.guid) AS n FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity = 'IfcWall') WHERE n = 1")
def nearest_box(t):
    b = boxes(t)
    out = P.nearest_box(b.where("entity = 'IfcWall'").select("guid", "x", "y", "z"), b.where("entity = 'IfcSpace'").select(*_BOX), "guid", 0.05)
    return out.select("guid", F.round("distance", 6).alias("distance"))


@query(f"WITH {B} SELECT guid, space, n FROM (SELECT e.guid, s.guid AS space, row_number() OVER (PARTITION BY e.guid ORDER BY {_DIST}, s.guid) AS n FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity = 'IfcWall' AND {_DIST} <= 0.2) WHERE n <= 2")
def two_nearest(t):
    b = boxes(t)
    out = P.near_boxes(b.where("entity = 'IfcWall'").select("guid", "x", "y", "z"), b.where("entity = 'IfcSpace'").select(*_BOX), "guid", 0.2, 2)
    return out.select("guid", F.col("s_guid").alias("space"), F.col("rank").alias("n"))


def _points(t):
    """Five sample points an element: the centre and four corners of its footprint."""
    b = boxes(t).where("entity <> 'IfcSpace'")
    c = F.col
    spots = F.array(*[F.struct(F.lit(i).alias("point"), x.alias("x"), y.alias("y"), c("z").alias("z")) for i, (x, y) in enumerate(((c("x"), c("y")), (c("min_x"), c("min_y")), (c("min_x"), c("max_y")), (c("max_x"), c("min_y")), (c("max_x"), c("max_y"))))])
    return b.select("guid", F.explode(spots).alias("s")).select("guid", "s.*")


_PTS = "pts AS (SELECT guid, 0 AS point, x, y, z FROM b WHERE entity <> 'IfcSpace' UNION ALL SELECT guid, 1, min_x, min_y, z FROM b WHERE entity <> 'IfcSpace' UNION ALL SELECT guid, 2, min_x, max_y, z FROM b WHERE entity <> 'IfcSpace' UNION ALL SELECT guid, 3, max_x, min_y, z FROM b WHERE entity <> 'IfcSpace' UNION ALL SELECT guid, 4, max_x, max_y, z FROM b WHERE entity <> 'IfcSpace')"
_VOTE = f"""{_PTS}, hits AS (SELECT e.guid, e.point, s.guid AS space FROM pts e JOIN b s ON s.entity = 'IfcSpace' AND e.x BETWEEN s.min_x - 0.01 AND s.max_x + 0.01 AND e.y BETWEEN s.min_y - 0.01 AND s.max_y + 0.01 AND e.z BETWEEN s.min_z - 0.01 AND s.max_z + 0.01),
  tally AS (SELECT guid, space, count(*) AS v, row_number() OVER (PARTITION BY guid ORDER BY count(*) DESC, space) AS n FROM hits GROUP BY 1, 2),
  vote AS (SELECT guid, max(space) FILTER (n = 1) AS room, CAST(max(v) FILTER (n = 1) AS DOUBLE) / sum(v) AS confidence, CAST(max(v) FILTER (n = 1) - coalesce(max(v) FILTER (n = 2), 0) AS DOUBLE) / sum(v) AS margin FROM tally GROUP BY 1),
  cov AS (SELECT guid, count(DISTINCT point) / 5.0 AS coverage FROM hits GROUP BY 1)"""


@query(f"WITH {B}, {_VOTE} SELECT guid, room, round(confidence, 6) AS confidence, round(margin, 6) AS margin, round(CAST(coverage AS DOUBLE), 6) AS coverage FROM vote JOIN cov USING (guid)")
def vote_rooms(t):
    from ..operators.relational import votes

    hits = P.point_in_box(_points(t), boxes(t).where("entity = 'IfcSpace'").select(*_BOX), CELL, 0.01)
    out = votes(hits, "guid", "s_guid", F.lit(5))
    return out.select("guid", "room", *[F.round(c, 6).alias(c) for c in ("confidence", "margin", "coverage")])


_MATCH = f"""{B}, {_VOTE}, pool AS (SELECT t.guid, t.space, greatest(least(e.max_x, s.max_x) - greatest(e.min_x, s.min_x), 0) * greatest(least(e.max_y, s.max_y) - greatest(e.min_y, s.min_y), 0) / greatest((e.max_x - e.min_x) * (e.max_y - e.min_y), 1e-9) AS ratio,
    sqrt(power(greatest(s.min_x - (e.min_x+e.max_x)/2, (e.min_x+e.max_x)/2 - s.max_x, 0), 2) + power(greatest(s.min_y - (e.min_y+e.max_y)/2, (e.min_y+e.max_y)/2 - s.max_y, 0), 2) + power(greatest(s.min_z - (e.min_z+e.max_z)/2, (e.min_z+e.max_z)/2 - s.max_z, 0), 2)) AS d
    FROM tally t JOIN b e ON e.guid = t.guid JOIN b s ON s.guid = t.space WHERE t.n <= 32),
  best AS (SELECT guid, min(struct_pack(m := -ratio, s := space)) AS r, min(struct_pack(d := d, s := space)) AS p, count(*) AS candidates FROM pool GROUP BY 1),
  near AS (SELECT * FROM (SELECT e.guid, s.guid AS space, {_DIST} AS d, row_number() OVER (PARTITION BY e.guid ORDER BY {_DIST}, s.guid) AS n FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity <> 'IfcSpace' WHERE e.guid NOT IN (SELECT guid FROM hits)) WHERE n = 1),
  matched AS (SELECT e.guid, CASE WHEN v.room IS NULL THEN n.space WHEN confidence >= 0.55 AND coverage >= 0.35 AND margin >= 0.1 THEN v.room WHEN r.m < 0 THEN r.s ELSE p.s END AS space,
    CASE WHEN v.room IS NULL THEN 'proximity' WHEN confidence >= 0.55 AND coverage >= 0.35 AND margin >= 0.1 THEN 'overlap_majority' ELSE 'overlap_geometric' END AS method,
    CASE WHEN v.room IS NOT NULL AND confidence >= 0.55 AND coverage >= 0.35 AND margin >= 0.1 THEN 'Contained' ELSE 'Resolved' END AS status,
    CASE WHEN v.room IS NULL THEN greatest(0, 1 - least(n.d, 0.1) / 0.1) WHEN confidence >= 0.55 AND coverage >= 0.35 AND margin >= 0.1 THEN confidence WHEN r.m < 0 THEN least(1, -r.m) ELSE greatest(0, 1 - least(p.d, 2) / 2) END AS confidence, coalesce(candidates, 0) AS candidates
    FROM b e LEFT JOIN vote v USING (guid) LEFT JOIN cov USING (guid) LEFT JOIN best USING (guid) LEFT JOIN near n USING (guid) WHERE e.entity <> 'IfcSpace')"""


def _match(t, pool: int | None):
    b = boxes(t)
    return P.room_match(b.where("entity <> 'IfcSpace'").select(*_BOX), _points(t), b.where("entity = 'IfcSpace'").select(*_BOX), size=CELL, reach=0.1, pool=pool)


@query(f"WITH {_MATCH.replace(' WHERE t.n <= 32', '')} SELECT guid, space, method, status, round(confidence, 5) AS confidence FROM matched")
def room_match(t):
    """Of all voted rooms, however many."""
    return _match(t, None).select("guid", "space", "method", "status", F.round("confidence", 5).alias("confidence"))


@query(f"WITH {_MATCH} SELECT count(*) AS elements, count_if(method = 'overlap_majority') AS overlap_majority, count_if(method = 'overlap_geometric') AS overlap_geometric, count_if(method = 'proximity') AS proximity_forced, count_if(status <> 'Contained' AND candidates > 1) AS ambiguous, count_if(confidence < 0.25) AS h1, count_if(confidence >= 0.25 AND confidence < 0.5) AS h2, count_if(confidence >= 0.5 AND confidence < 0.75) AS h3, count_if(confidence >= 0.75) AS h4 FROM matched")
def match_summary(t):
    m, c = _match(t, P.POOL), F.col("confidence")
    method = lambda x: F.count_if(F.col("method") == x)
    return m.agg(F.count("*").alias("elements"), method("overlap_majority").alias("overlap_majority"), method("overlap_geometric").alias("overlap_geometric"), method("proximity").alias("proximity_forced"), F.count_if((F.col("status") != "Contained") & (F.col("candidates") > 1)).alias("ambiguous"), F.count_if(c < 0.25).alias("h1"), F.count_if((c >= 0.25) & (c < 0.5)).alias("h2"), F.count_if((c >= 0.5) & (c < 0.75)).alias("h3"), F.count_if(c >= 0.75).alias("h4"))


@query(f"WITH {B}, inside AS (SELECT e.guid, min(struct_pack(v := (s.max_x-s.min_x)*(s.max_y-s.min_y)*(s.max_z-s.min_z), s := s.guid)) AS b FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity = 'IfcWall' AND {_INSIDE} GROUP BY 1), near AS (SELECT guid, space FROM (SELECT e.guid, s.guid AS space, row_number() OVER (PARTITION BY e.guid ORDER BY {_DIST}, s.guid) AS n FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity = 'IfcWall') WHERE n = 1) SELECT guid, coalesce(inside.b.s, near.space) AS space, CASE WHEN inside.guid IS NULL THEN 'nearest' ELSE 'contained' END AS method FROM near LEFT JOIN inside USING (guid)")
def room_match_legacy(t):
    """One point an element: the smallest space that contains it, else the nearest one."""
    b = boxes(t)
    points, spaces = b.where("entity = 'IfcWall'").select("guid", "x", "y", "z"), b.where("entity = 'IfcSpace'").select(*_BOX)
    inside = P.smallest_container(points, spaces, "guid", CELL)
    near = P.nearest_box(points.join(inside, "guid", "left_anti"), spaces, "guid", 0.1).select("guid", F.col("s_guid").alias("space"), F.lit("nearest").alias("method"))
    return inside.withColumn("method", F.lit("contained")).unionByName(near)


@query(f"WITH {B} SELECT guid, b.s AS space FROM (SELECT e.guid, min(struct_pack(a := (s.max_x-s.min_x)*(s.max_y-s.min_y), s := s.guid)) AS b FROM (SELECT guid, max_x + 0.02 AS x, y, z, entity FROM b) e JOIN b s ON s.entity = 'IfcSpace' AND e.entity = 'IfcFlowTerminal' AND {_INSIDE} GROUP BY 1)")
def side_point_pick(t):
    """The space that holds the point beside a door, the smallest footprint first."""
    b = boxes(t)
    points = b.where("entity = 'IfcFlowTerminal'").select("guid", (F.col("max_x") + 0.02).alias("x"), "y", "z")
    return P.smallest_container(points, b.where("entity = 'IfcSpace'").select(*_BOX), "guid", CELL, "area")


@query(f"WITH {B} SELECT guid, b.s AS space FROM (SELECT e.guid, min(struct_pack(v := (s.max_x-s.min_x)*(s.max_y-s.min_y)*(s.max_z-s.min_z), s := s.guid)) AS b FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity <> 'IfcSpace' AND {_INSIDE} GROUP BY 1)")
def smallest_container(t):
    b = boxes(t)
    return P.smallest_container(b.where("entity <> 'IfcSpace'").select("guid", "x", "y", "z"), b.where("entity = 'IfcSpace'").select(*_BOX), "guid", CELL)


_FACE = f"SELECT a.guid AS guid_a, c.guid AS guid_b, greatest({OX}, {OY}) AS shared_edge FROM b a JOIN b c ON a.guid < c.guid AND a.label = c.label AND ((abs({OX}) <= 0.05 AND {OY} >= 0.1) OR (abs({OY}) <= 0.05 AND {OX} >= 0.1))"


@query(f"WITH {B} SELECT guid_a, guid_b, round(shared_edge, 6) AS shared_edge FROM ({_FACE})")
def face_adjacency(t):
    out = P.face_adjacency(boxes(t).select(*_BOX), "label", 0.05, 0.1, CELL)
    return out.withColumn("shared_edge", F.round("shared_edge", 6))


@query(f"WITH {B}, f AS ({_FACE}) SELECT least(guid_a % 7, guid_b % 7) AS zone_a, greatest(guid_a % 7, guid_b % 7) AS zone_b, count(*) AS pairs FROM f WHERE guid_a % 7 <> guid_b % 7 GROUP BY 1, 2")
def zone_adjacency(t):
    b = boxes(t).select(*_BOX)
    return P.zone_adjacency(P.face_adjacency(b, "label", 0.05, 0.1, CELL), b.select(F.col("guid").alias("space"), (F.col("guid") % 7).alias("zone")))


@query(f"WITH {B} SELECT guid, CASE WHEN x < (min(x) OVER (PARTITION BY label) + max(x) OVER (PARTITION BY label)) / 2 THEN 'A' ELSE 'B' END AS side FROM b")
def half_partition(t):
    return P.half_split(boxes(t), ["label"], "x").select("guid", "side")


@query(f"""WITH {B}, f AS ({_FACE}), iso AS (SELECT * FROM b WHERE guid NOT IN (SELECT guid_a FROM f UNION SELECT guid_b FROM f))
  SELECT guid_a, guid_b FROM (SELECT i.guid AS guid_a, o.guid AS guid_b, row_number() OVER (PARTITION BY i.guid ORDER BY power(i.x-o.x,2) + power(i.y-o.y,2), o.guid) AS n FROM iso i JOIN b o ON o.guid <> i.guid AND o.label = i.label) WHERE n = 1""")
def isolated_nearest(t):
    """Nodes in no edge get one to the nearest centre of their storey, met over a grid."""
    b = boxes(t)
    f = P.face_adjacency(b.select(*_BOX), "label", 0.05, 0.1, CELL)
    linked = f.select(F.col("guid_a").alias("guid")).union(f.select("guid_b"))
    iso = b.join(linked, "guid", "left_anti")
    points = iso.select("guid", "label", "x", "y", F.lit(0.0).alias("z"))
    centres = b.select("guid", "label", *[(F.lit(0.0) if ax == "z" else F.col(ax)).alias(f"{side}_{ax}") for side in ("min", "max") for ax in "xyz"])
    near = P.nearest_box(points, centres, "guid", 0.05, (F.col("label") == F.col("s_label")) & (F.col("guid") != F.col("s_guid")), "xy")
    return near.select(F.col("guid").alias("guid_a"), F.col("s_guid").alias("guid_b"))


@query(f"""WITH {B} SELECT guid, round((max_x-min_x)*(max_y-min_y), 6) AS area, round((max_x-min_x)*(max_y-min_y)*(max_z-min_z), 6) AS volume, CAST(floor(min_x / 0.25) AS BIGINT) AS cx, round(sqrt(x*x + y*y), 6) AS plan, round(CASE WHEN z - min_z > 0.1 THEN least(max_z, min_z + 0.1) ELSE z END, 6) AS sample_z,
  round(greatest(least(max_x, 0.1) - greatest(min_x, -0.1), 0), 6) AS shared FROM b""")
def scalar_geometry(t):
    c = F.col
    area = (c("max_x") - c("min_x")) * (c("max_y") - c("min_y"))
    sample_z = F.when(c("z") - c("min_z") > 0.1, F.least(c("max_z"), c("min_z") + 0.1)).otherwise(c("z"))
    return boxes(t).select("guid", F.round(area, 6).alias("area"), F.round(area * (c("max_z") - c("min_z")), 6).alias("volume"), X.cell(c("min_x"), 0.25).cast("long").alias("cx"), F.round(F.sqrt(c("x") * c("x") + c("y") * c("y")), 6).alias("plan"), F.round(sample_z, 6).alias("sample_z"), F.round(F.greatest(X.overlap(c("min_x"), c("max_x"), F.lit(-0.1), F.lit(0.1)), F.lit(0.0)), 6).alias("shared"))


@query()
def mesh_samples(t):
    """Corners, centre and face centres of each box as sample points, kept apart by 0.05."""
    c = F.col
    spots = [F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x in (c("min_x"), c("x"), c("max_x")) for y in (c("min_y"), c("y"), c("max_y")) for z in (c("min_z"), c("z"), c("max_z"))]
    rows = boxes(t).select("guid", F.array(*spots).alias("points"))
    return P.sample_points(rows, "guid", "points", 24, 0.05).select("guid", F.size("points").alias("n_points"))


@query()
def point_dedupe(t):
    """Greedy separation of the first values of each vector, read as points."""
    e = lambda i: F.col("embedding")[i].cast("double")
    spots = [F.struct(e(i).alias("x"), e(i + 1).alias("y"), e(i + 2).alias("z")) for i in range(0, 60, 3)]
    rows = t.embeddings.select(F.col("vec_id").alias("guid"), F.array(*spots).alias("points"))
    return P.sample_points(rows, "guid", "points", 24, 0.2).select("guid", F.size("points").alias("n_points"))


_SIDE = "FROM b d JOIN b s ON s.entity = 'IfcSpace' AND d.entity = 'IfcDuctSegment' AND d.y BETWEEN s.min_y AND s.max_y AND d.z BETWEEN s.min_z AND s.max_z"


@query(f"""WITH {B}, e AS (SELECT guid, x, y, z FROM b WHERE entity = 'IfcDuctSegment'), near AS (SELECT * FROM (SELECT e.guid AS door, s.guid AS space, row_number() OVER (PARTITION BY e.guid ORDER BY {_DIST}, s.guid) AS n FROM e JOIN b s ON s.entity = 'IfcSpace' AND {_DIST} <= 0.15) WHERE n <= 2),
  side AS (SELECT d.guid AS door, min(struct_pack(a := (s.max_x-s.min_x)*(s.max_y-s.min_y), g := s.guid)) AS m {_SIDE} AND d.min_x - 0.02 BETWEEN s.min_x AND s.max_x GROUP BY 1 UNION ALL SELECT d.guid, min(struct_pack(a := (s.max_x-s.min_x)*(s.max_y-s.min_y), g := s.guid)) {_SIDE} AND d.max_x + 0.02 BETWEEN s.min_x AND s.max_x GROUP BY 1),
  link AS (SELECT guid AS door, 0 AS r, 'space_boundary' AS method, guid % 9 + 1 AS space FROM b WHERE entity = 'IfcDuctSegment' AND guid % 4 = 0 UNION ALL SELECT guid, 0, 'space_boundary', guid % 5 + 20 FROM b WHERE entity = 'IfcDuctSegment' AND guid % 4 = 0 UNION ALL SELECT door, 1, 'plan_sides', m.g FROM side UNION ALL SELECT door, 2, 'nearest', space FROM near),
  two AS (SELECT door, r, method, min(space) AS space_a, max(space) AS space_b FROM link GROUP BY 1, 2, 3 HAVING count(DISTINCT space) = 2)
  SELECT door, space_a, space_b, method FROM (SELECT *, row_number() OVER (PARTITION BY door ORDER BY r) AS k FROM two) WHERE k = 1""")
def door_pairs(t):
    """By the model's boundaries, else by the spaces on both sides, else the two nearest within reach."""
    b = boxes(t)
    doors, spaces = b.where("entity = 'IfcDuctSegment'"), b.where("entity = 'IfcSpace'").select(*_BOX)
    linked = doors.where("guid % 4 = 0").select(F.col("guid").alias("door"), F.explode(F.array(F.col("guid") % 9 + 1, F.col("guid") % 5 + 20)).alias("space"))
    points = doors.select(F.col("guid").alias("door"), "y", "z", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("min_x") - 0.02).alias("x")), F.struct(F.lit(1).alias("side"), (F.col("max_x") + 0.02).alias("x")))).alias("s"))
    points = points.select(F.struct("door", "s.side").alias("key"), "door", "s.x", "y", "z")
    sides = P.smallest_container(points, spaces, "key", CELL, "area").select("key.door", "space")
    near = P.near_boxes(doors.select(F.col("guid").alias("door"), "x", "y", "z"), spaces, "door", 0.15, 2).select("door", F.col("s_guid").alias("space"), "rank")
    return D.door_spaces(linked, sides, near)


@query(f"WITH {B} SELECT guid FROM b WHERE entity = 'IfcSlab' AND guid % 3 <> 0 AND (guid % 11 = 0 OR (min_z - floor(min_z / 0.1) * 0.1 <= 0.06 AND max_x - min_x >= 0.1 AND max_z - min_z >= 0.1))")
def passages(t):
    """Openings without a fill, low sill above the storey, wide and high enough; unknown geometry passes."""
    c = F.col
    known = lambda x: F.when(c("guid") % 11 != 0, x)
    slabs = boxes(t).where("entity = 'IfcSlab'")
    rows = slabs.select("guid", known(c("min_z") - F.floor(c("min_z") / 0.1) * 0.1).alias("sill"), known(c("max_x") - c("min_x")).alias("width"), known(c("max_z") - c("min_z")).alias("height"))
    return V.unfilled_passages(rows, slabs.where("guid % 3 = 0"), 0.06, 0.1, 0.1).select("guid")


@query(f"WITH {B} SELECT guid, CAST(floor(min_z / 0.2) AS BIGINT) AS low, CAST(floor(max_z / 0.2) AS BIGINT) AS high FROM b WHERE floor(min_z / 0.2) <> floor(max_z / 0.2) AND max_z - min_z >= 0.2")
def stair_links(t):
    """Connectors whose lowest and highest point lie on different storeys and that rise enough."""
    low, high = F.floor(F.col("min_z") / 0.2), F.floor(F.col("max_z") / 0.2)
    return boxes(t).where((low != high) & (F.col("max_z") - F.col("min_z") >= 0.2)).select("guid", low.alias("low"), high.alias("high"))


@query(f"""WITH {B}, v AS (SELECT guid, unnest([min_x, x, max_x, max_x]) AS x, unnest([min_y, y, max_y, min_y]) AS y, unnest([min_z, z, max_z, min_z + 0.05]) AS z FROM b),
  k AS (SELECT guid, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM v GROUP BY 1 HAVING max(z) - min(z) >= 0.2), e AS (SELECT v.*, k.* EXCLUDE (guid), greatest(0.06, 0.2 * (hz - lz)) AS band FROM v JOIN k USING (guid))
  SELECT guid, 'base' AS landing, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(min(lz), 6) AS z FROM e WHERE z <= lz + band GROUP BY 1 UNION ALL SELECT guid, 'top', round(avg(x), 6), round(avg(y), 6), round(max(hz), 6) FROM e WHERE z >= hz - band GROUP BY 1
  UNION ALL SELECT guid, 'middle_low', round((lx + hx) / 2, 6), round((ly + hy) / 2, 6), round(lz, 6) FROM k UNION ALL SELECT guid, 'middle_high', round((lx + hx) / 2, 6), round((ly + hy) / 2, 6), round(hz, 6) FROM k""")
def stair_landings(t):
    """The centres of the lowest and highest band of each stair's vertices, and the middle of its box."""
    c = F.col
    spots = F.array(*[F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in ((c("min_x"), c("min_y"), c("min_z")), (c("x"), c("y"), c("z")), (c("max_x"), c("max_y"), c("max_z")), (c("max_x"), c("min_y"), c("min_z") + 0.05))])
    out = D.stair_landings(boxes(t).select("guid", F.explode(spots).alias("v")).select("guid", "v.*"), "guid", 0.2, 0.2, 0.06)
    return out.select("guid", "landing", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"WITH {B} SELECT guid, round((min_x + max_x) / 2, 6) AS x, round((min_y + max_y) / 2, 6) AS y, round((min_z + max_z) / 2, 6) AS z FROM b")
def midpoints(t):
    """Half way between two points."""
    at = lambda side: F.array(*[F.col(f"{side}_{a}") for a in "xyz"])
    rows = boxes(t).select("guid", X.midpoint(at("min"), at("max")).alias("m"))
    return rows.select("guid", *[F.round(F.col("m")[i], 6).alias(a) for i, a in enumerate("xyz")])


@query(f"""WITH {B}, o AS (SELECT label, CASE WHEN max(x) - min(x) >= max(y) - min(y) THEN 'x' ELSE 'y' END AS axis, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM b GROUP BY 1)
  SELECT b.guid, concat('z', b.label, CASE WHEN CASE axis WHEN 'x' THEN x < mx ELSE y < my END THEN 'A' ELSE 'B' END) AS zone FROM b JOIN o USING (label)""")
def takt_zones(t):
    """G25, last rung: derived zones: storey and half along the axis of the larger spread, x on ties."""
    return D.zones(boxes(t), [("spatial_zone", _explicit(t).where("false")), ("ifc_zone", _explicit(t).where("false")), ("derived", _derived(t))]).select("guid", "zone")


def _derived(t):
    b = boxes(t)
    o = b.groupBy("label").agg(((F.max("x") - F.min("x")) >= (F.max("y") - F.min("y"))).alias("on_x"), ((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"))
    below = F.when(F.col("on_x"), F.col("x") < F.col("mx")).otherwise(F.col("y") < F.col("my"))
    return b.join(o, "label").select("guid", F.concat(F.lit("z"), F.col("label").cast("string"), F.when(below, "A").otherwise("B")).alias("zone"))


def _explicit(t):
    return boxes(t).where("guid % 9 = 0").select("guid", F.concat(F.lit("E"), (F.col("guid") % 4).cast("string")).alias("zone"))


@query(f"WITH {B} SELECT guid, 'E' || (guid % 4) AS zone, 'ifc_zone' AS rung FROM b WHERE guid % 9 = 0 AND entity <> 'IfcSpace'")
def takt_zone_ladder(t):
    """No explicit zone holds a member, so zones by grouping are taken, for all members."""
    b = boxes(t)
    outside = b.where("entity = 'IfcSpace'").select("guid", F.lit("takt 1").alias("zone"))
    return D.zones(b.where("entity <> 'IfcSpace'"), [("spatial_zone", outside), ("ifc_zone", _explicit(t)), ("derived", _derived(t))])


@query(f"""WITH {B}, inside AS (SELECT e.guid, min(struct_pack(v := (s.max_x-s.min_x)*(s.max_y-s.min_y)*(s.max_z-s.min_z), s := s.guid)) AS b FROM b e JOIN b s ON s.entity = 'IfcSpace' AND e.entity <> 'IfcSpace' AND {_INSIDE} GROUP BY 1)
  SELECT b.guid, CASE WHEN b.guid % 9 = 0 THEN 'explicit' WHEN i.guid IS NOT NULL THEN 'geometry' ELSE 'derived' END AS rung, CASE WHEN b.guid % 9 = 0 THEN 'E' || (b.guid % 4) WHEN i.guid IS NOT NULL THEN 'S' || i.b.s ELSE 'L' || b.label END AS zone FROM b LEFT JOIN inside i USING (guid) WHERE b.entity <> 'IfcSpace'""")
def zone_assignment(t):
    """Candidates of all rungs at once, the first rung of each element stays."""
    b = boxes(t)
    e = b.where("entity <> 'IfcSpace'")
    inside = P.smallest_container(e.select("guid", "x", "y", "z"), b.where("entity = 'IfcSpace'").select(*_BOX), "guid", CELL)
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("zone")
    return D.assigned([("explicit", _explicit(t).join(e, "guid", "left_semi")), ("geometry", inside.select("guid", named("S", "space"))), ("derived", e.select("guid", named("L", "label")))])
