"""Graph and point kernels, orders and job steps against brute force on small tables."""

from __future__ import annotations

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from girder.functions import scalars as X
from girder.operators import graphs, jobs, ladders, lineage, registry, relational, rules, selectors, spatial
from girder.plans import catalog
from girder.plans import spaces as plans
from girder.sources import tables


def adjacency(pairs):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def distances(pairs, source):
    near, far, queue = adjacency(pairs), {source: 0}, deque([source])
    while queue:
        v = queue.popleft()
        for w in near.get(v, ()):
            if w not in far:
                far[w] = far[v] + 1
                queue.append(w)
    return far


def count_parts(pairs, nodes):
    seen, n = set(), 0
    for v in nodes:
        if v not in seen:
            n += 1
            seen |= set(distances(pairs, v))
    return n


def graph(seed, n=14, m=19):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bridges_and_cut_vertices_over_partitions(spark, seed):
    pairs = graph(seed)
    nodes = {v for p in pairs for v in p}
    df = spark.createDataFrame(pairs, "src long, dst long").repartition(11)
    base = count_parts(pairs, nodes)
    without = lambda i: [p for n, p in enumerate(pairs) if n != i]
    want = {(min(p), max(p)) for i, p in enumerate(pairs) if p[0] != p[1] and count_parts(without(i), nodes) > base}
    assert {tuple(r) for r in graphs.bridges(df).collect()} == want
    cut = {v for v in adjacency(pairs) if count_parts([p for p in pairs if v not in p], nodes - {v}) > base}
    assert {r["id"] for r in graphs.articulation(df).collect()} == cut


def test_closeness(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (5, 6), (7, 7)]
    nodes = sorted({v for p in pairs for v in p})
    raw = {}
    for v in nodes:
        far = distances(pairs, v)
        s, total = len(far) - 1, sum(far.values())
        raw[v] = s / (len(nodes) - 1) * s / total if total else 0.0
    low, high = min(raw.values()), max(raw.values())
    out = {r["id"]: r["closeness"] for r in graphs.centrality(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert out == {v: pytest.approx((x - low) / (high - low), abs=2e-6) for v, x in raw.items()}


def test_shortest_paths(spark):
    pairs = graph(5)
    nodes = sorted({v for p in pairs for v in p})
    df = spark.createDataFrame(pairs, "src long, dst long")
    hops = {r["id"]: r["hops"] for r in graphs.hops(df, spark.createDataFrame([(nodes[0],)], "id long")).collect()}
    assert hops == distances(pairs, nodes[0])
    asked = [(a, b) for a, b in itertools.combinations(nodes, 2)]
    rows = graphs.path_edges(df, spark.createDataFrame(asked, "source long, target long")).collect()
    near = adjacency(pairs)
    for r in rows:
        assert r["dst"] in near[r["src"]] and r["src"] < r["dst"]
        whole = distances(pairs, r["path_from"])[r["path_to"]]
        assert whole == r["length"]
        ways = [distances(pairs, r["path_from"]).get(x, 99) + 1 + distances(pairs, r["path_to"]).get(y, 99) for x, y in ((r["src"], r["dst"]), (r["dst"], r["src"]))]
        assert min(ways) == whole
    assert len({(r["src"], r["dst"]) for r in rows}) == len(rows)
    assert {(r["src"], r["dst"]) for r in rows} == {(min(p), max(p)) for p in pairs if p[0] != p[1]}  # an edge is its ends' shortest path
    first = graphs.path_edges(df, spark.createDataFrame(asked, "source long, target long"), 1).collect()
    assert {(r["path_from"], r["path_to"]) for r in first} == {next((a, b) for a, b in asked if b in distances(pairs, a))}


@pytest.mark.parametrize("method", ["louvain", "edge_betweenness", "fiedler"])
def test_partitions_part_two_cliques(spark, method):
    two = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10)]
    out = {r["id"]: r["community"] for r in graphs.communities(spark.createDataFrame(two, "src long, dst long"), method).collect()}
    assert out == {v: 0 if v < 5 else 10 for v in out} and len(out) == 10


def modularity(pairs, label):
    near = adjacency(pairs)
    m2 = sum(len(x) for x in near.values())
    inside = sum(label[v] == label[w] for v in near for w in near[v])
    return inside / m2 - sum((sum(len(near[v]) for v in near if label[v] == c) / m2) ** 2 for c in set(label.values()))


def test_louvain_goes_beyond_one_level(spark):
    ring = [(c * 5 + a, c * 5 + b) for c in range(30) for a in range(5) for b in range(a + 1, 5)] + [(c * 5, (c + 1) % 30 * 5 + 1) for c in range(30)]
    label = {r["id"]: r["community"] for r in graphs.communities(spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert modularity(ring, label) >= modularity(ring, {v: v // 5 for v in label})


def test_components_by_size(spark):
    with pytest.raises(ValueError):
        graphs.centrality(spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long"), max_edges=3)


def test_topological_order_with_cycles(spark):
    chain = [(i, i + 1) for i in range(16)]
    edges = [*chain, (0, 5), (3, 16), (20, 21), (21, 22), (22, 20), (22, 23), (30, 30)]
    nodes = sorted({v for e in edges for v in e})
    e = spark.createDataFrame(edges, "parent_id long, child_id long")
    out = {r["id"]: r for r in lineage.topological_order(e, spark.createDataFrame([(v,) for v in nodes], "id long")).collect()}
    assert {v for v, r in out.items() if r["on_cycle"]} == {20, 21, 22, 23}
    assert all(out[i]["level"] == i for i in range(17)) and out[30]["level"] == 0 and out[20]["level"] == 17
    assert sorted(r["position"] for r in out.values()) == list(range(1, len(nodes) + 1))
    for a, b in edges:
        assert a == b or out[b]["on_cycle"] or out[a]["position"] < out[b]["position"]
    assert lineage.topological_order(e.where("false"), e.select(F.col("parent_id").alias("id")).where("false")).count() == 0


def test_positions_and_ranks(spark):
    rng = random.Random(2)
    values = [(i, rng.choice([None, *range(9)])) for i in range(200)]
    df = spark.createDataFrame(values, "id long, v int").repartition(7)
    order = sorted(values, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r["id"]: r["position"] for r in relational.positions(df, ["v", "id"]).collect()} == {r[0]: n for n, r in enumerate(order, 1)}
    first = {}
    for n, r in enumerate(order, 1):
        first.setdefault(r[1], n)
    assert {r["id"]: r["rank"] for r in relational.ranked(df, "v", "rank").collect()} == {i: first[v] for i, v in values}


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(3)

    def box(i):
        size = [rng.choice([0.0, 0.01, 0.3, 5.0, 80.0]) for _ in range(3)]
        low = [rng.uniform(-20, 20) for _ in range(3)]
        return (f"b{i}", "IfcWall", *low, *(x + s for x, s in zip(low, size, strict=True)))

    boxes = [box(i) for i in range(90)]
    df = spark.createDataFrame(boxes, "guid string, entity string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    for axes, grow in (("xy", 0.0), ("xyz", 0.5)):
        got = [(r["a_guid"], r["b_guid"]) for r in spatial.box_pairs(df, df, 0.25, grow, axes).collect()]
        want = {(a[0], b[0]) for a in boxes for b in boxes if all(a[2 + k] - grow <= b[5 + k] and b[2 + k] <= a[5 + k] + grow for k in range(len(axes)))}
        assert len(got) == len(set(got)) and set(got) == want
    points = [(f"p{i}", *(rng.uniform(-30, 30) for _ in range(3))) for i in range(40)]
    pf = spark.createDataFrame(points, "guid string, x double, y double, z double")
    inside = {(r["guid"], r["s_guid"]) for r in spatial.point_in_box(pf, df, 0.25, 0.1).collect()}
    assert inside == {(p[0], b[0]) for p in points for b in boxes if all(b[2 + k] - 0.1 <= p[1 + k] <= b[5 + k] + 0.1 for k in range(3))}

    def distance(p, b):
        return sum(max(b[2 + k] - p[1 + k], p[1 + k] - b[5 + k], 0) ** 2 for k in range(3)) ** 0.5

    near = {r["guid"]: r["s_guid"] for r in spatial.nearest_box(pf, df, "guid", 0.05).collect()}
    assert near == {p[0]: min(boxes, key=lambda b: (distance(p, b), b[0]))[0] for p in points}  # noqa: B023


@pytest.fixture
def shuffled(spark):
    """Rows written to shuffles since the test began."""

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in (every.apply(i) for i in range(every.size()))}

    before = stages()
    return lambda: sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("chunk", [100_000, 20])
def test_rooms_of_groups_and_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(spatial, "SLICE", 50)
    monkeypatch.setattr(spatial, "CHUNK", chunk, raising=False)
    rng = random.Random(5)
    box = lambda name, wide: (name, *(c := [rng.uniform(-1, 1) for _ in range(3)]), *(x + rng.uniform(0.1, wide) for x in c))
    elements, spaces = [box(f"e{i}", 0.5) for i in range(300)] + [("far", 9.0, 9.0, 9.0, 9.5, 9.5, 9.5)], [box(f"s{i}", 2.5) for i in range(300)]
    spots = {e[0]: [(0, *((e[1 + k] + e[4 + k]) / 2 for k in range(3))), *((n, e[x], e[y], e[3]) for n, (x, y) in enumerate(((1, 2), (1, 5), (4, 2), (4, 5)), 1))] for e in elements}
    schema = "guid string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    points = spark.createDataFrame([(g, *p) for g, own in spots.items() for p in own], "guid string, point int, x double, y double, z double")
    out = spatial.room_match(spark.createDataFrame(elements, schema), points, spark.createDataFrame(spaces, schema), size=0.25, reach=0.1)
    got = {r["guid"]: (r["space"], r["method"], round(r["confidence"], 9), r["candidates"]) for r in out.collect()}
    want = {}
    for e in elements[:-1]:
        own = {s[0]: [p[0] for p in spots[e[0]] if all(s[1 + k] - 0.01 <= p[1 + k] <= s[4 + k] + 0.01 for k in range(3))] for s in spaces}
        pool = sorted((-len(v), s) for s, v in own.items() if v)
        total, first = -sum(n for n, _ in pool), -pool[0][0] if pool else 0
        if not pool:
            want[e[0]] = None
            continue
        second = -pool[1][0] if len(pool) > 1 else 0
        if first / total >= 0.55 and len(set().union(*own.values())) / 5 >= 0.35 and (first - second) / total >= 0.1:
            want[e[0]] = (pool[0][1], "overlap_majority", round(first / total, 9), min(32, len(pool)))
            continue
        near = [s for s in spaces if s[0] in {x for _, x in pool[:32]}]
        share = {s[0]: max(min(e[4], s[4]) - max(e[1], s[1]), 0) * max(min(e[5], s[5]) - max(e[2], s[2]), 0) / ((e[4] - e[1]) * (e[5] - e[2])) for s in near}
        best = min(share, key=lambda s: (-share[s], s))
        if share[best] > 0:
            want[e[0]] = (best, "overlap_geometric", round(min(1, share[best]), 9), len(near))
    assert got["far"][1] == "proximity" and set(got) == {e[0] for e in elements}
    assert sum(v is not None for v in want.values()) > 250
    assert all(got[g] == v if v else got[g][1] == "proximity" for g, v in want.items())


@pytest.mark.parametrize("chunk", [100_000, 20])
def test_room_match_looks_at_all_voted_rooms(spark, monkeypatch, chunk):
    """Forty rooms hold all of its points, two only the middle: one shares more of its footprint; of another one nothing is shared."""
    monkeypatch.setattr(spatial, "CHUNK", chunk)
    schema = "guid string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    elements = spark.createDataFrame([("e", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("f", 10.0, 0.0, 0.0, 11.0, 1.0, 1.0)], schema)
    points = [("e", n, x, 0.5, 0.5) for n, x in enumerate((0.5, 0.45, 0.55))] + [("f", n, x, 2.0, 0.5) for n, x in enumerate((10.5, 10.4, 10.6))]
    rooms = [(f"r{i:02}", 0.4, 0.4, 0.0, 0.6, 0.6, 1.0) for i in range(40)] + [("wide", 0.48, 0.0, 0.0, 0.99, 1.0, 1.0), ("slim", 0.49, 0.4, 0.0, 0.51, 0.6, 1.0)]
    rooms += [(f"t{i:02}", 10.3, 1.9, 0.0, 10.7, 2.1, 1.0) for i in range(40)] + [("u", 10.45, 1.8, 0.0, 10.55, 2.1, 1.0)]
    run = lambda **more: {r["guid"]: (r["space"], r["method"], round(r["confidence"], 6), r["candidates"]) for r in spatial.room_match(elements, spark.createDataFrame(points, "guid string, point int, x double, y double, z double"), spark.createDataFrame(rooms, schema), size=0.25, reach=0.1, **more).collect()}
    assert run(pool=None) == {"e": ("wide", "overlap_geometric", 0.51, 42), "f": ("u", "overlap_geometric", 0.35, 41)}
    assert run() == {"e": ("r00", "overlap_geometric", 0.04, 32), "f": ("t00", "overlap_geometric", 0.3, 32)}


def test_room_match_in_the_plan_looks_at_all_voted_rooms(spark, tmp_path):
    """Forty rooms hold three points of each element and half its footprint, one only the middle and most of the footprint."""
    rows = [(5 * i, 0, [0.14, 0.0, 0.0, 0.16, 0.3, 0.3]) for i in range(40)] + [(200, 0, [0.0] * 3 + [0.27, 0.27, 0.3])] + [(5 * i + 1, 0, [0.0] * 3 + [0.29, 0.29, 0.1]) for i in range(3)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = plans.room_match(catalog.Tables(spark, str(tmp_path))).collect()
    assert {(r["guid"], r["space"], r["method"]) for r in out} == {(5 * i + 1, 200, "overlap_geometric") for i in range(3)}


@pytest.fixture
def crowded(spark, tmp_path):
    """1600 elements and 400 spaces, most of which meet."""
    rng = random.Random(6)
    rows = [(i, 0, [rng.uniform(-0.1, 0.1) for _ in range(3)] + [0.2, 0.2, 0.2]) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return catalog.Tables(spark, str(tmp_path))


def test_room_match_has_no_rows_of_pairs(crowded, shuffled):
    out = plans.room_match(crowded).collect()
    assert len(out) == 1600 and all(r["status"] == "Resolved" and r["method"] == "overlap_geometric" for r in out)
    assert shuffled() < 100_000


def test_match_summary_has_no_rows_of_pairs(crowded, shuffled):
    row = plans.match_summary(crowded).first()
    assert row["elements"] == row["overlap_geometric"] == row["ambiguous"] == 1600
    assert shuffled() < 100_000


@pytest.fixture
def made(spark):
    """The most rows that a step of a plan has made since the test began."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.executionsList()
        return {every.apply(i).executionId() for i in range(every.size())}

    def most():
        counts = [0]
        for k in executions() - before:
            values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        counts.append(int(values.apply(m.accumulatorId()).replace(",", "")))
        return max(counts)

    before = executions()
    return most


def test_box_pairs_makes_no_more_rows_than_it_returns(crowded, made):
    rows = {tuple(r) for r in plans.box_pairs(crowded).collect()}
    assert 1_000_000 < len(rows) and made() <= len(rows)
    assert {r[2] for r in rows} >= {"sits_in", "penetrates", "intersects"}


def test_related_boxes_are_those_of_classified_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SLICE", 20)
    monkeypatch.setattr(spatial, "FEW", 50)
    rng = random.Random(9)
    entities = ["IfcSpace", "IfcDuctSegment", "IfcAirTerminal", "IfcWall", "IfcColumn", "IfcDoor", None]

    def box(i):
        low = [round(rng.uniform(-1, 1), 2) for _ in range(3)]
        return (i, entities[i % 7], *low, *(round(x + rng.choice([0.0, 0.02, 0.3, 1.5]), 2) for x in low))

    schema = "guid long, entity string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    df = spark.createDataFrame([box(i) for i in range(420)] + [(900, "IfcWall", None, *[0.0] * 2, *[1.0] * 3)], schema)
    pairs = spatial.classify_pairs(spatial.box_pairs(df, df, 0.25, 0.051, "xyz"), 0.03).select("a_guid", "b_guid", "relation")
    want, got = sorted(map(tuple, pairs.collect())), sorted(map(tuple, spatial.related_boxes(df, df, 0.25, 0.03).collect()))
    assert got == want and {r[2] for r in got} == {name for name, _ in spatial.RELATIONS}


def test_lost_elements_have_no_rows_of_pairs(spark, tmp_path, made):
    """1600 elements, and 400 spaces two away from them."""
    rng = random.Random(7)
    rows = [(i, 0, [rng.uniform(-0.1, 0.1) + (0 if i % 5 else 2) for _ in range(3)] + [0.1 if i % 5 else 0.01] * 3) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = plans.room_match(catalog.Tables(spark, str(tmp_path))).collect()
    assert len(out) == 1600 and all(r["method"] == "proximity" and r["space"] % 5 == 0 for r in out)
    assert 1600 <= made() < 50_000


@pytest.mark.parametrize("chunk", [100_000, 20])
def test_nearest_rooms_of_groups_and_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(spatial, "SLICE", 50)
    monkeypatch.setattr(spatial, "CHUNK", chunk)
    rng = random.Random(8)
    place = lambda lo, hi: [rng.uniform(lo, hi) for _ in range(3)]
    spaces = [(f"s{i:03}", *(c := [round(x, 1) for x in place(0, 6)]), *(x + rng.choice((0.01, 0.2)) for x in c)) for i in range(150)]
    spaces += [(f"t{i:03}", *s[1:]) for i, s in enumerate(spaces)]  # equally near, of greater ids
    spots = {f"e{i:03}": tuple(place(-3, 9)) for i in range(300)} | {"far": (40.0, 40.0, 40.0)}
    schema = "guid string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    elements = spark.createDataFrame([(g, *p, *(x + 0.1 for x in p)) for g, p in spots.items()], schema)
    points = spark.createDataFrame([(g, 0, *p) for g, p in spots.items()] + [("none", 0, None, 0.0, 0.0)], "guid string, point int, x double, y double, z double")
    elements = elements.union(spark.createDataFrame([("none", *[0.0] * 6)], schema))
    out = spatial.room_match(elements, points, spark.createDataFrame(spaces, schema), size=0.25, reach=0.1).collect()
    got = {r["guid"]: r["space"] for r in out if r["method"] == "proximity"}
    distance = lambda p, s: sum(max(s[1 + k] - p[k], p[k] - s[4 + k], 0.0) ** 2 for k in range(3)) ** 0.5
    lost = {g: p for g, p in spots.items() if not any(all(s[1 + k] - 0.01 <= p[k] <= s[4 + k] + 0.01 for k in range(3)) for s in spaces)}
    assert len(lost) > 290 and got == {g: min((distance(p, s), s[0]) for s in spaces)[1] for g, p in lost.items()}
    assert [(r["status"], r["space"]) for r in out if r["guid"] == "none"] == [("Unmatched", None)]


def test_points_keep_their_distance(spark):
    rng = random.Random(4)
    rows = [(i, [tuple(rng.uniform(0, 1) for _ in range(3)) for _ in range(20)]) for i in range(12)]
    df = spark.createDataFrame(rows, "guid long, points array<struct<x:double,y:double,z:double>>")
    out = {r["guid"]: [tuple(p) for p in r["points"]] for r in spatial.sample_points(df, "guid", "points", 9, 0.4).collect()}
    for guid, points in rows:
        kept = []
        for p in points:
            if len(kept) < 9 and all(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5 >= 0.4 for q in kept):
                kept.append(p)
        assert out[guid] == kept


def test_traversals(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (3, 6)], "parent_id long, child_id long")
    types = spark.createDataFrame([(1, "IfcProject"), (2, "IfcBuilding"), (3, "IfcBuildingStorey"), (4, "IfcSpace"), (5, "IfcDoor"), (6, "IfcWall")], "id long, entity string")
    start = spark.createDataFrame([(5,), (6,)], "id long")
    go = lambda kind, s=start: {tuple(r) for r in lineage.traverse(tree, kind, s, types).collect()}
    assert go("parent") == {(5, 4, 1), (6, 3, 1)}
    assert go("storey_of") == {(5, 3, 2), (6, 3, 1)} and go("building_of") == {(5, 2, 3), (6, 2, 2)}
    assert go("ancestors", start.where("id = 6")) == {(6, 3, 1), (6, 2, 2), (6, 1, 3)}
    top = spark.createDataFrame([(2,)], "id long")
    assert go("children", top) == {(2, 3, 1)} and go("descendants", top) == {(2, 3, 1), (2, 4, 2), (2, 6, 2), (2, 5, 3)}
    assert go("products_in", top) == {(2, 6, 2), (2, 5, 3)}
    with pytest.raises(ValueError):
        lineage.traverse(tree, "uncles", start, types)


def test_space_functions_take_the_first_rule(spark):
    df = spark.createDataFrame([("KORRIDOR", "ELCENTRAL", None), (" ", None, "bostad"), (None, None, None), ("El", "central", None), ("x schakt", "trapphus", "hiss")], "a string, b string, c string")
    assert [r[0] for r in df.select(rules.space_function(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["centralort", "bostad", None, "centralort", "trapphus"]


def test_file_names(spark):
    names = {"a b.BCFZIP": "a_b.bcfzip", "x/y/Å ä-ö.IFC": "A_a-o.ifc", ".hidden": "hidden", "...": "file", "å" * 200 + ".ifc": "a" * 180 + ".ifc", "日本.ifc": "file.ifc", "two.dots.IfC": "two.dots.ifc", "__a__b__.x": "a_b.x", "": "file"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", tables.safe_name(F.col("n"))).collect()} == names


def test_prefixes_of_file_names(spark):
    cases = {"A1.part": "A1", "A1.x.part": None, "A1\tpart": "A1", "A1_x.ifc": "A1", "dir/DD00ff00ff-A1-x": "A1", "A12-x": "A12", "A1x_y": None, " A1 _x": "A1", "A1": "A1", "": None}
    df = spark.createDataFrame([(i, n) for i, n in enumerate(cases)], "id long, n string")
    codes = spark.createDataFrame([("A1",), ("A12",)], "prefix string")
    assert {r["n"]: r["prefix"] for r in selectors.longest_prefix(df, "n", "id", codes, "prefix").collect()} == cases


def test_globs(spark):
    import fnmatch

    paths = ["Pset_A.Name", "Pset_B.id", "ePset_X.Time", "P.[x]", "P.x^"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for globs in (["*.id"], ["ePset_*.*"], ["Pset_[AB].N*"], ["Pset_[!A].*"], ["P.[[]x]"], ["P.x[^]"], []):
        want = [any(fnmatch.fnmatchcase(p, g) or (g.startswith("*.") and fnmatch.fnmatchcase(p.rpartition(".")[2], g[2:])) or (g.endswith(".*") and fnmatch.fnmatchcase(p.rpartition(".")[0], g[:-2])) for g in globs) for p in paths]
        assert [r[0] for r in df.select(selectors.ignored(F.col("p"), globs)).collect()] == want, globs
    assert X.glob_pattern("a[") == r"(?s)^a\[$"


def test_job_steps(spark):
    df = spark.createDataFrame([(1, "Timeout: KeyError", 0), (2, "keyerror", 0), (3, None, 5), (4, "odd", 2)], "id long, m string, n int")
    out = {r["id"]: (r["a"], r["b"]) for r in df.select("id", jobs.retryable(F.col("m")).alias("a"), jobs.can_retry(F.col("m"), F.col("n"), 3).alias("b")).collect()}
    assert out == {1: (True, True), 2: (False, False), 3: (True, False), 4: (True, True)}
    docs = spark.createDataFrame([('{"a":1,"b":[]}',), ("[1,2]",), ('"text"',), ("broken {",), (None,)], "d string")
    assert [tuple(r) for r in docs.select(jobs.array_size(F.col("d")), jobs.object_size(F.col("d"))).collect()] == [(0, 2), (2, 0), (0, 0), (0, 0), (0, 0)]
    a, b = spark.createDataFrame([(i,) for i in range(5)], "a long"), spark.createDataFrame([("x",), ("y",)], "b string")
    assert sorted(map(tuple, jobs.combine(a, b, "by_position", ["a"], ["b"]).collect())) == [(0, "x"), (1, "y")]
    assert len(set(map(tuple, jobs.combine(a, b, "all").collect()))) == 10
    assert jobs.combine(a, b.where("false"), "all").count() == 0
    with pytest.raises(ValueError):
        jobs.combine(a, b, "all", most=1)
    planned = jobs.plan_layers(spark.createDataFrame([(1, "EL"), (2, "VS"), (3, "EL")], "id long, p string"), spark.createDataFrame([(3,)], "id long"), "id", F.col("p"), ["EL_PLAN", "ELX"])
    assert sorted(map(tuple, planned.collect())) == [(1, "EL_PLAN", "matched_existing"), (2, "VS", "new_layer_from_prefix")]


def test_recipes_and_mapping_modules(spark, tmp_path, monkeypatch):
    package = tmp_path / "mappings_for_tests"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "codes.py").write_text("RULES = [('IfcWall, Pset.Fire=1', 'C1'), ('IfcWall', 'C2'), ('IfcDoor', 'bad'), ('', 'C9')]\ndef valid(value):\n    return value.startswith('C')\n")
    (package / "empty.py").write_text("")
    monkeypatch.syspath_prepend(str(tmp_path))
    elements = spark.createDataFrame([("a", "IfcWall"), ("b", "IfcWall"), ("c", "IfcDoor"), ("d", "IfcWall"), ("e", "IfcWall")], "guid string, entity string")
    properties = spark.createDataFrame([("a", "Pset", "Fire", "1.0"), ("d", "BIP-PROCESS", "DuplicateOwnedBy", "x"), ("e", "BIP", "ContractID", "old"), ("b", "BIP-PROCESS", "DuplicateOwnedBy", " undefined")], "guid string, pset string, prop string, value string")
    tables = {"elements": elements, "properties": properties}
    values = lambda out: {r["guid"]: r["value"] for r in out["properties"].where("prop = 'ContractID'").collect()}
    run = lambda *more: registry.run_recipe(registry.AssignByRules, tables, "mappings_for_tests", "codes", "BIP", "ContractID", *more)
    assert values(run()) == {"a": "C1", "b": "C2", "e": "old"}
    assert values(run("yes")) == {"a": "C1", "b": "C2", "e": "C2"}
    assert {r["guid"]: r["reason"] for r in run()["assigned"].collect()} == {"a": "written", "b": "written", "c": "no_rule", "d": "duplicate_owned", "e": "has_value"}
    for module in ("missing", "empty", "os.path"):
        with pytest.raises(ValueError):
            registry.run_recipe(registry.AssignByRules, tables, "mappings_for_tests", module, "BIP", "ContractID")
    with pytest.raises(TypeError):
        registry.run_recipe(registry.AssignByRules, tables, wrong=1)


def test_zone_ladder_takes_one_rung_for_all(spark):
    members = spark.createDataFrame([("a",), ("b",)], "guid string")
    table = lambda rows: spark.createDataFrame(rows, "guid string, zone string")
    rungs = [("spatial_zone", table([("x", "z0")])), ("ifc_zone", table([("a", "z1")])), ("derived", table([("a", "z2"), ("b", "z2")]))]
    assert [tuple(r) for r in ladders.zones(members, rungs).collect()] == [("a", "z1", "ifc_zone")]
    assert ladders.zones(members, rungs, "derived").count() == 2 and ladders.zones(members, rungs, "spatial_zone").count() == 0
    with pytest.raises(ValueError):
        ladders.zones(members, rungs, "none")
    assert sorted(map(tuple, ladders.assigned(rungs).collect())) == [("a", "ifc_zone", "z1"), ("b", "derived", "z2"), ("x", "spatial_zone", "z0")]


def test_apartments(spark):
    spaces = spark.createDataFrame([("agg1", " 2-1103", None), ("r1", "2-1103-2", ""), ("r2", "2-1104-1", None), ("r3", "hall", " A7 "), ("r4", "hall", None), ("r5", None, None)], "guid string, name string, stated string")
    assert {tuple(r) for r in ladders.apartment_zones(spaces).collect()} == {("r1", "agg1"), ("r2", "2-1104"), ("r3", "A7")}


def test_children_meet_one_of_many_parents_of_equal_guids(spark):
    import time
    from bisect import bisect_left

    n = 30_000
    parents = spark.range(n).select("id", F.lit("0123456789z").alias("guid"), (F.col("id") * 977).alias("tag"), F.lit(1).alias("container"), F.lit("Pump").alias("name"))
    children = spark.range(n).select((F.col("id") + n).alias("id"), F.lit("0123456789abc").alias("guid"), (F.col("id") * 991).alias("tag"), F.lit(2).alias("container"), F.lit("my pump:3").alias("name"), F.lit(None).cast("string").alias("ref"))
    began = time.perf_counter()
    out = {r["child"]: (r["parent"], r["distance"]) for r in ladders.match_children(parents, children).collect()}
    assert time.perf_counter() - began < 60  # 900 million pairs take longer
    tags = [i * 977 for i in range(n)]
    for i in range(n):
        at = bisect_left(tags, i * 991) - 1
        assert out[i + n] == ((0, None) if at < 0 else (at, i * 991 - tags[at]))


@pytest.mark.parametrize("seed", [1, 2])
def test_children_have_the_best_of_all_parents(spark, seed):
    """Some are parents too, of other numbers; some are tied to parents by a word alone."""
    import re

    rng = random.Random(seed)
    guid = lambda: rng.choice([None, "short", *(f"0123456{a}{b}{c}" for a in "ab" for b in "xy" for c in "12")])
    parents = [(i, guid(), rng.choice([None, *range(0, 900, 50)]), rng.choice([None, *range(6)]), rng.choice([None, "Pump:1", "BigPump", "Valve", "Abc", "AIRValve:Pump"])) for i in range(60)]
    children = [(i, guid(), rng.choice([None, *range(0, 900, 30)]), rng.choice([None, *range(9)]), rng.choice([None, "a pump", "my valve:pump", "pumpvalve", "abc", "x"]), rng.choice([None, None, None, "100", "0123456ax1"])) for i in [*range(30), *range(100, 300)]]
    children += [(i, None, rng.choice([None, 0, 5000]), rng.choice([None, 0, 8]), rng.choice(["a pump", "my valve", "bigpump", "x"]), None) for i in [*range(30, 60), *range(300, 360)]]

    def score(c, p):
        near = c[2] - p[2] if c[2] is not None and p[2] is not None and c[2] > p[2] else None
        out = 200.0 * (c[5] is not None and (c[5] == str(p[2]) or c[5] == p[1]))
        if c[1] and p[1] and min(len(c[1]), len(p[1])) >= 8 and c[1][:8] == p[1][:8] and c[1] != p[1]:
            out += 100 + next((k for k in range(8, 10) if c[1][k] != p[1][k]), 10) - 8
        out += 50 * (1 - near / 100) if near is not None and near <= 100 else 0
        out += 25 * (c[3] is not None and c[3] == p[3])
        found = re.findall("[A-Z][a-z]+|[A-Z]+(?=[A-Z]|$)", (p[4] or "").split(":")[0])
        return out + 10 * any(len(w) > 3 and w.lower() in (c[4] or "").split(":")[0].lower() for w in found), near

    want = {}
    for c in children:
        ways = [(-s, n is None, n or 0, p[0]) for p in parents if p[0] != c[0] for s, n in [score(c, p)] if s > 0]
        if ways:
            best = min(ways)
            want[c[0]] = (best[3], round(-best[0], 6), None if best[1] else best[2])
    schema = "id long, guid string, tag long, container int, name string"
    out = ladders.match_children(spark.createDataFrame(parents, schema), spark.createDataFrame(children, schema + ", ref string")).collect()
    assert len(want) > 150 and any(s == 10 for _, s, _ in want.values())
    assert {r["child"]: (r["parent"], round(r["score"], 6), r["distance"]) for r in out} == want


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_centrality_counts_leaves_at_their_neighbour(spark, seed):
    pairs = [p for p in graph(seed, 16, 17) if p[0] != p[1]] + [(30, 31), (40, 41), (40, 42), (40, 43)]
    nodes, near = sorted({v for p in pairs for v in p}), adjacency(pairs)
    far = {v: distances(pairs, v) for v in nodes}

    def ways(a, b):
        return 1 if a == b else sum(ways(a, v) for v in near[b] if far[a][v] == far[a][b] - 1)

    n = len(nodes)
    want = {v: sum(ways(s, v) * ways(v, t) / ways(s, t) for s in nodes for t in far[s] if v in far[s] and len({s, t, v}) == 3 and far[s][v] + far[v][t] == far[s][t]) / ((n - 1) * (n - 2)) for v in nodes}
    raw = {v: (len(d) - 1) ** 2 / (n - 1) / sum(d.values()) for v, d in far.items()}
    low, high = min(raw.values()), max(raw.values())
    out = {r["id"]: r for r in graphs.centrality(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert {v: r["betweenness"] for v, r in out.items()} == {v: pytest.approx(x, abs=2e-6) for v, x in want.items()}
    assert {v: r["closeness"] for v, r in out.items()} == {v: pytest.approx((x - low) / (high - low), abs=2e-6) for v, x in raw.items()}


@pytest.mark.parametrize("column", ["closeness", "betweenness"])
def test_centrality_of_many_leaves_takes_no_walk_from_each(spark, column):
    n, hubs = 20_000, 10
    pairs = [(i % hubs, i + hubs) for i in range(n)] + [(i, (i + 1) % hubs) for i in range(hubs)]
    out = {r["id"]: r[column] for r in graphs.centrality(spark.createDataFrame(pairs, "src long, dst long"), max_edges=100).collect()}
    assert len(out) == n + hubs and len({out[i] for i in range(hubs)}) == 1 and out[0] > out[hubs] == 0


def test_crowded_cells_are_sliced_and_each_pair_is_met_once(spark):
    df = spark.range(1300).select(F.col("id").alias("guid"), *[F.lit(0.0).alias(f"min_{a}") for a in "xyz"], *[(F.lit(0.1) if a != "x" else F.col("id") * 1e-5 + 0.1).alias(f"max_{a}") for a in "xyz"])
    rows = [(1, *[0.0] * 3, *[0.1] * 3)]
    one = spark.createDataFrame(rows, "guid long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    out = spatial.box_pairs(df, one, 0.25)
    assert "_slice" in out._jdf.queryExecution().analyzed().toString()
    assert sorted(r["a_guid"] for r in out.collect()) == list(range(1300))


def test_cut_vertices_of_leaves_need_no_certificate_of_them(spark, monkeypatch):
    """A triangle of three hubs, a thousand leaves and chains of two on each, and a pair by itself."""
    pairs = [(0, 1), (1, 2), (2, 0), (8, 9)] + [(h, 10_000 * (h + 1) + i) for h in range(3) for i in range(1000)] + [(10_000 * (h + 1) + i, 100_000 * (h + 1) + i) for h in range(3) for i in range(100)]
    sizes, certificate = [], graphs._certificate
    monkeypatch.setattr(graphs, "_certificate", lambda e, v: sizes.append(e.count()) or certificate(e, v))
    out = sorted(r["id"] for r in graphs.articulation(spark.createDataFrame(pairs, "src long, dst long")).collect())
    assert out == [0, 1, 2] + sorted(10_000 * (h + 1) + i for h in range(3) for i in range(100))
    assert sizes == [3]
