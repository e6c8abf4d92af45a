"""Operators on small literal tables."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from girder.functions import scalars as X
from girder.operators import changes, graphs, lineage, registry, relational, selectors, spatial
from girder.sources import tables
from girder.streaming import upsert as streaming

BOX = "guid string, entity string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [
        (("IfcDuctSegment", 0, 0, 2, 5, 0.3, 2.3), ("IfcWall", 2, -0.1, 0, 2.2, 3, 3), "penetrates"),
        (("IfcDuctSegment", 1, 1, 1, 1.2, 1.2, 1.2), ("IfcSpace", 0, 0, 0, 4, 4, 3), "sits_in"),
        (("IfcFlowTerminal", 1, 1, 3.0, 1.5, 1.5, 3.5), ("IfcSlab", 0, 0, 2.8, 5, 5, 3.0), "mounted_on"),
        (("IfcFlowTerminal", 0, 0, 0, 1, 1, 1), ("IfcColumn", 0.5, 0.5, 0.5, 1.5, 1.5, 1.5), "intersects"),
        (("IfcDuctSegment", 0, 0, 0, 1, 1, 1), ("IfcWall", 1.02, 0, 0, 2, 1, 1), "within_clearance"),
        (("IfcWall", 0, 0, 0, 1, 1, 1), ("IfcSlab", 0.5, 0.5, 0.5, 2, 2, 2), None),
    ],
)
def test_pair_classes(spark, source, target, expected):
    a = spark.createDataFrame([("a", source[0], *map(float, source[1:]))], BOX)
    b = spark.createDataFrame([("b", target[0], *map(float, target[1:]))], BOX)
    found = [r["relation"] for r in spatial.classify_pairs(spatial.box_pairs(a, b, 3.0, 0.05), 0.05).collect()]
    assert found == ([expected] if expected else [])


def test_winner_keeps_lowest_or_highest_room(spark):
    rows = spark.createDataFrame([("beam", "010-200", 1), ("beam", "010-100", 2), ("beam", "050-100", 3), ("none", None, 4), ("none", None, 5)], "target string, v string, pos int")
    low = {r["v"] for r in relational.winners(rows.where("target='beam'"), "target", "v", "pos").collect()}
    high = {r["v"] for r in relational.winners(rows.where("target='beam'"), "target", "v", "pos", True).collect()}
    assert (low, high) == ({"010-100"}, {"050-100"})
    assert relational.winners(rows, "target", "v", "pos").where("target='none'").count() == 2


def test_export_columns(spark):
    df = spark.createDataFrame([("IfcWall", "g1"), ("IfcBuildingStorey", "g2"), ("IfcDoor", "g3")], "entity string, guid string")
    assert selectors.of_type(df, "IfcElement").count() == 2
    assert selectors.of_type(df, "IfcProduct").count() == 3
    assert selectors.select_columns(df, [("GlobalId", "guid")]).columns == ["GlobalId"]
    with pytest.raises(ValueError):
        selectors.select_columns(df, [("X", "nope")])


def test_selector_parsing():
    s = selectors.Selector.parse("IfcWall, Pset.Fire='A, b', Qto.Width=0.5")
    assert s.entity == "IfcWall"
    assert s.conditions == (("Pset", "Fire", "A, b"), ("Qto", "Width", "0.5"))
    assert selectors.Selector.parse("").entity == "IfcElement"


def test_diamond_has_one_row_a_path(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "parent_id long, child_id long")
    s = spark.createDataFrame([(4,)], "id long")
    assert lineage.walk(e, s, 5, up=True).where("node = 1").count() == 2
    assert lineage.walk(e, s, 5, up=True, distinct=True).where("node = 1").count() == 1


@pytest.fixture
def few_rows(spark):
    """Recursive queries of a session may make a million rows by default; here ten."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    yield spark.range(1, 200).select((F.col("id") / 2).cast("long").alias("parent_id"), F.col("id").alias("child_id"))
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_lineage_up_has_no_limit_of_rows(few_rows):
    out = lineage.walk(few_rows, few_rows.select(F.col("child_id").alias("id")), 10, up=True)
    assert out.count() == sum(i.bit_length() for i in range(1, 200))


def test_nearest_value_has_no_limit_of_rows(few_rows):
    ids = few_rows.select(F.col("child_id").alias("id"))
    values = ids.select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("value"))
    out = {r["start"]: r["value"] for r in lineage.nearest_with_value(lineage.walk(few_rows, ids, 10, up=True), values).collect()}
    near = lambda i: None if i < 1 else i if i % 3 == 0 else near(i // 2)
    assert out == {i: near(i // 2) for i in range(1, 200) if near(i // 2)}


def test_nearest_value_weighs_steps_as_its_sql_does(spark):
    up = spark.createDataFrame([(9, 3_000_000, 1), (9, 1_000_000, 2)], "start long, node long, depth int")
    values = spark.createDataFrame([(3_000_000, "near"), (1_000_000, "far")], "id long, value string")
    assert lineage.nearest_with_value(up, values).first()["value"] == "near"
    assert lineage.nearest_with_value(up, values, F.col("depth") * 1000000 + F.col("node")).first()["value"] == "far"


@pytest.fixture
def few_rows_tree(spark, few_rows):
    """A project (1), a building (2), storeys (3 to 9) and 90 walls, as a tree of more rows than the limit."""
    rows = [(1, 2)] + [(2, s) for s in range(3, 10)] + [(3 + i % 7, 10 + i) for i in range(90)]
    kinds = {1: "IfcProject", 2: "IfcBuilding"} | {s: "IfcBuildingStorey" for s in range(3, 10)}
    types = spark.createDataFrame([(i, kinds.get(i, "IfcWall")) for i in range(1, 100)], "id long, entity string")
    tree = spark.createDataFrame(rows, "parent_id long, child_id long")
    return lambda kind: sorted(tuple(r) for r in lineage.traverse(tree, kind, types.select("id"), types).collect())


def test_ancestors_has_no_limit_of_rows(few_rows_tree):
    assert few_rows_tree("ancestors") == sorted([(2, 1, 1)] + [x for s in range(3, 10) for x in ((s, 2, 1), (s, 1, 2))] + [x for w in range(10, 100) for x in ((w, 3 + (w - 10) % 7, 1), (w, 2, 2), (w, 1, 3))])


def test_building_of_has_no_limit_of_rows(few_rows_tree):
    assert few_rows_tree("building_of") == sorted([(s, 2, 1) for s in range(3, 10)] + [(w, 2, 2) for w in range(10, 100)])


def test_storey_of_has_no_limit_of_rows(few_rows_tree):
    assert few_rows_tree("storey_of") == [(w, 3 + (w - 10) % 7, 1) for w in range(10, 100)]


def test_lineage_down_has_no_limit_of_rows(few_rows):
    out = lineage.walk(few_rows, few_rows.select(F.col("child_id").alias("id")), 10, up=False)
    assert out.count() == sum(i.bit_length() - 1 for i in range(1, 200))


def test_lineage_down_has_no_limit_of_depth(spark, tmp_path):
    from girder.plans import catalog, models

    rows = [(3**k, "view" if k else "signup") for k in range(15)]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(tuple(r) for r in models.lineage_down(catalog.Tables(spark, str(tmp_path))).collect()) == [(1, 3**k, k) for k in range(1, 15)]


def test_walk_without_depth_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (3, 4), (5, 5)], "parent_id long, child_id long")
    out = lineage.walk(edges, edges.select(F.col("parent_id").alias("id")).where("id IN (1, 5)").distinct(), None, up=False)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]


def test_path_tree_has_no_limit_of_rows(few_rows):
    out = {r["node"]: (r["depth"], r["path"]) for r in lineage.tree_paths(few_rows, few_rows.where("child_id = 1").select(F.col("child_id").alias("id")), 5).collect()}
    path = lambda i: str(i) if i == 1 else f"{path(i // 2)}/{i}"
    assert out == {i: (i.bit_length() - 1, path(i)) for i in range(1, 64)}


def test_subset_with_ancestors_has_no_limit_of_rows(few_rows):
    ids = few_rows.select(F.col("child_id").alias("id"))
    out = {r["id"]: r["parent_id"] for r in lineage.subset_with_ancestors(few_rows, ids.where("id >= 100"), ids.where("id = 6"), 10).collect()}
    assert out == {i: 3 if i in (12, 13) else i // 2 if i else None for i in [0, *(i for i in range(1, 200) if i != 6 and (i >= 100 or i < 50 or i in range(50, 100)))]}


def test_children_has_no_limit_of_rows(few_rows_tree):
    assert few_rows_tree("children") == sorted([(1, 2, 1)] + [(2, s, 1) for s in range(3, 10)] + [(3 + (w - 10) % 7, w, 1) for w in range(10, 100)])


def test_descendants_has_no_limit_of_rows(few_rows_tree):
    assert few_rows_tree("descendants") == sorted([(1, 2, 1)] + [x for s in range(3, 10) for x in ((1, s, 2), (2, s, 1))] + [x for w in range(10, 100) for x in ((1, w, 3), (2, w, 2), (3 + (w - 10) % 7, w, 1))])


def test_parent_has_no_limit_of_rows(few_rows_tree):
    assert few_rows_tree("parent") == sorted([(2, 1, 1)] + [(s, 2, 1) for s in range(3, 10)] + [(w, 3 + (w - 10) % 7, 1) for w in range(10, 100)])


def test_products_in_has_no_limit_of_rows(few_rows_tree):
    assert few_rows_tree("products_in") == sorted(x for w in range(10, 100) for x in ((1, w, 3), (2, w, 2), (3 + (w - 10) % 7, w, 1)))


def test_upsert_merges_json(spark):
    old = spark.createDataFrame([("k", '{"a":"1","b":"1"}', None), ("o", None, "x")], "k string, meta string, v string")
    new = spark.createDataFrame([("k", '{"b":"2"}', "y"), ("n", "{}", None)], "k string, meta string, v string")
    out = {r["k"]: r for r in changes.upsert(old, new, ["k"], json=["meta"]).collect()}
    assert out["k"]["meta"] == '{"a":"1","b":"2"}' and out["k"]["v"] == "y" and len(out) == 3


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    prints = {relational.fingerprint(df.repartition(n), ["id", "v"]).first()[0] for n in (1, 4, 20)}
    assert len(prints) == 1
    assert relational.fingerprint(df.where("id > 0"), ["id", "v"]).first()[0] not in prints


def _brute_betweenness(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    nodes = sorted(near)
    score = dict.fromkeys(nodes, 0.0)

    def paths(s, t):
        queue, best, out = deque([[s]]), None, []
        while queue:
            p = queue.popleft()
            if best and len(p) > best:
                break
            if p[-1] == t:
                best = len(p)
                out.append(p)
                continue
            queue.extend([*p, w] for w in near[p[-1]] if w not in p)
        return out

    for i, s in enumerate(nodes):
        for t in nodes[i + 1 :]:
            found = paths(s, t)
            for p in found:
                for v in p[1:-1]:
                    score[v] += 1 / len(found)
    n = len(nodes)
    return {v: x * 2 / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_and_bridges(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(12)})
    df = spark.createDataFrame(pairs, "src long, dst long")
    want = _brute_betweenness(pairs)
    for r in graphs.centrality(df).collect():
        assert abs(r["betweenness"] - want[r["id"]]) < 1e-5

    def parts(edges):
        left = {v for p in pairs for v in p}
        n = 0
        while left:
            n += 1
            queue = [left.pop()]
            while queue:
                v = queue.pop()
                for a, b in edges:
                    for x, y in ((a, b), (b, a)):
                        if x == v and y in left:
                            left.remove(y)
                            queue.append(y)
        return n

    bridges = {(a, b) for a, b in pairs if parts([p for p in pairs if p != (a, b)]) > parts(pairs)}
    assert {(r["src"], r["dst"]) for r in graphs.bridges(df).collect()} == bridges
    assert graphs.components(df).select("component").distinct().count() == parts(pairs)


def test_parallel_edges_are_no_bridge(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long")
    assert [tuple(r) for r in graphs.bridges(df).collect()] == [(2, 3)]


def test_communities_are_the_cliques(spark):
    two = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10)]
    out = {r["id"]: r["community"] for r in graphs.communities(spark.createDataFrame(two, "src long, dst long")).collect()}
    assert len({out[i] for i in range(5)}) == 1 and len({out[i] for i in range(10, 15)}) == 1 and out[0] != out[10]


def test_nearest_box_looks_as_far_as_needed(spark):
    boxes = spark.createDataFrame([("s", "IfcSpace", 100.0, 100.0, 0.0, 101.0, 101.0, 3.0)], BOX)
    points = spark.createDataFrame([("p", 0.0, 0.0, 0.0)], "guid string, x double, y double, z double")
    assert round(spatial.nearest_box(points, boxes, "guid", 0.5).first()["distance"], 3) == 141.421


def test_registry():
    @registry.register("test.recipe", {"tol": "tolerance"})
    def recipe(name: str, tolerance: float = 0.1, deep: bool = False):
        return name, tolerance, deep

    assert registry.call("test.recipe", "a", "0.5", deep="yes") == ("a", 0.5, True)
    assert registry.call("test.recipe", "a", tol="2") == ("a", 2.0, False)
    assert registry.parameters("test.recipe")[1] == ("tolerance", "float", 0.1)
    with pytest.raises(TypeError):
        registry.call("test.recipe", "a", wrong=1)


def test_blank_and_numbers(spark):
    df = spark.createDataFrame([(" None ", "1.0", "1"), ("x", "a ", "a"), (None, "1", "a")], "t string, a string, b string")
    out = df.select(X.blank_to_null(F.col("t")).alias("t"), X.same_value(F.col("a"), F.col("b")).alias("e")).collect()
    assert [tuple(r) for r in out] == [(None, True), ("x", True), (None, False)]


def test_write_refuses_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), str(tmp_path / "x"), ".parquet")


def test_stream_upsert(spark, tmp_path):
    schema = "job_id string, status string, note string, n int"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "queued", "first", 1), ("b", "queued", None, 1)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    run = lambda: streaming.job_history_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["job_id"], "n", overwrite=["status"], keep_old=False).awaitTermination()
    run()
    spark.createDataFrame([("a", "finished", None, 2)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    out = {r["job_id"]: r for r in streaming.read_current(spark, str(tmp_path / "t"), schema, 1).collect()}
    assert out["a"]["status"] == "finished" and out["a"]["note"] == "first" and out["b"]["status"] == "queued"
