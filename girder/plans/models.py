"""Lineage, containment, relations between elements, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import graphs as G
from ..operators import ladders as D
from ..operators import lineage as L
from ..operators import relational as R
from ..operators import rules as V
from .catalog import query
from .graphs import TREE, tree


def _edges(t):
    return tree(t).select(F.col("src").alias("parent_id"), F.col("dst").alias("child_id"))


_UP = f"WITH RECURSIVE {TREE}, a(start, node, depth) AS (SELECT dst, src, 1 FROM tree UNION ALL SELECT a.start, t.src, depth + 1 FROM a JOIN tree t ON t.dst = a.node WHERE depth < 10)"


@query(f"{_UP} SELECT start, node, depth FROM a")
def lineage_up(t):
    e = _edges(t)
    return L.walk(e, e.select(F.col("child_id").alias("id")).distinct(), 10, up=True)


@query(f"WITH RECURSIVE {TREE}, a(start, node, depth) AS (SELECT event_id, dst, 1 FROM events JOIN tree ON src = event_id WHERE event_type = 'signup' UNION ALL SELECT a.start, t.dst, depth + 1 FROM a JOIN tree t ON t.src = a.node) SELECT start, node, depth FROM a")
def lineage_down(t):
    """All descendants of all roots, however deep."""
    return L.walk(_edges(t), t.events.where("event_type = 'signup'").select(F.col("event_id").alias("id")), None, up=False)


@query(f"{_UP} SELECT start, arg_min(v, depth * 1000000 + node) AS value FROM a JOIN (SELECT event_id AS id, event_type AS v FROM events WHERE event_id % 4 = 0) x ON x.id = a.node GROUP BY 1")
def nearest_value(t):
    """G02, in the order of the SQL, where a step weighs as much as a million ids."""
    up = lineage_up(t)
    return L.nearest_with_value(up, t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("value")), F.col("depth") * 1000000 + F.col("node"))


@query(f"WITH RECURSIVE {TREE}, a(node, depth, path) AS (SELECT event_id, 0, CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'signup' UNION ALL SELECT t.dst, depth + 1, path || '/' || t.dst FROM a JOIN tree t ON t.src = a.node WHERE depth < 5) SELECT node, depth, path FROM a")
def path_tree(t):
    """The trees of all roots, five levels deep."""
    return L.tree_paths(_edges(t), t.events.where("event_type = 'signup'").select(F.col("event_id").alias("id")), 5)


@query(f"WITH {TREE} SELECT dst AS child_id, src || ':' || event_type AS parents FROM tree JOIN events ON event_id = src")
def job_lineage(t):
    out = L.children_list(_edges(t), t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("name")))
    return out.select("child_id", F.array_join(F.transform("parents", lambda p: F.concat(p["parent_id"].cast("string"), F.lit(":"), p["name"])), ",").alias("parents"))


def _containment(t):
    """A model's tree: a project, regions as sites, nations as buildings, customers as storeys, orders as elements."""
    key = lambda c, table: F.col(c).cast("long") * 10 + table
    p = t.region.select(F.lit(0).cast("long").alias("parent_id"), key("r_regionkey", 1).alias("child_id"))
    p = p.union(t.nation.select(key("n_regionkey", 1), key("n_nationkey", 2))).union(t.customer.select(key("c_nationkey", 2), key("c_custkey", 3)))
    entity = F.element_at(F.array(*[F.lit(x) for x in ("IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcWall")]), (F.col("child_id") % 10).cast("int"))
    tree = p.union(t.orders.select(key("o_custkey", 3), key("o_orderkey", 4)))
    return tree, tree.select(F.col("child_id").alias("id"), entity.alias("entity")).union(t.rows([(0, "IfcProject")], "id long, entity string"))


_TREE = """m AS (SELECT 0 AS p, CAST(r_regionkey AS BIGINT) * 10 + 1 AS c FROM region UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 10 + 1, CAST(n_nationkey AS BIGINT) * 10 + 2 FROM nation
  UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 10 + 2, c_custkey * 10 + 3 FROM customer UNION ALL SELECT o_custkey * 10 + 3, o_orderkey * 10 + 4 FROM orders)"""


def _traversal(kind: str, sql: str):
    """One traversal from every node of the tree (from buildings down, for those that go all the way)."""

    def run(t):
        tree, types = _containment(t)
        starts = types.where("entity = 'IfcBuilding'") if kind in ("descendants", "products_in") else types
        return L.traverse(tree, kind, starts.select("id"), types)

    run.__name__ = f"traverse_{kind}"
    return query(f"WITH {_TREE} {sql}")(run)


_traversal("parent", "SELECT c AS start, p AS node, 1 AS depth FROM m")
_traversal("children", "SELECT p AS start, c AS node, 1 AS depth FROM m")
_traversal("ancestors", "SELECT c AS start, p AS node, 1 AS depth FROM m UNION ALL SELECT a.c, b.p, 2 FROM m a JOIN m b ON a.p = b.c UNION ALL SELECT a.c, x.p, 3 FROM m a JOIN m b ON a.p = b.c JOIN m x ON b.p = x.c UNION ALL SELECT a.c, y.p, 4 FROM m a JOIN m b ON a.p = b.c JOIN m x ON b.p = x.c JOIN m y ON x.p = y.c")
_traversal("descendants", "SELECT p AS start, c AS node, 1 AS depth FROM m WHERE p % 10 = 2 UNION ALL SELECT a.p, b.c, 2 FROM m a JOIN m b ON a.c = b.p WHERE a.p % 10 = 2")
_traversal("storey_of", "SELECT c AS start, p AS node, 1 AS depth FROM m WHERE c % 10 = 4")
_traversal("building_of", "SELECT c AS start, p AS node, 1 AS depth FROM m WHERE c % 10 = 3 UNION ALL SELECT a.c, b.p, 2 FROM m a JOIN m b ON a.p = b.c WHERE a.c % 10 = 4")
_traversal("products_in", "SELECT a.p AS start, b.c AS node, 2 AS depth FROM m a JOIN m b ON a.c = b.p WHERE a.p % 10 = 2")


_DAG = "dag AS (SELECT src, dst FROM tree UNION SELECT event_id // 2, event_id FROM events WHERE event_type = 'error' AND event_id > 0)"


@query(f"WITH RECURSIVE {TREE}, {_DAG}, n AS (SELECT src AS id FROM dag UNION SELECT dst FROM dag), a(id, d) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT dst FROM dag) UNION SELECT dst, d + 1 FROM a JOIN dag ON src = a.id), l AS (SELECT id, max(d) AS level FROM a GROUP BY 1) SELECT id, level, false AS on_cycle, row_number() OVER (ORDER BY level, id) AS position FROM l")
def topo_order(t):
    """Over links i to i div 3, and of errors also to i div 2, so nodes have several parents and ways to them."""
    more = t.events.where("event_type = 'error' AND event_id > 0").select(F.floor(F.col("event_id") / 2).cast("long").alias("parent_id"), F.col("event_id").alias("child_id"))
    e = _edges(t).union(more).distinct()
    return L.topological_order(e, e.select(F.col("parent_id").alias("id")).union(e.select("child_id")).distinct())


@query(f"""{_UP}, x AS (SELECT event_id AS id FROM events WHERE event_type = 'view'), kept AS (SELECT event_id AS id FROM events WHERE event_type = 'purchase'), clo AS (SELECT id FROM kept UNION SELECT node FROM a JOIN kept ON start = id), c2 AS (SELECT id FROM clo WHERE id NOT IN (SELECT id FROM x))
  SELECT c2.id, arg_min(node, depth) FILTER (node NOT IN (SELECT id FROM x)) AS parent_id FROM c2 LEFT JOIN a ON a.start = c2.id GROUP BY 1""")
def subset_with_ancestors(t):
    """All purchases with their ancestors; views are skipped."""
    of_type = lambda x: t.events.where(F.col("event_type") == x).select(F.col("event_id").alias("id"))
    return L.subset_with_ancestors(_edges(t), of_type("purchase"), of_type("view"), 10)


_SPEC = "SELECT o_orderkey AS guid, 'Walls|status is F' AS rule, o_orderstatus = 'F' AS passed, CASE WHEN o_orderstatus <> 'F' THEN 'wrong status' END AS reason FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'Doors|price', o_totalprice > 100000, CASE WHEN NOT o_totalprice > 100000 THEN 'too cheap' END FROM orders"


def _specs(t):
    c = F.col
    return V.check_specs(t.orders, "o_orderkey", [("Walls", "status is F", c("o_orderpriority") == "1-URGENT", c("o_orderstatus") == "F", "wrong status"), ("Doors", "price", F.lit(True), c("o_totalprice") > 100000, "too cheap")])


@query(_SPEC)
def spec_rows(t):
    return _specs(t)


@query(_SPEC)
def spec_report_rows(t):
    """The same results by way of the nested report of a checker, one report a row."""
    s = _specs(t).select(F.split("rule", r"\|").alias("p"), F.col("guid").cast("string").alias("guid"), "passed", "reason")
    none = F.array().cast("array<string>")
    failed = F.array(F.struct("guid", "reason"))
    req = F.struct(F.col("p")[1].alias("description"), F.when(F.col("passed"), F.array("guid")).otherwise(none).alias("passed_entities"), F.when(~F.col("passed"), failed).otherwise(F.array().cast("array<struct<guid:string,reason:string>>")).alias("failed_entities"))
    doc = F.to_json(F.struct(F.array(F.struct(F.col("p")[0].alias("name"), F.array(req).alias("requirements"))).alias("specifications")))
    return V.report_rows(s.select(doc.alias("doc")), "doc").select(F.col("guid").cast("long").alias("guid"), "rule", "passed", "reason")


@query(f"SELECT * FROM ({_SPEC})")
def rules_insert(t):
    """Inserting the same results again adds nothing."""
    from ..operators.changes import insert_absent

    s = _specs(t)
    return insert_absent(s.where("passed"), s, ["guid", "rule"])


@query("SELECT p_partkey AS guid, 'Common' AS pset, 'Size' AS prop, CASE WHEN p_type = 'SMALL' THEN 'S-' || p_brand ELSE CAST(p_size AS VARCHAR) END AS value FROM part")
def property_write(t):
    props = t.part.select(F.col("p_partkey").alias("guid"), F.lit("Common").alias("pset"), F.lit("Size").alias("prop"), F.col("p_size").cast("string").alias("value"))
    return V.write_property(props, t.part.where("p_type = 'SMALL'").withColumnRenamed("p_partkey", "guid"), "Common", "Size", F.concat(F.lit("S-"), F.col("p_brand")))


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice - s.e) <= 4000 THEN s.g END AS storey FROM (SELECT o_orderkey, o_totalprice, (SELECT min(struct_pack(d := abs(n_nationkey * 20000 - o_totalprice), e := n_nationkey * 20000, g := n_name)) FROM nation) AS s FROM orders)")
def storey_asof(t):
    storeys = t.nation.select((F.col("n_nationkey") * 20000).cast("double").alias("elevation"), F.col("n_name").alias("guid"))
    return V.nearest_storey(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", storeys, 4000).select("o_orderkey", "storey")


@query("SELECT n_regionkey, n_nationkey AS guid, lead(n_nationkey * 3.5) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS top FROM nation")
def storey_tops(t):
    s = t.nation.select("n_regionkey", F.col("n_nationkey").alias("guid"), (F.col("n_nationkey") * 3.5).alias("elevation"))
    return V.storey_tops(s, "n_regionkey").select("n_regionkey", "guid", "top")


@query("SELECT 'contained_in' AS relation, o_orderkey AS child, o_custkey AS parent FROM orders UNION ALL SELECT 'aggregates', c_custkey, c_nationkey FROM customer")
def containment_edges(t):
    a = t.orders.select(F.lit("contained_in").alias("relation"), F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"))
    return a.unionByName(t.customer.select(F.lit("aggregates").alias("relation"), F.col("c_custkey").alias("child"), F.col("c_nationkey").cast("long").alias("parent")))


@query("SELECT DISTINCT 'flow_connected' AS relation, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem WHERE l_partkey <> l_suppkey UNION ALL SELECT 'member_of_system', s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier UNION ALL SELECT DISTINCT 'connected_port', l_orderkey, l_partkey FROM lineitem")
def system_edges(t):
    """Elements that ports connect, elements in systems, ports on elements."""
    flow = R.unordered(t.lineitem, "l_partkey", "l_suppkey").select(F.lit("flow_connected").alias("relation"), "low", "high")
    member = t.supplier.select(F.lit("member_of_system").alias("relation"), F.col("s_suppkey").alias("low"), F.col("s_nationkey").cast("long").alias("high"))
    ports = t.lineitem.select(F.lit("connected_port").alias("relation"), F.col("l_orderkey").alias("low"), F.col("l_partkey").alias("high")).distinct()
    return flow.unionByName(member).unionByName(ports)


@query("SELECT CASE WHEN l_returnflag = 'A' THEN 'analytical' ELSE 'physical' END AS relation, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2, 3")
def structural_edges(t):
    kinds = [("analytical", "l_returnflag = 'A'"), ("physical", "l_returnflag <> 'A'")]
    out = [R.unordered(t.lineitem.where(w), "l_partkey", "l_suppkey").select(F.lit(k).alias("relation"), "low", "high") for k, w in kinds]
    return out[0].unionByName(out[1])


@query("SELECT DISTINCT l_partkey AS element, o_custkey AS host FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def hosting_edges(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("element"), F.col("o_custkey").alias("host")).distinct()


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL')")
def adjacency_filtered(t):
    """Adjacency between spaces alone: both ends must be space nodes."""
    nodes = t.part.where("p_type = 'SMALL'").select("p_partkey")
    e = R.unordered(t.lineitem, "l_partkey", "l_suppkey")
    return e.join(nodes, e.low == nodes.p_partkey, "left_semi").join(nodes, F.col("high") == nodes.p_partkey, "left_semi")


@query("SELECT DISTINCT l_orderkey AS portal, l_suppkey AS space FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2)")
def portal_edges(t):
    return G.two_hop(t.lineitem.select(F.col("l_orderkey").alias("portal"), F.col("l_suppkey").alias("space")), "portal", "space")


@query("SELECT cluster, m.g AS hub, m.r AS rule FROM (SELECT o_custkey AS cluster, min(struct_pack(r := CASE WHEN n >= 5 THEN 1 WHEN n >= 3 THEN 2 WHEN o_orderpriority LIKE '%HIGH%' THEN 3 ELSE 4 END, name := o_orderpriority, g := o_orderkey)) AS m FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)")
def cluster_hub(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rooms = t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("guid"), F.regexp_replace("o_orderpriority", "HIGH", "HALL").alias("name"), F.when(F.col("n") >= 5, 2).when(F.col("n") >= 3, 1).otherwise(0).alias("corridor_neighbours"))
    return G.hubs(rooms)


@query("SELECT l_orderkey AS portal, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS spaces FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def boundary_map(t):
    """Spaces that a portal's physical boundaries touch; virtual ones are left out."""
    b = t.lineitem.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("portal")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("s"))
    return b.select("portal", F.array_join(F.array_sort("s"), ",").alias("spaces"))


@query("SELECT count(DISTINCT l_orderkey) AS portals, count(*) AS links, 'navmesh+plan_sides+stair_element' AS method, count_if(l_linestatus = 'F') AS cross_storey, count_if(l_returnflag = 'R') AS stair_links FROM lineitem")
def egress_summary(t):
    method = F.when(F.col("l_returnflag") == "R", "stair_element").when(F.col("l_returnflag") == "A", "plan_sides").otherwise("navmesh")
    return V.egress_summary(t.lineitem.select(F.col("l_orderkey").alias("portal"), F.col("l_suppkey").alias("space"), method.alias("method"), (F.col("l_linestatus") == "F").alias("crosses")))


@query("""SELECT 'storey' AS relation, o_orderkey AS space, CAST(o_custkey AS VARCHAR) AS target FROM orders UNION ALL SELECT DISTINCT 'zone', o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'apartment', p_partkey, CASE WHEN p_partkey % 7 = 1 THEN 'given' ELSE coalesce((SELECT CAST(min(q.p_partkey) AS VARCHAR) FROM part q WHERE q.p_partkey % 5 = 0 AND q.p_size = part.p_size), '2-' || p_size) END FROM part WHERE p_partkey % 5 BETWEEN 1 AND 2 OR (p_partkey % 7 = 1 AND p_partkey % 5 <> 0)""")
def space_edges(t):
    a = t.orders.select(F.lit("storey").alias("relation"), F.col("o_orderkey").alias("space"), F.col("o_custkey").cast("string").alias("target"))
    z = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.lit("zone").alias("relation"), F.col("o_orderkey").alias("space"), F.col("c_mktsegment").alias("target")).distinct()
    i = F.col("p_partkey") % 5
    name = F.when(i == 0, F.concat(F.lit(" 2-"), F.col("p_size").cast("string"))).when(i <= 2, F.concat(F.lit("2-"), F.col("p_size").cast("string"), F.lit("-"), i.cast("string"))).otherwise("hall")
    rooms = t.part.select(F.col("p_partkey").alias("guid"), name.alias("name"), F.when(F.col("p_partkey") % 7 == 1, "given ").otherwise(" ").alias("stated"))
    return a.unionByName(z).unionByName(D.apartment_zones(rooms).select(F.lit("apartment").alias("relation"), "space", F.col("zone").alias("target")))


@query("SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name")
def triple_edges(t):
    """Triples to edges between elements; schema predicates and loops are dropped."""
    n, r = t.nation, t.region
    triples = n.select(F.concat(F.lit("urn:n/"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("bot#in").alias("p"), F.concat(F.lit("urn:r/"), F.col("n_regionkey").cast("string")).alias("o"))
    triples = triples.unionByName(n.select(F.concat(F.lit("urn:n/"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("rdf-syntax-ns#type").alias("p"), F.lit("bot#Zone").alias("o")))
    names = n.select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("k"), F.col("n_name").alias("g")).union(r.select(F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")), "r_name"))
    key = lambda c: F.regexp_replace(c, "^urn:", "")
    rows = triples.where(~F.col("p").rlike("(rdf-syntax-ns|rdf-schema|owl)#")).select(key("s").alias("s"), key("o").alias("o"))
    out = rows.join(names.withColumnsRenamed({"k": "s", "g": "a"}), "s").join(names.withColumnsRenamed({"k": "o", "g": "b"}), "o")
    return out.where("a <> b").select("a", "b")


_RDFS, _RDF = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@query(f"""WITH c AS (SELECT 'urn:c' || c_custkey AS s, 'urn:n' || c_nationkey AS o FROM customer), sc AS (SELECT 'urn:Element' AS lo, 'urn:Product' AS hi UNION ALL SELECT 'urn:Product', 'urn:Root' UNION ALL SELECT 'urn:Zone', 'urn:Root'),
  d AS (SELECT s, 'urn:in' AS p, o FROM c UNION SELECT s, 'urn:within', o FROM c UNION SELECT s, '{_RDF}type', x FROM c, (VALUES ('urn:Element'), ('urn:Product'), ('urn:Root')) v(x) UNION SELECT o, '{_RDF}type', x FROM c, (VALUES ('urn:Zone'), ('urn:Root')) v(x)
    UNION SELECT lo, '{_RDFS}subClassOf', hi FROM sc UNION SELECT 'urn:Element', '{_RDFS}subClassOf', 'urn:Root' UNION SELECT 'urn:in', '{_RDFS}subPropertyOf', 'urn:within' UNION SELECT 'urn:within', '{_RDFS}domain', 'urn:Element' UNION SELECT 'urn:in', '{_RDFS}range', 'urn:Zone')
  SELECT s, p, o FROM d""")
def inferred_triples(t):
    """What the schema's classes, properties, domains and ranges entail for all customers."""
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    data = t.customer.select(key("urn:c", "c_custkey").alias("s"), F.lit("urn:in").alias("p"), key("urn:n", "c_nationkey").alias("o"))
    schema = [("urn:Element", "subClassOf", "urn:Product"), ("urn:Product", "subClassOf", "urn:Root"), ("urn:Zone", "subClassOf", "urn:Root"), ("urn:in", "subPropertyOf", "urn:within"), ("urn:within", "domain", "urn:Element"), ("urn:in", "range", "urn:Zone")]
    return D.rdfs(data.unionByName(t.rows([(s, _RDFS + p, o) for s, p, o in schema], "s string, p string, o string")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'old' WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN 'C1' WHEN o_totalprice > 200000 AND o_orderkey % 5 <> 0 THEN 'C2' END AS assigned, o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AND (o_orderstatus = 'F' OR o_totalprice > 200000) AS written, CASE WHEN NOT (o_orderstatus = 'F' OR o_totalprice > 200000) THEN 'no_rule' WHEN o_orderkey % 5 = 0 THEN 'duplicate_owned' WHEN o_orderkey % 6 = 0 THEN 'has_value' ELSE 'written' END AS reason FROM orders")
def assign_by_rules(t):
    """The first rule that fits, but for elements that another one owns or that have a value."""
    owner = F.when(F.col("o_orderkey") % 5 == 0, "other").when(F.col("o_orderkey") % 3 == 0, " Undefined")
    return V.assign_by_rules(t.orders, "o_orderkey", [(F.col("o_orderstatus") == "F", "C1"), (F.lit(True), ""), (F.col("o_totalprice") > 200000, "C2")], owner, F.when(F.col("o_orderkey") % 6 == 0, "old"))


@query("SELECT l_orderkey AS element, CAST(l_suppkey AS VARCHAR) AS space, CASE WHEN l_linenumber = 1 THEN 0.9 ELSE l_discount END AS confidence FROM lineitem WHERE l_returnflag = 'A' AND (l_linenumber = 1 OR l_discount >= 0.05)")
def stamped_rooms(t):
    """Rooms by the stamp on each element."""
    status = F.when(F.col("l_returnflag") == "A", "Contained ").when(F.col("l_returnflag") == "R", "Ambiguous").otherwise("")
    score = F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.col("l_discount").cast("string"))
    return D.stamped_rooms(t.lineitem.select(F.col("l_orderkey").alias("element"), F.col("l_suppkey").cast("string").alias("space"), status.alias("status"), score.alias("confidence")), 0.05)


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN regexp_matches(text, '(?i)token|password') THEN 'secret' WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'english' END AS slug, regexp_extract(text, '\\b(\\d{3})-\\d{3,}', 1) AS prefix FROM documents""")
def label_ladder(t):
    rules = [("license", "license"), ("token|password", "secret"), (r"\bthe\b", "english")]
    return t.documents.select("doc_id", X.slug_ladder(F.col("text"), rules).alias("slug"), F.regexp_extract("text", r"\b(\d{3})-\d{3,}", 1).alias("prefix"))


@query("SELECT p_partkey, 'measure_size' AS relation, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'measure_price', p_retailprice FROM part")
def space_measures(t):
    """One relation a measure, by unpivoting."""
    m = t.part.select("p_partkey", F.col("p_size").cast("double").alias("measure_size"), F.col("p_retailprice").alias("measure_price"))
    return m.unpivot(["p_partkey"], ["measure_size", "measure_price"], "relation", "value")


@query("SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'trapphus' WHEN p_type = 'LARGE' AND p_size % 2 = 0 THEN 'centralort' WHEN p_type = 'LARGE' THEN 'korridor' WHEN p_type = 'PROMO' THEN 'bostad' END AS function FROM part")
def space_functions(t):
    """An earlier rule wins even where a later label has it."""
    long_name = F.when(F.col("p_type") == "SMALL", "Trapphus 2").when(F.col("p_type") == "LARGE", "x korridor").otherwise(" ")
    name = F.when(F.col("p_type") == "PROMO", "3 rok").when(F.col("p_size") % 2 == 0, "plan 2")
    reference = F.when((F.col("p_type") == "LARGE") & (F.col("p_size") % 2 == 0), "El central 3")
    return t.part.select("p_partkey", V.space_function(long_name, name, reference).alias("function"))
