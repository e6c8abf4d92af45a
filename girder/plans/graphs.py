"""Graphs: degrees, walks, bridges, centrality, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from .catalog import query
from .spaces import B, boxes


def _supply(t):
    return t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))


def tree(t):
    """A forest over all events: a signup is a root, any other event i hangs on event i div 3."""
    up = F.floor(F.col("event_id") / 3).cast("long")
    return t.events.where((F.col("event_type") != "signup") & (up != F.col("event_id"))).select(up.alias("src"), F.col("event_id").alias("dst"))


TREE = "tree AS (SELECT event_id // 3 AS src, event_id AS dst FROM events WHERE event_type <> 'signup' AND event_id // 3 <> event_id)"


def _whole(t):
    """Orders on customers, customers and suppliers on nations, suppliers beside parts: one large component with cycles."""
    key = lambda c, table: (F.col(c).cast("long") * 10 + table)
    links = [(t.orders, ("o_orderkey", 1), ("o_custkey", 2)), (t.customer, ("c_custkey", 2), ("c_nationkey", 3)), (t.supplier, ("s_suppkey", 4), ("s_nationkey", 3)), (t.lineitem, ("l_suppkey", 4), ("l_partkey", 5))]
    out = [df.select(key(*a).alias("src"), key(*b).alias("dst")) for df, a, b in links]
    return out[0].union(out[1]).union(out[2]).union(out[3])


#: Suppliers and parts hang together without bridges or cut vertices, but for parts with one supplier.
_LONE = """one AS (SELECT l_partkey AS part, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1 HAVING count(*) = 1), sole AS (SELECT s_nationkey AS nation, min(s_suppkey) AS supplier FROM supplier GROUP BY 1 HAVING count(*) = 1)"""


@query("SELECT id, count(*) AS degree FROM (SELECT l_suppkey AS id FROM lineitem UNION ALL SELECT l_partkey + 1000000 FROM lineitem) GROUP BY 1")
def degree(t):
    return G.degree(_supply(t))


@query("SELECT l_suppkey AS id, string_agg(DISTINCT CAST(l_partkey + 1000000 AS VARCHAR), ',' ORDER BY CAST(l_partkey + 1000000 AS VARCHAR)) AS neighbours FROM lineitem GROUP BY 1")
def neighbours(t):
    out = G.neighbours(_supply(t)).where("id < 1000000")
    return out.select("id", F.array_join(F.array_sort(F.transform("neighbours", lambda x: x.cast("string"))), ",").alias("neighbours"))


@query("WITH RECURSIVE w(id, hops, under) AS (SELECT 0, 0, false UNION ALL SELECT event_id, hops + 1, under OR event_id = 1 FROM w JOIN events ON event_id // 3 = w.id AND event_id > 0) SELECT id, CASE WHEN under THEN hops - 1 ELSE hops + 1 END AS hops FROM w")
def shortest_hops(t):
    """From one event to all others over the links i to i div 3, however far."""
    links = t.events.where("event_id > 0").select(F.floor(F.col("event_id") / 3).cast("long").alias("src"), F.col("event_id").alias("dst"))
    return G.hops(links, t.rows([(1,)], "id long")).select("id", "hops")


@query(f"""WITH {_LONE} SELECT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT o_orderkey * 10 + 1 AS a, o_custkey * 10 + 2 AS b FROM orders UNION ALL SELECT c_custkey * 10 + 2, CAST(c_nationkey AS BIGINT) * 10 + 3 FROM customer
  UNION ALL SELECT supplier * 10 + 4, CAST(nation AS BIGINT) * 10 + 3 FROM sole UNION ALL SELECT supplier * 10 + 4, part * 10 + 5 FROM one)""")
def bridges(t):
    """G11 over all tables: every order, every customer, parts with one line and nations with one supplier hang on one edge."""
    return G.bridges(_whole(t))


@query(f"""WITH {_LONE} SELECT o_custkey * 10 + 2 AS id FROM orders UNION SELECT CAST(c_nationkey AS BIGINT) * 10 + 3 FROM customer UNION SELECT supplier * 10 + 4 FROM one UNION SELECT supplier * 10 + 4 FROM sole
  UNION SELECT min(l_suppkey) * 10 + 4 FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1""")
def articulation(t):
    """G12 over all tables: what customers, nations and suppliers carry alone is parted from the rest without them."""
    return G.articulation(_whole(t))


def _trade(t):
    """Links between the brands of parts and the nations of suppliers over all returned lines, suppliers on their nations."""
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("n"))
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long") * 10 + 1
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), brand.alias("brand"))
    lines = t.lineitem.where("l_returnflag = 'R'").join(parts, "l_partkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("brand", "n").agg(F.count("*").alias("c")).select(F.col("brand").alias("src"), (F.col("n") * 10 + 2).alias("dst")).union(s.select(F.col("s_suppkey") * 10 + 3, F.col("n") * 10 + 2))


@query()
def betweenness(t):
    return G.centrality(_trade(t)).select("id", "betweenness")


@query()
def closeness(t):
    return G.centrality(_trade(t)).select("id", "closeness")


@query()
def communities(t):
    """Multilevel modularity over all suppliers and parts of returned lines."""
    return G.communities(_trade(t))


@query()
def fiedler_sides(t):
    return G.communities(_trade(t), "fiedler")


@query()
def betweenness_parts(t):
    """Nations and regions parted where most shortest paths run."""
    n = t.nation.select((F.col("n_nationkey").cast("long") * 10).alias("src"), (F.col("n_regionkey").cast("long") * 10 + 1).alias("dst"))
    near = t.nation.where("n_nationkey % 5 <> 4").select((F.col("n_nationkey").cast("long") * 10).alias("src"), ((F.col("n_nationkey").cast("long") + 1) * 10).alias("dst"))
    return G.communities(n.union(near), "edge_betweenness", 3)


@query()
def path_edges(t):
    """Paths between all nations of the trade graph."""
    nodes = t.nation.select((F.col("n_nationkey").cast("long") * 10 + 2).alias("source"))
    pairs = nodes.join(nodes.select(F.col("source").alias("target")), F.col("source") < F.col("target"))
    return G.path_edges(_trade(t), pairs)


@query(f"""WITH RECURSIVE {B}, w AS (SELECT guid, x, y, z FROM b WHERE entity = 'IfcWall'), e AS (SELECT a.guid AS src, c.guid AS dst FROM w a JOIN w c ON power(a.x-c.x,2) + power(a.y-c.y,2) + power(a.z-c.z,2) <= 0.0016),
  r(id, c) AS (SELECT guid, guid FROM w UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id) SELECT id, min(c) AS component FROM r GROUP BY 1""")
def clash_clusters(t):
    """Clash midpoints chained by distance."""
    return G.clusters(boxes(t).where("entity = 'IfcWall'"), "guid", 0.04)


@query("SELECT n_regionkey AS zone, a AS src, b AS dst FROM (SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)")
def clique_edges(t):
    return G.cliques(t.nation.select(F.col("n_regionkey").alias("zone"), "n_nationkey"), "zone", "n_nationkey", 100)


@query("SELECT c_nationkey AS zone, h AS src, c_custkey AS dst FROM customer JOIN (SELECT c_nationkey, min(c_custkey) AS h FROM customer GROUP BY 1) USING (c_nationkey) WHERE c_custkey <> h")
def star_or_clique(t):
    """G20 above the limit: a star instead of all pairs."""
    return G.cliques(t.customer.select(F.col("c_nationkey").alias("zone"), "c_custkey"), "zone", "c_custkey", 2)
