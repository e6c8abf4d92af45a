"""Aggregates, windows, paging, changes, upserts and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import changes as C
from ..operators import ladders as D
from ..operators import relational as R
from ..operators import selectors as S
from .catalog import query


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def type_counts(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (r <= 3) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) GROUP BY p_type")
def type_bank(t):
    """Counts with sample ids; only the ranked sample is collected, not whole groups."""
    ranked = t.part.withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))).where("r <= 3")
    few = ranked.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("sample"))
    return type_counts(t).join(few, "p_type")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(t):
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(CAST(user_id % 4 AS VARCHAR), 'total') AS queue, count_if(event_type = 'error') AS error, count_if(event_type = 'click') AS click, count(*) AS n FROM events GROUP BY ROLLUP (user_id % 4)""")
def status_pivot_totals(t):
    return t.events.rollup((F.col("user_id") % 4).alias("q")).agg(*[F.count_if(F.col("event_type") == s).alias(s) for s in ("error", "click")], F.count("*").alias("n")).select(F.coalesce(F.col("q").cast("string"), F.lit("total")).alias("queue"), "error", "click", "n")


@query("SELECT 'events' AS tab, count(*) AS n FROM events UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(t):
    out = None
    for name in ("events", "nation", "orders"):
        own = getattr(t, name).agg(F.lit(name).alias("tab"), F.count("*").alias("n"))
        out = own if out is None else out.union(own)
    return out


@query("SELECT count(*) AS total, count_if(event_type = 'error') AS filtered FROM events")
def filtered_and_total(t):
    return t.events.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("filtered"))


@query("SELECT DISTINCT event_type AS queue FROM events ORDER BY 1")
def distinct_queues(t):
    return t.events.select(F.col("event_type").alias("queue")).distinct().orderBy("queue")


@query("SELECT count(*) AS n, count(DISTINCT p_type) AS types, count(DISTINCT p_brand) AS brands, min(p_partkey) AS first, max(p_size) AS largest FROM part")
def model_summary(t):
    return t.part.agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types"), F.count_distinct("p_brand").alias("brands"), F.min("p_partkey").alias("first"), F.max("p_size").alias("largest"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1")
def name_list(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"), F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count_if(o_orderstatus = 'F') AS passed, count_if(o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1")
def spec_summary(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("passed"), F.count_if(F.col("o_orderstatus") != "F").alias("failed"))


@query("SELECT l_partkey, first(v) AS value FROM (SELECT l_partkey, l_returnflag AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag) AS n FROM lineitem) WHERE n = 1 GROUP BY l_partkey")
def value_aggregate_first(t):
    rows = t.lineitem.withColumn("pos", F.struct("l_orderkey", "l_linenumber", "l_returnflag"))
    return R.first_value(rows, "l_partkey", "l_returnflag", "pos")


@query("SELECT l_partkey, string_agg(v, ', ' ORDER BY p, v) AS value FROM (SELECT l_partkey, l_returnflag AS v, min(l_orderkey) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def value_aggregate_join(t):
    return R.joined_values(t.lineitem, "l_partkey", "l_returnflag", "l_orderkey")


@query("SELECT l_orderkey, min(l_returnflag) AS value FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def value_aggregate_conflicts(t):
    return R.agreed_value(t.lineitem, "l_orderkey", "l_returnflag")


@query("SELECT p_type, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) ELSE 'VARIES' END AS p_brand, CASE WHEN min(p_size) = max(p_size) THEN CAST(min(p_size) AS VARCHAR) ELSE 'VARIES' END AS p_size FROM part GROUP BY 1")
def varies_grouping(t):
    return R.varies(t.part, ["p_type"], ["p_brand", "p_size"])


@query("SELECT CASE WHEN value < 25 THEN 'low' WHEN value < 50 THEN 'mid' WHEN value < 100 THEN 'high' ELSE 'top' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram(t):
    v = F.col("value")
    return t.events.groupBy(F.when(v < 25, "low").when(v < 50, "mid").when(v < 100, "high").otherwise("top").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS relationship_type, l_linestatus AS method, count(*) AS n FROM lineitem GROUP BY 1, 2")
def rel_type_counts(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("relationship_type"), F.col("l_linestatus").alias("method")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS matched, count_if(p_size > 10) AS written, count_if(p_size <= 10) AS skipped, count_if(p_brand = 'Brand#1') AS unmapped, count_if(p_size IS NULL) AS errors FROM part")
def patch_stats(t):
    c = F.col
    return t.part.agg(F.count("*").alias("matched"), F.count_if(c("p_size") > 10).alias("written"), F.count_if(c("p_size") <= 10).alias("skipped"), F.count_if(c("p_brand") == "Brand#1").alias("unmapped"), F.count_if(c("p_size").isNull()).alias("errors"))


@query("SELECT count(DISTINCT s) AS distinct_histories, count(*) AS elements FROM (SELECT l_partkey, string_agg(DISTINCT concat(l_returnflag, l_linestatus), ',' ORDER BY concat(l_returnflag, l_linestatus)) AS s FROM lineitem GROUP BY 1)")
def signature_dedupe(t):
    """Elements with the same sorted history share one signature."""
    h = t.lineitem.groupBy("l_partkey").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")))), 256).alias("s"))
    return h.agg(F.count_distinct("s").alias("distinct_histories"), F.count("*").alias("elements"))


@query("""WITH r AS (SELECT sha256(concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '"}')) AS h FROM nation), c AS (SELECT h || ':' || count(*) AS x, substr(h, 1, 4) AS b FROM r GROUP BY h),
  p AS (SELECT b || sha256(string_agg(x, chr(10) ORDER BY x)) AS x, substr(b, 1, 2) AS b2 FROM c GROUP BY b), q AS (SELECT b2 || sha256(string_agg(x, chr(10) ORDER BY x)) AS x FROM p GROUP BY b2) SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS fingerprint FROM q""")
def fingerprint(t):
    return R.fingerprint(t.nation, ["n_nationkey", "n_name"])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def correlation_metrics(t):
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY s_acctbal) AS a, rank() OVER (ORDER BY s_nationkey) AS b FROM supplier),
  x AS (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20), y AS (SELECT s_suppkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 20)
  SELECT (SELECT round(corr(a, b), 6) FROM r) AS spearman, (SELECT count(*) FROM x JOIN y USING (s_suppkey)) AS shared""")
def rank_metrics(t):
    """Spearman by ranks and top-k overlap, of one value a graph node (a bounded comparison of engines)."""
    s = R.ranked(R.ranked(t.supplier, "s_acctbal", "a"), "s_nationkey", "b")
    rho = s.agg(F.round(F.corr("a", "b"), 6).alias("spearman"))
    x = t.supplier.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select("s_suppkey")
    y = t.supplier.orderBy(F.desc("s_nationkey"), "s_suppkey").limit(20).select("s_suppkey")
    return rho.crossJoin(x.join(y, "s_suppkey").agg(F.count("*").alias("shared")))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(sum(CAST(l_quantity AS DECIMAL(18,2))) / count(*), 4) AS mean FROM lineitem GROUP BY 1")
def quantity_summary(t):
    q = F.col("l_quantity").cast("decimal(18,2)")
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(q).cast("double").alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round((F.sum(q) / F.count("*")).cast("double"), 4).alias("mean"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events")
def object_history(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("user_id", "event_id", F.row_number().over(w).alias("n"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version(t):
    """W02 by an aggregate, which combines before the exchange where a window would move every version."""
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, event_id, round(value - prev, 6) AS delta FROM (SELECT *, lead(value) OVER w AS prev, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) WHERE n = 1")
def last_two_delta(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("user_id", "event_id", F.round(F.col("value") - F.lead("value").over(w), 6).alias("delta"), F.row_number().over(w).alias("n")).where("n = 1").drop("n")


@query("SELECT o_custkey, o_orderkey AS from_id, nxt AS to_id FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL")
def consecutive_edges(t):
    from ..operators.lineage import consecutive

    return consecutive(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("SELECT k, s_suppkey AS from_id, nxt AS to_id FROM (SELECT *, lead(s_suppkey) OVER (PARTITION BY k ORDER BY s_nationkey, s_suppkey) AS nxt, lead(s_nationkey) OVER (PARTITION BY k ORDER BY s_nationkey, s_suppkey) AS st FROM (SELECT *, CAST(round_even(s_acctbal / 500, 0) AS BIGINT) AS k FROM supplier)) WHERE nxt IS NOT NULL AND st <> s_nationkey")
def stacked_footprints(t):
    """Neighbours of one quantised footprint on different storeys."""
    rows = t.supplier.withColumn("k", F.bround(F.col("s_acctbal") / 500, 0).cast("long"))
    w = Window.partitionBy("k").orderBy("s_nationkey", "s_suppkey")
    rows = rows.select("k", F.col("s_suppkey").alias("from_id"), F.lead("s_suppkey").over(w).alias("to_id"), "s_nationkey", F.lead("s_nationkey").over(w).alias("st"))
    return rows.where("to_id IS NOT NULL AND st <> s_nationkey").select("k", "from_id", "to_id")


@query("SELECT DISTINCT a.o_custkey AS zone_a, b.o_custkey AS zone_b, a.o_orderpriority AS label FROM (SELECT DISTINCT o_custkey, o_orderpriority, s FROM (SELECT *, dense_rank() OVER (ORDER BY o_custkey) AS s FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders))) a JOIN (SELECT DISTINCT o_custkey, o_orderpriority, dense_rank() OVER (ORDER BY o_custkey) AS s FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) b ON b.s = a.s + 1 AND a.o_orderpriority = b.o_orderpriority")
def storey_zone_vertical(t):
    """Zones of consecutive storeys with one label. Storeys are ranked once each, by ranges, then joined."""
    zones = t.orders.select("o_custkey", "o_orderpriority").distinct()
    z = zones.join(R.positions(zones.select("o_custkey").distinct(), ["o_custkey"], "s"), "o_custkey")
    nxt = z.select((F.col("s") - 1).alias("s"), "o_orderpriority", F.col("o_custkey").alias("zone_b"))
    return z.join(nxt, ["s", "o_orderpriority"]).select(F.col("o_custkey").alias("zone_a"), "zone_b", F.col("o_orderpriority").alias("label"))


@query("""SELECT l_suppkey, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_quantity, l_orderkey, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def best_with_tiebreak(t):
    """W09 as one aggregate over the negated score, distance and ids."""
    best = F.min(F.struct((-F.col("l_discount")).alias("score"), "l_quantity", "l_orderkey", "l_partkey"))
    return t.lineitem.groupBy("l_suppkey").agg(best.alias("b")).select("l_suppkey", "b.l_orderkey", "b.l_partkey")


@query("""WITH v AS (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, l_suppkey) AS n FROM v)
  SELECT l_partkey, max(l_suppkey) FILTER (n = 1) AS room, max(c) FILTER (n = 1) AS dominant, coalesce(max(c) FILTER (n = 2), 0) AS second, CAST(sum(c) AS BIGINT) AS total FROM r GROUP BY 1""")
def dominant_vote(t):
    hits = t.lineitem.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("point"))
    return R.votes(hits, "l_partkey", "l_suppkey", F.lit(1)).select("l_partkey", "room", "dominant", "second", "total")


@query("""SELECT user_id, event_id FROM (SELECT *, count(v) OVER (PARTITION BY user_id) AS has, row_number() OVER (PARTITION BY user_id ORDER BY (v IS NULL), (try_cast(v AS DOUBLE) IS NULL), try_cast(v AS DOUBLE) NULLS LAST, v, event_id) AS n
  FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 'room' || (event_id % 7) ELSE CAST(event_id % 11 AS VARCHAR) END AS v FROM events)) WHERE has = 0 OR n = 1""")
def winner_by_sort_value(t):
    v = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", F.concat(F.lit("room"), (F.col("event_id") % 7).cast("string"))).otherwise((F.col("event_id") % 11).cast("string"))
    return R.winners(t.events.withColumn("v", v), "user_id", "v", "event_id").select("user_id", "event_id")


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 'kept' WHEN p_type = 'SMALL' THEN 'R1' WHEN p_size > 25 THEN 'R2' WHEN p_brand LIKE 'Brand#1%' THEN 'R3' END AS assigned FROM part")
def rule_precedence(t):
    rules = [(F.col("p_type") == "SMALL", "R1"), (F.col("p_size") > 25, "R2"), (F.col("p_brand").startswith("Brand#1"), "R3")]
    return R.precedence(t.part, "p_partkey", rules, F.when(F.col("p_size") == 1, "kept")).select("p_partkey", "assigned")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#7' THEN NULL WHEN p_brand = 'Brand#8' THEN 'X8' WHEN substr(p_brand, 1, 7) = 'Brand#1' AND p_type = 'SMALL' THEN 'P1' WHEN substr(p_brand, 1, 7) = 'Brand#1' THEN 'D1' WHEN substr(p_brand, 1, 7) = 'Brand#7' THEN 'D7' END AS code FROM part")
def code_mapping_ladder(t):
    exact = t.rows([("Brand#7", None), ("Brand#8", "X8")], "raw string, code string")
    paired = t.rows([("Brand#1", "SMALL", "P1")], "prefix string, class string, code string")
    default = t.rows([("Brand#1", "D1"), ("Brand#7", "D7")], "prefix string, code string")
    return R.code_ladder(t.part, "p_brand", F.substring("p_brand", 1, 7), "p_type", exact, paired, default).select("p_partkey", "code")


@query("""SELECT l_orderkey AS pos, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) THEN l_partkey ELSE l_suppkey END AS source, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) THEN l_suppkey ELSE l_partkey END AS target
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def pair_orient(t):
    pairs = t.lineitem.select(F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return R.orient_pairs(pairs, t.part.where("p_size < 25").select(F.col("p_partkey").alias("guid")))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem WHERE l_partkey <> l_suppkey")
def pair_dedupe(t):
    return R.unordered(t.lineitem, "l_partkey", "l_suppkey")


@query("SELECT l_suppkey AS target, arg_min(p_brand, l_orderkey * 10000000 + l_partkey) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def propagate_property(t):
    oriented = t.lineitem.select((F.col("l_orderkey") * 10000000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return R.propagate(oriented, t.part.select(F.col("p_partkey").alias("guid"), "p_brand"), "p_brand")


@query("""WITH h AS (SELECT user_id, arg_max(event_id, ts) AS head FROM events GROUP BY 1)
  SELECT e.event_id AS child, coalesce(p.event_id, h.head) AS parent_id FROM (SELECT event_id, user_id + 1 AS key, event_id - 1 AS pin FROM events) e LEFT JOIN events p ON p.user_id = e.key AND p.event_id = e.pin LEFT JOIN h ON h.user_id = e.key WHERE coalesce(p.event_id, h.head) IS NOT NULL""")
def parent_fallback(t):
    versions = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_id").alias("version"), F.col("ts").alias("created_at"))
    edges = t.events.select(F.col("event_id").alias("child"), (F.col("user_id") + 1).alias("key"), (F.col("event_id") - 1).alias("pin"))
    return R.lookup_with_fallback(edges, versions, "key").select("child", "parent_id")


@query("SELECT o_custkey AS zone, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def zone_members(t):
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("zone"), F.col("l_suppkey").cast("string").alias("m"))
    return R.members_of(rows, "zone", "m").select("zone", F.array_join("members", ",").alias("members"))


@query("SELECT l_partkey AS element, arg_min(o_custkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END * 100000000 + o_custkey) AS host FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def opening_chain(t):
    fills = t.lineitem.select(F.col("l_partkey").alias("element"), F.col("l_orderkey").alias("opening"))
    voids = t.orders.select(F.col("o_orderkey").alias("opening"), F.struct("o_custkey", "o_orderstatus").alias("host"))
    hosts = t.orders.select(F.struct("o_custkey", "o_orderstatus").alias("guid"), (F.col("o_orderstatus") == "F").alias("is_wall")).distinct()
    return R.opening_chain(fills, voids, hosts).select("element", F.col("host.o_custkey").alias("host"))


@query("""WITH p AS (SELECT s_suppkey + 1000000 AS id, md5(CAST(s_nationkey AS VARCHAR)) AS guid, s_suppkey * 17 AS tag, s_nationkey AS container, s_name AS name FROM supplier),
  c AS (SELECT c_custkey AS id, substr(md5(CAST(c_nationkey % 7 AS VARCHAR)), 1, CAST(6 + c_custkey % 20 AS INT)) || 'z' AS guid, c_custkey AS tag, c_nationkey AS container, CASE WHEN c_custkey % 10 = 0 THEN 'my supplier:2' ELSE c_name END AS name, CASE WHEN c_custkey % 13 = 0 THEN CAST((c_custkey % 50 + 1) * 17 AS VARCHAR) END AS ref FROM customer),
  x AS (SELECT c.id AS child, p.id AS parent, CASE WHEN ref = CAST(p.tag AS VARCHAR) THEN 200.0 ELSE 0 END + CASE WHEN length(c.guid) >= 8 AND substr(c.guid, 1, 8) = substr(p.guid, 1, 8) THEN 100 + length(c.guid) - 1 - 8 ELSE 0 END
    + CASE WHEN c.tag > p.tag AND c.tag - p.tag <= 100 THEN 50.0 * (1 - (c.tag - p.tag) / 100.0) ELSE 0 END + CASE WHEN c.container = p.container THEN 25 ELSE 0 END
    + CASE WHEN contains(lower(split_part(c.name, ':', 1)), 'supplier') THEN 10 ELSE 0 END AS score, CASE WHEN c.tag > p.tag THEN c.tag - p.tag END AS distance FROM c, p)
  SELECT child, parent, round(CAST(score AS DOUBLE), 6) AS score, distance FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, distance NULLS LAST, parent) AS n FROM x WHERE score > 0) WHERE n = 1""")
def best_parent(t):
    """By reference, common beginning, number, container and family."""
    n, c = F.col("s_nationkey").cast("string"), F.col
    parents = t.supplier.select((c("s_suppkey") + 1000000).alias("id"), F.md5(n).alias("guid"), (c("s_suppkey") * 17).alias("tag"), c("s_nationkey").alias("container"), c("s_name").alias("name"))
    guid = F.concat(F.substring(F.md5((c("c_nationkey") % 7).cast("string")), F.lit(1), (6 + c("c_custkey") % 20).cast("int")), F.lit("z"))
    ref = F.when(c("c_custkey") % 13 == 0, ((c("c_custkey") % 50 + 1) * 17).cast("string"))
    children = t.customer.select(c("c_custkey").alias("id"), guid.alias("guid"), c("c_custkey").alias("tag"), c("c_nationkey").alias("container"), F.when(c("c_custkey") % 10 == 0, "my supplier:2").otherwise(c("c_name")).alias("name"), ref.alias("ref"))
    return D.match_children(parents, children).withColumn("score", F.round("score", 6))


@query("SELECT s_suppkey AS guid FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer) INTERSECT SELECT p_partkey FROM part")
def shared_ids(t):
    a = t.supplier.select(F.col("s_suppkey").alias("guid")).intersect(t.customer.select(F.col("c_custkey").alias("guid")))
    return a.intersect(t.part.select(F.col("p_partkey").alias("guid")))


@query("SELECT p_partkey AS guid, 'size' AS prop, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE t.v END AS value FROM part JOIN (SELECT p_type, CAST(max(p_size) AS VARCHAR) AS v FROM part GROUP BY 1) t USING (p_type)")
def pset_inherit(t):
    types = t.part.groupBy(F.col("p_type").alias("type_guid")).agg(F.max("p_size").cast("string").alias("value")).withColumn("prop", F.lit("size"))
    own = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("guid"), F.lit("size").alias("prop"), F.col("p_size").cast("string").alias("value"))
    return R.inherit(types, own, t.part.select(F.col("p_partkey").alias("guid"), F.col("p_type").alias("type_guid")))


@query("SELECT * FROM (SELECT 'orders' AS tab, o_orderkey AS id, o_orderdate AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 'events', event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)")
def recent_top10(t):
    a = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select(F.lit("orders").alias("tab"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return a.union(t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select(F.lit("events"), "event_id", "ts"))


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 15 OFFSET 30")
def page(t):
    return S.history_page(t.events, "value", ["ts", "value"], True, "event_id", 15, 30).select("event_id", "value")


@query("SELECT event_id, lower(json_extract_string(props, '$.k')) AS k FROM events ORDER BY k, event_id")
def sort_by_meta(t):
    k = F.lower(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", k.alias("k")).orderBy("k", "event_id")


@query("SELECT p_partkey FROM part ORDER BY p_type, p_size DESC, p_partkey")
def sort_list(t):
    return t.part.orderBy("p_type", F.desc("p_size"), "p_partkey").select("p_partkey")


@query("SELECT s_name FROM supplier ORDER BY try_cast(nullif(regexp_extract(s_name, '[0-9]+'), '') AS BIGINT) NULLS LAST, s_name")
def natural_sort(t):
    n = F.nullif(F.regexp_extract("s_name", "[0-9]+", 0), F.lit("")).try_cast("long")
    return t.supplier.orderBy(n.asc_nulls_last(), "s_name").select("s_name")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY 1, 2")
def stable_emit(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct().orderBy("l_returnflag", "l_linestatus")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 ORDER BY 1 LIMIT 100")
def capped_sample(t):
    return t.lineitem.where("l_quantity = 50").select("l_partkey").distinct().orderBy("l_partkey").limit(100)


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL' ORDER BY p_partkey LIMIT 10")
def max_elements(t):
    return t.part.where("p_type = 'SMALL'").orderBy("p_partkey").limit(10).select("p_partkey")


def _second(t):
    """A second version of the customers: some gone, some changed, some added."""
    c = t.customer.where("c_custkey % 7 <> 0")
    c = c.withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    c = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    more = t.customer.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000)
    return c.unionByName(more)


_SECOND = "second AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0)"
_DIFF = f"""{_SECOND}, diff AS (SELECT * FROM (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'deleted' WHEN o.c_name <> n.c_name OR o.c_acctbal <> n.c_acctbal THEN 'changed' END AS op,
  CASE WHEN o.c_custkey IS NULL OR n.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.c_acctbal <> n.c_acctbal THEN 'c_acctbal' END, CASE WHEN o.c_name <> n.c_name THEN 'c_name' END) END AS changed FROM customer o FULL JOIN second n ON o.c_custkey = n.c_custkey) WHERE op IS NOT NULL)"""


def _diff(t):
    return C.diff(t.customer, _second(t), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query(f"WITH {_DIFF} SELECT * FROM diff")
def model_diff(t):
    return _diff(t).withColumn("changed", F.array_join("changed", ","))


@query(f"WITH {_DIFF} SELECT op, count(*) AS n FROM diff GROUP BY op")
def diff_counts(t):
    return C.counts(_diff(t))


@query(f"WITH {_DIFF} SELECT op, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FILTER (r <= 3) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY c_custkey) AS r FROM diff) GROUP BY op")
def diff_sample(t):
    return C.sample(_diff(t), "c_custkey", 3).withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))


@query(f"WITH {_SECOND} SELECT o.c_custkey, 'changed' AS op FROM customer o JOIN second n ON o.c_custkey = n.c_custkey AND o.c_mktsegment = 'BUILDING' AND n.c_mktsegment = 'BUILDING' WHERE o.c_acctbal <> n.c_acctbal")
def diff_filtered(t):
    """A diff of some columns of some elements."""
    b = lambda df: df.where("c_mktsegment = 'BUILDING'")
    return C.diff(b(t.customer), b(_second(t)), "c_custkey", ["c_acctbal"]).where("op = 'changed'").select("c_custkey", "op")


@query(f"WITH {_DIFF} SELECT c_custkey, changed LIKE '%c_name%' OR op = 'added' AS meaningful FROM diff WHERE op <> 'deleted'")
def meaningful_diff(t):
    d = _diff(t).where("op <> 'deleted'")
    return C.meaningful(d.select("c_custkey", "op", F.explode_outer("changed").alias("path")), "c_custkey", "path", F.col("op") == "added", ["c_acct*", "*.id"])


@query(f"WITH {_DIFF} SELECT c_custkey, op, CASE WHEN op = 'deleted' THEN 'r' || (c_custkey % 3) ELSE 'r9' END AS revision FROM diff WHERE op = 'added' OR (op = 'changed' AND changed LIKE '%c_name%') OR (op = 'deleted' AND c_custkey % 2 = 0)")
def revision_assign(t):
    d = _diff(t)
    m = C.meaningful(d.select("c_custkey", "op", F.explode_outer("changed").alias("path")), "c_custkey", "path", F.col("op") == "added", ["c_acct*"])
    previous = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("r"), (F.col("c_custkey") % 3).cast("string")).alias("revision"))
    return C.revisions(d, previous, "c_custkey", "r9", m)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('BUILDING') AND trim(c_mktsegment) <> ''")
def assignment_valid(t):
    """An assignment counts unless it is blank or the generic value."""
    return t.customer.where(X.blank_to_null(F.col("c_mktsegment")).isNotNull() & (F.col("c_mktsegment") != "BUILDING")).select("c_custkey")


_OLD = "o AS (SELECT user_id AS k, 'old' AS status, arg_min(event_type, event_id) AS kind, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'q' || user_id END AS queue FROM events WHERE user_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id AS k, 'new' AS status, arg_max(event_type, event_id) AS kind, 'n' || user_id AS queue FROM events WHERE user_id % 5 <> 0 GROUP BY user_id)"


def _two(t):
    e = t.events
    old = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.lit("old").alias("status"), F.min_by("event_type", "event_id").alias("kind")).withColumn("queue", F.when(F.col("k") % 3 != 0, F.concat(F.lit("q"), F.col("k").cast("string"))))
    new = e.where("user_id % 5 <> 0").groupBy(F.col("user_id").alias("k")).agg(F.lit("new").alias("status"), F.max_by("event_type", "event_id").alias("kind")).withColumn("queue", F.concat(F.lit("n"), F.col("k").cast("string")))
    return old, new


@query(f"WITH {_OLD} SELECT coalesce(o.k, n.k) AS k, coalesce(o.status, n.status) AS status, coalesce(o.kind, n.kind) AS kind, coalesce(o.queue, n.queue) AS queue FROM o FULL JOIN n ON o.k = n.k")
def upsert_old_wins(t):
    return C.upsert(*_two(t), ["k"])


@query(f"WITH {_OLD} SELECT coalesce(o.k, n.k) AS k, coalesce(n.status, o.status) AS status, coalesce(n.kind, o.kind) AS kind, CASE WHEN o.k IS NULL THEN n.queue ELSE o.queue END AS queue FROM o FULL JOIN n ON o.k = n.k")
def upsert_new_wins(t):
    return C.upsert(*_two(t), ["k"], overwrite=["status"], keep_old=False, fixed=["queue"])


@query("""SELECT user_id AS k, '{"a":"' || user_id || '","b":"new","c":"' || user_id || '"}' AS meta FROM events GROUP BY user_id""")
def upsert_json(t):
    """Metadata is united, the new side wins."""
    k = t.events.select(F.col("user_id").alias("k")).distinct()
    s = F.col("k").cast("string")
    old = k.select("k", F.concat(F.lit('{"a":"'), s, F.lit('","b":"old"}')).alias("meta"))
    new = k.select("k", F.concat(F.lit('{"c":"'), s, F.lit('","b":"new"}')).alias("meta"))
    return C.upsert(old, new, ["k"], json=["meta"])


@query(f"WITH {_OLD} SELECT k, status, kind, queue FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def insert_absent(t):
    return C.insert_absent(*_two(t), ["k"])


@query("SELECT 'both' AS what, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT p_partkey FROM part)")
def set_ops(t):
    k = lambda df, c: df.select(F.col(c).alias("k"))
    both = k(t.customer, "c_nationkey").intersect(k(t.supplier, "s_nationkey"))
    only = k(t.customer, "c_custkey").subtract(k(t.supplier, "s_suppkey"))
    either = k(t.customer, "c_custkey").union(k(t.part, "p_partkey")).distinct()
    out = None
    for name, df in (("both", both), ("only", only), ("either", either)):
        own = df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = own if out is None else out.union(own)
    return out


@query("SELECT o_custkey, string_agg(DISTINCT m, ',' ORDER BY m) AS methods, count(*) AS n FROM (SELECT o_custkey, 'order' AS m FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer) GROUP BY 1")
def method_union(t):
    rows = t.orders.select("o_custkey", F.lit("order").alias("m")).unionByName(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit("customer").alias("m")))
    return rows.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("methods"), F.count("*").alias("n"))
