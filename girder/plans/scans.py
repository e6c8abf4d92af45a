"""Scans, sinks, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import selectors as S
from ..session import shared_folder
from ..sources import tables as T
from .catalog import query


def _scratch(t, name: str) -> str:
    """A folder all executors share."""
    import uuid

    root = shared_folder(t.spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT r_name AS zone, count(*) AS n_elements, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY r_name")
def zone_rollup(t):
    """Elements and quantity per zone, rolled up the containment hierarchy.

    Elements are summed per space first, so the joins up the hierarchy carry one row a space.
    """
    per_space = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    up = per_space.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    up = up.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return up.groupBy(F.col("r_name").alias("zone")).agg(F.sum("n").alias("n_elements"), F.sum("q").cast("double").alias("quantity"))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def layer_scan(t):
    return T.scan_layer(t.spark, t.root, "part")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5")
def layer_preview(t):
    return T.preview(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"], 5)


@query("SELECT table_name AS layer, column_name AS column, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' END AS type FROM information_schema.columns WHERE table_name IN ('part','supplier','events')")
def layer_schema(t):
    return T.column_schemas({"part": t.part, "supplier": t.supplier, "events": t.events}, t.spark)


@query("SELECT 'part' AS layer, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def extract_all(t):
    paths = T.extract_all({"part": t.part, "supplier": t.supplier}, _scratch(t, "extract"))
    counts = [t.spark.read.parquet(p).agg(F.lit(name).alias("layer"), F.count("*").alias("n")) for name, p in paths.items()]
    return counts[0].union(counts[1])


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def write_roundtrip(t):
    path = T.write_table(t.supplier, _scratch(t, "supplier"), "csv", ";")
    return T.read_table(t.spark, path, t.supplier.schema, "csv", ";")


@query("SELECT c_name AS \"Name\", coalesce(nullif(trim(c_mktsegment), ''), '-') AS \"Segment\" FROM customer")
def csv_export(t):
    return T.export_projection(t.customer, {"Name": "c_name", "Segment": "c_mktsegment"})


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('EDIT', c_custkey) ELSE c_name END AS c_name FROM customer")
def csv_writeback(t):
    edits = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("EDIT"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, "-").otherwise("").alias("c_name"))
    return T.write_back(t.customer.select("c_custkey", "c_name"), edits, "c_custkey", ["c_name"])


@query("""SELECT user_id, event_id, pinned FROM (SELECT e.user_id, event_id, coalesce(event_id = pin, false) AS pinned,
  row_number() OVER (PARTITION BY e.user_id ORDER BY coalesce(event_id = pin, false) DESC, ts DESC, event_id DESC) AS n
  FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS pin FROM events WHERE user_id % 5 = 0 GROUP BY user_id) p ON e.user_id = p.user_id) WHERE n = 1""")
def pinned_read(t):
    pins = t.events.where("user_id % 5 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return T.pinned_or_head(t.events, pins, "user_id", "event_id", F.col("ts")).select("user_id", "event_id", "pinned")


@query("SELECT event_id AS id, sha256(props) AS sha256, CAST(strlen(props) AS BIGINT) AS size_bytes, CASE WHEN event_id % 4 = 0 THEN 'root' ELSE 'derived' END AS kind FROM events")
def object_append(t):
    parent = F.when(F.col("event_id") % 4 != 0, F.col("event_id") - F.col("event_id") % 4)
    versions, _ = T.append_objects(t.events.select(F.col("event_id").alias("id"), "props", parent.alias("parent")), "props", "parent")
    return versions.select("id", "sha256", "size_bytes", "kind")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 5, 7)")
def lookup_filter(t):
    return t.supplier.where(F.col("s_nationkey").isin(1, 5, 7)).select("s_suppkey", "s_name")


@query("SELECT event_id AS job_id, event_type AS queue, CASE WHEN value > 50 THEN 'failed' ELSE 'finished' END AS status FROM events")
def job_scan(t):
    return t.events.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("queue"), F.when(F.col("value") > 50, "failed").otherwise("finished").alias("status"))


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS guid_a, CAST(l_suppkey AS VARCHAR) AS guid_b, CAST(l_linenumber AS DOUBLE) AS distance, l_returnflag AS kind
  FROM lineitem WHERE l_returnflag <> 'N'
  UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), NULL, l_returnflag FROM lineitem WHERE l_returnflag = 'N'""")
def clash_report_pairs(t):
    """Reports in both layouts, flattened; text distances become null."""
    rows = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), F.col("l_returnflag").alias("f"),
        F.when(F.col("l_returnflag") == "N", "near").otherwise(F.col("l_linenumber").cast("string")).alias("d")).distinct()
    one = F.struct(F.lit("set").alias("name"), F.map_from_arrays(F.array(F.concat_ws("-", "a", "b")), F.array(F.struct(F.col("a").alias("a_global_id"), F.col("b").alias("b_global_id"), F.col("f").alias("type"), F.col("d").alias("distance")))).alias("clashes"))
    reports = rows.select(F.when(F.col("f") == "A", F.to_json(F.array(one))).otherwise(F.to_json(one)).alias("report"))
    return T.clash_pairs(reports, "report")


@query("SELECT CAST(l_partkey AS VARCHAR) AS element, CAST(l_suppkey AS VARCHAR) AS space, l_discount AS confidence FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount >= 0.05")
def room_report_edges(t):
    e = F.struct(F.col("l_partkey").cast("string").alias("global_id"), F.col("l_suppkey").cast("string").alias("space"), F.when(F.col("l_returnflag") == "N", "Unmatched").otherwise("Contained").alias("status"), F.col("l_discount").alias("confidence"))
    reports = t.lineitem.select(F.to_json(F.struct(F.array(e).alias("elements"))).alias("report"))
    return T.room_report(reports, "report", 0.05, ["contained", "resolved"])


@query("""SELECT DISTINCT concat('<urn:n', n_nationkey, '> <urn:in> <urn:r', n_regionkey, '> .') AS line FROM nation
  UNION ALL SELECT concat('<urn:n', n_nationkey, '> <urn:name> "', n_name, '" .') FROM nation""")
def triples_out(t):
    n = t.nation
    s = F.concat(F.lit("urn://n"), F.col("n_nationkey").cast("string"))
    links = n.select(s.alias("s"), F.lit("urn://in").alias("p"), F.concat(F.lit("urn://r"), F.col("n_regionkey").cast("string")).alias("o"))
    names = n.select(s.alias("s"), F.lit("urn://name").alias("p"), F.col("n_name").alias("o"))
    return T.turtle(links.union(links).union(names)).select(F.regexp_replace("line", "urn://", "urn:").alias("line"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') || '_' || lower(p_type) || '.ifc' WHEN 1 THEN regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') || '_Agora.bcfzip'
  WHEN 2 THEN 'file.ifc' WHEN 3 THEN regexp_replace(substr(repeat(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g') || 'x', 60), 1, 180), '-$', '') || '.ifc' ELSE regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') END AS safe FROM part""")
def safe_names(t):
    """Accents, blanks, an extension in capitals, nothing usable, a stem that is too long, and no extension."""
    i, n = F.col("p_partkey") % 5, F.col("p_name")
    raw = F.when(i == 0, F.concat(F.lit("up/loads/.. "), n, F.lit(" _ "), F.lower("p_type"), F.lit("(.IFC"))).when(i == 1, F.concat(n, F.lit(" Ågörâ.BCFZIP"))).when(i == 2, "- ü̈  ._.Ifc".replace("ü", "")).when(i == 3, F.concat(F.repeat(F.concat(F.regexp_replace(n, "[^A-Za-z0-9]+", "-"), F.lit("x")), 60), F.lit(".ifc"))).otherwise(F.concat(F.lit("a/"), n, F.lit("_ ")))
    return t.part.select("p_partkey", T.safe_name(raw).alias("safe"))


@query("SELECT p_partkey AS \"GlobalId\", p_name AS \"Name\" FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY')")
def export_projection(t):
    rows = S.of_type(t.part, "IfcElement", "p_type", ("PROMO", "ECONOMY"))
    return S.select_columns(rows, [("GlobalId", "p_partkey"), ("Name", "p_name")])


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#4'")
def filter_products(t):
    return S.where_given(t.part, p_type="SMALL", p_brand="Brand#4", p_size=None).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'LARGE'")
def by_type(t):
    return S.of_type(t.part, "LARGE", "p_type").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('LARGE', 'SMALL')")
def by_types(t):
    return S.by_types(t.part, ["LARGE", "SMALL", "NONE"], "p_partkey", "p_type").select("p_partkey")


def _model(t):
    p = t.part.select(F.col("p_partkey").alias("guid"), F.col("p_type").alias("entity"), "p_brand", "p_size")
    props = p.select("guid", F.lit("Common").alias("pset"), F.explode(F.create_map(F.lit("Brand"), F.col("p_brand"), F.lit("Size"), F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".0")))).alias("prop", "value"))
    return p.select("guid", "entity"), props


@query("SELECT p_partkey AS guid FROM part WHERE p_type = 'SMALL' AND p_size = 5 AND p_brand = 'Brand#4'")
def simple_selector(t):
    return S.select_guids(*_model(t), S.Selector.parse("SMALL, Common.Size=5, Common.Brand='Brand#4'"))


@query("SELECT p_partkey AS guid FROM part WHERE p_size = 7")
def numeric_equality(t):
    _, props = _model(t)
    return props.where((F.col("prop") == "Size") & X.same_value(F.col("value"), F.lit("7"))).select("guid")


@query("SELECT p_partkey AS guid FROM part WHERE (p_type = 'SMALL' AND p_size = 5) OR p_type = 'LARGE'")
def selector_union(t):
    return S.select_union(*_model(t), "SMALL, Common.Size=5.0 + LARGE + LARGE")


@query("SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'LARGE')")
def negated_types(t):
    return S.keep_listed(t.part, t.part.where(F.col("p_type").isin("PROMO", "LARGE")), "p_partkey", removed=True).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def keep_list(t):
    keep = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return S.keep_listed(t.part, keep, "p_partkey").select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type <> 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200)")
def source_mode(t):
    big = t.events.where("event_type = 'purchase' AND value > 200")
    return S.source_mode(t.events, "e", big, "user_id", F.col("event_type") == "signup").select("event_id")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' AND (props LIKE '%9%' OR event_type ILIKE '%9%') ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10")
def job_filter_page(t):
    rows = S.search(t.events, "9", ["props", "event_type"], event_type="error", user_id=None)
    return S.history_page(rows, "ts", ["ts", "value"], True, "event_id", 20, 10).select("event_id", "ts")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 42")
def json_predicate(t):
    return t.events.where(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' AND user_id = 3")
def json_contains(t):
    """containment of {"k": 7} within one key's versions."""
    doc = F.from_json("props", "map<string,string>")
    return t.events.where((F.col("user_id") == 3) & (F.element_at(doc, "k") == "7")).select("event_id")


@query("SELECT doc_id FROM documents WHERE sha256(text) = (SELECT min(sha256(text)) FROM documents)")
def hash_lookup(t):
    h = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(F.broadcast(h.agg(F.min("h").alias("h"))), "h").select("doc_id")


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def roots_since(t):
    roots = t.events.where((F.col("event_id") % 4 == 0) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return roots.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'purchase'")
def live_state(t):
    return t.events.where("event_type <> 'purchase'").select("event_id")


@query("SELECT p_partkey FROM part WHERE NOT (p_name LIKE 'red %' OR p_type = 'LARGE' OR (substr(p_type, 1, 1) IN ('S', 'M') AND p_name LIKE '% ring') OR (p_type NOT LIKE 'P%' AND regexp_full_match(p_name, 'b..e bolt')))")
def glob_ignore(t):
    """by property, by set, by both with a class of letters, and by all but a class."""
    path = F.concat(F.lit("Pset_"), F.col("p_type"), F.lit("."), F.col("p_name"))
    return t.part.where(~S.ignored(path, ["*.red *", "Pset_LARGE.*", "Pset_[SM]*.* ring", "Pset_[!P]*.b??e bolt"])).select("p_partkey")


@query("SELECT count(*) AS n, count_if(l_discount < 0.05) AS low_confidence, count_if(l_returnflag = 'N') AS wrong_status FROM lineitem")
def gate_counters(t):
    """what the gate lets through and skips, in one pass."""
    return t.lineitem.agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") < 0.05).alias("low_confidence"), F.count_if(F.col("l_returnflag") == "N").alias("wrong_status"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'electrical' WHEN p_name LIKE 'blue%' THEN 'plumbing' END AS route FROM part")
def prefix_route(t):
    return t.part.select("p_partkey", S.route(F.col("p_name"), {"red": "electrical", "blue": "plumbing"}).alias("route"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN CASE WHEN p_name LIKE 'red %' THEN 'red' WHEN p_name LIKE 'blue %' THEN 'blue' END WHEN p_partkey % 4 = 2 THEN NULL
  WHEN p_name = 'red bolt' THEN 'red bolt' WHEN p_name LIKE 'red %' THEN 'red' WHEN p_name LIKE 'blue %' THEN 'blue' END AS prefix FROM part""")
def longest_prefix(t):
    """the longest code before a blank, dash or tab; behind an upload's mark; none before a dot; the first token, trimmed."""
    i, n = F.col("p_partkey") % 4, F.col("p_name")
    first = F.substring_index(n, " ", 1)
    name = F.when(i == 0, F.concat(F.lit("a/"), n, F.lit("-plan.ifc"))).when(i == 1, F.concat(F.lit("DD00ab12cd-"), n, F.lit("\t2.ifc"))).when(i == 2, F.concat(F.lit("x#"), n, F.lit(".ifc"))).otherwise(F.concat(F.lit(" "), first, F.lit(" _plan.ifc")))
    table = t.rows([("red",), ("red bolt",), ("blue",), ("sm",)], "prefix string")
    rows = t.part.select("p_partkey", name.alias("name"))
    return S.longest_prefix(rows, "name", "p_partkey", table, "prefix").select("p_partkey", "prefix")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS arg, event_id % 3 = 1 AS flag FROM events")
def blank_args(t):
    raw = F.when(F.col("event_id") % 5 == 0, F.element_at(F.array(F.lit(" "), F.lit("None"), F.lit("NULL"), F.lit("undefined")), (F.col("event_id") % 4 + 1).cast("int"))).otherwise(F.concat(F.lit(" "), F.col("event_type")))
    flag = F.when(F.col("event_id") % 3 == 1, " Yes").when(F.col("event_id") % 3 == 0, "no")
    return t.events.select("event_id", X.blank_to_null(raw).alias("arg"), X.to_bool(flag).alias("flag"))
