"""Dataflow steps of the job workflows, and scalar functions in bulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import jobs as J
from .catalog import query


@query("SELECT user_id % 10 AS old_file, user_id % 3 AS new_file, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 0 GROUP BY 1, 2")
def diff_list(t):
    """The newest diff with changes per pair of files."""
    rows = t.events.where(F.get_json_object("props", "$.k").try_cast("int") > 0)
    return rows.groupBy((F.col("user_id") % 10).alias("old_file"), (F.col("user_id") % 3).alias("new_file")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_id, event_id % 3 AS added, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS changed FROM events")
def json_sizes(t):
    """Lengths of arrays and numbers of keys; other types count 0."""
    c = F.col("event_id")
    added = F.when(c % 3 == 0, "[]").when(c % 3 == 1, "[1]").otherwise('["a",2]')
    changed = F.when(c % 2 == 0, '{"x":1,"y":2}').otherwise('"none"')
    return t.events.select("event_id", J.array_size(added).alias("added"), J.object_size(changed).alias("changed"))


@query("SELECT event_id, ts FROM events WHERE event_type ILIKE '%ERR%' AND props ILIKE '%\"K\"%' ORDER BY ts DESC, event_id DESC LIMIT 1")
def diff_detail(t):
    return t.events.where(F.col("event_type").ilike("%ERR%") & F.col("props").ilike('%"K"%')).orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "ts")


@query("SELECT event_id, 'f' || event_id || '.ifc' AS base, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events")
def basename_and_time(t):
    """N04."""
    path = F.concat(F.lit("uploads/a/f"), F.col("event_id").cast("string"), F.lit(".ifc"))
    return t.events.select("event_id", F.regexp_replace(path, "^.*/", "").alias("base"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


@query("SELECT '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS items, max(n_nationkey) AS latest FROM nation")
def gather(t):
    """All items of a lookup as one ordered JSON array."""
    g = t.nation.agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("items"), F.max("n_nationkey").alias("latest"))
    return g.select(F.coalesce("items", F.lit("[]")).alias("items"), "latest")


@query("SELECT doc_id, CASE WHEN regexp_matches(m, '(?i)timeout|signal \\d+') THEN true WHEN regexp_matches(m, '(?i)KeyError') THEN false ELSE true END AS retryable, CASE WHEN regexp_matches(m, '(?i)timeout|signal \\d+') THEN true WHEN regexp_matches(m, '(?i)KeyError') THEN false ELSE true END AND doc_id % 5 < 3 AS can_retry FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Timeout: KeyError' WHEN 1 THEN 'keyerror x' WHEN 2 THEN 'signal 9' ELSE 'odd' END AS m FROM documents)")
def retry_class(t):
    i = F.col("doc_id") % 4
    message = F.when(i == 0, "Timeout: KeyError").when(i == 1, "keyerror x").when(i == 2, "signal 9").otherwise("odd")
    return t.documents.select("doc_id", J.retryable(message).alias("retryable"), J.can_retry(message, F.col("doc_id") % 5, 3).alias("can_retry"))


@query("""WITH d AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS prefix FROM part WHERE p_partkey % 4 <> 0), l AS (SELECT * FROM (VALUES ('RED'), ('BLUE_X'), ('GREENISH'), ('THE SMALL')) v(layer)),
  s AS (SELECT prefix, layer, CASE WHEN prefix = layer THEN 100 WHEN prefix = split_part(layer, '_', 1) THEN 95 WHEN starts_with(layer, prefix) OR starts_with(prefix, layer) THEN 80 WHEN contains(layer, prefix) OR contains(prefix, layer) THEN 65 ELSE 0 END AS score FROM (SELECT DISTINCT prefix FROM d), l),
  p AS (SELECT prefix, arg_max(layer, score * 1000 - length(layer)) AS layer, max(score) AS score FROM s GROUP BY 1)
  SELECT p_partkey, CASE WHEN score >= 65 THEN layer ELSE d.prefix END AS layer, CASE WHEN score >= 65 THEN 'matched_existing' ELSE 'new_layer_from_prefix' END AS reason FROM d JOIN p USING (prefix)""")
def layer_plan(t):
    """Linked documents are out; each prefix takes the best layer or becomes one."""
    linked = t.part.where("p_partkey % 4 = 0").select("p_partkey")
    return J.plan_layers(t.part, linked, "p_partkey", F.upper(F.substring_index("p_name", " ", 1)), ["RED", "BLUE_X", "GREENISH", "THE SMALL"])


@query("SELECT count(*) AS registered, count_if(p_partkey % 3 = 0) AS created, count_if(p_partkey % 3 <> 0) AS create_failed, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS layers FROM part WHERE p_partkey % 4 <> 0")
def plan_summary(t):
    """N11."""
    return J.plan_summary(t.part.where("p_partkey % 4 <> 0"), t.part.where("p_partkey % 3 = 0"), "p_partkey", "p_type")


@query("SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def combine_by_position(t):
    """Two item lists zipped by place."""
    return J.combine(t.nation.select("n_name", "n_nationkey"), t.region.select("r_name", "r_regionkey"), "by_position", ["n_nationkey"], ["r_regionkey"]).select("n_name", "r_name")


@query("SELECT c_custkey, r_name FROM customer, region")
def combine_all(t):
    """Each item with each of a short list."""
    return J.combine(t.customer.select("c_custkey"), t.region.select("r_name"), "all")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'failed' END AS status FROM events")
def status_merge(t):
    status = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    error = F.when(F.col("event_id") % 2 == 0, "boom")
    return t.events.select("event_id", J.merged_status(status, error).alias("status"))


@query("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'click,view' END AS batches FROM events GROUP BY user_id")
def batch_choice(t):
    asked = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("click"), F.lit("other"))).otherwise(F.array(F.lit("none")))
    return t.events.select("user_id").distinct().select("user_id", F.array_join(J.chosen(asked, ["click", "view"]), ",").alias("batches"))


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def failed_latest(t):
    return t.events.where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


@query("SELECT event_id, 'Name' AS path, 'a' AS old_value, 'b' || event_id AS new_value FROM events UNION ALL SELECT event_id, 'Psets.Common', '1', '2' FROM events WHERE event_id % 2 = 0")
def change_paths(t):
    """A nested change tree to rows of path, old and new value."""
    value = F.struct(F.lit("a").alias("old_value"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("new_value"))
    two = F.struct(F.lit("1").alias("old_value"), F.lit("2").alias("new_value"))
    tree = F.when(F.col("event_id") % 2 == 0, F.map_from_arrays(F.array(F.lit("root['Name']"), F.lit("root['Psets']['Common']")), F.array(value, two))).otherwise(F.map_from_arrays(F.array(F.lit("root['Name']")), F.array(value)))
    doc = F.to_json(F.struct(tree.alias("values_changed")))
    return J.change_rows(t.events.select("event_id", doc.alias("doc")), "event_id", "doc")


@query("SELECT doc_id, upper(substr(trim(lang), 1, 2)) AS lang, concat_ws('-', lang, source) AS tag, sha256(source) AS digest, array_to_string(list_distinct_sorted, ',') AS numbers FROM (SELECT *, (SELECT list(m ORDER BY i) FROM (SELECT m, min(i) AS i FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{3}')) AS m, generate_subscripts(regexp_extract_all(text, '[0-9]{3}'), 1) AS i) GROUP BY m)) AS list_distinct_sorted FROM documents)")
def scalar_text(t):
    return t.documents.select("doc_id", F.upper(F.substring(F.trim("lang"), 1, 2)).alias("lang"), F.concat_ws("-", "lang", "source").alias("tag"), F.sha2("source", 256).alias("digest"), F.nullif(F.array_join(X.tokens(F.col("text"), "[0-9]{3}"), ","), F.lit("")).alias("numbers"))


@query("SELECT p_partkey, round_even(p_retailprice * 0.5, 0) AS half, CAST(p_size AS DOUBLE) AS n, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 99 END AS picked, greatest(0, 1 - least(p_size, 20) / 20.0) AS confidence FROM part")
def scalar_numeric(t):
    odd = F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0)
    return t.part.select("p_partkey", X.scale_round(F.col("p_retailprice"), 0.5, 0).alias("half"), X.number(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("n"), X.first_positive(odd, F.lit(99)).alias("picked"), X.closeness_confidence(F.col("p_size"), 20.0).alias("confidence"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, date_diff('day', o_orderdate, TIMESTAMP '2005-01-01') AS days FROM orders")
def scalar_time(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.timestamp_diff("DAY", F.col("o_orderdate"), F.lit("2005-01-01").cast("timestamp_ntz")).alias("days"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'elev:' || printf('%.2f', CAST(o_custkey AS DOUBLE)) WHEN o_orderkey % 4 = 1 THEN 'gid:g' || o_custkey WHEN o_orderkey % 4 = 2 THEN 'prefix:010' ELSE 'z:' || printf('%.1f', CAST(o_custkey AS DOUBLE)) END AS storey FROM orders")
def storey_key(t):
    i = F.col("o_orderkey") % 4
    elevation = F.when(i == 0, F.col("o_custkey").cast("double"))
    guid = F.when(i <= 1, F.concat(F.lit("g"), F.col("o_custkey").cast("string")))
    room = F.when(i == 2, "010-100").otherwise("x")
    return t.orders.select("o_orderkey", X.storey_key(elevation, guid, room, F.col("o_custkey").cast("double")).alias("storey"))


@query("SELECT n_nationkey, n_name AS local FROM nation")
def uri_local_name(t):
    """E28."""
    return t.nation.select("n_nationkey", X.local_name(F.concat(F.lit("https://example.org/a#"), F.col("n_name"))).alias("local"))


@query("SELECT l_partkey AS guid, 'Psets.' || l_returnflag || '.' || l_linestatus AS path FROM lineitem")
def pretty_paths(t):
    """A bracketed property path as a dotted one."""
    raw = F.concat(F.lit("root['Psets']['"), F.col("l_returnflag"), F.lit("']['"), F.col("l_linestatus"), F.lit("']"))
    return t.lineitem.select(F.col("l_partkey").alias("guid"), J.pretty_path(raw).alias("path"))
