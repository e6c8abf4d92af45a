"""Steps of the job workflows: sizes and paths of change documents, retries, layer plans, merges and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import positions

#: Error texts worth another try, and those that aren't; others are.
RETRYABLE = r"(?i)Work-horse terminated|waitpid returned|signal \d+|timeout|timed out|ConnectionError|MemoryError|ENOMEM|Temporary failure|isolation strategies exhausted|kernel failure|Broken pipe|child.*exit"
FINAL = r"(?i)VisitError|SyntaxError|JSONDecodeError|Invalid.*selector|KeyError|ValueError|FileNotFoundError|No such file|Recipe.*not found|Invalid JSON"
#: Scores of a layer for a prefix, and the least that counts as a match.
SAME, SAME_CODE, BEGINS, HOLDS, LEAST_SCORE = 100, 95, 80, 65, 65


def array_size(doc: Column) -> Column:
    """The length of a JSON array; 0 for other values, broken documents and null."""
    return F.coalesce(F.json_array_length(doc).cast("long"), F.lit(0).cast("long"))


def object_size(doc: Column) -> Column:
    """The number of a JSON object's keys; 0 for other values and null."""
    return F.when(F.ltrim(doc).startswith("{"), F.coalesce(F.size(F.json_object_keys(doc)).cast("long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def pretty_path(raw: Column) -> Column:
    """``root['a']['b']`` as ``a.b``."""
    return F.array_join(F.regexp_extract_all(raw, F.lit(r"\['([^']*)'\]"), 1), ".")


def change_rows(df: DataFrame, key: str, doc: str, section: str = "values_changed") -> DataFrame:
    """(key, path, old_value, new_value): one row per changed value of a change document; documents without any give none."""
    tree = F.from_json(doc, f"struct<`{section}`:map<string,struct<old_value:string,new_value:string>>>")[section]
    rows = df.select(key, F.explode(tree).alias("path", "v"))
    return rows.select(key, pretty_path(F.col("path")).alias("path"), "v.old_value", "v.new_value")


def retryable(message: Column) -> Column:
    """Whether an error is worth another try: retryable texts first, then final ones, anything else and null is."""
    return F.coalesce(F.when(message.rlike(RETRYABLE), True).when(message.rlike(FINAL), False), F.lit(True))


def can_retry(message: Column, attempts: Column, most: int) -> Column:
    return retryable(message) & (F.coalesce(attempts, F.lit(0)) < most)


def merged_status(status: Column, error: Column) -> Column:
    """The status, or ``failed`` where there is none but an error."""
    return F.coalesce(status, F.when(error.isNotNull(), F.lit("failed")))


def layer_score(prefix: Column, layer: Column) -> Column:
    code = F.substring_index(layer, "_", 1)
    return F.when(prefix == layer, SAME).when(prefix == code, SAME_CODE).when(layer.startswith(prefix) | prefix.startswith(layer), BEGINS).when(layer.contains(prefix) | prefix.contains(layer), HOLDS).otherwise(0)


def plan_layers(documents: DataFrame, linked: DataFrame, key: str, prefix: Column, layers: list[str], deleted: Column | None = None) -> DataFrame:
    """(key, layer, reason) of the documents still to be registered: not linked, not deleted.

    Each takes the best layer of a list kept by hand (ties: the shorter name, then the later one by name) or, where none
    matches, a new one named by its prefix.
    """
    rows = documents.join(linked.select(key).distinct(), key, "left_anti")
    rows = rows if deleted is None else rows.where(~F.coalesce(deleted, F.lit(False)))
    rows = rows.withColumn("_prefix", prefix)
    scored = [F.struct(layer_score(F.col("_prefix"), F.lit(x)).alias("score"), F.lit(-len(x)).alias("short"), F.lit(x).alias("layer")) for x in layers]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0] if scored else F.struct(F.lit(0).alias("score"), F.lit(0).alias("short"), F.lit("").alias("layer"))
    rows = rows.withColumn("_best", best)
    found = F.col("_best.score") >= LEAST_SCORE
    return rows.select(key, F.when(found, F.col("_best.layer")).otherwise(F.col("_prefix")).alias("layer"), F.when(found, "matched_existing").otherwise("new_layer_from_prefix").alias("reason"))


def plan_summary(planned: DataFrame, created: DataFrame, key: str, layer: str) -> DataFrame:
    """(registered, created, create_failed, layers): planned documents against those that exist now."""
    rows = planned.join(created.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    return rows.agg(F.count("*").alias("registered"), F.count("_ok").alias("created"), F.count_if(F.col("_ok").isNull()).alias("create_failed"), F.array_join(F.array_sort(F.collect_set(layer)), ",").alias("layers"))


def combine(a: DataFrame, b: DataFrame, mode: str, order_a: list | None = None, order_b: list | None = None, most: int = 1000) -> DataFrame:
    """Two item lists ``by_position`` (the longer one's rest is left out) or ``all``: each item with each of the other.

    For ``all``, b is a list of at most ``most`` items, which is checked, and goes into each row of a as an array.
    """
    if mode == "by_position":
        return positions(a, order_a, "_i").join(positions(b, order_b, "_i"), "_i").drop("_i")
    if mode != "all":
        raise ValueError(f"no such mode: {mode!r}")
    items = b.limit(most + 1).collect()
    if len(items) > most:
        raise ValueError(f"more than {most} items to combine with each")
    if not items:
        return a.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in b.schema.fields])
    listed = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in b.schema.fields]) for r in items])
    return a.select("*", F.explode(listed).alias("_b")).select("*", "_b.*").drop("_b")


def chosen(asked: Column, allowed: list[str]) -> Column:
    """The allowed values that were asked for, in the allowed order; all where none was."""
    every = F.array(*[F.lit(x) for x in allowed])
    own = F.array_intersect(every, F.coalesce(asked, F.array().cast("array<string>")))
    return F.when(F.size(own) > 0, own).otherwise(every)
