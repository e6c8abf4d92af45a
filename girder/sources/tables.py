"""Scans and sinks: layers, delimited and JSON files, write-back, versioned objects, reports, triples."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

FORMATS = ("csv", "json", "parquet")


def scan_layer(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """One layer of a model; known layers are read with their declared schema."""
    reader = spark.read.schema(schemas.schema(layer)) if layer in schemas.LAYERS else spark.read
    return reader.parquet(f"{root}/{layer}.parquet")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", delimiter: str = ",") -> str:
    """Write csv (with a header), json or parquet; other formats are refused."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {', '.join(FORMATS)}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("sep", delimiter).csv(path)
    else:
        getattr(writer, fmt)(path)
    return path


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet", delimiter: str = ",") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("sep", delimiter).csv(path) if fmt == "csv" else getattr(reader, fmt)(path)


def extract_all(tables: dict[str, DataFrame], prefix: str, layers: list[str] | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Write the asked layers (default all) below a prefix; unknown names are refused."""
    unknown = set(layers or ()) - set(tables)
    if unknown:
        raise ValueError(f"no such layers: {sorted(unknown)}")
    return {name: write_table(tables[name], f"{prefix}/{name}", fmt) for name in layers or tables}


def column_schemas(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(layer, column, type) of every table, from its schema alone."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "layer string, column string, type string")


def preview(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def export_projection(df: DataFrame, columns: dict[str, str], null_value: str = "-") -> DataFrame:
    """Text export: {label: source}, empty and null values shown as ``null_value``."""
    shown = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(null_value))
    return df.select(*[shown(source).alias(label) for label, source in columns.items()])


def write_back(df: DataFrame, edits: DataFrame, key: str, columns: list[str], null_value: str = "-") -> DataFrame:
    """Take the edited values by key; blank and ``null_value`` cells keep the old ones, unknown keys are ignored."""
    new = edits.select(key, *[F.nullif(F.nullif(F.col(c), F.lit("")), F.lit(null_value)).alias(f"_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def pinned_or_head(versions: DataFrame, pins: DataFrame, key: str, version: str, created: Column) -> DataFrame:
    """Per key the pinned version where the pins name one that exists, else the newest."""
    marked = versions.join(pins.select(key, F.col(version).alias("_pin")), key, "left")  # pins grow with the keys
    order = [F.coalesce(F.col(version) == F.col("_pin"), F.lit(False)).desc(), created.desc(), F.col(version).desc()]
    ranked = marked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").withColumn("pinned", F.coalesce(F.col(version) == F.col("_pin"), F.lit(False))).drop("_n", "_pin")


def append_objects(objects: DataFrame, content: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(versions with sha256 and size, lineage edges) for new objects; roots have a null parent."""
    versions = objects.withColumn("sha256", F.sha2(F.col(content), 256)).withColumn("size_bytes", F.octet_length(content).cast("long"))
    versions = versions.withColumn("kind", F.when(F.col(parent).isNull(), "root").otherwise("derived"))
    edges = versions.where(F.col(parent).isNotNull()).select(F.col(parent).alias("parent_id"), F.col("id").alias("child_id"), F.lit("input").alias("role"))
    return versions.drop(content), edges


def _ascii_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition has one ASCII character, and those characters."""
    folds = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in (*range(0xA0, 0x250), *range(0x1E00, 0x2160), *range(0xFF01, 0xFF5F))]
    own = [(c, a) for c, a in folds if len(a) == 1]
    return "".join(c for c, _ in own), "".join(a for _, a in own)


def safe_name(name: Column, length: int = 180) -> Column:
    """The last part of a path as a file name of letters, digits, dot, dash and underscore, the extension in lower case.

    Letters lose their accents; other characters beyond ASCII go; any other run becomes one underscore. The stem has at
    most ``length`` characters, and is ``file`` where nothing is left of it.
    """
    base = F.regexp_replace(name, "^.*/", "")
    parts = r"(?s)^(\.*[^.].*)(\.[^.]*)$"
    whole = base.rlike(parts)
    stem, extension = F.when(whole, F.regexp_extract(base, parts, 1)).otherwise(base), F.when(whole, F.lower(F.regexp_extract(base, parts, 2))).otherwise("")
    stem = F.regexp_replace(F.translate(stem, *_ascii_letters()), r"[^\x00-\x7F]", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), "_+", "_")
    stem = F.regexp_replace(F.regexp_replace(stem, "^[._-]+|[._-]+$", "").substr(1, length), "[._-]+$", "")
    return F.concat(F.when(stem == "", "file").otherwise(stem), extension)


def clash_pairs(reports: DataFrame, column: str) -> DataFrame:
    """(guid_a, guid_b, distance, kind) of clash reports in either layout: a JSON list of sets, or one set.

    Distances that are no numbers are null; entries without both ids are dropped.
    """
    as_list = F.from_json(column, f"array<{schemas.CLASH_SET}>")
    as_one = F.from_json(column, schemas.CLASH_SET)
    trimmed = F.ltrim(F.col(column))
    sets = F.when(trimmed.startswith("["), as_list).otherwise(F.array(as_one))
    clashes = reports.select("*", F.explode(sets).alias("_set")).select("*", F.explode(F.map_values("_set.clashes")).alias("_c"))
    ids = (F.col("_c.a_global_id").isNotNull()) & (F.col("_c.b_global_id").isNotNull())
    return clashes.where(ids).select(F.col("_c.a_global_id").alias("guid_a"), F.col("_c.b_global_id").alias("guid_b"), F.col("_c.distance").try_cast("double").alias("distance"), F.col("_c.type").alias("kind"))


def room_report(reports: DataFrame, column: str, min_confidence: float, statuses: list[str]) -> DataFrame:
    """Edges (element, space, confidence) of room reports that pass the status and confidence gates."""
    schema = "struct<elements:array<struct<global_id:string,space:string,status:string,confidence:double>>>"
    rows = reports.select(F.explode(F.from_json(column, schema)["elements"]).alias("e")).select("e.*")
    gate = F.lower("status").isin([s.lower() for s in statuses]) & (F.col("confidence") >= min_confidence) & F.col("space").isNotNull()
    return rows.where(gate).select(F.col("global_id").alias("element"), "space", "confidence")


def turtle(triples: DataFrame) -> DataFrame:
    """One line a triple: subject and predicate as IRIs, objects as IRIs where they look like one, else as text."""
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    text = F.concat(F.lit('"'), F.regexp_replace("o", r'(["\\])', r"\\$1"), F.lit('"'))
    obj = F.when(F.col("o").rlike("^[a-z]+://"), iri("o")).otherwise(text)
    return triples.distinct().select(F.concat_ws(" ", iri("s"), iri("p"), obj, F.lit(".")).alias("line"))
