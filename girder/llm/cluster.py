"""What the operators ask of the session: scratch space all executors share, row keys, and components."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import WRITTEN as _WRITTEN
from ..session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write a table to the shared scratch space and read it back: cuts lineage and survives lost executors.

    The shuffles that made it are no longer needed, but Spark deletes their files only once the driver's JVM collects
    what stands for them, by default every half hour; asking for that here keeps the disk to one step's exchanges
    (``small`` steps are not worth it).
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not small:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    _WRITTEN.add(path)
    return out


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the greatest counts, ``most`` at most: those above the least power of 2**(1/16) that leaves so few.

    One aggregate over some hundred classes of counts finds the bound, so no sort gathers rows on the driver.
    """
    level = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    total, bound = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += row["n"]
        if total > most:
            break
        bound = row["level"]
    return counts.where(level >= bound) if bound is not None else counts.where("false")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.discard(folder)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stored` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that operators still hold in the shared folder. Results are lazy and read them, so this is for
    the caller to ask for, once the results are written."""
    for folder in sorted(_WRITTEN):
        _delete(spark, folder)


def steady(docs: DataFrame) -> DataFrame:
    """``docs`` where a row's file and place name it in every scan: Parquet files, columns and rows of them chosen by
    fixed rules. Anything else is written to the shared scratch space once, and read from there."""
    plan, fixed = docs._jdf.queryExecution().analyzed(), "_metadata" not in docs.columns
    fixed &= plan.deterministic()
    while fixed and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if fixed and plan.nodeName().startswith("LogicalRelation"):
        try:
            docs.select("_metadata.file_path", "_metadata.row_index")
            return docs
        except AnalysisException:  # files of another kind
            pass
    names = [f"c{i}" for i in range(len(docs.columns))]
    return stored(docs.toDF(*names), "rows").toDF(*docs.columns)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """:func:`steady` rows with a number each under ``name``, counted through the files in the order of their paths.

    Splits have no part in it, so it is the same in all scans, whichever executors come and go between them.
    """
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = sorted(map(tuple, docs.select(path.alias("path"), place.alias("place")).groupBy("path").agg(F.max("place") + 1).collect()))
    before = [0, *accumulate(n for _, n in files)]
    known = F.lit([f for f, _ in files]) if files else F.array().cast("array<string>")
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.array_position(known, path).cast("int"))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], (start + place).alias(name))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, id, text): _row tells repeated and null ids apart, and is the same in every scan."""
    rows = steady(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")))
    return numbered(rows, "_row").select("_row", "_id", "_text")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component being its least node.

    Each round links every node and its neighbours to the least node near them (the large-star and small-star steps),
    which needs a number of rounds that grows with the logarithm of the component size. It is over when every
    node hangs on one other and those hang on none. Rounds are cut by tables in the shared scratch space; no edge reaches the driver.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges", small=True)
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").union(least.where("u <> m").select("u", F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        short = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(short.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", small=True)
        drop_stored(current)
        current = after
        ends = current.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(current.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").head(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())


def merged_components(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (node, component) after more edges (a, b), which may have nodes of no component yet.

    Only the components that the edges join are gone through, as the nodes of a smaller graph.
    """
    name = lambda c, to: parts.select(F.col("node").alias(c), F.col("component").alias(to))
    joined = edges.join(name("a", "_a"), "a", "left").join(name("b", "_b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    new = stored(components(joined), "parts", small=True)
    old = parts.join(new.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    fresh = new.join(parts, "node", "left_anti").select("node", "component")
    return stored(old.unionByName(fresh), "parts", small=True)
