"""Model diff, meaningful change, upserts, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import merge_json
from .selectors import ignored


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, op, changed): added, deleted or changed rows and the sorted names of the columns that differ."""
    a = old.select(F.col(key), F.struct(*columns).alias("_old"))
    b = new.select(F.col(key), F.struct(*columns).alias("_new"))
    both = a.join(b, key, "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in sorted(columns)]))
    op = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.size(names) > 0, "changed")
    return both.withColumn("op", op).where("op IS NOT NULL").select(key, "op", F.when(F.col("op") == "changed", names).otherwise(F.array().cast("array<string>")).alias("changed"))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def sample(changes: DataFrame, key: str, n: int) -> DataFrame:
    """Per kind of change the count and the first n keys.

    The keys are ranked by a window, not gathered in one list, and only n of each kind are collected.
    """
    from pyspark.sql import Window

    ranked = changes.withColumn("_n", F.row_number().over(Window.partitionBy("op").orderBy(key)))
    few = ranked.where(F.col("_n") <= n).groupBy("op").agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return counts(changes).join(few, "op")


def meaningful(paths: DataFrame, key: str, path: str, flags: Column, globs: list[str]) -> DataFrame:
    """Keys with a flagged change (geometry, material, container, aggregate) or a path no pattern ignores.

    A path that can't be read (null) counts as meaningful.
    """
    counts_ = F.coalesce(flags, F.lit(False)) | F.col(path).isNull() | ~ignored(F.col(path), globs)
    return paths.groupBy(key).agg(F.max(F.coalesce(counts_, F.lit(True))).alias("meaningful"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str] = (), keep_old: bool = True, json: list[str] = (), fixed: list[str] = ()) -> DataFrame:
    """Rows of both by key, columns merged: ``overwrite`` takes the new value, ``json`` is united (new wins), ``fixed``
    is never updated; the rest keeps the old value if there is one (``keep_old``) or takes the new if there is one."""
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, F.struct(*rest).alias("_o")).join(new.select(*key, F.struct(*rest).alias("_n")), key, "full_outer")

    def merged(c: str) -> Column:
        o, n = F.col(f"_o.{c}"), F.col(f"_n.{c}")
        if c in json:
            return F.when(F.col("_o").isNull(), n).when(F.col("_n").isNull(), o).otherwise(merge_json(o, n))
        if c in fixed:
            return F.when(F.col("_o").isNull(), n).otherwise(o)
        if c in overwrite:
            return F.when(F.col("_n").isNull(), o).otherwise(n)
        return F.coalesce(o, n) if keep_old else F.coalesce(n, o)

    return both.select(*key, *[merged(c).alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and the new ones whose key is absent; of equal new keys one row."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def revisions(changes: DataFrame, previous: DataFrame, key: str, revision: str, meaningful_keys: DataFrame) -> DataFrame:
    """(key, op, revision): added and meaningfully changed rows get the new revision, deleted ones the previous if there
    is one; changes that are all ignored are left out."""
    out = changes.join(meaningful_keys.select(key, "meaningful"), key, "left").join(previous.select(key, F.col("revision").alias("_prev")), key, "left")
    gets = (F.col("op") == "added") | ((F.col("op") == "changed") & F.col("meaningful")) | ((F.col("op") == "deleted") & F.col("_prev").isNotNull())
    return out.where(gets).select(key, "op", F.when(F.col("op") == "deleted", F.col("_prev")).otherwise(F.lit(revision)).alias("revision"))
