"""The incremental form of the job-history upsert: micro-batches merged into a table on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import upsert


def job_history_stream(source: DataFrame, table: str, checkpoint: str, key: list[str], order: str, **rules) -> StreamingQuery:
    """Merge a stream of job rows into a Parquet table: of a micro-batch the last row of a key by ``order`` counts.

    Every batch writes a folder of its own from the one before, so a retried batch gives the same table again.
    """
    spark = source.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        before = read_current(spark, table, batch.schema, batch_id - 1)
        upsert(before, last, key, **rules).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_current(spark: SparkSession, table: str, schema, batch_id: int) -> DataFrame:
    """The table as of a batch; empty before the first."""
    return spark.read.schema(schema).parquet(f"{table}/batch={batch_id}") if batch_id >= 0 else spark.createDataFrame([], schema)
