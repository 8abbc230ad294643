"""Changes between snapshots as a stream: each batch of file states against the last known ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.operators.changes import compute_changes
from gneiss.storage import materialize

STATE = "path string, content_hash string, batch long"
#: Batches after which the log of states is folded into one.
FOLD = 64


def stream_changes(states: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``sink`` with (path, status) for each batch of a stream (path, content_hash).

    Within a batch the largest hash of a path counts. What is known lies beside the stream's
    checkpoint as a log, one folder for each batch, which holds only the paths of that batch; every ``FOLD``
    batches the log is folded into one folder. A restart goes on from there, and a batch that is
    replayed sees what was known before it, so it gives the same result.
    """
    spark = states.sparkSession
    log = f"{checkpoint.rstrip('/')}/known"

    def known(before: int) -> DataFrame:
        """The last state of each path before a batch."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(log)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], "path string, content_hash string")
        rows = spark.read.schema(STATE).parquet(log)
        folded = rows.where((F.col("batch") < 0) & (-F.col("batch") <= before)).agg(F.coalesce(F.min("batch"), F.lit(0)).alias("b")).first()["b"]
        live = rows.where((F.col("batch") == folded) & (folded < 0) | F.col("batch").between(-folded, before - 1))
        return live.groupBy("path").agg(F.max_by("content_hash", F.when(F.col("batch") < 0, -1).otherwise(F.col("batch"))).alias("content_hash"))

    def step(batch: DataFrame, number: int) -> None:
        new = materialize(batch.groupBy("path").agg(F.max("content_hash").alias("content_hash")), "states")
        told = known(number).join(new.select("path"), "path", "left_semi")
        sink(compute_changes(materialize(told, "states"), new, "path", "content_hash"), number)
        # folders are named by batch, so a replay writes the same one again
        new.write.mode("overwrite").parquet(f"{log}/batch={number}")
        if (number + 1) % FOLD == 0:
            materialize(known(number + 1), "states").write.mode("overwrite").parquet(f"{log}/batch={-(number + 1)}")

    return states.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
