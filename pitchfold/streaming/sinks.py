"""Where a stream's log goes: a table by batch, and finished matches without their static ids.

An object may turn out static late, and then all its rows go, also those that
were written before. So a match's positions are written once it is over, from
the log of all batches: work is in proportion to the rows, whatever the number
of batches. Each step overwrites a place that the batch id or the match names,
so a batch that is run again after a crash leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.identity import observations
from .identity import CLOSED, LATE


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log of all batches: partitions by ``batch`` and match are skipped where a filter or a join leaves them out."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def finished_matches(path: str, emit_occluded: bool = False) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over a log with ``tell_end``: writes ``log`` and ``observations`` under ``path``.

    ``observations`` has a partition a finished match, without static ids. A
    match that goes on after its end is written again, whole, when it ends again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("match_id").parquet(f"{path}/log/batch={batch_id}")
        log = read_log(spark, f"{path}/log", StructType([*batch.schema.fields, StructField("batch", LongType())]))
        ended = log.where((F.col("batch") == batch_id) & (F.col("status") == CLOSED)).select("match_id").distinct()
        if ended.isEmpty():
            return
        whole = log.where((F.col("batch") <= batch_id) & ~F.col("status").isin(CLOSED, LATE)).join(ended, "match_id", "left_semi")
        rows = observations(whole, emit_occluded).sortWithinPartitions("match_id", "frame", "id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(f"{path}/observations")

    return write


def start(log: DataFrame, path: str, checkpoint: str, available_now: bool = False, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run a log into the tables under ``path``."""
    writer = log.writeStream.foreachBatch(write or finished_matches(path)).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
