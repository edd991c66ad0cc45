"""The restartable work queue as a stream of document files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.sinks.relational import insert_missing
from quarrymill.tables import exists


def run_queue(spark: SparkSession, source: str, target: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], keys: list[str], schema: str, files_per_batch: int = 350, across_batches: bool = False) -> StreamingQuery:
    """Analyse new parquet files of ``source`` batch by batch. Every batch writes its own part of
    ``target``, ``batch=<number>``, each key once, so that a batch that is repeated after a failure
    replaces what it wrote and the target is not read. With ``across_batches`` rows whose key an
    earlier batch has written are left out too, for which the key columns of the target are read.
    The target belongs to one checkpoint. Stops when all present files are done."""

    def handle(batch: DataFrame, number: int) -> None:
        result = analyse(batch).dropDuplicates(keys)
        if across_batches and exists(spark, target):
            earlier = spark.read.parquet(target).filter(F.col("batch") < number)
            result = insert_missing(result, earlier, keys)
        result.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
