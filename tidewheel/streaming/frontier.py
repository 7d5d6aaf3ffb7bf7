"""Streaming: a table as a stream, sinks, a frontier fed by a stream, and deferral as a state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewheel.functions import flow as flows
from tidewheel.operators import frontier
from tidewheel.plans.crawl import Client, Run

DEFERRAL_DDL = "tag_key string, not_before_us bigint"


def stream_of(spark: SparkSession, folder: str, types: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """The parquet files of a folder as a stream. What is there is one batch, unless ``files_per_batch`` splits it."""
    reader = spark.readStream.schema(types)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def to_sink(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is, then ends; run again, it goes on where it ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)


def crawl_stream(requests: DataFrame, client: Callable[[SparkSession], Client], on_run: Callable[[Run, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro batch of requests is drained as a crawl of its own; ``on_run`` gets its result and the batch's number.

    A batch that is run again after a failure has the same number, so ``on_run`` can write it once.
    """

    def each(batch: DataFrame, number: int) -> None:
        on_run(client(batch.sparkSession).with_request_queue(frontier.as_requests(batch)).run(), number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deferral_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the not-before time of each key of a stream of (seq, tag_key, now_us, d_us) in a table; see :func:`deferral_state`.

    Each batch is folded as a table is: in runs of ``seq`` that are spread over tasks, however hot a key; then it is joined to
    the state before it, two numbers a key. Rows of a later batch count as later. A batch that runs again writes the same state again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        before = deferral_state(batch.sparkSession, folder, number - 1) if number else None
        flows.fold_deferrals(batch, before).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deferral_state(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(tag_key, not_before_us) after batch ``number``."""
    return spark.read.schema(DEFERRAL_DDL).parquet(f"{folder}/batch={number}")


def counters_stream(outcomes: DataFrame) -> DataFrame:
    """Running success and failure counts by tag key of a stream of (tag_key, counted_as)."""
    return outcomes.groupBy("tag_key").agg(F.count_if(F.col("counted_as") == "success").alias("succeeded"), F.count_if(F.col("counted_as") == "failure").alias("failed"))
