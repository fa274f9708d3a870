"""Job messages from a folder of JSON lines, dispatched one batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ratewright.schemas import ENUMS, JOB_MESSAGE


def parse_messages(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages with ``ok``, beside the columns in ``keep``; a line that is no JSON object, lacks an id or names no known job type is not."""
    parsed = F.from_json(column, JOB_MESSAGE)
    rows = lines.select(*keep, F.col(column).alias("raw"), parsed.alias("m")).select(*keep, "raw", "m.*")
    ok = F.col("job_id").isNotNull() & F.col("entity_id").isNotNull() & F.col("job_type").isin(ENUMS["job_type"])
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def watch_changes(spark: SparkSession, inbox: str, schema: str, checkpoint: str, key: str, listener: Callable[[DataFrame], None]) -> StreamingQuery:
    """Tell ``listener`` of every row that comes into a folder of JSON lines, as ``(key, payload)`` messages, once each."""
    rows = spark.readStream.schema(schema).json(inbox)
    told = rows.select(key, F.to_json(F.struct(*rows.columns)).alias("payload"))
    return told.writeStream.foreachBatch(lambda batch, _id: listener(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_jobs(spark: SparkSession, inbox: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], None]], log: Callable[[DataFrame], None]) -> StreamingQuery:
    """Work off all waiting messages. Each batch goes to the handlers by job type; bad messages are logged, not repeated.

    The checkpoint remembers which files are done, so a restart continues where the last run broke off.
    """

    def batch(rows: DataFrame, _id: int) -> None:
        rows = rows.persist()
        try:
            log(rows.filter("not ok"))
            for kind, handle in handlers.items():
                handle(rows.filter(F.col("ok") & (F.col("job_type") == kind)))
        finally:
            rows.unpersist()

    stream = parse_messages(spark.readStream.text(inbox))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
