"""E7 in streaming form: per-event retry state as a streaming aggregate.

Processing attempts arrive as a stream (event_id, outcome, attempted_at).  The state per event is
one row of built-in aggregates (failures, any success, last attempt), kept in Spark's state
store; in update mode each micro-batch emits the events it changed, with the status that
``operators.events.retry_state`` computes in batch, whose plan it shares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import retry_state
from ..session import ensure_checkpoint_dir

ATTEMPT_SCHEMA = "event_id long, outcome string, attempted_at timestamp_ntz"


def run_retry_state_available_now(spark, attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Land ``attempts`` as files, drain them through the streaming aggregate (availableNow) into a
    Parquet sink under the shared checkpoint folder and return the latest status per event."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/retry_state/{uuid.uuid4().hex}"
    source, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    attempts.select("event_id", "outcome", F.col("attempted_at").cast("timestamp_ntz").alias("attempted_at")).write.parquet(source)
    out = retry_state(spark.readStream.schema(ATTEMPT_SCHEMA).parquet(source), max_attempts)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/part={batch_id}")

    q = (out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    schema = f"{','.join(f'{f.name} {f.dataType.simpleString()}' for f in out.schema.fields)}, batch_id int"
    changes = spark.read.schema(schema).parquet(f"{sink}/*") if attempts.limit(1).count() else spark.createDataFrame([], schema)
    state = F.struct("batch_id", "retry_count", "status", "last_attempt_at")
    return changes.groupBy("event_id").agg(F.max(state).alias("s")).select("event_id", "s.retry_count", "s.status", "s.last_attempt_at")
