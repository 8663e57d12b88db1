"""O5 on a stream — hourly metric trend over event-time windows, with late rows kept.

file source → ``foreachBatch`` splits each batch at the watermark of the batches before it: rows whose
window has closed go to the side table ``<sink>/late/part=<batch>``, all others to ``<sink>/ontime``.
A second query reads the on-time rows with ``withWatermark`` and sums them in tumbling windows, in
update mode; each of its batches writes the windows it changed.  The trend is the last state of each
window plus what the side table holds for it, as sums and counts, so it equals the batch trend and no
row is lost, however late it comes.

The state that Spark keeps is one sum and count for each metric and open window.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

METRICS = "metric_id long, metric_name string, metric_value decimal(15,2), metric_timestamp timestamp_ntz"
_SUMS = "time_bucket timestamp, metric_name string, cents long, n long"


def _sums(rows: DataFrame, width: str) -> DataFrame:
    """Sum in cents and count by metric and tumbling window."""
    return (rows.groupBy(F.window("at", width).alias("_w"), "metric_name")
            .agg(F.sum((F.col("metric_value") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
            .select(F.col("_w.start").alias("time_bucket"), "metric_name", "cents", "n"))


def split_late(spark: SparkSession, source: str, sink: str, checkpoint: str, delay_minutes: int, width: str, files_per_batch: int | None = None):
    """Start the query that parts on-time rows from late ones; returns its handle.

    The watermark of a batch is the latest time of all batches before it, less the delay."""
    src = spark.readStream.schema(METRICS)
    src = (src.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else src).parquet(source)

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("at", F.col("metric_timestamp").cast("timestamp"))
        seen = None
        if batch_id:
            before = session.read.schema("top timestamp").parquet(*[f"{sink}/seen/part={batch_id - 1}"])
            seen = before.agg(F.max("top")).first()[0]
        top = rows.agg(F.max("at").alias("top")).select(F.greatest("top", F.lit(seen).cast("timestamp")).alias("top"))
        top.write.mode("overwrite").parquet(f"{sink}/seen/part={batch_id}")
        closes = F.window("at", width)["end"]
        late = F.coalesce(closes <= F.lit(seen).cast("timestamp") - F.make_dt_interval(mins=F.lit(delay_minutes)), F.lit(False))
        rows.where(late).write.mode("overwrite").parquet(f"{sink}/late/part={batch_id}")
        rows.where(~late).write.mode("overwrite").parquet(f"{sink}/ontime/part={batch_id}")

    return (src.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def window_sums(spark: SparkSession, sink: str, checkpoint: str, delay_minutes: int, width: str):
    """Start the windowed aggregation over the on-time rows; returns its handle."""
    rows = (spark.readStream.schema(f"{METRICS}, at timestamp, part int").option("maxFilesPerTrigger", 64).parquet(f"{sink}/ontime")
            .withWatermark("at", f"{delay_minutes} minutes"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/windows/part={batch_id}")

    return (_sums(rows, width).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def trend_of(spark: SparkSession, sink: str, width: str) -> DataFrame:
    """time_bucket, metric_name, cents, n, late: the last state of each window together with its late rows."""
    states = spark.read.schema(f"{_SUMS}, batch int").parquet(f"{sink}/windows/*")
    state = states.groupBy("time_bucket", "metric_name").agg(F.max(F.struct("batch", "cents", "n")).alias("_s")).select(
        "time_bucket", "metric_name", "_s.cents", "_s.n", F.lit(0).cast("long").alias("late"))
    late = _sums(spark.read.schema(f"{METRICS}, at timestamp").parquet(f"{sink}/late/*"), width).withColumn("late", F.col("n"))
    return state.unionByName(late).groupBy("time_bucket", "metric_name").agg(*[F.sum(c).alias(c) for c in ("cents", "n", "late")])


def run_available_now(spark: SparkSession, batches: list[DataFrame], delay_minutes: int = 60, width: str = "1 hour") -> DataFrame:
    """Land each of ``batches`` as one file of the stream, drain both queries and return ``trend_of`` the sink."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/metric_trend/{uuid.uuid4().hex}"
    source, sink = f"{base}/source", f"{base}/sink"
    for rows in batches:
        rows.select("metric_id", "metric_name", "metric_value", F.col("metric_timestamp").cast("timestamp_ntz").alias("metric_timestamp")).coalesce(1).write.mode("append").parquet(source)
    split_late(spark, source, sink, f"{base}/split", delay_minutes, width, 1).awaitTermination()
    window_sums(spark, sink, f"{base}/windows", delay_minutes, width).awaitTermination()
    return trend_of(spark, sink, width)
