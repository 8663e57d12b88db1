"""E8 — continuous event posting with Structured Streaming.

file source (declared schema) → ``foreachBatch``: parse, route, reject requests without a key,
drop repeats of a key (within the batch and against all keys posted before), post the rest
through the same handlers as the batch processor, and write events, keys, slices and journals to
``<sink>/<kind>/part=<batch>`` with overwrite.  A batch reads only what earlier batches wrote, so
re-running one after a failure rewrites the same rows: the sink is exactly-once with respect to
the checkpoint.

Stock.  Sales take units from cost layers, and what one batch takes is gone for the next.  The
layers' balances are a versioned table: every ``SNAPSHOT``-th batch writes the layers as they stand
before it, and the balance before any batch is the last snapshot less the slices of the batches since.
A batch reads the layers of the products that it sells.  Where batches follow the order of the sales'
dates, the slices are those that one batch over all events would cut.  A sale that cannot be met in
full is rejected and closes its product's stock, within a batch as over batches.

Repeats are found by key, not by a watermark, so an event that arrives late is posted like any
other; of the events of one key the first by time is posted, ties by id.  Keys are kept in a ``KeyIndex`` with one part per batch: a batch opens the key files of those
earlier batches only whose Bloom blocks may hold one of its keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import parse_events, route_events
from ..operators.key_index import KeyIndex
from ..operators.posting import dedupe_idempotent
from ..session import ensure_checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("idempotency_key", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("amount", T.DecimalType(15, 2)),
    T.StructField("payload", T.StringType()),
    T.StructField("event_status", T.StringType()),
])
KNOWN = "ledger"
SNAPSHOT = 16
LAYERS = "operation_id long, product_id long, quantity long, unit_cost_cents long, purchase_date date"
SLICES = "sale_id long, product_id long, operation_id long, units long, unit_cost_cents long, sale_units long"
Allocate = Callable[[DataFrame, DataFrame], DataFrame]
Post = Callable[..., DataFrame]


class LayerBalances:
    """Cost layers under ``path`` as they stand before each batch, less the slices that earlier batches took."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def start(self, layers: DataFrame) -> None:
        self._snapshot(0, layers)

    def _snapshot(self, batch: int, layers: DataFrame) -> None:
        (layers.select("operation_id", "product_id", "quantity", "unit_cost_cents", "purchase_date")
         .write.mode("overwrite").parquet(f"{self.path}/layers/part={batch}"))

    def _since(self, snapshot: int, batch: int) -> DataFrame:
        layers = self.spark.read.schema(LAYERS).parquet(f"{self.path}/layers/part={snapshot}")
        if batch == snapshot:
            return layers
        slices = self.spark.read.schema(SLICES).parquet(*[f"{self.path}/slices/part={i}" for i in range(snapshot, batch)])
        used = slices.groupBy("operation_id").agg(F.sum("units").alias("_used"))
        left = layers.join(used, "operation_id", "left").withColumn("quantity", F.col("quantity") - F.coalesce("_used", F.lit(0)))
        return left.where(F.col("quantity") > 0).drop("_used")

    def before(self, batch: int) -> DataFrame:
        """What is left of the layers before ``batch``; writes a snapshot where one is due."""
        last = batch - batch % SNAPSHOT
        if batch == last and batch > 0:
            self._snapshot(batch, self._since(last - SNAPSHOT, batch))
        return self._since(last, batch)

    def take(self, batch: int, slices: DataFrame) -> DataFrame:
        """Write the slices that ``batch`` takes and read them back."""
        path = f"{self.path}/slices/part={batch}"
        kinds = T._parse_datatype_string(SLICES)
        slices.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(SLICES).parquet(path)


def start_stream_post_events(spark: SparkSession, source_path: str, sink_path: str, checkpoint_path: str, post: Post,
                             known: DataFrame | None = None, available_now: bool = True, *, allocate: Allocate | None = None,
                             stock: DataFrame | None = None, files_per_batch: int | None = None):
    """Start the streaming query; returns the StreamingQuery handle.

    ``post`` turns fresh routed events into ledger legs; ``known`` (idempotency_key, transaction_id) are the keys of
    the ledger before the stream began.  With ``stock``, the cost layers before the stream began, ``allocate`` (events,
    layers left) gives the slices of the events' sales, and ``post`` takes the slices as its second argument."""
    src = spark.readStream.schema(EVENT_SCHEMA)
    src = (src.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else src).parquet(source_path)

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        index, balances = KeyIndex(session, f"{sink_path}/index"), LayerBalances(session, sink_path)
        if batch_id == 0:
            if stock is not None:
                balances.start(stock)
            if known is not None:
                index.add(KNOWN, known)
        routed = route_events(parse_events(batch))
        requests = (routed.where(F.col("route_status") == "ROUTED").drop("idempotency_key")
                    .withColumnRenamed("payload_key", "idempotency_key").withColumn("request_id", F.col("event_id")))
        posted = index.lookup(requests, [*([KNOWN] if known is not None else []), *range(batch_id)])
        split = dedupe_idempotent(requests, posted, order=["created_at", "request_id"])  # the first to arrive, as over batches
        split["fresh"].drop("request_id").write.mode("overwrite").parquet(f"{sink_path}/fresh/part={batch_id}")
        failed = routed.where(F.col("route_status") == "FAILED").select("event_id", F.col("route_error").alias("error"))
        (failed.unionByName(split["rejected"].select("event_id", "error"))
         .unionByName(split["duplicates"].select("event_id", F.lit("Duplicate Transaction Detected").alias("error")))
         .write.mode("overwrite").parquet(f"{sink_path}/errors/part={batch_id}"))
        fresh = session.read.schema(split["fresh"].drop("request_id").schema).parquet(f"{sink_path}/fresh/part={batch_id}")
        index.add(batch_id, fresh.select("idempotency_key", F.col("event_id").alias("transaction_id")))
        fresh = fresh.withColumn("payload_key", F.col("idempotency_key"))
        sold = () if stock is None else (balances.take(batch_id, allocate(fresh, balances.before(batch_id))),)
        post(fresh, *sold).write.mode("overwrite").parquet(f"{sink_path}/journals/part={batch_id}")

    writer = src.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_available_now(spark: SparkSession, events: DataFrame, allocate: Allocate, post: Post, stock: DataFrame,
                      known: DataFrame | None = None, batches: int = 4) -> DataFrame:
    """Land ``events`` as the stream's source, a run of days for each of ``batches``, each written by all tasks and
    drained with an availableNow trigger as one batch before the next run lands, and return the journals of the
    sink.  All paths lie under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream_post_events/{uuid.uuid4().hex}"
    source, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    day = F.unix_date(F.col("created_at").cast("date"))
    cuts = events.select(day.cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = events.select(*[f.name for f in EVENT_SCHEMA.fields])
        part = part if low is None else part.where(day >= low)
        part = part if high is None else part.where((day < high) | day.isNull() if low is None else day < high)
        part.write.mode("append").parquet(source)
        start_stream_post_events(spark, source, sink, ckpt, post, known, allocate=allocate, stock=stock).awaitTermination()
    return spark.read.parquet(f"{sink}/journals/*")
