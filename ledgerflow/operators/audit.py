"""A — audit: hash-chained logs, snapshot change audit, lifecycle and approvals.

The reference's per-row triggers become set operations over two snapshots
(full outer join on the key, per-field ``IS DISTINCT FROM``).  The hash chain
is the one inherently sequential fold: each link hashes the previous one, so a
chain is processed in order by one task.  Chains are spread over tasks by a
hash partitioning on the chain key and each task streams its sorted rows
through ``mapInPandas`` with O(1) state (the running tail per chain).  A log with
a chain of more than ``SLICE`` rows is cut by its order into slices of about that many,
which are folded one after the other, each from the tails of the one before, so no task
sorts or holds more than a slice of a chain; appends start from the stored tail.  Verification needs no order dependency and runs
fully parallel with the chunked ``lag``.

A long log is better kept as a two-level chain: segments per chain, day and block of ids are folded
in parallel, and a short anchor chain over their last hashes keeps them in order, so that neither a row nor
a whole segment can be changed, dropped or moved unseen.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import chunked_lag
from ..session import ensure_checkpoint_dir


# the fold runs on executors that need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8")).hexdigest()


#: Rows of one chain that a task sorts and folds at once, about.
SLICE = 1 << 21
_SLICE, _PLACE = "_hc_slice", "_hc_place"


def hash_chain(rows: DataFrame, chain_key: str = "table_name", order: Sequence[str] = ("audit_id",),
               table_col: str = "table_name", op_col: str = "operation", record_col: str = "record",
               tails: DataFrame | None = None, slice_rows: int = SLICE) -> DataFrame:
    """Add prev_hash and row_hash = md5(coalesce(prev, '') || table || op || record) per chain.

    A null part hashes as the empty text, here as in ``verify_hash_chain``.  One chain is folded
    in order, ``slice_rows`` or so of its rows at a time; choose a finer chain key (tenant, day) to spread a long log.
    ``tails`` (chain_key, tail_hash) continues existing chains from their stored last hash.
    """
    longest, total = rows.groupBy(chain_key).count().agg(F.max("count"), F.sum("count")).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // slice_rows))
    if (longest or 0) <= slice_rows:
        return _fold_chains(rows, chain_key, order, table_col, op_col, record_col, tails, parts)
    slices = -(-total // slice_rows)  # of all rows: a chain that stands together in the order fits a slice, too
    return _fold_slices(rows, chain_key, order, table_col, op_col, record_col, tails, parts, slices)


def _fold_slices(rows: DataFrame, chain_key: str, order: Sequence[str], table_col: str, op_col: str, record_col: str,
                 tails: DataFrame | None, parts: int, slices: int) -> DataFrame:
    """Slices by ``order`` of all chains, folded one after the other; only the tails of chains pass from one to the next."""
    spark = rows.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hash_chain/{uuid.uuid4().hex}"
    sliced = rows.repartitionByRange(slices, *order).withColumn(_SLICE, F.spark_partition_id())
    sliced.write.partitionBy(_SLICE).parquet(f"{base}/slices")
    cut = spark.read.schema(sliced.schema).parquet(f"{base}/slices")
    last = None if tails is None else tails.select(chain_key, "tail_hash").where(F.col(chain_key).isNotNull())
    paths = []
    for i in range(slices):
        part = cut.where(F.col(_SLICE) == i).drop(_SLICE)
        known = None if last is None else last.select(F.col(chain_key).alias("_chain"), "tail_hash")
        linked = _fold_chains(part, chain_key, order, table_col, op_col, record_col, known, parts, "_chain", _PLACE)
        path = f"{base}/links/part={i}"
        linked.write.parquet(path)
        done = spark.read.schema(linked.schema).parquet(path)
        paths.append(path)
        ends = done.groupBy(chain_key).agg(F.max_by("row_hash", _PLACE).alias("tail_hash"))
        if last is not None:  # chains without a row in this slice keep their tails
            same = F.col(chain_key).eqNullSafe(F.col("_chain"))
            ends = last.join(ends.select(F.col(chain_key).alias("_chain")), same, "left_anti").unionByName(ends)
        last = ends.checkpoint()
    return spark.read.schema(linked.schema).parquet(*paths).drop(_PLACE)


def _fold_chains(rows: DataFrame, chain_key: str, order: Sequence[str], table_col: str, op_col: str, record_col: str,
                 tails: DataFrame | None, parts: int, tail_key: str | None = None, place: str | None = None) -> DataFrame:
    """The chains of ``rows``, each by one task from its tail; ``place`` also numbers the rows that a task folds."""
    data = rows
    if tails is None:
        data = data.withColumn("tail_hash", F.lit(None).cast("string"))
    elif tail_key is None:
        data = data.join(tails.select(chain_key, "tail_hash"), chain_key, "left")
    else:
        data = data.join(tails, F.col(chain_key).eqNullSafe(F.col(tail_key)), "left").drop(tail_key)
    text = {c: F.col(c).cast("string") for c in {table_col, op_col, record_col}}
    ordered = data.withColumns(text).repartition(parts, chain_key).sortWithinPartitions(chain_key, *order)
    key_idx_cols = list(ordered.columns)
    extra = [T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())]
    extra += [] if place is None else [T.StructField(place, T.LongType())]
    out_schema = T.StructType(ordered.schema.fields + extra)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current_chain = object()
        prev, n = None, 0
        for pdf in batches:
            prevs, hashes = [], []
            for chain, tail, table, op, rec in zip(pdf[chain_key], pdf["tail_hash"], pdf[table_col],
                                                   pdf[op_col], pdf[record_col]):
                if chain != current_chain:
                    current_chain, prev = chain, (tail if isinstance(tail, str) else None)
                prevs.append(prev)
                h = _md5("".join(x if isinstance(x, str) else "" for x in (prev, table, op, rec)))
                hashes.append(h)
                prev = h
            out = pdf.assign(prev_hash=prevs, row_hash=hashes)
            yield out if place is None else out.assign(**{place: range(n, n + len(out))})
            n += len(out)

    return ordered.select(*key_idx_cols).mapInPandas(fold, out_schema).drop("tail_hash")


def verify_hash_chain(log: DataFrame, chain_key: str = "table_name", order_id: str = "audit_id",
                      table_col: str = "table_name", op_col: str = "operation",
                      record_col: str = "record", tails: DataFrame | None = None) -> DataFrame:
    """Rows whose link or content does not verify: BROKEN_LINK (prev_hash ≠ previous row_hash)
    or ALTERED_ROW (row_hash ≠ md5 of its stored inputs).  Comparisons are null-safe.  With
    ``tails`` (chain_key, tail_hash: the last hash of each chain, kept elsewhere) a chain that ends
    in another hash, or is gone, gives a MISSING_TAIL row with its last id.  Fully parallel."""
    with_prev = chunked_lag(log, [chain_key], order_id, "row_hash", "_expected_prev")
    recomputed = F.md5(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("prev_hash", table_col, op_col, record_col)]))
    broken = ~F.col("prev_hash").eqNullSafe(F.col("_expected_prev"))
    altered = ~F.col("row_hash").eqNullSafe(recomputed)
    bad = (with_prev.where(broken | altered)
           .select(chain_key, order_id, "prev_hash", "row_hash",
                   F.when(altered, "ALTERED_ROW").otherwise("BROKEN_LINK").alias("problem")))
    if tails is None:
        return bad
    last = log.groupBy(F.col(chain_key).alias("_chain")).agg(F.max(F.struct(order_id, "row_hash")).alias("_last"))
    ends = tails.select(chain_key, "tail_hash").join(last, F.col(chain_key).eqNullSafe(F.col("_chain")), "left")
    cut = ends.where(~F.col("_last.row_hash").eqNullSafe(F.col("tail_hash"))).select(
        chain_key, F.col(f"_last.{order_id}").alias(order_id), F.lit(None).cast("string").alias("prev_hash"),
        F.col("_last.row_hash").alias("row_hash"), F.lit("MISSING_TAIL").alias("problem"))
    return bad.unionByName(cut)


#: Ids of one segment, at most.
SEGMENT = 1 << 16
_DAY_BITS = 32


def segment_log(rows: DataFrame, chain_key: str = "table_name", order_id: str = "audit_id", day: str = "changed_at",
                segment_ids: int = SEGMENT) -> DataFrame:
    """Adds ``segment_no`` and ``segment``: one for each chain, day and block of ``segment_ids`` ids.

    Segments of a chain are ordered by ``segment_no`` (day, then block); a null day stands before all others."""
    on = F.coalesce(F.unix_date(F.col(day).cast("date")) + 1, F.lit(0)).cast("long")
    number = F.call_function("shiftleft", on, F.lit(_DAY_BITS)) + F.floor(F.col(order_id) / F.lit(segment_ids))
    return rows.withColumn("segment_no", number).withColumn(
        "segment", F.concat_ws("|", F.coalesce(F.col(chain_key).cast("string"), F.lit("")), F.col("segment_no").cast("string")))


def segment_chain(rows: DataFrame, chain_key: str = "table_name", order_id: str = "audit_id", day: str = "changed_at",
                  segment_ids: int = SEGMENT) -> DataFrame:
    """The lower level of a two-level chain: every segment is a hash chain of its own.

    A chain with a third of the log is folded by as many tasks as it has segments; ``anchor_chain`` links them."""
    return hash_chain(segment_log(rows, chain_key, order_id, day, segment_ids), "segment", [order_id], table_col=chain_key)


def anchor_chain(chained: DataFrame, chain_key: str = "table_name", order_id: str = "audit_id", tails: DataFrame | None = None) -> DataFrame:
    """The upper level: per chain, a hash chain over its segments in order, each with its rows, last id and last hash.

    ``chain_key, segment_no, segment, n_rows, last_id, head_hash, prev_hash, row_hash``.  One row per segment is
    folded; ``tails`` (chain_key, tail_hash) continues stored anchors when later segments arrive."""
    heads = chained.groupBy(chain_key, "segment_no", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.struct(order_id, "row_hash")).alias("_last")).select(
        chain_key, "segment_no", "segment", "n_rows", F.col(f"_last.{order_id}").alias("last_id"), F.col("_last.row_hash").alias("head_hash"))
    ensure_checkpoint_dir(heads.sparkSession)
    heads = heads.checkpoint()  # counted and folded; the segments are folded for it once
    linked = hash_chain(heads, chain_key, ["segment_no"], table_col="segment", op_col="n_rows", record_col="head_hash", tails=tails)
    return linked.withColumn("n_rows", F.col("n_rows").cast("long"))


def verify_segments(chained: DataFrame, anchors: DataFrame, chain_key: str = "table_name", order_id: str = "audit_id") -> DataFrame:
    """Problems of a two-level chain: segment, id, problem.

    Rows inside a segment as in ``verify_hash_chain``; MISSING_TAIL where a segment does not end in its anchor's
    head; WRONG_COUNT where it has another number of rows; NO_ANCHOR for rows of a segment without an anchor;
    ANCHOR_BROKEN_LINK and ANCHOR_ALTERED_ROW for the anchors themselves, with their last id.  All levels are
    verified in parallel."""
    inside = verify_hash_chain(chained, "segment", order_id, table_col=chain_key, tails=anchors.select("segment", F.col("head_hash").alias("tail_hash")))
    counts = chained.groupBy("segment").agg(F.count(F.lit(1)).alias("_n"), F.max(order_id).alias("_id"))
    both = counts.join(anchors.select("segment", F.col("n_rows").alias("_rows")), "segment", "left")
    counted = both.where(~F.col("_n").eqNullSafe(F.col("_rows"))).select(
        "segment", F.col("_id").alias(order_id), F.when(F.col("_rows").isNull(), "NO_ANCHOR").otherwise("WRONG_COUNT").alias("problem"))
    upper = verify_hash_chain(anchors, chain_key, "segment_no", table_col="segment", op_col="n_rows", record_col="head_hash")
    upper = upper.join(anchors.select(chain_key, "segment_no", "segment", "last_id"), [chain_key, "segment_no"]).select(
        "segment", F.col("last_id").alias(order_id), F.concat(F.lit("ANCHOR_"), F.col("problem")).alias("problem"))
    return inside.select("segment", order_id, "problem").unionByName(counted).unionByName(upper)


def _row_json(df_cols: Sequence[str], prefix: str) -> Column:
    return F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in df_cols]), {"ignoreNullFields": "false"})


def _diff_base(before: DataFrame, after: DataFrame, key: str):
    cols = [c for c in before.columns]
    b = before.select(*[F.col(c).alias(f"o_{c}") for c in cols]).withColumn("_o", F.lit(True))
    a = after.select(*[F.col(c).alias(f"n_{c}") for c in cols]).withColumn("_n", F.lit(True))
    j = b.join(a, F.col(f"o_{key}") == F.col(f"n_{key}"), "full")
    op = (F.when(F.col("_o").isNull(), "INSERT").when(F.col("_n").isNull(), "DELETE").otherwise("UPDATE"))
    return j.withColumn("operation", op).withColumn("record_id", F.coalesce(F.col(f"n_{key}"), F.col(f"o_{key}"))), cols


def change_audit(before: DataFrame, after: DataFrame, key: str, table: str) -> DataFrame:
    """INSERT / DELETE: one '*ROW*' entry with the row as JSON; UPDATE: one entry per field
    whose text IS DISTINCT FROM the old text."""
    j, cols = _diff_base(before, after, key)
    fields = [c for c in cols]
    changes = F.filter(F.array(*[
        F.struct(F.lit(c).alias("field_name"), F.col(f"o_{c}").cast("string").alias("old_value"),
                 F.col(f"n_{c}").cast("string").alias("new_value")) for c in fields]),
        lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    row = F.array(F.struct(F.lit("*ROW*").alias("field_name"),
                           F.when(F.col("operation") == "DELETE", _row_json(cols, "o_")).alias("old_value"),
                           F.when(F.col("operation") == "INSERT", _row_json(cols, "n_")).alias("new_value")))
    entries = F.when(F.col("operation") == "UPDATE", changes).otherwise(row)
    return j.select(F.lit(table).alias("table_name"), "record_id", "operation", F.inline(entries))


def change_audit_json(before: DataFrame, after: DataFrame, key: str, table: str,
                      client_col: str = "client_id", drop: Sequence[str] = ()) -> DataFrame:
    """One row per changed record: old / new row JSON, changed field names, client id."""
    j, cols = _diff_base(before, after, key)
    keep = [c for c in cols if c not in set(drop)]
    changed = F.filter(F.array(*[F.when(~F.col(f"o_{c}").cast("string").eqNullSafe(F.col(f"n_{c}").cast("string")),
                                        F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    fields = F.when(F.col("operation") == "UPDATE", changed).otherwise(F.array().cast("array<string>"))
    out = j.select(
        F.lit(table).alias("table_name"), "operation", "record_id",
        F.when(F.col("operation") != "INSERT", _row_json(keep, "o_")).alias("old_values"),
        F.when(F.col("operation") != "DELETE", _row_json(keep, "n_")).alias("new_values"),
        fields.alias("fields_changed"),
        F.coalesce(F.col(f"n_{client_col}"), F.col(f"o_{client_col}")).alias("client_id"))
    return out.where((F.col("operation") != "UPDATE") | (F.size("fields_changed") > 0))


SENSITIVE_FIELDS = ("ssn_encrypted", "tax_id_encrypted", "bank_account_encrypted", "internal_notes")


def redacted_audit(before: DataFrame, after: DataFrame, key: str, table: str,
                   sensitive: Sequence[str] = SENSITIVE_FIELDS) -> DataFrame:
    """Change rows without sensitive fields; prev/row hash = md5 of the old / new JSON."""
    c = change_audit_json(before, after, key, table, drop=[s for s in sensitive if s in before.columns])
    return c.select("table_name", "record_id", "operation",
                    F.coalesce("new_values", "old_values").alias("rec_transact"),
                    F.md5("old_values").alias("prev_hash"), F.md5("new_values").alias("row_hash"))


def user_audit_trail(ext: DataFrame, user: str, days: int, as_of: str) -> DataFrame:
    """One user's changes in the last ``days`` days before ``as_of``, newest first."""
    t0 = F.lit(as_of).cast("timestamp")
    since = t0 - F.make_dt_interval(F.lit(days))
    return (ext.where((F.col("changed_by") == user) & (F.col("changed_at") >= since) & (F.col("changed_at") <= t0))
               .orderBy(F.col("changed_at").desc(), F.col("audit_id").desc()))


def change_summary(ext: DataFrame) -> DataFrame:
    """Count and last change time by user, operation and table."""
    return ext.groupBy("changed_by", "operation", "table_name").agg(
        F.count(F.lit(1)).alias("change_count"), F.max("changed_at").alias("last_change"))


def recent_events(ext: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` log rows (top-k)."""
    return ext.orderBy(F.col("changed_at").desc(), F.col("audit_id").desc()).limit(n)


def record_state_change(lifecycle: DataFrame, changes: DataFrame) -> DataFrame:
    """New lifecycle rows; previous_state = the transaction's latest state before the change,
    seeded by the last state already stored.  Windows are per transaction (few rows each)."""
    last = (lifecycle.groupBy("transaction_id")
            .agg(F.max_by("new_state", F.struct("changed_at", "lifecycle_id")).alias("_seed")))
    c = changes.join(last, "transaction_id", "left")
    w = Window.partitionBy("transaction_id").orderBy("changed_at", "lifecycle_id")
    prev = F.coalesce(F.lag("new_state").over(w), F.col("_seed"))
    return c.select("lifecycle_id", "transaction_id", "client_id", prev.alias("previous_state"), "new_state",
                    "changed_at", "changed_by", "reason")


def state_history(lifecycle: DataFrame, transaction_id=None) -> DataFrame:
    l = lifecycle if transaction_id is None else lifecycle.where(F.col("transaction_id") == transaction_id)
    return l.orderBy("transaction_id", "changed_at", "lifecycle_id")


def record_approval(decisions: DataFrame) -> DataFrame:
    """Approval rows; approved_at is set only for APPROVED decisions."""
    return decisions.select("approval_id", "transaction_id", "approval_level", "approver", "decision", "decided_at",
                            F.when(F.col("decision") == "APPROVED", F.col("decided_at")).alias("approved_at"),
                            "comments")


def log_events(events: DataFrame) -> DataFrame:
    """Detailed event rows keyed by md5(type::transaction::time) (NULL when transaction is NULL)."""
    t = F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    key = F.md5(F.concat(F.col("event_type"), F.lit("::"), F.col("transaction_id").cast("string"), F.lit("::"), t))
    return events.select("event_id", "event_type", "event_category", "severity", "description", "payload",
                         "triggered_by", "triggered_at", "transaction_id", "client_id",
                         key.alias("idempotency_key"), F.lit("LOGGED").alias("status"))


def transaction_audit(lifecycle: DataFrame, approvals: DataFrame, logs: DataFrame,
                      transaction_id=None) -> DataFrame:
    """Timeline of state changes, approvals and log rows; log rows match on the JSON
    field value (not a substring), so transaction 12 never matches 123."""
    life = lifecycle.select("transaction_id", F.lit("STATE_CHANGE").alias("event_kind"),
                            F.col("changed_at").alias("event_time"),
                            F.concat_ws(" -> ", F.coalesce("previous_state", F.lit("NONE")), "new_state").alias("detail"))
    appr = approvals.select("transaction_id", F.lit("APPROVAL").alias("event_kind"), F.col("decided_at").alias("event_time"),
                            F.concat_ws(" ", F.concat(F.lit("L"), F.col("approval_level").cast("string")), "decision",
                                        F.lit("by"), "approver").alias("detail"))
    lg = logs.select(F.get_json_object("record", "$.transaction_id").cast("long").alias("transaction_id"),
                     F.lit("AUDIT_LOG").alias("event_kind"), F.col("changed_at").alias("event_time"),
                     F.concat_ws(" ", "operation", "table_name").alias("detail")).where(F.col("transaction_id").isNotNull())
    u = life.unionByName(appr).unionByName(lg)
    if transaction_id is not None:
        u = u.where(F.col("transaction_id") == transaction_id)
    return u.orderBy("transaction_id", "event_time", "event_kind")


def append_only_violations(prev: DataFrame, curr: DataFrame, key: str) -> DataFrame:
    """Keys of a write-once table that were updated or deleted between two snapshots."""
    cols = [c for c in prev.columns]
    h = lambda df: df.select(F.col(key), F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("_h"))
    p = h(prev).withColumnRenamed("_h", "_ph")
    c = h(curr).withColumnRenamed("_h", "_ch")
    j = p.join(c, key, "left")
    return (j.where(F.col("_ch").isNull() | (F.col("_ch") != F.col("_ph")))
             .select(key, F.when(F.col("_ch").isNull(), "DELETE").otherwise("UPDATE").alias("violation")))
