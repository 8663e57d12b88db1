"""G — staged import: CSV in → sanitize → validate → approve ×3 → post.

Every step is one set-based transformation over a whole import session; the
reference's per-row loops, per-row round trips and per-row counter updates
become projections, broadcastable existence joins and conditional counts.
Workflow state lives in a DataFrame (written to the shared table location at
the human approval gates).
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.ids import with_sequence_id

AR_COLUMNS = ("customer_code", "client_code", "amount", "invoice_date", "due_date", "status")

# Import type → staging table that holds its rows.
STAGING_TABLES = {
    "ar": "stg_ar_imports",
    "ap": "stg_ap_imports",
    "inventory": "stg_inventory_imports",
    "transactions": "stg_transaction_imports",
}

APPROVAL_STEPS = {1: ("VALID", "APPROVE_L1"), 2: ("APPROVE_L1", "APPROVE_L2"), 3: ("APPROVE_L2", "APPROVE_L3")}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of RFC 4180 files as text: record, header (first record of its file), _file, _block, _pos.

    A quoted field may hold line breaks, so a line is a record only where it starts outside quotes.  Files
    are still read in blocks by many tasks: each block counts its quotes, the counts of a file's blocks are
    summed up in order, and so every block knows whether it starts inside a quoted field.  Within a block
    the quotes before a line decide the same for the line.  Lines that start and end outside quotes are
    records at once; only the others are gathered, record by record, also across blocks.

    A file whose quotes do not balance is refused: from the stray quote on, no record would be sure.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_pos"), F.coalesce(quotes, F.lit(0)).cast("long").alias("_q")))
    blocks = lines.groupBy("_file", "_block").agg(F.sum("_q").alias("_n"))
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))  # one row per block
    odd = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).where(F.col("_n") % 2 != 0).select("_file").limit(1).collect()
    if odd:
        raise ValueError(f"quotes do not balance in {odd[0]['_file']}")
    in_block = Window.partitionBy("_file", "_block").orderBy("_pos")
    before = F.coalesce(F.sum("_q").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(blocks.select("_file", "_block", "_before"), ["_file", "_block"]).withColumns(
        {"_starts": (F.col("_before") + before) % 2 == 0, "header": (F.col("_block") == 0) & (F.row_number().over(in_block) == 1)})
    single = marked.where(F.col("_starts") & (F.col("_q") % 2 == 0))
    parts = marked.where(~(F.col("_starts") & (F.col("_q") % 2 == 0)))
    # the line that opened the record: in this block, or the last one opened in an earlier block of the file
    opened = F.when(F.col("_starts"), F.struct("_block", "_pos"))
    own = F.last(opened, ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    last = parts.groupBy("_file", "_block").agg(F.max(opened).alias("_last"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_open", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    gathered = (parts.withColumn("_own", own).join(last, ["_file", "_block"])
                .select("_file", F.coalesce("_own", "_open").alias("_at"), "header", F.struct("_block", "_pos", "value").alias("_line"))
                .groupBy("_file", "_at").agg(F.bool_or("header").alias("header"), F.sort_array(F.collect_list("_line")).alias("_lines"))
                .select(F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("record"), "header", "_file", "_at._block", "_at._pos"))
    records = single.select(F.col("value").alias("record"), "header", "_file", "_block", "_pos").unionByName(gathered)
    record = F.regexp_replace("record", r"\r$", "")
    return records.withColumn("record", F.when(F.col("header"), F.regexp_replace(record, "^\ufeff", "")).otherwise(record))


def import_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = AR_COLUMNS,
               session_id: int = 1) -> DataFrame:
    """Read a header CSV with every column as text; number rows in file order; stage as DRAFT.

    Columns are bound by the names in the header (blanks around a name and its case do not
    matter); columns that are not asked for are left out and a missing one is an error, as is a file
    whose header differs from the others'.  Quoted fields may hold separators, doubled quotes and line
    breaks (``csv_records``); blank lines are no rows.

    File order = (file path, block start, position in block) of a record's first line; the dense
    number comes from ``with_sequence_id`` (no single-task window).  Malformed records are kept
    with the raw text in ``_corrupt_record``.
    """
    records = csv_records(spark, path)
    heads = [r["record"] for r in records.where("header").select("record").distinct().limit(2).collect()]
    if not heads:
        raise ValueError(f"no CSV header in {path}")
    if len(heads) > 1:
        raise ValueError(f"CSV files with different headers: {heads[0]!r} and {heads[1]!r}")
    header = next(csv.reader([heads[0]]), [])
    place = {h.strip().lower(): i for i, h in reversed(list(enumerate(header)))}
    missing = [c for c in columns if c.lower() not in place]
    if missing:
        raise ValueError(f"columns missing in the CSV header: {', '.join(missing)}")
    schema = ", ".join([*[f"c{i} string" for i in range(len(header))], "_corrupt_record string"])
    parsed = F.from_csv(F.col("record"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "quote": '"', "escape": '"'})
    raw = (records.where(~F.col("header") & (F.trim("record") != "")).withColumn("_row", parsed)
           .select(*[F.col(f"_row.c{place[c.lower()]}").alias(c) for c in columns], "_row._corrupt_record", "_file", "_block", "_pos"))
    numbered = with_sequence_id(raw, ["_file", "_block", "_pos"], "row_number")
    return numbered.drop("_file", "_block", "_pos").withColumn("session_id", F.lit(session_id)) \
                   .withColumn("validation_status", F.lit("DRAFT")) \
                   .withColumn("validation_errors", F.lit(None).cast("string"))


def sanitize_ar(stg: DataFrame, customers: DataFrame, clients: DataFrame) -> DataFrame:
    """Collect errors in fixed order → VALID / INVALID with '; '-joined messages.

    A NULL amount / date / status passes (a NULL predicate is not TRUE), as in the reference.
    """
    cust = customers.select(F.col("customer_id").alias("_cid")).distinct().withColumn("_cust_ok", F.lit(True))
    cli = clients.select(F.col("client_id").alias("_clid")).distinct().withColumn("_cli_ok", F.lit(True))
    s = (stg.join(cust, V.parse_int("customer_code") == F.col("_cid"), "left")
            .join(cli, V.parse_int("client_code") == F.col("_clid"), "left"))
    errs = V.errors_of([
        (F.col("_cust_ok").isNull(), "Customer not found"),
        (F.col("_cli_ok").isNull(), "Client not found"),
        (~F.col("amount").rlike(V.AMOUNT_PATTERN), "Invalid amount format"),
        (~F.col("invoice_date").rlike(V.DATE_PATTERN), "Invalid Date"),
        (~F.col("due_date").rlike(V.DATE_PATTERN), "Invalid Date"),
        (~F.col("status").isin(*V.AR_STATUSES), "INVALID Status"),
    ])
    out = s.withColumn("_e", errs)
    ok = F.size("_e") == 0
    return out.select(*[c for c in stg.columns if c not in ("validation_status", "validation_errors")],
                      F.when(ok, "VALID").otherwise("INVALID").alias("validation_status"),
                      F.when(ok, F.lit(None).cast("string")).otherwise(V.joined(F.col("_e"))).alias("validation_errors"))


def workflows_after_sanitize(sanitized: DataFrame) -> DataFrame:
    """Workflow rows: VALID rows move DRAFT → PENDING; the rest stay DRAFT."""
    ok = F.col("validation_status") == "VALID"
    return sanitized.select(
        "session_id", F.col("id").alias("staging_record_id"),
        F.when(ok, "DRAFT").otherwise(F.lit(None).cast("string")).alias("previous_state"),
        F.when(ok, "PENDING").otherwise("DRAFT").alias("new_state"),
        F.when(ok, "PENDING FOR VALIDATION").otherwise(F.lit(None).cast("string")).alias("notes"))


# rule id → (checked column, fail message, pass message)
AR_RULES = {
    1: ("amount", "INVALID: Check Amount Value!", "Valid: Amount!"),
    2: ("invoice_date", "INVALID: Check Invoice Value!", "VALID: Invoice Date!"),
    3: ("customer_code", "INVALID: Customer not exists!", "VALID: Customer!"),
    4: ("status", "INVALID: Status Check!", "Valid: Status!"),
}


def validate_ar(stg: DataFrame, workflows: DataFrame, customers: DataFrame,
                table_name: str = "stg_ar_imports") -> dict[str, DataFrame]:
    """Four rules per PENDING row → validation log, compliance rows and the new workflow.

    The rules are per row, so the workflow update is a projection of one join between the
    staged rows and their workflow rows (no aggregate, no second pass).  Unparseable amounts
    or dates fail their rule for that row only (never the batch).
    """
    cust = customers.select(F.col("customer_id").alias("_cid")).distinct().withColumn("_cust_ok", F.lit(True))
    s = stg.select("session_id", F.col("id").alias("staging_record_id"), *AR_COLUMNS)
    r = (workflows.join(s, ["session_id", "staging_record_id"], "left")
         .join(cust, V.parse_int("customer_code") == F.col("_cid"), "left"))
    amt = V.parse_decimal("amount")
    inv = F.col("invoice_date").try_cast("date")
    due = F.col("due_date").try_cast("date")
    fails = {
        1: F.coalesce((F.col("amount").isNotNull() & amt.isNull()) | (amt <= 0), F.lit(False)),
        2: F.coalesce(inv.isNull() | due.isNull() | (inv > due), F.lit(False)),
        3: F.col("_cust_ok").isNull(),
        4: F.coalesce(~F.col("status").isin(*V.AR_STATUSES), F.lit(False)),
    }
    r = r.withColumns({f"_f{k}": v for k, v in fails.items()})
    pending = r.where(F.col("new_state") == "PENDING")
    checks = F.array(*[
        F.struct(F.lit(rid).alias("rule_id"), F.lit(col).alias("field_name"),
                 F.when(F.col(f"_f{rid}"), F.lit(bad)).otherwise(F.lit(good)).alias("validation_rule"),
                 F.col(col).alias("actual_value"), (~F.col(f"_f{rid}")).alias("is_valid"),
                 F.when(F.col(f"_f{rid}"), "ERROR").otherwise("INFO").alias("severity"))
        for rid, (col, bad, good) in AR_RULES.items()])
    per_rule = pending.select("session_id", "staging_record_id", "client_code", F.inline(checks))
    log = per_rule.select("session_id", F.col("staging_record_id").alias("row_number"), "rule_id", "field_name",
                          "validation_rule", "actual_value", "is_valid", "severity")
    compliance = per_rule.select(
        V.parse_int("client_code").alias("client_id"), "rule_id", "session_id", "staging_record_id",
        F.lit(None).cast("long").alias("production_record_id"), F.lit(table_name).alias("table_name"),
        F.when(F.col("is_valid"), "PASS").otherwise("FAIL").alias("status"),
        F.when(F.col("is_valid"), "RESOLVED").otherwise("UNRESOLVED").alias("resolution_status"))
    ok = (F.col("new_state") == "PENDING") & ~(F.col("_f1") | F.col("_f2") | F.col("_f3") | F.col("_f4"))
    wf = r.select("session_id", "staging_record_id",
                  F.when(ok, F.col("new_state")).otherwise(F.col("previous_state")).alias("previous_state"),
                  F.when(ok, "VALID").otherwise(F.col("new_state")).alias("new_state"),
                  F.when(ok, "VALIDATED").otherwise(F.col("notes")).alias("notes"))
    return {"log": log, "compliance": compliance, "workflows": wf}


def approve(workflows: DataFrame, level: int, approver: str) -> dict[str, DataFrame]:
    """One approval level: rows in the level's source state advance; approval rows are emitted."""
    src, dst = APPROVAL_STEPS[level]
    hit = F.col("new_state") == src
    wf = workflows.select(
        "session_id", "staging_record_id",
        F.when(hit, F.col("new_state")).otherwise(F.col("previous_state")).alias("previous_state"),
        F.when(hit, F.lit(dst)).otherwise(F.col("new_state")).alias("new_state"),
        F.when(hit, F.lit(f"APPROVED L{level} BY {approver}")).otherwise(F.col("notes")).alias("notes"))
    approvals = workflows.where(hit).select(
        "session_id", "staging_record_id", F.lit(level).alias("approval_level"),
        F.lit(approver).alias("approver"), F.lit("APPROVED").alias("decision"))
    return {"workflows": wf, "approvals": approvals}


def reject(workflows: DataFrame, session_id: int) -> DataFrame:
    """DRAFT (no previous state) or PENDING (from DRAFT) rows of one session → REJECT."""
    hit = ((F.col("session_id") == session_id)
           & (((F.col("new_state") == "DRAFT") & F.col("previous_state").isNull())
              | ((F.col("new_state") == "PENDING") & (F.col("previous_state") == "DRAFT"))))
    return workflows.select(
        "session_id", "staging_record_id",
        F.when(hit, F.col("new_state")).otherwise(F.col("previous_state")).alias("previous_state"),
        F.when(hit, F.lit("REJECT")).otherwise(F.col("new_state")).alias("new_state"),
        F.when(hit, F.lit("REJECTED")).otherwise(F.col("notes")).alias("notes"))


def log_import_records(sanitized: DataFrame, table_name: str = "stg_ar_imports",
                       columns: tuple[str, ...] = AR_COLUMNS) -> DataFrame:
    """One detail row per staged row, with the record as JSON (nulls kept) and SUCCESS/FAILED."""
    ok = F.col("validation_status") == "VALID"
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return sanitized.select(
        "session_id", F.col("id").alias("row_number"), F.lit(table_name).alias("table_name"),
        record.alias("record_data"), F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
        F.col("validation_errors").alias("error_message"),
        F.when(ok, F.col("id")).alias("created_record_id"),
        F.col("invoice_date").try_cast("timestamp").alias("created_at"))


def complete_sessions(details: DataFrame, client_id: int = 1, import_type: str = "ar",
                      imported_by: str = "importer") -> DataFrame:
    """Session headers with counters derived from the detail rows and a final status."""
    total = F.count(F.lit(1))
    ok = F.count_if(F.col("status") == "SUCCESS")
    bad = F.count_if(F.col("status") == "FAILED")
    s = details.groupBy("session_id").agg(
        total.alias("total_records"), ok.alias("successful_records"), bad.alias("failed_records"),
        F.min("created_at").alias("started_at"), F.max("created_at").alias("completed_at"))
    status = (F.when(F.col("failed_records") == 0, "SUCCESS")
               .when(F.col("successful_records") == 0, "FAILED").otherwise("PARTIAL_SUCCESS"))
    return s.select(
        "session_id", F.lit(client_id).alias("client_id"), F.lit(import_type).alias("import_type"),
        F.lit(imported_by).alias("imported_by"), "started_at", "completed_at", status.alias("status"),
        "total_records", "successful_records", "failed_records",
        F.when(F.col("failed_records") > 0,
               F.concat(F.col("failed_records").cast("string"), F.lit(" records failed"))).alias("error_summary"))


def import_history(sessions: DataFrame, client_id: int, limit: int = 50) -> DataFrame:
    """A client's sessions with success rate % (2 dp; 0 when empty), newest first (top-k)."""
    rate = F.when(F.col("total_records") > 0,
                  F.round(F.col("successful_records").cast("decimal(20,0)") * 100 / F.col("total_records"), 2)
                  ).otherwise(F.lit(0)).cast("decimal(10,2)")
    return (sessions.where(F.col("client_id") == client_id)
            .select("session_id", "import_type", "imported_by", "started_at", "completed_at", "status",
                    "total_records", "successful_records", "failed_records", rate.alias("success_rate"))
            .orderBy(F.col("started_at").desc_nulls_last(), F.col("session_id").desc()).limit(limit))


def failed_imports(details: DataFrame, sessions: DataFrame, client_id: int, limit: int = 50) -> DataFrame:
    """A client's FAILED detail rows, newest first (top-k)."""
    s = sessions.where(F.col("client_id") == client_id).select("session_id", "import_type")
    return (details.where(F.col("status") == "FAILED").join(s, "session_id")
            .select("session_id", "import_type", "row_number", "table_name", "error_message",
                    F.col("created_at").alias("failed_at"))
            .orderBy(F.col("failed_at").desc_nulls_last(), F.col("row_number").desc()).limit(limit))


def record_lineage(records: DataFrame, table_name: str, source_type: str, source_file: str) -> DataFrame:
    """Lineage rows linking each produced record to its session and source row."""
    return records.select(
        F.lit(table_name).alias("table_name"), F.col("record_id"), F.col("client_id"),
        F.lit(source_type).alias("source_type"), F.lit(source_file).alias("source_file"),
        "session_id", F.col("source_row_number"))


def get_record_lineage(lineage: DataFrame, table_name: str, record_id) -> DataFrame:
    return lineage.where((F.col("table_name") == table_name) & (F.col("record_id") == record_id))


def route_session(sessions: DataFrame, registry: dict[str, str] = STAGING_TABLES) -> DataFrame:
    """Which staging table holds each session; unknown import type → error text."""
    m = F.create_map(*[x for k, v in registry.items() for x in (F.lit(k), F.lit(v))])
    table = m[F.lower(F.col("import_type"))]
    return sessions.select("session_id", "import_type", table.alias("staging_table"),
                           F.when(table.isNull(), F.concat(F.lit("Unknown import type: "), F.col("import_type")))
                           .alias("error"))
