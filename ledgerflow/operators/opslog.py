"""O — operations-log analytics: dashboards over metric, access, backup,
replication, failover and index logs.

All are filters, conditional counts, group-bys and top-k (``orderBy().limit``
plans as TakeOrderedAndProject: a per-partition top-k, then a merge of k rows
per partition — no global sort).  Time windows are explicit ``as_of``
parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TS = "timestamp_ntz"


def _t(as_of: str) -> F.Column:
    return F.lit(as_of).cast(TS)


def _since(as_of: str, hours: int = 0, days: int = 0) -> F.Column:
    return _t(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))


def health_rollup(metrics: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    m = metrics.where((F.col("metric_timestamp") > _since(as_of, hours=hours)) & (F.col("metric_timestamp") <= _t(as_of)))
    return m.agg(F.lit("System Health Dashboard").alias("metric_category"),
                 F.count_if(F.col("status") == "HEALTHY").alias("healthy_checks"),
                 F.count_if(F.col("status") == "WARNING").alias("warning_checks"),
                 F.count_if(F.col("status") == "ALERT").alias("alert_checks"))


def recent_backups(hist: DataFrame, n: int = 10) -> DataFrame:
    # size in GB rounded half-up to 2 dp with integer arithmetic (exact in every engine)
    mb_cents = (F.col("backup_size_mb") * 100).cast("long")
    gb_cents = F.floor((mb_cents * 2 + 1024) / 2048)
    return (hist.select("backup_id", "backup_date", "backup_type", "status",
                        (gb_cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("size_gb"),
                        "backup_duration_seconds",
                        F.when(F.col("restored_at").isNotNull(), "VERIFIED").otherwise("PENDING TEST").alias("verification_status"))
            .orderBy(F.col("backup_date").desc(), F.col("backup_id").desc()).limit(n))


def recovery_readiness(targets: DataFrame, hist: DataFrame, as_of: str, latest: bool = False) -> DataFrame:
    """Per database: last backup, age, RPO compliance, last restore test and readiness.

    literal (default): every column is an independent MAX over the history, as written;
    ``latest=True`` takes status / method / test status from the newest backup instead."""
    j = targets.join(hist, "database_name", "left")
    if latest:
        status = F.max_by("status", "backup_date")
        method = F.max_by("backup_method", "backup_date")
        test = F.max_by("restore_test_status", "backup_date")
    else:
        status, method, test = F.max("status"), F.max("backup_method"), F.max("restore_test_status")
    g = j.groupBy("database_name", "rto_minutes", "rpo_minutes").agg(
        F.max("backup_date").alias("last_backup_date"), status.alias("backup_status"), method.alias("backup_method"),
        F.max("restored_at").alias("last_test_date"), test.alias("test_status"))
    age = ((F.unix_timestamp(_t(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_backup_date").cast("timestamp")))
           / 60).cast("int")
    ready = ((F.col("backup_status") == "SUCCESS") & (F.col("test_status") == "PASSED")
             & (F.col("last_test_date") > _since(as_of, days=7)))
    return g.select("database_name", "last_backup_date", age.alias("backup_age_minutes"), "backup_status",
                    "backup_method", "rto_minutes", "rpo_minutes", (age <= F.col("rpo_minutes")).alias("rpo_compliant"),
                    "last_test_date", "test_status", F.coalesce(ready, F.lit(False)).alias("recovery_ready"))


def performance_health(metrics: DataFrame, baseline: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    m = metrics.where((F.col("metric_timestamp") > _since(as_of, hours=hours)) & (F.col("metric_timestamp") <= _t(as_of)))
    return (m.join(baseline, "metric_name", "left")
            .select("metric_id", "metric_name", "metric_value", "baseline_value", "warning_threshold", "alert_threshold",
                    "status", "metric_timestamp"))


def metric_trend(metrics: DataFrame, name: str, as_of: str, days: int = 30) -> DataFrame:
    m = metrics.where((F.col("metric_name") == name) & (F.col("metric_timestamp") > _since(as_of, days=days))
                      & (F.col("metric_timestamp") <= _t(as_of)))
    return (m.groupBy(F.date_trunc("hour", "metric_timestamp").cast(TS).alias("time_bucket"))
            # average rounded half-up to cents with integer arithmetic (exact in every engine)
            .agg(((F.floor((F.sum((F.col("metric_value") * 100).cast("long")) * 2 + F.count(F.lit(1)))
                           / (F.count(F.lit(1)) * 2))).cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("avg_value"))
            .orderBy(F.col("time_bucket").desc()))


def security_violations(events: DataFrame, hours: int, as_of: str) -> DataFrame:
    e = events.where(F.col("severity").isin("WARNING", "CRITICAL") & (F.col("event_time") > _since(as_of, hours=hours))
                     & (F.col("event_time") <= _t(as_of)))
    return e.orderBy(F.col("event_time").desc(), F.col("security_event_id").desc())


def failed_logins(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    l = log.where((F.col("status") == "FAILED") & (F.col("login_time") > _since(as_of, hours=hours))
                  & (F.col("login_time") <= _t(as_of)))
    return l.groupBy("user_name").agg(F.count(F.lit(1)).alias("failed_count"), F.max("login_time").alias("last_attempt"))


def access_history(log: DataFrame, user: str, days: int, as_of: str) -> DataFrame:
    l = log.where((F.col("user_name") == user) & (F.col("login_time") > _since(as_of, days=days))
                  & (F.col("login_time") <= _t(as_of)))
    return l.orderBy(F.col("login_time").desc(), F.col("access_id").desc())


def log_access(rows: DataFrame) -> dict[str, DataFrame]:
    """Access rows as logged; every FAILED login also raises a CRITICAL security event."""
    sec = rows.where(F.col("status") == "FAILED").select(
        F.col("access_id").alias("security_event_id"), F.lit("FAILED_LOGIN").alias("event_type"),
        F.lit("CRITICAL").alias("severity"), "user_name",
        F.concat(F.lit("Failed login for "), F.col("user_name")).alias("description"),
        F.col("login_time").alias("event_time"))
    return {"access": rows, "security_events": sec}


def replication_lag(log: DataFrame, n: int = 20) -> DataFrame:
    return (log.select("check_time", "replication_lag_bytes",
                       F.round("replication_lag_seconds", 2).cast("decimal(18,2)").alias("lag_seconds"), "replication_status")
            .orderBy(F.col("check_time").desc()).limit(n))


def failover_events(log: DataFrame, n: int = 10) -> DataFrame:
    return (log.select("event_id", "event_time", "from_server", "to_server", "reason", "duration_seconds", "status")
            .orderBy(F.col("event_time").desc(), F.col("event_id").desc()).limit(n))


def ha_dr_status(config: DataFrame, repl: DataFrame, failover: DataFrame, as_of: str) -> DataFrame:
    """Config rows with the latest lag, last failover, days since it and the < 30 s objective.
    The two facts are one-row aggregates, read as scalars and attached as literals."""
    lag = repl.agg(F.coalesce(F.max_by("replication_lag_seconds", "check_time"), F.lit(0)).cast("decimal(18,2)")).first()[0]
    last = failover.where(F.col("event_type") == "FAILOVER").agg(F.max("event_time")).first()[0]
    lag_c = F.lit(lag).cast("decimal(18,2)")
    last_c = F.lit(last).cast(TS)
    days = F.floor((F.unix_timestamp(_t(as_of).cast("timestamp")) - F.unix_timestamp(last_c.cast("timestamp")))
                   / 86400).cast("int")
    return config.select("primary_server", "standby_server", "ha_enabled", "dr_enabled",
                         lag_c.alias("replication_lag_seconds"), last_c.alias("last_failover"),
                         days.alias("days_since_last_failover"), (lag_c < 30).alias("recovery_objective_met"))


def index_efficiency(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    l = log.where((F.col("checked_at") > _since(as_of, days=days)) & (F.col("checked_at") <= _t(as_of)))
    return (l.select("table_name", "index_name", F.round("index_size_mb", 2).cast("decimal(18,2)").alias("size_mb"),
                     "scan_count", "bloat_ratio", "is_unused", "recommendation", "checked_at")
            .orderBy(F.col("size_mb").desc(), "index_name", "checked_at"))


def active_alerts(metrics: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    m = metrics.where((F.col("status") != "HEALTHY") & (F.col("metric_timestamp") > _since(as_of, hours=hours))
                      & (F.col("metric_timestamp") <= _t(as_of)))
    return m.groupBy("metric_name").agg(F.count(F.lit(1)).alias("alert_count"),
                                        F.max("metric_timestamp").alias("latest_alert"))


def degradation(metrics: DataFrame, baseline: DataFrame, as_of: str, hours: int = 1, limit: float = 0.2) -> DataFrame:
    m = metrics.where((F.col("metric_timestamp") > _since(as_of, hours=hours)) & (F.col("metric_timestamp") <= _t(as_of)))
    j = m.join(baseline, "metric_name", "left").where(F.col("baseline_value").isNotNull())
    diff = F.abs(F.col("metric_value") - F.col("baseline_value"))
    dev_pct = diff.cast("double") * 100 / F.col("baseline_value").cast("double")
    return j.select("metric_id", "metric_name", "baseline_value", "metric_value", dev_pct.alias("deviation_percent"),
                    F.when(diff > F.col("baseline_value") * F.lit(limit).cast("decimal(4,2)"), "INVESTIGATE")
                     .otherwise("NORMAL").alias("action")) \
            .orderBy(F.col("deviation_percent").desc(), "metric_id")


def access_summary(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    l = log.where((F.col("login_time") > _since(as_of, days=days)) & (F.col("login_time") <= _t(as_of)))
    return l.groupBy(F.to_date("login_time").alias("access_date"), "user_name").agg(
        F.count(F.lit(1)).alias("login_count"), F.count_if(F.col("status") == "FAILED").alias("failed_count"))


def security_event_summary(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    e = events.where((F.col("event_time") > _since(as_of, days=days)) & (F.col("event_time") <= _t(as_of)))
    return e.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("event_count"),
                                                   F.max("event_time").alias("latest_event"))


def classify_metrics(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """HEALTHY / WARNING / ALERT from the metric's thresholds; ``lower_is_worse`` flips the test."""
    j = metrics.join(thresholds, "metric_name", "left")
    v = F.col("metric_value")
    low = F.coalesce(F.col("lower_is_worse"), F.lit(False))
    status = (F.when(F.col("alert_threshold").isNull(), F.lit("UNKNOWN"))
               .when(low & (v < F.col("alert_threshold")), "ALERT").when(low & (v < F.col("warning_threshold")), "WARNING")
               .when(low, "HEALTHY")
               .when(v > F.col("alert_threshold"), "ALERT").when(v > F.col("warning_threshold"), "WARNING")
               .otherwise("HEALTHY"))
    return j.select("metric_id", "metric_name", "metric_value", "metric_timestamp", status.alias("classified_status"))


def classify_lag(log: DataFrame) -> DataFrame:
    s = (F.when(F.col("replication_lag_seconds") > 60, "CATCHING_UP")
          .when(F.col("replication_lag_bytes") == 0, "STREAMING").otherwise("UNKNOWN"))
    healthy = (F.col("replication_lag_seconds") < 60) & (F.col("replication_lag_bytes") < 1000000)
    return log.select("check_time", "replication_lag_bytes", "replication_lag_seconds", s.alias("replication_status"),
                      healthy.alias("is_replication_healthy"))


def retention_select(catalog: DataFrame, policy: DataFrame, as_of: str) -> DataFrame:
    """KEEP the newest N daily, weekly and monthly backups (per the policy), else EXPIRE;
    plus the simple age rule (older than retention_days).

    Every backup gets a decision: one that did not succeed holds no slot and is FAILED, one of a
    database without a policy is NO_POLICY (nothing may be expired without a rule)."""
    ruled = catalog.join(policy, "database_name", "left")
    fine = (F.col("status") == "SUCCESS") & F.col("keep_daily").isNotNull()
    others = ruled.where(~F.coalesce(fine, F.lit(False))).select(
        "backup_id", "database_name", "backup_date", F.lit(None).cast("string").alias("kept_as"),
        F.when(F.coalesce(F.col("status") == "SUCCESS", F.lit(False)), "NO_POLICY").otherwise("FAILED").alias("decision"),
        (F.col("backup_date") < _since(as_of, days=30)).alias("past_age_limit"))
    c = ruled.where(fine)
    day = F.to_date("backup_date")
    wk = F.date_trunc("week", "backup_date")
    mo = F.date_trunc("month", "backup_date")
    first_in = lambda bucket: F.row_number().over(Window.partitionBy("database_name", bucket).orderBy(F.col("backup_date").desc(),
                                                                                                      F.col("backup_id").desc()))
    c = c.withColumn("_d1", first_in(day)).withColumn("_w1", first_in(wk)).withColumn("_m1", first_in(mo))
    rank = lambda flag: F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).over(
        Window.partitionBy("database_name").orderBy(F.col("backup_date").desc(), F.col("backup_id").desc())
        .rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("_dr", rank("_d1")).withColumn("_wr", rank("_w1")).withColumn("_mr", rank("_m1"))
    keep_d = (F.col("_d1") == 1) & (F.col("_dr") <= F.col("keep_daily"))
    keep_w = (F.col("_w1") == 1) & (F.col("_wr") <= F.col("keep_weekly"))
    keep_m = (F.col("_m1") == 1) & (F.col("_mr") <= F.col("keep_monthly"))
    aged = F.col("backup_date") < _since(as_of, days=30)
    return c.select("backup_id", "database_name", "backup_date",
                    F.when(keep_d, "DAILY").when(keep_w, "WEEKLY").when(keep_m, "MONTHLY").alias("kept_as"),
                    F.when(keep_d | keep_w | keep_m, "KEEP").otherwise("EXPIRE").alias("decision"),
                    aged.alias("past_age_limit")).unionByName(others)
