"""Registered queries for operations-log analytics (O1–O20).

The operational logs are derived from the event stream so their size follows
the data: a nightly backup per event day (size = the day's value, FULL on
Sundays with a restore test, FAILED when errors exceed a fifth of the day's
events), an hourly replication check (lag from that hour's error events),
failovers for error events above 95, a daily index check per event type, and
security events for failed logins and value anomalies.  Recovery targets,
the HA/DR configuration and the retention policy are fixed settings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import opslog
from ..streaming import trend as stream_trend
from .registry import query

AS_OF = "2024-01-31 00:00:00"

# Recovery targets (database, RTO minutes, RPO minutes).
RPO_RTO_TARGETS = [("accounting_db", 60, 15), ("reporting_db", 120, 240)]
# HA/DR configuration and retention policy.
HA_DR_CONFIG = [("primary", "standby", True, True)]
RETENTION_POLICY = [("accounting_db", 30, 7, 4, 12)]

TS = "timestamp_ntz"


def backups(b):
    e = b.raw("events")
    g = e.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"),
        F.sum("value").alias("v"))
    bd = F.col("day").cast(TS) + F.make_dt_interval(F.lit(0), F.lit(2))
    sunday = F.dayofweek("day") == 1
    status = F.when(F.col("e") * 5 > F.col("n"), "FAILED").otherwise("SUCCESS")
    return g.select(
        F.date_format("day", "yyyyMMdd").cast("int").alias("backup_id"),
        F.when(F.col("day").isNotNull(), F.lit("accounting_db")).alias("database_name"),
        bd.alias("backup_date"), F.when(sunday, "FULL").otherwise("INCREMENTAL").alias("backup_type"),
        F.lit("pg_dump").alias("backup_method"), status.alias("status"),
        F.col("v").cast("decimal(18,2)").alias("backup_size_mb"), F.col("n").alias("backup_duration_seconds"),
        F.when(sunday, bd + F.make_dt_interval(F.lit(0), F.lit(1))).alias("restored_at"),
        F.when(sunday, F.when(status == "SUCCESS", "PASSED").otherwise("FAILED")).alias("restore_test_status"))


_BACKUP_SQL = """bk AS (SELECT CAST(strftime(day, '%Y%m%d') AS INT) AS backup_id, 'accounting_db' AS database_name,
       CAST(day AS TIMESTAMP) + INTERVAL 2 HOUR AS backup_date,
       CASE WHEN dayofweek(day) = 0 THEN 'FULL' ELSE 'INCREMENTAL' END AS backup_type, 'pg_dump' AS backup_method,
       CASE WHEN e * 5 > n THEN 'FAILED' ELSE 'SUCCESS' END AS status, CAST(v AS DECIMAL(18,2)) AS backup_size_mb,
       n AS backup_duration_seconds,
       CASE WHEN dayofweek(day) = 0 THEN CAST(day AS TIMESTAMP) + INTERVAL 3 HOUR END AS restored_at,
       CASE WHEN dayofweek(day) = 0 THEN CASE WHEN e * 5 > n THEN 'FAILED' ELSE 'PASSED' END END AS restore_test_status
  FROM (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, count_if(event_type = 'error') AS e, SUM(value) AS v
        FROM events GROUP BY 1) g)"""


def replication(b):
    e = b.raw("events")
    g = e.groupBy(F.date_trunc("hour", "ts").cast(TS).alias("check_time")).agg(
        F.sum(F.when(F.col("event_type") == "error", F.round(F.col("value") * 1000).cast("long")).otherwise(0)).cast("long")
        .alias("replication_lag_bytes"),
        (F.count_if(F.col("event_type") == "error") * F.lit(7.5).cast("decimal(4,1)")).cast("decimal(18,2)")
        .alias("replication_lag_seconds"))
    return opslog.classify_lag(g)


_REPL_SQL = """rp0 AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS check_time,
        CAST(SUM(CASE WHEN event_type = 'error' THEN CAST(ROUND(value * 1000) AS BIGINT) ELSE 0 END) AS BIGINT) AS replication_lag_bytes,
        CAST(count_if(event_type = 'error') * 7.5 AS DECIMAL(18,2)) AS replication_lag_seconds FROM events GROUP BY 1),
rp AS (SELECT check_time, replication_lag_bytes, replication_lag_seconds,
        CASE WHEN replication_lag_seconds > 60 THEN 'CATCHING_UP' WHEN replication_lag_bytes = 0 THEN 'STREAMING' ELSE 'UNKNOWN' END
          AS replication_status,
        replication_lag_seconds < 60 AND replication_lag_bytes < 1000000 AS is_replication_healthy FROM rp0)"""


def failovers(b):
    e = b.raw("events").where((F.col("event_type") == "error") & (F.col("value") > 95))
    return e.select("event_id", F.col("ts").alias("event_time"), F.lit("primary").alias("from_server"),
                    F.lit("standby").alias("to_server"),
                    F.concat(F.lit("error event "), F.col("event_id").cast("string")).alias("reason"),
                    F.col("value").cast("int").alias("duration_seconds"), F.lit("COMPLETED").alias("status"),
                    F.lit("FAILOVER").alias("event_type"))


_FAIL_SQL = """fo AS (SELECT event_id, ts AS event_time, 'primary' AS from_server, 'standby' AS to_server,
        'error event ' || CAST(event_id AS VARCHAR) AS reason, CAST(FLOOR(value) AS INT) AS duration_seconds, 'COMPLETED' AS status,
        'FAILOVER' AS event_type FROM events WHERE event_type = 'error' AND value > 95)"""


def index_log(b):
    e = b.raw("events")
    g = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"))
    return g.select(F.col("event_type").alias("table_name"),
                    F.concat(F.lit("idx_"), F.col("event_type"), F.lit("_ts")).alias("index_name"),
                    (F.col("n") * F.lit(0.05).cast("decimal(4,2)")).cast("decimal(18,2)").alias("index_size_mb"),
                    F.col("n").alias("scan_count"), F.lit("0.10").cast("decimal(5,2)").alias("bloat_ratio"),
                    F.lit(False).alias("is_unused"), F.lit("KEEP").alias("recommendation"),
                    F.col("day").cast(TS).alias("checked_at"))


_INDEX_SQL = """ix AS (SELECT event_type AS table_name, 'idx_' || event_type || '_ts' AS index_name,
        CAST(COUNT(*) * 0.05 AS DECIMAL(18,2)) AS index_size_mb, COUNT(*) AS scan_count, CAST(0.10 AS DECIMAL(5,2)) AS bloat_ratio,
        FALSE AS is_unused, 'KEEP' AS recommendation, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS checked_at
        FROM events GROUP BY event_type, CAST(ts AS DATE))"""


def security_events(b):
    failed = opslog.log_access(b.access_log)["security_events"]
    anomalies = b.raw("events").where(F.col("value") > 99).select(
        (F.col("event_id") + 1000000000).alias("security_event_id"), F.lit("ANOMALY").alias("event_type"),
        F.lit("WARNING").alias("severity"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        F.concat(F.lit("Unusual value "), F.col("value").cast("string")).alias("description"), F.col("ts").alias("event_time"))
    return failed.unionByName(anomalies)


_SEC_SQL = """sec AS (SELECT access_id AS security_event_id, 'FAILED_LOGIN' AS event_type, 'CRITICAL' AS severity, user_name,
        'Failed login for ' || user_name AS description, login_time AS event_time FROM access_log WHERE status = 'FAILED'
        UNION ALL
        SELECT event_id + 1000000000, 'ANOMALY', 'WARNING', 'user' || CAST(user_id AS VARCHAR),
        'Unusual value ' || CAST(value AS VARCHAR), ts FROM events WHERE value > 99)"""


def baselines(b):
    m = b.metrics.where(F.col("metric_timestamp") < F.lit("2024-01-08").cast(TS))
    g = m.groupBy("metric_name").agg(
        (F.floor((F.sum((F.col("metric_value") * 100).cast("long")) * 2 + F.count(F.lit(1))) / (F.count(F.lit(1)) * 2))
         .cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias("baseline_value"))
    return g.select("metric_name", "baseline_value",
                    (F.col("baseline_value") * F.lit(1.5).cast("decimal(3,1)")).cast("decimal(18,2)").alias("warning_threshold"),
                    (F.col("baseline_value") * 2).cast("decimal(18,2)").alias("alert_threshold"),
                    F.lit(False).alias("lower_is_worse"))


_BASE_SQL = """bl AS (SELECT metric_name, baseline_value, CAST(baseline_value * 1.5 AS DECIMAL(18,2)) AS warning_threshold,
        CAST(baseline_value * 2 AS DECIMAL(18,2)) AS alert_threshold, FALSE AS lower_is_worse
  FROM (SELECT metric_name, CAST(CAST(FLOOR((SUM(CAST(metric_value * 100 AS BIGINT)) * 2 + COUNT(*)) / (COUNT(*) * 2)) AS DECIMAL(20,0)) / 100
               AS DECIMAL(18,2)) AS baseline_value
        FROM metrics WHERE metric_timestamp < TIMESTAMP '2024-01-08' GROUP BY metric_name) x)"""


def _targets(b):
    return b.spark.createDataFrame(RPO_RTO_TARGETS, "database_name string, rto_minutes int, rpo_minutes int")


_TARGETS_SQL = """tg AS (SELECT * FROM (VALUES ('accounting_db', 60, 15), ('reporting_db', 120, 240)) t(database_name, rto_minutes, rpo_minutes))"""


@query("health_rollup", "O1", views=["metrics"], oracle=f"""
SELECT 'System Health Dashboard' AS metric_category, count_if(status = 'HEALTHY') AS healthy_checks,
       count_if(status = 'WARNING') AS warning_checks, count_if(status = 'ALERT') AS alert_checks
FROM metrics WHERE metric_timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND metric_timestamp <= TIMESTAMP '{AS_OF}'""")
def _health_rollup(b):
    return opslog.health_rollup(b.metrics, AS_OF, hours=24)


@query("recent_backups", "O2", views=[], money=["size_gb"], oracle=f"""WITH {_BACKUP_SQL}
SELECT backup_id, backup_date, backup_type, status,
       CAST(CAST(FLOOR((CAST(backup_size_mb * 100 AS BIGINT) * 2 + 1024) / 2048) AS DECIMAL(20,0)) / 100 AS DECIMAL(18,2)) AS size_gb,
       backup_duration_seconds, CASE WHEN restored_at IS NOT NULL THEN 'VERIFIED' ELSE 'PENDING TEST' END AS verification_status
FROM bk ORDER BY backup_date DESC, backup_id DESC LIMIT 10""")
def _recent_backups(b):
    return opslog.recent_backups(backups(b), 10)


def _readiness_sql(latest: bool) -> str:
    if latest:
        st, me, te = "arg_max_null(b.status, b.backup_date)", "arg_max_null(b.backup_method, b.backup_date)", \
            "arg_max_null(b.restore_test_status, b.backup_date)"
    else:
        st, me, te = "MAX(b.status)", "MAX(b.backup_method)", "MAX(b.restore_test_status)"
    return f"""WITH {_BACKUP_SQL}, {_TARGETS_SQL},
g AS (SELECT t.database_name, t.rto_minutes, t.rpo_minutes, MAX(b.backup_date) AS last_backup_date, {st} AS backup_status,
             {me} AS backup_method, MAX(b.restored_at) AS last_test_date, {te} AS test_status
      FROM tg t LEFT JOIN bk b ON t.database_name = b.database_name GROUP BY t.database_name, t.rto_minutes, t.rpo_minutes)
SELECT database_name, last_backup_date,
       CAST((epoch(TIMESTAMP '{AS_OF}') - epoch(last_backup_date)) / 60 AS INT) AS backup_age_minutes, backup_status, backup_method,
       rto_minutes, rpo_minutes, CAST((epoch(TIMESTAMP '{AS_OF}') - epoch(last_backup_date)) / 60 AS INT) <= rpo_minutes AS rpo_compliant,
       last_test_date, test_status,
       COALESCE(backup_status = 'SUCCESS' AND test_status = 'PASSED' AND last_test_date > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, FALSE)
         AS recovery_ready FROM g"""


@query("recovery_readiness", "O3", views=[], oracle=_readiness_sql(False))
def _recovery_readiness(b):
    return opslog.recovery_readiness(_targets(b), backups(b), AS_OF)


@query("recovery_readiness_latest", "O3", views=[], oracle=_readiness_sql(True))
def _recovery_readiness_latest(b):
    return opslog.recovery_readiness(_targets(b), backups(b), AS_OF, latest=True)


@query("performance_health", "O4", views=["metrics"],
       money=["metric_value", "baseline_value", "warning_threshold", "alert_threshold"], oracle=f"""WITH {_BASE_SQL}
SELECT m.metric_id, m.metric_name, m.metric_value, bl.baseline_value, bl.warning_threshold, bl.alert_threshold, m.status,
       m.metric_timestamp
FROM metrics m LEFT JOIN bl ON m.metric_name = bl.metric_name
WHERE m.metric_timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND m.metric_timestamp <= TIMESTAMP '{AS_OF}'""")
def _performance_health(b):
    return opslog.performance_health(b.metrics, baselines(b), AS_OF, hours=24)


@query("metric_trend", "O5", views=["metrics"], money=["avg_value"], oracle=f"""
SELECT CAST(date_trunc('hour', metric_timestamp) AS TIMESTAMP) AS time_bucket,
       CAST(CAST(FLOOR((SUM(CAST(metric_value * 100 AS BIGINT)) * 2 + COUNT(*)) / (COUNT(*) * 2)) AS DECIMAL(20,0)) / 100
            AS DECIMAL(18,2)) AS avg_value
FROM metrics WHERE metric_name = 'purchase' AND metric_timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
  AND metric_timestamp <= TIMESTAMP '{AS_OF}' GROUP BY 1 ORDER BY 1 DESC""")
def _metric_trend(b):
    return opslog.metric_trend(b.metrics, "purchase", AS_OF, 30)


_HOURLY_SQL = """SELECT CAST(date_trunc('hour', metric_timestamp) AS TIMESTAMP) AS time_bucket, metric_name,
       CAST(SUM(CAST(metric_value * 100 AS BIGINT)) AS BIGINT) AS cents, COUNT(*) AS n"""


def _arrivals(b):
    """Three arrivals in order of time; every ninth row of the first two thirds comes with the last, days late."""
    m, i = b.metrics, F.col("metric_id")
    day = F.dayofmonth("metric_timestamp")
    third = F.when((i % 9 == 0) | (day > 20), 2).when(day > 10, 1).otherwise(0)
    return [m.where(third == k) for k in range(3)]


@query("metric_trend_stream", "O5", views=["metrics"], oracle=_HOURLY_SQL + " FROM metrics GROUP BY 1, 2")
def _metric_trend_stream(b):
    return stream_trend.run_available_now(b.spark, _arrivals(b)).drop("late")


@query("metric_trend_late", "O5", views=["metrics"], oracle="""
WITH a AS (SELECT *, CASE WHEN metric_id % 9 = 0 OR day(metric_timestamp) > 20 THEN 2 WHEN day(metric_timestamp) > 10 THEN 1 ELSE 0 END AS k,
                  date_trunc('hour', metric_timestamp) + INTERVAL 1 HOUR AS closes FROM metrics),
seen AS (SELECT k, MAX(MAX(metric_timestamp)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a GROUP BY k)
SELECT metric_name, COUNT(*) AS n, count_if(COALESCE(closes <= top - INTERVAL 60 MINUTE, FALSE)) AS late FROM a JOIN seen ON a.k = seen.k GROUP BY metric_name""")
def _metric_trend_late(b):
    t = stream_trend.run_available_now(b.spark, _arrivals(b))
    return t.groupBy("metric_name").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


@query("security_violations", "O6", views=["access_log"], oracle=f"""WITH {_SEC_SQL}
SELECT * FROM sec WHERE severity IN ('WARNING', 'CRITICAL') AND event_time > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
  AND event_time <= TIMESTAMP '{AS_OF}' ORDER BY event_time DESC, security_event_id DESC""")
def _security_violations(b):
    return opslog.security_violations(security_events(b), 24, AS_OF)


@query("failed_logins", "O7", views=["access_log"], oracle=f"""
SELECT user_name, COUNT(*) AS failed_count, MAX(login_time) AS last_attempt FROM access_log
WHERE status = 'FAILED' AND login_time > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND login_time <= TIMESTAMP '{AS_OF}'
GROUP BY user_name""")
def _failed_logins(b):
    return opslog.failed_logins(b.access_log, AS_OF)


@query("access_history", "O8", views=["access_log"], oracle=f"""
SELECT * FROM access_log WHERE user_name = 'user7' AND login_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
  AND login_time <= TIMESTAMP '{AS_OF}' ORDER BY login_time DESC, access_id DESC""")
def _access_history(b):
    return opslog.access_history(b.access_log, "user7", 30, AS_OF)


@query("log_access", "O9", views=["access_log"], oracle="""
SELECT access_id AS security_event_id, 'FAILED_LOGIN' AS event_type, 'CRITICAL' AS severity, user_name,
       'Failed login for ' || user_name AS description, login_time AS event_time FROM access_log WHERE status = 'FAILED'""")
def _log_access(b):
    return opslog.log_access(b.access_log)["security_events"]


@query("replication_lag", "O10", views=[], money=["lag_seconds"], oracle=f"""WITH {_REPL_SQL}
SELECT check_time, replication_lag_bytes, CAST(ROUND(replication_lag_seconds, 2) AS DECIMAL(18,2)) AS lag_seconds, replication_status
FROM rp ORDER BY check_time DESC LIMIT 20""")
def _replication_lag(b):
    return opslog.replication_lag(replication(b), 20)


@query("failover_events", "O11", views=[], oracle=f"""WITH {_FAIL_SQL}
SELECT event_id, event_time, from_server, to_server, reason, duration_seconds, status FROM fo
ORDER BY event_time DESC, event_id DESC LIMIT 10""")
def _failover_events(b):
    return opslog.failover_events(failovers(b), 10)


@query("ha_dr_status", "O12", views=[], money=["replication_lag_seconds"], oracle=f"""WITH {_REPL_SQL}, {_FAIL_SQL}
SELECT 'primary' AS primary_server, 'standby' AS standby_server, TRUE AS ha_enabled, TRUE AS dr_enabled,
       (SELECT CAST(COALESCE(arg_max(replication_lag_seconds, check_time), 0) AS DECIMAL(18,2)) FROM rp) AS replication_lag_seconds,
       (SELECT MAX(event_time) FROM fo WHERE event_type = 'FAILOVER') AS last_failover,
       CAST(FLOOR((epoch(TIMESTAMP '{AS_OF}') - epoch((SELECT MAX(event_time) FROM fo WHERE event_type = 'FAILOVER'))) / 86400) AS INT)
         AS days_since_last_failover,
       (SELECT CAST(COALESCE(arg_max(replication_lag_seconds, check_time), 0) AS DECIMAL(18,2)) FROM rp) < 30 AS recovery_objective_met""")
def _ha_dr_status(b):
    cfg = b.spark.createDataFrame(HA_DR_CONFIG, "primary_server string, standby_server string, ha_enabled boolean, dr_enabled boolean")
    return opslog.ha_dr_status(cfg, replication(b), failovers(b), AS_OF)


@query("index_efficiency", "O13", views=[], money=["size_mb", "bloat_ratio"], oracle=f"""WITH {_INDEX_SQL}
SELECT table_name, index_name, CAST(ROUND(index_size_mb, 2) AS DECIMAL(18,2)) AS size_mb, scan_count, bloat_ratio, is_unused,
       recommendation, checked_at FROM ix
WHERE checked_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND checked_at <= TIMESTAMP '{AS_OF}'
ORDER BY size_mb DESC, index_name, checked_at""")
def _index_efficiency(b):
    return opslog.index_efficiency(index_log(b), AS_OF)


@query("active_alerts", "O14", views=["metrics"], oracle=f"""
SELECT metric_name, COUNT(*) AS alert_count, MAX(metric_timestamp) AS latest_alert FROM metrics
WHERE status <> 'HEALTHY' AND metric_timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND metric_timestamp <= TIMESTAMP '{AS_OF}'
GROUP BY metric_name""")
def _active_alerts(b):
    return opslog.active_alerts(b.metrics, AS_OF)


@query("degradation", "O15", views=["metrics"], money=["baseline_value", "metric_value"], oracle=f"""WITH {_BASE_SQL}
SELECT m.metric_id, m.metric_name, bl.baseline_value, m.metric_value,
       CAST(ABS(m.metric_value - bl.baseline_value) AS DOUBLE) * 100 / CAST(bl.baseline_value AS DOUBLE) AS deviation_percent,
       CASE WHEN ABS(m.metric_value - bl.baseline_value) > bl.baseline_value * 0.20 THEN 'INVESTIGATE' ELSE 'NORMAL' END AS action
FROM metrics m LEFT JOIN bl ON m.metric_name = bl.metric_name
WHERE m.metric_timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND m.metric_timestamp <= TIMESTAMP '{AS_OF}'
  AND bl.baseline_value IS NOT NULL ORDER BY deviation_percent DESC, m.metric_id""")
def _degradation(b):
    return opslog.degradation(b.metrics, baselines(b), AS_OF, hours=24)


@query("access_summary", "O16", views=["access_log"], oracle=f"""
SELECT CAST(login_time AS DATE) AS access_date, user_name, COUNT(*) AS login_count, count_if(status = 'FAILED') AS failed_count
FROM access_log WHERE login_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND login_time <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2""")
def _access_summary(b):
    return opslog.access_summary(b.access_log, AS_OF)


@query("security_event_summary", "O17", views=["access_log"], oracle=f"""WITH {_SEC_SQL}
SELECT event_type, severity, COUNT(*) AS event_count, MAX(event_time) AS latest_event FROM sec
WHERE event_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND event_time <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2""")
def _security_event_summary(b):
    return opslog.security_event_summary(security_events(b), AS_OF)


@query("classify_metrics", "O18", views=["metrics"], money=["metric_value"], oracle=f"""WITH {_BASE_SQL}
SELECT m.metric_id, m.metric_name, m.metric_value, m.metric_timestamp,
       CASE WHEN bl.alert_threshold IS NULL THEN 'UNKNOWN'
            WHEN COALESCE(bl.lower_is_worse, FALSE) AND m.metric_value < bl.alert_threshold THEN 'ALERT'
            WHEN COALESCE(bl.lower_is_worse, FALSE) AND m.metric_value < bl.warning_threshold THEN 'WARNING'
            WHEN COALESCE(bl.lower_is_worse, FALSE) THEN 'HEALTHY'
            WHEN m.metric_value > bl.alert_threshold THEN 'ALERT' WHEN m.metric_value > bl.warning_threshold THEN 'WARNING'
            ELSE 'HEALTHY' END AS classified_status
FROM metrics m LEFT JOIN bl ON m.metric_name = bl.metric_name""")
def _classify_metrics(b):
    return opslog.classify_metrics(b.metrics, baselines(b))


@query("classify_lag", "O19", views=[], money=["replication_lag_seconds"], oracle=f"WITH {_REPL_SQL}\nSELECT * FROM rp")
def _classify_lag(b):
    return replication(b)


@query("retention_select", "O20", views=[], oracle=f"""WITH {_BACKUP_SQL},
c AS (SELECT b.*, 7 AS keep_daily, 4 AS keep_weekly, 12 AS keep_monthly FROM bk b WHERE status = 'SUCCESS'),
f AS (SELECT c.*,
        row_number() OVER (PARTITION BY database_name, CAST(backup_date AS DATE) ORDER BY backup_date DESC, backup_id DESC) AS d1,
        row_number() OVER (PARTITION BY database_name, date_trunc('week', backup_date) ORDER BY backup_date DESC, backup_id DESC) AS w1,
        row_number() OVER (PARTITION BY database_name, date_trunc('month', backup_date) ORDER BY backup_date DESC, backup_id DESC) AS m1
      FROM c),
r AS (SELECT f.*,
        SUM(CASE WHEN d1 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY database_name ORDER BY backup_date DESC, backup_id DESC ROWS UNBOUNDED PRECEDING) AS dr,
        SUM(CASE WHEN w1 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY database_name ORDER BY backup_date DESC, backup_id DESC ROWS UNBOUNDED PRECEDING) AS wr,
        SUM(CASE WHEN m1 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY database_name ORDER BY backup_date DESC, backup_id DESC ROWS UNBOUNDED PRECEDING) AS mr
      FROM f)
SELECT backup_id, database_name, backup_date,
       CASE WHEN d1 = 1 AND dr <= keep_daily THEN 'DAILY' WHEN w1 = 1 AND wr <= keep_weekly THEN 'WEEKLY'
            WHEN m1 = 1 AND mr <= keep_monthly THEN 'MONTHLY' END AS kept_as,
       CASE WHEN (d1 = 1 AND dr <= keep_daily) OR (w1 = 1 AND wr <= keep_weekly) OR (m1 = 1 AND mr <= keep_monthly)
            THEN 'KEEP' ELSE 'EXPIRE' END AS decision,
       backup_date < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS past_age_limit FROM r
UNION ALL
SELECT backup_id, database_name, backup_date, NULL, 'FAILED', backup_date < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY FROM bk WHERE status <> 'SUCCESS'
UNION ALL
SELECT backup_id, 'archive_db', backup_date, NULL, CASE WHEN status = 'SUCCESS' THEN 'NO_POLICY' ELSE 'FAILED' END,
       backup_date < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY FROM bk""")
def _retention_select(b):
    # a second database without a policy row: its backups are reported, not expired
    other = backups(b).withColumn("database_name", F.lit("archive_db"))
    pol = b.spark.createDataFrame(RETENTION_POLICY, "database_name string, retention_days int, keep_daily int, "
                                                    "keep_weekly int, keep_monthly int")
    return opslog.retention_select(backups(b).unionByName(other), pol, AS_OF)
