"""Monitoring queries: ``events`` are calls (type = component, value = latency)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir.catalog.registry import query, table
from corpusweir.operators import memo, metrics, ordering


def calls(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("component"), "value",
        (F.col("value") > 60).alias("failed"))


def r6(name, out=None):
    return F.round(F.col(name), 6).alias(out or name)


def past_tie(name):
    """Six digits; the means of two-digit values often lie exactly between two of them."""
    return F.round(F.col(name) + 1e-9, 6).alias(name)


_P = """WITH o AS (SELECT event_type AS component, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


@query("latency_stats", _P + """
 SELECT component, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg,
  max(value) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95,
  max(value) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM o GROUP BY component""")
def latency_stats(spark, sf):
    return metrics.latency_summary(calls(spark, sf), ["component"], "value").withColumn("avg", F.round("avg", 6))


@query("latency_benchmark", _P + """
 SELECT component, round(avg(value), 6) AS avg_latency, round(avg((value <= 60)::INT), 6) AS success_rate, count(*) AS runs,
  max(value) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95_latency,
  round(greatest(0, least(1, 40.0 / avg(value))) * 0.6 + avg((value <= 60)::INT) * 0.4, 6) AS score
 FROM o GROUP BY component""")
def latency_benchmark(spark, sf):
    out = metrics.benchmark_summary(calls(spark, sf), ["component"], "value", F.col("failed"))
    scored = out.withColumn("score", F.round(metrics.performance_score(F.col("avg_latency"), F.col("success_rate"), 40.0), 6))
    return scored.select("component", r6("avg_latency"), r6("success_rate"), "runs", "p95_latency", "score")


@query("error_summary", """WITH e AS (SELECT event_type AS component, CASE WHEN value > 120 THEN 'timeout' ELSE 'slow' END
   AS error_type, CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'error' ELSE 'warning' END AS severity
  FROM events WHERE value > 60)
 SELECT CASE WHEN GROUPING(component) = 0 THEN 'component' WHEN GROUPING(error_type) = 0 THEN 'error_type'
  WHEN GROUPING(severity) = 0 THEN 'severity' ELSE 'total' END AS dimension,
  coalesce(component, error_type, severity, '') AS value, count(*) AS n
 FROM e GROUP BY GROUPING SETS ((component), (error_type), (severity), ())""")
def error_summary(spark, sf):
    errors = calls(spark, sf).filter("failed").withColumns({
        "error_type": F.when(F.col("value") > 120, "timeout").otherwise("slow"),
        "severity": F.when(F.col("value") > 200, "critical").when(F.col("value") > 100, "error").otherwise("warning")})
    return metrics.error_summary(errors)


_ST = """WITH s AS (SELECT user_id, avg((value > 60)::INT) AS fr FROM events GROUP BY user_id),
 t AS (SELECT *, CASE WHEN fr >= 0.5 THEN 'unhealthy' WHEN fr >= 0.3 THEN 'degraded' ELSE 'healthy' END AS status FROM s)"""


@query("component_health", _ST + " SELECT user_id, round(fr, 6) AS failure_rate, status FROM t")
def component_health(spark, sf):
    out = metrics.health_from_rates(calls(spark, sf), "user_id", F.col("failed"), 0.3, 0.5)
    return out.select("user_id", r6("failure_rate"), "status")


@query("system_status", _ST + """
 SELECT count(*) FILTER (status = 'unhealthy') AS unhealthy, count(*) FILTER (status = 'degraded') AS degraded,
  count(*) FILTER (status = 'healthy') AS healthy, count(*) AS components, CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy'
  WHEN bool_or(status = 'degraded') THEN 'degraded' WHEN bool_or(status = 'healthy') THEN 'healthy' ELSE 'unknown' END AS overall_status FROM t""")
def system_status(spark, sf):
    return metrics.system_status(metrics.health_from_rates(calls(spark, sf), "user_id", F.col("failed"), 0.3, 0.5))


@query("field_times", """SELECT event_type AS component, count(*) AS searches, min(value) AS min_time,
 round(avg(value), 6) AS avg_time, max(value) AS max_time FROM events GROUP BY 1""")
def field_times(spark, sf):
    return metrics.field_times(calls(spark, sf), "component", "value").withColumn("avg_time", F.round("avg_time", 6))


@query("cache_hit_rates", """SELECT event_type AS component, count(*) FILTER (value <= 60) AS hits,
 count(*) FILTER (value > 60) AS misses, round(avg((value <= 60)::INT), 6) AS hit_rate FROM events GROUP BY 1""")
def cache_hit_rates(spark, sf):
    return metrics.hit_rates(calls(spark, sf), "component", ~F.col("failed")).withColumn("hit_rate", F.round("hit_rate", 6))


@query("running_mean", """SELECT event_id, event_type AS component, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running_mean FROM events""")
def running_mean(spark, sf):
    out = ordering.running_mean(calls(spark, sf), ["component"], [F.col("ts"), F.col("event_id")], "value")
    return out.select("event_id", "component", past_tie("running_mean"))


@query("ewma", """WITH o AS (SELECT event_id, event_type AS component, value, row_number() OVER (PARTITION BY event_type
   ORDER BY ts, event_id) AS i FROM events)
 SELECT a.event_id, a.component, round(sum(0.1 * pow(0.9::DOUBLE, a.i - b.i) * b.value) + 1e-9, 6) AS ewma
 FROM o a JOIN o b ON a.component = b.component AND b.i <= a.i AND b.i > a.i - 400 GROUP BY a.event_id, a.component""")
def ewma(spark, sf):
    # 0.9^400 is below 1e-18, so the statement's frame is exact to the digits shown.
    out = ordering.ewma(calls(spark, sf), ["component"], ["ts", "event_id"], "value")
    return out.select("event_id", "component", past_tie("ewma"))


@query("last_rows", """SELECT event_id, event_type AS component, value, row_number() OVER (PARTITION BY event_type
 ORDER BY ts DESC, event_id DESC) AS age_rank FROM events QUALIFY age_rank <= 100""")
def last_rows(spark, sf):
    out = metrics.last_rows(calls(spark, sf), ["component"], [F.desc("ts"), F.desc("event_id")], 100)
    return out.select("event_id", "component", "value", "age_rank")


@query("last_hours", """SELECT event_id, event_type AS component, value FROM events
 WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""")
def last_hours(spark, sf):
    c = calls(spark, sf)
    return metrics.since(c, "ts", c.agg(F.max("ts")).scalar(), 6 * 3600).select("event_id", "component", "value")


@query("rolling_hour", """SELECT event_id, count(*) OVER w AS rolling_count, round(avg(value) OVER w, 6) AS rolling_avg,
 max(value) OVER w AS rolling_max FROM events
 WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def rolling_hour(spark, sf):
    out = metrics.rolling(calls(spark, sf), ["component"], "ts", "value", 3600)
    return out.select("event_id", "rolling_count", r6("rolling_avg"), "rolling_max")


@query("dashboard", _P + """, l AS (SELECT component, count(*) AS n, avg(value) AS a,
   max(value) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95 FROM o GROUP BY component)""" + _ST.replace("WITH s", ", s") + """
 SELECT 'health' AS section, status AS name, 'components' AS metric, count(*)::DOUBLE AS value FROM t GROUP BY status
 UNION ALL SELECT 'errors', 'component:' || event_type, 'count', count(*) FROM events WHERE value > 60 GROUP BY event_type
 UNION ALL SELECT 'errors', 'total:', 'count', count(*) FROM events WHERE value > 60
 UNION ALL SELECT 'latency', component, unnest(['count', 'avg', 'p95']), unnest([n, round(a, 6), p95]) FROM l""")
def dashboard(spark, sf):
    c = calls(spark, sf)
    health = metrics.health_from_rates(c, "user_id", F.col("failed"), 0.3, 0.5).groupBy("status").agg(F.count("*").alias("n"))
    out = metrics.dashboard(metrics.latency_summary(c, ["component"], "value"),
                            metrics.error_summary(c.filter("failed"), ["component"]), health)
    return out.withColumn("value", F.round("value", 6))


@query("circuit_breaker", """WITH RECURSIVE o AS (SELECT event_id, event_type AS component, epoch(ts) AS tm, value > 60 AS failed,
   row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
 r AS (SELECT event_id, component, i, CASE WHEN failed AND 2 <= 1 THEN 'open' ELSE 'closed' END AS state,
   failed::BIGINT AS c, CASE WHEN failed THEN tm ELSE 0 END AS last, true AS admitted FROM o WHERE i = 1
  UNION ALL
  SELECT o.event_id, o.component, o.i,
   CASE WHEN r.state = 'open' AND o.tm - r.last < 3600 THEN 'open' WHEN NOT o.failed THEN 'closed'
     WHEN r.c + 1 >= 2 THEN 'open' WHEN r.state = 'open' THEN 'half_open' ELSE r.state END,
   CASE WHEN r.state = 'open' AND o.tm - r.last < 3600 THEN r.c WHEN NOT o.failed THEN 0 ELSE r.c + 1 END,
   CASE WHEN (r.state = 'open' AND o.tm - r.last < 3600) OR NOT o.failed THEN r.last ELSE o.tm END,
   NOT (r.state = 'open' AND o.tm - r.last < 3600)
  FROM r JOIN o ON o.component = r.component AND o.i = r.i + 1)
 SELECT event_id, component, state, c AS failure_count, admitted FROM r""")
def circuit_breaker(spark, sf):
    out = metrics.replay_breaker(calls(spark, sf), ["component"], "ts", "event_id", "failed", 2, 3600.0)
    return out.select("event_id", "component", "state", "failure_count", "admitted")


@query("progress_replay", """WITH g AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS term,
   coalesce(date_diff('microsecond', lag(ts) OVER w, ts) / 1000000, 0)::DOUBLE AS s FROM events
   WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g),
 st AS (SELECT user_id, min(i) FILTER (s >= 36000) AS late, min(i) FILTER (term) AS fin FROM n GROUP BY user_id),
 v AS (SELECT n.*, late, fin FROM n JOIN st USING (user_id) WHERE (fin IS NULL OR i <= fin) AND (late IS NULL OR i <= late))
 SELECT user_id, count(*) FILTER (late IS NULL OR i < late) AS relayed,
  sum(floor(least(s, 36000) / 3600))::BIGINT AS heartbeats, CASE WHEN bool_or(late IS NOT NULL AND i >= late) THEN 'timeout'
  WHEN bool_or(term) THEN 'finished' ELSE 'open' END AS ended FROM v GROUP BY user_id""")
def progress_replay(spark, sf):
    return metrics.progress_replay(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"),
                                   "user_id", "ts", "event_id", F.col("event_type") == "purchase", 3600, 36000)


@query("expired_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created FROM events GROUP BY user_id
 HAVING epoch_us((SELECT quantile_disc(ts, 0.01) FROM events)) - epoch_us(min(ts)) > 3600000000""")
def expired_sessions(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    n = ev.count()
    # The clock stands where one percent of the events have happened.
    at = ordering.positions(ev.withColumn("all", F.lit(1)), ["all"], [F.col("us"), F.col("user_id")], "pos").filter(
        F.col("pos") == -(-n // 100)).agg(F.max("ts")).scalar()
    created = ev.groupBy("user_id").agg(F.min("ts").alias("created"))
    out = metrics.expired(created, "created", at)
    return out.select("user_id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("memo_lookup", """WITH m AS (SELECT user_id, max_by(value, event_id) AS result, max(ts) AS stored FROM events
   WHERE event_type = 'view' GROUP BY user_id)
 SELECT e.event_id, m.result, m.result IS NOT NULL AS hit FROM events e LEFT JOIN
  (SELECT * FROM m WHERE epoch((SELECT max(ts) FROM events)) - epoch(stored) <= 86400) m USING (user_id)""")
def memo_lookup(spark, sf):
    ev = table(spark, sf, "events").withColumn("cache_key", F.col("user_id"))
    stored = ev.filter("event_type = 'view'").groupBy("cache_key").agg(
        F.max_by("value", "event_id").alias("result"), F.max("ts").alias("stored_at"))
    out = memo.lookup(ev.select("event_id", "cache_key"), stored, ev.agg(F.max("ts")).scalar(), 86400)
    return out.select("event_id", "result", "hit")


@query("memo_store", """SELECT user_id AS cache_key, max_by(value, event_id) AS result, max(event_id) AS stored_at
 FROM events GROUP BY user_id ORDER BY stored_at DESC, cache_key LIMIT 100""")
def memo_store(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("cache_key"), F.col("value").alias("result"), F.col("event_id").alias("stored_at"))
    old, new = rows.filter("result <= 60"), rows.filter("result > 60")
    return memo.store(old, new, 100)
