"""Queries on import history and usage events."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import publish, status
from ..operators.storage import landing
from ..streaming import usage
from .registry import query
from .views import view

NOW = "TIMESTAMP '2002-01-01 00:00:00'"
OFF = ("src2", "src9")
OFF_SQL = "('src2', 'src9')"


def runs(spark, sf_dir):
    return view(spark, sf_dir, "v_runs")


def states(spark, sf_dir):
    return view(spark, sf_dir, "v_states")


def joined(spark, sf_dir):
    return status.source_status(states(spark, sf_dir), runs(spark, sf_dir))


JOINED = "(SELECT s.*, r.started_at AS served_started_at, r.completed_at AS served_completed_at, r.record_count, r.skipped_parts, r.fingerprint AS served_fingerprint FROM v_states s LEFT JOIN v_runs r ON r.run_id = s.served_run_id)"
FAILED = "(SELECT * FROM (SELECT * FROM v_runs WHERE completed_at IS NOT NULL OR failed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(completed_at, failed_at) DESC, run_id DESC) = 1) t WHERE failed_at IS NOT NULL)"


@query(f"SELECT source, served_run_id, served_started_at, record_count, skipped_parts FROM {JOINED} j")
def source_status(spark, sf_dir):
    return joined(spark, sf_dir).select("source", "served_run_id", "served_started_at", "record_count", "skipped_parts")


@query(f"SELECT source, served_run_id FROM {JOINED} j WHERE record_count > 0 AND source NOT IN {OFF_SQL}")
def serving_sources(spark, sf_dir):
    return status.serving(joined(spark, sf_dir), OFF).select("source", "served_run_id")


@query(f"SELECT source, run_id, error FROM {FAILED} f")
def latest_failed_runs(spark, sf_dir):
    return status.latest_failed(runs(spark, sf_dir)).select("source", "run_id", "error")


@query(f"SELECT coalesce(s.source, f.source) AS source, s.served_run_id, f.run_id AS failed_run_id FROM v_states s FULL JOIN {FAILED} f ON f.source = s.source")
def source_history(spark, sf_dir):
    return status.source_history(states(spark, sf_dir), status.latest_failed(runs(spark, sf_dir)))


@query(f"SELECT CAST(coalesce(sum(record_count), 0) AS BIGINT) AS total FROM {JOINED} j WHERE record_count > 0 AND source NOT IN {OFF_SQL}")
def total_from_metadata(spark, sf_dir):
    return status.total_rows(status.serving(joined(spark, sf_dir), OFF))


@query(f"SELECT min(coalesce(last_checked_at, served_completed_at)) AS as_of FROM {JOINED} j WHERE record_count > 0 AND source NOT IN {OFF_SQL}")
def currency_date(spark, sf_dir):
    return status.currency_date(status.serving(joined(spark, sf_dir), OFF))


@query(f"SELECT source, CAST(year(CAST(served_started_at AS TIMESTAMP) + INTERVAL 1 HOUR + CASE WHEN month(served_started_at) BETWEEN 4 AND 9 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) AS INTEGER) AS year FROM {JOINED} j WHERE served_started_at IS NOT NULL")
def retrieval_years(spark, sf_dir):
    return status.retrieval_years(joined(spark, sf_dir))


REPORT = f"""(SELECT source, 'latest import failed' AS problem, error AS detail FROM {FAILED} f WHERE source NOT IN {OFF_SQL}
UNION ALL SELECT source, 'skipped parts', CAST(skipped_parts AS VARCHAR) FROM {JOINED} j WHERE skipped_parts > 0 AND source NOT IN {OFF_SQL}
UNION ALL SELECT source, 'no data and probe failing', last_probe_error FROM {JOINED} j WHERE served_run_id IS NULL AND last_probe_error IS NOT NULL AND source NOT IN {OFF_SQL})"""


@query(f"SELECT * FROM {REPORT} r")
def health_report(spark, sf_dir):
    return status.health_report(joined(spark, sf_dir), status.latest_failed(runs(spark, sf_dir)), OFF)


@query(f"SELECT problem, string_agg(source || ': ' || coalesce(detail, ''), '; ' ORDER BY source || ': ' || coalesce(detail, '')) AS sources FROM {REPORT} r GROUP BY problem")
def health_summary(spark, sf_dir):
    return status.health_summary(health_report(spark, sf_dir))


DAY = 86_400
POLICY = f"""SELECT j.*, CASE CAST(substr(j.source, 4) AS INT) % 3 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Approximate' ELSE CASE WHEN j.source = 'src2' THEN NULL ELSE 'Approximate' END END AS kind,
  CAST(30 AS BIGINT) * {DAY} AS min_age_s, CAST(90 AS BIGINT) * {DAY} AS max_age_s, f.run_id IS NOT NULL AS last_failed"""
CHANGED = "CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'new' ELSE probe_fingerprint END"


def planned(spark, sf_dir):
    own = joined(spark, sf_dir).withColumn("probe_fingerprint", F.expr(CHANGED))
    return spark.sql(POLICY + " FROM {j} j LEFT JOIN {f} f ON f.source = j.source", j=own, f=status.latest_failed(runs(spark, sf_dir)).select("source", "run_id"))


DUE = f"""(WITH j AS (SELECT * REPLACE ({CHANGED} AS probe_fingerprint) FROM {JOINED} j), p AS ({POLICY} FROM j LEFT JOIN {FAILED} f ON f.source = j.source),
a AS (SELECT *, CAST(epoch({NOW}) - epoch(served_started_at) AS BIGINT) AS age, probe_fingerprint IS DISTINCT FROM served_fingerprint AS changed FROM p),
o AS (SELECT *, CASE WHEN kind = 'Exact' THEN CASE WHEN changed THEN age END WHEN changed AND age >= min_age_s THEN age - min_age_s WHEN age >= max_age_s THEN age - max_age_s END AS late FROM a)
SELECT source, CASE WHEN kind IS NULL THEN 'unprobed' WHEN served_started_at IS NULL THEN 'Initial' WHEN late IS NULL THEN 'up to date' WHEN last_failed THEN 'Retry'
  WHEN kind = 'Exact' OR (changed AND age >= min_age_s) THEN 'Changed' ELSE 'MaxAge' END AS label, CASE WHEN kind IS NOT NULL THEN late END AS overdue_s, last_failed FROM o)"""


@query(f"SELECT source, label, overdue_s FROM {DUE} d")
def refresh_due(spark, sf_dir):
    return status.refresh_due(planned(spark, sf_dir), F.expr(NOW)).select("source", "label", "overdue_s")


@query(f"""SELECT source, label, CASE WHEN label = 'Initial' OR row_number() OVER (PARTITION BY label = 'Initial' ORDER BY last_failed, overdue_s DESC NULLS LAST, source) <= 3 THEN 'import' ELSE 'deferred' END AS action
  FROM {DUE} d WHERE label IN ('Initial', 'Retry', 'Changed', 'MaxAge')""")
def refresh_plan(spark, sf_dir):
    return status.refresh_plan(status.refresh_due(planned(spark, sf_dir), F.expr(NOW)), 3).select("source", "label", "action")


PROBES = "SELECT source, max(CASE WHEN run_id % 3 = 0 THEN fingerprint END) AS probe_fingerprint, max(CASE WHEN run_id % 2 = 0 THEN error END) AS last_probe_error FROM {r} WHERE source <> 'src5' GROUP BY source"


@query(f"""WITH n AS ({PROBES.format(r="v_runs")})
SELECT coalesce(s.source, n.source) AS source, coalesce(n.probe_fingerprint, s.probe_fingerprint) AS probe_fingerprint, CASE WHEN n.source IS NOT NULL THEN n.last_probe_error ELSE s.last_probe_error END AS last_probe_error
FROM v_states s FULL JOIN n ON n.source = s.source""")
def upsert_keep_last(spark, sf_dir):
    return status.upsert_keep_last(states(spark, sf_dir), spark.sql(PROBES, r=runs(spark, sf_dir)))


@query("SELECT run_id, source FROM (SELECT source, served_run_id AS run_id FROM v_states WHERE source NOT IN (SELECT source FROM v_runs WHERE run_id % 500 = 0) UNION ALL SELECT source, max(run_id) FROM v_runs WHERE run_id % 500 = 0 GROUP BY source) t")
def upsert_states(spark, sf_dir):
    new = runs(spark, sf_dir).where("run_id % 500 = 0").groupBy("source").agg(F.max("run_id").alias("run_id"))
    return status.upsert(states(spark, sf_dir).select("source", F.col("served_run_id").alias("run_id")), new, "source")


@query(f"SELECT run_id, CASE WHEN completed_at IS NULL AND failed_at IS NULL THEN {NOW} ELSE failed_at END AS failed_at, CASE WHEN completed_at IS NULL AND failed_at IS NULL THEN 'interrupted' ELSE error END AS error FROM v_runs")
def sweep_unfinished(spark, sf_dir):
    return status.sweep_unfinished(runs(spark, sf_dir), F.expr(NOW).cast("timestamp_ntz"), "interrupted").select("run_id", "failed_at", "error")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) FILTER (kind = 'page_loads') AS page_loads, count(*) FILTER (kind = 'searches') AS searches,
  count(*) FILTER (kind = 'table_row_opens') AS table_row_opens, count(*) FILTER (kind = 'outgoing_clicks') AS outgoing_clicks FROM v_usage WHERE kind IS NOT NULL GROUP BY 1""")
def daily_telemetry(spark, sf_dir):
    return usage.daily(view(spark, sf_dir, "v_usage"))


@query("SELECT CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS tag, count(*) AS clicks FROM v_usage WHERE kind = 'outgoing_clicks' GROUP BY 1, 2")
def clicks_by_tag(spark, sf_dir):
    return usage.clicks_by_tag(view(spark, sf_dir, "v_usage"))


@query("SELECT event_id, user_id, kind FROM v_usage")
def incremental_ingest(spark, sf_dir):
    """Landed files moved to staging by a stream, and served by their run once it has ended."""
    top, day = landing(spark, "stream"), datetime.datetime(2024, 1, 1)
    rows = view(spark, sf_dir, "v_usage").select("event_id", "user_id", "kind")
    rows.repartition(4).write.parquet(f"{top}/landed")
    store = publish.Store(f"{top}/store")
    usage.staged_import(spark, store, publish.start(spark, store, "usage", "v1", "Initial", day), f"{top}/landed", rows.schema, day)
    return publish.served(spark, store).select(*rows.columns)


#: Each user's events in order, folded: one is let in if fewer than 20 let in before are under 60 seconds old.
FOLDED = """(SELECT user_id, unnest(list_reduce(list_prepend([], list_transform(list(struct_pack(event_id := event_id, ts := ts, admitted := TRUE) ORDER BY ts, event_id), lambda p: [p])),
  lambda kept, p: list_concat(kept, [struct_pack(event_id := p[1].event_id, ts := p[1].ts, admitted := len(list_filter(kept, lambda q: q.admitted AND epoch(p[1].ts) - epoch(q.ts) < 60)) < 20)]))) AS e
  FROM (SELECT CASE WHEN user_id % 50 <> 7 THEN user_id % 3 END AS user_id, event_id, DATE_TRUNC('hour', ts) + to_seconds(event_id % 240) AS ts FROM v_usage) u WHERE user_id IS NOT NULL GROUP BY user_id)"""


@query(f"""SELECT e.event_id AS event_id, user_id, e.ts AS ts, e.admitted AS admitted FROM {FOLDED} f
UNION ALL SELECT event_id, NULL, DATE_TRUNC('hour', ts) + to_seconds(event_id % 240), NULL FROM v_usage WHERE user_id % 50 = 7""")
def admission_labels(spark, sf_dir):
    """Events of busy users: three of them, in the first minutes of each hour."""
    v = view(spark, sf_dir, "v_usage")
    busy = v.withColumns({"user_id": F.when(F.col("user_id") % 50 != 7, F.col("user_id") % 3), "ts": F.expr("date_trunc('hour', ts) + make_dt_interval(0, 0, 0, event_id % 240)").cast("timestamp_ntz")})
    return usage.admission_labels(busy)


@query("""SELECT run_id, CASE WHEN run_id % 97 = 0 THEN TIMESTAMP '2002-01-01 00:00:00' ELSE failed_at END AS failed_at, CASE WHEN run_id % 97 = 0 THEN 'lost ' || run_id ELSE error END AS error FROM v_runs WHERE run_id % 89 <> 0""")
def fail_and_discard(spark, sf_dir):
    """Runs of which some are failed and others forgotten."""
    r = runs(spark, sf_dir)
    failed = r.where("run_id % 97 = 0").select("run_id", F.concat(F.lit("lost "), F.col("run_id").cast("string")).alias("error"))
    out = status.failed_runs(r, failed, F.expr(NOW).cast("timestamp_ntz"))
    return status.discarded_runs(out, r.where("run_id % 89 = 0").select("run_id")).select("run_id", "failed_at", "error")


@query("""WITH last AS (SELECT max(run_id) AS m FROM v_runs), n AS (SELECT source, max(fingerprint) AS fingerprint FROM v_runs GROUP BY source)
SELECT m + row_number() OVER (ORDER BY source) AS run_id, source, fingerprint, TIMESTAMP '2002-01-01 00:00:00' AS started_at FROM n, last""")
def start_runs(spark, sf_dir):
    """A new run for each source, numbered after all before."""
    r = runs(spark, sf_dir)
    return status.started(r, r.groupBy("source").agg(F.max("fingerprint").alias("fingerprint")), F.expr(NOW).cast("timestamp_ntz")).select("run_id", "source", "fingerprint", "started_at")
