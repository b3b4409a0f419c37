"""Import history: states, failures, health, due refreshes, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_status(states: DataFrame, runs: DataFrame) -> DataFrame:
    """States with their served run, if any."""
    served = runs.select(F.col("run_id").alias("served_run_id"), F.col("started_at").alias("served_started_at"), F.col("completed_at").alias("served_completed_at"), "record_count", "skipped_parts", F.col("fingerprint").alias("served_fingerprint"))
    return states.join(served, "served_run_id", "left")


def serving(status: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Visible sources that serve rows."""
    out = status.where("record_count > 0")
    return out.where(~F.col("source").isin(*disabled)) if disabled else out


def latest_failed(runs: DataFrame) -> DataFrame:
    """The last finished run of each source, where it failed; unfinished runs don't count."""
    ended = F.coalesce("completed_at", "failed_at")
    last = Window.partitionBy("source").orderBy(ended.desc(), F.col("run_id").desc())
    return runs.where(ended.isNotNull()).withColumn("rn", F.row_number().over(last)).where("rn = 1 AND failed_at IS NOT NULL").drop("rn")


def source_history(states: DataFrame, failed: DataFrame) -> DataFrame:
    """Every source that serves or failed last."""
    return states.select("source", "served_run_id").join(failed.select("source", F.col("run_id").alias("failed_run_id")), "source", "full")


def total_rows(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("total"))


def currency_date(status: DataFrame) -> DataFrame:
    return status.agg(F.min(F.coalesce("last_checked_at", "served_completed_at")).alias("as_of"))


def retrieval_years(status: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    local = F.from_utc_timestamp(F.col("served_started_at").cast("timestamp"), zone)
    return status.where("served_started_at IS NOT NULL").select("source", F.year(local).alias("year"))


def health_report(status: DataFrame, failed: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """source, problem, detail for failed imports, skipped parts and failing probes without data."""
    if disabled:
        status, failed = (d.where(~F.col("source").isin(*disabled)) for d in (status, failed))
    say = lambda d, what, detail: d.select("source", F.lit(what).alias("problem"), detail.cast("string").alias("detail"))
    return (
        say(failed, "latest import failed", F.col("error"))
        .unionByName(say(status.where("skipped_parts > 0"), "skipped parts", F.col("skipped_parts")))
        .unionByName(say(status.where("served_run_id IS NULL AND last_probe_error IS NOT NULL"), "no data and probe failing", F.col("last_probe_error")))
    )


def health_summary(report: DataFrame) -> DataFrame:
    line = F.concat("source", F.lit(": "), F.coalesce("detail", F.lit("")))
    return report.groupBy("problem").agg(F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("sources"))


def seconds(a: Column, b: Column) -> Column:
    return F.unix_timestamp(a).cast("long") - F.unix_timestamp(b).cast("long")


def refresh_due(status: DataFrame, now: Column) -> DataFrame:
    """label and overdue seconds of each source: columns probe_fingerprint, kind (Exact or Approximate),
    served_fingerprint, served_started_at, min_age_s, max_age_s and last_failed decide."""
    age = seconds(now, F.col("served_started_at"))
    changed = ~F.equal_null("probe_fingerprint", "served_fingerprint")
    exact = F.col("kind") == "Exact"
    overdue = (
        F.when(exact & changed, age)
        .when(exact, F.lit(None).cast("long"))
        .when(changed & (age >= F.col("min_age_s")), age - F.col("min_age_s"))
        .when(age >= F.col("max_age_s"), age - F.col("max_age_s"))
    )
    reason = F.when(exact | (changed & (age >= F.col("min_age_s"))), "Changed").otherwise("MaxAge")
    label = (
        F.when(F.col("kind").isNull(), "unprobed")
        .when(F.col("served_started_at").isNull(), "Initial")
        .when(overdue.isNull(), "up to date")
        .when(F.col("last_failed"), "Retry")
        .otherwise(reason)
    )
    out = status.select("*", label.alias("label"))
    return out.withColumn("overdue_s", F.when(F.col("label").isin("Retry", "Changed", "MaxAge"), overdue))


def refresh_plan(due: DataFrame, cap: int) -> DataFrame:
    """action and rank: initial imports all, those that failed last; routine ones by lateness up to the cap, the rest deferred."""
    routine = F.col("label").isin("Retry", "Changed", "MaxAge")
    initial = F.col("label") == "Initial"
    kind = F.when(routine, "routine").when(initial, "initial").otherwise("none")
    place = Window.partitionBy("group").orderBy(F.col("last_failed").asc(), F.col("overdue_s").desc_nulls_last(), F.col("source").asc())
    out = due.where(routine | initial).withColumn("group", kind).withColumn("rank", F.row_number().over(place))
    return out.withColumn("action", F.when((F.col("group") == "initial") | (F.col("rank") <= cap), "import").otherwise("deferred"))


def upsert_keep_last(old: DataFrame, new: DataFrame) -> DataFrame:
    """States after a round of probes: the new error replaces the old, a missing fingerprint doesn't."""
    n = new.select("source", F.col("probe_fingerprint").alias("new_fingerprint"), F.col("last_probe_error").alias("new_error"), F.lit(True).alias("probed"))
    both = old.join(n, "source", "full")
    return both.select("source", F.coalesce("new_fingerprint", "probe_fingerprint").alias("probe_fingerprint"), F.when(F.col("probed"), F.col("new_error")).otherwise(F.col("last_probe_error")).alias("last_probe_error"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def sweep_unfinished(runs: DataFrame, now: Column, error: str) -> DataFrame:
    """Runs that neither completed nor failed become failed ones."""
    open_ = F.col("completed_at").isNull() & F.col("failed_at").isNull()
    return runs.withColumns({"failed_at": F.when(open_, now).otherwise(F.col("failed_at")), "error": F.substring(F.when(open_, F.lit(error)).otherwise(F.col("error")), 1, 2000)})


def started(runs: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """A new run for each source due, numbered after all runs in the order of the sources, of which there are some dozens."""
    last = F.broadcast(runs.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("last")))  # one row
    nth = F.row_number().over(Window.partitionBy("last").orderBy("source"))
    return due.crossJoin(last).select((F.col("last") + nth).alias("run_id"), *due.columns, now.alias("started_at"))


def failed_runs(runs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Runs after some (run_id, error) have failed; an error is cut at 2000 characters."""
    own = failures.select("run_id", F.substring("error", 1, 2000).alias("new_error"), F.lit(True).alias("hit"))
    both = runs.join(own, "run_id", "left")
    return both.withColumns({"failed_at": F.when(F.col("hit"), now).otherwise(F.col("failed_at")), "error": F.when(F.col("hit"), F.col("new_error")).otherwise(F.col("error"))}).drop("new_error", "hit")


def discarded_runs(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """Runs without those of the given run_ids."""
    return runs.join(gone.select("run_id"), "run_id", "left_anti")
