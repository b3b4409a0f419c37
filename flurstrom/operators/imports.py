"""Import jobs: what a source is, and one round that probes the sources and imports those that are due.

A new source is a class with the members of SourceJob and an entry in the registry;
planning, gates and publishing need no change."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import publish, status

PLAN = "source string, kind string, min_age_s long, max_age_s long, probe_fingerprint string, last_probe_error string"


@dataclass
class Fetched:
    """What a source's rows report beside themselves."""

    skipped: int = 0  #: parts tolerated missing
    fingerprint: str | None = None  #: the version really read, where it isn't the probe's
    gates: list[tuple[str, DataFrame]] = field(default_factory=list)  #: name and one-row frame with the column passes


class SourceJob(Protocol):
    #: Stable name; the rows, runs and states of the source go by it.
    id: str
    #: Exact (a change of the fingerprint is a change of the data) or Approximate.
    kind: str
    #: Ages of what is served, in seconds, from which a change or nothing at all is reason enough.
    min_age_s: int
    max_age_s: int

    def probe(self, spark: SparkSession) -> str:
        """The fingerprint of what there is to import, cheaply; raises where it can't tell."""

    def rows(self, spark: SparkSession, fetched: Fetched) -> DataFrame:
        """Standardized rows; what is skipped, another fingerprint and further gates go to ``fetched``."""


def probed(spark: SparkSession, jobs: Mapping[str, SourceJob]) -> list[dict]:
    """The fingerprint or the error of each source's probe."""
    out = []
    for job in jobs.values():
        try:
            out.append({"source": job.id, "fingerprint": job.probe(spark)})
        except Exception as e:  # the source is left out of this round
            out.append({"source": job.id, "error": str(e)[: publish.ERROR]})
    return out


def planned(spark: SparkSession, jobs: Mapping[str, SourceJob], probes: list[dict]) -> DataFrame:
    """A row for each source: its policy, if its probe answered, and what the probe told."""
    rows = [(p["source"], None if "error" in p else j.kind, j.min_age_s, j.max_age_s, p.get("fingerprint"), p.get("error")) for p in probes for j in [jobs[p["source"]]]]
    return spark.createDataFrame(rows, PLAN)


def due(spark: SparkSession, store: publish.Store, probes: DataFrame, now: datetime.datetime, cap: int) -> DataFrame:
    """Sources to import in this round, in order."""
    runs = publish.runs(spark, store)
    known = status.source_status(publish.states(spark, store), runs).select("source", "served_fingerprint", "served_started_at")
    failed = status.latest_failed(runs).select("source", F.lit(True).alias("last_failed"))
    table = probes.join(known, "source", "left").join(failed, "source", "left").fillna(False, ["last_failed"])
    return status.refresh_plan(status.refresh_due(table, F.lit(now)), cap)


def health(spark: SparkSession, store: publish.Store, disabled: tuple[str, ...] = ()) -> DataFrame:
    """The health report of a store."""
    runs = publish.runs(spark, store)
    return status.health_report(status.source_status(publish.known(spark, store), runs), status.latest_failed(runs), disabled)


def refresh(spark: SparkSession, store: publish.Store, jobs: Mapping[str, SourceJob], now: datetime.datetime, cap: int = 3, lease: datetime.timedelta = datetime.timedelta(days=1)) -> DataFrame:
    """One round: fails the runs that a lost job left, probes the sources, confirms those up to date and imports
    those due; returns each source's label and action.

    A source that fails is recorded and the round goes on. A round under way raises Busy; one that
    began a lease ago is taken for dead, and what it still does is fenced off."""
    round = publish.begin_round(spark, store, now, lease)
    publish.sweep(spark, store)
    probes = probed(spark, jobs)
    publish.record_probes(spark, store, probes, now, round)
    plan = due(spark, store, planned(spark, jobs, probes), now, cap).select("source", "label", "action", "rank", "probe_fingerprint").collect()  # a row for each source
    busy = {r["source"] for r in plan}
    publish.confirm(spark, store, [p["source"] for p in probes if "error" not in p and p["source"] not in busy], now, round)
    for r in sorted(plan, key=lambda r: (r["label"] != "Initial", r["rank"])):
        if r["action"] != "import":
            continue
        run = publish.start(spark, store, r["source"], r["probe_fingerprint"], r["label"], now, round)
        fetched = Fetched()
        try:
            rows = jobs[r["source"]].rows(spark, fetched)
        except Exception as e:
            publish.fail(spark, store, run, now, str(e), fetched.fingerprint)
            continue
        try:
            publish.replace(spark, store, run, rows, now, tuple(fetched.gates), fetched.skipped, fetched.fingerprint)
        except publish.Fenced:  # another round goes on
            raise
        except Exception:  # recorded by replace; other sources go on
            continue
    publish.end_round(spark, store, round)
    return spark.createDataFrame([(r["source"], r["label"], r["action"]) for r in plan], "source string, label string, action string")
