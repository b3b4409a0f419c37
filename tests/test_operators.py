"""Search, status, gates, publishing, geocoding and buildings on small tables."""

import dataclasses
import datetime
import datetime as dt
import math
import random
import tempfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from flurstrom.functions import geo
from flurstrom.operators import buildings, geocode, imports, publish, quality, search, spatial, status


def test_search_order_is_german_and_numeric(spark):
    rows = [(1, "Waldweg", "1", None, "20000"), (2, "Ölweg", "1", None, "20000"), (3, "Bergstraße", "10", None, "20000"), (4, "Bergstraße", "2", "a", "20000"), (5, "Bergstraße", "2", None, "20000"), (6, None, None, None, None), (7, "Zum Tor", "1", None, "10000")]
    df = spark.createDataFrame(rows, "id int, str string, hnr string, hnr_zus string, plz string")
    assert [r["id"] for r in search.top(df).collect()] == [7, 5, 4, 3, 2, 1, 6]
    assert "TakeOrderedAndProject" in search.top(df)._jdf.queryExecution().executedPlan().toString()


def test_filters_only_where_given(spark):
    df = spark.createDataFrame([("a", "1", 5.0, "s"), ("b", "1", None, "t")], "gemeinde string, plz string, flaeche_amtl double, source string")
    assert search.search(df).count() == 2
    assert search.search(df, min_area=5.0, max_area=5.0).count() == 1
    assert search.search(df, plz="1", disabled=("s",)).collect()[0]["gemeinde"] == "b"


T = dt.datetime


def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id int, source string, fingerprint string, started_at timestamp_ntz, completed_at timestamp_ntz, failed_at timestamp_ntz, error string, record_count long, skipped_parts int")


def test_latest_failed_ignores_unfinished_runs(spark):
    r = runs(spark, [(1, "a", "f", T(2024, 1, 1), T(2024, 1, 2), None, None, 5, 0), (2, "a", "f", T(2024, 1, 3), None, T(2024, 1, 4), "x", 0, 0), (3, "a", "f", T(2024, 1, 5), None, None, None, 0, 0), (4, "b", "f", T(2024, 1, 1), None, T(2024, 1, 2), "y", 0, 0), (5, "b", "f", T(2024, 1, 1), T(2024, 1, 2), None, None, 7, 0)])
    assert [(x["source"], x["run_id"]) for x in status.latest_failed(r).collect()] == [("a", 2)]
    swept = {x["run_id"]: x["error"] for x in status.sweep_unfinished(r, F.lit(T(2024, 2, 1)).cast("timestamp_ntz"), "z" * 3000).collect()}
    assert len(swept[3]) == 2000 and swept[2] == "x"
    one = spark.createDataFrame([(3, "e" * 3000)], "run_id long, error string")
    assert status.discarded_runs(r, one).count() == 4 and status.failed_runs(r, one, F.lit(T(2024, 2, 1)).cast("timestamp_ntz")).where("run_id = 3").collect()[0]["error"] == "e" * 2000


DAY = 86_400


@pytest.mark.parametrize(
    "kind, probe, age_days, failed, label, overdue_days",
    [
        (None, "a", 5, False, "unprobed", None),
        ("Exact", "a", None, True, "Initial", None),
        ("Exact", "a", 500, False, "up to date", None),
        ("Exact", "b", 2, False, "Changed", 2),
        ("Exact", "b", 2, True, "Retry", 2),
        ("Approximate", "b", 29, False, "up to date", None),
        ("Approximate", "b", 30, False, "Changed", 0),
        ("Approximate", "b", 95, False, "Changed", 65),
        ("Approximate", "a", 95, False, "MaxAge", 5),
        ("Approximate", "a", 89, False, "up to date", None),
    ],
)
def test_refresh_rules(spark, kind, probe, age_days, failed, label, overdue_days):
    now = T(2025, 1, 1)
    started = None if age_days is None else now - dt.timedelta(days=age_days)
    df = spark.createDataFrame([("s", probe, kind, "a" if started else None, started, 30 * DAY, 90 * DAY, failed)], "source string, probe_fingerprint string, kind string, served_fingerprint string, served_started_at timestamp, min_age_s long, max_age_s long, last_failed boolean")
    r = status.refresh_due(df, F.lit(now)).collect()[0]
    assert (r["label"], r["overdue_s"]) == (label, None if overdue_days is None else overdue_days * DAY)


def test_plan_caps_routine_imports_only(spark):
    rows = [("i1", "Initial", None, True), ("i2", "Initial", None, False), ("r1", "Retry", 900, True), ("r2", "Changed", 5, False), ("r3", "MaxAge", 50, False), ("u", "up to date", None, False)]
    df = spark.createDataFrame(rows, "source string, label string, overdue_s long, last_failed boolean")
    got = {r["source"]: (r["action"], r["rank"]) for r in status.refresh_plan(df, 1).collect()}
    assert got == {"i2": ("import", 1), "i1": ("import", 2), "r3": ("import", 1), "r2": ("deferred", 2), "r1": ("deferred", 3)}


def test_gates(spark):
    old = spark.createDataFrame([("a", k) for k in range(100)], "source string, k int")
    assert quality.shrink_check(old, old.limit(98)).collect()[0]["passes"] and not quality.shrink_check(old, old.limit(97)).collect()[0]["passes"]
    assert quality.shrink_check(old.limit(0), old.limit(1)).collect()[0]["passes"]
    lines = spark.createDataFrame([(True,), (False,)], "ok boolean")
    assert quality.readability(lines, "ok").collect()[0]["passes"] and not quality.readability(lines.where("NOT ok"), "ok").collect()[0]["passes"] and not quality.readability(lines.limit(0), "ok").collect()[0]["passes"]
    assert quality.completeness(lines, "ok", 0).collect()[0]["ratio"] == 1.0
    with pytest.raises(quality.GateError):
        quality.enforce(quality.readability(lines.limit(0), "ok"), "lines")


def table_of(spark, source, n, first=0):
    return spark.range(first, first + n).select("id", F.lit("1").alias("plz"), F.lit("g").alias("gemeinde"), F.lit(source).alias("source"))


def test_refused_import_leaves_what_was_served(spark):
    store = publish.Store(tempfile.mkdtemp(prefix="spark-"))
    day = lambda d: datetime.datetime(2024, 1, d)
    least = lambda: {r["source"]: (r["run_id"], r["a"], r["n"]) for r in publish.served(spark, store).groupBy("source", "run_id").agg(F.min("id").alias("a"), F.count("*").alias("n")).collect()}
    for source in "ab":
        publish.replace(spark, store, publish.start(spark, store, source, "f1", "Initial", day(1)), table_of(spark, source, 50), day(2))
    publish.replace(spark, store, publish.start(spark, store, "a", "f2", "Changed", day(3)), table_of(spark, "a", 49, 100), day(4), skipped=1, fingerprint="f2b")
    assert least() == {"a": (3, 100, 49), "b": (2, 0, 50)}
    bad = spark.createDataFrame([(False,)], "passes boolean")
    for rows, gates in ((table_of(spark, "a", 48), ()), (table_of(spark, "a", 0), ()), (table_of(spark, "a", 60), (("join", bad),)), (table_of(spark, "a", 60).withColumn("id", F.raise_error(F.lit("x" * 3000)).cast("long")), ())):
        with pytest.raises(Exception):
            publish.replace(spark, store, publish.start(spark, store, "a", "f3", "Changed", day(5)), rows, day(6), gates)
    assert least() == {"a": (3, 100, 49), "b": (2, 0, 50)}
    publish.discard(spark, store, publish.start(spark, store, "b", None, "Retry", day(7)))
    runs = {r["run_id"]: r for r in publish.runs(spark, store).collect()}
    assert sorted(runs) == [1, 2, 3, 4, 5, 6, 7] and all(runs[k]["failed_at"] == day(6) and len(runs[k]["error"]) <= 2000 for k in (4, 5, 6, 7))
    assert (runs[3]["record_count"], runs[3]["skipped_parts"], runs[3]["fingerprint"], runs[2]["fingerprint"]) == (49, 1, "f2b", "f1")
    assert publish.sweep(spark, store) >= 2 and least() == {"a": (3, 100, 49), "b": (2, 0, 50)}
    # an import may run again under its id, as after a lost driver
    publish.replace(spark, store, publish.Run(8, "c"), table_of(spark, "c", 3), day(8))
    assert least()["c"] == (8, 0, 3)


@dataclasses.dataclass
class Job:
    id: str
    print: str = "v1"
    n: int = 20
    broken: str = ""
    kind: str = "Exact"
    min_age_s: int = 0
    max_age_s: int = 10**9

    def probe(self, spark):
        if self.broken == "probe":
            raise ValueError("no answer")
        return self.print

    def rows(self, spark, fetched):
        if self.broken == "rows":
            raise ValueError("cut off")
        fetched.skipped = 1
        fetched.gates.append(("completeness", quality.shrink_check(table_of(spark, self.id, 0), table_of(spark, self.id, self.n))))
        return table_of(spark, self.id, self.n)


def test_a_round_of_imports(spark):
    store = publish.Store(tempfile.mkdtemp(prefix="spark-"))
    day = lambda d: datetime.datetime(2024, 1, d)
    jobs = {j.id: j for j in (Job("a"), Job("b"), Job("c", broken="rows"), Job("d", broken="probe"))}
    said = lambda d: {r["source"]: (r["label"], r["action"]) for r in imports.refresh(spark, store, jobs, day(d)).collect()}
    assert said(1) == {x: ("Initial", "import") for x in "abc"}
    assert {r["source"] for r in publish.states(spark, store).collect()} == {"a", "b"}
    jobs["a"].print, jobs["c"].broken, jobs["d"].broken = "v2", "", ""
    assert said(2) == {"a": ("Changed", "import"), "c": ("Initial", "import"), "d": ("Initial", "import")}
    jobs["b"].print, jobs["b"].n = "v2", 3  # too few rows
    assert said(3) == {"b": ("Changed", "import")}
    now = {r["source"]: r for r in publish.states(spark, store).collect()}
    assert now["b"]["last_checked_at"] == day(2) and now["a"]["last_checked_at"] == day(3)
    assert publish.served(spark, store).where("source = 'b'").count() == 20
    assert said(4) == {"b": ("Retry", "import")}


def test_a_round_records_versions_probes_and_lost_runs(spark):
    store = publish.Store(tempfile.mkdtemp(prefix="spark-"))
    day = lambda d: datetime.datetime(2024, 1, d)

    class Reports(Job):
        def rows(self, spark, fetched):
            fetched.fingerprint = f"real-{self.print}"
            return super().rows(spark, fetched)

    jobs = {j.id: j for j in (Reports("a", "v1"), Job("b", "v1"), Job("c", broken="probe"))}
    imports.refresh(spark, store, jobs, day(1))
    lost = publish.start(spark, store, "b", "v2", "Changed", day(2))  # its job is lost
    table_of(spark, "b", 9).withColumn("run_id", F.lit(lost.run_id)).write.mode("append").partitionBy("source", "run_id").parquet(store.served)
    jobs["b"].print, jobs["a"].broken, jobs["a"].print = "v2", "probe", "v9"
    got = {r["source"]: (r["label"], r["action"]) for r in imports.refresh(spark, store, jobs, day(3)).collect()}
    assert got == {"b": ("Retry", "import")}
    runs = {r["run_id"]: r for r in publish.runs(spark, store).collect()}
    assert {r["source"]: r["fingerprint"] for k, r in runs.items() if r["completed_at"] == day(1)} == {"a": "real-v1", "b": "v1"}
    assert runs[lost.run_id]["error"] == publish.INTERRUPTED and runs[lost.run_id]["fingerprint"] == "v2" and runs[lost.run_id]["failed_at"] == day(3)
    assert not spark._jvm.java.io.File(f"{store.served}/source=b/run_id={lost.run_id}").exists()
    known = {r["source"]: r for r in publish.known(spark, store).collect()}
    assert (known["a"]["probe_fingerprint"], known["a"]["last_probe_error"], known["a"]["last_probe_at"]) == ("v1", "no answer", day(3))
    assert known["b"]["last_probe_error"] is None and known["c"]["served_run_id"] is None
    assert {(r["source"], r["problem"]) for r in imports.health(spark, store).collect()} == {("a", "skipped parts"), ("b", "skipped parts"), ("c", "no data and probe failing")}
    assert publish.sweep(spark, store) == 1 and publish.sweep(spark, store) == 0  # the rows of b's first run


def test_writers_that_were_overtaken_are_fenced_off(spark):
    store = publish.Store(tempfile.mkdtemp(prefix="spark-"))
    day = lambda d: datetime.datetime(2024, 1, d)
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda s: publish.start(spark, store, s, "f", "Initial", day(1)).run_id, "abcdefgh"))
    assert sorted(ids) == list(range(1, 9))
    old, new = (publish.start(spark, store, "x", f, "Initial", day(2)) for f in ("f1", "f2"))
    publish.replace(spark, store, new, table_of(spark, "x", 5), day(3))
    with pytest.raises(publish.Fenced):
        publish.replace(spark, store, old, table_of(spark, "x", 50), day(4))
    assert publish.served(spark, store).where("source = 'x'").count() == 5
    first = publish.begin_round(spark, store, day(5), dt.timedelta(days=2))
    with pytest.raises(publish.Busy):
        publish.begin_round(spark, store, day(6), dt.timedelta(days=2))
    slow = publish.start(spark, store, "y", "f", "Initial", day(5), first)
    second = publish.begin_round(spark, store, day(8), dt.timedelta(days=2))
    assert second == first + 1
    for late in (lambda: publish.replace(spark, store, slow, table_of(spark, "y", 5), day(9)), lambda: publish.start(spark, store, "z", "f", "Initial", day(9), first), lambda: publish.confirm(spark, store, ["x"], day(9), first)):
        with pytest.raises(publish.Fenced):
            late()
    assert publish.served(spark, store).where("source = 'y'").count() == 0
    publish.end_round(spark, store, second)
    publish.begin_round(spark, store, day(9), dt.timedelta(days=2))


def test_a_snapshot_holds_all_commits(spark, monkeypatch):
    store = publish.Store(tempfile.mkdtemp(prefix="spark-"))
    monkeypatch.setattr(publish, "EACH", 4)
    at = datetime.datetime(2024, 1, 1)
    for k in range(11):
        publish.record_probes(spark, store, [{"source": f"s{k}", "fingerprint": "f"}], at)
    last, paths = publish.log_files(spark, store)
    assert last == 11 and len(paths) == 4 and publish.known(spark, store).count() == 11
    at_, fs = publish.files_at(spark, store.log)
    assert len([s for s in fs.listStatus(at_)]) <= 9


def shape(x, y, e):
    p = [(x, y), (x + e, y), (x + e, y + e), (x, y + e), (x, y)]
    return [[p]]


def test_smallest_container_wins_and_edges_are_outside(spark):
    shapes = spark.createDataFrame([(1, shape(0.0, 0.0, 100.0)), (2, shape(10.0, 10.0, 20.0)), (3, shape(10.0, 10.0, 20.0)), (4, [[[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])], f"id int, geometry {geo.GEOMETRY}")
    points = spark.createDataFrame([(1, 15.0, 15.0), (2, 50.0, 50.0), (3, 0.0, 50.0), (4, 10.0, 20.0), (5, 500.0, 5.0)], "p int, x double, y double")
    got = {r["p"]: r["id"] for r in spatial.containing(points, shapes, "p", "id", 30.0).collect()}
    assert got == {1: 2, 2: 1, 4: 1}


def star(rng, n, x, y, r):
    """A closed ring of n vertices about a middle, at angles in order and at distances of any kind."""
    p = [(x + math.cos(2 * math.pi * k / n) * d, y + math.sin(2 * math.pi * k / n) * d) for k in range(n) for d in [rng.choice([r, r * rng.uniform(0.6, 1), r * 0.75])]]
    return [*p, p[0]]


def test_prepared_shapes_hold_what_a_test_of_all_edges_finds(spark):
    rng = random.Random(6)
    teeth = [(float(k // 2 if k % 2 else (k + 1) // 2) / 4, 30.0 if k % 4 in (1, 2) else 31.0 + (k % 7)) for k in range(400)]
    comb = [(0.0, 20.0), *teeth, (50.0, 20.0), (0.0, 20.0)]
    stairs = [p for k in range(60) for p in ((k * 0.5, k * 0.5), (k * 0.5 + 0.5, k * 0.5))] + [(30.0, 0.0), (0.0, 0.0)]
    shapes = [(1, [[star(rng, 900, 50.0, 50.0, 40.0), star(rng, 300, 50.0, 50.0, 12.0)], [star(rng, 200, 5.0, 90.0, 4.0)]]), (2, [[comb]]), (3, [[stairs]]), (4, shape(10.0, 10.0, 60.0)), (5, [[[(80.0, 80.0), *((80.0 + k / 20, 81.0) for k in range(100)), (85.0, 80.0), (80.0, 80.0)]]]), (6, [[comb]])]
    df = spark.createDataFrame(shapes, f"id int, geometry {geo.GEOMETRY}").repartition(3)
    at = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(1200)] + [(float(rng.randrange(0, 200)) / 4, float(rng.randrange(0, 160)) / 4) for _ in range(800)] + [v for _, g in shapes for part in g for r in part for v in rng.sample(r, min(len(r), 30))]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "p int, x double, y double")
    e = df.select("id", geo.edges(F.col("geometry")).alias("e"), geo.area(F.col("geometry")).alias("s"))
    met = points.crossJoin(e).where(geo.contains(F.col("e"), F.col("x"), F.col("y"))).groupBy("p").agg(F.min(F.struct("s", "id")).alias("b"))
    want = {r["p"]: r["b"]["id"] for r in met.collect()}
    assert len(set(want.values())) == 5
    for limit in (None, 100):
        got = {r["p"]: r["id"] for r in spatial.containing(points, df, "p", "id", 10.0, limit=limit).collect()}
        assert got == want, limit


def test_a_shape_of_many_edges_costs_a_point_few(spark):
    n = 100_000
    circle = spark.range(1).select(F.lit(1).alias("id"), F.array(F.array(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.struct((F.cos(k % n * (2 * math.pi / n)) * 1000).alias("x"), (F.sin(k % n * (2 * math.pi / n)) * 1000).alias("y"))))).alias("geometry"))
    own = spatial.stripped(spatial.with_edges(circle))
    found = spatial.pieces(own).select("strip", "bucket", F.coalesce(F.size("some"), F.lit(0)).alias("edges")).groupBy("strip", "bucket").agg(F.sum("edges").alias("edges"), F.count("*").alias("n"))
    most = found.agg(F.max("edges"), F.max("n"), F.sum("edges")).first()
    assert most[0] < 1500 and most[1] < 20 and most[2] < 3 * n
    points = spark.createDataFrame([(k, math.cos(k) * k * 4, math.sin(k) * k * 4) for k in range(400)], "id long, x double, y double")
    got = {r["id"] for r in spatial.containing(points, circle.withColumnRenamed("id", "shape"), "id", "shape", 100.0).collect()}
    assert got == {k for k in range(400) if k * 4 < 1000}


def test_a_crowded_city_is_many_cells_and_one_place_an_error(spark):
    rng = random.Random(2)
    at = [(k, 5000 + rng.gauss(0, 20), 5000 + rng.gauss(0, 20)) for k in range(4000)] + [(10_000 + k, rng.uniform(0, 10_000), rng.uniform(0, 10_000)) for k in range(200)]
    points = spark.createDataFrame(at, "p int, x double, y double")
    shapes = spark.createDataFrame([(k, shape(k % 10 * 1000.0, k // 10 * 1000.0, 1000.0)) for k in range(100)], f"id int, geometry {geo.GEOMETRY}")
    met = spatial.dealt(points, spatial.stripped(spatial.with_edges(shapes)), "p", 1.0, 50, 14)
    cells = spatial.quadtree(points, "p", 2.0**14, 50, 14, strict=True).groupBy("level", "cx", "cy").count().agg(F.max("count"), F.count("*")).first()
    assert met.select("p").distinct().count() == len(at) and cells[0] < 50 and cells[1] > 80
    got = {r["p"]: r["id"] for r in spatial.containing(points, shapes, "p", "id", 1.0, limit=50, levels=14).collect()}
    assert got == {p: int(x // 1000) + 10 * int(y // 1000) for p, x, y in at}
    same = spark.createDataFrame([(k, 3.5, 3.5) for k in range(60)], "p int, x double, y double")
    with pytest.raises(Exception, match="holds 50 points or more"):
        spatial.containing(same, shapes, "p", "id", 1.0, limit=50, levels=14).collect()


def test_points_of_a_key_are_clustered_in_order(spark):
    rows = [("k", 1, 0.0, 0.0), ("k", 2, 0.5, 0.4), ("k", 3, 2.0, 0.0), ("k", 4, 1.2, 0.0), ("u", 1, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "key string, ord int, a float, b float")
    got = {r["key"]: [(p["a"], p["b"]) for p in r["points"]] for r in geocode.cluster_points(df, 1.0).collect()}
    assert got["u"] == [(5.0, 5.0)] and [p[0] for p in got["k"]] == [0.0, 2.0]


def test_parcel_texts_are_read_once_for_pins(spark):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
    parcels = spark.createDataFrame([(1, "Weg 1", shape(0.0, 0.0, 10.0)), (2, "Weg 2, 3b", shape(100.0, 0.0, 10.0))], f"parcel_id int, lagebez string, geometry {geo.GEOMETRY}")
    houses = spark.createDataFrame([(1, "Weg 2", shape(102.0, 2.0, 2.0))], f"building_id int, lagebez string, geometry {geo.GEOMETRY}")
    assert buildings.pinned(parcels.withColumn("lagebez", told("lagebez")), houses).count() == 3 and seen.value == 2


def test_pins_by_parcel_and_nearest_building(spark):
    parcels = spark.createDataFrame([(1, "Weg 1", shape(0.0, 0.0, 10.0)), (2, "Weg 2, 3b", shape(100.0, 0.0, 10.0)), (3, None, shape(0.0, 0.0, 1.0))], f"parcel_id int, lagebez string, geometry {geo.GEOMETRY}")
    houses = spark.createDataFrame([(1, "Weg 2", shape(102.0, 2.0, 2.0)), (2, "Weg 2", shape(104.0, 4.0, 4.0)), (3, "Weg 3 B", shape(300.0, 0.0, 5.0)), (4, "Weg 3b", shape(209.0, 0.0, 5.0))], f"building_id int, lagebez string, geometry {geo.GEOMETRY}")
    got = {(r["parcel_id"], r["pos"]): (r["kind"], r["x"], r["y"]) for r in buildings.pinned(parcels, houses).collect()}
    assert got == {(1, 0): ("parcel", 5.0, 5.0), (2, 0): ("building", 106.0, 6.0), (2, 1): ("building", 211.5, 2.5)}


def edge_distance(p, q):
    """Distance of two shapes of one ring each, edge by edge."""

    def to(a, b, c):
        d = (b[0] - a[0], b[1] - a[1])
        t = max(0.0, min(1.0, ((c[0] - a[0]) * d[0] + (c[1] - a[1]) * d[1]) / ((d[0] ** 2 + d[1] ** 2) or 1)))
        return math.hypot(c[0] - a[0] - t * d[0], c[1] - a[1] - t * d[1])

    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
    within = lambda r, c: sum((a[1] > c[1]) != (b[1] > c[1]) and c[0] < (b[0] - a[0]) * (c[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:])) % 2 == 1
    if within(p, q[0]) or within(q, p[0]):
        return 0.0
    out = 1e18
    for a, b in zip(p, p[1:]):
        for c, d in zip(q, q[1:]):
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return 0.0
            out = min(out, to(a, b, c), to(a, b, d), to(c, d, a), to(c, d, b))
    return out


def test_nearest_buildings_equal_brute_force_and_few_pairs_are_measured(spark, monkeypatch):
    rng = random.Random(13)
    ring = lambda n, r: star(rng, n, rng.uniform(0, 1500), rng.uniform(0, 1500), r)
    parcels = [(k, ring(rng.choice([5, 9, 40]), rng.choice([10.0, 30.0, 300.0]))) for k in range(60)]
    houses = [(k, ring(rng.choice([4, 8]), rng.choice([6.0, 15.0, 150.0]))) for k in range(150)]
    at = spark.createDataFrame([(k, 0, "Weg", "1", None, [[r]]) for k, r in parcels], f"parcel_id int, pos int, str string, hnr string, hnr_zus string, geometry {geo.GEOMETRY}")
    named = spark.createDataFrame([(k, "Weg 1", [[r]]) for k, r in houses], f"building_id int, lagebez string, geometry {geo.GEOMETRY}")
    want = {}
    for p, r in parcels:
        near = min((edge_distance(r, h), -area_of(h), b) for b, h in houses)
        if near[0] <= 100:
            want[p] = (near[2], round(near[0], 6))
    got = {r["parcel_id"]: (r["building_id"], round(r["distance"], 6)) for r in buildings.nearest_building(at, named).collect()}
    assert got == want and len(want) > 30
    # of many small buildings around an address, few can be the nearest
    close = lambda n, r: [[star(rng, n, rng.uniform(0, 300), rng.uniform(0, 300), r)]]
    at = spark.createDataFrame([(k, 0, "Weg", "1", None, close(5, 8.0)) for k in range(20)], at.schema)
    named = spark.createDataFrame([(k, "Weg 1", close(4, 5.0)) for k in range(200)], named.schema)
    assert buildings.candidate_pairs(at, named, 100.0).count() < 200
    # pairs of many edges are measured in blocks
    monkeypatch.setattr(buildings, "ROOM", 1000)
    shapes = [ring(n, 100.0) for n in (30, 80, 300, 5)]
    for p in shapes:
        for q in shapes:
            flat = [np.array([v for a, b in zip(r, r[1:]) for v in (*a, *b)]) for r in (p, q)]
            assert abs(buildings.distances([flat[0]], [flat[1]])[0] - (0 if p is q else edge_distance(p, q))) < 1e-9


def area_of(r):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2


def test_options_are_rebuilt_only_for_another_served_set(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/options"
    df = spark.createDataFrame([("1", "g"), ("2", None)], "plz string, gemeinde string")
    states = spark.createDataFrame([("a", 1, 5), ("b", 2, 0)], "source string, served_run_id int, record_count int")
    assert search.refresh_options(df, states, path) and not search.refresh_options(df, states, path)
    assert search.refresh_options(df, states.withColumn("served_run_id", F.lit(3)), path)
    assert spark.read.parquet(path).where("served = 'a=3'").count() == 3


def folded(rows, near):
    out: dict = {}
    for key, _, a, b in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2], r[3])):
        kept = out.setdefault(key, [])
        if all(abs(x - a) + abs(y - b) > near for x, y in kept):
            kept.append((a, b))
    return out


def test_crowded_keys_are_settled_without_an_array(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(200), float(rng.randrange(60)) / 2, float(rng.randrange(40)) / 2) for k in ("x", "y", None) for _ in range(300)]
    rows += [("line", n, float(n), 0.0) for n in range(12)] + [("same", n, 7.0, 7.0) for n in range(500)] + [("two", 1, 0.0, 0.0), ("two", 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "key string, ord int, a float, b float")
    want = {(k, p) for k, own in folded(rows, 3.0).items() for p in own}
    for many in (5, 1000):
        got = [(r["key"], (r["a"], r["b"])) for r in geocode.kept_points(df, 3.0, many=many).collect()]
        assert len(got) == len(want) and set(got) == want
    # equal points are aggregated before anything is gathered
    plan = geocode.kept_points(df.where("key = 'same'"), 3.0, many=5)
    assert plan.count() == 1 and {r["key"]: r["n"] for r in geocode.counted(plan).collect()} == {"same": 1}


def test_small_tiles_settle_the_same_points(spark):
    rng = random.Random(11)
    rows = [(k, rng.randrange(500), float(rng.randrange(90)) / 2, float(rng.randrange(90)) / 2) for k in ("x", None) for _ in range(700)]
    rows += [("line", n, float(n), 0.0) for n in range(150)] + [("back", -n, float(n), 1e300 if n == 7 else 0.0) for n in range(150)]
    df = spark.createDataFrame(rows, "key string, ord int, a float, b double")
    want = {(k, p) for k, own in folded(rows, 3.0).items() for p in own}
    got = [(r["key"], (r["a"], r["b"])) for r in geocode.kept_points(df, 3.0, many=5, limit=40).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_long_line_of_points_takes_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    keep = geocode.settled
    monkeypatch.setattr(geocode, "settled", lambda near: rounds.append(1) or keep(near))
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("ord"), F.col("id").cast("double").alias("a"), F.lit(0.0).alias("b"))
    got = geocode.kept_points(df, 2.5).select("a")
    assert got.count() == (n + 2) // 3 and got.where("a % 3 != 0").isEmpty() and len(rounds) <= 12


def test_points_without_coordinates_are_near_to_none(spark):
    rows = [("k", 1, None, 0.0), ("k", 2, None, 0.0), ("k", 3, float("nan"), 0.0), ("k", 4, float("inf"), 0.0), ("k", 5, float("inf"), 0.0), ("k", 6, 1.0, 1.0), ("k", 7, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, ord int, a float, b float")
    assert sorted(r["ord"] for r in geocode.kept_points(df, 3.0).collect()) == [1, 2, 3, 4, 5, 6]
    assert len(geocode.cluster_points(df, 3.0).first()["points"]) == 6
