"""Files of the landed shapes, and streams against their batch twins."""

import datetime as dt
import glob
import json
import os
import random
import tempfile
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from flurstrom.functions import geo
from flurstrom.operators import geocode, publish
from flurstrom.operators.imports import Fetched
from flurstrom.plans import QUERIES, files
from flurstrom.sources import configured, delimited, documents, gml
from flurstrom.streaming import usage


def put(name, body):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
    return path


def test_house_coordinates_in_both_dialects(spark):
    a = put("a.txt", "﻿nba;qua;gmd;ott;str;hnr;adz;zone;ostwert;nordwert;postplz\nn;A;Stadt;Ort;Weg;1;a;32;400000.5;5700000;12345\n\nn;c;Stadt;;Weg;2;;32;x;y;\nn;B;Stadt;Dorf Bezirk 3;Weg;3;;;400001;5700001;12\nn;A;Stadt;;Weg;4;;32;NaN;1;\nn;A;short\n")
    rows = delimited.house_coordinates(spark, a)
    assert tuple(delimited.read_tally(rows).collect()[0]) == (5, 2, 1, 2)
    got = {r["hnr"]: r for r in delimited.accepted(rows).collect()}
    assert got["1"]["plz"] == "12345" and got["3"]["plz"] is None and got["3"]["ort"] == "Stadt" and got["1"]["ort"] == "Ort"
    b = put("b.txt", '"qua","gmd","str","hnr","ostwert","nordwert"\r\n"A","S, Neu","Weg","7","1.5","2.5"\r\n')
    assert [(r["gemeinde"], r["x"]) for r in delimited.accepted(delimited.house_coordinates(spark, b)).collect()] == [("S, Neu", 1.5)]
    with pytest.raises(Exception, match="no header"):
        delimited.house_coordinates(spark, put("c.txt", "qua;ostwert\nA;1\n")).collect()


def test_house_files_of_different_layouts_in_one_folder(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    for name, body in (("a.txt", "qua;gmd;str;hnr;ostwert;nordwert;ott;zone\nA;Pirna, Stadt;Weg;1;1;2;Copitz, Stadt;32\n"), ("b.txt", '"nordwert"|"ostwert"|"hnr"|"str"|"gmd"|"qua"|"postplz"\n2|1|2|"A|B"|Stadt Wehlen|B|01829\n')):
        with open(f"{top}/{name}", "w", encoding="utf-8") as f:
            f.write(body)
    got = delimited.house_coordinates(spark, top)
    assert tuple(delimited.read_tally(got).collect()[0]) == (2, 2, 0, 0)
    assert sorted((r["hnr"], r["str"], r["ort"], r["gemeinde"], r["plz"], r["x"], r["y"]) for r in got.collect()) == [("1", "Weg", "Copitz", "Pirna", None, 1.0, 2.0), ("2", "A|B", "Wehlen", "Wehlen", "01829", 1.0, 2.0)]
    for zone in ("33", "3x"):
        with pytest.raises(Exception, match="UTM zone"):
            delimited.house_coordinates(spark, put("z.txt", f"qua;gmd;str;hnr;ostwert;nordwert;zone\nA;O;Weg;1;1;2;{zone}\n")).collect()
    # what isn't accepted isn't asked for its zone
    assert delimited.house_coordinates(spark, put("z.txt", "qua;gmd;str;hnr;ostwert;nordwert;zone\nC;O;Weg;1;1;2;33\nA;O;Weg;1;NaN;2;33\n")).count() == 2


def test_fields_of_wide_and_quoted_lines(spark):
    lines = [";".join(map(str, range(200))), "", ";", '"a;""b""";c', '"open;x', 'x"y;"";"z"']
    got = [r["f"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, v string").orderBy("k").select(delimited.fields(F.col("v")).alias("f")).collect()]
    assert got == [list(map(str, range(200))), [""], ["", ""], ['a;"b"', "c"], ['"open', "x"], ['x"y', "", "z"]]


def test_bulk_file_with_quoted_separators(spark):
    line = '1;a;b;"Text ""x""; more";Weg;5;;12345;Ort;Stadt;;;;;;;12.5'
    got = delimited.bulk(spark, put("b.csv", "header;;\n" + line + "\n" + line.replace(";5;", ";;") + "\n1;2\n")).collect()
    assert len(got) == 1 and got[0]["lagebez"] == 'Text "x"; more' and got[0]["flaeche_amtl"] == 12.5


MEMBER = """<wfs:member><x:P><x:id>1</x:id><x:area uom="m2">12.5</x:area><x:geom>{}</x:geom></x:P></wfs:member>"""


def test_parcel_geometries(spark):
    ring = "<gml:exterior><gml:LinearRing><gml:posList{}>{}</gml:posList></gml:LinearRing></gml:exterior>"
    flat = "0 0 4 0 4 4 0 4 0 0"
    shapes = [
        f"<gml:Polygon>{ring.format('', flat)}</gml:Polygon>",
        f"<gml:Polygon>{ring.format(' srsDimension=\"3\"', '0 0 9 4 0 9 4 4 9 0 4 9 0 0 9')}</gml:Polygon>",
        f"<gml:MultiSurface><gml:surfaceMember><gml:Surface><gml:patches><gml:PolygonPatch>{ring.format('', flat)}</gml:PolygonPatch></gml:patches></gml:Surface></gml:surfaceMember></gml:MultiSurface>",
        "<gml:Polygon><gml:exterior><gml:Ring><gml:curveMember><gml:LineString><gml:posList>0 0 4 0 4 4</gml:posList></gml:LineString></gml:curveMember><gml:curveMember><gml:LineString><gml:posList>4 4 0 4 0 0</gml:posList></gml:LineString></gml:curveMember></gml:Ring></gml:exterior></gml:Polygon>",
        f"<gml:Polygon>{ring.format('', '0 0 4 0 4 4')}</gml:Polygon>",
    ]
    body = '<wfs:FeatureCollection xmlns:wfs="w" xmlns:gml="g" xmlns:x="x">' + "".join(MEMBER.format(s) for s in shapes) + MEMBER.format(shapes[0]).replace("12.5", "n/a") + "</wfs:FeatureCollection>"
    got = gml.parcels(spark, put("p.gml", body), "P", {"id": "id", "area": "area", "geometry": "geom"})
    assert [r[0] for r in got.select(geo.area(F.col("geometry"))).collect()] == [16.0] * 4


def test_zip_members(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    with zipfile.ZipFile(f"{top}/a.zip", "w") as z:
        z.writestr("data/One.CSV", "x\ny\n")
        z.writestr("two.txt", "z\n")
    assert sorted(r["line"] for r in documents.zip_lines(spark, top, "*.csv").collect()) == ["x", "y"]
    assert documents.zip_lines(spark, top, "*.csv", only_one=True).count() == 2
    with pytest.raises(Exception, match="members fit"):
        documents.zip_lines(spark, top, "*.pdf", only_one=True).count()


def test_document_without_features_fails(spark):
    with pytest.raises(Exception, match="features"):
        documents.addresses(spark, put("x.json", "{}")).collect()


def events(spark, n=3000):
    rng = random.Random(8)
    rows = [(k, rng.randrange(5), float(rng.randrange(4000)), rng.choice([*usage.KINDS, None])) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s double, kind string")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_704_000_000) + F.col("s") * 60).cast("timestamp_ntz")).drop("s").withColumn("props", F.lit('{"k": 1}'))


def test_daily_counters_stream_equals_batch(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    e = events(spark)
    e.repartition(3).write.parquet(f"{top}/landed")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/landed")
    usage.write_daily(stream, f"{top}/daily", f"{top}/cp").awaitTermination()
    want = sorted(tuple(r) for r in usage.daily(e).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{top}/daily").select("day", *usage.KINDS).collect()) == want
    usage.ingest(spark, f"{top}/landed", e.schema, f"{top}/staged", f"{top}/cp2").awaitTermination()
    assert spark.read.parquet(f"{top}/staged").count() == e.count()


def test_late_events_count_and_replays_change_nothing(spark, monkeypatch):
    top = tempfile.mkdtemp(prefix="spark-")
    e = events(spark)
    old = e.limit(7).withColumns({"kind": F.lit("searches"), "ts": F.expr("ts - INTERVAL 3 DAYS")})
    e.coalesce(1).write.mode("append").parquet(f"{top}/landed")
    run = lambda: usage.write_daily(spark.readStream.schema(e.schema).parquet(f"{top}/landed"), f"{top}/daily", f"{top}/cp").awaitTermination()
    got = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{top}/daily").select("day", *usage.KINDS).collect())
    run()
    assert got() == sorted(tuple(r) for r in usage.daily(e).collect())
    old.coalesce(1).write.mode("append").parquet(f"{top}/landed")
    run()
    want = sorted(tuple(r) for r in usage.daily(e.unionByName(old)).collect())
    assert got() == want
    os.remove(f"{top}/cp/commits/1")  # as if the driver was lost before the last batch was committed
    for crc in glob.glob(f"{top}/cp/commits/.1.crc"):
        os.remove(crc)
    run()
    assert got() == want


def test_a_staged_import_is_served_once_and_only_at_its_end(spark, monkeypatch):
    top, day = tempfile.mkdtemp(prefix="spark-"), dt.datetime(2024, 1, 1)
    e = events(spark).select("event_id", "user_id")
    store = publish.Store(f"{top}/store")
    publish.replace(spark, store, publish.start(spark, store, "u", "v0", "Initial", day), e.limit(10), day)
    e.repartition(3).write.parquet(f"{top}/landed")
    run = publish.start(spark, store, "u", "v1", "Changed", day)
    with monkeypatch.context() as m:  # the driver is lost behind the stream's end
        m.setattr(publish, "replace", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            usage.staged_import(spark, store, run, f"{top}/landed", e.schema, day)
    assert publish.served(spark, store).count() == 10
    usage.staged_import(spark, store, run, f"{top}/landed", e.schema, day)
    assert sorted(r["event_id"] for r in publish.served(spark, store).collect()) == sorted(r["event_id"] for r in e.collect())
    assert not os.path.exists(f"{store.staging}/u-{run.run_id}")


def test_admission_forgets_quiet_users(spark):
    """Two users over several batches: the one that falls quiet has no state left; labels are those of the batch job."""
    top = tempfile.mkdtemp(prefix="spark-")
    base = dt.datetime(2024, 1, 1)
    steps = [[(1, 7, 0), *((10 + k, 8, k) for k in range(30))], [(2, 8, 3 * 3600)], [(3, 8, 6 * 3600), (4, 8, 6 * 3600 + 1)]]
    rows = []
    seen = []
    for step in steps:
        own = [(k, u, base + dt.timedelta(seconds=s)) for k, u, s in step]
        rows += own
        spark.createDataFrame(own, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{top}/landed")
        out = usage.admission_stream(spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz").parquet(f"{top}/landed"))
        out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/cp").trigger(availableNow=True).start().awaitTermination()
        kept = spark.read.format("statestore").option("path", f"{top}/cp").option("stateVarName", "times").load()
        seen.append({r["key"]["user_id"] for r in kept.collect()})
    want = {r["event_id"]: r["admitted"] for r in usage.admission_labels(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")).collect()}
    assert {r["event_id"]: r["admitted"] for r in spark.read.parquet(f"{top}/out").collect()} == want and sum(want.values()) == 24
    assert seen[0] == {7, 8} and 7 not in seen[1]


def test_admission_equals_a_loop_in_batch_and_stream(spark):
    odd = spark.createDataFrame([(9000, None, None), (9001, 3, None)], "event_id long, user_id long, ts timestamp_ntz")
    e = events(spark, 1500).withColumn("ts", F.timestamp_seconds(F.lit(1_704_000_000) + F.pmod(F.xxhash64("event_id"), F.lit(900))).cast("timestamp_ntz"))
    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in e.collect())
    state, want = {}, {}
    for u, t, k in rows:
        own = state.setdefault(u, deque())
        while own and (t - own[0]).total_seconds() >= 60:
            own.popleft()
        want[k] = len(own) < 20
        if want[k]:
            own.append(t)
    assert {r["event_id"]: r["admitted"] for r in usage.admission_labels(e).collect()} == want and not all(want.values())
    e, want = e.select("event_id", "user_id", "ts").unionByName(odd), want | {9000: None, 9001: None}
    assert {r["event_id"]: r["admitted"] for r in usage.admission_labels(e).collect()} == want
    top = tempfile.mkdtemp(prefix="spark-")
    e.coalesce(1).write.parquet(f"{top}/landed")
    q = usage.admission_stream(spark.readStream.schema(e.schema).parquet(f"{top}/landed")).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["admitted"] for r in spark.read.parquet(f"{top}/out").collect()} == want


GOOD = {"id": "hb", "epsg": 25832, "parcels": {"path": "p", "feature": "F", "fields": {"id": "i", "area": "a", "geometry": "g"}}, "addresses": {"kind": "geojson", "path": "q"}, "gates": {"max_unmatched": 0.5}}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"id": "Hb"}, "Hb: id must be of a-z, 0-9 and hyphens"),
        ({"id": "taken"}, "taken: id is used twice"),
        ({"epsg": 4326}, "hb: epsg must be one of 25831, 25832, 25833, was 4326"),
        ({"colour": 1}, "hb: colour is unknown"),
        ({"parcels": {"path": "p", "feature": "F", "fields": {"id": "i", "geometry": "g"}}}, "hb: parcels.fields.area is missing"),
        ({"parcels": {"path": "p", "feature": "F F", "fields": {"id": "i", "area": "a", "geometry": "g"}}}, "hb: parcels.feature is no element name: F F"),
        ({"parcels": {"path": "p", "feature": "F", "fields": {"id": "i", "area": "a", "geometry": "g", "x": "y"}}}, "hb: parcels.fields.x is unknown"),
        ({"parcels": {"path": "p", "feature": "F", "fields": {"id": "i", "area": "2a", "geometry": "g"}}}, "hb: parcels.fields.area is no element name: 2a"),
        ({"addresses": {"kind": "wfs"}}, "hb: addresses.kind must be one of flat, components, geojson, houses, texts"),
        ({"addresses": {"kind": "houses"}}, "hb: addresses.path is missing"),
        ({"addresses": {"kind": "geojson", "path": "q", "zone": 1}}, "hb: addresses.zone is unknown for geojson"),
        ({"addresses": {"kind": "texts"}}, "hb: addresses of kind texts need parcels.fields.lagebez and gemeinde"),
        ({"buildings": {"path": "b", "feature": "B", "fields": {"id": "i", "geometry": "g", "lagebez": "l"}}}, "hb: buildings are read with addresses of kind texts only"),
        ({"gates": {"max_unmatched": 1.5}}, "hb: gates.max_unmatched must be between 0 and 1"),
        ({"gates": {"most": 1}}, "hb: gates.most is unknown"),
        ({"cell": 0}, "hb: cell must be above 0 and at most a million metres"),
    ],
)
def test_each_fault_of_a_configuration_has_one_message(change, message):
    assert configured.faults({"sources": [GOOD]}) == []
    assert configured.faults({"sources": [GOOD | change]}, ("taken",)) == [message]
    with pytest.raises(configured.ConfigurationError, match="no JSON"):
        configured.sources("{")
    with pytest.raises(configured.ConfigurationError, match="used twice"):
        configured.sources(json.dumps({"sources": [GOOD, GOOD]}))


def test_configured_sources_give_the_rows_of_their_mappings(spark):
    """All kinds of addresses that need no XML of their own, through a configuration and through the readers."""
    sf = "/root/testdata/sf0.001"
    parcels = {"path": files.landed_parcels(spark, sf), "feature": "Flurstueck", "fields": files.FIELDS}
    own = lambda addresses, **more: configured.sources(json.dumps({"sources": [{"id": "x", "epsg": 25832, "parcels": parcels, "addresses": addresses, **more}]}))["x"]
    path = files.landed_geojson(spark, sf)
    geojson = own({"kind": "geojson", "path": path})
    assert sorted(map(repr, geojson.read_addresses(spark).collect())) == sorted(map(repr, documents.addresses(spark, path).select("str", "hnr", "hnr_zus", "plz", "ort", "gemeinde", "x", "y").collect()))
    fetched = Fetched()
    assert geojson.rows(spark, fetched).where("flaeche_amtl IS NULL OR lat IS NULL").isEmpty() and [n for n, _ in fetched.gates] == ["join"]
    texts = own({"kind": "texts"}, buildings={"path": parcels["path"], "feature": "Flurstueck", "fields": {"id": "oid", "geometry": "geometrie", "lagebez": "lagebeztxt"}})
    got = texts.rows(spark, Fetched())
    assert got.count() == geocode.exploded(texts.read_parcels(spark)).count() and {r["str"] for r in got.collect()} == {"Am Tor"} and got.where("lat IS NULL").isEmpty()


def test_the_box_of_a_zone_is_reprojected_and_editions_need_files(spark):
    square_ = lambda x, y: {"type": "Polygon", "coordinates": [[[x, y], [x + 0.05, y], [x + 0.05, y + 0.05], [x, y + 0.05], [x, y]]]}
    body = json.dumps({"features": [{"properties": {"postcode": c}, "geometry": square_(x, y)} for c, x, y in (("10001", 9.0, 52.0), ("10002", 9.6, 52.0), ("10003", 9.0, 53.0))]})
    path = put("areas.json", body)
    corner = geo.to_utm(F.lit(25832), F.lit(9.0), F.lit(52.0))
    x, y = spark.range(1).select(corner.alias("p")).select("p.x", "p.y").first()
    kept = lambda **more: sorted(r["plz"] for r in documents.postcode_areas(spark, path, (x, y, x + 1000, y + 1000), **more).collect())
    assert kept(epsg=25832) == ["10001"] and kept(epsg=25832, margin=0.7) == ["10001", "10002"]
    with pytest.raises(ValueError):
        kept(epsg=4326)
    top = tempfile.mkdtemp(prefix="spark-")
    for k, files_ in enumerate(([], [{"name": "a", "timestamp": "2024-01-01T00:00:00"}])):
        with open(f"{top}/{k}.json", "w", encoding="utf-8") as f:
            f.write(json.dumps({"datasets": [{"name": "d", "files": files_}]}))
    assert [r["file"] for r in documents.latest_edition(spark, top).collect()] == ["a"]
    with pytest.raises(Exception, match="dataset without files: e"):
        documents.latest_edition(spark, put("m.json", '{"datasets":[{"name":"e","files":[]}]}')).collect()


def test_members_of_one_archive_are_dealt_to_many_tasks(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    with zipfile.ZipFile(f"{top}/one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(40):
            z.writestr(f"part{k}.csv", "".join(f"{k};{n}\n" for n in range(50)))
        z.writestr("read.txt", "no")
    got = documents.zip_lines(spark, top, "*.CSV", portion=200)
    assert got.rdd.getNumPartitions() > 5 and got.count() == 2000 and got.select("member").distinct().count() == 40
    assert documents.zip_lines(spark, top, "*.pdf").count() == 0


def test_landed_documents_grow_in_number_not_in_size(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    names = ("resolve_components", "admin_unit_pick", "ingest_geojson_addresses", "latest_edition", "latest_listing_entry")
    rows = lambda: {n: sorted(map(repr, QUERIES[n](spark, sf).collect())) for n in names}
    want = rows()
    paths = []
    land = files.land_documents
    monkeypatch.setattr(files, "land_documents", lambda df, name, *more: paths.append((name, land(df, name, *more))) or paths[-1][1])
    monkeypatch.setattr(files, "EACH", 10)
    assert rows() == want and len(paths) == len(names)
    entry = {"components": "<ad:Address ", "geojson": '"properties"', "manifests": '"timestamp"', "listings": '"downloadLink"'}
    for name, path in paths:
        texts = [r["value"] for r in spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).collect()]
        sizes = [t.count(entry[name]) for t in texts]
        assert len(sizes) > 10 and max(sizes) <= (50 * 10 if name == "manifests" else 40), (name, sizes)


def test_documents_are_read_once_and_as_they_are(spark):
    body = json.dumps({"features": [{"properties": {"STN": "Weg", "HNR": k, "XCOORD": 32_000_000.0 + k, "YCOORD": 1.0, "PLZ": 10_000}} for k in range(5000)]}, indent=1)
    path = put("a.json", body)
    seen = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    began = seen()
    got = documents.feature_tally(documents.features(spark, path)).collect()[0]
    assert tuple(got) == (5000, 0) and seen() - began < 3 * len(body)
    odd = put("b.json", '\ufeff[{"features": [{"properties":\n\n{"HNR": 1.50, "PLZ": "01234", "XCOORD": 1, "YCOORD": 2}}]},\r\n{"features": []}]\n\n')
    assert [(r["hnr"], r["plz"]) for r in documents.addresses(spark, odd).collect()] == [("1.50", "01234")]


def test_manifests_of_one_dataset(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    one = lambda *f: '{"datasets":[{"name":"d","files":[' + ",".join(f'{{"name":"{n}","timestamp":"{t}"}}' for n, t in f) + "]}]}"
    for k, body in enumerate([one(("a", "2024-01-01T00:00:00"), ("b", "2024-01-03T00:00:00")), one(("c", "2024-01-03T00:00:00"), ("e", "2024-01-02T00:00:00"))]):
        with open(f"{top}/{k}.json", "w", encoding="utf-8") as f:
            f.write(body)
    assert [tuple(r) for r in documents.latest_edition(spark, top).collect()] == [("d", "b", "b@2024-01-03T00:00:00")]
