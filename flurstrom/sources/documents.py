"""JSON documents as tables: addresses, postcode areas, manifests and download listings; members of ZIP archives."""

from __future__ import annotations

import dataclasses
import fnmatch
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo, text

ADDRESS = "features array<struct<properties:struct<STN:string,HNR:string,ADZ:string,XCOORD:double,YCOORD:double,PLZ:string,ONM:string>>>"
AREA = "features array<struct<properties:struct<postcode:string>,geometry:struct<type:string,coordinates:string>>>"
MANIFEST = "datasets array<struct<name:string,title:string,files:array<struct<name:string,size:long,timestamp:timestamp_ntz>>>>"
LISTING = "searchresult struct<downloads:array<struct<name:string,fileExtension:string,creationDate:string,downloadLink:struct<uri:string>>>>"


#: Control characters, which JSON never has as they are: so no document holds it, and a file is one line.
NOWHERE = "\x00\x00\x01\x01"


def documents(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Files read whole, each one document; one without the field fails the job.

    With multiLine each number or list that is read as a string would be looked up in the file by a read of its own."""
    rows = spark.read.schema(schema).option("lineSep", NOWHERE).json(path)
    return rows.where(F.when(F.col(field).isNull(), F.raise_error(F.lit(f"a document has no {field}"))).otherwise(F.lit(True)))


def addresses(spark: SparkSession, path: str, zone_prefix: float = 32_000_000.0) -> DataFrame:
    """House addresses of GeoJSON features; those without coordinates are left out. The place is also the municipality."""
    return located(features(spark, path, zone_prefix))


def features(spark: SparkSession, path: str, zone_prefix: float = 32_000_000.0) -> DataFrame:
    """A row for each feature, with coordinates or not."""
    p = documents(spark, path, ADDRESS, "features").select(F.explode("features.properties").alias("p"))
    take = lambda c: text.blank_to_null(F.col(f"p.{c}"))
    return p.select(take("STN").alias("str"), take("HNR").alias("hnr"), take("ADZ").alias("hnr_zus"), text.postcode(take("PLZ")).alias("plz"), take("ONM").alias("ort"), take("ONM").alias("gemeinde"), (F.col("p.XCOORD") - zone_prefix).alias("x"), F.col("p.YCOORD").alias("y"))


def located(rows: DataFrame) -> DataFrame:
    return rows.where("x IS NOT NULL AND y IS NOT NULL")


def feature_tally(rows: DataFrame) -> DataFrame:
    """Features delivered, and those skipped for want of coordinates: both count where a page's fullness is judged."""
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.agg(F.count("*").alias("members"), F.count_if(~placed).alias("skipped"))


def lon_lat_box(spark: SparkSession, epsg: int, box: tuple[float, float, float, float], margin: float = 0.1) -> tuple[float, float, float, float]:
    """The box in degrees that holds the corners of a UTM box, with a margin."""
    x0, y0, x1, y1 = box
    corners = spark.createDataFrame([(x, y) for x in (x0, x1) for y in (y0, y1)], "x double, y double")
    p = corners.select(geo.to_lon_lat(F.lit(epsg), F.col("x"), F.col("y")).alias("p"))
    lon, lat = F.col("p.lon"), F.col("p.lat")
    r = p.agg(F.min(lon) - margin, F.min(lat) - margin, F.max(lon) + margin, F.max(lat) + margin).first()
    if r[0] is None:
        raise ValueError(f"EPSG {epsg} is no UTM zone that can be reprojected")
    return tuple(r)


def postcode_areas(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, margin: float = 0.1, epsg: int | None = None) -> DataFrame:
    """plz, geometry, envelope and size of areas with a five-digit postcode whose envelope meets the box and its margin.

    The box is in degrees, or with epsg in that UTM zone, whose corners are reprojected."""
    f = documents(spark, path, AREA, "features").select(F.explode("features").alias("f")).select(text.postcode(F.col("f.properties.postcode")).alias("plz"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    rings = lambda parts: F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))))
    one = F.array(F.from_json("c", "array<array<array<double>>>"))
    many = F.from_json("c", "array<array<array<array<double>>>>")
    shape = F.when(F.col("type") == "Polygon", rings(one)).when(F.col("type") == "MultiPolygon", rings(many))
    out = f.where("plz IS NOT NULL").select("plz", F.inline(F.array(F.struct(shape.alias("geometry")))))
    out = out.where("geometry IS NOT NULL").select("plz", "geometry", geo.envelope(F.col("geometry")).alias("box"), geo.area(F.col("geometry")).alias("size"))
    if box:
        x0, y0, x1, y1 = lon_lat_box(spark, epsg, box, margin) if epsg else (box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin)
        out = out.where((F.col("box.min_x") <= x1) & (F.col("box.max_x") >= x0) & (F.col("box.min_y") <= y1) & (F.col("box.max_y") >= y0))
    return out


def latest_edition(spark: SparkSession, path: str) -> DataFrame:
    """The newest file of each dataset, in whatever manifests, and its stamp; of equal times the first of the first manifest by path.

    A dataset without files in any manifest fails the job."""
    d = documents(spark, path, MANIFEST, "datasets").select(F.col("_metadata.file_path").alias("path"), F.posexplode("datasets").alias("set", "d")).select("path", "set", "d.name", F.posexplode_outer("d.files").alias("pos", "f"))
    files = d.select(F.col("name").alias("dataset"), F.struct("path", "set", "pos").alias("pos"), F.col("f.name").alias("file"), F.col("f.timestamp").alias("at"), F.col("f").isNotNull().alias("some"))
    top = newest(files, "dataset", F.col("some").desc())
    return top.where(F.when(F.col("file").isNull(), F.raise_error(F.concat(F.lit("dataset without files: "), "dataset"))).otherwise(F.lit(True)))


def newest(files: DataFrame, key: str, *before: Column) -> DataFrame:
    rank = Window.partitionBy(key).orderBy(*before, F.col("at").desc_nulls_last(), F.col("pos").asc())
    top = files.withColumn("rn", F.row_number().over(rank)).where("rn = 1")
    return top.select(key, "file", F.concat("file", F.lit("@"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).alias("stamp"))


def latest_listing_entry(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """The newest ZIP of each listing by day, then by name; an unreadable day is the oldest."""
    rows = documents(spark, path, LISTING, "searchresult").select((F.col("_metadata.file_name") if key is None else key).alias("listing"), F.explode("searchresult.downloads").alias("d"))
    rows = rows.select("listing", "d.name", F.col("d.creationDate").alias("day"), F.col("d.downloadLink.uri").alias("uri"), F.upper("d.fileExtension").alias("kind")).where("kind = 'ZIP' AND name IS NOT NULL AND day IS NOT NULL AND uri IS NOT NULL")
    when = F.try_to_date("day", "dd.MM.yyyy")
    rank = Window.partitionBy("listing").orderBy(when.desc_nulls_last(), F.col("name").desc())
    return rows.withColumn("rn", F.row_number().over(rank)).where("rn = 1").select("listing", "uri", F.concat("name", F.lit("|"), "day").alias("version"))


MEMBER = "archive string, member string, first long, size long"


def archive_members(spark: SparkSession, path: str, pattern: str, only_one: bool = False) -> DataFrame:
    """archive, member, first (where its bytes begin) and size of the members whose name fits the pattern, from the archives' directories.

    only_one: an archive without exactly one such member fails the job."""

    def of(batches):
        for batch in batches:
            for name in batch["path"]:
                with opened(name) as raw, zipfile.ZipFile(raw) as z:
                    own = [m for m in z.infolist() if not m.is_dir() and fnmatch.fnmatchcase(m.filename.rsplit("/", 1)[-1].lower(), pattern.lower())]
                    if only_one and len(own) != 1:
                        raise ValueError(f"{name}: {len(own)} members fit {pattern}")
                    yield pd.DataFrame([(name, m.filename, m.header_offset, m.compress_size) for m in own], columns=["archive", "member", "first", "size"])

    files = spark.read.format("binaryFile").load(path).select("path")  # the content isn't read
    return files.repartition(max(1, len(files.inputFiles()))).mapInPandas(of, MEMBER)


def opened(name: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
    return store.open_input_file(at)


class MemberLines(DataSource):
    """Lines of archive members, a partition for each of the portions into which members are dealt by their size."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, line string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(json.loads(self.options["members"]))


@dataclasses.dataclass
class Portion(InputPartition):
    members: list[tuple[str, str]]


class MemberReader(DataSourceReader):
    def __init__(self, portions: list[list[tuple[str, str]]]):
        self.portions = portions

    def partitions(self) -> list[InputPartition]:
        return [Portion(p) for p in self.portions]

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        for name, member in partition.members:
            with opened(name) as raw, zipfile.ZipFile(raw) as z, z.open(member) as f:
                lines = io.TextIOWrapper(f, "utf-8-sig", errors="replace")
                while some := [v.rstrip("\r\n") for v in itertools.islice(lines, 20_000)]:
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([member] * n), pa.array(some)], names=["archive", "member", "line"])


def zip_lines(spark: SparkSession, path: str, pattern: str, only_one: bool = False, portion: int = 64 << 20) -> DataFrame:
    """archive, member and line of the members whose name fits the pattern.

    Members are dealt to partitions of about so many compressed bytes, whatever archive they are in; a task opens
    its members as streams and sends their lines in portions, so a member of any size needs the memory of one.
    only_one: an archive without exactly one such member fails the job."""
    own = archive_members(spark, path, pattern, only_one).orderBy("archive", "first").collect()  # a row for each member
    portions: list[list[tuple[str, str]]] = [[]]
    held = 0
    for m in own:
        if portions[-1] and held + m["size"] > portion:
            portions.append([])
            held = 0
        portions[-1].append((m["archive"], m["member"]))
        held += m["size"]
    spark.dataSource.register(MemberLines)
    return spark.read.format("archive_members").option("members", json.dumps(portions)).load()
