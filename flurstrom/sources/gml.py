"""Feature members of GML files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from .delimited import number

TEXT = "struct<_VALUE:string>"
POS = "struct<_VALUE:string,_srsDimension:int>"
RING = f"struct<LinearRing:struct<posList:{POS}>,Ring:struct<curveMember:array<struct<LineString:struct<posList:{POS}>,Curve:struct<segments:struct<LineStringSegment:array<struct<posList:{POS}>>>>>>>>"
POLYGON = f"struct<_srsName:string,_srsDimension:int,exterior:{RING},interior:array<{RING}>>"
SURFACE = f"struct<_srsName:string,_srsDimension:int,Polygon:{POLYGON},MultiSurface:struct<_srsName:string,_srsDimension:int,surfaceMember:array<struct<Polygon:{POLYGON},Surface:struct<_srsName:string,_srsDimension:int,patches:struct<PolygonPatch:array<{POLYGON}>>>>>>,Surface:struct<_srsName:string,_srsDimension:int,patches:struct<PolygonPatch:array<{POLYGON}>>>>"
POINT = "struct<Point:struct<_srsName:string,_srsDimension:int,pos:struct<_VALUE:string>>>"


def members(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "member").option("ignoreNamespace", "true").schema(schema).load(path)


def vertices(positions: Column, dimension: Column) -> Column:
    """Vertices of a position list; of three dimensions the first two are kept."""
    parts = F.split(F.regexp_replace(positions, text.BLANK, ""), r"\s+")
    d = F.coalesce(dimension, F.lit(2))
    steps = F.sequence(F.lit(0), F.floor(F.size(parts) / d).cast("int") - 1)
    at = lambda k, o: F.get(parts, (k * d + o).cast("int")).try_cast("double")
    return F.when(F.size(parts) >= 2 * d, F.transform(steps, lambda k: F.struct(at(k, 0).alias("x"), at(k, 1).alias("y"))))


def ring_of(parts: Column) -> Column:
    """One ring of the vertex lists of its pieces, without repeated joints; NULL if it is open or has under four vertices."""
    step = lambda a, v: F.when((F.size(a) > 0) & (F.element_at(a, F.greatest(F.size(a), F.lit(1))) == v), a).otherwise(F.concat(a, F.array(v)))
    none = F.array().cast("array<struct<x:double,y:double>>")
    whole = F.aggregate(F.flatten(parts), none, step)
    return geo.let(whole, lambda r: F.when((F.size(r) >= 4) & (F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1))), r))


def ring(r: Column, dimension: Column) -> Column:
    """A ring, given as one list or as pieces of a curve."""
    own = lambda p: vertices(p["_VALUE"], F.coalesce(p["_srsDimension"], dimension))
    piece = lambda m: F.coalesce(F.transform(m["Curve"]["segments"]["LineStringSegment"], lambda s: own(s["posList"])), F.array(own(m["LineString"]["posList"])))
    lists = F.coalesce(F.flatten(F.transform(r["Ring"]["curveMember"], piece)), F.array(own(r["LinearRing"]["posList"])))
    return ring_of(F.filter(lists, lambda v: v.isNotNull()))


def polygon(p: Column, dimension: Column) -> Column:
    """Outline and holes of a polygon or patch; NULL without a valid outline."""
    d = F.coalesce(p["_srsDimension"], dimension)
    outline = ring(p["exterior"], d)
    holes = F.coalesce(F.filter(F.transform(p["interior"], lambda r: ring(r, d)), lambda r: r.isNotNull()), F.array().cast("array<array<struct<x:double,y:double>>>"))
    return F.when(outline.isNotNull(), F.concat(F.array(outline), holes))


def geometry(g: Column) -> Column:
    """Parts of a surface in any of its forms; NULL if none is valid."""
    patches = lambda s, d: F.transform(s["patches"]["PolygonPatch"], lambda p: polygon(p, F.coalesce(s["_srsDimension"], d)))
    multi = g["MultiSurface"]
    member = lambda m: F.coalesce(patches(m["Surface"], multi["_srsDimension"]), F.array(polygon(m["Polygon"], multi["_srsDimension"])))
    parts = F.coalesce(F.flatten(F.transform(multi["surfaceMember"], member)), patches(g["Surface"], F.lit(None).cast("int")), F.array(polygon(g["Polygon"], F.lit(None).cast("int"))))
    return geo.let(F.filter(parts, lambda p: p.isNotNull()), lambda ps: F.when(F.size(ps) > 0, ps))


def srs_name(g: Column) -> Column:
    return F.coalesce(g["Polygon"]["_srsName"], g["MultiSurface"]["_srsName"], g["Surface"]["_srsName"])


def parcels(spark: SparkSession, path: str, feature: str, fields: dict[str, str]) -> DataFrame:
    """parcel_id, geometry, area_m2, gemeinde and lagebez of members with a numeric area and a polygon.

    fields names the child elements of id, area, geometry and, where there are any, gemeinde and lagebez."""
    kinds = ", ".join(f"`{v}`: {SURFACE if k == 'geometry' else TEXT}" for k, v in fields.items())
    rows = members(spark, path, f"`{feature}` struct<{kinds}>")
    take = lambda k: text.blank_to_null(F.col(f"{feature}.{fields[k]}._VALUE")) if k in fields else F.lit(None).cast("string")
    shape = F.col(f"{feature}.{fields['geometry']}")
    out = rows.select(take("id").alias("parcel_id"), F.inline(F.array(F.struct(geometry(shape).alias("geometry"), srs_name(shape).alias("srs_name")))), number(take("area")).alias("area_m2"), take("gemeinde").alias("gemeinde"), take("lagebez").alias("lagebez"))
    return out.where("area_m2 IS NOT NULL AND geometry IS NOT NULL")


def buildings(spark: SparkSession, path: str, feature: str, fields: dict[str, str]) -> DataFrame:
    """building_id, geometry and lagebez of members that have both text and polygon."""
    rows = members(spark, path, f"`{feature}` struct<`{fields['id']}`: {TEXT}, `{fields['geometry']}`: {SURFACE}, `{fields['lagebez']}`: {TEXT}>")
    out = rows.select(F.col(f"{feature}.{fields['id']}._VALUE").alias("building_id"), F.inline(F.array(F.struct(geometry(F.col(f"{feature}.{fields['geometry']}")).alias("geometry")))), text.blank_to_null(F.col(f"{feature}.{fields['lagebez']}._VALUE")).alias("lagebez"))
    return out.where("geometry IS NOT NULL AND lagebez IS NOT NULL")


def flat_addresses(spark: SparkSession, path: str, feature: str, fields: dict[str, str], fixed_gemeinde: str | None = None) -> DataFrame:
    """Addresses whose fields are child elements; members without a point are left out."""
    kinds = ", ".join(f"`{v}`: {POINT if k == 'point' else TEXT}" for k, v in fields.items())
    rows = members(spark, path, f"`{feature}` struct<{kinds}>")
    take = lambda k: text.blank_to_null(F.col(f"{feature}.{fields[k]}._VALUE")) if k in fields else F.lit(None).cast("string")
    pos = F.split(F.trim(F.col(f"{feature}.{fields['point']}.Point.pos._VALUE")), r"\s+")
    gemeinde = F.coalesce(take("gemeinde"), F.lit(fixed_gemeinde))
    out = rows.select(take("id").alias("id"), F.get(pos, F.lit(0)).try_cast("double").alias("x"), F.get(pos, F.lit(1)).try_cast("double").alias("y"), take("str").alias("str"), take("hnr").alias("hnr"), take("hnr_zus").alias("hnr_zus"), text.postcode(take("plz")).alias("plz"), F.coalesce(take("ort"), gemeinde).alias("ort"), gemeinde.alias("gemeinde"))
    return out.where("x IS NOT NULL AND y IS NOT NULL")


HREF = "array<struct<_href:string>>"
ADDRESS = f"struct<_id:string,position:struct<GeographicPosition:struct<geometry:{POINT}>>,locator:struct<AddressLocator:struct<designator:array<struct<LocatorDesignator:struct<designator:{TEXT},type:struct<_href:string>>>>>>,component:{HREF}>"
NAME = f"struct<GeographicalName:struct<spelling:struct<SpellingOfName:struct<text:{TEXT}>>>>"
COMPONENT = f"ThoroughfareName struct<_id:string,name:struct<ThoroughfareNameValue:struct<name:{NAME}>>>, PostalDescriptor struct<_id:string,postName:{NAME},postCode:{TEXT}>, AdminUnitName struct<_id:string,name:{NAME},level:struct<_href:string>,code:{TEXT}>"
#: Lengths of codes by administrative level, where a unit has no code: of territorial states, and of city states.
LEVELS = {"2ndOrder": 2, "3rdOrder": 3, "4thOrder": 5, "6thOrder": 8}
CITY_LEVELS = {"2ndOrder": 8, "3rdOrder": 9, "4thOrder": 10}


def component_addresses(spark: SparkSession, path: str) -> DataFrame:
    """file, address_id, x, y, number, suffix and hrefs (of shared components) of address members with a point."""
    rows = members(spark, path, f"Address {ADDRESS}").where("Address IS NOT NULL")
    pos = F.split(F.trim(F.col("Address.position.GeographicPosition.geometry.Point.pos._VALUE")), r"\s+")
    each = F.col("Address.locator.AddressLocator.designator.LocatorDesignator")
    first = lambda test: F.get(F.filter(each, lambda d: test(d["type"]["_href"])), F.lit(0))["designator"]["_VALUE"]
    out = rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("Address._id").alias("address_id"),
        F.get(pos, F.lit(0)).try_cast("double").alias("x"),
        F.get(pos, F.lit(1)).try_cast("double").alias("y"),
        text.blank_to_null(first(lambda t: t.endswith("/addressNumber"))).alias("hnr"),
        text.blank_to_null(first(lambda t: t.contains("addressNumberExtension"))).alias("hnr_zus"),
        F.transform("Address.component._href", lambda h: F.regexp_replace(h, "^.*#", "")).alias("hrefs"),
    )
    return out.where("x IS NOT NULL AND y IS NOT NULL")


def level_length(href: Column, city_state: bool) -> Column:
    order = F.regexp_extract(href, r"(\d(?:st|nd|rd|th)Order)$", 1)
    out = F.lit(0)
    for name, n in (CITY_LEVELS if city_state else LEVELS).items():
        out = F.when(order == name, F.lit(n)).otherwise(out)
    return out


def components(spark: SparkSession, path: str, city_state: bool = False) -> DataFrame:
    """file, gml_id, kind, value, plz and length (of an administrative code) of shared components."""
    rows = members(spark, path, COMPONENT)
    said = lambda c: text.blank_to_null(F.col(f"{c}.GeographicalName.spelling.SpellingOfName.text._VALUE"))
    kind = F.when(F.col("ThoroughfareName").isNotNull(), "street").when(F.col("PostalDescriptor").isNotNull(), "post").when(F.col("AdminUnitName").isNotNull(), "admin")
    code = text.blank_to_null(F.col("AdminUnitName.code._VALUE"))
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.coalesce("ThoroughfareName._id", "PostalDescriptor._id", "AdminUnitName._id").alias("gml_id"),
        kind.alias("kind"),
        F.coalesce(said("ThoroughfareName.name.ThoroughfareNameValue.name"), said("PostalDescriptor.postName"), said("AdminUnitName.name")).alias("value"),
        text.postcode(F.col("PostalDescriptor.postCode._VALUE")).alias("plz"),
        F.coalesce(F.char_length(code), level_length(F.col("AdminUnitName.level._href"), city_state)).alias("length"),
    ).where("kind IS NOT NULL")


def resolved(addresses: DataFrame, parts: DataFrame) -> DataFrame:
    """Addresses with their street, postcode, municipality and place by way of their component references.

    Ids are unique within a file only. A dangling reference gives nothing."""
    refs = addresses.select("file", "address_id", F.posexplode_outer("hrefs").alias("pos", "gml_id"))
    met = refs.join(parts, ["file", "gml_id"])
    first = lambda c, test: F.min(F.when(test & F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v"))))["v"]
    admin = F.col("kind") == "admin"
    got = met.groupBy("file", "address_id").agg(
        first("value", F.col("kind") == "street").alias("str"),
        first("plz", F.col("kind") == "post").alias("plz"),
        first("value", F.col("kind") == "post").alias("post_name"),
        first("value", admin & (F.col("length") == 8)).alias("gemeinde"),
        F.max(F.when(admin & (F.col("length") > 8) & F.col("value").isNotNull(), F.struct("length", (-F.col("pos")).alias("p"), "value")))["value"].alias("district"),
    )
    out = addresses.join(got, ["file", "address_id"], "left")
    return out.withColumn("ort", F.coalesce("district", "post_name", "gemeinde")).drop("hrefs")
