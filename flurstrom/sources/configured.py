"""Sources from a configuration: JSON that names landed files, maps their elements to fields and sets the gates.

    {"sources": [{"id": "xx", "epsg": 25832,
      "parcels": {"path": "...", "feature": "Flurstueck", "fields": {"id": "oid", "area": "flaeche", "geometry": "geom"}},
      "addresses": {"kind": "flat", "path": "...", "feature": "adressen", "fields": {"id": "oid", "str": "stn", "point": "geom"}},
      "gates": {"min_completeness": 0.9}}]}

The kinds of addresses are flat (a feature with mapped fields), components (addresses that refer to shared
components), geojson, houses (delimited house coordinates) and texts (the parcels' own texts). A configuration is
checked as a whole before anything is read: ``faults`` gives one message for each fault, ``sources`` raises them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import buildings, geocode, quality, spatial
from ..operators.imports import Fetched
from . import delimited, documents, gml

SLUG, ELEMENT = re.compile("[a-z0-9-]+"), re.compile(r"[A-Za-z_][\w.-]*")
ZONES = (25831, 25832, 25833)
#: Of each mapped feature the fields it must have, and those it may have.
FIELDS = {
    "parcels": ({"id", "area", "geometry"}, {"gemeinde", "lagebez"}),
    "buildings": ({"id", "geometry", "lagebez"}, set()),
    "flat": ({"id", "point", "str", "hnr"}, {"hnr_zus", "plz", "ort", "gemeinde"}),
}
#: Of each kind of addresses its own settings, and whether each must be there.
KINDS = {
    "flat": {"path": True, "feature": True, "fields": True, "fixed_gemeinde": False},
    "components": {"path": True, "city_state": False},
    "geojson": {"path": True},
    "houses": {"path": True, "qualities": False},
    "texts": {},
}
GATES = {"min_completeness": 0.9, "max_unmatched": 0.2, "min_filled": 0.95}
TOP = {"id", "epsg", "parcels", "addresses", "buildings", "postcodes", "gates", "cell"}


class ConfigurationError(ValueError):
    """All faults of a configuration."""


def mapping_faults(own: Any, kind: str, at: str) -> list[str]:
    if not isinstance(own, dict):
        return [f"{at} must be an object"]
    out = [f"{at}.{k} is missing" for k in ("path", "feature", "fields") if not own.get(k)]
    if own.get("feature") and not ELEMENT.fullmatch(str(own["feature"])):
        out.append(f"{at}.feature is no element name: {own['feature']}")
    fields = own.get("fields") or {}
    if not isinstance(fields, dict):
        return [*out, f"{at}.fields must be an object"]
    need, may = FIELDS[kind]
    if fields:
        out += [f"{at}.fields.{k} is missing" for k in sorted(need - set(fields))]
    out += [f"{at}.fields.{k} is unknown" for k in sorted(set(fields) - need - may)]
    return out + [f"{at}.fields.{k} is no element name: {v}" for k, v in sorted(fields.items()) if not isinstance(v, str) or not ELEMENT.fullmatch(v)]


def address_faults(own: Any, at: str) -> list[str]:
    if not isinstance(own, dict) or own.get("kind") not in KINDS:
        return [f"{at}.kind must be one of {', '.join(KINDS)}"]
    may = KINDS[own["kind"]]
    out = [f"{at}.{k} is unknown for {own['kind']}" for k in sorted(set(own) - set(may) - {"kind"})]
    if own["kind"] == "flat":
        return out + mapping_faults(own, "flat", at)
    return out + [f"{at}.{k} is missing" for k, must in may.items() if must and not own.get(k)]


def faults(configuration: dict, reserved: tuple[str, ...] = ()) -> list[str]:
    """One message for each fault; none if all sources can be built."""
    own = configuration.get("sources")
    if not isinstance(own, list):
        return ["sources must be a list"]
    out, seen = [], set(reserved)
    for k, s in enumerate(own):
        if not isinstance(s, dict):
            out.append(f"sources[{k}] must be an object")
            continue
        name = s.get("id") if isinstance(s.get("id"), str) and s.get("id") else f"sources[{k}]"
        if not isinstance(s.get("id"), str) or not SLUG.fullmatch(s["id"]):
            out.append(f"{name}: id must be of a-z, 0-9 and hyphens")
        elif s["id"] in seen:
            out.append(f"{name}: id is used twice")
        seen.add(s.get("id"))
        out += [f"{name}: {key} is unknown" for key in sorted(set(s) - TOP)]
        if s.get("epsg") not in ZONES:
            out.append(f"{name}: epsg must be one of {', '.join(map(str, ZONES))}, was {s.get('epsg')}")
        out += [f"{name}: {x}" for x in mapping_faults(s.get("parcels"), "parcels", "parcels") + address_faults(s.get("addresses"), "addresses")]
        kind = s["addresses"].get("kind") if isinstance(s.get("addresses"), dict) else None
        mapped = s["parcels"].get("fields") if isinstance(s.get("parcels"), dict) else None
        if kind == "texts" and not {"lagebez", "gemeinde"} <= set(mapped or {}):
            out.append(f"{name}: addresses of kind texts need parcels.fields.lagebez and gemeinde")
        if "buildings" in s:
            out += [f"{name}: {x}" for x in mapping_faults(s["buildings"], "buildings", "buildings")]
            if kind != "texts":
                out.append(f"{name}: buildings are read with addresses of kind texts only")
        if "cell" in s and not (isinstance(s["cell"], (int, float)) and 0 < s["cell"] <= 1e6):
            out.append(f"{name}: cell must be above 0 and at most a million metres")
        gates = s.get("gates", {})
        if not isinstance(gates, dict):
            out.append(f"{name}: gates must be an object")
            continue
        out += [f"{name}: gates.{g} is unknown" for g in sorted(set(gates) - set(GATES))]
        out += [f"{name}: gates.{g} must be between 0 and 1" for g, v in sorted(gates.items()) if g in GATES and not (isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1)]
    return out


@dataclass
class Configured:
    """A source as its configuration has it: its parcels, its addresses, and the rows that both make."""

    id: str
    epsg: int
    parcels: dict
    addresses: dict
    buildings: dict | None = None
    postcodes: str | None = None
    gates: dict = field(default_factory=dict)
    cell: float = 100.0

    def gate(self, name: str) -> float:
        return self.gates.get(name, GATES[name])

    def read_parcels(self, spark: SparkSession) -> DataFrame:
        return gml.parcels(spark, self.parcels["path"], self.parcels["feature"], self.parcels["fields"])

    def read_addresses(self, spark: SparkSession) -> DataFrame:
        """str, hnr, hnr_zus, plz, ort, gemeinde, x and y, whatever the kind."""
        own, kind = self.addresses, self.addresses["kind"]
        if kind == "flat":
            rows = gml.flat_addresses(spark, own["path"], own["feature"], own["fields"], own.get("fixed_gemeinde"))
        elif kind == "components":
            rows = gml.resolved(gml.component_addresses(spark, own["path"]), gml.components(spark, own["path"], own.get("city_state", False)))
        elif kind == "geojson":
            rows = documents.addresses(spark, own["path"])
        else:
            rows = delimited.accepted(delimited.house_coordinates(spark, own["path"], zone=self.epsg - 25800, qualities=tuple(own.get("qualities", ("A", "B")))))
        return rows.select("str", "hnr", "hnr_zus", "plz", "ort", "gemeinde", "x", "y")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with x and y in the source's zone, with postcode by area where they have none, and lat and lon."""
        if self.postcodes:
            areas = documents.postcode_areas(rows.sparkSession, self.postcodes).select("plz", "geometry")
            at = rows.withColumn("p", geo.to_lon_lat(F.lit(self.epsg), F.col("x"), F.col("y"))).withColumns({"x": F.col("p.lon"), "y": F.col("p.lat")})
            rows = spatial.fill_postcode(at, areas, "row", 0.05)
        else:
            rows = rows.withColumns({"own_plz": F.nullif(F.trim("plz"), F.lit("")), "area_plz": F.lit(None).cast("string"), "p": geo.to_lon_lat(F.lit(self.epsg), F.col("x"), F.col("y"))})
        return rows.withColumns({"lat": F.col("p.lat").cast("float"), "lon": F.col("p.lon").cast("float")})

    def rows(self, spark: SparkSession, fetched: Fetched) -> DataFrame:
        """Standardized rows; the gates of the configuration go to ``fetched``."""
        parcels = self.read_parcels(spark)
        shape = ["str", "hnr", "hnr_zus", "plz", "ort", "gemeinde", "flaeche_amtl", "lat", "lon"]
        if self.addresses["kind"] == "texts":
            each = geocode.exploded(parcels).join(parcels.select("parcel_id", "gemeinde"), "parcel_id")
            houses = self.buildings and gml.buildings(spark, self.buildings["path"], self.buildings["feature"], self.buildings["fields"])
            pins = buildings.pinned(parcels, houses if houses else parcels.select(F.col("parcel_id").alias("building_id"), "geometry", "lagebez").limit(0))
            found = each.join(pins.select("parcel_id", "pos", "x", "y"), ["parcel_id", "pos"], "left").withColumns({"row": F.to_json(F.struct("parcel_id", "pos")), "plz": F.lit(None).cast("string"), "ort": F.col("gemeinde"), "flaeche_amtl": F.col("area_m2")})
            return self.placed(found).select(*shape)
        own = self.read_addresses(spark).withColumn("row", F.to_json(F.struct("x", "y", "str", "hnr", "hnr_zus")))
        met = spatial.containing(own.select("row", "x", "y"), parcels.select("parcel_id", "area_m2", "geometry"), "row", "parcel_id", self.cell, ("area_m2",))
        all_ = self.placed(own.join(met, "row", "left"))
        judged = all_.select(F.col("parcel_id").isNotNull().alias("matched"), F.col("own_plz").isNull().alias("needs_plz"), F.col("area_plz").isNotNull().alias("got_plz"))
        fetched.gates.append(("join", quality.join_quality(judged, max_unmatched=self.gate("max_unmatched"), min_filled=self.gate("min_filled") if self.postcodes else 0.0)))
        return all_.where("parcel_id IS NOT NULL").withColumnRenamed("area_m2", "flaeche_amtl").select(*shape)


def sources(text: str, reserved: tuple[str, ...] = ()) -> dict[str, Configured]:
    """The sources of a configuration by name; raises with all its faults."""
    try:
        own = json.loads(text)
    except ValueError as e:
        raise ConfigurationError(f"the configuration is no JSON: {e}") from e
    found = faults(own if isinstance(own, dict) else {}, reserved)
    if found:
        raise ConfigurationError("\n".join(found))
    return {s["id"]: Configured(**s) for s in own["sources"]}
