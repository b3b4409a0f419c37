"""Queries on points, parcels and postcode areas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import quality, spatial
from .registry import query
from .views import view

CELL = 100.0


def parcels(spark, sf_dir):
    """Parcels as squares; one whose edge is below 0 holds nothing, so its square is a point."""
    v = view(spark, sf_dir, "v_parcels")
    edge = F.greatest("edge", F.lit(0.0))
    return v.withColumn("geometry", geo.rectangle(F.col("min_x"), F.col("min_y"), F.col("min_x") + edge, F.col("min_y") + edge))


def areas(spark, sf_dir):
    v = view(spark, sf_dir, "v_postcode_areas")
    return v.select("plz", geo.rectangle(F.col("min_x"), F.col("min_y"), F.col("min_x") + F.col("edge"), F.col("min_y") + F.col("edge")).alias("geometry"))


def points(spark, sf_dir):
    return view(spark, sf_dir, "v_points")


INSIDE = "p.x > s.min_x AND p.x < s.min_x + s.edge AND p.y > s.min_y AND p.y < s.min_y + s.edge"
PIP = f"(SELECT p.address_id, s.parcel_id, s.area_m2 FROM v_points p JOIN v_parcels s ON {INSIDE} QUALIFY row_number() OVER (PARTITION BY p.address_id ORDER BY s.edge * s.edge, s.parcel_id) = 1)"
AREA = f"(SELECT p.address_id, s.plz AS area_plz FROM v_points p JOIN v_postcode_areas s ON {INSIDE} QUALIFY row_number() OVER (PARTITION BY p.address_id ORDER BY s.edge * s.edge, s.plz) = 1)"


@query(f"SELECT * FROM {PIP}")
def point_in_polygon(spark, sf_dir):
    return spatial.containing(points(spark, sf_dir), parcels(spark, sf_dir), "address_id", "parcel_id", CELL, ("area_m2",))


@query(f"SELECT * FROM {PIP}")
def dealt_point_in_polygon(spark, sf_dir):
    """The same with points dealt by a quadtree, so that crowded places are many cells; points on one place, however many, are one of its points."""
    own = points(spark, sf_dir).select("address_id", "x", "y").distinct()
    places = own.groupBy("x", "y").agg(F.min("address_id").alias("place"))
    met = spatial.containing(places, parcels(spark, sf_dir), "place", "parcel_id", 1.0, ("area_m2",), limit=2000, levels=12)
    return own.join(places.join(met, "place"), ["x", "y"]).select("address_id", "parcel_id", "area_m2")


def round_areas(spark, sf_dir):
    """Areas as rings of 400 edges about the middle of each parcel, with a hole of 100 and with their tips on two circles by turns."""
    v = view(spark, sf_dir, "v_parcels").where("edge > 0")
    mid = lambda a: F.col(f"min_{a}") + F.col("edge") / 2
    tip = lambda k, n, r: F.struct((mid("x") + r * F.cos(k * (2 * math.pi / n))).alias("x"), (mid("y") + r * F.sin(k * (2 * math.pi / n))).alias("y"))
    ring = lambda n, r: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: tip(k % n, n, F.col("edge") * r(k)))
    return v.withColumn("geometry", F.array(F.array(ring(400, lambda k: F.when(k % 2 == 0, 0.5).otherwise(0.45)), ring(100, lambda k: F.lit(0.125)))))


TURN = "2 * pi() / 400"
#: A point is inside the ring if it is on the inner side of the edge over its angle, and outside the hole alike.
ROUND = f"""(SELECT address_id, parcel_id, edge FROM (SELECT p.address_id, s.parcel_id, s.edge, (p.x - (s.min_x + s.edge / 2)) / s.edge AS u, (p.y - (s.min_y + s.edge / 2)) / s.edge AS v FROM v_points p JOIN v_parcels s
    ON p.x BETWEEN s.min_x AND s.min_x + s.edge AND p.y BETWEEN s.min_y AND s.min_y + s.edge) d,
  LATERAL (SELECT CAST(floor((CASE WHEN atan2(v, u) < 0 THEN atan2(v, u) + 2 * pi() ELSE atan2(v, u) END) / ({TURN})) AS INT) AS k, CAST(floor((CASE WHEN atan2(v, u) < 0 THEN atan2(v, u) + 2 * pi() ELSE atan2(v, u) END) / (2 * pi() / 100)) AS INT) AS h) a,
  LATERAL (SELECT CASE k % 2 WHEN 0 THEN 0.5 ELSE 0.45 END AS r1, CASE k % 2 WHEN 0 THEN 0.45 ELSE 0.5 END AS r2) b
  WHERE (r2 * cos((k + 1) * {TURN}) - r1 * cos(k * {TURN})) * (v - r1 * sin(k * {TURN})) - (r2 * sin((k + 1) * {TURN}) - r1 * sin(k * {TURN})) * (u - r1 * cos(k * {TURN})) > 1e-12
    AND (cos((h + 1) * 4 * {TURN}) - cos(h * 4 * {TURN})) * (v - 0.125 * sin(h * 4 * {TURN})) - (sin((h + 1) * 4 * {TURN}) - sin(h * 4 * {TURN})) * (u - 0.125 * cos(h * 4 * {TURN})) < -1e-12)"""


@query(f"SELECT address_id, parcel_id FROM {ROUND} r QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY edge, parcel_id) = 1")
def point_in_round_area(spark, sf_dir):
    """Shapes of many edges, prepared."""
    return spatial.containing(points(spark, sf_dir), round_areas(spark, sf_dir), "address_id", "parcel_id", CELL)


@query(f"SELECT p.address_id, a.area_plz AS plz FROM v_points p LEFT JOIN {AREA} a USING (address_id)")
def postcode_lookup(spark, sf_dir):
    own = points(spark, sf_dir)
    found = spatial.containing(own, areas(spark, sf_dir), "address_id", "plz", CELL)
    return own.select("address_id").join(found, "address_id", "left")


@query(f"SELECT p.address_id, coalesce(nullif(trim(p.plz), ''), a.area_plz) AS plz, a.area_plz FROM v_points p LEFT JOIN {AREA} a USING (address_id)")
def fill_postcode(spark, sf_dir):
    return spatial.fill_postcode(points(spark, sf_dir), areas(spark, sf_dir), "address_id", CELL).select("address_id", "plz", "area_plz")


@query(f"""SELECT count(*) FILTER (p.plz IS NULL) AS missing, count(*) FILTER (p.plz IS NULL AND area_plz IS NOT NULL) AS filled,
  count(*) FILTER (p.plz IS NOT NULL) AS official, count(*) FILTER (p.plz = area_plz) AS agreeing FROM v_points p LEFT JOIN {AREA} a USING (address_id)""")
def postcode_tally(spark, sf_dir):
    return spatial.postcode_tally(spatial.fill_postcode(points(spark, sf_dir), areas(spark, sf_dir), "address_id", CELL))


@query("SELECT count(*) FILTER (x >= 0 AND x < 1000 AND y >= 0 AND y < 1000) AS owned, count(*) AS expected, count(*) FILTER (x >= 0 AND x < 1000 AND y >= 0 AND y < 1000) / count(*) AS ratio FROM v_points")
def completeness(spark, sf_dir):
    own = points(spark, sf_dir).withColumn("owned", (F.col("x") >= 0) & (F.col("x") < 1000) & (F.col("y") >= 0) & (F.col("y") < 1000))
    return quality.completeness(own, "owned")


@query(f"""WITH t AS (SELECT count(*) AS owned, count(*) FILTER (m.parcel_id IS NULL) AS unmatched, count(*) FILTER (p.plz IS NULL) AS missing, count(*) FILTER (p.plz IS NULL AND a.area_plz IS NOT NULL) AS filled
  FROM v_points p LEFT JOIN {PIP} m USING (address_id) LEFT JOIN {AREA} a USING (address_id))
SELECT *, unmatched / owned AS unmatched_ratio, filled / missing AS filled_ratio, owned > unmatched AND unmatched / owned <= 0.2 AND filled / missing >= 0.95 AS passes FROM t""")
def join_quality(spark, sf_dir):
    own = points(spark, sf_dir)
    met = spatial.containing(own, parcels(spark, sf_dir), "address_id", "parcel_id", CELL)
    filled = spatial.fill_postcode(own, areas(spark, sf_dir), "address_id", CELL).join(met, "address_id", "left")
    return quality.join_quality(filled.select(F.col("parcel_id").isNotNull().alias("matched"), F.col("own_plz").isNull().alias("needs_plz"), F.col("area_plz").isNotNull().alias("got_plz")))


@query("SELECT address_id, x, y FROM v_points WHERE x BETWEEN 100 AND 400 AND y BETWEEN 50.5 AND 700")
def bbox_query(spark, sf_dir):
    return spatial.in_box(points(spark, sf_dir), 100.0, 50.5, 400.0, 700.0).select("address_id", "x", "y")


@query("SELECT address_id, CAST(floor(x / 250) AS BIGINT) AS tile_x, CAST(floor(y / 250) AS BIGINT) AS tile_y FROM v_points")
def tile_ownership(spark, sf_dir):
    return spatial.tile_of(points(spark, sf_dir), 250.0).select("address_id", "tile_x", "tile_y")


@query("""WITH e AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_points),
t AS (SELECT *, unnest(range(0, greatest(CAST(ceil((x1 - x0) / 300) AS BIGINT), 1))) AS i FROM e), u AS (SELECT *, unnest(range(0, greatest(CAST(ceil((y1 - y0) / 300) AS BIGINT), 1))) AS j FROM t)
SELECT i, j, x0 + i * 300 AS x0, y0 + j * 300 AS y0, least(x0 + i * 300 + 300, x1) AS x1, least(y0 + j * 300 + 300, y1) AS y1 FROM u""")
def tile_grid(spark, sf_dir):
    return spatial.tiles(spatial.extent(points(spark, sf_dir)), 300.0)


@query("SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v_points")
def extent(spark, sf_dir):
    return spatial.extent(points(spark, sf_dir))


QUAD_LIMIT = 40


@query(f"""WITH c AS (SELECT address_id, l AS level, CAST(floor(x * power(2, l) / 1024) AS BIGINT) AS cx, CAST(floor(y * power(2, l) / 1024) AS BIGINT) AS cy FROM v_points, range(0, 7) r(l)),
n AS (SELECT level, cx, cy FROM c GROUP BY ALL HAVING count(*) < {QUAD_LIMIT}),
f AS (SELECT * FROM c JOIN n USING (level, cx, cy) QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY level) = 1)
SELECT p.address_id, f.level, f.cx, f.cy FROM v_points p LEFT JOIN f USING (address_id)""")
def quadtree_cells(spark, sf_dir):
    return spatial.quadtree(points(spark, sf_dir), "address_id", 1024.0, QUAD_LIMIT, 6)


@query("SELECT p.address_id, s.parcel_id FROM v_points p JOIN v_parcels s ON p.x BETWEEN s.min_x AND s.min_x + s.edge AND p.y BETWEEN s.min_y AND s.min_y + s.edge")
def box_intersect_join(spark, sf_dir):
    boxes = view(spark, sf_dir, "v_parcels").select("parcel_id", "min_x", "min_y", (F.col("min_x") + F.col("edge")).alias("max_x"), (F.col("min_y") + F.col("edge")).alias("max_y"))
    return spatial.meeting_boxes(points(spark, sf_dir), boxes, "address_id", "parcel_id", CELL)


@query("SELECT parcel_id, edge * edge AS size, min_x, min_y, min_x + edge AS max_x, min_y + edge AS max_y FROM v_parcels WHERE edge > 0")
def polygon_area(spark, sf_dir):
    return spatial.with_edges(parcels(spark, sf_dir).select("parcel_id", "geometry")).select("parcel_id", "size", "box.*")


@query("SELECT parcel_id, min_x + edge / 2 AS x, min_y + edge / 2 AS y FROM v_parcels WHERE edge > 0")
def interior_point(spark, sf_dir):
    return spatial.anchored(parcels(spark, sf_dir).where("edge > 0"), "parcel_id", 250.0).select("parcel_id", "x", "y")


@query("SELECT parcel_id, CAST(floor((min_x + edge / 2) / 250) AS BIGINT) AS tile_x, CAST(floor((min_y + edge / 2) / 250) AS BIGINT) AS tile_y FROM v_parcels WHERE edge > 0")
def anchor_ownership(spark, sf_dir):
    return spatial.anchored(parcels(spark, sf_dir).where("edge > 0"), "parcel_id", 250.0).select("parcel_id", "tile_x", "tile_y")


@query("""SELECT CAST(floor((min_x + edge / 2) / 250) AS BIGINT) AS tile_x, CAST(floor((min_y + edge / 2) / 250) AS BIGINT) AS tile_y,
  min(min_x) - 100 AS x0, min(min_y) - 100 AS y0, max(min_x + edge) + 100 AS x1, max(min_y + edge) + 100 AS y1 FROM v_parcels WHERE edge > 0 GROUP BY 1, 2""")
def envelope_expand(spark, sf_dir):
    own = parcels(spark, sf_dir).where("edge > 0")
    at = spatial.anchored(own, "parcel_id", 250.0).select("parcel_id", "tile_x", "tile_y")
    boxes = own.select("parcel_id", geo.envelope(F.col("geometry")).alias("b")).select("parcel_id", "b.*").join(at, "parcel_id")
    return spatial.fetch_boxes(boxes, 100.0)


def series_sql() -> str:
    """The inverse projection in plain SQL, from the same fixed values."""
    xi, eta = f"(n / {geo.SCALE * geo.RADIUS!r})", f"((e - {geo.EAST!r}) / {geo.SCALE * geo.RADIUS!r})"
    cosh, sinh = (lambda v: f"((exp({v}) + exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) - exp(-({v}))) / 2)")
    xi2 = xi + "".join(f" - {b!r} * sin({2 * k} * {xi}) * {cosh(f'{2 * k} * {eta}')}" for k, b in enumerate(geo.BACK, 1))
    eta2 = eta + "".join(f" - {b!r} * cos({2 * k} * {xi}) * {sinh(f'{2 * k} * {eta}')}" for k, b in enumerate(geo.BACK, 1))
    atanh = lambda v: f"(ln((1 + {v}) / (1 - {v})) / 2)"
    step = lambda s: f"tanh(q + {geo.ECC!r} * {atanh(f'({geo.ECC!r} * {s})')})"
    fix = "s0"
    out = f"WITH p AS (SELECT address_id, 25831 + address_id % 3 AS code, 300000 + x * 400 AS e, 5300000 + y * 700 AS n FROM v_points), a AS (SELECT *, {xi2} AS x2, {eta2} AS e2 FROM p), b AS (SELECT *, sin(x2) / {cosh('e2')} AS s0 FROM a), c AS (SELECT *, {atanh('s0')} AS q FROM b)"
    last = "c"
    for k in range(5):
        out += f", c{k} AS (SELECT *, {step(fix)} AS s{k + 1} FROM {last})"
        last, fix = f"c{k}", f"s{k + 1}"
    return out + f" SELECT address_id, round(degrees(radians((code - 25831) * 6 + 3) + atan2({sinh('e2')}, cos(x2))), 6) AS lon, round(degrees(asin(s5)), 6) AS lat FROM {last}"


@query(series_sql())
def reproject_points(spark, sf_dir):
    own = points(spark, sf_dir).select("address_id", (25831 + F.col("address_id") % 3).alias("code"), (300000 + F.col("x") * 400).alias("e"), (5300000 + F.col("y") * 700).alias("n"))
    return own.select("address_id", geo.to_lon_lat(F.col("code"), F.col("e"), F.col("n")).alias("p")).select("address_id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))
