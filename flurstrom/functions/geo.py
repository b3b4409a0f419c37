"""Column functions for planar geometry and the UTM projection.

A geometry is array<array<array<struct<x,y>>>>: parts, rings (the first is the
outline, others are holes), vertices (the last equals the first)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edges(geometry: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> over all rings."""

    def of(ring: Column) -> Column:
        n = F.size(ring) - 1
        return F.zip_with(F.slice(ring, 1, F.greatest(n, F.lit(0))), F.slice(ring, 2, F.greatest(n, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    return F.flatten(F.transform(F.flatten(geometry), of))


def level_with(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def meets(e: Column, y: Column) -> Column:
    """Where an edge meets the level line of y."""
    return F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]


def on_edge(e: Column, x: Column, y: Column) -> Column:
    flat = (e["x2"] - e["x1"]) * (y - e["y1"]) == (x - e["x1"]) * (e["y2"] - e["y1"])
    return flat & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def contains(edge: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside, not on an edge: an odd number of edges to its right."""
    right = F.filter(edge, lambda e: level_with(e, y) & (x < meets(e, y)))
    return (F.size(right) % 2 == 1) & ~F.exists(edge, lambda e: on_edge(e, x, y))


def right_of(edge: Column, inside: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside, not on an edge, given some edges and whether what lies left of them is inside."""
    left = F.filter(edge, lambda e: level_with(e, y) & ~(x < meets(e, y)))
    return ((F.size(left) + inside.cast("int")) % 2 == 1) & ~F.exists(edge, lambda e: on_edge(e, x, y))


def ring_area(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    steps = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)) / 2


def area(geometry: Column) -> Column:
    """Area of all outlines less their holes."""
    part = lambda rings: F.aggregate(F.transform(rings, lambda r, k: F.when(k == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(geometry, part), F.lit(0.0), lambda s, v: s + v)


def envelope(geometry: Column) -> Column:
    points = F.flatten(F.flatten(geometry))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def interior_point(geometry: Column) -> Column:
    """A point inside the largest part: the middle of the widest stretch that a level line cuts from it.

    The line runs halfway between the two vertex levels next to the middle of the part,
    so it meets no vertex. A part without height gives its first vertex, no geometry NULL."""
    rings = F.reduce(geometry, F.array().cast("array<array<struct<x:double,y:double>>>"), lambda best, p: F.when((F.size(best) == 0) | (area(F.array(p)) > area(F.array(best))), p).otherwise(best))
    first = F.get(F.get(rings, F.lit(0)), F.lit(0))
    one = F.array(rings)

    def inside(r: Column) -> Column:
        return let(edges(F.array(r)), lambda es: let(F.array_sort(F.array_distinct(F.flatten(F.transform(es, lambda e: F.array(e["y1"], e["y2"]))))), lambda levels: cut_at(es, levels)))

    def cut_at(es: Column, levels: Column) -> Column:
        k = F.greatest(F.floor(F.size(levels) / 2).cast("int"), F.lit(1))
        return F.when(F.size(levels) > 1, let((F.get(levels, k - 1) + F.get(levels, k)) / 2, lambda level: widest(es, level)))

    def widest(es: Column, level: Column) -> Column:
        crossed = F.filter(es, lambda e: (e["y1"] > level) != (e["y2"] > level))
        return let(F.array_sort(F.transform(crossed, lambda e: e["x1"] + F.try_divide((level - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]))), lambda cuts: middle(cuts, level))

    def middle(cuts: Column, level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.greatest(F.floor(F.size(cuts) / 2).cast("int") - 1, F.lit(0)))
        spans = F.transform(pairs, lambda j: F.struct((F.get(cuts, 2 * j + 1) - F.get(cuts, 2 * j)).alias("w"), (-F.get(cuts, 2 * j)).alias("left"), F.get(cuts, 2 * j).alias("a"), F.get(cuts, 2 * j + 1).alias("b")))
        return let(F.array_max(spans), lambda w: F.struct(((w["a"] + w["b"]) / 2).alias("x"), level.alias("y")))

    return F.coalesce(F.get(F.transform(one, inside), F.lit(0)), first)


#: GRS80 and the UTM scale.
AXIS, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Kruger's series to the fourth order, there and back.
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))


def meridian(code: Column) -> Column:
    """Central meridian of EPSG 25831, 25832 or 25833, else NULL."""
    return F.when(code.isin(25831, 25832, 25833), F.radians((code - 25831) * 6.0 + 3.0))


def atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def to_lon_lat(code: Column, x: Column, y: Column) -> Column:
    xi, eta = y / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    xi2, eta2 = xi, eta
    for k, b in enumerate(BACK, 1):
        xi2 = xi2 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta2 = eta2 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    sin_chi = F.sin(xi2) / F.cosh(eta2)
    # from conformal to geodetic latitude by fixed-point steps
    q = atanh(sin_chi)
    s = sin_chi
    for _ in range(5):
        s = F.tanh(q + ECC * atanh(ECC * s))
    return F.struct(F.degrees(meridian(code) + F.atan2(F.sinh(eta2), F.cos(xi2))).alias("lon"), F.degrees(F.asin(s)).alias("lat"))


def to_utm(code: Column, lon: Column, lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    t = F.sinh(atanh(s) - ECC * atanh(ECC * s))
    d = F.radians(lon) - meridian(code)
    xi, eta = F.atan2(t, F.cos(d)), atanh(F.sin(d) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, a in enumerate(FORWARD, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return F.struct((EAST + SCALE * RADIUS * east).alias("x"), (SCALE * RADIUS * north).alias("y"))
