"""Pins of addresses named in parcel texts: the parcel's own point, or the nearest building that names the address."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from .spatial import level_of
from .storage import stored

REACH = 100.0


#: Numbers that one step of a batch's distances may hold, about.
ROOM = 2_000_000


def inside(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point lies in its shape (pairs, edges, 4)."""
    x1, y1, x2, y2 = np.moveaxis(e, 2, 0)
    x, y = x[:, None], y[:, None]
    cut = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (cut & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum(1) % 2 == 1


def to_edges(e: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The least distance of any of a pair's points (pairs, points, 2) to any of its edges (pairs, edges, 4)."""
    a, d = e[:, None, :, :2], (e[..., 2:] - e[..., :2])[:, None]
    p = points[:, :, None, :]
    length = (d * d).sum(3)
    t = np.clip(((p - a) * d).sum(3) / np.where(length > 0, length, 1), 0, 1)
    return np.sqrt(((p - a - t[..., None] * d) ** 2).sum(3).min((1, 2)))


def crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an edge of one shape crosses one of the other, pair by pair."""

    def side(e: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sign((e[:, :, None, 2] - e[:, :, None, 0]) * (p[:, None, :, 1] - e[:, :, None, 1]) - (e[:, :, None, 3] - e[:, :, None, 1]) * (p[:, None, :, 0] - e[:, :, None, 0]))

    apart = lambda e, f: side(e, f[..., :2]) * side(e, f[..., 2:]) < 0
    return (apart(a, b) & apart(b, a).transpose(0, 2, 1)).any((1, 2))


def near_edges(e: np.ndarray, other: np.ndarray, most: float) -> np.ndarray:
    """The edges (edges, 4) whose boxes come as near as most to the other shape's box."""
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    box = other.reshape(-1, 2)
    gap = np.maximum(np.maximum(low - box.max(0), box.min(0) - high), 0)
    return e[np.hypot(*gap.T) <= most]


def long_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two shapes of many edges: those too far from the other shape are left out, the others meet in blocks of ROOM numbers."""
    if inside(a[None], *b[:1, :2].T)[0] or inside(b[None], *a[:1, :2].T)[0]:
        return 0.0
    # no more than between some of their vertices
    some = [e[:: max(1, len(e) // 64), :2] for e in (a, b)]
    best = float(np.hypot(*np.moveaxis(some[0][:, None] - some[1], 2, 0)).min())
    a, b = near_edges(a, b, best), near_edges(b, a, best)
    step = max(1, int((ROOM / 8) ** 0.5))
    for i in range(0, len(a), step):
        for j in range(0, len(b), step):
            x, y = a[None, i : i + step], b[None, j : j + step]
            if crossing(x, y)[0]:
                return 0.0
            best = min(best, float(to_edges(x, y[..., :2])[0]), float(to_edges(x, y[..., 2:])[0]), float(to_edges(y, x[..., :2])[0]), float(to_edges(y, x[..., 2:])[0]))
    return best


def distances(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Distance of the shapes of each pair, given as edges (x1, y1, x2, y2 and so on), all pairs of like sizes at once."""
    sizes = np.array([(len(x) // 4, len(y) // 4) for x, y in zip(xs, ys)], int).reshape(-1, 2)
    out = np.full(len(xs), np.nan)
    for n, m in np.unique(sizes, axis=0):
        own = np.flatnonzero((sizes == (n, m)).all(1))
        if n and m and 4 * n * m > ROOM:
            for i in own:
                out[i] = long_distance(xs[i].reshape(-1, 4), ys[i].reshape(-1, 4))
        elif n and m:
            step = int(ROOM // (4 * n * m))
            for k in range(0, len(own), step):
                at = own[k : k + step]
                a, b = np.stack([xs[i] for i in at]).reshape(-1, n, 4), np.stack([ys[i] for i in at]).reshape(-1, m, 4)
                meet = crossing(a, b) | inside(a, *b[:, 0, :2].T) | inside(b, *a[:, 0, :2].T)
                out[at] = np.where(meet, 0.0, np.minimum(to_edges(a, b[..., :2]), to_edges(b, a[..., :2])))
    return out


def outlines_distance(a: Column, b: Column) -> Column:
    """Distance of two geometries given as edges, 0 where they meet; NULL where one has no edge."""
    flat = lambda e: F.flatten(F.transform(e, lambda v: F.array(v["x1"], v["y1"], v["x2"], v["y2"])))

    @F.pandas_udf("double")
    def of(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(distances(xs.tolist(), ys.tolist()))

    return F.nanvl(of(flat(a), flat(b)), F.lit(None).cast("double"))


def on_own_and_higher(boxes: DataFrame, levels: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a box meets on its own level, where cells are about as wide as it, and on each higher level in use: four a level at most."""
    each = boxes.crossJoin(F.broadcast(levels)).withColumn("on", F.explode(F.filter("levels", lambda k: k >= F.col("level")))).drop("levels")  # one row
    at = lambda a: F.floor(F.col(f"box.{a}") / (size * F.pow(F.lit(2.0), "on")))
    return each.withColumn("cx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("cy", F.explode(F.sequence(at("min_y"), at("max_y"))))


def box_bounds(p: Column, q: Column) -> tuple[Column, Column]:
    """What the distance of two shapes can't be less than, and can't be more than, by their boxes, whose sides they all touch."""
    gap = lambda a: F.greatest(q[f"min_{a}"] - p[f"max_{a}"], p[f"min_{a}"] - q[f"max_{a}"], F.lit(0.0))
    far = lambda a: F.greatest(q[f"max_{a}"] - p[f"min_{a}"], p[f"max_{a}"] - q[f"min_{a}"])
    between = lambda a: F.least(F.abs(q[f"min_{a}"] - p[f"max_{a}"]), F.abs(p[f"min_{a}"] - q[f"max_{a}"]))
    return F.hypot(gap("x"), gap("y")), F.least(F.hypot(between("x"), far("y")), F.hypot(between("y"), far("x")))


def candidate_pairs(addresses: DataFrame, buildings: DataFrame, reach: float) -> DataFrame:
    """parcel_id, pos, geometry, building_id and b_geometry of the pairs whose exact distance can decide: the building names
    the address, its box comes within reach, and no other building of the address is nearer by the boxes alone."""
    # both sides are filed under the grid cells they meet, addresses with their reach, so a name that is common everywhere meets its neighbours only
    size = 2 * reach
    # a small file is one split, so texts are dealt out before they are read
    dealt = buildings.where("lagebez IS NOT NULL").select("building_id", "geometry", "lagebez").repartition("building_id")
    named = dealt.select("building_id", F.col("geometry").alias("b_geometry"), F.explode(text.addresses_in(F.col("lagebez"))).alias("t"))
    named = named.select("building_id", "b_geometry", F.col("t.str").alias("str"), F.col("t.hnr").alias("hnr"), F.upper(F.coalesce("t.hnr_zus", F.lit(""))).alias("suffix"), geo.envelope(F.col("b_geometry")).alias("box"))
    own = addresses.withColumns({"suffix": F.upper(F.coalesce("hnr_zus", F.lit(""))), "tight": geo.envelope(F.col("geometry"))})
    wide = F.col("tight")
    own = own.withColumn("box", F.struct((wide["min_x"] - reach).alias("min_x"), (wide["min_y"] - reach).alias("min_y"), (wide["max_x"] + reach).alias("max_x"), (wide["max_y"] + reach).alias("max_y")))
    own, named = (d.withColumn("level", level_of(F.col("box"), size)).where("level IS NOT NULL") for d in (own, named))
    theirs = buildings.where("lagebez IS NOT NULL").select(level_of(geo.envelope(F.col("geometry")), size).alias("level"))  # without reading texts
    levels = own.select("level").unionByName(theirs.where("level IS NOT NULL")).agg(F.collect_set("level").alias("levels"))
    left = on_own_and_higher(own, levels, size).withColumnsRenamed({"box": "reached", "level": "own_level"})
    met = left.join(on_own_and_higher(named, levels, size), ["str", "hnr", "suffix", "on", "cx", "cy"]).where(F.col("on") == F.greatest("own_level", "level"))
    r, box = F.col("reached"), F.col("box")
    met = met.where((box["min_x"] <= r["max_x"]) & (box["max_x"] >= r["min_x"]) & (box["min_y"] <= r["max_y"]) & (box["max_y"] >= r["min_y"]))
    # a pair that shares several cells counts in the one that holds the corner of both boxes' overlap
    first = lambda k: F.floor(F.greatest(r[f"min_{k}"], box[f"min_{k}"]) / (size * F.pow(F.lit(2.0), "on"))) == F.col(f"c{k}")
    low, high = box_bounds(F.col("tight"), box)
    met = met.where(first("x") & first("y")).select("parcel_id", "pos", "geometry", "building_id", "b_geometry", low.alias("low"), high.alias("high"))
    least = F.min("high").over(Window.partitionBy("parcel_id", "pos"))
    # a little more, for what rounding takes
    return met.withColumn("least", least).where((F.col("low") <= reach) & (F.col("low") <= F.col("least") * (1 + 1e-9)))


def nearest_building(addresses: DataFrame, buildings: DataFrame, reach: float = REACH) -> DataFrame:
    """parcel_id, pos and the interior point of the nearest building naming the address within reach of the parcel.

    addresses: parcel_id, pos, str, hnr, hnr_zus, geometry. Of equally near buildings the larger, then the lesser id."""
    met = stored(candidate_pairs(addresses, buildings, reach))
    met = met.select("parcel_id", "pos", "building_id", "b_geometry", F.inline(F.array(F.struct(geo.edges(F.col("geometry")).alias("pe"), geo.edges(F.col("b_geometry")).alias("be")))))
    far = met.select("parcel_id", "pos", "building_id", "b_geometry", outlines_distance(F.col("pe"), F.col("be")).alias("d"), geo.area(F.col("b_geometry")).alias("size"))
    best = Window.partitionBy("parcel_id", "pos").orderBy(F.col("d").asc(), F.col("size").desc(), F.col("building_id").asc())
    near = far.where(F.col("d") <= reach).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return near.select("parcel_id", "pos", "building_id", "d", geo.interior_point(F.col("b_geometry")).alias("p")).select("parcel_id", "pos", "building_id", F.col("d").alias("distance"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def pinned(parcels: DataFrame, buildings: DataFrame, reach: float = REACH) -> DataFrame:
    """A row for each address with its pin: of a parcel with one address the parcel's point, else the nearest building's, else none.

    Buildings are looked up only for parcels with several addresses."""
    dealt = parcels.where("lagebez IS NOT NULL").select("parcel_id", "geometry", "lagebez").repartition("parcel_id")
    each = dealt.select("parcel_id", "geometry", text.addresses_in(F.col("lagebez")).alias("all"))
    rows = each.select("parcel_id", "geometry", F.size("all").alias("n"), F.posexplode("all").alias("pos", "t")).select("parcel_id", "geometry", "n", "pos", "t.str", "t.hnr", "t.hnr_zus")
    # four reads of these rows follow, each of which would read the texts anew
    rows = stored(rows)
    alone = rows.where("n = 1").select("parcel_id", "pos", "str", "hnr", "hnr_zus", F.lit("parcel").alias("kind"), geo.interior_point(F.col("geometry")).alias("p"))
    alone = alone.select("parcel_id", "pos", "str", "hnr", "hnr_zus", "kind", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    several = rows.where("n > 1")
    found = nearest_building(several, buildings, reach).select("parcel_id", "pos", "x", "y")
    rest = several.join(found, ["parcel_id", "pos"], "left").select("parcel_id", "pos", "str", "hnr", "hnr_zus", F.when(F.col("x").isNotNull(), "building").otherwise("none").alias("kind"), "x", "y")
    return alone.unionByName(rest)
