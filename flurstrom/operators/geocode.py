"""Positions of addresses by key, by postcode among several, and by a parcel's text."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text
from .storage import discard, stored

#: Points of a key that are folded in one row; keys of more are settled by tiles of so many points.
MANY, TILE = 1000, 20_000


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", text.address_key(F.col("gemeinde"), F.col("str"), F.col("hnr"), F.col("hnr_zus")))


def few_kept(points: DataFrame, near: float) -> DataFrame:
    """The fold of each key's points in one row, for keys of few points."""

    def keep(kept: Column, p: Column) -> Column:
        close = F.exists(kept, lambda k: F.abs(k["a"] - p["a"]) + F.abs(k["b"] - p["b"]) <= near)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(p)))

    ordered = points.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ord", "a", "b"))).alias("all"))
    return ordered.select("key", F.inline(F.aggregate("all", F.slice("all", 1, 0), keep)))


def tiled(points: DataFrame, near: float, limit: int) -> DataFrame:
    """Adds home, the tile of each point, and targets, the other tiles that have points less than ``near`` away, perhaps.

    Tiles are the cells of a quadtree over each key's points: the coarsest that hold fewer points than the limit, or
    the finest, which are about twice as wide as near."""
    side = near * 2.002 or 1.0  # so that rounding doesn't take a near point two cells away
    cell = lambda c: F.floor(F.greatest(F.lit(-(2.0**61)), F.least(F.lit(2.0**61), F.col(c).cast("double") / side)))
    own = points.withColumns({"own": F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("n")), "fx": cell("a"), "fy": cell("b")})
    fine = own.groupBy("own", "fx", "fy").agg(F.count("*").alias("n"))
    up = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k)).cast("long")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.struct(k.alias("up"), up("fx", k).alias("cx"), up("fy", k).alias("cy")))).alias("c")
    cells = fine.select("own", "fx", "fy", "n", above).select("own", "fx", "fy", "n", "c.*")
    fitting = cells.groupBy("own", "up", "cx", "cy").agg(F.sum("n").alias("n")).where((F.col("n") < limit) | (F.col("up") == 0)).drop("n")
    tile = F.max(F.struct("up", "cx", "cy")).alias("tile")
    found = stored(cells.drop("n").join(fitting, ["own", "up", "cx", "cy"]).groupBy("own", "fx", "fy").agg(tile))
    placed = own.join(found, ["own", "fx", "fy"]).withColumnRenamed("tile", "home")
    # only what lies at a tile's border has cells of others around it
    edge = lambda c: (F.floor((F.col(f"f{c}") - 1) / F.pow(F.lit(2.0), "home.up")) != F.col(f"home.c{c}")) | (F.floor((F.col(f"f{c}") + 1) / F.pow(F.lit(2.0), "home.up")) != F.col(f"home.c{c}"))
    around = F.explode(F.array(*(F.struct((F.col("fx") + i).alias("fx"), (F.col("fy") + j).alias("fy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
    at = placed.where(edge("x") | edge("y")).select("own", "ord", "a", "b", "home", around.alias("f")).select("own", "ord", "a", "b", "home", "f.*")
    others = at.join(found, ["own", "fx", "fy"]).where(F.col("tile") != F.col("home")).groupBy("own", "a", "b").agg(F.collect_set("tile").alias("targets"))
    return placed.join(others, ["own", "a", "b"], "left").select("key", "own", "ord", "a", "b", "home", F.coalesce("targets", F.array().cast(dict(others.dtypes)["targets"])).alias("targets"))


def settled(near: float):
    """Of one tile's points and those around it, in order: which of its own are kept, and which can't be told yet, because
    one before them and outside, or one that depends on it, can't."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(some=frame["ord"].notna()).sort_values(["some", "ord", "a", "b"], ignore_index=True)
        a, b = frame["a"].to_numpy(), frame["b"].to_numpy()
        own, kept = frame["at_home"].to_numpy(), frame["kept"].to_numpy().copy()
        side = near or 1.0
        cells = np.stack([np.floor(np.clip(v.astype(float) / side, -(2.0**61), 2.0**61)) for v in (a, b)], 1).astype(np.int64).tolist()
        grid: dict[tuple[int, int], list[int]] = {}
        open_ = np.zeros(len(frame), bool)
        gone = np.zeros(len(frame), bool)
        for k, (x, y) in enumerate(cells):
            before = [j for i in (x - 1, x, x + 1) for q in (y - 1, y, y + 1) for j in grid.get((i, q), ()) if float(abs(a[j] - a[k]) + abs(b[j] - b[k])) <= near]  # a sum of floats is one, as in Spark
            if kept[k]:
                pass
            elif any(kept[j] for j in before):
                gone[k] = True
                continue
            elif own[k] and not any(open_[j] for j in before):
                kept[k] = True
            else:
                open_[k] = True
            grid.setdefault((x, y), []).append(k)
        out = frame.assign(kept=kept)[own & ~gone]
        return out[["key", "own", "ord", "a", "b", "home", "targets", "kept"]]

    return of


def many_kept(points: DataFrame, near: float, limit: int = TILE) -> DataFrame:
    """The same for keys of many points, by tiles in parallel.

    In a round each tile settles all its points that depend on nothing unsettled outside it, however long a row of them
    does; so there are as many rounds as tiles that a row of points, each near the one before, goes through in order."""
    left = stored(tiled(points, near, limit).withColumn("kept", F.lit(False)))
    open_ = 1
    while open_:
        told = Observation()
        here = left.withColumn("tile", F.explode(F.concat(F.array("home"), "targets"))).withColumn("at_home", F.col("tile") == F.col("home"))
        new = here.groupBy("own", "tile").applyInPandas(settled(near), left.schema).observe(told, F.count_if(~F.col("kept")).alias("open"))
        after = stored(new)
        open_ = told.get["open"]
        discard(left)
        left = after
    return left.select("key", "ord", "a", "b")


def kept_points(points: DataFrame, near: float, many: int = MANY, limit: int = TILE) -> DataFrame:
    """key, ord, a, b of the points that aren't nearer than ``near`` (sum of both differences, 0 at least) to one kept before them.

    Equal points are one first, by a partial aggregation, as all but the first would be dropped.
    Points without two finite coordinates are near to none."""
    finite = F.coalesce(F.abs("a") < float("inf"), F.lit(False)) & F.coalesce(F.abs("b") < float("inf"), F.lit(False))
    points = points.select("key", "ord", "a", "b")
    first = F.when(~F.bool_or(F.col("ord").isNull()), F.min("ord")).alias("ord")
    one = stored(points.where(finite).groupBy("key", "a", "b").agg(first).select("key", "ord", "a", "b"))  # it is read several times
    counts = one.groupBy("key").count()
    parts = [points.where(~finite)]
    if (counts.agg(F.max("count")).first()[0] or 0) <= many:
        parts.append(few_kept(one, near))
    else:
        crowded = stored(counts.where(F.col("count") > many).select("key"))
        own = F.col("o.key").eqNullSafe(F.col("c.key"))
        parts.append(few_kept(one.alias("o").join(crowded.alias("c"), own, "left_anti"), near))
        parts.append(many_kept(one.alias("o").join(crowded.alias("c"), own, "left_semi"), near, limit))
    return functools.reduce(DataFrame.unionByName, parts)


def cluster_points(points: DataFrame, near: float) -> DataFrame:
    """key and its kept points in order, as one array."""
    rows = kept_points(points, near).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ord", "a", "b"))).alias("all"))
    return rows.select("key", F.transform("all", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))).alias("points"))


def counted(kept: DataFrame) -> DataFrame:
    """key, its number of kept points, and the first of them."""
    return kept.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("ord", "a", "b")).alias("p")).select("key", "n", "p.a", "p.b")


def unique_points(kept: DataFrame) -> DataFrame:
    return counted(kept).where("n = 1").drop("n")


def candidates(kept: DataFrame) -> DataFrame:
    """The points of keys that have several."""
    several = kept.groupBy("key").count().where(F.col("count") > 1).select("key")
    return kept.alias("o").join(several.alias("c"), F.col("o.key").eqNullSafe(F.col("c.key")), "left_semi").select("key", "a", "b")


def resolvable(tagged: DataFrame) -> DataFrame:
    """key, plz, a, b of candidates that are the only ones of their key in their postcode."""
    own = tagged.where("plz IS NOT NULL").groupBy("key", "plz").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    return own.where("n = 1").drop("n")


def by_key(rows: DataFrame, points: DataFrame) -> DataFrame:
    return rows.join(points, "key", "left")


def by_postcode(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Rows with the candidate of their key in their postcode, if there is exactly one."""
    return rows.join(single, ["key", "plz"], "left")


def fallback(rows: DataFrame, points: DataFrame) -> DataFrame:
    """id with its point and the step that found it: the own address, the address without a
    suffix that isn't unique, the first known address of the parcel's text, or none."""
    vague = F.lower(F.trim("hnr_zus")) == "uneindeutig"
    key = lambda suffix: text.address_key(F.col("gemeinde"), F.col("str"), F.col("hnr"), suffix)
    own = rows.select("id", "gemeinde", "lagebez", key(F.col("hnr_zus")).alias("k1"), F.when(vague, key(F.lit(None).cast("string"))).alias("k2"))
    named = own.where("lagebez IS NOT NULL").select("id", "gemeinde", F.posexplode(text.addresses_in(F.col("lagebez"))).alias("pos", "t"))
    named = named.select("id", "pos", text.address_key(F.col("gemeinde"), F.col("t.str"), F.col("t.hnr"), F.col("t.hnr_zus")).alias("key"))
    third = named.join(points, "key").groupBy("id").agg(F.min(F.struct("pos", "a", "b")).alias("p3"))
    at = F.struct("a", "b")
    out = own.join(points.select(F.col("key").alias("k1"), at.alias("p1")), "k1", "left").join(points.select(F.col("key").alias("k2"), at.alias("p2")), "k2", "left").join(third, "id", "left")
    step = F.when(F.col("p1").isNotNull(), "own").when(F.col("p2").isNotNull(), "without suffix").when(F.col("p3").isNotNull(), "parcel text").otherwise("none")
    pick = lambda c: F.coalesce(F.col(f"p1.{c}"), F.col(f"p2.{c}"), F.col(f"p3.{c}"))
    return out.select("id", pick("a").alias("a"), pick("b").alias("b"), step.alias("step"))


def step_tally(found: DataFrame) -> DataFrame:
    """Rows of each step and their share."""
    tally = found.groupBy("step").agg(F.count("*").alias("n"))
    return tally.crossJoin(F.broadcast(tally.agg(F.sum("n").alias("total")))).select("step", "n", (F.col("n") / F.col("total")).alias("share"))


def exploded(parcels: DataFrame) -> DataFrame:
    """A row for each address a parcel's text names, with the parcel's area."""
    return parcels.select("parcel_id", "area_m2", F.posexplode(text.addresses_in(F.col("lagebez"))).alias("pos", "t")).select("parcel_id", "pos", "t.str", "t.hnr", "t.hnr_zus", "area_m2")


def unread(parcels: DataFrame) -> DataFrame:
    return parcels.agg(F.coalesce(F.sum(text.unread_parts(F.col("lagebez"))), F.lit(0)).cast("long").alias("unread"))
