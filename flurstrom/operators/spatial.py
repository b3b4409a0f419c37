"""Spatial joins and partitions on grid cells.

A shape is filed under the cells its envelope meets on the level where cells are about
as wide as it (four at most, however large it is), and a point under its cell on each
level that shapes have; so a join is an equi-join on level and cell with the exact
predicate behind it. A crowded cell is split by adaptive execution like any skewed key, or
points are dealt beforehand by a quadtree whose cells hold so many at most.

A shape of many edges is prepared: its height is cut into strips, and the edges of a strip
into blocks of edges whose widths overlap. Between blocks no edge passes, so all of a gap
is inside or outside; and a point in a block is judged by that block's edges and the gap to
its left. Blocks and inner gaps are filed by strip and by a bucket of their width, where a
point finds its one piece, whatever the number of the shape's edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def with_edges(shapes: DataFrame) -> DataFrame:
    """Adds edges, size (area) and the envelope of each geometry; those without area are left out."""
    out = shapes.select("*", F.inline(F.array(F.struct(geo.edges(F.col("geometry")).alias("edges"), geo.area(F.col("geometry")).alias("size"), geo.envelope(F.col("geometry")).alias("box")))))
    return out.where("size > 0")


def level_of(box: Column, size: float) -> Column:
    """The level on which cells are about as wide as a box; they are size wide on level 0 and double in width with each level."""
    width = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    return F.greatest(F.ceil(F.log2(F.greatest(width, F.lit(size)) / size)), F.lit(0)).cast("int")


def layered(shapes: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a shape's envelope (box) meets on its own level: cells double in width with each level."""
    own = shapes.withColumn("level", level_of(F.col("box"), size))
    at = lambda a: F.floor(F.col(f"box.{a}") / (size * F.pow(F.lit(2.0), "level")))
    return own.withColumn("cx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("cy", F.explode(F.sequence(at("min_y"), at("max_y"))))


def on_levels(points: DataFrame, filed_shapes: DataFrame, size: float) -> DataFrame:
    """A row for each point and level that shapes are filed on, of which there are some dozens at most."""
    levels = filed_shapes.agg(F.collect_set("level").alias("levels"))
    each = points.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels")  # one row
    at = lambda a: F.floor(F.col(a) / (size * F.pow(F.lit(2.0), "level")))
    return each.withColumns({"cx": at("x"), "cy": at("y")})


#: Edges of a shape that points are tested against one by one; shapes of more are prepared.
FEW = 64
#: Edges of a strip, and blocks of a bucket, about.
EACH_STRIP, EACH_BUCKET = 32, 8


def stripped(shapes: DataFrame) -> DataFrame:
    """Adds key, n, strips and tall (a strip's height) to shapes with edges: what a strip is follows from the geometry alone."""
    n, box = F.size("edges"), F.col("box")
    height = box["max_y"] - box["min_y"]
    # edges count once for each strip they meet; where many are tall, few strips keep their number in bounds
    climb = F.aggregate("edges", F.lit(0.0), lambda s, e: s + F.abs(e["y2"] - e["y1"])) / height
    strips = F.greatest(F.least(F.ceil(n / EACH_STRIP), F.ceil(2 * n / climb)), F.lit(1)).cast("int")
    own = shapes.withColumns({"key": F.struct(F.xxhash64("edges").alias("h"), n.alias("n")), "strips": strips})
    return own.withColumn("tall", height / F.col("strips"))


def strip_of(y: Column) -> Column:
    return F.greatest(F.least(F.floor((y - F.col("box.min_y")) / F.col("tall")), F.col("strips") - 1), F.lit(0)).cast("int")


def bucket_of(x: Column) -> Column:
    wide = F.col("box.max_x") - F.col("box.min_x")
    return F.greatest(F.least(F.floor((x - F.col("box.min_x")) / wide * F.col("buckets")), F.col("buckets") - 1), F.lit(0)).cast("int")


def pieces(shapes: DataFrame) -> DataFrame:
    """key, buckets, strip, bucket, x0, x1, inside and edges of the blocks (inside tells of the gap to their left) and inner
    gaps (without edges) of shapes of many edges."""
    each = shapes.select("key", "box", "strips", "tall", F.explode("edges").alias("e"))
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    each = each.withColumn("strip", F.explode(F.sequence(strip_of(low), strip_of(high))))
    # the part of an edge's width that lies in the strip, a little widened
    rise, run = F.col("e.y2") - F.col("e.y1"), F.col("e.x2") - F.col("e.x1")
    share = lambda k: (F.col("box.min_y") + k * F.col("tall") - F.col("e.y1")) / rise
    at = lambda k: F.when(rise != 0, F.col("e.x1") + run * F.least(F.greatest(share(k), F.lit(0.0)), F.lit(1.0)))
    a, b = at(F.col("strip") - 0.001), at(F.col("strip") + 1.001)
    slack = (F.col("box.max_x") - F.col("box.min_x")) * 1e-9
    x0, x1 = F.coalesce(F.least(a, b), F.least("e.x1", "e.x2")), F.coalesce(F.greatest(a, b), F.greatest("e.x1", "e.x2"))
    each = each.withColumns({"x0": F.greatest(x0 - slack, F.least("e.x1", "e.x2")), "x1": F.least(x1 + slack, F.greatest("e.x1", "e.x2"))})
    row = Window.partitionBy("key", "strip").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(reach >= F.col("x0"), 0).otherwise(1)).withColumn("block", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.col("box.min_y") + (F.col("strip") + 0.5) * F.col("tall")
    crossed = F.sum(((F.col("e.y1") > middle) != (F.col("e.y2") > middle)).cast("int"))
    blocks = each.groupBy("key", "strip", "block").agg(F.first("box").alias("box"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.collect_list("e").alias("edges"), crossed.alias("crossed"))
    row = Window.partitionBy("key", "strip").orderBy("block")
    upto = F.sum("crossed").over(row.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumns({"upto": upto, "next": F.lead("x0").over(row)})
    most = blocks.groupBy("key").agg(F.ceil(F.max("block") / EACH_BUCKET).cast("int").alias("buckets"))
    own = F.struct("x0", "x1", ((F.col("upto") - F.col("crossed")) % 2 == 1).alias("inside"), "edges")
    gap = F.struct(F.col("x1").alias("x0"), F.col("next").alias("x1"), F.lit(True).alias("inside"), F.lit(None).cast(dict(blocks.dtypes)["edges"]).alias("edges"))
    both = F.when(F.col("next").isNotNull() & (F.col("upto") % 2 == 1), F.array(own, gap)).otherwise(F.array(own))
    found = blocks.select("key", "strip", "box", F.inline(both)).join(most, "key")
    return found.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("x0")), bucket_of(F.col("x1"))))).select("key", "buckets", "strip", "bucket", "x0", "x1", "inside", F.col("edges").alias("some"))


def within(pairs: DataFrame, prepared: DataFrame | None) -> DataFrame:
    """Pairs of points (x, y) and shapes (edges, key, box, strips, tall) of which the point lies inside the shape, not on an edge."""
    x, y = F.col("x"), F.col("y")
    few = pairs.where(F.size("edges") <= FEW).where(geo.contains(F.col("edges"), x, y))
    if prepared is None:
        return few
    many = pairs.where(F.size("edges") == FEW + 1).join(prepared.select("key", "buckets").distinct(), "key")
    met = many.withColumns({"strip": strip_of(y), "bucket": bucket_of(x)}).join(prepared.drop("buckets"), ["key", "strip", "bucket"])
    inner = F.col("some").isNull() & (x > F.col("x0")) & (x < F.col("x1"))
    met = met.where(inner | F.col("some").isNotNull() & x.between(F.col("x0"), F.col("x1")) & geo.right_of(F.col("some"), F.col("inside"), x, y))
    return few.unionByName(met.select(*few.columns))


def containing(points: DataFrame, shapes: DataFrame, point_id: str, shape_id: str, size: float, carry: tuple[str, ...] = (), limit: int | None = None, levels: int = 20) -> DataFrame:
    """point_id with the smallest shape that contains it (ties: least id) and its carried columns. Points on an edge are in none.

    size: about the width of the smallest shapes. limit: points are dealt by a quadtree whose cells hold fewer, the
    smallest of them size wide after so many levels; one that can't hold so few fails the job."""
    own = stripped(with_edges(shapes))
    large = own.where(F.size("edges") > FEW)
    # one look at the shapes tells whether any has to be prepared
    prepared = None if large.isEmpty() else pieces(large.dropDuplicates(["key"]))
    # of shapes with many edges some stand for all on their way to the points; the pieces have the others
    own = own.withColumn("edges", F.slice("edges", 1, FEW + 1)).drop("geometry")
    at = points.select(point_id, "x", "y")
    if limit is None:
        filed_ = layered(own, size)
        met = on_levels(at, filed_, size).join(filed_, ["level", "cx", "cy"])
    else:
        met = dealt(at, own, point_id, size, limit, levels)
    box = F.col("box")
    met = met.where((F.col("x") > box["min_x"]) & (F.col("x") < box["max_x"]) & (F.col("y") > box["min_y"]) & (F.col("y") < box["max_y"]))
    met = within(met.select(point_id, "x", "y", shape_id, *carry, "size", "box", "edges", "key", "strips", "tall"), prepared)
    best = met.groupBy(point_id).agg(F.min(F.struct("size", shape_id, *carry)).alias("best"))
    return best.select(point_id, f"best.{shape_id}", *(f"best.{c}" for c in carry))


def dealt(points: DataFrame, shapes: DataFrame, point_id: str, size: float, limit: int, levels: int) -> DataFrame:
    """Points with the shapes whose boxes meet their quadtree cell; no cell holds limit points or more."""
    side = size * 2.0**levels
    leaf = F.struct("level", "cx", "cy").alias("leaf")
    placed = points.join(quadtree(points, point_id, side, limit, levels, strict=True), point_id).select(*points.columns, leaf)
    leaves = placed.select("leaf").distinct()
    # a leaf and a cell that a shape is filed under meet if one holds the other: each also goes by the cells above it
    above = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.col(f"{c}.level")), lambda k: F.struct(k.alias("level"), *(F.floor(F.col(f"{c}.{a}") / F.pow(F.lit(2.0), F.col(f"{c}.level") - k)).alias(a) for a in ("cx", "cy")))))
    width = F.greatest(F.col("box.max_x") - F.col("box.min_x"), F.col("box.max_y") - F.col("box.min_y"))
    level = F.greatest(F.least(F.floor(F.log2(F.lit(side) / F.greatest(width, F.lit(size)))), F.lit(levels)), F.lit(0)).cast("int")
    cells = shapes.select("key", "box", level.alias("level")).distinct()
    span = lambda a: F.sequence(F.floor(F.col(f"box.min_{a}") * F.pow(F.lit(2.0), "level") / side), F.floor(F.col(f"box.max_{a}") * F.pow(F.lit(2.0), "level") / side))
    cells = cells.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y"))).select("key", "box", F.struct("level", "cx", "cy").alias("cell"))
    finer = cells.join(leaves.select("leaf", above("leaf").alias("cell")), "cell").select("key", "box", "leaf")
    coarser = cells.select("key", "box", above("cell").alias("leaf")).join(leaves, "leaf").select("key", "box", "leaf")
    met = finer.unionByName(coarser).distinct()
    width_of = F.pow(F.lit(2.0), -F.col("leaf.level")) * side
    touches = lambda a: (F.col(f"leaf.c{a}") * width_of <= F.col(f"box.max_{a}")) & ((F.col(f"leaf.c{a}") + 1) * width_of >= F.col(f"box.min_{a}"))
    near = met.where(touches("x") & touches("y")).select("key", "leaf")
    return placed.join(near.join(shapes, "key"), "leaf").drop("leaf")


def fill_postcode(points: DataFrame, areas: DataFrame, point_id: str, size: float) -> DataFrame:
    """The row's own postcode, or where it has none its area's; with the area's beside it."""
    found = containing(points, areas.withColumnRenamed("plz", "area_plz"), point_id, "area_plz", size)
    own = F.nullif(F.trim("plz"), F.lit(""))
    return points.join(found, point_id, "left").withColumns({"own_plz": own, "plz": F.coalesce(own, F.col("area_plz"))})


def postcode_tally(filled: DataFrame) -> DataFrame:
    return filled.agg(
        F.count_if(F.col("own_plz").isNull()).alias("missing"),
        F.count_if(F.col("own_plz").isNull() & F.col("area_plz").isNotNull()).alias("filled"),
        F.count_if(F.col("own_plz").isNotNull()).alias("official"),
        F.count_if(F.col("own_plz") == F.col("area_plz")).alias("agreeing"),
    )


def in_box(points: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Closed on all sides."""
    return points.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def tile_of(points: DataFrame, size: float, min_x: float = 0.0, min_y: float = 0.0) -> DataFrame:
    """The one tile (half-open) that owns each point."""
    return points.withColumns({"tile_x": cell(F.col("x") - min_x, size), "tile_y": cell(F.col("y") - min_y, size)})


def extent(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def tiles(extents: DataFrame, size: float) -> DataFrame:
    """Tiles of each extent column by column; the last ones are cut at its edge."""
    steps = lambda a: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / size).cast("int") - 1, F.lit(0)))
    out = extents.withColumn("i", F.explode(steps("x"))).withColumn("j", F.explode(steps("y")))
    at = lambda a, k: F.col(f"min_{a}") + F.col(k) * size
    return out.select("i", "j", at("x", "i").alias("x0"), at("y", "j").alias("y0"), F.least(at("x", "i") + size, F.col("max_x")).alias("x1"), F.least(at("y", "j") + size, F.col("max_y")).alias("y1"))


def meeting_boxes(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, size: float) -> DataFrame:
    """Pairs of points and boxes (min_x..max_y) that hold them, edges included. Boxes whose sides are the wrong way round hold none."""
    boxes = boxes.where("min_x <= max_x AND min_y <= max_y")
    own = layered(boxes.withColumn("box", F.struct("min_x", "min_y", "max_x", "max_y")), size)
    met = on_levels(points.select(point_id, "x", "y"), own, size).join(own, ["level", "cx", "cy"])
    return met.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))).select(point_id, box_id)


def quadtree(points: DataFrame, point_id: str, side: float, limit: int, levels: int, strict: bool = False) -> DataFrame:
    """For each point the coarsest cell (level, cx, cy) that holds fewer points than the limit; level NULL where none does, or if strict the job fails.

    Points are counted once, on the finest level; the levels above are sums of these counts. As counts only
    fall from a cell to its quarters, the first level that fits is the least."""
    finest = lambda a: F.floor(F.col(a) * 2.0**levels / side)
    own = points.select(point_id, finest("x").alias("fx"), finest("y").alias("fy"))
    fine = own.groupBy("fx", "fy").agg(F.count("*").alias("n"))
    up = lambda a, k: F.floor(F.col(a) / F.pow(F.lit(2.0), F.lit(levels) - k))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), up("fx", k).alias("cx"), up("fy", k).alias("cy"))))
    cells = fine.select("fx", "fy", "n", above.alias("c")).select("fx", "fy", "n", "c.*")
    fitting = cells.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).where(F.col("n") < limit).drop("n")
    found = cells.drop("n").join(fitting, ["level", "cx", "cy"]).groupBy("fx", "fy").agg(F.min(F.struct("level", "cx", "cy")).alias("c"))
    if strict:
        said = F.concat(F.lit("a cell of the smallest size, "), F.col("fx").cast("string"), F.lit(" "), F.col("fy").cast("string"), F.lit(f", holds {limit} points or more"))
        found = fine.join(found, ["fx", "fy"], "left").select("fx", "fy", F.when(F.col("c").isNull(), F.raise_error(said).cast(dict(found.dtypes)["c"])).otherwise(F.col("c")).alias("c"))
    return own.join(found, ["fx", "fy"], "left").select(point_id, F.col("c.level").alias("level"), F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))


def anchored(shapes: DataFrame, shape_id: str, size: float) -> DataFrame:
    """Each shape's interior point and the one tile that owns it."""
    p = shapes.select(shape_id, F.inline(F.array(F.struct(geo.interior_point(F.col("geometry")).alias("p")))))
    return tile_of(p.select(shape_id, F.col("p.x").alias("x"), F.col("p.y").alias("y")), size)


def fetch_boxes(anchors: DataFrame, margin: float) -> DataFrame:
    """Envelope of each tile's boxes, widened by a margin."""
    return anchors.groupBy("tile_x", "tile_y").agg((F.min("min_x") - margin).alias("x0"), (F.min("min_y") - margin).alias("y0"), (F.max("max_x") + margin).alias("x1"), (F.max("max_y") + margin).alias("y1"))
