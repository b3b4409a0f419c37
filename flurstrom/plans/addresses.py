"""Queries on address keys, parcel texts and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import buildings, geocode, spatial
from .places import areas
from .registry import query
from .served import KEY, key_sql, properties
from .views import view

NEAR = 30.0


def house_points(spark, sf_dir):
    v = view(spark, sf_dir, "v_house_points")
    # a second point for some keys, near or far
    again = v.where("ord % 5 = 1").withColumns({"x": F.col("x") + F.when(F.col("ord") % 2 == 0, 10.0).otherwise(140.0), "ord": F.col("ord") + 1_000_000})
    return geocode.keyed(v.unionByName(again)).select("key", "ord", F.col("x").cast("float").alias("a"), F.col("y").cast("float").alias("b"))


HOUSES = f"""(SELECT {KEY} AS key, ord, CAST(x AS FLOAT) AS a, CAST(y AS FLOAT) AS b FROM
  (SELECT * FROM v_house_points UNION ALL SELECT ord + 1000000, gemeinde, str, hnr, hnr_zus, x + CASE WHEN ord % 2 = 0 THEN 10 ELSE 140 END, y FROM v_house_points WHERE ord % 5 = 1) h)"""
#: The points of a key folded in order, each kept unless one kept before it is near.
CLUSTERS = f"""(SELECT key, list_reduce(list_prepend([], list_transform(list(struct_pack(a := a, b := b) ORDER BY ord), lambda p: [p])),
  lambda kept, p: CASE WHEN len(list_filter(kept, lambda k: abs(k.a - p[1].a) + abs(k.b - p[1].b) <= {NEAR})) > 0 THEN kept ELSE list_concat(kept, p) END) AS points FROM {HOUSES} h GROUP BY key)"""
UNIQUE = f"(SELECT key, points[1].a AS a, points[1].b AS b FROM {CLUSTERS} c WHERE len(points) = 1)"
CANDIDATES = f"(SELECT key, i - 1 AS n, points[i].a AS a, points[i].b AS b FROM (SELECT key, points, unnest(range(1, len(points) + 1)) AS i FROM {CLUSTERS} c WHERE len(points) > 1) t)"
TAGGED = f"""(SELECT c.*, s.plz FROM {CANDIDATES} c LEFT JOIN v_postcode_areas s ON c.a > s.min_x AND c.a < s.min_x + s.edge AND c.b > s.min_y AND c.b < s.min_y + s.edge)"""
SINGLE = f"(SELECT key, plz, min(a) AS a, min(b) AS b FROM {TAGGED} t WHERE plz IS NOT NULL GROUP BY key, plz HAVING count(*) = 1)"


def clusters(spark, sf_dir):
    return geocode.kept_points(house_points(spark, sf_dir), NEAR)


def tagged(spark, sf_dir):
    own = geocode.candidates(clusters(spark, sf_dir)).withColumn("point", F.struct("key", "a", "b"))
    found = spatial.containing(own.withColumnsRenamed({"a": "x", "b": "y"}), areas(spark, sf_dir), "point", "plz", 100.0)
    return own.join(found, "point", "left").drop("point")


@query(f"SELECT key, len(points) AS n, points[1].a AS a, points[1].b AS b FROM {CLUSTERS} c")
def cluster_points(spark, sf_dir):
    return geocode.counted(clusters(spark, sf_dir))


@query(f"SELECT p.id, u.a, u.b FROM (SELECT id, {KEY} AS key FROM v_properties) p LEFT JOIN {UNIQUE} u USING (key)")
def geocode_by_key(spark, sf_dir):
    rows = geocode.keyed(properties(spark, sf_dir)).select("id", "key")
    return geocode.by_key(rows, geocode.unique_points(clusters(spark, sf_dir))).select("id", "a", "b")


@query(f"SELECT p.id, s.a, s.b FROM (SELECT id, plz, {KEY} AS key FROM v_properties) p LEFT JOIN {SINGLE} s USING (key, plz)")
def geocode_ambiguous(spark, sf_dir):
    rows = geocode.keyed(properties(spark, sf_dir)).select("id", "plz", "key")
    return geocode.by_postcode(rows, geocode.resolvable(tagged(spark, sf_dir))).select("id", "a", "b")


@query(f"SELECT DISTINCT key FROM {SINGLE} s")
def resolvable_keys(spark, sf_dir):
    return geocode.resolvable(tagged(spark, sf_dir)).select("key").distinct()


def vague_rows(spark, sf_dir):
    """Served rows of which some suffixes aren't unique, with their parcel's text."""
    texts = view(spark, sf_dir, "v_parcel_texts").select(F.col("parcel_id").alias("id"), "lagebez")
    own = properties(spark, sf_dir).withColumn("hnr_zus", F.when(F.col("id") % 3 == 0, "uneindeutig").when(F.col("id") % 7 == 0, "zz").otherwise(F.col("hnr_zus")))
    # texts name houses by the street's own words, so that some are known
    return own.join(texts, "id").withColumn("lagebez", F.when(F.col("id") % 2 == 0, F.concat_ws(" ", "str", F.col("hnr"))).otherwise(F.col("lagebez")))


VAGUE = """(SELECT id, gemeinde, str, hnr, CASE WHEN id % 3 = 0 THEN 'uneindeutig' WHEN id % 7 = 0 THEN 'zz' ELSE hnr_zus END AS hnr_zus,
  CASE WHEN id % 2 = 0 THEN str || ' ' || hnr ELSE t.lagebez END AS lagebez FROM v_properties p JOIN v_parcel_texts t ON t.parcel_id = p.id)"""
#: Of a trimmed token: whether its last character is a letter, and what stands before that and one space.
LETTER = "(right({t}, 1) <> '' AND translate(lower(right({t}, 1)), 'abcdefghijklmnopqrstuvwxyz', '') = '')"
BODY = f"(CASE WHEN {LETTER} THEN CASE WHEN suffix({{t}}[:-2], ' ') THEN {{t}}[:-3] ELSE {{t}}[:-2] END ELSE {{t}} END)"
SUFFIX = f"(CASE WHEN {LETTER} THEN right({{t}}, 1) END)"


def exploded_sql(rows: str, key: str) -> str:
    """Addresses of the texts in a relation, each once, numbered in order; parts are read at commas, from the right."""
    body, letter = BODY.format(t="trim(c)"), SUFFIX.format(t="trim(c)")
    pure = f"({body} <> '' AND translate({body}, '0123456789', '') = '')"
    parts = f"(SELECT r.*, p.part_no, p.part, string_split(p.part, ',') AS cs FROM {rows} r, LATERAL (SELECT unnest(list_transform(string_split(r.lagebez, ';'), lambda x: trim(x))) AS part, generate_subscripts(string_split(r.lagebez, ';'), 1) AS part_no) p WHERE r.lagebez IS NOT NULL)"
    # the last piece that is no number alone, and what it is without the number at its end
    pieces = f"(SELECT *, coalesce(list_max(list_transform(cs, lambda c, i: CASE WHEN {pure} THEN 0 ELSE i END)), 0) AS last FROM {parts} a)"
    last_body = BODY.format(t="rtrim(cs[last])")
    ends = f"(SELECT *, rtrim({last_body}, '0123456789') AS ahead, {last_body} AS b, {SUFFIX.format(t='rtrim(cs[last])')} AS z FROM {pieces} e WHERE last > 0)"
    read = f"(SELECT * EXCLUDE (ahead, b, z), CASE WHEN last > 1 THEN array_to_string(cs[: last - 1], ',') || ',' ELSE '' END || rtrim(ahead) AS street, b[len(ahead) + 1 :] AS first_nr, z AS first_z FROM {ends} f WHERE b <> ahead AND rtrim(ahead) <> ahead AND rtrim(ahead) <> '')"
    houses = f"list_concat([struct_pack(nr := first_nr, suffix := first_z)], list_transform(cs[last + 1 :], lambda c: struct_pack(nr := {body}, suffix := {letter})))"
    each = f"(SELECT * EXCLUDE (h), h.nr AS nr, h.suffix AS suffix FROM (SELECT *, unnest(hs) AS h, generate_subscripts(hs, 1) AS k FROM (SELECT *, {houses} AS hs FROM {read} g) i WHERE length(regexp_replace(street, '[^\\p{{L}}]', '', 'g')) >= 2) j)"
    return f"""(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY part_no, k) - 1 AS pos FROM (SELECT * FROM {each} y
    QUALIFY row_number() OVER (PARTITION BY {key}, street, nr, suffix ORDER BY part_no, k) = 1) w)"""


@query(f"SELECT parcel_id, pos, street AS str, nr AS hnr, suffix AS hnr_zus, area_m2 FROM {exploded_sql('v_parcel_texts', 'parcel_id')} e")
def explode_addresses(spark, sf_dir):
    return geocode.exploded(view(spark, sf_dir, "v_parcel_texts")).withColumn("pos", F.col("pos").cast("long"))


#: Whether a part ends in a number behind white space (none of these texts has a street of digits and commas alone).
ENDING = BODY.format(t="string_split(part, ',')[-1]")
READS = f"({ENDING} <> rtrim({ENDING}, '0123456789') AND rtrim(rtrim({ENDING}, '0123456789')) <> rtrim({ENDING}, '0123456789') OR trim({ENDING}) <> '' AND translate(trim({ENDING}), '0123456789', '') = '' AND contains(part, ','))"


@query(f"SELECT count(*) AS unread FROM (SELECT unnest(list_transform(string_split(lagebez, ';'), lambda x: trim(x))) AS part FROM v_parcel_texts WHERE lagebez IS NOT NULL) t WHERE translate(part, '0123456789', '') <> part AND NOT {READS}")
def unread_parts(spark, sf_dir):
    return geocode.unread(view(spark, sf_dir, "v_parcel_texts"))


FALLBACK = f"""(WITH u AS (SELECT * FROM {UNIQUE} u), v AS (SELECT * FROM {VAGUE} v),
k AS (SELECT id, {KEY} AS k1, CASE WHEN hnr_zus = 'uneindeutig' THEN {key_sql('gemeinde', 'str', 'hnr', 'NULL')} END AS k2 FROM v),
t AS (SELECT e.id, u.a, u.b FROM {exploded_sql('v', 'id')} e JOIN u ON u.key = {key_sql('e.gemeinde', 'e.street', 'e.nr', 'e.suffix')} QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY e.pos) = 1)
SELECT k.id, coalesce(a1.a, a2.a, t.a) AS a, coalesce(a1.b, a2.b, t.b) AS b, CASE WHEN a1.key IS NOT NULL THEN 'own' WHEN a2.key IS NOT NULL THEN 'without suffix' WHEN t.id IS NOT NULL THEN 'parcel text' ELSE 'none' END AS step
FROM k LEFT JOIN u a1 ON a1.key = k1 LEFT JOIN u a2 ON a2.key = k2 LEFT JOIN t ON t.id = k.id)"""


@query(f"SELECT * FROM {FALLBACK} f")
def geocode_fallback(spark, sf_dir):
    return geocode.fallback(vague_rows(spark, sf_dir), geocode.unique_points(clusters(spark, sf_dir)))


@query(f"SELECT step, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {FALLBACK} f GROUP BY step")
def step_tally(spark, sf_dir):
    return geocode.step_tally(geocode.fallback(vague_rows(spark, sf_dir), geocode.unique_points(clusters(spark, sf_dir))))


def text_parcels(spark, sf_dir):
    """Parcels with texts, on a grid of squares."""
    t = view(spark, sf_dir, "v_parcel_texts")
    x, y = (F.col("parcel_id") % 40) * 100, F.floor(F.col("parcel_id") / 40) * 100
    return t.select("parcel_id", "lagebez", geo.rectangle(x, y, x + 90, y + 90).alias("geometry"))


def named_buildings(spark, sf_dir):
    """One building for most texts, some near their parcel, others too far."""
    t = view(spark, sf_dir, "v_parcel_texts").where("parcel_id % 7 <> 3 AND lagebez IS NOT NULL")
    x = (F.col("parcel_id") % 40) * 100 + (F.col("parcel_id") % 9) * 30
    y = F.floor(F.col("parcel_id") / 40) * 100
    return t.select(F.col("parcel_id").alias("building_id"), "lagebez", geo.rectangle(x, y + 10, x + 20, y + 40).alias("geometry"))


E_TEXTS = f"{exploded_sql('v_parcel_texts', 'parcel_id')}"
NEAREST = f"""(WITH e AS (SELECT *, (parcel_id % 40) * 100 AS px, floor(parcel_id / 40) * 100 AS py FROM {E_TEXTS} e), b AS (SELECT *, (parcel_id % 40) * 100 + (parcel_id % 9) * 30 AS bx, floor(parcel_id / 40) * 100 + 10 AS b_y FROM {E_TEXTS} f WHERE parcel_id % 7 <> 3),
d AS (SELECT e.parcel_id, e.pos, b.parcel_id AS building_id, bx, b_y, sqrt(power(greatest(bx - (px + 90), px - (bx + 20), 0), 2) + power(greatest(b_y - (py + 90), py - (b_y + 30), 0), 2)) AS distance
  FROM e JOIN b ON e.street = b.street AND e.nr = b.nr AND upper(coalesce(e.suffix, '')) = upper(coalesce(b.suffix, '')))
SELECT parcel_id, pos, building_id, distance, bx + 10.0 AS x, b_y + 15.0 AS y FROM d WHERE distance <= 100 QUALIFY row_number() OVER (PARTITION BY parcel_id, pos ORDER BY distance, building_id) = 1)"""


@query(f"SELECT parcel_id, pos, building_id, round(distance, 6) AS distance, x, y FROM {NEAREST} n")
def nearest_building(spark, sf_dir):
    own = text_parcels(spark, sf_dir)
    each = geocode.exploded(own.withColumn("area_m2", F.lit(0.0))).drop("area_m2").join(own.select("parcel_id", "geometry"), "parcel_id")
    out = buildings.nearest_building(each, named_buildings(spark, sf_dir))
    return out.withColumns({"pos": F.col("pos").cast("long"), "distance": F.round("distance", 6)})


@query(f"""WITH e AS (SELECT *, count(*) OVER (PARTITION BY parcel_id) AS n FROM {E_TEXTS} e), b AS (SELECT * FROM {NEAREST} n)
SELECT e.parcel_id, e.pos, CASE WHEN n = 1 THEN 'parcel' WHEN b.x IS NOT NULL THEN 'building' ELSE 'none' END AS kind,
  CASE WHEN n = 1 THEN (e.parcel_id % 40) * 100 + 45.0 ELSE b.x END AS x, CASE WHEN n = 1 THEN floor(e.parcel_id / 40) * 100 + 45.0 ELSE b.y END AS y FROM e LEFT JOIN b USING (parcel_id, pos)""")
def pin_addresses(spark, sf_dir):
    out = buildings.pinned(text_parcels(spark, sf_dir), named_buildings(spark, sf_dir))
    return out.select("parcel_id", F.col("pos").cast("long").alias("pos"), "kind", "x", "y")
