"""Queries on the served table: search, lists, names, keys, lines and links."""

from __future__ import annotations

import contextlib
import dataclasses
import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import geocode, imports, publish, quality, search
from ..operators.storage import landing
from .registry import query
from .views import view

ORDER = "plz NULLS LAST, str COLLATE de NULLS LAST, length(hnr) NULLS LAST, hnr NULLS LAST, hnr_zus IS NOT NULL, hnr_zus NULLS LAST, id"


def properties(spark, sf_dir):
    return view(spark, sf_dir, "v_properties")


@query("SELECT * FROM v_properties WHERE plz = '10003' AND flaeche_amtl >= 920 AND flaeche_amtl <= 2100 AND source NOT IN ('src2', 'src5')")
def search_by_filters(spark, sf_dir):
    return search.search(properties(spark, sf_dir), plz="10003", min_area=920.0, max_area=2100.0, disabled=("src2", "src5"))


@query(f"SELECT * FROM v_properties ORDER BY {ORDER} LIMIT 500")
def search_ordered(spark, sf_dir):
    return search.top(search.search(properties(spark, sf_dir)))


@query("SELECT id, source FROM v_properties WHERE source NOT IN ('src1', 'src12')")
def visible_rows(spark, sf_dir):
    return search.visible(properties(spark, sf_dir), ("src1", "src12")).select("id", "source")


@query("SELECT DISTINCT gemeinde FROM v_properties WHERE gemeinde IS NOT NULL")
def distinct_locations(spark, sf_dir):
    return search.distinct_values(properties(spark, sf_dir), "gemeinde")


@query("SELECT DISTINCT plz AS name, TRUE AS is_plz FROM v_properties WHERE plz IS NOT NULL UNION ALL SELECT DISTINCT gemeinde, FALSE FROM v_properties WHERE gemeinde IS NOT NULL")
def filter_options(spark, sf_dir):
    return search.filter_options(properties(spark, sf_dir))


#: Titles cut off word by word: the last of the comma parts if it ends in a title noun, then one title before the name.
PLAIN_PLACES = """(SELECT id, CASE WHEN len(p) > 1 AND len(list_filter(['stadt', 'gemeinde', 'flecken', 'bad', 'kurort'], lambda t: suffix(lower(p[-1]), t))) > 0 THEN array_to_string(p[:-2], ',') ELSE g END AS n
  FROM (SELECT id, g, string_split(g, ',') AS p FROM (SELECT id, CASE WHEN suffix(trim(gemeinde), ']') THEN rtrim(string_split(trim(gemeinde), '[')[1]) ELSE trim(gemeinde) END AS g FROM v_properties) a) b)"""


@query(f"SELECT id, nullif(CASE WHEN string_split(n, ' ')[1] IN ('Stadtgemeinde', 'Stadt', 'Gemeinde') AND contains(n, ' ') THEN ltrim(n[strpos(n, ' ') :]) ELSE n END, '') AS gemeinde FROM {PLAIN_PLACES} c")
def normalize_places(spark, sf_dir):
    return search.normalized(properties(spark, sf_dir)).select("id", "gemeinde")


BARE = "replace(gemeinde, ', Stadt', '')"
ODD = f"""CASE id % 6 WHEN 0 THEN 'Stadt' || chr(160) || {BARE} WHEN 1 THEN chr(160) || 'Gemeinde' || chr(9) || {BARE} || ' ' WHEN 2 THEN {BARE} || chr(160) || '[x y]'
  WHEN 3 THEN {BARE} || ',' || chr(160) || 'Bad' WHEN 4 THEN {BARE} || ' [a] b]' ELSE chr(9) || {BARE} || ' [ü ]' END"""


@query(f"SELECT id, CASE id % 6 WHEN 4 THEN {BARE} || ' [a] b]' ELSE {BARE} END AS gemeinde FROM v_properties")
def odd_place_names(spark, sf_dir):
    """Names with white space of all kinds and brackets that don't pair."""
    return properties(spark, sf_dir).select("id", text.place_name(F.expr(ODD)).alias("gemeinde"))


CRS = """CASE id % 8 WHEN 0 THEN 'EPSG:0:25832' WHEN 1 THEN 'x-EPSG:' || CAST(25831 + id % 3 AS STRING) WHEN 2 THEN 'EPSG//25832' WHEN 3 THEN 'epsg::' || CAST(25831 + id % 3 AS STRING)
  WHEN 4 THEN chr(160) || 'EPSG/0/25833' WHEN 5 THEN 'ETRS89_UTM331,ETRS89_UTM32*DE' WHEN 6 THEN 'EPSG:::25832' ELSE 'EPSG/25831 ' END"""


@query("SELECT id, CAST(CASE id % 8 WHEN 1 THEN 25831 + id % 3 WHEN 3 THEN 25831 + id % 3 WHEN 4 THEN 25833 WHEN 5 THEN 25832 WHEN 7 THEN 25831 END AS INTEGER) AS epsg FROM v_properties")
def odd_crs_names(spark, sf_dir):
    """CRS names in forms near those that are told."""
    return properties(spark, sf_dir).select("id", text.epsg(F.expr(CRS)).alias("epsg"))


@query("SELECT id, nullif(trim(CASE id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || str || '  ' ELSE str END), '') AS str FROM v_properties")
def normalize_streets(spark, sf_dir):
    said = F.expr("CASE id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || str || '  ' ELSE str END")
    return properties(spark, sf_dir).select("id", text.street_name(said).alias("str"))


@query("SELECT id, CASE WHEN regexp_matches(trim(code), '^[0-9]{5}$') THEN trim(code) END AS plz FROM (SELECT id, CASE id % 4 WHEN 0 THEN ' ' || plz WHEN 1 THEN plz || '1' ELSE plz END AS code FROM v_properties) t")
def normalize_plz(spark, sf_dir):
    code = F.expr("CASE id % 4 WHEN 0 THEN ' ' || plz WHEN 1 THEN plz || '1' ELSE plz END")
    return properties(spark, sf_dir).select("id", text.postcode(code).alias("plz"))


def key_sql(g: str, s: str, n: str, z: str) -> str:
    part = lambda c, by: f"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '[\\s\\-]+', '{by}', 'g'))"
    street = f"regexp_replace({part(s, ' ')}, 'str\\.(\\s|$)', 'strasse\\1', 'g')"
    return f"concat({part(g, ' ')}, chr(31), {street}, chr(31), {part(n, '')}, chr(31), {part(z, '')})"


KEY = key_sql("gemeinde", "str", "hnr", "hnr_zus")


@query(f"SELECT id, {KEY} AS key FROM v_properties")
def address_key(spark, sf_dir):
    return geocode.keyed(properties(spark, sf_dir)).select("id", "key")


STREET_LINE = "trim(concat(str, ' ', hnr, hnr_zus))"


@query(f"""SELECT id, {STREET_LINE} AS street_line,
  trim(concat(plz, ' ', ort)) || CASE WHEN gemeinde IS NULL OR trim(gemeinde) = '' OR gemeinde = ort THEN '' ELSE ' · ' || gemeinde END AS place_line,
  concat_ws(', ', nullif({STREET_LINE}, ''), nullif(plz, ''), nullif(ort, '')) AS copy_line FROM v_properties""")
def display_lines(spark, sf_dir):
    return search.display_lines(properties(spark, sf_dir))


PLACED = """SELECT id, str, hnr, CASE WHEN id % 7 = 0 THEN 'uneindeutig' ELSE hnr_zus END AS hnr_zus, plz, ort,
  CASE id % 3 WHEN 0 THEN 'nrw' WHEN 1 THEN 'sh' ELSE source END AS source,
  CASE WHEN id % 4 <> 0 THEN CAST(50 + id % 1000 / 1024.0 AS DOUBLE) END AS lat, CASE WHEN id % 4 <> 0 THEN CAST(7 + id % 512 / 512.0 AS DOUBLE) END AS lon FROM v_properties"""


@query(f"""WITH p AS ({PLACED}), q AS (SELECT *, replace(replace(url_encode(concat_ws(', ', trim(concat(str, ' ', hnr, CASE WHEN hnr_zus <> 'uneindeutig' THEN hnr_zus END)), plz, ort)), '+', '%20'), '*', '%2A') AS u,
  regexp_replace(printf('%.6f', lat), '\\.?0+$', '') AS la, regexp_replace(printf('%.6f', lon), '\\.?0+$', '') AS lo FROM p)
SELECT id, '{text.SEARCH_MAP}' || u AS search_link,
  CASE WHEN lat IS NOT NULL THEN '{text.OPEN_MAP}?mlat=' || la || '&mlon=' || lo || '&zoom=17' ELSE '{text.OPEN_MAP}search?query=' || u END AS marker_link,
  CASE source WHEN 'nrw' THEN '{text.NOISE["nrw"]}' WHEN 'sh' THEN '{text.NOISE["sh"]}' END AS noise_link,
  CASE WHEN source = 'nrw' AND lat IS NOT NULL THEN '{text.FLOOD_APP}#widget_567=center:' || lo || '%2C' || la || '%2C4326,scale:5000&widget_568=center:' || lo || '%2C' || la || '%2C4326,scale:5000'
       WHEN source = 'nrw' THEN '{text.FLOOD_PLAIN}' END AS flood_link FROM q""")
def link_columns(spark, sf_dir):
    return search.with_links(spark.sql(PLACED.replace("FROM v_properties", "FROM {p}"), p=properties(spark, sf_dir)))


STATE_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.STATES.items())
SLUGS = "CASE id % 13 WHEN 0 THEN 'NRW' WHEN 1 THEN 'sh' WHEN 2 THEN 'Th' WHEN 3 THEN 'bw' ELSE source END"


@query(f"SELECT DISTINCT CASE lower({SLUGS}) {STATE_CASE} ELSE {SLUGS} END AS name FROM v_properties")
def source_labels(spark, sf_dir):
    return search.source_labels(properties(spark, sf_dir).select(F.expr(SLUGS).alias("source")))


@query("SELECT id, source, plz, gemeinde, CAST(NULL AS VARCHAR) AS lagebez FROM v_properties UNION ALL SELECT parcel_id, 'texts', NULL, NULL, lagebez FROM v_parcel_texts")
def union_sources(spark, sf_dir):
    texts = view(spark, sf_dir, "v_parcel_texts").select(F.col("parcel_id").alias("id"), F.lit("texts").alias("source"), "lagebez")
    return publish.union_sources([properties(spark, sf_dir).select("id", "source", "plz", "gemeinde"), texts])


def replaced(spark, sf_dir):
    """A store in which every source was imported, then src3 replaced, and an import of src4 that lost rows refused."""
    rows = properties(spark, sf_dir).select("id", "str", "plz", "gemeinde", "source")
    store = publish.Store(landing(spark, "store"))
    at = lambda day: datetime.datetime(2024, 1, day)
    k = F.substr(F.col("source"), F.lit(4))
    publish.seed(spark, store, rows.withColumns({"run_id": k.cast("long") + 1, "fingerprint": F.concat(F.lit("f"), k)}), "Initial", at(1))
    run = publish.start(spark, store, "src3", "probed", "Changed", at(3))
    publish.replace(spark, store, run, rows.where("source = 'src3'").withColumn("str", F.concat("str", F.lit("!"))), at(4), skipped=2, fingerprint="imported")
    run = publish.start(spark, store, "src4", "worse", "Changed", at(5))
    with contextlib.suppress(quality.GateError):
        publish.replace(spark, store, run, rows.where("source = 'src4' AND id % 4 = 0"), at(6))
    publish.discard(spark, store, publish.start(spark, store, "src5", None, "Retry", at(7)))
    publish.start(spark, store, "src6", "open", "MaxAge", at(8))
    return store


@query("SELECT id, source, CASE WHEN source = 'src3' THEN str || '!' ELSE str END AS str, plz, CASE WHEN source = 'src3' THEN 14 ELSE CAST(substr(source, 4) AS BIGINT) + 1 END AS run_id FROM v_properties")
def replace_partition(spark, sf_dir):
    return publish.served(spark, replaced(spark, sf_dir)).select("id", "source", "str", "plz", "run_id")


@query("""WITH n AS (SELECT CAST(substr(source, 4) AS BIGINT) AS k, source, count(*) AS c FROM v_properties GROUP BY ALL)
SELECT k + 1 AS run_id, source, 'f' || k AS fingerprint, 'Initial' AS reason, c AS record_count, 0 AS skipped_parts, TRUE AS completed, FALSE AS failed, k <> 3 AS served FROM n
UNION ALL SELECT 14, source, 'imported', 'Changed', c, 2, TRUE, FALSE, TRUE FROM n WHERE k = 3
UNION ALL VALUES (15, 'src4', 'worse', 'Changed', NULL, NULL, FALSE, TRUE, FALSE), (17, 'src6', 'open', 'MaxAge', NULL, NULL, FALSE, FALSE, FALSE)""")
def import_runs(spark, sf_dir):
    """Start, completion, failure and discard of runs, and which are served."""
    store = replaced(spark, sf_dir)
    served = publish.states(spark, store).select(F.col("served_run_id").alias("run_id"), F.lit(True).alias("served"))
    out = publish.runs(spark, store).join(served, "run_id", "left")
    return out.select("run_id", "source", "fingerprint", "reason", "record_count", "skipped_parts", F.col("completed_at").isNotNull().alias("completed"), F.col("failed_at").isNotNull().alias("failed"), F.coalesce("served", F.lit(False)).alias("served"))


@dataclasses.dataclass
class Listed:
    """A source of a round: what its probe tells, and its rows with the version they report."""

    id: str
    told: str
    table: DataFrame | None = None
    reported: str | None = None
    kind: str = "Exact"
    min_age_s: int = 0
    max_age_s: int = 10**9

    def probe(self, spark):
        if self.table is None:
            raise ValueError("no answer")
        return self.told

    def rows(self, spark, fetched):
        fetched.fingerprint = self.reported
        return self.table


def round_of_imports(spark, sf_dir):
    """A store of all sources, an import of src5 that was cut short, then a round over some sources: a changed one that
    reports another version than its probe, one that lost rows, the one cut short, one without change, two whose probes fail."""
    rows = properties(spark, sf_dir).select("id", "str", "plz", "gemeinde", "source")
    store = publish.Store(landing(spark, "store"))
    at = lambda day: datetime.datetime(2024, 1, day)
    k = F.substr(F.col("source"), F.lit(4))
    publish.seed(spark, store, rows.withColumns({"run_id": k.cast("long") + 1, "fingerprint": F.concat(F.lit("f"), k)}), "Initial", at(1))
    publish.start(spark, store, "src5", "lost", "Changed", at(2))
    own = lambda s: rows.where(F.col("source") == s)
    jobs = [Listed("src1", "f1", own("src1")), Listed("src3", "new3", own("src3"), "read3"), Listed("src4", "new4", own("src4").where("id % 4 = 0")), Listed("src5", "new5", own("src5")), Listed("src6", "new6"), Listed("src99", "new99")]
    imports.refresh(spark, store, {j.id: j for j in jobs}, at(10))
    return store


@query("""WITH n AS (SELECT CAST(substr(source, 4) AS BIGINT) AS k, source, count(*) AS c FROM v_properties GROUP BY ALL)
SELECT k + 1 AS run_id, source, 'f' || k AS fingerprint, 'Initial' AS reason, c AS record_count, 'completed' AS outcome, k NOT IN (3, 5) AS served FROM n
UNION ALL SELECT 14, source, 'lost', 'Changed', NULL, 'interrupted', FALSE FROM n WHERE k = 5
UNION ALL SELECT 15, source, 'read3', 'Changed', c, 'completed', TRUE FROM n WHERE k = 3
UNION ALL SELECT 16, source, 'new4', 'Changed', NULL, 'refused', FALSE FROM n WHERE k = 4
UNION ALL SELECT 17, source, 'new5', 'Retry', c, 'completed', TRUE FROM n WHERE k = 5""")
def import_round(spark, sf_dir):
    """Runs after a round: what each came to, its fingerprint and whether it is served."""
    store = round_of_imports(spark, sf_dir)
    served = publish.states(spark, store).select(F.col("served_run_id").alias("run_id"), F.lit(True).alias("served"))
    outcome = F.when(F.col("error") == publish.INTERRUPTED, "interrupted").when(F.col("failed_at").isNotNull(), "refused").when(F.col("completed_at").isNotNull(), "completed")
    return publish.runs(spark, store).join(served, "run_id", "left").select("run_id", "source", "fingerprint", "reason", "record_count", outcome.alias("outcome"), F.coalesce("served", F.lit(False)).alias("served"))


@query("""WITH n AS (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) AS k FROM v_properties)
SELECT source, TIMESTAMP '2024-01-01 00:00:00' + to_days(CASE WHEN k IN (1, 3, 5) THEN 9 ELSE 0 END) AS last_checked_at,
  CASE WHEN k IN (3, 4, 5) THEN 'new' || k WHEN k = 1 THEN 'f1' END AS probe_fingerprint, CASE WHEN k = 6 THEN 'no answer' END AS last_probe_error, CASE WHEN k = 4 THEN 'latest import failed' END AS problem FROM n
UNION ALL SELECT 'src99', NULL, NULL, 'no answer', 'no data and probe failing'""")
def store_health(spark, sf_dir):
    """Sources after a round: when their rows were last current, what their probes told, and the health report."""
    store = round_of_imports(spark, sf_dir)
    known = publish.known(spark, store).select("source", "last_checked_at", "probe_fingerprint", "last_probe_error")
    return known.join(imports.health(spark, store).select("source", "problem"), "source", "left")


@query("""SELECT source, count(*) AS previous, count(*) FILTER (id % 40 <> 0 OR source = 'src1') AS rows,
  count(*) FILTER (id % 40 <> 0 OR source = 'src1') >= count(*) * 0.98 AS passes FROM v_properties GROUP BY source""")
def shrink_check(spark, sf_dir):
    old = properties(spark, sf_dir)
    return quality.shrink_check(old, old.where("id % 40 <> 0 OR source = 'src1'"))
