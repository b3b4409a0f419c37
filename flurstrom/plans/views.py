"""Views over the driver's tables in the shapes of the served and landed tables; plain SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "events", "nation", "orders", "part", "supplier")

VIEWS = {
    "v_properties": """
SELECT p_partkey AS id,
       p_name || ' ' || CASE p_size % 4 WHEN 0 THEN 'Str.' WHEN 1 THEN 'Straße' WHEN 2 THEN 'Weg' ELSE 'Öl-Allee' END AS str,
       CAST(p_size AS STRING) AS hnr,
       CASE p_partkey % 5 WHEN 1 THEN 'a' WHEN 2 THEN 'B' END AS hnr_zus,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(10000 + p_partkey % 25 AS STRING) END AS plz,
       p_type AS ort,
       replace(p_brand, '#', ' ') || CASE p_partkey % 3 WHEN 0 THEN ', Stadt' ELSE '' END AS gemeinde,
       p_retailprice AS flaeche_amtl,
       'src' || CAST(p_partkey % 13 AS STRING) AS source
FROM part
""",
    "v_parcels": """
SELECT s_suppkey AS parcel_id,
       CAST((s_suppkey % 10) * 100 + floor(s_suppkey / 100) * 4 AS DOUBLE) AS min_x,
       CAST((floor(s_suppkey / 10) % 10) * 100 + floor(s_suppkey / 100) * 4 AS DOUBLE) AS min_y,
       CAST(100 - floor(s_suppkey / 100) * 8 AS DOUBLE) AS edge,
       s_acctbal AS area_m2
FROM supplier
""",
    "v_points": """
SELECT c_custkey AS address_id,
       CAST(CASE WHEN c_custkey % 50 = 0 THEN (c_custkey % 7) * 100 ELSE (c_custkey * 37) % 1000 + 0.5 END AS DOUBLE) AS x,
       CAST((c_custkey * 91) % 1000 + 0.5 AS DOUBLE) AS y,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(10000 + c_nationkey AS STRING) END AS plz,
       c_mktsegment AS gemeinde
FROM customer
""",
    "v_postcode_areas": """
SELECT CAST(10000 + n_nationkey AS STRING) AS plz,
       CAST((n_nationkey % 5) * 200 AS DOUBLE) AS min_x,
       CAST(floor(n_nationkey / 5) * 200 AS DOUBLE) AS min_y,
       CAST(CASE WHEN n_nationkey % 2 = 1 THEN 150 ELSE 200 END AS DOUBLE) AS edge
FROM nation
""",
    "v_house_points": """
SELECT p_partkey AS ord,
       replace(p_brand, '#', ' ') || CASE p_partkey % 3 WHEN 0 THEN ', Stadt' ELSE '' END AS gemeinde,
       upper(p_name) || ' ' || CASE p_size % 4 WHEN 0 THEN 'Straße' WHEN 1 THEN 'str.' WHEN 2 THEN 'WEG' ELSE 'Öl Allee' END AS str,
       CAST(p_size AS STRING) AS hnr,
       CASE p_partkey % 5 WHEN 1 THEN ' A' WHEN 2 THEN 'b' END AS hnr_zus,
       CAST((p_partkey * 53) % 1000 + 0.5 AS DOUBLE) AS x,
       CAST((p_partkey * 71) % 1000 + 0.5 AS DOUBLE) AS y
FROM part WHERE p_partkey % 4 <> 0
""",
    "v_parcel_texts": """
SELECT p_partkey AS parcel_id,
       CASE p_partkey % 6
         WHEN 0 THEN p_name || ' Weg ' || CAST(p_size AS STRING)
         WHEN 1 THEN p_name || ' Gasse 3, 3 A, ' || CAST(p_size AS STRING) || '; Zollplatz 15,16b'
         WHEN 2 THEN 'L ' || CAST(p_size AS STRING) || '; Kurze 5 Morgen'
         WHEN 3 THEN 'Straße des 17. Juni ' || CAST(p_size AS STRING) || '; Am Tor 2; Am Tor 2'
         WHEN 4 THEN 'Kleingartenanlage'
         ELSE NULL END AS lagebez,
       p_retailprice AS area_m2
FROM part
""",
    "v_runs": """
SELECT o_orderkey AS run_id,
       'src' || CAST(o_custkey % 13 AS STRING) AS source,
       'f' || CAST(o_orderkey % 4 AS STRING) AS fingerprint,
       o_orderdate AS started_at,
       CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 2 HOURS END AS completed_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 HOURS END AS failed_at,
       CASE WHEN o_orderstatus = 'F' THEN 'error ' || o_orderpriority END AS error,
       CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS BIGINT) ELSE 0 END AS record_count,
       CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS skipped_parts
FROM orders
""",
    "v_usage": """
SELECT event_id, ts, user_id,
       CASE event_type WHEN 'view' THEN 'page_loads' WHEN 'purchase' THEN 'searches'
                       WHEN 'signup' THEN 'table_row_opens' WHEN 'click' THEN 'outgoing_clicks' END AS kind,
       props
FROM events
""",
}
#: Served run of each source: its latest completed one.
VIEWS["v_states"] = """
SELECT source, run_id AS served_run_id, fingerprint AS probe_fingerprint, completed_at + INTERVAL 30 HOURS AS last_checked_at,
       CASE WHEN source IN ('src3', 'src7') THEN 'timeout' END AS last_probe_error
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY completed_at DESC, run_id DESC) AS rn FROM v_runs WHERE completed_at IS NOT NULL) t
WHERE rn = 1 AND source <> 'src11'
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in sf_dir."""
    sql = VIEWS[name]
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\bFROM {t}\b", sql)}
    args |= {v: view(spark, sf_dir, v) for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)}
    for t in args:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **args)


def with_views(sql: str) -> str:
    """The SQL with the views it names as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    ctes = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in dict.fromkeys(need))
    if not ctes:
        return sql
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
