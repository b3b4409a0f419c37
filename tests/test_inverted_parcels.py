"""Parcels of large keys, whose edge falls below 0: the queries over them against their SQL."""

from collections import Counter

import duckdb
import pytest

from flurstrom.operators import spatial
from flurstrom.plans import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("inverted")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SMALL}/customer.parquet') TO '{top}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{SMALL}/nation.parquet') TO '{top}/nation.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE (CAST(s_suppkey + k AS BIGINT) AS s_suppkey) FROM '{SMALL}/supplier.parquet', (SELECT 700 * (1 + i % 4) + 10 * (i // 4) AS k FROM range(40) r(i)) v) TO '{top}/supplier.parquet' (FORMAT parquet)")
    return str(top)


NAMES = ["box_intersect_join", "point_in_polygon", "dealt_point_in_polygon", "join_quality", "polygon_area", "ingest_parcels", "configured_source", "parse_rings"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("customer", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    said = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]}) o").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(said) and said


def test_more_points_on_one_place_than_a_cell_holds(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CAST(c_custkey % 3 + 1000 * (i * 150 + c_custkey) AS BIGINT) AS c_custkey) FROM '{SMALL}/customer.parquet', range(50) r(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE (CAST(s_suppkey + 10 * i AS BIGINT) AS s_suppkey) FROM '{SMALL}/supplier.parquet', range(10) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = QUERIES["dealt_point_in_polygon"](spark, str(tmp_path))
    said = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['dealt_point_in_polygon']}) o").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(said) and len(said) > 4000


def test_boxes_the_wrong_way_round_are_filed_nowhere(spark, monkeypatch):
    filed, layered = [], spatial.layered
    monkeypatch.setattr(spatial, "layered", lambda *a: filed.append(layered(*a)) or filed[0])
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, -5000.0, -5000.0), (3, 7.0, 7.0, 7.0, 7.0)], "b int, min_x double, min_y double, max_x double, max_y double")
    points = spark.createDataFrame([(1, 7.0, 7.0), (2, -3.0, -3.0)], "p int, x double, y double")
    assert sorted(map(tuple, spatial.meeting_boxes(points, boxes, "p", "b", 100.0).collect())) == [(1, 1), (1, 3)]
    assert filed[0].count() == 2
