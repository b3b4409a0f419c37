"""Column functions on small tables of cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flurstrom.functions import geo, text


def apply(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["r"] for r in df.select("k", f(F.col("v")).alias("r")).orderBy("k").collect()]


def test_place_names(spark):
    cases = {
        "Pirna, Stadt": "Pirna", "Kiel, Landeshauptstadt": "Kiel", "Juist, Inselgemeinde": "Juist", "Stadtgemeinde Bremen": "Bremen", "Stadt Stadt Wehlen": "Stadt Wehlen",
        " Bautzen [Budyšin] ": "Bautzen", "Göttingen, Berg- und Universitätsstadt": "Göttingen", "Norderney, Nordseebad": "Norderney", "Masserberg, Kurort": "Masserberg", "Lilienthal": "Lilienthal",
        "Halstenbek, gemeinde": "Halstenbek", "Stadthagen": "Stadthagen", " ": None, "": None, None: None, "Bodenteich, Klosterflecken": "Bodenteich",
        "Foo, Bar, Stadt": "Foo, Bar", "Foo, 2. Stadt": "Foo, 2. Stadt", "Foo, Stadtteil": "Foo, Stadtteil", "Gemeinde": "Gemeinde", "Stadt  Pirna": "Pirna", "A [b] [c]": "A [b]", "A [b] c": "A [b] c", "A]": "A]", "Cottbus [Chóśebuz], Stadt": "Cottbus [Chóśebuz]",
    }
    assert apply(spark, cases, text.place_name) == list(cases.values())


def test_postcodes_streets_and_districts(spark):
    assert apply(spark, ["12345", " 01067 ", "1234", "66-400", "123456", "１２３４５", None], text.postcode) == ["12345", "01067", None, None, None, None, None]
    assert apply(spark, [" Weg ", " ", None], text.street_name) == ["Weg", None, None]
    assert apply(spark, ["Mitte Bezirk 12", "Bezirk 3", "Altdorf"], text.named_district) == [None, "Bezirk 3", "Altdorf"]


def test_address_keys_agree(spark):
    rows = [("Öckendorf", "Schlaraffiastr.", "2", "A"), ("öckendorf", "Schlaraffiastraße", "2 ", "a"), ("Bad-Kreuznach", "Öckendorfer Str.", "1", None), ("bad  kreuznach", "Öckendorfer-Straße", "1", " ")]
    df = spark.createDataFrame(rows, "g string, s string, n string, z string")
    keys = [r[0] for r in df.select(text.address_key(F.col("g"), F.col("s"), F.col("n"), F.col("z"))).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[0] != keys[2]


def test_crs_names(spark):
    cases = {"urn:ogc:def:crs:EPSG::25832": 25832, "http://www.opengis.net/def/crs/EPSG/0/25833": 25833, "EPSG:4258": 4258, "ETRS89_UTM32*DE_DHHN2016_NH": 25832, "ETRS89_UTM34": None, "urn:adv:crs:ETRS89_UTM331": None, "etrs89_utm33": 25833, "epsg/25831": 25831, "EPSG:x1": None, "EPSG:": None, "25832": None, "local": None, None: None}
    assert apply(spark, cases, text.epsg) == list(cases.values())


@pytest.mark.parametrize(
    "said, addresses, unread",
    [
        ("Weg 5", [("Weg", "5", None)], 0),
        ("Am Tor 2; Am Tor 2", [("Am Tor", "2", None)], 0),
        ("Straße des 17. Juni 5", [("Straße des 17. Juni", "5", None)], 0),
        ("Gasse 3, 3 A, 7b; Zollplatz 15,16b", [("Gasse", "3", None), ("Gasse", "3", "A"), ("Gasse", "7", "b"), ("Zollplatz", "15", None), ("Zollplatz", "16", "b")], 0),
        ("L 12; Kurze 5 Morgen", [], 1),
        ("Haus 3 4", [("Haus 3", "4", None)], 0),
        ("Weg, 3", [("Weg,", "3", None)], 0),
        ("Alt, Neu 3 ,4 b", [("Alt, Neu", "3", None), ("Alt, Neu", "4", "b")], 0),
        ("5; 7, 8", [], 1),
        ("Kleingartenanlage", [], 0),
        (" ", [], 0),
        (None, [], 0),
    ],
)
def test_parcel_texts(spark, said, addresses, unread):
    r = spark.createDataFrame([(said,)], "v string").select(text.addresses_in(F.col("v")).alias("a"), text.unread_parts(F.col("v")).alias("u")).collect()[0]
    assert [tuple(x) for x in r["a"]] == addresses and r["u"] == unread


def read_plainly(said):
    """Addresses and unread parts, by trying every white space of a part as the end of its street."""

    def number(token):
        digits = token.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") if len(token) > 1 and not token[-2:].isalpha() else token
        gone = token[len(digits) :]
        digits = digits[:-1] if gone and digits.endswith(" ") else digits
        return (digits, gone or None) if digits and all(c in "0123456789" for c in digits) else None

    out, unread = [], 0
    for part in map(str.strip, (said or "").split(";")):
        found = None
        for at in range(1, len(part)):
            if part[at - 1].isspace() and not part[at].isspace():
                numbers = [number(t.strip()) for t in part[at:].split(",")]
                if all(numbers) and part[:at].strip():
                    found = part[:at].rstrip(), numbers
                    break
        if found is None:
            unread += any(c in "0123456789" for c in part)
        elif sum(c.isalpha() for c in found[0]) >= 2:
            out += [(found[0], *n) for n in found[1] if (found[0], *n) not in out]
    return out, unread


def test_parcel_texts_read_as_a_plain_reader_does(spark):
    rng = random.Random(8)
    said = ["".join(rng.choices(["Weg", "Am", "L", "3", "17", "5", "a", "B", " ", " ", " ", ",", ",", ";", "\u00a0", ".", "St1"], k=rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(said)), "k int, v string").repartition(8)
    for r in df.select("v", text.addresses_in(F.col("v")).alias("a"), text.unread_parts(F.col("v")).alias("u")).collect():
        assert ([tuple(x) for x in r["a"]], r["u"]) == read_plainly(r["v"]), r["v"]


def test_place_names_with_odd_space_and_brackets(spark):
    cases = {"Stadt\u00a0Pirna": "Pirna", "Stadt\tPirna": "Pirna", "\u00a0Stadt \u2003Pirna ": "Pirna", "A\u00a0[b]": "A", "A [b ]": "A", "a [b] c]": "a [b] c]", "a [b [c]": "a", "Kiel,\u00a0Stadt": "Kiel", "Kiel, Alt\u00a0Stadt": "Kiel, Alt\u00a0Stadt", "Stadt , Stadt": None, "[x]": None, "Kiel , Stadt": "Kiel "}
    assert apply(spark, cases, text.place_name) == list(cases.values())


def test_odd_crs_names(spark):
    cases = {"EPSG:0:25832": None, "EPSG//25832": None, "x-EPSG:25832": 25832, "EPSG/0/25832": 25832, "epsg::25833 ": 25833, "EPSG:::25832": None, "EPSG/25831": 25831, "EPSG:99999999999": None, "ETRS89_UTM331 ETRS89_UTM32": 25832, "a ETRS89_UTM31,ETRS89_UTM33": 25831, "EPSG:25832:": None}
    assert apply(spark, cases, text.epsg) == list(cases.values())


def test_lines_and_links(spark):
    df = spark.createDataFrame([("Kölner Str.", "17", "uneindeutig", "50823", "Köln", "Köln", "nrw", 50.5, 7.25), (None, None, None, None, None, "X", "sh", None, None)], "s string, n string, z string, p string, o string, g string, q string, a double, b double")
    c = {k: F.col(k) for k in df.columns}
    got = df.select(text.street_line(c["s"], c["n"], text.known(c["z"])).alias("line"), text.place_line(c["p"], c["o"], c["g"]).alias("place"), *(x.alias(k) for k, x in text.links(c["s"], c["n"], c["z"], c["p"], c["o"], c["q"], c["a"], c["b"]).items())).collect()
    assert got[0]["line"] == "Kölner Str. 17" and got[0]["place"] == "50823 Köln" and got[1]["place"] == " · X".strip(" ") or got[1]["place"].endswith("X")
    assert got[0]["search_link"].endswith("K%C3%B6lner%20Str.%2017%2C%2050823%2C%20K%C3%B6ln")
    assert "mlat=50.5&mlon=7.25&" in got[0]["marker_link"] and "center:7.25%2C50.5%2C4326" in got[0]["flood_link"]
    assert got[1]["noise_link"].startswith("https://danord") and got[1]["flood_link"] is None


def square(x0, y0, e):
    return [(x0, y0), (x0 + e, y0), (x0 + e, y0 + e), (x0, y0 + e), (x0, y0)]


def test_containment_area_and_interior(spark):
    hole = [[square(0.0, 0.0, 10.0), square(4.0, 4.0, 2.0)], [square(20.0, 0.0, 5.0)]]
    u = [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (8.0, 10.0), (8.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0), (0.0, 0.0)]]]
    df = spark.createDataFrame([(1, hole), (2, u)], f"id int, g {geo.GEOMETRY}")
    at = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (4.0, 5.0), (0.0, 5.0), (10.0, 10.0), (22.0, 2.0), (15.0, 2.0), (9.0, 9.0), (5.0, 1.0)], "x double, y double")
    inside = {(r["id"], r["x"], r["y"]) for r in df.crossJoin(at).where(geo.contains(geo.edges(F.col("g")), F.col("x"), F.col("y"))).collect()}
    assert inside == {(1, 1.0, 1.0), (1, 22.0, 2.0), (1, 9.0, 9.0), (1, 5.0, 1.0), (2, 1.0, 1.0), (2, 9.0, 9.0), (2, 5.0, 1.0)}
    assert [r[0] for r in df.orderBy("id").select(geo.area(F.col("g"))).collect()] == [121.0, 52.0]
    p = df.select("id", "g", geo.interior_point(F.col("g")).alias("p")).where(geo.contains(geo.edges(F.col("g")), F.col("p.x"), F.col("p.y")))
    assert p.count() == 2
    none = spark.createDataFrame([(None,), ([],)], f"g {geo.GEOMETRY}")
    assert [r[0] for r in none.select(geo.interior_point(F.col("g"))).collect()] == [None, None]


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(25833, 391779.26, 5820072.16), (25832, 798809.0, 5828000.0), (4326, 1.0, 2.0)], "code int, x double, y double")
    out = df.select("x", "y", "code", geo.to_lon_lat(F.col("code"), F.col("x"), F.col("y")).alias("p"))
    rows = out.select("x", "y", "p", geo.to_utm(F.col("code"), F.col("p.lon"), F.col("p.lat")).alias("b")).collect()
    for r in rows[:2]:
        assert math.hypot(r["b"]["x"] - r["x"], r["b"]["y"] - r["y"]) < 1e-3 and 50 < r["p"]["lat"] < 55
    assert rows[2]["p"]["lon"] is None
