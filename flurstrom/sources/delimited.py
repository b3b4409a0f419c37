"""Delimited text files as tables: bulk address files, house coordinates, building references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Positions of the fields in the bulk file.
BULK_COLUMNS = {"lagebez": 3, "str": 4, "hnr": 5, "hnr_zus": 6, "plz": 7, "ort": 8, "gemeinde": 9, "flaeche_amtl": 16}
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """A finite decimal number, else NULL; Spark's cast alone would take NaN and a trailing d."""
    c = F.regexp_replace(c, text.BLANK, "")
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def fields(line: Column, sep: str = ";") -> Column:
    """The fields of a line, however many, with quoted separators and doubled quotes read as RFC 4180 has them."""
    s = "\\" + sep if sep == "|" else sep
    # with a separator before the first field too, no match is empty
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf'{s}("[^"]*+(?:""[^"]*+)*+"(?={s}|$)|[^{s}]*+)'), F.lit(1))
    quoted = lambda f: f.startswith('"') & f.endswith('"') & (F.char_length(f) > 1)
    return F.transform(found, lambda f: F.when(quoted(f), F.replace(F.substr(f, F.lit(2), F.char_length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def bulk(spark: SparkSession, path: str, columns: dict[str, int] = BULK_COLUMNS, least: int = 17) -> DataFrame:
    """Rows of every file below path but its first line; without street or number they are dropped, bad codes and areas become NULL."""
    heads = spark.read.option("header", "true").option("sep", "\x00").option("quote", "").csv(path)  # one column: each file's lines after the first
    body = heads.toDF("value").where("value IS NOT NULL")
    out = body.select(F.inline(F.array(F.struct(fields(F.col("value")).alias("f"))))).where(F.size("f") >= least)
    take = lambda k: text.blank_to_null(F.get("f", F.lit(columns[k])))
    some = lambda c: F.when(F.lower(c) != "null", c)
    got = out.select(*(some(take(k)).alias(k) for k in columns))
    got = got.where("str IS NOT NULL AND hnr IS NOT NULL")
    return got.withColumns({"plz": text.postcode(F.col("plz")), "gemeinde": F.when(F.col("gemeinde").rlike(r"^\p{L}"), F.col("gemeinde")), "flaeche_amtl": number(F.col("flaeche_amtl"))})


SEPARATORS = ";,\t|"
REQUIRED = ("qua", "gmd", "str", "hnr", "ostwert", "nordwert")
OPTIONAL = ("ott", "adz", "zone", "postplz")


def separator(header: Column) -> Column:
    """The most frequent of SEPARATORS outside quotes; of equally frequent ones the first."""
    bare = F.regexp_replace(header, '"[^"]*"', "")
    count = lambda s: F.char_length(bare) - F.char_length(F.replace(bare, F.lit(s), F.lit("")))
    best = F.array_max(F.array(*(F.struct(count(s).alias("n"), F.lit(-k).alias("k")) for k, s in enumerate(SEPARATORS))))
    return F.substr(F.lit(SEPARATORS), 1 - best["k"], F.lit(1))


def by_separator(line: Column, sep: Column) -> Column:
    out = F.when(sep == SEPARATORS[0], fields(line, SEPARATORS[0]))
    for s in SEPARATORS[1:]:
        out = out.when(sep == s, fields(line, s))
    return out


def house_coordinates(spark: SparkSession, path: str, zone: int = 32, qualities: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """A row for each line of every file below path with its verdict: accepted, other quality or malformed.

    Each file has its own separator and order of columns, which its header tells by name; a file without
    a header of the required columns fails the job. Quality is judged before coordinates are read, and a
    line with coordinates in another UTM zone fails the job, as it would land kilometres off. The byte
    order mark and blank lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value")).where(F.trim("value") != "")
    # of each file the line that names the columns; there are as many rows as files
    heads = lines.where(F.lower("value").contains("ostwert")).select("file", "value", separator(F.col("value")).alias("sep"))
    heads = heads.withColumn("names", F.transform(by_separator(F.col("value"), F.col("sep")), lambda n: F.lower(F.trim(n))))
    heads = heads.where(F.size(F.array_intersect("names", F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED)).groupBy("file").agg(F.min(F.struct("value", "sep", "names")).alias("head"))
    rows = lines.join(heads, "file", "left").where(F.when(F.col("head").isNull(), F.raise_error(F.concat(F.lit("no header with the columns "), F.lit(", ".join(REQUIRED)), F.lit(" in "), "file"))).otherwise(F.col("value") != F.col("head.value")))
    rows = rows.select(F.col("head.names").alias("names"), F.inline(F.array(F.struct(by_separator(F.col("value"), F.col("head.sep")).alias("f")))))
    take = lambda n: F.when(F.array_contains("names", n), text.blank_to_null(F.get("f", (F.array_position("names", F.lit(n)) - 1).cast("int"))))
    got = rows.select((F.size("f") == F.size("names")).alias("whole"), *(take(n).alias(n) for n in REQUIRED + OPTIONAL))
    x, y = number(F.col("ostwert")), number(F.col("nordwert"))
    foreign = F.col("zone").isNotNull() & ~F.equal_null(F.col("zone").try_cast("int"), F.lit(zone))
    verdict = (
        F.when(~F.col("whole"), "malformed")
        .when(~F.coalesce(F.upper("qua").isin(*(q.upper() for q in qualities)), F.lit(False)), "other quality")
        .when(x.isNull() | y.isNull(), "malformed")
        .when(foreign, F.raise_error(F.concat(F.lit("UTM zone "), "zone", F.lit(f" in place of {zone}"))).cast("string"))
        .otherwise("accepted")
    )
    gemeinde = text.place_name(F.col("gmd"))
    ort = F.coalesce(text.place_name(text.named_district(F.col("ott"))), gemeinde)
    return got.select("str", "hnr", F.col("adz").alias("hnr_zus"), text.postcode(F.col("postplz")).alias("plz"), ort.alias("ort"), gemeinde.alias("gemeinde"), x.alias("x"), y.alias("y"), verdict.alias("verdict"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("verdict = 'accepted'").drop("verdict")


def read_tally(rows: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v)
    return rows.agg(F.count("*").alias("rows"), count("accepted").alias("accepted"), count("other quality").alias("other_quality"), count("malformed").alias("malformed"))


def building_references(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line: its address, position and whether it could be read."""
    rows = spark.read.text(path).select(F.split("value", ";").alias("f"))
    take = lambda k: F.get("f", F.lit(k))
    x, y = number(take(18)), number(take(19))
    ok = (F.size("f") >= 20) & (F.trim(take(17)) == "32") & x.isNotNull() & y.isNotNull()
    names = {"gemeinde": 10, "str": 14, "hnr": 15, "hnr_zus": 16}
    return rows.select(*(text.blank_to_null(take(k)).alias(n) for n, k in names.items()), x.alias("x"), y.alias("y"), F.coalesce(ok, F.lit(False)).alias("readable"))
