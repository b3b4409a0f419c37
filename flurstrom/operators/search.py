"""Search over the served table, its location lists, labels and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def visible(df: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Rows of sources that aren't disabled; no filter at all where none is."""
    return df.where(~F.col("source").isin(*disabled)) if disabled else df


def search(df: DataFrame, plz: str | None = None, gemeinde: str | None = None, min_area: float | None = None, max_area: float | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Only the predicates given; an area bound leaves out rows without area."""
    df = visible(df, disabled)
    for given, condition in ((gemeinde, F.col("gemeinde") == gemeinde), (plz, F.col("plz") == plz), (min_area, F.col("flaeche_amtl") >= min_area), (max_area, F.col("flaeche_amtl") <= max_area)):
        if given is not None:
            df = df.where(condition)
    return df


def order(key: str = "id") -> list[Column]:
    """Postcode, street by German collation, number by length and text, no suffix first; NULLs last; the id decides ties."""
    return [
        F.col("plz").asc_nulls_last(),
        F.collate(F.col("str"), "de").asc_nulls_last(),
        F.char_length("hnr").asc_nulls_last(),
        F.col("hnr").asc_nulls_last(),
        F.col("hnr_zus").isNotNull().asc(),
        F.col("hnr_zus").asc_nulls_last(),
        F.col(key).asc(),
    ]


def top(df: DataFrame, limit: int = 500) -> DataFrame:
    return df.orderBy(*order()).limit(limit)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Each value once, sorted, without NULL."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def filter_options(df: DataFrame) -> DataFrame:
    """Postcodes, then municipalities, each once and sorted."""
    names = lambda c, is_plz: df.where(F.col(c).isNotNull()).select(F.col(c).alias("name"), F.lit(is_plz).alias("is_plz")).distinct()
    return names("plz", True).unionByName(names("gemeinde", False)).orderBy(F.col("is_plz").desc(), "name")


def display_lines(df: DataFrame) -> DataFrame:
    street = text.street_line(F.col("str"), F.col("hnr"), F.col("hnr_zus"))
    return df.select("id", street.alias("street_line"), text.place_line(F.col("plz"), F.col("ort"), F.col("gemeinde")).alias("place_line"), text.joined(", ", street, F.col("plz"), F.col("ort")).alias("copy_line"))


def with_links(df: DataFrame) -> DataFrame:
    return df.select("id", *(c.alias(k) for k, c in text.links(*(F.col(k) for k in ("str", "hnr", "hnr_zus", "plz", "ort", "source", "lat", "lon"))).items()))


def source_labels(df: DataFrame) -> DataFrame:
    """Names of the sources' states, each once, in code-point order."""
    return df.select(text.state_name(F.col("source")).alias("name")).distinct().orderBy("name")


def normalized(df: DataFrame) -> DataFrame:
    """Served rows with their names and codes standardized."""
    return df.withColumns({"gemeinde": text.place_name(F.col("gemeinde")), "ort": text.place_name(F.col("ort")), "str": text.street_name(F.col("str")), "plz": text.postcode(F.col("plz"))})


def served_key(status: DataFrame) -> str:
    """The set of runs that are served, as one text: what the options are valid for."""
    rows = status.where("record_count > 0").agg(F.sort_array(F.collect_list(F.concat_ws("=", "source", F.col("served_run_id").cast("string")))).alias("k"))
    return ",".join(rows.first()["k"])  # an entry for each source, of which there are a few


def refresh_options(df: DataFrame, status: DataFrame, path: str) -> bool:
    """Writes the filter options of the served set to its partition of the table at path, unless they are there; says whether it wrote."""
    spark, key = df.sparkSession, served_key(status)
    try:
        if spark.read.parquet(path).where(F.col("served") == key).limit(1).count():
            return False
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    filter_options(df).withColumn("served", F.lit(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("served").parquet(path)
    return True
