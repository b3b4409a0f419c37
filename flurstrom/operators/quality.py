"""Gates: one-row aggregates of what an import read, and their enforcement before it is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(Exception):
    """A gate refused the rows; what was served before stays."""


def completeness(points: DataFrame, owned: str, expected: int | None = None) -> DataFrame:
    """Owned addresses against those expected; with none expected the ratio is 1."""
    want = F.lit(expected) if expected is not None else F.count("*")
    out = points.agg(F.count_if(F.col(owned)).alias("owned"), want.cast("long").alias("expected"))
    return out.withColumn("ratio", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("owned") / F.col("expected")))


def join_quality(matched: DataFrame, missing: DataFrame | None = None, max_unmatched: float = 0.2, min_filled: float = 0.95) -> DataFrame:
    """Of owned rows the unmatched ones, of rows without postcode those filled, and whether both are good enough.

    matched: columns matched, needs_plz and got_plz (booleans)."""
    out = matched.agg(
        F.count("*").alias("owned"),
        F.count_if(~F.col("matched")).alias("unmatched"),
        F.count_if(F.col("needs_plz")).alias("missing"),
        F.count_if(F.col("needs_plz") & F.col("got_plz")).alias("filled"),
    )
    unmatched = F.when(F.col("owned") > 0, F.col("unmatched") / F.col("owned"))
    filled = F.when(F.col("missing") > 0, F.col("filled") / F.col("missing"))
    passes = (F.col("owned") > F.col("unmatched")) & (F.coalesce(unmatched, F.lit(1.0)) <= max_unmatched) & (F.coalesce(filled, F.lit(1.0)) >= min_filled)
    return out.withColumns({"unmatched_ratio": unmatched, "filled_ratio": filled}).withColumn("passes", passes)


def shrink_check(old: DataFrame, new: DataFrame, least: float = 0.98) -> DataFrame:
    """Rows of each source before and after, and whether the new ones are enough."""
    n = lambda d, name: d.groupBy("source").agg(F.count("*").alias(name))
    both = n(old, "previous").join(n(new, "rows"), "source", "full").fillna(0, ["previous", "rows"])
    return both.withColumn("passes", (F.col("previous") == 0) | (F.col("rows") >= F.col("previous") * least))


def readability(lines: DataFrame, readable: str) -> DataFrame:
    """Refused where there is no line, or where over half of them (rounded down) can't be read."""
    out = lines.agg(F.count("*").alias("lines"), F.count_if(~F.col(readable)).alias("skipped"))
    return out.withColumn("passes", (F.col("lines") > 0) & (F.col("skipped") <= F.floor(F.col("lines") / 2)))


def over_delivery(rows: DataFrame, key: str, expected: int, page: int) -> DataFrame:
    """More rows than announced and a page besides mean repeated pages."""
    out = rows.agg(F.count("*").alias("delivered"), (F.count("*") - F.countDistinct(key)).alias("repeated"))
    return out.withColumn("passes", F.col("delivered") <= expected + page)


def full_pages(members: DataFrame, page: str, limit: int) -> DataFrame:
    """Pages that hold as many members as the limit or more: there may be others behind."""
    return members.groupBy(page).agg(F.count("*").alias("members")).where(F.col("members") >= limit)


def foreign_crs(pages: DataFrame, page: str, epsg: str, expected: int) -> DataFrame:
    """Codes of each page that aren't the expected one; an unreadable name counts."""
    return pages.where(~F.equal_null(epsg, F.lit(expected))).select(page, F.col(epsg).alias("epsg")).distinct()


def enforce(gate: DataFrame, what: str) -> None:
    """Raises where a row of the gate doesn't pass."""
    bad = gate.where(~F.coalesce("passes", F.lit(False))).limit(5).collect()
    if bad:
        raise GateError(f"{what}: {[r.asDict() for r in bad]}")
