"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Fixed masks take some tokens of a window and ignore the others, so a substituted
token under a gap leaves the hash as it is. Test and training texts are hashed at
every position and joined on the hash; the hits of one document, item and alignment
are one row, and each alignment is verified once, token by token, over the whole
overlap.

An overlap counts if in WINDOW neighbouring tokens (in all of a shorter item) at
most the share SUBSTITUTIONS / WINDOW, rounded down, is substituted. The masks of an
item go by its length, so that every such overlap is met wherever the substituted
tokens are: two masks of weight 6 and span 8 meet every window of 13 with two and
every item of 10 to 12 with one; items of 7 to 9 have masks of their own; items of
up to 6 tokens allow no substitution, and their mask is the item. Masks that no item
needs are not computed.

The seeds of the benchmark are broadcast in portions whose size is counted first,
one pass over the documents for each; documents are never shuffled by hash. Seeds
travel without their document's tokens. Only documents that are hit are read again.

Defined cases: null or empty text has no tokens and meets nothing, as does an item
without tokens; equal items are reported each; documents with equal text are
reported each, rows with one id as one; an empty table gives no rows; columns
besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, once

WINDOW, SUBSTITUTIONS = 13, 2
#: Token offsets that count, and the fewest and most tokens of an item that they are for.
MASKS: tuple[tuple[tuple[int, ...], int, int], ...] = (
    ((0, 1, 3, 5, 6, 7), 10, 1 << 30),
    ((0, 1, 2, 3, 6, 7), 10, 1 << 30),
    ((0, 1, 2, 3), 7, 9),
    ((0, 1, 2, 4, 5, 6), 7, 9),
    *((tuple(range(n)), n, n) for n in range(1, 7)),
)
#: Benchmark seeds that are broadcast at once (some 40 bytes each).
PORTION = 2_000_000
#: Keys of hit texts that are broadcast, at most (some 50 bytes each); more are joined by a shuffle.
SMALL_KEYS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def span(m: int) -> int:
    return MASKS[m][0][-1] + 1


def seeds(t: Column, masks: list[int]) -> Column:
    """Mask, position and hash under each mask at each position."""

    def under(m: int) -> Column:
        last = F.size(t) - span(m)
        at = lambda k: F.struct(F.lit(m).alias("mask"), k.alias("at"), F.xxhash64(F.lit(m), *(F.get(t, k + o) for o in MASKS[m][0])).alias("seed"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<struct<mask:int,at:int,seed:bigint>>"))

    return F.concat(*(under(m) for m in masks))


def exploded(df: DataFrame, masks: list[int], *carry: str) -> DataFrame:
    """A row for each seed of the tokens t: the carried columns, the number of tokens, and the seed's mask, position and hash."""
    return df.select(*carry, F.size("t").alias("len"), F.inline(seeds(F.col("t"), masks)))


def best_window(match: Column, window: Column) -> Column:
    """Most matches in so many neighbouring places."""
    return F.array_max(F.transform(F.sequence(F.lit(1), F.size(match) - window + 1), lambda k: F.aggregate(F.slice(match, k, window), F.lit(0), lambda a, x: a + x)))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", portion: int = PORTION) -> DataFrame:
    """doc_id, item_id, matched (most equal tokens in a window) and aligned (equal tokens over the whole overlap) of each verified pair."""
    items = once(benchmark.select(F.col(item_col).alias("item_id"), "text"), t=tokens(F.col("text"))).where(F.size("t") > 0).drop("text")
    items = cut(items.withColumn("item_no", F.xxhash64("item_id", "t")).dropDuplicates(["item_no"]))
    sizes = [r["n"] for r in items.select(F.least(F.size("t"), F.lit(10)).alias("n")).distinct().collect()]  # ten at most
    masks = [m for m, (_, low, high) in enumerate(MASKS) if any(low <= n <= high for n in sizes)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("text"))
    hits = []
    if masks:
        fits = reduce(lambda a, m: a | ((F.col("mask") == m) & F.col("len").between(MASKS[m][1], MASKS[m][2])), masks, F.lit(False))
        marks = cut(exploded(items, masks, "item_no").where(fits).select("seed", "item_no", F.col("at").alias("item_at")))
        parts = max(1, -(-marks.count() // portion))
        own = exploded(once(rows.select("key", "text"), t=tokens(F.col("text"))), masks, "key")
        for p in range(parts):
            some = F.broadcast(marks.where(F.pmod("seed", F.lit(parts)) == p) if parts > 1 else marks)
            hits.append(cut(own.join(some, "seed").select("key", "item_no", (F.col("at") - F.col("item_at")).alias("shift")).distinct()))
        discard(marks)
    met = reduce(DataFrame.unionAll, hits).distinct() if hits else items.select(F.lit(0).cast("long").alias("key"), "item_no", F.lit(0).alias("shift")).limit(0)
    keys = met.select("key").distinct()
    few = keys.count() <= SMALL_KEYS
    again = once(rows.join(F.broadcast(keys) if few else keys, "key"), t=tokens(F.col("text"))).select("doc_id", "key", "t")
    laid = again.join(met, "key").join(items.select("item_no", "item_id", F.col("t").alias("item")), "item_no")
    # the item laid along the document, cut at both ends of the document
    lead = F.greatest(F.lit(0), -F.col("shift"))
    start = F.col("shift") + lead
    length = F.least(F.size("item") - lead, F.size("t") - start)
    match = F.zip_with(F.slice("t", start + 1, length), F.slice("item", lead + 1, length), lambda a, b: F.when(a == b, 1).otherwise(0))
    laid = once(laid, match=match).select("doc_id", "item_id", F.least(F.size("item"), F.lit(WINDOW)).alias("window"), "match")
    laid = once(laid.where(F.size("match") >= F.col("window")), matched=best_window(F.col("match"), F.col("window")))
    laid = laid.where(F.col("matched") >= F.col("window") - F.floor(F.col("window") * SUBSTITUTIONS / WINDOW))
    aligned = F.aggregate("match", F.lit(0), lambda a, x: a + x)
    found = laid.select("doc_id", "item_id", "matched", aligned.alias("aligned")).groupBy("doc_id", "item_id")
    out = cut(found.agg(F.max("matched").cast("long").alias("matched"), F.max("aligned").cast("long").alias("aligned")))
    discard(items, *hits)
    return out


#: DuckDB: without masks. Among the tokens of an overlap that counts, three neighbours at least (all of an item of one or two)
#: are equal, as so few substitutions leave longer runs; so every shift under which such a run meets is verified.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower("text"), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents WHERE "text" IS NOT NULL),
b AS (SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(lower("text"), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark WHERE "text" IS NOT NULL),
sizes AS (SELECT DISTINCT least(len(t), 3) AS g FROM b WHERE len(t) > 0),
dk AS (SELECT r, g, unnest(range(1, len(t) - g + 2)) AS k, t FROM d, sizes WHERE len(t) >= g),
bk AS (SELECT i, least(len(t), 3) AS g, unnest(range(1, len(t) - least(len(t), 3) + 2)) AS k, t FROM b WHERE len(t) > 0),
ds AS (SELECT r, k, array_to_string(t[k : k + g - 1], ' ') AS s FROM dk),
bs AS (SELECT i, k, array_to_string(t[k : k + g - 1], ' ') AS s FROM bk),
hits AS (SELECT DISTINCT r, i, ds.k - bs.k AS shift FROM ds JOIN bs USING (s)),
laid AS (SELECT d.doc_id, b.item_id, least(13, len(b.t)) AS w, [CASE WHEN d.t[j + shift] = b.t[j] THEN 1 ELSE 0 END FOR j IN range(greatest(1, 1 - shift), least(len(b.t), len(d.t) - shift) + 1)] AS m
  FROM hits h JOIN d USING (r) JOIN b USING (i)),
met AS (SELECT doc_id, item_id, w, list_sum(m) AS aligned, list_max([list_sum(m[j : j + w - 1]) FOR j IN range(1, len(m) - w + 2)]) AS matched FROM laid WHERE len(m) >= w)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(aligned) AS BIGINT) AS aligned FROM met WHERE matched >= w - (w * 2) // 13 GROUP BY doc_id, item_id
"""
