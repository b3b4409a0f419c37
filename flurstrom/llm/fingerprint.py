"""Fingerprints of documents: bottom-k sketches of word shingles, with DataFrame functions only.

A shingle ends at each word: it, with up to four words before it. The least ``k``
distinct hashes of a text's shingles are its sketch, kept as one string. Sketches of
parts merge into the sketch of the whole, and tell how alike two texts' shingle sets
are, how much of one lies in the other, and how many distinct shingles there are.

Each document is also compared with the next one by ascending id. Rows are dealt to
ranges of ids (an id with very many rows to ranges of its texts' hashes) of bounded
size, by boundaries that an approximate quantile of the ids gives; inside a range the
next row is a window's lead, and the first row of the next range is a guest at its end.

Defined cases: null text is empty; an empty text has an empty fingerprint, like that of
another empty text (1) and unlike all others (0); a text with fewer words than a shingle
has its shorter shingles; texts without white space are one word; very long texts are
sketched in portions of words; rows with equal ids are ordered by their texts' hashes,
null ids come first; equal rows follow one another and have a result each; one row is
followed by itself; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, once

K, WORDS = 128, 5
#: Words of a portion of a text that is sketched at once.
PORTION = 20_000
#: Bytes of the texts of a range of ids, about, and how many ranges there may be.
RANGE_BYTES, RANGES = 4 << 20, 100_000
HASH = 16  # hexadecimal digits
LEAST = -(1 << 63)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space."""
    return F.filter(F.split(F.translate(text, "\t\n\v\f\r", "     "), " "), lambda w: w != "")


def least(hashes: Column, k: int) -> Column:
    """The k least distinct of an array of hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<string>: the bottom-k sketch of a text's shingles."""

    def hashed(ws: Column, i: Column) -> Column:
        return F.left(F.md5(F.array_join(F.slice(ws, F.greatest(i - (words - 1), F.lit(1)), F.least(i, F.lit(words))), " ")), F.lit(HASH))

    def portion(ws: Column, p: Column) -> Column:
        first = p * PORTION + 1
        return least(F.transform(F.sequence(first, F.least(first + PORTION - 1, F.size(ws))), lambda i: hashed(ws, i)), k)

    def of(ws: Column) -> Column:
        portions = F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / PORTION).cast("int"))
        several = least(F.flatten(F.transform(portions, lambda p: portion(ws, p))), k)
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).when(F.size(ws) <= PORTION, portion(ws, F.lit(0))).otherwise(several)

    return let(words_of(text), of)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketched parts have together, by the shingles of both."""
    return least(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of all shingles of two texts that both have; of two empty ones 1."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles, exact below k."""
    # the k-th least of so many even hashes stands at k of their number
    part = (F.conv(F.left(F.element_at(a, -1), F.lit(12)), 16, 10).cast("double") + 1) / 16.0**12
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of a's shingles that b has too; of an empty a 1."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared / distinct_count(a, k), F.lit(1.0)))


def written(a: Column) -> Column:
    return F.array_join(a, ",")


def read(fingerprint: Column) -> Column:
    return F.when(fingerprint == "", F.array().cast("array<string>")).otherwise(F.split(fingerprint, ","))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, fingerprint and the estimated number of distinct shingles of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = once(docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), text.alias("text")), sketch=sketch(F.col("text"), k, words))
    return rows.select("doc_id", "n_chars", written(F.col("sketch")).alias("fingerprint"), distinct_count(F.col("sketch"), k).alias("n_shingles"))


def edited(text: Column, following: Column) -> Column:
    """The text whose last half of code points gives way to as many of the following text's first."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def below(bounds: list[int], value: Column, also: bool) -> Column:
    """How many of the ascending bounds are below value (or equal to it, if also), by two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    under = (lambda b: b <= value) if also else (lambda b: b < value)
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    constant = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)
    last = F.size(F.filter(constant([c[0] for c in chunks], "array<bigint>"), under)) - 1  # the chunk in which the count ends
    inside = F.size(F.filter(F.get(constant(chunks, "array<array<bigint>>"), F.greatest(last, F.lit(0))), under))
    return F.when(last >= 0, last * step + inside).otherwise(0)


def ranged(rows: DataFrame, range_bytes: int) -> DataFrame:
    """Adds order, key (the text's hash) and range to rows (doc_id, text); ranges ascend with order, then with key."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    n = min(RANGES, int(size // range_bytes) + 1)
    bounds: list[int] = []
    if n > 1:  # n numbers at most
        bounds = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("b")).first()["b"] or []
    keyed = rows.withColumns({"order": order, "key": F.md5("text")})
    # an id that several bounds name has the ranges between them, by its texts' hashes
    own = once(keyed, low=below(bounds, F.col("order"), False), high=below(bounds, F.col("order"), True))
    share = F.conv(F.left("key", F.lit(8)), 16, 10).cast("long") / 2.0**32
    return own.withColumn("range", (F.col("low") + F.floor(share * (F.col("high") - F.col("low") + 1))).cast("int")).drop("low", "high")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the fingerprints of the text and of its edited text, and how like the
    former is to the latter (near_edited) and to the next document's fingerprint (near_next)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = ranged(rows, range_bytes).select("range", "order", "key", "doc_id", "text", F.lit(False).alias("guest"))
    # a row for each range, of which there are RANGES at most: its first place, and the range before it, in a circle
    heads = rows.groupBy("range").agg(F.min(F.struct("order", "key")).alias("head"))
    turn, all_ = Window.partitionBy(F.lit(0)).orderBy("range"), Window.partitionBy(F.lit(0))
    heads = cut(heads.select("head.*", F.coalesce(F.lag("range").over(turn), F.max("range").over(all_)).alias("before")))
    # the first row of each range is a guest at the end of the range before; of equal rows any
    met = rows.join(F.broadcast(heads), ["order", "key"]).groupBy("before").agg(*(F.first(c).alias(c) for c in ("order", "key", "text")))
    guests = met.select(F.col("before").alias("range"), "order", "key", F.lit(None).cast(dict(rows.dtypes)["doc_id"]).alias("doc_id"), "text", F.lit(True).alias("guest"))
    # sketched after the one shuffle of the texts
    every = rows.unionByName(guests).repartition("range")
    every = once(every, sketch=sketch(F.col("text"), k, words))
    place = Window.partitionBy("range").orderBy("guest", "order", "key")
    every = every.withColumn("next", F.lead(F.struct("text", "sketch")).over(place)).where("NOT guest")
    every = once(every, edited=edited(F.col("text"), F.col("next.text")))
    every = once(every, changed=sketch(F.col("edited"), k, words))
    return every.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next.sketch"), k).alias("near_next"),
    )


def sql(k: int = K, words: int = WORDS) -> str:
    """The same in DuckDB's SQL, over all rows in one order."""
    ws = "list_filter(string_split(translate({t}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '')"
    hashed = f"list_transform(range(1, len(ws) + 1), lambda i: md5(array_to_string(ws[greatest(i - {words - 1}, 1) : i], ' '))[:{HASH}])"
    sketch_ = f"list_sort(list_distinct({hashed}))[:{k}]"
    near = f"CASE WHEN len({{a}}) + len({{b}}) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect({{a}}, {{b}}), list_sort(list_distinct(list_concat({{a}}, {{b}})))[:{k}])) / len(list_sort(list_distinct(list_concat({{a}}, {{b}})))[:{k}]) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS following FROM d WINDOW w AS (ORDER BY coalesce(doc_id, {LEAST}), md5(t))),
e AS (SELECT *, t[: n - n // 2] || following[: n // 2] AS edited FROM n),
s AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, (SELECT {sketch_} FROM (SELECT {ws.format(t="t")} AS ws) x) AS a, (SELECT {sketch_} FROM (SELECT {ws.format(t="edited")} AS ws) y) AS b, (SELECT {sketch_} FROM (SELECT {ws.format(t="following")} AS ws) z) AS c FROM e)
SELECT doc_id, n AS n_chars, edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint, {near.format(a="a", b="b")} AS near_edited, {near.format(a="a", b="c")} AS near_next FROM s
"""
