"""Near-duplicate documents by an inverted join over MinHash coordinates.

A text's set of word shingles has a signature of COORDS minima. Texts with equal
sets are one class. A pair of sets as similar as the threshold agrees in at least
MATCHES coordinates (but for eight pairs in some ten million at the threshold
itself), so it shares at least one of the COORDS - MATCHES + 1 coordinate values
that are rarest in either: only this prefix is posted, values that one class alone
has need no posting, and classes with fewer than MATCHES other values drop out. The
longer posting lists are skipped; what they would add is counted from eight bits of
each coordinate, which a class keeps beside its id.

A list of up to SMALL members makes its pairs, at most SMALL - 1 for a member. Longer
lists with the same class of least hash are a group, in which every member meets the hub
only, the member whose signature is most like the group's commonest one: members linked
to the hub are connected. For any other link of two members a and b
the triangle inequality of the Jaccard distance asks that their differences to the
hub's set overlap, in so many elements that the rarest of a's and b's differences
must meet: prefixes of differences are joined on (hub, element), and a pair is made
only where sizes and places leave it a chance. Copies of one text with edits of
their own have differences that don't meet, so no group makes all its pairs. Pairs
of short lists have their agreeing coordinates counted and are retained with MATCHES
or more; those, and the pairs found by way of a hub, are confirmed on the full sets. Components come from
alternating large-star and small-star steps over the links.

Defined cases: null text is empty; a text without words has no set and is linked
with nothing, not even another such text; a text with fewer words than a shingle
is one shingle; rows with equal text are one class, so repeated rows keep only
those whose id is the least; a null id takes part but names no component and is
never kept unless its component has no other id (then component_id is null and
kept false); an empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, bucketed, byte_slices, cut, discard, drop_bucketed, free, give_back, shuffled, spans

COORDS, MATCHES = 48, 24
#: Members of a posting list whose pairs are made directly, at most.
SMALL = 16
#: Groups are listed anew while at most this share of their members is left in long lists.
LESSER = 0.7
#: Columns of eight symbols of eight bits.
MARKS = [f"s{k}" for k in range(COORDS // 8)]
#: Keys of texts whose sets are needed that are broadcast, at most (some 100 bytes each); more are joined by a shuffle.
SMALL_KEYS = 500_000
#: Pairs are confirmed in portions, the texts of whose one side have at most this part of the shingles of all classes.
PART = 0.5
#: Bytes of text that a task works on at once.
PORTION = 1 << 19
ROOT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = SPACES[data]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    power = np.cumprod(np.full(len(data), ROOT, np.uint64))
    back = np.cumprod(np.full(len(data), INVERSE, np.uint64))
    letters = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * power)])
    word = mix((upto[end] - upto[begin]) * back[begin])
    first = np.searchsorted(begin, np.cumsum(sizes) - sizes)
    last = np.searchsorted(begin, np.cumsum(sizes))
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * ROOT) | np.uint64(1)
    n = max(0, len(word) - words + 1)
    run = np.zeros(n, np.uint64)
    for k in range(words):
        run = mix(run + word[k : k + n] * factors[k])
    out = []
    for a, b in zip(first, last):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for x in word[a:b]:
                h = mix(h * ROOT + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(own: np.ndarray, coords: int = COORDS, seed: int = 3) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    rng = np.random.default_rng(seed)
    xors, factors = rng.integers(0, 1 << 63, (2, coords), dtype=np.uint64)
    low = np.full(coords, ~np.uint64(0))
    for k in range(0, len(own), 20_000):
        part = own[k : k + 20_000]
        low = np.minimum(low, ((part[None, :] ^ xors[:, None]) * (factors[:, None] | np.uint64(1))).min(1))
    return mix(low + np.arange(coords, dtype=np.uint64) * ROOT)


def signed(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, key (of the text), n, cls (hash of the whole set), values and MARKS of each row (doc_id, body); without a set cls is null."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key binary, n long, cls binary, values array<long>, " + ", ".join(f"{m} long" for m in MARKS)

    def of(batches):
        for part in byte_slices(batches, "body", PORTION):
            bodies = part.column("body").to_pylist()
            sets = shingle_sets(bodies, words)
            sigs = [signature(own) if len(own) else np.zeros(COORDS, np.uint64) for own in sets]
            values = np.concatenate(sigs)
            marks = (values & np.uint64(255)).astype(np.uint8).view(np.int64).reshape(-1, len(MARKS))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([hashlib.md5(b).digest() for b in bodies], pa.binary()),
                    pa.array([len(own) for own in sets], pa.int64()),
                    pa.array([hashlib.md5(own.tobytes()).digest() if len(own) else None for own in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDS, pa.int32()), pa.array(values.view(np.int64))),
                    *(pa.array(np.ascontiguousarray(marks[:, k])) for k in range(len(MARKS))),
                ],
                names=["doc_id", "key", "n", "cls", "values", *MARKS],
            )

    return rows.mapInArrow(of, schema)


def posted(classes: DataFrame, *group: str) -> DataFrame:
    """value, id, c (members of the value's list) and hub, of the values in each class's prefix that others have posted too.

    With a group column, which stays, classes (id, values) are alone with the others of their group."""
    pairs = classes.select(*group, "id", F.explode("values").alias("value"))
    shared = pairs.groupBy(*group, "value").agg(F.count("*").alias("f")).where("f > 1")
    met = shuffled(pairs).join(shared, [*group, "value"])
    own = met.groupBy(*group, "id").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("own")).where(F.size("own") >= MATCHES)
    posts = cut(own.select(*group, "id", F.explode(F.slice("own.value", 1, F.size("own") - (MATCHES - 1))).alias("value")), large=True)
    lists = posts.groupBy(*group, "value").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("hub")).where("c > 1")
    out = cut(shuffled(posts).join(lists, [*group, "value"]))
    discard(posts)
    return out


def listed(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of members of short lists, and (id, hub) of the members of long ones; both stored.

    A long list is mostly one value that many texts have by chance. Its group is listed anew by itself, where values
    are rare again and members without enough of them drop out, as long as that leaves a lesser part in long lists."""
    rows, group, pairs, stored, members, least, before = classes.select("id", "values"), [], [], [], None, 0, None
    while True:
        stored.append(posts := posted(rows, *group))
        few, many = posts.where(F.col("c") <= SMALL), posts.where(F.col("c") > SMALL)
        a, b = (few.select(*group, "value", F.col("id").alias(x)) for x in "ab")
        pairs.append(shuffled(a).join(b, [*group, "value"]).where("a < b").select("a", "b"))
        here = cut(many.select("id", "hub").distinct())
        now = here.count()
        if members is None or now < least:
            members, least, here = here, now, members
        else:  # the groups as they were have all those pairs
            pairs.pop()
        if here is not None:
            discard(here)
        if not now or before is not None and now > LESSER * before:
            break
        before, group = now, ["within"]
        rows = members.withColumnRenamed("hub", "within").join(classes.select("id", "values"), "id")
    out = cut(ordered(reduce(DataFrame.unionAll, pairs)), large=True)
    discard(*stored)
    return out, members


def central(members: DataFrame, classes: DataFrame) -> DataFrame:
    """id, n (the size of its set) and hub, the central member of each group (id, hub): the one whose symbols agree with most of the group's commonest ones.

    Any member may be the hub. Differences to one at the margin hold in every member what the others have in common, so that all meet."""
    own = cut(members.join(classes.select("id", "n", *MARKS), "id"))
    symbol = lambda m, j: F.shiftrightunsigned(m, 8 * j).bitwiseAND(F.lit(255))
    usual = own.groupBy("hub").agg(*(F.mode(symbol(m, j), True).alias(f"{m}_{j}") for m in MARKS for j in range(8)))
    usual = usual.select("hub", *(reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(f"{m}_{j}", 8 * j) for j in range(8))).alias(f"usual_{m}") for m in MARKS))
    apart = reduce(add, (unequal(F.col(m), F.col(f"usual_{m}")) for m in MARKS))
    centres = own.join(usual, "hub").groupBy("hub").agg(F.min(F.struct(apart.alias("apart"), F.xxhash64("id").alias("h"), "id"))["id"].alias("centre"))
    out = cut(own.select("id", "n", "hub").join(centres, "hub").where("id <> centre").select("id", "n", F.col("centre").alias("hub")).distinct())
    discard(own)
    return out


def unequal(a: Column, b: Column) -> Column:
    """How many of the eight bytes of a and b differ."""
    x = a.bitwiseXOR(b)
    for k in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def retained(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that agree in MATCHES coordinates and whose sizes leave them a chance, and un, the size of u's set."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), *(F.col(m).alias(f"{x}{m}") for m in MARKS))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    agree = COORDS - reduce(add, (unequal(F.col(f"u{m}"), F.col(f"v{m}")) for m in MARKS))
    return both.where((F.least("un", "vn") * 100 >= F.greatest("un", "vn") * percent) & (agree >= MATCHES)).select("u", "v", "un")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def texts_of(rows: DataFrame, needed: DataFrame) -> tuple[DataFrame, str]:
    """id and body, a text of each needed class (id, key), as a table bucketed by id, whose joins don't shuffle it; and its name."""
    few = needed.count() <= SMALL_KEYS
    texts = rows.select(F.unhex(F.md5("body")).alias("key"), "body").join(F.broadcast(needed) if few else shuffled(needed), "key")
    return bucketed(texts.groupBy("id").agg(F.first("body").alias("body")), "id")


def side_by_side(pairs: DataFrame, texts: DataFrame, n: str, total: int) -> Iterator[DataFrame]:
    """The stored pairs (u, v, n) with their texts x and y, in portions by hash: the texts of u in one, which are shuffled,
    have at most PART of the shingles of all classes, the total."""
    held = pairs.agg(F.sum(n)).first()[0] or 0
    parts = max(1, math.ceil(held / (PART * max(1, total))))
    side = lambda x, text: shuffled(texts.select(F.col("id").alias(x), F.col("body").alias(text)))
    for p in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == p) if parts > 1 else pairs
        yield some.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y")


def pairs_of_sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Some pairs (u, v, x, y) at a time, with the sets of their texts; a text that comes again in them is shingled once."""
    for batch in batches:
        x, y = (batch.column(batch.schema.get_field_index(c)) for c in "xy")
        sizes = pc.add(pc.binary_length(x), pc.binary_length(y)).to_pylist()
        for part in spans(sizes, PORTION, rows=2000):
            some, sets = batch.slice(part.start, part.stop - part.start), []
            for at, text in ("ux", "vy"):
                ids = some.column(some.schema.get_field_index(at)).to_numpy()
                _, first, which = np.unique(ids, return_index=True, return_inverse=True)
                own = shingle_sets(some.column(some.schema.get_field_index(text)).take(pa.array(first)).to_pylist(), words)
                sets.append([own[k] for k in which])
            yield some, *sets
    give_back()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int, total: int) -> DataFrame:
    """The stored pairs (u, v, un) whose sets are as similar as asked; stored."""

    def of(batches):
        for some, xs, ys in pairs_of_sets(batches, words):
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys)])
            every = np.array([len(x) + len(y) for x, y in zip(xs, ys)])
            yield some.select(["u", "v"]).filter(pa.array(100 * both >= percent * (every - both)))

    done = [cut(part.mapInArrow(of, "u long, v long"), large=True) for part in side_by_side(pairs, texts, "un", total)]
    return joined(done)


def differences(spokes: DataFrame, texts: DataFrame, words: int, total: int) -> DataFrame:
    """id, hub, n, m (sizes of the sets of both) and d, the elements that one of both sets has alone, of the stored spokes; stored."""

    def of(batches):
        for some, xs, ys in pairs_of_sets(batches, words):
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(xs, ys)]
            ends = np.cumsum([0] + [len(d) for d in apart])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(apart).view(np.int64)))
            sizes = (pa.array([len(s) for s in own], pa.int64()) for own in (xs, ys))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *sizes, lists], names=["id", "hub", "n", "m", "d"])

    pairs = spokes.withColumnsRenamed({"id": "u", "hub": "v"})
    done = [cut(part.mapInArrow(of, "id long, hub long, n long, m long, d array<long>"), large=True) for part in side_by_side(pairs, texts, "n", total)]
    return joined(done)


def joined(parts: list[DataFrame]) -> DataFrame:
    """Tables that cut() made as one, which discard() takes for all of them."""
    out = reduce(DataFrame.unionAll, parts)
    out.stored_at = [p.stored_at for p in parts]
    return out


def meeting(spokes: DataFrame, percent: int) -> DataFrame:
    """Pairs u > v of members of one hub, in different components, whose differences to it may overlap enough.

    Two sets of x and y elements are linked if they differ in at most (x + y) * (100 - percent) / (100 + percent)
    elements, so their differences to the hub share at least half of what both have beyond that. Both are put in
    one order, rarest elements first; then the prefixes of those that share so much meet."""
    elements = spokes.select("hub", "id", "n", "root", F.size("d").cast("long").alias("k"), F.explode("d").alias("e"))
    shared = elements.groupBy("hub", "e").agg(F.count("*").alias("f")).where("f > 1")
    own = shuffled(elements).join(shared, ["hub", "e"]).groupBy("hub", "id").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("f", "e"))).alias("own"))
    placed = own.select("hub", "id", "n", "root", "k", F.posexplode("own.e").alias("p", "e"), F.size("own").alias("size"))
    placed = placed.withColumn("p", F.col("k") - F.col("size") + F.col("p") + 1).drop("size")
    # with a partner of fewer elements in its difference, and with one of as many or more
    far, near = F.floor(F.col("n") * (100 - percent) / percent) + 1, F.floor(F.col("n") * (100 - percent) / (2 * percent)) + 1
    placed = cut(placed.where(F.col("p") <= far))
    b = placed.alias("b")
    a = placed.where(F.col("p") <= near).alias("a")
    first = (F.col("a.k") < F.col("b.k")) | ((F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")))
    asked = (F.col("a.k") + F.col("b.k")) - (F.col("a.n") + F.col("b.n")) * (100 - percent) / (100 + percent)
    chance = 2 * (1 + F.least(F.col("a.k") - F.col("a.p"), F.col("b.k") - F.col("b.p"))) >= asked - 1e-6
    met = shuffled(a).join(b, (F.col("a.hub") == F.col("b.hub")) & (F.col("a.e") == F.col("b.e")) & (F.col("a.root") != F.col("b.root")) & first & chance)
    out = cut(ordered(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))))
    discard(placed)
    return out


def components(links: DataFrame) -> DataFrame:
    """u and the least node v of its component, for every node but the least, from links u > v; stored."""
    edges, before = cut(links.distinct(), large=True), None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return edges
        before, last = seen, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").toDF("u", "v").unionByName(least.toDF("u", "v"))
        edges = cut(small.distinct())
        discard(last)


def with_root(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """rows (id, ...) with the root of their component."""
    return rows.join(tree.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) and kept of every row."""
    rows = bounded(docs).select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("body"))
    sigs = cut(signed(rows, words))
    first = lambda *names: [F.first(c).alias(c) for c in names]
    classes = sigs.where("cls IS NOT NULL").groupBy("cls").agg(*first("n", "key", "values", *MARKS), F.min("doc_id").alias("least"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), large=True)
    pairs, members = listed(classes)
    found = cut(retained(pairs, classes, percent), large=True)
    spokes = central(members, classes)
    discard(pairs, members)
    needed = reduce(DataFrame.union, [found.select("u"), found.select("v"), spokes.select("id"), spokes.select("hub")]).distinct().toDF("id")
    needed = cut(needed.join(classes.select("id", "key"), "id"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    texts, name = texts_of(rows, needed)
    apart = differences(spokes, texts, words, total)
    # x + y elements, of which d lie in one of both sets only
    to_hub = apart.where((F.col("n") + F.col("m")) * (100 - percent) >= F.size("d") * (100 + percent)).select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v"))
    linked = confirmed(found, texts, percent, words, total)
    tree = components(linked.unionByName(to_hub))

    roots = cut(with_root(apart, tree))
    several = roots.groupBy("hub").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("hub")
    met = meeting(roots.join(several, "hub"), percent)
    likely = cut(retained(met, classes, percent))
    more = confirmed(likely, texts, percent, words, total)
    if not more.isEmpty():
        last, tree = tree, components(tree.unionByName(more))
        discard(last)

    named = with_root(classes.select("id", "cls", "least"), tree)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    mine = sigs.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    out = mine.where("cls IS NOT NULL").join(named, "cls").select("doc_id", "n_shingles", "component_id")
    alone = mine.where("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = cut(out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
    discard(sigs, classes, found, spokes, needed, apart, linked, roots, met, likely, more, tree)
    drop_bucketed(docs.sparkSession, name)
    free(docs.sparkSession)
    return out
