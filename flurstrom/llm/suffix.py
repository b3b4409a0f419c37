"""Removal of repeated byte strings by suffix arrays, over all texts.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else, in the same text or another. Spark brings together what can be equal; numpy
sorts suffixes inside tasks.

1. Texts with equal bytes become one row with its number of copies, in a table
   bucketed by their hash.
2. Each window of ``length`` bytes is filed under the least hash of the grams of
   half its length inside it. Equal windows have equal hashes; neighbouring windows
   mostly share theirs, and such a run is one row. Hashes met at one place only are
   dropped by an aggregation: their windows have no equal.
3. The runs that are left bring their bytes. Equal runs are one row with a count;
   others are dealt by hash to buckets of bounded size, and each bucket's windows
   are sorted by two-stage suffix sorting: suffixes smaller than their successors
   are sorted directly, the rest are induced by scanning the buckets of first
   bytes; adjacent common prefixes of ``length`` or more mark windows.
   Windows of a hash that would fill a bucket alone are filed anew under the hash of
   what they have around that gram, all but 24 of their bytes; where that is still too
   much (as many texts share nearly a window) all but 4, then all of them: equal windows
   are one part with a count, so no hash, however frequent, is one large group.
4. Marked windows return to their texts as ranges.

With ``words``, a byte also goes if a passage of so many whole words (between ASCII
white space, with what stands between them) that covers it starts anywhere else,
however few bytes it takes: steps 2 and 3 over windows of words, settled by counting
128-bit hashes of whole windows.

Defined cases: null text is empty; texts shorter than ``length`` keep everything;
repeated rows are copies, so all of a text of at least ``length`` bytes goes from
each; rows with equal or null ids are kept apart by nothing but their text and get
a result each; an empty table gives no rows; other columns, whatever their names,
are carried and change nothing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_slices, cut, discard, distinct_texts, drop_bucketed, give_back, shuffled
from .common import spans as spans_of

LENGTH = 400
#: Words of a passage that counts whatever its bytes, where passages are asked for.
PASSAGE = 51
#: Windows in a bucket of step 3, about, and bytes for each; a single hash with more is split.
BUCKET_WINDOWS, WINDOW_BYTES = 200_000, 80
#: Of a split hash's windows, so many neighbours stay together, then so many.
STRIDES = (25, 5, 1)
BLOCK = 1 << 19
SPACE = np.frombuffer(b" \t\n\r\f\v", np.uint8)
ROOT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), ROOT, np.uint64))
        back = np.cumprod(np.full(len(data), INVERSE, np.uint64))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values(seed)[data] * power)])
        h = (upto[n:] - upto[:-n]) * back[: len(data) - n + 1]
        for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def least_ahead(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of the w values from each place on."""
    n = len(h)
    tiles = np.concatenate([h, np.full(-n % w, ~np.uint64(0))]).reshape(-1, w)
    before = np.minimum.accumulate(tiles, 1).ravel()[:n]
    after = np.minimum.accumulate(tiles[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return np.minimum(after[: n - w + 1], before[w - 1 :])


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows and hash of each run of windows filed under one
    hash, and whether grams with this hash stand at several places in the run, as in periodic text."""
    gram = length // 2
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    grams = gram_hashes(data, gram)
    width = length - gram + 1
    least = least_ahead(grams, width)
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = least[begins[owner] + first]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    owner, first, n, h = owner[new], first[new], np.diff(np.append(new, len(h))), h[new]
    # the first such gram is in the run's first window, the last one in its last
    windows = sliding_window_view(grams, width)
    several = np.zeros(len(h), bool)
    for k in range(0, len(h), 2000):
        at, value = begins[owner[k : k + 2000]] + first[k : k + 2000], h[k : k + 2000, None]
        end = at + n[k : k + 2000] - 1
        several[k : k + 2000] = at + (windows[at] == value).argmax(1) < end + width - 1 - (windows[end][:, ::-1] == value).argmax(1)
    return owner, first, n, h, several


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    edge = np.flatnonzero(np.diff(np.r_[False, ~np.isin(data, SPACE), False]))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes from each first to its end."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), ROOT, np.uint64))
        back = np.cumprod(np.full(len(data), INVERSE, np.uint64))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values(seed)[data] * power)])
        h = (upto[end] - upto[first]) * back[first]
        for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def pieces(body: bytes, words: int) -> Iterator[tuple[int, bytes]]:
    """Parts of about BLOCK bytes, with their places, that hold each window of words once."""
    if len(body) <= BLOCK:
        yield 0, body
        return
    first, end = word_bounds(np.frombuffer(body, np.uint8))
    per = max(1, BLOCK * len(first) // len(body))
    for i in range(0, len(first) - words + 1, per):
        yield int(first[i]), body[first[i] : end[min(i + per + words - 1, len(end)) - 1]]


def word_runs(texts: list[bytes], words: int) -> tuple[np.ndarray, ...]:
    """Text number, first byte, end and hash of each run of windows of words filed under one gram of half
    as many words, and two hashes of the whole run; one gram at two places makes two runs."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    first, end = word_bounds(data)
    if len(first) < words:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    owner = np.searchsorted(begins, first, "right") - 1
    gram = words // 2
    grams = span_hashes(data, first[: len(first) - gram + 1], end[gram - 1 :])
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    at = order[least_ahead(rank, words - gram + 1).astype(np.int64)]
    own = np.flatnonzero(owner[: len(first) - words + 1] == owner[words - 1 :])
    if not len(own):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    new = np.flatnonzero(np.r_[True, at[own[1:]] != at[own[:-1]]])
    a, z = own[new], own[np.append(new[1:], len(own)) - 1]
    whole = (span_hashes(data, first[a], end[z + words - 1], seed) for seed in (2, 3))
    return owner[a], first[a] - begins[owner[a]], end[z + words - 1] - begins[owner[a]], grams[at[a]], *whole


class Words:
    """Eight bytes from each place on, as numbers that compare like them."""

    def __init__(self, data: bytes):
        self.at = np.ndarray((len(data),), ">u8", data + b"\0" * 8, strides=(1,)).astype(np.uint64)


def sort_directly(places: np.ndarray, room: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """places in the order of the depth bytes from them on (or as many as have room), by words of eight bytes; groups whose words agree aren't sorted."""
    place, room = places.copy(), room.copy()
    fresh = np.zeros(len(place) + 1, bool)  # where a group of equals begins
    fresh[[0, -1]] = True
    for d in range(0, depth, 8):
        open_ = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
        if not len(open_):
            break
        key = words[np.minimum(place[open_] + d, len(words) - 1)]
        left = np.clip(room[open_] - d, 0, 8)
        if d + 8 > depth:
            left = np.minimum(left, depth - d)
        short = left < 8
        key[short] &= ~np.uint64(0) << ((8 - left[short]).astype(np.uint64) * np.uint64(8)) if short.any() else np.uint64(0)
        key[left == 0] = 0
        group = np.cumsum(fresh[open_])
        differ = np.flatnonzero((group[1:] == group[:-1]) & (key[1:] != key[:-1]))
        if not len(differ):
            continue
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differ]] = True
        some = mixed[group]
        at, key, group = open_[some], key[some], group[some]
        order = np.lexsort((key, group))
        place[at], room[at] = place[at[order]], room[at[order]]
        key = key[order]
        fresh[at[1:][(key[1:] != key[:-1]) & (group[1:] == group[:-1])]] = True
    return place


def common_prefixes(a: np.ndarray, b: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Bytes that agree from a and from b on, up to most."""
    out = np.full(len(a), most)
    live = np.arange(len(a))
    for d in range(0, most, 8):
        x = words[a[live] + d] ^ words[b[live] + d]
        apart = x != 0
        if apart.any():
            high = x[apart]
            zeros = np.zeros(len(high), np.int64)
            for k in range(8):
                zeros += (high >> np.uint64(8 * (7 - k))) == 0
            out[live[apart]] = np.minimum(d + zeros, most)
            live = live[~apart]
        if not len(live):
            break
    return out


def two_stage(parts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """The places of the first counts[i] suffixes of each part, sorted by ``length`` bytes at least.

    A part ends in an unseen least byte. Suffixes smaller than their successors are
    sorted directly; each other one is its first byte before a suffix already placed."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1])
    step = np.zeros(total, np.int16)
    step[:-1] = data[1:].astype(np.int16) - data[:-1]
    step[ends - 1] = -1
    turn = np.where(step != 0, np.arange(total), total)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = step[turn] > 0
    # those wanted, and what follows them up to the first that is sorted directly
    wanted = np.zeros(total, bool)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    wanted[np.repeat(begins, counts) + first] = True
    anchor = np.minimum.accumulate(np.where(smaller, np.arange(total), total)[::-1])[::-1]
    need = wanted.copy()
    last = begins + counts - 1
    stop = np.minimum(anchor[last], ends - 1)
    more = np.maximum(stop - last, 0)
    tail = np.repeat(last + 1, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    need[tail] = True
    words = Words(b"".join(parts) + b"\0" * (length + 8)).at
    direct = np.flatnonzero(need & smaller)
    room = np.repeat(ends, sizes)[direct] - direct
    direct = sort_directly(direct, room, words, length)
    induced = need & ~smaller
    before = np.full(total + 1, -1, np.int16)
    before[1:][induced] = data[induced]
    before[begins] = -1
    pred = before.tolist()
    placed: list[list[int]] = [[] for _ in range(256)]
    split = np.searchsorted(data[direct], np.arange(257))
    direct_list = direct.tolist()
    for e in ends[induced[ends - 1]].tolist():  # the empty suffix of each part comes first
        placed[data[e - 1]].append(e - 1)
    for c in range(256):
        for p in placed[c]:  # grows while it is scanned
            b = pred[p]
            if b >= 0:
                placed[b].append(p - 1)
        for p in direct_list[split[c] : split[c + 1]]:
            b = pred[p]
            if b >= 0:
                placed[b].append(p - 1)
    order = np.array([p for c in range(256) for part in (placed[c], direct_list[split[c] : split[c + 1]]) for p in part], np.int64)
    return order[wanted[order]]


def repeated(parts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Which of the first counts[i] windows of each part are equal to another of them, in one array."""
    order = two_stage(parts, counts, length)
    words = Words(b"".join(parts) + b"\0" * (length + 8)).at
    same = common_prefixes(order[:-1], order[1:], words, length) >= length
    hit = np.zeros(len(words), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    begins = np.cumsum([0] + [len(p) for p in parts])[:-1]
    return hit[np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]


def ranges(hit: np.ndarray, length: int) -> list[list[int]]:
    """Byte ranges (first, end) that the marked windows cover, one for each unbroken row of marks."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    return [[int(a), int(b) - 1 + length] for a, b in zip(edge[::2], edge[1::2])]


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keyed(keys: list[bytes], owner: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows of the texts that owner numbers, with one array for each other column."""
    own = pa.array(keys, pa.binary()).take(pa.array(owner, pa.int64()))
    return pa.RecordBatch.from_arrays([own, *(pa.array(v) for v in columns.values())], names=["key", *columns])


def pairs_of(batches, *columns: str):
    """The rows of record batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def filed(texts: DataFrame, length: int) -> DataFrame:
    """key, s0, n, h, several: the runs of windows of each text."""

    def rows(group: list) -> pa.RecordBatch:
        owner, first, n, h, several = runs([g[1] for g in group], length)
        offset = np.array([g[2] for g in group], np.int64)
        return keyed([g[0] for g in group], owner, s0=first + offset[owner], n=n.astype(np.int64), h=h.view(np.int64), several=several)

    def of(batches):
        group, size = [], 0
        for key, body in pairs_of(batches, "key", "body"):
            for at in range(0, len(body) - length + 1, BLOCK):
                own = body[at : at + BLOCK + length - 1]
                group.append((key, own, at))
                size += len(own)
                if size > BLOCK:
                    yield rows(group)
                    group, size = [], 0
        if group:
            yield rows(group)
        give_back()

    return texts.select("key", "body").where(F.octet_length("body") >= length).mapInArrow(of, "key binary, s0 long, n long, h long, several boolean")


def with_bytes(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The runs with the bytes their windows cover, and the hash of these."""

    def rows(out: list) -> pa.RecordBatch:
        key, s0, n, h, part = zip(*out)
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((key, s0, n, h, part, [hashlib.md5(p).digest() for p in part]), types)], names=["key", "s0", "n", "h", "part", "part_id"])

    def of(batches):
        out, size = [], 0
        for key, body, own in pairs_of(batches, "key", "body", "runs"):
            for r in own:
                part = body[r["s0"] : r["s0"] + r["n"] + length - 1]
                out.append((key, r["s0"], r["n"], r["h"], part))
                size += len(part)
                if size > BLOCK:
                    yield rows(out)
                    out, size = [], 0
        if out:
            yield rows(out)
        give_back()

    lists = found.groupBy("key").agg(F.collect_list(F.struct("s0", "n", "h")).alias("runs"))
    return texts.select("key", "body").join(lists, "key").mapInArrow(of, "key binary, s0 long, n long, h long, part binary, part_id binary")


def split(parts: DataFrame, length: int, stride: int) -> DataFrame:
    """The runs in pieces of up to ``stride`` windows whose place (of the first gram of hash h, or of what the pieces of
    their hash have in common) is alike, each under the hash of the bytes that all its windows have in common. Equal
    windows come under equal hashes; with a stride of 1 a hash has nothing but equal windows."""
    gram = length // 2

    def of(batches):
        for batch in batches:
            for key, s0, h, part, shared in zip(batch["key"], batch["s0"], batch["h"], batch["part"], batch["shared"]):
                part = bytes(part)
                n = len(part) - length + 1
                if shared < 0:
                    at = np.flatnonzero(gram_hashes(np.frombuffer(part, np.uint8), gram).view(np.int64) == h)
                    place = at[np.searchsorted(at, np.arange(n))]
                else:
                    place = np.full(n, shared)
                block = (place - np.arange(n)) // stride
                new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (block[1:] != block[:-1])])
                out = []
                for a, k in zip(new.tolist(), np.diff(np.append(new, n)).tolist()):
                    low = int(place[a] - block[a] * stride)  # where the last window of the block begins
                    common = part[low : low - (stride - 1) + length]
                    own = hashlib.md5(b"%d %d " % (h, block[a]) + common).digest()
                    piece = part[a : a + k + length - 1]
                    out.append((key, s0 + a, k, int.from_bytes(own[:8], "little", signed=True), piece, hashlib.md5(piece).digest(), low - a))
                yield pd.DataFrame(out, columns=["key", "s0", "n", "h", "part", "part_id", "shared"])
        give_back()

    return parts.select("key", "s0", "h", "part", "shared").mapInPandas(of, "key binary, s0 long, n long, h long, part binary, part_id binary, shared long")


def crowded_hashes(parts: DataFrame, length: int, bucket_windows: int) -> DataFrame:
    """h of those whose different parts have more windows, or bytes, than a bucket may."""
    each = parts.groupBy("h", "part_id").agg(F.first("n").alias("n"))
    return each.groupBy("h").agg(F.sum("n").alias("w"), F.sum(F.col("n") + length - 1).alias("bytes"), F.count("*").alias("c")).where((F.col("c") > 1) & ((F.col("w") > bucket_windows) | (F.col("bytes") > WINDOW_BYTES * bucket_windows))).select("h")


def marked_parts(parts: DataFrame, length: int, bucket_windows: int) -> DataFrame:
    """part_id and the ranges that its repeated windows cover: of equal parts all, of others those that sorting finds."""
    one = parts.groupBy("h", "part_id").agg(F.first("part").alias("part"), F.first("n").alias("n"), F.count("*").alias("c"))
    size = parts.agg(F.sum("n").alias("windows"), F.sum(F.col("n") + length - 1).alias("bytes")).first()
    buckets = max(1, (size["windows"] or 0) // bucket_windows, (size["bytes"] or 0) // (WINDOW_BYTES * bucket_windows))

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        out, at = [], 0
        # whole hashes stay together; a few at a time bound the memory
        frame = frame.sort_values(["h", "part_id"], ignore_index=True)
        hs = frame["h"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        n = frame["n"].to_numpy()
        upto = np.cumsum(n)
        groups = []
        for c in np.append(cuts[1:], len(hs)):
            if upto[c - 1] - (upto[at - 1] if at else 0) >= bucket_windows // 2 or c == len(hs):
                groups.append((at, c))
                at = c
        for a, b in groups:
            rows = frame.iloc[a:b]
            counts = rows["n"].to_numpy()
            hit = repeated([bytes(p) for p in rows["part"]], counts, length)
            for part_id, c, own in zip(rows["part_id"], rows["c"], np.split(hit, np.cumsum(counts)[:-1])):
                if c > 1:
                    own = np.ones(len(own), bool)
                if own.any():
                    out.append((part_id, ranges(own, length)))
        give_back()
        return pd.DataFrame(out, columns=["part_id", "spans"])

    return one.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInPandas(of, "part_id binary, spans array<array<long>>")


def passages(texts: DataFrame, words: int) -> DataFrame:
    """key and ranges of the windows of words that stand in more than one place, in whatever texts; stored.

    Of runs filed under one gram those that are equal as a whole are ranges as they are. Where a gram has
    other runs too, one of each kind brings its windows, which are counted by 128-bit hashes."""

    def filed_words(batches):
        for batch in byte_slices(batches, "body", BLOCK):
            every = [(key, at, part) for key, body in pairs_of([batch], "key", "body") for at, part in pieces(body, words)]
            for some in spans_of([len(part) for _, _, part in every], BLOCK):
                group = every[some]
                owner, first, end, *hashes = word_runs([part for _, _, part in group], words)
                at = np.array([g[1] for g in group], np.int64)[owner]
                yield keyed([g[0] for g in group], owner, s0=first + at, e0=end + at, **{c: h.view(np.int64) for c, h in zip("hxy", hashes)})

    def windows(batches):
        def rows(out: list) -> pa.RecordBatch:
            return keyed([o[0] for o in out], np.repeat(np.arange(len(out)), [len(o[1]) for o in out]), **{c: np.concatenate([o[k] for o in out]) for k, c in enumerate("sexy", 1)})

        out, size = [], 0
        for key, body, own in pairs_of(batches, "key", "body", "runs"):
            for a, z in merged([(r["s0"], r["e0"]) for r in own]):
                for at, part in pieces(body[a:z], words):
                    data = np.frombuffer(part, np.uint8)
                    first, end = word_bounds(data)
                    first, end = first[: len(first) - words + 1], end[words - 1 :]
                    out.append((key, first + a + at, end + a + at, *(span_hashes(data, first, end, seed).view(np.int64) for seed in (2, 3))))
                    size += len(first)
                    if size > BLOCK // 16:
                        yield rows(out)
                        out, size = [], 0
        if out:
            yield rows(out)
        give_back()

    own = texts.select("key", "body").where(F.octet_length("body") >= 2 * words - 1)
    every = cut(own.mapInArrow(filed_words, "key binary, s0 long, e0 long, h long, x long, y long"))
    shared = every.groupBy("h").count().where("count > 1").select("h")
    met = cut(every.join(shuffled(shared), "h"), large=True)
    discard(every)
    kinds = cut(met.groupBy("h", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("key", "s0", "e0")).alias("one")))
    whole = met.join(shuffled(kinds.where("n > 1").select("h", "x", "y")), ["h", "x", "y"]).select("key", F.array(F.array("s0", "e0")).alias("spans"))
    several = kinds.groupBy("h").count().where("count > 1").select("h")
    lists = kinds.join(several, "h").groupBy("one.key").agg(F.collect_list(F.struct("one.s0", "one.e0")).alias("runs"))
    rows = cut(own.join(lists, "key").mapInArrow(windows, "key binary, s long, e long, x long, y long"), large=True)
    twice = rows.groupBy("x", "y").count().where("count > 1").select("x", "y")
    out = cut(rows.join(shuffled(twice), ["x", "y"]).select("key", F.array(F.array("s", "e")).alias("spans")).unionByName(whole), large=True)
    discard(met, kinds, rows)
    return out


def repeats(docs: DataFrame, length: int, bucket_windows: int, words: int | None) -> DataFrame:
    """key, copies, spans and passages (ranges by bytes and by words) of each different text (body) that has copies or ranges; stored."""
    texts, name = distinct_texts(bounded(docs))
    every = cut(filed(texts, length))
    shared = every.groupBy("h").agg(F.count("*").alias("c"), F.max("several").alias("s")).where("c > 1 OR s").select("h")
    found = cut(with_bytes(texts, every.join(shuffled(shared), "h").select("key", "s0", "n", "h"), length), large=True)
    discard(every)
    # of equal parts one is sorted; what is still too large for a bucket is filed anew, until nothing but equal windows would be together
    parts = found.withColumn("shared", F.lit(-1).cast("long"))
    for stride in STRIDES:
        crowded = cut(crowded_hashes(parts, length, bucket_windows))
        if crowded.isEmpty():
            break
        before, parts = found, cut(parts.join(crowded, "h", "left_anti").unionByName(split(parts.join(crowded, "h"), length, min(stride, length - length // 2 + 1))), large=True)
        found = parts
        discard(before, crowded)
    moved = parts.select("key", "s0", "part_id").join(marked_parts(parts, length, bucket_windows), "part_id")
    own = cut(moved.select("key", F.transform("spans", lambda s: F.transform(s, lambda x: x + F.col("s0"))).alias("spans")), large=True)
    discard(found)
    stored = [own]
    kinds = [own.select("key", "spans", F.lit(None).cast("array<array<long>>").alias("passages"))]
    if words:
        stored.append(passages(texts, words))
        kinds.append(stored[-1].select("key", F.lit(None).cast("array<array<long>>").alias("spans"), F.col("spans").alias("passages")))
    lists = functools.reduce(DataFrame.unionByName, kinds).groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "passages")))
    out = cut(texts.select("key", "copies").join(shuffled(lists), "key", "left").where("copies > 1 OR spans IS NOT NULL"), large=True)
    discard(*stored)
    drop_bucketed(docs.sparkSession, name)  # all that is needed of it is stored
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_windows: int = BUCKET_WINDOWS, with_text: bool = True, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, its other columns as the struct
    ``row``, and with_text its kept_text: the remaining bytes without characters that were cut in two.

    These are of the byte strings alone. With ``words``, n_passage_bytes counts the bytes that go as the
    passages of so many words do besides, and kept_text is without both."""
    others = F.struct(F.col(text_col).isNull().alias("no_text"), *(F.col(c) for c in docs.columns if c not in (text_col, "no_text")))
    rows = docs.select(F.col(id_col).alias("doc_id"), others.alias("row"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("body"))
    lists = repeats(rows.select("body"), length, bucket_windows, words)

    def without(body: bytes, own: list[tuple[int, int]]) -> bytes:
        at, kept = 0, []
        for a, b in own:
            kept.append(body[at:a])
            at = b
        return b"".join([*kept, body[at:]])

    # two columns go through Python and one comes back; the others stay where they are
    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept_text string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, copies, spans, passages_ in batches:
            out = []
            for body, c, own, also in zip(bodies, copies, spans, passages_):
                body = bytes(body)
                size = len(body)
                by_bytes = [(0, size)] if c > 1 and size >= length else merged(own) if own is not None else []
                rest = without(body, by_bytes)
                both, least = by_bytes, rest
                if words and by_bytes != [(0, size)]:
                    whole = c > 1 and len(body.split()) >= words
                    both = [(0, size)] if whole else merged([*by_bytes, *(also if also is not None else [])])
                    least = without(body, both)
                out.append((size - len(rest), len(by_bytes), hashlib.sha256(rest).hexdigest(), size - len(least), least.decode("utf-8", "ignore") if with_text else None))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept_text"])
        give_back()

    met = rows.withColumn("key", F.unhex(F.md5("body"))).join(shuffled(lists), "key", "left")
    done = met.select("doc_id", "row", F.octet_length("body").cast("long").alias("n_bytes"), of("body", F.coalesce("copies", F.lit(1)), "spans", "passages").alias("r"))
    extra = ["n_passage_bytes"] * bool(words) + ["kept_text"] * with_text
    return done.select("doc_id", "row", "n_bytes", *(f"r.{c}" for c in ("n_removed", "n_spans", "kept_sha256", *extra)))


def digest(docs: DataFrame, **options) -> DataFrame:
    """The result without texts."""
    return remove_repeats(docs, with_text=False, **options).drop("row")
