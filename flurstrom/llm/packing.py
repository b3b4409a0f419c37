"""Best-fit packing of documents into sequences of bounded length.

Planning works on the histogram of piece lengths (at most ``capacity`` numbers),
never on documents: best-fit decreasing takes whole groups of equally filled
sequences at a time and yields runs of slots. Pieces then find their slot by a
join on (length, rank within length). Ranks are counted in hashed buckets of each
length and shifted by the buckets before, so that a frequent length is no single
task.

Defined cases: null text is an empty text; an empty text is one piece of length 1
(the end id); repeated rows are packed once each; an empty table gives no rows;
columns besides id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import byte_characters
from .common import bounded, byte_slices, cut, give_back, ragged

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of texts whose words a worker holds at once, about.
SLICE = 1 << 18
#: Code points below this take the fast path; texts with others go to the tokenizer whole.
SIMPLE = 0x250
#: What the vocabulary writes behind the last token of a pre-token.
END = "</w>"


class Numbers(dict):
    """Numbers words as they first appear."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Encoder:
    """Token ids of texts, equal to the tokenizer's own, by way of its pre-tokens.

    Ids of a pre-token don't depend on its neighbours, so each distinct one is
    encoded once and kept while the cache has room (some 250 bytes a word). A text that the pattern can't
    split as the tokenizer does, or that names one of its added tokens, is given to
    the tokenizer whole.

    Pre-tokens are encoded by a vocabulary of ranks in the order of the merges, in which a
    space, that none contains, stands for their end; this is several times as fast. It joins
    any two tokens that make a third, the tokenizer only those of a merge. These are the same
    if each token, encoded alone, gives itself, as a test shows for all of them.
    """

    def __init__(self, path: str, room: int = 50_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        with open(path) as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_characters()
        plain = {c: bytes([k]) for k, c in enumerate(letters)}
        words = [*(c + END for c in letters), *letters, *("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])]
        ranks = {b"".join(map(plain.__getitem__, w.removesuffix(END))) + b" " * w.endswith(END): k for k, w in enumerate(words)}
        if len(ranks) < len(words):
            raise ValueError(f"several merges of {path} make one token")
        self.ranks = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.id = np.array([vocab[w] for w in words], np.uint32)
        self.last = np.array([w.endswith(END) for w in words])
        kind = {c: unicodedata.category(chr(c))[0] for c in range(SIMPLE)}
        of = lambda k: "".join(re.escape(chr(c)) for c in kind if kind[c] == k)
        space = "\t\n\v\f\r \x85\xa0"
        self.pattern = re.compile(f"[{of('L')}]+|[{of('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{space}{of('L')}{of('N')}]+")
        self.odd = re.compile(f"[^\x00-{chr(SIMPLE - 1)}]")
        self.room = room
        self.forget()

    def forget(self) -> None:
        self.index = Numbers()
        self.ids, self.starts, self.counts = [np.zeros(0, t) for t in (np.uint32, np.int64, np.int64)]

    def learn(self, words: list[str]) -> None:
        """Ids of words, numbered in this order after those already known."""
        if not words:
            return
        ranks = self.ranks.encode_to_numpy(" ".join(words) + " ")
        ends = np.flatnonzero(self.last[ranks]) + 1
        if len(ends) != len(words):
            raise ValueError("a pre-token doesn't end in a word-final token")
        begins = np.append(0, ends[:-1])
        self.starts, self.counts = np.append(self.starts, begins + len(self.ids)), np.append(self.counts, ends - begins)
        self.ids = np.append(self.ids, self.id[ranks])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > self.room:
            self.forget()
        found: list[np.ndarray | None] = [None] * len(texts)
        plain, numbers = [], []
        number, known = self.index.__getitem__, len(self.index)
        for k, text in enumerate(texts):
            low = text.lower()
            plainly = text.isascii() or not self.odd.search(text) and not self.odd.search(low) and len(low) == len(text) and unicodedata.is_normalized("NFC", text)
            if not plainly or any(t in low for t in self.added):
                found[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            plain.append(k)
            numbers.append(np.fromiter(map(number, self.pattern.findall(low)), np.int64))
        if len(self.index) > known:
            self.learn(list(self.index)[known:])
        if plain:
            which = np.concatenate(numbers)
            counts = self.counts[which]
            flat = self.ids[ragged(self.starts[which], counts)]
            upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(x) for x in numbers])]
            for k, a, b in zip(plain, np.concatenate([[0], upto[:-1]]), upto):
                found[k] = flat[a:b]
        return found


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each worker, which keeps the vocabularies for all its tasks, but no words."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document's ids and the end id 0: its place, length and checksum.

    tokenizer names a file of the public vocabularies; each worker finds its own copy."""

    def of(batches):
        import public_tokenizers

        encoder = encoder_of(public_tokenizers.path(tokenizer))
        for rows in byte_slices(batches, "text", SLICE):
            which, columns = [], {name: [] for name in ("piece", "start", "length", "ids_crc32")}
            for k, ids in enumerate(encoder.encode([t or "" for t in rows.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    which.append(k)
                    for name, value in zip(columns, (p, at, len(own), zlib.crc32(own.tobytes()))):
                        columns[name].append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(which, pa.int32())), *(pa.array(v, t) for v, t in zip(columns.values(), types))], names=["doc_id", *columns])
        encoder.forget()
        give_back()

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns runs (length, first rank, pieces, pieces per sequence, first sequence,
    offset): piece number r of a run stands in sequence first + r div per, at
    offset + (r mod per) * length. The number of runs depends on the lengths that
    occur, not on how often they do.
    """
    runs = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in free:
                insort(rooms, room)
                free[room] = []
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, per, first, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:
                runs.append((length, rank, left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return runs


def pack(rows: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, length, ...), which must be stored, not recomputed."""
    spark = rows.sparkSession
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    runs = plan(counts, capacity)
    buckets = max(1, sum(counts.values()) // bucket_rows)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    slots = spark.createDataFrame([(a, b, b + n, per, s, o) for a, b, n, per, s, o in runs], "length long, r0 long, r1 long, per long, s0 long, o0 long")
    # the runs number some thousands at most whatever the input, so they may be broadcast
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))).drop(slots["length"])
    nth = F.col("rank") - F.col("r0")
    return placed.withColumns({"sequence_id": F.col("s0") + F.floor(nth / F.col("per")), "offset": F.col("o0") + F.pmod(nth, F.col("per")) * F.col("length")}).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def best_fit(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and place there.

    Pieces are stored in the shared folder once, as both the plan and the join need them."""
    return pack(cut(pieces(docs, tokenizer, capacity, id_col, text_col)), capacity)
