"""Alignment of two tokenizers' tokens over whole texts, by interval coalescing.

A byte-level tokenizer (A) reads a space and the text, a piece tokenizer (B) the text,
before which it puts a space itself; so the tokens of both tile the same bytes.

1. A text is cut before single spaces that follow a character that isn't white space:
   no token of either tokenizer has one inside, so the parts between (a word, mostly)
   are encoded alone. Each worker keeps the parts it has met.
2. The tokens of new parts are laid on one axis of bytes, those of A and B are sorted
   by start together, and the running maximum of their ends is taken: a group ends
   where a start reaches it, which is where tokens of both end. Within groups each
   token of A is linked to the tokens of B that its bytes overlap.
3. Each text's figures and distinct linked pairs are stored. Spark counts the links of
   each pair over all texts; the counts are broadcast to the texts' pairs if there are
   at most ``most_pairs`` of them, and joined with them if there are more.

Defined cases: null and empty texts, and texts that a tokenizer doesn't give back byte
for byte, have no tokens: zeros, and '' for the groups' hash. Strings of special tokens
are plain text. A text without spaces is one part, however long. Repeated rows count
once each; rows with equal or null ids get a result each; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_slices, cut, give_back, ragged

FIGURES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
#: Counted pairs of ids that are broadcast, at most: 17 bytes each.
MOST_PAIRS = 4_000_000
#: Parts that a worker keeps, about; some 300 bytes each.
ROOM = 400_000
#: Spaces before which no token of either tokenizer goes on.
ODD = "▁\u180e\u200b\ufeff"
CUT = re.compile(f"(?<=[^\\s{ODD}]) (?!\\Z)")
#: Where not every space is such a one.
HARD = re.compile(f"[\\s{ODD}] |\\A | \\Z")
BETWEEN = ("\n", ";", "|", ",")


def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start (A first), and the number of the group of each in that order."""
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    new = np.r_[True, start[order][1:] >= reached[:-1]] if len(order) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1


def overlapping(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of each pair that overlap; both sides ascend and don't overlap themselves."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    return np.repeat(np.arange(len(a_start)), high - low), ragged(low, high - low)


def parts_of(text: str) -> list[str]:
    return CUT.split(text) if HARD.search(text) else text.split(" ")


class Numbers(dict):
    """Numbers parts as they first appear."""

    def __missing__(self, part: str) -> int:
        self[part] = k = len(self)
        return k


class Aligner:
    def __init__(self, a_file: str, b_file: str, room: int = ROOM):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(a_file)) as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        plain = {c: bytes([k]) for k, c in enumerate(byte_characters())}
        ranks = {b"".join(map(plain.__getitem__, w)): k for w, k in vocab.items() if all(c in plain for c in w) and not w.startswith("<|")}
        # merges in the order of ids make a vocabulary of ranks, whose encoder is several times as fast
        made = [vocab[m.replace(" ", "")] for m in merges]
        if made != list(range(256, 256 + len(made))) or len(ranks) < 256 + len(made):
            raise ValueError(f"the merges of {a_file} aren't in the order of its ids")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, k in ranks.items():
            self.a_bytes[k] = word
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k in range(self.b.vocab_size()) for p in [self.b.id_to_piece(k)]]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.said = [str(k) for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.room, self.age = room, 0
        self.forget(np.zeros(0, np.int64))

    def forget(self, kept: np.ndarray) -> None:
        """Forgets all parts but those of the numbers kept, which are numbered anew."""
        self.age += 1
        if not len(kept):
            self.index, self.groups = Numbers(), []
            self.figures, self.links, self.first, self.used = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            parts = list(self.index)
            self.links, n = self.links_of(kept)
            self.index = Numbers((parts[k], i) for i, k in enumerate(kept.tolist()))
            self.groups = [self.groups[k] for k in kept.tolist()]
            self.figures, self.first, self.used = self.figures[kept], np.cumsum(n) - n, np.zeros(len(kept), np.int64)
        self.known = len(self.index)
        self.held = sum(map(len, self.index))

    def encoded_a(self, joined: str, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of parts on end, and how many each has. Parts end where tokens do."""
        ids = self.a.encode_to_numpy(joined).astype(np.int64)
        ends = np.cumsum([len(r) for r in raw])
        upto = np.searchsorted(np.cumsum(self.a_size[ids]), ends, "right")
        return ids, np.diff(upto, prepend=0)

    def learn(self) -> None:
        """Aligns the parts that were numbered since."""
        parts = list(itertools.islice(self.index, self.known, None))
        raw = [(" " + p).encode() for p in parts]
        # after a part that ends in white space the next one's tokens may begin earlier, so it's encoded alone
        joined = "".join([" " + p for p in parts])
        last = np.array([p[-1:].isspace() or p[-1:] in ODD for p in parts]) if HARD.search(f"{joined} ", 1) else np.zeros(0, bool)
        if last.any():
            alone = [self.encoded_a(" " + p, [r]) if odd else None for p, r, odd in zip(parts, raw, last)]
            plain = [k for k in range(len(parts)) if not last[k]]
            together = self.encoded_a("".join([" " + parts[k] for k in plain]), [raw[k] for k in plain]) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            lists = iter(np.split(together[0], np.cumsum(together[1])[:-1]))
            lists = [x[0] if x else next(lists) for x in alone]
            a, n_a = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        else:
            a, n_a = self.encoded_a(joined, raw)
        b_lists = self.b.encode(parts, num_threads=1)
        n_b = np.fromiter(map(len, b_lists), np.int64, len(parts))
        b = np.fromiter(itertools.chain.from_iterable(b_lists), np.int64, int(n_b.sum()))
        ok = np.ones(len(parts), bool)
        body = b"".join(raw)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != body or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != body:
            lists = zip(np.split(a, np.cumsum(n_a)[:-1]), b_lists, raw)
            ok = np.array([b"".join(map(self.a_bytes.__getitem__, x.tolist())) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in lists])
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
            n_a, n_b = n_a * ok, n_b * ok
        ends = [np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])]
        starts = [ends[0] - self.a_size[a], ends[1] - self.b_size[b]]
        owner = np.concatenate([np.repeat(np.arange(len(parts)), n) for n in (n_a, n_b)])
        side = np.repeat(np.array([0, 1]), [len(a), len(b)])
        order, group = coalesced(np.concatenate(starts), np.concatenate(ends), side)
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        n_groups = np.bincount(owner[order[new]], minlength=len(parts))
        x, y = overlapping(starts[0], ends[0], starts[1], ends[1])
        n_links = np.bincount(owner[x], minlength=len(parts))
        # groups as text: A's ids, then B's
        at = np.lexsort((side[order], group))
        told, g = order[at], group[at]
        own, s = owner[told], side[told]
        mark = np.full(len(told), 3)
        mark[1:][s[1:] != s[:-1]] = 2
        mark[1:][g[1:] != g[:-1]] = 1
        mark[1:][own[1:] != own[:-1]] = 0
        words = [""] * (2 * len(told))
        words[::2] = map(BETWEEN.__getitem__, mark.tolist())
        words[1::2] = map(self.said.__getitem__, np.concatenate([a, b])[told].tolist())
        lines = "".join(words[1:]).split("\n")
        if not ok.all():
            each = iter(lines)
            lines = [next(each) if good else "" for good in ok]
        self.groups += lines
        self.figures = np.concatenate([self.figures, np.stack([ok.astype(np.int64), n_a, n_b, n_groups, n_links], 1)])
        self.first = np.append(self.first, len(self.links) + np.cumsum(n_links) - n_links)
        self.links = np.append(self.links, code(a[x], b[y]))
        self.used = np.append(self.used, np.zeros(len(parts), np.int64))
        self.known = len(self.index)
        self.held += len(body)

    def read(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's parts; none for a text without tokens. They hold until the next call."""
        if len(self.index) > self.room or self.held > 64 * self.room:
            # those met in several calls stay, if they leave room
            again = np.flatnonzero(self.used > 1)
            self.forget(again if len(again) < 0.7 * self.room and sum(self.figures[again, 1:3].ravel()) < 20 * self.room else again[:0])
        number = self.index.__getitem__
        out = [np.array(list(map(number, parts_of(t))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if len(self.index) > self.known:
            self.learn()
        self.used[np.unique(np.concatenate([*out, np.zeros(0, np.int64)]))] += 1
        for k, t in enumerate(texts):
            if len(out[k]) and not self.figures[out[k], 0].all():
                whole = number(t)  # judged as a whole
                if len(self.index) > self.known:
                    self.learn()
                out[k] = np.array([whole] * int(self.figures[whole, 0]), np.int64)
        return out

    def links_of(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of parts, and how many each part has."""
        n = self.figures[parts, 4]
        return self.links[ragged(self.first[parts], n)], n


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, the others from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [k for k in range(256) if k not in shown]
    return [chr(k) if k in shown else chr(256 + hidden.index(k)) for k in range(256)]


@functools.lru_cache(1)
def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker, which meets the same words in all its tasks."""
    return Aligner(a_file, b_file)


def figures_of(rows: DataFrame, a_file: str, b_file: str, groups: bool = False) -> DataFrame:
    """id, the figures and the distinct linked pairs (with how often) of each row (id, text); with groups, these as text too."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_file, b_file)
        for batch in byte_slices(batches, "text", 1 << 20):
            parts = own.read([t or "" for t in batch.column("text").to_pylist()])
            n = np.array([len(p) for p in parts], np.int64)
            every, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), n)
            figures = [np.bincount(doc, own.figures[every, k], len(parts)).astype(np.int64) for k in range(1, 5)]
            said = [";".join(map(own.groups.__getitem__, p.tolist())) for p in parts]
            told = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in said]
            # pairs as small numbers, so that a text and a pair are one number
            which, at = np.unique(every, return_inverse=True)
            links, each = own.links_of(which)
            pairs, number = np.unique(links, return_inverse=True)
            begin = np.cumsum(each) - each
            linked = number[ragged(begin[at], each[at])]
            both, times = np.unique(np.repeat(doc, each[at]) * max(1, len(pairs)) + linked, return_counts=True)
            owner, pair = both // max(1, len(pairs)), pairs[both % max(1, len(pairs))]
            ends = np.searchsorted(owner, np.arange(len(parts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(t))) for v, t in ((pair >> 32, np.int32), (pair & 0xFFFFFFFF, np.int32), (times, np.int64))]
            more = [pa.array(said, pa.string())] * groups
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, figures), pa.array(told, pa.string()), *more, *lists], names=["id", *FIGURES, *["groups"] * groups, "a", "b", "times"])
        give_back()

    return rows.mapInArrow(of, f"id {dict(rows.dtypes)['id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {'groups string, ' * groups}a array<int>, b array<int>, times array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n and best (whether no other pair of this B id has more links) of all linked pairs."""
    each = cut(found.select(F.inline(F.arrays_zip("a", "b", "times"))).groupBy("a", "b").agg(F.sum("times").alias("n")))
    top = each.groupBy("b").agg(F.max("n").alias("most"))
    return each.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_sums(found: DataFrame, counts: DataFrame, most_pairs: int) -> DataFrame:
    """Adds n_best and count_sum; counts is stored."""
    if counts.count() > most_pairs:
        # each row is told by a key of its own, which is stored
        rows = cut(found.withColumn("key", F.expr("uuid()")), large=True)
        met = rows.select("key", F.inline(F.arrays_zip("a", "b", "times"))).join(counts, ["a", "b"])
        best = F.when(F.col("best"), F.col("times")).otherwise(0)
        sums = met.groupBy("key").agg(F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        return rows.drop("a", "b", "times").join(sums, "key", "left").fillna(0, ["n_best", "count_sum"])
    own = counts.select(F.expr("shiftleft(CAST(a AS BIGINT), 32) + b").alias("code"), "n", "best").toArrow()  # most_pairs rows at most
    codes, n, best = (c.to_numpy() for c in own.columns)
    order = np.argsort(codes)
    shared = found.sparkSession.sparkContext.broadcast((codes[order], n[order], best[order].astype(np.int64)))
    carried = [(c, t) for c, t in found.dtypes if c not in ("a", "b", "times")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, *values = shared.value
        for batch in batches:
            a, b, times = (batch.column(c) for c in ("a", "b", "times"))
            at = np.searchsorted(codes, code(a.flatten().to_numpy(), b.flatten().to_numpy()))
            end = np.cumsum(pc.list_value_length(a).to_numpy())
            begin = np.r_[0, end[:-1]]
            # by differences of running sums, as integers
            upto = [np.r_[0, np.cumsum(v[at] * times.flatten().to_numpy())] for v in values]
            count_sum, n_best = (pa.array(u[end] - u[begin]) for u in upto)
            names = [c for c, _ in carried]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [n_best, count_sum], names=[*names, "n_best", "count_sum"])
        give_back()

    return found.mapInArrow(of, ", ".join(f"{c} {t}" for c, t in carried) + ", n_best long, count_sum long")


def align(docs: DataFrame, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS, groups: bool = False) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, best links, sum of their counts and the groups' hash of every row; with
    groups also these themselves, as text: A's ids and B's of each (``a1,a2|b1;a3|b2,b3``).

    a_file and b_file name files of the public vocabularies; each worker finds its own copies."""
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut(figures_of(rows, a_file, b_file, groups))
    out = with_sums(found, cut(pair_counts(found)), most_pairs)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups)
