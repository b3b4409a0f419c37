"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed to buckets, so an
unseen misspelling shares vectors with the words it resembles. A text is the mean
of its words' vectors; embeddings and softmax are trained jointly in numpy on a
bounded sample of labelled rows. As the softmax is linear, a trained bucket is one
number, and a text's logit is the mean over its words: whole texts of any length
are scored in one pass.

Defined cases: null and empty texts get the score of an empty bag (the bias
alone); rows without label or text are never learnt from; with labels of one kind
only, or none, every score is that kind's share (0 without labels); of rows with
one id one is learnt from; repeated rows are scored alike; texts that the sample's
bytes have no room for aren't learnt from, and are scored whole like any other; an
empty table gives no rows; columns besides id and text are ignored.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, give_back, spans

#: Rows of each label to learn from, at most; sampled by hash. More of label 0 keeps clean texts clean.
SAMPLE_ROWS = {1: 1800, 0: 3400}
#: Bytes of the texts of each label's sample, at most: texts beyond are left out whole.
SAMPLE_BYTES = 48 << 20
BUCKETS = 1 << 16
DIM = 8
#: Passes over the sample: as many as make STEPS batches, within these bounds.
EPOCHS, STEPS = (12, 60), 1500
GRAMS = (3, 4, 5)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each word and of itself, and how many each word has. Vectorised over all words at once."""
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n) + 2
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(flat))  # characters from here to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    buckets, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        here = flat[k - 1 :] if k > 1 else flat
        h[: len(here)] = (h[: len(here)] ^ here) * mix
        h ^= h >> np.uint64(29)
        if k in GRAMS:
            whole = (room == sizes[owner]) & (sizes == k)[owner]
            fits = (room >= k) & ~whole
            buckets.append((h[fits] >> np.uint64(20)) % np.uint64(BUCKETS))
            owners.append(owner[fits])
    power = mix ** (np.arange(len(flat), dtype=np.uint64) - np.repeat(ends - sizes, sizes).astype(np.uint64))
    if n:
        whole = np.add.reduceat(flat * power, ends - sizes)
        buckets.append(((whole ^ (whole >> np.uint64(31))) * mix >> np.uint64(20)) % np.uint64(BUCKETS))
        owners.append(np.arange(n))
    bucket, owner = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=n)


@dataclass
class Model:
    #: Logit of label 1 against 0 that each bucket adds, and the bias.
    weight: np.ndarray
    bias: float


def train(texts: list[str], labels: np.ndarray, epochs: int | None = None, seed: int = 7) -> Model:
    """Minibatch Adagrad on the cross entropy; rows weigh alike."""
    if len(texts) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 30.0 * (2 * share - 1))
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = []
    for t in texts:
        got: dict[int, int] = {}
        for w in words_of(t):
            k = index.setdefault(w, len(index))
            got[k] = got.get(k, 0) + 1
        docs.append((np.fromiter(got, np.int64, len(got)), np.fromiter(got.values(), np.float32, len(got))))
    words = list(index)
    parts = []
    for k in range(0, len(words), 20_000):
        b, n = grams(words[k : k + 20_000])
        parts.append((b.astype(np.int32), n))
    del words, index
    bucket, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    begins = np.cumsum(counts) - counts
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full_like(x, 1e-8) for x in (table, out, bias)]
    size = 64
    epochs = epochs or int(np.clip(STEPS * size // len(docs), *EPOCHS))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.02
        order = rng.permutation(len(docs))
        for at in range(0, len(order), size):
            part = [k for k in order[at : at + size] if len(docs[k][0])]
            if not part:
                continue
            word = np.concatenate([docs[k][0] for k in part])
            share_of = np.concatenate([docs[k][1] / docs[k][1].sum() for k in part])
            row = np.repeat(np.arange(len(part)), [len(docs[k][0]) for k in part])
            own, back = np.unique(word, return_inverse=True)
            n = counts[own]
            flat = bucket[np.arange(n.sum()) + np.repeat(begins[own] - (np.cumsum(n) - n), n)]
            word_vec = np.add.reduceat(table[flat], np.cumsum(n) - n) / n[:, None]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            doc_vec = np.add.reduceat(word_vec[back] * share_of[:, None], first)
            z = doc_vec @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            g = p / len(part)
            to_doc = g @ out.T
            to_word = np.stack([np.bincount(back, share_of * to_doc[row, d], len(own)) for d in range(DIM)], 1) / n[:, None]
            spread = np.repeat(to_word, n, axis=0)
            to_table = np.stack([np.bincount(flat, spread[:, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
            seen[0] += to_table**2
            table -= rate * to_table / np.sqrt(seen[0])
            for k, (x, dx) in enumerate(((out, doc_vec.T @ g), (bias, g.sum(0)))):
                seen[k + 1] += dx**2
                x -= rate * dx / np.sqrt(seen[k + 1])
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; a word's logit is computed once while the cache has room."""

    def __init__(self, model: Model, room: int = 50_000):
        self.model, self.room, self.known = model, room, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Scores of the texts, some megabyte of them at a time."""
        return np.concatenate([np.zeros(0), *(self.some(texts[part]) for part in spans([len(t) for t in texts], 1 << 20, rows=500))])

    def some(self, texts: list[str]) -> np.ndarray:
        found = [words_of(t) for t in texts]
        if len(self.known) > self.room:
            self.known = {}
        fresh = list({w for ws in found for w in ws}.difference(self.known))
        if fresh:
            bucket, n = grams(fresh)
            self.known.update(zip(fresh, (np.add.reduceat(self.model.weight[bucket], np.cumsum(n) - n) / n).tolist()))
        get = self.known.__getitem__
        z = np.array([sum(map(get, ws)) / len(ws) if ws else 0.0 for ws in found]) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def sample(rows: DataFrame, key: str, most: dict, by: Column) -> DataFrame:
    """At most most[v] rows of each value v of key (those with the least hashes), counted before and thinned before they are ranked."""
    there = {r[key]: r["count"] for r in rows.groupBy(key).count().collect() if r[key] in most}
    keep = F.lit(False)
    for v, n in there.items():
        keep = keep | ((F.col(key) == v) & (F.pmod(by, F.lit(1_000_000)) < int(min(1.0, 1.3 * most[v] / n + 0.0001) * 1_000_000)))
    ranked = rows.where(keep).withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    limit = F.lit(0)
    for v in there:
        limit = F.when(F.col(key) == v, F.lit(most[v])).otherwise(limit)
    return ranked.where(F.col("nth") <= limit).drop("nth")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: dict | None = None) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1)).dropDuplicates()
    known = known.where(~F.coalesce(held_out, F.lit(False)))
    by = F.xxhash64("doc_id", F.lit(5))
    most = most or SAMPLE_ROWS
    chosen = F.broadcast(sample(known, "label", most, by))  # ids and labels, as many as ``most`` allows
    rows = chosen.join(bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull()), "doc_id")
    # of an id's rows one, however many there are, and of the texts as many as there is room for
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    held = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(by, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("held", held).where(F.col("held") <= SAMPLE_BYTES).select("doc_id", "text", "label")

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "label", "text"])
        model = train(frame["text"].tolist(), frame["label"].to_numpy(np.int64))
        give_back()
        return pd.DataFrame({"weight": [model.weight.tobytes()], "bias": [model.bias]})

    # the sample is bounded, so one task can learn from it; the driver gets BUCKETS numbers
    got = rows.withColumn("of", F.lit("all")).groupBy("of").applyInPandas(of, "weight binary, bias double").collect()
    return Model(np.frombuffer(got[0]["weight"], np.float32), got[0]["bias"]) if got else train([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # BUCKETS numbers, whatever the input

    def of(batches):
        scorer = Scorer(Model(*shared.value))
        for rows in batches:
            s = scorer([t or "" for t in rows["text"]])
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "held_out": rows["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})
        del scorer
        give_back()

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False))).mapInPandas(of, SCORED)


def score_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score as a column, for rows that keep their other columns."""
    shared = spark.sparkContext.broadcast((model.weight, model.bias))

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*shared.value))
        for batch in texts:
            yield pd.Series(scorer([t or "" for t in batch]))
        del scorer
        give_back()

    return of(text)


def held(fold: int, of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == fold
