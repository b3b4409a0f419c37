"""Language identification by hierarchical discrimination.

First the language family is predicted (linear support vector machines, one
against the rest), then one-versus-one linear support vector machines separate the
languages within it by votes. Features are the relative frequencies of hashed
1- to 3-grams of lower-cased letters, over the whole text. As every machine is
linear, a text's margins are means of per-gram weights, gathered at once for a
batch of texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no
learnt language every text is ``und``; with one it is that language; ties of votes
go to the greater sum of margins, then to the first name; repeated rows are
predicted alike; an empty table gives no rows; columns besides those named are
ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, give_back, spans
from .toxicity import sample

#: Texts of each language to learn from, at most; sampled by hash. SAMPLE_ALL bounds all languages' together.
SAMPLE_TEXTS, SAMPLE_ALL = 400, 4000
BUCKETS = 1 << 12
#: Families of languages by ISO 639-1 code; others form one family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la lb oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv ms tl",
}
WORDLY = re.compile(r"[^\W\d_]")  # letters, and numerals such as ½ besides
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
#: Letters below are looked up; above, each code point stands for itself.
TABLE = 0x3000


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L."""
    return any(m[0].isalpha() for m in WORDLY.finditer(text))


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang.split("-")[0].lower() in own.split()), "other")


def lower_letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space where it is none."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(TABLE)], np.uint32)


def gram_hashes(texts: list[str], table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams at each kept place, where texts begin, and how many places each has.

    Of a run of other characters one space stays; each text ends in two."""
    code = np.frombuffer("".join(f" {t}  " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    letters = np.where(code < TABLE, table[np.minimum(code, TABLE - 1)], code)
    keep = np.r_[True, (letters[1:] != 32) | (letters[:-1] != 32)]
    starts = np.cumsum(sizes) - sizes
    keep[starts] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    n = upto[starts + sizes] - upto[starts]
    c = letters[keep]
    d = np.concatenate([c[1:], [np.uint32(32)]])
    e = np.concatenate([c[2:], [np.uint32(32)] * min(2, len(c))])[: len(c)].astype(np.uint32)
    last = upto[starts + sizes] - 1  # grams don't reach into the next text
    d[last] = e[last] = 32
    e[last[n > 1] - 1] = 32
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    one = (c * np.uint32(0x9E3779B1)) >> shift
    two = ((c * np.uint32(0x85EBCA6B)) ^ (d * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))) * np.uint32(0x9E3779B1) >> shift
    three = ((c * np.uint32(0x165667B1)) ^ (d * np.uint32(0x27D4EB2D)) ^ (e * np.uint32(0x9E3779B1) + np.uint32(0x51ED270B))) * np.uint32(0x85EBCA6B) >> shift
    return [one, two, three], upto[starts], n


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 80, c: float = 1.0) -> np.ndarray:
    """A linear support vector machine: squared hinge with an L2 bound, by accelerated gradient. Both sides weigh half."""
    y = y.astype(x.dtype)
    worth = (np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean()) * c / len(y)).astype(x.dtype)
    v = np.random.default_rng(1).normal(size=x.shape[1]).astype(x.dtype)
    for _ in range(8):  # the steepest curvature, for the step
        v = (worth * (x @ v)) @ x
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / (1e-3 + 2 * np.linalg.norm((worth * (x @ v)) @ x) * 1.2)
    step = x.dtype.type(step)
    w = z = np.zeros(x.shape[1], x.dtype)
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (x.dtype.type(1e-3) * z - 2 * (worth * y * gap) @ x)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + x.dtype.type((t - 1) / s) * (new - w)
        w, t = new, s
    return w


@dataclass
class Model:
    families: list[tuple[str, list[str]]]
    #: Columns of weights: the families', then those of each pair of languages within a family.
    pairs: list[tuple[str, str]]
    weights: np.ndarray  #: 3 * BUCKETS rows
    bias: np.ndarray


def train(texts: list[str], langs: list[str]) -> Model:
    own: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        own.setdefault(family_of(lang), []).append(lang)
    families = sorted(own.items())
    pairs = [p for _, ls in families for p in combinations(ls, 2)]
    width = 3 * BUCKETS
    if not texts:
        return Model([], [], np.zeros((width, 1), np.float32), np.zeros(1))
    x = np.zeros((len(texts), width), np.float32)
    table = lower_letters()
    for k, t in enumerate(texts):
        hashes, _, n = gram_hashes([t], table)
        for g, h in enumerate(hashes):
            x[k, g * BUCKETS : (g + 1) * BUCKETS] = np.bincount(h, minlength=BUCKETS) / n[0]
    mean = x.mean(0)
    scale = (1 / np.maximum(x.std(0), 1e-4)).astype(np.float32)
    x -= mean
    x *= scale / np.float32(np.sqrt(width))
    lang = np.array(langs)
    kin = np.array([family_of(v) for v in langs])
    columns = [machine(x, np.where(kin == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(width) for f, _ in families]
    for a, b in pairs:
        rows = (lang == a) | (lang == b)
        columns.append(machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0)))
    w = np.stack(columns, 1) * (scale / np.sqrt(width))[:, None]
    return Model(families, pairs, w.astype(np.float32), -(mean @ w))


def margins(model: Model, texts: list[str], table: np.ndarray) -> np.ndarray:
    hashes, begins, n = gram_hashes(texts, table)
    out = np.zeros((len(texts), model.weights.shape[1]))
    for g, h in enumerate(hashes):
        part = model.weights[g * BUCKETS : (g + 1) * BUCKETS]
        for c in range(part.shape[1]):
            out[:, c] += np.add.reduceat(part[:, c][h], begins, dtype=np.float64)
    return out / n[:, None] + model.bias


def decide(model: Model, margin: np.ndarray) -> tuple[str, float]:
    sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -10, 10)))
    k = int(np.argmax(margin[: len(model.families)]))
    _, langs = model.families[k]
    score = sure(margin[k]) if len(model.families) > 1 else 1.0
    won = {v: [0, 0.0] for v in langs}
    for (a, b), m in zip(model.pairs, margin[len(model.families) :]):
        if a in won:
            for v, own in ((a, m), (b, -m)):
                won[v][0] += own > 0
                won[v][1] += own
    best = max(langs, key=lambda v: won[v])
    for (a, b), m in zip(model.pairs, margin[len(model.families) :]):
        if best in (a, b) and a in won:
            score *= sure(m if best == a else -m)
    return best, float(score)


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_TEXTS) -> Model:
    """A model from at most ``most`` texts of each language among the rows that aren't held out."""
    rows = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    known = [r["lang"] for r in rows.select("lang").distinct().collect()]  # as many as there are languages
    chosen = sample(rows, "lang", dict.fromkeys(known, max(1, min(most, SAMPLE_ALL // max(1, len(known))))), F.xxhash64("doc_id", F.lit(4)))

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[[has_letter(t) for t in frame["text"]]].sort_values(["doc_id", "lang", "text"])
        model = train(frame["text"].tolist(), frame["lang"].tolist())
        del frame
        give_back()
        return pd.DataFrame({"families": [json.dumps(model.families)], "pairs": [json.dumps(model.pairs)], "weights": [model.weights.tobytes()], "bias": [model.bias.tobytes()]})

    # the sample is bounded, so one task can learn from it; the driver gets a column of weights for each machine
    got = chosen.select("doc_id", "text", "lang").withColumn("of", F.lit("all")).groupBy("of").applyInPandas(of, "families string, pairs string, weights binary, bias binary").collect()
    if not got:
        return train([], [])
    families, pairs = ([tuple(x) for x in json.loads(got[0][k])] for k in ("families", "pairs"))
    return Model(families, pairs, np.frombuffer(got[0]["weights"], np.float32).reshape(3 * BUCKETS, -1), np.frombuffer(got[0]["bias"], np.float64))


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.families, model.pairs, model.weights, model.bias))  # 3 * BUCKETS rows, a column for each pair of related languages

    def of(batches):
        own, table = Model(*shared.value), lower_letters()
        for batch in batches:
            for part in spans([len(t) if t else 0 for t in batch["text"]], 1 << 20, rows=200):
                rows = batch.iloc[part]
                texts = [t or "" for t in rows["text"]]
                m = margins(own, texts, table)
                said = [decide(own, m[k]) if own.families and has_letter(t) else ("und", 0.0) for k, t in enumerate(texts)]
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "held_out": rows["held_out"], "lang_pred": [s[0] for s in said], "score": [s[1] for s in said]})

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False))).mapInPandas(of, PREDICTED)
