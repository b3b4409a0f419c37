"""The pipeline's stages against brute force on a small table."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flurstrom.llm import suffix


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("the and ing th er on tion of re st".split(), k=rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage = text(30), text(120)
    rows, toxic = [], []
    for k in range(240):
        body = text(60)
        if k % 4 == 1:
            body = " ".join(f"{w} blockhead" if j % 12 == 5 else w for j, w in enumerate(body.split()))
        toxic.append((k, 1, int(k % 4 == 1)))
        rows.append((k, body, "en", "s", len(body)))
    near = rows[0][1].split()
    near[30] = "changed"
    extra = [(1000, rows[0][1]), (1001, " ".join(near)), (1002, text(40) + " " + item + " " + text(40)), (1003, text(30) + " " + passage + " " + text(30)), (1004, text(30) + " " + passage + " " + text(30)), (1005, None), (1006, ""), (None, text(50)), (2, rows[2][1])]
    rows += [(i, t, "en", "s", None if t is None else len(t)) for i, t in extra]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("x")).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, passage


def test_stages(spark, folder):
    top, passage = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    clean = corpus_pipeline.cut(stages["toxicity"](spark, docs, top))
    assert clean.columns == docs.columns
    gone = ids(docs) - ids(clean)
    bad = {k for k in range(240) if k % 4 == 1}
    assert len(gone & bad) >= 0.9 * len(bad) and len(gone - bad) <= 0.05 * 180
    one = corpus_pipeline.cut(stages["near_dedup"](spark, clean, top))
    assert ids(clean) - ids(one) == {1000, 1001} & ids(clean) and one.where("doc_id = 2").count() == 1
    cutted = corpus_pipeline.cut(stages["suffix_dedup"](spark, one, top))
    assert cutted.columns == docs.columns and cutted.count() == one.count()
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (one, cutted))
    assert all(passage in before[i] and passage not in after[i] for i in (1003, 1004) if i in after)
    assert all(after[i] == t for i, t in before.items() if i not in (1003, 1004)) and len(passage) > suffix.LENGTH
    pure = corpus_pipeline.cut(stages["decontamination"](spark, cutted, top))
    assert ids(cutted) - ids(pure) == {1002} & ids(cutted)
    assert {r["doc_id"] for r in stages["packing"](spark, pure, top).collect()} == ids(pure)


def test_run_on_an_empty_table(spark, folder, tmp_path):
    top, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{top}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Repeated and null ids, null, empty and very long texts, columns with the operators' own names, null benchmark and labels."""
    rng = random.Random(14)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n))
    copy = text(40)
    rows = [(1, text(30)), (1, text(30)), (1, copy), (2, copy), (None, copy), (None, text(30)), (None, text(30)), (3, text(60_000)), (4, None), (4, None), (5, ""), (6, "x"), (7, "y " * 50_000), (8, text(30)), (8, None)]
    own = "key id n cls values spans copies passages body row item_no seed at shift nth rank bucket kept component_id score".split()
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in own})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, rows[1][1]), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.cut(stage(spark, now, str(tmp_path)))
        seen[name] = now.count()
        if name != "packing":
            assert now.columns == docs.columns and now.where(" OR ".join(f"{c} <> '{c}'" for c in own)).count() == 0
    # of the three copies the one with the least id stays, of the two equal rows one; all others are different documents
    assert seen["toxicity"] == len(rows) and seen["near_dedup"] == len(rows) - 3
    assert seen["suffix_dedup"] == seen["near_dedup"] and seen["decontamination"] == seen["near_dedup"] - 1
    assert now.where("piece = 0").count() == seen["decontamination"]


def test_passages_of_51_words_go(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(n))
    passage, fifty, short = text(51), text(50), " ".join(rng.choices("abcdefghijk", k=51))
    assert len(short) < len(passage) < suffix.LENGTH
    # of all windows of 51 words those that repeat; two neighbours that share 40 words each don't add up to one
    left, right = text(40), text(40)
    rows = [f"{text(60)} {passage} {text(60)}", f"{text(9)} {passage} {text(70)}", f"{text(60)} {fifty} {text(60)}", f"{text(9)} {fifty} {text(70)}", f"{short} {text(20)}", f"{text(20)} {short}"]
    rows += [f"{text(20)} {left} {right} {text(20)}", f"{text(30)} {left} {text(30)}", f"{text(30)} {right} {text(30)}", text(200), text(51), text(30), "", None]
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    gone = {0: passage, 1: passage, 4: short, 5: short}
    assert {k: r["text"] for k, r in out.items()} == {k: t.replace(gone[k], "") if k in gone else t for k, t in enumerate(rows)}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values() if r["text"] is not None)


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    stock = [" ".join(rng.choices("ab c de".split(), k=40)) for _ in range(6)]
    rows = sorted({rng.choice([" ", "\n"]).join(rng.choices(stock, k=rng.randint(1, 4))) for _ in range(30)} | {"to and fro " * 30})
    words, places = 45, {}
    for t in rows:
        w = list(re.finditer(r"\S+", t))
        for i in range(len(w) - words + 1):
            a, b = w[i].start(), w[i + words - 1].end()
            places.setdefault(t[a:b], set()).add((t, a, b))
    want = {p for own in places.values() if len(own) > 1 for p in own}
    texts = spark.createDataFrame([(t.encode(), t.encode()) for t in rows], "key binary, body binary")
    covered = lambda spans: {(t, k) for t, a, b in spans for k in range(a, b)}
    got = [(bytes(r["key"]).decode(), *r["spans"][0]) for r in suffix.passages(texts, words).collect()]
    assert covered(got) == covered(want) and len(want) > 100


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 300)
    body = "  ".join("w" * (k % 7 + 1) for k in range(400)).encode()
    ends = lambda t: [(m.start(), m.end()) for m in re.finditer(rb"\S+", t)]
    got = [(a + at, b + at) for at, part in suffix.pieces(body, 51) for (a, _), (_, b) in zip(ends(part), ends(part)[50:])]
    assert got == [(a, b) for (a, _), (_, b) in zip(ends(body), ends(body)[50:])]


def test_the_pipeline_sends_python_small_batches(spark, folder):
    top, key = folder[0], "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        corpus_pipeline.toxicity(spark, spark.read.parquet(f"{top}/documents.parquet"), top).count()
        assert spark.conf.get(key) == corpus_pipeline.BATCH == "2m"
    finally:
        spark.conf.set(key, before)
