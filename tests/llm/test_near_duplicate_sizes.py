"""What near-duplicate detection broadcasts and stores does not grow with chance and with copies."""

import random

from test_dedup import brute_components, table

from flurstrom.llm import minhash

CLASSES = "id long, values array<long>"


def test_exploded_values_are_not_broadcast(spark, monkeypatch, tmp_path):
    """By its files the table is small enough; as an explode's result it was sent to the driver."""
    plans, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df, **options: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, **options))
    spark.createDataFrame([(i, list(range(100 * (i // 2), 100 * (i // 2) + minhash.COORDS))) for i in range(40)], CLASSES).write.parquet(f"{tmp_path}/classes")
    out = minhash.posted(spark.read.parquet(f"{tmp_path}/classes"))
    assert out.count() == 40 * (minhash.COORDS - minhash.MATCHES + 1)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_long_lists_of_chance_are_listed_anew(spark):
    """Each value stands in some 40 classes, so that lists are long, but within a group few members share it."""
    rng = random.Random(1)
    rows = [[100 * j + rng.randrange(50) for j in range(minhash.COORDS)] for _ in range(2000)]
    for k in range(0, 80, 2):
        rows[k + 1] = [x if rng.random() < 0.8 else y for x, y in zip(rows[k], rows[k + 1])]
    pairs, members = minhash.listed(spark.createDataFrame(list(enumerate(rows)), CLASSES))
    alike = {(k + 1, k) for k in range(0, 80, 2) if sum(x == y for x, y in zip(rows[k], rows[k + 1])) >= minhash.MATCHES}
    assert len(alike) >= 35 and members.count() == 0 and alike <= {(r["u"], r["v"]) for r in pairs.collect()}


def test_pairs_are_confirmed_in_portions(spark, monkeypatch):
    """Near copies make many pairs; the texts that are shuffled for them at once are a part of all texts."""
    rng, parts, beside = random.Random(2), [], minhash.side_by_side
    rows = []
    for k in range(12):
        base = [f"b{k}-{j}" for j in range(60)]
        for i in range(10):
            w = list(base)
            for p in rng.sample(range(60), rng.randint(0, 8)):
                w[p] = f"e{k}-{i}-{p}"
            rows.append((100 * k + i, " ".join(w)))

    def counted(*a):
        for part in beside(*a):
            parts.append(part.count())
            yield part

    monkeypatch.setattr(minhash, "side_by_side", counted)
    got = sorted((tuple(r) for r in minhash.near_duplicates(table(spark, rows), words=2).collect()), key=str)
    assert got == brute_components(rows, 2, 80) and len(parts) > 4 and max(parts) <= len(rows)
