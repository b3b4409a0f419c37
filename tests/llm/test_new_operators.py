"""Alignment of tokenizers, repair of conversations and fingerprints of documents, against brute force."""

import functools
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flurstrom.llm import align, fingerprint, repair
from flurstrom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# alignment


@functools.cache
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), align.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")


def plainly_aligned(text):
    """The groups, as lists of ids, and linked pairs of ids of a text, token by token."""
    a, b, own = tokenizers()
    if not text:
        return [], []
    raw = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [own.a_bytes[k] for k in ids[0]], [own.b_bytes[k] for k in ids[1]]
    if any(b"".join(p) != raw for p in parts):
        return [], []
    spans = [[(e - len(p), e) for e, p in zip(itertools.accumulate(map(len, p)), p)] for p in parts]
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = [[[k for k, (_, e) in zip(i, s) if low < e <= high] for i, s in zip(ids, spans)] for low, high in zip([0, *ends], ends)]
    links = [(x, y) for x, (p, q) in zip(ids[0], spans[0]) for y, (r, s) in zip(ids[1], spans[1]) if p < s and r < q]
    return groups, links


def texts_of_all_kinds():
    rng = random.Random(7)
    alphabet = " \n\t  abcdefgé.,'!0123456789ßü▁<>|日 ​　\x85"
    own = [None, "", " ", "a", "  a", "a  ", " a\n b", "\n", "<s> </s> [INST]", "<|endoftext|> x", "▁a", "a ▁b", "日本語 テキスト です", "😀 a😀b", "\x00 a", "<0x41> b", "ﬁ x²", "\r\n a \x1c b", "same words", "same words", "x" * 3000]
    return own + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(200)]


@pytest.mark.parametrize("most_pairs", [align.MOST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, most_pairs):
    texts = texts_of_all_kinds()
    found = [plainly_aligned(t) for t in texts]
    count = {}
    for _, links in found:
        for pair in links:
            count[pair] = count.get(pair, 0) + 1
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    want = []
    for k, (groups, links) in enumerate(found):
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        want.append((k, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    docs = spark.createDataFrame([(k, t, 1, "n") for k, t in enumerate(texts)], "doc_id long, text string, a int, pairs string").repartition(3)
    assert sorted(tuple(r) for r in align.align(docs, most_pairs=most_pairs).collect()) == want
    assert sum(bool(g) for g, _ in found) > 100 and sum(not g for g, _ in found) > 20


def test_alignment_of_null_ids_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(None, "ab cd"), (None, "ab cd"), (1, "ab cd"), (1, None)], "doc_id long, text string")
    rows = align.align(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"] > 0) for r in rows) == [(0, True), (0, True), (1, False), (1, True)]
    assert [r["count_sum"] for r in rows if r["n_links"]] == [3 * r["n_links"] for r in rows if r["n_links"]]
    assert align.align(docs.limit(0)).collect() == []
    told = {r["groups"]: r["groups_sha256"] for r in align.align(docs, groups=True).collect()}
    assert len(told) == 2 and told[""] == "" and all(hashlib.sha256(k.encode()).hexdigest() == v for k, v in told.items() if k)


def test_a_worker_forgets_and_learns_anew(monkeypatch):
    own = align.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", room=20)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(60)]
    for _ in range(40):
        texts = [" ".join(rng.choices(words[:5] * 8 + words, k=15)) for _ in range(3)]
        for text, parts in zip(texts, own.read(texts)):
            groups, links = plainly_aligned(text)
            assert ";".join(own.groups[k] for k in parts) == ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
            assert own.links_of(parts)[0].tolist() == [a << 32 | b for a, b in links]
    assert own.age > 3


def test_intervals_coalesce_where_both_sides_end():
    start, end, side = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 9, 3, 5, 9]), np.array([0, 0, 0, 1, 1, 1])
    order, group = align.coalesced(start, end, side)
    assert group.tolist() == [0, 0, 0, 0, 1, 1] and order.tolist() == [0, 3, 1, 4, 2, 5]
    assert [x.tolist() for x in align.overlapping(start[:3], end[:3], start[3:], end[3:])] == [[0, 1, 1, 2], [0, 0, 1, 2]]


# repair

WHITE = " \t\n\v\f\r"


def cheapest(rows):
    """Least cost and first audit over all edits, by recursion; rows: initial and fault."""
    then = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]

    @functools.cache
    def best(i, state, inserts):
        out = [(0, "")] if i == len(rows) and state in (0, 3) else []
        for c in "ua":
            if c in then[state] and inserts < 3:
                cost, audit = best(i, then[state][c], inserts + 1)
                out.append((cost + 2, "I" + audit))
        if i < len(rows):
            initial, fault = rows[i]
            cost, audit = best(i + 1, state, 0)
            out.append((cost + 3, "D" + audit))
            for c in then[state] if fault not in ("blank", "duplicate") else ():
                for letter, paid, fits in (("K", 0, c == initial), ("R", 2, c in "ua")):
                    if fits:
                        cost, audit = best(i + 1, then[state][c], 0)
                        out.append((cost + paid + (fault == "truncated"), letter + audit))
        return min(out) if out else (10**9, "")

    return best(0, 0, 0)


def repaired(rows, audit):
    then = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    out, state, left = [], 0, iter(rows)
    for letter in audit:
        role, text = next(left) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        state = then[state][role[0]]
        out.append(f"{role}:{text}")
    return "\n".join(out)


def plainly_repaired(table):
    """Reports of conversations (conv_id, turn, role, text), damaged first."""
    said = lambda v: " " if v is None else str(v)
    own = {conv: [] for conv, *_ in table}
    for conv, turn, role, text in table:
        role, text, c = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if c == 1 else "".join(x for x in text if x not in ".!?") if c == 2 else text
        own[conv] += [(turn, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    out = {}
    for conv, rows in own.items():
        key = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), key(*r[1:])))
        faults, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(WHITE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        turns = {r[0] for r in rows} - {None}
        cost, audit = cheapest(tuple(zip(initials, faults)))
        text = repaired([r[1:] for r in rows], audit)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def reports(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_repair_of_the_table_equals_brute_force(spark):
    rows = pd.read_parquet(f"{SF}/conversations.parquet")
    want = plainly_repaired([tuple(r) for r in rows[["conv_id", "turn", "role", "text"]].itertuples(index=False)])
    assert reports(QUERIES["op12_conversation_repair"](spark, SF)) == want


def test_repair_of_odd_conversations_equals_brute_force(spark):
    rng = random.Random(5)
    table = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randint(1, 14)):
            turn = rng.choice([turn, turn, turn, None, turn * 3, 0])
            table.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", None, "", "uncle", "éa"]), rng.choice(["Hi.", "Hi", "yes!", None, "", " \n", "No?\t", "same.", "x ", f"t{turn}."])))
    df = spark.createDataFrame(table, CONVERSATIONS).withColumns({"part": F.lit("x"), "key": F.lit(1), "again": F.lit(None).cast("int")}).repartition(5)
    assert reports(repair.repair(repair.damaged(df), df)) == plainly_repaired(table)


def test_repair_sql_gives_the_same_reports():
    rng = random.Random(15)
    table = [(conv, rng.choice([turn, turn, None, 0]), rng.choice(["user", "assistant", "assistant", "system", None, "uncle"]), rng.choice(["Hi.", "Hi", None, "", " \n", "No?\t", "same.", f"t{turn}."])) for conv in [None, *range(150)] for turn in range(rng.randint(1, 9))]
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", table)
    assert {r[0]: tuple(r[1:]) for r in c.execute(repair.sql()).fetchall()} == plainly_repaired(table)


def test_repair_without_rows_and_of_nothing(spark):
    gone = next(k for k in range(10**6) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], CONVERSATIONS)
    assert reports(repair.repair(repair.damaged(df), df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(df.limit(0)).collect() == []


def test_repaired_turns_come_as_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "So?"), (1, 2, "assistant", "Yes."), (1, 3, "user", ""), (2, 0, "assistant", "Go.")], CONVERSATIONS)
    got = sorted((r["conv_id"], r["pos"], r["edit"], r["role"], r["text"]) for r in repair.repair(df, turns=True).collect())
    assert got == [(1, 1, "K", "user", "Hi."), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "So?"), (1, 4, "K", "assistant", "Yes."), (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "Go.")]
    assert reports(repair.repair(df))[2][6] == "IK"


def test_a_long_conversation_is_one_stream(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.when(F.col("id") % 7 == 0, "again").otherwise(F.col("id").cast("string")), F.lit(".")).alias("text")).repartition(4)
    got = reports(repair.repair(df))[1]
    assert got[1:4] == (0, (n + 6) // 7 - 2, 0) and len(got[6]) >= n and got[6].startswith("KKKK")


def test_prices_are_the_least_costs_and_the_first_audit_is_traced():
    rng = random.Random(3)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        rows = [(rng.choice("suuaaaxé"), rng.randrange(4)) for _ in range(rng.randint(0, 12))]
        own = repair.Lattice()
        for r in rows:
            own.add(*r)
        cost, audit = own.audit()
        assert (cost, audit.decode()) == cheapest(tuple((i, names[f]) for i, f in rows)), rows


# fingerprints


def sketched(text, k=fingerprint.K, words=fingerprint.WORDS):
    ws = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    return sorted({hashlib.md5(" ".join(ws[max(0, i - words) : i]).encode()).hexdigest()[:16] for i in range(1, len(ws) + 1)})[:k]


def alike(a, b, k=fingerprint.K):
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def plainly_compared(rows):
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for (k, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = map(sketched, (text, changed, after))
        out.append((-1 if k is None else k, len(text), hashlib.sha256(changed.encode()).hexdigest(), ",".join(a), ",".join(b), alike(a, b), alike(a, c)))
    return sorted(out)


@pytest.mark.parametrize("range_bytes", [1 << 20, 300])
def test_fingerprints_equal_brute_force(spark, range_bytes):
    rng = random.Random(2)
    words = ["w" + str(k) for k in range(60)] + ["ä", "日本", "😀x"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", " ", "\t "]) for _ in range(n))
    rows = [(k * 3, text(rng.choice([0, 1, 3, 5, 30, 400]))) for k in range(60)] + [(1000, None), (1001, ""), (1002, "one two"), (1003, "one two"), (None, "null a b"), (None, None), *((500, text(20)) for _ in range(40)), (7, "z y x"), (7, "z y x")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, range int, sketch string, key string").repartition(4)
    got = sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in fingerprint.with_next(df, range_bytes=range_bytes).collect())
    assert got == plainly_compared(rows)


def test_a_long_text_is_sketched_in_portions(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "PORTION", 7)
    text = " ".join(str(k % 50) for k in range(400))
    df = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}
    assert got == {1: ",".join(sketched(text)), 2: ",".join(sketched("a b"))}


def test_one_document_follows_itself_and_none_give_none(spark):
    df = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    row = fingerprint.with_next(df).collect()[0]
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"a b c " + b"a b c").hexdigest()
    assert fingerprint.with_next(df.limit(0)).collect() == []


def test_estimates_are_near_the_truth_and_parts_merge(spark):
    rng = random.Random(9)
    a = [f"t{rng.randrange(10**6)}" for _ in range(3000)]
    pairs = [(a, a[:2000]), (a, a[1500:] + [f"u{k}" for k in range(3000)]), (a[:40], a[:20])]
    df = spark.createDataFrame([(k, " ".join(x), " ".join(y)) for k, (x, y) in enumerate(pairs)], "k int, x string, y string")
    s = df.select("k", fingerprint.sketch(F.col("x")).alias("x"), fingerprint.sketch(F.col("y")).alias("y"))
    rows = s.select("k", fingerprint.resemblance(F.col("x"), F.col("y")).alias("r"), fingerprint.containment(F.col("y"), F.col("x")).alias("c"), fingerprint.distinct_count(F.col("x")).alias("n"), fingerprint.merged(F.col("x"), F.col("y")).alias("m")).orderBy("k").collect()
    shingles = lambda ws: {tuple(ws[max(0, i - 5) : i]) for i in range(1, len(ws) + 1)}
    for r, (x, y) in zip(rows, pairs):
        p, q = shingles(x), shingles(y)
        assert abs(r["r"] - len(p & q) / len(p | q)) < 0.12 and abs(r["c"] - len(p & q) / len(q)) < 0.2 and abs(r["n"] / len(p) - 1) < 0.25
        assert r["m"] == sorted({*sketched(" ".join(x)), *sketched(" ".join(y))})[: fingerprint.K]


def test_fingerprint_sql_gives_the_same_rows(spark):
    got = sorted(tuple(r) for r in QUERIES["op13_document_fingerprints"](spark, SF).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == sorted(c.execute(fingerprint.sql()).fetchall())


def test_fingerprints_use_no_python_workers(spark):
    plan = QUERIES["op13_document_fingerprints"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
