"""Near duplicates, repeated byte strings and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, islice, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flurstrom.llm import minhash, packing, suffix

SCHEMA = "doc_id long, text string, key string, cls string, row string, n_bytes int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", "c", "r", 1) for i, t in rows], SCHEMA)


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute_components(rows, words, percent):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t, words) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(sets[k]), least, i is not None and i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, words):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(90):
        if rows and rng.random() < 0.65:
            w = (rng.choice(rows)[1] or "a b").split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.choice([3, 30, 120]))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "oNE\n"), (205, "Éa"), (206, "éa"), (207, rows[0][1]), (None, rows[0][1]), (208, "x y " * 20_000), (209, "x\vy\f" * 20_000), (208, "repeated id"), (208, "repeated id")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(table(spark, rows), words=words).collect()), key=str)
    assert got == brute_components(rows, words, 80)


@pytest.mark.parametrize("edits, own_words", [((0, 6), True), ((4, 14), True), ((6, 16), False)])
def test_large_groups_of_near_copies(spark, edits, own_words):
    """Copies above, around and below the threshold, with words of their own or from a common stock."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(400):
        w = list(base)
        for p in rng.sample(range(100), rng.randint(*edits)):
            w[p] = f"e{i}-{p}" if own_words else rng.choice("tuvwxyz")
        rows.append((i, " ".join(w)))
    # two halves that share a passage, and texts that have little besides it
    rows += [(1000 + i, " ".join([*base[:60], *(f"o{i}-{k}" for k in range(rng.randint(5, 50)))])) for i in range(60)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(table(spark, rows), words=2).collect()), key=str)
    want = brute_components(rows, 2, 80)
    assert got == want and len({w[2] for w in want}) > 20


def test_pairs_that_meet_are_few_and_complete(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    texts = []
    for i in range(600):
        w = list(base)
        for p in rng.sample(range(100), rng.randint(5, 9)):
            w[p] = f"e{i}-{p}"
        texts.append(" ".join(w))
    sets = minhash.shingle_sets([t.encode() for t in texts], 2)
    hub = set(sets[0].tolist())
    rows = [(i, 0, len(own), i, [int(x) for x in np.array(sorted(hub ^ set(own.tolist())), np.uint64).view(np.int64)]) for i, own in enumerate(sets) if i]
    met = {(r["u"], r["v"]) for r in minhash.meeting(spark.createDataFrame(rows, "id long, hub long, n long, root long, d array<long>"), 80).collect()}
    linked = set()
    for a, b in combinations(range(1, len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        near_hub = [10 * len(hub & set(sets[x].tolist())) >= 8 * len(hub | set(sets[x].tolist())) for x in (a, b)]
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and not all(near_hub):
            linked.add((b, a))
    assert linked <= met and len(met) < 0.05 * len(sets) ** 2 / 2


def test_hubs_are_central(spark, monkeypatch):
    """A hub at the margin of its group (the least hash of this one) makes 823 pairs of these rows."""
    rng, rows, met, meeting = random.Random(5), [], [], minhash.meeting
    base = [f"b{k}" for k in range(100)]
    for i in range(500):
        w = list(base)
        for p in rng.sample(range(100), rng.randint(0, 30)):
            w[p] = f"e{i}-{p}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "meeting", lambda *a: met.append(meeting(*a)) or met[0])
    monkeypatch.setattr(minhash, "discard", lambda *a: None)
    got = sorted((tuple(r) for r in minhash.near_duplicates(table(spark, rows), words=2).collect()), key=str)
    assert got == brute_components(rows, 2, 80) and met[0].count() < 300


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(table(spark, []), words=2).count() == 0
    docs = table(spark, [(1, "a b c d"), (2, "a b c d"), (2, "q r s t")])
    clashing = docs.select("*", *(docs["key"].alias(c) for c in ("id", "hub", "value", "values", "n", "u", "v", "least", "s0", "body", "own", "kept", "component_id")))
    assert sorted(tuple(r) for r in minhash.near_duplicates(clashing, words=2).collect()) == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 2, True)]


def brute_spans(bodies, length):
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    return [suffix.merged(suffix.ranges(np.array([seen[b[k : k + length]] > 1 for k in range(len(b) - length + 1)], bool), length)) if len(b) >= length else [] for b in bodies]


@pytest.mark.parametrize("length, letters", [(8, "ab"), (20, "ab"), (20, "abcdefgh")])
def test_two_stage_sorting_marks_what_counting_marks(length, letters):
    rng = random.Random(length)
    for _ in range(40):
        texts = set()
        for _ in range(rng.randint(1, 10)):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
            if texts and rng.random() < 0.6:
                o = rng.choice(sorted(texts))
                a = rng.randint(0, len(o))
                t = t[:40] + o[a : a + rng.randint(0, 100)] + t[40:]
            texts.add(t if rng.random() < 0.9 else letters[0] * rng.randint(0, 90))
        parts = [t.encode() for t in sorted(texts) if len(t) >= length]
        if parts:
            counts = np.array([len(p) - length + 1 for p in parts])
            order = suffix.two_stage(parts, counts, length)
            whole = b"".join(parts)
            ends = np.cumsum([len(p) for p in parts])
            keys = [whole[p : min(p + length, ends[np.searchsorted(ends, p, "right")])] for p in order]
            assert keys == sorted(keys) and len(order) == counts.sum()
            got = [suffix.merged(suffix.ranges(h, length)) for h in np.split(suffix.repeated(parts, counts, length), np.cumsum(counts)[:-1])]
            assert got == brute_spans(parts, length)


def test_boilerplate_just_under_the_length_is_no_large_group(spark, monkeypatch):
    """Texts that share all but two bytes of a window: none of it goes, but for the few that share the two bytes as well."""
    rng = random.Random(12)
    shared = "".join(rng.choices("abcdefgh ", k=398))
    rows = [(k, f"{k:05d}" + "".join(rng.choices("xyz", k=20)) + shared + "".join(rng.choices("uvw", k=20)) + f"{k:05d}") for k in range(2000)]
    largest = []
    marked = suffix.marked_parts

    def looked_at(parts, length, bucket_windows):
        each = parts.groupBy("h", "part_id").agg(F.first("n").alias("n"), F.first(F.octet_length("part")).alias("b")).groupBy("h").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("c"))
        largest.append(tuple(each.where("c > 1").agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()))
        return marked(parts, length, bucket_windows)

    monkeypatch.setattr(suffix, "marked_parts", looked_at)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.digest(table(spark, rows), bucket_windows=2000).collect()}
    assert largest[0][0] <= 2000 and largest[0][1] <= 2000 * suffix.WINDOW_BYTES
    counts = Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    want = {}
    for k, t in rows:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                hit[i : i + 400] = True
        want[k] = (int(hit.sum()), int((np.diff(np.r_[0, hit]) == 1).sum()))
    assert got == want and sum(n > 0 for n, _ in want.values()) > 1000


@pytest.mark.parametrize("bucket_windows, stride", [(100_000, 25), (300, 3)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, bucket_windows, stride):
    monkeypatch.setattr(suffix, "STRIDES", (stride, 2, 1))
    rng = random.Random(4)
    texts = []
    for _ in range(50):
        t = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 300)))
        if texts and rng.random() < 0.7:
            o = rng.choice(texts)
            a = rng.randint(0, len(o))
            t = t[:50] + o[a : a + rng.randint(0, 120)] + t[50:]
        texts.append(t)
    rows = [*enumerate(texts + texts[:3] + [None, "", "z" * 30_000]), (None, texts[5]), (7, texts[7])]
    bodies = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), b, spans in zip(rows, bodies, brute_spans(bodies, 20)):
        rest = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(a for a, _ in spans), len(b)]))
        want.append((i, len(b), len(b) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
    got = [tuple(r) for r in suffix.digest(table(spark, rows), length=20, bucket_windows=bucket_windows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_carries_columns_of_any_name(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = text(500)
    rows = [(1, text(400_000)), (2, text(300) + passage), (3, passage + text(300)), (4, None)]
    docs = table(spark, rows).select("*", *(F.lit(c).alias(c) for c in "spans copies passages h s0 part no_text kept_text body r".split()))
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 3, 4)] == [0, 500, 500, 0] and got[2]["kept_text"] == rows[1][1][:300]
    assert got[1]["row"]["spans"] == "spans" and got[4]["row"]["kept_text"] == "kept_text"


def test_suffix_of_an_empty_table(spark):
    assert suffix.digest(table(spark, [])).count() == 0


def test_plan_fills_sequences():
    rng = random.Random(6)
    for _ in range(30):
        cap = rng.choice([8, 50, 2048])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 400)))
        room, seen = Counter(), Counter()
        for length, rank, n, per, first, offset in packing.plan(counts, cap):
            assert rank == seen[length]
            seen[length] += n
            for r in range(n):
                s = first + r // per
                assert room[s] == offset + r % per * length
                room[s] += length
        assert seen == counts and max(room.values()) <= cap
        total = sum(k * n for k, n in counts.items())
        assert len(room) <= 11 / 9 * -(-total // cap) + 1


def test_pieces_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello, World! it's 123 don't", None, "", "Straße ÄÖÜ éèê%%% <|endoftext|>", "日本語 Σίσυφος ΟΔΟΣ", "é İstanbul \x85\xa0x", "a\x1cb !\x1f!", "word another " * 3000, "a " * 2047, "'s't X'LL ''RE"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "id-less")]
    got = sorted((tuple(r) for r in packing.best_fit(table(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert [g[:5] for g in got] == sorted(want, key=str)
    places = sorted((g[5], g[6], g[3]) for g in got)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (s2 == s and o2 == o + n) or (s2 != s and o2 == 0)
    assert packing.best_fit(table(spark, [])).count() == 0


def test_ids_of_any_characters_equal_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder, rng = Tokenizer.from_file(path), packing.Encoder(path, room=500), random.Random(1)
    texts = ["aƁb", "hello <|endoftext|> world", "<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>", "\x00", "a\u2028b", "ﬁﬀ", "ǅ Ⅷ ½²"]
    texts += ["".join(map(chr, range(k, k + 64))) for k in range(0, 0x10000, 64) if not 0xD800 <= k < 0xE000]
    for _ in range(2000):
        top = rng.choice([0x80, 0x250, 0x300, 0x600])
        texts.append("".join(chr(rng.choice([rng.randrange(top), rng.randrange(32, 127), 32])) for _ in range(rng.randint(1, 25))) + rng.choice(["", "", "", "<|endoftext|>"]))
    for k in range(0, len(texts), 300):
        for t, ids in zip(texts[k : k + 300], encoder.encode(texts[k : k + 300])):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_an_encoder_keeps_few_words():
    import public_tokenizers

    encoder, letters, most = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), "abcdefghijklmnop", 0
    text = lambda k: " ".join("".join(c) for c in islice(product(letters, repeat=5), k * 10_000, (k + 1) * 10_000))
    batch = pa.RecordBatch.from_pydict({"text": [text(k) for k in range(30)]})
    for rows in packing.byte_slices([batch], "text", packing.SLICE):
        encoder.encode(rows.column("text").to_pylist())
        most = max(most, len(encoder.index))
    assert 50_000 < most < 110_000


def test_new_words_cost_a_part_of_the_tokenizers_time():
    import time

    import public_tokenizers

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(7)
    encoder, letters, ratios = packing.Encoder(path), "etaoinshrdlucmfwypvbgkjqxz", []
    for _ in range(5):
        text = " ".join("".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(20_000))
        begin = time.process_time()
        want = encoder.whole.encode(text, add_special_tokens=False).ids
        middle = time.process_time()
        words = list(dict.fromkeys(text.split(" ")))
        encoder.forget()
        encoder.learn(words)
        ratios.append((time.process_time() - middle) / (middle - begin))
        assert encoder.encode([text])[0].tolist() == want
    assert min(ratios) < 0.25


def test_ranks_join_what_the_merges_join():
    import json

    import public_tokenizers
    from tokenizers import models

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    with open(path) as f:
        own = json.load(f)["model"]
    vocab, merges = own["vocab"], [tuple(m) for m in own["merges"]]
    assert len({"".join(m) for m in merges}) == len(merges)
    inner, final = models.BPE(vocab, merges), models.BPE(vocab, merges, end_of_word_suffix=packing.END)
    tokens = [w for w in vocab if not w.startswith("<|")]
    for w in tokens:
        model = final if w.endswith(packing.END) else inner
        assert [t.id for t in model.tokenize(w.removesuffix(packing.END))] == [vocab[w]], w
    # words of tokens on end, and words of any length
    encoder = packing.Encoder(path)
    plain = [w.removesuffix(packing.END) for w in tokens if re.fullmatch("[a-z]+", w.removesuffix(packing.END))]
    words = ["".join(rng.choices(plain, k=rng.randint(1, 6))) for _ in range(20_000)] + [c * k for c in "aeoz" for k in (*range(1, 40), 99, 100, 101, 499, 500, 501, 5000)]
    words = list(dict.fromkeys(words))
    for word, ids in zip(words, encoder.encode(words)):
        assert ids.tolist() == [t.id for t in final.tokenize(word)], word
