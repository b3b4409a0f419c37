"""Language identification, toxicity, page text: held-out accuracy and defined cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from flurstrom.llm import language, pages, toxicity

SYLLABLES = {"en": "the and ing th er on tion of", "de": "sch ung der die ein keit ö ß", "fr": "eau ou ai le é è eux que", "es": "ción os as el ñ do í ra"}


def prose(lang, rng, n=80):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def test_language_by_family_then_pairs(spark):
    rng = random.Random(2)
    rows = [(k, prose(v, rng), v, v) for k, v in enumerate(list(SYLLABLES) * 40)]
    rows += [(1000, None, None, "en"), (1001, "123 !?", "de", "en"), (1002, "", None, None), (1003, prose("fr", rng, 40_000), None, None), (None, prose("de", rng), "de", "de"), (1004, prose("es", rng), None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = toxicity.held(2, 4)
    model = language.fit(docs, held)
    got = {r["doc_id"]: r for r in language.predict(docs, model, held).collect()}
    assert len(got) == len(rows)
    right = [got[i]["lang_pred"] == v for i, _, v, _ in rows[:160] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(160))
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "fr", "es"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["lang_pred"] == "de"
    nothing = language.fit(docs.limit(0), held)
    assert {r["lang_pred"] for r in language.predict(docs, nothing, held).collect()} == {"und"}
    assert language.predict(docs.limit(0), model, held).count() == 0


def test_related_languages_of_one_family():
    model = language.train(["ab ab ab", "cd cd cd"] * 3, ["en", "de"] * 3)
    assert model.pairs == [("de", "en")] and [f for f, _ in model.families] == ["germanic"]
    assert language.decide(model, language.margins(model, ["ab ab"], language.lower_letters())[0])[0] == "en"


def test_toxicity_shares_subwords_with_misspellings(spark):
    rng = random.Random(3)
    bad = ["blockhead", "scoundrel", "dimwit"]
    rows, labels = [], []
    for k in range(400):
        words = [prose("en", rng, 1) for _ in range(40)]
        toxic = k % 2
        if toxic:
            for p in rng.sample(range(40), 4):
                words[p] = rng.choice(bad)
        rows.append((k, " ".join(words), 0.1))
        labels.append((k, toxic))
    odd = [(900, None, 0.0), (901, "", 0.0), (902, " ".join(["blockheads", "dimwitt"] * 3), 0.0), (903, "the and " * 50_000, 0.0), (None, "scoundrel scoundrel", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    held = toxicity.held(0, 5)
    model = toxicity.fit(docs, marks, held)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, held).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got.values())
    right = [got[k]["predicted"] == t for k, t in labels if got[k]["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert got[902]["predicted"] == 1 and got[None]["predicted"] == 1 and got[903]["predicted"] == 0
    assert got[900]["score"] == got[901]["score"]
    none = toxicity.fit(docs, marks.limit(0), held)
    assert {r["predicted"] for r in toxicity.score(docs, none, held).collect()} == {0}
    assert toxicity.score(docs.limit(0), model, held).count() == 0
    same = docs.where("doc_id = 7").withColumn("s", toxicity.score_of(F.col("text"), model, spark)).collect()[0]["s"]
    assert abs(same - got[7]["score"]) < 1e-9


def test_a_sampled_id_that_repeats_is_learnt_from_once(spark, monkeypatch):
    rows = [(k, "good words here" if k % 2 else "bad words there") for k in range(40)]
    docs = spark.createDataFrame(rows + [(1, f"good again {n}") for n in range(3000)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)] * 3, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: toxicity.Model(np.full(1, len(texts), np.float32), float(sum(map(len, texts)))))
    whole = toxicity.fit(docs, marks, F.lit(False))
    assert whole.weight.tolist() == [40.0]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100)
    some = toxicity.fit(docs, marks, F.lit(False))
    assert 10 <= some.weight[0] <= 14 and some.bias <= 200


def test_pages_of_unseen_layouts(spark):
    model = pages.learnt()
    rng = random.Random(77)
    wrong = total = 0
    for _ in range(80):
        page, marks = pages.drawn_page(rng)
        own = pages.leaves(page)
        assert len(own) == len(marks)
        if own:
            chance = pages.label(model, [pages.features(own)])[0] >= 0.5
            wrong += int((chance != np.array(marks)).sum())
            total += len(marks)
    assert wrong / total < 0.03
    html = (
        '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News</a></li></ul></nav>'
        '<!-- x --><div class="ad">Buy now.</div><article><h1>The &amp; title</h1><p><b>Bold start of it.<br><p>First  paragraph\n with &lt;tags&gt; &#233; in it.</p><p>Second one is here, too.</p></article>'
        '<section class="comments"><p>I agree with all of this, thanks.</p></section><footer>&copy; all rights reserved</footer></body></html>'
    )
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<!-- open"), (5, "u", "<p"), (None, "u", html), (1, "u", html)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(table, model).collect()]
    want = "The & title\nBold start of it.\nFirst paragraph with <tags> é in it.\nSecond one is here, too."
    assert sorted(got, key=str) == sorted([(1, want, len(want)), (1, want, len(want)), (None, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0), (5, "", 0)], key=str)
    assert pages.extract(table.limit(0), model).count() == 0


def test_all_elements_are_read_and_hidden_is_a_whole_attribute_name():
    seen = lambda tag: [b.text for b in pages.leaves(f"<{tag}>some text</{tag.split()[0]}>")]
    plain = ('a href="/hidden-gems"', "a href=/hidden", 'article title="the hidden valley"', "article title='a hidden b'", 'div data-hidden="false"', "div data-x = hidden", 'div data-style="display:none"', 'div title="style=display:none"', 'div aria-hidden="false"', "div x-hidden", 'p title="a > hidden"')
    hidden = ("div hidden", "div HIDDEN=''", 'div class="a" hidden="until-found"', "div id=x hidden", 'div title="x"hidden', 'div aria-hidden = "true"', "div ARIA-HIDDEN=TRUE", 'div style="color:red; display: none"', 'div data-hidden="1" hidden', "div class=a/ hidden")
    for tags, marked in ((plain, False), (hidden, True)):
        for tag in tags:
            name, _, attributes = tag.partition(" ")
            assert seen(tag) == ["some text"] and (".hidden" in pages.names(name, " " + attributes)) == marked, tag
    assert all(seen(t) == ["some text"] for t in ("noscript", "object", "iframe", "canvas", "svg", "math"))
    assert all(seen(t) == [] for t in ("script", "style", "template", "textarea", "select"))
    assert pages.names("div", 'data-id="wrong" title="class=bad" class="mainText" id=top') == ["div", ".main", ".text", ".top"]


def test_long_and_deep_pages_are_read_whole():
    deep = pages.leaves("<div class=x>a" * 20_000)
    assert len(deep) == 20_000 and deep[-1].path == deep[9].path
    long = pages.leaves("<article><p>one word</p>" + "<p>" + "more words, " * 50_000 + "</p></article>" * 2)
    assert [len(b.text) for b in long] == [8, 599_999]
    x = pages.features(long)
    assert abs(x[1, pages.PATH : pages.PATH + pages.WORDS].sum() - 100_000**0.5) < 0.1


def test_labels_equal_a_plain_lstm():
    """Each page alone, step by step and gate by gate."""
    rng = random.Random(4)
    model = pages.learnt(pages=40, epochs=1)
    p = model.parts
    read = [pages.features(pages.leaves(pages.drawn_page(rng)[0])) for _ in range(30)] + [np.zeros((0, pages.WIDTH), np.float32)]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(x, d):
        h, s, out = np.zeros(pages.HIDDEN), np.zeros(pages.HIDDEN), []
        for row in x:
            z = row.astype(float) @ p[f"w{d}"] + p[f"c{d}"] + h @ p[f"u{d}"]
            i, f, o, g = z.reshape(4, -1)
            s = sig(f) * s + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(s)
            out.append(h)
        return np.array(out)

    for x, got in zip(read, pages.label(model, read)):
        if len(x):
            both = np.concatenate([states(x, "f"), states(x[::-1], "b")[::-1]], 1)
            assert np.allclose(got, sig(both @ p["o"] + x @ p["s"] + p["bias"]), atol=1e-4)
        else:
            assert len(got) == 0


def test_margins_equal_a_plain_sum_over_grams():
    rng = random.Random(6)
    texts = [prose(v, rng, 60) for v in SYLLABLES for _ in range(6)]
    model = language.train(texts, [v for v in SYLLABLES for _ in range(6)])
    odd = ["", "a", "Ab  ½ 9", "x" * 500, "日本 語", "é-ü,,ß"] + texts[:4]
    m32 = lambda v: v & 0xFFFFFFFF

    def grams(text):
        letters = [ord(c.lower()[0]) if ord(c) >= language.TABLE or c.isalpha() else 32 for c in f" {text}  "]
        c = [x for k, x in enumerate(letters) if k == 0 or x != 32 or letters[k - 1] != 32]
        for k in range(len(c)):
            a, b, d = (*c[k:], 32, 32)[:3]
            yield 0, m32(a * 0x9E3779B1)
            yield 1, m32((m32(a * 0x85EBCA6B) ^ m32(b * 0xC2B2AE35 + 0x27D4EB2F)) * 0x9E3779B1)
            yield 2, m32((m32(a * 0x165667B1) ^ m32(b * 0x27D4EB2D) ^ m32(d * 0x9E3779B1 + 0x51ED270B)) * 0x85EBCA6B)

    for text in odd:
        rows = [g * language.BUCKETS + (h >> 20) for g, h in grams(text)]
        plain = model.weights[rows].sum(0) / (len(rows) / 3) + model.bias
        assert np.allclose(language.margins(model, [text], language.lower_letters())[0], plain, atol=1e-4), text
    together = language.margins(model, odd, language.lower_letters())
    assert np.allclose(together[3], language.margins(model, odd[3:4], language.lower_letters())[0], atol=1e-6)


def test_numerals_are_no_letters(spark):
    model = language.train(["ab ab ab", "cd cd cd"] * 3, ["en", "de"] * 3)
    docs = spark.createDataFrame([(1, "½ ² ³ Ⅷ"), (2, "½ a"), (3, "١٢٣ _")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model, toxicity.held(2, 4)).collect()}
    assert got[1] == got[3] == "und" and got[2] != "und"


def test_scores_equal_a_plain_mean_over_subwords():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.3)
    mix, full = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def buckets(word):
        w = f"<{word}>"
        for n in toxicity.GRAMS:
            for k in range(len(w) - n + 1):
                h = 0
                for c in w[k : k + n]:
                    h = (h ^ ord(c)) * mix & full
                    h ^= h >> 29
                if n < len(w):
                    yield (h >> 20) % toxicity.BUCKETS
        whole = sum(ord(c) * pow(mix, k, 1 << 64) for k, c in enumerate(w)) & full
        yield (((whole ^ whole >> 31) * mix & full) >> 20) % toxicity.BUCKETS

    texts = ["", "a", "Don't do it", "x1y_z", "ungefährlich É", "the the the cat", "12 ..."]
    scorer = toxicity.Scorer(model)
    for text, got in zip(texts, scorer(texts)):
        words = toxicity.words_of(text)
        logits = [np.mean([model.weight[b] for b in buckets(w)]) for w in words]
        assert abs(got - 1 / (1 + np.exp(-((np.mean(logits) if words else 0) + model.bias)))) < 1e-5, text


def test_pages_written_by_hand():
    """Pages that the generator can't draw: containers without a telling name, notices and author boxes inside articles."""
    said = (
        "The county council has voted to keep the old bridge open for another year. Engineers will inspect it in spring, and residents can attend a public meeting.",
        "Dr. Lane said the study, which followed 1,200 people, showed no rise in risk. Others were less sure; a second trial is planned for autumn.",
        "Prices fell again on Monday. Traders blamed weak demand from abroad, while officials pointed to a late harvest and full warehouses.",
        "It was the third such decision this month, and it will not be the last, as the mayor told reporters on the steps of the town hall.",
    )
    ps, text = "".join(f"<p>{t}</p>" for t in said), "\n".join(said)
    titled = "Bridge stays open\n" + text
    cases = [
        (f'<div class="inner">{ps}</div>', text),
        (f"<div><div>{ps}</div></div>", text),
        (f'<div><div class="css-1x2"><div>{ps}</div></div></div>', text),
        (ps, text),
        (f"<article><h1>Bridge stays open</h1><noscript>Please enable JavaScript to view this page.</noscript>{ps}</article>", titled),
        (f'<nav><a href="/">Home</a></nav><article><h1>Bridge stays open</h1>{ps}<div class="author-bio"><p>Jane Roe is a reporter who covers local politics.</p></div></article><footer>Copyright 2024</footer>', titled),
        (f'<table><tr><td><a href="/">Home</a></td><td><a href="/n">News</a></td></tr><tr><td>{ps}</td></tr></table>', text),
        (f'<table><tr><td class="menu"><a href="/">Home</a><br><a href="/n">News</a></td><td>{ps}</td></tr></table>', text),
        (f'<div id="root"><div class="x9"><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul></div><div class="k3 z"><h1>Bridge stays open</h1>{ps}</div><div class="q1"><a href="/p">Privacy</a> <a href="/t">Terms</a></div></div>', titled),
        (f'<article>{ps}<p>Look <svg><title>an arrow</title><path d="M0 0"/></svg> here for more of it, and then go on.</p></article>', text + "\nLook an arrow here for more of it, and then go on."),
    ]
    got = pages.main_text(pages.learnt(), [f"<html><head><title>t</title></head><body>{body}</body></html>" for body, _ in cases])
    for (body, want), text in zip(cases, got):
        assert text == want, body[:80]
