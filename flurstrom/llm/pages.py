"""Main text of web pages by a recurrent block labeller.

A page is read into leaves: blocks of text with the path of open tags (and their
class, id and role words) above them. A bidirectional LSTM in numpy reads the
sequence of tag-path and hashed-word vectors, so that each block is labelled with
the whole page as context; blocks it accepts are joined. It is trained on pages
drawn from a generator of layouts, in which each block's label is known.

Scripts, styles, templates, comments, fields of forms and the head are no blocks.
All else is read and labelled, hidden and embedded elements too, whose tags and
attributes are in the path. A line break within a block is white space.

Defined cases: null or empty html gives an empty text, as does a page without an
accepted block; broken or cut off markup is read as far as it goes: an unclosed
comment or script takes the rest, an unclosed tag at the end is dropped; repeated
rows give repeated results; an empty table gives no rows; columns besides those
named are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, give_back, spans

EXTRACTED = "page_id long, url string, text string, n_chars long"
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|template|textarea|select)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[a-zA-Z/][^>]*\Z""", re.S | re.I)
#: Any attribute with its whole value, so that names are never found in other names or in values.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?|"[^"]*"|'[^']*'""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var br wbr img svg g text tspan path circle ellipse rect line polyline polygon use desc math mi mn mo mrow msup msub mfrac msqrt mtext semantics".split())
#: An opening tag that ends the open one of the same kind, unless a container stands between.
ENDS_ITSELF = {"p": "p", "li": "li", "td": "td th", "th": "td th", "tr": "tr td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}
CONTAINERS = frozenset("html body div section article main aside header footer nav table ul ol dl form blockquote fieldset".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PATH, WORDS, NUMBERS = 96, 32, 8
WIDTH = PATH + WORDS + NUMBERS
HIDDEN = 24
#: Leaves that are read at once, and bytes of html.
GROUP, PORTION = 8192, 4 << 20


@dataclass
class Leaf:
    text: str
    path: int  #: the buckets of the words of the open tags, as bits
    linked: int  #: characters that stand in links


def names(tag: str, attributes: str) -> list[str]:
    """The words that stand for an open tag in the path: its name, its class, id and role words, and whether it is hidden."""
    out = [tag]
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            out += ["." + w for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if len(w) > 1]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            out.append(".hidden")
    return out


@functools.lru_cache(100_000)
def bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % n


def bits(words: list[str]) -> int:
    out = 0
    for w in words:
        out |= 1 << bucket(w, PATH)
    return out


def leaves(page: str) -> list[Leaf]:
    out: list[Leaf] = []
    #: Of each open tag its name, the bits of the path down to it, the last three words of the path, and whether it is quiet.
    stack: list[tuple[str, int, tuple[str, ...], bool]] = []
    open_ = Counter()
    parts: list[str] = []
    linked = 0
    quiet = 0  # open elements that are no part of the page as read

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            path = stack[-1][1] | bits([f"near {w}" for w in stack[-1][2]]) if stack else 0
            out.append(Leaf(text, path, min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal quiet
        while len(stack) > to:
            tag, _, _, was = stack.pop()
            open_[tag] -= 1
            quiet -= was

    def say(text: str) -> None:
        nonlocal linked
        if text and not quiet:
            parts.append(text)
            if open_["a"]:
                linked += len(text.strip())

    at = 0
    for m in TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "title" and open_["svg"]:  # a word for a picture within a line
            continue
        if tag in ("br", "wbr", "img"):
            parts.append(" " if tag != "wbr" else "")
            continue
        if m[2]:
            if tag not in INLINE:
                end()
            if open_[tag]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag not in INLINE:
            end()
            closes = ENDS_ITSELF.get(tag, "").split() + (["p"] if tag in ENDS_P else [])
            if any(open_[t] for t in closes):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        pop(k)
                        break
                    if stack[k][0] in CONTAINERS:
                        break
        if tag in VOID or m[4].endswith("/") and tag in INLINE:
            continue
        quiet_now = tag in ("head", "title")
        if tag == "body":
            pop(0)
        own = names(tag, m[4])
        above, last = (stack[-1][1], stack[-1][2]) if stack else (0, ())
        stack.append((tag, above | bits(own), (*last, *own)[-3:], quiet_now))
        open_[tag] += 1
        quiet += quiet_now
    say(page[at:])
    end()
    return out


def features(page: list[Leaf]) -> np.ndarray:
    """A row for each leaf: hashed tag path, hashed words, and numbers such as its length and place."""
    x = np.zeros((len(page), WIDTH), np.float32)
    paths: dict[int, np.ndarray] = {}
    for k, leaf in enumerate(page):
        if leaf.path not in paths:
            paths[leaf.path] = np.unpackbits(np.frombuffer(leaf.path.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        x[k, :PATH] = paths[leaf.path]
        words = leaf.text.lower().split()
        own = np.bincount([bucket(w.strip(".,;:!?()\"'"), WORDS) for w in words], minlength=WORDS)
        x[k, PATH : PATH + WORDS] = own / max(1, len(words)) ** 0.5
        n = len(leaf.text)
        x[k, PATH + WORDS :] = (np.log1p(n) / 5, np.log1p(len(words)) / 3, leaf.linked / n, leaf.text[-1] in ".!?…»”\"", sum(map(leaf.text.count, ".,;")) / max(1, len(words)), k / len(page), 1 / (1 + k), 1)
    return x


@dataclass
class Model:
    """Weights of both directions (input, recurrent, bias) and of the output."""

    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Model:
        rng = np.random.default_rng(seed)
        own = {}
        for d in "fb":
            own[f"w{d}"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN)).astype(np.float32)
            own[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            own[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        own["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        own["s"] = rng.normal(0, 0.05, WIDTH).astype(np.float32)
        own["bias"] = np.zeros(1, np.float32)
        return Model(own)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def read_one_way(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, keep: bool):
    """States of an LSTM over x (pages, leaves, width); where mask is 0 the state stays."""
    n, steps, _ = x.shape
    pre = x @ w + c
    h = np.zeros((n, HIDDEN), np.float32)
    s = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((n, steps, HIDDEN), np.float32)
    tape = []
    for t in range(steps):
        z = pre[:, t] + h @ u
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        s_new = m * (f * s + i * g) + (1 - m) * s
        th = np.tanh(s_new)
        h_new = m * (o * th) + (1 - m) * h
        if keep:
            tape.append((i, f, o, g, s, th, h, m))
        h, s = h_new, s_new
        out[:, t] = h
    return out, tape


def read_back_one_way(grad: np.ndarray, x: np.ndarray, tape: list, u: np.ndarray):
    n, steps, _ = grad.shape
    dz_all = np.zeros((n, steps, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh = np.zeros((n, HIDDEN), np.float32)
    ds = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, s, th, h, m = tape[t]
        total = dh + grad[:, t]
        dho = total * m
        ds_new = ds * m + dho * o * (1 - th * th)
        dz = np.concatenate([ds_new * g * i * (1 - i), ds_new * s * f * (1 - f), dho * th * o * (1 - o), ds_new * i * (1 - g * g)], 1)
        dz_all[:, t] = dz
        du += h.T @ dz
        dh = dz @ u.T + total * (1 - m)
        ds = ds_new * f + ds * (1 - m)
    return np.einsum("ntw,ntz->wz", x, dz_all), du, dz_all.sum((0, 1))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, WIDTH), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


def label(model: Model, pages: list[np.ndarray]) -> list[np.ndarray]:
    """The chance of each leaf to be main text; pages of like length are read together, GROUP leaves with their padding at most (or one page)."""
    p = model.parts
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    groups: list[list[int]] = []
    for k in order:  # ascending, so the last page of a group is its longest
        if not groups or (len(groups[-1]) + 1) * len(pages[k]) > GROUP:
            groups.append([])
        groups[-1].append(k)
    for some in groups:
        x, mask = padded([pages[k] for k in some])
        a, _ = read_one_way(x, mask, p["wf"], p["uf"], p["cf"], False)
        b, _ = read_one_way(x[:, ::-1], mask[:, ::-1], p["wb"], p["ub"], p["cb"], False)
        z = np.concatenate([a, b[:, ::-1]], 2) @ p["o"] + x @ p["s"] + p["bias"]
        for k, row in zip(some, sigmoid(z)):
            out[k] = row[: len(pages[k])]
    return out


def train(pages: list[np.ndarray], marks: list[np.ndarray], epochs: int = 8, seed: int = 5) -> Model:
    """Adam on the cross entropy of all leaves."""
    model = Model.fresh(seed)
    p = model.parts
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    rng = np.random.default_rng(seed)
    step = 0
    by_length = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    groups = [by_length[k : k + 32] for k in range(0, len(by_length), 32)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            some = groups[g]
            x, mask = padded([pages[k] for k in some])
            y = np.zeros(mask.shape, np.float32)
            for r, k in enumerate(some):
                y[r, : len(marks[k])] = marks[k]
            back_x, back_mask = x[:, ::-1], mask[:, ::-1]
            a, tape_a = read_one_way(x, mask, p["wf"], p["uf"], p["cf"], True)
            b, tape_b = read_one_way(back_x, back_mask, p["wb"], p["ub"], p["cb"], True)
            both = np.concatenate([a, b[:, ::-1]], 2)
            dz = (sigmoid(both @ p["o"] + x @ p["s"] + p["bias"]) - y) * mask / mask.sum()
            down = dz[..., None] * p["o"]
            grads = {"o": np.einsum("nt,nth->h", dz, both), "s": np.einsum("nt,ntw->w", dz, x), "bias": dz.sum(keepdims=True).reshape(1)}
            grads["wf"], grads["uf"], grads["cf"] = read_back_one_way(down[..., :HIDDEN], x, tape_a, p["uf"])
            grads["wb"], grads["ub"], grads["cb"] = read_back_one_way(down[:, ::-1, HIDDEN:], back_x, tape_b, p["ub"])
            step += 1
            rate = 0.02 * (1 - 0.9 * epoch / epochs)
            for k, d in grads.items():
                d = np.clip(d, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


#: Layouts of the generator: container tags with class words, by what they hold.
MAIN = "article|article.post|main|div.content|div#content|div.entry-content|div.article-body|section.post-content|div.main-content|div.story|div.text|main.page"
#: Containers that say nothing: bare ones, and ones with class words of any kind.
BARE = "div|div|section|div.inner|div.wrapper|div.container|div.row|div.col|div.box|div.block|div.page|div#root|div#wrap|div.body|div.area|div.view|center"
NOT_MAIN = {
    "menu": "nav|div.menu|ul.nav|div#navigation|div.navbar|header|div.breadcrumbs|div.toolbar|nav.breadcrumb",
    "top": "header|div.header|div#header|div.masthead|div.topbar|div.site-title",
    "bottom": "footer|div.footer|div#footer|div.copyright|div.bottom|div.colophon",
    "side": "aside|div.sidebar|div#sidebar|div.widget|aside.related|div.related|div.recommended|div.trending|div.popular",
    "advert": "div.ad|div.ads|div.advert|div.sponsored|div.promo|aside.ad|div.banner",
    "notice": "noscript|div.hidden|div.cookie-notice|div.cookie-banner|div.notice|div.alert|div.consent|div.newsletter|div.subscribe|div.popup|div.modal",
    "form": "form|form.search|form.login|div.form|form.comment-form|div.search|form.newsletter",
    "comments": "div.comments|section.comments|div#comments|ol.comment-list|div.comment|section.discussion|div.replies|div.disqus",
    "share": "div.share|div.social|ul.share|div.meta|div.tags|div.pagination|p.byline|div.byline",
    "author": "div.author-bio|div.author|aside.author|div.bio|section.author-box|div.about-author|div.vcard",
    "script": "noscript|noscript|noscript|div.noscript|object|iframe",
}
SAYS = {
    "menu": "home about contact news blog shop products login register search help menu start kontakt accueil inicio",
    "top": "home welcome site logo menu search login",
    "bottom": "© copyright 2023 2024 all rights reserved privacy policy terms imprint impressum contact",
    "side": "related read more popular latest trending you may like archive categories",
    "advert": "ad sponsored buy now offer sale discount free shipping advertisement deal",
    "notice": "cookies we use this site accept agree subscribe newsletter sign up updates",
    "form": "name email submit search password send message your required",
    "comments": "reply says comment posted ago like great thanks agree i think",
    "share": "share tweet facebook tags author posted by on previous next page",
    "author": "about the author written by is a writer reporter editor contributor follow posts",
    "script": "please enable javascript to view this page your browser does not support",
}
PIECES = "an en er ti re on st th in ha le ou que ión os as ra do ung ich sch ver ein de la es ment eau ä é ñ ö ß ly nd".split()


def drawn_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of a random layout, and for each of its blocks whether it is main text."""
    marks: list[bool] = []

    def word() -> str:
        return "".join(rng.choices(PIECES, k=rng.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        n = rng.randint(low, high)
        ws = [word() + ("," if rng.random() < 0.06 else "." if rng.random() < 0.08 else "") for _ in range(n)]
        junk = rng.choice(["", "", "", "&amp;&amp;", "%%%"])
        return (" ".join(w + junk for w in ws)).capitalize() + rng.choice([".", ".", ".", "!", ""])

    def box(spec: str, inner: str) -> str:
        tag, _, cls = spec.replace("#", ".#").partition(".")
        at = f' id="{cls[1:]}"' if cls.startswith("#") else f' class="{cls}{rng.choice(["", " box", " wide", ""])}"' if cls else ""
        return f"<{tag}{at}>{inner}</{tag}>"

    def bare() -> str:
        """A container that says nothing of what it holds."""
        made = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 7)))
        return rng.choice([rng.choice(BARE.split("|")), rng.choice(BARE.split("|")), f"div.{made}", f"div.{made}-{rng.randint(1, 99)} {made}", f"section#{made}"])

    def wrapped(inner: str, most: int) -> str:
        for _ in range(rng.randint(0, most)):
            inner = box(bare(), inner)
        return inner

    def block(main: bool, text: str, tag: str) -> str:
        marks.append(main)
        return f"<{tag}>{text}</{tag}>" if tag else text

    def said(kind: str) -> str:
        own = rng.choices(SAYS[kind].split(), k=rng.randint(1, 4))
        return " ".join(own) if rng.random() < 0.5 else prose(1, 14)

    def other(kind: str) -> str:
        spec = rng.choice(NOT_MAIN[kind].split("|"))
        if kind in ("menu", "bottom", "share") and rng.random() < 0.2:  # told by what it holds alone
            spec = bare()
            links = [block(False, f'<a href="/{k}">{rng.choice(SAYS[kind].split())}</a>', rng.choice(["", "p", "div"])) for k in range(rng.randint(3, 8))]
            return box(spec, "".join(f"<div>{x}</div>" if x.startswith("<a") else x for x in links))
        if kind in ("author", "script"):
            texts = [" ".join(rng.choices(SAYS[kind].split(), k=rng.randint(3, 14))) if rng.random() < 0.6 else prose(4, 30) for _ in range(rng.randint(1, 2))]
            return box(spec, "".join(block(False, t, "p") for t in texts) if len(texts) > 1 else block(False, texts[0], rng.choice(["", "p", "div"])))
        if kind in ("menu", "share") or rng.random() < 0.3:
            body = "<ul>" + "".join("<li>" + block(False, f'<a href="/{k}">{said(kind) if rng.random() < 0.4 else word()}</a>', "") + "</li>" for k in range(rng.randint(2, 8))) + "</ul>"
        elif kind == "comments":
            body = "".join(block(False, prose(1, 40), rng.choice(["p", "div", "li"])) for _ in range(rng.randint(1, 6)))
        elif kind in ("form", "side", "notice") and rng.random() < 0.6:
            body = "".join(block(False, said(kind), rng.choice(["p", "label", "h3", "div", "button"]) if kind != "form" else rng.choice(["p", "div", "h3", "button"])).replace("<label>", "<p>").replace("</label>", "</p>") for _ in range(rng.randint(1, 4)))
        else:
            text = said(kind) if rng.random() < 0.5 else prose(2, 16)
            body = block(False, text, rng.choice(["", "p", "span"]))
        return box(spec, body)

    def inside() -> str:
        out = []
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            if r < 0.66:
                out.append(block(True, prose(1, rng.choice([4, 30, 120, 120, 400])), "p"))
            elif r < 0.74:
                out.append(block(True, prose(1, 8).rstrip("."), rng.choice(["h2", "h3"])))
            elif r < 0.80:
                out.append("<ul>" + "".join(block(True, prose(1, 12), "li") for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.84:
                out.append(block(True, prose(3, 30), rng.choice(["blockquote", "pre", "div", "figcaption"])))
            elif r < 0.88:
                out.append("<table><tr>" + "".join(block(True, prose(1, 3), "td") for _ in range(rng.randint(2, 4))) + "</tr></table>")
            elif r < 0.95:
                out.append("<p><b>" + block(True, prose(2, 12), "") + "<br>")
            else:
                out.append(other(rng.choice(["advert", "share", "notice", "side", "author", "script"])))
        if rng.random() < 0.1:
            out.append(other("author"))
        return "".join(out)

    def title() -> str:
        return block(True, prose(1, 14).rstrip("."), "h1")

    before = [other(k) for k in rng.sample(["menu", "top", "advert", "notice", "side", "form"], rng.randint(0, 4))]
    marks_before = marks[:]
    head = title() if rng.random() < 0.85 else ""
    if rng.random() < 0.06:
        middle = ""
    else:
        r = rng.random()
        spec = rng.choice(MAIN.split("|")) if r < 0.6 else bare() if r < 0.92 else ""
        middle = wrapped(head + inside(), 2 if r >= 0.6 or rng.random() < 0.3 else 0)
        middle = wrapped(box(spec, middle) if spec else middle, 2 if rng.random() < 0.3 else 0)
        head = ""
    if head:
        marks.pop()
        head = ""
    marks_middle = marks[len(marks_before) :]
    after = [other(k) for k in rng.sample(["comments", "side", "share", "advert", "notice", "form"], rng.randint(0, 3))] + ([other("bottom")] if rng.random() < 0.8 else [])
    if middle and rng.random() < 0.2:  # nothing but the article
        first, n = len(marks_before), len(marks_middle)
        before, after, marks[:] = [], [], marks[first : first + n]
    r = rng.random()
    if r < 0.08:  # a table that lays the page out
        body = "<table><tr>" + "".join(f"<td>{x}</td>" for x in (*before, middle, *after)) + "</tr></table>"
    elif r < 0.3:
        body = wrapped("".join(before) + middle + "".join(after), 2)
    else:
        body = "".join(before) + middle + "".join(after)
    page = "<html><head><title>" + prose(2, 8) + "</title></head><body>" + body
    return page + rng.choice(["</body></html>", ""]), marks


def learnt(pages: int = 2000, epochs: int = 9, seed: int = 5) -> Model:
    """A model trained on so many drawn pages."""
    rng = random.Random(seed)
    x, y = [], []
    while len(x) < pages:
        page, marks = drawn_page(rng)
        own = leaves(page)
        if own and len(own) == len(marks):
            x.append(features(own))
            y.append(np.array(marks, np.float32))
    return train(x, y, epochs, seed)


def main_text(model: Model, pages: list[str]) -> list[str]:
    read = [leaves(p) for p in pages]
    chance = label(model, [features(r) for r in read])
    return ["\n".join(b.text for b, c in zip(r, own) if c >= 0.5) for r, own in zip(read, chance)]


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model.parts)  # some 20,000 numbers, whatever the input

    def of(batches):
        own = Model(shared.value)
        for batch in batches:
            for part in spans([len(h) if h else 0 for h in batch["html"]], PORTION, rows=256):
                rows = batch.iloc[part]
                texts = main_text(own, [h or "" for h in rows["html"]])
                yield pd.DataFrame({"page_id": rows["page_id"].astype("Int64"), "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]})
        give_back()

    return bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(of, EXTRACTED)
