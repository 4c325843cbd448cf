"""HTML extraction: a bidirectional LSTM labels every leaf block of a page from tag paths and words, in context."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hushtable.llm.common import over_texts, portion, slices

#: Fixed values of HTML: elements that begin a new block, that have no content, and whose content is not text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style iframe noembed noframes".split())
#: Lists that end the reach of an item left open.
HOLDERS = ("ul", "ol", "dl", "table", "select", "menu")
ITEMS = frozenset("li dt dd tr td th option".split())
#: So many open elements, the innermost ones, are a block's path.
DEEP = 32
#: Words in a tag, class, id or role that tell what an element holds, for the labels that the model learns from.
MAIN = frozenset("article main content post entry story articlebody".split())
REST = frozenset(
    "nav navbar menu header footer aside sidebar ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal "
    "form newsletter subscribe signup login search comment comments reply replies disqus share social related recommended breadcrumb breadcrumbs tags toc "
    "pagination widget copyright legal button select option label dialog masthead".split()
)

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
PATH_SLOTS, WORD_SLOTS, WIDTH, HIDDEN = 1024, 2048, 16, 16


def marks_of(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes:
        return (tag,)
    return (tag, *(w for _, a, b, c in ATTRIBUTE.findall(attributes) for w in NAME.findall((a or b or c).lower())))


def judged(verdict: int, marks: tuple, depth: int) -> int:
    """What an element inside one judged `verdict` holds, by its marks: 1 main text, -1 something else of the page, 0 unknown."""
    for mark in marks:
        if verdict < 0 or mark in REST and mark not in MAIN or mark == "title" and depth < 4:
            return -1
        if mark in MAIN:
            verdict = 1
    return verdict


class Open:
    """The elements open at a place of a page, with their numbers by tag, so that none is looked for."""

    def __init__(self):
        self.stack: list[tuple[str, tuple, int]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, tag: str, marks: tuple) -> None:
        verdict = judged(self.stack[-1][2] if self.stack else 0, marks, len(self.stack))
        self.at[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, marks, verdict))

    def cut(self, to: int) -> None:
        """Close the innermost elements down to number `to`."""
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at[tag] else -1

    def path(self) -> tuple:
        return tuple(m for _, marks, _ in self.stack[-DEEP:] for m in marks)


def leaves(page: str) -> list[tuple[tuple, str, int, int]]:
    """Blocks of text in page order: (marks on the path, text, characters inside links, 1 if marks say it is main text).

    Comments, doctypes and raw text that is no text (scripts, styles, frames) are left out; an element left open ends with
    its parent, a paragraph also where the next block begins. White space, <br> included, becomes one space. Takes time
    in proportion to the page, however deep it is nested.
    """
    out: list = []
    opened = Open()
    held: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        if text:
            out.append((opened.path(), text, linked, int(bool(opened.stack) and opened.stack[-1][2] > 0)))
        held.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        found = MARKUP.search(page, at)
        upto = found.start() if found else n
        if upto > at:
            held.append(page[at:upto])
            if opened.last("a") >= len(opened.stack) - 3 and opened.at["a"]:
                linked += upto - at
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            own = opened.last(tag)
            if tag in BLOCKS or own >= 0 and opened.blocks and opened.blocks[-1] >= own:
                close()
            if own >= 0:
                opened.cut(own)
            continue
        if tag in SILENT:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not found[3].rstrip().endswith("/"):
                at = end.end() if end else n
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCKS:
            close()
            if opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
                opened.cut(opened.blocks[-1])
            if tag in ITEMS and opened.last(tag) > max(map(opened.last, HOLDERS)):
                opened.cut(opened.last(tag))
        if tag not in VOID:
            opened.push(tag, marks_of(tag, found[3]))
    close()
    return out


def slots_of(path: tuple, text: str) -> tuple[list[int], list[int]]:
    """Hashed slots of a block's path marks, the inner three once more by depth, and of its words."""
    own = [crc32(m.encode()) % PATH_SLOTS for m in path]
    own += [crc32(f"{k}{m}".encode()) % PATH_SLOTS for k, m in enumerate(path[:-4:-1])]
    return own or [0], [crc32(w.encode()) % WORD_SLOTS for w in set(text.lower().split())] or [0]


class Slots:
    """Slots of paths and of words, remembered up to a bound, since pages repeat both."""

    def __init__(self):
        self.paths: dict = {}
        self.words: dict = {}

    def __call__(self, path, text):
        if len(self.paths) > 50_000:
            self.paths.clear()
        if len(self.words) > 300_000:
            self.words.clear()
        own = self.paths.get(path)
        if own is None:
            own = self.paths[path] = slots_of(path, "")[0]
        words = self.words
        out = []
        for w in set(text.lower().split()):
            k = words.get(w)
            if k is None:
                k = words[w] = crc32(w.encode()) % WORD_SLOTS
            out.append(k)
        return own, out or [0]


def inputs(page: list, model: dict, slots) -> tuple[np.ndarray, list]:
    """Vectors of a page's blocks: mean path vector, mean word vector, and four measures of length and links."""
    found = [slots(path, text) for path, text, *_ in page]
    paths = np.stack([model["path"][own].mean(0) for own, _ in found])
    flat = np.concatenate([w for _, w in found])
    lengths = np.array([len(w) for _, w in found])
    words = np.add.reduceat(model["word"][flat], np.append(0, np.cumsum(lengths)[:-1]), axis=0) / lengths[:, None]
    measures = np.array([(np.log1p(len(t)) / 8, min(1.0, a / max(len(t), 1)), t[-1:] in ".!?", len(t) > 80) for _, t, a, _ in page], float)
    return np.concatenate([paths, words, measures], 1), found


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray):
    """Hidden states (steps, pages, hidden) of one direction, and what going back needs."""
    steps, pages = mask.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    states, kept = np.zeros((steps, pages, HIDDEN)), []
    for t in range(steps):
        joined = np.concatenate([x[t], h], 1)
        z = joined @ w + b
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        th = np.tanh(new)
        m = mask[t][:, None]
        kept.append((joined, i, f, o, g, c, th, m))
        h, c = m * (o * th) + (1 - m) * h, m * new + (1 - m) * c
        states[t] = h
    return states, kept


def lstm_back(grad: np.ndarray, kept: list, w: np.ndarray):
    """Gradients by inputs, weights and bias from the gradients by the hidden states."""
    dw, db = np.zeros_like(w), np.zeros(w.shape[1])
    dx = np.zeros((len(kept), grad.shape[1], w.shape[0] - HIDDEN))
    dh, dc = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
    for t in range(len(kept) - 1, -1, -1):
        joined, i, f, o, g, c, th, m = kept[t]
        dh = dh + grad[t]
        own = dh * m
        dcell = dc * m + own * o * (1 - th * th)
        dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), own * th * o * (1 - o), dcell * i * (1 - g * g)], 1)
        dw += joined.T @ dz
        db += dz.sum(0)
        back = dz @ w.T
        dx[t] = back[:, :-HIDDEN]
        dh = back[:, -HIDDEN:] + dh * (1 - m)
        dc = dcell * f + dc * (1 - m)
    return dx, dw, db


def batch_of(pages: list[np.ndarray]):
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1])), np.zeros((steps, len(pages)))
    back = np.zeros((steps, len(pages)), np.int64)  # where each step's mirror image is
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
        back[:, k] = np.arange(steps)
        back[: len(page), k] = np.arange(len(page))[::-1]
    return x, mask, back


def mirror(x: np.ndarray, back: np.ndarray) -> np.ndarray:
    return x[back, np.arange(x.shape[1])]


def probabilities(pages: list[list], model: dict, slots) -> list[np.ndarray]:
    """For each page, the probability that each of its blocks is main text."""
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    out: list = [np.zeros(0)] * len(pages)
    order = [i for i in order if pages[i]]
    at = 0
    while at < len(order):  # batches of pages of like length
        size = max(1, min(256, 20_000 // len(pages[order[min(at + 255, len(order) - 1)]])))
        own = order[at : at + size]
        at += size
        x, mask, back = batch_of([inputs(pages[i], model, slots)[0] for i in own])
        ahead = lstm(x, mask, model["wf"], model["bf"])[0]
        behind = mirror(lstm(mirror(x, back), mask, model["wb"], model["bb"])[0], back)
        p = sigmoid(np.concatenate([ahead, behind], 2) @ model["out"] + model["const"])
        for k, i in enumerate(own):
            out[i] = p[: len(pages[i]), k]
    return out


def learn(pages: list[list], labels: list[np.ndarray], epochs: int = 6, rate: float = 0.01, seed: int = 3) -> dict:
    """Train the labeller by back-propagation through time and Adam steps; path marks are left out at random."""
    rng = np.random.default_rng(seed)
    wide = 2 * WIDTH + 4
    make = lambda *shape: rng.normal(0, 0.15, shape)
    model = {"path": make(PATH_SLOTS, WIDTH), "word": make(WORD_SLOTS, WIDTH), "wf": make(wide + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN), "wb": make(wide + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN), "out": make(2 * HIDDEN), "const": np.zeros(1)}
    for b in ("bf", "bb"):
        model[b][HIDDEN : 2 * HIDDEN] = 1
    m, v = ({k: np.zeros_like(a) for k, a in model.items()} for _ in range(2))
    step = 0
    slots = Slots()

    def thinned(path, text):
        own, words = slots(path, text)
        return [s for s in own if rng.random() > 0.15] or own[-1:], words

    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // 16)):
            made = []
            for i in rows:
                made.append(inputs(pages[i], model, thinned))
            x, mask, back = batch_of([a for a, _ in made])
            y = np.zeros(mask.shape)
            for k, i in enumerate(rows):
                y[: len(labels[i]), k] = labels[i]
            ahead, kept_f = lstm(x, mask, model["wf"], model["bf"])
            turned, kept_b = lstm(mirror(x, back), mask, model["wb"], model["bb"])
            both = np.concatenate([ahead, mirror(turned, back)], 2)
            d = (sigmoid(both @ model["out"] + model["const"]) - y) * mask / mask.sum()
            grad = {"out": np.einsum("tp,tph->h", d, both), "const": np.array([d.sum()])}
            dboth = d[:, :, None] * model["out"]
            dx, grad["wf"], grad["bf"] = lstm_back(dboth[:, :, :HIDDEN], kept_f, model["wf"])
            dx_b, grad["wb"], grad["bb"] = lstm_back(mirror(dboth[:, :, HIDDEN:], back), kept_b, model["wb"])
            dx = dx + mirror(dx_b, back)
            grad["path"], grad["word"] = np.zeros_like(model["path"]), np.zeros_like(model["word"])
            for k, (_, found) in enumerate(made):
                for t, (own, words) in enumerate(found):
                    np.add.at(grad["path"], own, dx[t, k, :WIDTH] / len(own))
                    np.add.at(grad["word"], words, dx[t, k, WIDTH : 2 * WIDTH] / len(words))
            step += 1
            for key, g in grad.items():
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.999 * v[key] + 0.001 * g * g
                model[key] = model[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return model


def invented(rng, words: list[str]) -> str:
    """A page with a main text among menus, notices, adverts, forms and comments, in one of many layouts."""
    pick = lambda options: options[rng.integers(len(options))]
    say = lambda least, most: " ".join(pick(words) for _ in range(rng.integers(least, most)))
    box = lambda names, inner, tags=("div", "section"): f'<{(t := pick(tags))} {pick(("class", "id"))}="{pick(names)}">{inner}</{t}>'
    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{say(1, 4)}</a></li>' for _ in range(rng.integers(3, 9))) + "</ul>"
    paragraph = lambda: pick((f"<p>{say(8, 70)}.</p>", f"<p>{say(8, 60)}", f"<p><b>{say(3, 40)}</b> {say(5, 30)}.</p>", f"<blockquote>{say(6, 30)}</blockquote>", f"<h2>{say(2, 7)}</h2><p>{say(10, 60)}.</p>", f"<ul><li>{say(3, 14)}</li><li>{say(3, 14)}</li></ul>", f"<p>{say(3, 9)}.</p>", f"<pre>{say(5, 20)}</pre>", f"<table><tr><td>{say(1, 5)}</td><td>{say(1, 5)}</td></tr></table>"))
    inner = f"<h1>{say(3, 12)}</h1>" * int(rng.random() < 0.9)
    body = [paragraph() for _ in range(rng.integers(1, 14))]
    for extra, chance in ((box(("ad", "advert", "ads", "sponsored", "promo"), say(4, 20), ("div", "aside")), 0.3), (box(("share", "social", "related"), links()), 0.15)):
        if rng.random() < chance:
            body.insert(int(rng.integers(len(body) + 1)), extra)
    main = pick((lambda s: f"<article>{s}</article>", lambda s: f"<main>{s}</main>", lambda s: f"<main><article>{s}</article></main>", lambda s: box(("content", "post", "entry", "story", "article", "main-content", "post-content", "article-body entry"), s)))(inner + "".join(body))
    before = [f"<nav>{links()}</nav>", box(("menu", "nav", "navbar"), links()), f"<header>{say(2, 12)}</header>", box(("header", "masthead"), f"<p>{say(2, 10)}</p>"), box(("cookie-notice", "consent", "cookie", "notice", "banner", "alert"), f"<p>{say(5, 30)}.</p><button>{say(1, 3)}</button>"), box(("ad", "advert", "ads"), say(4, 20)), f'<form class="search"><label>{say(1, 3)}</label><input></form>', box(("breadcrumb", "breadcrumbs"), links())]
    after = [f"<footer>&copy; {say(3, 20)}.</footer>", box(("footer", "copyright"), f"<p>{say(3, 20)}</p>"), f"<aside>{links()}<p>{say(4, 25)}.</p></aside>", box(("sidebar", "widget"), f"<h3>{say(1, 4)}</h3>{links()}<p>{say(5, 20)}.</p>"), box(("comments", "comment-list", "replies"), "".join(box(("comment", "reply"), f"<p>{say(5, 40)}.</p>") for _ in range(rng.integers(1, 5)))), f"<form><p>{say(3, 15)}</p><input><button>{say(1, 3)}</button></form>", box(("newsletter", "subscribe", "signup"), f"<p>{say(5, 20)}</p>"), box(("related", "recommended"), links())]
    some = lambda parts, rate: "".join(p for p in parts if rng.random() < rate)
    return f"<html><head><title>{say(3, 12)}</title></head><body>{some(before, 0.35)}{main}{some(after, 0.35)}</body></html>"


def train(pages: DataFrame, most: int = 250, made: int = 500, key: str = "page_id", text: str = "html", seed: int = 4) -> dict:
    """Fit the labeller on about `most` pages, chosen by a hash of their id, and on `made` invented layouts of their words.

    The labels come from marks that tell what an element holds; the model sees paths with marks left out at random, so it
    learns to judge a block also by its words, its shape and its neighbours. The sampled pages' blocks come to the driver.
    """
    rng = np.random.default_rng(seed)
    total = pages.count()
    sample = pages.selectExpr(f"`{key}` as id", f"`{text}` as text").where(portion("id", 11) < most / max(total, 1)).where("text is not null")

    def parse(frames):
        for frame in frames:
            for part in slices(frame):
                for i, page in zip(part["id"], part["text"]):
                    found = leaves(page)
                    yield pd.DataFrame({"id": [i], "path": [[" ".join(f[0]) for f in found]], "text": [[f[1] for f in found]], "linked": [[f[2] for f in found]], "main": [[f[3] for f in found]]})

    kind = pages.schema[key].dataType.simpleString()
    got = sample.mapInPandas(parse, f"id {kind}, path array<string>, text array<string>, linked array<long>, main array<long>").toPandas().sort_values("id", kind="stable")
    real = [list(zip((tuple(p.split(" ")) if p else () for p in row.path), row.text, row.linked, row.main)) for row in got.itertuples()]
    real = [page for page in real if page]
    words = sorted({w for page in real for _, t, *_ in page for w in t.split() if len(w) < 20}, key=lambda w: (crc32(w.encode()), w))[:20_000] or ["word", "text", "page"]
    pages_ = real + [leaves(invented(rng, words)) for _ in range(made)]
    pages_ = [p for p in pages_ if p]
    return learn(pages_, [np.array([main for *_, main in page], float) for page in pages_])


def extract(pages: DataFrame, model: dict, key: str = "page_id", url: str = "url", text: str = "html", threshold: float = 0.5) -> DataFrame:
    """The main text of every whole page: its blocks above the threshold, in page order, joined by line ends.

    A null, empty or textless page has an empty text. Repeated rows are read one by one. Returns key, url, text, n_chars,
    n_blocks (all blocks of the page).
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    def start():
        slots = Slots()

        def work(texts):
            found = [leaves(p) if p else [] for p in texts]
            chances = probabilities(found, held.value, slots)
            out = ["\n".join(f[1] for f, p in zip(page, own) if p >= threshold) for page, own in zip(found, chances)]
            return out, [len(t) for t in out], [len(p) for p in found]

        return work

    return over_texts(pages, [key, url], text, "text string, n_chars long, n_blocks int", start)
