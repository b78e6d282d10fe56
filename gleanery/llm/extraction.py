"""Main-text extraction by gradient-boosted trees over DOM-node features.

A page is parsed into a tree of block elements whose leaves are runs of text. Each node gets
features (subtree text, link and tag density, attribute tokens of itself and its ancestors,
depth, place among its siblings and what those are like), and boosted trees give the
probability that it holds article text. Decoding is hierarchical: the most probable labelling
in which no node below a dropped one is kept, found by dynamic programming over the tree.

The trees are fitted here, to pages that `training_pages` writes from a seed: `TRAIN_PAGES`
pages of many layouts with known article text. Every page is parsed and decoded whole.

Defined cases: a null or empty page has the empty text; markup that is not closed ends with
its parent; an unknown element is inline unless its name has a hyphen; character references
are decoded once; white space in a run becomes one space (a line break in a run too); repeated
pages are each extracted; pages of any length are parsed whole; of equally probable labellings the
one that keeps less is taken; an empty table gives an empty result; `extract` keeps other columns,
whatever their names, but text and n_chars are replaced.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gleanery.llm.common import as_bytes, chunks, extended, map_batches, read, with_columns

TRAIN_PAGES, SEED = 800, 11
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 32, 0.2, 20
PAGE_BYTES = 2 << 20

#: Elements that make blocks, elements without content, elements whose content is never text of a page.
BLOCKS = frozenset("html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend label address details summary hgroup center dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select button audio video canvas noembed noframes xmp".split())
#: An element that one of these ends, and where the search for it stops.
ENDS_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl div table blockquote pre figure form section article aside header footer nav main address fieldset center details hr".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("thead tbody tr td th", ("table",)), "tfoot": ("tbody tr td th", ("table",))}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=20_000)
def attribute_tokens(source: str) -> tuple[str, ...]:
    """Lower-case parts of the names that an element goes by; `hidden!` for what is not shown."""
    out = []
    for m in ATTRIBUTE.finditer(source):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            out += ["hidden!"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        elif name in ("hidden", "aria-hidden"):
            out += ["hidden!"] if value.lower() != "false" else []
        else:
            out += [t.lower() for t in TOKEN.findall(value)]
    return tuple(dict.fromkeys(out))


class Page:
    """Nodes in page order: tags, parents, ends of subtrees, attribute tokens; texts and link characters of leaves."""

    def __init__(self, source: str):
        self.tags, self.parents, self.ends, self.tokens, self.texts, self.links = ["html"], [-1], [0], [()], [""], [0]
        stack, run, in_run, anchors = [0], [], 0, []
        linked = 0

        def flush():
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self.add("#text", stack[-1], (), text, min(linked, len(text)))
                    self.ends[-1] = len(self.tags)
                run.clear()
            linked = 0

        def close(to: int):
            while len(stack) > to:
                node = stack.pop()
                self.ends[node] = len(self.tags)
                while anchors and anchors[-1] == node:
                    anchors.pop()

        at, pattern = 0, TAG
        while True:
            m = pattern.search(source, at)
            if m is None:
                if pattern is TAG and "<" in source[at : at + 1 << 20]:
                    pattern = LOOSE
                    continue
                break
            if m.start() > at:
                piece = source[at : m.start()]
                run.append(piece)
                if anchors:
                    linked += len(piece.strip())
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            closing = bool(m[1])
            if name in RAW:
                if not closing and not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else (at if name in ("button", "select", "noscript", "svg", "object") else len(source))
                run.append(" ")
                continue
            if name == "head":
                if not closing:
                    end = re.compile(r"</head\s*>|<body\b", re.I).search(source, at)
                    at = at if end is None else end.end() if end[0].startswith("</") else end.start()
                continue
            if name == "a":
                if closing:
                    if anchors:
                        anchors.pop()
                else:
                    anchors.append(stack[-1])
                continue
            if name in VOID:
                run.append(" ")
                if name == "hr":
                    flush()
                continue
            if name not in BLOCKS and "-" not in name:
                continue
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[i]] == name:
                        close(i)
                        break
                continue
            if name == "html":
                continue
            if name in ENDS_P and self.tags[stack[-1]] == "p":
                close(len(stack) - 1)
            if name in SAME:
                names, stops = SAME[name]
                found = None
                for i in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[i]] in stops:
                        break
                    if self.tags[stack[i]] in names.split():
                        found = i
                if found:
                    close(found)
            self.add(name, stack[-1], attribute_tokens(m[3]) if m[3] else (), "", 0)
            if not m[3].endswith("/") or name in BLOCKS:
                stack.append(len(self.tags) - 1)
            else:
                self.ends[-1] = len(self.tags)
        run.append(source[at:])
        flush()
        close(0)

    def add(self, tag, parent, tokens, text, links):
        self.tags.append(tag)
        self.parents.append(parent)
        self.ends.append(0)
        self.tokens.append(tokens)
        self.texts.append(text)
        self.links.append(links)


FEATURES = ("tag", "parent_tag", "own_low", "own_high", "above_low", "above_high", "depth", "log_chars", "share", "link_density", "leaves", "chars_per_leaf", "tags_per_word", "stops_per_word", "paragraphs", "paragraph_share", "place", "siblings", "same_siblings", "before_density", "after_density", "before_chars", "after_chars", "parent_density", "parent_chars", "hidden", "page_place")


def features(pages: list[Page], names: dict[str, float]) -> np.ndarray:
    """A row per node of all pages; names has the part of training nodes of that tag or token which hold article text."""
    count = np.array([len(p.tags) for p in pages])
    base = np.cumsum(count) - count
    first = np.repeat(base, count)
    parent = np.concatenate([np.array(p.parents) for p in pages]) + first
    root = np.zeros(len(first), bool)
    root[base] = True
    parent[root] = np.flatnonzero(root)
    end = np.concatenate([np.array(p.ends) for p in pages]) + first
    tags = [t for p in pages for t in p.tags]
    texts = [t for p in pages for t in p.texts]
    i = np.arange(len(tags))

    def subtree(x):
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[end] - total[i]

    chars = subtree(np.fromiter(map(len, texts), np.float64))
    links = subtree(np.array([x for p in pages for x in p.links], np.float64))
    words = subtree(np.array([t.count(" ") + bool(t) for t in texts], np.float64))
    stops = subtree(np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in texts], np.float64))
    leaves = subtree(np.array([t == "#text" for t in tags], np.float64))
    para = np.array([t in ("p", "blockquote", "pre") for t in tags])
    paragraphs, in_para = subtree(para.astype(float)), subtree(np.where(para, chars, 0.0))
    nodes = (end - i).astype(float)
    get = names.get
    tag_value = np.array([get(t, 0.5) for t in tags])
    tokens = [t for p in pages for t in p.tokens]
    own = np.array([(min(v), max(v)) if (v := [x for y in t if (x := get("." + y)) is not None]) else (0.5, 0.5) for t in tokens]).reshape(-1, 2)
    hidden = np.array(["hidden!" in t for t in tokens], float)
    low, high, depth, hid = own[:, 0].copy(), own[:, 1].copy(), np.zeros(len(i)), hidden.copy()
    above_low, above_high = np.full(len(i), 0.5), np.full(len(i), 0.5)
    local = parent.tolist()
    lowest, highest, deep, hide, own_tag = low.tolist(), high.tolist(), depth.tolist(), hid.tolist(), tag_value.tolist()
    path_low, path_high = [0.5] * len(local), [0.5] * len(local)
    for n, p in enumerate(local):  # parents come first
        if p != n:
            deep[n] = deep[p] + 1
            path_low[n] = min(path_low[p], lowest[p], own_tag[p] if own_tag[p] < 0.2 else 0.5)
            path_high[n] = max(path_high[p], highest[p], own_tag[p] if own_tag[p] > 0.8 else 0.5)
            hide[n] = max(hide[n], hide[p])
    above_low, above_high, depth, hid = np.array(path_low), np.array(path_high), np.array(deep), np.array(hide)
    # siblings: order of children within their parent
    order = np.lexsort((i, parent))
    order = order[~root[order]]
    same_parent = np.concatenate(([False], parent[order][1:] == parent[order][:-1])) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(~same_parent)
    sizes = np.diff(np.append(starts, len(order)))
    place, siblings = np.zeros(len(i)), np.ones(len(i))
    place[order] = (np.arange(len(order)) - np.repeat(starts, sizes)) / np.repeat(sizes, sizes)
    siblings[order] = np.repeat(sizes, sizes)
    kinds = {t: n for n, t in enumerate(dict.fromkeys(tags))}
    kind = np.array([kinds[t] for t in tags])
    _, inverse, times = np.unique(parent * len(kinds) + kind, return_inverse=True, return_counts=True)
    density = links / np.maximum(chars, 1)
    before, after, before_chars, after_chars = (np.full(len(i), -1.0) for _ in range(4))
    if len(order):
        later = order[same_parent]
        earlier = order[np.flatnonzero(same_parent) - 1]
        before[later], before_chars[later] = density[earlier], np.log1p(chars[earlier])
        after[earlier], after_chars[earlier] = density[later], np.log1p(chars[later])
    whole = chars[first]
    seen = np.concatenate(([0.0], np.cumsum(np.fromiter(map(len, texts), np.float64))))[i]
    columns = (tag_value, tag_value[parent], own[:, 0], own[:, 1], above_low, above_high, depth, np.log1p(chars), chars / np.maximum(whole, 1), density, np.log1p(leaves), chars / np.maximum(leaves, 1), nodes / np.maximum(words, 1), stops / np.maximum(words, 1), np.log1p(paragraphs), in_para / np.maximum(chars, 1), place, np.log1p(siblings), np.log1p(times[inverse]), before, after, before_chars, after_chars, density[parent], np.log1p(chars[parent]), hid, (seen - seen[first]) / np.maximum(whole, 1))
    return np.stack(columns, axis=1)


class Boosted:
    """Gradient-boosted trees on the logistic loss, on binned features; trees are full to DEPTH."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.binned(x)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS, np.int64)
            for level in range(DEPTH):
                width, offset = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-3)
                for f in range(x.shape[1]):
                    slot = node * BINS + binned[:, f]
                    sums = [np.bincount(slot, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h, np.ones(len(y)))]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                    where = gain.argmax(axis=1)
                    top = gain[np.arange(width), where]
                    better = top > best
                    best[better] = top[better]
                    feature[offset : offset + width][better] = f
                    cut[offset : offset + width][better] = where[better]
                own = offset + node
                node = node * 2 + (binned[np.arange(len(y)), feature[own]] > cut[own])
            leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            self.trees.append((feature, cut, leaf))
            score += leaf[node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1).astype(np.int16)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned, score, row = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                own = (1 << level) - 1 + node
                node = node * 2 + (binned[row, feature[own]] > cut[own])
            score += leaf[node]
        return score


def decoded(page: Page, odds: list[float]) -> list[bool]:
    """The most probable labelling in which a kept node's ancestors are all kept; the root is kept.

    With the score of dropping everything as zero, a kept subtree gains its own log odds and the gains
    of those children that are better kept. An element and the one run that is all it holds go together."""
    n = len(page.tags)
    gain, parents, ends = list(odds), page.parents, page.ends
    gain[0] = 0.0
    tied = [False] * n
    for i in range(n - 1, 0, -1):
        up = parents[i]
        tied[i] = up > 0 and up == i - 1 and ends[i] == ends[up]
        if gain[i] > 0 or tied[i]:
            gain[up] += gain[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parents[i]] and (tied[i] or gain[i] > 0)
    return kept


class Extractor:
    def __init__(self, names: dict[str, float], model: Boosted):
        self.names, self.model = names, model

    def labels(self, pages: list[Page]) -> list[list[bool]]:
        odds = self.model.log_odds(features(pages, self.names)).tolist()
        out, at = [], 0
        for p in pages:
            out.append(decoded(p, odds[at : at + len(p.tags)]))
            at += len(p.tags)
        return out

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        return ["\n".join(t for t, k in zip(p.texts, kept, strict=True) if t and k) for p, kept in zip(pages, self.labels(pages), strict=True)] if pages else []


#: The text of training pages carries marks: a run that starts with this sign is article text.
MARK = "⁣"


def training_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Pages of random layout; runs of article text start with MARK."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    syllables = "an be co di el fo ga hi in jo ka le mo ni or pa qui re su ta un va wo xe yo za tion ment ing er".split()

    pool = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(2_000)]

    def words(a, b):
        return [pool[i] for i in rng.integers(len(pool), size=int(rng.integers(a, b + 1)))]

    def sentence(a=4, b=18):
        w = words(a, b)
        return " ".join([w[0].capitalize(), *w[1:]]) + pick(".", ".", ".", "!", "?")

    def prose(a=1, b=6):
        return " ".join(sentence() for _ in range(int(rng.integers(a, b + 1))))

    def name(*options):
        base = pick(*options)
        return pick(base, f"{base}-{pick('box', 'wrap', 'area', 'block', 'inner')}", f"{pick('site', 'page', 'c', 'x')}-{base}", f"{base}{int(rng.integers(9))}")

    def attrs(*options, p=0.8):
        return f' {pick("class", "class", "id")}="{name(*options)}"' if chance(p) else ""

    def link():
        return f'<a href="/{pick(*syllables)}">{" ".join(words(1, 4))}</a>'

    def inline(text):
        parts = text.split(" ")
        for _ in range(int(rng.integers(0, 3))):
            i = int(rng.integers(len(parts)))
            parts[i] = pick(f"<b>{parts[i]}</b>", f"<em>{parts[i]}</em>", f'<a href="/x">{parts[i]}</a>', f"<b>{parts[i]}", f"{parts[i]}<br>")
        return MARK + " ".join(parts)

    def menu():
        items = "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 12))))
        return pick(f"<nav{attrs('nav', 'menu', 'navbar', p=0.4)}><ul>{items}</ul></nav>", f"<div{attrs('nav', 'menu', 'navigation', 'topbar')}><ul>{items}</ul></div>", f"<ul{attrs('menu', 'nav', 'links', 'breadcrumb')}>{items}</ul>", f"<nav>{' | '.join(link() for _ in range(5))}</nav>", f"<div{attrs('breadcrumb', 'crumbs')}>{' &gt; '.join(link() for _ in range(3))}</div>")

    def top():
        inner = pick(f"<h1>{' '.join(words(1, 3))}</h1>", f"<a href='/'>{' '.join(words(1, 2))}</a>", f"<div{attrs('logo', 'brand')}>{' '.join(words(1, 3))}</div><p>{sentence(2, 6)}</p>")
        return pick(f"<header{attrs('header', 'masthead', p=0.4)}>{inner}{menu() if chance(0.5) else ''}</header>", f"<div{attrs('header', 'masthead', 'banner', 'top')}>{inner}</div>", menu())

    def advert():
        text = pick(prose(1, 2), sentence(2, 8), f"{sentence(2, 6)} {link()}")
        text = pick(text, f"<p>{text}</p>")
        return pick(f'<div class="ad">{text}</div>', f"<div{attrs('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', p=1)}>{text}</div>", f"<aside{attrs('ad', 'advert', 'promo', 'sponsor')}>{text}</aside>", f"<section{attrs('sponsored', 'promo', 'advertisement', p=1)}><h3>{' '.join(words(1, 3))}</h3>{text}</section>")

    def notice():
        text = f"<p>{prose(1, 3)}</p>{pick('', link(), '<button>OK</button>')}"
        return pick(f"<div{attrs('cookie', 'consent', 'notice', 'banner', 'alert', 'gdpr', 'popup', 'modal', 'paywall', p=1)}>{text}</div>", f'<div role="{pick("alert", "dialog")}">{text}</div>', f"<dialog>{text}</dialog>", f'<div style="display:none">{text}</div>', f"<div hidden>{text}</div>")

    def sidebar():
        parts = "".join(pick(f"<h3>{' '.join(words(1, 3))}</h3><ul>{''.join(f'<li>{link()}</li>' for _ in range(int(rng.integers(2, 7))))}</ul>", f"<h4>{' '.join(words(1, 3))}</h4><p>{prose(1, 2)}</p>", advert(), f"<div{attrs('related', 'popular', 'trending', 'recommended')}>{link()} {link()} {link()}</div>") for _ in range(int(rng.integers(1, 4))))
        return pick(f"<aside{attrs('sidebar', 'side', 'rail', p=0.5)}>{parts}</aside>", f"<div{attrs('sidebar', 'aside', 'widget', 'related', 'rail', 'column', p=1)}>{parts}</div>", f"<section{attrs('related', 'recommended', 'more', p=1)}>{parts}</section>")

    def form():
        return pick(f"<form{attrs('search', 'subscribe', 'newsletter', 'login', p=0.6)}><label>{' '.join(words(1, 4))}</label><input><p>{sentence(3, 10)}</p><button>Go</button></form>", f"<div{attrs('newsletter', 'subscribe', 'signup', p=1)}><p>{prose(1, 2)}</p><form><input><button>Go</button></form></div>")

    def comments():
        each = "".join(pick(f"<div{attrs('comment', 'reply', p=1)}><p>{prose(1, 4)}</p></div>", f"<li{attrs('comment', p=0.5)}><b>{' '.join(words(1, 2))}</b><p>{prose(1, 4)}</p></li>", f"<article{attrs('comment', p=1)}><p>{prose(1, 4)}</p></article>") for _ in range(int(rng.integers(1, 6))))
        return pick(f"<section{attrs('comments', 'discussion', 'responses', p=1)}><h2>{' '.join(words(1, 2))}</h2>{each}</section>", f"<div{attrs('comments', 'respond', 'disqus', 'replies', p=1)}>{each}{form() if chance(0.3) else ''}</div>", f"<ol{attrs('commentlist', 'comments', p=1)}>{each}</ol>")

    def bottom():
        text = pick(f"&copy; {' '.join(words(1, 4))} &middot; {sentence(2, 8)}", f"<p>&copy; {sentence(2, 8)}</p><ul><li>{link()}</li><li>{link()}</li></ul>", prose(1, 2))
        return pick(f"<footer{attrs('footer', 'site', p=0.4)}>{text}</footer>", f"<div{attrs('footer', 'bottom', 'copyright', 'legal', p=1)}>{text}</div>")

    def share():
        return f"<div{attrs('share', 'social', 'tags', 'meta', p=1)}>{' '.join(link() for _ in range(int(rng.integers(2, 5))))}</div>"

    def block():
        r = rng.random()
        if r < 0.68:
            return f"<p>{inline(prose(1, 8))}</p>" if chance(0.9) else f"<p>{inline(prose(1, 3))}"
        if r < 0.76:
            return f"<h{(k := pick(2, 2, 3))}>{MARK}{' '.join(words(1, 7))}</h{k}>"
        if r < 0.84:
            tag = pick("ul", "ol")
            return f"<{tag}>{''.join(f'<li>{inline(sentence())}</li>' for _ in range(int(rng.integers(2, 6))))}</{tag}>"
        if r < 0.88:
            return f"<blockquote>{pick(f'<p>{inline(prose(1, 3))}</p>', inline(prose(1, 2)))}</blockquote>"
        if r < 0.91:
            return f"<pre>{MARK}{' '.join(words(3, 20))}</pre>"
        if r < 0.94:
            return "<table>" + "".join(f"<tr>{''.join(f'<td>{MARK}{' '.join(words(1, 3))}</td>' for _ in range(3))}</tr>" for _ in range(int(rng.integers(2, 5)))) + "</table>"
        if r < 0.97:
            return f"<figure><img src=x><figcaption>{MARK}{sentence(3, 10)}</figcaption></figure>"
        return f"<div>{inline(prose(1, 4))}</div>"

    def story():
        headline = pick(" ".join(words(2, 10)), sentence(2, 9), prose(1, 2))
        title = f"<h1>{MARK}{headline}</h1>" if chance(0.85) else ""
        if title and chance(0.2):
            title = f"<header>{title}</header>"
        parts = [block() for _ in range(int(rng.choice([0, 1, 2, 3, 5, 8, 14, 25], p=[0.02, 0.1, 0.12, 0.16, 0.2, 0.2, 0.14, 0.06])))]
        if not parts and not title:
            return ""
        if title and parts and chance(0.2):
            parts[0] = pick(f"<p>{MARK}{headline}</p>", f"<p>{inline(headline)}", f"<p>{MARK}<b>{headline}<br>")
        for extra in (advert, share, form, notice, sidebar):
            if chance(0.12):
                parts.insert(int(rng.integers(len(parts) + 1)), extra())
        inner = title + "".join(parts)
        if chance(0.15):
            half = len(parts) // 2
            inner = f"{title}<section>{''.join(parts[:half])}</section><section>{''.join(parts[half:])}</section>"
        inner = pick(inner, inner, f"<div{attrs('content', 'body', 'text', 'entry', 'post', 'story', p=0.7)}>{inner}</div>")
        return pick(f"<article>{inner}</article>", f"<article{attrs('post', 'article', 'entry', 'story')}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article>{comments() if chance(0.2) else ''}</main>", f"<div{attrs('content', 'article', 'post', 'story', 'main', 'body', 'text', 'entry', 'col')}>{inner}</div>", f"<div{attrs('col', 'row', 'left', 'box', 'wrap', p=0.5)}>{inner}</div>")

    pages = []
    for _ in range(count):
        before = [f() for f in (top, menu, advert, notice, form, sidebar) if chance(0.45)]
        after = [f() for f in (comments, sidebar, advert, share, form, notice, menu) if chance(0.3)] + ([bottom()] if chance(0.8) else [])
        body = "".join(before) + story() + "".join(after)
        if chance(0.4):
            body = f"<div{attrs('wrapper', 'container', 'page', 'layout')}>{body}</div>"
        if chance(0.1):
            body = f"<table><tr><td>{body}</td></tr></table>"
        pages.append(f"<!DOCTYPE html><html><head><title>{' '.join(words(2, 5))}</title><style>p{{margin:0}}</style></head><body>{body}<script>var x='<p>no</p>';</script></body></html>")
    return pages


def fit(sources: list[str] | None = None) -> Extractor:
    pages = [Page(s) for s in sources or training_pages()]
    labels = []
    for p in pages:
        holds = [t.startswith(MARK) for t in p.texts]
        for i in range(len(holds) - 1, 0, -1):
            if holds[i]:
                holds[p.parents[i]] = True
        labels += holds
        p.texts = [t.replace(MARK, "") for t in p.texts]
    y = np.array(labels, float)
    sums: dict[str, list[float]] = {}
    for (tag, tokens), label in zip(((t, k) for p in pages for t, k in zip(p.tags, p.tokens, strict=True)), labels, strict=True):
        for key in (tag, *("." + k for k in tokens)):
            s = sums.setdefault(key, [0.0, 0.0])
            s[0] += label
            s[1] += 1
    names = {k: (a + 1) / (n + 2) for k, (a, n) in sums.items() if n >= 3}
    return Extractor(names, Boosted(features(pages, names), y))


@lru_cache(maxsize=1)
def fitted() -> Extractor:
    """The extractor of the seeded training pages, which is fitted once for each driver."""
    return fit()


def extract(pages: DataFrame, extractor: Extractor | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the article's text, and n_chars, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor or fitted())

    def work(batches):
        for batch in chunks(batches, html_col, PAGE_BYTES):
            texts = shared.value.texts([(s or b"").decode("utf-8", "replace") for s in as_bytes(batch.column(html_col))])
            yield with_columns(batch, {text_col: pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return map_batches(pages, work, extended(pages, [(text_col, T.StringType()), ("n_chars", T.LongType())]))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
