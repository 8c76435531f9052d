"""Main-text extraction: boosted trees over the features of DOM nodes, then a decoding that respects the hierarchy.

A page is read into a tree of block elements (html_tree). Every element gets features: its subtree's text and link density,
the words of its class, id and role (and of its ancestors), its depth and place, and how it compares with its siblings. Gradient-boosted
trees, trained here on a bounded sample of pages, give each element the log-odds of belonging to the article. The
decoding chooses the most likely set of elements in which nothing inside a dropped element is kept: bottom-up,
an element is dropped with all below it if that gains more than keeping it and deciding each child for itself.

Pages carry no labels, so the sample is labelled by evidence that is no list of names: a page's own <article> or <main> is the article and what
stands outside of it is not; navigation, footers, asides and forms are not, nor are series of short items that carry dates or
authors, as comments do; on pages without such an element, and on a third of the others, text that other pages of the host repeat is not, and
paragraphs with several sentences that no other page has are. Other elements are not learned from.
What elements call themselves counts only as far as the sample shows it: the log-odds of each word of an attribute, counted on one half of
the sample (the trees are fitted on the other half). Every row is used a second time without what names and telling elements say, so that
shape alone can decide. And as pages also put foreign things inside of their articles, articles are used again with such things grafted
in: blocks that stand outside of the article on other pages, and series of comments. Texts of articles are set as lists and tables there,
too, as the article's own. `quality` measures the model on hosts that it wasn't
fitted on, with the names and the telling elements taken away.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_tree import Tree

#: Pages that the trees are fitted on, at most (about: a range of hash values), and their characters, at most.
SAMPLE_PAGES, SAMPLE_CHARS = 600, 24_000_000
#: Pages of a host that must have the same text for it to be none of an article; sentences and characters that make a paragraph one.
REPEATED, SENTENCES, PARAGRAPH = 3, 2, 80
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.2, 24, 20

# Names that elements give themselves.
ARTICLE_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "header", "footer", "aside", "menu", "select", "dialog", "head"}
NEVER_TAGS = {"form", "button", "select", "option", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "li", "dl", "dt", "dd", "menu"}
TABLES = {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}
N_FEATURES = 25
NAMED = slice(0, 5)  # the features that come from names; the first sums up over the ancestors, with the last word to the others
#: Dates and times, and how lines name an author; a line that holds one is as long at most, the items of a series are as long on average.
STAMP = re.compile(r"\d{4}-\d\d?-\d\d?|\d\d?[./]\d\d?[./]\d{2,4}|\b\d\d?:\d\d\b|\b(?:\d+|an?) \w+ ago\b|\b[^\W\d]{3,10}\.? \d\d?,? \d{4}\b|\b\d\d?\.? [^\W\d]{3,10}\.?,? \d{4}\b|^@\w|^(?:by|von|par|por) \w|\b(?:says|said|wrote|writes):?$", re.I)
STAMP_CHARS, ITEM_CHARS = 60, 800


def series(t: Tree) -> list[bool]:
    """Which elements are, or stand in, items of a series as comments are: two or more siblings alike (by element and names), short, most of them
    with a line of its own that is a date, a time or an author, beside other text. Rows of tables are no such items."""
    n = len(t.tag)
    held: list[int] = [0] * n
    chars, runs = [0] * n, [0] * n
    for node, text in t.runs:
        held[node] |= len(text) <= STAMP_CHARS and bool(STAMP.search(text))
        chars[node] += len(text)
        runs[node] += 1
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        held[p] |= held[i] and t.tag[i] not in HEADINGS
        chars[p] += chars[i]
        runs[p] += runs[i]
    alike: dict[tuple, list[int]] = defaultdict(list)
    for i in range(1, n):
        if t.tag[i] not in TABLES and runs[i]:
            alike[t.parent[i], t.tag[i], t.tokens[i]].append(i)
    out = [False] * n
    for own in alike.values():
        if len(own) > 1 and sum(held[i] and runs[i] > 1 for i in own) * 2 > len(own) and sum(chars[i] for i in own) <= ITEM_CHARS * len(own):
            for i in own:
                out[i] = True
    for i in range(1, n):
        out[i] = out[i] or out[t.parent[i]]
    return out


def features(t: Tree, odds: dict[str, float] | None = None) -> np.ndarray:
    """One row of features for each element. odds: the log-odds of words of attributes."""
    n = len(t.tag)
    parent = t.parent
    text, links, tags, inline, stops, runs = [0] * n, list(t.links), [1] * n, list(t.inline), [0] * n, [0] * n
    first = [0] * n
    seen = 0
    for node, s in t.runs:
        if not text[node]:
            first[node] = seen
        text[node] += len(s)
        seen += len(s)
        runs[node] += 1
        stops[node] += sentences(s)
    own = list(text)
    children = [0] * n
    place = [0] * n
    for i in range(1, n):
        place[i] = children[parent[i]]
        children[parent[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for x in (text, links, tags, inline, stops, runs):
            x[p] += x[i]
    depth, other, article, inside, good, bad, learned = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        same[parent[i], t.tag[i]] = same.get((parent[i], t.tag[i]), 0) + 1
    for i in range(1, n):
        p, tag = parent[i], t.tag[i]
        depth[i] = depth[p] + 1
        words = t.tokens[i]
        is_article = tag in ARTICLE_TAGS
        good[i] = int(is_article)
        # a heading's own <header> inside the article is part of it
        bad[i] = int(tag in OTHER_TAGS and not (tag == "header" and inside[p]))
        inside[i] = int(inside[p] or is_article)
        other[i] = other[p] + bad[i]
        article[i] = article[p] + good[i]
        learned[i] = min([learned[p], *(odds.get(w, 0.0) for w in words)]) if odds and words else learned[p]
    total = max(1, seen)
    listed = series(t)
    rows = []
    for i in range(n):
        p = max(parent[i], 0)
        chars = text[i]
        rows.append((
            -1 if other[i] else int(article[i] > 0), good[i], bad[i], learned[i], int(t.tag[i] in NEVER_TAGS), int(listed[i]),
            np.log1p(chars), np.log1p(own[i]), links[i] / (chars + 1), chars / (tags[i] + inline[i]), chars / (runs[i] + 1), np.log1p(tags[i]), stops[i] / (chars / 50 + 1), chars / total, chars / (text[p] + 1),
            depth[i], first[i] / total, children[i], children[p], place[i] / (children[p] or 1), same.get((parent[i], t.tag[i]), 1) / (children[p] or 1),
            int(t.tag[i] in HEADINGS), int(t.tag[i] in LISTS), int(t.tag[i] in TABLES), int(t.tag[i] == "p"),
        ))
    return np.array(rows, np.float32)


def sentences(s: str) -> int:
    return s.count(". ") + s.count(", ") + s.endswith((".", "!", "?"))


def labels(t: Tree, repeated: set[str], telling: bool = True) -> np.ndarray:
    """1, 0, or -1 for none, by the evidence of the page and of its host's other pages; see the module's text. telling: an <article> or <main> tells."""
    n = len(t.tag)
    inside, other, holds = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        p, tag = t.parent[i], t.tag[i]
        inside[i] = inside[p] or tag in ARTICLE_TAGS
        other[i] = other[p] or tag in OTHER_TAGS and not (tag == "header" and inside[p]) or tag in NEVER_TAGS
    for i in range(n - 1, 0, -1):
        holds[i] = holds[i] or t.tag[i] in ARTICLE_TAGS
        holds[t.parent[i]] = holds[t.parent[i]] or holds[i]
    other = [a or b for a, b in zip(other, series(t))]
    out = np.full(n, -1, np.int8)
    if holds[0] and telling:
        for i in range(1, n):
            out[i] = 0 if other[i] else 1 if inside[i] else -1 if holds[i] else 0
        return out
    for i in range(1, n):
        out[i] = 0 if other[i] else -1
    for node, s in t.runs:
        if s in repeated:
            out[node] = 0
        elif out[node] < 0 and t.tag[node] == "p" and len(s) >= PARAGRAPH and sentences(s) >= SENTENCES:
            out[node] = 1
    return out


def graft(t: Tree, at: int, place: int, s: Tree, top: int) -> Tree:
    """A copy of t with the subtree of s below `top` as one more child of `at`, its text before t's run number `place`."""
    out = Tree("")
    own, new = [i == top for i in range(len(s.tag))], {top: len(t.tag)}
    for i in range(top + 1, len(s.tag)):
        if own[s.parent[i]]:
            own[i] = True
            new[i] = len(t.tag) + len(new)
    out.tag, out.tokens, out.links, out.inline = ([*a, *(b[i] for i in new)] for a, b in ((t.tag, s.tag), (t.tokens, s.tokens), (t.links, s.links), (t.inline, s.inline)))
    out.parent = [*t.parent, at, *(new[s.parent[i]] for i in list(new)[1:])]
    out.runs = [*t.runs[:place], *((new[i], x) for i, x in s.runs if i in new), *t.runs[place:]]
    return out


def comments(texts: list[str], k: int) -> Tree:
    """A series of comments made of texts of the sample: k tells how they are dressed."""
    tag, names = ("div", "li", "section", "article")[k % 4], ("", f' class="w{k % 7}"', f' class="w{k % 5}-item"')[k % 3]
    stamp = (f"{k % 28 + 1}.{k % 12 + 1}.20{k % 20 + 10}", f"{k % 9 + 2} hours ago", f"20{k % 20 + 10}-0{k % 9 + 1}-1{k % 10}", f"User{k} 1{k % 10}:2{k % 10}")[k // 4 % 4]
    line = (f"<div>{stamp}</div>", f"<p>{stamp}</p>", f"<header>{stamp}</header>")[k // 3 % 3]
    items = "".join(f"<{tag}{names}>{line}<p>{html.escape(x)}</p></{tag}>" for x in texts)
    return Tree(f"<{'ul' if tag == 'li' else 'div'}>{items}</{'ul' if tag == 'li' else 'div'}>")


def set_out(texts: list[str], k: int) -> Tree:
    """Texts of articles set as lists, tables and under headings, as articles may hold them."""
    dated = [f"{x[:60]} {k % 28 + 1}.{j + 1}.20{k % 20 + 10}" if k % 3 == 0 else x[: (8, 20, 40, 90)[(k + j) % 4]] for j, x in enumerate(texts)]
    safe = [html.escape(x) for x in dated]
    rows = "".join(f"<tr><td>{j + 1}.{k % 12 + 1}.2020</td><td>{x[:80]}</td></tr>" for j, x in enumerate(safe))
    return Tree((
        "<ul>" + "".join(f"<li>{x}</li>" for x in safe) + "</ul>", f"<table><tbody>{rows}</tbody></table>", "<ol>" + "".join(f"<li><p>{x}</p></li>" for x in safe) + "</ol>",
        "<dl>" + "".join(f"<dt>{x[:20]}</dt><dd>{x}</dd>" for x in safe) + "</dl>", f"<table>{rows}</table>", "<blockquote>" + "".join(f"<p>{x}</p>" for x in safe) + "</blockquote>",
        "<div>" + "".join(f"<h{1 + (k + j) % 3}>{x[: 8 + 6 * (k % 5)]}</h{1 + (k + j) % 3}><p>{x}</p>" for j, x in enumerate(safe)) + "</div>", f"<div><h1>{safe[0][: 8 + 6 * (k % 7)]}</h1>" + "".join(f"<p>{x}</p>" for x in safe) + "</div>",
    )[k % 8])


class Boosted:
    """Gradient-boosted regression trees of fixed depth on binned features, with the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        # by the rows and by the values they have, so that rare values are told apart too
        cuts = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
        self.edges = [np.unique(np.concatenate([np.quantile(c, cuts), np.quantile(np.unique(c), cuts, method="lower")])) for c in x.T] if len(x) else []
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(x):
            return
        b = self._binned(x)
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grown(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._value(tree, b)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1).astype(np.uint8)

    @staticmethod
    def _grown(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**DEPTH - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(2**DEPTH)
        node = np.zeros(len(b), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                best = 1e-6
                for j in range(b.shape[1] if len(own) >= 2 * LEAST_LEAF else 0):
                    c = b[own, j]
                    gs, hs, ns = (np.cumsum(np.bincount(c, w, BINS + 1)) for w in (g[own], h[own], None))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    gain[(ns < LEAST_LEAF) | (ns[-1] - ns < LEAST_LEAF)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, feature[k], cut[k] = float(gain[at]), j, at
                node[own] = 2 * k + 1 + (b[own, feature[k]] > cut[k])
        for leaf in range(2**DEPTH):
            own = node == inner + leaf
            value[leaf] = RATE * g[own].sum() / (h[own].sum() + 1)
        return feature, cut, value

    @staticmethod
    def _value(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        at = np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[at, feature[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.base)
        b = self._binned(x)
        return self.base + sum(self._value(t, b) for t in self.trees)


class Extractor:
    """Boosted trees and the log-odds of attribute words; the same pages in the same order give the same."""

    def __init__(self, pages: list[tuple[str | None, str | None]], telling: bool = True):
        """pages: (url, html). telling: <article> and <main> count as evidence."""
        trees = [Tree(h or "") for _, h in pages]
        hosts = [_host(u) for u, _ in pages]
        held: dict[str, Counter] = defaultdict(Counter)
        for host, t in zip(hosts, trees):
            held[host].update({s for _, s in t.runs})
        repeated = {h: {s for s, n in c.items() if n >= REPEATED} for h, c in held.items()}
        # a third of the pages is labelled by its host's other pages alone
        ys = [labels(t, repeated[h], telling and k % 3 < 2) for k, (h, t) in enumerate(zip(hosts, trees))]
        votes: dict[str, list[int]] = {}
        for t, y in zip(trees[::2], ys[::2]):
            for words, label in zip(t.tokens, y.tolist()):
                for w in set(words) if label >= 0 else ():
                    votes.setdefault(w, [0, 0])[label] += 1
        self.odds = {w: float(np.log((good + 5) / (bad + 5))) for w, (bad, good) in votes.items()}
        fitted = list(zip(trees, ys))[1::2] or list(zip(trees, ys))
        xs, ls = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0)]
        for t, y in [*fitted, *self._grafted(fitted)]:
            xs.append(features(t, self.odds)[y >= 0])
            ls.append(y[y >= 0].astype(float))
        x, y = np.concatenate(xs), np.concatenate(ls)
        hidden = x.copy()
        hidden[:, NAMED] = 0
        self.boosted = Boosted(np.concatenate([x, hidden]), np.concatenate([y, y]))

    @staticmethod
    def _grafted(fitted: list[tuple[Tree, np.ndarray]]) -> Iterator[tuple[Tree, np.ndarray]]:
        """The pages with more among their articles' paragraphs: a block that is none of another page's article, comments, and lists or tables of its own."""
        foreign = [(t, [i for i in range(1, len(t.tag)) if y[i] == 0 and (y[t.parent[i]] != 0 or t.tag[t.parent[i]] in ("body", "html", "#"))]) for t, y in fitted]
        texts = [s[:300] for t, y in fitted for node, s in t.runs if y[node] > 0 and len(s) > 20]
        for k, (t, y) in enumerate(fitted):
            runs = [(j, t.parent[node]) for j, (node, _) in enumerate(t.runs) if y[node] > 0 and y[t.parent[node]] != 0]
            if not runs:
                continue
            place, at = runs[k * 7 % len(runs)]
            s, tops = foreign[(k + 1) % len(foreign)]
            if tops:
                more = graft(t, at, place, s, tops[k % len(tops)])
                yield more, np.concatenate([y, np.zeros(len(more.tag) - len(y), np.int8)])
            place, at = runs[k * 5 % len(runs)]
            own = [texts[(k * 13 + j) % len(texts)] for j in range(2 + k % 4)]
            more = graft(t, at, place, set_out(own, k), 1)
            yield more, np.concatenate([y, np.ones(len(more.tag) - len(y), np.int8)])
            place, at = runs[-1]
            said = [texts[(k * 11 + j) % len(texts)] for j in range(2 + k % 5)]
            more = graft(t, at, place + 1, comments(said, k), 1)
            yield more, np.concatenate([y, np.zeros(len(more.tag) - len(y), np.int8)])

    def kept(self, trees: list[Tree]) -> Iterator[list[bool]]:
        x = [features(t, self.odds) for t in trees]
        odds = self.boosted.log_odds(np.concatenate(x)) if x else np.zeros(0)
        at = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(int)
        for i, t in enumerate(trees):
            yield decode(t, odds[at[i] : at[i + 1]])

    def extract(self, pages: list[str | None]) -> list[str]:
        """The article's blocks in page order, joined by an empty line; empty without any."""
        trees = [Tree(h or "") for h in pages]
        return ["\n\n".join(s for node, s in t.runs if kept[node]) for t, kept in zip(trees, self.kept(trees))]


def _host(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc
    except ValueError:  # no url at all
        return ""


_TELLING = re.compile(r"(</?)(?:" + "|".join(sorted(ARTICLE_TAGS | (OTHER_TAGS - NEVER_TAGS))) + r")\b[^>]*>", re.I)
_ATTRIBUTES = re.compile(r"<(div|p|h[1-6]|ul|ol|li|section|table|tr|td)\s[^>]*>", re.I)


def quality(pages: list[tuple[str | None, str | None]], parts: int = 3, telling: bool = True) -> tuple[float, float]:
    """Precision and recall, by characters, on the pages of hosts that weren't learned from (one of `parts`, by hash), with
    telling elements made <div> and all attributes of blocks dropped; pages without <article> or <main> don't count. telling: false takes the
    telling elements out of what is learned from too, so that all evidence is that of the hosts."""
    out = [(u, h) for u, h in pages if crc32(_host(u).encode()) % parts == 0]
    rest = [(u, h) for u, h in pages if crc32(_host(u).encode()) % parts]
    model = Extractor(rest if telling else [(u, _TELLING.sub(r"\1div>", h or "")) for u, h in rest])
    right = found = asked = 0
    for _, h in out:
        t = Tree(h or "")
        want = Counter(s for (_, s), y in zip(t.runs, labels(t, set())[[node for node, _ in t.runs]]) if y > 0) if t.runs else Counter()
        if not want:
            continue
        plain = Tree(_ATTRIBUTES.sub(r"<\1>", _TELLING.sub(r"\1div>", h or "")))
        kept = next(model.kept([plain]))
        got = Counter(s for node, s in plain.runs if kept[node])
        size = lambda c: sum(len(s) * n for s, n in c.items())
        right, found, asked = right + size(want & got), found + size(got), asked + size(want)
    return right / max(1, found), right / max(1, asked)


def decode(t: Tree, log_odds: np.ndarray) -> list[bool]:
    """Which elements are kept: the best choice in which all below a dropped element is dropped."""
    n = len(t.tag)
    keep = np.minimum(0, log_odds) - np.log1p(np.exp(-np.abs(log_odds)))  # log p
    drop = keep - log_odds  # log (1 - p)
    keep, drop = keep.tolist(), drop.tolist()
    for i in range(n):
        if t.tag[i] in ("#", "html", "body"):  # they hold everything and say nothing
            keep[i] = drop[i] = 0.0
        elif t.tag[i] in NEVER_TAGS:
            keep[i], drop[i] = -1e9, 0.0
    best = list(keep)  # of keeping i and deciding below
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        best[p] += max(best[i], drop[i])
        drop[p] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[t.parent[i]] and (best[i] > drop[i] or t.tag[i] in ("html", "body"))
    return kept


def _extracted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.slice(lo, 200)
                texts = model.value.extract(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(s) for s in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _fitted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, chars = [], 0
        for b in batches:
            for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                if chars + len(h) <= most:
                    pages.append((u, h))
                    chars += len(h)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Extractor(pages))], pa.binary())], ["model"])

    return run


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Extractor:
    """The model of about `sample` pages chosen by hash (of these, pages that would exceed `chars` in sum are passed over); one
    task fits it, and its trees come to the driver."""
    d = pages.where("html is not null")
    share = int(min(1.0, sample / max(1, d.count())) * (1 << 30))
    spread = F.xxhash64("html")
    rows = d.where(F.pmod(spread, F.lit(1 << 30)) < share).select("url", "html").orderBy(spread, "html", "url").limit(2 * sample).coalesce(1)
    found = rows.mapInArrow(_fitted(chars), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Extractor([])


def extract_pages(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page, or one without article text, has the empty text. Unclosed elements are closed as browsers do, a page
    that is cut off keeps what was read, a tag that is cut off is dropped. Of two equally likely readings the one that drops an element is
    taken. Work and memory grow with the length of a page. Equal rows give equal results; extra columns are not read. An
    empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))
    return pages.select("page_id", "url", "html").mapInArrow(_extracted(model), "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
