"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is read into a tree of block elements with features of each node: tags of it and its parent, depth, subtree
text, density and links, sibling statistics, and tokens of its attributes. Boosted trees (histogram splits, logistic
loss, numpy) give each node the probability of belonging to the article. Decoding is hierarchical: a kept node needs a
kept parent, and the choice with the highest total log-likelihood, weighted by text, is found from the leaves up, so
ancestors and descendants never contradict each other.

There are no labelled pages. The trees learn from a bounded sample of pages, each as it is (labels from its semantic
tags and attribute names, or else from its densest element) and in variants whose paragraphs are laid out anew in other templates, with menus, notices,
forms, adverts and comments around and inside the article, where the label of every node is known.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfen.llm.common import table

#: Pages that the trees are fitted to, by a seeded order, and laid-out variants of each.
SAMPLE, VARIANTS = 150, 3
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.2, 32, 8
TOKEN_BUCKETS = 48

# Elements that begin and end blocks, elements without content, and elements whose content is no text.
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
RAW = "script style title textarea noscript iframe".split()
SKIPPED = "template svg select button object video audio canvas head".split()
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
# Names of attributes that tell boilerplate from articles in the sample's own labels and in the variants.
AWAY = (
    "ad ads advert advertisement banner sponsor sponsored promo nav menu navbar breadcrumb breadcrumbs header masthead footer colophon copyright sidebar aside widget "
    "related recommended share social newsletter subscribe signup login search cookie cookies consent notice alert gdpr popup modal comment comments discussion replies "
    "respond pagination pager tags toolbar hidden skip"
).split()
HERE = "article content post entry story main body text prose richtext".split()
_SPACE = r"[ \t\n\r\f]"
#: One attribute as browsers read it: a quote delimits only right after `=`; a name may hold quotes or begin with `=`.
_ONE = rf"""(?:=[^ \t\n\r\f/>=]*+|[^ \t\n\r\f/>=]++)(?:{_SPACE}*+={_SPACE}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+|(?=>)|\Z))?+"""
#: Comments (also the short `<!-->`), other markup without a name, and tags. What begins here always ends, with the page
#: at the latest, so no character is read twice.
_TAG = re.compile(rf"""<!---?>|<!--(?:[^-]++|-(?!-!?>))*+(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{_ONE})*+)(>|\Z)""")
_ATTRIBUTE = re.compile(rf"""(=?[^ \t\n\r\f/>=]*+)(?:{_SPACE}*+={_SPACE}*+("[^"]*+|'[^']*+|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+)?["']?)?+""")
_TELLING = frozenset("class id role itemprop aria-label".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK_SET, _RAW_SET, _SKIP_SET, _AWAY_SET, _HERE_SET = set(BLOCKS), set(RAW), set(SKIPPED), set(AWAY), set(HERE)
_FIRST = {name: n + 1 for n, name in enumerate(BLOCKS)}


def attribute_tokens(attributes: str) -> list[str]:
    if "=" not in attributes and "hidden" not in attributes:
        return []
    out = []
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or "").lstrip("\"'")
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out.append("hidden")
        elif name in _TELLING:
            out += [p.lower() for p in _PARTS.findall(value)]
    return out


def _raw_end(source: str, name: str, at: int) -> int:
    """Where the text of a raw element ends whose start tag ends at `at`: behind its end tag, or with the page."""
    end = re.compile(rf"</{name}(?=[ \t\n\r\f/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
    return end.end() if end else len(source)


def skipped_runs(source: str) -> dict[int, int]:
    """Start and end of every skipped element that is closed before its parent ends; the others are read like any tag.

    Only `head` may lack its end tag: the start of the body ends it as well.
    """
    runs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    at = 0
    while match := _TAG.search(source, at):
        at = match.end()
        name = (match[2] or "").lower()
        if name in _RAW_SET and not match[1] and not match[3].endswith("/"):
            at = _raw_end(source, name, at)
        elif name == "body" and not match[1] and open_.get("head"):
            runs |= {start: match.start() for own, start in stack if own == "head"}
            stack, open_ = [], {}
        if name not in _BLOCK_SET and name not in _SKIP_SET:
            continue
        if not match[1]:
            if name != "hr" and not match[3].endswith("/"):
                stack.append((name, match.start()))
                open_[name] = open_.get(name, 0) + 1
        elif open_.get(name):
            while True:
                own, start = stack.pop()
                open_[own] -= 1
                if own == name:
                    break
            if name in _SKIP_SET:
                runs[start] = at
    return runs


class Page:
    """Block elements of a page in document order, and its blocks of text as (node, text)."""

    def __init__(self, source: str | None) -> None:
        source = source or ""
        self.tags, self.parents, self.tokens = ["html"], [-1], [[]]
        self.links = [0]
        self.blocks: list[tuple[int, str]] = []
        stack, buffer, in_link, at = [0], [], 0, 0
        open_ = dict.fromkeys(BLOCKS, 0)
        runs = skipped_runs(source)

        def leave(place: int) -> None:
            for node in stack[place:]:
                open_[self.tags[node]] -= 1
            del stack[place:]

        def flush() -> None:
            nonlocal in_link
            if buffer:
                text = "".join(buffer)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1], text))
            in_link = 0

        while True:
            match = _TAG.search(source, at)
            text = source[at : match.start()] if match else source[at:]
            if text:
                buffer.append(text)
                if in_link:
                    self.links[stack[-1]] += len(text)
            if match is None:
                break
            at = match.end()
            name = match[2]
            if name is None:
                continue
            name = name.lower()
            if name in _RAW_SET:
                if not match[1] and not match[3].endswith("/"):
                    at = _raw_end(source, name, at)
            elif name in _SKIP_SET:
                at = runs.get(match.start(), at)
            elif name == "a":
                in_link = 0 if match[1] else 1
            elif name == "br":
                buffer.append(" ")
            elif name in _BLOCK_SET and name != "html":
                flush()
                if match[1]:
                    if open_[name]:
                        leave(next(k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == name))
                    continue
                if self.tags[stack[-1]] == "p":
                    leave(len(stack) - 1)
                if name in CLOSES and any(open_[end] for end in CLOSES[name][0].split()):
                    ends, limit = CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] in limit:
                            break
                        if self.tags[stack[k]] in ends.split():
                            leave(k)
                            break
                self.tags.append(name)
                self.parents.append(stack[-1])
                self.tokens.append(attribute_tokens(match[3]))
                self.links.append(0)
                if name != "hr" and not match[3].endswith("/"):
                    stack.append(len(self.tags) - 1)
                    open_[name] += 1
        flush()

    def features(self) -> np.ndarray:
        """One row per node; nodes come in document order, so a subtree is a run of rows."""
        n = len(self.tags)
        parents = np.array(self.parents)
        own, pieces, marks = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text in self.blocks:
            own[node] += len(text)
            pieces[node] += 1
            marks[node] += text.count(".") + text.count(",")
        links, nodes = np.array(self.links, float), np.ones(n)
        whole, linked, count, under, dots = own.copy(), links.copy(), pieces.copy(), nodes.copy(), marks.copy()
        for k in range(n - 1, 0, -1):
            p = parents[k]
            whole[p] += whole[k]
            linked[p] += linked[k]
            count[p] += count[k]
            under[p] += under[k]
            dots[p] += dots[k]
        depth, away, here, tag = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        above, inside, child, same = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        kinds: dict[tuple, int] = {}
        bag = np.zeros((n, TOKEN_BUCKETS))
        for k in range(n):
            tag[k] = _FIRST[self.tags[k]]
            bad, good = self.tags[k] in ("nav", "header", "footer", "aside", "form", "menu", "dialog"), self.tags[k] in ("article", "main")
            for token in self.tokens[k]:
                bad |= token in _AWAY_SET
                good |= token in _HERE_SET
                bag[k, zlib.crc32(token.encode()) % TOKEN_BUCKETS] = 1
            away[k], here[k] = bad, good
            if k:
                p = parents[k]
                depth[k], above[k] = depth[p] + 1, tag[p]
                inside[k] = inside[p] + 2 * here[p] if not away[p] else -1
                if inside[p] < 0:
                    inside[k] = -1
                child[p] += 1
                kinds[p, self.tags[k]] = kinds.get((p, self.tags[k]), 0) + 1
        for k in range(1, n):
            same[k] = kinds[parents[k], self.tags[k]]
        base = np.stack(
            [tag, above, depth, away, here, inside, np.log1p(own), np.log1p(whole), np.log1p(pieces), linked / (whole + 1), whole / under, dots / (whole + 1) * 100,
             whole / max(1.0, whole[0]), child, same, child[np.maximum(parents, 0)], whole / (whole[np.maximum(parents, 0)] + 1), np.arange(n) / n, whole / (count + 1)], 1)
        return np.concatenate([base, bag], 1)

    def text(self, keep: np.ndarray) -> str:
        return "\n".join(text for node, text in self.blocks if keep[node])

    def decode(self, chance: np.ndarray) -> np.ndarray:
        """Nodes kept by the likeliest choice in which a kept node has a kept parent."""
        n = len(self.tags)
        weight = np.ones(n)
        for node, text in self.blocks:
            weight[node] += len(text)
        chance = np.clip(chance, 1e-4, 1 - 1e-4)
        weight *= np.array([1.0 if w > 1 else 0.01 for w in weight])  # nodes without text of their own follow their subtree
        yes, no = weight * np.log(chance), weight * np.log(1 - chance)
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            yes[p] += max(yes[k], no[k])
            no[p] += no[k]
        keep = np.zeros(n, bool)
        keep[0] = yes[0] > no[0]
        for k in range(1, n):
            keep[k] = keep[self.parents[k]] and yes[k] > no[k]
        return keep


class Boosting:
    """Gradient-boosted trees with logistic loss on binned features; trees are full, splits kept as arrays."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k], side="left") for k, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosting:
        self.edges = []
        for k in range(rows.shape[1]):
            values = np.unique(rows[:, k])
            cuts = (values[1:] + values[:-1]) / 2
            self.edges.append(cuts if len(cuts) < BINS else np.unique(np.quantile(cuts, np.linspace(0, 1, BINS - 1))))
        used = [k for k, e in enumerate(self.edges) if len(e)]
        bins = self._binned(rows)
        share = np.clip(np.average(y, weights=weight), 0.01, 0.99) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        value = np.full(len(y), self.base)
        for _ in range(TREES if used else 0):
            p = 1 / (1 + np.exp(-value))
            grad, hess = weight * (y - p), weight * p * (1 - p) + 1e-9
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for k in used:
                    slot = (node - first) * BINS + bins[:, k]
                    g = np.bincount(slot, grad, width * BINS).reshape(width, BINS).cumsum(1)
                    h = np.bincount(slot, hess, width * BINS).reshape(width, BINS).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    gain[(h < LEAST / 100) | (ht - h < LEAST / 100)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + width][better] = k
                    cut[first : first + width][better] = at[better]
                node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**DEPTH - 1)
            out = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
            value += out[leaf]
            self.trees.append((feature, cut, out))
        return self

    def chances(self, rows: np.ndarray) -> np.ndarray:
        value = np.full(len(rows), self.base)
        if len(rows) and self.trees:
            bins, every = self._binned(rows), np.arange(len(rows))
            for feature, cut, out in self.trees:
                node = np.zeros(len(rows), np.int64)
                for _ in range(DEPTH):
                    node = 2 * node + 1 + (bins[every, feature[node]] > cut[node])
                value += out[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-value))


def own_labels(page: Page) -> np.ndarray:
    """Labels of a page as it is: inside its holder of the article and in nothing named as boilerplate.

    Holders are article and main elements. A page without text in any has one other: the element with the most text of
    its own and its children, where a name of `HERE` on it or above it counts threefold.
    """
    n = len(page.tags)
    lost, named, holder = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for k in range(1, n):
        p = page.parents[k]
        lost[k] = lost[p] or page.tags[k] in ("nav", "footer", "aside", "form", "menu", "dialog") or any(t in _AWAY_SET for t in page.tokens[k])
        named[k] = named[p] or any(t in _HERE_SET for t in page.tokens[k])
        holder[k] = page.tags[k] in ("article", "main")

    def under(holder: np.ndarray) -> np.ndarray:
        keep = holder & ~lost
        for k in range(1, n):
            keep[k] |= keep[page.parents[k]] and not lost[k]
        return keep

    keep = under(holder)
    if not any(keep[node] for node, _ in page.blocks):
        near = np.zeros(n)
        for node, text in page.blocks:
            if not lost[node]:
                near[node] += len(text)
                near[max(page.parents[node], 0)] += len(text) * (page.parents[node] >= 0)
        near *= np.where(lost, 0, np.where(named, 3, 1))
        if near.max() > 0:
            holder = np.zeros(n, bool)
            holder[near.argmax()] = True
            keep = under(holder)
    for k in range(n - 1, 0, -1):
        keep[page.parents[k]] |= keep[k]
    return keep


def variant(page: Page, draw: np.random.Generator) -> str | None:
    """The page's texts laid out in another template; text nodes carry `data-l`, 1 in the article and 0 elsewhere."""
    keep = own_labels(page)
    good = [t for n, t in page.blocks if keep[n]]
    spare = [w for n, t in page.blocks if not keep[n] for w in t.split()] or ["more"]
    if not good:
        return None

    def words(low: int, high: int) -> str:
        return entities.escape(" ".join(draw.choice(spare, draw.integers(low, high))))

    def prose() -> str:
        return entities.escape(good[draw.integers(len(good))][:400])

    def named(name: str) -> str:
        extra = draw.choice(["", " box", " block", "-wrap", " col-3"])
        return f'class="{name}{extra}"' if draw.random() < 0.8 else f'id="{name}"'

    def boiler() -> str:
        name, kind = str(draw.choice(AWAY)), draw.integers(7)
        if kind == 0:
            return "<nav><ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(draw.integers(3, 9))) + "</ul></nav>"
        if kind == 1:
            return f"<div {named(name)}><ul>" + "".join(f'<li><a href="#">{words(1, 6)}</a></li>' for _ in range(draw.integers(2, 8))) + "</ul></div>"
        if kind == 2:
            return f"<form {named(name)}><p>{words(3, 12)}</p><label>{words(1, 3)}</label></form>"
        if kind == 3:
            return f"<aside {named(name)}><h3>{words(1, 4)}</h3><p>{prose() if draw.random() < 0.5 else words(4, 30)}</p></aside>"
        if kind == 4:
            name = str(draw.choice(["comments", "comment-list", "discussion", "replies"]))
            return f'<section {named(name)}><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(draw.integers(1, 5))) + "</section>"
        tag = str(draw.choice(["div", "section", "p", "aside"]))
        body = words(3, 25) if draw.random() < 0.6 else prose()
        return f"<{tag} {named(name)}>{body}</{tag}>" if tag == "p" else f"<{tag} {named(name)}><p>{body}</p></{tag}>"

    parts = []
    for n, text in enumerate(good):
        tag = "h1" if n == 0 and draw.random() < 0.7 else str(draw.choice(["p", "p", "p", "p", "p", "h2", "li", "blockquote", "div", "pre"]))
        piece = f"<{tag}>{entities.escape(text)}</{tag}>"
        parts.append(f"<ul>{piece}</ul>" if tag == "li" else piece)
        if draw.random() < 0.08:
            parts.append(f'<b-oiler>{boiler()}</b-oiler>')
    holder = [("article", ""), ("main", ""), ("div", named(str(draw.choice(HERE)))), ("section", named(str(draw.choice(HERE)))), ("div", "")][draw.integers(5)]
    around = [f"<b-oiler>{boiler()}</b-oiler>" for _ in range(draw.integers(1, 6))]
    after = [f"<b-oiler>{boiler()}</b-oiler>" for _ in range(draw.integers(1, 5))]
    head = f"<b-oiler><header><p>{words(1, 5)}</p></header></b-oiler>" if draw.random() < 0.6 else ""
    foot = f"<b-oiler><footer><p>{words(3, 20)}</p></footer></b-oiler>" if draw.random() < 0.7 else ""
    return f"<body>{head}{''.join(around)}<{holder[0]} {holder[1]}>{''.join(parts)}</{holder[0]}>{''.join(after)}{foot}</body>"


def labelled_variant(source: str) -> tuple[Page, np.ndarray]:
    """The page of a variant and its labels: what stands between the marks of boilerplate is no article."""
    marked = Page(source.replace("<b-oiler>", '<div class="boilermark">').replace("</b-oiler>", "</div>"))
    lost = np.zeros(len(marked.tags), bool)
    for k in range(1, len(marked.tags)):
        lost[k] = lost[marked.parents[k]] or "boilermark" in marked.tokens[k]
    away = [k for k in range(len(marked.tags)) if "boilermark" in marked.tokens[k]]
    page = Page(source)
    keep = np.delete(~lost, away)
    text = {n for n, _ in page.blocks}
    under = np.zeros(len(page.tags), bool)
    for k in range(len(page.tags) - 1, -1, -1):
        under[k] |= k in text and keep[k]
        if k:
            under[page.parents[k]] |= under[k]
    return page, under


def train(sources: list[str | None], seed: int = 3) -> Boosting:
    """Trees from the pages as they are and from variants; without any text in an article nothing is kept."""
    draw = np.random.default_rng(seed)
    rows, labels, weights = [], [], []

    def take(page: Page, keep: np.ndarray) -> None:
        rows.append(page.features())
        labels.append(keep)
        weight = np.full(len(keep), 0.3)
        for node, text in page.blocks:
            weight[node] = 1 + min(1.0, len(text) / 200)
        weights.append(weight)

    for source in sources:
        page = Page(source)
        take(page, own_labels(page))
        for _ in range(VARIANTS):
            other = variant(page, draw)
            if other is not None:
                take(*labelled_variant(other))
    model = Boosting()
    if not rows:
        return model
    return model.fit(np.concatenate(rows), np.concatenate(labels).astype(float), np.concatenate(weights))


def main_texts(model: Boosting, sources: list[str | None]) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    rows = [p.features() for p in pages]
    chances = np.split(model.chances(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    return [p.text(p.decode(c)) for p, c in zip(pages, chances, strict=True)]


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per page: key, url, text (empty if there is none) and n_chars.

    Null and empty html give an empty text. Markup is cut as browsers do it: a quote delimits only after `=`, comments and
    tags that are never closed last to the end of the page, a `<` before anything else is text. Time grows with the length
    of a page, whatever stands in it. Pages that repeat come back as often as they came in.
    """
    drawn = pages.where(F.col(html).isNotNull()).orderBy(F.xxhash64(key, html), key).select(html).limit(sample).collect()
    model = train([r[0] for r in drawn])
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = main_texts(model, batch.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["key", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    made = rows.mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars bigint")
    return made.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))
