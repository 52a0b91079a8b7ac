"""HTML main text: gradient-boosted trees over DOM nodes with hierarchical decoding.

Pages are scanned and built into nodes in linear time, whatever they hold.
What a class or id says about a node is learned: each token of the training
pages' attributes has log odds of standing on an article's node, and a node's
own and inherited odds are features.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body button div fieldset figure footer form header html main nav section table td th".split())
LISTS = frozenset(("ul", "ol", "dl"))
#: Opening one of these closes an open one of its group.
GROUPS = {t: g for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",), ("p",)) for t in g}
#: Element kinds that become features, and those that say what is below them.
TAGS = "article main section div p h1 h2 h3 ul ol li a nav header footer aside form table figure blockquote pre button label span b body html head #text".split()
SEMANTIC = ("nav", "header", "footer", "aside", "form", "article", "main")
#: Elements that say nothing by themselves where they have one child and no attributes.
BARE = frozenset("#root html body div span section center main table tbody tr td".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_ENDS = {t: re.compile(f"</{t}", re.I) for t in RAW}


class Nodes:
    """The nodes of a page in page order, texts included, as columns.

    ``block`` is the nearest node at or above that is not inline.  Elements
    that close others by being opened look no further than the scopes that the
    open elements are counted in, so no step walks up past what it closes.
    """

    def __init__(self):
        self.tag, self.parent, self.text, self.tokens, self.depth, self.block, self.place, self.size = ["#root"], [-1], [""], [()], [0], [0], [0], [0]
        self.here = 0
        self._open = Counter()  # open elements of SCOPES
        self._frames = [("#root", Counter())]  # other open elements since each scope was opened
        self._near = [("#root", Counter())]  # the same, lists beginning anew as well

    def add(self, tag: str, text: str = "", tokens: tuple = ()) -> int:
        up, i = self.here, len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.text.append(text)
        self.tokens.append(tokens)
        self.depth.append(self.depth[up] + 1)
        self.block.append(self.block[up] if tag == "#text" or tag in INLINE else i)
        self.place.append(self.size[up])
        self.size.append(0)
        self.size[up] += 1
        return i

    def open(self, tag: str, tokens: tuple) -> None:
        self.here = self.add(tag, "", tokens)
        if tag in SCOPES:
            self._open[tag] += 1
            self._frames.append((tag, Counter()))
        else:
            self._frames[-1][1][tag] += 1
        if tag in SCOPES or tag in LISTS:
            self._near.append((tag, Counter()))
        else:
            self._near[-1][1][tag] += 1

    def _close_to(self, tags) -> None:
        """Closes open elements up to the first of ``tags``, which is open."""
        while True:
            tag = self.tag[self.here]
            self.here = self.parent[self.here]
            if tag in SCOPES or tag in LISTS:
                self._near.pop()
            else:
                self._near[-1][1][tag] -= 1
            if tag in SCOPES:
                self._open[tag] -= 1
                self._frames.pop()
            else:
                self._frames[-1][1][tag] -= 1
            if tag in tags:
                return

    def close(self, tag: str) -> None:
        """An end tag: closes its element, but for one of a scope none beyond a scope."""
        if self._open[tag] > 0 if tag in SCOPES else self._frames[-1][1][tag] > 0:
            self._close_to((tag,))

    def make_room(self, tag: str) -> None:
        """Closes what an element of this kind ends by being opened."""
        ends = {*GROUPS.get(tag, ()), *(("p",) if tag in CLOSES_P else ())}
        if not ends:
            return
        for barrier, inside in reversed(self._near):
            if any(inside[e] > 0 for e in ends) or barrier in ends:
                self._close_to(ends)
                return
            if not (barrier in ("td", "th") and tag in ("tr", "td", "th")):
                return


def parse(page: str) -> Nodes:
    """The nodes of any input; unclosed and stray tags are mended as browsers mostly do; raw elements
    (scripts, styles, the title) leave no text.  A tag or comment that never ends hides the rest, as in browsers."""
    nodes, at, quotes = Nodes(), 0, True

    def put(low, high):
        if high > low:
            nodes.add("#text", html.unescape(page[low:high]))

    start = 0
    while (at := page.find("<", at)) >= 0:
        second = page[at + 1 : at + 2]
        if second in ("!", "?"):
            put(start, at)
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + 4 if comment else at + 2)
            start = at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        name = _NAME.match(page, at + (2 if second == "/" else 1))
        if not name:
            at += 1
            continue
        put(start, at)
        rest = _REST.match(page, name.end()) if quotes else None
        if rest is None:
            # a quote that is open to the end of the page: from here on quotes don't count
            quotes, end = False, page.find(">", name.end())
            if end < 0:
                start = at = len(page)
                break
            attributes, at = page[name.end() : end], end + 1
        else:
            attributes, at = page[name.end() : rest.end() - 1], rest.end()
        start, tag = at, name[0].lower()
        if second == "/":
            nodes.close(tag)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = _ENDS[tag].search(page, at)
                close = page.find(">", end.end()) if end else -1
                start = at = close + 1 if close >= 0 else len(page)
            continue
        nodes.make_room(tag)
        tokens = tuple(t for a in _ATTR.findall(attributes) for t in _SPLIT.split(a.lower()) if t) if attributes else ()
        if tag in VOID or attributes.endswith("/"):
            nodes.add(tag, "", tokens)
        else:
            nodes.open(tag, tokens)
    put(start, len(page))
    return nodes


N_FEATURES = len(TAGS) + 23
_KIND = {t: k for k, t in enumerate(TAGS)}
#: Weight of the prior in a token's odds.
PRIOR = 2.0


def token_odds(pages: list[Nodes], labels: list[np.ndarray]) -> dict[str, float]:
    """Log odds of a token's nodes to hold article text, against that of all nodes with tokens, shrunk to 0."""
    good, bad = Counter(), Counter()
    for nodes, y in zip(pages, labels, strict=True):
        for tokens, keep in zip(nodes.tokens, y, strict=True):
            (good if keep else bad).update(set(tokens))
    base = (sum(good.values()) + 1) / (sum(bad.values()) + 1)
    return {t: float(np.log((good[t] + PRIOR * base / (1 + base)) / (bad[t] + PRIOR / (1 + base)) / base)) for t in good.keys() | bad.keys()}


def features(nodes: Nodes, odds: dict[str, float]) -> np.ndarray:
    """Node features: kind, learned odds of attribute tokens, own and inherited, depth, subtree size, density and links, siblings."""
    n, tag, parent = len(nodes.tag), nodes.tag, nodes.parent
    chars, links, tags, stops = ([0] * n for _ in range(4))
    for i in range(n - 1, -1, -1):
        if tag[i] == "#text":
            t = nodes.text[i].strip()
            chars[i], stops[i] = len(t), sum(map(t.count, ".,;!?"))
        else:
            tags[i] += 1
        if tag[i] == "a":
            links[i] = chars[i]
        p = parent[i]
        if p >= 0:
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            stops[p] += stops[i]
    bare = neutral(nodes)
    own, low, high, known, depth, above = ([0.0] * n for _ in range(6))
    kinds, last, before, after = defaultdict(Counter), [-1] * n, [0] * n, [0] * n
    for i in range(n):
        p = parent[i]
        found = [odds[t] for t in nodes.tokens[i] if t in odds]
        own[i], known[i] = sum(found), len(found)
        low[i], high[i] = min([low[p] if p >= 0 else 0.0, *found]), max([high[p] if p >= 0 else 0.0, *found])
        depth[i] = (depth[p] if p >= 0 else 0) + (not bare[i])
        above[i] = tag[i] if tag[i] in SEMANTIC else above[p] if p >= 0 else ""
        if p >= 0:
            kinds[p][tag[i]] += 1
            if last[p] >= 0:
                before[i], after[last[p]] = chars[last[p]], chars[i]
            last[p] = i
    total = max(1, chars[0])
    siblings = [nodes.size[p] if p >= 0 else 1 for p in parent]
    same = [kinds[p][t] if p >= 0 else 1 for p, t in zip(parent, tag, strict=True)]
    column = lambda x: np.asarray(x, np.float32)
    c, t, s = column(chars), column(tags), np.maximum(column(siblings), 1)
    out = np.zeros((n, N_FEATURES), np.float32)
    known_kind = [(i, _KIND[x]) for i, x in enumerate(tag) if x in _KIND]
    if known_kind:
        out[tuple(zip(*known_kind, strict=True))] = 1
    out[:, len(TAGS) :] = np.stack((
        column(own), column(low), column(high), column(known),
        *(column([x == k for x in above]) for k in SEMANTIC),
        np.minimum(column(depth), 30), np.log1p(c), c / np.maximum(t, 1), column(links) / np.maximum(c, 1), column(stops) / np.maximum(c, 1), c / total,
        np.minimum(s, 50), column(nodes.place) / s, np.minimum(column(nodes.size), 50),
        np.log1p(column(before)), np.log1p(column(after)), column(same) / s,
    ), 1)
    return out


def neutral(nodes: Nodes) -> list[bool]:
    """Wrappers that say nothing: one child, no attributes, of a bare kind."""
    return [size == 1 and not tokens and tag in BARE for size, tokens, tag in zip(nodes.size, nodes.tokens, nodes.tag, strict=True)]


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, with histogram splits."""

    def __init__(self, rounds=40, depth=4, rate=0.25, bins=32, least=20, penalty=1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], qs)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)
        rate = y.mean()
        self.start = float(np.log(rate / (1 - rate)))
        z, self.trees = np.full(len(y), self.start), []
        leaves = 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                width = 1 << level
                best = [(0.0, 0, np.inf)] * width
                for f in range(x.shape[1]):
                    if not len(self.edges[f]):
                        continue
                    k = len(self.edges[f]) + 1
                    code = node * k + binned[:, f]
                    gs, hs, cs = (np.bincount(code, w, width * k).reshape(width, k).cumsum(1) for w in (g, h, None))
                    gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(cs < self.least) | (ct - cs < self.least)] = 0
                    gain[:, -1] = 0
                    top = gain.argmax(1)
                    for i in range(width):
                        if gain[i, top[i]] > best[i][0] + 1e-9:
                            best[i] = (float(gain[i, top[i]]), f, float(self.edges[f][top[i]]))
                feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                tree.append((feature, cut))
                node = node * 2 + (x[np.arange(len(y)), feature[node]] > cut[node])
            value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty) * self.rate
            self.trees.append((tree, value))
            z += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = node * 2 + (x[rows, feature[node]] > cut[node])
            z += value[node]
        return z


# --- training pages -----------------------------------------------------------------

_SYLLABLES = "ta re mi son lo ka ve du en is or al the ing ed ion er an".split()
# Names that pages commonly give to their parts; what they mean is learned from where they stand.
NAMES = {
    "article": "article post entry story content main text body prose page article-body post-content entry-content story-body main-content page-content post-body article__text".split(),
    "menu": "menu nav navbar navigation main-nav site-nav topnav nav-menu menu-items breadcrumb breadcrumbs pagination toolbar".split(),
    "header": "header site-header masthead top topbar page-header branding".split(),
    "footer": "footer site-footer bottom colophon copyright legal footer-links".split(),
    "side": "sidebar side aside widget widgets widget-area rail right-column recommended related related-posts popular tags".split(),
    "advert": "ad ads advert adverts advertisement ad-slot ad-banner banner promo promotion sponsor sponsored sponsored-content popup".split(),
    "notice": "notice notices cookie cookies cookie-notice consent gdpr alert modal disclaimer paywall subscribe newsletter".split(),
    "comments": "comments comment comment-list replies reply respond discussion shoutbox responses".split(),
    "share": "share sharing social social-links follow-us share-buttons".split(),
}


def _prose(rng, words, stop=True):
    out = []
    for _ in range(words):
        out.append("".join(rng.choice(_SYLLABLES, rng.integers(1, 5))))
    text = " ".join(out).capitalize()
    return re.sub(r"(\w+ \w+ \w+ \w+ \w+ \w+) ", r"\1, ", text, count=words // 9) + ("." if stop else "")


def training_page(rng) -> tuple[str, list[tuple[str, int]]]:
    """A page of a random layout, and for each of its texts whether it belongs to the article."""
    parts, said = [], []

    def text(words, keep, stop=True):
        # stops say little: menus have some, articles' sentences lack some
        t = _prose(rng, words, stop if some(0.8) else not stop) + ("," if some(0.05) else "")
        said.append((t, keep))
        return t

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def some(p=0.5):
        return rng.random() < p

    def n(low, high):
        return int(rng.integers(low, high))

    def named(kind, p=1.0):
        """An attribute with a name or two of a kind, or none."""
        if not some(p):
            return ""
        return f' {pick("class", "class", "id")}="{" ".join(pick(*NAMES[kind]) for _ in range(pick(1, 1, 2)))}"'

    def menu(tag, attribute):
        items = "".join(f'<li><a href="/{i}">{text(n(1, 4), 0, False)}</a></li>' for i in range(n(2, 9)))
        return f"<{tag}{attribute}><ul>{items}</ul></{tag}>"

    def box(kind, tags=("div", "aside", "section")):
        tag = pick(*tags)
        inner = text(n(3, 60), 0) if some() else f"<p>{text(n(3, 60), 0)}</p>"
        return f"<{tag}{named(kind, 1.0 if tag != 'aside' else 0.5)}>{inner}</{tag}>"

    def form():
        return f'<form{named("notice", 0.3)}><label>{text(3, 0, False)}</label><input type="text"><button>{text(1, 0, False)}</button></form>'

    def comments():
        item = pick("li", "div", "article", "p")
        inner = "".join(f"<{item}{named('comments', 0.5)}>{'' if item == 'p' else '<p>'}{text(n(5, 50), 0)}</{item}>" for _ in range(n(1, 5)))
        tag = pick("section", "div", "ol")
        return f"<{tag}{named('comments')}>{'<h3>' + text(2, 0, False) + '</h3>' if some(0.3) else ''}{inner}</{tag}>"

    def deep(inner):
        wraps = n(1, 40) if some(0.1) else n(0, 4)
        return "<div>" * wraps + inner + "</div>" * wraps

    if some(0.5):
        parts.append(f'<header{named("header", 0.5)}><a href="/">{text(2, 0, False)}</a>{menu("nav", "") if some() else ""}</header>')
    if some(0.75):
        parts.append(menu(*pick(("nav", ""), ("nav", named("menu")), ("div", named("menu")), ("ul", named("menu")))))
    for kind in ("advert", "advert", "notice", "share"):
        if some(0.25):
            parts.append(box(kind))
    body = []
    if some(0.85):
        body.append(f'<{(h := pick("h1", "h1", "h2"))}>{text(n(2, 14), 1, False)}</{h}>')
    for _ in range(n(1, 14)):
        size, roll = int(rng.choice([1, 1, 2, 5, 15, 40, 90])), rng.random()
        if roll < 0.6:
            body.append(f"<p>{text(size, 1)}" + ("</p>" if some(0.8) else ""))
        elif roll < 0.72:
            body.append(f"<p><b>{text(size, 1)}" + pick("<br>", "</b></p>"))
        elif roll < 0.77:
            body.append(f"<h2>{text(4, 1, False)}</h2>")
        elif roll < 0.82:
            body.append("<ul>" + "".join(f"<li>{text(8, 1)}</li>" for _ in range(3)) + "</ul>")
        elif roll < 0.86:
            body.append(f'<p>{text(size, 1)} <a href="/x">{text(2, 1, False)}</a> {text(size, 1)}</p>')
        elif roll < 0.88:
            body.append(f"<blockquote>{text(size, 1)}</blockquote>")
        elif roll < 0.9:
            body.append(f'<figure><img src="/i.png"><figcaption>{text(6, 1)}</figcaption></figure>')
        elif roll < 0.92:
            body.append(f"<table><tr><td>{text(3, 1, False)}</td><td>{text(3, 1, False)}</td></tr></table>")
        else:
            body.append(pick(lambda: box(pick("advert", "share", "side", "notice")), form, lambda: menu("div", named("share")), lambda: menu("div", named("side")))())
    if some(0.15):
        body.append(comments())
    inner = "".join(body)
    tag = pick("div", "section", "main")
    parts.append(deep(pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article{named('article')}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<{tag}{named('article')}>{inner}</{tag}>", f"<div{named('article')}><div{named('article')}>{inner}</div></div>", f"<div><div>{inner}</div></div>", f"<div>{inner}</div>", f'<table><tr><td>{menu("div", named("menu"))}</td><td>{inner}</td></tr></table>')))
    if some(0.25):
        parts.append(comments())
    if some(0.3):
        parts.append(box("side", ("aside", "div")) if some() else menu("aside", named("side", 0.5)))
    if some(0.15):
        parts.append(form())
    if some(0.85):
        t = pick("footer", "footer", "div")
        parts.append(f"<{t}{named('footer', 0.3 if t == 'footer' else 1.0)}>{pick('&copy; ', '')}{text(n(2, 25), 0)}</{t}>")
    if some(0.07):  # nothing but the article
        kept = [(x, keep) for x, keep in said if keep]
        inner = pick("<p>{}</p>", "<div>{}</div>", "{}<br>")
        parts, said = [deep("".join(inner.format(x) for x, _ in kept))], kept
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>x</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{"".join(parts)}</body></html>'
    return page, said


def labels(nodes: Nodes, said: list[tuple[str, int]]) -> np.ndarray:
    """1 for article texts and what holds one, by what was said of each text."""
    wanted, out = dict(said), np.zeros(len(nodes.tag), int)
    for i in range(len(nodes.tag) - 1, -1, -1):
        if nodes.tag[i] == "#text" and wanted.get(nodes.text[i].strip().removeprefix("© ")):
            out[i] = 1
        if out[i] and nodes.parent[i] >= 0:
            out[nodes.parent[i]] = 1
    return out


#: Pages of the training sample and their seed: the bound of what the classifier is fitted on.
TRAINING_PAGES, SEED = 600, 5


@functools.cache
def model() -> tuple[Boosted, dict[str, float]]:
    """(trees, odds of attribute tokens).  Each half of the sample takes its odds from the other, as unseen pages would."""
    rng = np.random.default_rng(SEED)
    pages, ys = [], []
    for _ in range(TRAINING_PAGES):
        page, said = training_page(rng)
        nodes = parse(page)
        pages.append(nodes)
        ys.append(labels(nodes, said))
    half = TRAINING_PAGES // 2
    other = [token_odds(pages[half:], ys[half:])] * half + [token_odds(pages[:half], ys[:half])] * (TRAINING_PAGES - half)
    x = np.concatenate([features(p, o) for p, o in zip(pages, other, strict=True)])
    return Boosted().fit(x, np.concatenate(ys).astype(float)), token_odds(pages, ys)


# --- decoding ----------------------------------------------------------------------


def decode(nodes: Nodes, z: np.ndarray) -> list[bool]:
    """The most probable choice in which a kept node's ancestors are kept and a dropped one's descendants dropped.

    Bottom-up: dropping a node drops its subtree; keeping it leaves its children
    free.  Top-down, the better of the two is taken.  Wrappers that say nothing
    (``neutral``) cost nothing either way, so no depth of them hides a text.
    """
    n = len(nodes.tag)
    free = np.array(neutral(nodes))
    keep = np.where(free, 0.0, -np.logaddexp(0, -z)).tolist()
    drop = np.where(free, 0.0, -np.logaddexp(0, z)).tolist()
    for i in range(n - 1, 0, -1):
        p = nodes.parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    out = [False] * n
    for i, p in enumerate(nodes.parent):
        out[i] = (p < 0 or out[p]) and keep[i] >= drop[i]
    return out


def blocks(nodes: Nodes, kept: list[bool]) -> str:
    """Kept texts in page order: inline elements join, block elements and line breaks part, by one space."""
    out, last = [], -1
    for tag, text, parent, block, keep in zip(nodes.tag, nodes.text, nodes.parent, nodes.block, kept, strict=True):
        if tag == "br":
            out.append(" ")
        if tag != "#text" or not keep:
            continue
        if last >= 0 and block != last:
            out.append(" ")
        out.append(text)
        last = block
    return " ".join("".join(out).split())


def extract(pages: list[str | None], fitted: tuple[Boosted, dict[str, float]]) -> list[str]:
    trees, odds = fitted
    parsed = [parse(p or "") for p in pages]
    sizes = np.cumsum([0] + [len(n.tag) for n in parsed])
    if not len(parsed):
        return []
    z = trees.predict(np.concatenate([features(n, odds) for n in parsed]))
    return [blocks(n, decode(n, z[a:b])) for n, a, b in zip(parsed, sizes, sizes[1:], strict=False)]


SCHEMA = "page_id long, url string, text string, n_chars long"
#: Pages, and characters of pages, that are read together; one page may be longer.
TOGETHER, TOGETHER_CHARS = 256, 1 << 22


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, one row per row.

    Null or empty html, and pages without an article, give an empty text; any
    input parses, in time linear in its length.  Of choices equally probable a
    node is kept.  Repeated rows each give a row; other columns are ignored.
    """
    fitted = model()
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            at, html_of = 0, batch.column(2).to_pylist()
            while at < batch.num_rows:
                stop, chars = at, 0
                while stop < batch.num_rows and stop < at + TOGETHER and (stop == at or chars < TOGETHER_CHARS):
                    chars += len(html_of[stop] or "")
                    stop += 1
                part, texts = batch.slice(at, stop - at), extract(html_of[at:stop], fitted)
                at = stop
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
