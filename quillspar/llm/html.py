"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only

#: Quotes are quotes after an equals sign alone.
_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)*)(?:>|\Z))""", re.S)
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style noscript template title textarea select button iframe svg canvas object audio video math datalist".split())
_RAW = frozenset("script style noscript textarea title iframe noframes xmp template svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr area base col embed input link meta param source track map".split())
_CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PEERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
_KINDS = ("nav", "header", "footer", "aside", "form", "article", "section", "div", "p", "heading", "li", "list", "table", "quote", "figure", "body")
_KIND = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "fieldset": 4, "dialog": 4, "article": 5, "main": 5, "section": 6, "div": 7, "p": 8, "li": 10, "dt": 10, "dd": 10, "ul": 11, "ol": 11, "dl": 11, "table": 12, "tbody": 12, "thead": 12, "tr": 12, "td": 12, "th": 12, "blockquote": 13, "pre": 13, "figure": 14, "figcaption": 14, "body": 15, "html": 15, "#page": 15} | {f"h{i}": 9 for i in range(1, 7)}
_WORDS = {
    "menu": r"nav|navbar|navigation|menu|menubar|breadcrumbs?|topbar|toolbar|tabs?|pagination|pager|toc|skip|sitemap",
    "head": r"header|masthead|branding|logo|site-?title|topper",
    "foot": r"footer|foot|copyright|colophon|legal|imprint|credits",
    "side": r"sidebar|side|aside|widgets?|rail|complementary|column-?right|blogroll",
    "advert": r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|doubleclick|outbrain|taboola|affiliate",
    "notice": r"cookies?|consent|gdpr|notices?|alerts?|notification|popup|modal|overlay|newsletter|paywall|dialog|disclaimer|toast|subscribe|subscription",
    "form": r"form|search|login|signin|signup|register|contact",
    "comment": r"comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|reviews?|guestbook|feedback|responses?",
    "share": r"share|sharing|social|follow|related|recommended|more|trending|popular|tags?|author-?box|byline|meta|recirc\w*|read-?next",
    "main": r"article|articlebody|content|post|entry|story|main|text|body|copy|prose|document|page-?content|blog-?post|news",
}
_CUES = (*_WORDS, "hidden")
_CUE = [re.compile(rf"(?:^|[^a-z])(?:{w})(?:[^a-z]|$)") for w in _WORDS.values()]
_CAMEL = re.compile(r"([a-z])([A-Z])")
MAX_DEPTH = 512


@lru_cache(50_000)
def _cues(attributes: str) -> tuple[int, ...]:
    """For an element's attributes, which cue words its class, id, role, itemprop or label has, and last whether it is hidden."""
    names, hidden = [], 0
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component", "data-testid"):
            names.append(_CAMEL.sub(r"\1-\2", unescape(value)).lower())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = 1
    joined = " ".join(names).replace("_", "-")
    return (*(int(c.search(joined) is not None) for c in _CUE), hidden) if joined else (0,) * len(_CUE) + (hidden,)


class Page:
    """The block elements of a page in order, and the text runs that lie in them.

    Inline elements belong to the block around them. Missing end tags are supplied where HTML lets them be left out; an
    end tag that matches nothing open is ignored; elements of any depth are kept, the depth feature alone ends at MAX_DEPTH. Text hidden by an attribute or a
    style is kept: that an element is hidden is a feature of its node.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.cues = ["#page"], [-1], [0], [_cues("")]
        self.runs: list[tuple[int, str, int]] = []  # (node, text, characters in links)
        stack, text, links, open_links, gone = [(0, "#page")], [], 0, 0, 0
        at, n, lowered = 0, len(html), None

        def flush() -> None:
            nonlocal links
            if text:
                run = " ".join("".join(text).split())
                if run and not gone:
                    self.runs.append((stack[-1][0], run, links))
                text.clear()
            links = 0

        def say(piece: str) -> None:
            nonlocal links
            if piece and not gone:
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if open_links:
                    links += len(piece.strip())

        places: dict[str, list[int]] = {}  # rising stack heights of the open elements of a name, so that a tag's work doesn't grow with the depth

        def nearest(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close(k: int) -> None:
            for _, t in stack[k:]:
                places[t].pop()
            del stack[k:]

        hidden: list[int] = []  # stack heights at which a hidden element was opened
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                say(html[at:])
                break
            say(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    open_links = 0
                elif tag == "p" and not places.get("p"):
                    flush()
                elif tag not in _INLINE:
                    k = nearest((tag,))
                    if k:
                        flush()
                        close(k)
                        open_links = 0
                        while hidden and hidden[-1] >= len(stack):
                            hidden.pop()
                        gone = len(hidden)
                continue
            if tag in _INLINE:
                if tag == "a":
                    open_links = 1
                elif tag == "br" and not gone:
                    text.append("\n")
                continue
            if tag in ("svg", "math") and _CLOSED.search(m[3]):
                continue
            if tag == "head":  # what a head may hold has no text, and its end tag may be left out
                continue
            if tag in _RAW:
                lowered = html.lower() if lowered is None else lowered
                end = lowered.find(f"</{tag}", at)
                at = n if end < 0 else end
                continue
            flush()
            if tag == "hr":
                continue
            if tag in _CLOSES_P:
                k = nearest(("p",))
                if k > nearest(("table", "td", "th", "li", "article", "section", "div", "aside", "blockquote")):
                    close(k)
            if tag in _PEERS:
                peers, within = _PEERS[tag]
                while (k := nearest(peers)) > nearest(within):
                    close(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            open_links = 0
            while hidden and hidden[-1] >= len(stack):
                hidden.pop()
            if tag in _DROPPED:
                hidden.append(len(stack))
            gone = len(hidden)
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1][0])
            self.depths.append(min(len(stack), MAX_DEPTH))
            self.cues.append(_cues(m[3]))
            places.setdefault(tag, []).append(len(stack))
            stack.append((node, tag))
        flush()

    def features(self) -> np.ndarray:
        """A row per node; see FEATURE_NAMES."""
        n = len(self.tags)
        parent = np.array(self.parents)
        kinds = np.zeros((n, len(_KINDS)))
        kinds[np.arange(n), [_KIND.get(t, 7) for t in self.tags]] = 1
        cues = np.array(self.cues, dtype=np.float64)
        own, linked, words, marks = (np.zeros(n) for _ in range(4))
        for node, run, links in self.runs:
            own[node] += len(run)
            linked[node] += min(links, len(run))
            words[node] += run.count(" ") + 1
            marks[node] += run.count(". ") + run.count(",") + run.endswith((".", "!", "?"))
        total, link_total, nodes, mark_total, above = own.copy(), linked.copy(), np.ones(n), marks.copy(), np.hstack((kinds[:, :6], cues))
        for k in range(n - 1, 0, -1):
            p = parent[k]
            total[p] += total[k]
            link_total[p] += link_total[k]
            nodes[p] += nodes[k]
            mark_total[p] += mark_total[k]
        inherited = np.zeros_like(above)
        children, rank, length = np.zeros(n), np.zeros(n), np.zeros(n)
        for k in range(1, n):
            p = parent[k]
            inherited[k] = np.maximum(inherited[p], above[p])
            rank[k] = children[p]
            children[p] += 1
            length[p] += total[k]
        up = np.maximum(parent, 0)
        shape = np.column_stack((
            np.array(self.depths), np.log1p(own), np.log1p(total), link_total / np.maximum(1, total), np.log1p(nodes), np.log1p(total / nodes), np.log1p(words), mark_total / np.maximum(1, total) * 100,
            children[up], rank / np.maximum(1, children[up]), np.log1p(length[up] / np.maximum(1, children[up])), total / max(1, total[0]), np.arange(n) / n, children,
        ))
        return np.hstack((kinds, cues, inherited, shape))


FEATURE_NAMES = [f"is_{k}" for k in _KINDS] + [f"cue_{c}" for c in _CUES] + [f"in_{k}" for k in _KINDS[:6]] + [f"under_{c}" for c in _CUES] + ["depth", "own", "subtree", "link_share", "nodes", "density", "words", "marks", "siblings", "place", "sibling_length", "page_share", "order", "children"]


class BoostedTrees:
    """Gradient-boosted regression trees for the log odds of a class, on binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        coded, width, d = self._code(x), self.bins + 1, x.shape[1]
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, self.models = np.full(len(y), self.base), []
        offsets = np.arange(d) * width
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            inner = (1 << self.depth) - 1
            feature, cut, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, width, dtype=np.int64), np.zeros(1 << self.depth)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                slot = ((at - first)[:, None] * d * width + offsets + coded).ravel()
                size = count * d * width
                gs = np.bincount(slot, np.repeat(g, d), size).reshape(count, d, width).cumsum(axis=2)
                hs = np.bincount(slot, np.repeat(h, d), size).reshape(count, d, width).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = -1
                best = gain.reshape(count, -1).argmax(axis=1)
                good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
                feature[first : first + count] = np.where(good, best // width, 0)
                cut[first : first + count] = np.where(good, best % width, width)
                at = 2 * at + 1 + (coded[np.arange(len(y)), feature[at]] > cut[at])
            at -= inner
            gs, hs = np.bincount(at, g, 1 << self.depth), np.bincount(at, h, 1 << self.depth)
            leaf = self.rate * gs / (hs + 1)
            self.models.append((feature, cut, leaf))
            score += leaf[at]
        return self

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)]).astype(np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        coded, out, rows = self._code(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.models:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (coded[rows, feature[at]] > cut[at])
            out += leaf[at - ((1 << self.depth) - 1)]
        return out


def decode(parents: list[int], odds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the choice of largest weighted log likelihood among those where a node's descendants go if it goes."""
    gain = np.maximum(-np.logaddexp(0, -odds), -60.0) * weights
    loss = np.maximum(-np.logaddexp(0, odds), -60.0) * weights
    below_gone, below_best = np.zeros(len(odds)), np.zeros(len(odds))
    keep = np.zeros(len(odds), dtype=bool)
    for k in range(len(odds) - 1, -1, -1):
        stay, go = gain[k] + below_best[k], loss[k] + below_gone[k]
        keep[k] = stay > go
        if k:
            below_best[parents[k]] += max(stay, go)
            below_gone[parents[k]] += go
    for k in range(1, len(odds)):
        keep[k] &= keep[parents[k]]
    return keep


def main_text(page: Page, odds: np.ndarray) -> str:
    own = np.zeros(len(page.tags))
    for node, run, _ in page.runs:
        own[node] += len(run)
    keep = decode(page.parents, odds, 0.5 + np.log1p(own))
    return "\n\n".join(run for node, run, _ in page.runs if keep[node])


def extract_main(df: DataFrame, model: BoostedTrees, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row (id, text): the text runs of the kept blocks in page order, white space made single, joined by two newlines.

    Null, empty and textless pages give ''. Cut-off pages are read to their end; repeated rows are judged alike; an empty table gives no
    rows; only the two named columns are read.
    """
    pages = only(df, id=id_col, html=html_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [Page(h.as_py() or "") for h in part.column("html")]
                x = np.vstack([p.features() for p in parsed])
                odds = np.split(shared.value.predict(x), np.cumsum([len(p.tags) for p in parsed])[:-1])
                texts = [main_text(p, o) for p, o in zip(parsed, odds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return pages.mapInArrow(run, f"id {dict(pages.dtypes)['id']}, text string")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pagemaker import train

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extract_main(pages.withColumn("key", F.struct("page_id", "url")), train(), "key")
    return found.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))
