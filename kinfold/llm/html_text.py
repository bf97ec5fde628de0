"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Each word scores by its context, the element that says most about it,
and each tag scores below zero; weights are log-odds of lying in the main text, counted over labelled pages. One linear
scan finds the contiguous region with the greatest sum. Inside it, runs whose context scores below zero (an advert
between paragraphs) are left out, the rest is cut into blocks at block elements.

Labelled pages are (html, text) pairs: a few written here, for constructs that a corpus may lack, and a bounded sample
of pages of which the text is known (`MAX_FIT_PAGES`).

Contexts are the names of elements that often stand apart (a sidebar, a comment), within an article or outside of one,
and the tags of blocks. A name that wraps an article, or all words of a page, is none. On a page without an article neither is a name
that a page's own box may bear (a form around it all), if it wraps most of the words that stand in no footer, menu,
comment or other such name: how long those are never counts for them. What a context says is learned like all else: a
heading in an article's header is main text if labelled pages hold such ones.

Defined results: null, empty or blank html and pages without any positive word give an empty text; broken or missing
end tags are closed by their parents; script, style and comments end at their own end or at the page's; a tag without an
end is dropped with what follows; every row gives a row, repeated rows and null ids too; further columns are not read; of
regions with equal sums the first, shortest wins. Parsing and scanning are linear in the page, however broken it is.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FIT_PAGES = 400
#: Runs that are left out of the region anyhow part it less: what an advert or an aside of any length costs by the word.
LEFT_OUT = 0.02

_tag = re.compile(r"<(/)?([a-zA-Z][^\s/>]*)")
#: The rest of a tag up to its end. A quote opens a value right behind an equals sign only; any other is part of a name. Possessive, so
#: that a failure costs one pass; of quotes that never end there is one of each kind at most.
_rest = re.compile(r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>")
_attr = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_piece = re.compile(r"[A-Za-z]+")
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements whose content is no text of the page.
RAW = frozenset("script style title textarea noscript template svg iframe".split())
_raw_end = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
# Elements and names in class, id or role whose words are a context of their own; the learned weights decide what it says.
APART = frozenset("nav footer aside form header menu button select dialog head".split())
NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split())

# Names that a page's own box may bear, and words that make a class tell of a state (comments-open, has-sidebar) instead of a place.
SOFT = frozenset("form hidden search tags widget".split())
STATE = frozenset("allowed closed disabled enabled has no off on open with without".split())

# Labelled pages: the text between the brackets of each is main text.
_FRAMES = (
    "<body><header class='masthead'><h1>Site name here</h1><form><input><button>Go now</button></form></header><nav><ul><li><a>Home</a></li><li><a>News</a></li><li><a>About us</a></li></ul></nav><main><article>{}</article><aside class='sidebar'><h3>Most read</h3><ul><li><a>Other story one</a></li><li><a>Other story two</a></li></ul></aside></main><footer><p>All rights reserved by us</p></footer></body>",
    "<body><div id='header'><a>Our site</a></div><div class='menu'><a>One</a><a>Two</a><a>Three</a></div><div class='cookie notice'><p>We use cookies on this site</p><button>Accept</button></div><div class='content'>{}</div><div class='ad'>Buy this thing today</div><div class='related'><p>You may also like this</p></div><div id='comments'><h3>Comments</h3><div class='comment'><p>First reader says something here at length</p></div><div class='comment'><p>Second reader does not agree with that</p></div></div><div class='footer'>Imprint and contact</div></body>",
    "<body><ul class='breadcrumb'><li><a>Top</a></li><li><a>Section</a></li></ul><section>{}</section><section class='comments'><p>What a reader wrote about it yesterday</p></section><div class='share social'><a>Share</a><a>Post</a></div><form><label>Your mail</label><input><select><option>Daily</option></select></form><div class='newsletter signup'><p>Get our letter every week</p></div><footer><ul><li><a>Terms</a></li><li><a>Privacy</a></li></ul></footer></body>",
    "<body class='has-sidebar'><form id='page-form'><div class='sidebar'><p>Things that stand at the side</p></div><div class='content-sidebar-wrap'><article><div class='article-header'>{}</div></article></div><div class='footer-links'><a>Imprint</a></div></form></body>",
)
_BODIES = (
    "<h1>[A plain heading]</h1><p>[Some first words of the story with <a>a link</a> and more of it.]</p><p>[The second part tells what happened after that, in some detail.]</p>",
    "<h2>[What it is]</h2><p>[Long enough to be read as prose and not as a list.]</p><div class='ad'>Cheap flights now</div><ul><li>[the first point of the list]</li><li>[the second point of the list]</li></ul><blockquote>[As somebody said in so many words.]</blockquote><p>[And so it ends after all of that.]</p>",
    "<h1>[Table of results]</h1><p>[Before the table stands this line.]</p><table><tr><th>[name]</th><td>[value of the name]</td></tr></table><pre>[code as it is typed]</pre><dl><dt>[term]</dt><dd>[what the term means here]</dd></dl><figure><figcaption>[What the picture shows]</figcaption></figure><h3>[Last part]</h3><p>[Closing words that sum it all up once more.]</p>",
    "<header><h1>[The heading of it all]</h1><p class='byline'>By a writer today</p></header><div class='article-header'><h2>[A second line of heading]</h2></div><p>[What is told first is told at some length.]</p><div class='search-results'><p>[Prose that stands in a box of its own.]</p></div><aside>Do not miss this</aside><p>[And the rest of it is told here.]</p>",
)


def labelled_frames() -> list[tuple[str, str]]:
    out = []
    for frame in _FRAMES:
        for body in _BODIES:
            if "header" in body and "<article" not in frame:
                continue  # a header is part of the text inside an article only
            text = "\n".join(re.sub(r"<[^>]*>", "", m) for m in re.findall(r"\[(.*?)\]", body))
            out.append((frame.format(re.sub(r"[\[\]]", "", body)), text))
    return out


class Element:
    """An open element: its tag, its own name as a context, what encloses it, how many words it holds, how many of them outside of
    names that are not SOFT, and whether an article or main element stands in it."""

    __slots__ = ("tag", "name", "parent", "block", "words", "own", "holds_main", "context")

    def __init__(self, tag: str, name: str, parent: Element | None):
        self.tag, self.name, self.parent, self.words, self.own, self.holds_main = tag, name, parent, 0, 0, False
        self.block = self if tag in BLOCK else parent.block if parent else None
        self.context: tuple[str, bool] | None = None


def _name_of(tag: str, attrs: str) -> str:
    """An element that stands apart by its tag, or by a class, id or role that is, starts or ends with one of NAMES."""
    if tag in APART:
        return f"in:{tag}"
    if attrs and tag not in ("html", "body", "article", "main"):
        for a in _attr.finditer(attrs):
            for word in (a[1] or a[2] or a[3] or "").lower().split():
                pieces = _piece.findall(word)
                for p in (pieces[-1:] + pieces[:1]) if pieces and not STATE.intersection(pieces) else ():
                    if p in NAMES:
                        return f"name:{p}"
    return ""


def _soft(name: str) -> bool:
    return name == "" or name.rpartition(":")[2] in SOFT


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, rest) of a page, in one pass: text, open, close or raw; rest is the text or the attributes. A quote that never
    ends is none; a tag that never ends is dropped with what follows, as browsers do."""
    at, look, n, quoted = 0, 0, len(page), True
    while at < n:
        lt = page.find("<", look)
        m = _tag.match(page, lt) if lt >= 0 else None
        if lt >= 0 and m is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            look = lt + 1  # a sign of the text
            continue
        if lt != at:
            yield "text", "", page[at : lt if lt >= 0 else n]
            if lt < 0:
                return
        if m is None:
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 4) if comment else page.find(">", lt)
            at = look = n if end < 0 else end + (3 if comment else 1)
            continue
        rest = _rest.match(page, m.end()) if quoted else None
        if rest is None:  # from no later tag would the end be found with quotes observed
            quoted = False
            end = page.find(">", m.end())
            if end < 0:
                return
        else:
            end = rest.end() - 1
        tag, attrs = m[2].lower(), page[m.end() : end]
        at = look = end + 1
        if m[1]:
            yield "close", tag, ""
        elif tag in RAW and not attrs.endswith("/"):
            yield "raw", tag, ""
            stop = _raw_end[tag].search(page, at)
            at = look = n if stop is None else stop.end()
        else:
            yield "open", tag, attrs


def parse(page: str) -> list[tuple[str, str | None, int]]:
    """The sequence of (key, text, block): text is None for tags, block the number of the block that a run lies in. The key of a
    run is its context: the innermost name that encloses it, within an article or not, or else its block's tag. A name
    does not count if its element is a wrapper (see above)."""
    out: list[tuple[str | Element, str | None, int]] = []
    top = Element("", "", None)
    opened: Counter[str] = Counter()
    block = 0

    def close() -> None:
        nonlocal top
        opened[top.tag] -= 1
        top.parent.words += top.words
        top.parent.own += top.own if _soft(top.name) or top.holds_main or top.tag in ("article", "main") else 0
        top.parent.holds_main |= top.holds_main or top.tag in ("article", "main")
        top = top.parent

    for kind, tag, rest in _tokens(page):
        if kind == "text":
            text = html.unescape(rest)
            n = len(text.split())
            top.words, top.own = top.words + n, top.own + n
            out.append((top, text, block))
            continue
        if kind == "raw":
            out.append((f"<{tag}>", None, block))
            continue
        block += tag in BLOCK
        if tag == "br":
            out.append((top, " ", block))
        out.append((f"<{'/' if kind == 'close' else ''}{tag}>", None, block))
        if kind == "close":
            if opened[tag] > 0:
                while top.tag != tag:
                    close()
                close()
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            if tag in ("p", "li", "dd", "dt", "tr", "td", "th") and top.block is not None and top.block.tag == tag:
                last = top.block  # such an element ends where the next one begins
                while top is not last:
                    close()
                close()
            elif tag == "option" and top.tag == tag:
                close()
            opened[tag] += 1
            top = Element(tag, _name_of(tag, rest), top)
    while top.parent is not None:
        close()
    total, own, has_main = top.words, top.own, top.holds_main

    def wraps(e: Element) -> bool:
        return e.holds_main or e.words == total or (not has_main and e.name != "" and _soft(e.name) and 2 * e.own > own)

    def context(e: Element) -> tuple[str, bool]:
        """The innermost name that counts and whether an article encloses the element, from the outside in."""
        path = []
        while e is not None and e.context is None:
            path.append(e)
            e = e.parent
        at = ("", False) if e is None else e.context
        for e in reversed(path):
            if e.tag in ("article", "main"):
                at = ("", True)
            elif e.name and not wraps(e):
                at = (e.name, at[1])
            e.context = at
        return at

    keyed = []
    for key, text, k in out:
        if text is not None:
            name, within = context(key)
            key = f"{name}{' within' if within else ''}" if name else f"tag:{key.block.tag if key.block else ''}"
        keyed.append((key, text, k))
    return keyed


def _apart(key: str) -> bool:
    return key.startswith(("in:", "name:"))


class Weights:
    """Log-odds of contexts and tags, counted over labelled pages. What was never seen counts by its kind: apart and named
    contexts against, other words for, tags lightly against."""

    def __init__(self, pages: list[tuple[str, str]]):
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for page, text in pages:
            lines = {" ".join(x.split()) for x in (text or "").split("\n")}
            known = " ".join((text or "").split())
            runs: dict[int, list[tuple[str, str]]] = {}
            for key, run, block in parse(page or ""):
                if run is None:
                    outside[key] += 1
                else:
                    runs.setdefault(block, []).append((key, run))
            for block in runs.values():
                whole = " ".join("".join(t for _, t in block).split())
                # a block is main text if the labelled text holds it; one of a word or two also stands elsewhere by chance
                held = whole in known if whole.count(" ") >= 2 else whole in lines
                for key, run in block:
                    (inside if held else outside)[key] += len(run.split())
        total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
        self.of = {}
        for key in {*inside, *outside}:
            if key.startswith("<"):
                # a tag costs more the more of them stand outside for each word inside
                self.of[key] = -min(2.0, 0.02 + 20 * outside[key] / (total_in + 50 * len(pages)) * (0.1 if key.strip("</>") in ("p", "b", "br") else 1))
            elif inside[key] + outside[key]:
                odds = math.log((inside[key] + 0.5) / total_in) - math.log((outside[key] + 0.5) / total_out)
                self.of[key] = max(-3.0, min(1.0, odds))

    def __call__(self, key: str) -> float:
        w = self.of.get(key)
        if w is None:
            w = -1.0 if _apart(key) else -0.1 if key.startswith("<") else 0.5
        return w


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """(start, end) of the contiguous region with the greatest positive sum, in one pass; of equal sums the first, and from a
    start the shortest. (0, 0) if no score is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def token_scores(tokens: list[tuple[str, str | None, int]], weights: Weights) -> Iterator[float]:
    """A tag's weight, or a run's weight for each of its words. Runs in contexts that count against are left out of the region
    anyhow, so they part it less."""
    for key, text, _ in tokens:
        w = weights(key)
        yield w if text is None else w * len(text.split()) * (LEFT_OUT if w < 0 and _apart(key) else 1)


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    tokens = parse(page or "")
    blocks: dict[int, list[str]] = {}
    for key, text, block in tokens[slice(*best_region(token_scores(tokens, weights)))]:
        if text is not None and weights(key) > 0:
            blocks.setdefault(block, []).append(text)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def known_text(pages: DataFrame, documents: DataFrame, limit: int = MAX_FIT_PAGES) -> list[tuple[str, str]]:
    """Pages of which documents holds the text, under the number that ends the page's url; at most `limit` page ids,
    those with the least hash, each with one page and one text. The bound makes their broadcast one."""
    number = F.regexp_extract("url", r"/(\d+)(?:[/?#].*)?$", 1)
    some = pages.where((number != "") & F.col("html").isNotNull()).select("page_id", "html", number.try_cast("long").alias("doc_id")).where("page_id is not null and doc_id is not null")
    ids = some.groupBy("page_id").agg(F.min("doc_id").alias("doc_id")).orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    page = some.join(F.broadcast(ids), ["page_id", "doc_id"]).groupBy("page_id", "doc_id").agg(F.min("html").alias("html"))
    wanted = F.broadcast(ids.select("doc_id").distinct())
    texts = documents.select("doc_id", "text").where("text is not null").join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = page.join(texts, "doc_id").select("page_id", "html", "text").orderBy("page_id").collect()
    # a label counts if nearly all of its words stand in the page
    share = lambda r: sum((Counter(r.text.split()) & Counter(html.unescape(re.sub("<[^>]*>", " ", r.html)).split())).values()) / max(1, len(r.text.split()))
    return [(r.html, r.text) for r in rows if share(r) >= 0.95]


def fit(labelled: list[tuple[str, str]] | None = None) -> Weights:
    return Weights(labelled_frames() + (labelled or []))


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [extract(x, weights) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": np.array([len(t) for t in text], dtype=np.int64)})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
