"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by the word count and link
density of its own, of the block before and of the one after, and by the containers it lies in: within the
page's article or main element, outside of it, in an element that is never part of an article (nav, footer, form ...),
and, weakly, how much of its containers' names speaks of such a part. A decision tree, grown at start-up from
the labelled table below, tells article text from the rest.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never text, inline elements, and container words.
SILENT = "script style noscript template svg math iframe object embed canvas audio video select textarea button head title dialog map datalist".split()
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
MAIN_TAGS = "article main".split()
ASIDE_TAGS = "nav footer aside form menu header".split()
ASIDE_WORDS = "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs footer header masthead sidebar aside cookie cookies consent notice popup modal newsletter subscribe social share sharing related comment comments disqus reply replies respond widget toolbar pager pagination login signup form copyright".split()
ASIDE_ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
# Words that name the article itself, and words about layout that say nothing.
MAIN_WORDS = "article articles body content entry main page post posts stories story text".split()
LAYOUT_WORDS = "area block bottom box col column container inner item items left list outer right row section top wrap wrapper".split()

FEATURES = "words links prev_words prev_links next_words next_links main outside aside named heading".split()
# The labelled table: one block per line, features in the order above, then 1 for article text.
LABELLED = """
45 0.00 40 0.00 50 0.00 1 0 0 0.00 0 1
60 0.05 12 0.00 45 0.10 1 0 0 0.00 0 1
12 0.00 60 0.00 30 0.00 1 0 0 0.00 0 1
3 0.00 80 0.00 90 0.00 1 0 0 0.00 0 1
1 0.00 25 0.00 9 0.00 1 0 0 0.00 0 1
1 0.00 1 0.00 1 0.00 1 0 0 0.00 0 1
2 0.00 0 0.00 40 0.00 1 0 0 0.00 0 1
9 0.00 1 1.00 60 0.00 1 0 0 0.00 1 1
4 0.00 12 0.00 70 0.00 1 0 0 0.00 1 1
10 0.00 6 1.00 1 0.00 1 0 0 0.00 1 1
90 0.40 30 0.10 30 0.00 1 0 0 0.00 0 1
8 0.00 10 0.00 12 0.00 1 0 0 0.00 0 1
3 0.00 0 0.00 4 0.00 1 0 0 0.00 1 1
5 0.00 3 0.00 0 0.00 1 0 0 0.00 0 1
4 0.00 2 1.00 4 0.00 1 0 0 0.00 1 1
5 0.00 200 0.00 8 0.00 1 0 0 0.00 0 1
20 0.00 9 0.00 14 0.00 1 0 0 0.00 0 1
3 1.00 40 0.00 45 0.00 1 0 0 0.00 0 1
4 1.00 60 0.00 20 1.00 1 0 0 0.00 0 1
2 1.00 2 1.00 3 1.00 1 0 0 0.00 0 1
30 0.00 6 1.00 5 1.00 1 0 0 0.00 0 1
7 0.00 9 0.80 3 1.00 1 0 0 0.00 0 1
80 0.00 200 0.00 0 0.00 1 0 0 0.00 0 1
5 0.00 90 0.00 0 0.00 1 0 0 0.00 0 1
2 0.00 150 0.00 1 0.00 1 0 0 0.00 0 1
40 0.00 120 0.00 3 0.00 1 0 0 0.00 0 1
1 0.00 60 0.00 4 1.00 1 0 0 0.00 0 1
200 0.00 100 0.00 2 1.00 1 0 0 0.00 0 1
60 0.00 0 0.00 0 0.00 1 0 0 0.00 0 1
9 0.00 300 0.00 0 0.00 1 0 0 0.00 0 1
30 0.60 80 0.00 2 0.00 1 0 0 0.00 0 1
8 0.90 70 0.00 1 0.00 1 0 0 0.00 0 1
5 1.00 0 0.00 0 0.00 1 0 0 0.00 0 1
1 1.00 3 0.00 90 0.00 1 0 0 0.00 0 1
2 0.00 1 1.00 1 1.00 1 0 0 0.00 0 1
3 0.00 4 1.00 50 0.00 1 0 0 0.00 1 1
60 0.00 40 0.00 50 0.00 1 0 0 0.50 0 1
45 0.00 5 0.00 60 0.00 1 0 0 0.25 0 1
50 0.05 60 0.00 40 0.00 1 0 0 0.50 0 1
14 0.00 40 0.00 50 0.00 1 0 0 0.50 0 1
6 0.00 30 0.00 50 0.00 1 0 0 0.25 0 1
3 0.90 40 0.00 3 0.90 1 0 0 0.50 0 0
2 1.00 50 0.00 30 0.00 1 0 0 0.50 0 0
2 0.00 60 0.00 3 1.00 1 0 0 0.50 0 0
30 0.00 45 0.00 40 0.00 1 0 0 1.00 0 0
12 0.00 4 0.00 60 0.00 1 0 0 1.00 0 0
80 0.00 60 0.00 70 0.00 1 0 0 1.00 0 0
6 0.50 60 0.00 3 0.50 1 0 0 0.67 0 0
2 0.00 30 0.00 5 0.00 1 0 0 1.00 1 0
30 0.00 45 0.00 40 0.00 1 0 1 0.00 0 0
5 0.00 40 0.00 2 0.00 1 0 1 0.00 0 0
2 1.00 1 1.00 2 1.00 1 0 1 0.00 0 0
40 0.00 60 0.00 30 0.00 0 1 0 0.00 0 0
80 0.00 70 0.00 50 0.00 0 1 0 0.00 0 0
12 0.00 60 0.00 0 0.00 0 1 0 0.00 0 0
5 0.20 70 0.00 14 0.00 0 1 0 0.00 0 0
3 1.00 2 1.00 40 0.00 0 1 0 0.00 0 0
4 0.00 20 0.00 40 0.00 0 1 0 0.00 1 0
9 0.00 1 1.00 8 0.00 0 1 0 1.00 0 0
1 1.00 1 1.00 1 1.00 0 1 1 0.00 0 0
14 0.00 60 0.00 0 0.00 0 1 1 0.00 0 0
1 1.00 1 1.00 1 1.00 0 0 1 0.00 0 0
1 1.00 0 0.00 9 0.00 0 0 1 0.00 0 0
14 0.00 60 0.00 0 0.00 0 0 1 0.00 0 0
40 0.00 20 0.00 0 0.00 0 0 1 0.00 0 0
80 0.00 3 0.00 50 0.00 0 0 1 0.00 0 0
5 0.00 1 1.00 40 0.00 0 0 1 0.00 1 0
9 0.00 1 1.00 9 0.00 0 0 0 1.00 0 0
25 0.10 6 1.00 12 0.00 0 0 0 1.00 0 0
70 0.00 60 0.00 50 0.00 0 0 0 1.00 0 0
30 0.00 4 0.00 20 0.00 0 0 0 0.67 0 0
60 0.00 50 0.00 70 0.00 0 0 0 0.50 0 1
35 0.05 3 1.00 40 0.00 0 0 0 0.50 0 1
5 0.50 4 1.00 30 0.00 0 0 0 0.50 0 0
8 0.00 60 0.00 1 1.00 0 0 0 0.50 0 0
50 0.00 45 0.00 60 0.00 0 0 0 0.00 0 1
35 0.10 8 0.00 40 0.00 0 0 0 0.00 0 1
90 0.20 20 0.00 2 1.00 0 0 0 0.00 0 1
24 0.00 70 0.00 30 0.00 0 0 0 0.00 0 1
18 0.00 40 0.00 22 0.00 0 0 0 0.00 0 1
6 0.00 50 0.00 60 0.00 0 0 0 0.00 0 1
3 0.00 45 0.00 60 0.00 0 0 0 0.00 0 1
8 0.00 30 0.00 40 0.00 0 0 0 0.00 0 1
8 0.00 2 1.00 60 0.00 0 0 0 0.00 1 1
5 0.00 40 0.00 45 0.00 0 0 0 0.00 1 1
7 0.00 0 0.00 50 0.00 0 0 0 0.00 1 1
3 0.00 0 0.00 60 0.00 0 0 0 0.25 1 1
3 0.00 0 0.00 60 0.00 0 0 0 0.00 1 1
4 0.00 9 0.00 30 0.00 0 0 0 0.50 1 1
50 0.00 10 0.00 12 0.00 0 0 0 0.00 0 1
30 0.00 1 1.00 0 0.00 0 0 0 0.00 0 1
26 0.10 4 0.00 9 0.00 0 0 0 0.00 0 1
22 0.00 0 0.00 0 0.00 0 0 0 0.00 0 1
12 0.00 50 0.00 3 1.00 0 0 0 0.00 0 1
40 0.35 30 0.00 50 0.10 0 0 0 0.00 0 1
60 0.00 90 0.00 0 0.00 0 0 0 0.00 0 1
30 0.00 120 0.00 2 0.00 0 0 0 0.00 0 1
25 0.00 60 0.00 3 1.00 0 0 0 0.00 0 1
45 0.00 80 0.00 4 0.00 0 0 0 0.25 0 1
11 0.00 0 0.00 40 0.00 0 0 0 0.00 0 1
16 0.00 25 0.00 8 0.00 0 0 0 0.00 0 1
1 1.00 1 1.00 60 0.00 0 0 0 0.00 0 0
2 1.00 60 0.00 1 1.00 0 0 0 0.00 0 0
6 0.90 40 0.00 50 0.00 0 0 0 0.00 0 0
1 1.00 70 0.00 45 0.00 0 0 0 0.00 0 0
3 0.80 90 0.00 3 0.80 0 0 0 0.00 0 0
4 1.00 3 1.00 3 1.00 0 0 0 0.00 0 0
2 1.00 2 1.00 30 0.00 0 0 0 0.00 0 0
3 0.00 2 1.00 2 1.00 0 0 0 0.00 0 0
5 0.00 3 1.00 4 0.00 0 0 0 0.00 0 0
5 0.00 3 1.00 50 0.00 0 0 0 0.00 0 0
5 0.00 60 0.00 2 1.00 0 0 0 0.00 0 0
5 0.00 60 0.00 0 0.00 0 0 0 0.00 0 0
14 0.00 3 1.00 2 1.00 0 0 0 0.00 0 0
7 0.90 12 0.00 2 1.00 0 0 0 0.00 0 0
30 0.90 6 1.00 8 1.00 0 0 0 0.00 0 0
40 0.80 30 0.90 30 0.90 0 0 0 0.00 0 0
4 0.00 3 0.00 2 0.00 0 0 0 0.00 0 0
2 0.00 4 0.00 3 0.50 0 0 0 0.00 1 0
"""

_SILENT = "|".join(SILENT)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{_SILENT})(?=[\s/>])[^>]*>.*?(?:</(?P=silent)\s*>|(?=<body[\s>])|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NEGATING = frozenset("no not with without has is hide".split())
_INLINE, _MAIN, _ASIDE = frozenset(INLINE), frozenset(MAIN_TAGS), frozenset(ASIDE_TAGS)
_ASIDE_NAMES, _MAIN_NAMES = frozenset(ASIDE_WORDS) | frozenset(ASIDE_ROLES), frozenset(MAIN_WORDS)
_SAY_NOTHING = _MAIN_NAMES | frozenset(LAYOUT_WORDS)
_VOID = frozenset("area base br col hr img input link meta param source track wbr embed".split())
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(rest: str, in_main: bool) -> float:
    """How much of a container's class, id and role speaks of something beside the article, from 0 to 1.

    Of each name the share of such words, words that say nothing left out; the greatest counts, and half of it if
    another name is the article's. Names such as no-sidebar count nothing, nor does a header within the article.
    """
    most, own = 0.0, False
    for values in _NAMED.findall(rest):
        for name in "".join(values).split():
            words = [w.lower() for w in _WORD.findall(name)]
            if not words or words[0] in _NEGATING:
                continue
            aside = [w for w in words if w in _ASIDE_NAMES and not (in_main and w == "header")]
            telling = [w for w in words if w not in _SAY_NOTHING]
            if aside:
                most = max(most, len(aside) / len(telling))
            elif not _MAIN_NAMES.isdisjoint(words):
                own = True
    return most / 2 if own else most


def blocks(page: str) -> list[tuple]:
    """(text, words, share of characters in links, in main, outside of it, in an aside, named one, heading) of each non-empty flat block."""
    out: list[tuple] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, float]] = []  # tag, main, aside, named
    in_link, heading, at = 0, False, 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            first = next((i for i, x in enumerate(stack) if x[1]), None)  # names around the main element tell nothing of it
            named = max((x[3] for x in stack[first or 0 :]), default=0.0)
            out.append((text, text.count(" ") + 1, min(1.0, linked / len(text)), first is not None, any(x[2] for x in stack), named, heading))
        parts, linked = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(" ".join(html.unescape(piece).split()))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["silent"]:
                parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if m["end"] else 1
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            if tag in ("span", "label") and not m["end"] and m["rest"] and _HIDDEN.search(m["rest"]):
                close()
                stack.append((tag, False, True, 0.0))
            elif m["end"] and stack and stack[-1][0] == tag:
                close()
                stack.pop()
            continue
        close()
        in_link = 0
        if tag[0] == "h" and tag[1:].isdigit():
            heading = not m["end"]
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID and tag not in ("html", "body"):
            if stack and stack[-1][0] in _IMPLIED.get(tag, ()):
                stack.pop()
            rest = m["rest"] or ""
            main, in_main = tag in _MAIN, any(x[1] for x in stack)
            aside = not main and tag in _ASIDE and not (tag == "header" and in_main)
            aside = aside or bool(rest and _HIDDEN.search(rest))
            if not rest.rstrip().endswith("/"):
                stack.append((tag, main, aside, _named(rest, in_main or main) if "=" in rest else 0.0))
    parts.append(page[at:])
    close()
    has_main = any(main and not aside and named <= 0.5 for _, _, _, main, aside, named, _ in out)
    return [(text, words, links, main, has_main and not main, aside, named, heading) for text, words, links, main, aside, named, heading in out]


def describe(found: list[tuple]) -> np.ndarray:
    own = np.array([[b[1], b[2]] for b in found], float).reshape(-1, 2)
    pad = np.zeros((1, 2))
    rest = np.array([b[3:] for b in found], float).reshape(-1, 5)
    return np.hstack([own, np.vstack([pad, own[:-1]])[: len(own)], np.vstack([own[1:], pad])[: len(own)], rest])


def grow(x: np.ndarray, y: np.ndarray, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: nested (feature, threshold, left, right) or a class."""
    vote = int(y.mean() * 2 >= 1) if len(y) else 0
    if len(y) < 2 * least or y.min() == y.max():
        return vote
    best = (1e9, None, None)
    for j in range(x.shape[1]):  # of equal splits, words and links come first
        values = np.unique(x[:, j])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= t
            impurity = sum(part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (left, ~left))
            if min(left.sum(), (~left).sum()) >= least and impurity < best[0] - 1e-9:
                best = (impurity, j, t)
    if best[1] is None:
        return vote
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], least), grow(x[~left], y[~left], least)


def train_tree() -> tuple:
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1])


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    j, t, low, high = tree
    left = x[:, j] <= t
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = classify(tree, describe(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    A null or empty page, or one without article text, gives an empty text. Rows are independent:
    repeated and null ids are kept as they are, and equal pages give equal texts. Broken markup is read as far as
    it goes: unclosed elements end with the page. A page is read whole, in time linear in its length. Extra
    columns, also of the names text and n_chars, are ignored; an empty table gives an empty result.
    """
    tree = train_tree()

    @F.pandas_udf("string")
    def text(part: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, tree) for x in part], dtype=object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
