"""Main-text extraction from web pages by minimum cut.

A page is cut into blocks of text. A linear classifier over a block's text, links and surroundings gives the cost of
calling it boilerplate or content: the capacities of its edges from the source and to the sink. Blocks that follow each
other, and blocks of one parent, are joined by edges whose capacity falls with their distance in the tree. The maximum
flow's source side is the content: the labelling of least total cost.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</[^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
# Elements whose text is never shown or never prose.
RAW = frozenset("script style noscript template iframe object svg canvas title textarea select noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul head".split()
)
SPACED = frozenset("br td th img input".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"},
}
#: A start tag closes an element of CLOSES only up to one of these.
SCOPE = frozenset("table ul ol dl div section article aside nav main body html form blockquote header footer button select".split())
#: A block-level start tag also ends an open paragraph.
ENDS_P = BLOCK - {"body", "html", "head", "option", "tr", "tbody", "thead", "tfoot", "caption"}
CHROME = frozenset("nav aside footer form menu button dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside"
    " cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager"
    " comment comments reply replies disqus copyright skip".split()
)
BODY_WORDS = frozenset("article post entry story content main body".split())
LAMBDA = 1.2


def blocks(html: str):
    """(blocks, parents, marks): blocks as (text, element, share of linked characters, tag); elements by number."""
    parent, chrome, worded, inside, head = [-1], [False], [False], [False], [False]
    tags = [""]
    stack = [0]
    out: list[tuple[str, int, float, str]] = []
    text: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                at = stack[-1]
                while tags[at] not in BLOCK and parent[at] >= 0:
                    at = parent[at]
                out.append((said, at, min(1.0, linked / len(said)), tags[at]))
            text, linked = [], 0

    def pop_to(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            links -= tags[e] == "a"
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            part = html[at:lt]
            text.append(part)
            if links:
                linked += len(part.strip())
        if lt == n:
            break
        m = TOKEN.match(html, lt)
        if m is None:  # a lone <
            nxt = html[lt + 1 : lt + 2]
            if nxt.isalpha() or nxt == "/":  # a tag with an open quote ends at the next >
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text.append("<")
                at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            elif tag in SPACED:
                text.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and tags[stack[k]] in BLOCK and tag != "a":
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "object", "iframe"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
        elif tag in SPACED:
            text.append(" ")
        if tag in VOID:
            continue
        closed = CLOSES.get(tag, frozenset())
        for k in range(len(stack) - 1, 0, -1):
            name = tags[stack[k]]
            if name in closed or name == "p" and tag in ENDS_P:
                pop_to(k)
                continue
            if name in SCOPE:
                break
        up = stack[-1]
        mark = word = False
        body = tag in ("article", "main")
        if m[3] and tag not in ("html", "body") and tag in BLOCK:
            for name, *values in ATTRIBUTE.findall(m[3]):
                name, value = name.lower(), "".join(values).lower()
                if name in ("class", "id"):
                    words = set(WORDS.findall(value))
                    word = word or not words.isdisjoint(CHROME_WORDS)
                elif name == "role":
                    mark = mark or value in ROLES
                    body = body or value in ("main", "article")
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    mark = True
        e = len(parent)
        parent.append(up)
        tags.append(tag)
        chrome.append(mark or tag in CHROME)
        worded.append(word)
        inside.append(inside[up] or body)
        head.append(tag == "header" or head[up])
        stack.append(e)
        links += tag == "a"
    flush()
    return out, parent, chrome, worded, inside, head


def scores(found, parent, chrome, worded, inside, head) -> list[float]:
    """Log odds of each block being content. An element whose class or id speaks of page furniture counts as such unless
    it holds most of the page's text (a page named after its layout)."""
    size = [0] * len(parent)
    for said, e, _, _ in found:
        size[e] += len(said)
    for e in range(len(parent) - 1, 0, -1):
        size[parent[e]] += size[e]
    off = [False] * len(parent)
    for e in range(1, len(parent)):
        off[e] = off[parent[e]] or chrome[e] or worded[e] and size[e] < 0.6 * size[0]
    plain = not any(inside)
    out = []
    for said, e, linked, tag in found:
        words = said.count(" ") + 1
        s = min(words, 60) / 20 - 0.6 - 4 * linked + 0.7 * (said[-1] in ".!?…\"”»:")
        s -= 0.8 * (words < 4 and said[-1] not in ".!?…")
        if tag in ("h1", "h2", "h3", "h4"):
            s += 1
        if "©" in said or "all rights reserved" in said.lower():
            s -= 3
        if off[e] or head[e] and not (inside[e] and tag in ("h1", "h2")):
            s -= 8
        elif inside[e]:
            s += 4
        elif plain:
            s += 0.4
        out.append(s)
    return out


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: node k has capacity score[k] from the source, or -score[k] to the sink; edges go both
    ways. Dinic's algorithm."""
    n = len(score)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(there)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, s in enumerate(score):
        if s > 0:
            join(source, k, s, 0.0)
        elif s < 0:
            join(k, sink, -s, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while nth[a] < len(at[a]):
                e = at[a][nth[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nth[a] += 1
            if nth[a] < len(at[a]):
                path.append(e)
                a = to[e]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                nth[a] += 1


def smooth(found, parent) -> list[tuple[int, int, float]]:
    """Edges of neighbouring blocks (stronger the closer their elements) and of each block to the next one of its parent."""
    edges, last = [], {}
    for k, (_, e, _, _) in enumerate(found):
        up = parent[e]
        if k:
            f = found[k - 1][1]
            g = parent[f]
            same = e == f or up == g or e == g or f == up
            near = up >= 0 and g >= 0 and (parent[up] == g or parent[g] == up or parent[up] == parent[g])
            edges.append((k - 1, k, LAMBDA * (1 if same else 0.4 if near else 0.15)))
        if up in last and last[up] != k - 1:
            edges.append((last[up], k, LAMBDA * 0.5))
        last[up] = k
    return edges


def main_text(html: str) -> str:
    """Content blocks in page order, joined by one newline each."""
    found, parent, *marks = blocks(html)
    if not found:
        return ""
    score = scores(found, parent, *marks)
    if min(score) > 0 or max(score) <= 0:  # the cut is then the empty one
        keep = [score[0] > 0] * len(found)
    else:
        keep = min_cut(score, smooth(found, parent))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, within its partition. A null html counts as empty (text ""); null or
    repeated page_ids and urls stay as they are; a page of any length is read whole; an empty table gives an empty result;
    other columns are not looked at."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
