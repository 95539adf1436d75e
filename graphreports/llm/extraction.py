"""Main text of web pages by minimum cut.

A page is a row of text blocks. A linear classifier turns what is known of a block into the cost of calling it content or
boilerplate: these are its capacities to the two terminals. Blocks that follow one another, and blocks under the same parent,
are tied by edges that weaken with their distance in the tree. The minimum cut is the cheapest labelling.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>?", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
# Elements whose text is never read, with all they hold.
DROPPED = frozenset("script style noscript template textarea select option button svg math iframe object canvas title datalist audio video".split())
RAW = frozenset("script style noscript textarea title iframe".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I | re.A) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# Elements whose end tag may be left out, with the start tags that end them.
_CELLS = frozenset("td th tr tbody thead tfoot".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
ENDED_BY = {"p": _ENDS_P, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": _CELLS, "th": _CELLS, "tr": _CELLS - {"td", "th"}}
ENDED_BY |= {x: frozenset("tbody thead tfoot".split()) for x in ("tbody", "thead", "tfoot")}
ENDED_BY |= {"option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"])}
_LISTED = frozenset("li dt dd".split())
_BOUNDS = frozenset("table td th caption template".split())  # no end tag of an element around these is read inside them
FOREIGN = frozenset(["svg", "math"])
# Start tags of HTML, which end an open svg or math.
_HTML_ONLY = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
AWAY = frozenset("nav footer aside form menu dialog".split())
HERE = frozenset("article main".split())
AWAY_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside ad ads advert advertisement adverts banner promo promoted sponsor sponsored "
    "cookie cookies consent notice alert disclaimer gdpr popup modal overlay comment comments disqus reply replies respond share sharing social related recommended widget "
    "newsletter subscribe subscription signup login search form toolbar pagination pager copyright legal contentinfo complementary".split()
)
HERE_WORDS = frozenset("article content entry post story main body text".split())
AWAY_COST, HERE_COST, LINK_COST, LENGTH_COST, STOP_COST, BIAS = 12.0, 4.0, 4.0, 1.5, 0.6, 1.0
NEAR, KIN = 1.2, 0.6  # edges between neighbours, and between the next two blocks of a parent


class Block:
    __slots__ = ("text", "links", "path", "away", "here", "heading")

    def __init__(self, text: str, links: int, path: tuple[int, ...], away: int, here: int, heading: bool):
        self.text, self.links, self.path, self.away, self.here, self.heading = text, links, path, away, here, heading


def _names(attributes: str) -> set[str]:
    return {p.lower() for m in _NAMES.findall(attributes) for p in _PART.findall(m)}


def _hidden(attributes: str) -> bool:
    """Whether ``hidden``, ``aria-hidden="true"`` or ``display: none`` is among the attributes; words inside other values do not count."""
    if not _MAY_HIDE.search(attributes):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.strip("\"' \t\n").lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with white space made single. ``path`` names the ancestors of a block by number."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # element, its number, and how much above speaks against and for content
    text: list[str] = []
    links = in_link = numbered = 0

    def close() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                name, _, away, here = stack[-1]
                out.append(Block(joined, links, tuple(s[1] for s in stack), away, here, len(name) == 2 and name[0] == "h"))
            text.clear()
        links = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            text.append(piece)
            links += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name, ending, attributes = name.lower(), m[1], m[3] or ""
        if name in INLINE:
            if name == "a":
                in_link = 0 if ending else 1
            if not (attributes and not ending and _hidden(attributes)):
                continue
        if name == "br" or name == "wbr" or name == "img":
            if name != "wbr":
                text.append(" ")
            continue
        close()
        in_link = 0
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "head":  # what is never read in it is dropped by name; it ends where anything else begins
            continue
        if name in FOREIGN and attributes.endswith("/"):
            continue
        if name in DROPPED or (attributes and name not in VOID and _hidden(attributes)):
            at = _after(page, name, at, {s[0] for s in stack[1:]})
            continue
        if name in VOID:
            continue
        if name == "p" or name == "li" or name == "td" or name == "tr" or name == "dt" or name == "dd":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] not in ("p", "b"):
                    break
        _, _, away, here = stack[-1]
        words = _names(attributes) if "=" in attributes and name not in ("html", "body", "main") else ()
        inside = name in HERE
        if name in AWAY or (name == "header" and not here) or not AWAY_WORDS.isdisjoint(words):
            away += 1
        elif inside or not HERE_WORDS.isdisjoint(words):
            here += 1
        numbered += 1
        stack.append((name, numbered, away, here))
    close()
    return out


def _raw_end(page: str, name: str, at: int) -> int:
    m = _RAW_END[name].search(page, at)
    return m.end() if m else len(page)


def _after(page: str, name: str, at: int, around: set[str]) -> int:
    """Where the element that opened before ``at`` ends: after its end tag or, where that is left out, before the tag that implies it.

    ``around`` names the elements it is in. Only raw text without an end tag goes on to the end of the page, as in HTML.
    """
    if name in RAW:
        return _raw_end(page, name, at)
    if name in _ENDS_P:
        around = around - {"p"}
    inner, n = [name], len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if tag in inner:
                while inner.pop() != tag:
                    pass
                if not inner:
                    return at
            elif tag in around and (_BOUNDS.isdisjoint(inner) or ((tag in _CELLS or tag == "table") and "table" not in inner and "template" not in inner)):
                return m.start()
            continue
        if inner[0] in FOREIGN and tag in _HTML_ONLY and {"foreignobject", "desc", "title", "annotation-xml"}.isdisjoint(inner):
            return m.start()
        for k in range(len(inner) - 1, -1, -1):
            if tag in ENDED_BY.get(inner[k], ()):
                del inner[k:]
            elif inner[k] not in INLINE and inner[k] not in ENDED_BY and not (tag in _LISTED and inner[k] in ("div", "address")):
                break
        else:  # nothing between keeps the tag from ending what is open here, or what is open around
            if not inner or any(tag in ENDED_BY.get(x, ()) for x in around):
                return m.start()
        if tag in RAW:
            at = _raw_end(page, tag, at)
        elif tag not in VOID and not (attributes.endswith("/") and (tag in FOREIGN or not FOREIGN.isdisjoint(inner))):
            inner.append(tag)
    return n


def evidence(b: Block) -> float:
    """Cost of calling the block boilerplate, less the cost of calling it content."""
    n = len(b.text)
    told = HERE_COST * min(b.here, 2) - AWAY_COST * b.away - LINK_COST * min(1.0, b.links / n)
    told += LENGTH_COST * min(3.0, n / 80) + STOP_COST * min(3, sum(map(b.text.count, ".!?"))) - BIAS
    return told + (0.5 if b.heading else 0.0)


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Neighbours, by distance in the tree, and each block with the next under the same parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            a, c = found[k - 1].path, b.path
            shared = next((i for i, (x, y) in enumerate(zip(a, c, strict=False)) if x != y), min(len(a), len(c)))
            out[k - 1, k] = NEAR / (1 + len(a) + len(c) - 2 * shared)
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last:
            out[last[parent], k] = out.get((last[parent], k), 0.0) + KIN
        last[parent] = k
    return out


def minimum_cut(told: list[float], tied: dict[tuple[int, int], float]) -> list[bool]:
    """True where the cheapest labelling says content.

    A node whose terminal capacity is not less than all its open edges together keeps that side in a minimum cut; fixing it moves its
    edges to the terminals of its neighbours. What stays open is cut by augmenting along shortest paths.
    """
    n = len(told)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in tied.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    pull, label = list(told), [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(pull[k]) >= sum(near[k].values()):
            label[k] = pull[k] > 0
            for j, w in near[k].items():
                del near[j][k]
                pull[j] += w if label[k] else -w
                todo.append(j)
            near[k] = {}
    left = [k for k in range(n) if label[k] is None]
    if left:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {k: dict(near[k]) for k in left} | {source: {}, sink: {}}
        for k in left:
            room[source][k], room[k][source] = max(pull[k], 0.0), 0.0
            room[k][sink], room[sink][k] = max(-pull[k], 0.0), 0.0
        reached = _augment(room, source, sink)
        for k in left:
            label[k] = k in reached
    return label


def _augment(room: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Push flow along shortest paths until none is left; the nodes that the source still reaches."""
    while True:
        came = {source: source}
        todo = deque([source])
        while todo and sink not in came:
            a = todo.popleft()
            for b, w in room[a].items():
                if w > 1e-9 and b not in came:
                    came[b] = a
                    todo.append(b)
        if sink not in came:
            return set(came)
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        steps = list(zip(path[1:], path, strict=False))
        least = min(room[a][b] for a, b in steps)
        for a, b in steps:
            room[a][b] -= least
            room[b][a] = room[b].get(a, 0.0) + least


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    label = minimum_cut([evidence(b) for b in found], edges(found))
    return "\n\n".join(b.text for b, kept in zip(found, label, strict=True) if kept)


def report(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    A null, empty or text-free html gives an empty text; broken markup is read as far as it goes; rows that repeat stay rows; an
    empty table gives no rows; other columns are not read.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html")).mapInPandas(of, f"page_id {kind}, url string, text string, n_chars long")
