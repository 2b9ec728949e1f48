"""Main text of web pages by removing what a site repeats (operator 9).

Every element has a hash of its subtree. Spark counts with how many different texts of a host each
hash stands; subtrees that stand with many of them are the site's template and go, inside an article
too. A text that was copied stands with itself only, however many copies there are. What pages mark as
no article by tag, role or class goes too, as much of it (adverts, link lists) differs page by page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import broadcast_if_small, cut

#: a subtree is template if it stands with at least so many texts of its host and such a share of them
MIN_PAGES, MIN_SHARE = 10, 0.3
#: on smaller hosts, outside articles, it must stand with such a share of the texts; with fewer texts nothing can be told
SMALL_SHARE, LEAST_PAGES = 0.8, 3
#: inside an article, where passages are shared, it must stand with such a share
ARTICLE_SHARE = 0.6

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset("head script style noscript iframe template textarea select button form nav aside footer header menu dialog object svg canvas title".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "header footer masthead cookie cookies consent notice notices popup modal newsletter subscribe signup comment comments disqus reply replies "
    "related share sharing social widget toolbar copyright".split()
)
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: an open element of the key is closed by a start tag of these
CLOSES = {
    "p": BLOCK - {"body", "html", "legend", "optgroup", "option", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"li", "dd", "dt"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}

#: words that say nothing of their own in a name such as ``related-posts`` or ``share-buttons``
FILLER_WORDS = frozenset("area bar block body box buttons container content form group inner items links list outer panel post posts row section site the top bottom wrap wrapper".split())
#: inside an article these name parts of it
ARTICLE_WORDS = frozenset("header masthead banner".split())
#: elements nested deeper than this belong to the one at this depth, as in browsers
DEEPEST = 512

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Tags:
    """Tags of a page one after the other, in one pass.

    A tag ends at the first ``>`` outside quotes. Once a quote is found that is never closed, quotes no longer
    count on this page; without any more ``>`` the rest has no tag. So each failed search is made once only.
    """

    def __init__(self, page: str) -> None:
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def end_of(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends, or -1."""
        if at > self.last:
            return -1
        k = at
        while self.quotes:
            found = _STOP.search(self.page, k)
            if not found:
                self.quotes = False
            elif found[0] == ">":
                return found.end()
            else:
                k = self.page.find(found[0], found.end()) + 1
                self.quotes = k > 0
        return self.page.find(">", at) + 1 or -1

    def read(self, at: int) -> tuple[int, str, bool, str] | None:
        """``(end, tag, whether it closes, attributes)`` of what begins with ``<`` at ``at``; no tag name for comments; None for text."""
        page, n = self.page, len(self.page)
        if page.startswith("<!--", at):
            return (page.find("-->", at + 4) + 3 if page.find("-->", at + 4) >= 0 else n), "", False, ""
        name = _NAME.match(page, at)
        if not name:
            if page[at + 1 : at + 2] not in ("!", "?", "/"):
                return None
            end = page.find(">", at)
            return (end + 1 if end >= 0 else n), "", False, ""
        end = self.end_of(name.end())
        if end < 0:
            # a last tag that was cut off is none; what looks like one within text is text
            return (n, "", False, "") if page.find("<", at + 1) < 0 else None
        return end, name[1].lower(), page[at + 1] == "/", page[name.end() : end - 1]


class _Element:
    __slots__ = ("tag", "away", "article", "digest", "first", "speaks")

    def __init__(self, tag: str, away: bool, article: bool, first: int) -> None:
        self.tag, self.away, self.article, self.first = tag, away, article, first
        self.speaks = False  # it has words of its own, not only those of elements in it
        self.digest = hashlib.blake2b(tag.encode(), digest_size=8)


def _names_away(name: str, article: bool) -> bool:
    """Whether a class or id names no article. Inside one all of its words must, and words that parts of an article have don't count."""
    words = [w for w in _SPLIT.split(name) if w]
    if not article:
        return any(w in AWAY_WORDS for w in words)
    return any(w in AWAY_WORDS for w in words) and all(w in FILLER_WORDS or w in AWAY_WORDS - ARTICLE_WORDS for w in words)


def _marked_away(tag: str, attributes: str, article: bool) -> bool:
    if tag in AWAY and not (article and tag == "header"):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in AWAY_ROLES:
        return True
    return any(_names_away(name, article) for key in ("class", "id") if key in found for name in found[key].lower().split())


def read_page(page: str, template: frozenset[int] = frozenset(), counted: bool = False) -> tuple[list[str], list[tuple[int, bool, int]], int]:
    """Blocks of text, ``(hash, inside an article, other)`` of subtrees, and a hash of all text.

    One pass over the tags with a stack of open elements; missing end tags are supplied as HTML
    does for paragraphs, list items and cells. Blocks under an element that is marked as no
    article, or whose hash is in ``template``, are left out. ``other`` is the hash of the longest block outside
    the subtree; inline elements among words, subtrees without text, or beside blocks of less than half their longest one, aren't listed.
    If the host was ``counted``, all other blocks are text. If not, those outside the page's only
    element ``article`` or ``main`` are left out where it holds at least half of the text. The time is linear in the
    page's length, also for broken tags and very deep nesting.
    """
    pieces: list[str | bool] = []  # texts; a truth value ends a block and says if it stands inside an article
    subtrees: list[tuple[int, bool, int, int, _Element | None]] = []  # the last: what an inline element stands in
    stack: list[_Element] = [_Element("#", False, False, 0)]
    depths: Counter[str] = Counter()  # open elements by tag
    beyond: Counter[str] = Counter()  # those that are too deep to be kept apart
    blocks: list[int] = []  # places in the stack of those that are blocks
    away = inside = articles = 0

    def flush() -> None:
        if pieces and not isinstance(pieces[-1], bool):
            pieces.append(inside > 0)

    def close() -> None:
        nonlocal away, inside
        top = stack.pop()
        depths[top.tag] -= 1
        if top.tag in BLOCK:
            blocks.pop()
            flush()
        away -= top.away
        digest = top.digest.digest()
        if not away and top.tag not in ("body", "html") and len(pieces) > top.first:
            subtrees.append((int.from_bytes(digest, "little", signed=True), inside > 0, top.first, len(pieces), None if top.tag in BLOCK else stack[-1]))
        stack[-1].digest.update(digest)
        inside -= top.article

    at, n, tags = 0, len(page), _Tags(page)
    while at < n:
        start = page.find("<", at)
        found = tags.read(start) if start >= 0 else None
        stop = n if start < 0 else start if found else start + 1
        if stop > at:
            text = page[at:stop]
            stack[-1].digest.update(text.encode("utf-8", "surrogatepass"))
            if not away:
                pieces.append(text)
                stack[-1].speaks = stack[-1].speaks or any(map(str.isalnum, text))
        if not found:
            at = stop
            continue
        at, tag, ends, attributes = found
        if not tag:
            continue
        if ends:
            if beyond[tag]:  # it ends one that was never kept
                beyond[tag] -= 1
                if tag in BLOCK:
                    flush()
            elif depths[tag] > 0:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK and tag != "hr":
            # inline elements left open inside a paragraph don't keep it open
            while blocks and tag in CLOSES.get(stack[blocks[-1]].tag, ()):
                depth = blocks[-1]
                while len(stack) > depth:
                    close()
            flush()
        if tag in VOID:
            stack[-1].digest.update(tag.encode())
            if tag == "hr":
                flush()
            elif tag == "br" and not away:
                pieces.append(" ")
            continue
        article = tag in ("article", "main")
        gone = _marked_away(tag, attributes, inside > 0)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            stack[-1].digest.update(page[at : end.start() if end else n].encode("utf-8", "surrogatepass"))
            at = end.end() if end else n
            continue
        if len(stack) > DEEPEST:
            beyond[tag] += 1
            continue
        articles += article and not away and not gone and not inside
        if tag in BLOCK:
            blocks.append(len(stack))
        depths[tag] += 1
        stack.append(_Element(tag, gone, article, len(pieces)))
        away += gone
        inside += article
    while len(stack) > 1:
        close()
    flush()
    # an inline element among words is part of their sentence, also if it recurs
    subtrees = [x for x in subtrees if not (x[4] and x[4].speaks)]
    return _texts(pieces, subtrees, template, counted or articles != 1), _beside(pieces, subtrees), _hash("\n".join(t for _, _, t, _ in _blocks(pieces)))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _blocks(pieces: list[str | bool]) -> list[tuple[int, int, str, bool]]:
    """``(first piece, end, text, inside)`` of the blocks with text."""
    out, first = [], 0
    for k, piece in enumerate(pieces):
        if isinstance(piece, bool):
            text = " ".join(entities.unescape("".join(pieces[first:k])).split())
            if text:
                out.append((first, k, text, piece))
            first = k + 1
    return out


def _texts(pieces: list[str | bool], subtrees: list, template: frozenset[int], whole: bool) -> list[str]:
    hits = [(first, end) for value, _, first, end, _ in subtrees if value in template] if template else []
    if hits:
        gone = np.zeros(len(pieces) + 1, np.int64)
        np.add.at(gone, [first for first, _ in hits], 1)
        np.add.at(gone, [end for _, end in hits], -1)
        # ends of blocks stay, so that neighbours don't run together
        pieces = [p if not g or isinstance(p, bool) else " " for p, g in zip(pieces, np.cumsum(gone).tolist(), strict=False)]
    blocks = _blocks(pieces)
    own = sum(len(t) for _, _, t, inner in blocks if inner)
    only = not whole and 2 * own >= sum(len(t) for _, _, t, _ in blocks)
    return [t for _, _, t, inner in blocks if inner or not only]


def _beside(pieces: list[str | bool], subtrees: list) -> list[tuple[int, bool, int]]:
    blocks = _blocks(pieces)
    if not blocks or not subtrees:
        return []
    size = np.array([len(b[2]) for b in blocks])
    before, after = [-1], [-1]  # the longest block up to, and from, each place
    for k in range(len(blocks)):
        before.append(k if before[-1] < 0 or size[k] > size[before[-1]] else before[-1])
    for k in range(len(blocks) - 1, -1, -1):
        after.append(k if after[-1] < 0 or size[k] >= size[after[-1]] else after[-1])
    after.reverse()
    words = np.cumsum([0, *(isinstance(p, str) and bool(p.strip()) for p in pieces)])
    first, end = np.array([x[2] for x in subtrees]), np.array([x[3] for x in subtrees])
    # the blocks it has a part in; an inline element may begin or end within one
    lo, hi = np.searchsorted([b[1] for b in blocks], first, "right"), np.searchsorted([b[0] for b in blocks], end, "left")
    speaks = np.flatnonzero((lo < hi) & (words[end] > words[first]))
    if not len(speaks):
        return []
    own = np.maximum.reduceat(np.append(size, 0), np.stack([lo[speaks], hi[speaks]], 1).ravel())[::2].tolist()
    out, hashes = [], {}
    for k, most in zip(speaks.tolist(), own, strict=True):
        beside = max((x for x in (before[lo[k]], after[hi[k]]) if x >= 0), key=lambda x: size[x], default=-1)
        if beside >= 0 and 2 * size[beside] >= most:
            if beside not in hashes:
                hashes[beside] = _hash(blocks[beside][2])
            out.append((subtrees[k][0], subtrees[k][1], hashes[beside]))
    return out


def host_of(url):
    """Lower-cased host of a url column; null and urls without ``://`` have the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def site_template(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """``host, hashes`` of every host with ``LEAST_PAGES`` different texts: subtrees that stand with many of them.

    ``min_pages`` is the least number; on hosts with few texts ``SMALL_SHARE`` of these are enough outside articles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, rows = [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, subtrees, body = read_page(page.as_py() or "")
                own = {(None, False, body), *subtrees}  # a null counts the page's text itself
                hosts += [host] * len(own)
                rows += own
            hashes, inner, beside = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(inner, pa.bool_()), pa.array(beside, pa.int64())], ["host", "hash", "inner", "beside"])

    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, hash long, inner boolean, beside long")
    # each text counts once, however many copies of it there are
    counts = found.distinct().groupBy("host", "hash", "inner").agg(F.count(F.lit(1)).alias("n"))
    often = cut(counts.where(F.col("n") >= min(min_pages, LEAST_PAGES)))
    total = often.where("hash is null").select("host", F.col("n").alias("bodies"))
    share = F.col("bodies") * F.when(F.col("inner"), F.lit(article_share)).otherwise(F.lit(min_share))
    least = F.when(F.col("inner"), F.lit(float(min_pages))).otherwise(F.least(F.lit(float(min_pages)), SMALL_SHARE * F.col("bodies")))
    # the null of each host stays, so that a host without template has an empty list
    kept = often.join(total, "host").where(F.col("hash").isNull() | (F.col("n") >= F.greatest(share, least)))
    return kept.groupBy("host").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, in the input's order within its files.

    Null html is an empty page and gives an empty text; so does a page without any block. Repeated
    rows are extracted alike. An empty table gives no rows. Other columns are ignored, whatever their names. Very
    long pages are read whole.
    A host has at most ``1 / min_share`` times a page's number of subtrees as its template, so a
    host's list is as small as a page is.
    """
    template = cut(site_template(pages, min_pages, min_share))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    joined = own.join(broadcast_if_small(template, 20_000), "host", "left").select("page_id", "url", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, hashes in zip(batch.column(2), batch.column(3), strict=True):
                known = hashes.as_py()
                texts.append("\n".join(read_page(page.as_py() or "", frozenset(known or ()), known is not None)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
