"""Main text of web pages by markup and nearest-URL page differencing.

A page is cut into lines, one for each block of text, with what the markup says of them:
inside the article, inside a menu, header, footer, sidebar, notice, advert, form or reader
comments, or neither.  Pages are sorted by host and URL path; each is paired with the
neighbour whose path begins most like its own, their lines are aligned by a longest common
subsequence, and lines both have are deleted: a site's pages share its furniture and not
their articles.  Lines inside an article element are never deleted, as a mirrored article
is still one; where a page has no such element, a pair that shares most of its text is a
copy, and nothing is deleted for it.  Lines outside go with the furniture where the article,
or else the main element, is at least half of the text; where it is less, as with teaser
cards, they are aligned like any other.

Sorting is by ranges, so a host with a third of all pages is spread, and only hashes of
lines are sorted and paired.  Neighbours across two ranges meet by a gapless number.

Defined cases: null html is an empty page, whose text is empty; a null URL is an empty
one; pages that repeat URL and lines are one for pairing; text before any block is a
block; white space, also that of character references, is one space; an unclosed comment
or script reaches to the end; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import settle

# Elements that start a new block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# Elements whose content is not text of the page.
SILENT = frozenset("script style template title noscript textarea svg math iframe object canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that HTML closes by itself.
IMPLIED = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup".split())
FURNITURE = frozenset("nav header footer aside form menu button dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names in class, id and role, or last parts of them, that say the same.
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup social share sharing related recommended recommendations toolbar pagination pager widget "
    "contentinfo complementary search login".split()
)
COMMENT_HINTS = frozenset("comment comments commentlist disqus respond replies discussion".split())
# Parts of a name behind a hint that leave it one ("ad-slot"), and in front of it that do not ("has-sidebar").
PIECES = frozenset("area bar block box button buttons container content form inner item items links list panel posts section slot top unit wrap wrapper".split())
STATES = frozenset("has with no not non without is hide hidden show".split())

# A quoted value is taken in one way only, and a tag that is cut off ends with the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|\"(?![^\"]*+\")|'(?![^']*+'))*+)(?:>|\Z)",
    re.S,
)
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_URL = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)")


@dataclass
class Line:
    text: str
    inside: bool  # of an article, or of the main element where no article is
    furniture: bool


class _State(NamedTuple):
    """What holds inside an element: headers are furniture unless they show an article's heading."""

    article: bool = False
    main: bool = False
    furniture: bool = False
    furniture_heading: bool = False
    fixed: bool = False
    comments: bool = False


def _inside(around: _State, kind: str) -> _State:
    """The state inside an element of some kind; articles and main lift hints around them."""
    if kind == "plain" or around.comments:
        return around
    if kind == "comments":
        return around._replace(furniture=True, furniture_heading=True, comments=True)
    if kind in ("fixed", "hinted"):
        return around._replace(furniture=True, furniture_heading=True, fixed=around.fixed or kind == "fixed")
    if kind == "header":
        return around._replace(furniture=True, furniture_heading=around.furniture_heading or not around.article)
    kept = around._replace(furniture=around.furniture and around.fixed, furniture_heading=around.furniture_heading and around.fixed)
    return kept._replace(article=True) if kind == "article" else kept._replace(main=True)


def _hints_of(attributes: str) -> set[str]:
    """The whole names of class, id and role, and what their parts say: the last one that is no piece."""
    out = set()
    for value in _HINT.findall(attributes):
        for name in value.lower().strip("\"'").split():
            parts = _WORD.findall(name)
            while len(parts) > 1 and parts[-1] in PIECES:
                parts.pop()
            if parts and not STATES.intersection(parts[:-1]):
                out.update((name, parts[-1]))
    return out


def lines(page: str) -> list[Line]:
    """The blocks of visible text in page order."""
    found: list[tuple[str, bool, bool, bool]] = []
    # Open elements, each with what holds inside of it: (name, state).
    stack: list[tuple[str, _State]] = []
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    heading = 0

    def state() -> tuple[bool, bool, bool]:
        if not stack:
            return False, False, False
        now = stack[-1][1]
        return now.article, now.main, now.furniture_heading if heading else now.furniture

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, *state()))

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            parts.append(page[at:])
            break
        parts.append(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        name, closing = token[2].lower(), bool(token[1])
        if name in SILENT and not closing:
            if not token[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name in HEADINGS:
                heading = 0 if closing else 1
        if closing:
            if open_names[name]:
                flush()
                while True:
                    closed, _ = stack.pop()
                    open_names[closed] -= 1
                    if closed == name:
                        break
            continue
        if name in VOID or token[3].endswith("/"):
            continue
        if name in BLOCKS and name not in HEADINGS:
            while stack and stack[-1][0] in IMPLIED and (stack[-1][0] == "p" or stack[-1][0] == name):
                open_names[stack.pop()[0]] -= 1
        kind = "plain"
        if name not in ("html", "body"):
            words = _hints_of(token[3]) if "=" in token[3] else set()
            if words & COMMENT_HINTS:
                kind = "comments"
            elif name == "article":
                kind = "article"
            elif name == "main":
                kind = "main"
            elif name == "header" or "header" in words:
                kind = "header"
            elif name in FURNITURE:
                kind = "fixed"
            elif words & HINTS:
                kind = "hinted"
        # Plain inline and self-closing elements change nothing and need no place.
        if kind != "plain" or (name in BLOCKS and name not in IMPLIED and name not in HEADINGS):
            if kind != "plain" and name not in BLOCKS:
                flush()
            stack.append((name, _inside(stack[-1][1] if stack else _State(), kind)))
            open_names[name] += 1
    flush()
    total = sum(len(text) for text, _, _, furniture in found if not furniture)
    in_article = sum(len(text) for text, article, _, furniture in found if article and not furniture)
    in_main = sum(len(text) for text, _, main, furniture in found if main and not furniture)
    out = []
    for text, article, main, furniture in found:
        inside = article if in_article else main
        if in_article and 2 * in_article >= total:
            outside = not article
        else:
            outside = bool(in_main) and 2 * in_main >= total and not main and not article
        out.append(Line(text, inside and not furniture, furniture or outside))
    return out


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``other``."""
    start, end = 0, 0
    while start < min(len(mine), len(other)) and mine[start] == other[start]:
        start += 1
    while end < min(len(mine), len(other)) - start and mine[-1 - end] == other[-1 - end]:
        end += 1
    places = defaultdict(list)
    for j in range(len(other) - end - 1, start - 1, -1):
        places[other[j]].append(j)
    # The longest chain of matches that rises in both: the last match of each length.
    tails: list[int] = []
    last: list[tuple] = []
    for i in range(start, len(mine) - end):
        for j in places.get(mine[i], ()):
            k = bisect_left(tails, j)
            link = (i, last[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                last.append(link)
            else:
                tails[k], last[k] = j, link
    between, link = [], last[-1] if last else None
    while link:
        between.append(link[0])
        link = link[1]
    return [*range(start), *reversed(between), *range(len(mine) - end, len(mine))]


def _place(url: str | None) -> tuple[str, str]:
    found = _URL.match(url or "")
    return (found[1].lower(), found[2]) if found else ("", url or "")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


_PARSED = "page_id long, url string, lines_key long, text string, kept array<struct<at int, text string, inside boolean>>"
_SIGNATURE = "host string, path string, lines_key long, hashes array<long>, open_chars array<int>"


def _parse(pages: DataFrame, with_text: bool) -> DataFrame:
    """What ``_PARSED`` or ``_SIGNATURE`` names, of every page.

    ``kept`` is null where no line depends on the page's neighbours; ``text`` is then final.
    """
    kept_type = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("inside", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                rows = []
                for page, url, text in zip(*(some[c].to_pylist() for c in ("page_id", "url", "html"))):
                    found = lines(text or "")
                    place, hashes = _place(url), [_hash(line.text) for line in found]
                    key = _hash(repr((place, hashes)))
                    if with_text:
                        kept = [{"at": i, "text": line.text, "inside": line.inside} for i, line in enumerate(found) if not line.furniture]
                        final = all(line["inside"] for line in kept)
                        rows.append((page, url, key, "\n\n".join(line["text"] for line in kept) if final else "", None if final else kept))
                    else:
                        rows.append((*place, key, hashes, [0 if line.furniture or line.inside else len(line.text) for line in found]))
                if with_text:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), kept_type]
                    names = ["page_id", "url", "lines_key", "text", "kept"]
                else:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                    names = ["host", "path", "lines_key", "hashes", "open_chars"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, _PARSED if with_text else _SIGNATURE)


def _numbered(signatures: DataFrame) -> DataFrame:
    """Signatures with a gapless number ``at`` in the order of host and path."""
    ordered = signatures.orderBy("host", "path", "lines_key").withColumn("__id", F.monotonically_increasing_id())
    ordered = settle(ordered, "signatures").withColumn("__part", F.shiftright("__id", 33))
    # A row for each range.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return settle(ordered.join(F.broadcast(starts), "__part").withColumn("at", F.col("__start") + inside).drop("__id", "__part", "__start"), "numbered")


def differences(pages: DataFrame) -> DataFrame:
    """``(lines_key, shared)``: the lines each different page shares with its nearest one."""
    found = _parse(pages, False).groupBy("lines_key").agg(*[F.first(c).alias(c) for c in ("host", "path", "hashes", "open_chars")])
    numbered = _numbered(found)
    other = numbered.select("at", F.col("host").alias("h"), F.col("path").alias("p"), F.col("hashes").alias("o"))
    before = other.select((F.col("at") + 1).alias("at"), F.struct("h", "p", "o").alias("before"))
    after = other.select((F.col("at") - 1).alias("at"), F.struct("h", "p", "o").alias("after"))
    rows = numbered.join(before, "at", "left").join(after, "at", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                near = [n for n in (row["before"], row["after"]) if n and n["h"] == row["host"]]
                shared: list[int] = []
                if near:
                    # The earlier one of two that begin alike.
                    best = max(near, key=lambda n: _alike(n["p"], row["path"]))
                    shared = shared_lines(row["hashes"], best["o"])
                    sizes = row["open_chars"]
                    if 2 * sum(sizes[i] for i in shared) > sum(sizes):
                        shared = [i for i in shared if not sizes[i]]
                out.append(shared)
            yield pa.RecordBatch.from_arrays([batch["lines_key"], pa.array(out, pa.list_(pa.int32()))], ["lines_key", "shared"])

    return rows.mapInArrow(run, "lines_key long, shared array<int>")


def _alike(a: str, b: str) -> int:
    """Characters that two paths begin alike."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_shared)`` of every row of ``pages``."""
    parsed = _parse(pages, True).join(differences(pages), "lines_key", "left")
    shared = F.coalesce("shared", F.array().cast("array<int>"))
    stays = F.filter("kept", lambda line: line["inside"] | ~F.array_contains(shared, line["at"]))
    open_text = F.array_join(F.transform(stays, lambda line: line["text"]), "\n\n")
    found = parsed.select(
        "page_id", "url", F.when(F.col("kept").isNull(), F.col("text")).otherwise(open_text).alias("text"), F.size(shared).alias("n_shared")
    )
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
