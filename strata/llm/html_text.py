"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL paths; each is aligned with the page before and the page after by
the longest common subsequence of their text lines, and the lines they share are deleted as the site's template:
in articles and main elements only if nearly all pages of the host have them, for two articles may share a sentence.

Differencing alone can't give right results: menus and adverts that change from page to page are not shared.  So of the
lines that are left, mark-up takes those of elements that are never part of an article, and of the zones undecided,
main and article the one with the most text left is the main text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ranked, settled

# Elements of HTML by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody tfoot thead title tr ul".split()
)
NEVER = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video map nav footer aside "
    "button select datalist textarea dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words in classes and ids of elements that are no part of an article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside widget widgets footer masthead "
    "toolbar share sharing social related recommended recommendations comment comments commentlist discussion disqus "
    "replies reply respond copyright disclaimer skip".split()
)
REMARKS = frozenset("comment comments commentlist comment-list comment-body disqus replies reply respond".split())
# Within an article or main element only whole names decide: classes that are site parts there too, and ids that are no
# slugs of a heading.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie-notice "
    "cookie-banner cookie-consent newsletter newsletter-signup subscribe signup login nav navbar breadcrumb breadcrumbs "
    "pagination pager sidebar widget widgets toolbar share sharing share-buttons social-share social-links related "
    "related-posts related-articles recommended recommendations popup modal".split()
) | REMARKS
CHROME_IDS = frozenset("comments commentlist disqus disqus_thread respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Names that begin so describe the layout around a part, not the part.
ABOUT = ("has-", "no-", "with-", "without-")

OUT, FREE, MAIN, ARTICLE = range(4)
# Share of the lines outside of site parts from which on two pages are copies, and their shared lines say nothing.
COPY = 0.9
# Share of the pages of a host from which on a line of their articles is the site's.
SITE_SHARE = 0.9
# Bits of alignment state kept for tracing back; larger alignments are halved first.
TRACE_BITS = 1 << 27


# Elements whose content is text up to their end tag, and of these the ones with character references.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
REFERENCES = frozenset("textarea title".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_REST = re.compile(r"[\s/]*>?")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, dict]]:
    """("text" | "start" | "end", text or element name, attributes) of any mark-up, in one pass.

    What is not closed is read as browsers do: a comment or raw element runs to the end of the page, a declaration
    of any kind to the next ``>``.  A quote that is never closed belongs to a value without quotes.  No part of the
    page is read twice.
    """
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", unescape(page[at:mark]), {}
        if mark == size:
            return
        following = page[mark + 1 : mark + 2]
        if page.startswith("<!--", mark):
            short = page.startswith((">", "->"), mark + 4)
            end = page.find(">" if short else "-->", mark + 4)
            at = size if end < 0 else end + 1 if short else end + 3
            continue
        if following in ("/", "!", "?"):
            name = _NAME.match(page, mark + 2) if following == "/" else None
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            if name:
                yield "end", name[0].lower(), {}
            continue
        name = _NAME.match(page, mark + 1)
        if name is None:
            yield "text", "<", {}
            at = mark + 1
            continue
        tag, at = name[0].lower(), name.end()
        attributes: dict[str, str] = {}
        while (found := _ATTRIBUTE.match(page, at)) is not None:
            at = found.end()
            key = found[1].lower()
            if key not in attributes:
                value = next((v for v in found.groups()[1:] if v is not None), "")
                attributes[key] = unescape(value) if "&" in value else value
        at = _REST.match(page, at).end()
        yield "start", tag, attributes
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            stop = end.start() if end else size
            if tag in REFERENCES and stop > at:
                yield "text", unescape(page[at:stop]), {}
            at = stop


class _Lines:
    """Collects (zone, line) of a page; a line is the text of a block with its white space made single spaces."""

    def __init__(self):
        self.lines: list[tuple[int, str, int]] = []  # with the innermost hinted element around the line
        self.open: list[tuple[str, int, int]] = []  # element, zone and innermost hinted element around it
        self.where: dict[str, list[int]] = {}  # places of the open elements of each name
        self.blocks: list[int] = []  # places of the open blocks
        self.zone = FREE
        self.within = -1
        self.outer: list[int] = []  # the hinted element around each hinted element
        self.holders: set[int] = set()  # hinted elements that hold an article or main element
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            self.parts = []
            if line:
                self.lines.append((self.zone, line, self.within))

    def start(self, tag: str, attrs: dict) -> None:
        if tag in BLOCK:
            self.flush()
            # A paragraph ends where a block begins.
            if any(name == "p" for name, *_ in self.open[-4:]):
                self.end("p")
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "br":
            return
        inside, hinted = self._inside(tag, attrs), self._hinted(tag, attrs)
        if inside != self.zone or hinted:
            self.flush()
        at = len(self.open)
        self.open.append((tag, self.zone, self.within))
        self.where.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if hinted and inside != OUT:
            self.outer.append(self.within)
            self.within = len(self.outer) - 1
        elif inside != OUT and (tag in ("article", "main") or (attrs.get("role") or "").lower() == "main"):
            holder = self.within
            while holder >= 0 and holder not in self.holders:
                self.holders.add(holder)
                holder = self.outer[holder]
        self.zone = inside

    def _hinted(self, tag: str, attrs: dict) -> bool:
        """Whether the element goes unless it holds the article."""
        if tag == "form":
            return True
        if not attrs or tag in ("html", "body", "article", "main") or tag in HEADINGS or (attrs.get("role") or "").lower() == "main":
            return False
        classes, names = (attrs.get("class") or "").lower().split(), (attrs.get("id") or "").lower().split()
        if self.zone in (MAIN, ARTICLE):
            return not CHROME.isdisjoint(classes) or not CHROME_IDS.isdisjoint(names)
        names = " ".join(n for n in classes + names if not n.startswith(ABOUT))
        return not HINTS.isdisjoint(re.split(r"[^a-z0-9]+", names))

    def _inside(self, tag: str, attrs: dict) -> int:
        if self.zone == OUT or tag in NEVER:
            return OUT
        if not attrs and tag not in ("article", "main", "header"):
            return self.zone
        if "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return OUT
        role = (attrs.get("role") or "").lower()
        if role in ROLES or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return OUT
        if tag == "article":
            remark = REMARKS.intersection((attrs.get("class") or "").lower().split())
            return OUT if remark or (attrs.get("id") or "").lower() in CHROME_IDS else ARTICLE
        if tag == "main" or role == "main":
            return max(self.zone, MAIN)
        if tag == "header" and self.zone != ARTICLE:
            return OUT
        return self.zone

    def resolved(self) -> list[tuple[int, str]]:
        """(zone, line) with what hinted elements hold out.  One stays if it holds more text of articles and main
        elements than is found outside of such elements, the largest first: then it is laid around the article."""
        own = [0] * (len(self.outer) + 1)  # the last place is for lines outside of them
        for zone, line, within in self.lines:
            if zone >= MAIN:
                own[within] += len(line)
        held = own[:-1]
        for h in range(len(held) - 1, -1, -1):
            if self.outer[h] >= 0:
                held[self.outer[h]] += held[h]
        kept, found = {-1}, own[-1]
        # An element comes before those in it: it holds no less and was opened earlier.
        for h in sorted(self.holders, key=lambda h: (-held[h], h)):
            if held[h] <= found:
                break
            kept.add(h)
            found += own[h]
        return [(zone if within in kept else OUT, x) for zone, x, within in self.lines]

    def end(self, tag: str) -> None:
        """Closes the last open element of the name with all in it; an inline one closes no block."""
        places = self.where.get(tag)
        if not places or (tag not in BLOCK and self.blocks and places[-1] < self.blocks[-1]):
            return
        at = places[-1]
        if self.open[at][1:] != (self.zone, self.within):
            self.flush()
        _, self.zone, self.within = self.open[at]
        for name, *_ in self.open[at:]:
            self.where[name].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        del self.open[at:]


def page_lines(html: str | None) -> list[tuple[int, str]]:
    """(zone, line) of a page in page order; the zones are those of the mark-up alone."""
    page = _Lines()
    for kind, text, attributes in tokens(html or ""):
        if kind == "text":
            page.parts.append(text)
        elif kind == "start":
            page.start(text, attributes)
        else:
            if text in BLOCK:
                page.flush()
            page.end(text)
    page.flush()
    return page.resolved()


def _masks(lines: list) -> dict:
    masks: dict = {}
    for at, line in enumerate(lines):
        masks[line] = masks.get(line, 0) | 1 << at
    return masks


def _steps(a: list, b: list) -> Iterator[int]:
    """After each line of ``a``: a number whose zero bits mark where the common subsequence with ``b`` grows."""
    masks, full = _masks(b), (1 << len(b)) - 1
    state = full
    yield state
    for line in a:
        met = state & masks.get(line, 0)
        state = ((state + met) | (state - met)) & full
        yield state


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    state = 0
    for state in _steps(a, b):
        pass
    bits = np.frombuffer(state.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    grown = 1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(grown)])


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, by bit-parallel steps; large ones by halves."""
    in_both = set(a) & set(b)
    at, bt = [i for i, x in enumerate(a) if x in in_both], [j for j, x in enumerate(b) if x in in_both]
    pairs = _aligned([a[i] for i in at], [b[j] for j in bt])
    return [(at[i], bt[j]) for i, j in pairs]


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TRACE_BITS:
        half = len(a) // 2
        ahead = _prefix_lengths(a[:half], b)
        behind = _prefix_lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int((ahead + behind).argmax())
        return _aligned(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _aligned(a[half:], b[cut:])]
    states = list(_steps(a, b))
    i, j, found = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif states[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return found[::-1]


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def line_code(zone: int, line: str) -> int:
    """The hash of a line with its zone in the lowest two bits."""
    return line_hash(line) & ~3 | zone


SHARED, MARKED, ASIDE, KEPT = "shared", "mark-up", "other zone", "kept"


def decided(lines: list[tuple[int, str]], neighbours: list[list[int]], site: frozenset[int] = frozenset()) -> list[str]:
    """What becomes of each line, in order: deleted as shared, by mark-up, for its zone, or kept.

    ``neighbours`` are the line codes of the pages beside.  Lines aligned with a neighbour are deleted first, in all
    zones: undecided ones unless the neighbour is a copy of nearly all of the page, those of articles and main elements if
    ``site`` holds them (hashes of the lines that stand in nearly all pages of the host): two articles may well have
    a sentence in common.  Mark-up decides about the rest: lines that are no part of an article go, and of the other
    zones the one with most text left is kept, the one with more mark-up of equals.
    """
    own = [line_hash(line) >> 2 for _, line in lines]
    mine = {i for i, (zone, _) in enumerate(lines) if zone != OUT}
    shared: set[int] = set()
    for other in neighbours:
        pairs = common_subsequence(own, [code >> 2 for code in other])
        theirs = {j for j, code in enumerate(other) if code & 3 != OUT}
        met = {i for i, _ in pairs}
        silent = len(mine & met) >= COPY * len(mine) and len(theirs.intersection(j for _, j in pairs)) >= COPY * len(theirs)
        shared |= {i for i in met if lines[i][0] == OUT or own[i] in site or (lines[i][0] == FREE and not silent)}
    sizes = dict.fromkeys((ARTICLE, MAIN, FREE), 0)
    for i, (zone, line) in enumerate(lines):
        if zone != OUT and i not in shared:
            sizes[zone] += len(line)
    best = max(sizes, key=sizes.get)
    fate = {OUT: MARKED, best: KEPT}
    return [SHARED if i in shared else fate.get(zone, ASIDE) for i, (zone, _) in enumerate(lines)]


def main_text(lines: list[tuple[int, str]], neighbours: list[list[int]], site: frozenset[int] = frozenset()) -> str:
    """The lines that are kept, see :func:`decided`."""
    return "\n".join(line for (_, line), fate in zip(lines, decided(lines, neighbours, site), strict=True) if fate == KEPT)


def _place(url: str | None) -> tuple[str | None, str | None]:
    try:
        parts = urlsplit(url or "")
        return parts.hostname or None, parts.path
    except ValueError:
        return None, None


def _digest(codes: list[int]) -> bytes:
    return xxhash.xxh128_digest(np.array(codes, np.int64).tobytes())


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [_place(u) for u in batch.column(1).to_pylist()]
        hashes = [[line_code(*line) for line in page_lines(h)] for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([p[0] for p in places], pa.string()),
             pa.array([p[1] for p in places], pa.string()), pa.array([_digest(h) for h in hashes], pa.binary()),
             pa.array(hashes, pa.list_(pa.int64()))],
            ["id", "url", "host", "path", "digest", "hashes"],
        )


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        pages = [page_lines(h) for h in batch.column(2).to_pylist()]
        packed = [pack(json.dumps(lines).encode()) for lines in pages]
        hosts = [_place(u)[0] for u in batch.column(1).to_pylist()]
        digests = [_digest([line_code(*line) for line in lines]) for lines in pages]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
            ["id", "url", "host", "digest", "packed"],
        )


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, counts = [], []
        for packed, *near, site in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
            lines = json.loads(unpack(packed))
            fates = decided(lines, [n for n in near if n], frozenset(h >> 2 for h in site or ()))
            kept = (line for (_, line), fate in zip(lines, fates, strict=True) if fate == KEPT)
            texts.append("\n".join(kept).encode("utf-8", "replace").decode())
            counts.append([fates.count(fate) for fate in (SHARED, MARKED, ASIDE, KEPT)])
        columns = [pa.array(c, pa.int64()) for c in (list(map(len, texts)), *(zip(*counts, strict=True) if counts else [()] * 4))]
        names = ["id", "url", "text", "n_chars", "n_shared", "n_marked", "n_aside", "n_kept"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *columns], names)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", site_share: float = SITE_SHARE
) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars, and the numbers of lines deleted as shared (n_shared), by
    mark-up (n_marked), for standing in another zone (n_aside), and kept (n_kept).

    Neighbours are the pages before and after in the order (path, id, url) among those of the host, for the first and
    last page the two next to it; a page without host, or alone on its host, has none.  Pages of a host with equal
    lines, repeated rows among them, stand as one in the order, at the place of the first, and have equal texts.  A
    neighbour that differs but shares nearly all lines still counts as a neighbour and deletes no undecided ones.
    Lines of articles are the site's if at least ``site_share`` of the different pages of a host, three or more, have
    them.  Null pages count as empty and have an empty text; repeated rows are repeated in the result.  An empty table
    gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    hashed = settled(
        rows.mapInArrow(_hash_batches, "id long, url string, host string, path string, digest binary, hashes array<long>"), "hashes"
    )
    # One row per host and page content: copies in any number are summed up before the shuffle.
    places = settled(
        hashed.where(F.col("host").isNotNull())
        .groupBy("host", "digest")
        .agg(F.min(F.struct("path", "id", "url")).alias("first"), F.min("hashes").alias("hashes"))
        .select("host", "digest", "first.*", "hashes"),
        "places",
    )
    # A line in nearly all pages of a host is in nearly any of them, so the lists are no longer than a page.
    inside = places.select("host", F.explode(F.array_distinct(F.filter("hashes", lambda c: c.bitwiseAND(F.lit(3)) >= MAIN))).alias("line"))
    counted = inside.groupBy("host", F.expr("line & ~3L").alias("line")).count()
    per_host = places.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages > 2")
    site = settled(
        counted.where("count > 2").join(per_host, "host").where(F.col("count") >= site_share * F.col("pages"))
        .groupBy("host").agg(F.collect_set("line").alias("site")),
        "site",
    )
    order = ranked(places, "host", "path", "id", "url", "digest", name="order")
    order = settled(order.select("rank", "host", "digest", "hashes"), "ranks")
    side = lambda step, name: order.select(
        (F.col("rank") + step).alias("rank"), F.col("host").alias(f"{name}_host"), F.col("hashes").alias(name)
    )
    near = lambda name: F.when(F.col("host") == F.col(f"{name}_host"), F.col(name))
    beside = settled(
        order.drop("hashes")
        .join(side(1, "before"), "rank", "left")
        .join(side(-1, "after"), "rank", "left")
        .join(side(2, "before2"), "rank", "left")
        .join(side(-2, "after2"), "rank", "left")
        .join(site, "host", "left")
        .select(
            "host", "digest",
            F.coalesce(near("before"), near("after2")).alias("before"), F.coalesce(near("after"), near("before2")).alias("after"), "site",
        ),
        "beside",
    )
    packed = rows.mapInArrow(_packed_batches, "id long, url string, host string, digest binary, packed binary")
    met = packed.join(beside.hint("merge"), ["host", "digest"], "left").select("id", "url", "packed", "before", "after", "site")
    counts = "n_chars long, n_shared long, n_marked long, n_aside long, n_kept long"
    texts = met.mapInArrow(_text_batches, f"id long, url string, text string, {counts}")
    return texts.withColumnsRenamed({"id": id_col, "url": url_col})
