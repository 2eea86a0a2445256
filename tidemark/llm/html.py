"""Main text of web pages, by differencing each page with its nearest neighbour by URL.

Pages of a host are put in order of path; each is paired with the neighbour whose path
shares the longer beginning (the earlier one on ties).  Both pages' lines of text (blocks)
are aligned by their longest common subsequence, and lines that a page shares with its pair
are deleted as template.  A neighbour that holds all lines of the page, or whose lines the page
all holds, is a copy and tells nothing of template: the other neighbour is taken, or no line is
deleted as shared.

Articles quote each other and pages have versions, so a paragraph (``p``, ``blockquote``,
``pre``) goes as shared only if both neighbours share it, neither of which shares half or more
of the page's paragraphs.

Differencing alone is not exact: navigation that differs from page to page would stay.  An
exact check on structure follows it on every page.  Lines inside the page's main element
(``article``, ``main`` or its role) are protected: they are never deleted as shared.  Lines in
navigation, headers, footers, asides, forms, scripts, styles, or in blocks named as notices,
adverts, menus or comments are deleted although no other page shares them, and if a page has a
main element, so are lines outside it.  Inside a main element, names count only on containers
(``div`` and the like) and only where they say one thing: the whole class or id is such a word,
or one of its words is among :data:`PLAIN`.  A form that holds the main element is the page's,
not the article's; so is any named block if the page would have no article otherwise.

Only hashes of lines travel to find the pair: a hot host is dealt out by range of path, not
by host, and texts cross the network once.

Defined results: null html is an empty page with empty text; a null or unreadable URL counts
as host and path ''.  Pages that repeat a URL are neighbours in order of ``page_id``; repeated
rows are kept row by row.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialize

# Names from the HTML standard and names in common use for page furniture.
BLOCKS = """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary
table tbody td textarea tfoot th thead title tr ul""".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
SKIPPED = "head nav header footer aside form script style noscript template iframe svg button select textarea object dialog menu title".split()
RAW = "script style noscript template iframe svg textarea title".split()
FURNITURE = """ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related
reply replies replies-list respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
#: Names that say one thing wherever they stand among others.
PLAIN = """ad ads advert advertisement advertising breadcrumb breadcrumbs comment comments comment-list comments-list cookie cookies
disqus navbar newsletter pagination sidebar sponsored""".split()
CONTAINERS = "div section ul ol dl table".split()
PROSE = "p blockquote pre".split()
ROLES = "navigation banner contentinfo complementary search form alert dialog menu menubar".split()

_TAG = re.compile(r"<(?:!--(?:>|->|(.*?)(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|([!?/][^>]*)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_BLOCKS, _VOID, _SKIPPED, _RAW, _FURNITURE, _ROLES = map(frozenset, (BLOCKS, VOID, SKIPPED, RAW, FURNITURE, ROLES))
_PLAIN, _CONTAINERS, _PROSE = map(frozenset, (PLAIN, CONTAINERS, PROSE))
# Closing a block closes what is open within it; these end at the next of their kind.
_IMPLIED = {"p": _BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}


#: Why an element's text is no part of the article: its kind, being a form, or its name.
ELEMENT, FORM, NAMED = 1, 2, 3


def _furniture(name: str, attributes: str, inside: bool) -> int:
    """What kind of furniture an element is, or 0; ``inside`` a main element names count for less."""
    if name in _SKIPPED:
        return FORM if name == "form" else ELEMENT
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return ELEMENT
        if kind == "role" and value.lower() in _ROLES:
            return ELEMENT
        if kind in ("class", "id"):
            if not inside:
                named = any(w.lower() in _FURNITURE for w in _SPLIT.split(value))
            else:
                words = value.lower().split()
                named = name in _CONTAINERS and (len(words) == 1 and words[0] in _FURNITURE or not _PLAIN.isdisjoint(words))
            found = NAMED if named else found
    return found


@dataclass
class Line:
    """A block's text; whether it is in a main element, in furniture, and a paragraph."""

    text: str
    main: bool
    bad: bool
    prose: bool


def lines(page: str) -> list[Line]:
    """The blocks of a page that have text, in order."""
    out: list[Line] = []
    around: list[bool] = []  # of each line, whether a named block around its main element makes it furniture
    text: list[str] = []
    stack: list[tuple[str, int, bool, tuple[int, int]]] = []  # name, furniture, opens main, forms and names outside it
    count = [0, 0, 0, 0]  # open furniture of each kind, of forms and names those within the innermost main element
    main = outer = 0  # outer: named blocks around the outermost main element
    depth: Counter[str] = Counter()  # of open elements, by name

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                block = next((n for n, *_ in reversed(stack) if n in _BLOCKS), "")
                out.append(Line(line, main > 0, any(count), block in _PROSE))
                around.append(outer > 0)
            text.clear()

    def close() -> None:
        nonlocal main, outer
        gone, kind, was_main, held = stack.pop()
        depth[gone] -= 1
        if was_main:
            main -= 1
            count[FORM] = held[0]
            if not main:
                count[NAMED], outer = held[1], 0
        elif kind:
            count[kind] -= 1

    at, end = 0, len(page)
    while at < end:
        spot = page.find("<", at)
        if spot < 0:
            spot = end
        if spot > at:
            text.append(entities.unescape(page[at:spot]) if "&" in page[at:spot] else page[at:spot])
        if spot == end:
            break
        found = _TAG.match(page, spot)
        if not found:
            if page.startswith(("</", "<!", "<?"), spot) or page[spot + 1 : spot + 2].isalpha():
                break  # a tag that the page's end cuts off
            text.append("<")
            at = spot + 1
            continue
        at = found.end()
        name = found[3]
        if name is None:
            continue
        name = name.lower()
        if not found[2]:
            if name in _BLOCKS:
                flush()
            while stack and stack[-1][0] in _IMPLIED and name in _IMPLIED[stack[-1][0]]:
                close()
            if name in _VOID or found[4].endswith("/") and name not in _BLOCKS:
                continue
            kind = _furniture(name, found[4], main > 0)
            if kind and not any(count):
                flush()
            is_main = name in ("article", "main") or "role" in found[4] and re.search(r"role\s*=\s*[\"']?main\b", found[4]) is not None
            stack.append((name, 0 if is_main else kind, is_main, (count[FORM], count[NAMED])))
            depth[name] += 1
            if is_main:
                main += 1
                count[FORM] = 0
                if main == 1:
                    count[NAMED], outer = 0, count[NAMED]
            elif kind:
                count[kind] += 1
            if name in _RAW:
                stop = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(page, at)
                close()
                at = stop.end() if stop else end
        else:
            if name in _BLOCKS or any(count):
                flush()
            for i in range(len(stack) - 1 if depth[name] else -1, -1, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        if stack[-1][1]:
                            flush()
                        close()
                    break
                if stack[i][0] in _BLOCKS and name not in _BLOCKS:
                    break
    flush()
    if any(x.main and not x.bad and not o for x, o in zip(out, around)):
        for x, o in zip(out, around):
            x.bad = x.bad or o
    return out


#: Bits of the table that :func:`_common` may keep; beyond it sequences are halved.
_TABLE = 1 << 24


class _Masks:
    """Bit rows of the places of each item of a sequence, made as they are asked for: kept are
    only those of items with many places, of which there are few."""

    def __init__(self, b: list):
        self.places: dict = {}
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(j)
        self.often = {x: self._row(p) for x, p in self.places.items() if len(p) > 64}

    @staticmethod
    def _row(places: list[int]) -> int:
        row = bytearray(places[-1] // 8 + 1)
        for j in places:
            row[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(row, "little")

    def get(self, x) -> int:
        found = self.places.get(x)
        if found is None:
            return 0
        return 1 << found[0] if len(found) == 1 else self.often.get(x) or self._row(found)


def _reach(a: list, b: list) -> np.ndarray:
    """The longest common subsequence's length of ``a`` with each beginning of ``b``."""
    mask, full = _Masks(b), (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & mask.get(x)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in memory linear in both lengths:
    ``a`` is halved, and ``b`` cut where the halves' lengths add up to most."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > _TABLE:
        half = len(a) // 2
        j = int(np.argmax(_reach(a[:half], b) + _reach(a[half:][::-1], b[::-1])[::-1]))
        return _common(a[:half], b[:j]) + [half + i for i in _common(a[half:], b[j:])]
    mask, full = _Masks(b), (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        rows.append(v)
        u = v & mask.get(x)
        v = ((v + u) | (v - u)) & full
    j, back = len(b), []
    # the zero bits of a row below j count the longest common subsequence of the prefixes
    for i in range(len(a) - 1, -1, -1):
        after = v if i == len(a) - 1 else rows[i + 1]
        low = (1 << j) - 1
        if (~after & low).bit_count() > (~rows[i] & low).bit_count():
            back.append(i)
            # shrink j to just below the match
            need = (~after & low).bit_count()
            while j and (~after & ((1 << (j - 1)) - 1)).bit_count() == need:
                j -= 1
            j -= 1
    return back[::-1]


def shared(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = _common(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*range(head), *(head + i for i in found), *range(len(a) - tail, len(a))]


def told(mine: list[int], here: list[int], other: list[int]) -> tuple[bool, list[int], list[int]]:
    """What a neighbour tells of a page's template, from hashes of both pages' lines and the
    places ``here`` that they share: whether it does (it is no copy), shared places that are no
    paragraphs, and those that are (none if the neighbour is a version of the page)."""
    if len(here) >= min(len(mine), len(other)):
        return False, [], []
    prose = [i for i in here if mine[i] & 1]
    version = 2 * len(prose) >= sum(x & 1 for x in mine)
    return True, [i for i in here if not mine[i] & 1], [] if version else prose


def kept(page: list[Line], also: set[int]) -> list[bool]:
    """Which lines are the article's, given the places of the lines that differencing deletes."""
    has_main = any(x.main for x in page)
    return [(x.main or i not in also and not has_main) and not x.bad for i, x in enumerate(page)]


def main_text(page: list[Line], also: set[int]) -> str:
    """A page's text, given the places of the lines that differencing deletes."""
    return " ".join(x.text for x, k in zip(page, kept(page, also)) if k)


def hashed_line(x: Line) -> int:
    """A signed 64-bit hash of a line's text, its last bit telling whether it is a paragraph."""
    h = xxhash.xxh3_64_intdigest(x.text) - (1 << 63)
    return h & ~1 | x.prose


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_lines, n_shared, n_structure, n_protected) of each row.

    ``n_shared`` counts lines that differencing deletes, ``n_structure`` those that only
    structure deletes, ``n_protected`` those shared with the pair that structure keeps.
    """
    source = pages.select(F.col(key), F.col(url), F.col(body), F.xxhash64(url, body).alias("th"))
    kind = source.schema[key].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1), F.lit(""))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[hashed_line(x) for x in lines(page.as_py() or "")] for page in batch.column(4)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.list_(pa.int64()))], names=[key, "th", "host", "path", "hashes"])

    light = map_batches(
        source.select(key, "th", host.alias("host"), path.alias("path"), body),
        hashed, f"`{key}` {kind}, th long, host string, path string, hashes array<long>",
    )
    # dealing out by range reads its input twice, once for samples
    ordered = materialize(
        materialize(light)
        .repartitionByRange("host", "path", F.col(key), "th")
        .sortWithinPartitions("host", "path", key, "th")
        .withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33)
    # the next position in order: the next in the partition, or the first of the next partition that has rows
    ends = ordered.groupBy(part.alias("p")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    follows = ends.select("last", F.lead("first").over(Window.orderBy("p")).alias("next"))
    placed = ordered.join(F.broadcast(follows), ordered["at"] == follows["last"], "left").select(
        ordered["*"], F.when(F.col("last").isNull(), F.col("at") + 1).otherwise(F.col("next")).alias("next")
    )
    a, b = placed.alias("a"), ordered.alias("b")
    beside = a.join(b, (F.col("a.next") == F.col("b.at")) & (F.col("a.host") == F.col("b.host")))

    def common(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of two neighbours: what each shares with the other, and how far their paths agree."""
        out = []
        for left, right, p, q, i, j in zip(*(c.to_pylist() for c in batch.columns)):
            n = 0
            while n < min(len(p), len(q)) and p[n] == q[n]:
                n += 1
            here, there = shared(left, right), shared(right, left)
            out += [(i, n, 0, *told(left, here, right)), (j, n, 1, *told(right, there, left))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["at", "n", "earlier", "tells", "also", "prose"])

    paired = map_batches(
        beside.select(F.col("a.hashes").alias("x"), F.col("b.hashes").alias("y"), F.col("a.path").alias("p"), F.col("b.path").alias("q"), F.col("a.at").alias("i"), F.col("b.at").alias("j")),
        common, "at long, n int, earlier int, tells boolean, also array<int>, prose array<int>",
    )
    nearest = paired.groupBy("at").agg(
        F.max(F.struct("tells", "n", "earlier", "also")).alias("best"), F.collect_list("prose").alias("prose")  # of two neighbours at most
    )
    both = F.when(F.size("prose") == 2, F.array_intersect(F.get("prose", F.lit(0)), F.get("prose", F.lit(1))))
    gone = F.concat("best.also", F.coalesce(both, F.array().cast("array<int>"))).alias("also")
    also = ordered.select(key, "th", "at").join(nearest, "at").groupBy(key, "th").agg(F.min(gone).alias("also"))

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=3)
        column = [None if x.as_py() is None else z.compress(x.as_py().encode("utf-8")) for x in batch.column(3)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(column, pa.binary())], names=["__k", url, "__t", "z"])

    packed = map_batches(source.select(key, url, "th", body), squeeze, f"__k {kind}, `{url}` string, __t long, z binary")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        plain, texts, sizes = zstandard.ZstdDecompressor(), [], []
        for z, places in zip(batch.column(2), batch.column(3)):
            body, gone = z.as_py(), set(places.as_py() or [])
            page = lines(plain.decompress(body).decode("utf-8")) if body else []
            stay = kept(page, gone)
            texts.append(" ".join(x.text for x, k in zip(page, stay) if k))
            by_pair = sum(i in gone and not x.main for i, x in enumerate(page))
            sizes.append((len(texts[-1]), len(page), by_pair, len(page) - sum(stay) - by_pair, sum(i in gone and k for i, k in enumerate(stay))))
        columns = [*batch.columns[:2], pa.array(texts, pa.string()), *(pa.array([r[i] for r in sizes], pa.int64()) for i in range(len(counts)))]
        return pa.RecordBatch.from_arrays(columns, names=[key, url, "text", *counts])

    counts = ["n_chars", "n_lines", "n_shared", "n_structure", "n_protected"]
    met = packed.join(also, packed["__k"].eqNullSafe(also[key]) & (packed["__t"] == also["th"]), "left")
    return map_batches(met.select("__k", url, "z", "also"), cut, f"`{key}` {kind}, `{url}` string, text string, " + ", ".join(f"{c} long" for c in counts))
