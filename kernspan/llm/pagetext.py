"""Main text of web pages: page structure, and differences to the nearest page.

A page's visible text is read as lines, one per block element. Lines inside the page's
article (or main) element are its text and stay. Lines outside it, and all lines of a
page without one, are compared with such lines of the page of the same host whose URL
path is nearest: a line that a longest common subsequence aligns in both is template and
goes, the others stay.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernspan.llm.tables import stored

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]{0,8192}\"|'[^']{0,8192}')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style noscript template textarea title iframe object svg canvas math audio video xmp".split())
_SKIPPED = frozenset("head nav footer aside form button select dialog menu datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements a next block closes
_OPEN_ENDED = frozenset("p li dt dd td th tr option".split())
_CONTAINERS = ("article", "main")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_BOILERPLATE = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended recommendations sidebar comment comments disqus replies "
    "breadcrumb breadcrumbs menu nav navbar navigation footer masthead toolbar pagination pager login "
    "signup search complementary contentinfo dialog alert paywall skip".split()
)
#: words that are a verdict on an article or main element too: what these are inside another one
_NO_ARTICLE = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion comment comments disqus replies related recommended".split())
#: a class name that begins or ends so tells how a wrapper is laid out, not what it is
_MODIFIERS = frozenset("has with without no is not show hide hides js supports".split())
_SWITCHES = frozenset("on off enabled disabled open opened closed left right visible active result results".split())
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: more than this share of a page's compared text in common: perhaps copies, so that a second page decides
COPY_SHARE = 0.5


def _is_boilerplate(attributes: str, container: bool = False) -> bool:
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    if _HIDDEN.search(attributes):
        return True
    verdicts = _NO_ARTICLE if container else _BOILERPLATE
    for _, value in _NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            words = _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())
            state = len(words) > 1 and (words[0] in _MODIFIERS or words[-1] in _SWITCHES)
            if not state and not verdicts.isdisjoint(words):
                return True
    return False


def page_lines(source: str | None) -> list[tuple[str, bool]]:
    """(line, inside the container) of a page in order, boilerplate elements left out.

    The container is any article element, or else main; without either no line is
    inside. A skipped element ends with its closing tag; one that a next block closes
    ends there.
    """
    if not source:
        return []
    out: list[tuple[str, str]] = []
    buffer: list[str] = []
    opened: list[str] = []  # containers around this place
    skip, depth = "", 0
    at, end = 0, len(source)

    def flush() -> None:
        line = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if line:
            out.append((line, "article" if "article" in opened else opened[-1] if opened else ""))

    while at < end:
        found = _TAG.search(source, at)
        if not skip:
            buffer.append(source[at : found.start() if found else end])
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing = bool(found[1] or found[4])
        attributes = found[3] if found[2] else found[6]
        if name in _RAW and not closing:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                # an unclosed one holds what follows, as a browser reads it
                at = close.end() if close else end
            continue
        if skip:
            if skip in _OPEN_ENDED and name in _BLOCKS and not (closing and name == skip):
                skip = ""  # and this tag counts
            elif name in _CONTAINERS and not closing and skip not in ("dialog", "aside"):
                skip = ""
                if _is_boilerplate(attributes, container=True):
                    skip, depth = name, 1
                    continue
            elif name == skip:
                depth += -1 if closing else 1
                if depth <= 0:
                    skip = ""
                continue
            else:
                continue
        if name in _BLOCKS:
            flush()
        elif name == "br":
            buffer.append(" ")
        if closing:
            if name in _CONTAINERS and name in opened:
                del opened[len(opened) - 1 - opened[::-1].index(name)]
            continue
        if name in _VOID or name in ("html", "body"):
            continue
        outside_header = name == "header" and not opened
        if name in _SKIPPED or outside_header or _is_boilerplate(attributes, name in _CONTAINERS):
            if not attributes.endswith("/"):
                flush()
                skip, depth = name, 1
            continue
        if name in _CONTAINERS:
            opened.append(name)
    flush()
    kinds = {kind for _, kind in out}
    container = "article" if "article" in kinds else "main" if "main" in kinds else None
    return [(line, container is not None and kind in (container, "article")) for line, kind in out]


#: matching pairs of lines up to which they are walked one by one
MANY_PAIRS = 1_000_000


def common_lines(own: list[int], other: list[int]) -> set[int]:
    """Indices of ``own`` on a longest common subsequence with ``other``.

    Equal ends are taken off first. Patience over the matching pairs takes time in their
    number times its logarithm; where lines repeat so often that pairs are many, halving
    the table by rows takes the product of both lengths and memory in their sum.
    """
    start = 0
    while start < min(len(own), len(other)) and own[start] == other[start]:
        start += 1
    end = 0
    while end < min(len(own), len(other)) - start and own[-1 - end] == other[-1 - end]:
        end += 1
    a, b = own[start : len(own) - end], other[start : len(other) - end]
    often = Counter(b)
    pairs = sum(n * often[line] for line, n in Counter(a).items())
    inner = _patience(a, b) if pairs <= MANY_PAIRS else _halved(np.array(a), np.array(b))
    return {*range(start), *range(len(own) - end, len(own)), *(start + i for i in inner)}


def _patience(own: list[int], other: list[int]) -> Iterator[int]:
    places: dict[int, list[int]] = {}
    for j in range(len(other) - 1, -1, -1):
        places.setdefault(other[j], []).append(j)
    tails: list[int] = []
    chains: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(own):
        for j in places.get(line, ()):
            k = bisect_left(tails, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(link)
            else:
                tails[k], chains[k] = j, link
    chain = chains[-1] if chains else None
    while chain:
        yield chain[0]
        chain = chain[1]


def _last_row(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``own`` with each prefix of ``other``."""
    row = np.zeros(len(other) + 1, np.int32)
    for line in own:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == line)))
    return row


def _halved(own: np.ndarray, other: np.ndarray) -> Iterator[int]:
    """Indices of ``own``, by halves: ``other`` is cut where both halves have most in common."""
    todo = [(0, len(own), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            if (other[c:d] == own[a]).any():
                yield a
            continue
        middle = (a + b) // 2
        before = _last_row(own[a:middle], other[c:d])
        after = _last_row(own[middle:b][::-1], other[c:d][::-1])[::-1]
        cut = c + int((before + after).argmax())
        todo += [(a, middle, c, cut), (middle, b, cut, d)]


# ----------------------------------------------------------------------------- tasks


def _line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each page; place, hash and length of those outside its container."""
    for batch in batches:
        sources = batch.column("html")
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lines, sure, places, hashes, sizes = [], [], [], [], []
            for i in range(at, at + part.num_rows):
                read = page_lines(sources[i].as_py())
                outside = [k for k, (_, inside) in enumerate(read) if not inside]
                lines.append([line for line, _ in read])
                sure.append(len(outside) < len(read))
                places.append(outside)
                hashes.append([_line_hash(read[k][0]) for k in outside])
                sizes.append([len(read[k][0]) for k in outside])
            rest = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in rest],
                    pa.array(lines, pa.list_(pa.string())),
                    pa.array(sure, pa.bool_()),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(hashes, pa.list_(pa.int64())),
                    pa.array(sizes, pa.list_(pa.int64())),
                ],
                [*rest, "lines", "sure", "places", "hashes", "sizes"],
            )


def template_lines(
    own: list[int], sizes: list[int], other: list[int] | None, second: list[int] | None, sure: bool
) -> list[int]:
    """Which of a page's compared lines go. ``other`` is the nearest page, ``second`` the
    one on the other side; ``sure``: the page has a container, whose lines are not among
    these.

    Without a container, lines that are most of the page may be those of a copy. If
    nothing is left beside them they stay; else those go that ``second`` has too.
    """
    if other is None:
        # nothing to compare with: the container says what is text
        return list(range(len(own))) if sure else []
    common = common_lines(own, other)
    if not sure and sum(sizes[k] for k in common) > COPY_SHARE * sum(sizes):
        common = common & common_lines(own, second or []) if len(common) < len(own) else set()
    return sorted(common)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of its compared lines each page loses."""
    names = ("hashes", "sizes", "other", "second", "sure")
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        gone = [template_lines(*row) for row in rows]
        rest = ["key_a", "key_b"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in rest], pa.array(gone, pa.list_(pa.int32()))], [*rest, "gone"]
        )


# -------------------------------------------------------------------------- operator


def _url_part(pattern: str) -> Column:
    return F.regexp_extract(F.coalesce("url", F.lit("")), pattern, 1)


def neighbours(slim: DataFrame) -> DataFrame:
    """``slim`` (host, path, key_a, key_b, hashes, sizes) with ``other``: the hashes of
    the nearest page by URL path within the host, null for a host's only page, and
    ``second``: those of the page on its other side. Further columns stay.

    Nearest is the one before or after in the order of paths with the longer common
    start; ties go to the one before. The order is laid over ranges of rows, so a host
    of very many pages is many tasks; the rows at the edges of a range see the edge of
    the next one through a table of one row a range.
    """
    order = ["host", "path", "key_a", "key_b"]
    ranged = stored(
        slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged"
    )
    page = F.struct(*order, "hashes")
    edges = ranged.groupBy("part").agg(
        F.min(page).alias("first"), F.max(page).alias("last")
    )
    by_part = Window.orderBy("part")  # one row a range
    edges = edges.select(
        "part", F.lag("last").over(by_part).alias("edge_before"), F.lead("first").over(by_part).alias("edge_after")
    )
    within = Window.partitionBy("part").orderBy(*order)
    beside = (
        ranged.join(edges, "part")
        .withColumn("before", F.coalesce(F.lag(page).over(within), "edge_before"))
        .withColumn("after", F.coalesce(F.lead(page).over(within), "edge_after"))
    )

    def common_start(side: str) -> Column:
        longest = F.least(F.length("path"), F.length(f"{side}.path"))
        same = F.aggregate(
            F.sequence(F.lit(0), longest),
            F.lit(0),
            lambda a, n: F.when(
                F.substring(F.col("path"), F.lit(1), n) == F.substring(F.col(f"{side}.path"), F.lit(1), n), n
            ).otherwise(a),
        )
        return F.when(F.col(f"{side}.host") == F.col("host"), same)

    near_before, near_after = common_start("before"), common_start("after")
    other = F.when(
        near_before.isNotNull() & (F.coalesce(near_after, F.lit(-1)) <= near_before), F.col("before.hashes")
    ).when(near_after.isNotNull(), F.col("after.hashes"))
    second = F.when(
        near_before.isNotNull() & near_after.isNotNull(),
        F.when(near_after <= near_before, F.col("after.hashes")).otherwise(F.col("before.hashes")),
    )
    return beside.select(*slim.columns, other.alias("other"), second.alias("second"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Blocks are joined by a line feed, white space within one is a single space, and
    character references are decoded. A null, empty or wholly boilerplate page has an
    empty text. Pages without a container that equal their neighbour keep their lines; a
    page that has more than half of its text in common with it, but not all, loses the
    lines that the page on the other side has too. Rows that repeat are treated alike;
    other columns are not read. An empty table gives no rows.
    """
    keyed = pages.select(
        "page_id", "url",
        F.xxhash64("page_id", "url", "html").alias("key_a"),
        F.xxhash64("html", F.lit(1), "url", "page_id").alias("key_b"),
        "html",
    )
    kinds = dict(keyed.dtypes)
    read = keyed.mapInArrow(
        _extracted,
        f"page_id {kinds['page_id']}, url string, key_a long, key_b long, lines array<string>, "
        "sure boolean, places array<int>, hashes array<long>, sizes array<long>",
    )
    read = stored(read, "lines")
    slim = (
        read.where(F.size("places") > 0)
        .select(
            F.lower(_url_part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")).alias("host"),
            _url_part(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)").alias("path"),
            "key_a", "key_b", "hashes", "sizes", "sure",
        )
        .dropDuplicates(["key_a", "key_b"])
    )
    gone = (
        neighbours(slim)
        .select("key_a", "key_b", "hashes", "sizes", "other", "second", "sure")
        .mapInArrow(_shared, "key_a long, key_b long, gone array<int>")
        .where(F.size("gone") > 0)
    )
    whole = read.where(F.size("places") == 0).select("page_id", "url", "lines")
    lost = F.transform("gone", lambda g: F.get("places", g))
    kept = F.filter(F.col("lines"), lambda line, k: ~F.coalesce(F.array_contains(lost, k), F.lit(False)))
    compared = read.where(F.size("places") > 0).join(gone, ["key_a", "key_b"], "left").select(
        "page_id", "url", kept.alias("lines")
    )
    text = F.array_join("lines", "\n")
    return whole.unionByName(compared).select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars")
    )
