"""Main text of HTML pages.

A suffix array per host over the token streams of all its pages shows the long
substrings that distinct pages repeat outside articles; what such a run covers
is boilerplate. An exact check by the page's own markup (article, navigation,
footer and so on) follows: text inside an article or main element is kept
whole, because articles are themselves copied between pages and quote the same
lines, and the rest of such a page goes, as most menus and adverts stand on one
page only; of pages without one, blocks that markup doesn't call boilerplate
lose the runs that at least three pages and a fifth of the host's pages have.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingles, small, stage
from .url_cascade import split_url

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: What follows a tag's name, up to its end. An open quote is a plain character.
_REST = re.compile(r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+|=)*+>""")
_ATTRIBUTE = re.compile(r"""[\s/](class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
_DROPPED = frozenset("head nav header footer aside form menu button select dialog template noscript svg object".split())
_MAIN = frozenset({"article", "main"})
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Start tags that end an open paragraph.
_END_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Start tag -> open elements it ends, and where the search for them stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "button": ({"button"}, set()),
}
_WALLS = frozenset("button caption object table td template th".split())
_TABLE = frozenset("table caption tbody td tfoot th thead tr".split())
#: class, id or role that as a whole names boilerplate.
_NAMES = re.compile(
    r"(?:ads?|adverts?|advertisements?|sponsored|promo|banner|breadcrumbs?|masthead|newsletter|subscribe|sidebar|menu|nav|navbar|navigation|complementary|contentinfo|search|popup|modal|notice"
    r"|(?:cookies?|consent)(?:[-_](?:notice|banner|bar|consent))?|(?:site|page)[-_](?:header|footer|nav|menu)|footer|comments?(?:[-_](?:list|section|area))?|replies|respond|(?:social|share)[-_](?:buttons|links|bar)|related[-_](?:posts|articles|links))",
    re.I,
)
_SPACE = re.compile(r"\s+")

ARTICLE, UNKNOWN, CHROME = 2, 1, 0
#: Open elements further up than this aren't looked for, so that a tag's cost is bounded.
_DEEPEST = 1000


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(region, text) of each block in page order; white space is made single.

    End tags that HTML lets authors leave out (of head, p, li, td and so on) are
    implied; a tag or comment that never ends takes the rest of the page.
    Each character is looked at a bounded number of times.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    region, at, n = UNKNOWN, 0, len(page)

    def close() -> None:
        if text:
            if joined := _SPACE.sub(" ", html.unescape("".join(text))).strip():
                out.append((region, joined))
            text.clear()

    def end(names, walls) -> None:
        """Ends the innermost open element of these names, unless a wall stands before it."""
        nonlocal region
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, max(-1, len(stack) - _DEEPEST), -1):
            if stack[k][0] in names:
                region = stack[k][1]
                opened.subtract(x for x, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in walls:
                return

    while at < n:
        lt = page.find("<", at)
        if lt != at:
            piece = page[at : lt if lt >= 0 else n]
            if stack and stack[-1][0] == "head" and not piece.isspace():
                end({"head"}, ())
            text.append(piece)
            at = lt if lt >= 0 else n
            continue
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            stop = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            if stop < at + 2:
                break
            at = stop + 1
            continue
        closing = mark == "/"
        named = _NAME.match(page, at + 1 + closing)
        if named is None:
            if closing:  # a bogus comment
                stop = page.find(">", at)
                if stop < 0:
                    break
                at = stop + 1
            else:
                text.append("<")
                at += 1
            continue
        rest = _REST.match(page, named.end())
        if rest is None:
            break
        at, name = rest.end(), named[0].lower()
        if stack and stack[-1][0] == "head" and not closing and name not in _IN_HEAD:
            close()
            end({"head"}, ())
        if name == "br":
            text.append(" ")
            continue
        if name in _INLINE:
            continue
        close()
        if closing:
            if name not in ("body", "html"):
                end({name}, () if name in _TABLE or name in _MAIN or name in _WALLS else _WALLS)
            continue
        if name in _RAW:
            stop = _RAW[name].search(page, at)
            if stop is None:
                break
            at = page.find(">", stop.end()) + 1 or n
            continue
        if name in _END_P:
            end({"p"}, _WALLS)
        if name in _ENDS:
            end(*_ENDS[name])
        if name in _VOID:
            continue
        if name[0] == "h" and name[1:].isdigit() and stack and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
            end({stack[-1][0]}, ())
        stack.append((name, region))
        opened[name] += 1
        if region != CHROME:
            attributes = rest[0]
            if name in _DROPPED:
                region = CHROME
            elif name in _MAIN:
                region = ARTICLE
            elif len(attributes) > 1 and name not in ("body", "html") and any(_NAMES.fullmatch((x[2] or x[3] or x[4] or "").strip()) for x in _ATTRIBUTE.finditer(attributes)):
                region = CHROME
    close()
    return out


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of x's suffixes, by prefix doubling, and the length of the
    prefix that each shares with the one before it."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while step < n and rank.max(initial=0) < n - 1:
        later = np.full(n, -1, dtype=np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, dtype=np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        got = np.zeros(n - 1, dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (np.maximum(a, b) + (1 << k)) <= n
            same = np.zeros(n - 1, dtype=bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            got[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        shared[1:] = got
    return order, shared


def repeated(streams: list[list[int]], least: int, need: int, counts: list[bool] | None = None) -> list[np.ndarray]:
    """For each stream, at which tokens a substring of ``least`` tokens begins
    that at least ``need`` streams have, of those that ``counts`` names (all)."""
    if not streams:
        return []
    # a separator of its own ends each stream
    joined = np.concatenate([np.array([*s, -1 - k], dtype=np.int64) for k, s in enumerate(streams)])
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    order, shared = suffix_array(joined)
    run = np.cumsum(shared < least)
    seen = run * len(streams) + owner[order]
    if counts is not None:
        seen = seen[np.array(counts, dtype=bool)[owner[order]]]
    pages = np.unique(seen) // len(streams)
    begins = np.zeros(len(joined), dtype=bool)
    begins[order[(np.bincount(pages, minlength=run[-1] + 1) >= need)[run]]] = True
    ends = np.cumsum([len(s) + 1 for s in streams])
    # a run shorter than that is the end of a stream, which no other stream has
    return [begins[e - len(s) - 1 : e - 1] & (np.arange(len(s)) <= len(s) - least) for s, e in zip(streams, ends, strict=True)]


def _covered(starts: np.ndarray, n: int, least: int) -> np.ndarray:
    edge = np.zeros(n + least + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge)[:n] > 0


def unique_tokens(begins: np.ndarray, sizes: list[int], least: int) -> np.ndarray:
    """Which tokens stay, of blocks of the given sizes: those of no repeated
    substring. One that reaches into a block from its neighbour counts only if
    the whole block is covered."""
    every, at, out = _covered(np.flatnonzero(begins), len(begins), least), 0, np.ones(len(begins), dtype=bool)
    for n in sizes:
        if every[at : at + n].all():
            out[at : at + n] = False
        else:
            inside = np.flatnonzero(begins[at : at + n])
            out[at : at + n] = ~_covered(inside[inside + least <= n], n, least)
        at += n
    return out


def judged(regions: bytes, blocks: list[str], outside: np.ndarray, inside: np.ndarray, least: int) -> tuple[str, int]:
    """A page's text, and how many of its tokens stand in repeated runs, from
    where such runs begin in its tokens outside and inside articles."""
    sizes = [block.count(" ") + 1 for block in blocks]
    stays = unique_tokens(outside, [n for r, n in zip(regions, sizes, strict=True) if r != ARTICLE], least)
    covered = sum(int(_covered(np.flatnonzero(x), len(x), least).sum()) for x in (outside, inside))
    # the check by markup: an article is whole, whatever of it other pages repeat, and is all of its page's text
    marked, at, kept = ARTICLE in regions, 0, []
    for r, block, n in zip(regions, blocks, sizes, strict=True):
        if r == ARTICLE:
            kept.append(block)
            continue
        if r == UNKNOWN and not marked and stays[at : at + n].any():
            kept.append(" ".join(w for w, c in zip(block.split(" "), stays[at : at + n], strict=True) if c))
        at += n
    return "\n".join(kept), covered


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        regions, packed = [], []
        for page in b.column(4).to_pylist():
            blocks = blocks_of(page or "")
            regions.append(bytes(r for r, _ in blocks))
            packed.append(zlib.compress("\n".join(t for _, t in blocks).encode("utf-8"), 1))
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(regions, pa.binary()), pa.array(packed, pa.binary())], ["page_id", "url", "host", "copy", "regions", "packed"])


def _hosts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([split_url(u)[0] for u in b.column(1).to_pylist()], pa.string())], [*b.schema.names, "host"])


def _opened(regions: bytes, text: str) -> tuple[list[str], list[str], list[str]]:
    """Blocks, which have no line breaks, and the tokens outside and inside articles."""
    blocks = text.split("\n") if regions else []
    split = [[], []]
    for r, block in zip(regions, blocks, strict=True):
        split[r == ARTICLE] += block.split(" ")
    return blocks, *split


def _windows(tokens: list[str], least: int, known: dict[str, int]) -> np.ndarray:
    """A hash of each window of ``least`` tokens; ``known`` keeps those of tokens."""
    if len(tokens) < least:
        return np.zeros(0, dtype=np.int64)
    if len(known) > 1 << 17:
        known.clear()
    for t in tokens:
        if t not in known:
            known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
    return shingles(np.array([known[t] for t in tokens], dtype=np.uint64), least).view(np.int64)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 6, chunk: int = 1000, pages_least: int = 3, share: float = 0.2) -> DataFrame:
    """page_id, url, text, n_repeated of every row.

    Null html and pages without text give an empty text; null urls share the
    empty host. Repeated rows are distinct pages, so three of them repeat each
    other; ties don't arise. Very long pages are read whole, in time linear in
    their length. Other columns, of any name, are ignored; empty in, empty out.

    Every page of every host is in a suffix array. A run of ``least`` tokens or
    more is repeated if at least ``pages_least`` pages and a ``share`` of the
    host's pages have it outside articles; n_repeated is how many tokens of the
    page, its article included, stand in such runs. They leave the text of
    pages without an article, so a text that few pages share stays. A host of
    more than ``chunk`` pages has several suffix arrays. A run that enough of
    its pages have must be as frequent in one of them, so each array names the
    windows that are, and hashes of these are counted over all the host's
    pages: the result is that of one array. Rows equal in all three columns
    share an array.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    sizes = rows.select("page_id", "url").mapInArrow(_hosts, f"page_id {kind}, url string, host string").groupBy("host").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(pages_least), F.ceil(F.col("pages") * share)).cast("int")
    sizes = stage(sizes.select("host", "pages", need.alias("need"), F.ceil(F.col("pages") / chunk).cast("int").alias("chunks")), "hosts")
    hosted = rows.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("copy"), "html").mapInArrow(_hosts, f"page_id {kind}, url string, copy long, html string, host string")
    parsed = hosted.select("page_id", "url", "host", "copy", "html").mapInArrow(_parsed, f"page_id {kind}, url string, host string, copy long, regions binary, packed binary")
    streams = parsed.join(small(sizes), "host").withColumn("chunk", F.pmod("copy", "chunks").cast("int")).drop("copy")

    def of_host(pdf: pd.DataFrame) -> pd.DataFrame:
        several, of_all, need = pdf["chunks"].iloc[0] > 1, int(pdf["pages"].iloc[0]), int(pdf["need"].iloc[0])
        ids: dict[str, int] = {}
        known: dict[str, int] = {}
        lines = [zlib.decompress(x).decode("utf-8") for x in pdf["packed"]]
        opened = [_opened(r, x)[1:] for r, x in zip(pdf["regions"], lines, strict=True)]
        # if no part of the host had a window on its share of the needed pages, all of it would have it on too few
        here = -(-need * len(pdf) // of_all)
        begins = repeated([[ids.setdefault(t, len(ids)) for t in ts] for pair in opened for ts in pair], least, here, [True, False] * len(pdf))
        marks, prints, seen = [], [], set()
        for k, (outside, _) in enumerate(opened):
            new = {int(w) for w in _windows(outside, least, known)[begins[2 * k][: max(0, len(outside) - least + 1)]]} - seen if several else set()
            seen |= new
            prints.append(sorted(new))
            marks.append(b"" if several else np.packbits(np.concatenate(begins[2 * k : 2 * k + 2])).tobytes())
        return pdf[["page_id", "url", "host", "regions"]].assign(lines=lines, several=several, marks=marks, prints=prints)

    found = streams.groupBy("host", "chunk").applyInPandas(of_host, f"page_id {kind}, url string, host string, regions binary, lines string, several boolean, marks binary, prints array<long>")
    # pages of a host lie together and repeat each other: packed by the file, not one by one
    found = stage(found, "found", compression="zstd")

    def by_host(prints: DataFrame, most: int = 500_000) -> DataFrame:
        lists = prints.groupBy("host").agg(F.collect_list("print").alias("wanted"))
        return F.broadcast(lists) if prints.limit(most + 1).count() <= most else lists

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            of: dict[str, list[np.ndarray]] = {}
            for host, regions, lines, wanted in zip(*[b.column(i).to_pylist() for i in range(3)], b.column(3), strict=True):
                w = _windows(_opened(regions, lines)[1], least, known)
                of.setdefault(host, []).append(np.unique(w[np.isin(w, wanted.values.to_numpy())]))
            for host, lists in of.items():
                prints, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(prints), pa.string()), pa.array(prints, pa.int64()), pa.array(n, pa.int64())], ["host", "print", "n"])

    likely = stage(found.where("several").select("host", F.explode("prints").alias("print")).distinct(), "likely")
    counts = found.where("several").select("host", "regions", "lines").join(by_host(likely), "host").select("host", "regions", "lines", "wanted").mapInArrow(counted, "host string, print long, n long")
    common = counts.groupBy("host", "print").agg(F.sum("n").alias("n")).join(small(sizes.select("host", "need")), "host").where("n >= need").select("host", "print")
    common = stage(common, "common")

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            out, covered = [], []
            for regions, lines, several, marks, wanted in zip(*[b.column(i).to_pylist() for i in range(2, 6)], b.column(6), strict=True):
                blocks, *tokens = _opened(regions, lines)
                if several:
                    begins = [np.zeros(len(ts), dtype=bool) for ts in tokens]
                    if wanted.is_valid:
                        for x, ts in zip(begins, tokens, strict=True):
                            w = _windows(ts, least, known)
                            x[: len(w)] = np.isin(w, wanted.values.to_numpy())
                else:
                    n = len(tokens[0])
                    bits = np.unpackbits(np.frombuffer(marks, dtype=np.uint8), count=n + len(tokens[1])).astype(bool)
                    begins = [bits[:n], bits[n:]]
                text, c = judged(regions, blocks, *begins, least)
                out.append(text)
                covered.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(covered, pa.int64())], ["page_id", "url", "text", "n_repeated"])

    whole = found.select("page_id", "url", "host", "regions", "lines", "several", "marks").join(by_host(common), "host", "left")
    return whole.select("page_id", "url", "regions", "lines", "several", "marks", "wanted").mapInArrow(texts, f"page_id {kind}, url string, text string, n_repeated long")
