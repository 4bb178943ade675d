"""Main text of web pages: block structure and a suffix array per host.

A page becomes a stream of visible tokens in blocks; each block lies in the article (inside
``article`` or ``main``), in an excluded part (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments, by element or by a word of a class, id or role, whatever other words the
name has: ``post-comments`` is excluded, ``has-sidebar`` is not) or elsewhere. A run of ``RUN``
tokens that stands on two distinct pages of a host, and outside articles at half of its places or
more, is boilerplate. On a page that marks no article every token so covered is removed and the unique
runs of its blocks that aren't excluded are the text. On a page that marks its article that article is
the text but for blocks that runs of half of the host's articles, ``MIN_ARTICLES`` or more, cover wholly: articles quote
lines that stand in other pages' adverts, and nothing of theirs may go. An article that would lose over half of its
tokens is a near copy and stays.

Runs are counted over the whole host, whatever its size. A run of half of a host's articles stands in half of those of
one of its shards at least, so only such runs of a shard are moved and, where the host has several shards, counted in
all of them. Pages without article that have excluded parts only are settled as they are read. For hosts with other pages the distinct streams are
dealt evenly; the suffixes of about ``SHARD_BYTES`` of them at a time are sorted to a depth of
``RUN`` tokens by prefix doubling, so that a run of such a shard is one row: its 128-bit hash (host
included), the smallest and largest page, its places and those outside. These rows are summed by hash,
and the boilerplate runs are joined with the places of the pages that aren't settled.

Defined results: a null or empty html gives the empty text; a null url is a host of its own;
copies (pages of one token stream) count as one page, so repeated rows change no text; an empty table gives no row; columns beyond page_id, url and
html are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.session import cut, stored

RUN = 8
SHARD_BYTES = 2_000_000
#: Articles of a host that a run must stand in to be taken from articles.
MIN_ARTICLES = 4
BROADCAST_HOSTS = 100_000
BROADCAST_RUNS = 500_000

#: A quote opens a value only right after the equals sign.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*)(?:>|(?=<)|\Z)",
    re.S,
)
HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Their content is no text of the page.
RAW = {"script", "style", "title", "textarea", "template", "iframe", "svg", "canvas", "object", "audio", "video"}
EXCLUDED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset"}
ARTICLE = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role that name parts which aren't the article.
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "menu", "nav", "navbar", "navigation", "sidebar", "footer",
    "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "toolbar", "masthead", "pagination", "pager", "complementary", "contentinfo", "search",
}
#: In a name with one of these a word such as ``sidebar`` tells of the layout.
LAYOUT = {"no", "not", "has", "with", "without"}
MAIN, ELSEWHERE, OUT = 0, 1, 2
#: Pages of a part that is read or written at a time.
PART = 256
#: Of the polynomial hash of a run: odd, for each half.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
READ = "page_id long, url string, _host string, _stream string, _zones binary, _p1 long, _p2 long"
ARTICLES = "_host string, _p1 long, _p2 long, _stream string"
SHARED = "_host string, _cut boolean, _h1 long, _h2 long, _pages long, _of long"
COUNTED = "_h1 long, _h2 long, _low long, _high long, _places long, _out long"
PLACED = "_h1 long, _h2 long, _p1 long, _p2 long, _at int"


def blocks(html: str) -> list[tuple[list[str], int]]:
    """(tokens, zone) of a page's blocks in page order."""
    found: list[tuple[list[str], int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element; whether it, or one around it, is excluded, a header, an article
    at = 0

    def zone() -> int:
        if not stack:
            return ELSEWHERE
        _, out, header, article = stack[-1]
        if out or header and not any(re.fullmatch("h[1-6]", s[0]) and article for s in stack):
            return OUT
        return MAIN if article else ELSEWHERE

    def flush() -> None:
        if parts:
            tokens = unescape("".join(parts)).split()
            if tokens:
                found.append((tokens, zone()))
            parts.clear()

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    while True:
        m = MARKUP.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        parts.append(html[at : m.start()])
        at = m.end()
        if at == m.start():
            at += 1
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in INLINE:
                flush()
            if any(s[0] == name for s in stack):
                flush()
                close(name)
            continue
        if name in RAW:
            flush()
            if name != "svg" or not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html) if name in ("script", "style") else at
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        attributes = m[3]
        names = [set(re.findall(r"[a-z]+", n)) for g in HINT.findall(attributes) for n in "".join(g).lower().split()] if "=" in attributes else []
        hinted = name not in ARTICLE and name not in ("html", "body") and any(n & HINTS and not n & LAYOUT for n in names)
        out = name in EXCLUDED or hinted or bool(attributes and HIDDEN.search(attributes))
        if name in INLINE and not out:
            continue
        flush()
        if name not in INLINE:
            if stack and stack[-1][0] == "p":
                stack.pop()
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
        _, in_out, in_header, in_article = stack[-1] if stack else ("", False, False, False)
        stack.append((name, in_out or out, in_header or name == "header", in_article or name in ARTICLE or any("main" in n for n in names) and name in ("div", "section")))
    flush()
    return found


def suffixes(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array to a depth of ``run`` tokens, of runs within one page, and where each distinct run begins in it."""
    n = len(tokens)
    if n < run:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while width < run:  # ranks of suffixes by their first 2 * width tokens
        step = min(width, run - width)
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
        width += step
    places = np.flatnonzero(page[: n - run + 1] == page[run - 1 :])
    order = places[np.lexsort((page[places], rank[places]))]
    return order, np.flatnonzero(np.diff(rank[order], prepend=-1))


def repeated(tokens: np.ndarray, page: np.ndarray, outside: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens are covered by boilerplate runs.

    ``tokens``: numbers of the concatenated streams; ``page``: of which page; ``outside``: not in an article."""
    n = len(tokens)
    order, starts = suffixes(tokens, page, run)
    if not len(order):
        return np.zeros(n, dtype=bool)
    sizes = np.diff(np.append(starts, len(order)))
    out = np.add.reduceat(outside[order].astype(np.int64), starts)
    several = np.minimum.reduceat(page[order], starts) != np.maximum.reduceat(page[order], starts)
    return spread(order[np.repeat(several & (2 * out >= sizes), sizes)], n, run)


def spread(places: np.ndarray, n: int, run: int = RUN) -> np.ndarray:
    """Which of n tokens lie in a run that begins at one of the places."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, places, 1)
    np.add.at(marks, places + run, -1)
    return np.cumsum(marks)[:n] > 0


def laid_out(html: str | None) -> tuple[list[str], np.ndarray]:
    """Tokens and zones of a page; where it marks its article, all else is out."""
    return flat(blocks(html or ""))


def flat(own: list[tuple[list[str], int]]) -> tuple[list[str], np.ndarray]:
    zones = np.repeat(np.array([z for _, z in own], dtype=np.uint8), [len(t) for t, _ in own])
    if (zones == MAIN).any():
        zones[zones == ELSEWHERE] = OUT
    return [t for tokens, _ in own for t in tokens], zones


def article_without(stream: str, begins: list[int], run: int) -> str:
    """An article, a line a block, without the blocks that the runs at these places cover; whole if it would lose over half."""
    lines = stream.split("\n")
    ends = np.cumsum([len(line.split()) for line in lines])
    covered = np.concatenate([[0], np.cumsum(spread(np.array(begins, dtype=np.int64), int(ends[-1]), run))])
    sizes = np.diff(ends, prepend=0)
    gone = covered[ends] - covered[ends - sizes] == sizes
    if 2 * sizes[gone].sum() > ends[-1]:
        return stream
    return "\n".join(line for line, g in zip(lines, gone.tolist(), strict=True) if not g)


def halves(text: str) -> tuple[int, int]:
    """A 128-bit hash as two numbers."""
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


class Shard:
    """Streams of some pages, for the hashes and the order of their runs."""

    def __init__(self, hosts: list[str], streams: list[str], zones: list[bytes]):
        numbers: dict[str, int] = {}
        words = [s.split() for s in streams]
        lengths = [len(w) for w in words]
        self.tokens = np.array([numbers.setdefault(t, len(numbers)) for w in words for t in w], dtype=np.int64)
        self.zones = np.frombuffer(b"".join(zones), dtype=np.uint8)
        self.page = np.repeat(np.arange(len(streams)), lengths)
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        own: dict[str, int] = {}
        self.host = np.repeat(np.array([own.setdefault(h, len(own)) for h in hosts], dtype=np.int64), lengths)
        self.words = numbers
        self.host_hash = np.array([halves(h) for h in own], dtype=np.uint64).reshape(-1, 2)
        self.ids = np.array([halves(f"{h}\n{s}") for h, s in zip(hosts, streams, strict=True)], dtype=np.uint64).reshape(-1, 2).view(np.int64)

    @cached_property
    def token_hash(self) -> np.ndarray:
        return np.array([halves(t) for t in self.words], dtype=np.uint64).reshape(-1, 2)

    def hashes(self, places: np.ndarray, run: int) -> list[pa.Array]:
        """Of the runs at these places, host included."""
        found = []
        for k, factor in enumerate(FACTORS):
            total = self.host_hash[self.host[places], k]
            for step in range(run):
                total = total * np.uint64(factor) + self.token_hash[self.tokens[places + step], k]
            found.append(pa.array(total.view(np.int64)))
        return found

    def counted(self, run: int) -> list[pa.Array]:
        """A row for each distinct run of a host."""
        order, starts = suffixes(self.tokens * (self.host.max(initial=0) + 1) + self.host, self.page, run)
        if not len(order):
            return [pa.array([], pa.int64())] * 6
        ids = self.ids[self.page[order], 0]
        out = np.add.reduceat((self.zones[order] != MAIN).astype(np.int64), starts)
        columns = (np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts), np.diff(np.append(starts, len(order))), out)
        return self.hashes(order[starts], run) + [pa.array(c) for c in columns]

    def shared(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct run of a host: where it stands first, on how many pages, and how many the host has here."""
        order, starts = suffixes(self.tokens * (self.host.max(initial=0) + 1) + self.host, self.page, run)
        if not len(order):
            return (np.zeros(0, dtype=np.int64),) * 3
        page = self.page[order]
        other = np.append(True, page[1:] != page[:-1])
        other[starts] = True
        of = np.bincount(self.host[self.first])
        return order[starts], np.add.reduceat(other.astype(np.int64), starts), of[self.host[order[starts]]]

    def placed(self, run: int) -> list[pa.Array]:
        """A row for each run that reaches a token elsewhere."""
        n = len(self.tokens)
        begins = np.arange(max(n - run + 1, 0))
        upto = np.concatenate([[0], np.cumsum(self.zones == ELSEWHERE)])
        places = begins[(self.page[begins] == self.page[begins + run - 1]) & (upto[begins + run] > upto[begins])]
        ids = self.ids[self.page[places]]
        return self.hashes(places, run) + [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array((places - self.first[self.page[places]]).astype(np.int32))]


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Shard]:
    """Rows (_host, _stream, _zones) by about ``limit`` bytes of streams."""
    rows: list[tuple[str, str, bytes]] = []
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            for row in zip(*(batch.column(c).slice(at, PART).to_pylist() for c in ("_host", "_stream", "_zones")), strict=True):
                rows.append(row)
                held += len(row[1])
                if held >= limit:
                    yield Shard(*map(list, zip(*rows, strict=True)))
                    rows, held = [], 0
    if rows:
        yield Shard(*map(list, zip(*rows, strict=True)))


def host_shards(batches: Iterator[pa.RecordBatch], limit: int, unsettled: set[str]) -> Iterator[tuple[Shard, list[str], list[bool]]]:
    """Distinct articles of rows in order of (_host, _salt), by whole such groups of about ``limit`` bytes or more; hosts, and whether they are cut.

    Hosts of rows without article are put into ``unsettled``."""
    rows: dict[tuple[int, int], tuple[str, bool, str]] = {}
    held, last = 0, None

    def shard() -> tuple[Shard, list[str], list[bool]]:
        hosts, cuts, streams = map(list, zip(*rows.values(), strict=True))
        known = dict(zip(hosts, cuts, strict=True))
        return Shard(hosts, streams, [bytes([ELSEWHERE]) * len(s.split()) for s in streams]), list(known), list(known.values())

    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            for host, salt, parted, p1, p2, stream in zip(*(part.column(c).to_pylist() for c in ("_host", "_salt", "_cut", "_p1", "_p2", "_stream")), strict=True):
                if stream is None:
                    unsettled.add(host)
                    continue
                if held >= limit and (host, salt) != last:
                    yield shard()
                    rows, held = {}, 0
                last = host, salt
                if (p1, p2) not in rows:
                    rows[p1, p2] = host, parted, stream
                    held += len(stream)
    if rows:
        yield shard()


def site_runs(articles: DataFrame, large: DataFrame, run: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """_host, _h1, _h2: runs of half of the distinct articles of their host, ``MIN_ARTICLES`` or more; and _host of the pages without article.

    ``articles``: _host, _p1, _p2, _stream, null for those pages; ``large``: _host, _shards of hosts that don't fit one shard.
    Copies fall into one shard."""
    least = MIN_ARTICLES

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of half of a shard's articles, and the number of articles of hosts that have other shards."""
        unsettled: set[str] = set()
        for shard, hosts, cuts in host_shards(batches, limit, unsettled):
            places, n, of = shard.shared(run)
            parted = np.array(cuts)[shard.host[places]]
            kept = (2 * n >= of) & (parted | (n >= least))
            places, n, of, parted = places[kept], n[kept], of[kept], parted[kept]
            number = shard.host[places].tolist()
            h1, h2 = shard.hashes(places, run) if len(places) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([hosts[k] for k in number], pa.string()), pa.array(parted, pa.bool_()), h1, h2, pa.array(n), pa.array(of)], ["_host", "_cut", "_h1", "_h2", "_pages", "_of"])
            sizes = [(h, c, None, None, None, int(k)) for h, c, k in zip(hosts, cuts, np.bincount(shard.host[shard.first]), strict=True) if c]
            if sizes:
                columns = [pa.array(c, t) for c, t in zip(zip(*sizes, strict=True), (pa.string(), pa.bool_(), *[pa.int64()] * 4), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["_host", "_cut", "_h1", "_h2", "_pages", "_of"])
        none = pa.nulls(len(unsettled), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(unsettled), pa.string()), pa.nulls(len(unsettled), pa.bool_()), none, none, none, none], ["_host", "_cut", "_h1", "_h2", "_pages", "_of"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, _ in host_shards(batches, limit, set()):
            places, n, _ = shard.shared(run)
            if len(places):
                yield pa.RecordBatch.from_arrays([*shard.hashes(places, run), pa.array(n)], ["_h1", "_h2", "_n"])

    dealt = articles.join(F.broadcast(large), "_host", "left").withColumn("_cut", F.col("_shards").isNotNull())
    dealt = dealt.withColumn("_salt", F.when(F.col("_cut"), F.pmod("_p1", "_shards")).otherwise(0).cast("long")).drop("_shards")
    columns = ["_host", "_salt", "_cut", "_p1", "_p2", "_stream"]

    def in_shards(rows: DataFrame) -> DataFrame:
        return rows.select(*columns).repartition("_host", "_salt").sortWithinPartitions("_host", "_salt")

    found = cut(in_shards(dealt).mapInArrow(half, SHARED))
    unsettled = found.where("_cut IS NULL").select("_host").distinct()
    whole = found.where("NOT _cut").select("_host", "_h1", "_h2")
    open_runs = found.where("_cut AND _h1 IS NOT NULL").select("_host", "_h1", "_h2").distinct()
    if open_runs.isEmpty():
        return whole, unsettled
    sizes = found.where("_cut AND _h1 IS NULL").groupBy("_host").agg(F.sum("_of").alias("_of"))
    again = in_shards(dealt.join(open_runs.select("_host").distinct(), "_host", "left_semi")).mapInArrow(every, "_h1 long, _h2 long, _n long")
    sums = again.join(open_runs, ["_h1", "_h2"]).groupBy("_host", "_h1", "_h2").agg(F.sum("_n").alias("_n"))
    return whole.unionByName(sums.join(sizes, "_host").where((2 * F.col("_n") >= F.col("_of")) & (F.col("_n") >= least)).select("_host", "_h1", "_h2")), unsettled


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    run, limit = RUN, SHARD_BYTES
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("_host"))

    def parsed(html: str | None, settle: bool) -> tuple[str, bytes | None]:
        """Article, a line a block, of a settled page; stream and zones of another."""
        own = blocks(html or "")
        article = [" ".join(t) for t, z in own if z == MAIN]
        if settle and (article or all(z == OUT for _, z in own)):
            return "\n".join(article), None
        tokens, zones = flat(own)
        return " ".join(tokens), zones.tobytes()

    def read(batches: Iterator[pa.RecordBatch], settle: bool = True) -> Iterator[pa.RecordBatch]:
        """Article of settled pages; stream, zones and number of the others, or of all."""
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                found = [parsed(html, settle) for html in part.column("html").to_pylist()]
                ids = [halves(f"{name}\n{stream}") for name, (stream, _) in zip(part.column("_host").to_pylist(), found, strict=True)]
                numbers = np.array(ids, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                columns = [part.column("page_id"), part.column("url"), part.column("_host"), pa.array([t for t, _ in found], pa.string()), pa.array([z for _, z in found], pa.binary()), pa.array(numbers[:, 0]), pa.array(numbers[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "_host", "_stream", "_zones", "_p1", "_p2"])

    def read_articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's distinct articles; a row without for each host of unsettled pages."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                hosts, streams, ids = [], [], []
                for name, html in zip(part.column("_host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    stream, zones = parsed(html, True)
                    own = halves(f"{name}\n{stream}" if zones is None else name)
                    if own not in seen and (stream or zones is not None):
                        seen.add(own)
                        hosts.append(name)
                        streams.append(stream if zones is None else None)
                        ids.append(own)
                numbers = np.array(ids, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), pa.array(streams, pa.string())], ["_host", "_p1", "_p2", "_stream"])

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read(batches, settle=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, limit):
            yield pa.RecordBatch.from_arrays(shard.counted(run), ["_h1", "_h2", "_low", "_high", "_places", "_out"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, limit):
            yield pa.RecordBatch.from_arrays(shard.placed(run), ["_h1", "_h2", "_p1", "_p2", "_at"])

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                streams = part.column("_stream").to_pylist()
                shard = Shard(part.column("_host").to_pylist(), streams, [bytes([ELSEWHERE]) * len(t.split()) for t in streams])
                yield pa.RecordBatch.from_arrays(shard.placed(run), ["_h1", "_h2", "_p1", "_p2", "_at"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                texts = []
                for stream, marks, begins in zip(*(part.column(c).to_pylist() for c in ("_stream", "_zones", "_begins")), strict=True):
                    zones = np.frombuffer(marks, dtype=np.uint8)
                    kept = (zones == ELSEWHERE) & ~spread(np.array(begins or [], dtype=np.int64), len(zones), run)
                    texts.append(" ".join(t for t, k in zip(stream.split(), kept.tolist(), strict=True) if k))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                texts = [article_without(t, b, run) if b else t for t, b in zip(part.column("_stream").to_pylist(), part.column("_begins").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # Pages are parsed again where they are needed: their texts are written nowhere but for the exchange by host.
    sizes = rows.select("_host", F.xxhash64("html").alias("_x"), F.length("html").alias("_size")).distinct().groupBy("_host").agg(F.sum("_size").alias("_size"))
    large = sizes.where(F.col("_size") > limit).select("_host", F.ceil(F.col("_size") / limit).alias("_shards"))  # one for every ``limit`` bytes at most
    own_runs, hosts = site_runs(rows.mapInArrow(read_articles, ARTICLES), large, run, limit)
    own_runs, hosts = cut(own_runs), cut(hosts)
    settled = rows.mapInArrow(read, READ).where(F.col("_zones").isNull())
    n_runs = own_runs.count()
    if n_runs:
        ours = rows.join(own_runs.select("_host").distinct(), "_host", "left_semi").mapInArrow(read_articles, ARTICLES).where("_stream IS NOT NULL")
        at_runs = ours.select("_host", "_stream").mapInArrow(place_all, PLACED)
        at_runs = at_runs.join(F.broadcast(own_runs) if n_runs <= BROADCAST_RUNS else own_runs, ["_h1", "_h2"]).groupBy("_p1", "_p2").agg(F.collect_set("_at").alias("_begins"))
        texts = settled.join(at_runs, ["_p1", "_p2"], "left").select("page_id", "url", "_stream", "_begins").mapInArrow(trim, "page_id long, url string, text string")
    else:
        texts = settled.select("page_id", "url", F.col("_stream").alias("text"))
    texts = texts.withColumn("text", F.translate("text", "\n", " "))
    found = hosts.count()
    if found:
        theirs = rows.join(F.broadcast(hosts) if found <= BROADCAST_HOSTS else hosts, "_host", "left_semi")
        unsettled = stored(theirs.mapInArrow(read, READ).where(F.col("_zones").isNotNull()))
        streams = theirs.mapInArrow(read_all, READ).select("_host", "_stream", "_zones").distinct()
        counts = streams.mapInArrow(count, COUNTED).groupBy("_h1", "_h2").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_places").alias("_places"), F.sum("_out").alias("_out"))
        boilerplate = cut(counts.where("_low <> _high and 2 * _out >= _places").select("_h1", "_h2"))
        if boilerplate.count() <= BROADCAST_RUNS:  # then the places needn't be moved
            boilerplate = F.broadcast(boilerplate)
        places = unsettled.select("_host", "_stream", "_zones").distinct().mapInArrow(place, PLACED)
        begins = places.join(boilerplate, ["_h1", "_h2"]).groupBy("_p1", "_p2").agg(F.collect_set("_at").alias("_begins"))
        rest = unsettled.join(begins, ["_p1", "_p2"], "left").select("page_id", "url", "_stream", "_zones", "_begins")
        texts = texts.unionByName(rest.mapInArrow(strip, "page_id long, url string, text string"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
