"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of the blocks they hold (less below nested containers, less where links
are).  The best one is widened to what stands round it without being links: the main element, all articles of a list, a
heading or a last paragraph beside it.  The widened container votes for its generalised path: tags from the root down with
ids and classes, digits as ``#``.  Votes are counted for each host in Spark, and every page is read again for all containers
at its host's winning path, widened in the same way.  A page without that path, or where it holds under ``LEAST_SHARE`` of
the text of the page's own best container, keeps its own best.

The pages of a host also agree on what is not main text: a block outside article and main elements that stands on
``REPEATED`` of a host's different pages, ``LEAST_PAGES`` at least, is part of the frame, whatever its name.  It stays where it
makes up most of a page's text.

Else menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are told by tag, role,
and by names that say nothing else: "sidebar" and "sidebar-box", not "sidebar-layout".  Names of adverts, comments and the
like count in any company but that of words for a state ("has-ads").  What a name of a place or a form holds stays
if it is most of the page's text.  A block's text has its character references decoded and its white space (line breaks
included) squeezed; blocks are joined in page order by a newline.

Defined cases: a null or empty html, or one with no main text, gives an empty text; a null or odd
url belongs to the host ""; repeated rows give repeated rows and vote once each; an empty table gives
no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

LEAST_SHARE = 0.3
DECAY = 0.7
#: Of the text that a wider container would add: the most that may stand in links, and the least in blocks of ``LONG`` characters
#: where the container is the page itself or adds more than there was.
LINKED = 0.3
PROSE = 0.6
LONG = 40
#: Share of a host's different pages, and their least number, from which a block outside articles is part of the frame.
REPEATED, LEAST_PAGES = 0.6, 5
#: What is known of hosts is broadcast up to this many hosts and repeated blocks; beyond it they are joined, and Spark splits
#: a large host's pages.
BROADCAST_HOSTS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>"
    r"|<[a-zA-Z/!][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|aria-label|itemprop|itemtype)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article main section div td body center blockquote dd".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT_TAGS = frozenset("head nav footer aside button select option datalist dialog menu object audio video canvas map".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words for parts of a page that are not its article, wherever they stand.
_STRONG = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising adsense sponsor sponsored promo comment comments commentlist "
    "disqus newsletter cookie cookies consent gdpr cta".split()
)
_OUT_WORDS = _STRONG | frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer bottombar sidebar side aside rail notice notices banner promotion "
    "reply replies respond discussion feedback share sharing social related recommended breadcrumb breadcrumbs "
    "pagination pager login signin signup subscribe subscription form search popup modal overlay widget toolbar "
    "copyright legal disclaimer alert".split()
)
#: Of those, words that name parts of articles as well.
_WEAK = frozenset("side social related recommended form search legal discussion feedback promotion".split())
#: Words beside which an unwanted one tells a state, not a part.
_STATE = frozenset("has with without no is enabled disabled free layout".split())
#: Words that may stand beside an unwanted one in the name of a part without giving it another meaning.
_FILLER = frozenset(
    "area bar block body bottom box button buttons container content group holder icons inner item items left link links list main notes "
    "outer page panel post posts primary right row secondary section site slot text thread top unit user wrap wrapper".split()
)
#: Beside these a word that else names parts of articles too does not.
_CROWD = frozenset("thread notes user users list posts board".split())
_IN_WORDS = frozenset("article content main post entry story body text".split())
_CLOSES_P = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_WEIGHT = {"article": 1.5, "main": 1.3}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _words(value: str) -> list[str]:
    return re.sub(r"[^a-z]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()).split()


#: What an element is: part of the text, never part of it, not part of it unless it is most of the page, or if it is links.
_TEXT, _OUT, _PLACE, _LIKELY = range(4)


def _kind(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """``inside``: the element stands in an article or main element, where a header is part of the text."""
    if tag in _OUT_TAGS or (tag == "header" and not inside):
        return _OUT
    if tag == "form":
        return _PLACE
    if not attributes:
        return _TEXT
    role = attributes.get("role", "").lower()
    if role in _OUT_ROLES or role == "comment" or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return _OUT
    if attributes.get("itemprop", "").lower() == "comment" or attributes.get("itemtype", "").lower().endswith("/comment"):
        return _OUT
    names = [_words(n) for n in (*attributes.get("class", "").split(), attributes.get("id", ""), attributes.get("aria-label", ""))]
    if tag in ("body", "html") or (tag in ("article", "main") and _IN_WORDS & set().union(*names)):
        return _TEXT
    found = _TEXT
    for n in map(set, names):
        bad = n & _OUT_WORDS
        if not bad or n & _STATE:
            continue
        if bad & _STRONG:
            return _OUT
        if n <= _OUT_WORDS | _FILLER and (bad := bad - {"header"} if inside else bad):
            sure = not inside or bad - _WEAK or n & _CROWD
            found = _PLACE if sure else found or _LIKELY
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    name = tag
    if tag in ("html", "body"):  # their classes tell pages apart, not containers
        return name
    if attributes.get("id"):
        name += "#" + re.sub(r"\d+", "#", attributes["id"].strip())
    return name + "".join("." + c for c in sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()}))


class Page:
    """A page's elements and its blocks of main text, from one pass over the markup.

    Elements are numbered in page order, 0 being the page itself; what is known of them stands in lists by number,
    and a path is a checksum until it is asked for, so deep pages take memory and time in proportion.
    """

    def __init__(self, source: str):
        self.tag, self.step, self.up, self.container, self.path_sum = [""], [""], [-1], [0], [0]
        self._out, self._inside, self._weak, self._linked = [False], [False], [0], [0]
        self._skipped: set[int] = set()  # elements inside the chosen region that are no part of it
        self._place, self._beyond = [0], {0: 0}  # of each element the innermost unwanted place; of each such place the next one
        # (container, text, characters in links, weak element, place, in an article or main element) of each block
        self._rows: list[tuple[int, str, int, int, int, bool]] = []
        self._parts: list[str] = []
        self._links, self._at = 0, None
        stack, last, opened = [0], 0, dict.fromkeys(("p", "li"), 0)
        for m in _TOKEN.finditer(source):
            if m.start() > last:
                self._say(source[last : m.start()], stack[-1])
            last = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            if tag == "br":
                self._say(" ", stack[-1])
                continue
            if tag in _BLOCKS:
                self._end_block()
            if m[2] or m[5]:
                if opened.get(tag):
                    where = len(stack) - 1
                    while self.tag[stack[where]] != tag:
                        where -= 1
                    self._close(stack, where, opened)
                continue
            if (tag in _CLOSES_P or tag == "li") and opened["li" if tag == "li" else "p"]:
                self._close_open(stack, tag, opened)
            rest = m[4] or m[7] or ""
            if tag in _VOID or rest.rstrip().endswith("/") and tag not in _BLOCKS:
                continue
            opened[tag] = opened.get(tag, 0) + 1
            stack.append(self._element(tag, rest, stack[-1]))
        if last < len(source):
            self._say(source[last:], stack[-1])
        self._end_block()
        self._settle()

    def _element(self, tag: str, rest: str, up: int) -> int:
        at, attributes = len(self.tag), _attributes(rest)
        kind = _OUT if self._out[up] else _kind(tag, attributes, self._inside[up])
        out = kind == _OUT
        step = _step(tag, attributes) if tag in _BLOCKS else ""
        self.tag.append(tag)
        self.step.append(step)
        self.up.append(up)
        self._out.append(out)
        self._inside.append(self._inside[up] or (tag in ("article", "main") and not out))
        self._weak.append(self._weak[up] or (at if kind == _LIKELY else 0))
        self._place.append(at if kind == _PLACE else self._place[up])
        if kind == _PLACE:
            self._beyond[at] = self._place[up]
        self._linked.append(self._linked[up] + (tag == "a"))
        self.container.append(at if tag in _CONTAINERS and not out else self.container[up])
        self.path_sum.append(zlib.crc32(f">{step}".encode(), self.path_sum[up]) if step else self.path_sum[up])
        return at

    def _close(self, stack: list[int], where: int, opened: dict[str, int]) -> None:
        for i in stack[where:]:
            opened[self.tag[i]] -= 1
        del stack[where:]

    def _close_open(self, stack: list[int], tag: str, opened: dict[str, int]) -> None:
        """A block ends an open paragraph; a list item ends an open item of the same list."""
        ends = {"li": ("li", ("ul", "ol", "menu"))}.get(tag, ("p", ("div", "td", "li", "article", "section", "main", "body")))
        for k in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[k]]
            if name == ends[0]:
                self._close(stack, k, opened)
                return
            if name in ends[1]:
                return

    def _say(self, raw: str, node: int) -> None:
        if self._out[node]:
            return
        at = (self.container[node], self._weak[node], self._place[node], self._inside[node])
        if self._at is not None and self._at != at:
            self._end_block()
        self._at = at
        self._parts.append(raw)
        if self._linked[node]:
            self._links += len(raw)

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            if text:
                self._rows.append((self._at[0], text, min(self._links, len(text)), *self._at[1:]))
        self._parts, self._links, self._at = [], 0, None

    def _settle(self) -> None:
        """Likely unwanted parts go if they are links by half, unwanted places unless one holds most of the page's text."""
        weak: dict[int, list[int]] = {}
        mass: dict[int, int] = {}
        for _, text, links, w, place, _ in self._rows:
            mass[place] = mass.get(place, 0) + len(text) - links
            if w:
                sums = weak.setdefault(w, [0, 0])
                sums[0] += len(text)
                sums[1] += links
        gone = {w for w, (n, links) in weak.items() if 2 * links >= n}
        most, total = max(mass, key=lambda x: (mass[x], -x), default=0), sum(mass.values())
        stays = {0}
        while most and 2 * mass.get(most, 0) > total or most and len(stays) > 1:  # the place, and those round it
            stays.add(most)
            most = self._beyond[most]
        self._rows = [r for r in self._rows if r[3] not in gone and r[4] in stays]

    def frame(self) -> list[int]:
        """Hashes of the blocks outside article and main elements."""
        return sorted({_hash(text) for _, text, _, _, _, inside in self._rows if not inside})

    def without(self, repeated: frozenset[int]) -> None:
        """Take out the blocks outside article and main elements that the host's pages repeat, unless they are most of the text."""
        rest = [r for r in self._rows if r[5] or _hash(r[1]) not in repeated]
        if 2 * sum(len(r[1]) for r in rest) > sum(len(r[1]) for r in self._rows):
            self._rows = rest

    def _sums(self) -> tuple[dict[int, float], dict[int, list[int]]]:
        """Of each container with text, its own or below: the score, and the characters of text, of links and of long blocks."""
        score: dict[int, float] = {}
        size: dict[int, list[int]] = {}
        for c, text, links, *_ in self._rows:
            sums = size.setdefault(c, [0, 0, 0])
            for k, n in enumerate((len(text), links, len(text) if len(text) >= LONG else 0)):
                sums[k] += n
        score = {c: float(max(0, n - 2 * links)) for c, (n, links, _) in size.items()}
        # Containers follow those that hold them, so each is complete before it is added to its own.
        for c in range(len(self.tag) - 1, 0, -1):
            if c in size:
                above = self.container[self.up[c]]
                score[above] = score.get(above, 0.0) + DECAY * score[c]
                sums = size.setdefault(above, [0, 0, 0])
                for k in range(3):
                    sums[k] += size[c][k]
        return {c: s * _WEIGHT.get(self.tag[c], 1.0) for c, s in score.items()}, size

    def _region(self, top: int, size: dict[int, list[int]]) -> list[int]:
        """A container widened: to the outermost article round it and its fellows, and from there to the main element if that
        adds little of links; without an article, to wider containers that add no links but prose, or less than there was."""
        article, at = 0, top
        while at:
            if self.tag[at] == "article" and self.container[at] == at:
                article = at
            at = self.up[at]
        found = [article or top]
        if article:
            fellow = lambda i: self.up[i] == self.up[article] or self.path_sum[i] == self.path_sum[article]
            found += [i for i in size if i != article and self.tag[i] == "article" and fellow(i) and size[i][1] <= LINKED * size[i][0]]
        # Articles of links beside it are teasers: they neither count nor come along when it is widened.
        teasers = [i for i in size if article and self.tag[i] == "article" and i not in found and size[i][1] > LINKED * size[i][0]]
        at, best = article or top, found
        held = [sum(size[i][k] for i in found) for k in range(3)]
        while at and self.tag[at] != "main":
            at = self.container[self.up[at]]
            beside = [sum(size[i][k] for i in teasers if self._within(i, at)) for k in range(3)]
            n, links, long = (x - y - z for x, y, z in zip(size[at], held, beside, strict=True))
            page = at == 0 or self.tag[at] in ("body", "html")
            if article and page or n and (links > LINKED * n or (page or n > held[0]) and long < PROSE * n):
                break
            if n and at and (not article or self.tag[at] == "main"):
                best, held = [at], [x - y for x, y in zip(size[at], beside, strict=True)]
                self._skipped = {i for i in teasers if self._within(i, at)}
        return best

    def _within(self, at: int, top: int) -> bool:
        while at > top:
            at = self.up[at]
        return at == top

    def best(self, path: str | None = None) -> tuple[list[int], int]:
        """The best container, widened, or those at ``path`` if the page has enough text there; and their characters."""
        scores, size = self._sums()
        if not scores:
            return [], 0
        first = lambda among: max(among, key=lambda i: (scores[i], -i))
        own = self._region(first(scores), size)
        chars = sum(size[i][0] for i in own)
        if path is not None:
            wanted = zlib.crc32(path.encode())
            there = [i for i in scores if i and self.path_sum[i] == wanted and self.path(i) == path]
            if there:
                agreed = [i for i in there if 2 * size[i][1] <= size[i][0]] or [first(there)]
                if sum(size[i][0] for i in agreed) >= LEAST_SHARE * chars:
                    wide = self._region(first(agreed), size)
                    return sorted({*agreed, *wide}, key=lambda i: (i not in wide, i)), sum(size[i][0] for i in wide)
        return own, chars

    def path(self, at: int) -> str:
        """An element's generalised path: the steps of the block elements from the root down to it."""
        steps = []
        while at > 0:
            if self.step[at]:
                steps.append(self.step[at])
            at = self.up[at]
        return "".join(">" + s for s in reversed(steps))

    def under(self, tops: list[int]) -> str:
        """The blocks of containers and of those in them, joined."""
        inside = [False] * len(self.tag)
        for i in tops:
            inside[i] = True
        for i in range(1, len(self.tag)):
            inside[i] = i not in self._skipped and (inside[i] or inside[self.up[i]])
        return "\n".join(r[1] for r in self._rows if inside[r[0]])


def _hash(text: str) -> int:
    """63 bits of a block's text."""
    import xxhash

    return xxhash.xxh64_intdigest(text) >> 1


def _vote(page: Page) -> tuple[str | None, int]:
    tops, size = page.best()
    return (page.path(tops[0]), size) if tops and tops[0] else (None, 0)


def vote(source: str) -> tuple[str | None, int]:
    """The path of a page's best container and its characters."""
    return _vote(Page(source))


def extract(source: str, path: str | None = None, repeated: frozenset[int] = frozenset()) -> str:
    page = Page(source)
    if repeated:
        page.without(repeated)
    return page.under(page.best(path)[0])


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def votes_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, chars, frame) of each page: its vote, and the hashes of its blocks outside articles."""
    df = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("text"))

    def make() -> Callable:
        def helper(sources: list[str]) -> list:
            votes = [(*_vote(page), page.frame()) for page in map(Page, sources)]
            return [pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.int64()), pa.array([v[2] for v in votes], pa.list_(pa.int64()))]

        return helper

    return map_texts(df, make, "path string, chars bigint, frame array<bigint>")


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): each host's winning path; most votes, then most text, then the first by name."""
    return winning_paths(votes_of(pages, url_col, html_col))


def winning_paths(votes: DataFrame) -> DataFrame:
    """``host_paths`` of pages that have voted."""
    counted = votes.filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    first = F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), -F.col("chars"), "path")).alias("w")
    return counted.groupBy("host").agg(first).select("host", "w.path", "w.votes")


def repeated_blocks(votes: DataFrame) -> DataFrame:
    """(host, repeated): hashes of the blocks outside articles that most of a host's pages hold; pages with the same blocks
    count as one.  A host's list is no longer than its pages' mean number of blocks by 1 / ``REPEATED``."""
    different = votes.filter(F.size("frame") > 0).select("host", "frame").distinct()
    pages = different.groupBy("host").agg(F.count("*").alias("pages"))
    often = different.select("host", F.explode("frame").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    common = often.join(pages, "host").filter(F.col("n") >= REPEATED * F.col("pages"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("block")).alias("repeated"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of each page and its main text."""
    votes = votes_of(pages, url_col, html_col).persist()
    winners = winning_paths(votes).select("host", F.col("path").alias("__path")).join(repeated_blocks(votes), "host", "full").persist()
    size = winners.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("repeated")), F.lit(0)).alias("blocks")).first()
    votes.unpersist()
    small = size["hosts"] + size["blocks"] <= BROADCAST_HOSTS
    df = pages.select(*keep, host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("__html"))
    joined = df.join(F.broadcast(winners) if small else winners, "host", "left").select(*keep, F.struct("__path", "repeated").alias("__at"), "__html")

    def run(batches):
        from tidemark.llm.common import byte_slices

        for batch in batches:
            for part in byte_slices(batch, "__html"):
                agreed = [(a["__path"], frozenset(a["repeated"] or ())) for a in part.column("__at").to_pylist()]
                made = [extract(s or "", *a) for s, a in zip(part.column("__html").to_pylist(), agreed, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.string())], [*keep, "text"])

    shape = ", ".join(f"`{n}` {t}" for n, t in pages.select(*keep).dtypes)
    return joined.mapInArrow(run, f"{shape}, text string")


def op9(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
