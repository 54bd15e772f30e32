"""HTML extraction by deduction of templates from equivalence classes of tokens.

A page is a row of tokens: an element by its path of tags (with first class or
id), and a block of text by its path and words. Tokens of one host with equal
occurrence vectors (the same counts on the same pages) form an equivalence
class. The vectors are never built: sums of hashes of (page, count) tell them
apart, which tasks add up separately; as sums, they stand repeated pages.

A class is valid if it has support and more than one token, its tokens stand in
one order on most of its pages, and it nests: on these pages it lies in one slot,
between two neighbouring tokens, of the class around it. Nested, the valid classes
are the host's template. Its texts that stand on most pages of the class around
them are no content. Elements that occur once on most of their pages bound slots;
a host's main slots are those that hold the article, one for each layout:
article, main and content elements need support only, others a valid class. What
is left in a page's main slot is its text, but for menus, adverts, forms and the
like, which vary from page to page as articles do and are told by fixed words.
Pages that lack all main slots, and hosts with few pages, are read by the same
words on the page alone. Reading takes time in proportion to a page's length,
however deep it nests.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace

#: Pages that a class must occur on, and their least share of the host's pages.
SUPPORT, SHARE = 3, 0.3
#: Least share of the host's pages for a layout's named slot, and of a token's pages on which it occurs once.
LAYOUT, ONCE = 0.02, 0.8
#: Least share of its parent class's pages that a text of the template stands on.
REPEATED = 0.7
#: Digests of repeated pages of at most so many rows (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_PAGES = 500_000
#: Templates (one row a host) of at most so many hosts are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUT = frozenset("nav footer aside form script style noscript template iframe svg math button select option textarea head title object canvas audio video menu dialog datalist map xmp".split())
#: Elements that the start of another closes if it is open inside the nearest barrier.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("html body article section main div table ul ol dl blockquote aside nav header footer form td th select".split())
#: Words of a class, id or role that tell what isn't the article.
NOISE = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav\w*|header|footer|masthead|breadcrumbs?|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|subscription|social|share|sharing|related|recommend\w*|widget|comments?|commentlist|respond|disqus|replies|pagination|pager|toolbar|tags?|legal|copyright|search|login|signup|skip)(?:$|[^a-z])")
MAIN = re.compile(r"(?:^|[^a-z])(?:article|main|content|post|entry|story|body-?text)(?:$|[^a-z])")

_TOKEN = re.compile(r"<!--(?:(?!-->)[\s\S])*+(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<[!?][^>]*+>|<[a-zA-Z/!?][^<]*+$")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?")


def _attrs(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /") else {}


@lru_cache(maxsize=200_000)
def _digest(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Paths:
    """The element paths of a page: numbers in order of appearance, a parent before its children. 0 is the page."""

    def __init__(self):
        self.parent, self.label, self.key, self.depth, self.known = [0], [""], [0], [0], {}

    def under(self, parent: int, label: str) -> int:
        i = self.known.get((parent, label))
        if i is None:
            i = self.known[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.key.append(_digest(self.key[parent], label))
            self.depth.append(self.depth[parent] + 1)
        return i

    def inside(self, slot: int | None) -> list[bool]:
        """For each path whether it is the one with key ``slot`` or below it; all if there is no slot."""
        found = [slot is None]
        for i in range(1, len(self.parent)):
            found.append(self.key[i] == slot or found[self.parent[i]])
        return found


@lru_cache(maxsize=100_000)
def _named(text: str) -> tuple[str, str]:
    """An element's attributes as text -> (lower-cased class, id and role, whether it is hidden)."""
    attrs = _attrs(text)
    return " ".join((attrs.get("class") or "", attrs.get("id") or "", attrs.get("role") or "")).lower().strip(), "hidden" in attrs


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}


def events(page: str, paths: Paths):
    """(kind, path, noise, value): "open" of elements, "break" at block ends, "text".

    ``path`` is a number of ``paths``, ``noise`` tells that one of the open
    elements isn't part of an article. Tag soup is closed as browsers do it in the
    common cases. The depths of open tags are kept by name, so nothing is searched.
    """
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]  # tag, path, noise, in an article, depth of the innermost block
    opened: dict[str, list[int]] = defaultdict(list)
    at = 0

    def last(tags, but=()) -> int:
        return max((opened[t][-1] for t in tags if t not in but and opened.get(t)), default=0)

    def leave(depth: int):
        while len(stack) > depth:
            tag, path, noise, _, _ = stack.pop()
            opened[tag].pop()
            if tag in BLOCK:
                yield ("break", path, noise, "")

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield ("text", stack[-1][1], stack[-1][2], text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            d = opened[tag][-1] if opened.get(tag) else 0
            if d and (tag in BLOCK or d > stack[-1][4]):
                yield from leave(d)
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if closes and (d := last(closes)) and d > last(BARRIER, closes | {"td", "th"} if tag in ("tr", "td", "th") else closes):
            yield from leave(d)
        label, hidden = _named(m[3]) if m[3] else ("", False)
        mark = re.sub(r"\d+", "#", label.split()[0]) if label else ""
        _, parent, noise, within, block = stack[-1]
        path = paths.under(parent, f"{tag}.{mark}" if mark else tag)
        noise = noise or tag in OUT or (tag == "header" and not within) or hidden or bool(label and tag not in ("html", "body", "article", "main") and NOISE.search(label))
        if tag in BLOCK:
            yield ("break", path, noise, "")
        yield ("open", path, noise, tag)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "use"):
            if tag in ("br", "hr"):
                yield ("text", stack[-1][1], stack[-1][2], " ")
        elif tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        else:
            opened[tag].append(len(stack))
            stack.append((tag, path, noise, within or tag in ("article", "main"), len(stack) if tag in BLOCK else block))
    yield from leave(1)


def _solid(block: list[str]) -> str:
    return " ".join("".join(block).split())


class Reading:
    """A page read once: its elements, its blocks of text that are not noise, its tokens in order."""

    def __init__(self, page: str):
        self.paths = Paths()
        seen = list(events(page, self.paths))
        n = len(self.paths.parent)
        self.times, self.chars, self.noise = [0] * n, [0] * n, [False] * n
        self.order: list[int] = []
        self.blocks: list[tuple[int, int, list]] = []  # token, characters, texts by path
        block: list[tuple[int, str]] = []

        def end():
            if block and (text := _solid([t for _, t in block])):
                where = next(p for p, t in block if t.strip())
                self.blocks.append((_digest(self.paths.key[where], "#" + text), len(text), list(block)))
                self.order.append(self.blocks[-1][0])
            block.clear()

        for kind, path, noise, value in seen:
            if kind == "open":
                if not self.times[path]:
                    self.noise[path] = noise
                self.times[path] += 1
                self.order.append(self.paths.key[path])
            elif kind == "break":
                end()
            elif not noise:
                self.chars[path] += len(value.strip())
                block.append((path, html.unescape(value)))
        end()
        for i in range(n - 1, 0, -1):
            self.chars[self.paths.parent[i]] += self.chars[i]

    def elements(self) -> dict[int, tuple[int, int, bool, str, int]]:
        """key -> (occurrences, characters of article text inside, is noise, label, depth)."""
        p = self.paths
        return {p.key[i]: (self.times[i], self.chars[i], self.noise[i], p.label[i], p.depth[i]) for i in range(1, len(p.key))}


def rank_of(label: str) -> int:
    """0: an article element, 1: a main element, 2: one whose name says content, 3: any other."""
    tag, _, mark = label.partition(".")
    return 0 if tag == "article" else 1 if tag == "main" else 2 if mark and MAIN.search(mark) else 3


def main_of(frame: dict[int, tuple[int, str, int]]) -> int | None:
    """The frame element (key -> article characters inside, label, depth) that holds the article; None for the whole page.

    An article or main element wins, then one whose name says content, else the
    deepest one with more than half of the text.
    """
    most = max((n for n, _, _ in frame.values()), default=0)
    fit = [k for k, (n, label, _) in frame.items() if n > 0 and rank_of(label) < 3]
    if fit:
        return max(fit, key=lambda k: (-rank_of(frame[k][1]), frame[k][0], -frame[k][2], k))
    deep = [k for k, (n, label, _) in frame.items() if 2 * n > most and label.split(".")[0] in BLOCK]
    return max(deep, key=lambda k: (frame[k][2], frame[k][0], k), default=None)


def own_slot(found: dict[int, tuple]) -> int | None:
    """The main slot of a page by its own elements: a single one, or article or main elements that repeat and hold most of the text."""
    own = main_of({k: (n, label, depth) for k, (times, n, noise, label, depth) in found.items() if not noise and times == 1})
    if own is None or rank_of(found[own][3]) > 1:
        most = max((x[1] for x in found.values()), default=0)
        many = [k for k, x in found.items() if not x[2] and x[0] > 1 and rank_of(x[3]) < 2 and 2 * x[1] > most]
        own = min(many, key=lambda k: (rank_of(found[k][3]), -found[k][1], k), default=own)
    return own


def slot_on(found: dict[int, tuple], slots: list[int]) -> int | None:
    """The slot of a page with these elements: its host's first named slot that holds text here, else its own.

    A host's slot that is only a generic ancestor is taken if the page has no
    article, main or content element of its own.
    """
    here = [k for k in slots if k in found and not found[k][2]]
    for k in here:
        if rank_of(found[k][3]) < 3 and found[k][1]:
            return k
    own = own_slot(found)
    if own is not None and rank_of(found[own][3]) < 3:
        return own
    return next((k for k in here if rank_of(found[k][3]) == 3), own)


def blocks_of(page: str | None, slots: list[int]) -> tuple[int | None, list[tuple[int, str]]]:
    """A page's main slot and the blocks (token, text) in it, in page order."""
    if not page:
        return None, []
    read = Reading(page)
    slot = slot_on(read.elements(), slots)
    inside = read.paths.inside(slot)
    found = [(token, _solid([t for p, t in block if inside[p]])) for token, _, block in read.blocks]
    return slot, [(token, text) for token, text in found if text]


def extract(page: str | None) -> str:
    """The text of a page that is read alone."""
    return "\n".join(text for _, text in blocks_of(page, [])[1])


_MASK = (1 << 64) - 1


def _vector(page: int, n: int) -> tuple[int, int]:
    """Two halves of a hash of (page, count) that can be added up as long integers."""
    x = ((page & _MASK) * 0x9E3779B97F4A7C15 + n * 0xBF58476D1CE4E5B9) & _MASK
    x = (x ^ (x >> 30)) * 0x94D049BB133111EB & _MASK
    x ^= x >> 31
    return x & 0x7FFFFFFF, x >> 33


_TOKENS = "host string, token long, label string, depth int, v1 long, v2 long, pages double, once double, chars double, noise double"


def _token_rows(batches):
    """Rows (host, page, weight, html) -> sums by host and token; ``label`` is null for text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sums: dict[tuple, list] = {}
            for host, page, weight, source in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                read = Reading(source or "")
                found = [(k, label, depth, *rest) for k, (*rest, label, depth) in read.elements().items()]
                sizes = {t: n for t, n, _ in read.blocks}
                found += [(t, None, 0, k, sizes[t], False) for t, k in Counter(t for t, _, _ in read.blocks).items()]
                for token, label, depth, times, chars, noise in found:
                    x = sums.setdefault((host, token), [label, depth, 0, 0, 0.0, 0.0, 0.0, 0.0])
                    v1, v2 = _vector(page, times)
                    x[2] += v1
                    x[3] += v2
                    x[4] += weight
                    x[5] += weight * (times == 1)
                    x[6] += weight * chars
                    x[7] += weight * noise
            columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) or [[]] * 10
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "token", "label", "depth", "v1", "v2", "pages", "once", "chars", "noise"])


def places(order: list[int], of: dict[int, int]) -> dict[int, tuple[tuple, int, int]]:
    """A page's tokens in order and the classes of some -> class -> (its tokens in order, the class around it, the slot there).

    The class around is the one with the shortest span over all of this one's
    tokens, 0 for none; the slot is the number of its tokens before, and -1 if it
    isn't the same for all of this class's tokens.
    """
    at: dict[int, list[int]] = defaultdict(list)
    for i, token in enumerate(order):
        if (c := of.get(token)) is not None:
            at[c].append(i)
    found, around = {}, []
    for c in sorted(at, key=lambda c: (at[c][0], -at[c][-1])):
        lo, hi = at[c][0], at[c][-1]
        while around and at[around[-1]][-1] < lo:
            around.pop()
        outer = next((o for o in reversed(around) if at[o][-1] > hi), 0)
        slot = bisect(at[outer], lo) if outer else 0
        found[c] = (tuple(order[i] for i in at[c]), outer, slot if not outer or bisect(at[outer], hi) == slot else -1)
        around.append(c)
    return found


def _place_rows(batches):
    """Rows (weight, classes, html, host), classes a map of tokens -> (host, class, sequence, outer, slot, pages)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sums: Counter = Counter()
            for weight, classes, source, host in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                if classes and source:
                    for c, (tokens, outer, slot) in places(Reading(source).order, dict(classes)).items():
                        sums[host, c, _digest(len(tokens), repr(tokens)), outer, slot] += weight
            columns = list(zip(*((*k, v) for k, v in sums.items()), strict=True)) or [[]] * 6
            types = [pa.string(), *[pa.int64()] * 4, pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "class", "sequence", "outer", "slot", "pages"])


def slots_of(frame: dict[int, tuple[int, str, int, bool]]) -> list[int]:
    """Frame (key -> article characters a page, label, depth, is valid for a generic slot) -> named slots, best first, then the generic one."""
    named = sorted((k for k, (n, label, _, _) in frame.items() if n > 0 and rank_of(label) < 3), key=lambda k: (rank_of(frame[k][1]), -frame[k][0], frame[k][2], k))
    generic = main_of({k: (n, label, depth) for k, (n, label, depth, common) in frame.items() if common and rank_of(label) == 3})
    return [*named, generic] if generic is not None else named


def _slots(batches):
    """Rows (host, frame: list of {token, chars, label, depth, common}, texts) -> (host, slots, texts)."""
    for batch in batches:
        frames = [{x["token"]: (x["chars"], x["label"], x["depth"], x["common"]) for x in f or ()} for f in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([slots_of(f) for f in frames], pa.list_(pa.int64())), batch.column(2)], names=["host", "slots", "texts"])


def _blocks(batches):
    """Rows (..., slots, texts, html) -> (..., slot, blocks, fixed): the slot's blocks, and which of them, from 0, are the template's."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            n = part.num_columns
            slots, blocks, fixed = [], [], []
            for own, texts, source in zip(*(part.column(i).to_pylist() for i in (n - 3, n - 2, n - 1)), strict=True):
                slot, found = blocks_of(source, own or [])
                known = set(texts or ())
                slots.append(slot)
                blocks.append([t for _, t in found])
                fixed.append([i for i, (token, _) in enumerate(found) if token in known])
            made = [pa.array(slots, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.array(fixed, pa.list_(pa.int32()))]
            yield pa.record_batch([*part.columns[: n - 3], *made], names=[*part.schema.names[: n - 3], "slot", "blocks", "fixed"])


def _joined(rows: DataFrame, small: DataFrame, on, most: int, how: str = "left") -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= most else small, on, how)


class Templates:
    """Templates of the hosts of ``pages`` (host, page, weight, html); ``page`` is a digest, ``weight`` one by how often the page is there.

    Shares of pages decide, so a few odd pages change nothing for the others; a
    host has a named slot for each of its layouts.
    """

    def __init__(self, pages: DataFrame, work: Workspace):
        self.pages, self.work = pages, work
        rows = pages.select("host", "page", "weight", "html").mapInArrow(_token_rows, _TOKENS)
        # one row per token of a host; partial sums are made where the pages are read
        token = rows.groupBy("host", "token").agg(F.first("label").alias("label"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("v1", "v2", "pages", "once", "chars", "noise")))
        self.tokens = work.keep(token.where(F.col("pages") >= SUPPORT - 1e-6), "tokens")
        self.of = work.keep(self.tokens.groupBy("host").agg(F.max("pages").alias("of")), "hosts")

    def nested(self) -> DataFrame:
        """The template (host, token, class, outer, slot, pages, around): tokens of valid classes, where each class nests, and the pages of the class around."""
        work = self.work
        sized = self.tokens.groupBy("host", "v1", "v2").agg(F.count("*").alias("size")).where("size > 1")
        fit = self.tokens.join(sized, ["host", "v1", "v2"]).join(self.of, "host").where((F.col("pages") >= SHARE * F.col("of")) & (2 * F.col("noise") < F.col("pages")))
        fit = work.keep(fit.select("host", "token", F.xxhash64("v1", "v2").alias("class"), "pages"), "classes")
        # a host's list has at most a page's tokens, divided by the least share
        listed = work.keep(fit.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("token", "class"))).alias("classes")), "listed")
        rows = _joined(self.pages, listed, "host", BROADCAST_HOSTS, "inner").select("weight", "classes", "html", "host")
        seen = rows.mapInArrow(_place_rows, "host string, class long, sequence long, outer long, slot long, pages double")
        seen = work.keep(seen.groupBy("host", "class", "sequence", "outer", "slot").agg(F.sum("pages").alias("n")), "places")
        best = seen.groupBy("host", "class").agg(F.sum("n").alias("all"), F.max(F.struct("n", "sequence", "outer", "slot")).alias("b"))
        best = best.where((F.col("b.n") >= ONCE * F.col("all")) & (F.col("b.slot") >= 0)).select("host", "class", F.col("b.outer").alias("outer"), F.col("b.slot").alias("slot"))
        pages = fit.groupBy("host", F.col("class").alias("outer")).agg(F.max("pages").alias("around"))
        best = best.join(pages, ["host", "outer"], "left").join(self.of, "host").select("host", "class", "outer", "slot", F.coalesce("around", "of").alias("around"))
        return work.keep(fit.join(best, ["host", "class"]), "template")

    def slots(self) -> DataFrame:
        """(host, slots, texts): keys of each host's main slots, and tokens of its template's texts."""
        template = self.nested()
        own = self.tokens.join(template.select("host", "token", "around", F.lit(True).alias("valid")), ["host", "token"], "left").join(self.of, "host")
        single = F.col("label").isNotNull() & (F.col("pages") >= LAYOUT * F.col("of")) & (F.col("once") >= ONCE * F.col("pages")) & (2 * F.col("noise") < F.col("pages"))
        text = F.col("label").isNull() & F.col("valid") & (F.col("pages") >= REPEATED * F.col("around"))
        element = F.struct("token", F.floor(F.col("chars") / F.col("pages")).alias("chars"), "label", "depth", F.coalesce("valid", F.lit(False)).alias("common"))
        # a frame has at most a page's single elements, divided by the least share
        frame = own.where(single | text).groupBy("host").agg(F.sort_array(F.collect_list(F.when(single, element))).alias("frame"), F.collect_list(F.when(text, F.col("token"))).alias("texts"))
        return self.work.keep(frame.mapInArrow(_slots, "host string, slots array<long>, texts array<long>"), "slots")


def extract_pages(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    A null or empty page has an empty text; a null url has a host of its own.
    Repeated rows keep a row each and count as one page of their host, an empty
    table gives an empty result, and other columns aren't read. Where the
    template's texts would be more than half of a layout's text, its pages are
    near copies of each other and keep them, as does a page of nothing else.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit("")))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    read = own.select("host", F.xxhash64("html").alias("page"), "html").where("html is not null")
    twice = work.keep(read.groupBy("host", "page").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    weighed = _joined(read, twice, ["host", "page"], BROADCAST_PAGES).select("host", "page", (1 / F.coalesce("n", F.lit(1))).alias("weight"), "html")
    found = Templates(weighed, work).slots()
    rows = _joined(own, found, "host", BROADCAST_HOSTS).select("id", "url", "host", "slots", "texts", "html")
    out = rows.mapInArrow(_blocks, f"id {rows.schema['id'].dataType.simpleString()}, url string, host string, slot long, blocks array<string>, fixed array<int>")
    out = work.keep(out, "blocks")
    whole = F.array_join("blocks", "\n")
    rest = F.array_join(F.filter("blocks", lambda _, i: ~F.array_contains("fixed", i)), "\n")
    many = out.where("size(fixed) > 0").groupBy("host", "slot").agg(F.sum(F.length(whole)).alias("a"), F.sum(F.length(rest)).alias("b"))
    copies = work.keep(many.where("2 * b < a").select("host", F.coalesce("slot", F.lit(0)).alias("slot"), F.lit(True).alias("copies")), "copies")
    out = _joined(out.withColumn("slot", F.coalesce("slot", F.lit(0))), copies, ["host", "slot"], BROADCAST_HOSTS)
    text = F.when(F.col("copies").isNotNull() | (F.size("fixed") == 0) | (rest == ""), whole).otherwise(rest)
    return out.select("id", "url", text.alias("text")).select("id", "url", "text", F.length("text").cast("long").alias("n_chars"))
