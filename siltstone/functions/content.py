"""Content parsing: bytes to text, HTML to title, metas, links and text, feeds to items."""

from __future__ import annotations

import codecs
import html
import re
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

#: Elements that carry links, and the attribute that does.
LINK_ATTRIBUTES = {"a": "href", "area": "href", "link": "href", "frame": "src", "iframe": "src", "script": "src", "img": "src"}
#: Elements whose start and end begin a new line of text.
LINE_ELEMENTS = frozenset("address article blockquote br dd div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li ol p pre section table td th tr ul".split())
#: Names under which pages declare character sets that they don't use.
ALIASES = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "x-sjis": "shift_jis", "x-gbk": "gbk", "gb2312": "gb18030", "utf8": "utf-8"}

_BOMS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
_META_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([\w.:-]+)|<\?xml[^>]{0,100}?encoding\s*=\s*[\"']([\w.:-]+)", re.I)
_DECLARED = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def known_charset(name: str | None) -> str | None:
    """The codec that a declared name stands for; None if there is none."""
    if not name:
        return None
    name = name.strip().lower()
    try:
        return codecs.lookup(ALIASES.get(name, name)).name
    except LookupError:
        return None


def detect_charset(data: bytes, content_type: str | None = None) -> tuple[str, str]:
    """(charset, by): the header's, else the byte order mark's, else the one declared in the page, else a guess by what decodes."""
    header = _DECLARED.search(content_type or "")
    if found := known_charset(header and header[1]):
        return found, "header"
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name, "mark"
    meta = _META_CHARSET.search(data[:4096])
    if found := known_charset(meta and (meta[1] or meta[2]).decode("ascii")):
        return found, "meta"
    for name in ("utf-8", "shift_jis", "euc_jp", "gb18030"):
        try:
            data.decode(name)
        except UnicodeDecodeError as e:
            if not (name == "utf-8" and e.start >= len(data) - 3):  # cut inside the last character
                continue
        if name == "utf-8" or sum(b > 127 for b in data) * 5 >= len(data):
            return name, "guess"
    return "cp1252", "guess"


def inflate(data: bytes, most: int = 1 << 27) -> tuple[bytes, bool]:
    """(content, truncated) of gzip or deflate data; other data stays. What a cut-off stream still holds is kept."""
    if not data.startswith((b"\x1f\x8b", b"\x78\x01", b"\x78\x9c", b"\x78\xda")):
        return data, False
    z = zlib.decompressobj(47)
    try:
        out = z.decompress(data, most)
        return out, not z.eof
    except zlib.error:
        return data, False


def strip_html(text: str | None) -> str | None:
    """Text without tags, character references decoded, blanks collapsed: a feed item's description."""
    return None if text is None else " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.base, self.in_head, self.title, self.metas, self.links, self.text = url, False, None, [], [], []
        self.open_title = self.skip = self.anchor = None
        self.context: list[tuple[str, int, int]] = []  # enclosing tables: (element, rows, cells)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "base" and self.in_head and a.get("href"):
            self.base = urljoin(self.base, a["href"])
        elif tag == "title" and self.title is None:
            self.open_title = []
        elif tag == "meta":
            self.metas.append({"name": (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower(), "content": a.get("content", "")})
        elif tag in ("script", "style"):
            self.skip = tag
        elif tag == "table":
            self.context.append((tag, 0, 0))
        elif tag in ("tr", "td", "th") and self.context:
            t, rows, cells = self.context[-1]
            self.context[-1] = (t, rows + 1, 0) if tag == "tr" else (t, rows, cells + 1)
        if (where := LINK_ATTRIBUTES.get(tag)) and a.get(where, "").strip():
            t, rows, cells = self.context[-1] if self.context else (None, None, None)
            link = {"type": tag, "href": self.resolved(a[where].strip()), "rel": a.get("rel", "").lower() or None, "text": "", "row": rows, "cell": cells}
            self.links.append(link)
            if tag == "a":
                self.anchor = link
        if tag in LINE_ELEMENTS:
            self.text.append("\n")

    def resolved(self, href: str) -> str:
        try:
            return urljoin(self.base, href)
        except ValueError:
            return href

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_head = False
        elif tag == "title" and self.open_title is not None:
            self.title, self.open_title = " ".join("".join(self.open_title).split()), None
        elif tag == "a":
            self.anchor = None
        elif tag == "table" and self.context:
            self.context.pop()
        if tag == self.skip:
            self.skip = None
        if tag in LINE_ELEMENTS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.open_title is not None:
            self.open_title.append(data)
        elif self.skip is None:
            if self.anchor is not None:
                self.anchor["text"] = " ".join(f"{self.anchor['text']} {data}".split())
            self.text += [data, " "]


def parse_html(page: str | None, url: str | None) -> dict:
    """title, base, metas (name, content), links (type, href, rel, text, row, cell) and text of a page."""
    p = _Page(url or "")
    p.feed(page or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.text).split("\n"))
    return {"title": p.title, "base": p.base, "metas": p.metas, "links": p.links, "text": "\n".join(x for x in lines if x)}


def parse_html_raw(page: str | None, url: str | None) -> dict:
    """What ``parse_html`` finds, with character references as they stand."""
    kept = "\udc26"  # for &; no valid text holds a half of a pair

    def back(x):
        if isinstance(x, str):
            return x.replace(kept, "&")
        if isinstance(x, dict):
            return {k: back(v) for k, v in x.items()}
        return [back(v) for v in x] if isinstance(x, list) else x

    return back(parse_html(page and page.replace("&", kept), url))


def _local(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _inner(e, *names) -> str | None:
    for name in names:
        for c in e:
            if _local(c.tag) == name and (t := "".join(c.itertext()).strip()):
                return t
    return None


def _link(e) -> str | None:
    found = [(c.get("rel", "alternate"), (c.get("href") or c.text or "").strip()) for c in e if _local(c.tag) == "link"]
    return next((h for rel, h in found if rel == "alternate" and h), None)


def parse_feed(source: str | None) -> dict | None:
    """kind, title, link, truncated and items (title, link, published, author, categories, description, links) of RSS, RDF or Atom; None for others.

    A feed that is cut off is closed after its last whole item. Document types and
    entity definitions are removed before parsing.
    """
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>|<\?xml[^>]*\?>", "", source or "").strip()
    head = re.match(r"(?:<!--.*?-->|\s)*<([\w:.-]+)", text, re.S)
    root = head[1].rpartition(":")[2].lower() if head else ""
    if root not in ("rss", "rdf", "feed"):
        return None
    truncated = False
    try:
        tree = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        truncated = True
        ends = [m.end() for m in re.finditer(r"</(?:\w+:)?(?:item|entry)\s*>", text)]
        closing = {"rss": "</channel></rss>", "feed": f"</{head[1]}>", "rdf": f"</{head[1]}>"}[root]
        try:
            tree = ElementTree.fromstring(text[: ends[-1]] + closing) if ends else None
        except ElementTree.ParseError:
            tree = None
        if tree is None:
            return {"kind": root, "title": None, "link": None, "truncated": True, "items": []}
    channel = next((c for c in tree if _local(c.tag) == "channel"), tree)
    items = []
    for e in tree.iter():
        if _local(e.tag) in ("item", "entry"):
            body = _inner(e, "encoded", "content", "description", "summary")
            inside = [x["href"] for x in parse_html(body, _link(e))["links"] if x["type"] == "a"] if body and "<" in body else []
            cats = [c.get("term") or (c.text or "").strip() for c in e if _local(c.tag) == "category"]
            items.append({"title": strip_html(_inner(e, "title")), "link": _link(e), "published": _inner(e, "pubdate", "published", "date", "updated"), "author": _inner(e, "author", "creator"), "categories": [c for c in cats if c], "description": strip_html(body), "links": inside})
    return {"kind": {"feed": "atom"}.get(root, "rss"), "title": strip_html(_inner(channel, "title")), "link": _link(channel), "truncated": truncated, "items": items}
