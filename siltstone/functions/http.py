"""HTTP metadata: headers, MIME types, dates, cache lifetime, robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME types by what a parser does with them.
TEXT_TYPES = ["text/plain", "application/x-javascript", "application/javascript", "text/javascript", "text/css"]
HTML_TYPES = ["text/html", "application/xhtml+xml", "application/xhtml"]
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/rdf+xml", "text/rss", "text/atom"]
XML_TYPES = ["text/xml", "application/xml"]
#: Path extensions that are never text, and those that are.
BINARY_EXTENSIONS = "jpg jpeg gif png bmp ico svg mp3 mp4 avi mov wmv flv wav swf zip gz tgz rar 7z exe dmg iso bin css js".split()
TEXT_EXTENSIONS = "html htm shtml xhtml php asp aspx jsp cfm txt pdf doc xml rss atom".split()
#: Date forms without the name of the day, which says nothing new.
HTTP_DATES = ["dd MMM yyyy HH:mm:ss z", "dd-MMM-yy HH:mm:ss z", "MMM d HH:mm:ss yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'"]


def header_map(block: Column) -> Column:
    """Header lines as a map of lower-cased names; the last of equal names wins."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    return F.map_from_arrays(names, last)


def status_code(block: Column) -> Column:
    return F.nullif(F.regexp_extract(block, r"^HTTP/\d\.\d\s+(\d{3})", 1), F.lit("")).cast("int")


def charset(content_type: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1), F.lit("")))


def mime(content_type: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(content_type, r"^([^;,]*)", 1)))


def disposition(content_type: Column) -> Column:
    m = mime(content_type)
    return (
        F.when(m.isin(HTML_TYPES), "HTML").when(m.isin(FEED_TYPES), "FEED").when(m.isin(XML_TYPES), "XML")
        .when(m.isin(TEXT_TYPES) | m.startswith("text/"), "TEXT").when(m.isNull() | (m == ""), "OTHER").otherwise("REJECT")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))


def http_date(text: Column) -> Column:
    """Seconds since 1970 of a date in any of the usual forms; null if in none."""
    bare = F.regexp_replace(text, r"^\s*(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in HTTP_DATES)).cast("long")


def freshness_seconds(status: Column, cache_control: Column, date: Column, expires: Column, last_modified: Column, age: Column) -> Column:
    """Cache lifetime: no-cache 0; max-age; expires - date; a week less the age for 200 and 203; else unlimited or 0."""
    flags, week = F.lower(F.coalesce(cache_control, F.lit(""))), 7 * 86400
    max_age = F.nullif(F.regexp_extract(flags, r"max-age\s*=\s*(\d+)", 1), F.lit("")).cast("long")
    return (
        F.when(flags.rlike("no-cache|no-store"), F.lit(0))
        .when(max_age.isNotNull(), max_age)
        .when(expires.isNotNull() & date.isNotNull(), F.greatest(expires - date, F.lit(0)))
        .when(status.isin(200, 203) & ~flags.contains("must-revalidate"), F.greatest(F.lit(week) - F.coalesce(date - last_modified, age, F.lit(0)), F.lit(0)))
        .when(status.isin(300, 301, 410), F.lit(2**31))
        .otherwise(F.lit(0))
    )


def robots_rules(text: Column, agent: str) -> Column:
    """array<struct<prefix, allow>> of the stanza for ``agent``, else of that for ``*``."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"#[^\n]*", ""), r"\r", "")
    stanzas = F.filter(F.split(clean, r"(?<=\n|^)(?=\s*user-agent:)"), lambda s: s.rlike("user-agent:"))
    own = F.filter(stanzas, lambda s: s.rlike(rf"user-agent:[ \t]*{agent}"))
    any_ = F.filter(stanzas, lambda s: s.rlike(r"user-agent:[ \t]*\*"))
    chosen = F.coalesce(F.get(own, F.lit(0)), F.get(any_, F.lit(0)), F.lit(""))
    lines = F.filter(F.split(chosen, r"\n"), lambda s: s.rlike(r"^\s*(dis)?allow:[ \t]*\S"))
    return F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r":[ \t]*(\S*)", 1).alias("prefix"), (~s.rlike(r"^\s*dis")).alias("allow")))


def robots_allow(rules: Column, path: Column) -> Column:
    """The first rule whose prefix matches decides; without one, allowed."""
    return F.coalesce(F.get(F.filter(rules, lambda r: F.startswith(F.lower(path), r["prefix"])), F.lit(0))["allow"], F.lit(True))
