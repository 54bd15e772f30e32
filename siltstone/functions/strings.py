"""String functions: encodings, separators, matchers, cookies, URL repair, order of hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.urls import IPV4


def to_base64(data: Column) -> Column:
    return F.base64(data)


def from_base64(text: Column) -> Column:
    """Bytes of standard or URL-safe base64, padded or not; null if it is neither."""
    plain = F.translate(F.regexp_replace(text, r"\s|=+$", ""), "-_", "+/")
    return F.try_to_binary(F.rpad(plain, ((F.length(plain) + 3) / 4).cast("int") * 4, "="), F.lit("base64"))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of hexadecimal digits, between which blanks may stand; null for others."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(bare.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(bare))


def escape(text: Column, separator: str = "\t") -> Column:
    """Backslash, line feed and the separator behind a backslash, so that joined fields can be told apart."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit(separator), F.lit(f"\\{separator}")), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def join_escaped(fields: list[Column], separator: str = "\t") -> Column:
    return F.concat_ws(separator, *(escape(F.coalesce(f, F.lit("")), separator) for f in fields))


def split_escaped(line: Column, separator: str = "\t") -> Column:
    """The fields that ``join_escaped`` joined."""
    mark = "\\x{%x}" % ord(separator)
    fields = F.regexp_extract_all(F.concat(line, F.lit(separator)), F.lit(rf"(?s)((?:[^\\{mark}]|\\.)*){mark}"), F.lit(1))
    return F.transform(fields, unescape)


def matches_prefix(text: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(text, p))


def matches_suffix(text: Column, suffixes: Column) -> Column:
    return F.exists(suffixes, lambda p: F.endswith(text, p))


def shortest_prefix(text: Column, prefixes: Column) -> Column:
    """The shortest of ``prefixes`` that ``text`` starts with; null without one."""
    return F.get(F.array_sort(F.transform(F.filter(prefixes, lambda p: F.startswith(text, p)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), F.lit(0))["p"]


def longest_prefix(text: Column, prefixes: Column) -> Column:
    return F.array_max(F.transform(F.filter(prefixes, lambda p: F.startswith(text, p)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def longest_suffix(text: Column, suffixes: Column) -> Column:
    return F.array_max(F.transform(F.filter(suffixes, lambda p: F.endswith(text, p)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def index_of(text: Column, part: Column) -> Column:
    """Where ``part`` starts in ``text``, counted from 0; -1 if nowhere."""
    return F.position(part, text) - 1


def leading_long(text: Column) -> Column:
    """The number that a text starts with, sign included; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1), F.lit("")).cast("long")


def cookie(header: Column) -> Column:
    """A Set-Cookie header: struct(name, value, domain, path, max_age, expires, secure, http_only); null without a name."""
    parts = F.transform(F.split(header, ";"), lambda p: F.trim(p))
    first = F.get(parts, F.lit(0))

    def attribute(name: str) -> Column:
        found = F.get(F.filter(parts, lambda p: p.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
        return F.nullif(F.regexp_extract(found, r"=\s*\"?([^\"]*)\"?$", 1), F.lit(""))

    def flag(name: str) -> Column:
        return F.exists(parts, lambda p: F.lower(p) == name)

    value = F.regexp_extract(first, r"=\s*\"?([^\"]*)\"?$", 1)
    return F.when(first.rlike(r"^[^=\s]+\s*="), F.struct(
        F.trim(F.regexp_extract(first, r"^([^=]+)=", 1)).alias("name"), value.alias("value"), F.lower(F.regexp_replace(attribute("domain"), r"^\.", "")).alias("domain"), attribute("path").alias("path"),
        attribute("max-age").try_cast("long").alias("max_age"), attribute("expires").alias("expires"), flag("secure").alias("secure"), flag("httponly").alias("http_only"),
    ))


def cookie_domain_matches(host: Column, domain: Column) -> Column:
    """A cookie's domain holds for the host itself and for hosts below it; addresses match only themselves."""
    return (host == domain) | (F.endswith(host, F.concat(F.lit("."), domain)) & ~host.rlike(IPV4))


def cookie_path_matches(path: Column, own: Column) -> Column:
    return (path == own) | F.startswith(path, F.when(F.endswith(own, F.lit("/")), own).otherwise(F.concat(own, F.lit("/"))))


def repaired_url(url: Column) -> Column:
    """Blanks trimmed and encoded, a stray percent sign encoded, hexadecimal digits in capitals, letters and digits decoded, ``/./`` and ``//`` in the path made one."""
    x = F.replace(F.trim(F.regexp_replace(url, r"[\t\r\n]", "")), F.lit(" "), F.lit("%20"))
    x = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    digits = F.array_distinct(F.regexp_extract_all(x, F.lit("(%[0-9A-Fa-f]{2})"), F.lit(1)))
    plain = lambda c: F.decode(F.unhex(F.substring(c, 2, 2)), "ISO-8859-1")
    better = lambda c: F.when(plain(c).rlike("^[A-Za-z0-9_.~-]$"), plain(c)).otherwise(F.upper(c))
    x = F.aggregate(digits, x, lambda text, c: F.replace(text, c, better(c)))
    return F.regexp_replace(x, r"(?<!:)/(?:\.?/)+", "/")


def marked_www(url: Column) -> Column:
    """A leading ``www.`` of the host moved behind it as a mark, so that both forms sort together."""
    return F.regexp_replace(url, r"(?i)^([a-z][a-z0-9+.-]*://)www\.([^/?#:.]+\.[^/?#:]+)", "$1$2!www")


def unmarked_www(url: Column) -> Column:
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#:!]+)!www", "$1www.$2")


def valid_domain(name: Column) -> Column:
    """Labels of 1 to 63 letters, digits and inner hyphens, 253 characters at most, a top one that isn't a number."""
    return (F.length(name) <= 253) & name.rlike(r"(?i)^([a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9])?\.)+[a-z]([a-z0-9-]{0,61}[a-z0-9])?$")


def host_order(host: Column) -> list[Column]:
    """Sort keys: hosts of a domain stand together, the domain before what is below it."""
    return [F.reverse(F.split(host, r"\.")), host]


def murmur_int(value: Column, seed: int = 0) -> Column:
    """The 32-bit finaliser of MurmurHash3 over a number's low 32 bits, as a signed integer."""
    mask = F.lit(0xFFFFFFFF)

    def times(x: Column, m: int) -> Column:
        low, high = x.bitwiseAND(0xFFFF), F.shiftrightunsigned(x, 16)
        return (low * m + F.shiftleft((high * m).bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)

    x = value.cast("long").bitwiseXOR(F.lit(seed)).bitwiseAND(mask)
    x = reduce(lambda x, step: times(x.bitwiseXOR(F.shiftrightunsigned(x, step[0])), step[1]), [(16, 0x85EBCA6B), (13, 0xC2B2AE35)], x)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    return F.when(x >= 2**31, x - 2**32).otherwise(x).cast("int")
