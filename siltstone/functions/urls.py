"""URL and host functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
#: Country domains below which these labels are public suffixes, such as co.uk and com.au.
SECOND_LEVEL_COUNTRIES = "ae ar at au bd bo br ci cn co cr cy do ec eg fj gh gr gt hk hn hu id il im in iq je jm jo jp ke kh kr kw lb lk ly ma mm mo mt mx my na nf ng ni np nz om pa pe pg ph pk pl pr ps pt py qa ro rs ru sa sb sg sv sz th tn tr tt tw tz ua ug uk uy uz ve vi vn ye za zm zw".split()
SECOND_LEVEL_LABELS = "ac co com edu go gob gov govt mil ne net nhs nom or org plc sch school web".split()
#: Suffixes below which every label is a suffix, and names excepted from that.
WILDCARD_SUFFIXES, EXCEPTIONS = ["ck", "er"], ["www.ck"]
#: Session parameters removed from query strings and paths.
SESSION_KEYS = ["phpsessid", "sessionid", "session_id", "jsessionid", "aspsessionid[a-z]*", "oscsid", "zenid", "cfid", "cftoken", "sid", "s"]


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; null if there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(h), r"\.+$", ""), F.lit(""))


def strip_www(h: Column) -> Column:
    """Without a leading ``www.``, unless nothing but a top-level domain would be left."""
    return F.when(h.rlike(r"^www\.[^.]+\..+"), F.substring(h, 5, 10_000)).otherwise(h)


def _last(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, -n, n), ".")


def _two_labels(labels: Column) -> Column:
    """Whether a name ends in a public suffix of two labels."""
    return (F.size(labels) >= 2) & F.element_at(labels, -1).isin(SECOND_LEVEL_COUNTRIES) & F.get(labels, F.size(labels) - 2).isin(SECOND_LEVEL_LABELS)


def root_domain(h: Column) -> Column:
    """The registrable domain: an address stays itself; a bare suffix or invalid name gives null."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two, one = F.when(n >= 2, _last(labels, 2)), F.element_at(labels, -1)
    three = F.when(n >= 3, _last(labels, 3))
    return (
        F.when(h.rlike(IPV4), h)
        .when(~F.coalesce(h.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)+$"), F.lit(False)), None)
        .when(two.isin(EXCEPTIONS), two)
        .when(_two_labels(labels) | one.isin(WILDCARD_SUFFIXES), three)
        .when(one.rlike("^[a-z]{2,}$"), two)
    )


def tld(h: Column) -> Column:
    """The public suffix; an address gives ``inaddr-arpa.arpa``."""
    labels = F.split(h, r"\.")
    two, one = F.when(F.size(labels) >= 2, _last(labels, 2)), F.element_at(labels, -1)
    wide = _two_labels(labels) | (one.isin(WILDCARD_SUFFIXES) & ~two.isin(EXCEPTIONS))
    return F.when(h.rlike(IPV4), F.lit("inaddr-arpa.arpa")).when(F.coalesce(wide, F.lit(False)), two).otherwise(one)


def invert_host(h: Column) -> Column:
    return F.array_join(F.reverse(F.split(h, r"\.")), ".")


def normalize_host(h: Column, without_www: bool = False) -> Column:
    """Lower case, no blanks, no dots at the ends; null if invalid. Addresses stay."""
    x = F.regexp_replace(F.lower(h), r"(\s|%20)+", "")
    x = F.regexp_replace(x, r"^\.+|\.+$", "")
    x = strip_www(x) if without_www else x
    return F.when(x.rlike(IPV4) | x.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)*$"), x)


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def without_session(url: Column) -> Column:
    """Removes session identifiers from path parameters, path segments and query strings."""
    keys = "|".join(SESSION_KEYS)
    x = F.regexp_replace(url, rf"(?i);({keys})=[^/?#;&]*", "")
    x = F.regexp_replace(x, r"(?i)/\(s\([a-z0-9]{24}\)\)", "")
    x = F.regexp_replace(x, r"(?i)/sessions?/[0-9a-f]{16,}", "")
    x = F.regexp_replace(x, rf"(?i)([?&])(?:(?:{keys})=[^&#]*(?:&|(?=#)|$))+", "$1")
    return F.regexp_replace(x, r"[?&]+(#|$)", "$1")


def canonical_url(url: Column, without_www: bool = False) -> Column:
    """scheme://host[:port but 80]path-before-;[?query], without session ids; ``#!`` fragments stay."""
    clean = without_session(F.trim(url))
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    user = F.regexp_extract(clean, r"^[^:/?#]+://([^/?#@]*@)", 1)
    port = F.regexp_extract(clean, r"^[^:/?#]+://[^/?#]*?:(\d+)(?=[/?#]|$)", 1)
    h = host(clean)
    h = strip_www(h) if without_www else h
    fragment = F.regexp_extract(clean, r"(#!.*)$", 1)
    tail = F.regexp_replace(path(clean), r";.*$", "")
    q = F.coalesce(F.concat(F.lit("?"), query(clean)), F.lit(""))
    shown = F.when(port.isin("", "80"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(h.isNotNull() & (scheme != ""), F.concat(scheme, F.lit("://"), user, h, shown, tail, q, fragment))


def home_page(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), host(url), F.lit("/"))


def ip_to_int(ip: Column) -> Column:
    """A dotted address as an unsigned number; null if it isn't one."""
    p = F.split(ip, r"\.")
    n = sum((F.try_element_at(p, F.lit(i + 1)).cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.try_element_at(p, F.lit(1)).cast("long") * (1 << 24))
    return F.when(ip.rlike(IPV4), n)


def int_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftrightunsigned(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
