"""PII: detected entities receive keyed surrogates of the same type, script and format.

A surrogate comes from a keyed permutation (a Feistel network on mixed radixes)
of all strings of the entity's format: vowels stay vowels, consonants stay
consonants of the same script and case, digits stay digits. An entity therefore
has one surrogate wherever it occurs, and two entities of a format never share
one. Card numbers keep their checksum, addresses stay in the public range, given
names stay in the list of their gender, and nothing is its own surrogate. A check over the whole corpus compares
distinct entities with distinct surrogates and re-keys the run if two collide.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Workspace

#: Given names by gender, told by a title or followed by a capitalised surname.
GIVEN = {
    "f": "Anna Maria Laura Julia Sarah Emma Sophie Claire Marie Camille Elena Carmen Lucia Isabel Ingrid Petra Sabine Monika Alice Mary Jennifer Linda Susan Karen Emily Olivia Hannah Nora Ana María Lucía Sofía Beatriz Nathalie Isabelle Charlotte Katharina Lena Elizabeth Margaret Jessica Françoise".split(),
    "m": "John James Robert Michael William David Thomas Peter Paul Hans Klaus Stefan Wolfgang Jean Pierre Michel Antoine Carlos Juan Miguel Pedro Luis Daniel Andrew George Edward Henry Oliver José Antonio Manuel Francisco Javier Fernando Jorge François Jacques Jürgen Markus Andreas Christopher Joseph".split(),
}
#: Given names by gender in Cyrillic and Greek script.
NAMES = GIVEN | {
    "f-cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Дарья Анастасия Оксана Людмила".split(),
    "m-cyrillic": "Иван Сергей Александр Дмитрий Андрей Алексей Михаил Николай Владимир Павел Олег Игорь Виктор Пётр".split(),
    "f-greek": "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Άννα Γεωργία Ιωάννα".split(),
    "m-greek": "Γεώργιος Δημήτρης Ιωάννης Νίκος Κωνσταντίνος Παναγιώτης Χρήστος Αντώνης".split(),
}
_GENDER = {n: g for g, names in NAMES.items() for n in names}
#: Titles by gender, "" for either.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Mme": "f", "Sr": "m", "Sra": "f", "г-н": "m", "г-жа": "f", "κ": ""}
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞŸŒА-ЯЁΑ-ΩΆΈΉΊΌΎΏ", "a-zß-öø-ÿœа-яёα-ωάέήίόύώ"
_SURNAME = rf"[{_UPPER}][{_LOWER}]+(?:-[{_UPPER}][{_LOWER}]+)*"
_TITLE = r"(?<!\w)(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?[ ]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_KINDS = [
    r"(?P<email>(?<![\w.+-])[\w+-]++(?:\.[\w+-]++)*+@[^\W_](?:[^\W_]|-)*(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}(?![\w-]))",
    r"(?P<secret>(?i:(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)(?![A-Za-z])[\"']?\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_\-+/](?:[A-Za-z0-9_\-+/.=~!@#$%^&*]{6,})[A-Za-z0-9_\-+/=~!@#$%^&*]))",
    r"(?P<bare>(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|AIza[\w-]{35}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9]))",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b)",
    r"(?P<ip>(?<![\w.])" + rf"{_OCTET}(?:\.{_OCTET}){{3}}" + r"(?![\w]|\.\d))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\)[ ]?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))",
    r"(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-]))",
    rf"(?P<person>(?=[{_UPPER}гκ])(?:(?:{_TITLE})?(?<!\w)(?:" + "|".join(sorted(_GENDER, key=len, reverse=True)) + rf")[ ](?:[{_UPPER}]\.[ ])?{_SURNAME}(?!\w)|{_TITLE}(?:[{_UPPER}]\.[ ])*{_SURNAME}(?:[ ](?!(?:Sr|Jr)\b){_SURNAME})?(?!\w)))",
]
#: What a text holds that has a secret; without one and without an at sign entities start at a digit, a plus, a bracket or a capital.
_SECRET = re.compile(r"(?i:token|secret|passw|key)|sk-|gh[pousr]_|AIza|AKIA|xox|eyJ")


@lru_cache(maxsize=4)
def _pattern(email: bool, secret: bool) -> re.Pattern:
    """All kinds in order, without those that a text cannot hold."""
    kinds = "|".join(k for k in _KINDS if (email or "(?P<email>" not in k) and (secret or not re.search(r"\(\?P<(?:secret|bare)>", k)))
    return re.compile(kinds if email or secret else rf"(?=[\d+({_UPPER}гκ])(?:{kinds})")


#: Prefixes of bare secrets keep their form.
_PREFIX = re.compile(r"AKIA|AIza|gh[pousr]_|sk-|xox[abprs]-|eyJ")
#: Country calling codes of one and two digits; others have three.
_CALLING = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")

#: Letters that stand for each other, and ranges of letters of other scripts that do.
_ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "ñç", "åæøœ", "ðłđþß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_RANGES = [(0x100, 0x17F), (0x3AC, 0x3CE), (0x450, 0x52F), (0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x1E00, 0x1EFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
_ALPHABETS += ["".join(c for c in map(chr, range(lo, hi + 1)) if c.isalpha() and c == c.lower() and (not c.upper().isascii()) and not any(c in x for x in _ALPHABETS)) for lo, hi in _RANGES]
_PLACE = {c: (a, i) for a, letters in enumerate(_ALPHABETS) for i, c in enumerate(letters)}
_HEX = {c: (0, i) for i, c in enumerate("0123456789abcdef")}


def _prf(key: bytes, *what) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), key=key, digest_size=32).digest(), "big")


def permute(places: list[int], radixes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection on digits of mixed radixes that leaves no value as it was.

    A Feistel network puts all values into a secret order; each value is replaced
    by the one a secret number of steps further on.
    """
    half = (len(places) + 1) // 2
    sides = []
    for lo, hi in ((0, half), (half, len(places))):
        x, size = 0, 1
        for p, r in zip(places[lo:hi], radixes[lo:hi], strict=True):
            x, size = x * r + p, size * r
        sides.append([x, size])
    (_, m), (_, n) = sides
    if m * n > 1:
        for i in range(8):
            a, b = sides[i % 2], sides[1 - i % 2]
            a[0] = (a[0] + _prf(key, tweak, i, b[0])) % a[1]
        moved = (sides[0][0] * n + sides[1][0] + 1 + _prf(key, tweak, "step") % (m * n - 1)) % (m * n)
        sides[0][0], sides[1][0] = divmod(moved, n)
        for i in reversed(range(8)):
            a, b = sides[i % 2], sides[1 - i % 2]
            a[0] = (a[0] - _prf(key, tweak, i, b[0])) % a[1]
    out = []
    for (x, _), (lo, hi) in zip(sides, ((0, half), (half, len(places))), strict=True):
        part = []
        for r in reversed(radixes[lo:hi]):
            x, p = divmod(x, r)
            part.append(p)
        out += part[::-1]
    return out


def _like(text: str, key: bytes, tweak: str, table: dict = _PLACE) -> str:
    """The image of a string among all of its format; letter case is put back as it was."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    at = [i for i, c in enumerate(low) if c in table]
    size = 16 if table is _HEX else 0
    spots = [table[low[i]] for i in at]
    form = "".join(f"<{table[c][0]}>" if c in table else c for c in low)
    moved = permute([p for _, p in spots], [size or len(_ALPHABETS[a]) for a, _ in spots], key, f"{tweak}:{form}")
    out = list(text)
    for i, (a, _), p in zip(at, spots, moved, strict=True):
        c = "0123456789abcdef"[p] if size else _ALPHABETS[a][p]
        out[i] = c.upper() if text[i].isupper() or size and text.upper() == text else c
    return "".join(out)


def _checksum(digits: str) -> int:
    return sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits)), 1)) % 10


def _card(text: str, key: bytes) -> str:
    """All digits but the last are permuted; the last keeps the checksum as it was."""
    digits = re.sub(r"\D", "", text)
    body = _like(digits[:-1], key, f"card{_checksum(digits)}")
    last = next(d for d in "0123456789" if _checksum(body + d) == _checksum(digits))
    new = iter(body + last)
    return re.sub(r"\d", lambda m: next(new), text)


def _ip(text: str, key: bytes) -> str:
    def public(p: list[int]) -> bool:
        return 0 < p[0] < 224 and p[0] not in (10, 127)

    own = [int(x) for x in text.split(".")]
    p = permute(own, [256] * 4, key, "ip")
    while public(p) != public(own):  # walks inside the permutation's cycle, so it stays one to one
        p = permute(p, [256] * 4, key, "ip")
    return ".".join(map(str, p))


def parts(text: str) -> tuple[str, str, str]:
    """A person's title, given name with initials, and surname; what is missing is empty."""
    words = text.split(" ")
    title = words.pop(0) if words[0].rstrip(".") in TITLES else ""
    return title, " ".join(words[:-1]), words[-1]


def _person(text: str, key: bytes) -> str:
    title, given, surname = parts(text)
    first, _, initials = given.partition(" ") if given.split(" ")[0] in _GENDER else ("", "", given)
    names = NAMES[_GENDER[first]] if first else [""]
    # both names move together, so that no two persons of a gender meet
    spots = [_PLACE[c] if c in _PLACE else None for c in surname.lower()]
    form = "".join("?" if s is None else f"<{s[0]}>" for s in spots) + "".join(c for c, s in zip(surname, spots, strict=True) if s is None)
    moved = permute([names.index(first), *(s[1] for s in spots if s)], [len(names), *(len(_ALPHABETS[s[0]]) for s in spots if s)], key, f"person:{_GENDER.get(first, '')}:{form}")
    rest = iter(moved[1:])
    new = "".join(c if s is None else _ALPHABETS[s[0]][next(rest)] for c, s in zip(surname, spots, strict=True))
    new = "".join(n.upper() if c.isupper() else n for c, n in zip(surname, new, strict=True))
    return " ".join(x for x in (title, names[moved[0]], _like(initials, key, "initials") if initials else "", new) if x)


def _plain(text: str) -> str:
    return re.sub(r"[\W_]", "", text).upper()


def _fill(text: str, new: str) -> str:
    """``text`` with its letters and digits replaced by those of ``new``, in order; spacing stays."""
    rest = iter(new)
    return re.sub(r"[^\W_]", lambda m: next(rest), text)


def surrogate(kind: str, text: str, key: bytes) -> str:
    if kind == "email":
        head, dot, top = text.rpartition(".")
        return _like(head, key, f"email:{top.lower()}") + dot + top
    if kind == "secret":
        head = _PREFIX.match(text)
        n = head.end() if head else 0
        return _like(text, key, "hex", _HEX) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) else text[:n] + _like(text[n:], key, f"secret:{text[:n]}" if n else "secret")
    if kind == "iban":
        plain = _plain(text)
        return _fill(text, plain[:2] + _like(plain[2:], key, f"iban:{plain[:2]}"))
    if kind == "phone":
        plain = _plain(text)
        n = _CALLING.match(plain).end() if text.startswith("+") else 0
        return _fill(text, plain[:n] + _like(plain[n:], key, f"phone:{'+' * (n > 0)}{plain[:n]}"))
    return {"ip": _ip, "card": _card, "person": _person, "ssn": lambda t, k: _like(t, k, "ssn")}[kind](text, key)


def identity(kind: str, text: str) -> str:
    """What tells two mentions of one entity: letter case, titles, initials and the spacing of numbers don't."""
    if kind == "person":
        _, given, surname = parts(text)
        first = given.split(" ")[0]
        named = [w for w in given.split(" ") if w and not w.endswith(".")]
        return f"person:{' '.join([*(named[:1] if first in _GENDER else named), surname])}"
    if kind in ("phone", "iban", "card"):
        return f"{kind}:{'+' * text.startswith('+')}{_plain(text)}"
    return f"{kind}:{text if kind == 'secret' else text.lower()}"


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity, in order."""
    found = []
    for m in _pattern("@" in text, bool(_SECRET.search(text))).finditer(text):
        kind = m.lastgroup
        found.append((*m.span("value"), "secret") if kind in ("secret", "value") else (*m.span(), "secret" if kind == "bare" else kind))
    return found


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of each mention, in order.

    A person who is named in full is also meant by the given name or the surname
    alone, with or without a title: by the nearest such person before, of the
    title's gender if there is one, else by the first after.
    """
    found = [(a, b, k, text[a:b]) for a, b, k in entities(text)]
    full = [(a, *parts(t)[1:], t) for a, _, k, t in found if k == "person" and parts(t)[1].split(" ")[0] in _GENDER]
    if not full:
        return found

    def meant(at: int, word: str, gender: str) -> str | None:
        same = [x for x in full if word in (x[1].split(" ")[0], x[2])]
        same = [x for x in same if _GENDER[x[1].split(" ")[0]].startswith(gender)] or same
        return (max((x for x in same if x[0] <= at), default=None) or min(same))[3] if same else None

    out, spans = [], [(a, b) for a, b, _, _ in found]
    for a, b, k, t in found:
        if k == "person" and parts(t)[1].split(" ")[0] not in _GENDER:
            t = meant(a, parts(t)[2], TITLES.get(parts(t)[0].rstrip("."), "")) or t
        out.append((a, b, k, t))
    words = {w for _, given, surname, _ in full for w in (given.split(" ")[0], surname)}
    at = 0
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?!\w)", text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            out.append((*m.span(), "person", meant(m.start(), m[0], "")))
    return sorted(out)


def shown(kind: str, mention: str, entity: str, image: str) -> str:
    """What stands for a mention whose entity has the surrogate ``image``."""
    if kind != "person" or mention == entity:
        return image
    title, given, surname = parts(mention)
    _, own, _ = parts(entity)
    _, new, last = parts(image)
    if not given:
        short = new.split(" ")[0] if surname == own.split(" ")[0] else last
        return f"{title} {short}" if title else short
    return " ".join(x for x in (title, new if given == own else re.sub(rf"[{_UPPER}](?=\.)", "X", given), last) if x)


def _replace(key: bytes):
    kind = [("text", pa.string()), ("entities", pa.list_(pa.struct([("kind", pa.string()), ("was", pa.int64()), ("is", pa.int64())])))]

    def run(batches):
        @lru_cache(maxsize=100_000)
        def known(k: str, t: str) -> tuple[str, int, int]:
            s = surrogate(k, t, key)
            was, now = (int.from_bytes(hashlib.blake2b(identity(k, x).encode(), digest_size=8).digest(), "big", signed=True) for x in (t, s))
            return s, was, now

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, lists = [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    out, last, listed = [], 0, []
                    for start, end, k, t in mentions(text) if text else ():
                        s, was, now = known(k, t)
                        out += [text[last:start], shown(k, text[start:end], t, s)]
                        last = end
                        listed.append({"kind": k, "was": was, "is": now})
                    texts.append("".join([*out, text[last:]]) if out else text)
                    lists.append(listed)
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(lists, kind[1][1])], names=[*part.schema.names[:-1], "text", "entities"])

    return run


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates (kind, is) that stand for more than one entity of a table with ``entities``."""
    mentions = found.select(F.explode("entities").alias("e")).select("e.kind", "e.was", "e.is").distinct()
    return mentions.groupBy("kind", "is").agg(F.count("*").alias("n")).where("n > 1")


def key_of(spark: SparkSession) -> str:
    """The session's secret, by the setting ``spark.siltstone.pii.key``; without one a public word, for tests only."""
    return spark.conf.get("spark.siltstone.pii.key", "public word for tests")


def replace_entities(docs: DataFrame, work: Workspace, keep: list[str], *, secret: str, text_col: str = "text", name: str = "entities") -> DataFrame:
    """Columns ``keep``, text (entities replaced) and ``name`` (kind, was, is: digests).

    A text without entities, null or empty stays as it is. Repeated rows keep a row
    each; columns that aren't kept aren't read; an empty table gives an empty result.
    """
    chosen = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("t"))
    ddl = "".join(f"k{i} {chosen.schema[i].dataType.simpleString()}, " for i in range(len(keep)))
    for attempt in range(8):
        key = hashlib.blake2b(f"{secret}:{attempt}".encode(), digest_size=32).digest()
        found = work.keep(chosen.mapInArrow(_replace(key), ddl + "text string, entities array<struct<kind string, was long, is long>>"), "replaced")
        if not collisions(found).limit(1).count():
            return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", F.col("entities").alias(name))
        work.forget(found)
    raise RuntimeError("surrogates collide under every key")
