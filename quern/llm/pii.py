"""Personal data: detection and keyed surrogates of the same type.

A surrogate depends on nothing but the secret key and the entity's identity:
its letters without case and its digits without separators. It is a keyed
permutation without fixed points of the strings of the same shape, in any
script. So equal entities, however they are written, get equal surrogates in
every document, different ones different surrogates, and none stays as it is,
without any table and whatever else a document holds. Where only part of a
shape may be used (valid card numbers, public addresses, words that are no
listed name), the permutation is walked on until it is back in that part, which
keeps it one; that walk is the check against collisions. ``collisions`` proves
the outcome on a corpus.

Cards and IBANs keep valid check digits, phone numbers their country code,
addresses the kind of range they lie in, mail addresses their top-level domain.

Names are found after a title, after a phrase that introduces one, and where a
listed first name stands before a capitalised word. Each word of a name has one
surrogate: a listed first name becomes another of its gender and script; any
other word has its letters permuted within vowels, consonants or the letters of
their script, except the last one, whose ending shows gender in many languages.
A word of a name is replaced wherever else the document has it as a whole word.

Who knows the key can undo all surrogates; there is no default key.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: Setting of the session that holds the secret key.
KEY_SETTING = "spark.quern.surrogates.key"

#: Titles (fixed values).
TITLES = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Señorita Signora Sig.ra Госпожа Mr Herr Monsieur Señor Sr Signor Господин Dr Prof"
#: Phrases before a name (fixed values).
INTRODUCTIONS = ("[Mm]y name is", "[Nn]ame:", "[Mm]ein Name ist", "[Ii]ch heiße", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Mm]eu nome é", "[Mm]i chiamo", "[Мм]еня зовут")
#: Words inside names that stay (fixed values).
PARTICLES = "de del della der den di da do dos du la le los van von vom zu zur ten ter al el bin ibn y e"
#: First names by script and gender (fixed values); no word is in two lists.
FIRST = {
    ("latin", "f"): "Alice Amelia Anna Beatrice Camille Carmen Caroline Catherine Charlotte Clara Claire Denise Diana Elena Elisabeth Elizabeth Emily Emma Eva Fiona Greta Hannah Helen Helga Ines Ingrid Isabel Jane Jennifer Jessica Johanna Juana Julia Karin Laura Linda Lucia Lucy Margaret Maria Marie Martha Mary Monica Nadia Nicole Nora Olivia Patricia Paula Petra Rachel Rebecca Rosa Sandra Sarah Sofia Sophie Susan Teresa Ursula Vera",
    ("latin", "m"): "Adam Albert Alfonso Andrew Anthony Antonio Benjamin Brian Bruno Carl Carlos Charles Christopher Daniel David Diego Edward Emil Enrique Eric Felix Fernando François Frank George Hans Henry Hugo Jacques James Javier Jean John Jonas Jorge José Joseph Juan Jürgen Kevin Klaus Leo Luis Manuel Martin Matthew Michael Miguel Oscar Paul Pedro Peter Philip Pierre Richard Robert Simon Stefan Stephen Thomas Victor Walter William Wolfgang",
    ("latin", "n"): "Alex Andrea Charlie Dominique Kim Robin Sacha Sascha Toni",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    ("cyrillic", "m"): "Александр Алексей Антон Борис Владимир Денис Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий",
    ("cyrillic", "n"): "Саша Женя Валя",
}
#: Vowels and consonants by script (fixed values); a letter that is not here moves among its neighbours.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
#: Telephone country codes of one and two digits (fixed values); all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: Ranges of addresses that are not public, and the one of public addresses of the longer kind (fixed values).
SPECIAL = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 ::/8 2001:db8::/32 fc00::/7 fe80::/10 ff00::/8 2000::/3"

_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _ranges(characters: list[int]) -> str:
    """Code points as ranges of a character class."""
    out, begin = [], None
    for a, b in zip(characters, [*characters[1:], -1], strict=True):
        begin = a if begin is None else begin
        if b != a + 1:
            out.append(f"{chr(begin)}-{chr(a)}")
            begin = None
    return "".join(out)


_MARKS = _ranges([c for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc")])
_UPPER = _ranges([c for c in range(0x41, 0x2000) if unicodedata.category(chr(c)) == "Lu"])
_W, _L = rf"\w{_MARKS}", rf"(?:[^\W\d_]|[{_MARKS}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: An apostrophe inside a name, which that of a final 's is not.
_APOSTROPHE = r"['’](?!s(?!\w))"
_WORD = rf"[{_UPPER}](?:\.|(?:(?:{_APOSTROPHE})?{_L})+(?:-{_L}+)*|(?!\w))"
_PARTICLE = "|".join(PARTICLES.split())
_NAME = rf"{_WORD}(?: (?:(?:{_PARTICLE}) ){{0,2}}{_WORD}){{0,2}}"
_TITLE = "|".join(re.escape(t) for t in TITLES.split())
#: Kinds in order of precedence where two could begin at one place.
PATTERNS = {
    "email": rf"(?<![{_W}.%+-])[{_W}%+-]+(?:\.[{_W}%+-]+)*@(?:[{_W}](?:[{_W}-]*[{_W}])?\.)+{_L}{{2,}}(?![{_W}-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?<![^:]:)(?![\w:]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![\w]|-[0-9])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)|(?<![\w.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])",
    "name": rf"(?<!\w)(?:(?:(?:{_TITLE})\.?|{'|'.join(INTRODUCTIONS)}) (?P<called>(?:(?:{_PARTICLE}) ){{0,2}}{_NAME})|(?P<given>{_WORD}) (?:(?:{_PARTICLE}) ){{0,2}}{_WORD})",
}
EMAIL, NAME = re.compile(PATTERNS["email"]), re.compile(PATTERNS["name"])
NUMBERS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k not in ("email", "name")))
#: Where a name may begin: a capitalised word or an introduction.
CAPITALISED = re.compile(rf"[{_UPPER}](?<!\w\w){_L}*(?:\.ra)?")
INTRODUCED = re.compile("|".join(INTRODUCTIONS))
DIGIT = re.compile("[0-9]")
#: Words as names have them, with hyphens and apostrophes inside.
WORD = re.compile(rf"(?<!\w){_L}+(?:(?:-|{_APOSTROPHE}){_L}+)*(?!\w)")
_TITLES = frozenset(TITLES.split())
_LISTS = {name.lower(): [n.lower() for n in names.split()] for names in FIRST.values() for name in names.split()}
_STARTS = _TITLES | {form for name in _LISTS for form in (name.capitalize(), name.upper())}


def _round(half: int, r: int, right: int, key: bytes, tweak: str) -> int:
    width = (half + 7) // 8
    seed = f"{tweak}|{half}|{r}|".encode() + right.to_bytes(width, "big")
    digest = b"".join(hashlib.blake2b(seed + bytes([i]), key=key).digest() for i in range(width // 64 + 1))
    return int.from_bytes(digest[:width], "big") & ((1 << half) - 1)


def _permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network on enough bits, walked until it lands inside."""
    if size < 2:
        return value
    half = max(((size - 1).bit_length() + 1) // 2, 1)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(6)) if back else range(6):
            if back:
                left, right = right ^ _round(half, r, left, key, tweak), left
            else:
                left, right = right, left ^ _round(half, r, right, key, tweak)
        value = left << half | right
        if value < size:
            return value


def derange(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) without fixed points: one step along a hidden order of all values."""
    return _permute((_permute(value, size, key, tweak) + 1) % size, size, key, tweak, back=True)


def _within(text: str, classes: list[str], key: bytes, tweak: str) -> str:
    """The text with each character moved within its class of characters."""
    size, value = 1, 0
    for c, s in zip(text, classes, strict=True):
        size, value = size * len(s), value * len(s) + s.index(c)
    value, out = derange(value, size, key, tweak), []
    for s in reversed(classes):
        value, digit = divmod(value, len(s))
        out.append(s[digit])
    return "".join(reversed(out))


def _walked(text: str, move: Callable[[str], str], belongs: Callable[[str], bool]) -> str:
    """Moves on until the outcome is on the same side of a property; a permutation of either side."""
    side, made = belongs(text), move(text)
    while belongs(made) != side:
        made = move(made)
    return made


@lru_cache(8192)
def _neighbours(c: str) -> str:
    """The characters that may stand for a letter or digit beyond ASCII: among the 64 around it those of its category and without another case."""
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == unicodedata.category(c) and x.lower() == x and not any(x in s for s in LETTERS)) or c


def _plain_class(c: str) -> str:
    """What a character of an address or number moves within: digits, small letters, the letters around it, or itself."""
    return next((s for s in (_DIGITS, _SMALL) if c in s), None) or (_neighbours(c) if c.isalnum() and c not in "".join(LETTERS) else next((s for s in LETTERS if c in s), c))


def _name_class(c: str) -> str:
    return next((s for s in LETTERS if c in s), None) or (_neighbours(c) if c.isalpha() else c)


def _shaped(text: str, key: bytes, tweak: str) -> str:
    """Small letters and digits of every script permuted within strings of the same shape."""
    classes = [_plain_class(c) for c in text]
    shape = hashlib.blake2b("\0".join(classes).encode(), digest_size=16).hexdigest()
    return _within(text, classes, key, f"{tweak}|{shape}")


def _lower(text: str) -> str:
    """Small letters, one for one; a letter whose small form is several stays."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _cased(made: str, like: str) -> str:
    """Capitals where the original has them."""
    return "".join(u if o != o.lower() and len(u := m.upper()) == 1 else m for m, o in zip(made, like, strict=True))


def _dressed(digits: str, like: str) -> str:
    """The digits with the original's separators."""
    rest = iter(digits)
    return "".join(next(rest) if "0" <= c <= "9" else c for c in like)


def word_surrogate(word: str, key: bytes) -> str:
    """Another listed name of the same list for a listed one; for any other word one that no list has."""
    small = _lower(word)
    if small in _LISTS:
        names = _LISTS[small]
        made = names[derange(names.index(small), len(names), key, f"listed|{names[0]}")]
        return made.upper() if word.isupper() else made.capitalize() if word[0].isupper() else made

    def move(text: str) -> str:
        classes = [_name_class(c) for c in text]
        parts = re.split(r"([-'’])", text)
        # the ending stays where others can move, and so does a short first part as in O'
        if any(len(s) > 1 for s in classes[:-1]):
            classes[-1] = text[-1]
        if len(parts) > 1 and len(parts[0]) == 1 and any(len(s) > 1 for s in classes[1:]):
            classes[0] = text[0]
        return _within(text, classes, key, f"word|{'|'.join(classes)}")

    return _cased(_walked(small, move, lambda x: x in _LISTS), word)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    if luhn(digits):  # the first digit names the industry
        body = digits[0] + _shaped(digits[1:-1], key, "card")
        return _dressed(next(body + c for c in _DIGITS if luhn(body + c)), text)
    return _dressed(_walked(digits, lambda d: _shaped(d, key, "no card"), luhn), text)


def iban_check(country: str, account: str) -> str:
    """The two check digits."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country) + '00') % 97:02d}"


def _iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    made = _shaped(account.lower(), key, f"iban|{country}").upper()
    right, valid = iban_check(country, account), iban_check(country, made)
    others = [f"{k:02d}" for k in range(100)]
    if check != right:  # wrong digits become wrong ones
        valid = [c for c in others if c != valid][[c for c in others if c != right].index(check)]
    rest = iter(country + valid + made)
    return "".join(c if c == " " else next(rest) for c in text)


@lru_cache(1)
def _special():
    return [ipaddress.ip_network(x) for x in SPECIAL.split()]


def _range_of(ip):
    """The first special range that holds an address, else all addresses of its length."""
    return next((net for net in _special() if ip in net), ipaddress.ip_network(f"{type(ip)(0)}/0"))


def _address(text: str, key: bytes) -> str:
    ip = ipaddress.ip_address(text)
    bits, net = ip.max_prefixlen, _range_of(ip)
    low, made = int(net.network_address), int(ip)
    while True:  # walk on over addresses of other ranges
        made = low + derange(made - low, net.num_addresses, key, f"ip|{net}")
        if _range_of(type(ip)(made)) == net:
            break
    new = type(ip)(made)
    shown = new.exploded if bits == 128 and "::" not in text and all(len(g) == 4 for g in text.split(":")) else str(new)
    return shown.upper() if text != text.lower() else shown


def _phone(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    code = ""
    if text.startswith("+"):
        code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES.split()), digits[:3])
    rest = digits[len(code) :]
    zeros = len(rest) - len(rest.lstrip("0"))
    zeros = min(zeros, max(len(rest) - 1, 0))
    return _dressed(code + rest[:zeros] + _shaped(rest[zeros:], key, f"phone|{code}|{zeros}"), text) if rest else text


def _ssn(text: str, key: bytes) -> str:
    def issued(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    return _dressed(_walked(text.replace("-", ""), lambda d: _shaped(d, key, "ssn"), issued), text)


def _email(text: str, key: bytes) -> str:
    rest, _, top = _lower(text).rpartition(".")
    return _cased(f"{_shaped(rest, key, 'email')}.{top}", text)


def _name(text: str, key: bytes) -> str:
    """A name without its title, word by word; particles stay."""
    return re.sub(rf"{_L}+(?:[-'’]{_L}+)*", lambda m: m[0] if m[0] in PARTICLES.split() else word_surrogate(m[0], key), text)


_MAKERS = {"email": _email, "iban": _iban, "ip": _address, "ipv6": _address, "ssn": _ssn, "card": _card, "phone": _phone, "name": _name}


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity (of a name without its title)."""
    return _MAKERS[kind](text, key)


def _ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text) is not None and any(c.isdigit() for c in text) and len([g for g in text.split(":") if g]) > 1
    except ValueError:
        return False


def _names(text: str) -> list[tuple[int, int]]:
    """Names without their title; a listed first name counts where a capitalised word follows."""
    starts = [m.start() for m in CAPITALISED.finditer(text) if m[0] in _STARTS]
    if INTRODUCED.search(text):
        starts = sorted(starts + [m.start() for m in INTRODUCED.finditer(text)])
    found, at = [], 0
    for start in starts:
        m = NAME.match(text, start) if start >= at else None
        if m and (m["called"] is not None or _lower(m["given"]) in _LISTS):
            at = m.end()
            found.append((start if m["called"] is None else m.start("called"), at))
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """Entities as (kind, start, end), leftmost first and not overlapping; a name's title is not part of it."""
    found = [("name", a, b) for a, b in _names(text)]
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        found += [(m.lastgroup, m.start(), m.end()) for m in NUMBERS.finditer(text) if m.lastgroup != "ipv6" or _ipv6(m[0])]
    rank, kept, at = list(PATTERNS), [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], rank.index(x[0]))):
        if start >= at:
            kept.append((kind, start, end))
            at = end
    return kept


def _with_mentions(text: str, entities: list[tuple[str, int, int]], words: set[str]) -> list[tuple[str, int, int]]:
    """The entities and, between them, every whole word of a name that the document has."""
    found, at = [], 0
    for entity in [*entities, ("", len(text), len(text))]:
        found += [("name", m.start(), m.end()) for m in WORD.finditer(text, at, entity[1]) if m[0] in words]
        at = entity[2]
        found.append(entity)
    return found[:-1]


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The text with surrogates, the entities found, and the spans of their surrogates in the new text."""
    entities = find(text)
    words = {w for kind, a, b in entities if kind == "name" for w in WORD.findall(text[a:b]) if w not in PARTICLES.split() and len(w) > 1}
    if words:
        entities = _with_mentions(text, entities, words | {w.upper() for w in words})
    parts, at, spans, size = [], 0, [], 0
    for kind, a, b in entities:
        new = surrogate(kind, text[a:b], key)
        parts += [text[at:a], new]
        size += a - at
        spans.append((size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*parts, text[at:]]), entities, spans


def secret(key: str | bytes) -> bytes:
    """The key that surrogates are made with."""
    if not key:
        raise ValueError("surrogates need a secret key")
    return hashlib.blake2b(key.encode() if isinstance(key, str) else key, digest_size=32).digest()


def session_key(spark: SparkSession) -> str | bytes:
    """The session's secret key, else one drawn for this call, with which surrogates differ from every other run's."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_bytes(32)


def replace_entities(docs: DataFrame, key: str | bytes, passing: list[str] | None = None) -> DataFrame:
    """Replace personal data in every whole text by surrogates.

    Returns one row per input row: doc_id, the ``passing`` columns, text (with
    surrogates), n_entities, entities (kind:start:end in the new text,
    comma-joined). Null text stays null and has no entities, an empty text stays
    empty; texts of any length are taken whole, a table without rows gives none.
    Equal entities get equal surrogates whatever row they are in, different ones
    different surrogates; repeated rows get equal results, null ids are ids like
    any other. Other columns are ignored.
    """
    passing = passing or []
    made_with = secret(key)

    def rows(batches):
        for batch in batches:
            texts, counts, spans = [], [], []
            for x in batch.column("text"):
                text = x.as_py()
                new, found, at = (None, [], []) if text is None else replace(text, made_with)
                texts.append(new)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for (k, _, _), (a, b) in zip(found, at, strict=True)))
            own = [batch.column(c) for c in ("doc_id", *passing)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", *passing, "text", "n_entities", "entities"])

    source = docs.select("doc_id", *passing, F.col("text").cast("string").alias("text"))
    kinds = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *passing)) + ", text string, n_entities long, entities string"
    return source.mapInArrow(rows, schema)


def entities(docs: DataFrame, key: str | bytes) -> DataFrame:
    """The distinct entities of a corpus as (kind, entity, surrogate); null and empty texts have none."""
    made_with = secret(key)

    def rows(batches):
        for batch in batches:
            seen = {(k, t[a:b]) for x in batch.column("text") if (t := x.as_py()) for k, a, b in replace(t, made_with)[1]}
            listed = [(k, e, surrogate(k, e, made_with)) for k, e in sorted(seen)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in listed], pa.string()) for i in range(3)], names=["kind", "entity", "surrogate"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "kind string, entity string, surrogate string").distinct()


def collisions(docs: DataFrame, key: str | bytes) -> DataFrame:
    """Surrogates that two different entities of a corpus share, and entities that stay: none, by construction."""
    found = entities(docs, key)
    twice = found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "surrogate")
    return twice.union(found.where("entity = surrogate").select("kind", "surrogate"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir), session_key(spark))
