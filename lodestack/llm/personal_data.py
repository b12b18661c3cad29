"""Problem 5: personal information inside free text.

Detection is by pattern and context; the names in use are learned from the corpus, starting from a list of given and family names:
a name-shaped word that stands beside a listed name, and seldom elsewhere, is a name of the other kind.

Method of replacement: surrogate generation. Every entity gets a keyed replacement of its own type that keeps script, case,
format and (for given names, by their ending) gender; the same entity gets the same surrogate in all texts, two
entities never share one, a person and the e-mail address made of the same names stay alike, and no surrogate equals an entity of the
text (the one that would is made anew). Typed placeholders, numbered per entity, are given beside it. An item is reported once it has its surrogate.

Defined results
* Null and empty texts hold nothing and stay as they are. Items do not span lines.
* Of overlapping items the earlier in the order email, phone, identity, address, person wins; within a kind the longer.
* Repeated rows of a sample report an item once; an empty name list finds no persons but those written as "X. Family" of learned
  names, thus none; empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut

KINDS = ("email", "phone", "identity", "address", "person")

# fixed values: patterns of the items -------------------------------------------------------------------------
_AT = r"(?:\s?@\s?|[ ]?[\[({]\s?at\s?[\])}][ ]?|[ ]at[ ])"
_DOT = r"(?:\.|[ ]?[\[({]\s?dot\s?[\])}][ ]?|[ ]dot[ ])"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
# an address is looked for at its sign: the local part backwards, the domain onwards
_SIGN = re.compile(_AT, re.I)
_SPELLED_SIGN = re.compile(r"[ ]?[\[({]\s?at\s?[\])}][ ]?|[ ]at[ ]", re.I)
_AROUND_SIGN = re.compile(r"\s?@\s?")
# where numbers, and so the items that begin with one or hold one, may begin
_RUN = re.compile(r"\d+")
_BEGIN = re.compile(r"[+(]|\d+")
_DOMAIN = re.compile(rf"(?:{_LABEL}{_DOT})+(?:[^\W\d_]{{2,}})(?![\w@])", re.I)
PHONE = re.compile(
    r"(?<![\w+/.,-])(?<!\d )(?:"
    r"(?:\+|00)\d{1,3}[ .]\(?\d{1,4}\)?(?:[ .-]?\d{2,8}){1,5}"  # +44 20 7946 0499, 0049 30 23125261
    r"|\+\d{9,14}"
    r"|(?:44|49|33|34)\d{9,11}"  # a country code without its plus
    r"|0\d{2,4}/\d{3,6}-\d{2,4}"  # 030/23125-949
    r"|0\d(?:[ .]\d\d){4}"  # 01 99 00 96 92
    r"|0\d\d \d{4} \d{4}|0\d{4} \d{6}|0\d\d \d{3} \d{3}"
    r"|\(\d{3}\) \d{3}-\d{4}|1-\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    r")(?![\w/]|-\d|\.\d|[ ]\d{3}\b(?![ ]\w))"
)
IDENTITY = re.compile(
    r"(?<![\w/.-])(?:[A-Z]{2}\d{7}|[A-Z]\d{8}(?: [A-Z]\b)?|[A-Z]{2} \d\d \d\d \d\d [A-Z]\b|\d{3}-\d\d-\d{4}|\d{4}-\d{4}-\d\d|\d{8}-\d{4}|\d\d \d{3} \d{3} \d{3}|\d{9,12}|\d{8}[A-Z]\b)(?![\w/-])"
)
_IDENTITY_WORDS = re.compile(
    r"(?:passport|passeport|pasaporte|reisepass|ausweis|identit|identid|identificador|\bid\b|-id\b|\btax (?:id|number|no)|steuer|fiscal|social|sozialvers|securite|seguridad|\bdni\b|\bnif\b|\bnie no)"
)
_OTHER_NUMBERS = re.compile(r"invoice|facture|factura|rechnung|ticket|aviso|vorgang|\brun\b|ejecucion|execution|lauf\b")
_NOT_PHONE = re.compile(r"(?:invoice|facture|factura|rechnung|ticket|aviso|vorgang)\W*$")
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w’'-]*"
_NUMBER = r"\d{1,4}(?:\s?[a-dA-D])?"
_EN_STREET = r"(?:Row|Road|Rd|Lane|Ln|Street|St|Close|Cl|Avenue|Ave|Terrace|Ter|Drive|Dr|Way|Court|Ct|Square|Sq|Place|Crescent|Cres|Hill|Gardens|Grove)"
_DE_STREET = r"(?:straße|strasse|str|gasse|allee|weg|platz|damm|ufer|ring|steig|chaussee)"
_FR_STREET = r"(?:rue|chemin|avenue|place|boulevard|impasse|allée|quai|route|cours|square|passage|sentier|ruelle)"
_ES_STREET = r"(?:calle|avenida|plaza|camino|paseo|ronda|carrera|callejón|travesía|c/|avda\.?|pza\.?)"
_FR_LINK = r"(?:(?:de la|de l[’']|des|du|de|d[’']|le|la|les|aux|au)\s?)*"
_ES_STREETS = ("calle", "avenida", "plaza", "camino", "paseo", "ronda", "carrera", "callejón", "travesía", "c/", "avda", "pza")
_ES_LINK = r"(?:(?:de las|de los|de la|del|de|la|los|las)\s)*"
_ADDRESSES = (
    re.compile(
        rf"(?<![\w.-])(?=\d)(?:{_NUMBER}(?:,)? (?:{_CAP} ){{1,3}}?{_EN_STREET}\b(?:\.(?=,| [a-z]))?"
        rf"|{_NUMBER}(?: ?(?:bis|ter|quater))?,? (?i:{_FR_STREET}) {_FR_LINK}{_CAP}(?: (?:(?:de|du|des|la|le)\s)*{_CAP})*)(?![\w-])"
    ),
    re.compile(rf"(?<![\w.-])(?i:{_ES_STREET}) {_ES_LINK}{_CAP}(?: (?:(?:de|del|la|los|las)\s)*{_CAP})*,? (?:(?i:n\.?\s?[º°o]\.?|núm\.?)\s?)?{_NUMBER}(?![\w-])"),
    # the street before a number is looked up backwards
    re.compile(rf" (?:Nr\. ?)?{_NUMBER}(?![\w-])"),
)
_STEM = re.compile(rf"(?<![\w.-])[^\W\d_]*(?i:{_DE_STREET})\.?$")


def _matches(pattern: re.Pattern, text: str, places: Iterable[int]) -> Iterator[re.Match]:
    """What ``finditer`` gives for a pattern that can only match at the given places, in ascending order."""
    done = 0
    for at in places:
        if at >= done and (m := pattern.match(text, at)):
            yield m
            done = m.end()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    yield from ((m.start(), m.end()) for m in _matches(_ADDRESSES[0], text, (m.start() for m in _RUN.finditer(text))))
    low = text.lower()
    if any(street in low for street in _ES_STREETS):
        for m in _ADDRESSES[1].finditer(text):
            yield m.span()
    for m in _ADDRESSES[2].finditer(text):
        if text[m.start() - 1 : m.start()].isalpha() or text[m.start() - 1 : m.start()] == ".":
            # from the character before the letters on, which may be none of a word
            start = m.start() - (text[m.start() - 1] == ".")
            while start and text[start - 1].isalnum() and not text[start - 1].isdecimal():
                start -= 1
            if stem := _STEM.search(text[max(0, start - 1) : m.start()]):
                yield m.start() - len(stem.group()), m.end()


_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_NAME = r"[^\W\d_]{2,}(?:[’'-][^\W\d_]+)*"
_INITIAL = r"[^\W\d_]\."
PERSON = re.compile(
    rf"(?<![\w@.+-])(?=[^\W\d_])(?:(?P<g>{_NAME}) (?:{_INITIAL} ?){{0,2}}(?P<f>{_NAME})|(?P<i>{_INITIAL}) ?(?:{_INITIAL} ?){{0,2}}(?P<fi>{_NAME})"
    rf"|(?P<fc>{_NAME}), (?P<gc>{_NAME}(?: {_INITIAL})?|{_INITIAL}))(?![\w@])"
)
# -------------------------------------------------------------------------------------------------------------

LEAST_PAIRS = 2
LEAST_SHARE = 0.3
#: learned names sent to every executor (some 100 bytes each there); of more, each text gets its own by joins
SENT_NAMES = 200_000


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


class Names:
    """Given and family names, in lower case."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family


def _shaped(word: str) -> bool:
    return len(word) > 3 and word[0].isupper() and (word[1:].islower() or word.isupper())


def _name_words(text: str, names: Names) -> list[re.Match]:
    """The words of a text that are names of either kind."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        return [m for m in _WORD.finditer(text) if (w := m.group().lower()) in names.given or w in names.family]
    # no word spans white space, and most of what it separates is one
    tokens = set(low.split())
    tokens.update(*(_WORD.findall(t) for t in tokens if not t.isalpha()))
    present = (tokens & names.given) | (tokens & names.family)
    found = []
    for name in present:
        at = low.find(name)
        while at >= 0:
            m = _WORD.match(text, at)
            if m.end() - at == len(name) and not (at and (text[at - 1].isalpha() or text[at - 1] in "’'-" and at > 1 and text[at - 2].isalpha())):
                found.append(m)
            at = low.find(name, at + 1)
    return sorted(found, key=re.Match.start)


_BEFORE = re.compile(rf"(?<![\w@.+-])(?P<word>{_NAME})(?P<gap> (?:{_INITIAL} ?){{0,2}})$")
_AFTER = re.compile(rf" (?:{_INITIAL} ?){{0,2}}(?P<word>{_NAME})(?![\w@])")
_INITIALS = re.compile(rf"(?<![\w@.+-])(?:{_INITIAL} ?){{1,3}}$")


def beside_names(text: str, names: Names) -> Iterator[tuple[str, str]]:
    """(word, kind) for name-shaped words that stand, given name first, beside a listed name of the other kind."""
    for m in _name_words(text, names):
        word = m.group().lower()
        if word in names.given and (n := _AFTER.match(text, m.end())):
            if n["word"].lower() not in names.family and _shaped(n["word"]):
                yield n["word"].lower(), "family"
        if word in names.family and (n := _BEFORE.search(text[max(0, m.start() - 40) : m.start()])):
            if n["word"].lower() not in names.given and _shaped(n["word"]):
                yield n["word"].lower(), "given"


def learn_names(texts: DataFrame, names: DataFrame) -> tuple[Names, DataFrame]:
    """The listed names, and (word, kind) of those learned from all texts.

    A word is learned if it stands beside a listed name of the other kind at least ``LEAST_PAIRS`` times, and that in at least ``LEAST_SHARE`` of
    its occurrences in any case. The list of names is a fixed table and is held by the driver; what is learned from the texts is not.
    """
    listed = Names(set(), set())
    for row in names.where("name is not null").select("name", "kind").toLocalIterator():
        if row.kind in ("given", "family"):
            getattr(listed, row.kind).add(row.name.strip().lower())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, tokens, total = Counter(), Counter(), Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    pairs.update(beside_names(text, listed))
                    tokens.update(text.lower().split())
            for token, n in tokens.items():
                for word in [token] if token.isalpha() else _WORD.findall(token):
                    total[word] += n
            keys = [(w, k) for w, k in pairs] + [(w, "") for w in total]
            counts = list(pairs.values()) + list(total.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.string()), pa.array(counts, pa.int64())], ["word", "kind", "n"]
            )

    counted = texts.select("text").mapInArrow(count, "word string, kind string, n bigint")
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    words = counted.groupBy("word").agg(n("given").alias("given"), n("family").alias("family"), n("").alias("total"))
    learned = words.where((F.greatest("given", "family") >= LEAST_PAIRS) & (F.greatest("given", "family") >= LEAST_SHARE * F.col("total")))
    return listed, cut(learned.select("word", F.when(F.col("given") >= F.col("family"), "given").otherwise("family").alias("kind")))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    signs = list(_AROUND_SIGN.finditer(text)) if "@" in text else []
    if " at " in (low := text.lower()) or "at" in low and any(c in text for c in "[({"):
        signs = sorted([*signs, *_SPELLED_SIGN.finditer(text)], key=re.Match.start)
    for m in signs:
        domain = _DOMAIN.match(text, m.end())
        if domain is None:
            continue
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        local = start < m.start() and text[start].isalnum()
        # a bare "at" makes an address only where its dots are written out too, or the domain ends like one
        if local and ("@" in m.group() or m.group().strip()[0] in "[({" or re.search(r"(?i)[\[({ ]dot[\])} ]|\.[a-z]{2,}$", domain.group())):
            yield start, domain.end()


def detect(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all items, in text order, not overlapping."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))

    def take(start: int, end: int, kind: str) -> None:
        if not any(used[start:end]):
            used[start:end] = b"\1" * (end - start)
            taken.append((start, end, kind))

    for start, end in _emails(text):
        take(start, end, "email")
    for m in _matches(PHONE, text, (m.start() for m in _BEGIN.finditer(text))):
        if not _NOT_PHONE.search(_before(text, m.start())):
            take(m.start(), m.end(), "phone")
    # a number may have up to two letters and a blank before its digits
    for m in _matches(IDENTITY, text, sorted({p for m in _RUN.finditer(text) for p in range(max(0, m.start() - 3), m.start() + 1)})):
        before = _before(text, m.start())
        label = [x.end() for x in _IDENTITY_WORDS.finditer(before)]
        other = [x.end() for x in _OTHER_NUMBERS.finditer(before)]
        if label and (not other or other[-1] < label[-1]) and not re.search(r"[.;!?]\s+\w{3,}|\d", before[label[-1] :]):
            take(m.start(), m.end(), "identity")
    for start, end in _addresses(text):
        take(start, end, "address")
    done = 0
    for word in _name_words(text, names):
        if word.start() < done:
            continue
        # a person begins with one of the names, or with the initials before it
        start = word.start()
        if word.group().lower() in names.family and (before := _INITIALS.search(text[max(0, start - 9) : start])):
            start -= before.end() - before.start()
        m = PERSON.match(text, start)
        if m is None:
            continue
        if m["g"]:
            g, f = m["g"].lower(), m["f"].lower()
            known = g in names.given and f in names.family or g in names.family and f in names.given
        elif m["i"]:
            known = m["fi"].lower() in names.family
        else:
            known = m["fc"].lower() in names.family and (m["gc"].endswith(".") and len(m["gc"]) == 2 or m["gc"].split(" ")[0].lower() in names.given)
        if known:
            take(m.start(), m.end(), "person")
            done = m.end()
    return sorted(taken)


def _before(text: str, at: int) -> str:
    """The folded 40 characters before a place, without line breaks and the quote marks after them."""
    return fold(re.sub(r"\s*\n(?:[>|: ]|[A-ZÀ-Ý]{2}>)*", " ", text[max(0, at - 48) : at]))[-40:]


# surrogates ---------------------------------------------------------------------------------------------------

# fixed values: letters of made words, spellings of letters beyond a-z, and the letters of other scripts as ranges
_CONSONANTS, _VOWELS = "bdfghjklmnprstvz", "aeiou"
_SPELLED = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x915, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_KEPT_LABELS = ("example", "test", "invalid", "localhost")
_STREET_WORD = re.compile(rf"(?i)^(?:{_EN_STREET}|{_FR_STREET}|{_ES_STREET}|bis|ter|quater|de|du|des|la|le|les|del|los|las|n|nr|núm)$")
_STREET_END = re.compile(rf"(?i){_DE_STREET}$")

#: salts tried for an entity before its replacement is lengthened
SALTS = 16


def _shift(key: bytes, salt: int, kind: str, before: str) -> int:
    data = f"{salt}\0{kind}\0{before}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=8).digest())


@functools.lru_cache(maxsize=100_000)
def _made_word(key: bytes, word: str, salt: int) -> str:
    """A word's replacement: two letters become three that can be spoken, letters of other scripts move within their script."""
    low = fold(word).translate(_SPELLED)
    # the gender of a given name shows in its ending
    ending = low[-1] if len(low) > 2 and low[-1] in "aeo" else ""
    body, out, at = low[: len(low) - len(ending)], "", 0
    while at < len(body):
        a, b = body[at], body[at + 1 : at + 2]
        if "a" <= a <= "z":
            if "a" <= b <= "z":
                n = (ord(a) - 97) * 26 + ord(b) - 97 + _shift(key, salt, "pair", body[:at]) % 1280
                out += _CONSONANTS[n // 80 % 16] + _VOWELS[n // 16 % 5] + _CONSONANTS[n % 16]
                at += 2
                continue
            n = ord(a) - 97 + _shift(key, salt, "one", body[:at]) % 80
            out += _CONSONANTS[n // 5 % 16] + _VOWELS[n % 5]
        else:
            first, last = next((r for r in _SCRIPTS if r[0] <= ord(a) <= r[1]), (ord(a), ord(a)))
            out += chr(first + (ord(a) - first + _shift(key, salt, "script", body[:at])) % (last - first + 1))
        at += 1
    out += ending
    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize() if word[:1].isupper() else out


class Surrogates:
    """Keyed replacements of the entities of one text.

    A digit, a letter or two letters of a word are shifted within their alphabet by an amount that the key and what was read before them
    decide. Reading back is possible symbol by symbol, so two entities never get one replacement, in whatever texts they stand, and an entity gets
    the same in all. Words map alike in persons and in e-mail addresses. What was shifted onto an entity of the same text is shifted
    again by another salt, and lengthened after ``SALTS`` of them.
    """

    def __init__(self, key: bytes, items: list[tuple[str, str]]) -> None:
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key if len(key) <= 64 else hashlib.sha256(key).digest()
        self.made: dict[tuple[str, str], str] = {}
        self.used: dict[str, tuple[str, str] | None] = {fold(item): None for _, item in items}
        # the given name behind an initial, where the text has both with one family name
        self.initials: dict[tuple[str, str], str] = {}
        for kind, item in items:
            words = [fold(w) for w in _WORD.findall(item)] if kind == "person" else []
            for w in words:
                for other in words:
                    if len(w) > 1 and other is not w:
                        self.initials.setdefault((w[0], other), w)

    def _shift(self, salt: int, kind: str, before: str, size: int) -> int:
        return _shift(self.key, salt, kind, before) % size

    def of(self, kind: str, item: str) -> str:
        """The replacement of an item: never an entity of the text, never that of another entity."""
        if (kind, item) not in self.made:
            entity, salt = (kind, _entity(kind, item)), 0
            while True:
                new = getattr(self, f"_{kind}")(item, salt)
                if salt >= SALTS:  # nothing of its own length is free
                    digits = list(re.finditer(r"\d+", new))
                    new = new[: digits[-1].end()] + str(salt) + new[digits[-1].end() :] if digits else new + "-" + self._word(chr(97 + salt % 26) * (salt // 26 + 2), salt)
                if self.used.get(fold(new), entity) == entity and fold(new) != fold(item):
                    break
                salt += 1
            self.made[kind, item] = new
            self.used[fold(new)] = entity
        return self.made[kind, item]

    def _word(self, word: str, salt: int) -> str:
        return _made_word(self.key, word, salt)

    def _initial(self, letter: str, family: list[str], salt: int) -> str:
        low = fold(letter)
        given = next((self.initials[low, f] for f in family if (low, f) in self.initials), None)
        new = self._word(given, salt)[0] if given else self._word(low * 2, salt)[0]
        return new.upper() if letter.isupper() else new

    def _digits(self, item: str, kind: str, salt: int, keep: int = 0, letters: bool = False) -> str:
        """Digits after the first ``keep`` shifted, each by those to its right; with ``letters`` those too."""
        seen, out, right = sum(c.isdecimal() for c in item), [], ""
        for c in reversed(item):
            digit = c.isdecimal() and c.isascii()
            if c.isdecimal():
                seen -= 1
            if digit and seen >= keep:
                out.append(str((int(c) + self._shift(salt, kind, right, 10)) % 10))
                right += c
            elif letters and c.isalpha() and c.isascii():
                base = 65 if c.isupper() else 97
                out.append(chr(base + (ord(c) - base + self._shift(salt, kind, right, 26)) % 26))
                right += c
            else:
                out.append(c)
        return "".join(reversed(out))

    def _phone(self, item: str, salt: int) -> str:
        # the country code or the zero before the number stays; one number in national and international form keeps its tail
        head = re.match(r"\+(\d{1,3})[ .]|\+(\d\d)|(00\d{1,3})[ .]|(00\d\d)|(0|1-)|(44|49|33|34)(?=\d{9})", item)
        return self._digits(item, "phone", salt, sum(c.isdecimal() for c in head.group()) if head else 0)

    def _identity(self, item: str, salt: int) -> str:
        return self._digits(item, "identity", salt, 0, True)

    def _email(self, item: str, salt: int) -> str:
        sign = next(m for m in _SIGN.finditer(item) if _DOMAIN.match(item, m.end()))
        local, domain = item[: sign.start()], item[sign.end() :]
        labels = list(_WORD.finditer(domain))
        names = [fold(w) for w in _WORD.findall(local)]

        def swap(m: re.Match) -> str:
            return self._initial(m.group(), names, salt) if len(m.group()) == 1 else self._word(m.group(), salt)

        def label(m: re.Match) -> str:
            w = m.group()
            return w if m.start() == labels[-1].start() or w.lower() == "dot" or w.lower() in _KEPT_LABELS else self._word(w, salt)

        made = self._digits(_WORD.sub(swap, local), "local", salt)
        return made + sign.group() + _WORD.sub(label, domain)

    def _address(self, item: str, salt: int) -> str:
        def swap(m: re.Match) -> str:
            w = m.group()
            if _STREET_WORD.match(w) or len(w) < 3:
                return w
            if tail := _STREET_END.search(w):
                return self._word(w[: tail.start()] or "Neue", salt) + tail.group()
            return self._word(w, salt)

        def number(m: re.Match) -> str:
            first = (int(m.group()[0]) - 1 + self._shift(salt, "house", m.group()[1:], 9)) % 9 + 1 if m.group()[0] != "0" else 0
            return str(first) + self._digits(m.group()[1:], "house", salt)

        return re.sub(r"[0-9]+", number, _WORD.sub(swap, item))

    def _person(self, item: str, salt: int) -> str:
        names = [fold(w) for w in _WORD.findall(item) if len(w) > 1]
        return _WORD.sub(lambda m: self._initial(m.group(), names, salt) if len(m.group()) == 1 else self._word(m.group(), salt), item)


def _entity(kind: str, item: str) -> str:
    """What two spellings of one entity have in common."""
    if kind in ("phone", "identity"):
        return re.sub(r"[^0-9a-z]", "", fold(item)).removeprefix("00" if kind == "phone" else "")
    if kind == "person":
        return " ".join(sorted(fold(w) for w in _WORD.findall(item) if len(w) > 1))
    return re.sub(r"\W+", " ", fold(item))


def replaced(text: str | None, items: list[tuple[int, int, str]], key: bytes) -> tuple[str | None, str | None]:
    """The text with surrogates, and with typed placeholders numbered per entity, for its items."""
    if not text or not items:
        return text, text
    surrogates = Surrogates(key, [(kind, text[a:b]) for a, b, kind in items])
    numbers: dict[str, dict[str, int]] = {}
    one, two, at = [], [], 0
    for a, b, kind in items:
        known = numbers.setdefault(kind, {})
        number = known.setdefault(_entity(kind, text[a:b]), len(known) + 1)
        one += [text[at:a], surrogates.of(kind, text[a:b])]
        two += [text[at:a], f"[{kind.upper()}_{number}]"]
        at = b
    return "".join(one) + text[at:], "".join(two) + text[at:]


def _samples(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.col("text").cast("string").alias("text")).where("sample_id is not null")


def _with_names(rows: DataFrame, names: DataFrame, bound: int, run: Callable[[str | None, Names], list[tuple]], schema: str) -> DataFrame:
    """``run`` over all texts of (sample_id, text) with the names in use: each of its rows behind the sample_id.

    Up to ``bound`` learned names, as counted, are sent to every executor. If there are more, each text gets those of its own words by joins on the words.
    """
    listed, learned = learn_names(rows, names)
    kinds = [pa.int64(), *({"string": pa.string(), "bigint": pa.int64()}[c.split(" ")[1]] for c in schema.split(", "))]
    columns = ["sample_id", *(c.split(" ")[0] for c in schema.split(", "))]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in made], kind) for n, kind in enumerate(kinds)], columns)

    if learned.count() <= bound:
        for row in learned.toLocalIterator():
            getattr(listed, row.kind).add(row.word)
        held = rows.sparkSession.sparkContext.broadcast(listed)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch_of([(i, *out) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for out in run(t, held.value)])

        return rows.mapInArrow(whole, f"sample_id bigint, {schema}")

    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+(?:[’'-][\p{L}]+)*)"), F.lit(1))))
    texts = cut(rows.withColumn("t", F.xxhash64("text")))
    used = texts.where("text is not null").select("sample_id", "t", words.alias("word")).join(learned, "word")
    own = used.groupBy("sample_id", "t").agg(F.collect_set(F.struct("kind", "word")).alias("own"))
    held = rows.sparkSession.sparkContext.broadcast(listed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, t, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                mine = Names(held.value.given | {x["word"] for x in own or [] if x["kind"] == "given"}, held.value.family | {x["word"] for x in own or [] if x["kind"] == "family"}) if own else held.value
                made += [(i, *out) for out in run(t, mine)]
            yield batch_of(made)

    return texts.join(own, ["sample_id", "t"], "left").select("sample_id", "text", "own").mapInArrow(each, f"sample_id bigint, {schema}")


def entities(samples: DataFrame, names: DataFrame, key: bytes, bound: int = SENT_NAMES) -> DataFrame:
    """(sample_id, kind, found, surrogate): each distinct item of each sample's texts, and what replaces it."""

    def run(text: str | None, known: Names) -> list[tuple]:
        items = list(dict.fromkeys((kind, text[a:b]) for a, b, kind in detect(text, known)))
        surrogates = Surrogates(key, items)
        return [(kind, item, surrogates.of(kind, item)) for kind, item in items]

    return _with_names(_samples(samples), names, bound, run, "kind string, found string, surrogate string")


def found(samples: DataFrame, names: DataFrame, key: bytes, bound: int = SENT_NAMES) -> DataFrame:
    """(sample_id, kind, found): each distinct item of each sample's texts that has been given a surrogate."""
    return entities(samples, names, key, bound).where("surrogate <> found").select("sample_id", "kind", "found").distinct()


def redacted(samples: DataFrame, names: DataFrame, key: bytes, bound: int = SENT_NAMES) -> DataFrame:
    """(sample_id, text, placeholders, items): every row's text with surrogates and with typed placeholders, and how many items were replaced."""

    def run(text: str | None, known: Names) -> list[tuple]:
        items = detect(text, known)
        return [(*replaced(text, items, key), len(items))]

    return _with_names(_samples(samples), names, bound, run, "text string, placeholders string, items bigint")
