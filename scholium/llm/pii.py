"""Surrogates for personal data: keyed, consistent for each entity, of the same type, gender, script and format.

Numbers, addresses and secrets: all values of one format (the same kinds of characters at the same places) are a
finite space, and a keyed permutation of that space without fixed points gives each its stand-in. So no two entities
share one, none keeps its own, and nothing has to be looked up; a space that is used up by entities is permuted all
the same. Card numbers and IBANs get check digits of the same validity, private IPv4 addresses stay in their block.

Names: given names by gender and script, and family names by script, have stand-ins of their own, so "Mr. John Smith"
and "Mr. Smith" stay one person. A collision check over all names of the texts moves those whose stand-in belongs to
another name, or is itself a name of the texts, to the next attempt; attempts append letters, one more each time, so
the spaces never run out and the check ends. The stand-ins of attempt 0 are a few hundred for each kind, so of many names
most are moved; the list of these goes to the texts: it is broadcast where it is short, and joined to the documents else.
In a document, names that a title introduces are also replaced where they stand without a title.

Kinds: e-mail, IPv4 and IPv6 addresses, telephone, card and IBAN numbers, social security numbers, secrets (long hex,
what is given for a token, secret, password or key, tokens of known forms, long tokens of much entropy), dates of birth
(behind words that say so), street addresses, and persons (titles of address with up to three names, initials and
particles). Names that no title introduces are not found.

Defined cases: null text stays null, without entities; empty texts stay. Repeated rows each give a row. Columns that
carry an output's name are replaced, all others are kept. Long texts are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import secrets
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, with_arrow_columns

#: The session's setting with the key; where it is absent, each run draws its own.
KEY_SETTING = "spark.scholium.pii.key"
#: Names moved by the collision check whose list is broadcast; 100 bytes each are 20 MB.
MAX_BROADCAST = 200_000


def key_of(spark: SparkSession) -> bytes:
    """The session's key. Surrogates are the same in two runs only if both have one key."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else secrets.token_bytes(32)


# permutations ---------------------------------------------------------------------------------------------------------


def _number(key: bytes, tag: str, size: int) -> int:
    """A keyed number of `size` bits."""
    raw = hashlib.shake_256(len(key).to_bytes(4, "big") + key + tag.encode("utf-8", "surrogatepass")).digest(-(-size // 8) + 1)
    return int.from_bytes(raw, "big") & ((1 << size) - 1)


def _feistel(x: int, half: int, key: bytes, tag: str, back: bool) -> int:
    """A permutation of 2 * half bits, or its inverse."""
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for r in range(4)[:: -1 if back else 1]:
        if back:
            left, right = right ^ _number(key, f"{tag}|{r}|{left:x}", half), left
        else:
            left, right = right, left ^ _number(key, f"{tag}|{r}|{right:x}", half)
    return left << half | right


@lru_cache(65_536)
def permuted(x: int, size: int, key: bytes, tag: str) -> int:
    """A keyed permutation of 0 to size - 1 without fixed points, where there are two numbers or more: a turn of the
    circle of all numbers in a keyed order."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2 or 1

    def walk(y: int, back: bool) -> int:
        y = _feistel(y, half, key, tag, back)
        while y >= size:  # what leaves the space goes on until it is back
            y = _feistel(y, half, key, tag, back)
        return y

    return walk((walk(x, False) + 1 + _number(key, f"{tag}|turn", 64) % (size - 1)) % size, True)


#: Blocks of characters that stand for one another: first code point and how many.
BLOCKS = [(0x61, 26), (0x41, 26), (0x30, 10), (0x430, 32), (0x410, 32), (0x3B1, 17), (0x391, 17), (0xF8, 7), (0xE0, 23), (0xD8, 7), (0xC0, 23), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x660, 10), (0x6F0, 10), (0x966, 10), (0x3041, 86), (0x30A1, 86), (0xAC00, 11172), (0x4E00, 20992), (0x3400, 6592)]
#: Characters of a value that are permuted as one number; those after are added to a keyed sequence that the first determine.
HEAD = 64


@lru_cache(4096)
def _block(c: str) -> tuple[int, int] | None:
    at = ord(c)
    return next(((first, n) for first, n in BLOCKS if first <= at < first + n), None) or ((at - int(c), 10) if c.isdecimal() else None)


def reshaped(value: str, key: bytes, tag: str, fixed: int = 0) -> str:
    """Another value of the same format: each character of a block by one of its block, the others and the first
    `fixed` ones as they are. Two values of a format never get the same. Without such characters: a keyed token."""
    places = [(k, b) for k, c in enumerate(value) if k >= fixed and (b := _block(c))]
    if not places:
        return f"x{_number(key, f'{tag}|{value}', 80):020x}"
    shape = f"{tag}|{value[:fixed]}|" + "".join(chr(b[0]) if (b := _block(c)) and k >= fixed else c for k, c in enumerate(value))
    out, rest = list(value), places[HEAD:]
    if rest:  # first what follows, by the head as it was; then the head, by what follows now
        head = "".join(value[k] for k, _ in places[:HEAD])
        stream = hashlib.shake_256(key + f"{shape}|{head}".encode("utf-8", "surrogatepass")).digest(4 * len(rest))
        for j, (k, (first, n)) in enumerate(rest):
            out[k] = chr(first + (ord(value[k]) - first + int.from_bytes(stream[4 * j : 4 * j + 4], "big")) % n)
        shape += hashlib.sha256("".join(out[k] for k, _ in rest).encode("utf-8", "surrogatepass")).hexdigest()
    number = 0
    for k, (first, n) in places[:HEAD]:
        number = number * n + ord(value[k]) - first
    number = permuted(number, math.prod(n for _, (_, n) in places[:HEAD]), key, shape)
    for k, (first, n) in reversed(places[:HEAD]):
        number, digit = divmod(number, n)
        out[k] = chr(first + digit)
    return "".join(out)


# what is found --------------------------------------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles of address with the gender they tell; "n" tells none.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f"}
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]+"
_TITLE = rf"(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?"
_INITIAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]\.(?:-?[A-ZÀ-ÖØ-ÞА-ЯЁ]\.)*"
#: Fixed value: what stands between given and family names.
PARTICLES = "van von der den de del della di da du la le ten ter zu zur af av bin al dos das".split()
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})"
#: Titles, then two given names or initials at most, particles, and a family name.
PERSON = re.compile(rf"(?<!\w){_TITLE}(?: {_TITLE})*(?: (?:{_INITIAL}|{_NAME}(?!\w))){{0,2}}(?: {_PARTICLE}){{0,3}} {_NAME}")
_TITLED = re.compile(rf"(?:{_TITLE} )+")
DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
_LOCAL = re.compile(r"[\w.%+-]").match
HEX = re.compile(r"\b[0-9a-fA-F]{32,}\b")
#: What is given for a secret's name: in quotes, or bare with a digit in it.
KEYED = re.compile(
    r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']?\s?[:=]\s?"
    r"(?:\"(?P<double>[^\s\"]{8,})|'(?P<single>[^\s']{8,})|(?P<bare>(?=[^\s\"',;]*\d)[^\s\"',;]{8,}))",
    re.IGNORECASE,
)
KEYED_CUES = ("oken", "ecret", "assw", "pwd", "key", "OKEN", "ECRET", "ASSW", "PWD", "KEY", "Key", "Pwd")
#: Tokens of known forms, and long ones of all kinds of characters.
ISSUED = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|[sp]k[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|xox[abps]-[A-Za-z0-9-]{10,})\b")
LONG = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![\w+/=-])")
#: Bits for each character from which a long token is no word.
ENTROPY = 4.0
#: Where numbers can be, and the numbers.
RUN = re.compile(r"[\d(+][\d .()+-]{6,}")
NUMBER = re.compile(
    rf"(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})|\(\d{2,4}\))(?:[ .-]?\d{2,4}){2,4}(?!\d|\.\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,:/-])0\d{2,4}[ -]\d{5,9}(?![\w-]))"
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_MONTHS = "january february march april may june july august september october november december januar februar märz april mai juni juli august september oktober november dezember janvier février mars avril mai juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
_MONTH = "|".join(sorted(set(_MONTHS), key=len, reverse=True))
#: What must stand before a date of birth.
BORN_CUES = ("born", "birth", "geboren", "Geburtsdatum", "geb.", " né", "naissance", "nacid", "nacimiento", "DOB")
BORN = re.compile(
    r"(?:\bborn(?: on)?|\bdate of birth|\bDOB|\bgeboren(?: am)?|\bGeburtsdatum|\bgeb\.|\bnée?(?: le)?|\bdate de naissance|\bnacid[oa](?: el)?|\bfecha de nacimiento)[:,]? "
    rf"(?P<date>\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{1,2}}\.? (?:de )?(?:{_MONTH}) (?:de )?\d{{4}}|(?:{_MONTH}) \d{{1,2}}, \d{{4}})(?!\d)",
    re.IGNORECASE,
)
STREET_CUES = (" Street", " St.", " Avenue", " Ave", " Road", " Rd", " Lane", " Drive", " Boulevard", "straße ", "strasse ", "str. ", "platz ", "allee ", " rue ", " avenue ", "Calle ", "Avenida ", "Paseo ", "Plaza ")
STREET = re.compile(
    r"(?<!\w)(?:\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|St\.|Ave\.|Rd\.)|[A-ZÄÖÜ][\w-]{0,60}(?:straße|strasse|str\.|platz|allee) \d{1,4}[a-z]?"
    r"|\d{1,4},? (?:rue|avenue|boulevard) (?:de la |de |du |des |d['’])?[A-ZÀ-Þ]\w+(?: [A-ZÀ-Þ]\w+)?|(?:Calle|Avenida|Paseo|Plaza) (?:de la |de los |de |del )?[A-ZÀ-Þ]\w+(?: [A-ZÀ-Þ]\w+)?,? \d{1,4})(?!\w)"
)
STREET_WORDS = re.compile(r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|St\.|Ave\.|Rd\.|straße|strasse|str\.|platz|allee|\brue\b|\bavenue\b|\bboulevard\b|Calle|Avenida|Paseo|Plaza|\bde la\b|\bde los\b|\bdel?\b|\bdu\b|\bdes\b|\bd['’])")


def luhn(digits: str) -> int:
    """0 for a valid card number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10


def iban_rest(value: str) -> int:
    """1 for a valid IBAN."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _is_ipv6(text: str) -> bool:
    try:
        return ("::" in text or text.count(":") == 7) and len(text) > 4 and ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    if re.search(r"\d", text):
        if re.search(r"[A-Z]{2}\d{2}", text):
            found += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if m[0].isascii() and iban_rest(m[0].replace(" ", "")) == 1]
        if any(c in text for c in BORN_CUES):
            found += [(*m.span("date"), "birth") for m in BORN.finditer(text) if _date(m["date"])]
        if any(c in text for c in STREET_CUES):
            found += [(m.start(), m.end(), "street") for m in STREET.finditer(text)]
        for run in RUN.finditer(text):
            found += [(m.start(), m.end(), m.lastgroup) for m in NUMBER.finditer(text, run.start(), min(run.end() + 2, len(text)))]
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start and _LOCAL(text[start - 1]):
            start -= 1
        if start < m.start():
            found.append((start, m.end(), "email"))
    found += [(a, b, "secret") for a, b in secrets_in(text)]
    if "::" in text or re.search("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", text):
        found += [(m.start(), m.end(), "ipv6") for m in IPV6.finditer(text) if _is_ipv6(m[0])]
    found += [(m.start(), m.start() + len(m[0].removesuffix("'s").removesuffix("’s")), "person") for m in persons(text)]
    if not found:
        return []
    order = {k: n for n, k in enumerate(("email", "secret", "iban", "ipv6", "birth", "street", "ip", "ssn", "card", "phone", "person"))}
    covered, taken = bytearray(len(text)), []
    for a, b, kind in [*sorted(found, key=lambda x: (order[x[2]], x[0])), *_untitled(text, found)]:  # what is told more surely goes first
        if not any(covered[a:b]):
            covered[a:b] = b"\1" * (b - a)
            taken.append((a, b, kind))
    return sorted(taken)


def secrets_in(text: str) -> list[tuple[int, int]]:
    """Spans of hexadecimal numbers, what is given for a secret's name, issued tokens, and long tokens of much entropy."""
    found = []
    if any(c in text for c in KEYED_CUES):
        found += [m.span(m.lastgroup) for m in KEYED.finditer(text)]
    if "_" in text or "-" in text or "AKIA" in text:
        found += [m.span() for m in ISSUED.finditer(text)]
    for m in LONG.finditer(text):
        if HEX.fullmatch(m[0]) or (re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and _entropy(m[0]) >= ENTROPY):
            found.append(m.span())
    return found + [m.span() for m in HEX.finditer(text)]


def _entropy(text: str) -> float:
    """Bits for each character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def persons(text: str) -> list[re.Match]:
    return list(PERSON.finditer(text)) if any(t in text for t in TITLES) else []


def _untitled(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Mentions of the persons' names without a title."""
    words = {without_titles(text[a:b])[1] for a, b, kind in found if kind == "person"}
    words |= {w.rpartition(" ")[2] for w in words}
    known = sorted(words | {w.upper() for w in words if len(w) > 3}, key=lambda w: (-len(w), w))
    return [(m.start(), m.end(), "name") for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, known))})(?!\w)", text)] if known else []


# names ----------------------------------------------------------------------------------------------------------------

#: Given names by script and gender ("n": of either), and beginnings and ends of family names.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karel Leon Marco Nils Oscar Paul Quentin Robert Simon Thomas Urban Victor Walter Xaver Yannick Zeno John".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Quirina Rosa Sofia Teresa Ursula Vera Wanda Xenia Yvonne Zora".split(),
    ("latin", "n"): "Alex Andrea Chris Dominique Eden Francis Jamie Jordan Kai Kim Kerry Leslie Lou Maxime Morgan Noa Robin Sasha Sidney Toni".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура".split(),
}
BEGINNINGS = {"latin": "Abel Brand Castel Dorn Eber Fark Grim Holm Ibsen Jan Kel Lind Mor Nov Ort Pint Quist Ren Ser Tor Ulr Vid Web Xim Young Zim".split(), "cyrillic": "Авде Бой Влас Гонч Доро Ерма Жук Зайч Крав Лис Моро Наза Остап Пань Роман".split()}
ENDS = {"latin": "a berg dahl ek er feld gren ham ier kamp lund man o rath sen son ström thal vik wood y".split(), "cyrillic": "енко ук як ко".split(), "inflected": "ов ев ин".split()}
INFLECTED = re.compile(r"(?:[оеё]в|ин|ын)$")
_GENDER_OF = {name: gender for gender in "mf" for script in ("latin", "cyrillic") for name in GIVEN[(script, gender)]}


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def _plain(name: str) -> str:
    """A name, of one or two words, as it is written when it is not in capitals."""
    return " ".join(w.capitalize() if len(w) > 1 and w.isupper() else w for w in name.split(" "))


def family_of(word: str, gender: str) -> tuple[str, str]:
    """(kind, family name), without the ending of a woman's name."""
    word = _plain(word)
    script = script_of(word)
    base = word[:-1] if script == "cyrillic" and gender == "f" and word.endswith("а") and INFLECTED.search(word[:-1]) else word
    return f"family {'inflected' if script == 'cyrillic' and INFLECTED.search(base) else script}", base


def without_titles(mention: str) -> tuple[str, str, str]:
    """(titles with the space behind them, names, the gender that the titles tell) of a mention."""
    m = _TITLED.match(mention)
    titles = m[0] if m else ""
    told = [g for t in titles.split() if (g := TITLES[t.rstrip(".")]) != "n"]
    return titles, mention[len(titles) :], told[0] if told else "n"


def parts_of(mention: str, genders: dict[str, str]) -> tuple[str, list[tuple[str, str, str]]]:
    """(what stands before the names, for each of their words its kind, value and the word as it stands) of a mention of a
    person. Kinds: given and family names, "initial", and "particle", which stays.

    genders: of full names that a title tells elsewhere in the document."""
    titles, names, gender = without_titles(mention)
    words = names.split(" ")
    if gender == "n":
        gender = genders.get(_plain(names), genders.get(_plain(words[-1]), _GENDER_OF.get(_plain(words[0]), "n") if len(words) > 1 else "n"))
    kind = lambda w: "particle" if w in PARTICLES else "initial" if w.endswith(".") else f"given {gender} {script_of(w)}"
    return titles, [*((kind(w), _plain(w), w) for w in words[:-1]), (*family_of(words[-1], gender), words[-1])]


def genders_in(text: str, spans: list[tuple[int, int, str]]) -> dict[str, str]:
    """The gender that titles tell of full and family names."""
    out: dict[str, str] = {}
    for a, b, kind in spans:
        _, names, gender = without_titles(text[a:b])
        if kind == "person" and gender != "n":
            out.setdefault(_plain(names), gender)
            out.setdefault(_plain(names.split(" ")[-1]), gender)
    return out


def name_for(kind: str, value: str, attempt: int, key: bytes) -> str:
    """A name's stand-in; family names of women get their ending when they are written."""
    what, _, group = kind.partition(" ")
    drawn = _number(key, f"{kind}|{attempt}|{value}", 128)
    if what == "given":
        gender, _, script = group.partition(" ")
        name = GIVEN[(script, gender)][drawn % len(GIVEN[(script, gender)])]
    else:
        script = "latin" if group == "latin" else "cyrillic"
        name = BEGINNINGS[script][drawn % len(BEGINNINGS[script])]
    drawn >>= 24
    letters = "abcdefghijklmnoprstuvwyz" if script == "latin" else "абвгдежзиклмнопрстуфхц"
    for _ in range(attempt + 1 if attempt else 0):  # the lists are short; made-up letters tell more names apart
        drawn, k = divmod(drawn, len(letters))
        name += letters[k]
        drawn = drawn or _number(key, f"{kind}|{attempt}|{value}|{name}", 128)
    return name + ENDS[group][drawn % len(ENDS[group])] if what == "family" else name


def _written(name: str, word: str, kind: str) -> str:
    """The stand-in as the word stands: in capitals, with a woman's ending."""
    if kind == "family inflected" and _plain(word).endswith("а"):
        name += "а"
    return name.upper() if len(word) > 1 and word.isupper() else name


# surrogates -----------------------------------------------------------------------------------------------------------

_DAY_ONE, _DAYS = datetime.date(1900, 1, 1).toordinal(), 47_482  # to the end of 2029


def _date(text: str) -> tuple[int, list[str]] | None:
    """(day, the kinds of its parts) of a date, or None."""
    parts = re.findall(r"\d+|[^\W\d_]+", text)
    fields = [p for p in parts if p.lower() != "de"]
    word = [p for p in fields if p.lower() in _MONTHS]
    kinds = ["d", "M", "y"] if word and fields[0] not in word else ["M", "d", "y"] if word else ["y", "m", "d"] if len(fields[0]) == 4 else ["d", "m", "y"]
    got = dict(zip([k.lower() for k in kinds], fields, strict=False))
    try:
        month = _MONTHS.index(got["m"].lower()) % 12 + 1 if word else int(got["m"])
        day = datetime.date(int(got["y"]), month, int(got["d"])).toordinal() - _DAY_ONE
    except (KeyError, ValueError):
        return None
    return (day, kinds) if 0 <= day < _DAYS else None


def _birth(mention: str, key: bytes) -> str:
    day, kinds = _date(mention)
    new = datetime.date.fromordinal(_DAY_ONE + permuted(day, _DAYS, key, "birth"))
    found = [m for m in re.finditer(r"\d+|[^\W\d_]+", mention) if m[0].lower() != "de"]
    out = mention
    for m, kind in reversed(list(zip(found, kinds, strict=True))):
        if kind == "M":
            word = _MONTHS[_MONTHS.index(m[0].lower()) // 12 * 12 + new.month - 1]  # in the same language
            value = word.capitalize() if m[0][0].isupper() else word
        else:
            value = str({"d": new.day, "m": new.month, "y": new.year}[kind]).zfill(2 if m[0].startswith("0") and len(m[0]) == 2 else 1)
        out = out[: m.start()] + value + out[m.end() :]
    return out


def _ip(value: str, key: bytes) -> str:
    """Of the same block, if that is private; else another public address."""
    number = int(ipaddress.IPv4Address(value))
    for block in map(ipaddress.IPv4Network, ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")):
        if ipaddress.IPv4Address(number) in block:
            return str(block[permuted(number - int(block[0]), block.num_addresses, key, str(block))])
    inside = lambda x: not ipaddress.IPv4Address(x).is_private
    new = permuted(number, 1 << 32, key, "ip")
    while inside(number) and not inside(new):  # comes back to number at the latest
        new = permuted(new, 1 << 32, key, "ip")
    return str(ipaddress.IPv4Address(new))


def _email(mention: str, key: bytes) -> str:
    """Each label by one of its format; the top label goes before .example, where no mail is delivered."""
    local, _, domain = mention.lower().rpartition("@")
    labels = domain.split(".")
    new = reshaped(local, key, "local") + "@" + ".".join([*(reshaped(x, key, "label") for x in labels[:-1]), labels[-1]])
    if len(new) == len(mention):
        new = "".join(x.upper() if c.isupper() else x for x, c in zip(new, mention, strict=True))
    return f"{new}.example"


def _digits(mention: str) -> str:
    return "".join(str(int(c)) for c in mention if c.isdecimal())


def _with_digits(mention: str, digits: str) -> str:
    """The mention with other digits, in its own script."""
    left = iter(digits)
    return "".join(chr(ord(c) - int(c) + int(next(left))) if c.isdecimal() else c for c in mention)


def surrogate(kind: str, mention: str, key: bytes) -> str:
    """The stand-in of a mention of any kind but persons, in its format."""
    if kind == "email":
        return _email(mention, key)
    if kind == "secret":
        hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", mention)
        if not hexed:
            return reshaped(mention, key, "secret")
        parts = [mention[k : k + HEAD] for k in range(0, len(mention), HEAD)]
        for _ in range(1 if len(parts) == 1 else 2):  # each part by the others, twice, so that all depend on all
            for k, p in enumerate(parts):
                others = hashlib.sha256("|".join(parts[:k] + parts[k + 1 :]).encode()).hexdigest() if len(parts) > 1 else ""
                parts[k] = f"{permuted(int(p, 16), 16 ** len(p), key, f'hex {len(p)} {mention.isupper()} {others}'):0{len(p)}x}"
        new = "".join(parts)
        return new.upper() if mention.upper() == mention else new
    if kind == "ip":
        return _ip(_ascii(mention), key)
    if kind == "ipv6":
        block = int(ipaddress.IPv6Address(mention)) >> 112 << 112
        return str(ipaddress.IPv6Address(block + permuted(int(ipaddress.IPv6Address(mention)) - block, 1 << 112, key, f"ipv6 {block:x}")))
    if kind == "birth":
        return _birth(mention, key)
    if kind == "street":
        kept = [m.span() for m in STREET_WORDS.finditer(mention)]
        cuts = [0, *(x for span in kept for x in span), len(mention)]
        pieces = [mention[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return "".join(reshaped(p, key, "street") if k % 2 == 0 and any(map(str.isalnum, p)) else p for k, p in enumerate(pieces))
    if kind == "iban":
        bare = mention.replace(" ", "")
        body = reshaped(bare[4:], key, f"iban {bare[:2]}")
        new = iter(f"{bare[:2]}{98 - iban_rest(f'{bare[:2]}00{body}'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in mention)
    digits = _digits(mention)
    if kind == "card":
        body = digits[0] + reshaped(digits[1:-1], key, f"card {digits[0]}")
        return _with_digits(mention, next(body + d for d in "0123456789" if luhn(body + d) == luhn(digits)))
    # a number with the code +1 is that without it
    code, national = ("1", digits[1:]) if kind == "phone" and len(digits) == 11 and mention.lstrip("(").startswith("+") and digits[0] == "1" else ("", digits)
    return _with_digits(mention, code + reshaped(national, key, kind, fixed=1))


def _ascii(text: str) -> str:
    return "".join(str(int(c)) if c.isdecimal() else c for c in text)


ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
NAMES = T.StructType([T.StructField("names", T.ArrayType(ENTITY))])
FIELDS = [T.StructField("n_entities", T.LongType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]


def names_in(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the names of the persons, without a search for anything else where there are none."""
    if not persons(text):
        return []
    spans = mentions(text)
    genders = genders_in(text, spans)
    return sorted({(k, v) for a, b, kind in spans if kind in ("person", "name") for k, v, _ in parts_of(text[a:b], genders)[1] if k not in ("particle", "initial")})


def _name_finder() -> Callable[[pa.Array], dict]:
    def run(texts: pa.Array) -> dict:
        return {"names": [[{"kind": k, "value": v} for k, v in names_in(t)] if t else [] for t in texts.to_pylist()]}

    return run


def names(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """kind, value of each distinct name."""
    found = with_arrow_columns(docs, [text], NAMES, _name_finder, keep=[])
    return found.select(F.explode("names").alias("e")).select("e.kind", "e.value").distinct()


def _stand_ins(key: bytes) -> Callable[..., dict]:
    return lambda kinds, values, attempts: {"stand_in": [name_for(k, v, a, key) for k, v, a in zip(kinds.to_pylist(), values.to_pylist(), attempts.to_pylist(), strict=True)]}


def moved_names(found: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt of the names whose stand-in at attempt 0 would collide. found: a written table.

    Ends, as each attempt draws from a space larger than that before."""
    field = T.StructType([T.StructField("stand_in", T.StringType())])
    make = lambda rows: with_arrow_columns(rows, ["kind", "value", "attempt"], field, _stand_ins, key)
    n = found.count()
    state = cut(make(found.withColumn("attempt", F.lit(0))), n)
    while True:
        # who came to a stand-in first keeps it; equals by the value
        first = state.groupBy("kind", "stand_in").agg(F.min(F.struct("attempt", "value")).alias("first"))
        ranked = state.join(first, ["kind", "stand_in"]).withColumn("late", F.struct("attempt", "value") > F.col("first"))
        real = found.select("kind", F.col("value").alias("stand_in")).withColumn("is_real", F.lit(True))
        judged = ranked.join(real, ["kind", "stand_in"], "left").withColumn("lost", F.col("late") | F.col("is_real").isNotNull())
        judged = cut(judged.select("kind", "value", "attempt", "stand_in", "lost"), n)
        losers = judged.where("lost").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if losers.isEmpty():
            return judged.where("attempt > 0").select("kind", "value", "attempt")
        state = judged.where("not lost").select("kind", "value", "attempt", "stand_in").unionByName(make(losers))


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the spans in the old text. attempts: of the names that are not at the first."""
    spans = mentions(text)
    genders = genders_in(text, spans)
    parts, at = [], 0
    for a, b, kind in spans:
        if kind in ("person", "name"):
            before, words = parts_of(text[a:b], genders)
            named = lambda k, v, word: word if k == "particle" else reshaped(word, key, k) if k == "initial" else _written(name_for(k, v, attempts.get((k, v), 0), key), word, k)
            new = before + " ".join(named(*w) for w in words)
        else:
            new = surrogate(kind, text[a:b], key)
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), spans


def _replacer(key: bytes, moved) -> Callable[..., dict]:
    listed = {} if moved is None else moved.value

    def run(texts: pa.Array, own: pa.Array | None = None) -> dict:
        out, counts, found = [], [], []
        for text, extra in zip(texts.to_pylist(), own.to_pylist() if own is not None else [None] * len(texts), strict=True):
            attempts = {(m["kind"], m["value"]): m["attempt"] for m in extra} if extra else listed
            new, spans = replaced(text, key, attempts) if text else (text, [])
            out.append(new)
            counts.append(len(spans))
            found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
        return {"text": out, "n_entities": counts, "found": found}

    return run


def pseudonymise(docs: DataFrame, *, key: bytes, text: str = "text", max_broadcast: int = MAX_BROADCAST, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with surrogates in its text, n_entities, and found (spans in the old text)."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != text]
    moved = cut(moved_names(cut(names(docs, text=text)), key))
    fields = T.StructType([T.StructField("text", T.StringType()), *FIELDS])
    order = [c for c in docs.columns if c in keep or c == text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("row"), F.col(text).alias("text"))
    if moved.count() <= max_broadcast:
        listed = {(r["kind"], r["value"]): r["attempt"] for r in moved.collect()}
        out = with_arrow_columns(rows, ["text"], fields, _replacer, key, spark.sparkContext.broadcast(listed))
    else:
        tagged = with_arrow_columns(rows.withColumn("tag", F.xxhash64("text")), ["text"], NAMES, _name_finder)
        each = tagged.select("tag", F.explode("names").alias("e")).distinct().select("tag", "e.kind", "e.value")
        own = each.join(moved, ["kind", "value"]).groupBy("tag").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("own"))  # as many as a text has names
        out = with_arrow_columns(tagged.drop("names").join(own, "tag", "left"), ["text", "own"], fields, _replacer, key, None, keep=["row"])
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in order if c not in ("n_entities", "found")], "n_entities", "found")
