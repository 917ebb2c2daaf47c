"""PII: keyed, type-consistent surrogates for detected entities.

Entities are found by rule: e-mail addresses, telephone, card and social security numbers, IBANs, IP addresses,
credentials after a context word, and personal names: known given names (Latin, Cyrillic, Greek) with the capitalised words
that follow, one or two capitalised words after an honorific, the word after an Arabic or Devanagari one, and
ideographs before or hangul before one. Where a document has a full name, its parts standing alone are mentions as well.
Given names that stand alone in a document without such a full name are left, as most are words too.

* Numbers, addresses and credentials go round a keyed cycle through all values of their format (a Feistel permutation, a
  step, and back; values outside the format are walked over). So no two entities share a surrogate and none keeps its own,
  however small the pool, and all mentions of an entity get the same one in any document (coreference). Separators,
  groups of digits, letter case, the country code, the private or public range of an IP address and valid
  check digits stay. A surrogate may be a value that another entity has, where the corpus holds much of the pool.
* Given names are exchanged within their gender and script by a keyed cycle through the list, so they never
  collide. Surnames are made of syllables of their script, drawn by a keyed hash, and, where the script has it, keep the gendered ending.
* Collision checks: over the distinct surnames of all documents, surrogates that two of them share, or that are one's
  own value, are drawn again for all but the lowest, with one syllable more each time, so the pool grows thirtyfold
  a round until none are left. Only surnames drawn again have to be known when texts are rewritten. They are sent to the workers if there
  are few (a checked number); else each document's are joined to it. Tables hold keyed hashes, never the values.

Defined cases: null and empty texts stay as they are. Rows that repeat are rewritten alike. Mentions that
overlap go to the type that is first in TYPES, then to the leftmost. Empty tables give an empty table. Other columns pass
through; internal names give way to the table's own. Texts without entities are returned unchanged. Values without any letter or digit
stay, as they have no other value of their format.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import BROADCAST_ROWS, fresh, map_texts, row_key, small
from moraine.session import checkpointed

TYPES = ("email", "credential", "iban", "ip", "card", "ssn", "phone", "name")

GIVEN = {
    ("latin", "f"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Anna Maria Julia Sofia Lucia "
        "Carmen Isabel Ingrid Ursula Heike Claire Camille Chloe Elodie Juliette Ann Anne Betty Donna Ruth Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Christine Catherine Virginia Rachel "
        "Janet Maryam Fatima Aisha Layla Zainab Priya Ananya Deepika Lakshmi Sunita Kavita Neha Pooja Mei Xiu Ying Yuki Sakura Haruka Akiko Naoko Nguyet Linh Thuy Giulia Chiara Francesca Alessandra Valentina Martina Elena "
        "Paola Silvia Marta Pilar Dolores Mercedes Beatriz Fernanda Gabriela Mariana Renata Joana Inês Katarzyna Agnieszka Małgorzata Zofia Hanna Ewa Astrid Freja Sigrid Karin Birgit Petra Sabine Monika Renate Gisela Brigitte "
        "Nathalie Sylvie Véronique Amélie Océane Léa Manon Ines Amina Wanjiru Ngozi Chiamaka Adaeze Thandiwe Olivia Emma Charlotte Sophia Evelyn Harriet Eleanor Abigail Madison Hannah"
    ).split(),
    ("latin", "m"): (
        "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Paul Joshua Kenneth Kevin Brian George Edward Ronald Timothy Carlos Miguel Javier Pablo Diego Hans "
        "Klaus Dieter Wolfgang Stefan Pierre Jacques Antoine Olivier Laurent Donald Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Raymond Jack "
        "Dennis Jerry Tyler Aaron Jose José Adam Nathan Henry Douglas Zachary Peter Kyle Noah Ethan Jeremy Walter Christian Keith Roger Terry Austin Sean Gerald Carl Harold Dylan Arthur Lawrence Jordan Jesse Bryan Billy Bruce "
        "Bob Gabriel Joe Logan Alan Juan Albert Willie Elijah Wayne Randy Vincent Mason Roy Ralph Bobby Russell Bradley Philip Eugene Mohammed Muhammad Ahmed Omar Ali Hassan Ibrahim Yusuf Khalid Rahul Amit Arjun Vikram Rajesh "
        "Sanjay Anil Suresh Ravi Wei Jun Ming Hao Qiang Lei Hiroshi Takashi Kenji Satoshi Daisuke Minh Tuan Duc Giovanni Marco Luca Alessandro Matteo Lorenzo Francesco Antonio Manuel Fernando Ricardo Eduardo Rafael Luis Jorge "
        "Sergio Andrés João Pedro Tiago Paulo Piotr Krzysztof Andrzej Tomasz Jan Lars Erik Björn Sven Anders Jürgen Günther Uwe Bernd Matthias Heinrich Friedrich Philippe Michel Alain Jean François Étienne Kwame Kofi Chinedu Emeka Sipho"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Анастасия Дарья Ксения Вера Людмила Галина Надежда Валентина Лариса Тамара Нина Полина Алина Виктория Оксана Зоя".split(),
    ("cyrillic", "m"): "Александр Сергей Дмитрий Андрей Алексей Максим Иван Михаил Николай Павел Роман Владимир Виктор Олег Артём Егор Константин Борис Юрий Анатолий Василий Пётр Никита Игорь Тарас Степан".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ιωάννα Παναγιώτα Ευαγγελία Άννα".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Παναγιώτης Βασίλειος Χρήστος Αθανάσιος Μιχαήλ Ευάγγελος Σπυρίδων".split(),
}
KIND_OF = {n.casefold(): k for k, names in GIVEN.items() for n in names}
SYLLABLES = {
    "latin": "bar bel cor dan del far fen gar hal hol jan kel lan lor mar mel nor pal per ral ron sal sen tal tor van vel wal win zan".split(),
    "cyrillic": "бар бел вол гор дан дол жар зим кал кор лад лом мар мел нор пал пет рад рож сав сол тар тим хол чер".split(),
    "greek": "βαλ γαρ δαν δελ ζερ θαν καλ κορ λαμ λορ μαν μελ ναρ νικ παλ περ ραν σαλ σερ ταλ τορ φαν χαλ ψαρ".split(),
    "arabic": "بار تال جان حام دار راد زين سال شام صاد طار عام فار قاس كام لان مار نال هاد وال".split(),
    "devanagari": "कम गर चन जय तर दल नर पल बल मन रज लख वर शर सम हर".split(),
    "han": list("安柏成达恩方光海和华嘉建静凯兰乐丽林美明宁平琪青荣瑞山诗思天文希晓心雪雅阳永宇悦云泽志"),
    "hangul": list("가강경고규김나남다도동라로마명문미민박백범병보상서선성세소송수승시신아안양연영예오우원유윤은이인임장재전정조주준지진찬채천철태하한해현형혜호홍화환희"),
}

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]++\.)+[^\W\d_]{2,}+")
_CREDENTIAL = re.compile(r"""(?i)\b(?:token|password|passwd|secret|api[_-]?key)["']?\s*+[:=]\s*+["']?([A-Za-z0-9_\-+/.=]{8,})""")
# runs without an upper bound, so none ends within an entity
_DIGITS = re.compile(r"(?<![\w.])[+(]?\(?\d[\d .()\-]{5,}\d(?!\w)")
_IP = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)")
# these three are tried from each place, as what is found at one may be dropped for an entity of another type
_IBAN = re.compile(r"(?<!\w)(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)))")
_CARD = re.compile(r"(?<![\d-])(?=((?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![\d-])))")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<![\w.])(?=((?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|\+\d{1,3}[ .-]\d{3,4}[ .-]\d{4}(?!\w)|\+\d{1,3}[ .-]\d{1,2}(?:[ .-]\d{2}){4}(?!\w)|\+\d{9,15}(?!\w)))")
_UP = "A-ZÀ-ÖØ-ÞŁŚŻА-ЯЁΆΈ-ΏΑ-Ϋ"
# steps by one word, so a capitalised word before a name doesn't use it up; up to two capitalised words follow
_NAME = re.compile(rf"\b([{_UP}][\w]+)(?=((?: [{_UP}]\.)? )([{_UP}][\w'’-]*\w)(?: (?:[{_UP}]\. )?([{_UP}][\w'’-]*\w))?)")
_WORD = re.compile(rf"\b[{_UP}][\w'’-]*\w")
_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Господин Госпожа Κύριος Κυρία".split()
_TITLE = re.compile(rf"\b({'|'.join(_TITLES)})\.? (?=([{_UP}][\w'’-]*\w)(?:(?: [{_UP}]\.)? ([{_UP}][\w'’-]*\w))?)")
_F_TITLES = {"Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа", "Κυρία", "السيدة", "श्रीमती", "女士", "小姐"}
#: Scripts without capitals: the name is what stands next to an honorific.
_BEFORE = re.compile(r"(?<!\w)(السيدة|السيد|श्रीमती|श्री) ([\w\u0900-\u097F]+)")
_AFTER = re.compile(r"(?<![\u4E00-\u9FFF])([\u4E00-\u9FFF]{2,4}?)(先生|女士|小姐|さん|様)|(?<![\uAC00-\uD7A3])([\uAC00-\uD7A3]{2,4}) ?(씨|님)(?![\uAC00-\uD7A3])")
#: Calling codes of one and of two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

#: A mention: begin, end, type, normalised entity.
Mention = tuple[int, int, str, str]


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def national(phone: str) -> str:
    """The digits of a telephone number after its country code, if it has one."""
    own = digits(phone)
    if not phone.startswith("+"):
        return own
    return own[next((n for n in (1, 2) if own[:n] in _CODES), 3) :]


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_SCRIPTS = (("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))


def script(word: str) -> str:
    return next((name for name, first, last in _SCRIPTS if any(first <= ord(c) <= last for c in word)), "latin")


def mentions(text: str | None) -> list[Mention]:
    """The entities of a text, from left to right, without overlaps."""
    if not text:
        return []
    raw: list[Mention] = []
    if "@" in text:
        raw += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        raw += [(m.start(1), m.end(1), "credential", m[1]) for m in _CREDENTIAL.finditer(text)]
    for m in _IBAN.finditer(text):
        # groups that follow an IBAN aren't part of it
        if end := next((i for i in range(len(m[1]), 14, -1) if m[1][i : i + 1] in ("", " ") and iban_ok(m[1][:i])), 0):
            raw.append((m.start(), m.start() + end, "iban", m[1][:end].replace(" ", "")))
    for area in _DIGITS.finditer(text):
        a, z = area.span()
        raw += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text, a, z)]
        raw += [(m.start(1), m.end(1), "card", digits(m[1])) for m in _CARD.finditer(text, a, z)]
        raw += [(m.start(), m.end(), "ssn", digits(m[0])) for m in _SSN.finditer(text, a, z)]
        raw += [(m.start(1), m.end(1), "phone", national(m[1])) for m in _PHONE.finditer(text, a, z) if 8 <= len(digits(m[1])) <= 15]
    own = names(text)
    out: list[Mention] = []
    for x in sorted({*raw, *own}, key=lambda x: (TYPES.index(x[2]), x[0], -x[1], x[3])):
        i = bisect(out, x)
        if (i == 0 or out[i - 1][1] <= x[0]) and (i == len(out) or x[1] <= out[i][0]):
            out.insert(i, x)
    return out


def names(text: str) -> list[Mention]:
    """Parts of personal names; they may repeat."""
    out: dict[tuple[int, int], str] = {}

    def add(m: re.Match, i: int, gender: str) -> None:
        if (kind := KIND_OF.get(m[i].casefold())) and kind[0] == script(m[i]):
            out.setdefault(m.span(i), f"given:{kind[0]}:{kind[1]}:{m[i].casefold()}")
        else:
            out.setdefault(m.span(i), f"surname:{script(m[i])}:{gender}:{stem(m[i], gender)}")

    for m in _NAME.finditer(text):
        if kind := KIND_OF.get(m[1].casefold()):
            for i in (1, 3, 4):
                if m[i] and m[i] not in _TITLES:
                    add(m, i, kind[1])
    for m in _TITLE.finditer(text):
        gender = "f" if m[1] in _F_TITLES else "m"
        for i in (2, 3):
            if not m[i] or m[i] in _TITLES:
                break
            add(m, i, gender)
    if not text.isascii():
        for m in _BEFORE.finditer(text) if "السيد" in text or "श्री" in text else ():
            add(m, 2, "f" if m[1] in _F_TITLES else "m")
        for m in _AFTER.finditer(text) if any(h in text for h in ("先生", "女士", "小姐", "さん", "様", "씨", "님")) else ():
            add(m, 1 if m[1] else 3, "f" if m[2] in _F_TITLES else "m")
    if out:  # parts of a full name that stand alone
        known: dict[str, str] = {}
        for (a, z), entity in sorted(out.items()):
            if text[a].isupper() and z - a > 2:
                known.setdefault(text[a:z].casefold(), entity)
        for m in _WORD.finditer(text) if known else ():
            if (entity := known.get(m[0].casefold())) and m.span() not in out:
                out[m.span()] = entity
    return [(a, z, "name", entity) for (a, z), entity in out.items()]


def stem(surname: str, gender: str) -> str:
    """A Cyrillic surname of either gender has one stem, so a family's names stay one entity."""
    low = surname.casefold()
    return re.sub("(ова|ева|ина)$", lambda m: m[0][:-1], low) if gender == "f" and script(surname) == "cyrillic" else low


def permuted(key: bytes, label: str, n: int, x: int, back: bool = False) -> int:
    """A keyed permutation of 0 .. n - 1: a Feistel network over the next even number of bits, walked until within n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    size, mask = (half + 7) // 8, (1 << half) - 1
    head = len(key).to_bytes(4, "big") + key + len(label).to_bytes(4, "big") + label.encode()
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(8)) if back else range(8):
            half_block = left if back else right
            f = int.from_bytes(hashlib.shake_256(head + bytes([r]) + half_block.to_bytes(size, "big")).digest(size), "big") & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        x = left << half | right
        if x < n:
            return x


def after(key: bytes, label: str, n: int, x: int, fits: Callable[[int], bool] = lambda y: True) -> int:
    """The next value on a keyed cycle through all values of 0 .. n - 1 that fit; x is one of them. The same only if there's no other."""
    y = x
    while True:
        y = permuted(key, label, n, (permuted(key, label, n, y) + 1) % n, back=True)
        if y == x or fits(y):
            return y


@functools.cache
def _letters() -> dict[tuple[str, str], list[str]]:
    """Letters beyond ASCII by script and category, each with all of its kind."""
    out: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(128, 0x10000)):
        if c.isalpha() and (c.lower() == c or unicodedata.category(c) == "Lu"):
            out.setdefault((unicodedata.name(c, "?").split()[0], unicodedata.category(c)), []).append(c)
    return out


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _hexadecimal(s: str) -> bool:
    return len(s) >= 16 and not s.isdecimal() and all(c in "0123456789abcdef" for c in s)


def like(key: bytes, label: str, s: str) -> str:
    """Another string of the same format: each letter and digit is one of its kind; hexadecimal stays hexadecimal."""
    if hexa := _hexadecimal(s):
        kinds = ["0123456789abcdef"] * len(s)
        places = list(range(len(s)))
    else:
        places, kinds = [], []
        for i, c in enumerate(s):
            own: str | list[str] | None = "0123456789" if c in "0123456789" else _LOWER if c in _LOWER else _UPPER if c in _UPPER else None
            if own is None and c.isalpha():
                own = _letters().get((unicodedata.name(c, "?").split()[0], unicodedata.category(c)))
                own = own if own and c in own else None
            if own:
                places.append(i)
                kinds.append(own)
    n = x = 1
    x = 0
    for i, own in zip(places, kinds):
        n, x = n * len(own), x * len(own) + own.index(s[i])

    def read(y: int) -> str:
        out = list(s)
        for i, own in zip(reversed(places), reversed(kinds)):
            y, d = divmod(y, len(own))
            out[i] = own[d]
        return "".join(out)

    # formats don't run into one another: what was hexadecimal stays so, and nothing else becomes it
    shape = f"{label}:{'x' * len(s) if hexa else ''.join(str(len(k)) + '.' for k in kinds)}"
    return read(after(key, shape, n, x, lambda y: _hexadecimal(read(y)) == hexa)) if n > 1 else s


def _public(address: int) -> bool:
    return 11 <= address >> 24 <= 223 and address >> 24 not in (100, 127, 169, 172, 192, 198, 203)


def who(key: bytes, alphabet: str, word: str) -> str:
    """A keyed hash that stands for a surname in tables."""
    return hmac.digest(key, f"who:{alphabet}:{word}".encode(), "sha256").hex()[:32]


def ending(alphabet: str, word: str) -> str:
    return next((e for e in ("ов", "ев", "ин") if word.endswith(e)), "") if alphabet == "cyrillic" else ""


def drawn_surname(key: bytes, alphabet: str, hashed: str, end: str, nonce: int) -> str:
    own, n = SYLLABLES[alphabet], 3 + nonce
    x = int.from_bytes(hashlib.shake_256(f"{key.hex()}:{hashed}:{nonce}".encode()).digest(8 + n), "big")
    out = []
    for _ in range(n):
        x, i = divmod(x, len(own))
        out.append(own[i])
    return "".join(out) + end


def surrogate(key: bytes, kind: str, entity: str, nonce: int = 0) -> str:
    """The surrogate of an entity, normalised as entities are. nonce: how often a surname was drawn again."""
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        return f"{like(key, 'local:' + domain, local)}@{like(key, 'domain', domain)}.example.com"  # one domain stays one
    if kind == "credential":
        return like(key, kind, entity)
    if kind == "ip":
        octets = entity.split(".")
        fixed = 1 if octets[0] in ("10", "127") else 2 if entity.startswith(("192.168.", "169.254.")) or (octets[0] == "172" and 16 <= int(octets[1]) <= 31) else 0
        x = int.from_bytes(bytes(map(int, octets[fixed:])), "big")
        y = after(key, "ip:" + ".".join(octets[:fixed]), 256 ** (4 - fixed), x, (lambda v: True) if fixed or not _public(x) else _public)
        return ".".join([*octets[:fixed], *map(str, y.to_bytes(4 - fixed, "big"))])
    if kind == "iban":
        body = like(key, "iban:" + entity[:2], entity[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "card":
        good = lambda body: next(d for d in range(10) if luhn(f"{body}{d}"))
        body = entity[0] + like(key, f"card:{entity[0]}", entity[1:-1])
        return f"{body}{(good(body) + int(entity[-1]) - good(entity[:-1])) % 10}"
    if kind in ("ssn", "phone"):
        n, zero = len(entity), entity[:1] == "0"
        if not n:
            return entity
        y = after(key, f"{kind}:{n}:{zero}", 10**n, int(entity), lambda v: (v < 10 ** (n - 1)) == zero)
        return f"{y:0{n}d}"
    part, alphabet, gender, word = entity.split(":", 3)
    if part == "given":
        own = [n.casefold() for n in GIVEN[(alphabet, gender)]]
        own.sort(key=lambda n: hmac.digest(key, n.encode(), "sha256"))
        return f"given:{alphabet}:{gender}:{own[(own.index(word) + 1) % len(own)]}"
    # the surname of a family is one for both genders, so gender isn't drawn on
    return f"surname:{alphabet}:{gender}:{drawn_surname(key, alphabet, who(key, alphabet, word), ending(alphabet, word), nonce)}"


def written(mention: str, kind: str, new: str) -> str:
    """The surrogate in the format of the mention."""
    if kind == "name":
        part, alphabet, gender, word = new.split(":", 3)
        if part == "surname" and alphabet == "cyrillic" and gender == "f" and word.endswith(("ов", "ев", "ин")):
            word += "а"
        if alphabet == "greek" and word.endswith("σ") and not mention.isupper():
            word = word[:-1] + "ς"
        return word.upper() if mention.isupper() and len(mention) > 1 else word.lower() if mention.islower() else word[0].upper() + word[1:]
    if kind in ("email", "ip"):
        return new.upper() if mention.isupper() and kind == "email" else new
    if kind == "credential":
        return new
    source = iter(new)
    keep = len([c for c in mention if c.isalnum()]) - len(new)  # a country code stays
    out, seen = [], 0
    for c in mention:
        if c.isalnum():
            seen += 1
            out.append(c if seen <= keep else next(source))
        else:
            out.append(c)
    return "".join(out)


class Surrogates:
    """surrogate() with what was drawn before kept, up to a number of entries; the rest is computed again."""

    def __init__(self, key: bytes, keep: int = 50_000):
        self.key, self.keep, self.known = key, keep, {}

    def __call__(self, kind: str, entity: str, nonces: dict[str, int] | None) -> str:
        nonce = 0
        if nonces and kind == "name" and entity.startswith("surname:"):
            _, alphabet, _, word = entity.split(":", 3)
            nonce = nonces.get(who(self.key, alphabet, word), 0)
        at = kind, entity, nonce
        if (new := self.known.get(at)) is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            new = self.known[at] = surrogate(self.key, kind, entity, nonce)
        return new


def rewrite(text: str | None, key: bytes | Surrogates, nonces: dict[str, int] | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and how many mentions there were. nonces: by who()."""
    own = mentions(text)
    if not own:
        return text, 0
    new = key if isinstance(key, Surrogates) else Surrogates(key)
    out, at = [], 0
    for a, z, kind, entity in own:
        out += [text[at:a], written(text[a:z], kind, new(kind, entity, nonces))]
        at = z
    return "".join(out) + text[at:], len(own)


def surnames(text: str | None, key: bytes) -> set[tuple[str, str, str]]:
    """Alphabet, who() and ending of the surnames of a text, also of those within mentions of other types."""
    own = {e for *_, e in names(text or "") if e.startswith("surname:")}
    return {(alphabet, who(key, alphabet, word), ending(alphabet, word)) for _, alphabet, _, word in (e.split(":", 3) for e in own)}


def entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """alphabet, who and ending of the surnames of all documents, distinct. Other entities can't collide."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = sorted({x for t in part.column(0) for x in surnames(t.as_py(), key)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], pa.string()) for i in range(3)], names=["alphabet", "who", "ending"])

    return map_texts(docs.select(F.col(text_col).alias("text")), run, "alphabet string, who string, ending string").distinct()


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """who and nonce of the surnames whose first draw collides; found: entities(), materialised."""

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            new = [drawn_surname(key, *x) for x in zip(*(part.column(i).to_pylist() for i in range(4)))]
            # a surrogate as it is written, hashed as surnames are, to be compared with the real ones
            real = [who(key, a, n) for a, n in zip(part.column(0).to_pylist(), new)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(real, pa.string())], names=["alphabet", "who", "ending", "nonce", "new"])

    state = found.withColumn("nonce", F.lit(0))
    while True:
        drawn = checkpointed(state.mapInArrow(draw, "alphabet string, who string, ending string, nonce int, new string"))
        shared = drawn.groupBy("new").agg(F.min(F.struct("nonce", "who")).alias("first"), F.count("*").alias("n"))
        real = drawn.select(F.col("who").alias("new"), F.lit(True).alias("real"))
        clash = shared.join(real, "new", "left").where((F.col("n") > 1) | F.col("real"))
        lost = drawn.join(clash, "new").where(F.col("real").isNotNull() | (F.col("first.who") != F.col("who"))).select("who", F.lit(1).alias("again"))
        lost = checkpointed(lost)
        if lost.isEmpty():
            return drawn.where("nonce > 0").select("who", "nonce")
        state = drawn.join(lost, "who", "left").select("alphabet", "who", "ending", (F.col("nonce") + F.coalesce("again", F.lit(0))).alias("nonce"))


def replaced(docs: DataFrame, *, key: bytes = b"moraine-surrogates", id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, broadcast_rows: int = BROADCAST_ROWS // 4) -> DataFrame:
    """docs with surrogates in the text, and, if named, the number of mentions in count_col."""
    again = checkpointed(redrawn(checkpointed(entities(docs, key, text_col)), key))
    names = docs.columns
    place = next(i for i, c in enumerate(names) if c.lower() == text_col.lower())
    schema = docs.schema
    if count_col:
        schema = docs.select("*").schema.add(count_col, "integer", False)
    known, extra = None, []
    source = docs
    if small(again, broadcast_rows):
        known = docs.sparkSession.sparkContext.broadcast({r.who: r.nonce for r in again.collect()})
    else:
        row, mine = fresh(docs, "row_key_of_text", "nonces_of_text")

        def list_(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                own = [sorted({x[1] for x in surnames(t.as_py(), key)}) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.string()))], names=["row", "own"])

        listed = map_texts(docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")), list_, "row long, own array<string>").select("row", F.explode("own").alias("who")).distinct()
        per_row = listed.join(again, "who").groupBy("row").agg(F.collect_list(F.struct("who", "nonce")).alias(mine)).withColumnRenamed("row", row)
        source = docs.withColumn(row, row_key(id_col, text_col)).join(per_row, row, "left")
        extra = [mine]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_of = Surrogates(key)
        for part in parts:
            texts = part.column(place).to_pylist()
            if known is not None:
                new = [rewrite(t, new_of, known.value) for t in texts]
            else:
                new = [rewrite(t, new_of, {x["who"]: x["nonce"] for x in n or []}) for t, n in zip(texts, part.column(len(names)).to_pylist())]
            columns = [*part.columns[: len(names)]]
            columns[place] = pa.array([n[0] for n in new], pa.string())
            if count_col:
                columns.append(pa.array([n[1] for n in new], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_texts(source.select(*names, *extra), run, schema)
