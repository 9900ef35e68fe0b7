"""Surrogates for personal data and credentials.

Each detected entity is replaced by a keyed surrogate of its own kind, gender, script and format.  A surrogate comes from a
keyed permutation of all values of the entity's format (a Feistel network over mixed radices, walked until it is in range),
conjugated with a shift, so that

* the same value always gets the same surrogate, in every document and run (coreference);
* two values never share one, since values of one format are permuted and formats are kept apart (distinctness; names and IPv6
  addresses that differ in case alone are one value, and the surrogate takes on the case);
* no value stays what it was, wherever its format has two values or more (a walk past values that aren't in the format may come
  back to a rare word of few letters);

and no table of values has to be shared between tasks.  Both properties are checked all the same: within every batch as it
is written, and over the whole corpus by :func:`collisions`, which the registered query runs before it returns.

Names are found by context and shape: after a title (of several languages, in capitals too) or words that introduce a person
("my name is", "Dear", "signed by"), before words that only people go with ("said", "was born"), by a known given name, by the ending of
a family name after another capitalised word, and in Chinese by a family name in a run of two or three characters or before a title.
They run over initials, particles and all capitalised words that follow.
Every word of a name found anywhere in a text is then replaced wherever it stands in that text by itself, in capitals and, in
Cyrillic, in its other cases and genders, so that a family name or a given name alone means the surrogate of the same person.

A surrogate that stands for two values all the same is no error of the run: the later value gets a keyed digest of its own in a
worker, and the registered query marks the rows of such values over the corpus as ``quarantined``, with a null text.

Formats: letters stay letters of their script, case and class (vowel or consonant), digits stay digits, everything else stays;
card numbers with a valid check digit get another valid one, and so do IBANs; octets stay octets; given names are exchanged
within the list of their script and gender; other words of names are exchanged cluster by cluster, consonants that begin, part or
end a syllable for others that do, and keep the endings that show gender; hexadecimal stays hexadecimal; top-level domains and
known key prefixes stay.

Limits: names without any such context are not found, and a title's gender is kept by keeping the title and the
word's ending, since lists are finite and surrogates must stay distinct.

Defined results: null texts stay null; texts without entities stay as they are; repeated rows are treated alike; extra columns
are kept by :func:`replace_text` and not returned by :func:`surrogates`; texts of any length are read whole.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialize, table

#: The key of the registered query; others belong in a secret store.
KEY = b"paperloom surrogate key"

# Alphabets by script and class.
ALPHABETS = (
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåèéêëìíîïòóôõöùúûü", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "çñß", "ÇÑ",
    "āăąēĕėęěīĭįōŏőūŭůűų", "ćĉċčďđĝğģĥħķĺļľłńņňŕřśŝşšţťźżž", "ĀĂĄĒĔĖĘĚĪĬĮŌŎŐŪŬŮŰŲ", "ĆĈĊČĎĐĜĞĢĤĦĶĹĻĽŁŃŅŇŔŘŚŜŞŠŢŤŹŻŽ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "ёіїє", "ЁІЇЄ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
HEX = "0123456789abcdef"

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Camille Caroline Carmen Charlotte Claire Clara Elena Elisabeth Emily Emma Eva Hannah Helen Ingrid Isabel Jane Julia Karin Katharina Laura Lucia Maria Marie Martha Monika Nathalie Olivia Patricia Paula Rosa Sabine Sarah Sofia Sophie Susan Ursula Victoria Aisha Ana Fatima Fatma Giulia Jing Mary Mei Nadia Priya Rachel Yuki Zeynep".split(),
    ("latin", "m"): "Albert Alexander Andreas Antonio Carlos Charles Daniel David Diego Edward Felix Francisco Friedrich George Hans Henri Jacques James Javier Jean Johann John Jorge Karl Louis Lucas Manuel Martin Michael Miguel Nicolas Oliver Pablo Paul Pedro Peter Pierre Robert Stefan Thomas William Wolfgang Abdullah Ahmed Ali Amit Giovanni Hassan Hiroshi Ibrahim Jose José João Juan Kenji Kwame Luis Mehmet Mohamed Mohammed Muhammad Omar Raj Wei".split(),
    ("cyrillic", "f"): "Анна Вера Галина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Αναστασία Βασιλική Ειρήνη Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
# Clusters of consonants and vowels by place in a word and length, and endings that show gender.
CLUSTERS = (
    ("begin", "b c d f g h j k l m n p r s t v w z"), ("begin", "bl br ch cl cr dr fl fr gl gr kl kn kr pf ph pl pr sh sk sl sm sn sp st sw th tr tw vl wh"),
    ("begin", "chr sch scr shr spl spr str thr"), ("begin", "schl schm schn schr schw"),
    ("part", "b c d f g h j k l m n p r s t v w y z"),
    ("part", "bb br ch ck cl dd dl dr ff fr gg gl gr kl kr lb ld lf lk ll lm ln ls lt mb mm mp nd ng nk nn ns nt pl pp pr rb rd rf rg rk rl rm rn rs rt sh sk sp ss st th tr tt"),
    ("part", "cht ldr mbr ndr ngl ntr rth sch str"),
    ("end", "b c d f g h k l m n p r s t w y z"), ("end", "by ch ck cs dt dy ff ft gh ld ll lm ln ls lt ly mp my nd ng nk nn ns nt ny pf rd rg rk rl rm rn rs rt ry rz sh sk ss st sy th tt ty tz"),
    ("end", "cht ldt nds ngs rst rth sch tts"),
    ("begin", "q x y"), ("part", "q x"), ("end", "j q v x"), ("vowel", "a e i o u"), ("vowel", "ae ai au ea ee ei eu ia ie io oa oe oi oo ou ua ue ui"),
)
ENDINGS = re.compile("(?:ova|eva|ska|skaya|sky|ski|dottir|[aeio]|(?:ов|ев|ин)(?:а|у|ым|ой|е|ы|ых|ыми)?|ск(?:ий|ая|ого|ой|ому|ую|им|ом)|[ая]|ίδου|οπούλου|όπουλος|ίδης)$")
# Chinese family names and characters of given names that are common.
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余杜叶程魏苏吕丁任沈姚卢姜崔钟谭陆范汪廖石贾夏韦付邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔汤"
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红建国志文斌浩宇轩子涵欣怡梦琪雨佳俊博晨阳雪梅春燕"
_HAN = "一-鿿"
PARTICLES = frozenset("van von der den de del della di da du la le el al bin ibn zu zur ten ter".split())
_UNITS = {(place, unit): units.split() for place, units in CLUSTERS for unit in units.split()}
_LIST_OF = {name: names for names in GIVEN.values() for name in names}


# -- a keyed permutation ---------------------------------------------------------------------------------------------


class Cipher:
    """Permutations of range(n), one for each (n, tweak)."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        raw = b"".join(hmac.digest(self.key, b"%d|%d|%d|" % (r, block, half) + tweak, "sha256") for block in range((size + 31) // 32))
        return int.from_bytes(raw[:size], "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, order) -> int:
        bits = ((n - 1).bit_length() + 1) // 2
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for r in order:
                if order.step > 0:
                    left, right = right, left ^ self._round(tweak, r, right, bits)
                else:
                    left, right = right ^ self._round(tweak, r, left, bits), left
            if (x := left << bits | right) < n:
                return x

    def forth(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, range(self.ROUNDS))

    def back(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, range(self.ROUNDS - 1, -1, -1))

    def replace(self, x: int, n: int, tweak: bytes) -> int:
        """A permutation of range(n) that leaves nothing in its place, for n of 2 or more."""
        return x if n < 2 else self.back((self.forth(x, n, tweak) + 1) % n, n, tweak)


_CLASS_OF = {c: a for a in ALPHABETS for c in a}


def in_format(cipher: Cipher, kind: str, text: str, alphabets: dict[str, str] | None = None, keep: Callable[[str], bool] | None = None) -> str:
    """Replace the characters of ``text`` that have a class by others of it; with ``keep``, walk on until it holds."""
    classes = alphabets or _CLASS_OF
    places = [(i, classes[c]) for i, c in enumerate(text) if c in classes]
    n = 1
    for _, a in places:
        n *= len(a)
    shape = list(text)
    for i, a in places:
        shape[i] = a[0]
    tweak = f"{kind}|{''.join(shape)}".encode()
    out = text
    while True:
        x = 0
        for i, a in places:
            x = x * len(a) + a.index(out[i])
        x = cipher.replace(x, n, tweak)
        new = list(text)
        for i, a in reversed(places):
            x, k = divmod(x, len(a))
            new[i] = a[k]
        out = "".join(new)
        if keep is None or keep(out):
            return out


# -- kinds -----------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for k, c in enumerate(reversed([c for c in digits if c.isdigit()])):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the two check digits fit the rest."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _card(c: Cipher, text: str) -> str:
    valid = luhn(text)
    return in_format(c, "card", text, keep=lambda x: luhn(x) == valid)


def _iban(c: Cipher, text: str) -> str:
    if not iban(text):
        return text[:2] + in_format(c, f"iban{text[:2]}", text[2:])
    body = in_format(c, f"iban body {text[:2]}", text[4:])
    check = next(k for k in range(2, 99) if iban(f"{text[:2]}{k:02d}{body}"))
    return f"{text[:2]}{check:02d}{body}"


def _ip(c: Cipher, text: str) -> str:
    x = 0
    for part in text.split("."):
        x = x * 256 + int(part)
    x = c.replace(x, 256**4, b"ip")
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _email(c: Cipher, text: str) -> str:
    local, _, domain = text.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{in_format(c, 'local part', local)}@{in_format(c, 'host', host)}.{top}"


def _phone(c: Cipher, text: str) -> str:
    """The country code stays."""
    code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    at = code.end() if code else 0
    return text[:at] + in_format(c, f"phone {text[:at]}", text[at:])


def _hex(c: Cipher, text: str) -> str:
    return in_format(c, "hex", text, {x: HEX for x in HEX})


def _key(c: Cipher, text: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    return text[:4] + in_format(c, f"key {text[:4]}", text[4:], {x: letters for x in letters})


def _secret(c: Cipher, text: str) -> str:
    return _hex(c, text) if re.fullmatch(r"[0-9a-f]{8,}", text) else in_format(c, "secret", text)


def _ipv6(c: Cipher, text: str) -> str:
    """Permuted in lower case; capitals if it has no small letter."""
    new = in_format(c, "ipv6", text.lower(), {x: HEX for x in HEX})
    return new.upper() if text.isupper() else new


def birthday(text: str) -> bool:
    """Whether three numbers are a date in one of the usual orders."""
    x = [int(v) for v in re.findall(r"\d+", text)]
    return any(1 <= m <= 12 and 1 <= d <= 31 and 1 <= len(str(y)) for d, m, y in (x, x[::-1], (x[1], x[0], x[2])))


def _birth(c: Cipher, text: str) -> str:
    """Another date of the same form, in the same century if it has one."""
    cents = re.search(r"\d{4}", text)
    at = cents.start() if cents else None
    kept = {i: text[i] for i in ((at, at + 1) if cents else ())}
    body = "".join("·" if i in kept else ch for i, ch in enumerate(text))
    whole = lambda x: "".join(kept.get(i, ch) for i, ch in enumerate(x))
    valid = birthday(text)
    return whole(in_format(c, f"birth {''.join(kept.values())}", body, keep=lambda x: birthday(whole(x)) == valid))


def _units(word: str) -> list[tuple[str, list[str]]]:
    """The clusters of a word, each with those that may stand in its place; letters by themselves where a cluster is unknown."""
    out = []
    for m in re.finditer("[aeiou]+|[a-z]+?(?=[aeiou]|[^a-z]|$)|[^a-z]", word):
        unit = m[0]
        place = "vowel" if unit[0] in "aeiou" else "begin" if m.start() == 0 else "end" if m.end() == len(word) else "part"
        if (same := _UNITS.get((place, unit))) is not None:
            out.append((unit, same))
        else:
            out += [(x, list(_CLASS_OF.get(x, x))) for x in unit]
    return out


def _ending(word: str) -> str:
    found = ENDINGS.search(word, 2)
    return found[0] if found else ""


def _family(c: Cipher, word: str) -> str:
    """Another word of the same clusters, case and ending; walked until it is no listed name and has that ending still.

    Words that differ in their ending alone mostly get surrogates that do so too, as both stems take the same walk.
    """
    low = word.lower()
    upper = [a != b for a, b in zip(word, low, strict=True)] if len(word) == len(low) else [False] * len(low)
    ending = _ending(low)
    stem = low[: len(low) - len(ending)]
    shape = lambda x: [same for _, same in _units(x)]
    places = shape(stem)
    n = 1
    for same in places:
        n *= len(same)
    cased = lambda x: "".join(ch.upper() if up else ch for ch, up in zip(x, upper, strict=True))
    tweak = f"family|{'|'.join(s[0] + str(len(s)) for s in places)}".encode()
    now = stem
    while True:
        x = 0
        for unit, same in _units(now):
            x = x * len(same) + same.index(unit)
        x = c.replace(x, n, tweak)
        parts = []
        for same in reversed(places):
            x, k = divmod(x, len(same))
            parts.append(same[k])
        now = "".join(reversed(parts))
        if shape(now) == places and _ending(now + ending) == ending and (now + ending).capitalize() not in _LIST_OF:
            return cased(now + ending)


def _han(c: Cipher, text: str) -> str:
    """Family names and common given characters are exchanged within their lists, other characters among all others."""
    other = "".join(x for x in map(chr, range(0x4E00, 0x9FA6)) if x not in HAN_GIVEN)
    lists = [HAN_FAMILY if k == 0 and x in HAN_FAMILY else HAN_GIVEN if x in HAN_GIVEN else other for k, x in enumerate(text)]
    return "".join(own[c.replace(own.index(x), len(own), f"han {k}|{own[0]}".encode())] if x in own else x for k, (x, own) in enumerate(zip(text, lists, strict=True)))


def _name(c: Cipher, text: str) -> str:
    """A known given name is exchanged within its list; other name words are exchanged by clusters; particles stay."""
    out = []
    for part in re.split(r"([ \-.'’])", text):
        title = part.capitalize() if len(part) > 1 and part.isupper() else part
        if (names := _LIST_OF.get(title)) is not None:
            new = names[c.replace(names.index(title), len(names), names[0].encode())]
            out.append(new.upper() if title != part else new)
        elif re.fullmatch(f"[{_HAN}]+", part):
            out.append(_han(c, part))
        elif len(part) == 1 or part in PARTICLES or not part:
            out.append(in_format(c, "initial", part) if part.isupper() else part)
        else:
            out.append(_family(c, part))
    return "".join(out)


def _address(c: Cipher, text: str) -> str:
    """Digits become digits; words that say which kind of street it is stay."""
    parts = re.split(r"(\d+)|(\W+)", text)
    kept = re.compile(rf"(?:{_STREETS}|{'|'.join(sorted(PARTICLES))})$")

    def one(x: str) -> str:
        if x[:1].isdigit():
            return in_format(c, "house", x)
        if (inner := re.fullmatch(r"(\w{2,}?)(straße|strasse|gasse|weg|platz|allee)", x)) is not None:
            return _family(c, inner[1]) + inner[2]
        return x if len(x) < 2 or kept.match(x) or not x[0].isalpha() else _family(c, x)

    return "".join(one(x) for x in parts if x)


_LOWER = "a-zß-öø-ÿĀ-žа-яёіїєά-ώ"
_CAPITAL = rf"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁІЇЄΑ-Ω](?:['’][A-ZÀ-Þ])?[{_LOWER}]+(?:[A-Z][a-z]+)?"
_WORD = rf"{_CAPITAL}(?:-{_CAPITAL})*"
_INITIAL = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]\."
_UPPER = r"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁІЇЄΑ-Ω]{2,}(?:[-'’][A-ZÀ-ÖØ-ÞА-ЯЁ]{2,})?"
_REST = rf"(?: (?:(?:{'|'.join(sorted(PARTICLES))}) ){{0,2}}{_WORD}| {_INITIAL}(?= (?:{_INITIAL}|{_WORD})))"
_NAMES = "|".join(sorted(_LIST_OF, key=len, reverse=True))
# Titles, words that introduce a person, words that follow one, and endings of family names.
_TITLES = (
    r"(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Sir|Lady|Lord|Professor|Doctor|Captain|Judge|Signora?|Sig|Senhora?|Doña|Pani?|Mevrouw|Meneer|Dhr"
    r"|MRS?|MS|MISS|DR|PROF|HERR|FRAU|[Гг]-н|[Гг]-жа|[Гг]осподин|[Гг]оспожа|[Дд]октор|[Пп]рофессор|Κύριος|Κυρία|κύριος|κυρία|[Κκ]|κος|κα)\.? "
)
_CUES = r"(?:(?i:my name is|name is|mein name ist|ich heiße|je m'appelle|me llamo|mi nombre es|меня зовут|signed by|written by|full name:|name:|nom:|nombre:|имя:|attn:?|sincerely,|regards,|dear|contact)\s)"
_DOES = r"(?:said|says|wrote|writes|told|asked|agreed|replied|called|lives|works|signed|was born|sagte|schrieb|wohnt|arbeitet|habite|travaille|dijo|escribió|vive|trabaja|сказал|сказала|написал|написала|живёт)"
_KIN = r"(?:son|sen|berg|stein|mann|sson|ova|eva|ov|ev|sky|ski|ska|ez|escu|yan|idis|poulos|oglu|enko|chuk|vić|vic|shvili|ова|ева|ов|ев|ский|ская|енко)"
_PERSON = rf"(?:(?:(?:{'|'.join(sorted(PARTICLES))}) ){{0,2}}{_WORD}|{_INITIAL}(?= )){_REST}{{0,5}}"
_CHINESE = rf"(?<![{_HAN}])[{HAN_FAMILY}][{_HAN}]{{1,2}}(?![{_HAN}])|[{HAN_FAMILY}][{_HAN}]{{0,2}}(?=先生|女士|小姐|教授|博士|老师|医生)"
_STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Boulevard|Blvd|Drive|rue|avenue|boulevard|place|calle|Calle|avenida|plaza"
_MENTION = re.compile(rf"(?<![\w])(?:{_CAPITAL}|{_UPPER})(?![\w])")
_CASES = re.compile("(?<=[бвгджзклмнпрстфхцчшщ])(?:а|у|ым|ой|е|ы|ых|ыми|ом|ого|ому|ую|ий|ая|им)$")

#: Kind, pattern (the group ``v`` is replaced, or all) and surrogate; earlier kinds win where two begin at one place.
KINDS = (
    ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", _email),
    ("key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", _key),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)(?P<v>[^\s\"',;]{4,}?)(?=[\"',;.]*(?:\s|$|[\"',;]))", _secret),
    ("hex", r"\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}\b", _hex),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", _iban),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)|(?<![\w.:/-])0\d{2,4}[ /]\d{3,4}(?: ?\d{3,5})(?!\d|\.\d)|(?<![\w.:/-])1[3-9]\d{9}(?!\d|\.\d)", _phone),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", lambda c, t: in_format(c, "ssn", t)),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)", _ip),
    ("ipv6", r"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])", _ipv6),
    ("passport", r"(?i:\bpassport(?: (?:no|number|nr))?\.?\s*[:#]?\s+)(?P<p>[A-Z]{0,2}\d{6,9}\b)", lambda c, t: in_format(c, "passport", t)),
    ("card", r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)", _card),
    ("address", rf"\b\d{{1,5}} (?:{_WORD} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Boulevard|Blvd|Drive)\b|\b\d{{1,5}},? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la) ){{0,2}}{_WORD}|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse) \d{{1,4}}\b|\b(?:[Cc]alle|[Aa]venida) (?:(?:de|del|la) ){{0,2}}{_WORD},? \d{{1,4}}\b", _address),
    ("birth", r"(?i:\b(?:born|date of birth|dob|birthday|geboren|geburtsdatum|née?|nacid[oa]|fecha de nacimiento|дата рождения|родил(?:ся|ась))\b[^\d\n]{0,12})(?P<d>\d{1,2}([./-])\d{1,2}\2\d{2,4}|\d{4}-\d{1,2}-\d{1,2})(?![\d-])".replace(r"([./-])", r"(?P<sep>[./-])").replace(r"\2", "(?P=sep)"), _birth),
    ("name", rf"\b(?:(?:{_TITLES}|{_CUES}(?={_CAPITAL} {_CAPITAL}))(?P<w>{_PERSON}|{_UPPER}(?: {_UPPER}){{0,3}})|(?:{_NAMES}){_REST}{{1,5}}|(?:{_NAMES.upper()}) {_UPPER}(?: {_UPPER}){{0,2}}|{_CAPITAL} {_WORD}(?= {_DOES}\b)|{_CAPITAL} [A-ZА-ЯЁ][{_LOWER}]{{2,}}{_KIN})(?!\w)|{_CHINESE}", _name),
)

_MADE = {kind: make for kind, _, make in KINDS}
_OTHERS = re.compile("|".join(f"(?P<k_{kind}>{pattern})" for kind, pattern, _ in KINDS[:-1])).search
_NAMED = re.compile(KINDS[-1][1]).match
_TRACE = re.compile(r"[0-9@]|[=:]").search
# Where a name may begin: a capital whose word another one follows, words that introduce a name (small letters), Chinese.
_TWO = re.compile(rf"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁІЇЄΑ-Ω](?=[\w'’-]*\.? (?:(?:{'|'.join(sorted(PARTICLES))}) ){{0,2}}[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁІЇЄΑ-Ω])").finditer
_SMALL = ("name", "ich heiße", "appelle", "me llamo", "nombre", "зовут", "signed", "written", "nom:", "имя", "attn", "sincerely", "regards", "dear", "contact", "г-", "госп", "доктор", "профессор", "κ")
_INTRODUCED = re.compile(rf"(?<!\w)(?:{_CUES}|{_TITLES})").finditer
_FAMILY_HAN = re.compile(f"[{HAN_FAMILY}](?=[{_HAN}])").finditer
#: Kinds whose values are the same in any case.
FOLDED = ("name", "ipv6")


def stem(word: str) -> str:
    """A Cyrillic word of five letters or more without the ending of its case; other words as they are."""
    return _CASES.sub("", word) if len(word) > 4 and "а" <= word[1] <= "я" else word


def canonical(kind: str, value: str) -> str:
    """What tells values apart: names and IPv6 addresses that differ in case alone are one."""
    return value.lower() if kind in FOLDED else value


def detect(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the entities of a text, in its order and disjoint."""
    found = []
    starts = [m.start() for m in _TWO(text)]
    low = text.lower()
    if any(w in low for w in _SMALL):
        starts += [m.start() for m in _INTRODUCED(text)]
    if not text.isascii():
        starts += [m.start() for m in _FAMILY_HAN(text)]
    starts.sort(reverse=True)

    def named(at: int):
        while starts:
            if (k := starts.pop()) >= at and (m := _NAMED(text, k)):
                return m
        return None

    others, at = bool(_TRACE(text)), 0
    other, name = _OTHERS(text) if others else None, named(0)
    while other or name:
        # the first of both; what overlaps it is looked for again behind it
        if other and (not name or other.start() <= name.start()):
            m, kind = other, other.lastgroup if other.lastgroup.startswith("k_") else next(g for g, v in other.groupdict().items() if v is not None and g.startswith("k_"))
            inner = {"k_secret": "v", "k_passport": "p", "k_birth": "d"}.get(kind)
            group = inner if inner and m.groupdict().get(inner) is not None else 0
        else:
            m, kind, group = name, "k_name", "w" if name["w"] is not None else 0
        found.append((kind[2:], *m.span(group)))
        at = m.end()
        if other and other.start() < at:
            other = _OTHERS(text, at)
        if name and name.start() < at:
            name = named(at)
    names = [text[a:b] for kind, a, b in found if kind == "name"]
    words = {w for name in names for cut in (r" ", r"[ \-]", r"[ \-.'’]") for w in re.split(cut, name) if len(w) > 1 and w[0].isupper()}
    stems = {stem(w) for w in words}
    if any(text.count(w) > sum(n.count(w) for n in names) for w in stems | {w.upper() for w in words} | {w.capitalize() for w in words}):
        # the same words by themselves, between what has been found
        ends = [0, *(b for _, _, b in found)]
        starts = [*(a for _, a, _ in found), len(text)]
        found += [("name", m.start(), m.end()) for a, b in zip(ends, starts, strict=True) for m in _MENTION.finditer(text, a, b) if m[0] in words or stem(m[0]) in stems or len(m[0]) > 2 and m[0].isupper() and m[0].capitalize() in words or m[0].upper() in words]
        found.sort(key=lambda x: x[1])
    yield from found


class Replacer:
    """Replaces entities under one key; remembers the surrogates of recent values."""

    def __init__(self, key: bytes):
        self.key, self.cipher, self.known, self.owner = key, Cipher(key), {}, {}

    def surrogate(self, kind: str, value: str) -> str:
        if (found := self.known.get((kind, value))) is None:
            if len(self.known) > 100_000:
                self.known.clear()
                self.owner.clear()
            found = self.known[kind, value] = _MADE[kind](self.cipher, value)
            if self.owner.setdefault((kind, canonical(kind, found)), canonical(kind, value)) != canonical(kind, value):
                found = self.known[kind, value] = f"[{kind} {self.value_id(kind, value)}]"
        return found

    def value_id(self, kind: str, value: str) -> str:
        return hmac.digest(self.key, b"value|" + canonical(kind, value).encode("utf-8", "surrogatepass"), "sha256")[:16].hex()

    def text(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and kind, start, end (in the given text) and surrogate of each entity."""
        found = [(kind, a, b, self.surrogate(kind, text[a:b])) for kind, a, b in detect(text)] if text else []
        if not found:
            return text, found
        out, at = [], 0
        for _, a, b, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), found


@lru_cache(maxsize=2)
def replacer(key: bytes) -> Replacer:
    return Replacer(key)


def surrogates(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_col`` with surrogates, and entities (kind, start, end, surrogate, value_id); one narrow pass.

    A value_id is a keyed digest of the value: it tells values apart without telling them.
    """
    names = ("kind", "start", "end", "surrogate", "value_id")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string()), ("value_id", pa.string())]))

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replacer(key)
        for batch in source:
            old = batch.column(1).to_pylist()
            done = [own.text(t) for t in old]
            where = [[dict(zip(names, (*x, own.value_id(x[0], t[x[1] : x[2]])), strict=True)) for x in found] for t, (_, found) in zip(old, done, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(where, span)], ["id", "body", "entities"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    out = rows.mapInArrow(batches, f"id {kind}, body string, entities array<struct<kind:string,start:bigint,end:bigint,surrogate:string,value_id:string>>")
    return out.select(F.col("id").alias(id_col), F.col("body").alias(text_col), "entities")


def replace_text(docs: DataFrame, key: bytes = KEY, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``length_col``, if there is one, follows the new text; other columns stay."""
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replacer(key)
        for batch in source:
            old = batch.column(at).to_pylist()
            new = [own.text(t)[0] for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(length).to_pylist(), old, new, strict=True)]
                columns[length] = pa.array(sizes, batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(giving_back(batches), docs.schema)


def collisions(rows: DataFrame) -> DataFrame:
    """Surrogates of :func:`surrogates`' ``rows`` that stand for two values or more, and values with two surrogates: none.

    Least and greatest are combined in each task before the shuffle, so a frequent value is no burden.
    """
    e = rows.select(F.explode("entities").alias("e")).select("e.kind", _folded("e.kind", "e.surrogate").alias("surrogate"), "e.value_id")
    clash = lambda one, other: e.groupBy("kind", F.col(one).alias("shared")).agg(F.min(other).alias("least"), F.max(other).alias("greatest")).where("least <> greatest")
    return clash("surrogate", "value_id").unionByName(clash("value_id", "surrogate"))


def _folded(kind: str, value: str) -> Column:
    return F.when(F.col(kind).isin(*FOLDED), F.upper(value)).otherwise(F.col(value))


def quarantine(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """``rows`` with ``quarantined``, which is true, and the text null, where an entity's value or surrogate is among ``clashes``."""
    marked = rows.withColumn("row_", F.expr("uuid()"))
    marked = materialize(marked, "marked")
    e = marked.select("row_", F.explode("entities").alias("e")).select("row_", "e.kind", F.explode(F.array(_folded("e.kind", "e.surrogate"), "e.value_id")).alias("shared"))
    bad = e.join(clashes.select("kind", "shared").distinct(), ["kind", "shared"]).select("row_").distinct().withColumn("bad_", F.lit(True))
    found = marked.join(bad, "row_", "left").withColumn("quarantined", F.coalesce("bad_", F.lit(False)))
    return found.withColumn("text", F.when(~F.col("quarantined"), F.col("text"))).select(*rows.columns, "quarantined")


def op4_pii_surrogates(spark, sf_dir):
    """All documents with surrogates for personal data and credentials, and where they stand; rows with values that share a surrogate
    are marked, and their texts kept back."""
    rows = materialize(surrogates(table(spark, sf_dir, "documents")), "surrogates")
    clashes = collisions(rows)
    return rows.withColumn("quarantined", F.lit(False)) if clashes.isEmpty() else quarantine(rows, clashes)
