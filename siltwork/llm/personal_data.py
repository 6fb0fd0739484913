"""Personal data in free text: found by validated patterns, replaced by linked pseudonyms.

Numbers and birth dates are brought to one notation and permuted within their format by a keyed
Feistel network, with cycle walking where a format isn't a power of ten: what has valid check
digits goes to what has them, what hasn't to what hasn't. So a value has the same pseudonym in
every document, however it was written, no two values share one, and the key restores it. Values
without such a format (names, addresses, mail addresses) get a keyed tag of 128 bits of their
normal form. Each replacement is a typed placeholder. Texts are worked on whole, row by row, with
nothing shuffled, in time that is linear in their length.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "id_number", "phone", "address", "name")

# --- Keyed permutation ------------------------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, half: str, width: int) -> int:
    data = tweak + bytes([i]) + half.encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=16).digest(), "big") % 10**width


def feistel(digits: str, key: bytes, tweak: bytes = b"", rounds: int = 8, inverse: bool = False) -> str:
    """A permutation of the digit strings of one length (alternating unbalanced Feistel).

    A single digit is shifted by a keyed amount; the empty string stays.
    """
    n = len(digits)
    if n < 2:
        if not n:
            return digits
        shift = _round(key, tweak, 0, "", 1)
        return str((int(digits) + (-shift if inverse else shift)) % 10)
    u = n // 2
    left, right = digits[:u], digits[u:]
    for i in reversed(range(rounds)) if inverse else range(rounds):
        if i % 2 == 0:
            f = _round(key, tweak, i, right, u)
            left = f"{(int(left) + (-f if inverse else f)) % 10**u:0{u}d}"
        else:
            w = n - u
            f = _round(key, tweak, i, left, w)
            right = f"{(int(right) + (-f if inverse else f)) % 10**w:0{w}d}"
    return left + right


def snils_check(nine: str) -> str:
    """The two check digits of an insurance number."""
    return f"{sum(int(d) * w for d, w in zip(nine, range(9, 0, -1))) % 101 % 100:02d}"


# Weights of the check digits of tax numbers.
_INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
_INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
_INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def inn_check(body: str) -> str:
    """Check digits of a tax number from its first nine or ten digits."""
    weigh = lambda s, ws: str(sum(int(d) * w for d, w in zip(s, ws)) % 11 % 10)
    if len(body) == 9:
        return weigh(body, _INN10)
    first = weigh(body, _INN11)
    return first + weigh(body + first, _INN12)


def luhn_check(body: str) -> str:
    """The check digit of a policy number."""
    doubled = [int(d) * (2 if i % 2 == 0 else 1) for i, d in enumerate(reversed(body))]
    return str(-sum(x - 9 if x > 9 else x for x in doubled) % 10)


# Length, digits before the check digits, and their rule, of numbers that have them.
_CHECKED = {11: (9, snils_check), 10: (9, inn_check), 12: (10, inn_check), 16: (15, luhn_check)}


def is_checked(digits: str) -> bool:
    """Whether the check digits of an insurance, tax or policy number are right."""
    body, check = _CHECKED.get(len(digits), (0, None))
    return check is not None and digits[body:] == check(digits[:body])


def walk(digits: str, key: bytes, tweak: bytes, inside: Callable[[str], bool], inverse: bool = False) -> str:
    """A permutation of those digit strings of one length that are ``inside`` (cycle walking)."""
    while True:
        digits = feistel(digits, key, tweak, inverse=inverse)
        if inside(digits):
            return digits


def permute_index(x: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A permutation of 0..size-1."""
    width = len(str(size - 1))
    return int(walk(f"{x:0{width}d}", key, tweak, lambda d: int(d) < size, inverse))


def permute_number(digits: str, key: bytes, kind: str, inverse: bool = False) -> str:
    """The pseudonym of a number of a kind, of the same length. Numbers with right check digits and
    those without are permuted each among themselves."""
    tweak = kind.encode()
    if kind == "id_number" and len(digits) in _CHECKED:
        body, check = _CHECKED[len(digits)]
        if is_checked(digits):
            new = feistel(digits[:body], key, tweak + b"+", inverse=inverse)
            return new + check(new)
        return walk(digits, key, tweak + b"-", lambda d: not is_checked(d), inverse)
    return feistel(digits, key, tweak, inverse=inverse)


def permute_lettered(value: str, key: bytes, inverse: bool = False) -> str:
    """The pseudonym of Latin capitals followed by digits: as many of each."""
    letters = re.match("[A-Z]*", value).group()
    n, m = len(letters), len(value) - len(letters)
    x = 0
    for c in letters:
        x = x * 26 + ord(c) - 65
    x = permute_index(x * 10**m + int(value[n:] or 0), 26**n * 10**m, key, f"id_number{n}".encode(), inverse)
    x, rest = divmod(x, 10**m)
    out = ""
    for _ in range(n):
        x, c = divmod(x, 26)
        out = chr(65 + c) + out
    return out + (f"{rest:0{m}d}" if m else "")


def _is_nanp(d: str) -> bool:
    return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"


def permute_phone(digits: str, key: bytes, inverse: bool = False) -> str:
    """The pseudonym of the digits of a phone number with its country code. All digits of a number
    of the countries +7 and +1 change but that code, of other countries all."""
    if len(digits) == 11 and digits[0] == "7":
        return "7" + feistel(digits[1:], key, b"phone7", inverse=inverse)
    if digits[:1] == "1" and _is_nanp(digits[1:]):
        return "1" + walk(digits[1:], key, b"phone1", _is_nanp, inverse)
    other = lambda d: d[0] != "0" and not (len(d) == 11 and d[0] == "7") and not (d[0] == "1" and _is_nanp(d[1:]))
    if not digits or digits[0] == "0":
        return walk(digits, key, b"phone0", lambda d: d[:1] in ("", "0"), inverse)
    return walk(digits, key, b"phone", other, inverse)


def permute_date(day: datetime.date, key: bytes, first: datetime.date, last: datetime.date, inverse: bool = False) -> datetime.date:
    """A date between ``first`` and ``last`` for each date there (cycle walking); others stay."""
    span = (last - first).days + 1
    x = (day - first).days
    return first + datetime.timedelta(days=permute_index(x, span, key, b"date", inverse)) if 0 <= x < span else day


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9" or c.isdecimal())


# --- Detection --------------------------------------------------------------------------------

# Ends of file names that look like the end of a mail domain.
_FILES = {"png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "pdf", "js", "css", "html", "php", "txt", "csv", "zip", "ico"}
_AT = r"(?:\s?@\s?|\s?[\(\[]\s?(?:at|собака|эт)\s?[\)\]]\s?|\s(?:собака)\s)"
_DOT = r"(?:\.|\s?[\(\[]\s?(?:dot|точка)\s?[\)\]]\s?|\s(?:точка)\s)"
_EMAIL = re.compile(rf"(?i)(?<![\w.+%-])[a-z0-9_%][a-z0-9._%+-]*{_AT}([a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{0,8}}?{_DOT}([a-z]{{2,24}}))(?![\w@])")

_NO = r"(?:\s*(?:№|no\.?|number|номер|n)\s*)?"
_BARE_SNILS = re.compile(r"(?<![\w-])\d{3}-\d{3}-\d{3}[ -]\d{2}(?![\w-])")
_IDS = [
    _BARE_SNILS,
    re.compile(rf"(?i)\bснилс\w*\W{{0,3}}{_NO}(\d{{3}}[ -]?\d{{3}}[ -]?\d{{3}}[ -]?\d{{2}})(?!\w)"),
    re.compile(rf"(?i)\bинн\W{{0,3}}{_NO}(\d{{12}}|\d{{10}})(?!\w)"),
    re.compile(rf"(?i)\bполис\w*(?:\s+омс)?\W{{0,3}}{_NO}(\d{{4}} ?\d{{4}} ?\d{{4}} ?\d{{4}})(?!\w)"),
    re.compile(r"(?i)\bомс\W{0,3}(\d{4} ?\d{4} ?\d{4} ?\d{4})(?!\w)"),
    re.compile(r"(?i)\bпаспорт\w*\W{0,3}(?:серия\W{0,2})?(\d{2} ?\d{2}\W{0,3}(?:номер|№|n|no\.?)?\W{0,3}\d{6})(?!\w)"),
    re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    re.compile(rf"(?i)\b(?:ssn|social security)\W{{0,2}}{_NO}\W{{0,2}}(\d{{3}}[ -]?\d{{2}}[ -]?\d{{4}})(?!\w)"),
    re.compile(rf"(?i)\b(?:passport|id[ -]card|identity card|personalausweis\w*|ausweis\w*|reisepass)\W{{0,2}}{_NO}\W{{0,2}}([a-z]{{1,2}} ?\d{{6,9}}|\d{{8,10}})(?!\w)"),
]
_ID_CUE = re.compile(r"(?i)снилс|инн|полис|омс|паспорт|ssn|social|passport|card|ausweis|reisepass|\d{3}-\d\d")

_BEFORE, _AFTER = r"(?<![\w+])(?<!\d[-./:,])(?<![A-Za-zА-Яа-яЁё][-/:])", r"(?!\w)(?![-.:,/]\d)"
_PHONES = [
    re.compile(rf"{_BEFORE}(?:\+\s?)?[78][ \xa0.\-]?\(?\d{{3}}\)?[ \xa0.\-]?\d{{3}}[ \xa0.\-]?\d{{2}}[ \xa0.\-]?\d{{2}}{_AFTER}"),
    re.compile(rf"{_BEFORE}\+\s?[1-9]\d{{0,2}}[ \xa0.\-]?\(?\d{{1,4}}\)?(?:[ \xa0.\-]?\d{{2,6}}){{1,4}}{_AFTER}"),
    re.compile(rf"{_BEFORE}(?:\([2-9]\d{{2}}\)[ \xa0]?|[2-9]\d{{2}}[ \xa0.\-]?)[2-9]\d{{2}}[ \xa0.\-]?\d{{4}}{_AFTER}"),
]
_NOT_PHONE = re.compile(
    r"(?i)(?:account|сч[её]т\w*|договор\w*|contract|прибор\w*|счётчик\w*|штрих-?код\w*|barcode|заявк\w*|заказ\w*|ticket|order|meter"
    r"|снилс|инн|полис\w*|омс|паспорт\w*|passport|card|объект\w*|код\w*|чек\w*|квитанци\w*|инвентарн\w*|рейс\w*|маршрут\w*)"
    r"\W*(?:№|no\.?|number|номер)?\W*$"
)

_H = r"[^\S\n\r]"  # white space within a line
_TYPE = (
    r"(?:ул(?:иц[аеыу]|ицей)?|наб(?:ережн(?:ая|ой|ую))?|алле[яеию]|пр-д|проезд[ае]?|пер(?:еул(?:ок|ке|ка))?|пр-т|просп(?:ект[ае]?)?"
    r"|пл(?:ощад[ьи])?|б-р|бульвар[ае]?|ш(?:оссе)?|тупик[ае]?)(?![а-яё])\.?"
)
_HOUSE = rf"(?:д(?:ом)?(?![а-яё])\.?{_H}?)?(?:№{_H}?)?\d{{1,3}}(?![\d]|[.,:]\d)(?:{_H}?[а-я](?![а-яё.]))?(?:/\d{{1,3}}[а-я]?(?!\w))?"
_MORE = (
    rf"(?:,?{_H}?(?:корп(?:ус)?|к|стр(?:оение)?|лит(?:ера)?)(?![а-яё])\.?{_H}?\d{{1,3}}[а-я]?(?!\w))?"
    rf"(?:{_H}?-{_H}?\d{{1,4}}(?!\w))?(?:,?{_H}?(?:кв(?:артира)?|подъезд|под|эт(?:аж)?|оф(?:ис)?|помещ\w*)(?![а-яё])\.?{_H}?\d{{1,4}}(?!\w))*"
)
_TOWN = rf"(?:г(?:ород)?\.?{_H}?[а-яё-]{{3,}},?{_H})?"
_ADJ = r"[а-яё]{2,}(?:-[а-яё]+)?(?:ая|яя|ой|ей|ую|юю)"
_ADDRESSES = [
    re.compile(rf"(?i)(?<![а-яё-]){_TOWN}{_TYPE}{_H}?(?:[а-яё-]{{2,}}{_H}?,?|(?:[а-яё-]{{2,}}{_H}){{1,2}}[а-яё-]{{2,}}{_H}?,){_H}{{0,2}}{_HOUSE}{_MORE}"),
    re.compile(rf"(?i)(?<![а-яё-]){_TOWN}{_ADJ}{_H}{_TYPE}{_H}?,?{_H}?{_HOUSE}{_MORE}"),
    re.compile(rf"(?i)(?<![а-яё-])({_ADJ}),?{_H}{{1,2}}{_HOUSE}{_MORE}"),
]
# Words with the ending of a street's name that are none.
_NO_STREET = {
    "второй", "какой", "такой", "каждой", "одной", "другой", "самой", "третьей", "первой", "любой", "горячей", "холодной",
    "новой", "старой", "этой", "той", "моей", "нашей", "вашей", "своей", "всей", "открытой", "маршрутной",
}
_EN_STREET = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|square|sq|way|boulevard|blvd|terrace|close)"
_EN_ADDRESS = re.compile(
    rf"(?i)\b(?:(?:flat|apt|apartment|unit|suite)\.?\s?\d{{1,4}}[a-z]?,?\s)?\d{{1,4}}[a-z]?,?\s(?:[a-z][a-z'-]+\s){{1,3}}{_EN_STREET}\b\.?"
    rf"(?:,?\s?(?:flat|apt|apartment|unit|suite)\.?\s?\d{{1,4}}[a-z]?\b)?"
)
_DE_ADDRESS = re.compile(r"(?i)\b[a-zäöüß-]{3,}(?:straße|strasse|str\.|weg|platz|allee|gasse)\s\d{1,4}\s?[a-z]?\b(?![\w-])")

# Common given names, in the nominative; their cases come from rules.
_GIVEN_RU = (
    "александр александра алексей алина алиса алла алёна анастасия анатолий ангелина андрей анна антон антонина аркадий арсений "
    "артём артемий артур богдан борис вадим валентин валентина валерий валерия варвара василий василиса вера вероника виктор виктория "
    "виталий владимир владислав владислава всеволод вячеслав галина геннадий георгий герман глеб григорий давид дарья данил данила "
    "даниил демид денис диана дмитрий евгений евгения егор екатерина елена елизавета ефим захар зинаида злата зоя иван игнат игорь "
    "илья инна ирина ия карина кира кирилл клавдия константин ксения лариса лев леонид лидия лилия любовь людмила макар максим марат "
    "маргарита марина мария марк матвей милана мирон михаил надежда назар наталья наталия никита николай нина оксана олег олеся ольга "
    "павел пётр петр полина прохор раиса регина родион роман руслан савва савелий семён сергей снежана софия софья станислав степан "
    "таисия тамара тарас татьяна тимофей тимур тихон ульяна фаина фёдор филипп эдуард элина эльвира эмма эмилия юлия юрий яков яна ярослав"
).split()
_GIVEN_EN = (
    "adam agnes albert alice amy andrew anna arthur ben bruno carl casper charles clara daniel david dora edith edward ella emma "
    "eric ethan felix florence frank george gloria grace greta harold harry helen henry hugo ida ingrid ivy jack jacob james jane "
    "john joseph julia karl kate kevin laura leo linda lucas lucy mabel maria mark martha martin mary max michael mona nina nora oliver "
    "oren oscar otto paul peter philip rachel ralph richard robert rose rufus ruth samuel sarah silas simon sofia stella susan theodore "
    "thomas tobias victor walter wanda wilma william"
).split()


def _cases(name: str) -> set[str]:
    """The grammatical cases of a given name, by its ending."""
    out = {name}
    if name.endswith("ия") or name.endswith("ья") or name.endswith("оя"):
        out |= {name[:-1] + e for e in ("и", "ю", "ей", "е", "ею")}
    elif name.endswith("а"):
        out |= {name[:-1] + e for e in ("ы", "и", "е", "у", "ой", "ою")}
    elif name.endswith("я"):
        out |= {name[:-1] + e for e in ("и", "е", "ю", "ей")}
    elif name.endswith("й"):
        out |= {name[:-1] + e for e in ("я", "ю", "ем", "е", "и")}
    elif name.endswith("ь"):
        out |= {name[:-1] + e for e in ("я", "ю", "ем", "е", "и", "ью")}
    else:
        out |= {name + e for e in ("а", "у", "ом", "е")}
    irregular = {"лев": "льв", "павел": "павл", "пётр": "петр"}
    if name in irregular:
        out |= {irregular[name] + e for e in ("а", "у", "ом", "е")}
    return out


_GIVEN = {form for name in _GIVEN_RU for form in _cases(name)}
_GIVEN |= {x.replace("ё", "е") for x in _GIVEN} | set(_GIVEN_EN)
_PATRONYMIC = re.compile(r"(?i)^[а-яё]{3,}(?:(?:ов|ев|ьев)ич(?:а|у|ем|е)?|(?:ов|ев|ьев|ин)н(?:а|ы|е|у|ой|ою)|иничн(?:а|ы|е|у|ой)|ич(?:а|у|ом|ем|е)?)$")
_SURNAME = re.compile(r"(?i)^[а-яё-]{2,}(?:(?:ов|ев|ёв|ин|ын)(?:а|у|ым|е|ой|ою|ы|ых)?|(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую)|(?:енко|чук|юк|дзе|швили|ян|ых|их))$")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_NOT_SURNAME = {"слов", "один", "один-то", "готов", "снова", "слова", "такая", "детский", "детского", "городской", "ключев"}
_INITIALS = [
    re.compile(r"(?<![\w.])(?:[А-ЯЁ]\.\s?){1,2}([А-ЯЁ][А-Яа-яЁё-]{2,})"),
    re.compile(r"(?<![\w-])([А-ЯЁа-яё][А-Яа-яЁё-]{2,}),?\s[А-ЯЁа-яё]\.\s?[А-ЯЁа-яё]\."),
    re.compile(r"(?<![\w.])[а-яё]\.\s?[а-яё]\.\s?([а-яё-]{4,})"),
    re.compile(r"(?<![\w-])([А-ЯЁ][А-Яа-яЁё-]{2,})\s[А-ЯЁ]\.(?!\s?[А-ЯЁа-яё]\.)"),
]
_EN_NAME = re.compile(
    r"(?:(?i:my name is|yours,|yours truly,|sincerely,|regards,|signed,|mr\.?|mrs\.?|ms\.?|dr\.?))\s+"
    r"((?:[A-Z]\.\s?){1,2}[A-Z][A-Za-z'-]+|[A-Z][A-Za-z'-]+,\s[A-Z][A-Za-z'-]+(?:\s[A-Z]\.)?|[A-Z][A-Za-z'-]+\s(?:[A-Z]\.\s?)?[A-Z][A-Za-z'-]+)"
    r"|(?:(?i:my name is|yours,))\s+([a-z][a-z'-]+,?\s(?:[a-z]\.\s?)?[a-z][a-z'-]+|[a-z]\.\s?[a-z][a-z'-]+)"
)


# Cheap searches that decide whether the costly ones can find anything.
_LONG_NUMBER = re.compile(r"\d[\d ()\-.\xa0]{7,}\d")
_HOUSE_CUE = re.compile(r"[а-яё]\.?\s?,?\s{0,2}(?:д(?:ом)?\.?\s?)?(?:№\s?)?\d{1,3}(?!\d)")
_EN_STREET_CUE = re.compile(rf"[a-z'-]\s{_EN_STREET}\b")
_DE_STREET_CUE = re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse)\s\d")
_EN_CUE = re.compile(r"my name is|yours|sincerely|regards|signed|\bm(?:r|rs|s)\b|\bdr\b")
_EN_PAIR = re.compile(r"\b([A-Z][a-z]+)\s(?:[A-Z]\.\s?)?([A-Z][a-z]{2,})\b")
_INITIAL_CUE = re.compile(r"(?<!\w)[А-ЯЁа-яё]\.")


def _names_ru(text: str, low: str) -> Iterator[tuple[int, int]]:
    if not any(w in _GIVEN or "вич" in w or "вн" in w or "ич" in w for w in _WORD.findall(low)):
        return
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    lows = [w.lower() for _, _, w in words]
    given = [w in _GIVEN for w in lows]
    used = -1
    for i, w in enumerate(lows):
        father = len(w) > 5 and ("вн" in w or "ич" in w) and _PATRONYMIC.match(w) is not None
        if i <= used or not (given[i] or father):
            continue
        near = lambda a, b: text[words[a][1] : words[b][0]].strip(" \t\xa0    ") == ""
        capital = words[i][2][0].isupper()
        fits = lambda j: words[j][2][0].isupper() == capital and len(lows[j]) > 1
        surname = lambda j: fits(j) and lows[j] not in _NOT_SURNAME and _SURNAME.match(lows[j]) is not None
        first, last = i, i
        if father and not given[i]:
            # An unknown given name before a patronymic (that is no adjective).
            if i == 0 or w.endswith(("ой", "ою")) or len(lows[i - 1]) < 3 or not near(i - 1, i) or not fits(i - 1):
                continue
            first = i - 1
            found = True
            if first > 0 and near(first - 1, first) and surname(first - 1):
                first -= 1
            elif last + 1 < len(words) and near(last, last + 1) and surname(last + 1):
                last += 1
        else:
            found = False
            if i + 1 < len(words) and near(i, i + 1) and fits(i + 1) and _PATRONYMIC.match(lows[i + 1]):
                last, found = i + 1, True
            if i > 0 and i - 1 > used and near(i - 1, i) and surname(i - 1) and not given[i - 1]:
                first, found = i - 1, True
            elif last + 1 < len(words) and near(last, last + 1) and surname(last + 1):
                last, found = last + 1, True
        if found:
            used = last
            yield words[first][0], words[last][1]


def _names_initials(text: str) -> Iterator[tuple[int, int]]:
    for p in _INITIALS:
        for m in p.finditer(text):
            word = m.group(1)
            if word.lower() in _NOT_SURNAME or not _SURNAME.match(word):
                continue
            if word.isupper() and m.group().count(".") == 1 and m.group()[0] in "ГДПСШ" and m.group()[1] == ".":
                continue  # one capital before a word in capitals: an abbreviation of a place
            yield m.span()


def _names_en(text: str, low: str) -> Iterator[tuple[int, int]]:
    if _EN_CUE.search(low):
        for m in _EN_NAME.finditer(text):
            yield m.span(1) if m.group(1) else m.span(2)
    for m in _EN_PAIR.finditer(text):
        if m.group(1).lower() in _GIVEN:
            yield m.span()


def find_personal(text: str | None, dates: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every datum, in the order of the text; none overlap.

    Null and empty texts have none. Where two readings overlap, the kind named first in
    ``KINDS`` stands, then the earlier and longer one. With ``dates`` dates of birth are found too
    (kind ``date``). An insurance number without a word that says so must have right check digits;
    where one says so, a number mistyped is personal as well.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if "@" in text or "собака" in low or "(at" in low or "[at" in low or "( at" in low:
        found += [(0, *m.span()) for m in _EMAIL.finditer(text) if m.group(2).lower() not in _FILES]
    if _ID_CUE.search(text):
        for p in _IDS:
            found += [(1, *(m.span(1) if p.groups else m.span())) for m in p.finditer(text) if p is not _BARE_SNILS or is_checked(_digits(m.group()))]
    if _LONG_NUMBER.search(text):
        for p in _PHONES:
            for m in p.finditer(text):
                digits = sum(c.isdigit() for c in m.group())
                if not 9 <= digits <= 15 or (m.group().isdigit() and _NOT_PHONE.search(text[max(0, m.start() - 40) : m.start()])):
                    continue
                found.append((2, *m.span()))
    if _HOUSE_CUE.search(low):
        for p in _ADDRESSES:
            for m in p.finditer(text):
                if not p.groups or m.group(1).lower() not in _NO_STREET:
                    found.append((3, *m.span()))
    if _EN_STREET_CUE.search(low):
        found += [(3, *m.span()) for m in _EN_ADDRESS.finditer(text)]
    if _DE_STREET_CUE.search(low):
        found += [(3, *m.span()) for m in _DE_ADDRESS.finditer(text)]
    found += [(4, *s) for s in _names_en(text, low)]
    found += [(4, *s) for s in _names_ru(text, low)]
    if _INITIAL_CUE.search(text):
        found += [(4, *s) for s in _names_initials(text)]
    if dates and _BIRTH_CUE.search(low):
        found += [(5, *m.span("day" if m.group("day") else "before")) for m in _BIRTH.finditer(text) if birth_date(m.group("day") or m.group("before"))]
    taken: list[tuple[int, int, int]] = []  # in the order of the text
    for k, a, b in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        at = bisect.bisect(taken, (a, b, k))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b, k))
    return [(a, b, (*KINDS, "date")[k]) for a, b, k in taken]


# Months in the genitive, by the first letters that tell them apart.
_MONTHS = ("янв", "фев", "мар", "апр", "мая", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")
_DAY = r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s(?:янв|фев|мар|апр|мая|июн|июл|авг|сен|окт|ноя|дек)[а-я]{0,5}\s\d{4}"
_BIRTH_CUE = re.compile(r"рожд|родил|д\.\s?р\.|г\.\s?р\.|\bborn\b|birth|\bdob\b|\bgeb(?:\.|oren)")
_BIRTH = re.compile(
    rf"(?i)(?:рожд\w{{0,8}}|родил\w{{0,4}}|д\.\s?р\.|\bborn(?:\son)?|birth(?:\s?date)?|\bdob|\bgeb(?:\.|oren)(?:\sam)?)[\s:,–-]{{0,4}}(?P<day>{_DAY})(?!\d)"
    rf"|(?<![\d.])(?P<before>{_DAY})\s?(?:г\.\s?р\.|г(?:ода|\.)?\sрожд)"
)


def birth_date(text: str) -> datetime.date | None:
    """The date of 1900 to 2099 that a text writes, day before month; None if there is no such day."""
    parts = re.split(r"[./\s-]", text)
    if len(parts[0]) == 4:
        parts.reverse()
    month = next((i for i, m in enumerate(_MONTHS, 1) if parts[1].lower().startswith(m)), None) or int(parts[1]) if parts[1].isdigit() or parts[1] else 0
    try:
        day = datetime.date(int(parts[2]), int(month), int(parts[0]))
    except ValueError:
        return None
    return day if _FIRST <= day <= _LAST else None


_FIRST, _LAST = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
_CASE_END = re.compile(r"(?:[аеиоуыюяйь]|(?<=[оеыи])м|(?<=[ыио])х|(?<=[ое])го|(?<=[ое])му)+$")
# Names whose stem changes with the case.
_STEMS = {"павел": "павл", "лев": "льв"}
# Words of addresses that are written in several ways, by a pattern for each.
_ADDRESS_WORDS = [
    (re.compile(p), w)
    for p, w in (
        ("ул|улиц[аеыу]|улицей", "ул"), ("наб|набережн(?:ая|ой|ую)", "наб"), ("алле[яеию]", "аллея"), ("пр-д|проезд[ае]?", "проезд"), ("пер|переул(?:ок|ке|ка)", "пер"),
        ("пр-т|просп|проспект[ае]?", "проспект"), ("пл|площад[ьи]", "пл"), ("б-р|бульвар[ае]?", "бульвар"), ("ш|шоссе", "ш"), ("д|дом", ""), ("к|корп|корпус", "к"),
        ("стр|строение", "стр"), ("кв|квартира", "кв"), ("г|город", "г"), ("эт|этаж", "эт"), ("под|подъезд", "под"), ("лит|литера", "лит"), ("оф|офис", "оф"),
        ("street|st", "st"), ("avenue|ave", "ave"), ("road|rd", "rd"), ("lane|ln", "ln"), ("drive|dr", "dr"), ("court|ct", "ct"), ("square|sq", "sq"),
        ("boulevard|blvd", "blvd"), ("apartment|apt|flat", "apt"), ("straße|strasse|str", "str"),
    )
]


def _stem(word: str) -> str:
    """A Cyrillic word without its case ending; others as they are."""
    if not "а" <= word[0] <= "я" or len(word) < 3:
        return word
    stem = _CASE_END.sub("", word)
    return _STEMS.get(stem, stem) if len(stem) >= 2 else word


def normal_form(value: str, kind: str) -> str:
    """What the tag of a value without number format is taken of, so that spellings are linked.

    Mail addresses without the words for their marks; names as sorted stems, without case endings
    (which a man's and a woman's name of one stem share, unless a patronymic tells them apart);
    addresses with the words for their parts in one form and street names as stems.
    """
    low = value.lower().replace("ё", "е")
    if kind == "email":
        return re.sub(rf"(?i){_DOT}", ".", re.sub(rf"(?i){_AT}", "@", low))
    if kind == "name":
        return " ".join(sorted(_stem(w) for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", low)))
    words = []
    for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+", low):
        known = next((to for p, to in _ADDRESS_WORDS if p.fullmatch(w)), None)
        words.append(_stem(w) if known is None else known)
    return " ".join(w for w in words if w)


def _grouped(digits: str, sizes: tuple[int, ...], marks: str) -> str:
    out, at = "", 0
    for size, mark in zip(sizes, [*marks, ""]):
        out += digits[at : at + size] + mark
        at += size
    return out


def canonical_number(value: str, kind: str) -> str:
    """A phone number (``+`` and digits, or digits without a known country), an identity number
    (capitals and digits) or a date (ISO) in one notation."""
    if kind == "date":
        return birth_date(value).isoformat()
    digits = _digits(value)
    if kind == "id_number":
        return "".join(c for c in value.upper() if "A" <= c <= "Z") + digits
    if len(digits) == 11 and digits[0] in "78" and not ("+" in value and digits[0] == "8"):
        return "+7" + digits[1:]
    if "+" not in value and _is_nanp(digits):
        return "+1" + digits
    return ("+" if "+" in value else "") + digits


def permute_value(number: str, kind: str, key: bytes, inverse: bool = False) -> str:
    """The permuted number or date, both in their one notation."""
    if kind == "date":
        return permute_date(datetime.date.fromisoformat(number), key, _FIRST, _LAST, inverse).isoformat()
    if kind == "phone":
        return "+" + permute_phone(number[1:], key, inverse) if number.startswith("+") else feistel(number, key, b"phone-", inverse=inverse)
    return permute_lettered(number, key, inverse) if number[:1].isalpha() else permute_number(number, key, kind, inverse)


def pretty(number: str, kind: str) -> str:
    """A number as people write it."""
    if kind == "phone" and len(number) == 12 and number[:2] in ("+7", "+1"):
        return number[:2] + " " + (_grouped(number[2:], (3, 3, 2, 2), " --") if number[1] == "7" else _grouped(number[2:], (3, 3, 4), " -"))
    if kind == "id_number" and number.isdigit():
        groups = {11: ((3, 3, 3, 2), "-- "), 16: ((4, 4, 4, 4), "   "), 9: ((3, 2, 4), "--")}.get(len(number))
        return _grouped(number, *groups) if groups else number
    return number


def keyed_tag(text: str, kind: str, key: bytes) -> str:
    """128 bits of a text, in hexadecimal, that only the key tells."""
    return hashlib.blake2b(f"{kind}\x00{text}".encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The typed placeholder of a datum; equal values, however written, get equal ones."""
    if kind in ("phone", "id_number", "date"):
        return f"[{kind} {pretty(permute_value(canonical_number(value, kind), kind, key), kind)}]"
    return f"[{kind} {keyed_tag(normal_form(value, kind), kind, key)}]"


_PLACEHOLDER = re.compile(r"\[(phone|id_number|date) ([+0-9A-Z -]+)\]")


def restore(text: str, key: bytes) -> str:
    """The numbers and dates of a redacted text, in their one notation; tags stay."""

    def back(m: re.Match) -> str:
        kind, number = m.groups()
        number = number if kind == "date" else re.sub(r"[ -]", "", number)
        return pretty(permute_value(number, kind, key, inverse=True), kind)

    return _PLACEHOLDER.sub(back, text)


def redact(text: str | None, key: bytes) -> str | None:
    """The text with every datum replaced; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_personal(text, dates=True):
        out += [text[at:a], pseudonym(text[a:b], kind, key)]
        at = b
    return "".join(out) + text[at:]


# --- Operators --------------------------------------------------------------------------------


def personal_occurrences(df: DataFrame, *, id_col: str, text_col: str = "text") -> DataFrame:
    """``rec_id``, ``kind``, ``occ``, ``start_pos``, ``end_pos``: a row for each datum.

    ``occ`` counts from 1 within a row and kind; positions are code points. Null and empty texts
    have no row; repeated rows each have theirs; an empty table gives an empty table.
    """
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL AND t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for rec, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen = dict.fromkeys(KINDS, 0)
                for start, end, kind in find_personal(text.as_py()):
                    seen[kind] += 1
                    for c, v in zip(cols, (rec, kind, seen[kind], start, end)):
                        c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["rec_id", "kind", "occ", "start_pos", "end_pos"])

    return source.mapInArrow(run, "rec_id long, kind string, occ long, start_pos long, end_pos long")


def redact_texts(df: DataFrame, *, key: bytes, id_col: str, text_col: str = "text") -> DataFrame:
    """``rec_id`` and the redacted ``text`` of every row; null and empty texts stay as they are.

    ``key``: 1 to 64 bytes, else a ValueError. Repeated rows each have theirs; an empty table gives
    an empty table; other columns don't matter.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redact(t.as_py(), key) for t in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["rec_id", "text"])

    return source.mapInArrow(run, "rec_id long, text string")
