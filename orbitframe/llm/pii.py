"""Format-preserving pseudonyms for personal data.

Detectors find candidates, validators decide. What passes is split into its
format (signs, spaces, letters' case, check digits) and a number below a known
bound; a keyed Feistel network with cycle walking permutes that number, and the
format is put back. Equal values get equal pseudonyms in every document, no two
values get the same one, and the key holder can invert them.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import fresh, small_batches

ROUNDS = 8
#: Values whose pseudonyms a worker remembers.
REMEMBERED = 100_000


class Feistel:
    """Keyed permutations of ``0 .. n-1`` for any ``n``, one per tweak."""

    def __init__(self, key: bytes):
        self._key = key

    def _mix(self, tweak: bytes, turn: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        seed = b"%s|%d|%d|%x" % (tweak, turn, bits, half)
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(seed + b"|%d" % len(out), key=self._key, digest_size=64).digest()
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, tweak: bytes, back: bool = False) -> int:
        """Two unequal halves take turns; values that land at ``n`` or above walk on."""
        if n < 2:
            return value
        bits = max(2, (n - 1).bit_length())
        low = bits // 2
        high = bits - low
        turns = range(ROUNDS)
        while True:
            left, right = value >> low, value & ((1 << low) - 1)
            for turn in reversed(turns) if back else turns:
                if turn % 2:
                    right ^= self._mix(tweak, turn, left, low)
                else:
                    left ^= self._mix(tweak, turn, right, high)
            value = left << low | right
            if value < n:
                return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    """The two check digits of ISO 7064 mod 97-10."""
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _alphabet(c: str, hexadecimal: str) -> str | None:
    return hexadecimal if hexadecimal and c in hexadecimal else next((a for a in _CLASSES if c in a), None)


def permute_symbols(net: Feistel, text: str, tweak: bytes, back: bool, hexadecimal: str = "") -> str:
    """All digits and ASCII letters as one mixed-radix number; everything else and every class of symbol stays."""
    alphabets = [_alphabet(c, hexadecimal) for c in text]
    value, bound = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value, bound = value * len(a) + a.index(c), bound * len(a)
    shape = "".join("x" if a else c for c, a in zip(text, alphabets, strict=True))
    kinds = "".join(str(len(a)) + a[0] for a in alphabets if a)
    value = net.permute(value, bound, b"%s|%s|%s" % (tweak, shape.encode(), kinds.encode()), back)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, d = divmod(value, len(a))
            out.append(a[d])
        else:
            out.append(c)
    return "".join(reversed(out))


def _refill(text: str, digits: str) -> str:
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in text)


def _digits_only(net: Feistel, text: str, tweak: bytes, back: bool) -> str:
    """Permutes the digits, as many as there are; separators stay."""
    digits = "".join(c for c in text if c.isdigit())
    value = net.permute(int(digits or 0), 10 ** len(digits), tweak + b"|%d" % len(digits), back)
    return _refill(text, f"{value:0{len(digits)}d}")


# ------------------------------------------------------------------ kinds


def _recased(like: str, text: str) -> str:
    """``text`` with capitals where ``like`` has them; a letter stands where a letter stood."""
    return "".join(b.upper() if a.isupper() else b for a, b in zip(like, text, strict=True))


def _email(net: Feistel, m: str, back: bool) -> str | None:
    # The whole local part and the name of the host, not the top-level domain; capitals make no other address.
    head, dot, top = m.rpartition(".")
    return _recased(head, permute_symbols(net, head.lower(), b"email", back)) + dot + top


def _heads(m: str) -> list[str]:
    """What stands before each separator inside a find, shortest first."""
    return [m[: gap.start()] for gap in re.finditer(r"[ -]", m)]


def _is_card(m: str) -> bool:
    digits = re.sub(r"\D", "", m)
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(net: Feistel, m: str, back: bool) -> str | None:
    if not _is_card(m):
        return None
    payload = re.sub(r"\D", "", m)[:-1]
    while True:
        payload = _digits_only(net, payload, b"card", back)
        out = payload + luhn_digit(payload)
        made = _refill(m, out)
        if len(set(out)) > 1 and not any(map(_is_card, _heads(made))):  # else it would not be read as this card: walk on
            return made


#: Country calling codes of one and of two digits; all others have three. Fixed values of the numbering plan.
_CODES = {1: "1 7", 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"}
_CODE_DIGITS = {code: n for n, codes in _CODES.items() for code in codes.split()}


def _calling_code(digits: str) -> str:
    return digits[: next((n for n in _CODES if _CODE_DIGITS.get(digits[:n]) == n), 3)]


def _is_american(m: str) -> bool:
    digits = re.sub(r"\D", "", m)
    return m[:1] == "+" and digits[:1] == "1" and len(digits) == 11


def _phone(net: Feistel, m: str, back: bool) -> str | None:
    """The national number is permuted; forms without a plus are the three, three and four digits of code 1."""
    digits = re.sub(r"\D", "", m)
    if not 7 <= len(digits) <= 15:
        return None
    code = _calling_code(digits) if m[0] == "+" else ""
    moved = _digits_only(net, digits[len(code) :], b"phone" + (code or "1").encode(), back)
    return _refill(m, code + moved)


def _ssn(net: Feistel, m: str, back: bool) -> str | None:
    def index(area: int, group: int, serial: int) -> int:
        return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1

    area, group, serial = (int(x) for x in m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    value = net.permute(index(area, group, serial), 898 * 99 * 9999, b"ssn", back)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(net: Feistel, m: str, back: bool) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    # Parts keep their number of digits, so the text keeps its length.
    spans = [(0, 10) if len(p) == 1 else (10, 90) if len(p) == 2 else (100, 156) for p in parts]
    value, bound = 0, 1
    for p, (first, n) in zip(parts, spans, strict=True):
        value, bound = value * n + int(p) - first, bound * n
    value = net.permute(value, bound, b"ip" + bytes(len(p) for p in parts), back)
    out = []
    for first, n in reversed(spans):
        value, d = divmod(value, n)
        out.append(str(d + first))
    return ".".join(reversed(out))


#: Characters of an IBAN by country.
_IBAN_LENGTH = {
    country: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in names.split()
}


def _is_iban(m: str) -> bool:
    plain = m.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def _has_own_length(m: str) -> bool:
    return _IBAN_LENGTH.get(m[:2]) == len(m.replace(" ", ""))


def _iban(net: Feistel, m: str, back: bool) -> str | None:
    if not _is_iban(m):
        return None
    plain = m.replace(" ", "")
    country, account = plain[:2], plain[4:]
    while True:
        account = permute_symbols(net, account, b"iban" + country.encode(), back)
        fresh = iter(country + iban_check(country, account) + account)
        made = "".join(c if c == " " else next(fresh) for c in m)
        if _has_own_length(made) or not any(map(_is_iban, _heads(made))):  # else a part of it would be read as one: walk on
            return made


#: Names of the months; their first three letters are their short forms.
_MONTHS = "January February March April May June July August September October November December".split()
_SHORT = [name[:3] for name in _MONTHS]
_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST + 1


def _day(y: int, m: int, d: int) -> datetime.date | None:
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        return None
    return day if 1900 <= y <= 2099 else None


def _moved(net: Feistel, day: datetime.date, back: bool, fits: Callable[[datetime.date], bool] = lambda day: True) -> datetime.date:
    """Another day; where not all days can be written in a notation, those that can are permuted among themselves."""
    while True:
        day = datetime.date.fromordinal(_FIRST + net.permute(day.toordinal() - _FIRST, _DAYS, b"date", back))
        if fits(day):
            return day


def _number_of(text: str, value: int) -> bool:
    """Whether ``value`` can stand where ``text`` stood: one place holds no more than 9."""
    return len(text) > 1 or value < 10


def _date(net: Feistel, m: str, back: bool) -> str | None:
    """A real day of 1900-2099 becomes another in the same notation; only names of months change the length."""
    if x := re.fullmatch(r"(\d{4})([-/.])(\d{2})\2(\d{2})", m):
        if day := _day(int(x[1]), int(x[3]), int(x[4])):
            new = _moved(net, day, back)
            return f"{new.year}{x[2]}{new.month:02d}{x[2]}{new.day:02d}"
        return None
    if x := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})", m):
        p, q = x[1], x[3]
        if day := _day(int(x[4]), int(q), int(p)):
            new = _moved(net, day, back, lambda d: _number_of(p, d.day) and _number_of(q, d.month))
            return f"{new.day:0{len(p)}d}{x[2]}{new.month:0{len(q)}d}{x[2]}{new.year}"
        if day := _day(int(x[4]), int(p), int(q)):  # a day beyond 12, else it would read as day first
            new = _moved(net, day, back, lambda d: d.day > 12 and _number_of(p, d.month))
            return f"{new.month:0{len(p)}d}{x[2]}{new.day:0{len(q)}d}{x[2]}{new.year}"
        return None
    return _written_date(net, m, back)


def _written_date(net: Feistel, m: str, back: bool) -> str | None:
    """``4 March 2021`` or ``Mar 4, 2021``; May counts as a whole name, so short forms keep out of it."""
    x = re.fullmatch(r"(?:(\d{1,2}) )?([A-Za-z]+)\.? (?:(\d{1,2}),? )?(\d{4})", m)
    place, word = x[1] or x[3], x[2].capitalize()
    names = _MONTHS if word in _MONTHS else _SHORT
    day = _day(int(x[4]), names.index(word) + 1, int(place))
    if not day:
        return None
    new = _moved(net, day, back, lambda d: _number_of(place, d.day) and (names is _MONTHS or d.month != 5))
    name = names[new.month - 1]
    name = name.upper() if x[2].isupper() else name.lower() if x[2].islower() else name
    pieces = {x.span(2): name, x.span(4): str(new.year), x.span(1) if x[1] else x.span(3): f"{new.day:0{len(place)}d}"}
    out, at = [], 0
    for (a, b), piece in sorted(pieces.items()):
        out += [m[at:a], piece]
        at = b
    return "".join(out)


def _secret(net: Feistel, m: str, back: bool) -> str | None:
    if re.fullmatch(r"(?:AKIA|ASIA)[A-Z0-9]{16}", m):
        return m[:4] + permute_symbols(net, m[4:], b"key", back)
    return None


def _hex_secret(net: Feistel, m: str, back: bool) -> str | None:
    return permute_symbols(net, m, b"hex", back, "0123456789ABCDEF" if m.upper() == m else "0123456789abcdef")


def _password(net: Feistel, m: str, back: bool) -> str | None:
    """What follows the name of a password; behind a colon and a space only what holds a digit, since prose goes on there too."""
    x = re.fullmatch(r"(\w+ ?[=:] ?[\"']?)(.*)", m, re.DOTALL | re.ASCII)
    if x[1].rstrip("\"'").endswith(": ") and not re.search(r"\d", x[2]):
        return None
    return x[1] + permute_symbols(net, x[2], b"secret", back)


Rule = tuple[str, str, Callable[[Feistel, str, bool], "str | None"]]

#: Detectors in order of precedence at one place; each starts at a place that cannot continue a word or number.
RULES: tuple[Rule, ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w-])", _email),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("key", r"(?<!\w)A[KS]IA[A-Z0-9]{16}(?!\w)", _secret),
    ("secret_hex", r"(?<!\w)(?=[a-fA-F]*\d)(?=\d*[a-fA-F])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?!\w)", _hex_secret),
    ("password", r"(?<![A-Za-z])(?i:password|passwd|pwd) ?[=:] ?[\"']?[^\s\"'&]{4,128}", _password),
    (
        "date",
        r"(?<![\w./-])(?:(?:\d{4}([-/.])\d{2}\1\d{2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!(?!T\d\d:\d\d)[\w/-]|\.\d)|(?:\d{1,2} (?i:MONTH)\.? \d{4}|(?i:MONTH)\.? \d{1,2},? \d{4})(?!\w|[-/]\d))".replace("MONTH", "|".join(_MONTHS + _SHORT)),
        _date,
    ),
    ("ssn", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)", _ssn),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _ip),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[-.]\d)", _card),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])", _phone),
)


def _compiled(rules: tuple[Rule, ...]) -> re.Pattern:
    """One alternation; back references move with their group numbers."""
    parts, at = [], 0
    for name, pattern, _ in rules:
        at += 1
        base = at
        parts.append(f"(?P<{name}>" + re.sub(r"\\([1-9])", lambda m, base=base: f"\\{int(m[1]) + base}", pattern) + ")")
        at += re.compile(pattern).groups
    return re.compile("|".join(parts), re.ASCII)


#: A text without any of these has nothing to find.
_SIGN = re.compile(r"[0-9@]|(?i:password|passwd|pwd) ?[=:]")


class Pseudonymizer:
    """Replaces what the rules validate; ``back`` inverts the pseudonyms of a text made with the same key."""

    def __init__(self, key: bytes, rules: tuple[Rule, ...] = RULES, back: bool = False):
        self._net, self._rules, self._back = Feistel(key), {n: f for n, _, f in rules}, back
        self._find = _compiled(rules)
        self._known: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, text: str) -> str | None:
        at = (kind, text)
        if at not in self._known:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[at] = self._rules[kind](self._net, text, self._back)
        return self._known[at]

    def spans(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """``start, end, kind, pseudonym`` of every validated find."""
        if not _SIGN.search(text):
            return
        at = 0
        while m := self._find.search(text, at):
            kind = m.lastgroup
            for part in self._parts(kind, m[0]):
                made = self.value(kind, part)
                if made is not None:
                    at = m.start() + len(part)
                    yield m.start(), at, kind, made
                    break
            else:
                at = self._after_refusal(text, m)

    @staticmethod
    def _parts(kind: str, found: str) -> list[str]:
        """What of a find may be the value: cards and IBANs can be followed by other numbers and words.

        The shortest valid part counts. What follows it then cannot change how
        it is read, nor its pseudonym, so equal values stay equal and can be
        inverted. An IBAN of its country's length goes first, and so does a
        phone number of code 1 and ten digits.
        """
        if kind == "card":
            return [*_heads(found), found]
        if kind == "iban":
            return sorted([*_heads(found), found], key=lambda h: not _has_own_length(h))
        if kind == "phone":
            return [*(h for h in _heads(found) if _is_american(h)), found]
        return [found]

    @staticmethod
    def _after_refusal(text: str, m: re.Match) -> int:
        """Go on behind the first word of what failed, so that a find inside it is still seen."""
        gap = re.compile(r"[ -]").search(text, m.start() + 1, m.end())
        return gap.end() if gap else m.end()

    def text(self, text: str | None) -> tuple[str | None, Counter]:
        if not text:
            return text, Counter()
        out, last, kinds = [], 0, Counter()
        for start, end, kind, made in self.spans(text):
            out += [text[last:start], made]
            last = end
            kinds[kind] += 1
        return ("".join([*out, text[last:]]) if out else text), kinds


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", into: str = "pii_found", back: bool = False) -> DataFrame:
    """``docs`` with a struct column ``into``: ``text string, n_found long, kinds map<string, long>``.

    Null and empty texts stay as they are with nothing found; texts of any
    length are scanned whole; equal values have equal pseudonyms in all rows and
    runs of one key, repeated rows and ids included. All other columns stay as
    they are: where ``docs`` has a column of the name, underscores are added to
    ``into`` (``common.fresh``). An empty table stays empty. Pseudonyms keep
    length, separators, symbol classes, check digits and being a real date; only
    dates with the name of a month may change their length. Numbers that no
    validator knows (other runs of digits, days that do not exist) stay.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("text string, n_found long, kinds map<string,long>")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = Pseudonymizer(key, back=back)
        for texts in batches:
            done = [worker.text(t) for t in texts.where(texts.notna(), None)]
            yield pd.DataFrame(
                {
                    "text": pd.Series([t for t, _ in done], dtype=object),
                    "n_found": [sum(k.values()) for _, k in done],
                    "kinds": pd.Series([dict(sorted(k.items())) for _, k in done], dtype=object),
                }
            )

    return docs.withColumn(fresh(docs, into), replace(F.col(text_col)))
