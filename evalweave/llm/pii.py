"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes its validity check is read as a number in the domain of its
format and permuted by a keyed Feistel network, walking until it lands in the domain
again. Separators and check digits are put back, so the pseudonym is valid too, and
equal values get equal pseudonyms in every document. The key undoes it.
"""

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import date
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY = date(1900, 1, 1).toordinal()
LAST_DAY = date(2099, 12, 31).toordinal()

_EMAIL = re.compile(r"([A-Za-z0-9._%+-]+)(@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
_NUMBER = re.compile(
    r"""(?<!\w)(?<!\d\.)(?:
    (?P<ymd>(?:19|20)\d\d-\d\d-\d\d)
    |(?P<dmy>\d\d?[./]\d\d?[./](?:19|20)\d\d)
    |(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)
    |(?P<ssn>\d{3}-\d\d-\d{4})
    |(?P<card>\d{13,19}|\d{4}([ -])\d{4}\6\d{4}\6\d{1,7}|\d{4}([ -])\d{6}\7\d{5})
    |(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)\ ?|\d{3}[ .-])\d{3}[ .-]\d{4})
    |(?P<iban>[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?:\ [A-Z0-9]{4}){3,7}(?:\ [A-Z0-9]{1,3})?))
    )(?(ymd)(?!(?!T\d)\w)|(?(dmy)(?!(?!T\d)\w)|(?!\w)))""",
    re.VERBOSE,
)


class Feistel:
    """A keyed permutation of the numbers below ``size``, one for each kind of value."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo

    def _mix(self, kind: str, size: int, number: int, half: int, i: int) -> int:
        said = f"{kind}|{size}|{i}|{number}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=16).digest(), "big") & ((1 << half) - 1)

    def permuted(self, kind: str, size: int, number: int) -> int:
        if size < 2:
            return number
        half = ((size - 1).bit_length() + 1) // 2
        while True:
            left, right = number >> half, number & ((1 << half) - 1)
            if self.undo:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._mix(kind, size, left, half, i), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._mix(kind, size, right, half, i)
            number = left << half | right
            if number < size:
                return number

    def digits(self, kind: str, digits: str) -> str:
        return str(self.permuted(kind, 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else ""


def luhn_digit(payload: str) -> int:
    total = 0
    for i, digit in enumerate(reversed(payload)):
        value = int(digit) * (2 - i % 2)
        total += value - 9 * (value > 9)
    return -total % 10


def _refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(f: Feistel, text: str) -> str | None:
    digits = _digits_of(text)
    if luhn_digit(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    payload = digits[0] + f.digits("card", digits[1:-1])
    return _refilled(text, payload + str(luhn_digit(payload)))


def _phone(f: Feistel, text: str) -> str:
    digits = _digits_of(text)
    country, area, rest = digits[:-10], digits[-10:-7], digits[-7:]
    # An area code that begins with 2 to 9 goes on doing so, and one with 0 or 1 too.
    low, size = (200 * 10**7, 8 * 10**9) if area[0] > "1" else (0, 2 * 10**9)
    number = low + f.permuted("phone", size, int(area + rest) - low)
    return _refilled(text, country + str(number).zfill(10))


def _ssn(f: Feistel, text: str) -> str | None:
    digits = _digits_of(text)

    def valid(value: str) -> bool:
        return value[:3] not in ("000", "666") and value[0] != "9" and value[3:5] != "00" and value[5:] != "0000"

    if not valid(digits):
        return None
    while True:  # walk on to the next valid number
        digits = f.digits("ssn", digits)
        if valid(digits):
            return _refilled(text, digits)


def _ip(f: Feistel, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or text != ".".join(map(str, parts)):
        return None
    number = f.permuted("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, number.to_bytes(4, "big")))


def _day(f: Feistel, year: int, month: int, day: int) -> date | None:
    try:
        number = date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    size = LAST_DAY - FIRST_DAY + 1
    return date.fromordinal(FIRST_DAY + f.permuted("date", size, number)) if 0 <= number < size else None


def _ymd(f: Feistel, text: str) -> str | None:
    new = _day(f, *map(int, text.split("-")))
    return new.isoformat() if new else None


def _dmy(f: Feistel, text: str) -> str | None:
    """Day first with dots, month first with slashes."""
    mark = "." if "." in text else "/"
    parts = text.split(mark)
    if len(parts) != 3:
        return None
    first, second, year = map(int, parts)
    day, month = (first, second) if mark == "." else (second, first)
    new = _day(f, year, month, day)
    if not new:
        return None
    padded = len(parts[0]) == 2 and len(parts[1]) == 2
    ordered = (new.day, new.month) if mark == "." else (new.month, new.day)
    return mark.join([*(f"{p:02d}" if padded else str(p) for p in ordered), f"{new.year:04d}"])


def _mod97(country: str, check: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + check)) % 97


def _classes(f: Feistel, kind: str, text: str) -> str:
    """Letters and digits permuted together, each staying a small letter, capital or digit."""
    sets = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    kinds = ["d" if c in sets["d"] else "l" if c in sets["l"] else "u" if c in sets["u"] else "" for c in text]
    number, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            number, size = number * len(sets[k]) + sets[k].index(c), size * len(sets[k])
    number = f.permuted(f"{kind}|{''.join(kinds)}", size, number)
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            number, place = divmod(number, len(sets[k]))
            c = sets[k][place]
        out.append(c)
    return "".join(reversed(out))


def _iban(f: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[:2], plain[2:4], plain[4:]) != 1:
        return None
    rest = _classes(f, "iban", plain[4:])
    new = iter(plain[:2] + f"{98 - _mod97(plain[:2], '00', rest):02d}" + rest)
    return "".join(c if c == " " else next(new) for c in text)


# Fixed order of the formats; each returns None for a value that fails its check.
_FORMATS: dict[str, Callable[[Feistel, str], str | None]] = {
    "ymd": _ymd,
    "dmy": _dmy,
    "ip": _ip,
    "ssn": _ssn,
    "card": _card,
    "phone": _phone,
    "iban": _iban,
}


@cache
def _compiled(key: bytes, undo: bool) -> Feistel:
    return Feistel(key, undo)


def pseudonymised(text: str, key: bytes, undo: bool = False) -> tuple[str, int]:
    """``text`` with its personal values replaced, and how many there were."""
    f, found = _compiled(key, undo), 0

    def number(match: re.Match) -> str:
        nonlocal found
        new = _FORMATS[match.lastgroup](f, match[0])
        found += new is not None
        return match[0] if new is None else new

    def email(match: re.Match) -> str:
        nonlocal found
        found += 1
        return _classes(f, "email", match[1]) + match[2]

    if "@" in text:
        # Numbers are looked for between addresses, so that none is replaced twice.
        parts, at = [], 0
        for match in _EMAIL.finditer(text):
            parts += [_NUMBER.sub(number, text[at : match.start()]), email(match)]
            at = match.end()
        return "".join([*parts, _NUMBER.sub(number, text[at:])]), found
    return _NUMBER.sub(number, text), found


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """``(doc_id, text, n_values)``: every row of ``docs`` with its personal values replaced.

    Cards (Luhn), phone and social security numbers, IPv4 addresses, IBANs (mod 97)
    and calendar dates from 1900 to 2099 are replaced if they pass their checks;
    mail addresses keep their domain. ``undo`` restores the values. A null text
    stays null with no values, an empty one stays empty; repeated rows and null
    ids are kept; other columns are not read; an empty table gives no rows.
    """
    secret = key.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: Sequence[str | None] = batch.column(1).to_pylist()
            rows = [(None, 0) if t is None else pseudonymised(t, secret, undo) for t in texts]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "text", "n_values"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, text string, n_values long")
