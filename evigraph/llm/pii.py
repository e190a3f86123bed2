"""PII: format-preserving pseudonyms from keyed Feistel permutations.

Personal data found and validated in a text are replaced by other data of the same format:

==========  ====================================================================
kind        validated by; permuted part
==========  ====================================================================
card        13-19 digits, Luhn sum, one separator throughout; all but the check digit
iban        country, length, mod-97; the account part, check digits recomputed
ssn         ddd-dd-dddd with assignable parts; all digits, within assignable numbers
date        a calendar date of 1900-2099 (y-m-d, d/m/y, m/d/y when only that is valid);
            dates up to and past the 12th each among themselves
ipv4        four octets of 0-255; all 32 bits
phone       international or North American layouts; digits after the country code
email       local part; letters stay letters (case kept), digits stay digits
==========  ====================================================================

Each kind is permuted by an unbalanced Feistel network of ``ROUNDS`` rounds whose round
function is keyed BLAKE2b; the domain is the format, with cycle walking where a format is
smaller than the network's domain. A permutation has no collisions, so equal values get
equal pseudonyms in every document, different ones differ, and the key's holder can undo
it. Punctuation and layout stay. Nothing is stored, and texts are handled one by one.
Fixed points, where a value is its own pseudonym, are as rare as in a random permutation.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import bound_batches

ROUNDS = 10
KINDS = ("card", "iban", "ssn", "date", "ipv4", "phone", "email")
#: For demonstrations and tests; real runs pass a secret of their own.
DEMO_KEY = b"evigraph demonstration key"

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_EPOCH = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _EPOCH + 1
#: Days up to and past the 12th of their month, and each day's place in its list (-1 - place for late ones).
_EARLY, _LATE = ([d for d in range(_DAYS) if (datetime.date.fromordinal(d + _EPOCH).day > 12) == late] for late in (False, True))
_RANKS = {d: k for k, d in enumerate(_EARLY)} | {d: -1 - k for k, d in enumerate(_LATE)}
#: Longer texts are permuted symbol by symbol instead of as one number.
WIDE = 64
_IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}

_FIND = re.compile(
    r"(?P<email>(?<![\w.%+\-])[\w.%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,24}(?![\w\-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<iso>(?<![\w/.\-])\d{4}(?P<s1>[\-/.])\d{1,2}(?P=s1)\d{1,2}(?![\w/\-]|\.\d))"
    r"|(?P<dmy>(?<![\w/.\-])\d{1,2}(?P<s2>[\-/.])\d{1,2}(?P=s2)\d{4}(?![\w/\-]|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<card>(?<![\w.\-+])\d(?:\d{12,18}|(?:\d{3})(?:[ \-]\d{3,6}){2,4})(?![\w]|[.\-]\d))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?![\w]|[.\-]\d))"
    r"|(?P<plain>(?<![\w.+])\+\d{8,15}(?!\w))"
)


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 if i % 2 else 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonymizer:
    """Keyed permutations of each format; ``back`` undoes ``forth``."""

    def __init__(self, key: bytes, undo: bool = False) -> None:
        self.key, self.undo = blake2b(key).digest(), undo

    def _round(self, tweak: bytes, i: int, value: int, modulus: int) -> int:
        return int.from_bytes(self._bytes(b"%s|%d|%x" % (tweak, i, value), max(16, modulus.bit_length() // 8 + 9)), "big") % modulus

    def _bytes(self, data: bytes, size: int) -> bytes:
        """``size`` keyed bytes for some data: one digest, or as many as it takes."""
        if size <= 64:
            return blake2b(data, key=self.key, digest_size=size).digest()
        seed = blake2b(data, key=self.key).digest()
        return b"".join(blake2b(b"%d" % k, key=seed).digest() for k in range(-(-size // 64)))[:size]

    def number(self, value: int, left: int, right: int, tweak: bytes) -> int:
        """Permute 0 .. left*right - 1: a Feistel network on (value // right, value % right)."""
        a, b = divmod(value, right)
        if left == 1 or right == 1:  # too small to split: a keyed shift
            size = left * right
            move = self._round(tweak, 0, 0, size)
            return (value - move if self.undo else value + move) % size
        for i in reversed(range(ROUNDS)) if self.undo else range(ROUNDS):
            sign = -1 if self.undo else 1
            if i % 2:
                b = (b + sign * self._round(tweak, i, a, right)) % right
            else:
                a = (a + sign * self._round(tweak, i, b, left)) % left
        return a * right + b

    def letters(self, text: str, alphabet: str, tweak: str) -> str:
        """Permute strings of one length over an alphabet."""
        if not text:
            return text
        if len(text) > WIDE:
            return self._wide(text, alphabet, tweak)
        base, half = len(alphabet), len(text) // 2
        value = 0
        for c in text:
            value = value * base + alphabet.index(c)
        value = self.number(value, base ** (len(text) - half), base**half, f"{tweak}|{base}|{len(text)}".encode())
        out = []
        for _ in text:
            value, k = divmod(value, base)
            out.append(alphabet[k])
        return "".join(reversed(out))

    def _wide(self, text: str, alphabet: str, tweak: str) -> str:
        """The same network on halves that are lists of symbols, in time linear in the length."""
        base, half = len(alphabet), len(text) - len(text) // 2
        symbols = [alphabet.index(c) for c in text]
        sides = [symbols[:half], symbols[half:]]
        for i in reversed(range(ROUNDS)) if self.undo else range(ROUNDS):
            mine, other = sides[i % 2], sides[1 - i % 2]
            keyed = self._bytes(f"{tweak}|{base}|{len(text)}|{i}|".encode() + bytes(other), 4 * len(mine))
            moves = [int.from_bytes(keyed[k : k + 4], "big") for k in range(0, len(keyed), 4)]
            sides[i % 2] = [(x - m if self.undo else x + m) % base for x, m in zip(mine, moves, strict=True)]
        return "".join(alphabet[x] for x in sides[0] + sides[1])

    def digits(self, text: str, tweak: str) -> str:
        return self.letters(text, "0123456789", tweak)

    def within(self, value: int, size: int, tweak: str) -> int:
        """Permute 0 .. size - 1 by walking a slightly larger network back into range."""
        side = int(size**0.5) + 1
        while True:
            value = self.number(value, side, side, tweak.encode())
            if value < size:
                return value

    # One method per kind takes the matched text and gives its pseudonym, or None if it is not valid.

    def card(self, text: str) -> str | None:
        plain = re.sub(r"[ \-]", "", text)
        if not 13 <= len(plain) <= 19 or len(set(re.findall(r"[ \-]", text))) > 1 or len(set(plain)) == 1 or luhn(plain[:-1]) != int(plain[-1]):
            return None
        body = self.digits(plain[:-1], "card")
        return _lay(text, body + str(luhn(body)))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if _IBAN_LENGTHS.get(plain[:2]) != len(plain) or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.mixed(plain[4:], "iban" + plain[:2])
        return _lay(text, plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)

    def ssn(self, text: str) -> str | None:
        value = _ssn_number(int(text[:3]), int(text[4:6]), int(text[7:]))
        if value is None:
            return None
        value = self.within(value, 898 * 99 * 9999, "ssn")
        rest, serial = divmod(value, 9999)
        area, group = divmod(rest, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, text: str) -> str | None:
        parts = re.split(r"([\-/.])", text)
        numbers = [int(parts[0]), int(parts[2]), int(parts[4])]
        orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))
        for order in orders:
            try:
                day = datetime.date(*(numbers[k] for k in order)).toordinal() - _EPOCH
            except ValueError:
                continue
            if not 0 <= day < _DAYS:
                return None
            new = datetime.date.fromordinal(self._day(day) + _EPOCH)
            for k, value in zip(order, (new.year, new.month, new.day), strict=True):
                numbers[k] = value
            wide = [len(parts[0]), len(parts[2]), len(parts[4])]
            return parts[1].join(f"{n:0{w}d}" for n, w in zip(numbers, wide, strict=True))
        return None

    def _day(self, day: int) -> int:
        """Permute dates; those past the 12th of a month among themselves.

        Only they can be read month first, so a date has one pseudonym in all layouts and
        each layout can still be read.
        """
        late = _RANKS[day] < 0
        rank = self.within(-1 - _RANKS[day] if late else _RANKS[day], len(_LATE if late else _EARLY), "late" if late else "early")
        return (_LATE if late else _EARLY)[rank]

    def ipv4(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        value = self.number(int.from_bytes(bytes(octets), "big"), 1 << 16, 1 << 16, b"ipv4")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def phone(self, text: str) -> str | None:
        plain = re.sub(r"\D", "", text)
        if not (text[0] == "+" and 8 <= len(plain) <= 15 or len(plain) == 10 and re.fullmatch(r"(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}", text)):
            return None
        m = re.match(r"\+(\d{1,3})(?=\D)", text)
        code = m[1] if m else plain[: len(plain) - 10] if text[0] == "+" and len(plain) > 10 else ""
        return _lay(text, code + self.digits(plain[len(code) :], "phone"))

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        return f"{self.mixed(local, 'email')}@{domain}"

    def mixed(self, text: str, tweak: str) -> str:
        """Permute the digits, letters and accented letters of a text, each among themselves."""
        lower = [c.lower() if len(c.lower()) == 1 else c for c in text]
        out = list(text)
        shape = "".join("d" if c in "0123456789" else "l" if c in _LOWER else "a" if c in _ACCENTED else c for c in lower)
        for mark, alphabet in (("d", "0123456789"), ("l", _LOWER), ("a", _ACCENTED)):
            at = [i for i, c in enumerate(lower) if c in alphabet]
            for i, c in zip(at, self.letters("".join(lower[i] for i in at), alphabet, f"{tweak}|{mark}|{len(shape)}"), strict=True):
                out[i] = c.upper() if text[i] != lower[i] else c
        return "".join(out)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its personal data replaced, and how many of each kind."""
        counts = dict.fromkeys(KINDS, 0)

        def swap(m: re.Match) -> str:
            kind = {"iso": "date", "dmy": "date", "plain": "phone", "s1": "date", "s2": "date"}.get(m.lastgroup, m.lastgroup)
            new = getattr(self, kind)(m.group())
            if new is None:
                return m.group()
            counts[kind] += 1
            return new

        return _FIND.sub(swap, text), counts


def _lay(layout: str, symbols: str) -> str:
    """Put symbols in the places of the layout's letters and digits."""
    following = iter(symbols)
    return "".join(next(following) if c.isalnum() else c for c in layout)


def _ssn_number(area: int, group: int, serial: int) -> int | None:
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, text, n_card, n_iban, n_ssn, n_date, n_ipv4, n_phone, n_email)``, one row per row.

    Whole texts of any length; a null text is empty, an empty one stays. Ids may repeat or be
    null: rows are handled one by one. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, digit = Pseudonymizer(key), re.compile(r"[0-9@]")
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                new, found = worker.replace(t) if t and digit.search(t) else (t or "", dict.fromkeys(KINDS, 0))
                texts.append(new)
                counts.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]],
                names=["doc_id", "text", *[f"n_{k}" for k in KINDS]],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
