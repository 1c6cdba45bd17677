"""Format-preserving pseudonyms for personal data.

A value that validates (check digits, calendar, number ranges) is read as a number of its
format's domain, permuted there by a keyed Feistel network with cycle walking, and written back
in the same format.  The permutation depends on key, kind and format only, so equal values stay
equal in all documents, different ones stay different, and the key holder can invert it.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanframe.llm.rows import map_steps
from gleanframe.operators.columns import ident

ROUNDS = 8
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

# fixed values: characters of an IBAN by country
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 "
    "TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
# fewest characters of a value that may end before its candidate does
SHORTEST = {"card": 13, "iban": 15}

# what starts a closer look at a text
_HINT = re.compile(r"[0-9@=]|password:")
_FIND = re.compile(
    r"""
    (?P<email>(?<![A-Za-z0-9_.+%-])[A-Za-z0-9_.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9_]))
    | (?P<iban>(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]){11,30}(?![A-Za-z0-9_]))
    | (?P<key>(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_]))
    | (?P<secret>(?<=password=|password:|passw0rd=)[^\s"']{6,}|(?<=token\ =\ ")[^\s"]{8,}(?=")|(?<=api_key=)[^\s"']{8,})
    | (?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d))
    | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))
    | (?P<phone>(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)
        | (?<![\d+(-])\(\d{3}\)[ ]?\d{3}[-. ]\d{4}(?!\d) | (?<![\d+.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])
        | (?<![\d+])\+\d(?:[ .-]?\(?\d\)?){7,14}(?!\d))
    | (?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d))
    """,
    re.VERBOSE,
)


def feistel(key: bytes, tweak: str, x: int, size: int, inverse: bool = False) -> int:
    """A keyed permutation of 0..size-1: balanced rounds over the next even number of bits, walked until inside."""
    if size < 2:
        return x
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, width = (1 << half) - 1, -(-half // 8)
    seed = hashlib.sha256(key + b"\0" + tweak.encode() + b"\0" + str(size).encode()).digest()

    def mix(turn: int, value: int) -> int:
        block = hashlib.shake_256(seed + bytes([turn]) + value.to_bytes(width, "little")).digest(width)
        return int.from_bytes(block, "little") & mask

    while True:
        left, right = x >> half, x & mask
        if inverse:
            for turn in reversed(range(ROUNDS)):
                left, right = right ^ mix(turn, left), left
        else:
            for turn in range(ROUNDS):
                left, right = right, left ^ mix(turn, right)
        x = left << half | right
        if x < size:
            return x


def _usual(kind: str, found: str) -> int:
    """Characters that a card of this network or an IBAN of this country mostly has."""
    if kind == "iban":
        return IBAN_LENGTHS.get(found[:2], 0)
    first = re.sub(r"\D", "", found[:4])[:2]
    return 15 if first in ("34", "37") else 14 if first in ("30", "36", "38", "39") else 16


def _candidates(kind: str, found: str) -> list[str]:
    """What a match may stand for: cards and IBANs also end before the groups that follow them.

    The usual length comes first, then the longest.
    """
    if kind not in SHORTEST:
        return [found]
    sizes, n = {}, 0
    for end, c in enumerate(found, 1):
        n += c.isalnum()
        if c.isalnum() and n >= SHORTEST[kind] and not found[end:end + 1].isalnum():
            sizes[n] = end
    usual = _usual(kind, found)
    return [found[:sizes[n]] for n in sorted(sizes, key=lambda n: (n != usual, -n))]


class Pseudonyms:
    """Replacement of each kind of value; None where a value does not validate."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def _permute(self, tweak: str, x: int, size: int) -> int:
        return feistel(self.key, tweak, x, size, self.inverse)

    def _characters(self, kind: str, text: str, digits: str = "0123456789", lower: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        """Letters and digits permuted together, each within its class; other characters stay."""
        classes = (digits, lower, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        form = [next((c for c in classes if x in c), None) for x in text]
        value, size = 0, 1
        for x, c in zip(text, form):
            if c:
                value, size = value * len(c) + c.index(x), size * len(c)
        value = self._permute(kind + "".join("." if c is None else c[0] for c in form), value, size)
        out = list(text)
        for i in reversed(range(len(text))):
            if form[i]:
                value, digit = divmod(value, len(form[i]))
                out[i] = form[i][digit]
        return "".join(out)

    def _digits(self, kind: str, text: str, sizes: list[list[str]]) -> str:
        """The digits of ``text`` replaced, position i within ``sizes[i]``; other characters stay."""
        at = [i for i, x in enumerate(text) if x.isdigit()]
        value, size = 0, 1
        for i, choice in zip(at, sizes):
            value, size = value * len(choice) + choice.index(text[i]), size * len(choice)
        value = self._permute(kind, value, size)
        out = list(text)
        for i, choice in reversed(list(zip(at, sizes))):
            value, digit = divmod(value, len(choice))
            out[i] = choice[digit]
        return "".join(out)

    def email(self, text: str) -> str:
        head, _, top = text.rpartition(".")
        return self._characters("email", head) + "." + top

    def key_id(self, text: str) -> str:
        return text[:4] + self._characters("key", text[4:])

    def secret(self, text: str) -> str:
        if re.fullmatch(r"[0-9a-f]+", text):
            value = self._permute(f"hex{len(text)}", int(text, 16), 16 ** len(text))
            return f"{value:0{len(text)}x}"
        return self._characters("secret", text)

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")

        def rest(body: str, head: str) -> int:
            return int("".join(str(int(c, 36)) for c in body + head)) % 97

        if rest(plain[4:], plain[:4]) != 1:
            return None
        body = self._characters("iban" + plain[:2], plain[4:])
        fresh = iter(plain[:2] + f"{98 - rest(body, plain[:2] + '00'):02d}" + body)
        return "".join(" " if c == " " else next(fresh) for c in text)

    def date(self, text: str) -> str | None:
        mark = next(c for c in text if not c.isdigit())
        a, b, c = (int(p) for p in text.split(mark))
        # year-month-day, day.month.year, month/day/year unless only day/month/year can be meant
        swapped = mark == "." or mark == "/" and a > 12
        year, month, day = (a, b, c) if mark == "-" else (c, b, a) if swapped else (c, a, b)
        if not 1 <= month <= 12 or not 1 <= day or not 1900 <= year <= 2099 or day > calendar.monthrange(year, month)[1]:
            return None
        late = mark == "/" and swapped
        x = dt.date(year, month, day).toordinal() - _FIRST_DAY
        while True:
            x = self._permute("date", x, _LAST_DAY - _FIRST_DAY + 1)
            new = dt.date.fromordinal(_FIRST_DAY + x)
            if not late or new.day > 12:
                break
        if mark == "-":
            return new.isoformat()
        first, second = (new.day, new.month) if swapped else (new.month, new.day)
        return f"{first:02d}{mark}{second:02d}{mark}{new.year}"

    def ssn(self, text: str) -> str | None:
        area, group, serial = (int(p) for p in text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._permute("ssn", x, len(areas) * 99 * 9999), 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        x = self._permute("ip", int.from_bytes(bytes(parts)), 1 << 32)
        return ".".join(map(str, x.to_bytes(4)))

    def phone(self, text: str) -> str:
        """Country code and layout stay; an area code keeps to the range of its first digit.

        Of a short international number two digits stay, of any other all but the last ten.
        """
        at = [i for i, c in enumerate(text) if c.isdigit()]
        at = at[2:] if text[0] == "+" and len(at) < 11 else at[-10:]
        head, number = text[:at[0]], text[at[0]:]
        first = list("01") if number[0] in "01" else list("23456789")
        return head + self._digits("phone" + re.sub(r"\D", "", head), number, [first] + [list("0123456789")] * (len(at) - 1))

    def card(self, text: str) -> str | None:
        """The first digit (the network) stays, the last is the check digit of the new number."""
        digits = [int(c) for c in text if c.isdigit()]
        if _luhn(digits):
            return None
        at = [i for i, c in enumerate(text) if c.isdigit()]
        body = self._digits(f"card{digits[0]}", text[at[1]:at[-1]], [list("0123456789")] * (len(digits) - 2))
        new = digits[:1] + [int(c) for c in body if c.isdigit()] + [0]
        return text[:at[1]] + body + str(-_luhn(new) % 10)

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """(new text, spans of the replacements in it)."""
        kinds: dict[str, Callable] = {k: getattr(self, k) for k in "email iban secret date ssn ip phone card".split()}
        kinds["key"] = self.key_id
        out, spans, last, size = [], [], 0, 0
        at = 0
        while m := _FIND.search(text, at):
            kind, new = m.lastgroup, None
            for value in _candidates(kind, m[0]):
                new = kinds[kind](value)
                if new is not None:
                    break
            if new is None:
                # look again behind the first character, another kind may fit from there
                at = m.start() + 1
                continue
            out += [text[last:m.start()], new]
            size += m.start() - last
            spans.append((kind, size, size + len(new)))
            size += len(new)
            last = at = m.start() + len(value)
        return "".join([*out, text[last:]]), spans


def _luhn(digits: list[int]) -> int:
    doubled = (d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return sum(doubled) % 10


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def pseudonymise(
    df: DataFrame, key: bytes, *, text: str = "text", keep: tuple[str, ...] | None = None, spans: str | None = "spans",
) -> DataFrame:
    """The rows with personal data in ``text`` replaced, and the spans of the replacements (code points).

    Repeated rows change alike, and columns of any name pass through; an empty table stays one.

    Cards, IBANs, social security numbers, dates, IP addresses, telephone numbers, e-mail
    addresses and credentials keep their format and stay valid.  What does not validate stays.
    All other columns (or those of ``keep``) pass through; null text stays null and has no spans.
    """
    names = [c for c in (keep if keep is not None else df.columns) if c != text]

    def run(columns):
        new, found = [], []
        made = Pseudonyms(key)
        for t in columns["__text"].to_pylist():
            fresh, where = made.replace(t) if t and _HINT.search(t) else (t, [])
            new.append(fresh)
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in where])
        return [*[columns[f"c{i}"] for i in range(len(names))], pa.array(new, pa.string()), found]

    fields = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    source = df.select(*[ident(c).alias(f"c{i}") for i, c in enumerate(names)], ident(text).alias("__text"))
    done = map_steps(source, run, ", ".join([*fields, f"__text string, __spans {_SPANS}"]))
    order = keep if keep is not None else df.columns
    columns = [done["__text"].alias(c) if c == text else done[f"c{names.index(c)}"].alias(c) for c in order]
    return done.select(*columns, *([done["__spans"].alias(spans)] if spans else []))
