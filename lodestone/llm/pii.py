"""PII: format-preserving Feistel pseudonyms.

Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, phone and social security numbers, dates and
email addresses are found in whole texts, validated, and replaced by another valid value of the same
format. The replacement is a keyed permutation of the values of the format, so equal values stay equal
and different ones stay different in all documents, and the holder of the key can undo it.

Values that do not validate (a card number with a wrong check digit, a 31st of February) stay as they are.
A null text stays null with no findings, as does an empty one; spans count code points of the text given.
Phone numbers are: `+` with 8 to 15 digits in a row or in groups apart by blank, . - / or parentheses (E.164
and national groupings, `+49 (0)30 ...` too); 3-3-4 digits apart by blank, . or -, area code in parentheses or
not; and those that start with a trunk 0, as pairs (06 12 34 56 78) or as an area code of 3 to 5 digits and
one or two groups. Bare digits without +, trunk 0 or such groups (5551234567, 612 345 678) are not told from
counts and stay. Dates are year first with - or /, or day or month first with . / or -, with a year of four
digits, padded or not, also before the T of a timestamp; names of months and years of two digits are not read. Dates
before 1900 or after 2099 stay as they are. Local parts of any length move. A key is any number of bytes, all of
which count.
A number or date moves among those of its own format, so a padded date and an unpadded one are not linked.
Overlapping candidates fall to the leftmost, then to the kind listed first; any length of text is taken
whole. Rows are independent of each other, so repeated rows and null ids need no care. Other columns
are kept; result columns replace columns of their names.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm._common import Bounded, arrow_schema, batch

ROUNDS = 10
#: Characters of a local part that move as one number; longer ones move piece by piece.
LOCAL_PIECE = 128


class Feistel:
    """A keyed permutation of 0..n-1 for any n: an alternating Feistel network over the smallest even
    number of bits that holds n, walked until it lands below n."""

    def __init__(self, key: bytes, domain: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.size = (self.half + 7) // 8
        if len(key) > 64:  # a key longer than the hash takes counts as its digest
            key = hashlib.blake2b(key).digest()
        self.rounds = [hashlib.blake2b(domain.encode() + b"|%d|%d" % (n, r), key=key, digest_size=min(64, max(8, self.size))) for r in range(ROUNDS)]

    def _f(self, r: int, x: int) -> int:
        h = self.rounds[r].copy()
        h.update(x.to_bytes(self.size, "big"))
        out = h.digest()
        for i in range(1, -(-self.size // 64)):  # halves of over 64 bytes: further digests, by number
            more = h.copy()
            more.update(b"|%d" % i)
            out += more.digest()
        return int.from_bytes(out, "big") & self.mask

    def apply(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in range(ROUNDS):
                a, b = b, a ^ self._f(r, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def undo(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(ROUNDS)):
                a, b = b ^ self._f(r, a), a
            x = a << self.half | b
            if x < self.n:
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _letters(s: str) -> str:
    return "".join(str(int(c, 36)) for c in s)


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


@cache
def _days(past_twelve: bool, short_day: bool, short_month: bool) -> list[int]:
    """Ordinals of the days after the twelfth of their month, or of those whose day or month has one digit."""
    each = ((i, datetime.date.fromordinal(i)) for i in range(FIRST_DAY, FIRST_DAY + DAYS))
    return [i for i, d in each if (d.day > 12 or not past_twelve) and (d.day < 10 or not short_day) and (d.month < 10 or not short_month)]


#: Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")
_RUN = re.compile(r"\d+", re.ASCII)
#: Tried where a run of digits starts, or up to two characters before. In order of preference.
_NUMBERS = re.compile(
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))"
    # four numbers of an IP address after a + are one still, as its new value may have another number of digits
    r"|(?P<phone_abroad>(?<![\w+])\+(?!(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d))(?:\d{1,3} ?\(0\)|\d{1,15})(?:(?:(?<=\)) ?|[ ./-])\d{1,14}|[ .-]?\(\d{2,5}\)(?: ?\d{1,14})){0,7}(?!\w|[./-]\d))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{4}-\d{4}-\d{4}(?:-\d{3})?|\d{4}-\d{6}-\d{5})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}(?P<ymd>[/-])\d{1,2}(?P=ymd)\d{1,2}|\d{1,2}(?P<dmy>[./-])\d{1,2}(?P=dmy)\d{4})(?:(?=T\d{2}:?\d{2})|(?![\w/-]|\.\d)))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<phone_trunk>(?<![\w+./-])(?:0\d(?:[ .-]\d{2}){4}|(?:\(0\d{2,4}\) ?|0\d{2,4}[ /-])(?:\d{5,8}|\d{3,4}[ -]\d{3,5}))(?![\w-]|[./]\d))",
    re.ASCII,
)
_KINDS = [k for k in _NUMBERS.groupindex if k not in ("ymd", "dmy")]


class Pseudonyms:
    """The permutations of one key."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self.networks = Bounded(lambda dn: Feistel(self.key, *dn), 4096, 512)
        self.memo = Bounded(lambda kv: getattr(self, "_" + kv[0])(kv[1]), 200_000, 64)

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None if the text is no valid value of its kind."""
        return self.memo[kind, text]

    def _move(self, domain: str, n: int, x: int) -> int:
        f = self.networks[domain, n]
        return f.undo(x) if self.undo else f.apply(x)

    def _digits(self, domain: str, digits: str) -> str:
        return str(self._move(domain, 10 ** len(digits), int(digits))).zfill(len(digits))

    @staticmethod
    def _fill(shape: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def _card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        new = self._digits("card", d[:-1])
        return self._fill(s, new + luhn_digit(new))

    def _phone(self, s: str) -> str | None:
        """The country code or trunk 0 stays, and with it the form that the number is read by."""
        if s[0] == "+":
            if not 8 <= sum(c.isdigit() for c in s) <= 15:
                return None
            at = (re.compile(r"\d{1,3}(?!\d)").match(s, 1) or _COUNTRY.match(s, 1)).end()
            at = m.end() if (m := re.compile(r" ?\(0\)").match(s, at)) else at
        else:
            at = m.end() if (m := re.match(r"\(?0(?!\d{2}\)? ?[ .-]?\d{3}[ .-]\d{4}$)", s)) else 0
        return s[:at] + self._fill(s[at:], self._digits("phone", re.sub(r"\D", "", s[at:])))

    def _ssn(self, s: str) -> str | None:
        # areas 001-665 and 667-899, groups 01-99, serials 0001-9999 are valid
        a, g, n = map(int, s.split("-"))
        if a in (0, 666) or a > 899 or not g or not n:
            return None
        x = self._move("ssn", 898 * 99 * 9999, ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1)
        x, n = divmod(x, 9999)
        a, g = divmod(x, 99)
        a += 1
        return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"

    def _ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self._move("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, s: str) -> str | None:
        sep = re.search(r"\D", s)[0]
        p = list(map(int, s.split(sep)))
        orders = ("ymd",) if s.index(sep) == 4 else ("dmy",) if sep == "." else ("dmy", "mdy")
        for order in orders:
            at = dict(zip(order, p, strict=True))
            try:
                x = datetime.date(at["y"], at["m"], at["d"]).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= x < DAYS:
                return None
            width = dict(zip(order, map(len, s.split(sep)), strict=True))
            short = width["d"] == 1, width["m"] == 1
            if order == "mdy" or any(short):  # mdy only where the day is past 12; moved among their like, they are read alike again
                like = _days(order == "mdy", *short)
                domain = "mdy" if order == "mdy" and not any(short) else f"{order}{width['d']}{width['m']}"
                new = like[self._move(domain, len(like), bisect.bisect_left(like, x + FIRST_DAY))]
            else:
                new = FIRST_DAY + self._move("date", DAYS, x)
            new = datetime.date.fromordinal(new)
            return sep.join(f"{getattr(new, {'y': 'year', 'm': 'month', 'd': 'day'}[c]):0{width[c]}d}" for c in order)
        return None

    def _iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        if not 15 <= len(d) <= 34 or int(_letters(d[4:] + d[:4])) % 97 != 1:
            return None
        body = d[4:]
        digits = "".join(c for c in body if c.isdigit())
        if not digits:
            return None
        body = self._fill(body, self._digits("iban" + d[:2] + re.sub(r"\d", "0", body), digits))
        check = f"{98 - int(_letters(body + d[:2] + '00')) % 97:02d}"
        it = iter(d[:2] + check + body)
        return "".join(c if c == " " else next(it) for c in s)

    def _email(self, s: str) -> str:
        """The local part's letters and digits move as one mixed-radix number; case and marks stay. One of over
        LOCAL_PIECE characters moves in pieces, each under the digest of what stood before it, so that equal parts
        stay equal, different ones stay different, and time grows with the length."""
        local, _, host = s.partition("@")
        out, before = [], hashlib.blake2b(digest_size=16)
        for lo in range(0, len(local), LOCAL_PIECE):
            piece = local[lo : lo + LOCAL_PIECE]
            new = self._local(piece, host + (f"#{before.hexdigest()}" if lo else ""))
            out.append(new)
            before.update((new if self.undo else piece).lower().encode())
        return "".join(out) + "@" + host

    def _local(self, local: str, domain: str) -> str:
        x, n = 0, 1
        for c in local.lower():
            r, v = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 97) if c.isalpha() else (1, 0)
            x, n = x * r + v, n * r
        shape = re.sub(r"[a-z]", "a", re.sub(r"\d", "0", local.lower()))
        x = self._move(f"email:{shape}@{domain.lower()}", n, x) if n > 1 else x
        out = []
        for c in reversed(local):
            if c.isdigit():
                x, v = divmod(x, 10)
                out.append(str(v))
            elif c.isalpha():
                x, v = divmod(x, 26)
                out.append(chr((65 if c.isupper() else 97) + v))
            else:
                out.append(c)
        return "".join(reversed(out))

    def _valid(self, kind: str, text: str) -> str | None:
        """The text, or for an account or phone number its longest first groups, that validates."""
        while self.value(kind, text) is None:
            if kind not in ("iban", "phone") or " " not in text:
                return None
            text = text.rpartition(" ")[0]
        return text

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each value in the text given."""
        found = []
        if "@" in text:
            found = [(m.start(), m.end(), "email", m[0]) for m in _EMAIL.finditer(text)]
        at = 0
        while run := _RUN.search(text, at):
            start, at = run.span()
            for begin in range(max(start - 2, 0), start + 1):
                m = _NUMBERS.match(text, begin)
                if not m:
                    continue
                kind = next(k for k in _KINDS if m[k]).partition("_")[0]
                if value := self._valid(kind, m[0]):
                    found.append((begin, begin + len(value), kind, value))
                    at = begin + len(value)
                    break
        if not found:
            return text, []
        found.sort(key=lambda f: (f[0], -f[1]))
        out, spans, done = [], [], 0
        for start, end, kind, value in found:
            if start < done:
                continue
            out += [text[done:start], self.value(kind, value)]
            spans.append((kind, start, end))
            done = end
        return "".join([*out, text[done:]]), spans


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", findings: str = "findings", undo: bool = False) -> DataFrame:
    """df with pseudonyms in its text, and findings: array of (kind, start, end) in the text it had."""
    kind = T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>")
    schema = T.StructType([*(f for f in df.schema.fields if f.name != findings), T.StructField(findings, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, out = Pseudonyms(key, undo), arrow_schema(schema)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = [(None, []) if t is None else p.rewrite(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                cols = {f.name: part.column(part.schema.get_field_index(f.name)) for f in schema if f.name not in (text, findings)}
                cols[text] = [t for t, _ in got]
                cols[findings] = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for _, spans in got]
                yield batch(out, **cols)

    return df.mapInArrow(run, schema)
