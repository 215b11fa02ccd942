"""Format-preserving pseudonyms of personal numbers, dates, addresses and secrets by a keyed Feistel permutation.

A value is ranked within its format (all digit strings of its length, all days of two centuries, ...), the rank is permuted
under a key, and the new rank is written in the same format, with check digits made anew. Equal values get equal
pseudonyms in every document, different values different ones, and who has the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, make_room, schema_of, small_batches

#: Key of the registered query; a real run passes its own.
KEY = b"sighthound example key"
ROUNDS = 8
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
KINDS = ("email", "ip", "iban", "date", "ssn", "card", "phone", "secret")

#: Country codes of telephone numbers (ITU-T E.164).
COUNTRY = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
#: What stands between groups of a telephone number; behind a blank no address, date or number of another kind may begin.
GAP = r"[ \u00a0\u202f./-]"
OTHER = r"(?:\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)|(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}(?!\w)|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d(?!\w)|\d{3}-\d{2}-\d{4}(?![\w-])|\d{4}(?:[ -]\d{4}){3}(?!\w)|\d{13,19}(?!\w))"
#: With a country code: national numbers of known length, then any grouping; without: two to four, three and four digits,
#: a trunk 0 with groups behind it, Spanish groups, and three and four digits.
PHONE = "|".join(
    (
        rf"(?<![\w+])(?:\+|00 ?)3[34]{GAP}?(?:\(0\){GAP}?)?[1-9](?:{GAP}?\d){{8}}(?!\w)",
        rf"(?<![\w+])(?:\+|00 ?)44{GAP}?(?:\(0\){GAP}?)?[1-9](?:{GAP}?\d){{9}}(?!\w)",
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
        rf"(?<![\w+])(?:\+|00 ?)(?=[1-9])\d(?:(?!{GAP}{OTHER})[ \u00a0\u202f./()-]{{0,3}}\d){{6,14}}(?!\w)",
        rf"(?<![\w+.,/-])(?:\(0[1-9]\d{{0,3}}\)|0[1-9]\d{{0,3}})(?:[ \u00a0\u202f]?[/-][ \u00a0\u202f]?|[ \u00a0\u202f])\d\d(?:(?![ \u00a0\u202f]{OTHER})[ \u00a0\u202f-]?\d){{3,8}}(?![\w/-]|[.,]\d)",
        r"(?<![\w+.,/-])0[1-9](?:\.\d\d){4}(?!\w|[.,]\d)",
        r"(?<![\w+.,/-])(?:[6-9]\d\d[ \u00a0-]\d{3}[ \u00a0-]\d{3}|[6-9]\d\d(?:[ \u00a0-]\d\d){3}|9\d[ \u00a0-]\d{3}(?:[ \u00a0-]\d\d){2})(?![\w/-]|[.,]\d|[ \u00a0]\d{3}\b)",
        r"(?<![\w+.,/-])[2-9]\d\d-\d{4}(?![\w/-]|[.,]\d)",
    )
)
PHONE_ALONE = re.compile(PHONE)
#: What stays of a telephone number: country code, or trunk 0.
PHONE_HEAD = re.compile(rf"(?:\+|00 ?){COUNTRY}{GAP}?(?:\(0\){GAP}?)?(?=[(\d])|\(?0(?=[1-9])|")

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:(?:19|20)\d\d(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)(?:19|20)\d\d)(?![\w/-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))"
    rf"|(?P<phone>{PHONE})"
    r"|(?P<secret>(?<!\w)(?=[0-9a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,64}(?!\w))"
)


def _alphabets():
    """Letters of one kind by block: upper and lower case of Basic Latin, Latin-1, Greek and Cyrillic, digits, and other letters by runs of 256 code points."""
    for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A)):
        yield "".join(map(chr, range(a, b)))
    for a in (*range(0x00, 0x3100, 0x100), *range(0xAC00, 0xD700, 0x100), *range(0x4E00, 0x9F00, 0x100)):
        block = [chr(i) for i in range(max(a, 0xAA), a + 0x100)]
        for kind in (str.isupper, str.islower, lambda c: not c.isupper() and not c.islower()):
            if members := "".join(c for c in block if c.isalpha() and kind(c)):
                yield members


#: Alphabet of a character that has one.
ALPHABET_OF = {c: a for a in _alphabets() for c in a}


class Feistel:
    """A keyed permutation of 0 to n - 1 for any n: alternating additions on two halves, walking on until the value is in range."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, tweak: str, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{i}:{tweak}:{value}".encode(), key=self.key, digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = (n + a - 1) // a
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if i % 2:
                    right = (right + (-1 if back else 1) * self._round(i, tweak, left)) % b
                else:
                    left = (left + (-1 if back else 1) * self._round(i, tweak, right)) % a
            x = left * b + right
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    twice = [int(d) * (2 if i % 2 == 0 else 1) for i, d in enumerate(reversed(digits))]
    return str(-sum(d - 9 if d > 9 else d for d in twice) % 10)


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def _permute(self, x: int, n: int, tweak: str) -> int:
        return self.feistel.permute(x, n, tweak, self.back)

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self._permute(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}")).zfill(len(digits))

    def _spread(self, value: str, chars: str, alphabet: re.Pattern) -> str:
        """``chars`` in the places of ``value`` that the pattern allows."""
        it = iter(chars)
        return alphabet.sub(lambda m: next(it), value)

    def _mixed(self, value: str, tweak: str) -> str:
        """Each character to one of its own alphabet: ASCII letters and digits, and those of the other blocks of ``ALPHABETS``, case and all else as they are."""
        own = [ALPHABET_OF.get(c, c) for c in value]
        shape = "".join(a[0] for a in own)
        x, n = 0, 1
        for c, a in zip(value, own, strict=True):
            x, n = x * len(a) + a.index(c), n * len(a)
        x = self._permute(x, n, tweak + shape)
        out = []
        for a in reversed(own):
            x, d = divmod(x, len(a))
            out.append(a[d])
        return "".join(reversed(out))

    def email(self, v: str) -> str | None:
        name, dot, top = v.rpartition(".")
        if not any(c in ALPHABET_OF for c in name):
            return None  # nothing in it can change
        return self._mixed(name, "email") + dot + top

    def ip(self, v: str) -> str | None:
        parts = [int(x) for x in v.split(".")]
        if max(parts) > 255:
            return None
        x = self._permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def iban(self, v: str) -> str | None:
        plain = v.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or _iban_check(country, rest) != check:
            return None
        new = self._mixed(rest, "iban" + country)
        return self._spread(v, country + _iban_check(country, new) + new, re.compile(r"[A-Z0-9]"))

    def date(self, v: str) -> str | None:
        mark = re.search(r"\D", v)[0]
        parts = v.split(mark)
        orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))

        def day(order: tuple, values: list[str]) -> int | None:
            try:
                return datetime.date(*(int(values[i]) for i in order)).toordinal() - FIRST_DAY
            except ValueError:
                return None

        order = next((o for o in orders if day(o, parts) is not None), None)
        if order is None:
            return None
        x = day(order, parts)
        while True:
            x = self._permute(x, DAYS, "date")
            d = datetime.date.fromordinal(x + FIRST_DAY)
            if order != (2, 0, 1) or d.day > 12:  # the other reading comes first where both are possible
                break
        out = [""] * 3
        padded = all(len(p) > 1 for p in parts)
        for i, n in zip(order, (d.year, d.month, d.day), strict=True):
            out[i] = f"{n:02d}" if padded else str(n)
        return mark.join(out)

    def ssn(self, v: str) -> str | None:
        """Numbers that can have been given out: area 001 to 899 without 666, group from 01, serial from 0001."""
        area, group, serial = (int(x) for x in v.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._permute(x, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, v: str) -> str | None:
        """Numbers whose last digit is their Luhn digit; the pseudonym's is as well."""
        digits = re.sub(r"\D", "", v)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self._digits(digits[:-1], "card")
        return self._spread(v, body + luhn_digit(body), re.compile(r"\d"))

    def phone(self, v: str) -> str | None:
        """Seven to fifteen digits with a mark or blank among them; the pseudonym has the same head and is read as a phone number again."""
        if v.isdigit() or not 7 <= sum(c.isdigit() for c in v) <= 15:
            return None  # a plain number
        head = PHONE_HEAD.match(v)[0]
        digits = re.sub(r"\D", "", v[len(head) :])
        whole = PHONE_ALONE.fullmatch(v) is not None
        while True:
            digits = self._digits(digits, "phone")
            new = head + self._spread(v[len(head) :], digits, re.compile(r"\d"))
            if PHONE_HEAD.match(new)[0] == head and (PHONE_ALONE.fullmatch(new) is not None) == whole:
                return new

    def secret(self, v: str) -> str:
        new = f"{self._permute(int(v, 16), 16 ** len(v), f'secret{len(v)}'):0{len(v)}x}"
        return new.upper() if v.isupper() else new

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind it got. Values that fail their validation stay."""
        found: dict[str, int] = {}

        def one(m: re.Match) -> str:
            kind = next(k for k in KINDS if m[k] is not None)
            new = getattr(self, kind)(m[0])
            if new is None:
                return m[0]
            found[kind] = found.get(kind, 0) + 1
            return new

        return (PATTERN.sub(one, text), found) if NEEDS.search(text) else (text, found)


#: What every pattern needs.
NEEDS = re.compile(r"[\d@]")


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """Replace ``text`` and append ``pii_found``, a map from kind to count. A null text stays null, an empty one empty, with an empty map.

    Formats: e-mail addresses (top-level label kept; letters of each alphabet stay in it), IPv4 (parts to 255), IBAN (check
    digits tested and made anew), dates of 1900 to 2099 that the calendar has, social security numbers that can have been
    given out, card numbers of 13 to 19 digits with a right Luhn digit, phone numbers (country code or trunk 0 kept; after
    + or 00 any grouping of 7 to 15 digits, else the groupings of ``PHONE``), hexadecimal secrets. Values that fail these
    tests stay as they are. Where formats overlap the first of ``KINDS`` counts.

    A column ``pii_found`` of the input gets ``input_`` before its name. Rows keep to themselves, so repeated rows get equal
    results; an empty table gives no rows.
    """
    docs, names = make_room(docs, ["pii_found"])
    text = names[text]

    def run(batches):
        give = Pseudonyms(key)
        for batch in batches:
            done = [give.replace(x) if x is not None else (None, {}) for x in batch[text].to_pylist()]
            columns = [pa.array([d[0] for d in done], pa.string()) if c == text else batch[c] for c in batch.schema.names]
            found = pa.array([list(d[1].items()) for d in done], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, found], [*batch.schema.names, "pii_found"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema_of(docs, "pii_found map<string,bigint>"))


def op9_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced, and how many were."""
    df = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.coalesce(F.col("pii_found")[k], F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", "text", *counts)
