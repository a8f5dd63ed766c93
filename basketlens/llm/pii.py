"""Format-preserving pseudonyms for personal data.

Card numbers, phone numbers, social security numbers, account numbers (IBAN), IP
addresses, e-mail addresses, dates and quoted secrets are found by pattern, checked
(Luhn sum, check digits, calendar, octet range) and replaced by a keyed permutation
within their format: a Feistel network over the digits (or characters, or days), walked
until the result is valid again.  The same value gives the same pseudonym in every
document, different values give different ones, and :func:`restore` with the key turns
a pseudonym back.

Kinds and what stays as it is:

* card: 13-19 digits with a right Luhn sum; separators stay, the check digit is recomputed.
* number: other runs of 9-19 digits (not valid cards); separators stay.
* phone: ``+`` and country code stay, all later digits are permuted; separators stay.
* ssn, iban: separators, IBAN country code stay; IBAN check digits are recomputed.  An
  IBAN ends at its country's length, whatever capitals and digits follow.
* ip: a valid IPv4 address becomes a valid one.
* email: letters become letters of that case, digits digits; ``@``, dots and the last
  label (top-level domain) stay.
* date: a calendar day 1900-2099 becomes another one in that notation.
* access_key: the prefix of four letters stays.
* secret: runs of 16 and more hexadecimal or base64 characters, with letters and digits,
  after a quote or an equals sign, each character within its class.  A whole run that is
  another kind's valid value is of that kind, quoted or not; a longer run is a secret, but
  for an IBAN or access key at its start.

The search goes on one character behind the start of what fails its check.  Such a value
gives the same pseudonym as elsewhere, but where it overlaps what failed, that may pass its
check with the pseudonym (one card in ten), and :func:`restore` then misses the value.

Defined results: a null text stays null and counts no replacements, an empty one stays
empty; a text without personal data is returned unchanged.  Rows are independent, so
repeated rows give repeated results; other columns are passed on unread.  Texts of any
length are processed whole, in linear time.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unpacked, whole_row

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY
VALUES_KEPT = 100_000
#: Characters permuted at once; longer values are cut.  No check reaches beyond the first block.
BLOCK = 64
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

RUN = "A-Za-z0-9+/_-"
#: Tried in this order at each place; what fails its check is left to the next ones.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "access_key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
    r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])[0-9]{9,19}(?![0-9A-Za-z])",
    "secret": rf"(?<=[\"'=])(?=[+/_A-Za-z-]*[0-9])(?=[+/_0-9-]*[A-Za-z])[{RUN}]{{16,}}={{0,2}}(?![{RUN}])",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
ONE = {k: re.compile(p) for k, p in KINDS.items()}
#: Kinds that a secret beginning at the same place and ending later does not take over.
CERTAIN = ("email", "access_key", "iban")
#: Length of a country's account numbers; other countries' end where the pattern does.
IBAN_LENGTHS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def iban_within(value: str) -> str | None:
    """The start of ``value`` that has the length of its country's account numbers."""
    size = IBAN_LENGTHS.get(value[:2])
    if size is None:
        return value
    ends = [i for i, c in enumerate(value, 1) if c != " "]
    if len(ends) < size or value[ends[size - 1] :][:1].isalnum():
        return None
    return value[: ends[size - 1]]


#: A text can only hold any of these if it has one of these characters.
HINT = re.compile(r"[0-9@]|A[KS]IA")


def luhn_digit(payload: str) -> str:
    """The check digit that follows ``payload``."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_sum(country: str, account: str, check: str = "00") -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


class Feistel:
    """Keyed permutations of 0 .. size-1; ``tweak`` names the format."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = key, back

    def _mix(self, tweak: str, step: int, half: int, bits: int) -> int:
        message = f"{tweak}|{step}|{half}".encode()
        digest = hmac.digest(self.key, message, "sha256")
        while len(digest) * 8 < bits:
            digest += hashlib.sha256(digest).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _once(self, value: int, bits: int, tweak: str) -> int:
        """Balanced network over ``2 * bits`` bits."""
        left, right = value >> bits, value & ((1 << bits) - 1)
        if not self.back:
            for step in range(ROUNDS):
                left, right = right, left ^ self._mix(tweak, step, right, bits)
        else:
            for step in reversed(range(ROUNDS)):
                left, right = right ^ self._mix(tweak, step, left, bits), left
        return left << bits | right

    def permute(
        self, value: int, size: int, tweak: str, valid: Callable[[int], bool] | None = None
    ) -> int:
        """Walk the cycle until the value is in range and valid, as the start was."""
        if size < 2:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        while True:
            value = self._once(value, bits, tweak)
            if value < size and (valid is None or valid(value)):
                return value


class Pseudonyms:
    """Replaces one value, or all values of a text."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.feistel = Feistel(key, back)
        self.known: dict[tuple[str, str], tuple[str, str] | None] = {}

    def _string(
        self, value: str, alphabets: list[str], tweak: str, valid: Callable[[str], bool] | None = None
    ) -> str:
        """Permute a string whose characters each come from an alphabet of their own.

        Long ones are permuted in blocks from the last to the first, each under the digest of
        the pseudonym behind it.  What ``valid`` asks for must then depend on the first block
        alone, given the alphabets.
        """
        if len(value) <= BLOCK:
            return self._block(value, alphabets, tweak, valid)
        done: list[str] = []
        behind = ""
        for at in reversed(range(0, len(value), BLOCK)):
            part, letters = value[at : at + BLOCK], alphabets[at : at + BLOCK]
            chained = f"{tweak}|{at}|{hashlib.sha256(behind.encode()).hexdigest()}"
            fits = None
            if valid and not at:
                rest = "".join(reversed(done))
                fits = lambda s, rest=rest: valid(s + rest)
            done.append(self._block(part, letters, chained, fits))
            behind = part if self.feistel.back else done[-1]
        return "".join(reversed(done))

    def _block(
        self, value: str, alphabets: list[str], tweak: str, valid: Callable[[str], bool] | None
    ) -> str:
        number = size = 0
        for c, letters in zip(value, alphabets):
            number, size = number * len(letters) + letters.index(c), (size or 1) * len(letters)

        def spelled(number: int) -> str:
            out = []
            for letters in reversed(alphabets):
                number, at = divmod(number, len(letters))
                out.append(letters[at])
            return "".join(reversed(out))

        fits = valid and (lambda n: valid(spelled(n)))
        return spelled(self.feistel.permute(number, size, f"{tweak}:{[len(a) for a in alphabets]}", fits))

    def _digits(self, value: str, tweak: str) -> str:
        return self._string(value, [DIGITS] * len(value), tweak)

    def _into(self, shape: str, characters: str, fits=str.isdigit) -> str:
        rest = iter(characters)
        return "".join(next(rest) if fits(c) else c for c in shape)

    def _classes(self, value: str) -> list[str]:
        return [DIGITS if c in DIGITS else UPPER if c in UPPER else LOWER for c in value]

    def card(self, value: str) -> str | None:
        digits = re.sub(r"[ -]", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        payload = self._digits(digits[:-1], "card")
        if not payload.strip("0"):
            payload = self._digits(payload, "card")
        return self._into(value, payload + luhn_digit(payload))

    def number(self, value: str) -> str:
        """Numbers of card length that are no cards stay no cards."""
        size = 10 ** len(value)
        width = len(value)

        def no_card(n: int) -> bool:
            s = str(n).zfill(width)
            return luhn_digit(s[:-1]) != s[-1]

        valid = no_card if width >= 13 else None
        if valid and not valid(int(value)):
            return value
        return str(self.feistel.permute(int(value), size, f"number:{width}", valid)).zfill(width)

    def phone(self, value: str) -> str:
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|", value)[0]
        rest = value[len(head) :]
        return head + self._into(rest, self._digits(re.sub("[^0-9]", "", rest), f"phone{head}"))

    def ssn(self, value: str) -> str:
        return self._into(value, self._digits(value.replace("-", ""), "ssn"))

    def _is_iban(self, value: str) -> bool:
        plain = value.replace(" ", "")
        return iban_sum(plain[:2], plain[4:], plain[2:4]) == 1

    def iban(self, value: str) -> str | None:
        if not self._is_iban(value):
            return None
        plain = value.replace(" ", "")
        country, account = plain[:2], plain[4:]
        account = self._string(account, self._classes(account), "iban" + country)
        check = str(98 - iban_sum(country, account)).zfill(2)
        return self._into(value, country + check + account, lambda c: c != " ")

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        number = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, number.to_bytes(4, "big")))

    def email(self, value: str) -> str:
        stem, dot, top = value.rpartition(".")
        letters = re.sub("[^A-Za-z0-9]", "", stem)
        letters = self._string(letters, self._classes(letters), "email")
        return self._into(stem, letters, lambda c: c in DIGITS + LOWER + UPPER) + dot + top

    def date(self, value: str) -> str | None:
        form = "%Y-%m-%d" if value[4] == "-" else "%d.%m.%Y" if value[2] == "." else "%m/%d/%Y"
        if form == "%m/%d/%Y" and int(value[:2]) > 12:
            form = "%d/%m/%Y"
        try:
            day = datetime.datetime.strptime(value, form).date().toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        late = lambda n: datetime.date.fromordinal(FIRST_DAY + n).day > 12
        valid = late if form == "%d/%m/%Y" else None
        day = self.feistel.permute(day, DAYS, "date" + form[:2] * bool(valid), valid)
        return datetime.date.fromordinal(FIRST_DAY + day).strftime(form)

    def secret(self, value: str) -> str | None:
        letters = re.sub("[^A-Za-z0-9]", "", value)

        def secret_again(s: str) -> bool:
            new = self._into(value, s, str.isalnum)
            if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or ONE["access_key"].match(new):
                return False
            m = ONE["iban"].match(new)
            account = m and iban_within(m[0])
            return not account or not self._is_iban(account)

        if not secret_again(letters):
            return None
        alphabets, tweak = self._classes(letters), "secret"
        if re.fullmatch("[0-9a-f]+", letters):
            # over several blocks digits stay digits, so that there are still both
            long = len(letters) > BLOCK
            either = [DIGITS if c in DIGITS else "abcdef" for c in letters]
            alphabets, tweak = either if long else [DIGITS + "abcdef"] * len(letters), "hex"
        return self._into(value, self._string(letters, alphabets, tweak, secret_again), str.isalnum)

    def access_key(self, value: str) -> str:
        return value[:4] + self._string(value[4:], [DIGITS + UPPER] * 16, "access_key")

    def replaced(self, kind: str, value: str) -> tuple[str, str] | None:
        """Kind and pseudonym, or None if the value is not valid."""
        key = kind, value
        if key not in self.known:
            if len(self.known) >= VALUES_KEPT:
                self.known.clear()
            found = getattr(self, kind)(value)
            if found is None and kind == "card" and value.isdigit():
                kind, found = "number", self.number(value)
            told = None if found is None else (kind, found)
            if len(value) > 4 * BLOCK:
                return told
            self.known[key] = told
        return self.known[key]

    def _at(self, text: str, start: int) -> tuple[str, str, int] | None:
        """Kind, pseudonym and end of the first valid value that begins at ``start``."""
        secret = ONE["secret"].match(text, start)
        for kind, pattern in ONE.items():
            m = pattern.match(text, start)
            value = iban_within(m[0]) if m and kind == "iban" else m and m[0]
            if value is None or (secret and kind not in CERTAIN and m.end() < secret.end()):
                continue
            found = self.replaced(kind, value)
            if found is not None:
                return *found, start + len(value)
        return None

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each within the new text."""
        if not HINT.search(text):
            return text, []
        out, spans, at, size, look = [], [], 0, 0, 0
        while m := PATTERN.search(text, look):
            found = self._at(text, m.start())
            if found is None:
                look = m.start() + 1
                continue
            kind, value, end = found
            out += [text[at : m.start()], value]
            size += m.start() - at
            spans.append((kind, size, size + len(value)))
            size += len(value)
            at = look = end
        return "".join([*out, text[at:]]) if out else text, spans


SPANS = "array<struct<kind:string,start:int,end:int>>"


def pseudonymize(
    docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = None, back: bool = False
) -> DataFrame:
    """Replace the text column; ``spans_col`` names a column for kinds and places."""
    kind = pa.struct(
        [
            ("text", pa.string()),
            (
                "spans",
                pa.list_(
                    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
                ),
            ),
        ]
    )

    @F.arrow_udf(f"text string, spans {SPANS}")
    def replace(texts: pa.Array) -> pa.Array:
        names = Pseudonyms(key, back)
        out, spans = [], []
        for value in texts:
            text = value.as_py()
            new, places = (None, []) if text is None else names.text(text)
            out.append(new)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in places])
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.string()), pa.array(spans, kind[1].type)], fields=list(kind)
        )

    found = docs.select(whole_row(docs), replace(F.col(f"`{text_col}`")).alias("new"))
    new = {text_col: F.col("new.text")}
    if spans_col:
        new[spans_col] = F.col("new.spans")
    return unpacked(found, docs.columns, **new)


def restore(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Turn the pseudonyms of a text back (each format maps onto itself)."""
    return pseudonymize(docs, key, text_col, back=True)
