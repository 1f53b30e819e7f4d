"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A found value is checked (Luhn, IBAN and calendar rules, number plans), read as a number of its own format, permuted within all
numbers of that format and written back into its own punctuation. The permutation depends on the key and the kind only, so equal
values get equal pseudonyms in all documents and however they are punctuated, different ones stay different, pseudonyms are valid
again, and whoever has the key can turn them back (``restore``; of dates, the day itself: 3/4/2021 may come back as 03/04/2021, and a
day-first date whose pseudonym has a day up to 12 is read month-first). A value that fails its check does not hide one that starts inside
it ("1234 4111 1111 1111 1111"); only such overlapping numbers may turn back wrongly, when the pseudonym makes the failed one valid.

Kinds: payment cards, IBANs, phone numbers, US social security numbers, IPv4 addresses, dates, e-mail addresses (their local part), and
secrets behind a word such as password or token (12 or more hexadecimal digits, or letters mixed with digits). Each text is worked on whole, by
itself, in time that grows with its length; nothing is shuffled. Names and tokens over 256 characters are permuted in parts. A column called
n_found or found makes the output columns take underscores. Defined results: null stays null; texts without such values stay as they are; repeated rows come out alike; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free_name

ROUNDS = 8
PART = 256      # characters of a long name or token that are one number; its parts are permuted one by one
HEXADECIMAL = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


class Feistel:
    """Keyed permutations of 0..size-1 for any size, with their inverses."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, kind: str, size: int, turn: int, half: int, out: int) -> int:
        data = f"{kind}|{size}|{turn}|{half}".encode()
        wide = -(-out.bit_length() // 8) + 8
        digest = b"".join(hashlib.blake2b(data, key=self.key, digest_size=64, salt=i.to_bytes(16, "big")).digest() for i in range(-(-wide // 64)))
        return int.from_bytes(digest[:wide], "big") % out

    def _pass(self, x: int, kind: str, size: int, back: bool) -> int:
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        left, right = divmod(x, b)
        for turn in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._f(kind, size, turn, left, b)) % b
            else:
                left = (left + sign * self._f(kind, size, turn, right, a)) % a
        return left * b + right

    def permute(self, x: int, kind: str, size: int, within=None, back: bool = False) -> int:
        """The image of x; outside the range, or outside ``within``, the walk goes on, so the numbers that satisfy it map to each other."""
        if size <= 1:
            return x
        while True:
            x = self._pass(x, kind, size, back)
            if x < size and (within is None or within(x)):
                return x


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _refill(shape: str, new: str) -> str:
    """``shape`` with its letters and digits replaced in order by those of ``new``."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _parts(s: str) -> list[str]:
    return [s[i:i + PART] for i in range(0, len(s), PART)]


def luhn(digits: str) -> int:
    """The check digit that ``digits`` need."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _social(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _plan(x: int) -> bool:      # a number of the North American plan
    return x // 10 ** 9 >= 2 and x // 10 ** 6 % 10 >= 2


def _host(x: int) -> bool:
    return 0 < x >> 24 < 224 and x >> 24 != 127


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back, self._known = Feistel(key), back, {}

    def _p(self, x: int, kind: str, size: int, within=None) -> int:
        if len(self._known) > 200_000:
            self._known.clear()
        at = (x, kind, size)
        if at not in self._known:
            self._known[at] = self.feistel.permute(x, kind, size, within, self.back)
        return self._known[at]

    def mixed(self, s: str, kind: str, within=None) -> str:
        """Permute letters and digits, each within its own alphabet and case; anything else stays. ``within`` tells of the text, not its number."""
        value, size, places = 0, 1, []
        for c in s:
            base, low = (10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c)
            places.append((base, low))
            value = value * base + (ord(c) - ord(low))
            size *= base

        def written(value: int) -> str:
            out = []
            for base, low in reversed(places):
                value, d = divmod(value, base)
                out.append(chr(ord(low) + d))
            return "".join(reversed(out))

        return written(self._p(value, kind + ":" + "".join(low for _, low in places), size, within and (lambda x: within(written(x)))))

    def card(self, s: str) -> str | None:
        d = _digits(s)
        if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        n = len(d) - 1
        low = 0 if d[0] == "0" else 10 ** (n - 1)
        size = 10 ** (n - 1) if d[0] == "0" else 9 * 10 ** (n - 1)
        body = str(low + self._p(int(d[:-1]) - low, f"card{n}{'z' if d[0] == '0' else ''}", size)).zfill(n)
        return _refill(s, body + str(luhn(body)))

    def iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        if not 15 <= len(d) <= 34 or _iban_check(d[:2], d[4:]) != d[2:4]:
            return None
        n = IBAN_LENGTHS.get(d[:2], len(d))
        # Of a longer one, whether its beginning passes as well stays as it is, so that it is read alike when turned back.
        begins = lambda body: _iban_check(d[:2], body[:n - 4]) == _iban_check(d[:2], body)      # noqa: E731
        own = begins(d[4:])
        body = self.mixed(d[4:], "iban" + d[:2], (lambda body: begins(body) == own) if n < len(d) else None)
        return _refill(s, d[:2] + _iban_check(d[:2], body) + body)

    def phone(self, s: str) -> str | None:
        d = _digits(s)
        if s.startswith("+") and not (len(d) == 11 and d[0] == "1"):
            lead = d[:3]
            return "+" + _refill(s[1:], lead + self.mixed(d[3:], "tel" + lead)) if 8 <= len(d) <= 15 else None
        own = int(d[-10:])
        same = _plan if _plan(own) else (lambda x: not _plan(x))
        return s[:1] * s.startswith("+") + _refill(s[s.startswith("+"):], d[:-10] + f"{self._p(own, 'nanp', 10 ** 10, same):010d}")

    def social(self, s: str) -> str | None:
        own = int(_digits(s))
        return _refill(s, f"{self._p(own, 'social', 10 ** 9, _social):09d}") if _social(own) else None

    def address(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        own = int.from_bytes(bytes(parts), "big") if max(parts) < 256 else 0
        return ".".join(map(str, self._p(own, "ipv4", 1 << 32, _host).to_bytes(4, "big"))) if _host(own) else None

    def date(self, s: str) -> str | None:
        parts = re.split(r"([^0-9])", s)
        n = [int(x) for x in parts[::2]]
        year_first = len(parts[0]) == 4
        y, (a, b) = (n[0], n[1:]) if year_first else (n[2], n[:2])
        day_first = not year_first and (parts[1] == "." or a > 12)
        m, d = (b, a) if day_first else (a, b)
        try:
            own = datetime.date(y, m, d).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= own < DAYS:
            return None
        new = self._p(own, "date", DAYS)
        at = datetime.date.fromordinal(FIRST_DAY + new)
        wide = [len(x) for x in parts[::2]]
        if year_first:
            return f"{at.year}{parts[1]}{at.month:02d}{parts[3]}{at.day:02d}"
        padded = wide[0] == 2 and wide[1] == 2 and (parts[0][0] == "0" or parts[2][0] == "0" or min(n[:2]) > 9)
        form = "02d" if padded else "d"
        x, z = (at.day, at.month) if day_first else (at.month, at.day)
        return f"{x:{form}}{parts[1]}{z:{form}}{parts[3]}{at.year}"

    def email(self, s: str) -> str | None:
        local, _, host = s.rpartition("@")
        return "".join(self.mixed(x, f"email{i or ''}") for i, x in enumerate(_parts(local))) + "@" + host

    def secret(self, s: str) -> str | None:
        if len(s) > PART or not HEXADECIMAL.fullmatch(s):       # what is hexadecimal stays so, what is not does not become it
            other = (lambda x: not HEXADECIMAL.fullmatch(x)) if len(s) <= PART else None
            return "".join(self.mixed(x, f"token{i}", other) for i, x in enumerate(_parts(s)))
        size = 16 ** len(s)
        body = f"{self._p(int(s, 16), f'secret{len(s)}', size):0{len(s)}x}"
        return body if s == s.lower() else body.upper() if s == s.upper() else None


#: A number may stand after a full stop or an underscore, but not after a letter, a digit, or a digit and a full stop.
NUMBERS = re.compile(r"""(?<![^\W_])(?<!\d\.)(?:
    (?P<address>\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
  | (?P<date>\d{4}-\d\d-\d\d(?=[Tt]\d)|(?:\d{4}-\d\d-\d\d|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]))
  | (?P<social>\d{3}-\d\d-\d{4}(?![\w-]))
  | (?P<phone>(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w]))
  | (?P<card>(?:\d{13,19}|\d{4}(?:[ ]\d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ ]\d{6}[ ]\d{5}|\d{4}-\d{6}-\d{5})(?![\w]))
)""", re.X)
STARTS = re.compile(r"[+(]?\d")
IBAN = re.compile(r"\b(?P<iban>[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)\b")
# The length of an IBAN by country.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
    32: "LC", 33: "RU"}.items() for country in countries.split()}
IBANS = {n: re.compile(rf"(?P<iban>[A-Z]{{2}}\d\d(?:[ ]?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"[ ]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r")\b")
         for n in set(IBAN_LENGTHS.values())}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-.")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SECRET = re.compile(r"""(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b["']?\s*[:=]\s*["']?)(?P<secret>(?:[0-9a-f]{12,}|[0-9A-F]{12,})(?![\w+/=-])|(?=[A-Za-z_+/-]*+\d)(?=[\d_+/-]*+[A-Za-z])[\w+/-]{12,}+=*+)(?!\w)""", re.A)
KINDS = ["card", "iban", "phone", "social", "address", "date", "email", "secret"]


def _checked(m: re.Match | None, names: Pseudonyms):
    """(start, end, kind, pseudonym), or None where nothing matched or the value fails the check of its kind."""
    new = getattr(names, m.lastgroup)(m[m.lastgroup]) if m else None
    return None if new is None else (*m.span(m.lastgroup), m.lastgroup, new)


def _shorter(m: re.Match | None, names: Pseudonyms):
    """An international number without the groups of digits after it that make it too long."""
    value = m["phone"] if m and m.lastgroup == "phone" else ""
    while len(_digits(value)) > 15 and (cut := max(map(value.rfind, " .-"))) > 0:
        value = value[:cut]
    new = names.phone(value) if value else None
    return None if new is None else (m.start(), m.start() + len(value), "phone", new)


def _numbers(text: str, names: Pseudonyms):
    """Values of NUMBERS, tried only where a number starts: at its sign or parenthesis, then at its first digit."""
    at = 0
    while start := STARTS.search(text, at):
        m, digit = NUMBERS.match(text, start.start()), start.end() - 1
        hit = _checked(m, names)
        if not hit and digit > start.start():
            hit = _checked(NUMBERS.match(text, digit), names)
        if hit := hit or _shorter(m, names):
            yield hit
            at = hit[1]
        else:
            at = start.end()
            while at < len(text) and text[at].isdigit():
                at += 1


def _ibans(text: str, names: Pseudonyms):
    """IBANs of their country's length, else the longest that passes for one."""
    at = 0
    while m := IBAN.search(text, at):
        own = IBANS.get(IBAN_LENGTHS.get(m["iban"][:2]))
        hit = _checked(own and own.match(text, m.start()), names) or _checked(m, names)
        if hit:
            yield hit
        at = hit[1] if hit else m.start() + 1


def _emails(text: str, names: Pseudonyms):
    """Addresses, from each @ outwards: to the left over the dotted words of the name, to the right over the host."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        name = text[start:at]
        name = name[name.rfind("..") + 2 if ".." in name else 0:].lstrip(".")
        host = HOST.match(text, at + 1) if name and not name.endswith(".") else None
        if host:
            end = host.end()
            yield at - len(name), end, "email", names.email(name + "@" + host[0])
        at = text.find("@", max(at + 1, end))


def replace(text: str, names: Pseudonyms, found: dict[str, int] | None = None) -> str:
    hits = [*_numbers(text, names), *_ibans(text, names), *_emails(text, names)]
    if "=" in text or ":" in text:
        hits += filter(None, (_checked(m, names) for m in SECRET.finditer(text)))
    out, at = [], 0
    for start, end, kind, new in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start < at:
            continue
        out += [text[at:start], new]
        at = end
        if found is not None:
            found[kind] = found.get(kind, 0) + 1
    return "".join([*out, text[at:]]) if out else text


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", restore: bool = False) -> DataFrame:
    """``docs`` with the values in ``text`` replaced (or, with ``restore``, turned back), plus ``n_found`` and ``found``, the counts by
    kind as text."""
    names = docs.columns
    counted, kinds = free_name(docs, "n_found"), free_name(docs, "found")
    schema = T.StructType([*docs.schema.fields]).add(counted, "long").add(kinds, "string")

    def run(batches):
        pseudonyms = Pseudonyms(key, back=restore)
        for b in batches:
            new, n, by = [], [], []
            for value in b.column(b.schema.get_field_index(text)):
                found: dict[str, int] = {}
                value = value.as_py()
                new.append(None if value is None else replace(value, pseudonyms, found))
                n.append(sum(found.values()))
                by.append(",".join(f"{k}:{found[k]}" for k in KINDS if k in found))
            columns = [pa.array(new, b.schema.field(c).type) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(by, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
