"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel network.

Values are found by pattern and then validated: card numbers (13 to 19 digits, Luhn), IBANs (modulo 97), US social security
numbers, phone numbers (with a plus or brackets any, else such as
the North American plan allows), IPv4 addresses, e-mail addresses, dates in ISO, slash and dot order, and hexadecimal secrets after
a word like token or key. What fails its validation is tried again without its last group, as long as a group is
left, and stays as it is if no part is valid; the search goes on after what was taken. Each value is brought to a canonical number, permuted
within its own domain (rounds keyed by BLAKE2, walking on until the result is valid again), and written in the format it
came in: separators, letter case and lengths stay, check digits are recomputed. The permutation depends on the key and the
kind alone, so equal values have equal pseudonyms in all documents, different ones different ones, and whoever has
the key can turn them back (``restore``). The exception: a value found in front of groups that its pseudonym would be read
together with as one longer value (one in ten of card numbers before other digits) is permuted again until it is not.

Defined cases: null stays null with no values found; texts without values are returned unchanged, byte for byte. Repeated
rows give equal results; extra columns are ignored. Overlapping candidates are taken from left to right, the longest
kind first. Texts are read whole, in one pass.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

ROUNDS = 10
KINDS = ("email", "secret", "iban", "ipv4", "date", "ssn", "phone", "card")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31

PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"
    r"|(?P<secret>(?<=[\"'=: ])(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ipv4>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
)
SECRET_WORD = re.compile(r"(?i)(?:token|key|secret|password|passwd|pwd)\W{0,6}$")
#: Every pattern implies one of these: two digits with at most two separators between them, an @, or a secret's length.
#: Digits are those of ASCII everywhere: others have no place in the formats.
MAY_HOLD = re.compile(r"[0-9][ ./()-]{0,2}[0-9]|@|[0-9a-fA-F]{32}")


class Permuter:
    """A keyed permutation of the numbers below any bound, for each kind of value."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, size: int, i: int, value: int, bound: int) -> int:
        word = f"{kind}|{size}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(word, key=self.key, digest_size=32).digest(), "big") % bound

    def _once(self, x: int, size: int, kind: str, back: bool) -> int:
        a = 1
        while a * a < size:
            a *= 2
        b = -(-size // a)
        left, right = x % a, x // a
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                left = (left + sign * self._round(kind, size, i, right, a)) % a
            else:
                right = (right + sign * self._round(kind, size, i, left, b)) % b
        return left + a * right

    def walk(self, x: int, size: int, kind: str, valid=lambda x: True, back: bool = False) -> int:
        """The next valid number on x's cycle: a permutation of the valid numbers."""
        while True:
            x = self._once(x, size, kind, back)
            if x < size and valid(x):
                return x


def luhn_digit(body: str) -> str:
    """The check digit that makes body followed by it valid."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _iban_number(text: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in text[4:] + text[:4]))


def _digit(ch: str) -> bool:
    return "0" <= ch <= "9"


def _refill(shape: str, symbols: str) -> str:
    """The symbols in place of shape's digits (and letters, where there are as many symbols)."""
    it = iter(symbols)
    only_digits = sum(map(_digit, shape)) == len(symbols)
    return "".join(next(it) if (_digit(ch) if only_digits else ch.isalnum()) else ch for ch in shape)


def _mixed(p: Permuter, text: str, kind: str, back: bool) -> str:
    """Letters a-z and digits of text permuted within their classes; all other characters stay."""
    classes = {**dict.fromkeys(string.digits, string.digits), **dict.fromkeys(string.ascii_lowercase, string.ascii_lowercase)}
    at = [i for i, ch in enumerate(text) if ch.lower() in classes]
    size, number = 1, 0
    for i in at:
        c = classes[text[i].lower()]
        number = number * len(c) + c.index(text[i].lower())
        size *= len(c)
    if size < 2:
        return text
    shape = "".join("9" if _digit(ch) else "a" if ch.lower() in classes else ch for ch in text.lower())
    number = p.walk(number, size, f"{kind}:{shape}", back=back)
    out = list(text)
    for i in reversed(at):
        c = classes[text[i].lower()]
        number, d = divmod(number, len(c))
        out[i] = c[d].upper() if text[i].isupper() else c[d]
    return "".join(out)


def _date(text: str) -> tuple[datetime.date, str] | None:
    sep = next(ch for ch in text if not _digit(ch))
    parts = [int(x) for x in text.split(sep)]
    for order in (("ymd",) if sep == "-" else ("dmy", "mdy") if sep == "." else ("mdy", "dmy")):
        by = dict(zip(order, parts, strict=True))
        try:
            found = datetime.date(by["y"], by["m"], by["d"])
        except ValueError:
            continue
        return (found, order) if 0 <= found.toordinal() - FIRST_DAY < DAYS else None
    return None


def pseudonym(p: Permuter, kind: str, text: str, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if the value isn't valid. With back, the value of a pseudonym."""
    digits = "".join(filter(_digit, text))
    if kind == "email":
        local, at, domain = text.partition("@")
        return _mixed(p, local, "email", back) + at + domain
    if kind == "secret":
        number = p.walk(int(text, 16), 16 ** len(text), f"secret{len(text)}", back=back)
        out = f"{number:0{len(text)}x}"
        return out.upper() if text.isupper() else out
    if kind == "ipv4":
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or parts[0] == 0:
            return None
        number = p.walk(int.from_bytes(bytes(parts), "big"), 2**32, "ipv4", lambda x: x >> 24 > 0, back)
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "date":
        if not (got := _date(text)):
            return None
        day, order = got
        sep = next(ch for ch in text if not _digit(ch))
        parts = text.split(sep)

        def valid(x: int) -> bool:  # written in this order it must be read as the same day again
            d = datetime.date.fromordinal(x + FIRST_DAY)
            return order in ("ymd", "dmy" if sep == "." else "mdy") or (d.month, d.day)[order == "mdy"] > 12 or order == "dmy" and d.day > 12

        d = datetime.date.fromordinal(p.walk(day.toordinal() - FIRST_DAY, DAYS, "date" if order in ("ymd", "dmy" if sep == "." else "mdy") else f"date-{order}{sep}", valid, back) + FIRST_DAY)
        value = {"y": d.year, "m": d.month, "d": d.day}
        return sep.join(str(value[k]).zfill(len(x)) for k, x in zip(order, parts, strict=True))
    if kind == "ssn":

        def valid_ssn(x: int) -> bool:
            return x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 > 0 and x % 10**4 > 0

        return _refill(text, f"{p.walk(int(digits), 10**9, 'ssn', valid_ssn, back):09d}") if valid_ssn(int(digits)) else None
    if kind == "phone":
        north = "(" in text or not text.startswith("+")
        body = digits[-10:] if north else digits[-7:]
        plan = lambda x: x // 10**9 > 1 and x // 10**6 % 10 > 1  # noqa: E731  area and exchange begin with 2 to 9
        if not 8 <= len(digits) <= 15:
            return None
        if not north:
            number = p.walk(int(body), 10 ** len(body), "phone-local:" + digits[: -len(body)], back=back)
        elif plan(int(body)):
            number = p.walk(int(body), 10**10, "phone", plan, back)
        elif "(" in text or text.startswith("+"):  # written as a phone number, if in no area that exists
            number = p.walk(int(body), 10**10, "phone-elsewhere", lambda x: not plan(x), back)
        else:
            return None
        return _refill(text, digits[: -len(body)] + f"{number:0{len(body)}d}")
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        many = lambda x: len(set(f"{x:0{n}d}" + luhn_digit(f"{x:0{n}d}"))) > 1
        body = f"{p.walk(int(digits[:-1]), 10**n, f'card{n}', many, back):0{n}d}"
        return _refill(text, body + luhn_digit(body))
    if kind == "iban":
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _iban_number(bare) % 97 != 1:
            return None
        body = _mixed(p, bare[4:].lower(), "iban" + bare[:2], back).upper()
        check = 98 - _iban_number(bare[:2] + "00" + body) % 97
        return _refill(text, f"{bare[:2]}{check:02d}{body}")
    raise ValueError(kind)


def _prefixes(kind: str, raw: str) -> Iterator[str]:
    """The candidate and, of kinds that are written in groups, its shorter prefixes that end at a group's border."""
    yield raw
    if kind in ("card", "iban", "phone"):
        for m in reversed(list(re.finditer(r"[ .-]", raw))):
            yield raw[: m.start()]


def _first(p: Permuter, kind: str, raw: str) -> tuple[str, int] | None:
    """The kind and length of the longest valid value that the candidate begins with."""
    for part in _prefixes(kind, raw):
        for k in (kind, "card") if kind == "phone" else (kind,):  # digits with a plus or dots may still be a card
            if pseudonym(p, k, part) is not None:
                return k, len(part)
    return None


def pseudonymise(p: Permuter, text: str | None, back: bool = False) -> tuple[str | None, list[str]]:
    """The text with its values replaced, and their kinds in order."""
    if not text or not MAY_HOLD.search(text):
        return text, []
    kinds: list[str] = []

    def put(m: re.Match) -> tuple[str, int]:
        """What stands for the match, and the end of what it replaces; that is the start of the match if no value was found."""
        kind, raw = m.lastgroup, m[0]
        if kind == "secret" and not SECRET_WORD.search(text, max(0, m.start() - 24), m.start()):
            return "", m.start()
        if kind == "email":
            raw = raw.rstrip(".-")
        whole = pseudonym(p, kind, raw, back)
        if whole is not None:
            kinds.append(kind)
            return whole, m.start() + len(raw)
        found = _first(p, kind, raw)
        if not found:
            return "", m.start()
        k, n = found
        got = pseudonym(p, k, raw[:n], back)
        # walks on while the pseudonym and the groups after it would be read as another value
        while _first(p, kind, got + raw[n:]) != found:
            got = pseudonym(p, k, got, back)
        kinds.append(k)
        return got, m.start() + n

    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        got, end = put(m)
        if end > m.start():
            out += [text[done : m.start()], got]
            done = at = end
        else:  # nothing of it is a value
            at = m.end()
    return "".join([*out, text[done:]]), kinds


_OWN_KEYS: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key in spark.seqloom.pii.key. Without one, a random key of this application: nobody can turn its pseudonyms back,
    and they are linked within the application only."""
    given = spark.conf.get("spark.seqloom.pii.key", None)
    return given.encode() if given else _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _mapped(df: DataFrame, key: bytes, text_col: str, id_col: str, back: bool) -> DataFrame:
    small_batches(df)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = [pseudonymise(p, t, back) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(k) for _, k in done], pa.int32()), pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string())), pa.array([t for t, _ in done], pa.string())],
                    names=["id", "n_found", "kinds", "text"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_found int, kinds array<string>, text string").withColumnRenamed("id", id_col)


def mask(df: DataFrame, key: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_found, kinds, text with pseudonyms, for each row."""
    return _mapped(df, key, text_col, id_col, False)


def restore(df: DataFrame, key: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The reverse of mask under the same key."""
    return _mapped(df, key, text_col, id_col, True)
