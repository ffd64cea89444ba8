r"""Personal data replaced by surrogates: keyed, of the same type and format, one for each original.

Detected: e-mail addresses, telephone, payment-card, IP (both versions), MAC, IBAN and social-security numbers, cloud keys,
tokens and passwords that a text assigns, and names behind a form of address; a name without one is not. Each gets a
surrogate of its own kind: the same separators, lengths, kinds of characters, case and script; a card of the same network whose
check digit is right or wrong as before; an address of the same network class; an IBAN that checks; for a listed first name
one of the same gender and script; for other names letters of the same kind, vowels for vowels, and in scripts without a list
of kinds letters of the same Unicode block and case.

A surrogate is the original enciphered: the characters that may change are a number in mixed radix. A keyed Feistel
network puts all numbers in an order, and the surrogate is the next one in it that is of the form asked for. That is a
permutation without a fixed point, so an original has the same surrogate in every document (coreference; numbers and addresses
are compared without their punctuation and case), never itself, and different originals have different ones, without a
table that grows with the corpus. collisions() checks it over all entities of a corpus all the same, and surrogates() does so
before it returns anything.

The key is spark.facetwise.pii.key of the session's settings. Without it a random one is drawn for the application, which nobody
can undo later; to have the same surrogates in two applications, set it.

Null text stays null, empty text stays empty, and both have no entities. Rows are independent of each other, repeated ones too.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS, hold, rows_a_batch, settle, text_by_text

KEY_SETTING = "spark.facetwise.pii.key"
ROUNDS = 6

# First names by gender and script, forms of address by gender.
MALE_LATIN = "Adam Albert Andreas Anton Bernard Carlos Charles Daniel David Diego Edward Emil Felix Frank George Hans Henri Hugo James Javier John Joseph Juan Karl Klaus Louis Lucas Manuel Marc Martin Michael Miguel Oscar Pablo Paul Peter Philip Pierre Rafael Richard Robert Samuel Stefan Thomas Victor Walter William".split()
FEMALE_LATIN = "Alice Amelia Anna Barbara Carla Carmen Caroline Catherine Charlotte Clara Claire Diana Elena Elisabeth Emily Emma Eva Helen Helga Ines Isabel Jane Jennifer Julia Karin Laura Linda Lucia Margaret Maria Marie Marta Mary Monica Nina Olivia Patricia Paula Petra Rosa Ruth Sabine Sarah Sofia Sophie Susan Teresa Ursula".split()
MALE_CYRILLIC = "Александр Алексей Андрей Антон Борис Виктор Владимир Дмитрий Иван Игорь Максим Михаил Николай Олег Павел Сергей".split()
FEMALE_CYRILLIC = "Александра Анастасия Анна Вера Дарья Екатерина Елена Ирина Ксения Людмила Мария Наталья Ольга Светлана Татьяна Юлия".split()
ADDRESS = "Mr. Mrs. Ms. Miss Sir Madam Dr. Prof. Herr Herrn Frau Monsieur Madame Mademoiselle Mme Señor Señora Señorita Sr. Sra. господин госпожа г-н г-жа".split()
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
LONG_VOWELS, OTHER_LATIN = "àáâäèéêëìíîïòóôöùúûü", "çñ"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
RESERVED = re.compile(r"(^|\.)(example\.(com|org|net)|example|test|invalid|localhost)$")

FIRST_NAMES = [MALE_LATIN, FEMALE_LATIN, MALE_CYRILLIC, FEMALE_CYRILLIC]
LISTED = {n.lower(): (names, i) for names in FIRST_NAMES for i, n in enumerate(names)}

_KINDS = {c: k for k in ("0123456789", VOWELS, CONSONANTS, LONG_VOWELS, OTHER_LATIN, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS, GREEK) for c in k}
_LETTERS = {**{c: "0123456789" for c in "0123456789"}, **{c: VOWELS + CONSONANTS for c in VOWELS + CONSONANTS}}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
#: Blocks of letters that are wider than BLOCK code points: ideographs and Hangul syllables.
WIDE, BLOCK = ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3)), 128

_own_keys: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key from the session's settings, or a random one of this application."""
    found = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    return found.encode() if found else _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


@functools.lru_cache(4096)
def letters_like(c: str) -> str:
    """The letters that may stand for a letter of a name: those of its fixed kind, or of its block, category and case."""
    if c in _KINDS or not c.isalpha():
        return _KINDS.get(c, "")
    first, last = next((b for b in WIDE if b[0] <= ord(c) <= b[1]), (ord(c) // BLOCK * BLOCK, ord(c) // BLOCK * BLOCK + BLOCK - 1))
    kind = unicodedata.category(c)
    alone = lambda x: len(x.upper()) == 1 and x.upper().lower() == x  # noqa: E731  it has a capital of its own
    return "".join(x for x in map(chr, range(first, last + 1)) if unicodedata.category(x) == kind and x not in _KINDS and (alone(x) == alone(c)))


class _NameKinds:
    get = staticmethod(letters_like)


@functools.lru_cache(4096)
def _places(alphabet: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(alphabet)}


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """The number after value in a keyed order of 0 .. size - 1; another order for each tweak."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    base = hashlib.blake2b(f"{tweak}|{size}".encode(), key=key[:64])

    def feistel(number: int, rounds) -> int:
        left, right = number >> half, number & mask
        if rounds is _BACK:
            left, right = right, left
        for r in rounds:
            h = base.copy()
            h.update(bytes([r]) + right.to_bytes(width, "big"))
            left, right = right, left ^ (int.from_bytes(h.digest(), "big") & mask)
        return right << half | left if rounds is _BACK else left << half | right

    while (place := feistel(value, _FORTH)) >= size:  # walks on: a permutation of the numbers below size
        value = place
    value = (place + 1) % size
    while (value := feistel(value, _BACK)) >= size:
        pass
    return value


_FORTH, _BACK = range(ROUNDS), range(ROUNDS - 1, -1, -1)


def encipher(text: str, kinds, key: bytes, tweak: str, fits: Callable[[str], bool] = lambda s: True) -> str:
    """Each character for which kinds has an alphabet becomes one of it; the others stay. The next text in order that fits."""
    alphabets = [kinds.get(c) or "" for c in text]
    size, value = 1, 0
    for c, a in zip(text, alphabets):
        if a:
            size, value = size * len(a), value * len(a) + _places(a)[c]
    shape = "".join(c if not a else a[0] for c, a in zip(text, alphabets))
    while True:
        value = rest = permute(value, size, key, f"{tweak}|{shape}")
        out = []
        for c, a in zip(reversed(text), reversed(alphabets)):
            if a:
                rest, at = divmod(rest, len(a))
                c = a[at]
            out.append(c)
        found = "".join(reversed(out))
        if fits(found):
            return found


def with_case(new: str, old: str) -> str:
    return "".join(n.upper() if o.isupper() else n for n, o in zip(new, old)) if len(new) == len(old) else new


def spread(digits: str, shape: str) -> str:
    """The digits in the places of the shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


DIGITS = {c: "0123456789" for c in "0123456789"}


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def card(text: str, key: bytes) -> str:
    d = only_digits(text)
    body = d[0] + encipher(d[1:-1], DIGITS, key, f"card{d[0]}")
    return spread(body + str((int(d[-1]) - luhn(d[:-1]) + luhn(body)) % 10), text)


def phone(text: str, key: bytes) -> str:
    country = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    head = country[0] if country else ""
    rest = text[len(head) :]
    d = only_digits(rest)
    if len(d) == 10 and head in ("", "+1"):  # area and line change; the fictional exchange 555 stays
        fits = lambda s: s[0] in "23456789" if d[0] in "23456789" else s[0] not in "23456789"
        if d[3:6] == "555":
            e = encipher(d[:3] + d[6:], DIGITS, key, "phone555", fits)
            return head + spread(e[:3] + "555" + e[3:], rest)
        return head + spread(encipher(d, DIGITS, key, "phone", lambda s: fits(s) and s[3:6] != "555"), rest)
    return head + spread(encipher(d, DIGITS, key, f"phone{head}", lambda s: (s[0] == "0") == (d[0] == "0")), rest)


def network(octets: list[int]) -> int:
    a, b = octets[0], octets[1]
    return 1 if a == 10 else 2 if a == 127 else 3 if (a, b) == (192, 168) else 4 if a == 172 and 16 <= b < 32 else 5 if a == 0 or a >= 224 else 0


def ip(text: str, key: bytes) -> str:
    octets = [int(x) for x in text.split(".")]
    fixed = {0: 0, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1}[network(octets)]
    value, size = 0, 256 ** (4 - fixed)
    for x in octets[fixed:]:
        value = value * 256 + x
    while True:
        value = permute(value, size, key, f"ip{octets[:fixed]}")
        new = octets[:fixed] + [value >> 8 * i & 255 for i in reversed(range(4 - fixed))]
        if network(new) == network(octets):
            return ".".join(map(str, new))


def ip6(text: str, key: bytes) -> str:
    """The first group, which tells the kind of network, stays."""
    head, colon, rest = text.partition(":")
    low = encipher(rest.lower(), _HEX, key, f"ip6{head.lower()}")
    return head + colon + (low.upper() if rest.isupper() else low)


def is_ip6(text: str) -> bool:
    try:
        return len(re.findall("[0-9A-Fa-f]+", text)) >= 3 and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def email(text: str, key: bytes) -> str:
    low = text.lower()
    local, _, domain = low.rpartition("@")
    labels = domain.split(".")
    new = domain if RESERVED.search(domain) else ".".join([*(encipher(x, _LETTERS, key, "domain") for x in labels[:-1]), labels[-1]])
    return with_case(f"{encipher(local, _LETTERS, key, f'mail@{domain}')}@{new}", text)


def hexlike(text: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text))


def secret(text: str, key: bytes) -> str:
    head = re.match(r"(?:AKIA|ASIA|sk-|gh[pousr]_|xox[abprs]-)?", text)[0]
    body = text[len(head) :]
    if hexlike(body):
        out = encipher(body.lower(), _HEX, key, f"secret{head}")
        return head + (out.upper() if body.isupper() else out)
    kinds = {c: a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in a}
    return head + encipher(body, kinds, key, f"secret{head}", lambda s: not hexlike(s))


def ssn(text: str, key: bytes) -> str:
    fits = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    d = only_digits(text)
    return spread(encipher(d, DIGITS, key, "ssn", fits if fits(d) else lambda s: not fits(s)), text)


def mac(text: str, key: bytes) -> str:
    return with_case(encipher(text.lower(), _HEX, key, "mac"), text) if not text.isupper() else encipher(text.lower(), _HEX, key, "mac").upper()


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    kinds = {**DIGITS, **{c: "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
    body = encipher(plain[4:], kinds, key, f"iban{plain[:2]}")
    it = iter(plain[:2] + iban_check(plain[:2], body) + body)
    return "".join(" " if c == " " else next(it) for c in text)


def one_name(text: str, key: bytes) -> str:
    """A listed first name to another of its list; another name to letters of the same kind."""
    low = text.lower()
    if low in LISTED:
        names, i = LISTED[low]
        new = names[permute(i, len(names), key, f"first{names[0]}")]
        return new.upper() if text.isupper() else new
    return with_case(encipher(low, _NameKinds, key, "name", lambda s: s not in LISTED), text)


def name(text: str, key: bytes) -> str:
    return re.sub(r"[^\W\d_]+", lambda m: one_name(m[0], key), text)


def is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and plain[2:4] == iban_check(plain[:2], plain[4:])


_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_capital = r"[^\W\d_a-zß-öø-ÿа-я]\w+"  # of scripts without case any word
#: type, group of the match that is replaced, pattern, surrogate, condition. Earlier ones go first where they meet.
DETECTORS = [
    ("email", 0, re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email, None, "@"),
    ("secret", 0, re.compile(r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,})\b"), secret, None, "0"),
    ("secret", 1, re.compile(r"(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?(?=[^\s\"']*\d)([A-Za-z0-9+/_.-]{8,})"), secret, None, "0"),
    ("mac", 0, re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"), mac, None, "0"),
    ("ip", 0, re.compile(rf"(?<![\d.])(?:{_octet}\.){{3}}{_octet}(?!\d|\.\d)"), ip, None, "0"),
    ("ip", 0, re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])"), ip6, is_ip6, ":"),
    ("iban", 0, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), iban, is_iban, "0"),
    ("ssn", 0, re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), ssn, None, "0"),
    ("card", 0, re.compile(r"(?<![\w.+-])[3-6](?:\d{12,18}|\d{3}(?:[ -]\d{4}){3}|\d{3}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)"), card, None, "0"),
    ("phone", 0, re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"), phone, None, "0"),
    ("phone", 0, re.compile(r"(?<![\w.+/=:-])[2-9]\d{2}[2-9]\d{6}(?![\w:-]|\.\d)"), phone, None, "0"),
    ("name", 1, re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, ADDRESS))})\s((?:{_capital})(?:[ -](?:{_capital})){{0,2}})"), name, None, " "),
]
_digit, _address = re.compile(r"\d"), re.compile("|".join(map(re.escape, ADDRESS)))


def entities(text: str) -> list[tuple[int, int, str, Callable]]:
    """(start, end, type, function) of the entities of a text, in order, none over another."""
    has = {"0": bool(_digit.search(text)), "@": "@" in text, ":": text.count(":") > 1, " ": bool(_address.search(text))}
    taken, out = [], []
    for kind, group, pattern, make, condition, needs in DETECTORS:
        if not has[needs]:
            continue
        for m in pattern.finditer(text):
            s, e = m.span(group)
            if all(e <= a or s >= b for a, b in taken) and (condition is None or condition(text[s:e])):
                taken.append((s, e))
                out.append((s, e, kind, make))
    return sorted(out, key=lambda x: x[0])


@functools.lru_cache(100_000)
def _made(make: Callable, original: str, key: bytes) -> str:
    return make(original, key)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, original, surrogate) of its entities."""
    found, out, at = [], [], 0
    for s, e, kind, make in entities(text):
        new = _made(make, text[s:e], key)
        found.append((kind, text[s:e], new))
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]) if found else text, found


def canonical(kind: str, text: str) -> str:
    """What two ways to write one entity have in common."""
    low = text.lower()
    if kind in ("card", "ssn"):
        return only_digits(low)
    if kind == "phone":  # of a number with the country code 1 the national digits
        head, d = re.match(r"\+\d{1,3}(?=[ .(-])", low), only_digits(low)
        return d[1:] if head and head[0] == "+1" and len(d) == 11 else low[0] * (low[0] == "+") + d
    return low.replace(" ", "") if kind == "iban" else low if kind in ("email", "mac", "name") else text


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, originals) where different originals of a corpus have one surrogate, or one original several: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii", _made.cache_clear)
        for b in batches:
            rows = {(k, canonical(k, o), canonical(k, n)) for t in b.column("text") if t.is_valid for k, o, n in replaced(t.as_py(), key)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "original", "surrogate"])

    with rows_a_batch(docs.sparkSession, TEXTS):
        pairs = settle(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, original string, surrogate string").distinct(), "entities")
    one = pairs.groupBy("kind", F.col("surrogate").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    other = pairs.groupBy("kind", F.col("original").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(other).filter("n > 1")


def surrogates(docs: DataFrame, key: bytes | None = None, check: bool = True) -> DataFrame:
    """The rows of docs with their text replaced; the other columns as they are. A settled table, so that workers get few texts at once."""
    key = key or key_of(docs.sparkSession)
    if check and (bad := collisions(docs, key).take(1)):
        raise RuntimeError(f"surrogates collide: {bad}")

    @F.arrow_udf("string")
    def new_text(text: pa.Array) -> pa.Array:
        hold("pii", _made.cache_clear)
        return text_by_text(lambda t: None if t is None else replaced(t, key)[0], text, pa.string())

    with rows_a_batch(docs.sparkSession, TEXTS):
        return settle(docs.withColumn("text", new_text(F.col("text").cast("string"))), "surrogates")


def report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, text with surrogates, n_entities, kinds (their types in order, joined by commas)."""
    key = key or key_of(docs.sparkSession)
    if bad := collisions(docs, key).take(1):
        raise RuntimeError(f"surrogates collide: {bad}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [replaced(t.as_py(), key) if t.is_valid else (None, []) for t in b.column("text")]
            kinds = [",".join(k for k, _, _ in found) for _, found in done]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_entities", "kinds"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, n_entities long, kinds string")
