"""Personal data replaced by keyed, type-consistent surrogates.

Detected: e-mail addresses, telephone numbers with a country code or in the
North American form, IPv4 and IPv6 addresses, payment card numbers and IBANs
(with right check digits), US social security numbers, secrets that are
assigned to a name (token = ...), access keys of published forms, and persons:
a listed first name (accents and capitals aside) before a capitalised word, a
title before one, and the names of such persons where they stand alone in the
same text.

A surrogate is the image of the entity's normal form under a keyed permutation
of all forms of the same type and format: letters stay letters of their case
and script, in surnames vowels stay vowels, digits stay digits, a card and an
IBAN keep right check digits, an address stays one, a first name becomes one of
the same gender and script. A permutation takes distinct entities to distinct
surrogates by construction, and equal ones, however they are written, to the
same: coreference and distinctness hold over the whole corpus without any state.
It has no fixed point: the image is the next one in a keyed order. A surname
has one surrogate in full names and alone. `checked_replace` looks for
collisions and fixed points among all entities of the corpus before it replaces.

The order is a four-round Feistel network over the smallest even number of
bits, keyed with SHAKE-256 and walked until it falls within the format. Who
knows the key can undo it.

A surrogate may be a real entity of another text, which itself is replaced.
Persons without a listed first name or a title aren't found.

Defined cases: a null text stays null, a text without entities stays as it is;
repeated rows are treated alike; n_chars, where there is one, is counted anew
for texts that changed; other columns are kept; the column name __pii is
reserved. Spans are merged in one sweep, so that the time for a text is in
proportion to its length.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import arrow_batches, materialise, tidy

# First names by gender and script.
FIRST_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Camille Carla Charlotte Clara Elena Emily Emma Heike Helga Ingrid Isabelle Julia Karin Laura Lucia Maria Marie Mary Monika Nathalie Olivia Petra Sabine Sofia Sophie Susan Ursula".split(),
    ("m", "latin"): "Alejandro Andreas Antonio Benjamin Carlos Daniel David Etienne Fernando Francisco Friedrich Guillaume Hans Heinrich Henri Jacques James John Jorge Klaus Laurent Michael Miguel Olivier Pierre Robert Stefan Thomas William Wolfgang".split(),
    ("f", "cyrillic"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
_NAMED = {name: (kind, k) for kind, names in FIRST_NAMES.items() for k, name in enumerate(names)}

EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_ADDRESS = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
IPV4 = re.compile(rf"(?<![\w.]){_ADDRESS}")
# a blank before a group neither follows a complete number (seven digits in a row) nor precedes an IPv4 address
_GROUP = rf"(?:(?<!\d{{7}}) (?!{_ADDRESS})|[.-])?\d{{2,4}}"
# a blank before a third group doesn't follow two that make a number complete (three or four digits, then four)
_THIRD = rf"(?!(?<=[ .-]\d{{3}}[ .-]\d{{4}}) |(?<=[ .-]\d{{4}}[ .-]\d{{4}}) ){_GROUP}"
PHONE = re.compile(rf"(?<![\w+])\+\d{{1,3}}(?:[ .-]?\(\d{{2,4}}\)|[ .-]?\d{{2,4}})(?:{_GROUP}){{2}}(?:{_THIRD})?(?!\d)")
CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
LOCAL_PHONE = re.compile(r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}([-.]))\d{3}[-.]\d{4}(?![\w-]|\.\d)")
SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_NAMES_SECRET = re.compile(r"(?i)token|secret|passw|api[_-]?key")
SECRET = re.compile(r"(?i)\b(?:\w*token|\w*secret|\w*passw(?:or)?d|api[_-]?key)\b\s*[:=]\s*(?:[\"']([^\"'\s]{8,})[\"']|(?=[^\s\"'<>,;]*\d)(?=[^\s\"'<>,;]*[A-Za-z])([^\s\"'<>,;]{8,}))")
# Published forms of access keys; what is before the group stays.
ACCESS = re.compile(r"\b(?:(?:AKIA|ASIA)([0-9A-Z]{16})|gh[pousr]_([A-Za-z0-9]{36})|sk-([A-Za-z0-9_-]{20,})|xox[abprs]-([A-Za-z0-9-]{10,})|AIza([0-9A-Za-z_-]{35}))(?![\w-])")
_REST = r"[^\W\d_]*(?:['’-][^\W\d_]+)*"
_SURNAME = rf"[^\W\d_]{_REST}"
#: A capitalised word, and before a further one perhaps an initial: whether it is a first name the list says.
PERSON = re.compile(rf"(?<![\w'’-])([A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+)(?=[ \n\u00a0](?:[A-ZА-Я]\.[ \n\u00a0])?([A-ZÀ-ÖØ-ÞА-ЯЁ]{_REST})(?!\w))")
TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\.?[ \u00a0]([A-ZÀ-ÖØ-ÞА-ЯЁ]{_REST})(?!\w)")
_WORD = re.compile(_SURNAME)

_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(map(chr, range(0x430, 0x450))) + "ё",
    "".join(map(chr, range(0x410, 0x430))) + "Ё",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ",
    "çñßðþčďěğłňřśšťžźż",
)
#: Of names: vowels become vowels and consonants consonants, so that a name stays one that can be said.
_SOUNDS = (
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "аеиоуыэюяё",
    "бвгджзйклмнпрстфхцчшщъь",
    *_ALPHABETS[5:],
)


def _places(alphabets: tuple[str, ...]) -> dict[str, tuple[str, int]]:
    return {c: (alphabet, k) for alphabet in alphabets for k, c in enumerate(alphabet)}


_PLACE, _SOUND_PLACE = _places(_ALPHABETS), _places(_SOUNDS)


def _feistel(x: int, half: int, size: int, key: bytes, label: str, turns) -> int:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for turn in turns:
        told = f"{label}:{size}:{turn}:{right}".encode()
        f = int.from_bytes(hashlib.shake_256(key + told).digest((half + 7) // 8), "little")
        left, right = right, left ^ (f & mask)
    return (left << half) | right


def permute(x: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        x = _feistel(x, half, size, key, label, range(4))
        if x < size:
            return x


def unpermute(x: int, size: int, key: bytes, label: str) -> int:
    """The inverse of permute."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    swap = lambda v: (v & mask) << half | v >> half
    while True:
        x = swap(_feistel(swap(x), half, size, key, label, range(3, -1, -1)))
        if x < size:
            return x


def derange(x: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of range(size) that leaves nothing at its place: the next one in a keyed order."""
    return unpermute((permute(x, size, key, label) + 1) % max(1, size), size, key, label)


def rewrite(text: str, key: bytes, label: str, kept: Callable[[int], bool] = lambda _: False, place: dict[str, tuple[str, int]] = _PLACE) -> str:
    """text with the letters and digits changed within their alphabets; kept(place) and other characters stay.

    The characters are the digits of one number in mixed radix, which is permuted.
    """
    places = [k for k, c in enumerate(text) if c in place and not kept(k)]
    changed = set(places)
    form = "".join(place[c][0][0] if k in changed else f"[{c}]" for k, c in enumerate(text))
    number, size = 0, 1
    for k in places:
        alphabet, at = place[text[k]]
        number, size = number * len(alphabet) + at, size * len(alphabet)
    number = derange(number, size, key, f"{label}:{form}")
    out = list(text)
    for k in reversed(places):
        alphabet = place[text[k]][0]
        number, at = divmod(number, len(alphabet))
        out[k] = alphabet[at]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that belongs after digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _cased_like(text: str, model: str) -> str:
    return "".join(c.upper() if m.isupper() else c for c, m in zip(text, model, strict=True))


def _filled(form: str, digits: str) -> str:
    """form with its digits replaced, in their order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def email(found: str, key: bytes) -> str:
    plain = found.lower()
    top = plain.rindex(".")
    return _cased_like(rewrite(plain, key, "email", lambda k: k >= top), found)


def phone(found: str, key: bytes) -> str:
    """The country code stays: the digits before the first separator; a number without one is of code 1."""
    digits = re.sub(r"\D", "", found)
    if not found.startswith("+"):
        return _filled(found, rewrite(digits, key, "phone:1"))
    code = len(re.match(r"\+\d+", found)[0]) - 1
    if code >= len(digits) - 5:
        code = 1
    return _filled(found, digits[:code] + rewrite(digits[code:], key, f"phone:{digits[:code]}"))


def ssn(found: str, key: bytes) -> str:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = map(int, found.split("-"))
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    number, serial = divmod(derange(number, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(number, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def iban(found: str, key: bytes) -> str:
    """The country stays, the check digits are made anew."""
    plain = found.replace(" ", "")
    body = rewrite(plain[4:], key, f"iban:{plain[:2]}")
    rest = iter(f"{plain[:2]}{_iban_check(plain[:2], body):02d}{body}")
    return "".join(c if c == " " else next(rest) for c in found)


def ipv6(found: str, key: bytes) -> str:
    return str(ipaddress.IPv6Address(derange(int(ipaddress.IPv6Address(found)), 1 << 128, key, "ipv6")))


def ipv4(found: str, key: bytes) -> str:
    number = int.from_bytes(bytes(map(int, found.split("."))), "big")
    return ".".join(map(str, derange(number, 2**32, key, "ipv4").to_bytes(4, "big")))


def card(found: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", found)
    body = rewrite(digits[:-1], key, "card")
    return _filled(found, body + str(luhn(body)))


def _plain(name: str) -> str:
    """A first name as it is listed: without accents, one capital."""
    name = unicodedata.normalize("NFKD", name.replace("Ё", "Е").replace("ё", "е"))
    return "".join(c for c in name if not unicodedata.combining(c)).capitalize()


def _listed(name: str) -> tuple[tuple[str, str], int] | None:
    return _NAMED.get(unicodedata.normalize("NFC", name).capitalize()) or _NAMED.get(unicodedata.normalize("NFC", _plain(name)))


def first_name(found: str, key: bytes) -> str:
    """Another one of the same gender and script."""
    kind, k = _listed(found)
    names = FIRST_NAMES[kind]
    new = names[derange(k, len(names), key, f"first:{kind}")]
    return new.upper() if found.isupper() else new


def surname(found: str, key: bytes) -> str:
    """Of the same form: each part a name that can be said, in the same case and script."""
    plain = unicodedata.normalize("NFC", found)
    low = plain.lower()
    if len(low) != len(plain):
        low = plain
    return _cased_like(rewrite(low, key, "last", place=_SOUND_PLACE), plain)


def person(found: str, key: bytes) -> str:
    parts = re.match(rf"(\S+?)([ \n\u00a0](?:\S\.[ \n\u00a0])?)({_SURNAME})$", found)
    return f"{first_name(parts[1], key)}{parts[2]}{surname(parts[3], key)}"


Span = tuple[int, int, str]


def _joined(spans: list[Span], more: list[Span]) -> list[Span]:
    """Both in order; of more those that overlap none of spans, nor an earlier one of their own. One sweep."""
    out: list[Span] = []
    k, end = 0, 0
    for span in sorted(more):
        while k < len(spans) and spans[k][0] < span[1]:
            out.append(spans[k])
            end = max(end, spans[k][1])
            k += 1
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out + spans[k:]


def _checked_card(found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    return 13 <= len(digits) <= 19 and int(digits[-1]) == luhn(digits[:-1]) and len(set(digits)) > 1


def _checked_iban(found: str) -> bool:
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and int(plain[2:4]) == _iban_check(plain[:2], plain[4:])


def _checked_ipv6(found: str) -> bool:
    try:
        return int(ipaddress.IPv6Address(found)) > 0xFFFF
    except ValueError:
        return False


def _groups(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span(m.lastindex) for m in pattern.finditer(text)]


def find(text: str) -> list[Span]:
    """Spans (start, end, type) that don't overlap; of two that do, the one of the type that is looked for first stays."""
    spans: list[Span] = []

    def add(kind: str, found) -> None:
        nonlocal spans
        if found:
            spans = _joined(spans, [(a, b, kind) for a, b in found])

    every = lambda pattern, good=lambda _: True: [m.span() for m in pattern.finditer(text) if good(m[0])]
    if "@" in text:
        add("email", every(EMAIL))
    if _NAMES_SECRET.search(text):
        add("secret", _groups(SECRET, text))
    if _DIGITS.search(text):
        add("secret", _groups(ACCESS, text))
        if "+" in text:
            add("phone", every(PHONE))
        add("card", every(CARD, _checked_card))
        add("iban", every(IBAN, _checked_iban))
        add("ipv4", every(IPV4))
        if "::" in text or text.count(":") > 6:
            add("ipv6", every(IPV6, _checked_ipv6))
        add("ssn", every(SSN))
        add("phone", every(LOCAL_PHONE))
    persons = [m for m in PERSON.finditer(text) if _listed(m[1])]
    add("person", [(m.start(), m.end(2)) for m in persons])
    titled = _groups(TITLED, text)
    add("surname", titled)
    alone = {m[2] for m in persons} | {text[a:b] for a, b in titled}
    first = {m[1] for m in persons} - alone
    if alone or first:
        names = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        names += [(a, a + len(w.split(mark)[0]), w.split(mark)[0]) for a, _, w in names for mark in ("'s", "’s") if w.endswith(mark)]
        add("surname", [(a, b) for a, b, w in names if w in alone])
        add("first", [(a, b) for a, b, w in names if w in first])
    return spans


_DIGITS = re.compile("[0-9]")
_MAKE: dict[str, Callable[[str, bytes], str]] = {
    "email": email, "phone": phone, "ipv4": ipv4, "card": card, "ssn": ssn, "iban": iban, "ipv6": ipv6, "person": person,
    "surname": surname, "first": first_name, "secret": lambda found, key: rewrite(found, key, "secret"),
}


def surrogate(found: str, kind: str, key: bytes) -> str:
    return _MAKE[kind](found, key)


def normal(found: str, kind: str) -> str:
    """What two spellings of one entity have in common."""
    if kind == "phone":
        digits = re.sub(r"\D", "", found)
        return digits if found.startswith("+") else f"1{digits}"
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"\W", "", found)
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded
    if kind in ("email", "person", "surname", "first"):
        plain = re.sub(r"\s+", " ", unicodedata.normalize("NFC", found)).lower()
        return " ".join([_plain(plain.split(" ")[0]).lower(), *plain.split(" ")[1:]]) if kind in ("person", "first") else plain
    return found


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, entity, surrogate) of each place."""
    out, at, done = [], 0, []
    for start, end, kind in find(text):
        new = surrogate(text[start:end], kind, key)
        done.append((kind, text[start:end], new))
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), done


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """Distinct (kind, entity, surrogate) of all docs (text), in normal form; repeated ones are dropped in each batch before the shuffle."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in tidy(batches):
            found = {(k, normal(e, k), normal(s, k)) for t in batch.column(0).to_pylist() if t for k, e, s in pseudonymise(t, key)[1]}
            columns = list(zip(*sorted(found), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "entity", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, entity string, surrogate string").distinct()


def clashes(found: DataFrame) -> DataFrame:
    """Of entities: (kind, surrogate, n) where one surrogate stands for n > 1 entities, and (n = 1) where an entity stands for itself."""
    shared = found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
    split = found.groupBy("kind", "entity").agg(F.count("*").alias("n"), F.min("surrogate").alias("surrogate")).where("n > 1").select("kind", "surrogate", "n")
    return shared.unionByName(split).unionByName(found.where("entity = surrogate").select("kind", "surrogate", F.lit(1).cast("bigint").alias("n")))


def checked_replace(docs: DataFrame, key: bytes) -> DataFrame:
    """replace, after a look at all entities of docs that distinct ones have distinct surrogates, equal ones equal ones, and none itself."""
    wrong = clashes(materialise(entities(docs, key), "entities")).limit(5).collect()
    if wrong:
        raise RuntimeError(f"surrogates that aren't one for each entity: {[(r['kind'], r['n']) for r in wrong]}")
    return replace(docs, key)


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in text, and __pii array<struct<kind, entity, surrogate>> of what was replaced."""
    arrow_batches(docs.sparkSession)
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    kind = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))

    def run(batches):
        for batch in tidy(batches):
            texts, done = [], []
            counts = batch.column(chars_at).to_pylist() if chars_at is not None else None
            for k, text in enumerate(batch.column(text_at).to_pylist()):
                new, found = pseudonymise(text, key) if text else (text, [])
                if found and counts:
                    counts[k] = len(new)
                texts.append(new)
                done.append([{"kind": a, "entity": b, "surrogate": c} for a, b, c in found])
            arrays = [batch.column(k) for k in range(len(names))]
            arrays[text_at] = pa.array(texts, pa.string())
            if counts is not None:
                arrays[chars_at] = pa.array(counts, batch.column(chars_at).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(done, kind)], names=[*names, "__pii"])

    entry = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "entity", "surrogate")])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__pii", T.ArrayType(entry))]))


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates (kind, surrogate) that stand for more than one entity: none, if all is well."""
    each = replaced.select(F.explode("__pii").alias("e")).select("e.*")
    digits, lower = F.col("kind").isin("phone", "card", "ssn", "iban"), F.col("kind").isin("email", "person", "surname", "first")

    def form(c: str) -> Column:
        number = F.regexp_replace(c, "\\W", "")
        return F.when((F.col("kind") == "phone") & ~F.col(c).startswith("+"), F.concat(F.lit("1"), number)).when(digits, number).when(lower, F.lower(c)).otherwise(F.col(c))

    pairs = each.select("kind", form("entity").alias("entity"), form("surrogate").alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").count().where("count > 1")
