"""Text cleaning, masking and redaction as Column expressions.

Everything here stays inside the JVM except Unicode NFKC, which Spark lacks;
that one step is an Arrow function and only sees the rows it could change.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Secret names and the replacement written over their values.
SECRET_NAMES = ("password", "token", "key", "secret")
MASK = "***MASKED***"

# Characters counted as recognition noise.
NOISE_CHARS = "?#@$"

# Everything Python's str.split() treats as a separator.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"

# Shapes of personal data. What has one of them is a candidate, where no
# letter or digit stands beside it; each kind has further rules of its own.
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}"
_IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])"
_CARD = r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}"
_ABROAD = r"\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}"
PII_CANDIDATE = f"{_EMAIL}|(?<![A-Za-z0-9])(?:{'|'.join((_CARD, _SSN, _PHONE, _ABROAD))})(?![A-Za-z0-9])|(?<![A-Za-z0-9.]){_IPV4}(?![A-Za-z0-9])"


@lru_cache(maxsize=1)
def _unusual() -> str:
    """A class holding every character NFKC could touch and every non-ASCII control or separator.

    Exact within Latin-1, a superset above it.
    """
    latin1 = "".join(
        rf"\x{{{c:X}}}"
        for c in range(0x80, 0x100)
        if unicodedata.normalize("NFKC", chr(c)) != chr(c) or unicodedata.category(chr(c))[0] in "CZ"
    )
    return rf"[{latin1}\x{{100}}-\x{{10FFFF}}]"


@lru_cache(maxsize=1)
def _nfkc_udf():
    # pyarrow's own utf8_normalize leaves characters decomposed.
    def nfkc(texts: pa.Array) -> pa.Array:
        return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(nfkc, T.StringType())


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Rows that cannot change are passed to Python as nulls only."""
    candidate = F.when(F.regexp_like(text, F.lit(_unusual())), text)
    return F.coalesce(_nfkc_udf()(candidate), text)


def clean_text(text: Column, strict: bool = False, normalised: bool = False) -> Column:
    """Normalise, strip entities, controls and non-ASCII, collapse whitespace.

    By default a newline or tab separates words. ``strict=True`` deletes it with
    the other control characters, joining the words around it. Null and blank
    give the empty string. ``normalised=True`` says the text is in NFKC already.
    """
    out = F.regexp_replace(text if normalised else nfkc(text), r"&[a-zA-Z]+;", " ")
    # Other controls and non-ASCII separators are rare and dear to look for. Where
    # the raw text has none of the unusual characters, no later form of it has.
    odd = F.regexp_replace(out, r"\x{85}", "" if strict else " ")
    controls = r"\x00-\x1F\x7F" if strict else r"\x00-\x08\x0E-\x1B\x7F"
    odd = F.regexp_replace(odd, rf"[{controls}]+|[\p{{C}}&&[^\x00-\x7F]]+", "")
    odd = F.regexp_replace(odd, r"[\p{Z}&&[^ ]]+", " ")
    out = F.when(F.regexp_like(text, F.lit(rf"[{controls}]|{_unusual()}")), odd).otherwise(out)
    # A single space stays as it is: only other runs are rewritten.
    out = F.regexp_replace(out, r"[\t-\r\x1C-\x1F][\t-\r\x1C-\x20]*| [\t-\r\x1C-\x20]+", " ")
    return F.coalesce(F.trim(F.regexp_replace(out, r"[^\x00-\x7F]+", "")), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{_SPACE}]+")), F.lit(0))


def is_blank(text: Column) -> Column:
    """Null, empty or only whitespace."""
    return text.isNull() | ~F.regexp_like(text, F.lit(rf"[^{_SPACE}]"))


def noise_count(text: Column, chars: str = NOISE_CHARS) -> Column:
    """Number of ``chars`` in the text."""
    return F.regexp_count(text, F.lit("[" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]"))


def noise_ratio(text: Column, chars: str = NOISE_CHARS) -> Column:
    """Share of ``chars`` in the text; null for an empty text."""
    return F.try_divide(noise_count(text, chars), F.length(text))


def mask_text(text: Column) -> Column:
    """Overwrite the value in ``name = value`` for every secret name, case-insensitively."""
    masked = text
    for name in SECRET_NAMES:
        pattern = rf"""(?iu){name}["']?[{_SPACE}]*[:=][{_SPACE}]*["']?[^"'{_SPACE}]+["']?"""
        masked = F.regexp_replace(masked, pattern, f"{name}={MASK}")
    return F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), masked).otherwise(text)


def _overwrite(entries: Column, value_type: T.DataType) -> Column:
    """The mask in place of every text below."""

    def hide(key: Column, value: Column) -> Column:
        if isinstance(value_type, T.StringType):
            return F.when(value.isNotNull(), F.lit(MASK))
        if isinstance(value_type, T.MapType):
            return _overwrite(value, value_type.valueType)
        return F.lit(None).cast(value_type)

    return F.transform_values(entries, hide)


def mask_map(entries: Column, value_type: T.DataType | None = None) -> Column:
    """Mask a map: whole value under a secret key, text masking of other strings.

    Pass ``value_type`` for maps whose values are maps themselves; under a secret key
    their texts are masked and their keys stay. A value that is neither text nor a map
    becomes null under a secret key, since the mask is text.
    """
    value_type = value_type or T.StringType()

    def hide(key: Column, value: Column) -> Column:
        secret = F.lower(key).rlike("|".join(SECRET_NAMES))
        if isinstance(value_type, T.StringType):
            return F.when(secret & value.isNotNull(), F.lit(MASK)).otherwise(mask_text(value))
        if isinstance(value_type, T.MapType):
            return F.when(secret, _overwrite(value, value_type.valueType)).otherwise(mask_map(value, value_type.valueType))
        return F.when(~secret, value)

    return F.transform_values(entries, hide)


def _masked_json(text: str | None) -> str | None:
    """JSON text with the values under secret keys overwritten, whatever they are."""
    if text is None:
        return None
    # A work list in place of recursion: metadata may be nested deeper than Python's stack.
    root = {"": json.loads(text, parse_float=_Exact, parse_int=_Exact)}
    work: list[dict | list] = [root]
    while work:
        node = work.pop()
        for key, value in node.items() if isinstance(node, dict) else enumerate(node):
            if isinstance(node, dict) and any(name in key.lower() for name in SECRET_NAMES):
                node[key] = MASK
            elif isinstance(value, (dict, list)):
                work.append(value)
            elif isinstance(value, str):
                node[key] = _masked_text(value)
    return _json_text(root[""])


class _Exact(float):
    """A number that is written as it was read."""

    def __new__(cls, text: str):
        number = super().__new__(cls, text)
        number.text = text
        return number

    def __repr__(self) -> str:
        return self.text


def _json_text(value) -> str:
    """JSON of a value, without recursion."""
    out, work = [], [value]
    while work:
        item = work.pop()
        if isinstance(item, _Raw):
            out.append(item)
        elif isinstance(item, dict):
            parts = [_Raw("{")]
            for k, (key, inner) in enumerate(item.items()):
                parts += [_Raw(("," if k else "") + json.dumps(key) + ":"), inner]
            work += reversed([*parts, _Raw("}")])
        elif isinstance(item, list):
            parts = [_Raw("[")]
            for k, inner in enumerate(item):
                parts += [_Raw(","), inner] if k else [inner]
            work += reversed([*parts, _Raw("]")])
        else:
            out.append(item.text if isinstance(item, _Exact) else json.dumps(item))
    return "".join(out)


class _Raw(str):
    """Text that stands in the output as it is."""


@lru_cache(maxsize=1)
def _secret_patterns():
    space = r"\s\x0B\x1C-\x1F\x85"
    return [(re.compile(rf"""{n}["']?[{space}]*[:=][{space}]*["']?[^"'{space}]+["']?""", re.IGNORECASE), f"{n}={MASK}") for n in SECRET_NAMES]


def _masked_text(text: str) -> str:
    if ":" in text or "=" in text:
        for pattern, replacement in _secret_patterns():
            text = pattern.sub(replacement, text)
    return text


@lru_cache(maxsize=1)
def _mask_udf():
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([_masked_json(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(mask, T.StringType())


def mask_value(value: Column) -> Column:
    """Mask a VARIANT, map, struct or array; the result is a VARIANT.

    Whatever stands under a key with a secret name becomes the mask, be it a number, a
    truth value, an array or an object; texts elsewhere are masked like :func:`mask_text`,
    in arrays too. Values without any secret name stay in the JVM. Null stays null.
    """
    text = F.to_json(value, {"ignoreNullFields": "false"})
    touched = F.regexp_like(text, F.lit("(?i)" + "|".join(SECRET_NAMES)))
    return F.parse_json(F.coalesce(_mask_udf()(F.when(touched, text)), text))


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a number fits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))

    def counted(d: Column, k: Column) -> Column:
        twice = d * 2
        return F.when(k % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(values, counted), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _kind_of(found: Column) -> Column:
    """What a candidate is, or null for none of the kinds."""
    shaped = lambda pattern: found.rlike(f"^(?:{pattern})$")
    digits = F.regexp_replace(found, "[^0-9]", "")
    octets = F.forall(F.split(found, r"\."), lambda o: o.try_cast("int") <= 255)
    area, middle, last = (F.split(found, "-")[k] for k in range(3))
    issued = ~area.isin("000", "666") & ~area.startswith("9") & (middle != "00") & (last != "0000")
    # Area and exchange codes begin with 2 to 9.
    dialled = F.regexp_like(F.right(digits, F.lit(10)), F.lit("^[2-9][0-9]{2}[2-9]"))
    return (
        F.when(found.contains("@"), F.lit("[EMAIL]"))
        .when(shaped(_IPV4), F.when(octets, F.lit("[IP]")))
        .when(shaped(_SSN), F.when(issued, F.lit("[SSN]")))
        .when(shaped(_CARD), F.when(_luhn(digits), F.lit("[CARD]")))
        .when(shaped(_PHONE), F.when(dialled, F.lit("[PHONE]")))
        .when(F.length(digits).between(8, 15), F.lit("[PHONE]"))
    )


def redact_pii(text: Column) -> Column:
    """Replace e-mail addresses, phone numbers, IPv4 addresses, card and social security numbers.

    Candidates are looked for once; each is then held against the rules of its kind (check
    digit, area codes, octets up to 255), so that order numbers, dates and versions stay.
    """
    found = F.regexp_extract_all(text, F.lit(PII_CANDIDATE), F.lit(0))
    between = F.split(text, PII_CANDIDATE, -1)
    shown = F.transform(found, lambda c: F.coalesce(_kind_of(c), c))
    redacted = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    # The pieces and the candidates alternate; texts without a candidate are not taken apart.
    return F.when(F.size(found) > 0, redacted).otherwise(text)
