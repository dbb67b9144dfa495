"""Supplier records in canonical form: JSON paths, numbers, white space, case folding, and the fingerprint over them."""

from __future__ import annotations

import decimal
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the record format.
MAX_NAME, MAX_BRAND, MAX_EXPONENT, FINGERPRINT_PREFIX = 512, 255, 308, "v1:"
#: What counts as white space, and marks without width that are dropped.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WIDTHLESS = "".join(map(chr, [0x200B, 0xFEFF, 0x200C, 0x200D]))
_BLANK_RUN = re.compile(f"[{BLANKS}]+")
_NO_WIDTH = dict.fromkeys(map(ord, WIDTHLESS))
_STEP = re.compile(r"([^.\[\]\s]+)|\[(\d+)\]")
_EXACT = decimal.Context(prec=100_000, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)


class RecordError(ValueError):
    """Why a record can't be normalised; kind is one of malformed, missing_field, invalid_origin."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class Number(str):
    """A JSON number as its source text."""


def parse_path(path: str) -> list[str | int]:
    """The steps of a dotted path with [n] indexes; ValueError if it isn't one."""
    steps: list[str | int] = []
    at = 0
    while at < len(path):
        if steps and path[at] == ".":
            at += 1
            m = _STEP.match(path, at)
            m = m if m and m[1] else None
        else:
            m = _STEP.match(path, at)
            m = m if m and (m[2] is not None if steps else m[1]) else None
        if not m:
            raise ValueError(f"no path: {path!r}")
        steps.append(m[1] if m[1] else int(m[2]))
        at = m.end()
    if not steps:
        raise ValueError("empty path")
    return steps


def look_up(root: object, path: str) -> object | None:
    """What stands at the path, or None. A step of digits indexes an array; on an object it is a key."""
    node = root
    for step in parse_path(path):
        if isinstance(node, dict):
            node = node.get(str(step))
        elif isinstance(node, list) and str(step).isdecimal() and int(step) < len(node):
            node = node[int(step)]
        else:
            return None
    return node


def canonical_number(text: str) -> str:
    """The number written out, without exponent, trailing zeros or a sign of zero; exact at any length."""
    text = text.strip()
    m = re.fullmatch(r"[+-]?(?=[0-9.]*[0-9])[0-9]*\.?[0-9]*(?:[eE]([+-]?[0-9]+))?", text)
    if not m or m[1] and abs(int(m[1])) > MAX_EXPONENT:
        raise RecordError("malformed", f"number {text[:40]!r}")
    value = _EXACT.create_decimal(text)
    return format(value.normalize(_EXACT), "f") if value else "0"


def scalar_text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Number):
        return canonical_number(value)
    if isinstance(value, str):
        return value
    raise RecordError("malformed", "no scalar")


def collapse(text: str) -> str:
    """Composed (NFC), without widthless marks, runs of blanks as one, none at the ends."""
    if text.isascii():
        return _BLANK_RUN.sub(" ", text).strip(" ")
    return _BLANK_RUN.sub(" ", unicodedata.normalize("NFC", text).translate(_NO_WIDTH)).strip(" ")


def fold(text: str) -> str:
    """Lower case, one character at a time: no special final forms, nothing grows."""
    text = text.strip(BLANKS)
    if text.isascii():
        return text.lower()
    out = unicodedata.normalize("NFC", text)
    return "".join(low if len(low := c.lower()) == 1 else "i" if c == "İ" else c for c in out)


@dataclass(frozen=True)
class FieldMapping:
    """Where a supplier's payload holds the canonical fields."""

    name: str
    description: str | None = None
    brand: str | None = None
    origin_country: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for path in (self.name, self.description, self.brand, self.origin_country, *self.attributes.values()):
            if path is not None:
                parse_path(path)


def _constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_constant)


def decode_json(text: str) -> object:
    """Strict JSON, one value and nothing after it, numbers as their source text; ValueError otherwise."""
    return _DECODER.decode(text.strip(" \t\r\n"))


def normalise(payload: str | None, mapping: FieldMapping) -> dict:
    """name, description, brand, origin_country, attributes of a payload, or RecordError."""
    try:
        root = decode_json(payload or "")
    except (ValueError, RecursionError) as e:
        raise RecordError("malformed", str(e)[:80]) from None
    if not isinstance(root, dict):
        raise RecordError("malformed", "no object")

    def text_at(path: str | None) -> str | None:
        value = look_up(root, path) if path else None
        return None if value is None else collapse(scalar_text(value).encode("utf-8", "replace").decode("utf-8"))

    if isinstance(look_up(root, mapping.name), bool):
        raise RecordError("malformed", "boolean name")
    name, brand, origin = text_at(mapping.name), text_at(mapping.brand) or "", text_at(mapping.origin_country) or ""
    if not name:
        raise RecordError("missing_field", "name")
    if len(name) > MAX_NAME or len(brand) > MAX_BRAND:
        raise RecordError("malformed", "too long")
    if origin and not re.fullmatch("[A-Za-z]{2}", origin):
        raise RecordError("invalid_origin", origin[:40])
    attributes = {k: v for k, path in mapping.attributes.items() if (v := text_at(path))}
    return {"name": name, "description": text_at(mapping.description) or "", "brand": brand, "origin_country": origin.upper(), "attributes": attributes or None}


#: Characters the serialised form writes as escapes; half a surrogate pair becomes the replacement character.
_ESCAPES = {ord(c): f"\\u{ord(c):04x}" for c in ("<", ">", "&", chr(0x2028), chr(0x2029))} | dict.fromkeys(range(0xD800, 0xE000), "\ufffd")


def fingerprint(name: str, description: str | None, brand: str | None, origin_country: str | None, attributes: dict[str, str] | None) -> str:
    """A versioned SHA-256 over the canonical fields: keys in order, empty ones left out, brand and attribute names folded."""
    fields = {"attributes": {fold(k): attributes[k] for k in attributes} if attributes else None, "brand": fold(brand or ""), "canonical_name": name, "description": description, "origin_country": origin_country}
    kept = {k: v for k, v in fields.items() if v or k == "canonical_name"}
    if "attributes" in kept:
        kept["attributes"] = dict(sorted(kept["attributes"].items(), key=lambda x: x[0].encode("utf-8", "surrogatepass")))
    text = json.dumps(kept, ensure_ascii=False, separators=(",", ":")).translate(_ESCAPES)
    return FINGERPRINT_PREFIX + hashlib.sha256(text.encode("utf-8")).hexdigest()


NORMALISED = "error string, name string, description string, brand string, origin_country string, attributes map<string,string>, fingerprint string"


def with_normalised(records: DataFrame, mapping: FieldMapping, payload: str = "payload", raw: str = "payload_raw") -> DataFrame:
    """records with a struct `product` (NORMALISED); error is null for a good record, else its kind, and the rest is null. Where the exact bytes are
    kept beside the payload, bytes that are no UTF-8 make the record malformed."""

    @F.pandas_udf(NORMALISED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sys.set_int_max_str_digits(0)
        for payloads in batches:
            rows = []
            for p in payloads:
                try:
                    n = normalise(p, mapping)
                    rows.append((None, *n.values(), fingerprint(*n.values())))
                except RecordError as e:
                    rows.append((e.kind, None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NORMALISED.split(", ")])

    text = F.col(payload)
    if raw in records.columns:
        text = F.when(F.col(raw).isNull() | F.is_valid_utf8(F.col(raw).cast("string")), text)
    return records.withColumn("product", run(text))


def version_fingerprint(name: Column, description: Column, brand: Column, origin: Column, attributes_json: Column) -> Column:
    """The fingerprint of a stored version; its attributes are a JSON object of strings, or null. A null value is read as the empty string."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for n, d, b, o, a in batches:
            given = [json.loads(x) if x else None for x in a]
            yield pd.Series([fingerprint(x or "", y, z, w, {k: t if t is not None else "" for k, t in g.items()} if g else None) for x, y, z, w, g in zip(n, d, b, o, given, strict=True)])

    return run(name, description, brand, origin, attributes_json)


def collapse_native(c: Column) -> Column:
    """collapse for composed text, JVM side; text that may not be composed goes through collapse_text."""
    blanks = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\x{200b}\\x{feff}\\x{200c}\\x{200d}]", ""), blanks, " "))


def collapse_text(c: Column) -> Column:
    """collapse: JVM side where the text is ASCII, in Python otherwise."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(collapse, na_action="ignore")

    ascii_only = c.rlike("\\A[\\x00-\\x7F]*\\z")
    return F.when(ascii_only, collapse_native(c)).otherwise(run(F.when(~ascii_only, c)))


CANON = ["attributes", "brand", "canonical_name", "description", "origin_country"]


def canonical_fields(name: Column, description: Column, brand: Column, origin: Column, attributes_json: Column) -> Column:
    """A struct of strings (CANON) that are equal exactly where the fields are, for the fingerprint: names of brand and attributes folded, attributes
    in the order of their names, nothing for nulls. Attributes without value don't count."""

    @F.pandas_udf("attributes string, brand string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for brands, given in batches:
            maps = [json.loads(g) if g else {} for g in given]
            texts = [json.dumps(sorted((fold(k), v) for k, v in m.items() if v is not None), ensure_ascii=False) if m else "" for m in maps]
            yield pd.DataFrame({"attributes": ["" if t == "[]" else t for t in texts], "brand": [fold(b or "") for b in brands]})

    folded = run(brand, attributes_json)
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(folded["attributes"].alias("attributes"), folded["brand"].alias("brand"), text(name).alias("canonical_name"), text(description).alias("description"), text(origin).alias("origin_country"))


def changed_fields(old: Column, new: Column) -> Column:
    """The sorted names of the canonical fields that differ."""
    return F.array_compact(F.array(*[F.when(~old[k].eqNullSafe(new[k]), F.lit(k)) for k in CANON]))
