"""Codes, dates and small scalar rules of trade data, as columns; cursors and checkpoints as driver-side codecs."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The customs union's members, and its own code.
UNION, MEMBERS = "EU", "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE".split()


def hs_code(c: Column) -> Column:
    """Digits of a tariff code, printed with dots or spaces; null unless 2 to 10 digits in pairs."""
    digits = F.translate(c, ". ", "")
    return F.when(digits.rlike(r"\A([0-9]{2}){1,5}\z"), digits)


def hs_prefixes(c: Column) -> Column:
    """The code and its leading parts, longest first."""
    return F.transform(F.sequence(F.length(c), F.lit(2), F.lit(-2)), lambda n: F.substring(c, F.lit(1), n))


def country(c: Column) -> Column:
    code = F.upper(F.trim(c))
    return F.when(code.rlike(r"\A[A-Z]{2}\z"), code)


def jurisdiction(c: Column) -> Column:
    """Where a country's import rules are made."""
    return F.when(c.isin(MEMBERS), F.lit(UNION)).otherwise(c)


def utc_date(c: Column) -> Column:
    return F.to_date(c)


def in_force(start: Column, end: Column, at: Column) -> Column:
    """Half-open: start <= at < end; a null end is open, a null start never began."""
    return F.coalesce((start <= at) & (end.isNull() | (at < end)), F.lit(False))


def backoff_seconds(attempt: Column, base: float, most: float) -> Column:
    """base doubled by each attempt, up to most."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(1000))))


def full_jitter(wait: Column) -> Column:
    """A random wait of at most `wait`."""
    return wait * F.rand()


def retries_fit(attempts: int, timeout: float, longest_wait: float, min_idle: float) -> bool:
    """Whether all attempts and waits end before others may take the message over."""
    return attempts * timeout + (attempts - 1) * longest_wait < min_idle


def sanitised(c: Column, most: int) -> Column:
    """Valid text without NUL, at most so many characters."""
    return F.substring(F.translate(F.make_valid_utf8(c), "\x00", ""), 1, most)


def intact(c: Column, most: int) -> Column:
    """Whether sanitised leaves the text as it is."""
    return F.coalesce(sanitised(c, most) == c, F.lit(True))


def stable_uuid(*parts: Column) -> Column:
    """A UUID that depends on its parts only, so that a plan that runs again gives the same."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    at = [(1, 8), (9, 4), (14, 3), (18, 3), (21, 12)]
    a, b, c, d, e = (F.substring(h, s, n) for s, n in at)
    return F.concat_ws("-", a, b, F.concat(F.lit("4"), c), F.concat(F.lit("8"), d), e)


def limit_of(asked: int, default: int, most: int) -> int:
    return default if asked <= 0 else min(asked, most)


def encode_cursor(created_at: dt.datetime, row_id: str) -> str:
    text = json.dumps({"created_at": created_at.isoformat() + "Z", "id": row_id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[dt.datetime, str]:
    """ValueError unless it is exactly what encode_cursor gives."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", cursor):
        raise ValueError("no cursor")
    fields = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
    if not isinstance(fields, dict) or set(fields) != {"created_at", "id"} or not all(isinstance(v, str) for v in fields.values()):
        raise ValueError("no cursor")
    return dt.datetime.fromisoformat(fields["created_at"].removesuffix("Z")), fields["id"]


def parse_checkpoint(text: str | None) -> tuple[str, object] | None:
    """('offset', n), ('cursor', token), ('page', n) or ('time', datetime); None for none; ValueError if it is no checkpoint."""
    if not text or not text.strip():
        return None
    kind, _, rest = text.strip().partition(":")
    if kind.lower() in ("offset", "page"):
        if not rest.isdecimal():
            raise ValueError(f"bad checkpoint {text!r}")
        return kind.lower(), int(rest)
    if kind.lower() == "cursor" and rest:
        return "cursor", rest
    return "time", dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))


def format_checkpoint(kind: str, value: object) -> str:
    """The text parse_checkpoint reads; '' for an empty cursor."""
    if kind == "time":
        return value.astimezone(dt.UTC).isoformat().replace("+00:00", "Z")  # type: ignore[attr-defined]
    if kind in ("offset", "page"):
        if int(value) < 0:  # type: ignore[call-overload]
            raise ValueError("checkpoints count from 0")
        return f"{kind}:{int(value)}"  # type: ignore[call-overload]
    token = str(value).strip()
    return token if not token or token.startswith("cursor:") else f"cursor:{token}"
