"""The eight field types: canonical bytes of values, as columns and in Python."""

from __future__ import annotations

import datetime
import decimal
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ensure

TYPES = ("text", "integer", "bigint", "decimal", "boolean", "instant", "json", "bytes")
SEARCHABLE = ("text", "integer", "bigint", "decimal")
_SAFE = 2**53 - 1
_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?\Z", re.A)
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


def canonical_decimal(value: str, precision: int, scale: int) -> str:
    """No plus sign, no leading zeros, exactly `scale` digits after the point, no negative zero."""
    ensure(isinstance(value, str) and _NUMBER.match(value))
    with decimal.localcontext(prec=max(len(value), precision + scale) + 1):
        number = decimal.Decimal(value)
        exact = number.quantize(decimal.Decimal(1).scaleb(-scale))
        ensure(len(value.partition(".")[2]) <= scale and abs(exact).scaleb(scale) < 10**precision)
        return format(exact if exact else abs(exact), "f")


def encode(kind: str, value, precision: int = 0, scale: int = 0) -> bytes:
    """Canonical bytes of one value, for query terms."""
    if kind == "text":
        ensure(isinstance(value, str))
        try:
            return value.encode()
        except UnicodeEncodeError:
            ensure(False)
    if kind == "integer":
        if isinstance(value, float):
            ensure(value.is_integer())
            value = int(value)
        ensure(isinstance(value, int) and not isinstance(value, bool) and abs(value) <= _SAFE)
        return str(value).encode()
    if kind == "bigint":
        ensure(isinstance(value, int) and not isinstance(value, bool))
        return str(value).encode()
    if kind == "decimal":
        return canonical_decimal(format(value, "f") if isinstance(value, decimal.Decimal) else value, precision, scale).encode()
    if kind == "boolean":
        ensure(isinstance(value, bool))
        return bytes([value])
    if kind == "instant":
        ensure(isinstance(value, datetime.datetime))
        stamp = value if value.tzinfo else value.replace(tzinfo=datetime.UTC)
        millis, rest = divmod(stamp - _EPOCH, datetime.timedelta(milliseconds=1))
        return (f"{millis}.{rest.microseconds:03d}" if rest else str(millis)).encode()
    if kind == "json":
        try:
            return json.dumps(value, ensure_ascii=False, allow_nan=False, separators=(",", ":")).encode()
        except (TypeError, ValueError, RecursionError):
            ensure(False)
    ensure(kind == "bytes" and isinstance(value, (bytes, bytearray)))
    return bytes(value)


def _instant(text: str) -> datetime.datetime:
    millis, _, rest = text.partition(".")
    return _EPOCH + datetime.timedelta(milliseconds=int(millis), microseconds=int(rest or 0))


def decode(kind: str, raw: bytes, precision: int = 0, scale: int = 0):
    """The value of canonical bytes; anything else is INVALID_CIPHERTEXT."""
    try:
        text = "" if kind in ("bytes", "boolean") else raw.decode()
        value = {
            "text": lambda: text, "integer": lambda: int(text), "bigint": lambda: int(text), "decimal": lambda: text, "boolean": lambda: {b"\0": False, b"\1": True}[raw],
            "instant": lambda: _instant(text), "json": lambda: json.loads(text), "bytes": lambda: raw,
        }[kind]()
    except (ValueError, KeyError, OverflowError):
        value = None
    ensure(value is not None and (kind == "json" or encode(kind, value, precision, scale) == raw), "INVALID_CIPHERTEXT")
    return value


def _invalid(to: str) -> Column:
    return F.raise_error(F.lit("HUSHLAKE INVALID_VALUE")).cast(to)


def encode_col(kind: str, value: Column, precision: int = 0, scale: int = 0) -> Column:
    """Canonical bytes of a column; a value outside the type stops the job with INVALID_VALUE."""
    if kind == "text":
        return value.cast("string").cast("binary")
    if kind == "json":
        # kept as it was written, if it is JSON
        return F.when(value.isNotNull() & F.try_parse_json(value.cast("string")).isNull(), _invalid("binary")).otherwise(value.cast("string").cast("binary"))
    if kind in ("integer", "bigint"):
        number = value.try_cast("decimal(38,0)")
        # a fraction of a double shows in its value, that of a long decimal in its digits
        broken = number.isNull() | (number.cast("double") != value.try_cast("double")) | value.cast("string").rlike(r"^[+-]?[0-9]*\.[0-9]*[1-9][0-9]*$")
        wide = F.abs(number) > _SAFE if kind == "integer" else F.lit(False)
        return F.when(value.isNotNull() & (broken | wide), _invalid("binary")).otherwise(number.cast("string").cast("binary"))
    if kind == "decimal":
        exact = value.try_cast(f"decimal({precision},{scale})")
        # more digits than the scale: the value and its rounding differ as doubles, or in their digits
        more = value.cast("string").rlike(rf"^[+-]?[0-9]*\.[0-9]{{{scale}}}[0-9]*[1-9][0-9]*$")
        return F.when(value.isNotNull() & (exact.isNull() | more | (exact.cast("double") != value.try_cast("double"))), _invalid("binary")).otherwise(exact.cast("string").cast("binary"))
    if kind == "boolean":
        return F.when(value, F.unhex(F.lit("01"))).when(~value, F.unhex(F.lit("00")))
    if kind == "instant":
        stamp = value.cast("timestamp")
        millis, rest = F.unix_millis(stamp), F.pmod(F.unix_micros(stamp), F.lit(1000))
        return F.concat(millis.cast("string"), F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"))).otherwise(F.lit(""))).cast("binary")
    return value.cast("binary")


def decode_col(kind: str, raw: Column, precision: int = 0, scale: int = 0) -> Column:
    text = raw.cast("string")
    return {
        "text": lambda: text, "json": lambda: text, "integer": lambda: text.cast("long"), "bigint": lambda: text.cast("decimal(38,0)"),
        "decimal": lambda: text.cast(f"decimal({precision},{scale})"), "boolean": lambda: raw == F.unhex(F.lit("01")),
        "instant": lambda: F.timestamp_micros(F.split_part(text, F.lit("."), F.lit(1)).cast("long") * 1000 + F.coalesce(F.nullif(F.split_part(text, F.lit("."), F.lit(2)), F.lit("")).cast("long"), F.lit(0))), "bytes": lambda: raw,
    }[kind]()


def spark_type(kind: str, precision: int = 0, scale: int = 0) -> str:
    return {"text": "string", "json": "string", "integer": "bigint", "bigint": "decimal(38,0)", "decimal": f"decimal({precision},{scale})", "boolean": "boolean", "instant": "timestamp", "bytes": "binary"}[kind]
