"""Unambiguous byte encodings: framed parts and typed values."""

from __future__ import annotations

import datetime
import decimal
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ensure


def u32(n: int) -> bytes:
    return struct.pack(">I", n)


def frame(parts: list[str | bytes]) -> bytes:
    """Count, then each part behind its length."""
    raw = [p.encode() if isinstance(p, str) else p for p in parts]
    return u32(len(raw)) + b"".join(u32(len(p)) + p for p in raw)


def framed_col(known: list[str | bytes], columns: list[Column]) -> Column:
    """The same as frame(), for parts of which the last are binary columns."""
    head = frame([*known, *([b""] * len(columns))])[: -4 * len(columns)]
    tail = [piece for c in columns for piece in (u32_col(F.octet_length(c)), c)]
    return F.concat(F.lit(bytearray(head)), *tail)


def u32_col(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def canonical(value) -> bytes:
    """Typed, order-independent bytes of nested plain values; equal only for equal values."""
    if value is None:
        return b"n"
    if isinstance(value, bool):
        return b"b1" if value else b"b0"
    if isinstance(value, int):
        return b"i" + frame([str(value)])
    if isinstance(value, float):
        ensure(math.isfinite(value))
        return b"f" + struct.pack(">d", value)
    if isinstance(value, decimal.Decimal):
        return b"d" + frame([str(value)])
    if isinstance(value, str):
        return b"s" + frame([value])
    if isinstance(value, (bytes, bytearray)):
        return b"y" + frame([bytes(value)])
    if isinstance(value, (datetime.datetime, datetime.date)):
        return b"t" + frame([value.isoformat()])
    if isinstance(value, (list, tuple)):
        return b"l" + frame([canonical(v) for v in value])
    if isinstance(value, dict):
        pairs = sorted((k.encode(), canonical(v)) for k, v in value.items())
        return b"o" + frame([p for pair in pairs for p in pair])
    ensure(False)
    return b""
