"""Text normalization, the same in Python, as Spark columns and as DuckDB text.

Normalized is NFC, with full-width ASCII made plain, A-Z (only) lower-cased and, unless
spaces are kept, white space removed.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import ensure

DEFAULT, KEEP_SPACES, DIGITS = "default", "keep-spaces", "digits"
KINDS = (DEFAULT, KEEP_SPACES, DIGITS)

# The characters that count as white space, and the full-width forms U+FF01 to U+FF5E of U+0021 to U+007E.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
PLAIN = "".join(map(chr, range(0x21, 0x7F)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FROM, _TO = WIDE + UPPER, "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in PLAIN) + LOWER
_FOLD = str.maketrans(_FROM, _TO)
_WHITE = re.compile(f"[{WHITE}]+")
_DIGITS = re.compile(r"[0-9]*\Z")
_WIDE, _ALONE = re.compile(f"[{WIDE}]"), re.compile("[\ud800-\udfff]")


def fold(text: str) -> str:
    if text.isascii():
        return text.translate(_FOLD)
    text = unicodedata.normalize("NFC", text)
    # bytes are lower-cased in A-Z alone, and far faster than text is translated
    return text.translate(_FOLD) if _WIDE.search(text) or _ALONE.search(text) else text.encode().lower().decode()


def normalize(text: str, kind: str = DEFAULT) -> str:
    folded = fold(text)
    if kind == KEEP_SPACES:
        return folded
    plain = _WHITE.sub("", folded)
    if kind == DIGITS:
        digits = re.sub(r"[().-]", "", plain)
        digits = digits[1:] if digits.startswith("+") else digits
        ensure(_DIGITS.match(digits) and (digits or not plain))
        return digits
    return plain


def compact(text: str, kind: str = DEFAULT) -> str:
    """What substrings are searched in: normalized and without white space."""
    return _WHITE.sub("", normalize(text, kind))


def _each(one, texts: list[str], kind: str) -> list[str]:
    """one() of every text in a single call: they are joined by NUL, which it leaves alone and nothing composes across."""
    joined = "\0".join(texts)
    if not texts or kind == DIGITS or joined.count("\0") != len(texts) - 1:
        return [one(t, kind) for t in texts]
    return one(joined, kind).split("\0")


def normalize_all(texts: list[str], kind: str = DEFAULT) -> list[str]:
    return _each(normalize, texts, kind)


def compact_all(texts: list[str], kind: str = DEFAULT) -> list[str]:
    return _each(compact, texts, kind)


def fold_col(text: Column) -> Column:
    """fold() of text that is NFC already; wholly inside the JVM."""
    return F.translate(text, _FROM, _TO)


def normalize_col(text: Column, kind: str = DEFAULT) -> Column:
    """normalize() of text that is NFC already; see nfc() for other text."""
    folded = fold_col(text)
    if kind == KEEP_SPACES:
        return folded
    plain = F.translate(folded, WHITE, "")
    if kind == DIGITS:
        digits = F.regexp_replace(F.translate(plain, "().-", ""), r"^\+", "")
        return F.when(digits.rlike(r"^[0-9]*\z") & ((digits != "") | (plain == "")), digits).when(text.isNotNull(), F.raise_error(F.lit("HUSHLAKE INVALID_VALUE")).cast("string"))
    return plain


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition, which Spark has no function for."""
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def normalize_sql(expression: str, kind: str = DEFAULT) -> str:
    """DuckDB text of normalize() for valid input."""
    quote = lambda s: s.replace("'", "''")
    folded = f"translate(nfc_normalize({expression}), '{quote(_FROM)}', '{quote(_TO)}')"
    if kind == KEEP_SPACES:
        return folded
    plain = rf"regexp_replace({folded}, '[\x{{0009}}-\x{{000d}}\x{{0020}}\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')"
    if kind == DIGITS:
        return rf"regexp_replace(regexp_replace({plain}, '[().-]', '', 'g'), '^\+', '')"
    return plain
