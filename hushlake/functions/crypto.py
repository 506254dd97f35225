"""Keyed hashes and authenticated encryption as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .framing import framed_col, u32_col
from .keys import Keyring

VERSION = b"\x03"
#: version, nonce and tag
LEAST_ENVELOPE = 29
SHARDS = 256

_BLOCK = {256: 64, 384: 128}


def binary(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def hmac_col(key: bytes, message: Column, bits: int) -> Column:
    """HMAC-SHA2 with a key known to the driver."""
    padded = key.ljust(_BLOCK[bits], b"\0")
    sha = lambda c: F.unhex(F.sha2(c, bits))
    return sha(F.concat(binary(bytes(b ^ 0x5C for b in padded)), sha(F.concat(binary(bytes(b ^ 0x36 for b in padded)), message))))


def signed64(digest_hex: Column) -> Column:
    """The first eight bytes of a hex digest as a signed big-endian integer."""
    return F.conv(F.substring(digest_hex, 1, 16), 16, -10).cast("long")


def stamp_col(key: Column, salt: Column, ordinal: Column | None = None) -> Column:
    """Salted proof that a value has this key (at its so-manieth occurrence)."""
    return signed64(F.sha2(F.concat(key, salt, *([] if ordinal is None else [u32_col(ordinal)])), 256))


def salt_col() -> Column:
    """16 bytes, unique for each row; to be materialised before use."""
    return F.substring(F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()).cast("binary"), 256)), 1, 16)


def shard_col(row_id: Column) -> Column:
    """Low byte of the 32-bit FNV-1a hash of the id; only low bytes carry into it."""
    step = lambda octet: lambda h, i: h.bitwiseXOR(octet(i)) * F.lit(0x01000193 & 255) % 256
    fold = lambda octet: F.aggregate(F.sequence(F.lit(1), F.octet_length(row_id)), F.lit(0x811C9DC5 & 255), step(octet))
    # where characters are octets, their codes are the octets
    plain = fold(lambda i: F.ascii(F.substring(row_id, i, 1)))
    other = fold(lambda i: F.conv(F.hex(F.substring(row_id.cast("binary"), i, 1)), 16, 10).cast("int"))
    return F.when(F.octet_length(row_id) == 0, F.lit(0x811C9DC5 & 255)).when(F.octet_length(row_id) == F.char_length(row_id), plain).otherwise(other)


class FieldCipher:
    """Seals and opens one field of one model: AES-256-GCM, bound to model, field, codec, scope and row.

    A key given as a column comes from a table (keyed() of the engine) and never shows in a plan; without
    one, the keys are literals of the expression, as tests use them.
    """

    def __init__(self, ring: Keyring, model: str, field: str, codec: str, parameters: str):
        self._known = [VERSION, model, field, codec, parameters, ring.scope(model)]
        self.keys = [ring.derive(model, "field", [field, codec, parameters, bytes([i])], 32) for i in range(SHARDS)]

    def _key(self, row_id: Column) -> Column:
        # one text for all keys of the field: a single call to the JVM
        return F.element_at(F.expr("array(" + ", ".join(f"X'{k.hex()}'" for k in self.keys) + ")"), shard_col(row_id) + 1)

    def _aad(self, scope: Column, row_id: Column) -> Column:
        return framed_col(["hushlake/aad/1", *self._known], [scope.cast("binary"), row_id.cast("binary")])

    def seal(self, plain: Column, scope: Column, row_id: Column, key: Column | None = None) -> Column:
        box = F.aes_encrypt(plain, self._key(row_id) if key is None else key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), self._aad(scope, row_id))
        return F.concat(binary(VERSION), box)

    def open(self, sealed: Column, scope: Column, row_id: Column, strict: bool = True, key: Column | None = None) -> Column:
        """The canonical bytes; a damaged or foreign envelope raises, or is null where not strict."""
        inner = F.substring(sealed, 2, 1 << 30)
        aes = F.aes_decrypt if strict else F.try_aes_decrypt
        opened = aes(inner, self._key(row_id) if key is None else key, F.lit("GCM"), F.lit("DEFAULT"), self._aad(scope, row_id))
        bad = F.raise_error(F.lit("HUSHLAKE INVALID_CIPHERTEXT")).cast("binary") if strict else F.lit(None).cast("binary")
        return F.when(sealed.isNull(), F.lit(None).cast("binary")).when(envelope_shape(sealed), opened).otherwise(bad)


def envelope_shape(sealed: Column) -> Column:
    return (F.octet_length(sealed) >= LEAST_ENVELOPE) & (F.substring(sealed, 1, 1) == binary(VERSION))
