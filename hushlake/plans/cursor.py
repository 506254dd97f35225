"""Opaque page cursors, authenticated and bound to the query that they continue."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import os

from ..errors import SealError, ensure
from ..functions.framing import canonical, frame
from ..functions.keys import Keyring
from .model import Registration


def query_digest(value) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def _keys(ring: Keyring, registration: Registration) -> tuple[bytes, bytes]:
    raw = ring.derive(registration.model, "cursor", [], 64)
    return raw[:32], raw[32:]


def _stream(key: bytes, nonce: bytes, size: int) -> bytes:
    """Key stream from a keyed hash in counter mode: the standard library has no block cipher."""
    blocks = (hmac.digest(key, nonce + i.to_bytes(8, "big"), "sha256") for i in range(-(-size // 32)))
    return b"".join(blocks)[:size]


def _tag(key: bytes, registration: Registration, ring: Keyring, scope: str, digest: str, box: bytes) -> bytes:
    return hmac.digest(key, frame(["hushlake/cursor/1", registration.model, ring.scope(registration.model), scope, digest, box]), "sha256")


def seal_cursor(ring: Keyring, registration: Registration, scope: str, digest: str, position: list) -> str:
    """Encrypts, then authenticates (with the query's digest), the position of the last row."""
    hide, prove = _keys(ring, registration)
    nonce, plain = os.urandom(16), json.dumps(position).encode()
    box = nonce + bytes(a ^ b for a, b in zip(plain, _stream(hide, nonce, len(plain)), strict=True))
    return base64.urlsafe_b64encode(b"\x01" + box + _tag(prove, registration, ring, scope, digest, box)).decode().rstrip("=")


def open_cursor(ring: Keyring, registration: Registration, scope: str, digest: str, cursor: str) -> list:
    hide, prove = _keys(ring, registration)
    try:
        raw = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError, TypeError) as e:
        raise SealError("CURSOR_INVALID") from e
    ensure(len(raw) >= 49 and raw[0] == 1, "CURSOR_INVALID")
    box, tag = raw[1:-32], raw[-32:]
    ensure(hmac.compare_digest(tag, _tag(prove, registration, ring, scope, digest, box)), "CURSOR_INVALID")
    return json.loads(bytes(a ^ b for a, b in zip(box[16:], _stream(hide, box[:16], len(box) - 16), strict=True)))
