"""Key derivation on the driver; labels are this package's own."""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

from ..errors import SealError, ensure
from .framing import frame

GLOBAL = "global"


@lru_cache(maxsize=4096)
def hkdf(root: bytes, info: bytes, size: int) -> bytes:
    """HKDF-SHA384 with an empty salt."""
    prk = hmac.digest(bytes(48), root, "sha384")
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = hmac.digest(prk, block + info + bytes([i]), "sha384")
        out, i = out + block, i + 1
    return out[:size]


class Keyring:
    """One root key for all models, or one fixed key for each model."""

    def __init__(self, root: bytes | None = None, models: dict[str, bytes] | None = None):
        for key in [root, *(models or {}).values()]:
            ensure(key is None or len(key) == 32, "KEY_NOT_FOUND")
        ensure(root is not None or models, "KEY_NOT_FOUND")
        self._root, self._models = root, dict(models or {})

    def scope(self, model: str) -> str:
        return f"model:{model}" if model in self._models else GLOBAL

    def derive(self, model: str, label: str, parts: list[str | bytes], size: int) -> bytes:
        key = self._models.get(model, self._root)
        if key is None:
            raise SealError("KEY_NOT_FOUND")
        return hkdf(key, frame([f"hushlake/{label}/1", model, self.scope(model), *parts]), size)

    def digest(self, model: str) -> str:
        """Tells two rings apart without giving the key away."""
        return hashlib.sha256(self.derive(model, "ring", [], 32)).hexdigest()[:16]

    def __repr__(self) -> str:
        return "Keyring(...)"

    def __getstate__(self):
        raise TypeError("a keyring stays on the driver")
