"""The one error of this package, told apart by code."""

from __future__ import annotations

import re

# The codes that callers may rely on.
CODES = """
SEAL_REQUIRED INVALID_VALUE INVALID_SCHEMA INVALID_QUERY INVALID_ID INVALID_TRANSACTION_CONTEXT REBUILD_INCOMPLETE NOT_FOUND
SCOPE_CONFLICT SCOPE_MISMATCH ROW_CONTEXT_MISSING LIMIT_EXCEEDED CANCELLED DB_TIMEOUT QUERY_TOO_BROAD UNSUPPORTED_SEARCH
CURSOR_INVALID CURSOR_EXPIRED VALIDATION_FAILED INVALID_CIPHERTEXT AUTHENTICATION_FAILED KEY_NOT_FOUND KEY_SCOPE_MISMATCH
UNSUPPORTED_DRIVER INVALID_CANDIDATE_SHAPE WRITE_OUTCOME_UNKNOWN DATABASE_ERROR CONSTRAINT_VIOLATION TRANSACTION_CONFLICT
""".split()


class SealError(Exception):
    def __init__(self, code: str, field_id: str | None = None):
        assert code in CODES, code
        super().__init__(f"{code}: {field_id}" if field_id else code)
        self.code, self.field_id = code, field_id

    def __reduce__(self):
        return SealError, (self.code, self.field_id)


def ensure(ok, code: str = "INVALID_VALUE", field_id: str | None = None) -> None:
    if not ok:
        raise SealError(code, field_id)


_IN_MESSAGE = re.compile(rf"\b(?:SealError: |HUSHLAKE )({'|'.join(CODES)})\b(?:: (\w+))?")


def from_spark(error: Exception) -> SealError:
    """What an executor reported: codes that this package raised, a failed tag of AES-GCM, or DATABASE_ERROR."""
    if isinstance(error, SealError):
        return error
    text = str(error)
    if m := _IN_MESSAGE.search(text):
        return SealError(m[1], m[2])
    if "AES_CRYPTO_ERROR" in text or "AEADBadTag" in text or "Tag mismatch" in text:
        return SealError("AUTHENTICATION_FAILED")
    return SealError("DATABASE_ERROR")
