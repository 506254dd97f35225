"""Candidate tokens and proof keys: what a query term becomes, and the same for stored values.

A token is 32 bits of the scope and the leading `bits` bits of 32 of the piece, both
keyed; it may be shared by different pieces, and never differs for equal ones.  A
proof key is a 256-bit keyed hash of a piece; salted per row it becomes a stamp.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..functions.framing import frame, u32
from ..functions.keys import Keyring
from ..functions.normalize import compact_all, normalize
from .model import EXACT, Profile


@dataclass(frozen=True)
class ProfileKeys:
    """Derived keys of one profile; the root key stays behind."""

    token: bytes
    proof: bytes
    bits: int

    @classmethod
    def of(cls, ring: Keyring, profile: Profile) -> "ProfileKeys":
        derive = lambda label, size: ring.derive(profile.model, label, profile.descriptor, size)
        return cls(derive("token", 48), derive("proof", 32), profile.bits)

    def token_of(self, scope: str, piece: bytes) -> int:
        high = _scope_part(self.token, scope)
        low = int.from_bytes(hmac.digest(self.token, _head(("value", scope)) + u32(len(piece)) + piece, "sha384")[:4], "big")
        low &= 0xFFFFFFFF << (32 - self.bits) & 0xFFFFFFFF
        return struct.unpack(">q", struct.pack(">II", high, low))[0]

    def proof_of(self, scope: str, piece: bytes) -> bytes:
        inner, outer = _pads(self.proof)
        return hashlib.sha256(outer + hashlib.sha256(inner + _head((scope,)) + u32(len(piece)) + piece).digest()).digest()


@lru_cache(maxsize=4096)
def _head(parts: tuple[str, ...]) -> bytes:
    """frame() of the parts and one more, without that one."""
    return frame([*parts, b""])[:-4]


@lru_cache(maxsize=4096)
def _pads(key: bytes) -> tuple[bytes, bytes]:
    """The two blocks of HMAC-SHA256 of a short key: for short messages, hashing them takes half the time of hmac.digest()."""
    padded = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)


@lru_cache(maxsize=4096)
def _scope_part(key: bytes, scope: str) -> int:
    return int.from_bytes(hmac.digest(key, frame(["scope", scope]), "sha384")[:4], "big")


def stamp(key: bytes, salt: bytes, ordinal: int | None = None) -> int:
    raw = key + salt + (b"" if ordinal is None else u32(ordinal))
    return struct.unpack(">q", hashlib.sha256(raw).digest()[:8])[0]


def grams(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(len(text) - 1)]


def pieces(text: str, skip_grams: bool, start: bool = False, end: bool = False) -> list[bytes]:
    """Distinct framed pieces of a compact text of at least two characters: pairs, pairs with a gap, and its ends where asked for."""
    if len(text) < 2:
        return []
    out = [("pair", g) for g in grams(text)]
    out += [("start", text[:2])] if start else []
    out += [("end", text[-2:])] if end else []
    out += [("gap", text[i] + text[i + 2]) for i in range(len(text) - 2)] if skip_grams else []
    return [frame([k, v]) for k, v in dict.fromkeys(out)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... so many times counts[i], one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _lists(counts: np.ndarray, values: pa.Array, none: np.ndarray | None = None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=None if none is None else np.concatenate([none, [False]])), values)


def _numbers(distinct: dict, items, n: int) -> np.ndarray:
    """For each item its place in the dictionary, which takes what is new."""
    return np.fromiter((distinct.setdefault(x, len(distinct)) for x in items), np.int64, n)


def _salts(n: int) -> tuple[pa.Array, bytes]:
    raw = os.urandom(16 * n)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(raw)]).cast(pa.binary()), raw


class TextIndex:
    """Index entries of text values, a batch at a time; hashes of the pieces met so far are remembered."""

    MOST = 200_000
    #: Stamps that are hashed at a time.
    BLOCK = 1 << 16

    def __init__(self, keys: ProfileKeys, normalizer: str, skip_grams: bool, hardened: bool):
        self.keys, self.normalizer, self.skip_grams, self.hardened = keys, normalizer, skip_grams, hardened
        self._tokens: dict[tuple[str, str, str], int] = {}
        self._proofs: dict[tuple[str, str], bytes] = {}

    def _token(self, scope: str, kind: str, gram: str) -> int:
        found = self._tokens.get((scope, kind, gram))
        if found is None:
            if len(self._tokens) >= self.MOST:
                self._tokens.clear()
            found = self._tokens[scope, kind, gram] = self.keys.token_of(scope, frame([kind, gram]))
        return found

    def _proof(self, scope: str, gram: str) -> bytes:
        found = self._proofs.get((scope, gram))
        if found is None:
            if len(self._proofs) >= self.MOST:
                self._proofs.clear()
            found = self._proofs[scope, gram] = self.keys.proof_of(scope, gram.encode())
        return found

    def substring(self, texts: list[str], scopes: list[str]) -> list[pa.Array]:
        """Columns (tokens, unless hardened, salt, length, stamps, offsets): stamps ascend, one for each pair of characters, counted by occurrence."""
        n, known, spaces = len(texts), {}, {}
        which = _numbers(known, zip(scopes, texts, strict=True), n)
        values = compact_all([t for _, t in known], self.normalizer)
        space = _numbers(spaces, (x for x, _ in known), len(known))
        size = np.fromiter(map(len, values), np.int64, len(values))
        chars = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        names = list(spaces)

        def grams_of(gap: int):
            """Of each pair with a distance: its value, its offset, and its number among the distinct ones, which come as scope and text."""
            count = np.maximum(size - gap, 0)
            owner, at = np.repeat(np.arange(len(values)), count), _ranges(begin, count)
            distinct, number = np.unique(space[owner] << 42 | chars[at] << 21 | chars[at + gap], return_inverse=True)
            own = [(names[g >> 42], chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)) for g in distinct.tolist()]
            return owner, at - begin[owner], number, own

        owner, offset, gram, grams = grams_of(1)
        count = np.maximum(size - 1, 0)
        first = np.cumsum(count) - count
        out = [] if self.hardened else [self._token_lists(owner, offset, gram, grams, size, grams_of(2) if self.skip_grams else None)]
        out = [c if len(known) == n else c.take(pa.array(which)) for c in out]
        # which occurrence of its pair each one is: equal pairs of a value come together, in order of their offsets
        together = np.sort((owner * max(len(grams), 1) + gram) * max(len(owner), 1) + np.arange(len(owner)))
        same, place = np.divmod(together, max(len(owner), 1))
        new = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, np.int64)
        ordinal = np.empty(len(owner), np.int64)
        ordinal[place] = np.arange(len(owner)) - np.repeat(new, np.diff(np.concatenate([new, [len(owner)]]))) + 1
        proofs = np.frombuffer(b"".join(self._proof(*g) for g in grams), np.uint8).reshape(-1, 32)
        entry, row = _ranges(first[which], count[which]), np.repeat(np.arange(n), count[which])
        while True:
            salts, raw = _salts(n)
            stamps = self._stamps(proofs, gram[entry], np.frombuffer(raw, np.uint8).reshape(-1, 16), row, ordinal[entry])
            order = _by_row(row, stamps, n)
            stamps, again = stamps[order], offset[entry][order]
            if not np.any((row[1:] == row[:-1]) & (stamps[1:] == stamps[:-1])):
                break
        lists = lambda values: _lists(count[which], values)
        return [*out, salts, pa.array(size[which], pa.int32()), lists(pa.array(stamps)), lists(pa.array(again, pa.int32()))]

    def _token_lists(self, owner, offset, gram, grams, size, gaps) -> pa.ListArray:
        """The distinct tokens of each value, ascending; null for values of fewer than two characters."""
        made = lambda kind, found, chosen: np.array([self._token(found[i][0], kind, found[i][1]) for i in chosen], np.int64)
        parts = [(owner, made("pair", grams, range(len(grams)))[gram])]
        for kind, here in (("start", offset == 0), ("end", offset == size[owner] - 2)):
            chosen, number = np.unique(gram[here], return_inverse=True)
            parts.append((owner[here], made(kind, grams, chosen.tolist())[number]))
        if gaps is not None:
            parts.append((gaps[0], made("gap", gaps[3], range(len(gaps[3])))[gaps[2]]))
        tokens, rank = np.unique(np.concatenate([t for _, t in parts]), return_inverse=True)
        pairs = np.sort(np.concatenate([o for o, _ in parts]) * max(len(tokens), 1) + rank)
        value, rank = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(len(tokens), 1))
        return _lists(np.bincount(value, minlength=len(size)), pa.array(tokens[rank]), size < 2)

    def _stamps(self, proofs, gram, salts, row, ordinal) -> np.ndarray:
        """stamp() of every entry."""
        out = np.empty(len(gram), np.int64)
        for at in range(0, len(gram), self.BLOCK):
            part = slice(at, at + self.BLOCK)
            raw = np.empty((len(gram[part]), 52), np.uint8)
            raw[:, :32], raw[:, 32:48] = proofs[gram[part]], salts[row[part]]
            raw[:, 48:] = ordinal[part].astype(">u4").view(np.uint8).reshape(-1, 4)
            out[part] = _leading(raw.view("V52").ravel().tolist())
        return out


def _leading(messages: list[bytes]) -> np.ndarray:
    """The first eight bytes of the hash of each."""
    sha256 = hashlib.sha256
    return np.frombuffer(b"".join([sha256(m).digest() for m in messages]), ">i8")[::4]


def _by_row(row: np.ndarray, stamps: np.ndarray, rows: int) -> np.ndarray:
    """The order by row and stamp: by row and the leading bits of the stamp, which mostly tell."""
    bits = 64 - max(rows, 2).bit_length()
    lead = (stamps.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)
    order = np.argsort(row.astype(np.uint64) << np.uint64(bits) | lead)
    found = stamps[order]
    return np.lexsort((stamps, row)) if np.any((row[1:] == row[:-1]) & (found[1:] < found[:-1])) else order


class ValueIndex:
    """Index entries of whole values, a batch at a time; hashes of the values met so far are remembered."""

    MOST = 200_000

    def __init__(self, keys: ProfileKeys, hardened: bool):
        self.keys, self.hardened = keys, hardened
        self._known: dict[tuple[str, bytes], tuple[int, bytes]] = {}

    def _entry(self, scope: str, raw: bytes) -> tuple[int, bytes]:
        found = self._known.get((scope, raw))
        if found is None:
            if len(self._known) >= self.MOST:
                self._known.clear()
            found = self._known[scope, raw] = 0 if self.hardened else self.keys.token_of(scope, raw), self.keys.proof_of(scope, raw)
        return found

    def exact(self, values: list[bytes], scopes: list[str]) -> list[pa.Array]:
        """Columns (token, unless hardened, salt, stamp)."""
        entries = [self._entry(s, v) for s, v in zip(scopes, values, strict=True)]
        salts, raw = _salts(len(values))
        stamps = _leading([proof + raw[16 * i : 16 * i + 16] for i, (_, proof) in enumerate(entries)])
        return [*([] if self.hardened else [pa.array([t for t, _ in entries], pa.int64())]), salts, pa.array(stamps.astype(np.int64))]


def exact_bytes(profile: Profile, value: str | bytes) -> bytes:
    """What an exact search compares: normalized text, or the codec's bytes."""
    assert profile.mode == EXACT
    return normalize(value, profile.normalizer).encode() if profile.kind == "text" else value
