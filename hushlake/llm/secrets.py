"""Secrets in whole texts, also under nested encodings.

Each text starts a worklist of layers.  A layer is scanned, its findings are
mapped back to the text it came from, and whatever in it looks encoded (percent
escapes, Unicode escapes, base64 in one or many lines, and gzip or zlib data
inside any of them) is decoded into further layers, until no new layer appears.
Layers are bytes, whatever control characters they hold.  A layer that was seen
before at the same place is not taken again, so cycles end.

Percent and Unicode escapes keep a place for every byte; a base64 piece and
compressed data map as a whole to the characters that encode them.  The first
LEVELS levels of escapes are layers of their own; what is nested deeper is
unescaped to the end in one pass over the bytes, so a chain of escapes costs its
length and not the square of it.

Compressed data is inflated as a stream, member after member.  Up to LAYER bytes
are one layer; more are scanned in pieces that end where nothing can be cut in
two, so memory is bounded however far a few bytes inflate, and no byte is
skipped; the time is that of reading what was packed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Texts, chunks
from .scratch import small_batches

KINDS = ("assign", "access", "hex")

# Fixed patterns; key letters count in either case, ASCII only.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = [(kind, least, group, re.compile(p, re.A), re.compile(p.encode())) for kind, least, group, p in (("assign", 6, 2, _ASSIGN), ("access", 20, 0, r"AKIA[A-Z0-9]+"), ("hex", 24, 0, r"(?<![0-9a-f])[0-9a-f]{24,}+"))]

_PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(rb"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ONE_ESCAPE = re.compile(rb"\\u\{([0-9A-Fa-f]+)\}|\\[ux]([0-9A-Fa-f]{2}(?:(?<=\\u..)[0-9A-Fa-f]{2})?)|\\(.)|(\+)", re.S)
# Compressed bytes in escapes: what a form or a string literal has besides, decoded only in search of them.
_FORM = re.compile(rb"(?:%[0-9A-Fa-f]{2}|\+)+")
_LITERAL = re.compile(rb"""(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\[abfnrtv0\\'"])+""")
_SHORT = {b"a": 7, b"b": 8, b"f": 12, b"n": 10, b"r": 13, b"t": 9, b"v": 11, b"0": 0}
_PACKED = re.compile(rb"(?=\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff])")
_MARK = re.compile(rb"[%\\]")
# An escape at the end of some bytes; the longest has ten.
_LAST = re.compile(rb"(?:%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\})\Z")
_LONGEST = 10

_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}+={0,2}")
_PIECE = re.compile(rb"[A-Za-z0-9]{16,}+={0,2}")
_FOLD = rb"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
_WRAPPED = re.compile(rb"[A-Za-z0-9+/_-]{16,}+(?:" + _FOLD + rb"[A-Za-z0-9+/_-]{16,}+)*+(?:" + _FOLD + rb"[A-Za-z0-9+/_-]++)?={0,2}")
_FOLDS = re.compile(_FOLD)

#: Levels of escapes that are layers of their own.
LEVELS = 8
#: Inflated bytes that are one layer.
LAYER = 4 << 20
#: Inflated bytes that are held for want of a place to cut; beyond, pieces overlap by OVERLAP.
HELD, OVERLAP = 8 << 20, 1 << 20
#: Bytes that stand in no pattern and no encoding: no match goes over them.
_CUT = re.compile(rb"[^A-Za-z0-9+/_.=:%\\\"'{}\r\n\t -]")
_SPACES = re.compile(rb"\x20{2,}")


def base(text: str | bytes) -> list[tuple[str, int, int]]:
    """The base spans of one layer, by start and then kind."""
    at = 3 if isinstance(text, str) else 4
    out = [(p[0], *m.span()) for p in _PATTERNS for m in p[at].finditer(text) if m.end(p[2]) - m.start(p[2]) >= p[1]]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# Places ----------------------------------------------------------------------


class _Chars:
    """Bytes of the text itself, in code points."""

    BLOCK = 4096

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self._heads = None if data.isascii() else (raw & 0xC0) != 0x80
        if self._heads is not None:
            self._before = np.concatenate([[0], np.cumsum(np.add.reduceat(self._heads, np.arange(0, len(raw), self.BLOCK), dtype=np.int64))])

    def _at(self, i: int) -> int:
        if self._heads is None:
            return i
        k = i // self.BLOCK
        return int(self._before[k] + np.count_nonzero(self._heads[k * self.BLOCK : i]))

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self._at(a), self._at(b)


class _Flat:
    """Bytes that stand for all of one span."""

    def __init__(self, a: int, b: int):
        self._span = a, b

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self._span


class _Mapped:
    """Bytes in segments: copies of bytes of the layer above, or what one escape in it stands for."""

    def __init__(self, above, at, old, stop, copied):
        self._above, self._at, self._old, self._stop, self._copied = above, at, old, stop, copied

    def _find(self, i: int) -> tuple[int, int]:
        k = int(np.searchsorted(self._at, i, side="right")) - 1
        if self._copied[k]:
            first = int(self._old[k]) + i - int(self._at[k])
            return first, first + 1
        return int(self._old[k]), int(self._stop[k])

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self._above.span(self._find(a)[0], self._find(b - 1)[1])


# Decoding --------------------------------------------------------------------


def _packed(raw: bytes, i: int = 0) -> bool:
    """Whether the header of gzip or zlib data stands at i."""
    return raw[i : i + 3] == b"\x1f\x8b\x08" or len(raw) > i + 6 and raw[i] & 15 == 8 and raw[i] < 0x80 and (raw[i] << 8 | raw[i + 1]) % 31 == 0


class _Inflated:
    """Inflated bytes of gzip or zlib data, as often as asked for: one member after the other, as far as the data is sound."""

    PIECE = 1 << 20

    def __init__(self, source, i: int = 0):
        self._source, self._from = source, i
        self.stop, self.whole = i, False

    def __iter__(self) -> Iterator[bytes]:
        at, box, fresh = self._from, zlib.decompressobj(47), True
        self.stop, self.whole = at, False
        for raw in self._fed():
            while raw:
                if fresh:  # gzip may be padded with zeros between members
                    rest = raw.lstrip(b"\0") if self.whole else raw
                    at += len(raw) - len(rest)
                    raw = rest
                    if not raw:
                        break
                try:
                    part = box.decompress(raw, self.PIECE)
                except zlib.error:
                    return
                fresh = False
                left = box.unused_data if box.eof else box.unconsumed_tail
                at += len(raw) - len(left)
                if part:
                    yield part
                if box.eof:
                    self.stop, self.whole = at, True
                    box, fresh = zlib.decompressobj(47), True
                raw = left
                if not self.whole:
                    self.stop = at

    def _fed(self) -> Iterator[bytes]:
        """Little at a time: what comes before damaged data is not lost."""
        if isinstance(self._source, bytes):
            for i in range(self._from, len(self._source), 1024):
                yield self._source[i : i + 1024]
        else:
            for part in self._source:
                for i in range(0, len(part), 1024):
                    yield part[i : i + 1024]

    def head(self, n: int) -> bytes:
        out = b""
        for part in self:
            out += part
            if len(out) >= n:
                break
        return out


def _unpack(raw: bytes, i: int = 0) -> tuple[bytes | _Inflated, int, bool]:
    """What is packed at i (the bytes themselves up to LAYER, else a stream), where it ends, and whether it is complete; no bytes if nothing is packed there."""
    if not _packed(raw, i):
        return b"", i, False
    stream, out, size = _Inflated(raw, i), [], 0
    for part in stream:
        out.append(part)
        size += len(part)
        if size > LAYER:
            return stream, len(raw), True
    return b"".join(out), stream.stop, stream.whole


def _decode64(piece: bytes) -> bytes:
    piece = _FOLDS.sub(b"", piece).rstrip(b"=").translate(_STANDARD)
    if len(piece) % 4 == 1:
        piece = piece[:-1]
    return base64.b64decode(piece + b"=" * (-len(piece) % 4))


_STANDARD = bytes.maketrans(b"-_", b"+/")


def _good(raw: bytes) -> bool:
    """Whether decoded bytes are text or compressed, so that they were cut at the right places."""
    if _packed(raw) and _Inflated(raw).head(1):
        return True
    try:
        return len(raw.decode()) >= 6
    except UnicodeDecodeError:
        return False


def _pieces(layer: bytes):
    """Base64 in a layer: start, end and decoded bytes; lines of wrapped base64 as one where they fit together."""
    for block in _WRAPPED.finditer(layer):
        raw, folds = _decode64(block[0]), [m.start() for m in _FOLDS.finditer(block[0])]
        if folds and _good(raw):
            yield *block.span(), raw
            continue
        if len(folds) > 1 and _good(short := _decode64(block[0][: folds[-1]])):
            yield block.start(), block.start() + folds[-1], short
            yield from _lines(layer, block.start() + folds[-1], block.end())
            continue
        if folds:
            yield *block.span(), raw
        yield from _lines(layer, *block.span())


def _lines(layer: bytes, start: int, end: int):
    for m in _BASE64.finditer(layer, start, end):
        raw = _decode64(m[0])
        yield *m.span(), raw
        if not _good(raw):
            for p in _PIECE.finditer(layer, *m.span()):
                if p.span() != m.span():
                    yield *p.span(), _decode64(p[0])


def _rewritten(layer: bytes, pattern: re.Pattern, decode, place) -> tuple[bytes, _Mapped] | None:
    """The layer with each match decoded."""
    out, at, old, stop, copied, last, n = [], [], [], [], [], 0, 0

    def add(raw, a, b, copy):
        nonlocal n
        out.append(raw)
        at.append(n + (np.zeros(1, np.int64) if copy else np.arange(len(raw))))
        old.append(a)
        stop.append(b)
        copied.append(np.full(len(a), copy))
        n += len(raw)

    for m in pattern.finditer(layer):
        if m.start() > last:
            add(layer[last : m.start()], np.array([last]), np.array([last + 1]), True)
        got, a, b = decode(m[0])
        add(got, np.asarray(a, np.int64) + m.start(), np.asarray(b, np.int64) + m.start(), False)
        last = m.end()
    if not last:
        return None
    if last < len(layer):
        add(layer[last:], np.array([last]), np.array([last + 1]), True)
    return b"".join(out), _Mapped(place, *map(np.concatenate, (at, old, stop, copied)))


def _percent(run: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes of a run of percent escapes (and of plus signs for spaces), each with its place."""
    raw = np.frombuffer(run, np.uint8)
    starts = np.flatnonzero((raw == 0x25) | (raw == 0x2B))
    return bytes.fromhex(run.replace(b"%", b"").replace(b"+", b"20").decode()), starts, np.append(starts[1:], len(run))


def _code(code: int) -> bytes:
    """Codes below 256 are bytes, others are UTF-8."""
    return bytes([code]) if code < 256 else chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else b"\xff"


def _escapes(run: bytes) -> tuple[bytes, list[int], list[int]]:
    """Bytes of a run of escapes, each with its place."""
    out, starts, ends = bytearray(), [], []
    for m in _ONE_ESCAPE.finditer(run):
        got = _code(int(m[1] or m[2], 16) if m[1] or m[2] else _SHORT.get(m[3], m[3][0]))
        out += got
        starts += [m.start()] * len(got)
        ends += [m.end()] * len(got)
    return bytes(out), starts, ends


_ENDS = frozenset(b"0123456789abcdefABCDEF}")


def _settled(layer: bytes, place) -> tuple[bytes, _Mapped]:
    """The layer without any escapes, however deeply they are nested, in one pass.

    Bytes move to the output one by one near a mark; as soon as its last bytes are
    an escape, the byte it stands for takes their place, and may end another.
    """
    out, at, old, stop, copied = bytearray(), [], [], [], []

    def put(raw: bytes, a: int, b: int, copy: bool) -> None:
        at.append(len(out))
        old.append(a)
        stop.append(b)
        copied.append(copy)
        out.extend(raw)

    i, n = 0, len(layer)
    single = 0  # bytes at the end of the output that went there one by one
    while i < n:
        tail = out[-min(single, _LONGEST - 1) :] if single else b""
        if b"%" not in tail and b"\\" not in tail:
            m = _MARK.search(layer, i)
            j = m.start() if m else n
            if j > i:
                put(layer[i:j], i, i + 1, True)
                single, i = 0, j
                if i == n:
                    break
        put(layer[i : i + 1], i, i + 1, False)
        single, i = single + 1, i + 1
        while out[-1] in _ENDS and (m := _LAST.search(out[-min(single, _LONGEST) :])):
            size = m.end() - m.start()
            a, b = old[-size], stop[-1]
            for column in (at, old, stop, copied):
                del column[-size:]
            del out[-size:]
            got = _code(int(m[1] or m[2] or m[3] or m[4], 16))
            for k in range(len(got)):
                put(got[k : k + 1], a, b, False)
            single += len(got) - size
    return bytes(out), _Mapped(place, *(np.array(c) for c in (at, old, stop, copied)))


def _children(layer: bytes, place, level: int):
    """Layers under a layer: bytes or a stream, their place, and their level of escapes."""
    if got := _unpack(layer)[0]:
        yield got, _Flat(*place.span(0, len(layer))), 0
    if level < LEVELS:
        for pattern, decode, wide in ((_PERCENT, _percent, _FORM), (_ESCAPE, _escapes, _LITERAL)):
            if plain := _rewritten(layer, pattern, decode, place):
                yield *plain, level + 1
                if not level and (_PERCENT.search(plain[0]) or _ESCAPE.search(plain[0])):
                    yield *_settled(layer, place), LEVELS
                data, own = _rewritten(layer, wide, decode, _Same())
                end = 0
                for m in _PACKED.finditer(data):
                    i = m.start()
                    # a header has an escape in its first two bytes, or else it is text
                    if i >= end and _packed(data, i) and max(b - a for a, b in (own.span(k, k + 1) for k in range(i, min(i + 2, len(data))))) > 1:
                        got, stop, whole = _unpack(data, i)
                        if got and (whole or data[i] == 0x1F):
                            end = stop
                            yield got, _Flat(*place.span(*own.span(i, stop))), 0
    for a, b, raw in _pieces(layer):
        yield raw, _Flat(*place.span(a, b)), 0


class _Same:
    """Bytes that are their own place."""

    def span(self, a: int, b: int) -> tuple[int, int]:
        return a, b


def _cut_up(stream: _Inflated, digest) -> Iterator[bytes]:
    """A stream in pieces of about LAYER bytes that end at a byte which is part of nothing; runs of spaces count as one."""
    held = b""
    for part in stream:
        digest.update(part)
        if held.endswith(b" "):
            part = part.lstrip(b" ")
        held += _SPACES.sub(b" ", part)
        if len(held) < LAYER:
            continue
        last = None
        for lo in range(len(held) - 4096, 0, -4096):
            for m in _CUT.finditer(held, lo, lo + 4096):
                last = m.end()
            if last:
                break
        if last:
            yield held[:last]
            held = held[last:]
        elif len(held) >= HELD:
            yield held
            held = held[-OVERLAP:]
    if held:
        yield held


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]]]:
    """Base spans, and all spans with the depth of the layer they were found in (0: the text itself)."""
    own = base(text)
    spans = {(k, a, b): 0 for k, a, b in own}
    data = text.encode("utf-8", "surrogatepass")
    seen = {(hashlib.sha256(data).digest(), 0, len(text))}
    work = [_under(data, _Chars(data), 0, 0)]
    while work:
        found = next(work[-1], None)
        if found is None:
            work.pop()
            continue
        layer, place, level, depth = found
        if isinstance(layer, _Inflated):
            # its pieces first, one at a time; then what the stream itself packs, if it was not met before
            work.append(_streamed(layer, place, depth, seen))
            continue
        if not layer:
            continue
        key = (hashlib.sha256(layer).digest(), *place.span(0, len(layer)))
        if key in seen:
            continue
        seen.add(key)
        for k, a, b in base(layer):
            spans.setdefault((k, *place.span(a, b)), depth)
        work.append(_under(layer, place, level, depth))
    return own, sorted(((k, a, b, d) for (k, a, b), d in spans.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _under(layer: bytes, place, level: int, depth: int):
    for child, own, next_level in _children(layer, place, level):
        yield child, own, next_level, depth + 1


def _streamed(stream: _Inflated, place, depth: int, seen: set):
    digest = hashlib.sha256()
    for piece in _cut_up(stream, digest):
        yield piece, place, 0, depth
    key = (digest.digest(), *place.span(0, 1))
    if key not in seen and _packed(stream.head(8)):
        seen.add(key)
        inner = _Inflated(stream)
        if inner.head(1):
            yield inner, place, 0, depth + 1


# What a decoded piece needs to hold a secret or another layer.
_HINT = re.compile(rb"(?i:pass|secr|toke|api)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[ux]|[A-Za-z0-9+/_-]{16}")


def _hint(piece: bytes) -> bool:
    raw = _decode64(piece)
    return _packed(raw) or _HINT.search(raw) is not None


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_HEX_DIGIT = _table("0123456789abcdefABCDEF")
_LOW_HEX = _table("0123456789abcdef")
_CODE = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_ESCAPE_LETTER = _table("ux")


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least so many within one row."""
    n = len(inside)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _begins(data: np.ndarray, *steps) -> np.ndarray:
    """Places from which each byte is its step: a value, or a table of values."""
    n = len(data) - len(steps) + 1
    hit = np.ones(max(0, n), dtype=bool)
    for i, step in enumerate(steps if n > 0 else ()):
        part = data[i : n + i]
        hit &= step[part] if isinstance(step, np.ndarray) else part == step
    return np.flatnonzero(hit)


def _candidates(texts: Texts) -> np.ndarray:
    """Rows that may hold a secret or an encoded layer."""
    data = texts.data
    lower = data | 0x20
    hits = [_runs(_LOW_HEX[data], texts.offsets, 24)[0], *(_begins(lower, *word) for word in (b"pass", b"secr", b"toke", b"api")), _begins(data, *b"AKIA")]
    hits += [_begins(data, 0x25, _HEX_DIGIT, _HEX_DIGIT), _begins(data, 0x5C, _ESCAPE_LETTER)]
    raw = data.tobytes()
    coded = []
    for a, b in zip(*map(np.ndarray.tolist, _runs(_CODE[data], texts.offsets, 16)), strict=True):
        piece = raw[a:b]
        if raw[b : b + 1] in (b"\n", b"\r", b"\\") or _hint(piece) or any(_hint(p[0]) for p in _PIECE.finditer(piece)):
            coded.append(a)
    hits.append(np.array(coded, dtype=np.int64))
    return np.unique(np.searchsorted(texts.offsets, np.concatenate(hits), side="right") - 1)


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


_NONE = hashlib.sha256(b"").hexdigest()


def _run(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("depth", pa.int32())])
    for batch in batches:
        for texts in chunks(batch.column(1)):
            n = len(texts)
            counts = {k: np.zeros(n, dtype=np.int64) for k in KINDS}
            digest, spans, found = [_NONE] * n, [""] * n, [[] for _ in range(n)]
            for r in _candidates(texts).tolist():
                own, every = find(texts.text(r))
                if not every:
                    continue
                for k, _, _ in own:
                    counts[k][r] += 1
                digest[r] = hashlib.sha256(joined(own).encode()).hexdigest()
                spans[r] = joined(every)
                found[r] = [dict(zip(("kind", "start", "stop", "depth"), s, strict=True)) for s in every]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.lo, n), *(pa.array(counts[k]) for k in KINDS), pa.array(digest), pa.array(spans), pa.array(found, pa.list_(span))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"],
            )


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: doc_id, n_assign, n_access, n_hex (of the text itself), base_sha256, spans, found.

    base_sha256 is the digest of the base spans, `spans` lists those and the
    spans of decoded layers, both as kind:start:end (code points, end exclusive)
    joined by commas; found has them as structs with the depth of their layer.

    Null text counts as empty and has no spans; null and repeated ids pass
    through, a row comes back for each input row; other columns are ignored,
    whatever their names.  Texts of any length are searched whole, and so is
    whatever is packed in them, in time that grows with the unpacked bytes and in
    bounded memory; only inside compressed data of over HELD bytes may one unbroken
    encoded run of more than OVERLAP bytes be decoded in parts.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,stop:long,depth:int>>")
