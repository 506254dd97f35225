"""Removal of word windows that an earlier document holds already.

Level-wise doubling.  A window of `window` words can repeat only if the
windows of half its length inside it repeat, so short windows are counted
first, and only those found in more than one document are extended to twice
their length (one word of overlap makes 7 + 6 reach 13) and counted again, up to
the window asked for or until no candidate survives.  At the shortest level it is
enough to count one short window in each one of twice its length, picked by content
(the one with the smallest hash), because equal long windows pick the same one:
about a quarter of all positions.  Extended windows are compared by 128 bits.

Scale: what travels at the shortest level is a hash and a place for each picked window,
once to be counted (a minimum and a maximum, aggregated before the shuffle)
and once to learn whether it survives; the texts of documents with survivors
then meet their places and are extended.  At the last level all
windows that picked one short window travel as one row and meet in one sorted run.
A short window that was counted more than `run_limit` times (a phrase that is
common all over the corpus) is dealt out in as many parts as its count asks for;
each part tells the smallest and largest document of its different extended windows, these are aggregated, and
the parts learn what repeats.  Joins on hashes are left to the optimizer's splitting
of skewed partitions.  Neither groups nor pairs of documents are ever formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACE, U64, Words, by_row, chunks, covered, mix
from .scratch import cut, drop, empty, small_batches

RUN_LIMIT = 2000
_POS, _AHEAD = 32, 8  # bits of a position in its document, and of the distance to the short window
_LOW = (1 << _POS) - 1
_BLOCK = 1 << 18  # windows that are looked at together


def _levels(window: int) -> list[int]:
    """Lengths from the shortest level up to the window, each at most twice the one before."""
    out = [window]
    while out[0] > 7:
        out.insert(0, out[0] // 2 + 1)
    return out


def _picked(words: Words, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the long windows, the distance from each to the short window in it with the smallest hash, and that hash."""
    at = words.window_starts(long)
    ahead, best = np.zeros(len(at), dtype=np.uint8), np.zeros(len(at), dtype=U64)
    for lo in range(0, len(at), _BLOCK):
        here = at[lo : lo + _BLOCK]
        grams = words.span(np.arange(here[0], here[-1] + long - short + 1), short)
        here = here - here[0]
        least, far = grams[here], ahead[lo : lo + _BLOCK]
        for j in range(1, long - short + 1):
            other = grams[here + j]
            less = other < least
            least = np.where(less, other, least)
            far[less] = j
        best[lo : lo + _BLOCK] = least
    return at, ahead.astype(np.int64), best


def _heads(picked: np.ndarray) -> np.ndarray:
    """Where another short window is picked than one place before."""
    return np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]])) if len(picked) else picked


def _anchors(short: int, long: int, places: bool):
    """The picked short windows of all texts: hash and document, and their places if asked for."""
    schema = pa.schema([(c, pa.int64()) for c in ("h", "doc", *(("mark", "at") if places else ()))])

    def run(batches):
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for texts in chunks(batch.column(2)):
                words = Words(texts, SPACE)
                at, ahead, best = _picked(words, short, long)
                picked = at + ahead
                head = _heads(picked)
                row = words.row[at[head]]
                out = [best[head].view(np.int64), ids[texts.lo + row]]
                if places:
                    out += [marks[texts.lo + row], picked[head] - words.first[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


_EXTENDED = pa.schema([(c, pa.int64()) for c in ("h", "part", "doc", "mark", "at")] + [("prints", pa.binary())])


def _extended(short: int, long: int, first: bool, packed: bool):
    """Windows of the long level whose short windows survive.

    At the first level those whose picked short window does, at later levels those that begin
    and end with a survivor.  If packed, the windows of one short window are one row, in the part
    that its document belongs to (-1 if there is only one part); else they are a row each, without h.
    """

    def batch_of(h, part, doc, mark, at, prints, ends):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, part, doc, mark, at)), pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32) * 16), pa.py_buffer(prints)])], schema=_EXTENDED)

    def run(batches):
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy() for i in (0, 1))
            alive = batch.column(3)
            for texts in chunks(batch.column(2)):
                words = Words(texts, SPACE)
                survivors = alive.slice(texts.lo, len(texts))
                places = survivors.flatten().to_numpy()
                # how many parts the short window at a word is dealt out in; 0 where it does not survive
                parts = np.zeros(len(words) + 1, dtype=np.int32)
                parts[(places & _LOW) + np.repeat(words.first[:-1], survivors.value_lengths().to_numpy())] = np.maximum(1, places >> _POS)
                if first:
                    at, ahead, best = _picked(words, short, long)
                    some = parts[at + ahead] > 0
                    at, ahead, best = at[some], ahead[some], best[some]
                else:
                    at = words.window_starts(long)
                    at = at[(parts[at] > 0) & (parts[at + long - short] > 0)]
                if not len(at):
                    continue
                prints = np.stack([words.span(at, long), words.span(at, long, other=True)], axis=1)
                row = words.row[at]
                doc, mark, pos = ids[texts.lo + row], marks[texts.lo + row], at - words.first[row]
                if not packed:
                    none = np.zeros(len(at), dtype=np.int64)
                    yield batch_of(none, none, doc, mark, pos, prints, np.arange(len(at) + 1))
                    continue
                k = _heads(at + ahead)
                n = parts[(at + ahead)[k]]
                part = np.where(n > 1, (mix(doc[k].view(U64)) % n.astype(U64)).astype(np.int64), -1)
                yield batch_of(best[k].view(np.int64), part, doc[k], mark[k], (ahead[k] << _POS) | pos[k], prints, np.append(k, len(at)))

    return run


def _windows(at, ends, prints):
    """The windows of packed rows, one by one: their row, their number in it, how far ahead the short window is, and their hashes."""
    sizes = ends[1:] - ends[:-1]
    row = np.repeat(np.arange(len(at)), sizes)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, inner, (at >> _POS)[row] - inner, prints[np.repeat(ends[:-1], sizes) + inner]


def _alike(group, ahead, prints):
    """An order in which equal windows of a group stand together (else as they were), and the number of each window's kind in it."""
    place = (group.astype(U64) << U64(_AHEAD)) | ahead.astype(U64)
    order = np.lexsort((prints[:, 1], prints[:, 0], place))
    g, p = place[order], prints[order]
    head = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1]).any(axis=1)])
    return order, np.flatnonzero(head), np.cumsum(head) - 1


_FLAGS = pa.list_(pa.int64())
_OUT = pa.schema([(c, pa.int64()) for c in ("kind", "doc", "mark", "at", "h", "part")] + [("prints", pa.binary()), ("flags", _FLAGS)])
_OUT_COLUMNS = "kind long, doc long, mark long, at long, h long, part long, prints binary, flags array<long>"
#: Kinds of rows: a window's smallest (doc) and largest (mark) document in its part, a row of a part, and what was found in a document.
_LEAST, _ROW, _FOUND = 0, 1, 2


def _out(kind, doc, mark, at=None, h=None, part=None, prints=None, flags=None) -> pa.RecordBatch:
    n = len(doc)
    numbers = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (np.full(n, kind), doc, mark, at, h, part)]
    return pa.RecordBatch.from_arrays([*numbers, pa.nulls(n, pa.binary()) if prints is None else prints, pa.nulls(n, _FLAGS) if flags is None else flags], schema=_OUT)


def _hashes_of(table) -> tuple[np.ndarray, np.ndarray]:
    """Ends and hashes of the windows of each row."""
    column = table["prints"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 16
    return ends, np.frombuffer(column.buffers()[2], np.uint64).reshape(-1, 2)


def _flags(hit, row, inner, doc, mark, at) -> pa.RecordBatch:
    """For each document with hits, pairs: a place, and a bit for each window from there on that is a hit."""
    bits = np.zeros(len(at), dtype=np.int64)
    np.bitwise_or.at(bits, row[hit], np.int64(1) << inner[hit])
    found = np.flatnonzero(bits)
    found = found[np.lexsort((mark[found], doc[found]))]
    d, m = doc[found], mark[found]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])])) if len(found) else found
    pairs = np.stack([at[found] & _LOW, bits[found]], axis=1).ravel()
    flags = pa.ListArray.from_arrays(pa.array(2 * np.append(first, len(found)), pa.int32()), pa.array(pairs))
    return _out(_FOUND, d[first], m[first], flags=flags)


def _repeats(table):
    """Places of windows of which an earlier document has the like; rows of parts go on, with what each part holds."""
    h, part, doc, mark, at = (table[c].to_numpy() for c in ("h", "part", "doc", "mark", "at"))
    ends, prints = _hashes_of(table)
    group = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])) - 1
    row, inner, ahead, prints = _windows(at, ends, prints)
    order, heads, kind = _alike(group[row], ahead, prints)
    who = doc[row][order]  # within a kind in the order of documents
    hit = np.zeros(len(row), dtype=bool)
    hit[order] = who > who[heads][kind]
    split = part >= 0
    yield _flags(hit & ~split[row], row, inner, doc, mark, at)
    if split.any():
        one = heads[split[row[order[heads]]]]
        last = np.append(heads[1:], len(order))[split[row[order[heads]]]] - 1
        k = order[one]
        own = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(np.arange(0, 16 * len(k) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(prints[k]))])
        yield _out(_LEAST, who[one], who[last], ahead[k], h[row[k]], part[row[k]], own)
        gone = np.flatnonzero(split)
        yield _out(_ROW, doc[gone], mark[gone], at[gone], h[gone], part[gone], table["prints"].take(pa.array(gone)).combine_chunks())


def _resolved(table):
    """The same for parts: each has the smallest documents of its windows that repeat, and then its rows."""
    h, part, doc, mark, at, kinds = (table[c].to_numpy() for c in ("h", "part", "doc", "mark", "at", "kind"))
    ends, prints = _hashes_of(table)
    least = kinds == _LEAST
    group = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])) - 1
    row, inner, ahead, prints = _windows(np.where(least, at << _POS, at), ends, prints)
    order, heads, kind = _alike(group[row], ahead, prints)
    first = row[order[heads]]
    lo = np.where(least[first], doc[first], np.iinfo(np.int64).max)
    hit = np.zeros(len(row), dtype=bool)
    hit[order] = doc[row[order]] > lo[kind]
    yield _flags(hit & ~least[row], row, inner, doc, mark, at)


def _streamed(solve, keys: list[str]):
    """Run over tables of whole groups of rows sorted by the keys; about one group is held at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < 50_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            differ = np.zeros(table.num_rows, dtype=bool)
            for key in keys:
                column = table[key].to_numpy()
                differ |= column != column[-1]
            k = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
            if k:
                yield from solve(table.slice(0, k).combine_chunks())
            held = table.slice(k).to_batches()
            n -= k
        if n:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _applied(window: int):
    # flags are pairs: a place, and a bit for each of the windows that start at it and after it
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches, with_text):
        for batch in batches:
            flags = batch.column(2)
            for texts in chunks(batch.column(1)):
                words = Words(texts, SPACE)
                starts = []
                for r in range(len(texts)):
                    marks = flags[texts.lo + r]
                    if not marks.is_valid:
                        continue
                    v = marks.values.to_numpy().reshape(-1, 2)
                    bits = np.flatnonzero((v[:, 1][:, None] >> np.arange(window)) & 1)
                    starts.append(words.first[r] + (v[:, 0] & ((1 << _POS) - 1))[bits // window] + bits % window)
                starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
                gone = covered(len(words), starts, window)
                kept = words.joined(~gone)
                cols = [
                    batch.column(0).slice(texts.lo, len(texts)),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(by_row(gone, words.first)),
                    pa.array([hashlib.sha256(kept.raw(r)).hexdigest() for r in range(len(texts))]),
                    pa.array([kept.text(r) for r in range(len(texts))] if with_text else [None] * len(texts), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _repeated(windows: DataFrame, by: str) -> DataFrame:
    """Hashes found in more than one document, with the smallest and how often."""
    return windows.groupBy(by).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")


def _found(rows: DataFrame, window: int, run_limit: int) -> DataFrame:
    """Places of windows of which an earlier document has the like: doc, mark and flags, which may come in several rows for a document."""
    levels = _levels(window)
    first = rows.mapInArrow(_anchors(levels[0], levels[1], False), "h long, doc long")
    again = cut(_repeated(first, "h").select("h", F.ceil(F.col("n") / run_limit).cast("int").alias("parts")), free=True)
    places = rows.mapInArrow(_anchors(levels[0], levels[1], True), "h long, doc long, mark long, at long")
    alive = cut(places.join(again, "h").select("doc", "mark", F.col("at").bitwiseOR(F.shiftleft(F.col("parts").cast("long"), _POS)).alias("at")), free=True)
    drop(again)
    for k in range(1, len(levels)):
        last = k == len(levels) - 1
        packed = last and k == 1
        per_doc = alive.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.collect_list("at").alias("alive"))
        texts = rows.join(per_doc, ["doc_id", "mark"]).select("doc_id", "mark", "text", "alive")
        windows = texts.mapInArrow(_extended(levels[k - 1], levels[k], k == 1, packed), "h long, part long, doc long, mark long, at long, prints binary")
        if packed:
            runs = windows.repartition("h", "part").sortWithinPartitions("h", "part", "doc").mapInArrow(_streamed(_repeats, ["h", "part"]), _OUT_COLUMNS)
            found = cut(runs, free=True)
            break
        windows = cut(windows, free=True)
        least = _repeated(windows, "prints").select("prints", "lo")
        old, alive = alive, windows.join(least, "prints")
        if last:
            found = cut(alive.where("doc > lo").select("doc", "mark", F.array(F.col("at"), F.lit(1).cast("long")).alias("flags")), free=True)
        else:
            alive = cut(alive.select("doc", "mark", "at"), free=True)
        drop(old)
        drop(windows)
        if last or empty(alive):
            return found if last else alive.select("doc", "mark", F.array("at").alias("flags"))
    drop(alive)
    whole = found.where(F.col("kind") == _FOUND).select("doc", "mark", "flags")
    least = found.where(F.col("kind") == _LEAST)
    if empty(least):
        return whole
    alike = ["h", "at", "prints"]
    more = least.groupBy(*alike).agg(F.min("doc").alias("lo"), F.max("mark").alias("hi")).where("lo < hi")
    more = least.join(more, alike).select("kind", F.col("lo").alias("doc"), "mark", "at", "h", "part", "prints", "flags")
    parts = found.where(F.col("kind") == _ROW).unionByName(more).repartition("h", "part").sortWithinPartitions("h", "part", "kind")
    return whole.unionByName(parts.mapInArrow(_streamed(_resolved, ["h", "part"]), _OUT_COLUMNS).select("doc", "mark", "flags"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Remove each word that lies in a window of `window` words whose word sequence also starts in a document with a smaller id.

    Words are runs of anything but space and the ASCII controls 09-0D.  Windows
    are judged on the input.  One row comes back for each input row: doc_id,
    n_words, n_removed, kept_sha256 and kept_text (kept words joined by one
    space; null if not with_text).

    Null or empty text: no words.  Null id: compared with nothing, all words
    stay.  Rows that share an id are never earlier than each other, and each is
    judged on its own text.  Texts of any length are read whole.  Other columns
    of the input are ignored, whatever their names; an empty table gives an
    empty table.  run_limit decides how work is cut, never what is found.
    """
    if not 8 <= window <= 60:
        raise ValueError("window must be 8 to 60 words")
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the mark tells rows apart that share an id
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = _found(rows.where("doc_id is not null and text is not null"), window, run_limit)
    flags = found.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.flatten(F.collect_list("flags")).alias("flags"))
    joined = rows.join(flags, ["doc_id", "mark"], "left").select("doc_id", "text", "flags")
    apply = _applied(window)
    return joined.mapInArrow(lambda batches: apply(batches, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
