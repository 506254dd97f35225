"""Benchmark decontamination: exact windows of benchmark items inside documents.

Prefix-filtered set join.  Every window of an item is a set of word shingles.
Shingles are ordered by rarity, counted over all documents; since the whole
window must occur, the prefix that a document has to share with it is the one
rarest shingle.  Documents are read against these prefix shingles; a hit
proposes one place for the window, the length and positional bounds say
whether it fits inside the document there, and what is left is compared word by
word, byte for byte, over a stretch as long as the item's window.

Scale: documents are read twice, however large the benchmark is, and never
shuffled.  The first scan counts shingles: a bitmap of all shingles of the
benchmark (at most MOST_BITS) keeps those that may be in it, their counts are
combined before the shuffle and joined with the exact shingles.  In the second
scan the benchmark travels to the documents: it is cut
into blocks of a bounded number of bytes by hash of the item, each block is
broadcast by itself and the documents stream past one block after the other in
the same stage, so the driver never holds more than
`block_bytes` of benchmark text, however large the benchmark is.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import NOT_ALNUM, Texts, Words, chunks, covered
from .scratch import cut, small_batches

BLOCK_BYTES = 8 << 20
_SLOTS = 1 << 20
#: Bits of the bitmap of the benchmark's shingles, at least and at most; a full one only lets more shingles through to the join.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


@dataclass
class _Block:
    """Windows of some items: `key` and `size` in words, their text, their items, and their prefix shingles."""

    seen: np.ndarray  # slots that the prefix shingles fall into
    size: np.ndarray
    key: np.ndarray
    text: list[bytes]
    items: list[list[int]]
    shingle: np.ndarray  # prefix shingles, sorted, one for each window
    offset: np.ndarray  # of that shingle in its window
    window: np.ndarray


def _known(values: np.ndarray, sorted_: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Indices of the values that are in sorted_."""
    maybe = np.flatnonzero(seen[(values & np.uint64(_SLOTS - 1)).astype(np.int64)])
    at = np.searchsorted(sorted_, values[maybe])
    at[at == len(sorted_)] = 0
    return maybe[sorted_[at] == values[maybe]]


def _slots(values: np.ndarray) -> np.ndarray:
    seen = np.zeros(_SLOTS, dtype=bool)
    seen[(values & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    return seen


def _windows(items: list[tuple[int, str]], window: int):
    """The distinct windows of the items: (text, size, shingle hashes) and the items of each."""
    by_text: dict[bytes, list] = {}
    for item, text in items:
        words = Words(Texts.of([text]), NOT_ALNUM, fold=True)
        n = len(words)
        if not n:
            continue
        size = min(window, n)
        q = min(3, size)
        grams = words.span(np.arange(n - q + 1), q)
        whole = words.span(np.arange(n - size + 1), size)
        raw = [words.texts.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
        for i in range(n - size + 1):
            found = by_text.setdefault(b" ".join(raw[i : i + size]), [size, whole[i], grams[i : i + size - q + 1], []])
            if not found[3] or found[3][-1] != item:
                found[3].append(item)
    return by_text


def _shingles(by_text) -> tuple[np.ndarray, list[int]]:
    """All shingles of the windows, sorted, and their lengths in words."""
    grams = [np.zeros(0, np.uint64), *(found[2] for found in by_text.values())]
    return np.unique(np.concatenate(grams)), sorted({min(3, found[0]) for found in by_text.values()})


def _block(by_text, counts: dict[int, int]) -> _Block:
    text = list(by_text)
    found = [by_text[t] for t in text]
    shingle, offset = [], []
    for _, _, grams, _ in found:
        rank = [(counts.get(int(g), 0), int(g)) for g in grams]
        k = rank.index(min(rank))
        shingle.append(grams[k])
        offset.append(k)
    shingle = np.array(shingle, dtype=np.uint64)
    order = np.argsort(shingle, kind="stable")
    return _Block(_slots(shingle), np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.uint64), text, [f[3] for f in found], shingle[order], np.array(offset, np.int64)[order], order)


def _lengths(block: _Block) -> list[int]:
    """Shingle lengths in use: three words, fewer for items of one or two."""
    return sorted({min(3, int(s)) for s in np.unique(block.size)})


def _bit(values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of the bitmap that each value falls into."""
    slot = values & np.uint64(8 * len(bits) - 1)
    return (slot >> np.uint64(3)).astype(np.int64), np.left_shift(1, (slot & np.uint64(7)).astype(np.uint8), dtype=np.uint8)


def _count(shared):
    """Occurrences in the documents of shingles that may be the benchmark's, batch by batch."""
    schema = pa.schema([("g", pa.int64()), ("n", pa.int64())])

    def run(batches):
        bits, lengths = shared.value
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for texts in chunks(batch.column(0)):
                words = Words(texts, NOT_ALNUM, fold=True)
                for q in lengths:
                    grams = words.span(words.window_starts(q), q)
                    byte, bit = _bit(grams, bits)
                    found.append(grams[bits[byte] & bit != 0])
            g, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return run


def _dealt(items: DataFrame, blocks: int, window: int):
    """The windows of the items of each block, one block at a time."""
    rows = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).orderBy("block", "item", "text")
    for _, some in itertools.groupby(rows.toLocalIterator(), key=lambda r: r["block"]):
        by_text = _windows([(r["item"], r["text"]) for r in some], window)
        if by_text:
            yield by_text


def _occurrences(words: Words, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Word index and window of each occurrence."""
    starts, windows = [], []
    for q in _lengths(block):
        at = words.window_starts(q)
        grams = words.span(at, q)
        hit = _known(grams, block.shingle, block.seen)
        lo, hi = np.searchsorted(block.shingle, grams[hit]), np.searchsorted(block.shingle, grams[hit], side="right")
        n = hi - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        start = np.repeat(at[hit], n) - block.offset[entry]
        window = block.window[entry]
        row = words.row[np.repeat(at[hit], n)]
        fits = (start >= words.first[row]) & (start + block.size[window] <= words.first[row + 1]) & (np.minimum(block.size[window], 3) == q)
        start, window = start[fits], window[fits]
        same = words.span(start, block.size[window]) == block.key[window]
        starts.append(start[same])
        windows.append(window[same])
    start, window = np.concatenate(starts), np.concatenate(windows)
    if not len(start):
        return start, window
    # Word for word: each row's words joined by one space, sliced by their places in it.
    joined = words.joined()
    length = words.ends - words.starts + 1
    place = np.cumsum(length) - length
    row = words.row[start]
    base = joined.offsets[row] + place[start] - place[words.first[row]]
    size = np.array([len(t) for t in block.text], dtype=np.int64)[window]
    data = joined.data.tobytes()
    exact = np.fromiter((data[b : b + s] == block.text[w] for b, s, w in zip(base.tolist(), size.tolist(), window.tolist(), strict=True)), bool, len(start))
    return start[exact], window[exact]


def _pass(block: _Block):
    """Add what this block hits to the rows' runs of hit words and to their items."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            runs = batch.schema.field("hits").type
            ids, text = names.index("items"), names.index("text")
            for texts in chunks(batch.column(text)):
                words = Words(texts, NOT_ALNUM, fold=True)
                start, window = _occurrences(words, block)
                part = batch.slice(texts.lo, len(texts))
                if len(start):
                    hits = part.column(names.index("hits")).to_pylist()
                    items = part.column(ids).to_pylist()
                    gone = covered(len(words), start, block.size[window])
                    edge = gone & ~np.concatenate([[False], gone[:-1] & (words.row[1:] == words.row[:-1])])
                    stop = gone & ~np.concatenate([gone[1:] & (words.row[1:] == words.row[:-1]), [False]])
                    first, last = np.flatnonzero(edge), np.flatnonzero(stop)
                    row = words.row[first]
                    for r, a, b in zip(row.tolist(), (first - words.first[row]).tolist(), (last - words.first[row] + 1).tolist(), strict=True):
                        hits[r] += [a, b]
                    pairs = np.unique(np.stack([words.row[start], window]), axis=1)
                    for r, w in pairs.T.tolist():
                        items[r] += block.items[w]
                    columns = part.columns
                    columns[names.index("hits")] = pa.array(hits, runs)
                    columns[ids] = pa.array([list(dict.fromkeys(x)) for x in items], batch.schema.field("items").type)
                    part = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield part

    return run


def _digest(with_rows: bool):
    """n_words, n_hit, n_items, items_sha256 and contaminated in place of the runs."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            column = lambda name: batch.column(names.index(name))
            hits, items = column("hits").to_pylist(), column("items").to_pylist()
            n_words = np.concatenate([np.zeros(0, np.int64), *(Words(t, NOT_ALNUM, fold=True).counts for t in chunks(column("text")))]).astype(np.int64)
            n_hit, digests = [], []
            for runs, found in zip(hits, items, strict=True):
                n, end = 0, 0
                for a, b in sorted(zip(runs[::2], runs[1::2], strict=True)):
                    n += max(0, b - max(a, end))
                    end = max(end, b)
                n_hit.append(n)
                digests.append(hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
            out = [column("doc_id"), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), column("items")]
            rest = ["text", "rest"] if with_rows else []
            yield pa.RecordBatch.from_arrays([*out, *map(column, rest)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *rest])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, with_rows: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark documents that hold `window` consecutive words of a benchmark item (all words of a shorter item).

    Words are runs of 0-9, a-z (A-Z are lower-cased) and all characters from
    U+0080.  One row for each input row: doc_id, n_words, n_hit (words inside
    any occurrence of a window), n_items, items_sha256 (of the item ids, sorted
    as strings and joined by commas), contaminated and items (the ids);
    if with_rows also text and `rest`, a struct of the row's other columns,
    however they are named.

    Null or empty text, in a document or an item, has no words; an item with a
    null id counts for nothing; item ids may repeat and then count once; rows
    that repeat stay and are judged each by itself.  An empty benchmark hits
    nothing, an empty table of documents gives an empty table.
    """
    small_batches(docs)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_bytes))
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if with_rows else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*rest).alias("rest")] if rest else []), F.array().cast("array<long>").alias("hits"), F.array().cast("array<long>").alias("items"))
    bits, lengths = np.zeros(min(MOST_BITS, max(LEAST_BITS, 1 << (4 * total).bit_length())) // 8, np.uint8), set()
    for by_text in _dealt(items, blocks, window):
        grams, used = _shingles(by_text)
        np.bitwise_or.at(bits, *_bit(grams, bits))
        lengths.update(used)
    if lengths:
        shared = spark.sparkContext.broadcast((bits, sorted(lengths)))
        counted = cut(texts.mapInArrow(_count(shared), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")))
        for by_text in _dealt(items, blocks, window):
            exact = spark.createDataFrame(pa.table({"g": _shingles(by_text)[0].view(np.int64)}))
            counts = {r["g"] % (1 << 64): r["n"] for r in counted.join(F.broadcast(exact), "g").toLocalIterator()}
            shared = spark.sparkContext.broadcast(_block(by_text, counts))
            rows = rows.mapInArrow(lambda batches, shared=shared: _pass(shared.value)(batches), rows.schema)
    schema = T.StructType([rows.schema["doc_id"]]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("items", T.ArrayType(T.LongType()))
    for name in ("text", "rest") if with_rows else ():
        schema = schema.add(rows.schema[name])
    return rows.mapInArrow(_digest(with_rows), schema)
