"""Quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning: a logistic model g minimises the non-negative
unbiased risk

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

where p are trusted positives (rows that the training labels call good), u are
web texts whose labels are not looked at, and pi is the class prior, estimated
as the share of good rows among all training labels.

Features are taken from the bytes of the whole text: the square roots of the
frequencies of hashed byte pairs, and a few shape figures (share of capitals,
of punctuation, of repeated lines, words and word triples).  Labels,
language, source and id are never inputs.

Scale: the model is fitted on the driver from at most `positives` and
`unlabelled` rows, the first by hash of the id (a documented, fixed bound);
priors are counted over all labels and every text is scored in one pass, without
a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACE, Texts, U64, Words, by_row, chunks, mix
from .scratch import small_batches

PAIRS = 2048
SHAPES = 15
ROWS = 256  # texts that are held as dense rows at a time

#: Most rows to fit on; see fit().
POSITIVES, UNLABELLED = 3000, 5000
THRESHOLD = 0.3
#: Share of trusted positives that may fall below the threshold.
LOST = 0.005

_SLOT = (mix(np.arange(1 << 16, dtype=U64)) % U64(PAIRS)).astype(np.int64)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """How many different values each row has."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return np.bincount(row[new], minlength=rows)


def _features(texts: Texts) -> np.ndarray:
    data, offsets, n = texts.data, texts.offsets, len(texts)
    size = np.diff(offsets)
    out = np.zeros((n, PAIRS + SHAPES), dtype=np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(n), size)
    pair = _SLOT[(data[:-1].astype(np.int64) << 8) | data[1:]]
    same = row[1:] == row[:-1]
    counts = np.bincount(row[1:][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
    # short texts say little: their frequencies shrink towards zero
    out[:, :PAIRS] = np.sqrt(counts / (size + 100)[:, None])
    words, lines = Words(texts, SPACE), Words(texts, _NEWLINE)
    some = size + 30
    share = [by_row(table[data], offsets) / some for table in (_UPPER, _PUNCT, _DIGIT, _NEWLINE)]
    n_words, n_lines = np.maximum(1, words.counts), np.maximum(1, lines.counts)
    at = words.window_starts(3)
    threes = np.bincount(words.row[at], minlength=n)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    alone = (words.ends - words.starts == 1) & _PUNCT[data[words.starts]]
    share += [1 - _distinct(lines.row, lines.hash, n) / n_lines]
    odd = [1 - _distinct(words.row[at], words.span(at, 3), n) / np.maximum(1, threes), by_row(again, words.first) / n_words, by_row(alone, words.first) / n_words, by_row(_PUNCT[data], offsets) / some, by_row(_UPPER[data], offsets) / some]
    share += [x for o in odd for x in (np.sqrt(np.maximum(0, o)), np.minimum(1, 8 * o))]
    out[:, PAIRS:] = np.stack(share, axis=1)
    return out


def features(column) -> Iterator[np.ndarray]:
    """Feature rows of an Arrow string column, in blocks, in order."""
    for texts in chunks(column):
        for lo in range(0, len(texts), ROWS):
            hi = min(len(texts), lo + ROWS)
            a, b = texts.offsets[lo], texts.offsets[hi]
            yield _features(Texts(texts.data[a:b], texts.offsets[lo : hi + 1] - a))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, column) -> np.ndarray:
        parts = [x @ self.weights + self.bias for x in features(column)]
        return _sigmoid(np.concatenate([np.zeros(0), *parts]).astype(np.float64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.01, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the inputs as scaled (in place), the scale, and the bias. Adam on the non-negative risk with the logistic loss; where the negative part falls below zero, only that part is stepped back."""
    scale = np.sqrt(np.mean(unlabelled.astype(np.float64) ** 2, axis=0)).astype(np.float32) + np.float32(0.01)
    p, u = positive, unlabelled
    p /= scale
    u /= scale
    w, b = np.zeros(p.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        plus, minus, other = -prior * _sigmoid(-gp) / len(p), -prior * _sigmoid(gp) / len(p), _sigmoid(gu) / len(u)
        dp, du = (plus + minus, other) if negative >= 0 else (-minus, -other)
        dp, du = dp.astype(np.float32), du.astype(np.float32)
        grad = np.append(p.T @ dp + u.T @ du + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = (w - step[:-1]).astype(np.float32)
        b -= step[-1]
    return w, scale, float(b)


def held_out(id_col: str):
    """crc32 of the id as text is a multiple of five; never true for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, threshold: float = THRESHOLD) -> Model:
    """Learn from the labels of rows that are not held out.

    An id with several labels counts as good only if all say so; null labels
    and ids are ignored.  Without any good label the model gives everyone its prior.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & ~held_out("id"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y")).where(~held_out("id"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")).first()
    prior = min(0.98, max(0.02, (counts["good"] + 1) / (counts["n"] + 2)))
    by_hash = [F.xxhash64("id", F.lit(5)), F.col("id")]
    # ids first: the texts of at most positives + unlabelled ids are then looked up
    good = known.where("y = 1").join(rows.select("id").distinct(), "id", "left_semi").orderBy(*by_hash).limit(positives).select("id", F.lit(True).alias("good"))
    any_ = rows.select("id").distinct().orderBy(*by_hash).limit(unlabelled).select("id", F.lit(False).alias("good"))
    picked = F.broadcast(good.unionByName(any_))

    def rows_of(batches):
        for batch in batches:
            x = np.concatenate([np.zeros((0, PAIRS + SHAPES), np.float32), *features(batch.column(1))]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], names=["good", "x", "id"])

    # an id that repeats counts once, with one of its texts
    one_each = rows.join(picked, "id").groupBy("good", "id").agg(F.max("text").alias("text")).select("good", "text", "id")
    table = one_each.mapInArrow(rows_of, "good boolean, x binary, id long").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    mask = table["good"].to_numpy(zero_copy_only=False).astype(bool) if table.num_rows else np.zeros(0, bool)
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(-1, PAIRS + SHAPES)
    p, u = x[mask].astype(np.float32), x[~mask].astype(np.float32)
    if not len(p) or not len(u):
        return Model(np.zeros(PAIRS + SHAPES, np.float32), float(np.log(prior / (1 - prior))), prior)
    del table, x, mask
    w, scale, b = minimise(p, u, prior)
    # the threshold sits where the prior says it should: that share of unlabelled text is at or above it, and nearly all trusted positives
    at = min(np.quantile(u @ w + b, 1 - prior), np.quantile(p @ w + b, LOST))
    return Model((w / scale).astype(np.float32), float(b - at + np.log(threshold / (1 - threshold))), prior)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows with a column more; null text is scored as empty."""
    small_batches(docs)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))

    return docs.withColumn(out, score(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) for every row.

    Null and empty texts are scored like any other (their features are zero);
    a null id is not held out and takes no part in learning; repeated rows get
    the same score; other columns are ignored, whatever their names; an empty
    table gives an empty table.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, threshold=threshold, **bounds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = scored(rows, model).withColumn("held_out", held_out("doc_id"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
