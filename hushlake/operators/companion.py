"""Building the companion: tokens and salted proofs of every searchable field."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.crypto import hmac_col
from ..functions.framing import framed_col
from ..functions.keys import Keyring
from ..functions.normalize import normalize_all
from ..plans.model import EXACT, UNSCOPED, Profile, Registration
from ..plans.tokens import ProfileKeys, TextIndex, ValueIndex

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
#: Bytes of text that are indexed at a time: what a worker holds beside its batch is about a hundred times that.
SLICE_BYTES = 1 << 18


def _slices(batch: pa.RecordBatch, texts: list[int]):
    """The batch in parts of at most SLICE_BYTES of text, or of one row."""
    if not texts or not batch.num_rows:
        return [batch] if batch.num_rows else []
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0)).astype(np.int64) for i in texts)
    ends, out, at = np.cumsum(sizes), [], 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, SLICE_BYTES + (ends[at - 1] if at else 0), "right")))
        out.append(batch.slice(at, end - at))
        at = end
    return out


def _index(plan: list[tuple[ProfileKeys, Profile]], schema: pa.Schema):
    """Arrow batches of scope, row id and one column for each profile to batches of a companion.

    The keys stay in the function: as literals of a column they would stand in plans and event logs. Salts are drawn
    here, so it must not be evaluated twice for a row (the companion is written once).
    """
    texts = [2 + i for i, (_, p) in enumerate(plan) if p.mode != EXACT]

    def run(batches):
        own = [ValueIndex(k, p.hardened) if p.mode == EXACT else TextIndex(k, p.normalizer, p.skip_grams, p.hardened) for k, p in plan]
        for part in (x for batch in batches for x in _slices(batch, texts)):
            scopes, columns = part.column(0).to_pylist(), []
            for i, ((_, p), index) in enumerate(zip(plan, own, strict=True)):
                column = part.column(2 + i)
                values, there = column.drop_null().to_pylist(), column.is_valid().to_pylist()
                held = [s for s, x in zip(scopes, there, strict=True) if x]
                if p.mode == EXACT:
                    made = index.exact([v.encode() for v in normalize_all(values, p.normalizer)] if p.kind == "text" else values, held)
                else:
                    made = index.substring(values, held)
                if column.null_count:
                    place = pa.array(np.cumsum(there) - 1, mask=~np.array(there))
                    made = [c.take(place) for c in made]
                columns += made
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), *(c.cast(f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return run


def token_col(keys: ProfileKeys, scope: Column, piece: Column) -> Column:
    """ProfileKeys.token_of() as a column."""
    head = lambda message: F.conv(F.substring(F.hex(hmac_col(keys.token, message, 384)), 1, 8), 16, 10).cast("long")
    high = head(framed_col(["scope"], [scope.cast("binary")]))
    low = head(framed_col(["value"], [scope.cast("binary"), piece])).bitwiseAND(0xFFFFFFFF << (32 - keys.bits) & 0xFFFFFFFF)
    return F.shiftleft(high, 32).bitwiseOR(low)


def proof_key_col(keys: ProfileKeys, scope: Column, piece: Column) -> Column:
    return hmac_col(keys.proof, framed_col([], [scope.cast("binary"), piece]), 256)


def build_postings(companion: DataFrame, registration: Registration) -> DataFrame | None:
    """(token, row_id) for every candidate token of a written companion, in ranges of the token; None if no profile has tokens.

    Ranges go by row as well, so a token that many rows have is spread over several tasks and files.
    Tokens are bound to their profile and scope, so that neither needs a column.
    """
    none = F.array().cast("array<long>")
    tokens = [F.array(c) if p.mode == EXACT else F.coalesce(c, none) for _, p in registration.profiles if not p.hardened for c in [F.col(f"tokens_{p.tag}")]]
    if not tokens:
        return None
    rows = companion.select(F.explode(F.concat(*tokens)).alias("token"), "row_id").where("token is not null")
    return rows.repartitionByRange("token", "row_id").sortWithinPartitions("token", "row_id")


def build_companion(rows: DataFrame, registration: Registration, ring: Keyring) -> DataFrame:
    """scope_id, row_id and the index columns of each row of plain values.

    Null values have null index columns; rows in which all searchable fields are
    null have no companion row.  Index columns are made in Arrow batches, with
    keys that never enter the plan.  The result draws random salts: write it before it is read.
    """
    scope = F.col(registration.scope).cast("string") if registration.scope else F.lit(UNSCOPED)
    plan = [(ProfileKeys.of(ring, p), p) for _, p in registration.profiles]
    columns = []
    for name, p in registration.profiles:
        spec, value = registration.fields[name], F.col(name)
        columns.append(value.cast("string") if spec.kind == "text" else codec.encode_col(spec.kind, value, spec.precision, spec.scale))
    out = rows.select(scope.alias("scope_id"), F.col(registration.row).cast("string").alias("row_id"), *(c.alias(f"__{i}") for i, c in enumerate(columns)))
    if not plan:
        return out.where(F.lit(False))
    some = F.coalesce(*(F.col(f"__{i}").cast("string") for i in range(len(columns)))).isNotNull()
    types = registration.companion_schema()
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in types.items()])
    return out.where(some).mapInArrow(_index(plan, schema), ", ".join(f"`{name}` {kind}" for name, kind in types.items()))
