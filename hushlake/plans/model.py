"""Sealed models: fields, search profiles, registrations and the layout of the companion."""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..errors import ensure
from ..functions import codec
from ..functions.normalize import DEFAULT, DIGITS, KEEP_SPACES

EXACT, SUBSTRING = "exact", "substring"
SUBSTRING_BITS = 16
UNSCOPED = "_"
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z")


def exact_bits_for_population(rows: int) -> int:
    """Bits of an exact token so that a token is shared by about two to four values of a population."""
    ensure(isinstance(rows, int) and rows >= 512)
    return min(32, max(8, math.floor(math.log2(rows)) - 1))


def fnv64(text: str) -> str:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@dataclass(frozen=True)
class Profile:
    """How one field is searched in one mode."""

    model: str
    field: str
    mode: str
    bits: int
    normalizer: str
    skip_grams: bool
    hardened: bool
    kind: str
    parameters: str

    @property
    def tag(self) -> str:
        return fnv64(f"{self.field}/{self.mode}")

    @property
    def descriptor(self) -> list[str]:
        """What token and proof keys are bound to; hardening is not part of it."""
        return [self.field, self.mode, self.kind, self.parameters, self.normalizer, str(self.bits), str(int(self.skip_grams))]

    @property
    def columns(self) -> dict[str, str]:
        """Companion columns and their types."""
        t = self.tag
        if self.mode == EXACT:
            own = {f"tokens_{t}": "long"}
            proof = {f"eq_salt_{t}": "binary", f"eq_stamp_{t}": "long"}
        else:
            own = {f"tokens_{t}": "array<long>"}
            proof = {f"pos_salt_{t}": "binary", f"pos_len_{t}": "int", f"pos_stamps_{t}": "array<long>", f"pos_offsets_{t}": "array<int>"}
        return proof if self.hardened else own | proof


@dataclass(frozen=True)
class Validator:
    """A check of plain values at write time: a function from a column to a Boolean column."""

    id: str
    version: int
    check: Callable[[Any], Any]


def _whole(low: int, high: float = math.inf):
    return lambda x, _: isinstance(x, int) and not isinstance(x, bool) and low <= x <= high


def _option(**parts):
    """True, or a dictionary of options that are each valid."""
    return lambda x, spec: x is True or isinstance(x, dict) and all(k in parts and parts[k](v, spec) for k, v in x.items())


# What each option of a field, and of its search, may be: the types of field it is for, and what it has to fulfil.
_DEFAULTS = {"nullable": False, "precision": 0, "scale": 0}
_FIELD_RULES = {
    "kind": (codec.TYPES, lambda x, _: True),
    "id": (codec.TYPES, lambda x, _: isinstance(x, str) and x != "" and "/" not in x),
    "column": (codec.TYPES, lambda x, _: isinstance(x, str) and x != ""),
    "nullable": (codec.TYPES, lambda x, _: isinstance(x, bool)),
    "precision": (("decimal",), _whole(1, 38)),
    "scale": (("decimal",), lambda x, spec: _whole(0, spec.precision)(x, spec)),
    "max_bytes": (codec.TYPES, _whole(1)),
    "validate": (codec.TYPES, lambda x, _: bool(x.id) and callable(x.check) and _whole(1)(x.version, _)),
    "search": (codec.SEARCHABLE, lambda x, _: isinstance(x, dict)),
    "hardened": (codec.SEARCHABLE, lambda x, spec: x is True and bool(spec.search)),
}
_SEARCH_RULES = {
    EXACT: (codec.SEARCHABLE, _option(bits=_whole(2, 32))),
    SUBSTRING: (("text",), _option(skip_grams=lambda x, _: isinstance(x, bool))),
    "normalizer": (("text",), lambda x, _: x in (DIGITS, KEEP_SPACES)),
    "protection": (codec.SEARCHABLE, lambda x, _: x == "standard"),
}


@dataclass(frozen=True)
class FieldSpec:
    kind: str
    id: str | None = None
    column: str | None = None
    nullable: bool = False
    precision: int = 0
    scale: int = 0
    max_bytes: int | None = None
    validate: Validator | None = None
    search: dict[str, Any] | None = None
    hardened: bool | None = None

    def __post_init__(self):
        given = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        search = dict(self.search or {})
        for options, rules in ((given, _FIELD_RULES), (search, _SEARCH_RULES)):
            for name, value in options.items():
                kinds, valid = rules.get(name, ((), None))
                ensure(value is None or value == _DEFAULTS.get(name, ...) or self.kind in kinds and valid(value, self), "INVALID_SCHEMA")
        ensure(self.kind in codec.TYPES and (self.kind != "decimal" or self.precision > 0), "INVALID_SCHEMA")
        ensure(not search or EXACT in search or SUBSTRING in search, "INVALID_SCHEMA")

    @property
    def parameters(self) -> str:
        return f"{self.precision}:{self.scale}" if self.kind == "decimal" else ""


def _builder(kind: str):
    def build(**options) -> FieldSpec:
        return FieldSpec(kind, **options)

    build.__name__ = kind
    return build


text, integer, bigint, boolean, instant, json, bytes_ = map(_builder, ("text", "integer", "bigint", "boolean", "instant", "json", "bytes"))


def decimal(precision: int, scale: int, **options) -> FieldSpec:
    return FieldSpec("decimal", precision=precision, scale=scale, **options)


@dataclass(frozen=True)
class Registration:
    """A parent table with sealed columns and the companion that it is searched by.

    row is the column with the row's identity (text, or lower-case UUIDs); scope the
    tenant's, if there is one.  Other columns of the parent stay as they are.
    """

    model: str
    row: str
    fields: dict[str, FieldSpec]
    scope: str | None = None
    row_type: str = "text"
    scope_type: str = "text"
    plain: tuple[str, ...] = ()
    unique_row: bool = True
    _profiles: dict[tuple[str, str], Profile] = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        ok = lambda x: ensure(x, "INVALID_SCHEMA")
        ok(self.model and "/" not in self.model and self.fields)
        ok(self.row_type in ("text", "uuid") and self.scope_type in ("text", "uuid"))
        ids = [self.field_id(n) for n in self.fields]
        ok(len(set(ids)) == len(ids) and all("/" not in i for i in ids))
        names = [self.row, *([self.scope] if self.scope else []), *self.plain, *map(self.column, self.fields)]
        ok(len(set(names)) == len(names))
        for name, spec in self.fields.items():
            search = spec.search or {}
            for mode in (EXACT, SUBSTRING):
                if mode in search:
                    option = search[mode] if isinstance(search[mode], dict) else {}
                    bits = option.get("bits", 16) if mode == EXACT else SUBSTRING_BITS
                    self._profiles[name, mode] = Profile(self.model, self.field_id(name), mode, bits, search.get("normalizer", DEFAULT), option.get("skip_grams", True) if mode == SUBSTRING else False, bool(spec.hardened), spec.kind, spec.parameters)

    def field_id(self, name: str) -> str:
        return self.fields[name].id or name

    def column(self, name: str) -> str:
        return self.fields[name].column or f"{name}_ct"

    def profile(self, name: str, mode: str) -> Profile:
        ensure(name in self.fields and (name, mode) in self._profiles, "UNSUPPORTED_SEARCH")
        return self._profiles[name, mode]

    @property
    def profiles(self) -> list[tuple[str, Profile]]:
        return [(name, p) for (name, _), p in self._profiles.items()]

    @property
    def keys(self) -> list[str]:
        """Columns that identify a row in the parent."""
        return [*([self.scope] if self.scope else []), self.row]

    def scope_value(self, requested: str | None) -> str:
        """The companion's scope for a request; required by scoped models, forbidden by others."""
        ensure((requested is None) == (self.scope is None))
        return UNSCOPED if self.scope is None else identity(requested, self.scope_type)

    def companion_schema(self) -> dict[str, str]:
        out = {"scope_id": "string", "row_id": "string"}
        for _, p in self.profiles:
            out |= p.columns
        return out


def identity(value, kind: str) -> str:
    ensure(isinstance(value, str) and value != "" and "\0" not in value, "INVALID_ID")
    ensure(kind == "text" or _UUID.match(value), "INVALID_ID")
    return value


UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
