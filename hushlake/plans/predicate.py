"""Encrypted predicates: the builder, the checked tree, and its compilation to one column over the companion."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SealError, ensure
from ..functions import codec
from ..functions.framing import u32
from ..functions.keys import Keyring
from ..functions.normalize import compact
from .model import EXACT, SUBSTRING, Profile, Registration
from .tokens import ProfileKeys, exact_bytes, pieces

MOST_TOKENS = 3


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Group:
    op: str  # and, or
    children: tuple


@dataclass(frozen=True)
class Plain:
    """An ordinary condition on the parent."""

    condition: Column

    def __hash__(self):
        return id(self)


Node = Leaf | Group | Plain


class _Field:
    def __init__(self, registration: Registration, name: str):
        self._registration, self._name = registration, name

    def _leaf(self, op: str, mode: str, value) -> Leaf:
        self._registration.profile(self._name, mode)
        return Leaf(self._name, op, value)

    def eq(self, value) -> Leaf:
        return self._leaf("eq", EXACT, value)

    def contains(self, text: str) -> Leaf:
        return self._leaf("contains", SUBSTRING, text)

    def starts_with(self, text: str) -> Leaf:
        return self._leaf("starts_with", SUBSTRING, text)

    def ends_with(self, text: str) -> Leaf:
        return self._leaf("ends_with", SUBSTRING, text)

    def like(self, pattern: str) -> Leaf:
        return self._leaf("like", SUBSTRING, pattern)

    def __getattr__(self, name: str):
        # order, negation and the like are not offered on sealed values
        raise SealError("UNSUPPORTED_SEARCH", self._name)


class Match:
    """m.<field>.eq / contains / starts_with / ends_with / like, m.and_, m.or_ and m.sql."""

    def __init__(self, registration: Registration):
        self._registration = registration

    def __getattr__(self, name: str) -> _Field:
        ensure(name in self._registration.fields, "UNSUPPORTED_SEARCH", name)
        return _Field(self._registration, name)

    def __getitem__(self, name: str) -> _Field:
        return self.__getattr__(name)

    def and_(self, *children: Node) -> Group:
        return Group("and", tuple(children))

    def or_(self, *children: Node) -> Group:
        return Group("or", tuple(children))

    def sql(self, condition: Column) -> Plain:
        return Plain(condition)

    def not_(self, *_):
        raise SealError("UNSUPPORTED_SEARCH")


def validate(node: Node, registration: Registration) -> None:
    if isinstance(node, Group):
        ensure(node.op in ("and", "or") and node.children)
        for child in node.children:
            validate(child, registration)
    elif isinstance(node, Leaf):
        ensure(node.op in ("eq", "contains", "starts_with", "ends_with", "like"))
        registration.profile(node.field, EXACT if node.op == "eq" else SUBSTRING)
    else:
        ensure(isinstance(node, Plain))


def secure(node: Node) -> bool:
    """Nothing in it needs the parent."""
    return isinstance(node, Leaf) or isinstance(node, Group) and all(map(secure, node.children))


def fingerprint(node: Node | None):
    """Plain values that differ between different trees; binds cursors to their query."""
    if node is None:
        return None
    if isinstance(node, Leaf):
        return {"op": node.op, "field": node.field, "value": node.value}
    if isinstance(node, Group):
        return {"op": node.op, "children": [fingerprint(c) for c in node.children]}
    return {"op": "sql", "condition": str(node.condition._jc)}


# LIKE patterns ---------------------------------------------------------------


@dataclass(frozen=True)
class Chunk:
    """What stands between two % signs: literals at fixed places, and the width of all of it."""

    literals: tuple[tuple[int, str], ...]
    width: int


@dataclass(frozen=True)
class Pattern:
    chunks: tuple[Chunk, ...]
    open_start: bool
    open_end: bool

    @property
    def least(self) -> int:
        return sum(c.width for c in self.chunks)


def parse_like(pattern: str, normalizer: str) -> Pattern:
    r"""% and _ with the escapes \% \_ \; literals are compacted and need two characters each."""
    ensure(isinstance(pattern, str))
    parts: list[str] = []  # "%", "_" or "=" and a literal
    run, chars = "", iter(pattern)
    for c in chars:
        if c == "\\":
            c = next(chars, "")
            ensure(c in ("%", "_", "\\") and c)
            run += c
        elif c in "%_":
            parts += [f"={run}", c] if run else [c]
            run = ""
        else:
            run += c
    parts += [f"={run}"] if run else []
    parts = [f"={compact(p[1:], normalizer)}" if p[0] == "=" else p for p in parts]
    parts = [p for p in parts if p != "="]
    literals = [p[1:] for p in parts if p[0] == "="]
    ensure(literals and all(len(x) >= 2 for x in literals), "QUERY_TOO_BROAD")
    chunks = []
    for percent, group in itertools.groupby(parts, lambda p: p == "%"):
        if not percent:
            at, found = 0, []
            for p in group:
                if p == "_":
                    at += 1
                else:
                    found.append((at, p[1:]))
                    at += len(p) - 1
            chunks.append(Chunk(tuple(found), at))
    return Pattern(tuple(chunks), parts[0] == "%", parts[-1] == "%")


def _pattern(leaf: Leaf, normalizer: str) -> Pattern:
    if leaf.op == "like":
        return parse_like(leaf.value, normalizer)
    ensure(isinstance(leaf.value, str))
    text = compact(leaf.value, normalizer)
    ensure(len(text) >= 2, "QUERY_TOO_BROAD")
    return Pattern((Chunk(((0, text),), len(text)),), leaf.op != "starts_with", leaf.op != "ends_with")


def windows(text: str) -> list[tuple[int, str]]:
    """Pairs at even places and the last pair: they cover the text."""
    at = [*range(0, len(text) - 1, 2)]
    if at[-1] != len(text) - 2:
        at.append(len(text) - 2)
    return [(i, text[i : i + 2]) for i in at]


# Compilation -----------------------------------------------------------------


def pick_tokens(tokens: list[int]) -> list[int]:
    """At most three of the tokens (first, middle and last by value): more hardly exclude more rows."""
    tokens = sorted(set(tokens))
    return tokens if len(tokens) <= MOST_TOKENS else [tokens[0], tokens[len(tokens) // 2], tokens[-1]]


class Compiler:
    """Compiles the trees of one registration and scope; only derived keys of the terms enter the plan.

    An encrypted tree becomes one SQL expression, which the driver hands over in a single call.
    """

    def __init__(self, registration: Registration, ring: Keyring, scope: str, prefix: str = ""):
        self.registration, self.ring, self.scope, self.prefix = registration, ring, scope, prefix

    def column(self, node: Node) -> Column:
        """A condition on a companion (joined to its parent where the tree has plain conditions)."""
        if isinstance(node, Plain):
            return node.condition
        if secure(node):
            return F.expr(self.sql(node))
        return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), map(self.column, node.children))

    def sql(self, node: Node) -> str:
        """The text of a purely encrypted tree."""
        if isinstance(node, Group):
            return "(" + f" {node.op} ".join(map(self.sql, node.children)) + ")"
        return self._exact(node) if node.op == "eq" else self._substring(node)

    def _col(self, name: str) -> str:
        return f"`{self.prefix}{name}`"

    def _exact_raw(self, leaf: Leaf) -> bytes:
        p, spec = self.registration.profile(leaf.field, EXACT), self.registration.fields[leaf.field]
        if spec.kind == "text":
            ensure(isinstance(leaf.value, str))
            return exact_bytes(p, leaf.value)
        return codec.encode(spec.kind, leaf.value, spec.precision, spec.scale)

    def clauses(self, node: Node) -> list[set[int]] | None:
        """Token sets by which postings find candidates: a matching row has all tokens of one of the sets. None where no index can help."""
        if isinstance(node, Plain):
            return None
        if isinstance(node, Group):
            parts = [self.clauses(c) for c in node.children]
            if node.op == "or":
                return None if None in parts else [c for p in parts for c in p]
            single = [p[0] for p in parts if p is not None and len(p) == 1]
            return [set().union(*single)] if single else min((p for p in parts if p is not None), key=len, default=None)
        p = self.registration.profile(node.field, EXACT if node.op == "eq" else SUBSTRING)
        if p.hardened:
            return None
        tokens = {ProfileKeys.of(self.ring, p).token_of(self.scope, self._exact_raw(node))} if node.op == "eq" else set(pick_tokens(self.tokens(node)))
        return [tokens] if tokens else None

    def _exact(self, leaf: Leaf) -> str:
        p, raw = self.registration.profile(leaf.field, EXACT), self._exact_raw(leaf)
        keys = ProfileKeys.of(self.ring, p)
        proof = f"{self._col(f'eq_stamp_{p.tag}')} = {_stamp(keys.proof_of(self.scope, raw), self._col(f'eq_salt_{p.tag}'))}"
        return f"({proof})" if p.hardened else f"({self._col(f'tokens_{p.tag}')} = {_long(keys.token_of(self.scope, raw))} and {proof})"

    def tokens(self, leaf: Leaf) -> list[int]:
        """The candidate tokens of a substring leaf."""
        p = self.registration.profile(leaf.field, SUBSTRING)
        pattern, keys = _pattern(leaf, p.normalizer), ProfileKeys.of(self.ring, p)
        single = len(pattern.chunks) == 1 and len(pattern.chunks[0].literals) == 1 and pattern.chunks[0].width == len(pattern.chunks[0].literals[0][1])
        start = single and not pattern.open_start
        end = single and not pattern.open_end and pattern.open_start
        found = {x for c in pattern.chunks for _, text in c.literals for x in pieces(text, p.skip_grams, start, end)}
        return [keys.token_of(self.scope, x) for x in found]

    def _substring(self, leaf: Leaf) -> str:
        p = self.registration.profile(leaf.field, SUBSTRING)
        pattern, keys = _pattern(leaf, p.normalizer), ProfileKeys.of(self.ring, p)
        grams = list(dict.fromkeys(g for c in pattern.chunks for _, text in c.literals for _, g in windows(text)))
        value = _Value({g: keys.proof_of(self.scope, g.encode()) for g in grams}, *(self._col(f"pos_{x}_{p.tag}") for x in ("salt", "len", "stamps", "offsets")))
        whole = len(pattern.chunks) == 1 and not pattern.open_start and not pattern.open_end
        terms = [f"{value.n} {'=' if whole else '>='} {pattern.least}"]
        if not p.hardened:
            terms += [f"array_contains({self._col(f'tokens_{p.tag}')}, {_long(x)})" for x in pick_tokens(self.tokens(leaf))]
        # each pair must occur at least once: one hash and one look-up for each
        terms += [value.has(g, 1) for g in grams]
        if pattern.least > 2 or len(grams) > 1 or not (pattern.open_start and pattern.open_end):
            # mostly no pair occurs twice: then there is one place to look at, and compiled code does it
            again = " or ".join(value.has(g, 2) for g in grams)
            terms.append(f"case when {again} then {_placed(pattern, value)} else {_placed_once(pattern, value)} end")
        return "(" + " and ".join(terms) + ")"


def _long(x: int) -> str:
    return f"{x}L" if x >= 0 else f"cast('{x}' as bigint)"


def _stamp(key: bytes, salt: str, ordinal: int | None = None) -> str:
    """stamp_col() as text."""
    tail = "" if ordinal is None else f", X'{u32(ordinal).hex()}'"
    return f"cast(conv(substring(sha2(concat(X'{key.hex()}', {salt}{tail}), 256), 1, 16), 16, -10) as bigint)"


@dataclass(frozen=True)
class _Value:
    """The position proof of a stored value, and the keys of the pairs that a pattern asks for."""

    proof: dict[str, bytes]
    salt: str
    n: str
    stamps: str
    offsets: str

    def has(self, gram: str, ordinal: int) -> str:
        return f"array_contains({self.stamps}, {_stamp(self.proof[gram], self.salt, ordinal)})"

    def first(self, gram: str) -> str:
        return f"get({self.offsets}, cast(array_position({self.stamps}, {_stamp(self.proof[gram], self.salt, 1)}) as int) - 1)"

    def everywhere(self) -> str:
        """For each pair, the offsets of its first, second, ... occurrence, until one is missing."""
        keys = ", ".join(f"X'{k.hex()}'" for k in self.proof.values())
        stamp = f"cast(conv(substring(sha2(concat(key, {self.salt}, unhex(lpad(hex(acc.next), 8, '0'))), 256), 1, 16), 16, -10) as bigint)"
        found = f"named_struct('next', acc.next + 1, 'found', array_append(acc.found, get({self.offsets}, cast(at as int) - 1)), 'more', true)"
        none = "named_struct('next', acc.next, 'found', acc.found, 'more', false)"
        step = f"if(acc.more, {_let('at', f'array_position({self.stamps}, {stamp})', f'if(at > 0, {found}, {none})')}, acc)"
        start = "named_struct('next', 1, 'found', cast(array() as array<int>), 'more', true)"
        return f"transform(array({keys}), key -> aggregate(sequence(1, greatest({self.n} - 1, 1)), {start}, (acc, i) -> {step}, acc -> acc.found))"


def _let(name: str, value: str, body: str) -> str:
    """The body with the value under a name, computed once for the row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _placed_once(pattern: Pattern, value: _Value) -> str:
    """_placed() for values in which each pair of the pattern occurs once."""
    terms, end, seen = ["true"], "0", set()
    last = len(pattern.chunks) - 1
    for k, chunk in enumerate(pattern.chunks):
        at_start, at_end = k == 0 and not pattern.open_start, k == last and not pattern.open_end
        pairs = [(place + i, g) for place, text in chunk.literals for i, g in windows(text)]
        if any(g in seen for _, g in pairs) or len({g for _, g in pairs}) < len(pairs):
            return "false"  # a pair that the pattern has at two places
        seen.update(g for _, g in pairs)
        if pairs:
            start = f"({value.first(pairs[0][1])} - {pairs[0][0]})"
            if len(pairs) > 1:
                terms.append("size(array_distinct(array(" + ", ".join(f"{value.first(g)} - {place}" for place, g in pairs) + "))) = 1")
            if at_start or k or pairs[0][0]:
                terms.append(f"{start} = 0" if at_start else f"{start} >= {end}")
            if at_end or pairs[-1][0] + 2 < chunk.width:
                terms.append(f"{start} + {chunk.width} {'=' if at_end else '<='} {value.n}")
            end = f"({start} + {chunk.width})"
        else:
            end = f"({end} + {chunk.width})"
            terms.append(f"{end} {'=' if at_start and at_end else '<='} {value.n}")
    return " and ".join(terms)


def _placed(pattern: Pattern, value: _Value) -> str:
    """Whether the chunks stand in order, each at its place; leftmost places are tried, which is exact for % patterns."""
    grams = list(value.proof)
    last, n = len(pattern.chunks) - 1, value.n

    def starts(chunk: Chunk) -> str:
        """Places at which all pairs of the chunk's literals agree."""
        (first, g0), *rest = [(at + i, g) for at, text in chunk.literals for i, g in windows(text)]
        ok = [f"o >= {first}", f"o - {first} + {chunk.width} <= {n}", *(f"array_contains(found[{grams.index(g)}], o - {first} + {i})" for i, g in rest)]
        return f"transform(filter(found[{grams.index(g0)}], o -> {' and '.join(ok)}), o -> o - {first})"

    def place(k: int, end: str) -> str:
        """Whether chunks from the k-th on fit at or after `end`."""
        if k > last:
            return "true"
        chunk = pattern.chunks[k]
        at_start, at_end = k == 0 and not pattern.open_start, k == last and not pattern.open_end
        fixed = f"({n} - {chunk.width})" if at_end else "0" if at_start else end
        if chunk.literals and not at_start and not at_end:
            here = f"s{k}"
            return _let(here, f"array_min(filter({starts(chunk)}, o -> o >= {end}))", f"({here} is not null and {place(k + 1, f'({here} + {chunk.width})')})")
        fits = [f"{fixed} >= {end}", f"array_contains({starts(chunk)}, {fixed})" if chunk.literals else f"{fixed} + {chunk.width} <= {n}"]
        if at_start and at_end:
            fits.append(f"{n} = {chunk.width}")
        return "(" + " and ".join([*fits, place(k + 1, f"({fixed} + {chunk.width})")]) + ")"

    return _let("found", value.everywhere(), place(0, "0"))
