"""The query as immutable values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    """Absolute time range in nanoseconds, both ends included."""

    start: int
    end: int


@dataclass(frozen=True)
class Last:
    """Sliding range that ends now."""

    ns: int


@dataclass(frozen=True)
class Scan:
    signal: str
    time: Span | Last
    lookup: str | None = None


@dataclass(frozen=True)
class Literal:
    """kind: null, bool, int, float, string, or name (a status, span kind or severity)."""

    value: object
    kind: str


@dataclass(frozen=True)
class Field:
    """scope: "", attr, resource or scope."""

    scope: str
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


Expr = Literal | Field | Binary | Call


@dataclass(frozen=True)
class And:
    parts: tuple[Pred, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Pred, ...]


@dataclass(frozen=True)
class Not:
    part: Pred


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Exists:
    field: Field
    negated: bool = False


@dataclass(frozen=True)
class Match:
    """kind: contains, starts_with, ends_with or matches."""

    kind: str
    field: Field
    text: str


@dataclass(frozen=True)
class In:
    field: Field
    values: tuple[Literal, ...]


Pred = And | Or | Not | Compare | Exists | Match | In


@dataclass(frozen=True)
class Where:
    pred: Pred


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Field, str], ...]


@dataclass(frozen=True)
class Compute:
    items: tuple[tuple[Expr, str], ...]


@dataclass(frozen=True)
class Key:
    expr: Expr
    bin_ns: int | None
    alias: str


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Expr | None
    pred: Pred | None
    alias: str


@dataclass(frozen=True)
class Group:
    keys: tuple[Key, ...]
    aggs: tuple[Agg, ...]


@dataclass(frozen=True)
class Sort:
    items: tuple[tuple[Expr, bool], ...]
    """Expression and whether it is descending."""


@dataclass(frozen=True)
class Take:
    n: int
    offset: int = 0


@dataclass(frozen=True)
class Uniq:
    field: Field


@dataclass(frozen=True)
class Patterns:
    field: Field


@dataclass(frozen=True)
class Within:
    """A sliding range as a stage."""

    time: Last


@dataclass(frozen=True)
class Navigate:
    signal: str


@dataclass(frozen=True)
class Merge:
    signal: str
    stages: tuple[Stage, ...]
    alias: str


Stage = Where | Select | Compute | Group | Sort | Take | Uniq | Patterns | Within | Navigate | Merge


@dataclass(frozen=True)
class Query:
    scan: Scan
    stages: tuple[Stage, ...] = ()
