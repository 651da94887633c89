"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


class DialectError(ValueError):
    """The text isn't a query of this dialect, or names something that isn't there."""


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Literal:
    value: object
    kind: str  # int, float, string, bool, null


@dataclass(frozen=True)
class Interval:
    micros: int


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class In:
    arg: object
    items: tuple
    query: object = None
    negated: bool = False


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool = False


@dataclass(frozen=True)
class Like:
    arg: object
    pattern: object
    fold: bool = False
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool = False


@dataclass(frozen=True)
class Case:
    operand: object
    whens: tuple
    default: object = None


@dataclass(frozen=True)
class Cast:
    arg: object
    kind: str


@dataclass(frozen=True)
class Frame:
    unit: str
    start: tuple  # (kind, offset): UNBOUNDED PRECEDING, PRECEDING, CURRENT ROW, FOLLOWING, UNBOUNDED FOLLOWING
    end: tuple


@dataclass(frozen=True)
class Over:
    partition: tuple = ()
    order: tuple = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    distinct: bool = False
    over: Over | None = None


@dataclass(frozen=True)
class Exists:
    query: object
    negated: bool = False


@dataclass(frozen=True)
class Scalar:
    query: object


@dataclass(frozen=True)
class Table:
    name: str
    prefix: str | None = None
    alias: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class Series:
    args: tuple
    alias: str
    columns: tuple = ()


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str
    columns: tuple = ()


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    kind: str  # inner, left, right, full
    on: object
    asof: bool = False


@dataclass
class Select:
    items: list  # (expression, alias or None)
    source: object = None
    distinct: bool = False
    where: object = None
    group: list = field(default_factory=list)
    having: object = None
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int | None = None


@dataclass
class SetOperation:
    op: str
    all: bool
    left: object
    right: object
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


@dataclass
class With:
    names: list  # (name, query)
    body: object


@dataclass
class Statement:
    """A session statement; text is the query it carries."""

    action: str  # create view, drop view, create matview, refresh matview, drop matview
    name: str
    text: str | None = None
    replace: bool = False
    lenient: bool = False
    persistent: bool = False
    data: bool = True


def children(x: object):
    """The expressions below an expression; not into subqueries."""
    if isinstance(x, (Unary, Cast, IsNull)):
        return [x.arg]
    if isinstance(x, Binary):
        return [x.left, x.right]
    if isinstance(x, In):
        return [x.arg, *x.items]
    if isinstance(x, Between):
        return [x.arg, x.low, x.high]
    if isinstance(x, Like):
        return [x.arg, x.pattern]
    if isinstance(x, Case):
        return [*([x.operand] if x.operand else []), *(y for w in x.whens for y in w), *([x.default] if x.default else [])]
    if isinstance(x, Call):
        return [*x.args, *((x.over.partition + tuple(e for e, _ in x.over.order)) if x.over else ())]
    return []


def some(x: object, test) -> bool:
    return test(x) or any(some(y, test) for y in children(x))
