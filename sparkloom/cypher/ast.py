"""Syntax trees of queries and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str  # "*" for all


@dataclass(frozen=True)
class Call(Expr):
    name: str  # lower case
    args: tuple[Expr, ...]
    distinct: bool = False


@dataclass(frozen=True)
class CountStar(Expr):
    pass


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Un(Expr):
    op: str  # "not", "-", "!"
    of: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class ListLit(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class StructLit(Expr):
    fields: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    first: Expr | None
    last: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    of: Expr
    to: str


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str  # all, any, none, single
    var: str
    over: Expr
    where: Expr


@dataclass(frozen=True)
class Lambda(Expr):
    vars: tuple[str, ...]
    body: Expr


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Range:
    mode: str = "walk"  # walk, trail, acyclic, shortest, all shortest, wshortest, all wshortest
    low: int = 1
    high: int | None = None
    weight: str | None = None
    rel_var: str | None = None
    node_var: str | None = None
    where: Expr | None = None
    rel_keep: tuple[str, ...] | None = None
    node_keep: tuple[str, ...] | None = None


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...] = ()
    direction: str = "both"  # out, in, both
    props: tuple[tuple[str, Expr], ...] = ()
    range: Range | None = None


@dataclass(frozen=True)
class PathPattern:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    var: str | None = None


@dataclass(frozen=True)
class Subquery(Expr):
    """EXISTS {...}, COUNT {...}, or a bare pattern as a predicate."""

    kind: str  # exists, count
    paths: tuple[PathPattern, ...]
    where: Expr | None = None


@dataclass
class Item:
    expr: Expr
    alias: str | None
    text: str


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # (expression, ascending)
    skip: Expr | None = None
    limit: Expr | None = None


class Clause:
    """A part of a query."""


@dataclass
class Match(Clause):
    paths: list[PathPattern]
    where: Expr | None = None
    optional: bool = False
    hint: list[str] | None = None


@dataclass
class Unwind(Clause):
    expr: Expr
    var: str


@dataclass
class LoadFrom(Clause):
    source: Any  # list of paths, or a Query
    options: dict[str, Any]
    headers: list[tuple[str, str]] | None = None
    where: Expr | None = None


@dataclass
class CallTable(Clause):
    name: str
    args: list[Expr]
    where: Expr | None = None
    yields: list[tuple[str, str]] | None = None


@dataclass
class CallUnion(Clause):
    vars: list[str]
    body: Query


@dataclass
class With(Clause):
    proj: Projection
    where: Expr | None = None


@dataclass
class Return(Clause):
    proj: Projection


@dataclass
class Create(Clause):
    paths: list[PathPattern]


@dataclass
class SetProps(Clause):
    items: list[tuple[str, str, Expr]]  # variable, property, value


@dataclass
class Delete(Clause):
    vars: list[str]
    detach: bool


@dataclass
class Merge(Clause):
    path: PathPattern
    on_match: list[tuple[str, str, Expr]]
    on_create: list[tuple[str, str, Expr]]


@dataclass
class Query:
    branches: list[list[Clause]]
    union_all: list[bool] = field(default_factory=list)  # one fewer than branches


@dataclass
class CreateNodeTable:
    label: str
    columns: list[tuple[str, str, Expr | None]]  # name, type, default
    key: str
    if_not_exists: bool = False


@dataclass
class CreateRelTable:
    label: str
    pairs: list[tuple[str, str]]
    columns: list[tuple[str, str, Expr | None]]
    multiplicity: str | None = None
    if_not_exists: bool = False


@dataclass
class DropTable:
    label: str
    if_exists: bool = False


@dataclass
class AlterTable:
    label: str
    action: str  # add, drop, rename, rename table
    name: str = ""
    to: str = ""
    default: Expr | None = None
    lenient: bool = False  # IF [NOT] EXISTS


@dataclass
class CopyFrom:
    label: str
    source: Any  # list of paths, or a Query
    options: dict[str, Any]
    columns: list[str] | None = None


@dataclass
class CopyTo:
    query: Query
    path: str
    options: dict[str, Any]


@dataclass
class Admin:
    kind: str  # checkpoint, extension, set, explain, transaction
    args: list[Any] = field(default_factory=list)
