"""A data frame whose columns belong to query variables."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Graph, NodeTable
from ..cypher import ast as A


class BindFault(ValueError):
    """A query that the graph or the clauses before it don't allow."""


@dataclass(frozen=True)
class NodeVar:
    """A node: columns of its key and label; of its properties only once they are asked for."""

    labels: tuple[str, ...]
    key: str
    label: str
    props: dict[str, str] | None = None
    #: Of the key's column: "long", or "string" if a label has keys of another type.
    kind: str = "long"

    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.key, self.label, *(self.props or {}).values()]))

    def identity(self) -> list[str]:
        return [self.key] if len(self.labels) == 1 else [self.key, self.label]


@dataclass(frozen=True)
class RelVar:
    src: str
    src_label: str
    dst: str
    dst_label: str
    type: str
    eid: str
    props: dict[str, str]
    ends: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
    kinds: tuple[str, str] = ("long", "long")

    def columns(self) -> list[str]:
        return [self.src, self.src_label, self.dst, self.dst_label, self.type, self.eid, *self.props.values()]

    def identity(self) -> list[str]:
        return [self.type, self.src, self.dst, self.eid]


@dataclass(frozen=True)
class PathVar:
    length: str
    nodes: str | None = None
    rels: str | None = None
    cost: str | None = None

    def columns(self) -> list[str]:
        return [c for c in (self.length, self.nodes, self.rels, self.cost) if c]

    identity = columns


@dataclass(frozen=True)
class ValueVar:
    column: str

    def columns(self) -> list[str]:
        return [self.column]

    identity = columns


Binding = NodeVar | RelVar | PathVar | ValueVar


@dataclass
class Frame:
    df: DataFrame
    vars: dict[str, Binding] = field(default_factory=dict)
    #: Hidden columns that the rows are sorted by, and whether ascending; for collect() after ORDER BY.
    order: list[tuple[str, bool]] = field(default_factory=list)
    #: A column that says how many rows each row stands for, where rows that nothing tells apart any more were summed.
    weight: str | None = None

    def with_df(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def bind(self, **more: Binding) -> Frame:
        return replace(self, vars=self.vars | more)


class Context:
    """What is the same for all clauses of a query."""

    def __init__(self, graph: Graph, parameters: dict[str, Any] | None = None, settings: dict[str, Any] | None = None) -> None:
        self.graph, self.parameters, self.settings = graph, parameters or {}, settings or {}
        self.spark: SparkSession = graph.spark
        self._numbers = itertools.count()
        self.uses: dict[str, set[str]] = {}

    def fresh(self, base: str = "v") -> str:
        return f"{''.join(c if c.isalnum() else '_' for c in base)}_{next(self._numbers)}"

    def hidden(self) -> str:
        """A variable's name that no query can have."""
        return f"?{next(self._numbers)}"

    def parameter(self, name: str) -> Any:
        if name not in self.parameters:
            raise BindFault(f"no parameter ${name}")
        return self.parameters[name]

    @property
    def max_hops(self) -> int:
        return int(self.settings.get("var_length_extend_max_depth", 30))

    # keys of nodes
    def kind(self, labels: Iterable[str]) -> str:
        """The type that holds the keys of the labels: long if all are integers, else string."""
        return "long" if all(isinstance(self.graph.node(x).key_type, T.IntegralType) for x in labels) else "string"

    @staticmethod
    def to(column: Column, kind: str, wanted: str) -> Column:
        """A key of one kind as another; no key where it can't be one."""
        return column if kind == wanted else column.cast("string") if wanted == "string" else column.try_cast("long")

    @staticmethod
    def equal(a: Column, a_kind: str, b: Column, b_kind: str) -> Column:
        """Whether two keys are equal; only keys of different kinds are compared as text."""
        return a == b if a_kind == b_kind else a.cast("string") == b.cast("string")

    def node_scan(self, name: str, labels: tuple[str, ...]) -> tuple[DataFrame, NodeVar]:
        """All nodes of the labels; a property that a label lacks is null."""
        tables = [self.graph.node(x) for x in labels]
        kinds: dict[str, T.DataType] = {}
        for t in tables:
            for p, kind in t.properties.items():
                if kinds.setdefault(p, kind) != kind:
                    raise BindFault(f"property {p} has different types in {', '.join(labels)}")
        key, label = self.fresh(f"{name}_key"), self.fresh(f"{name}_label")
        props = {p: self.fresh(f"{name}_{p}") for p in kinds}
        of = self.kind(labels)

        def one(t: NodeTable) -> DataFrame:
            return t.df.select(
                F.col(f"`{t.key}`").cast(of).alias(key), F.lit(t.label).alias(label),
                *[(F.col(f"`{p}`") if p in t.properties else F.lit(None).cast(kinds[p])).alias(c) for p, c in props.items()],
            )

        df = one(tables[0])
        for t in tables[1:]:
            df = df.unionAll(one(t))
        return df, NodeVar(tuple(labels), key, label, props, of)

    def hydrate(self, frame: Frame, name: str) -> Frame:
        """The frame with the properties of the node variable: a join by its key."""
        var = frame.vars[name]
        if not isinstance(var, NodeVar) or var.props is not None:
            return frame
        df, found = self.node_scan(name, var.labels)
        on = self.equal(F.col(var.key), var.kind, F.col(found.key), found.kind)
        if len(var.labels) > 1:
            on &= F.col(var.label) == F.col(found.label)
        joined = frame.df.join(df, on, "left").drop(found.key, found.label)
        return frame.with_df(joined).bind(**{name: replace(var, props=found.props)})

    def only_keys(self, var: NodeVar, wanted: set[str]) -> bool:
        """Whether the wanted properties are all the key of the variable's only label."""
        return len(var.labels) == 1 and wanted <= {self.graph.node(var.labels[0]).key}


def walk(tree: Any) -> Iterator[Any]:
    """All syntax nodes of the tree, itself included."""
    yield tree
    if is_dataclass(tree):
        for f in fields(tree):
            yield from walk(getattr(tree, f.name))
    elif isinstance(tree, (list, tuple)):
        for x in tree:
            yield from walk(x)


def names_in(expr: Any) -> set[str]:
    """Variables that the expression reads, those of patterns in it included."""
    found: set[str] = set()

    def go(x: Any, local: frozenset[str]) -> None:
        if isinstance(x, A.Var):
            if x.name not in local:
                found.add(x.name)
        elif isinstance(x, A.Quantifier):
            go(x.over, local)
            go(x.where, local | {x.var})
        elif isinstance(x, A.Lambda):
            go(x.body, local | set(x.vars))
        elif isinstance(x, (A.NodePattern, A.RelPattern)):
            if x.var and x.var not in local:
                found.add(x.var)
            go(x.props, local)
        elif is_dataclass(x):
            for f in fields(x):
                go(getattr(x, f.name), local)
        elif isinstance(x, (list, tuple)):
            for y in x:
                go(y, local)

    go(expr, frozenset())
    return found


def uses(tree: Any) -> dict[str, set[str]]:
    """Of each variable, the functions that are applied to it and `bare` for its other uses."""
    out: dict[str, set[str]] = {}

    def go(x: Any) -> None:
        if isinstance(x, A.Call):
            for a in x.args:
                if isinstance(a, A.Var):
                    out.setdefault(a.name, set()).add(x.name)
                else:
                    go(a)
        elif isinstance(x, A.Var):
            out.setdefault(x.name, set()).add("bare")
        elif isinstance(x, A.Item) and isinstance(x.expr, A.Var) and x.alias in (None, x.expr.name):
            out.setdefault(x.expr.name, set()).add("carried")
        elif isinstance(x, A.Return):
            for item in x.proj.items:
                go(item.expr)
            go([e for e, _ in x.proj.order])
            if x.proj.star:
                out.setdefault("*", set()).add("bare")
        elif is_dataclass(x):
            for f in fields(x):
                go(getattr(x, f.name))
        elif isinstance(x, (list, tuple)):
            for y in x:
                go(y)

    go(tree)
    return out


def conjuncts(expr: A.Expr | None) -> list[A.Expr]:
    if expr is None:
        return []
    if isinstance(expr, A.Bin) and expr.op == "and":
        return [*conjuncts(expr.left), *conjuncts(expr.right)]
    return [expr]
