"""The graph: a data frame for each node label and for each (source label, type, target label) of edges."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut, exists, names, remove, unpacked
from .types import default_column


#: Changes of a table that are kept beside it before it is written anew, and changed rows up to which they are (they are broadcast to be applied).
CHANGES, FEW = 16, 100_000


class CatalogFault(ValueError):
    """A label, type or property that the graph doesn't have, or has already."""


@dataclass(frozen=True)
class NodeTable:
    """Nodes of a label; `key` is the primary-key column of df."""

    label: str
    key: str
    df: DataFrame

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema}

    @property
    def key_type(self) -> T.DataType:
        return self.df.schema[self.key].dataType


@dataclass(frozen=True)
class EdgeTable:
    """Edges of a triplet; df's columns src and dst hold the keys of their ends, all others are properties."""

    type: str
    source: str
    target: str
    df: DataFrame
    src: str = "_src"
    dst: str = "_dst"

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in (self.src, self.dst)}


@dataclass
class Graph:
    """A catalog of immutable tables; a change puts a new table in the old one's place."""

    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[tuple[str, str, str], EdgeTable] = field(default_factory=dict)
    multiplicities: dict[str, str] = field(default_factory=dict)
    #: (table, property) -> the value that it has where none is given, if it isn't the type's.
    defaults: dict[tuple[str, str], Any] = field(default_factory=dict)
    #: Changes that were put since a table was last written.
    changes: dict[Any, int] = field(default_factory=dict)
    #: Rows of tables that have been counted, by the data frame's identity (which is held, so that it stays its own).
    counted: dict[int, tuple[DataFrame, int]] = field(default_factory=dict)
    #: Files whose size in memory is known.
    files: set[str] = field(default_factory=set)

    def rows(self, df: DataFrame) -> int:
        """The number of rows of a table, counted once (Parquet files state it)."""
        if id(df) not in self.counted:
            self.counted[id(df)] = df, df.count()
        return self.counted[id(df)][1]

    def changed(self, name: Any, df: DataFrame, rows: int) -> DataFrame:
        """A table after a change of so many rows: computed from the old one when it is read, or written if the change is large or one of many."""
        self.changes[name] = self.changes.get(name, 0) + 1
        if rows <= FEW and self.changes[name] < CHANGES:
            return df
        self.changes[name] = 0
        return cut(df)

    def add_nodes(self, label: str, df: DataFrame, key: str) -> Graph:
        if label in self.nodes or label in self.types():
            raise CatalogFault(f"{label} is there already")
        if key not in df.columns:
            raise CatalogFault(f"{label} has no column {key}")
        unpacked(df, self.files)
        self.nodes[label] = NodeTable(label, key, df)
        return self

    def add_edges(self, type_: str, source: str, target: str, df: DataFrame, src: str = "_src", dst: str = "_dst") -> Graph:
        """df: a row an edge. Its ends have to be keys of nodes that are there."""
        if (source, type_, target) in self.edges or type_ in self.nodes:
            raise CatalogFault(f"{type_} from {source} to {target} is there already")
        self.node(source), self.node(target)
        if {src, dst} - set(df.columns):
            raise CatalogFault(f"{type_} has no columns {src} and {dst}")
        unpacked(df, self.files)
        self.edges[source, type_, target] = EdgeTable(type_, source, target, df, src, dst)
        return self

    def types(self) -> set[str]:
        return {t for _, t, _ in self.edges}

    def node(self, label: str) -> NodeTable:
        if label not in self.nodes:
            raise CatalogFault(f"no node label {label}")
        return self.nodes[label]

    def labels(self, wanted: Iterable[str] = ()) -> list[str]:
        """The wanted labels, all if none is named."""
        wanted = list(dict.fromkeys(wanted))
        for label in wanted:
            self.node(label)
        return wanted or list(self.nodes)

    def triplets(self, types: Iterable[str] = ()) -> list[EdgeTable]:
        types = list(dict.fromkeys(types))
        for t in types:
            if t not in self.types():
                raise CatalogFault(f"no edge type {t}")
        return [e for e in self.edges.values() if not types or e.type in types]

    def put_nodes(self, label: str, df: DataFrame, rows: int | None = None) -> None:
        """rows: how many of the old table the change touches, if it may be kept beside it."""
        self.nodes[label] = replace(self.node(label), df=df if rows is None else self.changed(label, df, rows))

    def put_edges(self, edge: EdgeTable, df: DataFrame, rows: int | None = None) -> None:
        at = edge.source, edge.type, edge.target
        self.edges[at] = replace(edge, df=df if rows is None else self.changed(at, df, rows))

    def drop(self, name: str, lenient: bool = False) -> None:
        if name in self.nodes:
            if used := [t for s, t, d in self.edges if name in (s, d)]:
                raise CatalogFault(f"{name} is an end of {used[0]}")
            del self.nodes[name]
        elif name in self.types():
            self.edges = {k: e for k, e in self.edges.items() if e.type != name}
            self.multiplicities.pop(name, None)
        elif not lenient:
            raise CatalogFault(f"no table {name}")
        self.defaults = {k: v for k, v in self.defaults.items() if k[0] != name}

    def alter(self, name: str, change) -> None:
        """Puts change(df, reserved columns) in the place of each table of the name."""
        if name in self.nodes:
            table = self.nodes[name]
            self.put_nodes(name, change(table.df, (table.key,)))
        elif name in self.types():
            for edge in self.triplets([name]):
                self.put_edges(edge, change(edge.df, (edge.src, edge.dst)))
        else:
            raise CatalogFault(f"no table {name}")

    def rename(self, name: str, to: str) -> None:
        if to in self.nodes or to in self.types():
            raise CatalogFault(f"{to} is there already")
        if name in self.nodes:
            self.nodes = {to if k == name else k: replace(t, label=to) if k == name else t for k, t in self.nodes.items()}
            swap = lambda x: to if x == name else x
            self.edges = {(swap(s), t, swap(d)): replace(e, source=swap(s), target=swap(d)) for (s, t, d), e in self.edges.items()}
        elif name in self.types():
            self.edges = {(s, to if t == name else t, d): replace(e, type=to) if t == name else e for (s, t, d), e in self.edges.items()}
        else:
            raise CatalogFault(f"no table {name}")
        self.defaults = {(to if t == name else t, p): v for (t, p), v in self.defaults.items()}

    def default(self, name: str, prop: str, kind: T.DataType) -> Column:
        """What a row of the table holds where the property isn't given."""
        value = self.defaults.get((name, prop))
        return default_column(kind) if value is None else F.lit(value).cast(kind)

    # storage
    def save(self, path: str) -> None:
        """Writes all tables as Parquet into a new version folder of path; its schema comes last and makes it the current one.

        The tables may be read from an earlier version, so nothing is overwritten. When the new version is whole, all older
        ones but the one before it go: data frames that came from that one can still be computed.
        """
        schema: dict[str, Any] = {"nodes": [], "edges": [], "defaults": [[*k, v if isinstance(v, (bool, int, float, str)) else str(v)] for k, v in self.defaults.items()]}
        there = versions(self.spark, path)
        at = f"{path}/v{(_number(there[-1]) if there else 0) + 1:08d}-{uuid.uuid4().hex[:8]}"
        for i, n in enumerate(self.nodes.values()):
            n.df.write.parquet(f"{at}/nodes-{i}")
            schema["nodes"].append({"label": n.label, "key": n.key})
        for i, e in enumerate(self.edges.values()):
            e.df.write.parquet(f"{at}/edges-{i}")
            schema["edges"].append({"type": e.type, "source": e.source, "target": e.target, "src": e.src, "dst": e.dst, "multiplicity": self.multiplicities.get(e.type)})
        self.spark.createDataFrame([(json.dumps(schema),)], "schema string").coalesce(1).write.text(f"{at}/schema")
        for old in there[:-1]:
            remove(self.spark, f"{path}/{old}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """The graph of the current version; FileNotFoundError if nothing has been saved there."""
        there = versions(spark, path)
        if not there:
            raise FileNotFoundError(path)
        path = f"{path}/{there[-1]}"
        schema = json.loads(spark.read.text(f"{path}/schema").first()[0])
        out = cls(spark)
        for i, n in enumerate(schema["nodes"]):
            out.add_nodes(n["label"], spark.read.parquet(f"{path}/nodes-{i}"), n["key"])
        for i, e in enumerate(schema["edges"]):
            out.add_edges(e["type"], e["source"], e["target"], spark.read.parquet(f"{path}/edges-{i}"), e["src"], e["dst"])
            if e["multiplicity"]:
                out.multiplicities[e["type"]] = e["multiplicity"]
        out.defaults = {(t, p): v for t, p, v in schema["defaults"]}
        return out


def _number(version: str) -> int:
    return int(version[1:].split("-")[0])


def versions(spark: SparkSession, path: str) -> list[str]:
    """The version folders of path whose schema is written, oldest first."""
    return sorted((x for x in names(spark, path) if re.fullmatch(r"v\d{8,}-\w+", x) and exists(spark, f"{path}/{x}/schema/_SUCCESS")), key=lambda x: (_number(x), x))
