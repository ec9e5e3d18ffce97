"""Sessions: a graph and the statements that are executed on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import CatalogFault, Graph
from .cypher import ast as A
from .cypher.parser import parse
from .functions.expressions import Compiler
from .plans.frame import BindFault, Context, Frame
from .plans.query import Planner, void_to_string
from .sources import files
from .sources.datasets import load_dataset
from .storage import cut
from .types import default_column, spark_type


class Session:
    """Executes statements; a query gives a DataFrame, which nothing has computed yet."""

    def __init__(self, graph: Graph, path: str | None = None) -> None:
        self.graph, self.path = graph, path
        self.settings: dict[str, Any] = {"var_length_extend_max_depth": 30, "functions": {}}

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None) -> Session:
        """A session on an empty graph, or on the one that CHECKPOINT wrote to the path."""
        if path is not None:
            try:
                return cls(Graph.load(spark, path), path)
            except FileNotFoundError:  # nothing has been written there yet
                pass
        return cls(Graph(spark), path)

    def register(self, name: str, function: Callable[..., Column]) -> None:
        """Makes a function of columns callable in expressions."""
        self.settings["functions"][name.lower()] = function

    def execute(self, text: str, parameters: dict[str, Any] | None = None) -> DataFrame | None:
        return self.run(parse(text), parameters)

    def run(self, statement: Any, parameters: dict[str, Any] | None = None) -> DataFrame | None:
        ctx = Context(self.graph, parameters, self.settings)
        if isinstance(statement, A.Query):
            return Planner(ctx).query(statement)
        return getattr(self, "_" + type(statement).__name__.lower())(ctx, statement)

    # definitions
    def _value(self, ctx: Context, e: A.Expr) -> Column:
        return Compiler(ctx, Frame(ctx.spark.range(1)))(e)

    def _createnodetable(self, ctx: Context, s: A.CreateNodeTable) -> None:
        if s.if_not_exists and s.label in self.graph.nodes:
            return
        if s.key not in {n for n, _, _ in s.columns}:
            raise CatalogFault(f"{s.label} has no column {s.key}")
        self.graph.add_nodes(s.label, self._empty(ctx, s.columns), s.key)
        self._defaults(ctx, s.label, s.columns)

    def _defaults(self, ctx: Context, name: str, columns: list) -> None:
        for column, kind, e in columns:
            if e is not None:
                self.graph.defaults[name, column] = ctx.spark.range(1).select(self._value(ctx, e).cast(spark_type(kind))).first()[0]

    def _empty(self, ctx: Context, columns: list, ends: dict | None = None) -> DataFrame:
        return ctx.spark.createDataFrame([], T.StructType([*(T.StructField(n, k) for n, k in (ends or {}).items()), *(T.StructField(n, spark_type(k)) for n, k, _ in columns)]))

    def _createreltable(self, ctx: Context, s: A.CreateRelTable) -> None:
        if s.if_not_exists and s.label in self.graph.types():
            return
        for a, b in s.pairs:
            ends = {"_src": self.graph.node(a).key_type, "_dst": self.graph.node(b).key_type}
            self.graph.add_edges(s.label, a, b, self._empty(ctx, s.columns, ends))
        self._defaults(ctx, s.label, s.columns)
        if s.multiplicity:
            self.graph.multiplicities[s.label] = s.multiplicity.upper()

    def _droptable(self, ctx: Context, s: A.DropTable) -> None:
        self.graph.drop(s.label, s.if_exists)

    def _altertable(self, ctx: Context, s: A.AlterTable) -> None:
        if s.action == "rename table":
            return self.graph.rename(s.label, s.to)

        def change(df: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
            there = s.name in df.columns
            if s.action == "add":
                if there:
                    if s.lenient:
                        return df
                    raise CatalogFault(f"{s.label} has {s.name} already")
                kind = spark_type(s.to)
                return df.withColumn(s.name, self._value(ctx, s.default).cast(kind) if s.default is not None else default_column(kind))
            if not there:
                if s.lenient:
                    return df
                raise CatalogFault(f"{s.label} has no {s.name}")
            if s.action == "drop":
                if s.name in fixed:
                    raise CatalogFault(f"{s.name} is a key of {s.label}")
                return df.drop(s.name)
            if s.to in df.columns:
                raise CatalogFault(f"{s.label} has {s.to} already")
            return df.withColumnRenamed(s.name, s.to)

        key = self.graph.nodes[s.label].key if s.label in self.graph.nodes else None
        if s.action == "rename" and key == s.name:
            table = self.graph.nodes[s.label]
            self.graph.nodes[s.label] = replace(table, df=change(table.df, ()), key=s.to)
        else:
            self.graph.alter(s.label, change)
        if s.action == "add" and s.default is not None:
            self._defaults(ctx, s.label, [(s.name, s.to, s.default)])
        elif s.action != "add":
            value = self.graph.defaults.pop((s.label, s.name), None)
            if s.action == "rename" and value is not None:
                self.graph.defaults[s.label, s.to] = value
        return None

    # loading and writing
    def _rows(self, ctx: Context, source: Any, options: dict[str, Any]) -> DataFrame:
        return Planner(ctx).query(source) if isinstance(source, A.Query) else files.read(ctx.spark, source, options)

    def _copyfrom(self, ctx: Context, s: A.CopyFrom) -> None:
        rows = void_to_string(self._rows(ctx, s.source, s.options))
        known = s.label in self.graph.nodes or s.label in self.graph.types()
        ends = (s.options.get("from"), s.options.get("to"))
        if not known:
            if s.options.get("auto_detect", True) in (False, "false", "False"):
                raise CatalogFault(f"no table {s.label}")
            if all(ends):
                a, b = ends
                df = rows.withColumnsRenamed({rows.columns[0]: "_src", rows.columns[1]: "_dst"})
                self.graph.add_edges(s.label, a, b, cut(self._existing(ctx, df, a, b)))
            else:
                self.graph.add_nodes(s.label, cut(rows), rows.columns[0])
        elif s.label in self.graph.nodes:
            table = self.graph.nodes[s.label]
            new = self._fitted(table.label, rows, list(table.properties.items()), s.columns, (table.key,))
            new = cut(new.where(F.col(f"`{table.key}`").isNotNull()))
            # keys that are there stay as they are; of rows with one key the least stays (rows of files have no order)
            rest = [c for c in new.columns if c != table.key]
            new = new.groupBy(table.key).agg(F.min(F.struct(*rest)).alias("_row")).select(table.key, "_row.*") if rest else new.distinct()
            new = new.join(table.df, table.key, "left_anti").select(*table.df.columns)
            self.graph.put_nodes(s.label, cut(table.df.unionByName(new)))
        else:
            tables = [t for t in self.graph.triplets([s.label]) if ends[0] in (None, t.source) and ends[1] in (None, t.target)]
            if len(tables) != 1:
                raise CatalogFault(f"which {s.label}? (from='...', to='...')")
            t = tables[0]
            kinds = {t.src: t.df.schema[t.src].dataType, t.dst: t.df.schema[t.dst].dataType} | t.properties
            new = self._fitted(t.type, rows, list(kinds.items()), [t.src, t.dst, *s.columns] if s.columns else None, (t.src, t.dst))
            self.graph.put_edges(t, cut(t.df.unionByName(self._existing(ctx, new, t.source, t.target, t.src, t.dst))))

    def _existing(self, ctx: Context, df: DataFrame, a: str, b: str, src: str = "_src", dst: str = "_dst") -> DataFrame:
        """Edges whose ends are there."""
        for end, label in ((src, a), (dst, b)):
            table = self.graph.node(label)
            kind = ctx.kind((label,))
            df = df.join(table.df.select(F.col(f"`{table.key}`").cast(kind).alias("_there")), F.col(f"`{end}`").cast(kind) == F.col("_there"), "left_semi")
        return df

    def _fitted(self, name: str, rows: DataFrame, wanted: list, named: list[str] | None, keys: tuple[str, ...]) -> DataFrame:
        """rows by position, or by the columns that are named, with defaults for what is missing; keys have none."""
        names = named or [n for n, _ in wanted]
        given = dict(zip(names, rows.columns, strict=False))
        out = []
        for n, kind in wanted:
            value = F.col(f"`{given[n]}`").cast(kind) if n in given else F.lit(None).cast(kind)
            out.append((value if n in keys else F.coalesce(value, self.graph.default(name, n, kind))).alias(n))
        return rows.select(*out)

    def _copyto(self, ctx: Context, s: A.CopyTo) -> None:
        files.write(void_to_string(Planner(ctx).query(s.query)), s.path, s.options)

    # administration
    def _admin(self, ctx: Context, s: A.Admin) -> DataFrame | None:
        if s.kind == "explain":
            df = self.run(s.args[0], ctx.parameters)
            if df is None:
                return None
            return ctx.spark.createDataFrame([(df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string")
        if s.kind == "checkpoint":
            if self.path is None:
                raise BindFault("this session has no path to write to")
            self.graph.save(self.path)
            self.graph = Graph.load(ctx.spark, self.path)
        elif s.kind == "set":
            self.settings[s.args[0].lower()] = s.args[1].value
        elif s.kind == "transaction" and s.args[0] == "rollback":
            raise BindFault("statements take effect at once")
        return None

    def load_builtin_dataset(self, name: str, folder: str | None = None) -> None:
        """Puts the tables of a built-in data set, or of one whose files stand in the folder, into the graph."""
        found = load_dataset(self.graph.spark, name, folder)
        for n in found.nodes.values():
            self.graph.add_nodes(n.label, n.df, n.key)
        for e in found.edges.values():
            self.graph.add_edges(e.type, e.source, e.target, e.df)
