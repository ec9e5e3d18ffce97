"""Queries: clause by clause from one frame to the next."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..functions.expressions import Compiler
from ..sources import files
from .frame import BindFault, Context, Frame, ValueVar, conjuncts, names_in, uses, walk
from .project import Projector, counts_only
from .updates import Updates


class Planner:
    def __init__(self, ctx: Context) -> None:
        self.ctx, self.projector = ctx, Projector(ctx)
        self.matcher = self.projector.matcher

    def query(self, query: A.Query, start: Frame | None = None) -> DataFrame | None:
        """The result, None for a query that returns nothing."""
        results = [self.single(b, start) for b in query.branches]
        if any(r is None for r in results):
            return None if len(results) == 1 else self._mixed()
        out = results[0].df
        for more, whole in zip(results[1:], query.union_all, strict=True):
            df = more.df
            if len(df.columns) != len(out.columns):
                raise BindFault("the branches of a UNION have different columns")
            out = out.unionAll(df) if whole else out.unionAll(df).distinct()
        return out

    @staticmethod
    def _mixed() -> None:
        raise BindFault("a branch of a UNION returns nothing")

    def single(self, clauses: list[A.Clause], frame: Frame | None = None) -> Frame | None:
        before = self.ctx.uses
        self.ctx.uses = _merged(before, uses(clauses))
        returned = False
        for k, c in enumerate(clauses):
            if isinstance(c, A.Match):
                frame = self.matcher.match(frame, c, _live(clauses[k + 1 :]), _total(clauses[k + 1 :]), _read(clauses[k + 1 :]))
            else:
                frame = getattr(self, "_" + type(c).__name__.lower())(frame, c)
            returned = isinstance(c, A.Return)
        self.ctx.uses = before
        return frame if returned else None

    def _match(self, frame: Frame | None, c: A.Match) -> Frame:
        return self.matcher.match(frame, c)

    def _with(self, frame: Frame | None, c: A.With) -> Frame:
        out = self.projector.project(frame, c.proj, False)
        return self.matcher.filter(out, conjuncts(c.where))

    def _return(self, frame: Frame | None, c: A.Return) -> Frame:
        return self.projector.project(frame, c.proj, True)

    def _start(self, frame: Frame | None) -> Frame:
        return frame if frame is not None else Frame(self.ctx.spark.range(1).select(F.lit(True).alias(self.ctx.fresh("one"))))

    def _unwind(self, frame: Frame | None, c: A.Unwind) -> Frame:
        frame = self.matcher.ready(self._start(frame), c.expr)
        column = self.ctx.fresh(c.var)
        values = Compiler(self.ctx, frame)(c.expr)
        return replace(frame, df=frame.df.withColumn(column, F.explode(values))).bind(**{c.var: ValueVar(column)})

    def _loadfrom(self, frame: Frame | None, c: A.LoadFrom) -> Frame:
        df = self.query(c.source) if isinstance(c.source, A.Query) else files.read(self.ctx.spark, c.source, c.options, c.headers)
        names = {n: self.ctx.fresh(n) for n in df.columns}
        if c.headers:
            names = {n: self.ctx.fresh(h) for n, (h, _) in zip(df.columns, c.headers, strict=False)}
            bound = {h: ValueVar(names[n]) for n, (h, _) in zip(df.columns, c.headers, strict=False)}
        else:
            bound = {n: ValueVar(x) for n, x in names.items()}
        new = df.select(*[F.col(f"`{n}`").alias(x) for n, x in names.items()])
        out = Frame(new, bound) if frame is None else replace(frame, df=frame.df.crossJoin(new), vars=frame.vars | bound)
        return self.matcher.filter(out, conjuncts(c.where))

    def _calltable(self, frame: Frame | None, c: A.CallTable) -> Frame:
        df = self.table_function(c.name, [a.value for a in c.args if isinstance(a, A.Lit)])
        names = dict(c.yields) if c.yields else {n: n for n in df.columns}
        columns = {n: self.ctx.fresh(n) for n in names}
        new = df.select(*[F.col(f"`{n}`").alias(x) for n, x in columns.items()])
        bound = {names[n]: ValueVar(x) for n, x in columns.items()}
        out = Frame(new, bound) if frame is None else replace(frame, df=frame.df.crossJoin(new), vars=frame.vars | bound)
        return self.matcher.filter(out, conjuncts(c.where))

    def table_function(self, name: str, args: list) -> DataFrame:
        spark, graph = self.ctx.spark, self.ctx.graph
        if name == "show_loaded_extensions":
            return spark.createDataFrame([(n, "built in") for n in ("csv", "json", "parquet")], "`extension name` string, `extension source` string")
        if name == "show_tables":
            return spark.createDataFrame([(n, "NODE") for n in graph.nodes] + [(t, "REL") for t in sorted(graph.types())], "name string, type string")
        if name == "table_info":
            label = args[0]
            table = graph.nodes.get(label)
            found = table.properties if table else {p: k for e in graph.triplets([label]) for p, k in e.properties.items()}
            rows = [(i, n, k.simpleString(), bool(table) and n == table.key) for i, (n, k) in enumerate(found.items())]
            return spark.createDataFrame(rows, "`property id` int, name string, type string, `primary key` boolean")
        if name == "current_setting":
            return spark.createDataFrame([(str(self.ctx.settings.get(args[0].lower())),)], f"`{args[0]}` string")
        raise BindFault(f"no table function {name}")

    def _callunion(self, frame: Frame | None, c: A.CallUnion) -> Frame:
        """The branches begin with the frame's rows and its variables that are named; what they return goes on."""
        frame = self._start(frame)
        missing = set(c.vars) - set(frame.vars)
        if missing:
            raise BindFault(f"no variable {', '.join(sorted(missing))}")
        inner = replace(frame, vars={v: frame.vars[v] for v in c.vars}, order=[])
        results = [self._branch(b, inner) for b in c.body.branches]
        names = list(dict.fromkeys(n for n, _ in results[0][1]))
        if any(len(r[1]) != len(results[0][1]) for r in results):
            raise BindFault("the branches of a UNION return different columns")
        df = None
        for k, (out, columns, _) in enumerate(results):
            one = out.select(*[F.col(x).alias(results[0][1][i][1]) for i, (_, x) in enumerate(columns)])
            df = one if df is None else df.unionAll(one) if c.body.union_all[k - 1] else df.unionAll(one).distinct()
        bound = {}
        for n, binding in zip(names, results[0][2], strict=True):
            bound[n] = binding
        return Frame(df, bound)

    def _branch(self, clauses: list[A.Clause], inner: Frame):
        """(data frame, [(name, column)], bindings) of a branch: nodes stay nodes."""
        last = clauses[-1]
        if not isinstance(last, A.Return):
            raise BindFault("a branch returns nothing")
        before = self.ctx.uses
        self.ctx.uses = _merged(before, uses(clauses))
        frame: Frame | None = inner
        for x in clauses[:-1]:
            frame = getattr(self, "_" + type(x).__name__.lower())(frame, x)
        proj = replace(last.proj, items=[replace(i, alias=i.alias or (i.expr.name if isinstance(i.expr, A.Var) else i.text)) for i in last.proj.items])
        out = self.projector.project(frame, proj, False)
        self.ctx.uses = before
        columns, bindings = [], []
        for n, b in out.vars.items():
            b = replace(b, props=None) if hasattr(b, "labels") else b
            bindings.append(b)
            columns += [(n, x) for x in b.columns()]
        return out.df, columns, bindings

    # updates
    def _create(self, frame: Frame | None, c: A.Create) -> Frame:
        return Updates(self.ctx, self.matcher).create(self._start(frame), c)

    def _setprops(self, frame: Frame | None, c: A.SetProps) -> Frame:
        return Updates(self.ctx, self.matcher).set(self._start(frame), c.items)

    def _delete(self, frame: Frame | None, c: A.Delete) -> Frame:
        return Updates(self.ctx, self.matcher).delete(self._start(frame), c)

    def _merge(self, frame: Frame | None, c: A.Merge) -> Frame:
        return Updates(self.ctx, self.matcher).merge(frame, c)


def _live(later: list[A.Clause]) -> set[str] | None:
    """The variables that the clauses read, if they are MATCH clauses and a projection that only counts; else None."""
    for k, c in enumerate(later):
        if isinstance(c, (A.With, A.Return)):
            return names_in([later[: k + 1]]) if counts_only(c.proj) else None
        if not isinstance(c, A.Match):
            return None
    return None


def _read(later: list[A.Clause]) -> set[str] | None:
    """The variables that the projection which comes next reads otherwise than as count(variable), if it only counts; else None."""
    c = later[0] if later else None
    if not isinstance(c, (A.With, A.Return)) or not counts_only(c.proj):
        return None
    trees = [[i.expr for i in c.proj.items], c.proj.order, c.proj.skip, c.proj.limit]
    seen = Counter(x.name for x in walk(trees) if isinstance(x, A.Var))
    counted = Counter(x.args[0].name for x in walk(trees) if isinstance(x, A.Call) and x.name == "count" and not x.distinct and len(x.args) == 1 and isinstance(x.args[0], A.Var))
    return names_in(trees) - {v for v, n in counted.items() if seen[v] == n}


def _total(later: list[A.Clause]) -> bool:
    """Whether all that is asked for is the number of rows."""
    proj = later[0].proj if len(later) == 1 and isinstance(later[0], A.Return) else None
    return proj is not None and not proj.star and not proj.order and proj.skip is None and proj.limit is None and all(isinstance(i.expr, A.CountStar) for i in proj.items)


def _merged(a: dict[str, set[str]], b: dict[str, set[str]]) -> dict[str, set[str]]:
    return {k: a.get(k, set()) | b.get(k, set()) for k in {*a, *b}}


def void_to_string(df: DataFrame) -> DataFrame:
    """df without columns of the null type, which files can't hold."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema])
