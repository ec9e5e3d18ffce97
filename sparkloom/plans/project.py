"""WITH and RETURN: projection, grouping, DISTINCT, ORDER BY, SKIP and LIMIT."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cypher import ast as A
from ..functions.expressions import AGGREGATES, Compiler, has_aggregate
from ..types import is_interval, normal
from .frame import BindFault, Context, Frame, NodeVar, PathVar, RelVar, ValueVar, walk
from .match import Matcher, _swap


def _items(frame: Frame, proj: A.Projection) -> list[A.Item]:
    """The items with * and n.* written out."""
    out: list[A.Item] = []
    if proj.star:
        out += [A.Item(A.Var(v), v, v) for v in frame.vars if not v.startswith("?")]
    for i in proj.items:
        if isinstance(i.expr, A.Prop) and i.expr.key == "*":
            name = i.expr.of.name if isinstance(i.expr.of, A.Var) else ""
            b = frame.vars.get(name)
            if not isinstance(b, (NodeVar, RelVar)):
                raise BindFault(f"{i.text} is no node's or relationship's")
            out += [A.Item(A.Prop(i.expr.of, p), None, f"{name}.{p}") for p in (b.props or {})]
        else:
            out.append(i)
    return out


def _constant(ctx: Context, e: A.Expr, what: str) -> int:
    value = ctx.parameter(e.name) if isinstance(e, A.Param) else ctx.spark.range(1).select(Compiler(ctx, Frame(ctx.spark.range(1)))(e)).first()[0] if not isinstance(e, A.Lit) else e.value
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise BindFault(f"{what} takes a number that is not negative")
    return value


def _sorted(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Nulls stand last, whichever the direction."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


class Projector:
    def __init__(self, ctx: Context) -> None:
        self.ctx, self.matcher = ctx, Matcher(ctx)

    def project(self, frame: Frame | None, proj: A.Projection, final: bool) -> Frame:
        ctx = self.ctx
        if frame is None:
            frame = Frame(ctx.spark.range(1).select(F.lit(True).alias(ctx.fresh("one"))))
        for i in proj.items:
            if isinstance(i.expr, A.Prop) and i.expr.key == "*" and isinstance(i.expr.of, A.Var) and i.expr.of.name in frame.vars:
                frame = ctx.hydrate(frame, i.expr.of.name)
        items = _items(frame, proj)
        names = [self.name(i, final) for i in items]
        if len(set(names)) < len(names):
            raise BindFault("two columns of one name")
        if final:  # nodes leave as values
            for i in items:
                if isinstance(i.expr, A.Var) and isinstance(frame.vars.get(i.expr.name), NodeVar):
                    frame = ctx.hydrate(frame, i.expr.name)
        exprs = [i.expr for i in items]
        for k, e in enumerate(exprs):
            if any(isinstance(x, A.Subquery) for x in walk(e)):
                frame, exprs[k] = self.matcher.flags(frame, e)
        order = [(e, up) for e, up in proj.order]
        grouped = any(has_aggregate(e) for e in exprs)
        if grouped:
            out, exprs = self.group(frame, exprs, names)
        else:
            out = self.matcher.ready(frame, *[e for e in exprs if not (isinstance(e, A.Var) and not final and isinstance(frame.vars.get(e.name), NodeVar))])
        out = self.bind(out, exprs, names, final)
        hidden: list[tuple[str, bool]] = []
        if order:
            # what is ordered by: an item itself, else an expression over the items, else over what was before
            scope = out if grouped or proj.distinct else replace(out, vars=frame.vars | {k: v for k, v in out.vars.items()})
            for e, up in order:
                e = self.over_items(e, items, names, exprs)
                b = scope.vars.get(e.name) if isinstance(e, A.Var) else None
                if isinstance(b, (NodeVar, RelVar, PathVar)):
                    raise BindFault("nodes, relationships and paths have no order")
                scope = self.matcher.ready(scope, e)
                compiled = Compiler(ctx, scope)
                column, hide = compiled(e), ctx.fresh("order")
                column = normal(column) if is_interval(compiled.type_of(column)) else column
                scope = scope.with_df(scope.df.withColumn(hide, column))
                hidden.append((hide, up))
            out = replace(out, df=scope.df, vars={k: scope.vars.get(k, v) if isinstance(v, NodeVar) and not final else v for k, v in out.vars.items()})
        if proj.distinct:
            out = self.distinct(out)
        if hidden:
            out = out.with_df(_sorted(out.df, hidden))
        if proj.skip is not None:
            out = out.with_df(out.df.offset(_constant(ctx, proj.skip, "SKIP")))
        if proj.limit is not None:
            out = out.with_df(out.df.limit(_constant(ctx, proj.limit, "LIMIT")))
        if final:
            return replace(out, df=out.df.select(*[F.col(out.vars[n].column).alias(n) for n in names]), vars={n: ValueVar(n) for n in names})
        return replace(out, order=hidden)

    def name(self, item: A.Item, final: bool) -> str:
        if item.alias:
            return item.alias
        if isinstance(item.expr, A.Var):
            return item.expr.name
        if not final:
            raise BindFault(f"{item.text} needs a name: WITH ... AS")
        return item.text

    def over_items(self, e: A.Expr, items: list[A.Item], names: list[str], exprs: list[A.Expr]) -> A.Expr:
        for i, n in zip(items, names, strict=True):
            if e == i.expr:
                return A.Var(n)
        out = e
        for i, n in zip(items, names, strict=True):
            if not isinstance(i.expr, (A.Lit, A.Var)):
                out = _swap(out, i.expr, A.Var(n))
        return out

    @staticmethod
    def weighed(frame: Frame, compiled: Compiler, call: A.Expr):
        """The aggregate, of rows that stand for several."""
        if frame.weight is None or not (isinstance(call, A.CountStar) or isinstance(call, A.Call) and call.name == "count" and not call.distinct):
            return compiled(call)
        weight = F.col(frame.weight)
        if isinstance(call, A.Call):
            for a in call.args:
                weight = F.when(compiled(A.IsNull(a, True)), weight)
        return F.coalesce(F.sum(weight), F.lit(0)).cast("long")

    def bind(self, frame: Frame, exprs: list[A.Expr], names: list[str], final: bool) -> Frame:
        """Entities go on as they are, values get a column each."""
        bound, columns = {}, {}
        compiled = Compiler(self.ctx, frame)
        for e, n in zip(exprs, names, strict=True):
            b = frame.vars.get(e.name) if isinstance(e, A.Var) else None
            if b is not None and not final:
                bound[n] = b
            else:
                c = self.ctx.fresh("value")
                columns[c] = compiled(e)
                bound[n] = ValueVar(c)
        return replace(frame, df=frame.df.withColumns(columns) if columns else frame.df, vars=bound)

    def distinct(self, frame: Frame) -> Frame:
        keys = list(dict.fromkeys(c for b in frame.vars.values() for c in b.identity()))
        if all(isinstance(b, (ValueVar, PathVar)) for b in frame.vars.values()):
            return frame.with_df(frame.df.select(*dict.fromkeys([*keys, *[c for c in frame.df.columns if c.startswith("order_")]])).distinct()) if not any(c.startswith("order_") for c in frame.df.columns) else frame.with_df(frame.df.dropDuplicates(keys))
        return frame.with_df(frame.df.dropDuplicates(keys))

    def group(self, frame: Frame, exprs: list[A.Expr], names: list[str]) -> tuple[Frame, list[A.Expr]]:
        """Groups by the items without aggregates; the others become expressions over the aggregates."""
        ctx = self.ctx
        plain = [(k, e) for k, e in enumerate(exprs) if not has_aggregate(e)]
        calls: list[A.Expr] = []
        for e in exprs:
            for x in walk(e):
                if (isinstance(x, A.CountStar) or isinstance(x, A.Call) and x.name in AGGREGATES) and x not in calls:
                    if isinstance(x, A.Call) and any(has_aggregate(a) for a in x.args):
                        raise BindFault("an aggregate within an aggregate")
                    calls.append(x)
        frame = self.matcher.ready(frame, *[e for _, e in plain if not isinstance(e, A.Var)], *calls)
        for c in calls:  # whole nodes in lists
            if isinstance(c, A.Call) and c.name != "count":
                for a in c.args:
                    if isinstance(a, A.Var) and isinstance(frame.vars.get(a.name), NodeVar):
                        if c.name in ("min", "max", "sum", "avg"):
                            raise BindFault(f"{c.name} takes no node")
                        frame = ctx.hydrate(frame, a.name)
        compiled = Compiler(ctx, frame)
        keys, carried, bound = [], [], {}
        out_exprs = list(exprs)
        for k, e in plain:
            b = frame.vars.get(e.name) if isinstance(e, A.Var) else None
            name = f"group_{k}"
            if isinstance(b, NodeVar):
                # the label of a single-label variable goes with its key; properties are joined again if they are read
                keys += [F.col(c) for c in b.identity()]
                if len(b.labels) == 1:
                    carried.append(F.first(b.label).alias(b.label))
                bound[name] = replace(b, props=None)
            elif isinstance(b, RelVar):
                keys += [F.col(c) for c in b.identity()]
                carried += [F.first(c).alias(c) for c in b.columns() if c not in b.identity()]
                bound[name] = b
            elif b is not None:
                keys += [F.col(c) for c in b.columns()]
                bound[name] = b
            else:
                c = ctx.fresh("group")
                keys.append(compiled(e).alias(c))
                bound[name] = ValueVar(c)
            out_exprs[k] = A.Var(name)
        aggregates = []
        for n, call in enumerate(calls):
            c = ctx.fresh("agg")
            aggregates.append(self.weighed(frame, compiled, call).alias(c))
            bound[f"agg_{n}"] = ValueVar(c)
        df = frame.df.groupBy(*keys).agg(*aggregates, *carried) if keys else frame.df.agg(*aggregates)
        for k, e in enumerate(exprs):
            if has_aggregate(e):
                for n, call in enumerate(calls):
                    e = _swap(e, call, A.Var(f"agg_{n}"))
                for j, p in plain:
                    if not isinstance(p, A.Lit):
                        e = _swap(e, p, A.Var(f"group_{j}"))
                out_exprs[k] = e
        out = Frame(df, bound)
        needs = [e for k, e in enumerate(out_exprs) if not isinstance(e, A.Var)]
        return self.matcher.ready(out, *needs), out_exprs


def counts_only(proj: A.Projection) -> bool:
    """Whether the projection groups, and its aggregates depend on no more than which rows there are and how many of each."""
    if proj.star or any(isinstance(x, A.Subquery) for x in walk([proj.items, proj.order])):
        return False
    found = [x for i in proj.items for x in walk(i.expr) if isinstance(x, A.CountStar) or isinstance(x, A.Call) and x.name in AGGREGATES]
    return bool(found) and all(isinstance(x, A.CountStar) or x.name in ("count", "min", "max") or x.distinct for x in found)


