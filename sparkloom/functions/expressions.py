"""Expressions as Spark columns, with the language's semantics."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..plans.frame import BindFault, Context, Frame, NodeVar, PathVar, RelVar, ValueVar
from ..types import INTERVAL, Interval, add_intervals, date_plus, difference, interval, is_interval, milliseconds, negate, normal, parse_interval, spark_type, timestamp_plus

AGGREGATES = frozenset({"count", "sum", "avg", "min", "max", "collect", "first", "stddev"})
_ID_MASK = (1 << 56) - 1

#: Functions that are one Spark function each.
PLAIN: dict[str, Callable[..., Column]] = {
    "upper": F.upper, "ucase": F.upper, "toupper": F.upper, "lower": F.lower, "lcase": F.lower, "tolower": F.lower, "reverse": F.reverse,
    "abs": F.abs, "pow": F.pow, "power": F.pow, "sqrt": F.sqrt, "ceil": F.ceil, "ceiling": F.ceil, "floor": F.floor, "ln": F.log, "log": F.log10, "log2": F.log2, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sign": F.signum, "factorial": F.factorial, "cbrt": F.cbrt, "degrees": F.degrees, "radians": F.radians, "greatest": F.greatest, "least": F.least,
    "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "coalesce": F.coalesce, "ifnull": F.coalesce, "list_distinct": F.array_distinct, "range": F.sequence, "gen_random_uuid": F.uuid,
}


def literal(value: Any) -> Column:
    if isinstance(value, Interval):
        return value.column()
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("long") if -(1 << 63) <= value < 1 << 63 else F.lit(decimal.Decimal(value)).cast("decimal(20,0)")
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def has_aggregate(tree: Any) -> bool:
    from ..plans.frame import walk

    return any(isinstance(x, A.CountStar) or isinstance(x, A.Call) and x.name in AGGREGATES for x in walk(tree))


class Compiler:
    """Compiles expressions over one frame; node variables whose properties they read are to be hydrated before."""

    def __init__(self, ctx: Context, frame: Frame, local: dict[str, Column] | None = None) -> None:
        self.ctx, self.frame, self.local = ctx, frame, local or {}

    def type_of(self, column: Column) -> T.DataType | None:
        try:
            return self.frame.df.select(column).schema[0].dataType
        except PySparkException:
            return None  # it reads a lambda's variable

    # entry
    def __call__(self, e: A.Expr) -> Column:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _lit(self, e: A.Lit) -> Column:
        return literal(e.value)

    def _param(self, e: A.Param) -> Column:
        return literal(self.ctx.parameter(e.name))

    def _var(self, e: A.Var) -> Column:
        if e.name in self.local:
            return self.local[e.name]
        return self.value(self.binding(e.name))

    def binding(self, name: str):
        if name not in self.frame.vars:
            raise BindFault(f"no variable {name}")
        return self.frame.vars[name]

    def value(self, b) -> Column:
        if isinstance(b, ValueVar):
            return F.col(b.column)
        if isinstance(b, NodeVar):
            return F.when(F.col(b.key).isNotNull(), F.struct(self.node_id(b).alias("_ID"), F.col(b.label).alias("_LABEL"), *[F.col(c).alias(p) for p, c in (b.props or {}).items()]))
        if isinstance(b, RelVar):
            src, dst = (self.id_of(F.col(k), F.col(lab), labels) for k, lab, labels in ((b.src, b.src_label, b.ends[0]), (b.dst, b.dst_label, b.ends[1])))
            return F.when(F.col(b.type).isNotNull(), F.struct(F.col(b.eid).alias("_ID"), F.col(b.type).alias("_LABEL"), src.alias("_SRC_ID"), dst.alias("_DST_ID"), *[F.col(c).alias(p) for p, c in b.props.items()]))
        fields = [F.col(c).alias(n) for n, c in (("nodes", b.nodes), ("rels", b.rels)) if c]
        return F.when(F.col(b.length).isNotNull(), F.struct(*fields, F.col(b.length).alias("length"), *([F.col(b.cost).alias("cost")] if b.cost else [])))

    def id_of(self, key: Column, label: Column, labels: tuple[str, ...]) -> Column:
        """A number for a node: its label's in the upper byte, its key or the key's hash below."""
        at = {x: i for i, x in enumerate(self.ctx.graph.nodes)}

        def one(x: str) -> Column:
            below = key.try_cast("long") if self.ctx.kind((x,)) == "long" else F.xxhash64(key)
            return F.lit(at[x] << 56).cast("long").bitwiseOR(below.bitwiseAND(F.lit(_ID_MASK)))

        return one(labels[0]) if len(labels) == 1 else F.coalesce(*[F.when(label == x, one(x)) for x in labels or at])

    def node_id(self, b: NodeVar) -> Column:
        return self.id_of(F.col(b.key), F.col(b.label), b.labels)

    def _prop(self, e: A.Prop) -> Column:
        if isinstance(e.of, A.Var) and e.of.name not in self.local:
            b = self.binding(e.of.name)
            if isinstance(b, NodeVar):
                if b.props is None and self.ctx.only_keys(b, {e.key}):
                    kind = self.ctx.graph.node(b.labels[0]).key_type
                    return F.col(b.key).cast(kind)
                if b.props is None or e.key not in b.props:
                    raise BindFault(f"{e.of.name} has no property {e.key}")
                return F.col(b.props[e.key])
            if isinstance(b, RelVar):
                if e.key not in b.props:
                    raise BindFault(f"{e.of.name} has no property {e.key}")
                return F.col(b.props[e.key])
        return self(e.of).getField(e.key)

    def _bin(self, e: A.Bin) -> Column:
        op = e.op
        if op in ("and", "or", "xor"):
            a, b = self(e.left), self(e.right)
            return a & b if op == "and" else a | b if op == "or" else (a | b) & ~(a & b)
        if op in ("=", "<>"):
            same = self.same(e.left, e.right)
            return same if op == "=" else ~same
        if op == "in":
            return self.contains(e.left, e.right)
        a, b = self(e.left), self(e.right)
        if op in ("<", "<=", ">", ">="):
            if is_interval(self.type_of(a)):
                a, b = normal(a), normal(b)
            return {"<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)
        if op in ("+", "-", "*", "/", "%"):
            return self.arithmetic(op, a, b)
        if op == "^":
            return F.pow(a, b)
        if op == "starts with":
            return F.startswith(a, b)
        if op == "ends with":
            return F.endswith(a, b)
        if op == "contains":
            return F.contains(a, b)
        if op == "=~":
            return F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        if op in ("|", "&"):
            return a.bitwiseOR(b) if op == "|" else a.bitwiseAND(b)
        number = e.right.value if isinstance(e.right, A.Lit) else None
        if op in ("<<", ">>") and isinstance(number, int):
            return F.shiftleft(a, number) if op == "<<" else F.shiftright(a, number)
        raise BindFault(f"no operator {op} here")

    def entity(self, e: A.Expr) -> Any:
        """The binding of a variable or of id(variable) that is a node or relationship."""
        if isinstance(e, A.Call) and e.name == "id" and len(e.args) == 1:
            e = e.args[0]
        if isinstance(e, A.Var) and e.name not in self.local:
            b = self.frame.vars.get(e.name)
            return b if isinstance(b, (NodeVar, RelVar)) else None
        return None

    def same(self, left: A.Expr, right: A.Expr) -> Column:
        a, b = self.entity(left), self.entity(right)
        if a is not None and b is not None and isinstance(left, A.Call) == isinstance(right, A.Call):
            if isinstance(a, NodeVar) and isinstance(b, NodeVar):
                keys = self.ctx.equal(F.col(a.key), a.kind, F.col(b.key), b.kind)
                return keys if a.labels == b.labels and len(a.labels) == 1 else keys & (F.col(a.label) == F.col(b.label))
            if isinstance(a, RelVar) and isinstance(b, RelVar):
                return (F.col(a.type) == F.col(b.type)) & (F.col(a.src) == F.col(b.src)) & (F.col(a.dst) == F.col(b.dst)) & (F.col(a.eid) == F.col(b.eid))
            return F.lit(False)
        x, y = self(left), self(right)
        if is_interval(self.type_of(x)):
            x, y = normal(x), normal(y)
        return x == y

    def contains(self, item: A.Expr, over: A.Expr) -> Column:
        """Null only if the item or the list is; null elements are never equal."""
        if isinstance(over, A.ListLit) and all(isinstance(i, (A.Lit, A.Param)) for i in over.items):
            values = [i.value if isinstance(i, A.Lit) else self.ctx.parameter(i.name) for i in over.items]
            return self(item).isin([v for v in values if v is not None]) if values else F.when(self(item).isNotNull(), F.lit(False))
        b = self.entity(item)
        list_, kind = self(over), self.type_of(self(over))
        if isinstance(b, (NodeVar, RelVar)) and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            number = self.node_id(b) if isinstance(b, NodeVar) else F.col(b.eid)
            return F.exists(list_, lambda x: x["_ID"] == number)
        x = self(item)
        return F.when(x.isNotNull() & list_.isNotNull(), F.coalesce(F.array_contains(list_, x), F.lit(False)))

    def arithmetic(self, op: str, a: Column, b: Column) -> Column:
        ka, kb = self.type_of(a), self.type_of(b)
        if op in "+-" and (is_interval(ka) or is_interval(kb) or isinstance(ka, (T.DateType, T.TimestampNTZType, T.TimestampType))):
            return self.temporal(op, a, b, ka, kb)
        if op == "+" and isinstance(ka, T.StringType) and isinstance(kb, T.StringType):
            return F.concat(a, b)
        if op == "+" and isinstance(ka, T.ArrayType):
            return F.concat(a, b)
        whole = lambda k: isinstance(k, T.IntegralType) or isinstance(k, T.DecimalType) and k.scale == 0
        if op == "/":
            if whole(ka) and whole(kb):
                kind = ka if isinstance(ka, T.DecimalType) else kb if isinstance(kb, T.DecimalType) else T.LongType() if T.LongType() in (ka, kb) else T.IntegerType()
                return F.call_function("div", a, b).cast(kind)
            # IEEE: division by zero is infinite or not a number
            quotient = F.try_divide(a.cast("double"), b.cast("double"))
            return F.when(b == 0, F.when((a > 0) | (a < 0), F.signum(a.cast("double")) * F.lit(float("inf"))).when(a == 0, F.lit(float("nan")))).otherwise(quotient)
        return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "%": a.__mod__}[op](b)

    def temporal(self, op: str, a: Column, b: Column, ka, kb) -> Column:
        if is_interval(ka) and is_interval(kb):
            return add_intervals(a, b if op == "+" else negate(b))
        if is_interval(kb) or is_interval(ka):
            if is_interval(ka):
                a, b, ka = b, a, kb
            step = b if op == "+" else negate(b)
            return date_plus(a, step) if isinstance(ka, T.DateType) else timestamp_plus(a, step)
        if op == "-" and isinstance(kb, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            return difference(a, b)
        return {"+": a.__add__, "-": a.__sub__}[op](b)

    def _un(self, e: A.Un) -> Column:
        if e.op == "not":
            return ~self(e.of)
        if e.op == "!":
            return F.factorial(self(e.of))
        x = self(e.of)
        return negate(x) if is_interval(self.type_of(x)) else -x

    def _isnull(self, e: A.IsNull) -> Column:
        b = self.frame.vars.get(e.of.name) if isinstance(e.of, A.Var) and e.of.name not in self.local else None
        x = F.col(b.key) if isinstance(b, NodeVar) else F.col(b.type) if isinstance(b, RelVar) else F.col(b.length) if isinstance(b, PathVar) else self(e.of)
        return x.isNotNull() if e.negated else x.isNull()

    def _case(self, e: A.Case) -> Column:
        out: Any = F
        for condition, value in e.whens:
            test = self(condition) if e.subject is None else self.same(e.subject, condition)
            out = out.when(test, self(value))
        return out.otherwise(self(e.default)) if e.default is not None else out

    def _listlit(self, e: A.ListLit) -> Column:
        items = [self(i) for i in e.items]
        kinds = [self.type_of(i) for i in items]
        numeric = all(k is None or isinstance(k, (T.NumericType, T.NullType)) for k in kinds)
        if numeric or len({k for k in kinds if not isinstance(k, T.NullType)}) <= 1:
            return F.array(*items)
        return F.struct(*[i.alias(f"_{n + 1}") for n, i in enumerate(items)])  # a tuple

    def _structlit(self, e: A.StructLit) -> Column:
        return F.struct(*[self(v).alias(k) for k, v in e.fields])

    def _index(self, e: A.Index) -> Column:
        of = self(e.of)
        if isinstance(self.type_of(of), T.StructType) and isinstance(e.at, A.Lit):
            return of.getField(f"_{e.at.value + 1}")
        return of[self(e.at).cast("int")]

    def _slice(self, e: A.Slice) -> Column:
        """From first up to last, last not included; both counted from 0, from the end if negative."""
        of = self(e.of)
        text = isinstance(self.type_of(of), T.StringType)
        size = F.length(of) if text else F.size(of)
        place = lambda x, none: none if x is None else F.greatest(F.lit(0), F.least(size, F.when(self(x) < 0, self(x) + size).otherwise(self(x)).cast("int")))
        first, last = place(e.first, F.lit(0)), place(e.last, size)
        length = F.greatest(F.lit(0), last - first)
        return F.substr(of, first + 1, length) if text else F.slice(of, first + 1, length)

    def _cast(self, e: A.Cast) -> Column:
        of = self(e.of)
        kind, to = self.type_of(of), spark_type(e.to)
        if is_interval(kind):
            if isinstance(to, T.StringType):
                return render_interval(of)
            return of if to == INTERVAL else milliseconds(of).cast(to)
        if to == INTERVAL:
            if isinstance(e.of, A.Lit):
                return parse_interval(e.of.value).column()
            return interval_of_text(of)
        if isinstance(to, T.ArrayType) and isinstance(kind, T.StringType):
            return F.from_json(of, to.simpleString())
        unsigned = {"UINT8": 1 << 8, "UINT16": 1 << 16, "UINT32": 1 << 32, "UINT64": 1 << 64}.get(e.to.upper())
        cast = of.cast(to)
        if unsigned:
            return F.when((cast >= 0) & (cast < F.lit(decimal.Decimal(unsigned))), cast).otherwise(F.when(cast.isNotNull(), F.raise_error(F.lit(f"out of the range of {e.to}"))).cast(to))
        return cast

    def _quantifier(self, e: A.Quantifier) -> Column:
        over = self(e.over)
        test = lambda x: Compiler(self.ctx, self.frame, self.local | {e.var: x})(e.where)
        if e.kind == "all":
            return F.forall(over, test)
        if e.kind == "any":
            return F.exists(over, test)
        if e.kind == "none":
            return ~F.exists(over, test)
        return F.size(F.filter(over, test)) == 1

    def _subquery(self, e: A.Subquery) -> Column:
        raise BindFault("a pattern or subquery can't stand here")

    def _countstar(self, e: A.CountStar) -> Column:
        return F.count(F.lit(1))

    def _call(self, e: A.Call) -> Column:
        name, args = e.name, e.args
        if name in AGGREGATES:
            return self.aggregate(e)
        method = getattr(self, f"_f_{name}", None)
        if method is not None:
            return method(*args)
        if name in PLAIN:
            return PLAIN[name](*[self(a) for a in args])
        if name in self.ctx.settings.get("functions", {}):
            return self.ctx.settings["functions"][name](*[self(a) for a in args])
        raise BindFault(f"no function {name}")

    # aggregates
    def aggregate(self, e: A.Call) -> Column:
        name = e.name
        if name == "count":
            columns: list[Column] = []
            for a in e.args:
                b = self.entity(a) if isinstance(a, A.Var) else None
                path = self.frame.vars.get(a.name) if isinstance(a, A.Var) and a.name not in self.local else None
                if isinstance(b, NodeVar):
                    columns += [F.col(c) for c in b.identity()]
                elif isinstance(b, RelVar):
                    columns += [F.col(c) for c in b.identity()]
                elif isinstance(path, PathVar):
                    columns.append(F.col(path.length) if not e.distinct else F.struct(*[F.col(c) for c in path.columns()]))
                else:
                    columns.append(self(a))
            return F.count_distinct(*columns) if e.distinct else F.count(columns[0] if len(columns) == 1 else F.when(_all_there(columns), F.lit(1)))
        x = self(e.args[0])
        kind = self.type_of(x)
        if name in ("min", "max") and is_interval(kind):
            x = normal(x)
        if name == "sum":
            return F.sum_distinct(x) if e.distinct else F.sum(x)
        if name == "avg":
            x = x.cast("double")
            return F.call_function("avg", F.expr("null")) if kind is None else F.avg(x) if not e.distinct else F.sum_distinct(x) / F.count_distinct(x)
        if name == "collect":
            if e.distinct:
                return F.array_sort(F.collect_set(x))
            if self.frame.order:
                return ordered_list(x, self.frame.order)
            return F.collect_list(x)
        return {"min": F.min, "max": F.max, "first": lambda c: F.first(c, ignorenulls=True), "stddev": F.stddev}[name](x)

    # graph functions
    def _f_id(self, a: A.Expr) -> Column:
        b = self.entity(a)
        if isinstance(b, NodeVar):
            return self.node_id(b)
        return F.col(b.eid) if isinstance(b, RelVar) else self(a)["_ID"]

    def _f_label(self, a: A.Expr) -> Column:
        b = self.entity(a)
        if isinstance(b, NodeVar):
            return F.when(F.col(b.key).isNotNull(), F.col(b.label))
        return F.col(b.type) if isinstance(b, RelVar) else self(a)["_LABEL"]

    _f_labels = _f_type = _f_label

    def _path(self, a: A.Expr) -> PathVar | None:
        b = self.frame.vars.get(a.name) if isinstance(a, A.Var) and a.name not in self.local else None
        return b if isinstance(b, PathVar) else None

    def _f_length(self, a: A.Expr) -> Column:
        if p := self._path(a):
            return F.col(p.length)
        x = self(a)
        return F.length(x).cast("long") if isinstance(self.type_of(x), T.StringType) else x["length"]

    def _f_nodes(self, a: A.Expr) -> Column:
        return F.col(p.nodes) if (p := self._path(a)) and p.nodes else self(a)["nodes"]

    def _f_rels(self, a: A.Expr) -> Column:
        return F.col(p.rels) if (p := self._path(a)) and p.rels else self(a)["rels"]

    _f_relationships = _f_rels

    def _f_cost(self, a: A.Expr) -> Column:
        if (p := self._path(a)) and p.cost:
            return F.col(p.cost)
        raise BindFault("only weighted shortest paths have a cost")

    def _f_properties(self, a: A.Expr, key: A.Expr) -> Column:
        return F.transform(self(a), lambda x: x[key.value])

    def _f_is_trail(self, a: A.Expr) -> Column:
        ids = F.transform(self._f_rels(a), lambda r: r["_ID"])
        return F.size(F.array_distinct(ids)) == F.size(ids)

    def _f_is_acyclic(self, a: A.Expr) -> Column:
        ids = F.transform(self._f_nodes(a), lambda n: n["_ID"])
        return F.size(F.array_distinct(ids)) == F.size(ids)

    def _end(self, a: A.Expr, source: bool) -> Column:
        b = self.entity(a)
        if isinstance(b, RelVar):
            key, label, labels = (b.src, b.src_label, b.ends[0]) if source else (b.dst, b.dst_label, b.ends[1])
            return F.struct(self.id_of(F.col(key), F.col(label), labels).alias("_ID"), F.col(label).alias("_LABEL"), F.col(key).alias("_KEY"))
        r = self(a)
        side = "SRC" if source else "DST"
        return F.struct(r[f"_{side}_ID"].alias("_ID"), r[f"_{side}_LABEL"].alias("_LABEL"), r[f"_{side}_KEY"].alias("_KEY"))

    def _f_start_node(self, a: A.Expr) -> Column:
        return self._end(a, True)

    def _f_end_node(self, a: A.Expr) -> Column:
        return self._end(a, False)

    _f_startnode, _f_endnode = _f_start_node, _f_end_node

    # lists, strings, structs
    def _f_size(self, a: A.Expr) -> Column:
        x = self(a)
        return F.when(x.isNotNull(), F.length(x) if isinstance(self.type_of(x), T.StringType) else F.size(x)).cast("long")

    _f_list_len = _f_len = _f_array_length = _f_size

    def _f_list_contains(self, a: A.Expr, b: A.Expr) -> Column:
        return self.contains(b, a)

    _f_list_has = _f_array_contains = _f_list_contains

    def _f_list_extract(self, a: A.Expr, i: A.Expr) -> Column:
        return self._index(A.Index(a, i))

    _f_list_element = _f_list_extract

    def _f_list_slice(self, a: A.Expr, first: A.Expr, last: A.Expr) -> Column:
        return self._slice(A.Slice(a, first, last))

    def _f_list_creation(self, *items: A.Expr) -> Column:
        return self._listlit(A.ListLit(items))

    def _f_list_sort(self, a: A.Expr, order: A.Expr | None = None) -> Column:
        return F.sort_array(self(a), not (isinstance(order, A.Lit) and str(order.value).upper() == "DESC"))

    def _f_list_reverse_sort(self, a: A.Expr) -> Column:
        return F.sort_array(self(a), False)

    def _f_list_append(self, a: A.Expr, x: A.Expr) -> Column:
        return F.array_append(self(a), self(x))

    def _f_list_transform(self, a: A.Expr, body: A.Lambda) -> Column:
        return F.transform(self(a), lambda x: Compiler(self.ctx, self.frame, self.local | {body.vars[0]: x})(body.body))

    def _f_list_filter(self, a: A.Expr, body: A.Lambda) -> Column:
        return F.filter(self(a), lambda x: Compiler(self.ctx, self.frame, self.local | {body.vars[0]: x})(body.body))

    def _f_concat(self, *items: A.Expr) -> Column:
        return F.concat(*[self(i) for i in items])

    def _f_substring(self, a: A.Expr, first: A.Expr, length: A.Expr | None = None) -> Column:
        return F.substr(self(a), self(first), *([self(length)] if length is not None else []))

    _f_substr = _f_substring

    def _f_starts_with(self, a: A.Expr, b: A.Expr) -> Column:
        return F.startswith(self(a), self(b))

    def _f_ends_with(self, a: A.Expr, b: A.Expr) -> Column:
        return F.endswith(self(a), self(b))

    _f_suffix, _f_prefix = _f_ends_with, _f_starts_with

    def _f_contains(self, a: A.Expr, b: A.Expr) -> Column:
        return F.contains(self(a), self(b))

    def _f_struct_extract(self, a: A.Expr, key: A.Expr) -> Column:
        return self._prop(A.Prop(a, key.value))

    def _f_round(self, a: A.Expr, n: A.Expr | None = None) -> Column:
        return F.round(self(a), n.value if isinstance(n, A.Lit) else 0)

    def _f_negate(self, a: A.Expr) -> Column:
        return self._un(A.Un("-", a))

    def _f_pi(self) -> Column:
        return F.pi()

    # dates
    def _f_date(self, a: A.Expr) -> Column:
        return F.to_date(self(a))

    _f_to_date = _f_date

    def _f_timestamp(self, a: A.Expr) -> Column:
        return self(a).cast("timestamp_ntz")

    _f_datetime = _f_timestamp

    def _f_interval(self, a: A.Expr) -> Column:
        if isinstance(a, A.Param):
            return parse_interval(self.ctx.parameter(a.name)).column()
        return parse_interval(a.value).column() if isinstance(a, A.Lit) else interval_of_text(self(a))

    _f_duration = _f_to_interval = _f_interval

    def _f_date_part(self, part: A.Expr, a: A.Expr) -> Column:
        name, x = part.value.lower(), self(a)
        name = name.removesuffix("s") if name not in ("s", "us") else name
        kind = self.type_of(x)
        if is_interval(kind):
            unit = {"year": (x["months"], 12, 1 << 30), "month": (x["months"], 1, 12), "day": (x["days"], 1, 1 << 30), "hour": (x["micros"], 3_600_000_000, 1 << 40), "minute": (x["micros"], 60_000_000, 60), "second": (x["micros"], 1_000_000, 60), "millisecond": (x["micros"], 1_000, 60_000), "microsecond": (x["micros"], 1, 60_000_000)}.get(name)
            if unit is None:
                raise BindFault(f"no part {name} of an interval")
            return (F.call_function("div", unit[0].cast("long"), F.lit(unit[1])) % F.lit(unit[2])).cast("long")
        if name == "millisecond":
            return F.floor(F.date_part(F.lit("second"), x) * 1000).cast("long")
        if name == "second":
            return F.floor(F.date_part(F.lit("second"), x)).cast("long")
        return F.date_part(F.lit(name), x).cast("long")

    _f_datepart = _f_date_part


def _all_there(columns: list[Column]) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out &= c.isNotNull()
    return out


def ordered_list(x: Column, order: list[tuple[str, bool]]) -> Column:
    """The values in the order of the sort columns, nulls last; null values are left out."""
    names = [f"k{i}" for i in range(len(order))]
    packed = F.when(x.isNotNull(), F.struct(*[F.col(c).alias(n) for n, (c, _) in zip(names, order, strict=True)], x.alias("x")))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for n, (_, up) in reversed(list(zip(names, order, strict=True))):
            less, more = (-1, 1) if up else (1, -1)
            out = F.when(a[n].isNull() & b[n].isNull(), out).when(a[n].isNull(), 1).when(b[n].isNull(), -1).when(a[n] < b[n], less).when(a[n] > b[n], more).otherwise(out)
        return out

    return F.transform(F.array_sort(F.collect_list(packed), compare), lambda s: s["x"])


def interval_of_text(x: Column) -> Column:
    """An interval of a text column such as `2 days 3 hours`."""
    part = lambda units: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.lower(x), rf"(\d+)\s*(?:{units})\b", 1), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0))
    micros = part("hours?") * 3_600_000_000 + part("minutes?") * 60_000_000 + part("seconds?") * 1_000_000 + part("milliseconds?") * 1000 + part("microseconds?|us")
    return F.when(x.isNotNull(), interval(part("years?") * 12 + part("months?"), part("days?"), micros))


def render_interval(i: Column) -> Column:
    """`1 year 2 months 3 days 4 hours`: parts of zero are left out."""
    div = lambda a, n: F.call_function("div", a.cast("long"), F.lit(n))
    us = i["micros"]
    parts = [(div(i["months"], 12), "year"), (i["months"] % 12, "month"), (i["days"], "day"), (div(us, 3_600_000_000), "hour"), (div(us, 60_000_000) % 60, "minute"), (div(us, 1_000_000) % 60, "second"), (div(us, 1000) % 1000, "millisecond"), (us % 1000, "microsecond")]
    return F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""))) for n, unit in parts])
