"""MATCH: a pattern as an order of joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import EdgeTable
from ..cypher import ast as A
from ..functions.expressions import Compiler
from ..operators.expand import edges
from ..operators.paths import Paths, Wanted
from ..storage import cut
from .frame import BindFault, Context, Frame, NodeVar, PathVar, RelVar, ValueVar, conjuncts, names_in, walk

#: The name of an edge that is asked for once, however many stand between its ends.
ONCE = "?once"
#: Comparisons, and what they are with their sides exchanged.
_TURNED = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass
class Node:
    name: str
    labels: tuple[str, ...]
    tests: list[A.Expr] = field(default_factory=list)


@dataclass
class Rel:
    name: str
    left: str
    right: str
    pattern: A.RelPattern
    tables: list[EdgeTable]
    tests: list[A.Expr] = field(default_factory=list)


@dataclass
class Pattern:
    nodes: dict[str, Node]
    rels: list[Rel]
    named: list[tuple[str, list[str], list[str]]]  # path variables, with their nodes and relationships


def build(ctx: Context, frame: Frame | None, paths: list[A.PathPattern]) -> Pattern:
    """The pattern's graph, with names for what has none and the labels that the schema leaves."""
    bound = frame.vars if frame else {}
    out = Pattern({}, [], [])

    def node(p: A.NodePattern) -> str:
        name = p.var or ctx.hidden()
        labels = ctx.graph.labels(p.labels)
        have = bound.get(name)
        if isinstance(have, (RelVar, PathVar)):
            raise BindFault(f"{name} is no node")
        if isinstance(have, NodeVar):
            labels = [x for x in have.labels if x in labels]
        if name in out.nodes:
            labels = [x for x in out.nodes[name].labels if x in labels]
        else:
            out.nodes[name] = Node(name, ())
        out.nodes[name].labels = tuple(labels)
        out.nodes[name].tests += [A.Bin("=", A.Prop(A.Var(name), k), v) for k, v in p.props]
        return name

    for path in paths:
        names = [node(n) for n in path.nodes]
        rels = []
        for r, a, b in zip(path.rels, names, names[1:], strict=False):
            name = r.var or ctx.hidden()
            if name in bound or any(x.name == name for x in out.rels):
                raise BindFault(f"{name} is bound already")
            tests = [A.Bin("=", A.Prop(A.Var(name), k), v) for k, v in r.props]
            out.rels.append(Rel(name, a, b, r, ctx.graph.triplets(r.types), tests))
            rels.append(name)
            if path.var:  # what is read of the path is read of its parts
                ctx.uses[name] = ctx.uses.get(name, set()) | ctx.uses.get(path.var, set())
        if path.var:
            out.named.append((path.var, names, rels))
    _prune(out)
    return out


def _prune(p: Pattern) -> None:
    """Leaves labels and tables that can stand together, until nothing changes."""
    changed = True
    while changed:
        changed = False
        for r in (r for r in p.rels if r.pattern.range is None):
            a, b, way = p.nodes[r.left], p.nodes[r.right], r.pattern.direction
            fits = lambda t, a=a, b=b, way=way: (way != "in" and t.source in a.labels and t.target in b.labels) or (way != "out" and t.target in a.labels and t.source in b.labels)
            tables = [t for t in r.tables if fits(t)]
            ends = [(t.source, t.target) for t in tables if way != "in"] + [(t.target, t.source) for t in tables if way != "out"]
            left = tuple(x for x in a.labels if any(e[0] == x and e[1] in b.labels for e in ends))
            right = tuple(x for x in b.labels if any(e[1] == x and e[0] in a.labels for e in ends))
            if (len(tables), left, right) != (len(r.tables), a.labels, b.labels):
                changed = True
            if not tables:
                raise BindFault(f"the schema has no such edge between {r.left} and {r.right}")
            r.tables = tables
            if a is b:
                a.labels = tuple(x for x in left if x in right)
            else:
                a.labels, b.labels = left, right
    for n in p.nodes.values():
        if not n.labels:
            raise BindFault(f"the schema has no label for {n.name}")


class Matcher:
    def __init__(self, ctx: Context) -> None:
        self.ctx = ctx

    # expressions over a frame
    def ready(self, frame: Frame, *exprs) -> Frame:
        """The frame with the properties that the expressions read."""
        for name in sorted(names_in(exprs)):
            b = frame.vars.get(name)
            if isinstance(b, NodeVar) and b.props is None:
                wanted, bare = self.reads(exprs, name)
                if bare or not self.ctx.only_keys(b, wanted):
                    frame = self.ctx.hydrate(frame, name)
        return frame

    @staticmethod
    def reads(tree, name: str) -> tuple[set[str], bool]:
        """The properties of the variable that are read, and whether it is read whole."""
        wanted: set[str] = set()
        known = 0
        total = sum(1 for x in walk(tree) if isinstance(x, A.Var) and x.name == name)
        for x in walk(tree):
            if isinstance(x, A.Prop) and isinstance(x.of, A.Var) and x.of.name == name:
                known += 1
                if x.key == "*":
                    return wanted, True
                wanted.add(x.key)
            elif isinstance(x, A.Call) and x.name in ("id", "label", "labels", "count"):
                known += sum(1 for a in x.args if isinstance(a, A.Var) and a.name == name)
            elif isinstance(x, A.IsNull) and isinstance(x.of, A.Var) and x.of.name == name:
                known += 1
            elif isinstance(x, A.Bin) and x.op in ("=", "<>") and isinstance(x.left, A.Var) and isinstance(x.right, A.Var):
                known += (x.left.name == name) + (x.right.name == name)
            elif isinstance(x, A.Bin) and x.op == "in" and isinstance(x.left, A.Var) and x.left.name == name:
                known += 1
        return wanted, total > known

    def filter(self, frame: Frame, tests: list[A.Expr]) -> Frame:
        plain = [t for t in tests if not any(isinstance(x, A.Subquery) for x in walk(t))]
        if plain:
            frame = self.ready(frame, plain)
            compiled = Compiler(self.ctx, frame)
            for t in plain:
                frame = frame.with_df(frame.df.where(compiled(t)))
        for t in tests:
            if t in plain:
                continue
            inner, negated = t, False
            while isinstance(inner, A.Un) and inner.op == "not":
                inner, negated = inner.of, not negated
            if isinstance(inner, A.Subquery) and inner.kind == "exists":
                frame = self.semi(frame, inner, negated)
            else:
                columns = list(frame.vars)
                frame, expr = self.flags(frame, t)
                frame = self.ready(frame, expr)
                frame = frame.with_df(frame.df.where(Compiler(self.ctx, frame)(expr)))
                frame = replace(frame, vars={k: v for k, v in frame.vars.items() if k in columns})
        return frame

    # MATCH
    def match(self, frame: Frame | None, clause: A.Match, live: set[str] | None = None, total: bool = False, read: set[str] | None = None) -> Frame:
        """live: the variables that are read later, where only the number of rows matters besides; None where all do. total: that number is all that is asked for. read: those of the live ones that are read otherwise than in count(), where a projection comes next."""
        frame = self.rebound(frame, clause.paths)
        if clause.optional:
            return self.optional(frame, clause, read)
        if total and frame is None and not clause.hint and not any(p.var for p in clause.paths):
            tests = conjuncts(clause.where)
            nodes = {n.var for p in clause.paths for n in p.nodes}
            if tests and all({*(_apart(t) or ("?",))} <= nodes or self.closing(clause.paths, t) for t in tests):
                return self.total(list(clause.paths), tests)
        return self.plan(frame, clause.paths, conjuncts(clause.where), clause.hint, live)

    def closing(self, paths: list[A.PathPattern], test: A.Expr) -> list[A.PathPattern] | None:
        """The paths with the edge that the test says is not there, if it would close a triangle; else None."""
        sub = test.of if isinstance(test, A.Un) and test.op == "not" else None
        if not isinstance(sub, A.Subquery) or sub.kind != "exists" or sub.where is not None or len(sub.paths) != 1 or len(sub.paths[0].rels) != 1 or sub.paths[0].var:
            return None
        path, r = sub.paths[0], sub.paths[0].rels[0]
        known = {n.var for p in paths for n in p.nodes if n.var}
        if r.var or any(n.var not in known or n.labels or n.props for n in path.nodes):
            return None
        closed = [*paths, replace(path, rels=(replace(r, var=ONCE),))]
        pattern = build(self.ctx, None, closed)
        found = self.triangle(pattern, {n.var for n in path.nodes})
        return closed if found else None

    def total(self, paths: list[A.PathPattern], tests: list[A.Expr]) -> Frame:
        """match() where the number of rows is all that is asked for: a row of all that a test doesn't see, one of what it leaves out, as a negative weight.

        So two ends that have to differ, or that no edge may join, are never listed as pairs: a hub has the square of its edges of these.
        """
        weight = self.ctx.fresh("weight")

        def sum_of(frame: Frame, sign: int):
            n = F.sum(frame.weight) if frame.weight else F.count(F.lit(1))
            return frame.df.agg((F.lit(sign) * F.coalesce(n, F.lit(0))).cast("long").alias(weight))

        if not tests:
            return self.plan(None, paths, [], None, set())
        t = next((t for t in tests if not _apart(t)), tests[0])
        rest = [x for x in tests if x is not t]
        if ends := _apart(t):
            same = {ends[1]: ends[0]}
            labels = build(self.ctx, None, paths).nodes
            if not set(labels[ends[0]].labels) & set(labels[ends[1]].labels):
                return self.total(paths, rest)
            out = self.total([_rename_expr(p, same) for p in paths], [_rename_expr(x, same) for x in rest])
        else:
            out = self.plan(None, self.closing(paths, t), rest, None, set())
        return Frame(sum_of(self.total(paths, rest), 1).unionAll(sum_of(out, -1)), {}, [], weight)

    def triangle(self, pattern: Pattern, read: set[str]) -> list[Rel] | None:
        """Three edges of one type, both ways, between three nodes of one label, of which nothing is read and nothing tested."""
        fit = [r for r in pattern.rels if r.pattern.range is None and r.pattern.direction == "both" and not r.tests and r.name not in read and r.left != r.right and len(r.tables) == 1 and r.tables[0].source == r.tables[0].target]
        once = [r for r in pattern.rels if r.name == ONCE]
        for three in combinations(fit, 3):
            if once and once[0] not in three:
                continue
            ends = {frozenset((r.left, r.right)) for r in three}
            nodes = sorted({n for r in three for n in (r.left, r.right)})
            if len(ends) == 3 and len(nodes) == 3 and len({id(r.tables[0]) for r in three}) == 1 and not pattern.named and not any(pattern.nodes[n].tests for n in nodes):
                return list(three)
        return None

    def scan_triangle(self, pattern: Pattern, three: list[Rel]) -> Frame:
        """The triangles of three edges, each from its end of fewest edges: a hub's pairs of neighbours are not listed."""
        ctx, table = self.ctx, three[0].tables[0]
        label = table.source
        e = edges(ctx, three[0].name, [table], "both", (label,), (label,))
        pairs = cut(e.df.where(F.col(e.near).isNotNull() & F.col(e.far).isNotNull()).groupBy(F.col(e.near).alias("u"), F.col(e.far).alias("v")).agg(F.count(F.lit(1)).alias("m")))
        degree = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
        up = pairs.join(degree.selectExpr("u", "k AS ku"), "u").join(degree.selectExpr("u AS v", "k AS kv"), "v").where(F.struct("ku", "u") <= F.struct("kv", "v")).select("u", "v", "kv", "m")
        up = cut(up)
        wedges = up.join(up.selectExpr("u", "v AS w", "kv AS kw", "m AS uw"), "u").where(F.struct("kv", "v") <= F.struct("kw", "w"))
        found = wedges.withColumnRenamed("m", "uv").join(pairs.selectExpr("u AS v", "v AS w", "m AS vw"), ["v", "w"])
        a, b, c = sorted({n for r in three for n in (r.left, r.right)})
        counts = {frozenset("uv"): "uv", frozenset("uw"): "uw", frozenset("vw"): "vw"}

        def turned(x: str, y: str, z: str) -> Column:
            """The triangle with its corners as a, b and c."""
            at = {a: x, b: y, c: z}
            n = F.lit(1).cast("long")
            for r in three:
                n = n if r.name == ONCE else n * F.col(counts[frozenset((at[r.left], at[r.right]))])
            return F.struct(*[F.col(at[k]).alias(f"x{i}") for i, k in enumerate((a, b, c))], n.alias("n"))

        kind, names, weight = ctx.kind([label]), [ctx.fresh("corner") for _ in range(3)], ctx.fresh("weight")
        rows = found.select(F.explode(F.array_distinct(F.array(*[turned(*p) for p in permutations("uvw")]))).alias("x"))
        label_name = ctx.fresh("label")
        df = rows.select(*[F.col(f"x.x{i}").alias(x) for i, x in enumerate(names)], F.lit(label).alias(label_name), F.col("x.n").alias(weight))
        return Frame(df, {n: NodeVar((label,), x, label_name, kind=kind) for n, x in zip((a, b, c), names, strict=True)}, [], weight)

    def summed(self, frame: Frame, live: set[str]) -> Frame:
        """The frame with a row for all rows that agree in the live variables, and their number as its weight.

        The sum is made by the keys that the next join is made by, so it needs no exchange of its own.
        """
        kept = {v: b for v, b in frame.vars.items() if v in live}
        if not any(isinstance(b, NodeVar) for v, b in frame.vars.items() if v not in kept) or not kept or not all(isinstance(b, NodeVar) for b in kept.values()):
            return frame
        keys = list(dict.fromkeys(c for b in kept.values() for c in b.identity()))
        carried = [c for b in kept.values() for c in b.columns() if c not in keys]
        weight = self.ctx.fresh("weight")
        total = F.count(F.lit(1)) if frame.weight is None else F.sum(frame.weight)
        df = frame.df.groupBy(*keys).agg(total.alias(weight), *[F.first(c).alias(c) for c in dict.fromkeys(carried)])
        return Frame(df, kept, [], weight)

    def rebound(self, frame: Frame | None, paths: list[A.PathPattern]) -> Frame | None:
        """Node values, such as elements of nodes(path), that a pattern goes on from, as node variables."""
        for p in (n for path in paths for n in path.nodes):
            b = frame.vars.get(p.var) if frame and p.var else None
            if isinstance(b, ValueVar):
                kind = frame.df.schema[b.column].dataType
                names = getattr(kind, "names", [])
                if "_LABEL" not in names:
                    raise BindFault(f"{p.var} is no node")
                labels = tuple(self.ctx.graph.labels(p.labels))
                keys, kind_of = {self.ctx.graph.node(x).key for x in labels}, self.ctx.kind(labels)
                c = F.col(b.column)
                key = c["_KEY"] if "_KEY" in names else F.coalesce(*[F.when(c["_LABEL"] == x, c[self.ctx.graph.node(x).key].cast(kind_of)) for x in labels if self.ctx.graph.node(x).key in names]) if keys & set(names) else None
                if key is None:
                    raise BindFault(f"{p.var} has no key")
                k, lab = self.ctx.fresh(p.var), self.ctx.fresh(p.var)
                frame = frame.with_df(frame.df.withColumns({k: key.try_cast(kind_of), lab: c["_LABEL"]})).bind(**{p.var: NodeVar(labels, k, lab, kind=kind_of)})
        return frame

    def plan(self, frame: Frame | None, paths: list[A.PathPattern], tests: list[A.Expr], hint: list[str] | None = None, live: set[str] | None = None) -> Frame:
        ctx = self.ctx
        pattern = build(ctx, frame, paths)
        later: list[A.Expr] = []
        for t in tests:  # a test of one variable is made where the variable is bound
            names = names_in(t)
            one = next(iter(names)) if len(names) == 1 else None
            if any(isinstance(x, A.Subquery) for x in walk(t)):
                later.append(t)
            elif one in pattern.nodes:
                pattern.nodes[one].tests.append(t)
            elif any(r.name == one and r.pattern.range is None for r in pattern.rels):
                next(r for r in pattern.rels if r.name == one).tests.append(t)
            else:
                later.append(t)
        bound = set(frame.vars) & set(pattern.nodes) if frame else set()
        for name in sorted(bound):
            frame = self.settle(frame, pattern.nodes[name])
        rels = list(pattern.rels)
        order = {name: i for i, name in enumerate(hint or [])}
        rels.sort(key=lambda r: order.get(r.name, len(order)))
        if live is not None and frame is None and not hint and (three := self.triangle(pattern, live | names_in(tests))):
            frame = self.scan_triangle(pattern, three)
            rels = [r for r in rels if r not in three]
            bound |= set(frame.vars)
            now = [t for t in later if names_in(t) <= bound]
            later = [t for t in later if t not in now]
            frame = self.filter(frame, now)
        while rels or not set(pattern.nodes) <= bound:
            near = [r for r in rels if r.left in bound or r.right in bound]
            if near:
                r = near[0] if len(near) == 1 else min(near, key=lambda r: (not (r.left in bound and r.right in bound), r.pattern.range is not None, order.get(r.name, len(order)), self.fan(pattern, r, bound)))
                rels.remove(r)
                if live is not None and self.counted(frame, pattern, r, bound, rels, live | names_in(later)):
                    frame = self.expand_degree(frame, pattern, r, bound)
                else:
                    needed = (live or set()) | names_in(later) | {n for x in rels for n in (x.left, x.right)} | names_in([x.tests for x in (*rels, *pattern.nodes.values())])
                    merged = live is not None and not pattern.named and not needed & set(frame.vars)
                    frame = self.expand(frame, pattern, r, bound) if r.pattern.range is None else self.expand_path(frame, pattern, r, bound, live is not None, merged)
            else:
                ranges = {n: self.ranged(pattern, n, later, live) for n in pattern.nodes if n not in bound and live is not None and not pattern.named}
                ranges = {n: x for n, x in ranges.items() if x}
                plain = [n for n in pattern.nodes if n not in bound and n not in ranges]
                if not plain and frame is not None and bound and (new := self.range_counted(frame, pattern.nodes[name := next(iter(ranges))], ranges[name])):
                    frame = new
                    later = [t for t in later if name not in names_in(t)]
                    bound.add(name)
                    continue
                name = self.first(pattern, bound | (set(ranges) if plain else set()), rels)
                r = self.first_edge(pattern, name, rels)
                if r is None:
                    frame = self.scan(frame, pattern.nodes[name])
                    bound.add(name)
                    continue
                rels.remove(r)
                frame = self.scan_edge(frame, pattern, r)
            bound |= {r.left, r.right}
            # a test of several variables is made as soon as all of them are there
            known = set(pattern.nodes) | {x.name for x in pattern.rels} | set(frame.vars)
            now = [t for t in later if names_in(t) & known <= set(frame.vars)] if rels else []
            later = [t for t in later if t not in now]
            frame = self.filter(frame, now)
            if live is not None and rels and not pattern.named:
                tested = names_in([later, *[n.tests for n in pattern.nodes.values() if n.name not in bound], *[x.tests for x in rels]])
                frame = self.summed(frame, live | tested | {n for x in rels for n in (x.left, x.right)})
        for var, nodes, names in pattern.named:
            frame = self.name_path(frame, var, nodes, names)
        return self.filter(frame, later)

    def fan(self, pattern: Pattern, r: Rel, bound: set[str]) -> float:
        """About how many rows each row becomes by going along r from its bound end: edges a node, a tenth for each test of the other end."""
        if r.left in bound and r.right in bound:
            return 0.0
        near, far = (pattern.nodes[n] for n in ((r.left, r.right) if r.left in bound else (r.right, r.left)))
        outward = r.left in bound
        graph, total = self.ctx.graph, 0
        for t in r.tables:
            for way in ("out", "in"):
                forward = r.pattern.direction == "both" or (r.pattern.direction == way) == outward
                a, b = (t.source, t.target) if way == "out" else (t.target, t.source)
                if forward and a in near.labels and b in far.labels:
                    total += graph.rows(t.df)
        nodes = sum(graph.rows(graph.node(x).df) for x in near.labels)
        return total / max(1, nodes) * 0.1 ** len(far.tests)

    def first(self, pattern: Pattern, bound: set[str], rels: list[Rel]) -> str:
        """The node to begin a component with: by key, else with a test, else the first."""

        def rank(name: str) -> int:
            n = pattern.nodes[name]
            return 0 if self.fixed(n) else 1 if n.tests else 2

        return min((n for n in pattern.nodes if n not in bound), key=rank)

    @staticmethod
    def first_edge(pattern: Pattern, name: str, rels: list[Rel]) -> Rel | None:
        """The relationship to begin with at a node that has no test: its table holds the node's key, so the node's own is not read."""
        if pattern.nodes[name].tests:
            return None
        found = [r for r in rels if r.pattern.range is None and name in (r.left, r.right) and r.left != r.right]
        return max(found, key=lambda r: len(r.tests) + len(pattern.nodes[r.left].tests) + len(pattern.nodes[r.right].tests), default=None)

    def scan_edge(self, frame: Frame | None, pattern: Pattern, r: Rel) -> Frame:
        a, b = pattern.nodes[r.left], pattern.nodes[r.right]
        e = edges(self.ctx, r.name, r.tables, r.pattern.direction, a.labels, b.labels)
        own = [t for t in r.tests if names_in(t) <= {r.name}]
        new = self.filter(Frame(e.df, {r.name: e.rel}), own)
        single = [[t for t in n.tests if names_in(t) <= {n.name}] for n in (a, b)]
        new = self.arrive(new, replace(a, tests=single[0]), e.near, e.near_label, e.near_labels, e.near_kind)
        new = self.arrive(new, replace(b, tests=single[1]), e.far, e.far_label, e.far_labels, e.far_kind)
        if frame is not None:
            new = replace(frame, df=frame.df.crossJoin(new.df), vars=frame.vars | new.vars)
        return self.filter(new, [t for tests in (r.tests, a.tests, b.tests) for t in tests if t not in own and t not in single[0] and t not in single[1]])

    def scan(self, frame: Frame | None, node: Node) -> Frame:
        df, var = self.ctx.node_scan(node.name, node.labels)
        new = Frame(df, {node.name: var})
        own = [t for t in node.tests if names_in(t) <= {node.name}]
        new = self.filter(new, own)
        if frame is None:
            return new
        joined = replace(frame, df=frame.df.crossJoin(new.df), vars=frame.vars | new.vars)
        return self.filter(joined, [t for t in node.tests if t not in own])

    def settle(self, frame: Frame, node: Node) -> Frame:
        """A variable of the frame, with the labels and tests of this pattern."""
        var = frame.vars[node.name]
        if set(node.labels) < set(var.labels):
            frame = frame.with_df(frame.df.where(F.col(var.label).isin(list(node.labels)))).bind(**{node.name: replace(var, labels=node.labels)})
        else:
            frame = frame.with_df(frame.df.where(F.col(var.key).isNotNull()))
        return self.filter(frame, node.tests)

    def arrive(self, frame: Frame, node: Node, key: str, label: str, labels: tuple[str, ...], kind: str) -> Frame:
        """A node that an edge leads to. Its table is joined only for tests of its properties."""
        if len(labels) > len(node.labels):
            frame = frame.with_df(frame.df.where(F.col(label).isin(list(node.labels))))
        frame = frame.bind(**{node.name: NodeVar(node.labels, key, label, kind=kind)})
        own = [t for t in node.tests if names_in(t) <= {node.name}]
        wanted, bare = self.reads(own, node.name)
        if own and (bare or not self.ctx.only_keys(frame.vars[node.name], wanted)):
            found = self.scan(None, Node(node.name, node.labels, own))
            var = found.vars[node.name]
            on = self.ctx.equal(F.col(key), kind, F.col(var.key), var.kind)
            if len(node.labels) > 1:
                on &= F.col(label) == F.col(var.label)
            frame = frame.with_df(frame.df.join(found.df, on).drop(var.key, var.label)).bind(**{node.name: replace(var, key=key, label=label, kind=kind)})
            return self.filter(frame, [t for t in node.tests if t not in own])
        return self.filter(frame, node.tests)

    def expand(self, frame: Frame, pattern: Pattern, r: Rel, bound: set[str]) -> Frame:
        forward = r.left in bound
        a, b = (r.left, r.right) if forward else (r.right, r.left)
        way = r.pattern.direction if forward or r.pattern.direction == "both" else {"out": "in", "in": "out"}[r.pattern.direction]
        var, there = frame.vars[a], pattern.nodes[b]
        e = edges(self.ctx, r.name, r.tables, way, pattern.nodes[a].labels, there.labels)
        side = self.filter(Frame(e.df, {r.name: e.rel}), [t for t in r.tests if names_in(t) <= {r.name}])
        on = self.ctx.equal(F.col(var.key), var.kind, F.col(e.near), e.near_kind)
        if len(var.labels) > 1 or len(e.near_labels) > 1:
            on &= F.col(var.label) == F.col(e.near_label)
        closes = b in bound
        if closes:
            other = frame.vars[b]
            on &= self.ctx.equal(F.col(other.key), other.kind, F.col(e.far), e.far_kind)
            if len(other.labels) > 1 or len(e.far_labels) > 1:
                on &= F.col(other.label) == F.col(e.far_label)
        out = replace(frame, df=frame.df.join(side.df, on), vars=frame.vars | {r.name: e.rel})
        if not closes:
            out = self.arrive(out, there, e.far, e.far_label, e.far_labels, e.far_kind)
        return self.filter(out, [t for t in r.tests if not names_in(t) <= {r.name}])

    @staticmethod
    def ranged(pattern: Pattern, name: str, later: list[A.Expr], live: set[str] | None) -> list[tuple[str, str, A.Expr]] | None:
        """The tests of a node without edges that is only counted, as (operator, its property, what that is compared with): equal ones and one range; else None."""
        tests = [t for t in later if name in names_in(t)]
        if name in live or any(name in (r.left, r.right) for r in pattern.rels) or name in names_in([n.tests for n in pattern.nodes.values() if n.name != name]) or names_in(pattern.nodes[name].tests) - {name}:
            return None
        found = []
        for t in tests:
            if not isinstance(t, A.Bin) or t.op not in _TURNED or any(isinstance(x, A.Subquery) for x in walk(t)):
                return None
            op, own, other = (t.op, t.left, t.right) if name in names_in(t.left) else (_TURNED[t.op], t.right, t.left)
            if not isinstance(own, A.Prop) or not isinstance(own.of, A.Var) or name in names_in(other) or len(names_in(other)) != 1:
                return None
            found.append((op, own.key, other))
        return found if sum(op == "=" for op, _, _ in found) == len(found) - 1 > 0 else None

    def range_counted(self, frame: Frame, node: Node, tests: list[tuple[str, str, A.Expr]]) -> Frame | None:
        """The frame, each row with the number of nodes that it passes the tests with; None where the types differ.

        Values of both sides are sorted together, of each key by itself, and counted as they come: no row is made for a pair.
        """
        ctx = self.ctx
        tests = sorted(tests, key=lambda t: t[0] != "=")
        frame = self.ready(frame, *[other for _, _, other in tests])
        there = self.scan(None, node)
        mine, theirs = Compiler(ctx, frame), Compiler(ctx, there)
        names = [ctx.fresh("by") for _ in tests]
        left = frame.df.withColumns({n: mine(other) for n, (_, _, other) in zip(names, tests, strict=True)}).where(_present(names))
        right = there.df.select(*[theirs(A.Prop(A.Var(node.name), key)).alias(n) for n, (_, key, _) in zip(names, tests, strict=True)]).where(_present(names))
        if any(left.schema[n].dataType != right.schema[n].dataType or not isinstance(right.schema[n].dataType, T.AtomicType) for n in names) or any(isinstance(right.schema[n].dataType, (T.FloatType, T.DoubleType)) for n in names[:-1]):
            return None
        n, weight = ctx.fresh("n"), ctx.fresh("weight")
        found = self.so_far(left, right.groupBy(*names).agg(F.count(F.lit(1)).alias(n)), names, n, tests[-1][0])
        df = left.join(found, names).withColumn(weight, F.col(n) * (F.col(frame.weight) if frame.weight else F.lit(1))).drop(*names, n)
        return replace(frame, df=df, weight=weight)

    def so_far(self, left: DataFrame, counts: DataFrame, names: list[str], n: str, op: str) -> DataFrame:
        """Of left's values of `names`, keys and a value last: the sum of the counts n of equal keys whose value stands in op to it, where there are any."""
        (*keys, value), side, weight = names, self.ctx.fresh("side"), self.ctx.fresh("weight")
        counts = counts.select(*names, n, F.lit(op in ("<", ">")).alias(side))
        points = left.select(*names).distinct().select(*names, F.lit(0).cast("long").alias(n), F.lit(op in ("<=", ">=")).alias(side))
        order = F.col(value).asc() if op in ("<", "<=") else F.col(value).desc()
        window = Window.partitionBy(*keys).orderBy(order, F.col(side)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = points.unionAll(counts).withColumn(weight, F.sum(n).over(window))
        return both.where((F.col(side) == (op in ("<=", ">="))) & (F.col(weight) > 0)).select(*names, F.col(weight).alias(n))

    def optional_counted(self, frame: Frame, found: Frame, alone: dict[str, str], test: A.Expr, read: set[str]) -> Frame | None:
        """optional(), each row once with the number of what it finds by equal nodes and one range; None where it is no such test or more is read than how many there are.

        read: the variables that are read later otherwise than in count().
        """
        ctx = self.ctx
        new = {k: v for k, v in found.vars.items() if k not in alone.values() and k not in frame.vars}
        pairs = [(frame.vars[v], found.vars[w]) for v, w in alone.items()]
        if not pairs or any(len(b.labels) > 1 for p in pairs for b in p) or any(x.kind != y.kind for x, y in pairs) or set(new) & read or any(not k.startswith("?") and not (isinstance(b, NodeVar) and len(b.labels) == 1) for k, b in new.items()):
            return None
        if not isinstance(test, A.Bin) or test.op not in _TURNED or test.op == "=" or any(isinstance(x, A.Subquery) for x in walk(test)):
            return None
        op, own, other = (test.op, test.left, test.right) if names_in(test.left) <= set(new) else (_TURNED[test.op], test.right, test.left)
        if not names_in(own) or not names_in(own) <= set(new) or names_in(other) & set(found.vars):
            return None
        names = [ctx.fresh("by") for _ in range(len(pairs) + 1)]
        left = frame.df.withColumns({c: e for c, e in zip(names, [*(F.col(x.key) for x, _ in pairs), Compiler(ctx, frame)(other)], strict=True)})
        right = found.df.withColumns({c: e for c, e in zip(names, [*(F.col(y.key) for _, y in pairs), Compiler(ctx, found)(own)], strict=True)}).where(_present(names))
        if left.schema[names[-1]].dataType != right.schema[names[-1]].dataType or not isinstance(right.schema[names[-1]].dataType, T.AtomicType):
            return None
        n, weight = ctx.fresh("n"), ctx.fresh("weight")
        counts = right.groupBy(*names).agg((F.sum(found.weight) if found.weight else F.count(F.lit(1))).alias(n))
        df = left.join(self.so_far(left.where(_present(names)), counts, names, n, op), names, "left")
        # a row that finds nothing stays, once; of what is found only that it is there is known
        df, bound = df.withColumn(weight, F.coalesce(F.col(n), F.lit(1)) * (F.col(frame.weight) if frame.weight else F.lit(1))), {}
        for k, b in new.items():
            if isinstance(b, NodeVar) and len(b.labels) == 1:
                key, label = ctx.fresh(k), ctx.fresh(k)
                df = df.withColumns({key: F.when(F.col(n).isNotNull(), F.lit(0).cast(b.kind)), label: F.when(F.col(n).isNotNull(), F.lit(b.labels[0]))})
                bound[k] = replace(b, key=key, label=label, props=None)
        return replace(frame, df=df.drop(*names, n), vars=frame.vars | bound, weight=weight)

    def counted(self, frame: Frame, pattern: Pattern, r: Rel, bound: set[str], rels: list[Rel], read: set[str]) -> bool:
        """Whether only the number of r's edges at each bound node matters: neither r nor its other end is read again, and nothing is tested."""
        far = pattern.nodes[r.right if r.left in bound else r.left]
        free = far.name not in bound and far.name not in {n for x in rels for n in (x.left, x.right)} and not {r.name, far.name} & read
        plain = not any(n.tests for n in pattern.nodes.values()) and not any(x.tests for x in pattern.rels)
        return r.pattern.range is None and free and plain and not pattern.named

    def expand_degree(self, frame: Frame, pattern: Pattern, r: Rel, bound: set[str]) -> Frame:
        """expand(), where the edges are counted by their near ends first: a row of the frame stays one, and its weight is multiplied."""
        a, b = (r.left, r.right) if r.left in bound else (r.right, r.left)
        way = r.pattern.direction if r.left in bound or r.pattern.direction == "both" else {"out": "in", "in": "out"}[r.pattern.direction]
        var = frame.vars[a]
        e = edges(self.ctx, r.name, r.tables, way, pattern.nodes[a].labels, pattern.nodes[b].labels)
        n, weight = self.ctx.fresh("degree"), self.ctx.fresh("weight")
        on = self.ctx.equal(F.col(var.key), var.kind, F.col(e.near), e.near_kind)
        keys = [e.near]
        if len(var.labels) > 1 or len(e.near_labels) > 1:
            on &= F.col(var.label) == F.col(e.near_label)
            keys.append(e.near_label)
        degrees = e.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
        df = frame.df.join(degrees, on).withColumn(weight, F.col(n) * (F.col(frame.weight) if frame.weight else F.lit(1)))
        return replace(frame, df=df, weight=weight)

    # paths
    def expand_path(self, frame: Frame, pattern: Pattern, r: Rel, bound: set[str], counts: bool = False, merged: bool = False) -> Frame:
        """counts: only the number of rows matters besides what is read; merged: nothing of the frame is read."""
        ctx, spec = self.ctx, r.pattern.range
        forward = r.left in bound
        if not forward and ctx.uses.get(r.name, set()) & {"nodes", "rels", "relationships", "bare"}:
            frame = self.scan(frame, pattern.nodes[r.left])  # the path's order is seen
            bound.add(r.left)
            forward = True
        a, b = (r.left, r.right) if forward else (r.right, r.left)
        way = r.pattern.direction if forward or r.pattern.direction == "both" else {"out": "in", "in": "out"}[r.pattern.direction]
        high = ctx.max_hops if spec.high is None else spec.high
        if high > ctx.max_hops:
            raise BindFault(f"paths have at most {ctx.max_hops} hops")
        if spec.low > high:
            raise BindFault("a path's lower bound is over its upper one")
        # what a bare * means can be set; the modes that are written stand
        mode = str(ctx.settings.get("recursive_pattern_semantic", "walk")).lower() if spec.mode == "walk" else spec.mode
        short = "shortest" in mode
        if short and spec.low != 1:
            raise BindFault("shortest paths begin at 1 hop")
        near = tuple(dict.fromkeys([*pattern.nodes[a].labels, *(x for t in r.tables for x in (t.source, t.target))]))
        kind = ctx.kind(near)
        e = edges(ctx, r.name, r.tables, way, key_kind=kind)
        tests = [replace(t, left=A.Prop(A.Var(r.name), t.left.key)) for t in r.tests]
        edge_tests, node_tests = list(tests), []
        for t in conjuncts(spec.where):
            names = names_in(t) & {spec.rel_var, spec.node_var}
            if len(names) > 1:
                raise BindFault("a test within a path is of its relationships or of its nodes")
            (node_tests if names == {spec.node_var} else edge_tests).append(t)
        side = self.filter(Frame(e.df, {n: e.rel for n in (r.name, spec.rel_var) if n}), edge_tests)
        e = replace(e, df=side.df)
        used = ctx.uses.get(r.name, set())
        whole = "bare" in used or ("*" in ctx.uses and bool(r.pattern.var))
        wanted = Wanted(nodes=whole or bool(used & {"nodes", "is_acyclic"}), rels=whole or bool(used & {"rels", "relationships", "is_trail"}))
        compiled = Compiler(ctx, Frame(e.df, {r.name: e.rel}))
        ids = [compiled.id_of(F.col(k), F.col(lab), labels) for k, lab, labels in ((e.rel.src, e.rel.src_label, e.rel.ends[0]), (e.rel.dst, e.rel.dst_label, e.rel.ends[1]))]
        keep = spec.rel_keep
        rel = F.struct(
            F.col(e.rel.eid).alias("_ID"), F.col(e.rel.type).alias("_LABEL"), ids[0].alias("_SRC_ID"), ids[1].alias("_DST_ID"),
            F.col(e.rel.src).alias("_SRC_KEY"), F.col(e.rel.src_label).alias("_SRC_LABEL"), F.col(e.rel.dst).alias("_DST_KEY"), F.col(e.rel.dst_label).alias("_DST_LABEL"),
            *[F.col(c).alias(p) for p, c in e.rel.props.items() if keep is None or p in keep],
        )

        def node_frame(df) -> Frame:
            return ctx.hydrate(Frame(df, {"n": NodeVar(near, "t", "tl", kind=kind)}), "n")

        def node_of(df):
            f = node_frame(df)
            b = f.vars["n"]
            b = b if spec.node_keep is None else replace(b, props={p: c for p, c in b.props.items() if p in spec.node_keep})
            value = Compiler(ctx, f).value(b)
            return f.df.withColumn("node", value).drop(*f.vars["n"].props.values())

        def node_test(df):
            f = self.filter(Frame(df, {spec.node_var: NodeVar(near, "t", "tl", kind=kind)}), node_tests)
            return f.df.select(*df.columns)

        weight = e.rel.props.get(spec.weight) if spec.weight else None
        if spec.weight and weight is None:
            raise BindFault(f"no weight {spec.weight}")
        var = frame.vars[a]
        starts = frame.df.select(ctx.to(F.col(var.key), var.kind, kind).alias("s"), F.col(var.label).alias("sl")).where(F.col("s").isNotNull()).distinct()
        paths = Paths(replace(e, near_labels=near, far_labels=near), wanted, rel, node_of, node_test if node_tests else None, weight)
        if weight:
            found = paths.weighted(starts, mode.startswith("all"), self.targets(frame, starts, var, pattern.nodes[b], b in bound, kind), self.far(pattern.nodes[b], kind))
        elif short:
            found = paths.shortest(starts, high, mode.startswith("all"), self.targets(frame, starts, var, pattern.nodes[b], b in bound, kind))
        elif merged := merged and counts and mode == "walk" and wanted == Wanted() and b not in bound:
            n = F.count(F.lit(1)) if frame.weight is None else F.sum(frame.weight)
            begun = frame.df.select(ctx.to(F.col(var.key), var.kind, kind).alias("s"), F.col(var.label).alias("sl"), *([F.col(frame.weight)] if frame.weight else [])).where(F.col("s").isNotNull()).groupBy("s", "sl").agg(n.alias("n"))
            found = paths.walks(begun, spec.low, high, mode, True, True)
        else:
            found = paths.walks(starts, spec.low, high, mode, counts and mode == "walk" and wanted == Wanted())
        merged = merged and not weight and not short
        if paths.one_label:
            found = found.withColumns({"sl": F.lit(near[0]), "tl": F.lit(near[0])})
        names = {c: ctx.fresh(f"{r.name}_{c}") for c in found.columns}
        found = found.withColumnsRenamed(names)
        on = ctx.equal(F.col(var.key), var.kind, F.col(names["s"]), kind)
        if len(var.labels) > 1:
            on &= F.col(var.label) == F.col(names["sl"])
        there, closes = pattern.nodes[b], b in bound
        if closes:
            other = frame.vars[b]
            on &= ctx.equal(F.col(other.key), other.kind, F.col(names["t"]), kind)
            if not paths.one_label:
                on &= F.col(other.label) == F.col(names["tl"])
        path = PathVar(names["len"], names.get("nodes"), names.get("rels"), names.get("cost"))
        if merged:
            return self.arrive(Frame(found, {r.name: path}, [], names["n"]), there, names["t"], names["tl"], near, kind)
        out = replace(frame, df=frame.df.join(found, on), vars=frame.vars | {r.name: path})
        if "n" in names:
            weight = ctx.fresh("weight")
            out = replace(out, df=out.df.withColumn(weight, F.col(names["n"]) * (F.col(frame.weight) if frame.weight else F.lit(1))), weight=weight)
        return out if closes else self.arrive(out, there, names["t"], names["tl"], near, kind)

    def targets(self, frame: Frame, starts, start: NodeVar, there: Node, closes: bool, kind: str):
        """The pairs of ends that a shortest path is asked for, if they are bound already or the end is fixed by its key; else None."""
        if closes:
            other = frame.vars[there.name]
            return frame.df.select(self.ctx.to(F.col(start.key), start.kind, kind).alias("s"), F.col(start.label).alias("sl"), self.ctx.to(F.col(other.key), other.kind, kind).alias("t"), F.col(other.label).alias("tl")).where("s is not null and t is not null")
        if not self.fixed(there):
            return None
        found = self.scan(None, Node(there.name, there.labels, [t for t in there.tests if names_in(t) <= {there.name}]))
        end = found.vars[there.name]
        return starts.crossJoin(found.df.select(self.ctx.to(F.col(end.key), end.kind, kind).alias("t"), F.col(end.label).alias("tl")))  # a node a label at most

    def far(self, there: Node, kind: str):
        """The ends that a path's own tests pick; None if it has none."""
        own = [t for t in there.tests if names_in(t) <= {there.name}]
        if not own:
            return None
        found = self.scan(None, Node(there.name, there.labels, own))
        end = found.vars[there.name]
        return found.df.select(self.ctx.to(F.col(end.key), end.kind, kind).alias("t"), F.col(end.label).alias("tl"))

    def fixed(self, n: Node) -> bool:
        """Whether a test gives the node's key."""
        keys = {self.ctx.graph.node(x).key for x in n.labels}
        return any(isinstance(t, A.Bin) and t.op == "=" and isinstance(t.left, A.Prop) and t.left.key in keys and isinstance(t.right, (A.Lit, A.Param)) for t in n.tests)

    def name_path(self, frame: Frame, var: str, nodes: list[str], rels: list[str]) -> Frame:
        """p = (a)-[e]->(b): nodes and relationships as arrays of one struct type."""
        ctx = self.ctx
        if len(rels) == 1 and isinstance(frame.vars.get(rels[0]), PathVar):
            return frame.bind(**{var: frame.vars[rels[0]]})
        if any(isinstance(frame.vars[r], PathVar) for r in rels):
            raise BindFault("a named path of several parts has single edges only")
        for n in nodes:
            frame = ctx.hydrate(frame, n)
        compiled = Compiler(ctx, frame)
        keys = lambda bs: list(dict.fromkeys(p for b in bs for p in b.props))
        node_props, rel_props = keys([frame.vars[n] for n in nodes]), keys([frame.vars[r] for r in rels])

        def struct(name: str, props: list[str]) -> Column:
            b = frame.vars[name]
            head = ["_ID", "_LABEL"] if isinstance(b, NodeVar) else ["_ID", "_LABEL", "_SRC_ID", "_DST_ID"]
            kinds = {p: frame.df.schema[c].dataType for n in (nodes if isinstance(b, NodeVar) else rels) for p, c in frame.vars[n].props.items()}
            v = compiled.value(b)
            return F.struct(*[v[h].alias(h) for h in head], *[(F.col(b.props[p]) if p in b.props else F.lit(None).cast(kinds[p])).alias(p) for p in props])

        columns = {ctx.fresh(f"{var}_{k}"): c for k, c in (("len", F.lit(len(rels)).cast("long")), ("nodes", F.array(*[struct(n, node_props) for n in nodes])), ("rels", F.array(*[struct(r, rel_props) for r in rels])))}
        return frame.with_df(frame.df.withColumns(columns)).bind(**{var: PathVar(*columns)})

    # OPTIONAL MATCH, EXISTS and COUNT
    def inner(self, frame: Frame, paths: tuple[A.PathPattern, ...], where: A.Expr | None) -> tuple[Frame, list[Column], list[A.Expr], dict[str, str]]:
        """The pattern planned by itself; the join with the frame on the variables that both have; tests that need both."""
        shared = sorted({n.var for p in paths for n in p.nodes if n.var and isinstance(frame.vars.get(n.var), NodeVar)})
        alone: dict[str, str] = {v: self.ctx.hidden() for v in shared}
        renamed = [_rename(p, alone, {v: frame.vars[v].labels for v in shared}, self.ctx) for p in paths]
        local = {x.var for p in renamed for x in (*p.nodes, *p.rels) if x.var} | {p.var for p in renamed if p.var}
        own, both = [], []
        for t in conjuncts(where):
            t2 = _rename_expr(t, alone)
            props_outside = names_in(t) - set(alone) - local
            # a test of shared variables is made on either side; subqueries in it are planned inside
            (both if props_outside & set(frame.vars) else own).append(t2)
        found = self.plan(None, renamed, own)
        on = []
        for v, w in alone.items():
            x, y = frame.vars[v], found.vars[w]
            on.append(self.ctx.equal(F.col(x.key), x.kind, F.col(y.key), y.kind))
            if len(x.labels) > 1 or len(y.labels) > 1:
                on.append(F.col(x.label) == F.col(y.label))
        return found, on, both, alone

    def optional(self, frame: Frame | None, clause: A.Match, read: set[str] | None = None) -> Frame:
        ctx = self.ctx
        if frame is None:  # a query that begins with OPTIONAL MATCH has at least one row
            one = Frame(ctx.spark.range(1).select(F.lit(True).alias(ctx.fresh("one"))))
            frame = one
        found, on, both, alone = self.inner(frame, tuple(clause.paths), clause.where)
        for t in both:
            frame, found = self._ready_both(frame, found, t)
        if read is not None and len(both) == 1 and (out := self.optional_counted(frame, found, alone, both[0], read)):
            return out
        joined = Frame(frame.df, frame.vars | found.vars)
        condition = self._all([*on, *[Compiler(ctx, joined)(t) for t in both]])
        df = frame.df.join(found.df, condition, "left")
        fresh = {k: v for k, v in found.vars.items() if k not in alone.values() and k not in frame.vars}
        return replace(frame, df=df, vars=frame.vars | fresh)

    @staticmethod
    def _all(tests: list[Column]) -> Column:
        out = tests[0] if tests else F.lit(True)
        for t in tests[1:]:
            out &= t
        return out

    def _ready_both(self, frame: Frame, found: Frame, test: A.Expr) -> tuple[Frame, Frame]:
        for name in names_in(test):
            if name in found.vars:
                found = self.ready(found, *[x for x in [test] if name in names_in(x)]) if isinstance(found.vars[name], NodeVar) else found
            elif name in frame.vars:
                frame = self.ready(frame, test)
        return frame, found

    def semi(self, frame: Frame, sub: A.Subquery, negated: bool) -> Frame:
        found, on, both, _ = self.inner(frame, sub.paths, sub.where)
        for t in both:
            frame, found = self._ready_both(frame, found, t)
        joined = Frame(frame.df, frame.vars | found.vars)
        condition = self._all([*on, *[Compiler(self.ctx, joined)(t) for t in both]])
        return frame.with_df(frame.df.join(found.df, condition, "left_anti" if negated else "left_semi"))

    def flags(self, frame: Frame, expr) -> tuple[Frame, A.Expr]:
        """The frame with a column for each subquery of the expression, and the expression that reads these."""
        for sub in [x for x in walk(expr) if isinstance(x, A.Subquery)]:
            found, on, both, alone = self.inner(frame, sub.paths, sub.where)
            if both:
                raise BindFault("a subquery within an expression may share nodes only")
            keys = [found.vars[w] for w in alone.values()]
            columns = list(dict.fromkeys(c for k in keys for c in (k.key, k.label)))
            count, column, name = self.ctx.fresh("sub"), self.ctx.fresh("sub"), self.ctx.hidden()
            counted = found.df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))
            df = frame.df.join(counted, self._all(on), "left") if on else frame.df.crossJoin(counted)
            value = F.coalesce(F.col(count), F.lit(0)) if sub.kind == "count" else F.col(count).isNotNull() & (F.col(count) > 0)
            frame = frame.with_df(df.withColumn(column, value).drop(count, *columns)).bind(**{name: ValueVar(column)})
            expr = _swap(expr, sub, A.Var(name))
        return frame, expr


def _present(names: list[str]) -> Column:
    """That no column is null. dropna() would leave out NaN too, which is a number above all others."""
    return Matcher._all([F.col(c).isNotNull() for c in names])


def _apart(t: A.Expr) -> tuple[str, str] | None:
    """The two nodes that the test tells apart by their ids."""
    if isinstance(t, A.Bin) and t.op == "<>" and all(isinstance(x, A.Call) and x.name == "id" and len(x.args) == 1 and isinstance(x.args[0], A.Var) for x in (t.left, t.right)):
        return t.left.args[0].name, t.right.args[0].name
    return None


def _rename(p: A.PathPattern, names: dict[str, str], labels: dict[str, tuple[str, ...]], ctx: Context) -> A.PathPattern:
    nodes = tuple(
        replace(n, var=names[n.var], labels=tuple(x for x in labels[n.var] if not n.labels or x in n.labels) or n.labels, props=tuple((k, _rename_expr(v, names)) for k, v in n.props)) if n.var in names else n for n in p.nodes
    )
    return replace(p, nodes=nodes)


def _rename_expr(e, names: dict[str, str]):
    from dataclasses import fields, is_dataclass

    if isinstance(e, A.Var):
        return A.Var(names.get(e.name, e.name))
    if isinstance(e, A.NodePattern) and e.var in names:
        e = replace(e, var=names[e.var])
    if is_dataclass(e):
        return replace(e, **{f.name: _rename_expr(getattr(e, f.name), names) for f in fields(e)})
    return tuple(_rename_expr(x, names) for x in e) if isinstance(e, tuple) else [_rename_expr(x, names) for x in e] if isinstance(e, list) else e


def _swap(e, old, new):
    from dataclasses import fields, is_dataclass

    if e == old:
        return new
    if is_dataclass(e):
        return replace(e, **{f.name: _swap(getattr(e, f.name), old, new) for f in fields(e)})
    return tuple(_swap(x, old, new) for x in e) if isinstance(e, tuple) else [_swap(x, old, new) for x in e] if isinstance(e, list) else e
