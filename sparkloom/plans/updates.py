"""CREATE, SET, DELETE and MERGE: each puts new tables in the place of the graph's.

What is new or changed is written, not the table: few rows are joined to it by broadcast when it is read, and only many changes,
or a large one, write it anew.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import FEW, EdgeTable
from ..cypher import ast as A
from ..functions.expressions import Compiler
from ..storage import cut
from .frame import BindFault, Context, Frame, NodeVar, RelVar
from .match import Matcher


class Updates:
    def __init__(self, ctx: Context, matcher: Matcher) -> None:
        self.ctx, self.graph, self.matcher = ctx, ctx.graph, matcher

    # CREATE
    def create(self, frame: Frame, c: A.Create) -> Frame:
        frame = frame.with_df(cut(frame.df))
        for path in c.paths:
            frame, names = self.create_nodes(frame, path)
            for r, a, b in zip(path.rels, names, names[1:], strict=False):
                if r.direction == "both" or len(r.types) != 1:
                    raise BindFault("a new relationship has one type and a direction")
                a, b = (a, b) if r.direction == "out" else (b, a)
                self.create_edge(frame, r, a, b)
        return frame

    def create_nodes(self, frame: Frame, path: A.PathPattern) -> tuple[Frame, list[str]]:
        names = []
        for n in path.nodes:
            name = n.var or self.ctx.hidden()
            names.append(name)
            if name in frame.vars:
                continue
            if len(n.labels) != 1:
                raise BindFault("a new node has one label")
            table, given = self.graph.node(n.labels[0]), dict(n.props)
            if table.key not in given:
                raise BindFault(f"a new {table.label} needs its key {table.key}")
            if unknown := set(given) - set(table.properties):
                raise BindFault(f"{table.label} has no property {', '.join(sorted(unknown))}")
            frame = self.matcher.ready(frame, *given.values())
            compiled = Compiler(self.ctx, frame)
            new = cut(frame.df.select(*[(compiled(given[p]).cast(k) if p in given else self.graph.default(table.label, p, k)).alias(p) for p, k in table.properties.items()]))
            again = new.groupBy(table.key).count().where("count > 1")
            if not again.isEmpty() or not new.join(table.df, table.key, "left_semi").isEmpty():
                raise BindFault(f"a {table.label} of this key is there already")
            self.graph.put_nodes(table.label, table.df.unionByName(new), 0)
            key, label = self.ctx.fresh(f"{name}_key"), self.ctx.fresh(f"{name}_label")
            kind = self.ctx.kind((table.label,))
            columns = {key: compiled(given[table.key]).cast(kind), label: F.lit(table.label)}
            frame = frame.with_df(frame.df.withColumns(columns)).bind(**{name: NodeVar((table.label,), key, label, kind=kind)})
        return frame, names

    def create_edge(self, frame: Frame, r: A.RelPattern, a: str, b: str) -> None:
        for t in self.graph.triplets(r.types):
            x, y = frame.vars[a], frame.vars[b]
            if not (isinstance(x, NodeVar) and isinstance(y, NodeVar)) or t.source not in x.labels or t.target not in y.labels:
                continue
            given = dict(r.props)
            if unknown := set(given) - set(t.properties):
                raise BindFault(f"{t.type} has no property {', '.join(sorted(unknown))}")
            ready = self.matcher.ready(frame, *given.values())
            compiled = Compiler(self.ctx, ready)
            rows = ready.df.where((F.col(x.label) == t.source) & (F.col(y.label) == t.target) & F.col(x.key).isNotNull() & F.col(y.key).isNotNull())
            kinds = t.df.schema
            new = rows.select(F.col(x.key).cast(kinds[t.src].dataType).alias(t.src), F.col(y.key).cast(kinds[t.dst].dataType).alias(t.dst), *[(compiled(given[p]).cast(k) if p in given else self.graph.default(t.type, p, k)).alias(p) for p, k in t.properties.items()])
            self.graph.put_edges(t, t.df.unionByName(cut(new)), 0)

    @staticmethod
    def few(df: DataFrame) -> tuple[DataFrame, int]:
        """Written rows, to be broadcast if they are few; and their number."""
        n = df.count()
        return (F.broadcast(df) if n <= FEW else df), n

    def at(self, label: str, column: str, b: NodeVar):
        """Whether a table's column of the label's keys is the variable's key."""
        kind = self.ctx.kind((label,))
        return self.ctx.equal(F.col(f"`{column}`").cast(kind), kind, F.col("_key"), b.kind)

    # SET
    def set(self, frame: Frame, items: list[tuple[str, str, A.Expr]]) -> Frame:
        for var in dict.fromkeys(v for v, _, _ in items):
            b = frame.vars.get(var)
            changes = {p: e for v, p, e in items if v == var}
            frame = self.matcher.ready(frame, *changes.values())
            if isinstance(b, NodeVar):
                self.set_nodes(frame, frame.vars[var], changes)
            elif isinstance(b, RelVar):
                self.set_edges(frame, b, changes)
            else:
                raise BindFault(f"{var} is no node or relationship")
        # what the frame holds of the variables is old: it is read again
        return replace(frame, vars={v: replace(b, props=None) if isinstance(b, NodeVar) else b for v, b in frame.vars.items()})

    def set_nodes(self, frame: Frame, b: NodeVar, changes: dict[str, A.Expr]) -> None:
        compiled = Compiler(self.ctx, frame)
        columns = {f"_set_{p}": compiled(e) for p, e in changes.items()}
        rows = frame.df.where(F.col(b.key).isNotNull()).select(F.col(b.key).alias("_key"), F.col(b.label).alias("_of"), *[c.alias(n) for n, c in columns.items()])
        rows, n_rows = self.few(cut(rows.groupBy("_key", "_of").agg(*[F.first(n).alias(n) for n in columns])))
        for label in b.labels:
            table = self.graph.node(label)
            if table.key in changes:
                raise BindFault(f"{table.key} is the key of {label}")
            if unknown := set(changes) - set(table.properties):
                raise BindFault(f"{label} has no property {', '.join(sorted(unknown))}")
            joined = table.df.join(rows.where(F.col("_of") == label), self.at(label, table.key, b), "left")
            self.graph.put_nodes(label, joined.select(*[(F.when(F.col("_key").isNotNull(), F.col(f"_set_{p}").cast(k)).otherwise(F.col(f"`{p}`")) if p in changes else F.col(f"`{p}`")).alias(p) for p, k in table.properties.items()]), n_rows)

    def edge_tables(self, b: RelVar) -> list[EdgeTable]:
        return [t for t in self.graph.edges.values() if t.source in b.ends[0] and t.target in b.ends[1]]

    def set_edges(self, frame: Frame, b: RelVar, changes: dict[str, A.Expr]) -> None:
        compiled = Compiler(self.ctx, frame)
        columns = {f"_set_{p}": compiled(e) for p, e in changes.items()}
        rows = frame.df.where(F.col(b.eid).isNotNull()).select(F.col(b.eid).alias("_eid"), *[c.alias(n) for n, c in columns.items()])
        rows, n_rows = self.few(cut(rows.groupBy("_eid").agg(F.lit(True).alias("_hit"), *[F.first(n).alias(n) for n in columns])))
        for t in self.edge_tables(b):
            if set(changes) - set(t.properties):
                continue
            joined = self.with_id(t).join(rows, "_eid", "left")
            out = [(F.when(F.col("_hit"), F.col(f"_set_{f.name}").cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) if f.name in changes else F.col(f"`{f.name}`")).alias(f.name) for f in t.df.schema]
            self.graph.put_edges(t, joined.select(*out), n_rows)

    @staticmethod
    def with_id(t: EdgeTable) -> DataFrame:
        """The table with the ids that a traversal gives its edges."""
        return t.df.withColumn("_eid", F.xxhash64(F.lit(t.type), F.lit(t.source), F.lit(t.target), *[F.col(f"`{c}`") for c in t.df.columns]))

    # DELETE
    def delete(self, frame: Frame, c: A.Delete) -> Frame:
        frame = frame.with_df(cut(frame.df))
        nodes, rels = [v for v in c.vars if isinstance(frame.vars.get(v), NodeVar)], [v for v in c.vars if isinstance(frame.vars.get(v), RelVar)]
        if len(nodes) + len(rels) < len(c.vars):
            raise BindFault("only nodes and relationships are deleted")
        if c.detach and rels:
            raise BindFault("DETACH is for nodes")
        for v in rels:
            b = frame.vars[v]
            gone, n_gone = self.few(cut(frame.df.select(F.col(b.eid).alias("_eid")).where("_eid is not null").distinct()))
            for t in self.edge_tables(b):
                self.graph.put_edges(t, self.with_id(t).join(gone, "_eid", "left_anti").drop("_eid"), n_gone)
        for v in nodes:
            b = frame.vars[v]
            for label in b.labels:
                table = self.graph.node(label)
                gone, n_gone = self.few(cut(frame.df.where((F.col(b.label) == label) & F.col(b.key).isNotNull()).select(F.col(b.key).alias("_key")).distinct()))
                for t in list(self.graph.edges.values()):
                    for end, of in ((t.src, t.source), (t.dst, t.target)):
                        if of != label:
                            continue
                        t = self.graph.edges[t.source, t.type, t.target]
                        on = self.at(of, end, b)
                        if c.detach:
                            self.graph.put_edges(t, t.df.join(gone, on, "left_anti"), n_gone)
                        elif not t.df.join(gone, on, "left_semi").isEmpty():
                            raise BindFault(f"a {label} to be deleted has {t.type} edges: DETACH DELETE")
                self.graph.put_nodes(label, table.df.join(gone, self.at(label, table.key, b), "left_anti"), n_gone)
        return frame

    # MERGE
    def merge(self, frame: Frame | None, c: A.Merge) -> Frame:
        """Matches the path, and creates it for the rows that have no match."""
        if frame is None:
            found = self.matcher.plan(None, [c.path], [])
            if not found.df.isEmpty():
                return self.set(found, c.on_match) if c.on_match else found
            start = Frame(self.ctx.spark.range(1).select(F.lit(True).alias(self.ctx.fresh("one"))))
            made = self.create(start, A.Create([c.path]))
            return self.set(made, c.on_create) if c.on_create else made
        frame = frame.with_df(cut(frame.df))
        missing = self.matcher.semi(frame, A.Subquery("exists", (c.path,)), True)
        missing = missing.with_df(cut(missing.df))
        matched = self.matcher.plan(frame, [c.path], [])
        if c.on_match:
            self.set(matched.with_df(cut(matched.df)), c.on_match)
        if not missing.df.isEmpty():
            made = self.create(missing, A.Create([c.path]))
            if c.on_create:
                self.set(made, c.on_create)
        return self.matcher.plan(frame, [c.path], [])
