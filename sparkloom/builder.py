"""Queries from Python: each step adds a clause, and the plan is the same as that of the text.

    from sparkloom.builder import query

    q = query().match("(a:person)-[:knows]->(b:person)").where("a.age > $least").returns("b.name AS name", "count(*) AS n").order_by("n DESC")
    session.run(q.build(), {"least": 30})
"""

from __future__ import annotations

from .cypher import ast as A
from .cypher.parser import Parser, SyntaxFault


def _part(text: str, rule: str):
    parser = Parser(text)
    out = getattr(parser, rule)()
    if parser.tok.kind != "end":
        raise SyntaxFault(f"the end expected in {text!r}")
    return out


class QueryBuilder:
    """A query under construction. Steps give new builders, so that a beginning can be used for several queries."""

    def __init__(self, clauses: tuple[A.Clause, ...] = (), before: tuple[tuple[A.Clause, ...], ...] = (), flags: tuple[bool, ...] = ()) -> None:
        self._clauses, self._before, self._flags = clauses, before, flags

    def _with(self, *clauses: A.Clause) -> QueryBuilder:
        return QueryBuilder((*self._clauses, *clauses), self._before, self._flags)

    def _changed(self, clause: A.Clause) -> QueryBuilder:
        return QueryBuilder((*self._clauses[:-1], clause), self._before, self._flags)

    def match(self, *patterns: str, optional: bool = False) -> QueryBuilder:
        return self._with(A.Match([_part(p, "path") for p in patterns], optional=optional))

    def optional_match(self, *patterns: str) -> QueryBuilder:
        return self.match(*patterns, optional=True)

    def where(self, text: str) -> QueryBuilder:
        """A further condition of the MATCH, WITH or LOAD FROM before it."""
        from dataclasses import replace

        last = self._clauses[-1]
        test = _part(text, "expr")
        return self._changed(replace(last, where=test if last.where is None else A.Bin("and", last.where, test)))

    def unwind(self, text: str, name: str) -> QueryBuilder:
        return self._with(A.Unwind(_part(text, "expr"), name))

    def load(self, *paths: str, **options) -> QueryBuilder:
        return self._with(A.LoadFrom(list(paths), options))

    @staticmethod
    def _projection(items: tuple[str, ...], distinct: bool) -> A.Projection:
        proj = _part(", ".join(items), "projection")
        proj.distinct = proj.distinct or distinct
        return proj

    def with_(self, *items: str, distinct: bool = False) -> QueryBuilder:
        return self._with(A.With(self._projection(items, distinct)))

    def returns(self, *items: str, distinct: bool = False) -> QueryBuilder:
        return self._with(A.Return(self._projection(items, distinct)))

    def _projected(self, **changes) -> QueryBuilder:
        from dataclasses import replace

        last = self._clauses[-1]
        if not isinstance(last, (A.With, A.Return)):
            raise SyntaxFault("ORDER BY, SKIP and LIMIT follow WITH or RETURN")
        return self._changed(replace(last, proj=replace(last.proj, **changes)))

    def order_by(self, *keys: str) -> QueryBuilder:
        return self._projected(order=_part("x ORDER BY " + ", ".join(keys), "projection").order)

    def skip(self, n: int) -> QueryBuilder:
        return self._projected(skip=A.Lit(n))

    def limit(self, n: int) -> QueryBuilder:
        return self._projected(limit=A.Lit(n))

    def union(self, other: QueryBuilder, all: bool = False) -> QueryBuilder:  # noqa: A002
        return QueryBuilder(other._clauses, (*self._before, self._clauses, *other._before), (*self._flags, all, *other._flags))

    def build(self) -> A.Query:
        return A.Query([list(b) for b in (*self._before, self._clauses)], list(self._flags))


def query() -> QueryBuilder:
    return QueryBuilder()
