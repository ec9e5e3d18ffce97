"""A recursive-descent parser of the query language."""

from __future__ import annotations

import re
from typing import Any

from . import ast as A


class SyntaxFault(ValueError):
    """A text that is no query."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?(?!\.)|\d+)
    |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
    |(?P<name>[^\W\d]\w*|`[^`]+`)
    |(?P<param>\$\w+)
    |(?P<op>\.\.|<>|!=|<=|>=|=~|<<|>>|:=|[-+*/%^=<>()\[\]{}|,.:;&!])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_RESERVED = frozenset("match optional where return with union order skip limit unwind as and or xor not in starts ends contains is case when then else end distinct create set delete detach merge on call load hint yield asc desc ascending descending".split())


class _Tok:
    __slots__ = ("end", "kind", "low", "start", "text")

    def __init__(self, kind: str, text: str, start: int, end: int) -> None:
        self.kind, self.text, self.start, self.end = kind, text, start, end
        self.low = text.lower() if kind == "name" else text


def tokens(text: str) -> list[_Tok]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup or "", m[0]
        # `1..3` is a range, not the number 1. and .3
        if kind == "number" and value.startswith(".") and out and out[-1].text == ".":
            raise SyntaxFault(f"unexpected {value!r} at {at}")
        if kind == "name" and value[0] == "`":
            out.append(_Tok("quoted", value[1:-1], at, m.end()))
        elif kind != "space":
            out.append(_Tok(kind, value, at, m.end()))
        at = m.end()
    out.append(_Tok("end", "", at, at))
    return out


def _unquote(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "uU" and len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text[1:-1], flags=re.DOTALL)


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.toks, self.at = text, tokens(text), 0
        self.bars = True  # whether | is an operator here

    # tokens
    @property
    def tok(self) -> _Tok:
        return self.toks[self.at]

    def ahead(self, n: int = 1) -> _Tok:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def fault(self, wanted: str) -> SyntaxFault:
        return SyntaxFault(f"{wanted} expected at {self.tok.start}, found {self.tok.text or 'the end'!r}")

    def is_word(self, *words: str) -> bool:
        return all(self.ahead(k).kind == "name" and self.ahead(k).low == w for k, w in enumerate(words))

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fault(" ".join(words).upper())

    def is_op(self, op: str) -> bool:
        return self.tok.kind == "op" and self.tok.text == op

    def op(self, *ops: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in ops:
            self.at += 1
            return self.toks[self.at - 1].text
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            raise self.fault(repr(op))

    def name(self) -> str:
        if self.tok.kind not in ("name", "quoted"):
            raise self.fault("a name")
        self.at += 1
        return self.toks[self.at - 1].text

    def string(self) -> str:
        if self.tok.kind != "string":
            raise self.fault("a string")
        self.at += 1
        return _unquote(self.toks[self.at - 1].text)

    # statements
    def statement(self) -> Any:
        if self.word("explain") or self.word("profile"):
            out: Any = A.Admin("explain", [self.statement()])
        elif self.is_word("create", "node", "table") or self.is_word("create", "rel", "table"):
            out = self.create_table()
        elif self.word("drop", "table"):
            lenient = self.word("if", "exists")
            out = A.DropTable(self.name(), lenient)
        elif self.word("alter", "table"):
            out = self.alter_table()
        elif self.is_word("copy"):
            out = self.copy()
        elif self.word("checkpoint"):
            out = A.Admin("checkpoint")
        elif self.is_word("begin") or self.is_word("commit") or self.is_word("rollback"):
            out = A.Admin("transaction", [self.name().lower()])
            while self.tok.kind == "name":
                self.name()
        elif self.is_word("install") or self.is_word("uninstall") or (self.is_word("load") and not self.is_word("load", "from") and not self.is_word("load", "with")):
            out = A.Admin("extension", [self.name().lower()])
            self.word("extension")
            out.args.append(self.name() if self.tok.kind == "name" else self.string())
        elif self.is_word("call") and self.ahead().kind == "name" and self.ahead(2).text == "=":
            self.at += 1
            key = self.name()
            self.need("=")
            out = A.Admin("set", [key, self.expr()])
        else:
            out = self.query()
        self.op(";")
        if self.tok.kind != "end":
            raise self.fault("the end")
        return out

    def create_table(self) -> Any:
        self.need_word("create")
        node = self.word("node", "table")
        if not node:
            self.need_word("rel", "table")
        lenient = self.word("if", "not", "exists")
        label = self.name()
        self.need("(")
        columns: list[tuple[str, str, A.Expr | None]] = []
        pairs: list[tuple[str, str]] = []
        key = multiplicity = None
        while True:
            if node and self.word("primary", "key"):
                self.need("(")
                key = self.name()
                self.need(")")
            elif not node and self.is_word("from"):
                self.at += 1
                a = self.name()
                self.need_word("to")
                pairs.append((a, self.name()))
            elif not node and self.tok.low in ("many_many", "many_one", "one_many", "one_one", "many_to_many", "many_to_one", "one_to_many", "one_to_one"):
                multiplicity = self.name()
            else:
                column = self.name()
                kind = self.type_name()
                default = self.expr() if self.word("default") else None
                if self.word("primary", "key"):
                    key = column
                columns.append((column, kind, default))
            if not self.op(","):
                break
        self.need(")")
        if node:
            if key is None:
                raise SyntaxFault("a node table has a primary key")
            return A.CreateNodeTable(label, columns, key, lenient)
        return A.CreateRelTable(label, pairs, columns, multiplicity, lenient)

    def type_name(self) -> str:
        out = self.name().upper()
        if self.op("("):
            depth = 1
            out += "("
            while depth:
                if self.tok.kind == "end":
                    raise self.fault("')'")
                depth += {"(": 1, ")": -1}.get(self.tok.text, 0)
                out += self.tok.text
                self.at += 1
        while self.op("["):
            if self.tok.kind == "number":
                self.at += 1
            self.need("]")
            out += "[]"
        return out

    def alter_table(self) -> A.AlterTable:
        label = self.name()
        if self.word("add"):
            lenient = self.word("if", "not", "exists")
            name, kind = self.name(), self.type_name()
            return A.AlterTable(label, "add", name, kind, self.expr() if self.word("default") else None, lenient)
        if self.word("drop"):
            lenient = self.word("if", "exists")
            return A.AlterTable(label, "drop", self.name(), lenient=lenient)
        self.need_word("rename")
        if self.word("to"):
            return A.AlterTable(label, "rename table", to=self.name())
        name = self.name()
        self.need_word("to")
        return A.AlterTable(label, "rename", name, self.name())

    def copy(self) -> Any:
        self.need_word("copy")
        if self.op("("):
            query = self.query()
            self.need(")")
            self.need_word("to")
            return A.CopyTo(query, self.string(), self.options())
        label = self.name()
        columns = None
        if self.op("("):
            columns = [self.name()]
            while self.op(","):
                columns.append(self.name())
            self.need(")")
        self.need_word("from")
        return A.CopyFrom(label, self.source(), self.options(), columns)

    def source(self) -> Any:
        if self.op("("):
            query = self.query()
            self.need(")")
            return query
        if self.op("["):
            paths = [self.string()]
            while self.op(","):
                paths.append(self.string())
            self.need("]")
            return paths
        return [self.string()]

    def options(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.is_op("("):
            self.at += 1
            while not self.op(")"):
                key = self.name().lower()
                if self.op("="):
                    value = self.expr()
                    out[key] = [i.value for i in value.items] if isinstance(value, A.ListLit) else value.value if isinstance(value, A.Lit) else value.name if isinstance(value, A.Var) else value
                else:
                    out[key] = True
                self.op(",")
        return out

    # queries
    def query(self) -> A.Query:
        branches, flags = [self.single()], []
        while self.word("union"):
            flags.append(self.word("all"))
            branches.append(self.single())
        return A.Query(branches, flags)

    def single(self) -> list[A.Clause]:
        out: list[A.Clause] = []
        while True:
            if self.word("optional", "match"):
                out.append(self.match(True))
            elif self.word("match"):
                out.append(self.match(False))
            elif self.word("unwind"):
                expr = self.expr()
                self.need_word("as")
                out.append(A.Unwind(expr, self.name()))
            elif self.is_word("load"):
                out.append(self.load())
            elif self.is_word("call"):
                out.append(self.call())
            elif self.word("with"):
                proj = self.projection()
                out.append(A.With(proj, self.expr() if self.word("where") else None))
            elif self.word("return"):
                out.append(A.Return(self.projection()))
                return out
            elif self.word("create"):
                out.append(A.Create(self.paths()))
            elif self.word("set"):
                out.append(A.SetProps(self.set_items()))
            elif self.is_word("delete") or self.is_word("detach"):
                detach = self.word("detach")
                self.need_word("delete")
                names = [self.name()]
                while self.op(","):
                    names.append(self.name())
                out.append(A.Delete(names, detach))
            elif self.word("merge"):
                path = self.path()
                on: dict[str, list] = {"match": [], "create": []}
                while self.word("on"):
                    kind = self.name().lower()
                    self.need_word("set")
                    on[kind] += self.set_items()
                out.append(A.Merge(path, on["match"], on["create"]))
            else:
                if not out or isinstance(out[-1], (A.Match, A.With, A.Unwind)):
                    raise self.fault("a clause")
                return out

    def match(self, optional: bool) -> A.Match:
        paths = self.paths()
        where = self.expr() if self.word("where") else None
        hint = None
        if self.word("hint"):
            hint, depth = [], 0
            while self.tok.kind in ("name", "quoted") and self.tok.low not in (_RESERVED - {"join"}) or self.tok.text in ("(", ")"):
                depth += {"(": 1, ")": -1}.get(self.tok.text, 0)
                if depth < 0:
                    break
                if self.tok.kind != "op" and self.tok.low not in ("join", "multi_join"):
                    hint.append(self.tok.text)
                self.at += 1
        return A.Match(paths, where, optional, hint)

    def load(self) -> A.LoadFrom:
        self.need_word("load")
        headers = None
        if self.word("with", "headers"):
            self.need("(")
            headers = []
            while not self.op(")"):
                column = self.name()
                headers.append((column, self.type_name()))
                self.op(",")
        self.need_word("from")
        source, options = self.source(), self.options()
        return A.LoadFrom(source, options, headers, self.expr() if self.word("where") else None)

    def call(self) -> A.Clause:
        self.need_word("call")
        if self.op("("):
            names = []
            while not self.op(")"):
                names.append(self.name())
                self.op(",")
            self.need("{")
            body = self.query()
            self.need("}")
            return A.CallUnion(names, body)
        name = self.name().lower()
        self.need("(")
        args = []
        while not self.op(")"):
            args.append(self.expr())
            self.op(",")
        where = self.expr() if self.word("where") else None
        yields = None
        if self.word("yield"):
            yields = []
            while True:
                column = self.name()
                yields.append((column, self.name() if self.word("as") else column))
                if not self.op(","):
                    break
        return A.CallTable(name, args, where, yields)

    def set_items(self) -> list[tuple[str, str, A.Expr]]:
        out = []
        while True:
            var = self.name()
            self.need(".")
            key = self.name()
            self.need("=")
            out.append((var, key, self.expr()))
            if not self.op(","):
                return out

    def projection(self) -> A.Projection:
        distinct = self.word("distinct")
        proj = A.Projection([], distinct=distinct)
        if self.op("*"):
            proj.star = True
            if self.op(","):
                self.items(proj)
        else:
            self.items(proj)
        if self.word("order", "by"):
            while True:
                expr = self.expr()
                up = not (self.word("desc") or self.word("descending"))
                if up and not self.word("asc"):
                    self.word("ascending")
                proj.order.append((expr, up))
                if not self.op(","):
                    break
        if self.word("skip"):
            proj.skip = self.expr()
        if self.word("limit"):
            proj.limit = self.expr()
        return proj

    def items(self, proj: A.Projection) -> None:
        while True:
            start = self.tok.start
            expr = self.expr()
            text = self.text[start : self.toks[self.at - 1].end]
            proj.items.append(A.Item(expr, self.name() if self.word("as") else None, text))
            if not self.op(","):
                return

    # patterns
    def paths(self) -> list[A.PathPattern]:
        out = [self.path()]
        while self.op(","):
            out.append(self.path())
        return out

    def path(self) -> A.PathPattern:
        var = None
        if self.tok.kind in ("name", "quoted") and self.ahead().text == "=":
            var = self.name()
            self.need("=")
        if self.is_op("(") and self.ahead().text == "(":
            self.need("(")
            inner = self.path()
            self.need(")")
            return A.PathPattern(inner.nodes, inner.rels, var)
        nodes, rels = [self.node()], []
        while self.is_op("-") or (self.is_op("<") and self.ahead().text == "-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return A.PathPattern(tuple(nodes), tuple(rels), var)

    def props(self) -> tuple[tuple[str, A.Expr], ...]:
        out = []
        if self.op("{"):
            while not self.op("}"):
                key = self.name()
                self.need(":")
                out.append((key, self.expr()))
                self.op(",")
        return tuple(out)

    def node(self) -> A.NodePattern:
        self.need("(")
        var = self.name() if self.tok.kind in ("name", "quoted") else None
        labels = []
        while self.op(":"):
            labels.append(self.name())
            while self.op("|"):
                self.op(":")
                labels.append(self.name())
        props = self.props()
        self.need(")")
        return A.NodePattern(var, tuple(labels), props)

    def rel(self) -> A.RelPattern:
        left = bool(self.op("<"))
        self.need("-")
        var, types, props, range_ = None, [], (), None
        if self.op("["):
            var = self.name() if self.tok.kind in ("name", "quoted") else None
            if self.op(":"):
                types.append(self.name())
                while self.op("|"):
                    self.op(":")
                    types.append(self.name())
            if self.op("*"):
                range_ = self.range()
            props = self.props()
            self.need("]")
        self.need("-")
        right = bool(self.op(">"))
        if left and right:
            raise self.fault("one direction")
        return A.RelPattern(var, tuple(types), "in" if left else "out" if right else "both", props, range_)

    def range(self) -> A.Range:
        mode, weight = "walk", None
        prefix = "all " if self.word("all") else ""
        if self.word("wshortest"):
            self.need("(")
            mode, weight = f"{prefix}wshortest", self.name()
            self.need(")")
        elif self.word("shortest"):
            mode = f"{prefix}shortest"
        elif prefix:
            raise self.fault("SHORTEST")
        elif self.word("trail"):
            mode = "trail"
        elif self.word("acyclic") or self.word("simple"):
            mode = "acyclic"
        else:
            self.word("walk")
        low, high = 1, None
        if self.tok.kind == "number":
            text = self.tok.text
            self.at += 1
            low = int(text)
            if self.op(".."):
                high = self.number() if self.tok.kind == "number" else None
            else:
                high = low
        elif self.op(".."):
            high = self.number() if self.tok.kind == "number" else None
        rel_var = node_var = where = rel_keep = node_keep = None
        if self.is_op("("):
            self.need("(")
            rel_var = self.name()
            self.need(",")
            node_var = self.name()
            while self.op("|"):
                if self.word("where"):
                    self.bars = False
                    where = self.expr()
                    self.bars = True
                else:
                    rel_keep = self.keep()
                    self.need(",")
                    node_keep = self.keep()
            self.need(")")
        return A.Range(mode, low, high, weight, rel_var, node_var, where, rel_keep, node_keep)

    def keep(self) -> tuple[str, ...]:
        self.need("{")
        out = []
        while not self.op("}"):
            expr = self.expr()
            if not isinstance(expr, A.Prop):
                raise self.fault("a property")
            out.append(expr.key)
            self.op(",")
        return tuple(out)

    def number(self) -> int:
        self.at += 1
        return int(self.toks[self.at - 1].text)

    # expressions, loosest first
    def expr(self) -> A.Expr:
        left = self.xor()
        while self.word("or"):
            left = A.Bin("or", left, self.xor())
        return left

    def xor(self) -> A.Expr:
        left = self.conj()
        while self.word("xor"):
            left = A.Bin("xor", left, self.conj())
        return left

    def conj(self) -> A.Expr:
        left = self.neg()
        while self.word("and"):
            left = A.Bin("and", left, self.neg())
        return left

    def neg(self) -> A.Expr:
        if self.word("not"):
            return A.Un("not", self.neg())
        return self.comparison()

    def comparison(self) -> A.Expr:
        left = self.bits(0)
        if self.op("!="):
            raise SyntaxFault("!= is no operator, write <>")
        found = self.op("=", "<>", "<", "<=", ">", ">=")
        if found:
            left = A.Bin(found, left, self.bits(0))
            if self.tok.text in ("=", "<>", "<", "<=", ">", ">="):
                raise SyntaxFault("comparisons can't be chained")
        return left

    _LEVELS = (("|",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("^",))

    def bits(self, level: int) -> A.Expr:
        if level == len(self._LEVELS):
            return self.unary()
        left = self.bits(level + 1)
        if level == 0 and not self.bars:
            return left
        while found := self.op(*self._LEVELS[level]):
            left = A.Bin(found, left, self.bits(level + 1))
        return left

    def unary(self) -> A.Expr:
        if self.op("-"):
            inner = self.unary()
            return A.Lit(-inner.value) if isinstance(inner, A.Lit) and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool) else A.Un("-", inner)
        out = self.postfix()
        if self.is_op("!") and self.ahead().text != "=":
            self.at += 1
            out = A.Un("!", out)
        return out

    def postfix(self) -> A.Expr:
        out = self.property()
        while True:
            if self.word("in"):
                out = A.Bin("in", out, self.property())
            elif self.op("["):
                if self.op(":"):
                    out = A.Slice(out, None, None if self.is_op("]") else self.expr())
                else:
                    first = self.expr()
                    if self.op(":"):
                        out = A.Slice(out, first, None if self.is_op("]") else self.expr())
                    else:
                        out = A.Index(out, first)
                self.need("]")
                while self.op("."):
                    out = A.Prop(out, self.name())
            elif self.word("starts", "with"):
                out = A.Bin("starts with", out, self.property())
            elif self.word("ends", "with"):
                out = A.Bin("ends with", out, self.property())
            elif self.word("contains"):
                out = A.Bin("contains", out, self.property())
            elif self.op("=~"):
                out = A.Bin("=~", out, self.property())
            elif self.word("is", "null"):
                out = A.IsNull(out, False)
            elif self.word("is", "not", "null"):
                out = A.IsNull(out, True)
            else:
                return out

    def property(self) -> A.Expr:
        out = self.atom()
        while self.is_op("."):
            self.at += 1
            out = A.Prop(out, "*" if self.op("*") else self.name())
        return out

    def is_pattern(self) -> bool:
        """Whether a path pattern with a relationship begins here."""
        depth, k = 0, 0
        while True:
            t = self.ahead(k)
            if t.kind == "end":
                return False
            depth += {"(": 1, ")": -1}.get(t.text, 0) if t.kind == "op" else 0
            k += 1
            if depth == 0:
                break
        a, b = self.ahead(k).text, self.ahead(k + 1).text
        inside = self.ahead()
        if not (inside.text == ")" or inside.text == ":" or inside.kind in ("name", "quoted") and self.ahead(2).text in (")", ":", "{")):
            return False
        c = self.ahead(k + 2).text
        return (a == "-" and (b == "[" or b == "-" and c in (">", "("))) or (a == "<" and b == "-" and c in ("[", "-"))

    def atom(self) -> A.Expr:
        t = self.tok
        if t.kind == "number":
            self.at += 1
            return A.Lit(float(t.text) if any(c in t.text for c in ".eE") else int(t.text))
        if t.kind == "string":
            return A.Lit(self.string())
        if t.kind == "param":
            self.at += 1
            return A.Param(t.text[1:])
        if t.kind == "op":
            if t.text == "(":
                if self.is_pattern():
                    return A.Subquery("exists", (self.path(),))
                self.at += 1
                inner = self.expr()
                self.need(")")
                return inner
            if t.text == "[":
                self.at += 1
                items = []
                while not self.op("]"):
                    items.append(self.expr())
                    self.op(",")
                return A.ListLit(tuple(items))
            if t.text == "{":
                self.at += 1
                fields = []
                while not self.op("}"):
                    key = self.string() if self.tok.kind == "string" else self.name()
                    self.need(":")
                    fields.append((key, self.expr()))
                    self.op(",")
                return A.StructLit(tuple(fields))
            raise self.fault("an expression")
        if t.kind == "quoted":
            return A.Var(self.name())
        if t.kind != "name":
            raise self.fault("an expression")
        if t.low in ("true", "false", "null") and self.ahead().text != "(":
            self.at += 1
            return A.Lit({"true": True, "false": False, "null": None}[t.low])
        if t.low == "case":
            return self.case()
        if t.low in ("exists", "count") and self.ahead().text == "{":
            self.at += 2
            self.need_word("match")
            inner = self.match(False)
            self.need("}")
            return A.Subquery(t.low, tuple(inner.paths), inner.where)
        if self.ahead().text == "(":
            return self.function()
        return A.Var(self.name())

    def case(self) -> A.Case:
        self.need_word("case")
        subject = None if self.is_word("when") else self.expr()
        whens = []
        while self.word("when"):
            condition = self.expr()
            self.need_word("then")
            whens.append((condition, self.expr()))
        default = self.expr() if self.word("else") else None
        self.need_word("end")
        return A.Case(subject, tuple(whens), default)

    def function(self) -> A.Expr:
        name = self.name().lower()
        self.need("(")
        if name == "count" and self.op("*"):
            self.need(")")
            return A.CountStar()
        if name in ("all", "any", "none", "single") and self.ahead().low == "in":
            var = self.name()
            self.need_word("in")
            over = self.expr()
            self.need_word("where")
            where = self.expr()
            self.need(")")
            return A.Quantifier(name, var, over, where)
        if name == "cast":
            of = self.expr()
            if self.word("as"):
                kind = self.type_name()
            else:
                self.need(",")
                kind = self.string().upper()
            self.need(")")
            return A.Cast(of, kind)
        distinct = self.word("distinct")
        args = []
        while not self.op(")"):
            args.append(self.argument())
            if not self.is_op(")"):
                self.need(",")
        return A.Call(name, tuple(args), distinct)

    def argument(self) -> A.Expr:
        if self.tok.kind in ("name", "quoted") and self.ahead().text == "-" and self.ahead(2).text == ">":
            var = self.name()
            self.at += 2
            return A.Lambda((var,), self.expr())
        if self.tok.kind == "name" and self.ahead().text == ":=":
            self.at += 2
        return self.expr()


def parse(text: str) -> Any:
    """The statement that the text holds."""
    return Parser(text).statement()
