import pytest

from sparkloom.cypher import ast as A
from sparkloom.cypher.parser import SyntaxFault, parse


def where(text):
    return parse(f"MATCH (a) WHERE {text} RETURN a").branches[0][0].where


def test_precedence():
    assert where("a.x + 2 * 3 = 7 AND NOT a.y OR a.z") == A.Bin(
        "or", A.Bin("and", A.Bin("=", A.Bin("+", A.Prop(A.Var("a"), "x"), A.Bin("*", A.Lit(2), A.Lit(3))), A.Lit(7)), A.Un("not", A.Prop(A.Var("a"), "y"))), A.Prop(A.Var("a"), "z")
    )


def test_range_is_no_decimal():
    rel = parse("MATCH (a)-[e:k*1..3]->(b) RETURN b").branches[0][0].paths[0].rels[0]
    assert (rel.range.low, rel.range.high, rel.range.mode, rel.direction) == (1, 3, "walk", "out")


@pytest.mark.parametrize(
    ("text", "mode", "low", "high"),
    [("*", "walk", 1, None), ("*2", "walk", 2, 2), ("*..4", "walk", 1, 4), ("*2..", "walk", 2, None), ("* TRAIL 1..2", "trail", 1, 2), ("*ACYCLIC 0..1", "acyclic", 0, 1), ("*SHORTEST 1..", "shortest", 1, None), ("* ALL SHORTEST 1..3", "all shortest", 1, 3), ("*WSHORTEST(w)", "wshortest", 1, None)],
)
def test_ranges(text, mode, low, high):
    r = parse(f"MATCH (a)-[e:k{text}]-(b) RETURN b").branches[0][0].paths[0].rels[0].range
    assert (r.mode, r.low, r.high) == (mode, low, high)


def test_pattern_or_parentheses():
    assert isinstance(where("(a)-[:k]->(b)"), A.Subquery)
    assert isinstance(where("(a.x) - (a.y) = 0"), A.Bin)
    assert isinstance(where("NOT (a)<-[:k]-()"), A.Un)


def test_comments_strings_and_quoted_names():
    q = parse("MATCH (a) /* all */ RETURN a.`odd name` AS x, 'it\\'s\\u0041' AS y // end")
    items = q.branches[0][-1].proj.items
    assert items[0].expr == A.Prop(A.Var("a"), "odd name")
    assert items[1].expr == A.Lit("it'sA")


@pytest.mark.parametrize("text", ["MATCH (a)", "MATCH (a) WHERE a.x != 1 RETURN a", "MATCH (a) WHERE 1 < a.x < 3 RETURN a", "RETURN", "MATCH (a)<-[e]->(b) RETURN a", "RETURN 1 garbage here", "CREATE NODE TABLE t (a INT64)"])
def test_faults(text):
    with pytest.raises(SyntaxFault):
        parse(text)


def test_statements():
    assert parse("CREATE REL TABLE k (FROM a TO b, FROM a TO c, w DOUBLE DEFAULT 1.0, MANY_ONE);").pairs == [("a", "b"), ("a", "c")]
    copy = parse("COPY p FROM ['a.csv', 'b.csv'] (header=true, delim='|')")
    assert (copy.source, copy.options) == (["a.csv", "b.csv"], {"header": True, "delim": "|"})
    assert parse("ALTER TABLE t DROP IF EXISTS x").lenient
    assert parse("CALL var_length_extend_max_depth = 10").kind == "set"
