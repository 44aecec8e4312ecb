"""What the grammar accepts, what it rejects, and the trees it makes."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trailweave.plans.errors import SyntaxProblem
from trailweave.plans.parser import parse
from trailweave.plans.tree import Agg, Bin, EdgeP, Index, Lit, NodeP, Not, Param, Prop, RowQuery, Var


def only(text):
    (statement,) = parse(text).statements
    return statement


def expr(text):
    return only(f"RETURN {text} AS x").ret.items[0].expr


def test_precedence():
    assert expr("1 + 2 * 3") == Bin("+", Lit(1), Bin("*", Lit(2), Lit(3)))
    assert expr("1 - 2 - 3") == Bin("-", Bin("-", Lit(1), Lit(2)), Lit(3))
    assert expr("TRUE OR FALSE AND NULL") == Bin("OR", Lit(True), Bin("AND", Lit(False), Lit(None)))
    assert expr("NOT a.b = 1") == Not(Bin("=", Prop("a", "b"), Lit(1)))
    assert expr("NOT a AND b") == Bin("AND", Not(Var("a")), Var("b"))
    assert expr("e[0]-2") == Bin("-", Index(Var("e"), Lit(0)), Lit(2))
    assert expr("COUNT(DISTINCT a.b) * $p") == Bin("*", Agg("count", Prop("a", "b"), True), Param("p"))


@pytest.mark.parametrize(
    "arrow, direction",
    [("<-[]-", "left"), ("-[]->", "right"), ("~[]~", "undirected"), ("<~[]~", "left_or_undirected"), ("~[]~>", "right_or_undirected"), ("<-[]->", "left_or_right"), ("-[]-", "any"), ("<-", "left"), ("->", "right"), ("~", "undirected"), ("<~", "left_or_undirected"), ("~>", "right_or_undirected"), ("<->", "left_or_right"), ("-", "any"), ("->[]->", "right")],
)
def test_directions(arrow, direction):
    assert only(f"MATCH (a){arrow}(b) FINISH").match.paths[0].edges == (EdgeP(direction),)


def test_arrows_and_comments():
    path = only("MATCH (a)<--(b) FINISH").match.paths[0]
    assert [e.direction for e in path.edges] == ["left", "any"] and path.nodes[1] == NodeP()
    with pytest.raises(SyntaxProblem):
        parse("MATCH (a)-->(b) RETURN a")  # the rest is a comment
    assert len(parse("RETURN 1 AS a // x\n; /* y */ RETURN 2 AS b -- z").statements) == 2


def test_strings_and_numbers():
    assert expr(r"'it''s' ") == Lit("it's")
    assert expr(r'"a\n\"b"') == Lit('a\n"b')
    assert expr(r"@'a\n'") == Lit("a\\n")
    assert expr("`x`") == Lit("x")
    assert expr("1.5e3") == Lit(1500.0)


def test_patterns():
    path = only("MATCH TRAIL PATH (a:A:B {k: 1, m: 'x'})-[e:R]->{1,3}(b) FINISH").match.paths[0]
    assert path.trail and path.nodes[0] == NodeP("a", "A", (("k", Lit(1)), ("m", Lit("x"))))
    assert path.edges[0] == EdgeP("right", "e", "R", (), (1, 3))
    assert only("MATCH -[:K]-> FINISH").match.paths[0].nodes == (NodeP(), NodeP())
    assert only("match (match) return match.return").ret.items[0].expr == Prop("match", "return")


def test_where_kinds():
    where = lambda t: only(f"MATCH (a) WHERE {t} FINISH").match.where
    assert where("(a)-[:R]->(b)").path is not None and not where("(a)-[:R]->(b)").negated
    assert where("NOT (a)-[:R]->()").negated
    assert where("(a.x + 1) * 2 = 4").expr is not None
    assert where("(a)").expr == Var("a")


def test_clauses():
    q = only("MATCH (a) OPTIONAL MATCH (a)->(b) WITH a, COUNT(b) AS n RETURN DISTINCT n ORDER BY n DESC, a ASC SKIP 2 LIMIT 3 LIMIT 4")
    assert isinstance(q, RowQuery) and len(q.clauses) == 3
    assert (q.ret.distinct, q.ret.skip, q.ret.limit, [d for _, d in q.ret.order]) == (True, 2, 4, [True, False])


@pytest.mark.parametrize(
    "text",
    ["MATCH (a)", "RETURN", "MATCH (a RETURN a", "MATCH (a)-[]->{2,1}(b) RETURN a", "MATCH (a)-[]->{2} RETURN a", "RETURN COUNT(DISTINCT *) AS x", "RETURN sum(*) AS x", "RETURN foo(1) AS x", "INSERT (a)-[:R]-(b)", "INSERT (a)-[:R]->", "MATCH (a) WITH a WHERE a RETURN a", "RETURN 1 LIMIT $n", "RETURN 'open", "RETURN 0x1F AS", "WITH 1 AS x RETURN x", "MATCH (a) WITH a SET a.x = 1"],
)
def test_rejected(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_error_text():
    with pytest.raises(SyntaxProblem) as caught:
        parse("MATCH (a)\nRETURN a,, b")
    assert str(caught.value) == "2:10: error: expected an expression\nRETURN a,, b\n         ^"


@given(st.text(max_size=40))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse(text)
    except SyntaxProblem as e:
        assert e.line >= 1


@given(st.text(max_size=30))
def test_string_round_trip(text):
    quoted = "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"
    assert expr(quoted) == Lit(text)
