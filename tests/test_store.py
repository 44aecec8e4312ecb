"""The graphs and expectations of the end-to-end scenarios, on the mutable store."""

import json

import pytest

from trailweave.plans.errors import Busy, MissingParameter, UnknownIdentifier, Unsupported, WrongResultKind, WrongType
from trailweave.session import Session
from trailweave.sources.store import Store


@pytest.fixture
def session(spark, tmp_path):
    return Session(Store(spark, f"file://{tmp_path}/store"))


def rows(session, text, params=None):
    return [tuple(r) for r in session.execute(text, params).collect()]


def test_people(session):
    made = session.execute("INSERT (:Person {name: 'Ada', age: 30, active: TRUE}), (:Person {name: 'Bert', age: 41, active: FALSE}), (:Person {name: 'Cara', age: 42, active: TRUE})")
    assert made.rows_affected == 3
    assert rows(session, "MATCH (p:Person) RETURN p.name ORDER BY p.age DESC SKIP 1 LIMIT 1") == [("Bert",)]
    assert rows(session, "MATCH (p:Person) WHERE p.age >= 41 AND p.active RETURN p.name") == [("Cara",)]
    assert rows(session, "MATCH (p:Person) WHERE NOT p.active RETURN p.name") == [("Bert",)]
    assert rows(session, "MATCH (p) RETURN COUNT(*) AS n, SUM(p.age) AS s, AVG(p.age) AS a") == [(3, 113, pytest.approx(113 / 3))]
    assert session.execute("MATCH (p:Person) FINISH").rows_affected == 3
    assert json.loads(session.execute("MATCH (p:Person) FINISH").to_json()) == {"ok": True, "rows_affected": 3}
    with pytest.raises(WrongResultKind):
        session.execute("RETURN 1 AS x").rows_affected


def test_likes(session):
    session.execute("INSERT (a:User {name: 'Ada'}), (b:User {name: 'Bert'}), (f:Food {name: 'Pie', calories: 500}), (g:Food {name: 'Egg', calories: 90}), (a)-[:Likes]->(f), (a)-[:Likes]->(g)")
    assert sorted(rows(session, "MATCH (u:User), (f:Food) RETURN u.name, f.name")) == [("Ada", "Egg"), ("Ada", "Pie"), ("Bert", "Egg"), ("Bert", "Pie")]
    assert sorted(rows(session, "MATCH (u:User) OPTIONAL MATCH (u)-[l:Likes]->(f) WITH u, COUNT(l) AS n RETURN u.name, n")) == [("Ada", 2), ("Bert", 0)]
    assert rows(session, "MATCH (u:User) WHERE NOT (u)-[:Likes]->() RETURN u.name") == [("Bert",)]
    assert rows(session, "MATCH (u:User)-[:Likes]->(f:Food {calories: 90}) RETURN u.name, f.name") == [("Ada", "Egg")]
    assert session.execute("MATCH (u:User {name: 'Ada'}) DETACH DELETE u").rows_affected == 3
    assert rows(session, "MATCH (u)-[:Likes]->(f) RETURN COUNT(*) AS n") == [(0,)]


def test_self_loop_and_directions(session):
    session.execute("INSERT (a:Person {name: 'Ada'}), (b:Person {name: 'Bob'}), (a)-[:Knows]->(a), (a)-[:Knows]->(b)")
    assert rows(session, "MATCH (x:Person)-[:Knows]->(x) RETURN x.name") == [("Ada",)]
    assert rows(session, "MATCH (x)-[:Knows]-(y) RETURN COUNT(*) AS n") == [(4,)]
    session.execute("MATCH (b:Person {name: 'Bob'}) INSERT (b)~[:Near]~(b)")
    assert rows(session, "MATCH (x)~[:Near]~(y) RETURN COUNT(*) AS n") == [(1,)]


def test_chain(session):
    session.execute("INSERT (a:P {n: 'Ada'})-[:F]->(b:P {n: 'Bob'})-[:F]->(c:P {n: 'Cara'}), (a)-[:F]->(d:P {n: 'Dan'})")
    assert sorted(rows(session, "MATCH TRAIL (a:P {n: 'Ada'})-[:F]->{1,2}(x) RETURN x.n")) == [("Bob",), ("Cara",), ("Dan",)]
    got = session.execute("MATCH TRAIL (a:P {n: 'Ada'})-[e:F]->{2,2}(x) RETURN e, e[0] AS f, e[2] AS none").collect()
    assert len(got) == 1 and len(got[0]["e"]) == 2 and got[0]["none"] is None and got[0]["f"]["start"] is not None
    session.execute("MATCH (a:P {n: 'Ada'}) INSERT (a)~[:U]~(:P {n: 'Eve'})")
    assert rows(session, "MATCH TRAIL (a:P {n: 'Ada'})~[:U]~{2,2}(x) RETURN COUNT(*) AS n") == [(0,)]


def test_labels_and_properties(session):
    session.execute("INSERT (:Person {name: 'Ada'})-[:Knows {since: 2001}]->(:Person {name: 'Bob'})")
    assert session.execute("MATCH (p:Person) SET p:Employee").rows_affected == 2
    assert session.execute("MATCH (p:Person) SET p:Employee").rows_affected == 0
    assert rows(session, "MATCH (p:Employee) RETURN COUNT(*) AS n") == [(2,)]
    assert session.execute("MATCH (p {name: 'Ada'}) REMOVE p:Employee").rows_affected == 1
    assert session.execute("MATCH (p {name: 'Ada'}) REMOVE p:Employee").rows_affected == 0
    assert session.execute("MATCH (a)-[e:Knows]->(b) SET e.since = e.since + 1, b.age = 7, a.age = 'old'").rows_affected == 3
    assert rows(session, "MATCH (a)-[e:Knows {since: 2002}]->(b) WHERE a.age = 'old' AND b.age = 7 RETURN b.name") == [("Bob",)]
    shown = json.loads(session.execute("MATCH (a)-[e:Knows]->(b) RETURN e, a").to_json())
    assert shown[0]["e"]["properties"] == {"since": 2002} and shown[0]["e"]["directed"] is True
    assert shown[0]["a"]["labels"] == ["Person"] and len(shown[0]["a"]["id"]) == 16


def test_null_property_equals_missing(session):
    session.execute("INSERT (:X {a: 1}), (:X {a: NULL}), (:X)")
    assert rows(session, "MATCH (x:X {a: NULL}) RETURN COUNT(*) AS n") == [(2,)]


def test_parameters_and_errors(session):
    session.execute("INSERT (:Person {name: $name, age: $age})", {"name": "Ada", "age": 30})
    assert rows(session, "MATCH (p:Person {name: $n}) RETURN p.age", {"n": "Ada"}) == [(30,)]
    with pytest.raises(MissingParameter):
        session.execute("RETURN $x AS x")
    with pytest.raises(UnknownIdentifier):
        session.execute("INSERT (a) RETURN a").collect()
    with pytest.raises(Unsupported):
        session.execute("MATCH (p) RETURN p.age + COUNT(*) AS x")
    with pytest.raises(WrongType):
        session.execute("MATCH (p) WITH p.age AS p MATCH (p) RETURN 1 AS x")
    assert session.execute("").rows_affected == 0


def test_transactions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    one, two = Session(store), Session(store)
    one.execute("INSERT (:C {n: 1})")
    one.begin()
    two.begin()
    one.execute("MATCH (c:C) SET c.n = 2")
    assert rows(two, "MATCH (c:C) RETURN c.n") == [(1,)]
    one.commit()
    assert rows(two, "MATCH (c:C) RETURN c.n") == [(1,)]
    two.execute("MATCH (c:C) SET c.n = 3")
    with pytest.raises(Busy):
        two.commit()
    two.begin()
    two.execute("INSERT (:D)")
    one.execute("INSERT (:D)")
    two.commit()  # nothing in common: both are kept
    assert rows(one, "MATCH (d:D) RETURN COUNT(*) AS n") == [(2,)]
    one.begin()
    one.execute("MATCH (d) DETACH DELETE d")
    one.rollback()
    again = Session(Store(spark, f"file://{tmp_path}/store"))
    assert rows(again, "MATCH (x) RETURN COUNT(*) AS n") == [(3,)]


def test_edges_of_a_snapshot_are_not_derived(session):
    session.execute("INSERT (a:A {n: 1})-[:R]->(b:B {n: 2}), (a)-[:S]->(b), (:A {n: 3})")
    graph = session.source.begin().graph()
    assert [graph.derived(label) for label in (None, "R", "none")] == [False] * 3
    assert rows(session, "MATCH (a:A), (a)-[:R]->(b) RETURN a.n, b.n") == [(1, 2)]
    assert rows(session, "MATCH (a:A), (a)-[e]->(b) RETURN COUNT(*) AS n") == [(2,)]
