"""Schema text, query text, literals."""

import pytest

from skein.errors import QuerySyntaxError, QueryTypeError, SchemaError
from skein.functions.literals import coerce, parse_datetime
from skein.plans import ast as A
from skein.plans.builder import F_, Q
from skein.plans.parser import parse_query
from skein.plans.sdl import Schema

SDL = """
type User { name: String @unique  age: u32 @indexed  friends: [User] @on_delete(remove)  posts: [Post] @inverse(Post.author) } // people
type Post { title: String @fulltext(analyzer: "english", positions: false)  author: User { weight: f32 } @on_delete(cascade)
            embedding: Vector<4> @index(hnsw, metric: l2, quantization: 3, m: 8) @vectorize(source: title, model: "m") }
"""


def test_schema_text_is_a_fixed_point():
    s = Schema.parse(SDL)
    again = Schema.parse(s.emit())
    assert again.emit() == s.emit() and again.digest() == s.digest()
    assert [t["name"] for t in s.describe()["types"]] == ["Post", "User"]
    assert s.types["Post"].fields["embedding"].index.metric == "l2"


@pytest.mark.parametrize(
    "text",
    [
        "type A { x: i32 } type A { y: i32 }", "type A { x: i32 x: i32 }", "type A { b__c: i32 }", "type A { r: B }", "type A { m: Json @indexed }", "type A { x: i32 @fulltext }",
        "type A { s: String @fulltext @fulltext }", "type A { s: String @index(hnsw) }", "type A { v: Vector<3> @index(hnsw, quantization: none) }", "type A { v: Vector<3> @index(hnsw, m: 0) }",
        "type A { v: Vector<3> @vectorize(source: t) }", "type A { s: String @vectorize(source: s) }", "type A { b: [B] @inverse(B.a) } type B { c: A }", "type A { s: String @shiny }", "type A { v: Vector<0> }",
    ],
)
def test_schema_refusals(text):
    with pytest.raises(SchemaError):
        Schema.parse(text)


def test_queries_parse():
    q = parse_query('User.filter(.age > 22 && (.name == "a\\"b" || .age <= 1e1)).friends.matches(.title, "x", k: 3,).limit(5)')
    assert isinstance(q.source, A.Filter) and q.source.predicate.left == A.Compare("age", ">", 22)
    assert q.source.predicate.right.right == A.Compare("age", "<=", 10.0)
    assert q.steps == (A.Traverse("friends"), A.Matches("title", "x", 3), A.Limit(5))
    assert parse_query('A.filter(.m == {"b": 1, "a": [2]})').source.predicate.value == A.Json('{"a":[2],"b":1}')
    assert parse_query("A.similar(.v, [1 2, -3.5], k: 2, ef: 10, rerank: 0)").steps[0] == A.Similar("v", (1.0, 2.0, -3.5), 2, 10, 0)
    assert parse_query('A.filter(.x == 1 or .y == 2 and .z == 3)').source.predicate == A.Or(A.Compare("x", "==", 1), A.And(A.Compare("y", "==", 2), A.Compare("z", "==", 3)))
    assert parse_query("A.offset(2).limit(1).b.offset(1)").steps[-1] == A.Offset(1)
    assert dict(parse_query("A.create({a: 1 a: 2 b: null})").source.fields) == {"a": 2, "b": None}


@pytest.mark.parametrize(
    "text",
    ["A.limit(1).offset(1)", "A.filter(.x == 1).limit(2).filter(.y == 1).offset(1)", "A.shine(1)", 'A.filter(.x == "a)', "A.get(-1)", "A.limit(-1)", "A.similar(.v, [1], k: 1, k: 2)", "A.similar(.v, [1], k: 1, ef: 0)", "A.similar(.v, [1])",
     "A.get(99999999999999999999)", "A trailing", "A.filter(.x = 1)", "A.filter(x == 1)", 'A.filter(.m == {"a": })', "A.similar(.v, [1], k: 1, wide: 2)", ".x"],
)
def test_query_refusals(text):
    with pytest.raises(QuerySyntaxError):
        parse_query(text)


def test_dates_and_coercion():
    assert parse_datetime("1970-01-01T00:00:01.2345Z") == 1234 and parse_datetime("1969-12-31T23:59:50Z") == -10_000
    assert parse_datetime("1970-01-01T02:00:00+02:00") == 0 and parse_datetime("soon") is None and parse_datetime("2024-02-30T00:00:00Z") is None
    assert coerce(1, "f64", "x") == 1.0 and coerce(None, "i32", "x") is None and coerce("aGk=", "Bytes", "x") == b"hi"
    for value, scalar in ((2**31, "i32"), (-1, "u32"), (1.5, "i64"), (True, "i32"), ("x", "Bool"), ("soon", "DateTime"), (A.Json("{}"), "String"), ("!", "Bytes")):
        with pytest.raises(QueryTypeError):
            coerce(value, scalar, "x")


def test_builder_makes_query_text():
    text = Q("User").filter((F_("age") > 22) & (F_("name") != 'a"b')).hop("friends").offset(1).limit(2).text()
    assert parse_query(text).steps == (A.Traverse("friends"), A.Offset(1), A.Limit(2))
    assert parse_query(Q("User").get(1).link("User", 2, w=1.5).text()).steps == (A.Link("User", 2, (("w", 1.5),)),)
    assert parse_query(Q("D").similar("v", [1, 2], 3, ef=9).text()).steps[0].ef == 9
