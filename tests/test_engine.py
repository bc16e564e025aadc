"""Operators of the engine on small frames, against plain Python where there is something to compare."""

import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.engine import Engine
from skein.errors import (
    BudgetExceeded, ConflictError, DeleteDenied, IdCollision, InvalidArgument, MigrationError, ObjectNotFound, PermissionDenied, QueryTypeError, SchemaError, TextQueryError, UniqueViolation,
)
from skein.operators import fulltext, links, migrate, vectors
from skein.operators.rules import Principal, Rules
from skein.plans.governor import Governor
from skein.plans.sdl import Schema
from skein.sources import export
from skein.sources.catalog import Catalog
from skein.sources.store import Store
from skein.streaming.changes import Subscription, change_stream, gaps, subscribe, wire_events

PERSON = Schema.parse("type Person { name: String  slug: String @unique  age: u32 @indexed  score: f64 @indexed  active: Bool @indexed  country: String @indexed  nick: String  rank: i64 }")
PEOPLE = [
    (1, "Ann", "Ann", 50, 1.5, True, "US", "a", 10), (2, "Bob", "Bob", 20, 2.5, True, "US", None, 20), (3, "Cy", "Cy", 60, 3.5, True, "CA", "c", 30), (4, "Dee", "Dee", 30, 4.5, True, "US", "d", 40),
    (5, "Eve", "Eve", 70, 5.5, False, "CA", None, 50), (6, "Fay", "Fay", 30, 2.5, True, None, "f", 60), (7, "Gus", "Gus", 40, 9.9, False, "UK", "g", 70), (8, "Hal", "Hal", 20, 1.5, True, "US", "h", 80),
]
COLUMNS = ["id", "name", "slug", "age", "score", "active", "country", "nick", "rank"]


@pytest.fixture(scope="module")
def people(spark):
    frame = spark.createDataFrame(PEOPLE, "id long, name string, slug string, age long, score double, active boolean, country string, nick string, rank long")
    return Engine(spark, Catalog(PERSON, {"Person": frame}))


SHAPES = {
    '.slug == "Cy"': lambda r: r["slug"] == "Cy",
    ".age == 30": lambda r: r["age"] == 30,
    ".age > 30 && .active == true": lambda r: r["age"] > 30 and r["active"],
    '.country == "US" && .age < 40': lambda r: r["country"] == "US" and r["age"] < 40,
    '.country == "US" || .country == "UK"': lambda r: r["country"] in ("US", "UK"),
    ".score >= 2.5 && .score < 5": lambda r: 2.5 <= r["score"] < 5,
    ".age > 29.5": lambda r: r["age"] > 29.5,
    ".score == 2": lambda r: False,
    '.nick != "a"': lambda r: r["nick"] not in (None, "a"),
    ".active != true": lambda r: not r["active"],
    ".active > false": lambda r: False,
    ".name == 42": lambda r: False,
    '.rank == "10"': lambda r: False,
    ".nick == null": lambda r: r["nick"] is None,
    ".nick != null": lambda r: r["nick"] is not None,
    '.name.contains("")': lambda r: True,
    '.name.contains("a") || .rank >= 70': lambda r: "a" in r["name"] or r["rank"] >= 70,
    '(.age == 20 || .age == 60) && .country != "CA"': lambda r: r["age"] in (20, 60) and r["country"] not in (None, "CA"),
}


@pytest.mark.parametrize("text", SHAPES)
def test_predicates_against_python(people, text):
    want = {r[0] for r in PEOPLE if SHAPES[text](dict(zip(COLUMNS, r, strict=True)))}
    assert {r.id for r in people.query(f"Person.filter({text})").collect()} == want


def test_order_with_limits(people):
    ids = lambda q: [r.id for r in people.query(q).collect()]
    for n in range(9):
        assert ids(f"Person.filter(.age >= 20).limit({n})") == [r[0] for r in sorted(PEOPLE, key=lambda r: (r[3], r[0]))][:n]
        assert ids(f"Person.filter(.age >= 20 && .rank > 0).limit({n})") == [r[0] for r in PEOPLE][:n]
    assert ids("Person.offset(6).limit(9)") == [7, 8]


def test_validation_and_missing(people):
    for bad in (".age.contains(\"x\")", '.nothing.contains("x")'):
        with pytest.raises(QueryTypeError):
            people.query(f"Person.filter({bad})")
    with pytest.raises(ObjectNotFound):
        people.query("Person.get(99)")
    for bad in ("Person.friends", 'Person.matches(.name, "x", k: 1)', "Person.similar(.name, [1], k: 1)", "Nobody"):
        with pytest.raises(InvalidArgument):
            people.query(bad)


def test_absent_fields_match_nothing(spark):
    schema = Schema.parse("type T { x: i64 m: Json b: Bytes d: DateTime f: f64 }")
    nan = float("nan")
    rows = [(1, ["x"], None, '{"a":1}', b"a", dt.datetime(1970, 1, 1), nan), (2, [], None, None, b"b", None, -0.0), (3, ["x"], 5, '{"a":1.0}', None, dt.datetime(1969, 12, 31, 23, 59, 50), 1.0)]
    e = Engine(spark, Catalog(schema, {"T": spark.createDataFrame(rows, "id long, _present array<string>, x long, m string, b binary, d timestamp_ntz, f double")}))
    ids = lambda p: [r.id for r in e.query(f"T.filter({p})").collect()]
    assert ids(".x == null") == [1] and ids(".x != null") == [3] and ids(".x != 4") == [3]
    plain = Engine(spark, Catalog(schema, {"T": e.catalog.frame("T").drop("_present")}))
    ids = lambda p: sorted(r.id for r in plain.query(f"T.filter({p})").collect())
    assert ids('.m == {"a": 1}') == [1] and ids('.m != {"a": 1}') == [3]
    assert ids(".f == 0") == [2] and ids(".f != 0") == [1, 3] and ids(".f > 0") == [3] and ids(".f < 9") == [2, 3]
    assert ids(".d < 0") == [3] and ids('.d == "1970-01-01T00:00:00Z"') == [1]
    assert ids(".b == null") == [3]
    for bad in (".m > 1", ".m.a == 1", '.b == "x"', ".b > null"):
        with pytest.raises(QueryTypeError):
            ids(bad)
    assert [r.id for r in plain.filter_bytes("T", "b", ">", b"a").collect()] == [2]


MOVIES = Schema.parse("""
type User     { name: String  email: String @unique  friends: [User] @on_delete(remove)  ratings: [Rating] @inverse(Rating.user) }
type Director { name: String  movies: [Movie] @inverse(Movie.director) }
type Movie    { title: String  year: u32 @indexed  director: Director @on_delete(remove)  ratings: [Rating] @inverse(Rating.movie)  tags: [Director] { weight: f64 } @on_delete(remove) }
type Rating   { user: User @on_delete(cascade)  movie: Movie @on_delete(deny)  stars: f32 }
""")


def _movies(spark, seed=42):
    rng = random.Random(seed)
    users = [(i, f"u{i}", f"u{i}@x") for i in range(1, 9)]
    directors = [(i, f"d{i}") for i in range(20, 23)]
    movies = [(i, f"m{i}", rng.randrange(1950, 2025), rng.choice([20, 21, 22, None])) for i in range(30, 40)]
    ratings = [(100 + n, u, m, round(rng.uniform(1, 5), 1)) for n, (u, m) in enumerate((u[0], m[0]) for u in users for m in rng.sample(movies, 3))]
    friends = sorted({(a, b) for a in range(1, 9) for b in rng.sample(range(1, 9), 2) if a != b})
    c = Catalog(
        MOVIES,
        {
            "User": spark.createDataFrame(users, "id long, name string, email string"), "Director": spark.createDataFrame(directors, "id long, name string"),
            "Movie": spark.createDataFrame(movies, "id long, title string, year long, director long"), "Rating": spark.createDataFrame(ratings, "id long, user long, movie long, stars float"),
        },
        {("User", "friends"): spark.createDataFrame(friends, "src long, dst long"), ("Movie", "tags"): spark.createDataFrame([], "src long, dst long, weight double")},
    )
    return c, users, movies, ratings, friends


def test_hops(spark):
    c, users, movies, ratings, friends = _movies(spark)
    e = Engine(spark, c)
    ids = lambda q: sorted(r.id for r in e.query(q).collect())
    mine = {m for _, u, m, _ in ratings if u == 3}
    assert ids("User.get(3).ratings.movie") == sorted(mine)
    assert ids("User.get(3).ratings.movie.ratings.user") == sorted({u for _, u, m, _ in ratings if m in mine})
    assert ids("User.get(3).ratings.movie.director") == sorted({m[3] for m in movies if m[0] in mine and m[3]})
    assert ids("User.get(3).friends.friends") == sorted({d for s, d in friends if s in {b for a, b in friends if a == 3}})
    assert ids("Director.get(20).movies.filter(.year > 1980)") == sorted(m[0] for m in movies if m[3] == 20 and m[2] > 1980)
    assert [r.id for r in e.query("User.get(3).ratings.movie.offset(1).limit(1)").collect()] == sorted(mine)[1:2]
    with pytest.raises(BudgetExceeded):
        Engine(spark, c, governor=Governor(max_depth=1)).query("User.get(3).ratings.movie")
    with pytest.raises(BudgetExceeded):
        Engine(spark, c, governor=Governor(max_rows=2)).collect("User")
    with pytest.raises(BudgetExceeded):
        Engine(spark, c, governor=Governor(max_scan=3)).query("User")


def test_link_reads(spark):
    schema = Schema.parse("type Label { name: String  messages: [Message] @inverse(Message.labels) } type Message { subject: String  thread: Thread @on_delete(remove)  labels: [Label] } type Thread { key: String  latest: DateTime }")
    at = lambda n: None if n is None else dt.datetime(1970, 1, 1) + dt.timedelta(seconds=n)
    threads = [(i, f"t{i}", at(n)) for i, n in enumerate([10, 30, None, 30, 20])]
    messages = [(10 + i, "s", i % 6 if i % 6 < 5 else None) for i in range(12)]
    c = Catalog(
        schema,
        {"Label": spark.createDataFrame([(99, "l")], "id long, name string"), "Message": spark.createDataFrame(messages, "id long, subject string, thread long"), "Thread": spark.createDataFrame(threads, "id long, key string, latest timestamp_ntz")},
        {("Message", "labels"): spark.createDataFrame([(m[0], 99) for m in messages], "src long, dst long")},
    )
    ids = spark.createDataFrame([(99,)], "id long")
    top = lambda **a: [r.id for r in links.link_peers_top(c, "Label", "messages", "thread", ids, "latest", **a).collect()]
    assert top(descending=True) == [3, 1, 4, 0, 2] and top(descending=False) == [0, 4, 1, 3, 2] and top(offset=1, limit=2, fields=["key"]) == [1, 4]
    assert {(r.id, r.peer) for r in links.link_peer_ids(c, "Label", "messages", "thread", ids).collect()} == {(m[0], m[2]) for m in messages}
    many = links.get_many(c, "Thread", spark.createDataFrame([(3,), (0,), (3,), (77,)], "id long"), ["key"])
    assert [tuple(r) for r in many.collect()] == [(0, "t0"), (3, "t3")]
    with pytest.raises(InvalidArgument):
        links.get_many(c, "Thread", ids, ["nothing"])


def test_writes(spark, tmp_path):
    c, *_ = _movies(spark)
    store = Store(spark, str(tmp_path / "db"))
    e = Engine(spark, store.commit(c, set(), 500), store=store)
    made = e.query('Movie.create({title: "new", year: 2001, director: 21})').collect()
    assert [(r.id, r.title) for r in made] == [(500, "new")]
    assert {r.id for r in e.query("Director.get(21).movies").collect()} >= {500}
    with pytest.raises(UniqueViolation):
        e.query('User.create_batch([{name: "a", email: "n@x"}, {name: "b", email: "u1@x"}])')
    assert e.count("User") == 8
    e.query('User.create_batch([{name: "a", email: "n@x"}, {name: "b", email: null}, {name: "c"}])')
    assert e.count("User") == 11
    with pytest.raises(UniqueViolation):
        e.query('User.filter(.name == "a").update({email: "u2@x"})')
    assert [r.title for r in e.query('Movie.get(500).update({title: "newer"})').collect()] == ["newer"]
    with pytest.raises(InvalidArgument):
        e.query("Movie.get(500).link(Director.get(20))")  # two relations lead there
    e.query("User.get(1).link(User.get(502))")
    e.query("User.get(1).link(User.get(502))")
    assert e.catalog.edges["User", "friends"].where("src = 1 and dst = 502").count() == 1
    e.query("User.get(1).unlink(User.get(502))")
    assert e.catalog.edges["User", "friends"].where("src = 1 and dst = 502").count() == 0
    with pytest.raises(DeleteDenied):
        e.query("Movie.filter(.title != \"newer\").delete()")
    e.query("Movie.get(500).delete()")
    e.query("User.get(3).delete()")
    assert e.query("Rating").join(e.catalog.frame("Rating").where("user = 3"), "id").count() == 0
    assert e.catalog.edges["User", "friends"].where("src = 3 or dst = 3").count() == 0
    e.query("Director.get(21).delete()")
    assert e.catalog.frame("Movie").where("director = 21").count() == 0 and e.count("Movie") == 10
    log = e.change_log().collect()
    assert {(r.kind, r.type) for r in log} >= {("create", "Movie"), ("update", "Movie"), ("delete", "User"), ("delete", "Rating")}
    again = Engine.open(spark, store.root)
    assert again.count("Movie") == 10 and again.next_id() == 504
    with pytest.raises(ConflictError):
        store.commit(store.load(1), set(), 0)
    Store(spark, store.root).backup(str(tmp_path / "copy"))
    back = Store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "db2"))
    assert back.load().frame("Movie").count() == 10
    with pytest.raises(ConflictError):
        Store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "db2"))
    assert back.compact().version == again.catalog.version + 1
    seen = []
    q = subscribe(change_stream(spark, f"{store.root}/changes"), Subscription("User", kinds=("delete",)), lambda df, n: seen.extend(wire_events(df).collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    assert [(r.kind, r.object_id) for r in seen] == [("delete", "3")]
    assert gaps(spark.createDataFrame([(2,), (3,), (6,)], "version long"), 1).collect()[0] == (3, 6)


def test_random_history(spark):
    """Links, unlinks, updates and deletes against sets in Python."""
    schema = Schema.parse("type A { v: i64  peers: [B] @on_delete(remove)  one: B @on_delete(remove) } type B { w: i64 }")
    c = Catalog(schema, {"A": spark.createDataFrame([(i, 0, None) for i in range(4)], "id long, v long, one long"), "B": spark.createDataFrame([(10 + i, 0) for i in range(4)], "id long, w long")}, {("A", "peers"): spark.createDataFrame([], "src long, dst long")})
    from skein.operators import mutate

    rng = random.Random(7)
    peers, one, values, bs = set(), {}, dict.fromkeys(range(4), 0), {10, 11, 12, 13}
    for step in range(12):
        ids = spark.createDataFrame([(rng.randrange(4),)], "id long")
        a = ids.first().id
        kind = rng.choice(["update", "edge", "edge", "one", "delete"] if len(bs) > 2 else ["update", "edge", "one"])
        b = rng.choice(sorted(bs))
        if kind == "update":
            c = mutate.update(c, "A", ids, {"v": step}).catalog
            values[a] = step
        elif kind == "one":
            c = mutate.update(c, "A", ids, {"one": b}).catalog
            one[a] = b
        elif kind == "edge":
            c.edges["A", "peers"] = c.edges["A", "peers"].unionByName(spark.createDataFrame([(a, b)], "src long, dst long")).distinct()
            peers.add((a, b))
        else:
            c = mutate.delete(c, "B", spark.createDataFrame([(b,)], "id long")).catalog
            bs.discard(b)
            peers = {p for p in peers if p[1] != b}
            one = {k: v for k, v in one.items() if v != b}
        c.objects["A"], c.edges["A", "peers"] = spark.createDataFrame(c.objects["A"].collect(), c.objects["A"].schema), spark.createDataFrame(c.edges["A", "peers"].collect(), "src long, dst long")
        c.objects["B"] = spark.createDataFrame(c.objects["B"].collect(), "id long, w long")
    assert {(r.src, r.dst) for r in c.edges["A", "peers"].collect()} == peers
    assert {r.id: (r.v, r.one) for r in c.objects["A"].collect()} == {k: (v, one.get(k)) for k, v in values.items()}
    assert {r.id for r in c.objects["B"].collect()} == bs


def _index(spark, texts, analyzer="simple", positions=True):
    return fulltext.build_index(spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string"), "text", analyzer, positions)


def _bm25(docs, terms):
    n, lens = len(docs), [len(d) for d in docs]
    avg = sum(lens) / n
    out = {}
    for t in terms:
        df = sum(t in d for d in docs)
        for i, d in enumerate(docs, 1):
            if tf := d.count(t):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[i - 1] / avg))
    return sorted(((i, s) for i, s in out.items()), key=lambda x: (-x[1], x[0]))


def test_full_text(spark):
    texts = ["Pay the invoice", "the invoice for the Invoice run", "milk and eggs", None, ""]
    idx = _index(spark, texts)
    assert tuple(idx.stats().first()) == (4, 12)
    docs = [t.lower().split() for t in texts if t is not None]
    got = [(r.id, r.score) for r in fulltext.search(idx, "invoice the", 9).collect()]
    want = _bm25(docs, ["invoice", "the"])
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(a[1] - b[1]) < 1e-5 for a, b in zip(got, want, strict=True))
    ids = lambda q, **a: [r.id for r in fulltext.search(a.pop("idx", idx), q, 9, **a).collect()]
    assert ids("+milk invoice") == [3] and ids('"the invoice"') == ids("+the +invoice") and ids('"invoice the"') == [] and ids("+run +milk") == []
    assert ids("invoice", candidates=spark.createDataFrame([(1,)], "id long")) == [1]
    prefix = _index(spark, ["camera", "cameras and a camera", "the campaign", "calm", "nothing here"])
    assert sorted(ids("cam*", idx=prefix)) == [1, 2, 3] and ids("+cam* +campaign", idx=prefix) == [3]
    english = _index(spark, ["security cameras", "tables and chairs", "state of the art"], "english")
    assert ids("cameras*", idx=english) == [1] and ids("tables*", idx=english) == [2] and ids('"state of the art"', idx=english) == [3] and ids('"state art"', idx=english) == [] and ids("of the", idx=english) == []
    for bad in ("", "!!", '"open', '"a b*"', "c*", "x" * 20_000, " ".join(f"w{i}" for i in range(300)), '"' + "w " * 40 + '"'):
        with pytest.raises(TextQueryError):
            ids(bad)
    many = _index(spark, [f"pre{i}" for i in range(70)])
    with pytest.raises(TextQueryError):
        ids("pre*", idx=many)
    with pytest.raises(TextQueryError):
        ids('"a b"', idx=_index(spark, ["a b"], positions=False))



def test_prefix_of_many_terms(spark):
    c = Catalog(Schema.parse("type A { t: String @fulltext }"), {"A": spark.createDataFrame([(i, f"pre{i} pre{i % 7}") for i in range(1, 201)], "id long, t string")})
    assert len(Engine(spark, c).query('A.matches(.t, "pre*", k: 500)').collect()) == 200
    with pytest.raises(TextQueryError):
        Engine(spark, c, governor=Governor(max_expansion=64)).query('A.matches(.t, "pre*", k: 500)')



def test_scores_that_round_to_the_same_go_by_id(spark):
    idx = _index(spark, [f"word {'x ' * (900 - i // 10)}" for i in range(100)])
    exact, rounded = ([(r.id, round(r.score, 4)) for r in fulltext.search(idx, "word", 20, digits=d).collect()] for d in (None, 4))
    scores = [(r.id, r.score) for r in fulltext.search(idx, "word", 100).collect()]
    assert rounded == sorted(((i, round(s, 4)) for i, s in scores), key=lambda r: (-r[1], r[0]))[:20]
    assert exact != rounded and [i for i, _ in exact] == [i for i, _ in scores[:20]]



@pytest.mark.parametrize("analyzer", ["simple", "english"])
def test_index_comes_in_small_batches(spark, analyzer, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(400))) for _ in range(1500)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "value"])
    made = list(fulltext.index_rows([batch, batch.slice(0, 0)], analyzer, True))
    words = [sum(b.column("tf").fill_null(0).to_pylist()) for b in made]
    assert len(made) > 4 and max(words) <= fulltext.SLICE_PLACES + 400 and sum(words) == sum(len(t.split()) for t in texts)
    monkeypatch.setattr(fulltext, "SLICE_PLACES", 1 << 40)
    whole = list(fulltext.index_rows([batch], analyzer, True))
    assert len(whole) == 1 and pa.Table.from_batches(made).combine_chunks().equals(pa.Table.from_batches(whole).combine_chunks())


def test_vectors(spark):
    schema = Schema.parse("type Doc { t: String  e: Vector<2> @index(hnsw, metric: l2) @vectorize(source: t, model: m) }")
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(1, 6)], "id long, t string")
    vec = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0, 0.0]), (4, [float("nan"), 0.0])], "id long, vec array<float>")
    e = Engine(spark, Catalog(schema, {"Doc": frame}, {}, {("Doc", "e"): vec}), embedders={"m": lambda texts: [[float(len(t)), 0.0] for t in texts]})
    rows = lambda q: [(r.id, r.score) for r in e.query(q).collect()]
    assert rows("Doc.similar(.e, [0, 0], k: 9)") == [(1, 0.0), (3, 1.0), (2, 25.0)] or sorted(rows("Doc.similar(.e, [0, 0], k: 9)")) == [(1, 0.0), (2, 25.0), (3, 1.0)]
    assert [r[0] for r in rows("Doc.similar(.e, [0, 0], k: 9).limit(2)")] == [1, 3]
    assert sorted(rows("Doc.filter(.id == 1 || .t != \"t1\").similar(.e, [3, 4], k: 9)"))[-1][1] == float("inf")
    assert [r[0] for r in rows('Doc.similar(.e, "t", k: 1)')] == [3]
    e.ctx.rerankers["m"] = lambda q, texts: [None if t == "t2" else float(t[1:]) for t in texts]
    got = [(r.id, r.rerank_score) for r in e.query('Doc.similar(.e, "t", k: 3).limit(3)').collect()]
    assert got == [(3, 3.0), (1, 1.0), (2, None)]
    with pytest.raises(QueryTypeError):
        e.query("Doc.similar(.e, [1], k: 1)")
    for bad in ([(9, [1.0])], [(9, [1.0, float("inf")])]):
        with pytest.raises(QueryTypeError):
            e.ingest_vectors("Doc", "e", spark.createDataFrame(bad, "id long, vec array<float>"))
    assert e.catalog.vectors["Doc", "e"].count() == 4
    assert {r.id for r in e.embed_missing("Doc", "e").collect()} in ({5}, set()) and e.catalog.vectors["Doc", "e"].count() == 5
    one = spark.range(1)
    d = lambda m, a, b: one.select(vectors.distance(F.array(*map(F.lit, a)), b, m)).first()[0]
    assert d("l2", [0.0, 0.0], [3, 4]) == 25 and d("cosine", [1.0, 0.0], [0, 1]) == 1 and d("cosine", [0.0, 0.0], [1, 1]) == 1 and d("dot", [1.0, 2.0], [3, 4]) == -11
    assert vectors.resolve(10).ef == 50 and vectors.resolve(10, restricted=True).pool == 40 and vectors.resolve(10, rerank=0, default_rerank=99).pool == 10 and vectors.resolve(99_999).ef == 10_000
    assert vectors.recall_at_k(frame.where("id < 3"), frame.where("id < 5")).first()[0] == 0.5
    assert vectors.rank_correlation(spark.createDataFrame([(1, 2), (2, 4), (3, 9)], "a int, b int"), "a", "b").first()[0] == pytest.approx(1.0)


RULED = Schema.parse("type User { uid: String role: String } type Org { name: String members: [User] } type Post { title: String published: Bool rank: i64 ownerUid: String tags: Json author: User editors: [User] }")


@pytest.mark.parametrize(
    "rule,who,want",
    [
        ("resource.published", Principal(), {1}),
        ("resource.published || request.auth.uid == resource.author.uid", Principal("u2"), {1, 2}),
        ("request.auth != null", Principal(), set()),
        ("request.auth != null", Principal("x"), {1, 2, 3, 4}),
        ("request.auth == null", Principal(), {1, 2, 3, 4}),
        ("request.auth.uid in resource.editors.uid", Principal("u1"), {1, 3}),
        ("!(request.auth.uid in resource.editors.uid)", Principal("u1"), {2, 4}),
        ("resource.ownerUid != 3", Principal(), {1, 2, 3}),
        ("resource.ownerUid == 3", Principal(), set()),
        ("resource.ownerUid != null", Principal(), {1, 2, 3}),
        ("resource.ownerUid == null", Principal(), set()),
        ("!(resource.ownerUid == \"u1\")", Principal(), {2, 3}),
        ("resource.rank >= 20 && resource.title != \"c\"", Principal(), {2, 4}),
        ("request.auth.claims.team.lead == true", Principal("x", {"team": {"lead": True}}), {1, 2, 3, 4}),
        ("resource.title in request.auth.claims.titles", Principal("x", {"titles": ["a", "d"]}), {1, 4}),
        ("request.auth.claims.missing != 1", Principal("x"), set()),
        ("null", Principal(), set()),
        ("\"text\"", Principal(), set()),
        ("resource.rank in resource.title", Principal(), set()),
    ],
)
def test_rules(spark, rule, who, want):
    users = spark.createDataFrame([(11, "u1", "r"), (12, "u2", "r")], "id long, uid string, role string")
    posts = spark.createDataFrame([(1, "a", True, 10, "u1", None, 11), (2, "b", False, 20, "u2", None, 12), (3, "c", None, 30, "u3", None, None), (4, "d", False, 40, None, None, 99)], "id long, title string, published boolean, rank long, ownerUid string, tags string, author long")
    edges = spark.createDataFrame([(1, 11), (1, 12), (2, 12), (3, 11)], "src long, dst long")
    c = Catalog(RULED, {"User": users, "Post": posts, "Org": spark.createDataFrame([], "id long, name string")}, {("Post", "editors"): edges, ("Org", "members"): edges.limit(0)})
    e = Engine(spark, c, f"match Post {{ allow read, update: if {rule}; }}")
    assert {r.id for r in e.query("Post", who).collect()} == want
    assert e.query("User", who).collect() == []
    if want and want != {1, 2, 3, 4}:
        with pytest.raises(PermissionDenied):
            e.query("Post", who)
            Engine(spark, c, f"match Post {{ allow read: if true; allow update: if {rule}; }}").query("Post.update({rank: 1})", who)


def test_rule_over_many_links(spark):
    users = spark.createDataFrame([(i, f"u{i}", "r") for i in range(3000)], "id long, uid string, role string")
    posts = spark.createDataFrame([(5000, "u7", True, 1, None, None, None), (5001, "u2500", True, 2, None, None, None), (5002, "u9", True, 3, None, None, None), (5003, None, True, 4, None, None, None)], "id long, title string, published boolean, rank long, ownerUid string, tags string, author long")
    edges = spark.range(2000).selectExpr("5000L as src", "id as dst").unionAll(spark.range(1000, 3000).selectExpr("5001L as src", "id as dst")).unionAll(spark.sql("select 5003L as src, 2500L as dst"))
    c = Catalog(RULED, {"User": users, "Post": posts}, {("Post", "editors"): edges})
    read = lambda rule, who: {r.id for r in Engine(spark, c, f"match Post {{ allow read: if {rule}; }}").query("Post", who).collect()}
    mine = "request.auth.uid in resource.editors.uid"
    assert read(mine, Principal("u1999")) == {5000, 5001} and read(mine, Principal("u3")) == {5000} and read(mine, Principal()) == set()
    assert read(f"!({mine})", Principal("u3")) == {5001, 5002, 5003} and read(f"!({mine})", Principal()) == set()
    assert read("resource.title in resource.editors.uid", Principal()) == {5000, 5001} and read("!(resource.title in resource.editors.uid)", Principal()) == {5002}
    assert read(f"{mine} && request.auth.claims.other in resource.editors.uid", Principal("u3", {"other": "u1999"})) == {5000}


def test_rule_refusals_and_create_gate(spark):
    for bad in ("match X { }", "match Post { allow fly: if true; }", "match Post { allow read: if resource.nope; }", "match Post { allow read: if resource.author; }", "match Post { allow read: if request.auth == 1; }", "match Post { allow read: if resource.editors.uid == 1; }", "match Post { allow read: if request.auth.name == 1; }", "match Post { allow read: if true }", "match Post {"):
        with pytest.raises(SchemaError):
            Rules.parse(bad, RULED)
    users = spark.createDataFrame([(11, "u1", "r")], "id long, uid string, role string")
    e = Engine(spark, Catalog(RULED, {"User": users}), "match User { allow create: if request.uid == request.auth.uid; }")
    with pytest.raises(PermissionDenied):
        e.query('User.create({uid: "z"})', Principal("y"))
    assert e.query('User.create({uid: "y"})', Principal("y")).collect() == []  # made, but not readable
    assert e.count("User") == 2


def test_export_round_trip(spark, tmp_path):
    schema = Schema.parse("type User { name: String @unique  age: u32  at: DateTime  raw: Bytes  posts: [Post] @inverse(Post.author)  buddy: User  embedding: Vector<2> } type Post { rating: f64 small: f32 author: User { weight: f32 } }")
    users = [(1, "a", 3, dt.datetime(2020, 1, 2, 3, 4, 5, 678000), b"\x00\xff", 2), (2, "b", None, None, None, 1)]
    posts = [(5, 0.1, 0.1, 1), (6, float("nan"), -0.0, None)]
    c = Catalog(
        schema, {"User": spark.createDataFrame(users, "id long, name string, age long, at timestamp_ntz, raw binary, buddy long"), "Post": spark.createDataFrame(posts, "id long, rating double, small float, author long")},
        {("Post", "author"): spark.createDataFrame([(5, 1, 0.3)], "src long, dst long, weight float")}, {("User", "embedding"): spark.createDataFrame([(1, [0.1, 2.0])], "id long, vec array<float>")},
    )
    export.export(c, str(tmp_path))
    back = export.read_export(spark, str(tmp_path))
    for n in ("User", "Post"):
        cols = c.frame(n).columns
        assert [str(r) for r in back.frame(n).select(cols).orderBy("id").collect()] == [str(r) for r in c.frame(n).orderBy("id").collect()]
    assert [tuple(r) for r in back.edges["Post", "author"].collect()] == [tuple(r) for r in c.edges["Post", "author"].collect()]
    assert [tuple(r) for r in back.vectors["User", "embedding"].collect()] == [tuple(r) for r in c.vectors["User", "embedding"].collect()]
    with pytest.raises(IdCollision):
        export.merge_import(c, back)
    export.export(c, str(tmp_path / "some"), ["Post"])
    assert export.read_export(spark, str(tmp_path / "some")).frame("Post").count() == 2


def test_migrations(spark):
    schema = Schema.parse("type T { x: String n: i32 }")
    c = Catalog(schema, {"T": spark.createDataFrame([(1, " 7 ", 1), (2, "1.5", 2), (3, None, None), (4, "+9", 4)], "id long, x string, n int")})
    with pytest.raises(MigrationError):
        migrate.change_field_type(c, "T", "x", "parse_string_as_i64")
    dry = migrate.change_field_type(c, "T", "x", "parse_string_as_i64", dry_run=True)
    assert (dry.total, dry.failed) == (4, 1) and dry.catalog is c
    skip = migrate.change_field_type(c, "T", "x", "parse_string_as_i64", "skip").catalog
    assert {r.id: r.x for r in skip.frame("T").collect()} == {1: 7, 2: None, 3: None, 4: 9} and skip.schema.types["T"].fields["x"].scalar == "i64"
    out = migrate.change_field_type(c, "T", "x", "parse_string_as_i64", "quarantine")
    assert out.catalog.frame("T").count() == 3 and [tuple(r) for r in out.bad.collect()] == [(2, "1.5")]
    more = migrate.evolve(c, Schema.parse("type T { x: String n: i32 y: f64 } type U { z: i32 }"))
    assert more.frame("T").where("y is null").count() == 4 and more.frame("U").count() == 0
    with pytest.raises(MigrationError):
        migrate.evolve(c, Schema.parse("type T { x: String }"))
    assert "n" not in migrate.evolve(c, Schema.parse("type T { x: String }"), allow_removal=True).frame("T").columns
    with pytest.raises(MigrationError):
        migrate.evolve(c, Schema.parse("type T { x: String n: i32 old: i32 }"), retired=frozenset({"T.old"}))
    with pytest.raises(MigrationError):
        migrate.evolve(c, Schema.parse("type T { x: i32 n: i32 }"))
    assert migrate.rename_field(c, "T", "x", "y").frame("T").columns == ["id", "y", "n"]
    assert "V" in migrate.rename_type(c, "T", "V").schema.types
    log = migrate.MigrationLog()
    steps = [("a", lambda c: migrate.rename_field(c, "T", "x", "y"))]
    done = log.apply(c, steps)
    assert log.apply(done, steps) is done and len(log.done) == 1
    with pytest.raises(MigrationError):
        log.apply(done, [("b", steps[0][1])])


def test_of_two_writers_one_wins(spark, tmp_path):
    """The loser's data and events are nowhere, also where both wrote at the same version."""
    schema = Schema.parse("type A { v: i64 }")
    frame = lambda v: spark.createDataFrame([(1, v)], "id long, v long")
    event = lambda v: spark.createDataFrame([("create", "A", v, None, "{}")], "kind string, type string, id long, origin long, fields string")
    root = str(tmp_path / "db")
    first, second = Store(spark, root), Store(spark, root)
    c = first.load()
    mine, theirs = (replace(c, schema=schema, objects={"A": frame(v)}) for v in (10, 20))
    create = first._create

    def late(name, text):  # the other writer commits between this one's data and its manifest
        second.commit(theirs, {"o:A"}, 2, event(20))
        create(name, text)

    first._create = late
    with pytest.raises(ConflictError):
        first.commit(mine, {"o:A"}, 2, event(10))
    assert [tuple(r) for r in Store(spark, root).load().frame("A").collect()] == [(1, 20)]
    assert [r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(first.publish()).collect()] == [20]
    assert not list((tmp_path / "db" / "pending").iterdir())


def test_events_of_a_lost_writer_are_published(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.publish = lambda: None  # lost after the manifest
    c = replace(store.load(), schema=Schema.parse("type A { v: i64 }"), objects={"A": spark.createDataFrame([(1, 5)], "id long, v long")})
    store.commit(c, {"o:A"}, 2, spark.createDataFrame([("create", "A", 1, None, "{}")], "kind string, type string, id long, origin long, fields string"))
    assert Engine.open(spark, str(tmp_path / "db")).change_log().count() == 1


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_vector_index_recall(spark, tmp_path, metric):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((40, 24)) * 3
    x = middles[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 24))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7000, None), (7001, [1.0])], "id long, vec array<float>")
    index = vectors.build_vector_index(rows, 24, metric, str(tmp_path / "index"))
    assert int(index.sizes.sum()) == 6000
    hit = 0
    for i in range(0, 6000, 600):
        plan = vectors.resolve(10, ef=40, rerank=60)
        assert sum(index.sizes[index.lists_for(x[i], plan.ef * vectors.ROWS_PER_EF)]) < 3500
        found = {r.id for r in vectors.search_index(index, x[i].tolist(), plan).collect()}
        gap = {"l2": ((x - x[i]) ** 2).sum(1), "dot": -(x @ x[i]), "cosine": -(x @ x[i]) / np.linalg.norm(x, axis=1)}[metric]
        hit += len(found & set(np.argsort(gap)[:10].tolist()))
    assert hit >= 95


def test_gaps_over_ranges(spark, monkeypatch):
    from skein.streaming import changes

    monkeypatch.setattr(changes, "GAP_RANGE", 4)
    seen = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 7, 8, 15, 16, 17, 30)], "version long")
    assert sorted(map(tuple, gaps(seen, 0).collect())) == [(4, 7), (8, 15), (17, 30)]


def test_text_index_is_kept_until_its_type_changes(spark):
    schema = Schema.parse("type A { t: String @fulltext }")
    e = Engine(spark, Catalog(schema, {"A": spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "id long, t string")}))
    assert [r.id for r in e.query('A.matches(.t, "red", k: 5)').collect()] == [1]
    kept = e.ctx.indexes["A", "t"]
    assert [r.id for r in e.query('A.matches(.t, "fox", k: 5)').collect()] == [1, 2] and e.ctx.indexes["A", "t"] is kept
    e.query('A.get(2).update({t: "red hen"})')
    assert sorted(r.id for r in e.query('A.matches(.t, "red", k: 5)').collect()) == [1, 2]
