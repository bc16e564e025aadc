"""The engine's own queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import Engine
from .operators import links, migrate, mutate
from .operators.rules import Principal
from .sources.export import export_counts
from .sources.paths import scratch
from .sources.star import star_catalog
from .streaming.changes import Subscription, change_stream, select_changes, wire_events

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_CUSTOMER = "c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment"
_ORDER = "o_orderkey AS id, o_orderstatus AS status, o_totalprice AS totalprice, o_orderdate AS orderdate, o_orderpriority AS priority"
_PART = "p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS ptype, p_size AS size, p_retailprice AS retailprice"
_SUPPLIER = "s_suppkey AS id, s_name AS name, s_acctbal AS acctbal"
_EVENT = "event_id AS id, date_trunc('millisecond', ts) AS ts, user_id, event_type, value, regexp_replace(props, '\": +', '\":', 'g') AS props"
_DOC = "doc_id AS id, lang, source, n_chars"


def engine(spark, folder: str, **more) -> Engine:
    return Engine(spark, star_catalog(spark, folder), **more)


def _text(name: str, query: str, sql: str | None, drop: tuple[str, ...] = (), **more) -> None:
    """Register a query of the language; ``drop``: result columns that the comparison leaves out."""
    QUERIES[name] = lambda spark, folder: engine(spark, folder, **more).query(query).drop(*drop)
    if sql is not None:
        ORACLE_SQL[name] = sql


_text(
    "flagship", 'Customer.filter(.mktsegment == "BUILDING" && .acctbal > 0).orders.filter(.totalprice > 150000)',
    f"SELECT {_ORDER} FROM orders WHERE o_totalprice > 150000 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 0)",
)
_text("get_point", "Customer.get(42)", f"SELECT {_CUSTOMER} FROM customer WHERE c_custkey = 42")
_text("list_all", "Nation", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
_text("filter_eq_and", 'Customer.filter(.mktsegment == "BUILDING" && .acctbal > 5000)', f"SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
_text("filter_or_paren", 'Part.filter((.size < 5 || .size >= 45) && .brand != "Brand#2")', f"SELECT {_PART} FROM part WHERE (p_size < 5 OR p_size >= 45) AND p_brand <> 'Brand#2'")
_text("filter_words", 'Part.filter(.size <= 10 and .retailprice > 950.5 or .size == 50)', f"SELECT {_PART} FROM part WHERE p_size <= 10 AND p_retailprice > 950.5 OR p_size = 50")
_text("filter_int_float", "Part.filter(.size > 44.5)", f"SELECT {_PART} FROM part WHERE p_size > 44.5")
_text("filter_datetime", 'Order.filter(.orderdate >= "1998-01-01T00:00:00Z")', f"SELECT {_ORDER} FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
_text("filter_datetime_offset", 'Order.filter(.orderdate < "1996-06-01T02:00:00+02:00")', f"SELECT {_ORDER} FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01'")
_text("filter_datetime_bad", 'Order.filter(.orderdate >= "soon")', f"SELECT {_ORDER} FROM orders WHERE false")
_text("filter_contains", 'Document.filter(.text.contains("ment"))', f"SELECT {_DOC} FROM documents WHERE contains(text, 'ment')", drop=("text",))
_text("filter_json_eq", 'Event.filter(.props == {"k": 69})', f"SELECT {_EVENT} FROM events WHERE regexp_replace(props, '\": +', '\":', 'g') = '{{\"k\":69}}'")
_text("filter_null", "Event.filter(.value == null)", f"SELECT {_EVENT} FROM events WHERE value IS NULL")
_text("filter_not_null", "Event.filter(.value != null)", f"SELECT {_EVENT} FROM events WHERE value IS NOT NULL")
_text("filter_type_mismatch", "Part.filter(.name == 42)", f"SELECT {_PART} FROM part WHERE false")
_text("filter_dotted_path", "Order.filter(.customer.id == 3)", f"SELECT {_ORDER} FROM orders WHERE false")
_text("indexed_range_limit", "Part.filter(.size > 40).limit(50)", f"SELECT {_PART} FROM part WHERE p_size > 40 ORDER BY p_size, p_partkey LIMIT 50")
_text("and_limit_by_id", 'Part.filter(.size > 40 && .retailprice > 0).limit(50)', f"SELECT {_PART} FROM part WHERE p_size > 40 AND p_retailprice > 0 ORDER BY p_partkey LIMIT 50")
_text("offset_limit", "Customer.filter(.acctbal > 0).offset(20).limit(10)", f"SELECT {_CUSTOMER} FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 10 OFFSET 20")
_text("hop_forward_one", 'Order.filter(.status == "P").customer', f"SELECT {_CUSTOMER} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_text("hop_inverse", "Nation.get(3).customers", f"SELECT {_CUSTOMER} FROM customer WHERE c_nationkey = 3")
_text(
    "hop2_inverse_forward", "Customer.get(7).orders.items.part",
    f"SELECT {_PART} FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7)",
)
_text(
    "hop2_self", "Part.get(9).items.supplier.items.part",
    f"SELECT {_PART} FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 9))",
)
_text(
    "hop3", "Region.get(1).nations.customers.orders",
    f"SELECT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
)
_text(
    "hop_then_filter", 'Region.get(2).nations.suppliers.filter(.acctbal > 1000).offset(2).limit(15)',
    f"SELECT {_SUPPLIER} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND s_acctbal > 1000 ORDER BY s_suppkey LIMIT 15 OFFSET 2",
)
_text("hop_labels", "Label.filter(.quality == 0).document", f"SELECT {_DOC} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)", drop=("text",))
# Batched forms of the single-object benchmarks: the same hops for every object at once.
_text("bench_all_lookups", 'Customer.filter(.acctbal > -2000)', f"SELECT {_CUSTOMER} FROM customer WHERE c_acctbal > -2000")
_text("bench_hop1_all", 'Customer.filter(.mktsegment == "MACHINERY").orders', f"SELECT {_ORDER} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
_text(
    "bench_hop2_all", 'Customer.filter(.mktsegment == "MACHINERY").orders.items.supplier',
    f"SELECT {_SUPPLIER} FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY')",
)
_text(
    "bench_hop3_all", "Supplier.filter(.acctbal > 5000).items.order.customer",
    f"SELECT {_CUSTOMER} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 5000)",
)

# Vectors: the query is a fixed vector of 64 numbers.
_Q = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
_QS = "[" + ", ".join(str(x) for x in _Q) + "]"
_QD = _QS + "::DOUBLE[]"
_V = "embedding::DOUBLE[]"


def _similar(name: str, query: str, distance: str, where: str = "true", k: int = 10) -> None:
    QUERIES[name] = lambda spark, folder: engine(spark, folder).query(query).select("id", "label", F.round(F.col("score").cast("double"), 3).alias("score"))
    ORACLE_SQL[name] = f"SELECT vec_id AS id, label, round({distance}, 3) AS score FROM embeddings WHERE {where} ORDER BY {distance}, vec_id LIMIT {k}"


_similar("similar_cosine", f"Item.similar(.vec, {_QS}, k: 10)", f"1 - list_cosine_similarity({_V}, {_QD})")
_similar("similar_l2", f"Near.similar(.vec, {_QS}, k: 10, ef: 100)", f"power(list_distance({_V}, {_QD}), 2)")
_similar("similar_dot", f"Dot.similar(.vec, {_QS}, k: 10, rerank: 50)", f"-list_inner_product({_V}, {_QD})")
_similar("similar_filtered", f"Item.filter(.label == 3).similar(.vec, {_QS}, k: 7)", f"1 - list_cosine_similarity({_V}, {_QD})", "label = 3", 7)

# Full text over turns: words with their positions in SQL. Joined by a point or apostrophe between letters or between
# digits, words are one; marks of such joins are kept apart as private characters until the words are cut.
_JOIN = "coalesce(text, '')"
for _ in range(2):
    _JOIN = f"regexp_replace({_JOIN}, '(\\p{{L}})[.]([\\p{{L}}])', '\\1\ue001\\2', 'g')"
    _JOIN = f"regexp_replace({_JOIN}, '([0-9])[.]([0-9])', '\\1\ue001\\2', 'g')"
    _JOIN = f"regexp_replace({_JOIN}, '([0-9])[,]([0-9])', '\\1\ue002\\2', 'g')"
    _JOIN = f"regexp_replace({_JOIN}, '(\\p{{L}})['']([\\p{{L}}])', '\\1\ue003\\2', 'g')"
    _JOIN = f"regexp_replace({_JOIN}, '(\\p{{L}})[:]([\\p{{L}}])', '\\1\ue004\\2', 'g')"
_TOKENS = f"""
  words AS (SELECT conv_id * 10000 + turn AS id, role, list_filter(regexp_extract_all({_JOIN}, '[\\p{{L}}\\p{{N}}_\ue001\ue002\ue003\ue004]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS w FROM conversations WHERE text IS NOT NULL),
  tok AS (SELECT id, role, len(w) AS len, unnest(w) AS raw, generate_subscripts(w, 1) - 1 AS pos FROM words),
  tokens AS (SELECT id, role, len, pos, translate(strip_accents(lower(raw)), '\ue001\ue002\ue003\ue004', '.,'':') AS term FROM tok),
  stats AS (SELECT count(*) AS n, sum(len(w)) AS total FROM words),
  tf AS (SELECT id, term, count(*) AS tf, max(len) AS len FROM tokens GROUP BY id, term),
"""
_WEIGHT = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / n)))"


def _matches(name: str, query: str, hits: str, k: int, where: str = "true") -> None:
    """``hits``: SELECT id, score over the frames above. The SQL orders by the rounded score, which its alias names."""
    QUERIES[name] = lambda spark, folder: engine(spark, folder, score_digits=3).query(query).select("id", F.round(F.col("score").cast("double"), 3).alias("score"))
    ORACLE_SQL[name] = f"WITH {_TOKENS} hits AS ({hits}) SELECT id, round(score, 3) AS score FROM hits WHERE {where} ORDER BY score DESC, id LIMIT {k}"


def _terms(*terms: str) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"SELECT id, term, tf, len, count(*) OVER (PARTITION BY term) AS df FROM tf WHERE term IN ({names})"


_matches("matches_or", 'Turn.matches(.text, "the thing of", k: 20)', f"SELECT id, sum({_WEIGHT}) AS score FROM ({_terms('the', 'thing', 'of')}), stats GROUP BY id", 20)
_matches("matches_required", 'Turn.matches(.text, "+the +and for", k: 20)', f"SELECT id, sum({_WEIGHT}) AS score FROM ({_terms('the', 'and', 'for')}), stats GROUP BY id HAVING count(*) FILTER (term IN ('the', 'and')) = 2", 20)
_matches(
    "matches_phrase", 'Turn.matches(.text, "\\"of the\\"", k: 20)',
    f"SELECT id, sum({_WEIGHT}) AS score FROM ({_terms('of', 'the')}), stats WHERE id IN (SELECT a.id FROM tokens a JOIN tokens b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') GROUP BY id", 20,
)
_matches(
    "matches_prefix", 'Turn.matches(.text, "thinge*", k: 20)',
    f"SELECT id, {_WEIGHT} AS score FROM (SELECT id, tf, len, count(*) OVER () AS df FROM (SELECT id, sum(tf) AS tf, max(len) AS len FROM tf WHERE starts_with(term, 'thinge') GROUP BY id)), stats", 20,
)
_matches(
    "matches_filtered", 'Turn.filter(.role == "user").matches(.text, "the in", k: 20)',
    f"SELECT id, sum({_WEIGHT}) AS score FROM ({_terms('the', 'in')}), stats WHERE id IN (SELECT id FROM words WHERE role = 'user') GROUP BY id", 20,
)


def matches_stats(spark, folder):
    index = engine(spark, folder).index_text("Turn", "text")
    return index.stats().select("n", "tokens", F.round(F.col("tokens") / F.col("n"), 6).alias("average"))


QUERIES["matches_stats"] = matches_stats
ORACLE_SQL["matches_stats"] = f"WITH {_TOKENS.rstrip().rstrip(',')} SELECT n, total::BIGINT AS tokens, round(total / n, 6) AS average FROM stats"
_text("matches_english", 'Document.matches(.text, "thtion \\"of the\\" onshon", k: 20)', None)


# What a reader may not see does not count in the statistics either.
QUERIES["matches_visible"] = lambda spark, folder: (
    engine(spark, folder, rules='match Turn { allow read: if resource.role == "user"; }', score_digits=3).query('Turn.matches(.text, "the of", k: 20)').select("id", F.round(F.col("score").cast("double"), 3).alias("score"))
)
ORACLE_SQL["matches_visible"] = ORACLE_SQL["matches_or"].replace("WHERE text IS NOT NULL", "WHERE text IS NOT NULL AND role = 'user'").replace("'the', 'thing', 'of'", "'the', 'of'")


def similar_indexed(spark, folder):
    """The nearest by the index; what its codes and lists leave out can differ from the exact search."""
    e = engine(spark, folder)
    e.index_vectors("Item", "vec")
    return e.query(f"Item.similar(.vec, {_QS}, k: 10, ef: 200, rerank: 100)").select("id", "label", F.round(F.col("score").cast("double"), 3).alias("score"))


QUERIES["similar_indexed"] = similar_indexed


def export_import(spark, folder):
    """Parts written as export lines and read again."""
    from .sources.export import export, read_export

    out = scratch(spark, "export")
    export(star_catalog(spark, folder), out, ["Part"])
    return read_export(spark, out).frame("Part").select("id", "name", "brand", "size", "retailprice")


def rename_then_query(spark, folder):
    c = migrate.rename_field(star_catalog(spark, folder), "Part", "brand", "make")
    return Engine(spark, c).query('Part.filter(.make == "Brand#3")').select("id", "make")


def link_changed(spark, folder):
    """To-one links set and taken away again, as the other side sees them."""
    e = engine(spark, folder)
    e.query("Customer.filter(.acctbal < 0).link(Nation.get(5))")
    e.query('Customer.filter(.mktsegment == "BUILDING").unlink(Nation.get(5))')
    return e.query("Nation.get(5).customers").select("id")


for _g in (export_import, rename_then_query, link_changed):
    QUERIES[_g.__name__] = _g
ORACLE_SQL |= {
    "export_import": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS retailprice FROM part",
    "rename_then_query": "SELECT p_partkey AS id, p_brand AS make FROM part WHERE p_brand = 'Brand#3'",
    "link_changed": "SELECT c_custkey AS id FROM customer WHERE (c_acctbal < 0 OR c_nationkey = 5) AND c_mktsegment <> 'BUILDING'",
}


def peers_left(spark, folder):
    c = star_catalog(spark, folder)
    return links.link_peer_ids(c, "Part", "items", "supplier", c.frame("Part")).select("src", "peer")


def peers_top(spark, folder):
    c = star_catalog(spark, folder)
    return links.link_peers_top(c, "Part", "items", "supplier", c.frame("Part"), "acctbal", True, 1, 12)


def get_many(spark, folder):
    c = star_catalog(spark, folder)
    return links.get_many(c, "Part", c.frame("LineItem").where(F.col("quantity") == 50).select(F.col("part").alias("id")), ["name", "size"])


def scan_chunk(spark, folder):
    return engine(spark, folder).scan_chunk("Customer", 100, 25, ["name"])


def update_batch(spark, folder):
    return engine(spark, folder).query('Order.filter(.priority == "1-URGENT").update({status: "X", totalprice: 0})')


def _deleted(spark, folder):
    e = engine(spark, folder)
    e.query("Customer.filter(.acctbal < -500).delete()")
    return e


def delete_cascade(spark, folder):
    return _deleted(spark, folder).catalog.frame("Order").select("id", "status")


def delete_cascade_items(spark, folder):
    return _deleted(spark, folder).catalog.frame("LineItem").groupBy("order").agg(F.count("*").alias("items"))


def delete_remove(spark, folder):
    e = engine(spark, folder)
    e.query("Supplier.filter(.acctbal < 0).delete()")
    return e.catalog.frame("LineItem").groupBy("supplier").agg(F.count("*").alias("items"))


def delete_events(spark, folder):
    return _deleted(spark, folder).change_log().groupBy("kind", "type").agg(F.count("*").alias("n"))


def unique_violation_rows(spark, folder):
    return mutate.unique_violations(star_catalog(spark, folder).frame("Event"), "user_id")


def create_batch(spark, folder):
    e = engine(spark, folder)
    e.query('Customer.create_batch([{name: "A", acctbal: 1, nation: 3}, {name: "B", acctbal: 2.5, nation: 3}])')
    return e.query("Nation.get(3).customers").select("name", "acctbal")


_RULES = """
match Order { allow read: if resource.customer.mktsegment == request.auth.claims.segment && resource.totalprice > 1000; }
match Nation { allow read: if request.auth.uid in resource.customers.name; }
"""
_WHO = Principal("Customer#000000042", {"segment": "BUILDING"})


def rules_read_filter(spark, folder):
    return engine(spark, folder, rules=_RULES).query("Order.filter(.totalprice < 200000)", _WHO)


def rules_relation_many(spark, folder):
    c = star_catalog(spark, folder)
    name = c.frame("Customer").where("id = 42").select("name").first()[0]
    return Engine(spark, c, _RULES).query("Nation", Principal(name))


def change_feed_filter(spark, folder):
    """A change log written from the events, read as a stream until it has nothing new."""
    base = scratch(spark, "feed")
    events = star_catalog(spark, folder).frame("Event")
    kinds = F.when(F.col("id") % 3 == 0, "create").when(F.col("id") % 3 == 1, "update").otherwise("delete")
    log = events.select(kinds.alias("kind"), F.lit("Event").alias("type"), "id", F.when(F.col("id") % 2 == 0, F.col("user_id")).alias("origin"), F.to_json(F.struct("event_type")).alias("fields"), F.col("id").alias("version"))
    log.write.parquet(f"{base}/log")
    wanted = Subscription("Event", kinds=("create", "delete"), exclude_origin=7)
    out = wire_events(select_changes(change_stream(spark, f"{base}/log"), wanted))
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _converter(type_name: str, field: str, converter: str):
    def run(spark, folder):
        return star_catalog(spark, folder).frame(type_name).select("id", migrate.convert(F.col(field), converter).alias("value"))

    return run


def converter_quarantine(spark, folder):
    c = star_catalog(spark, folder)
    c.objects["Event"] = c.frame("Event").withColumn("event_type", F.when(F.col("id") % 7 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("id"), F.lit(" "))))
    done = migrate.change_field_type(c, "Event", "event_type", "parse_string_as_i64", "quarantine")
    good = done.catalog.frame("Event").select("id", F.col("event_type").alias("value"), F.lit(None).cast("string").alias("bad"))
    return good.unionByName(done.bad.select("id", F.lit(None).cast("long").alias("value"), F.col("value").alias("bad")))


def export_rows(spark, folder):
    return export_counts(star_catalog(spark, folder))


for _f in (peers_left, peers_top, get_many, scan_chunk, update_batch, delete_cascade, delete_cascade_items, delete_remove, delete_events, unique_violation_rows, create_batch, rules_read_filter, rules_relation_many, change_feed_filter, converter_quarantine):
    QUERIES[_f.__name__] = _f
QUERIES["export_counts"] = export_rows
for _n, _spec in {"converter_widen_int_to_f64": ("Part", "size", "widen_int_to_f64"), "converter_i32_to_i64": ("Part", "size", "lossless_widen_i32_to_i64"), "converter_int_to_string": ("Part", "size", "int_to_string"), "converter_parse_string": ("Part", "brand", "parse_string_as_i64")}.items():
    QUERIES[_n] = _converter(*_spec)

_GONE = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500)"
ORACLE_SQL |= {
    "peers_left": "SELECT l_partkey AS src, l_suppkey AS peer FROM lineitem",
    "peers_top": f"SELECT {_SUPPLIER} FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 12 OFFSET 1",
    "get_many": "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "scan_chunk": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey > 100 ORDER BY 1 LIMIT 25",
    "update_batch": "SELECT o_orderkey AS id, 'X' AS status, 0.0::DOUBLE AS totalprice, o_orderdate AS orderdate, o_orderpriority AS priority FROM orders WHERE o_orderpriority = '1-URGENT'",
    "delete_cascade": f"SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE NOT {_GONE}",
    "delete_cascade_items": f"SELECT l_orderkey AS \"order\", count(*) AS items FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_GONE}) GROUP BY 1",
    "delete_remove": "SELECT CASE WHEN s_acctbal < 0 THEN NULL ELSE l_suppkey END AS supplier, count(*) AS items FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "delete_events": f"""SELECT 'delete' AS kind, 'Customer' AS type, count(*) AS n FROM customer WHERE c_acctbal < -500 HAVING count(*) > 0
        UNION ALL SELECT 'delete', 'Order', count(*) FROM orders WHERE {_GONE} HAVING count(*) > 0
        UNION ALL SELECT 'delete', 'LineItem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_GONE}) HAVING count(*) > 0""",
    "unique_violation_rows": "SELECT user_id AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    "create_batch": "SELECT c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'A', 1.0 UNION ALL SELECT 'B', 2.5",
    "rules_read_filter": f"SELECT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 AND o_totalprice < 200000",
    "rules_relation_many": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 42)",
    "change_feed_filter": """SELECT event_id::VARCHAR AS version, CASE event_id % 3 WHEN 0 THEN 'create' ELSE 'delete' END AS kind, 'Event' AS type, event_id::VARCHAR AS object_id,
        CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS origin, '{"event_type":"' || event_type || '"}' AS fields FROM events
        WHERE event_id % 3 IN (0, 2) AND (event_id % 2 = 1 OR user_id <> 7)""",
    "converter_quarantine": "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS value, CASE WHEN event_id % 7 = 0 THEN event_type END AS bad FROM events",
    "converter_widen_int_to_f64": "SELECT p_partkey AS id, p_size::DOUBLE AS value FROM part",
    "converter_i32_to_i64": "SELECT p_partkey AS id, p_size::BIGINT AS value FROM part",
    "converter_int_to_string": "SELECT p_partkey AS id, p_size::VARCHAR AS value FROM part",
    "converter_parse_string": "SELECT p_partkey AS id, TRY_CAST(p_brand AS BIGINT) AS value FROM part",
    "export_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS type, count(*) AS objects FROM {n}"
        for t, n in {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "LineItem": "lineitem", "Event": "events", "Document": "documents", "Label": "labels", "Item": "embeddings", "Near": "embeddings", "Dot": "embeddings", "Page": "pages", "Bench": "benchmark", "Turn": "conversations"}.items()
    ),
}
