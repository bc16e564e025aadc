"""The object schema over the star-schema and corpus tables, and their loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.sdl import Schema
from .catalog import Catalog, from_tables

SDL = """
type Region   { name: String @unique  nations: [Nation] @inverse(Nation.region) }
type Nation   { name: String @unique  region: Region
                customers: [Customer] @inverse(Customer.nation)  suppliers: [Supplier] @inverse(Supplier.nation) }
type Customer { name: String  acctbal: f64  mktsegment: String @indexed  nation: Nation
                orders: [Order] @inverse(Order.customer) }
type Supplier { name: String  acctbal: f64  nation: Nation  items: [LineItem] @inverse(LineItem.supplier) }
type Part     { name: String  brand: String  ptype: String  size: i32 @indexed  retailprice: f64
                items: [LineItem] @inverse(LineItem.part) }
type Order    { status: String  totalprice: f64  orderdate: DateTime @indexed  priority: String
                customer: Customer @on_delete(cascade)  items: [LineItem] @inverse(LineItem.order) }
type LineItem { linenumber: i32  quantity: f64  extendedprice: f64  discount: f64  tax: f64
                returnflag: String  linestatus: String  shipdate: DateTime
                order: Order @on_delete(cascade)  part: Part @on_delete(remove)  supplier: Supplier @on_delete(remove) }
type Event    { ts: DateTime  user_id: i64 @indexed  event_type: String  value: f64  props: Json }
type Document { text: String @fulltext(analyzer: "english")  lang: String  source: String  n_chars: i64
                labels: [Label] @inverse(Label.document) }
type Label    { quality: i32  toxic: i32  document: Document @on_delete(cascade) }
type Item     { label: i32  vec: Vector<64> @index(hnsw, metric: cosine) }
type Near     { label: i32  vec: Vector<64> @index(hnsw, metric: l2) }
type Dot      { label: i32  vec: Vector<64> @index(hnsw, metric: dot) }
type Page     { url: String  html: String }
type Bench    { text: String @fulltext }
type Turn     { turn: i64  role: String  text: String @fulltext  conv_id: i64 }
"""
SCHEMA = Schema.parse(SDL)
#: Name of the file, and column of each field.
_TABLES = {
    "Region": ("region", {"id": "r_regionkey", "name": "r_name"}),
    "Nation": ("nation", {"id": "n_nationkey", "name": "n_name", "region": "n_regionkey"}),
    "Customer": ("customer", {"id": "c_custkey", "name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment", "nation": "c_nationkey"}),
    "Supplier": ("supplier", {"id": "s_suppkey", "name": "s_name", "acctbal": "s_acctbal", "nation": "s_nationkey"}),
    "Part": ("part", {"id": "p_partkey", "name": "p_name", "brand": "p_brand", "ptype": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "Order": ("orders", {"id": "o_orderkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority", "customer": "o_custkey"}),
    "Document": ("documents", {"id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}),
    "Label": ("labels", {"id": "doc_id", "quality": "quality", "toxic": "toxic", "document": "doc_id"}),
    "Item": ("embeddings", {"id": "vec_id", "label": "label"}),
    "Near": ("embeddings", {"id": "vec_id", "label": "label"}),
    "Dot": ("embeddings", {"id": "vec_id", "label": "label"}),
    "Page": ("pages", {"id": "page_id", "url": "url", "html": "html"}),
    "Bench": ("benchmark", {"id": "item_id", "text": "text"}),
}


def _columns(table: str, names: dict[str, str]):
    keys = {"id", *(f.name for t in SCHEMA.types.values() for f in t.relations if not f.inverse)}
    return lambda spark, folder: spark.read.parquet(f"{folder}/{table}.parquet").select(*(F.col(c).cast("long").alias(n) if n in keys else F.col(c).alias(n) for n, c in names.items()))


def _lineitem(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    # Rows have no key of their own; whole rows are distinct, so their hash names them without a shuffle.
    names = {"linenumber": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate", "order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}
    return df.select(F.xxhash64(*df.columns).alias("id"), *(F.col(c).alias(n) for n, c in names.items()))


def _events(spark, folder):
    df = spark.read.parquet(f"{folder}/events.parquet")
    canonical = F.regexp_replace(F.regexp_replace("props", r'":\s+', '":'), r",\s+", ",")
    return df.select(F.col("event_id").alias("id"), F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", canonical.alias("props"))


def _turns(spark, folder):
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    return df.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "turn", "role", "text", "conv_id")


def _vectors(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def star_catalog(spark, folder: str) -> Catalog:
    loaders = {n: _columns(*spec) for n, spec in _TABLES.items()} | {"LineItem": _lineitem, "Event": _events, "Turn": _turns}
    return from_tables(spark, SCHEMA, loaders, folder, {(n, "vec"): _vectors for n in ("Item", "Near", "Dot")})
