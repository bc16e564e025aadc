"""Logical export and import: newline-delimited JSON that any snapshot can be rebuilt from.

Lines: a header (format, schema), objects, edges, vectors, and a trailer with the counts of each type. Whole
numbers are decimal strings, floats the hexadecimal bits of IEEE numbers, bytes base64, so nothing is lost.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IdCollision, MigrationError
from ..plans.sdl import Field, Schema
from .catalog import Catalog

FORMAT = "skein-logical/1"
_NAN = {4: "7fc00000", 8: "7ff8000000000000"}


def _bits(width: int):
    code, size = (">f", ">I") if width == 4 else (">d", ">Q")

    @F.pandas_udf(T.StringType())
    def bits(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else format(struct.unpack(size, struct.pack(code, x))[0], f"0{2 * width}x") for x in v], dtype=object)

    return bits


def _from_bits(width: int):
    code, size = (">f", ">I") if width == 4 else (">d", ">Q")

    @F.pandas_udf(T.FloatType() if width == 4 else T.DoubleType())
    def value(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else struct.unpack(code, struct.pack(size, int(x, 16)))[0] for x in v], dtype=object)

    return value


def _encode(scalar: str, c: Column) -> Column:
    if scalar in ("f32", "f64"):
        width = 4 if scalar == "f32" else 8  # nulls and NaN look alike in a batch, so they are told apart here
        return F.when(c.isNull(), None).when(F.isnan(c), F.lit(_NAN[width])).otherwise(_bits(width)(c))
    if scalar == "Bytes":
        return F.base64(c)
    if scalar == "DateTime":
        return F.unix_millis(c.cast("timestamp")).cast("string")
    return c.cast("string")


def _decode(scalar: str, c: Column) -> Column:
    if scalar in ("f32", "f64"):
        width = 4 if scalar == "f32" else 8
        return F.when(c == _NAN[width], F.lit(float("nan"))).otherwise(_from_bits(width)(c))
    if scalar == "Bytes":
        return F.unbase64(c)
    if scalar == "DateTime":
        return F.timestamp_millis(c.cast("bigint")).cast("timestamp_ntz")
    return c.cast(Field("x", "scalar", scalar=scalar).spark_type)


def _lines(kind: str, name: str, df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), *columns)).alias("value"))


def export_lines(catalog: Catalog, types: list[str] | None = None, vectors: str = "all") -> DataFrame:
    """``value``: all lines but header and trailer. Edges into types that are left out are left out, too."""
    schema = catalog.schema
    chosen = [n for n in catalog.objects if types is None or n in types]
    parts = []
    for n in chosen:
        t, df = schema.types[n], catalog.frame(n)
        parts.append(_lines("object", n, df, [F.col("id").cast("string").alias("id"), F.struct(*(_encode(f.scalar, F.col(f.name)).alias(f.name) for f in t.scalars)).alias("fields")]))
        for f in t.relations:
            if f.inverse or f.target not in chosen:
                continue
            edges = catalog.edge_frame(t, f).join(catalog.frame(f.target).select(F.col("id").alias("dst")), "dst", "left_semi")
            extra = [_encode(s, F.col(e)).alias(e) for e, s in f.edge_fields.items() if e in edges.columns]
            parts.append(_lines("edge", f"{n}.{f.name}", edges, [F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), *([F.struct(*extra).alias("fields")] if extra else [])]))
        for (tn, fn), v in catalog.vectors.items():
            if tn == n and vectors != "none":
                bits = F.transform("vec", lambda x: x.cast("string")) if vectors == "text" else F.col("vec")
                parts.append(_lines("vector", f"{n}.{fn}", v, [F.col("id").cast("string").alias("id"), bits.alias("vec")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_counts(catalog: Catalog, types: list[str] | None = None) -> DataFrame:
    """``type, objects``: the trailer's counts."""
    out = None
    for n in sorted(catalog.objects):
        if types is None or n in types:
            one = catalog.frame(n).agg(F.count("*").alias("objects")).select(F.lit(n).alias("type"), "objects")
            out = one if out is None else out.unionByName(one)
    return out


def export(catalog: Catalog, folder: str, types: list[str] | None = None) -> None:
    spark = next(iter(catalog.objects.values())).sparkSession
    counts = {r.type: r.objects for r in export_counts(catalog, types).collect()}
    head = json.dumps({"kind": "header", "format": FORMAT, "schema": catalog.schema.emit()})
    tail = json.dumps({"kind": "trailer", "counts": counts})
    export_lines(catalog, types).write.mode("overwrite").text(f"{folder}/lines")
    spark.createDataFrame([(head,), (tail,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/frame")


def read_export(spark: SparkSession, folder: str) -> Catalog:
    """A catalog from an export; header, trailer and counts are checked before anything is used."""
    frame = [json.loads(r.value) for r in spark.read.text(f"{folder}/frame").collect()]
    head = next((x for x in frame if x.get("kind") == "header"), None)
    tail = next((x for x in frame if x.get("kind") == "trailer"), None)
    if not head or not tail or head.get("format") != FORMAT:
        raise MigrationError("the export lacks its header or trailer, or has another format")
    schema = Schema.parse(head["schema"])
    lines = spark.read.text(f"{folder}/lines").withColumn("kind", F.get_json_object("value", "$.kind")).withColumn("name", F.get_json_object("value", "$.name"))
    out = Catalog(schema, {})
    for n in tail["counts"]:
        t = schema.types[n]
        spec = "id string, fields struct<" + ", ".join(f"`{f.name}`: string" for f in t.scalars) + ">" if t.scalars else "id string"
        rows = lines.where((F.col("kind") == "object") & (F.col("name") == n)).select(F.from_json("value", spec).alias("o"))
        out.objects[n] = rows.select(F.col("o.id").cast("long").alias("id"), *(_decode(f.scalar, F.col(f"o.fields.{f.name}")).alias(f.name) for f in t.scalars))
    for n in tail["counts"]:
        t = schema.types[n]
        for f in t.relations:
            if f.inverse or f.target not in tail["counts"]:
                continue
            spec = "src string, dst string" + (", fields struct<" + ", ".join(f"`{e}`: string" for e in f.edge_fields) + ">" if f.edge_fields else "")
            rows = lines.where((F.col("kind") == "edge") & (F.col("name") == f"{n}.{f.name}")).select(F.from_json("value", spec).alias("e"))
            edges = rows.select(F.col("e.src").cast("long").alias("src"), F.col("e.dst").cast("long").alias("dst"), *(_decode(s, F.col(f"e.fields.{e}")).alias(e) for e, s in f.edge_fields.items()))
            if f.many or f.edge_fields:
                out.edges[n, f.name] = edges
            if not f.many:
                out.objects[n] = out.objects[n].join(edges.select(F.col("src").alias("id"), F.col("dst").alias(f.name)), "id", "left")
        for f in t.fields.values():
            if f.kind == "vector":
                rows = lines.where((F.col("kind") == "vector") & (F.col("name") == f"{n}.{f.name}")).select(F.from_json("value", "id string, vec array<float>").alias("v"))
                out.vectors[n, f.name] = rows.select(F.col("v.id").cast("long").alias("id"), F.col("v.vec").alias("vec"))
    found = {r.type: r.objects for r in export_counts(out).collect()}
    if found != tail["counts"]:
        raise MigrationError(f"the export says {tail['counts']} objects, its lines hold {found}")
    return out


def merge_import(catalog: Catalog, incoming: Catalog) -> Catalog:
    """Add the objects of ``incoming``; an id that any type has already is refused."""
    mine = None
    for df in catalog.objects.values():
        ids = df.select("id")
        mine = ids if mine is None else mine.unionByName(ids)
    for n, df in incoming.objects.items():
        bad = df.join(mine, "id", "left_semi").select("id").limit(1).collect()
        if bad:
            raise IdCollision(f"{n} {bad[0].id} is there already")
    merge = lambda a, b: {k: a[k].unionByName(b[k], allowMissingColumns=True) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
    return Catalog(catalog.schema, merge(catalog.objects, incoming.objects), merge(catalog.edges, incoming.edges), merge(catalog.vectors, incoming.vectors), catalog.version)
