"""Changes to objects and links, as new frames over the old ones.

Nothing is written in place: each operation gives a changed catalog, the keys of the frames that changed,
and the rows of the change log. A store makes that a version; without one it lives in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DeleteDenied, InvalidArgument, ObjectNotFound, UniqueViolation
from ..functions.literals import check_vector, coerce
from ..plans.ast import Json
from ..plans.sdl import Field, TypeDef
from ..sources.catalog import Catalog
from ..sources.paths import scratch

#: Of links without @on_delete: what happens to them when their target is deleted.
DEFAULT_MANY, DEFAULT_ONE = "remove", "deny"
CHANGE = "kind string, type string, id long, origin long, fields string"


@dataclass
class Mutation:
    catalog: Catalog
    changed: set[str]
    changes: DataFrame | None = None
    result: DataFrame | None = None
    next_id: int | None = None


def event_rows(df: DataFrame, t: TypeDef, kind: str, origin: int | None = None) -> DataFrame:
    """Change-log rows of the objects in ``df``: their scalar fields as JSON, nulls left out."""
    return df.select(
        F.lit(kind).alias("kind"), F.lit(t.name).alias("type"), "id", F.lit(origin).cast("long").alias("origin"),
        F.to_json(F.struct(*(F.col(f.name) for f in t.scalars))).alias("fields") if t.scalars else F.lit("{}").alias("fields"),
    )


def stored(t: TypeDef, fields: dict) -> tuple[dict, dict, dict]:
    """Scalars, to-one keys and vectors of a written object, checked against the schema."""
    scalars, keys, vectors = {}, {}, {}
    for name, value in fields.items():
        f = t.fields.get(name)
        if f is None:
            raise InvalidArgument(f"{t.name} has no field {name}")
        where = f"{t.name}.{name}"
        if f.kind == "scalar":
            scalars[name] = coerce(value, f.scalar, where)
        elif f.kind == "vector":
            import json

            values = json.loads(value.text) if isinstance(value, Json) else value
            if values is not None:
                vectors[name] = check_vector(values, f.dim, where)
        elif f.many or f.inverse:
            raise InvalidArgument(f"{where} is set by link")
        else:
            keys[name] = coerce(value, "i64", where)
    return scalars, keys, vectors


def _check_targets(catalog: Catalog, t: TypeDef, every: list[dict]) -> None:
    """All targets of a type in one join, whatever the number of rows."""
    wanted: dict[str, set[int]] = {}
    for keys in every:
        for name, target in keys.items():
            if target is not None:
                wanted.setdefault(t.fields[name].target, set()).add(target)
    for name, ids in wanted.items():
        frame = catalog.frame(name)
        asked = frame.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "id long")
        missing = asked.join(frame.select("id"), "id", "left_anti").orderBy("id").limit(1).collect()
        if missing:
            raise ObjectNotFound(f"{name} {missing[0].id}")


def unique_violations(frame: DataFrame, name: str, touched: DataFrame | None = None) -> DataFrame:
    """``value, n``: non-null values that several objects have; ``touched`` (ids) limits the search to their values."""
    rows = frame.select(F.col(name).alias("value"), "id").where("value is not null")
    if touched is not None:
        rows = rows.join(rows.join(touched.select("id"), "id", "left_semi").select("value").distinct(), "value", "left_semi")
    return rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")


def _check_unique(frame: DataFrame, t: TypeDef, names, touched: DataFrame) -> None:
    for name in names:
        f = t.fields.get(name)
        if f is not None and f.unique:
            bad = unique_violations(frame, name, touched).limit(1).collect()
            if bad:
                raise UniqueViolation(f"{t.name}.{name}: {bad[0].value!r} is there already")


def create(catalog: Catalog, type_name: str, rows: list[dict], next_id: int, origin: int | None = None) -> Mutation:
    """Insert all rows or none."""
    t = catalog.schema.type(type_name)
    frame = catalog.frame(type_name)
    spark = frame.sparkSession
    made, vectors, names = [], {}, set()
    parsed = [stored(t, fields) for fields in rows]
    _check_targets(catalog, t, [keys for _, keys, _ in parsed])
    for n, (scalars, keys, vecs) in enumerate(parsed):
        made.append({"id": next_id + n} | scalars | keys)
        names |= set(scalars)
        for name, v in vecs.items():
            vectors.setdefault(name, []).append((next_id + n, v))
    struct = t.struct()
    fresh = spark.createDataFrame([tuple(r.get(c) for c in struct.names) for r in made], struct)
    fresh = fresh.select(*(F.col(c).cast(frame.schema[c].dataType).alias(c) if c in frame.columns else F.col(c) for c in struct.names))
    grown = frame.unionByName(fresh, allowMissingColumns=True)
    _check_unique(grown, t, names, fresh)
    out = replace(catalog, objects=catalog.objects | {type_name: grown}, vectors=catalog.vectors | {})
    changed = {f"o:{type_name}"}
    for name, pairs in vectors.items():
        more = spark.createDataFrame(pairs, "id long, vec array<float>")
        had = out.vectors.get((type_name, name))
        out.vectors[type_name, name] = more if had is None else had.select("id", "vec").unionByName(more)
        changed.add(f"v:{type_name}:{name}")
    return Mutation(out, changed, event_rows(fresh, t, "create", origin), fresh.select("id", *(f.name for f in t.scalars)), next_id + len(rows))


def update(catalog: Catalog, type_name: str, ids: DataFrame, fields: dict, origin: int | None = None) -> Mutation:
    """Set the given fields of every object in ``ids``; other fields stay."""
    t = catalog.schema.type(type_name)
    scalars, keys, vecs = stored(t, fields)
    if vecs:
        raise InvalidArgument("vectors are replaced by ingest")
    _check_targets(catalog, t, [keys])
    frame = catalog.frame(type_name)
    flag = frame.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    values = scalars | keys
    columns = [F.when(F.col("_hit"), F.lit(values[c]).cast(frame.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in frame.columns]
    grown = flag.select(*columns)
    touched = grown.join(ids.select("id"), "id", "left_semi")
    _check_unique(grown, t, scalars, ids)
    out = replace(catalog, objects=catalog.objects | {type_name: grown})
    return Mutation(out, {f"o:{type_name}"}, event_rows(touched, t, "update", origin), touched.select("id", *(f.name for f in t.scalars)))


def _policy(f: Field) -> str:
    return f.on_delete or (DEFAULT_MANY if f.many else DEFAULT_ONE)


def delete_set(catalog: Catalog, type_name: str, ids: DataFrame) -> dict[str, DataFrame]:
    """All objects that go with ``ids``: a fixpoint over cascading links, by type; raises where a link denies it.

    The policy stands on the link that points at a deleted object. Rounds are checkpointed where the session
    names a folder for it.
    """
    gone = {type_name: catalog.frame(type_name).join(ids.select("id"), "id", "left_semi").select("id")}
    frontier = dict(gone)
    schema = catalog.schema
    while frontier:
        following: dict[str, DataFrame] = {}
        for target, df in frontier.items():
            for t, f in schema.holders(target):
                if _policy(f) == "cascade":
                    held = catalog.edge_frame(t, f).join(df.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
                    if t.name in gone:
                        held = held.join(gone[t.name], "id", "left_anti")
                    following[t.name] = following[t.name].unionByName(held).distinct() if t.name in following else held
        frontier = {}
        for name, df in following.items():
            df = _settled(df)
            if not df.isEmpty():
                frontier[name] = df
                gone[name] = gone[name].unionByName(df) if name in gone else df
    for target, df in gone.items():
        for t, f in schema.holders(target):
            if _policy(f) == "deny":
                held = catalog.edge_frame(t, f).join(df.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
                if t.name in gone:
                    held = held.join(gone[t.name], "id", "left_anti")
                left = held.limit(1).collect()
                if left:
                    raise DeleteDenied(f"{t.name} {left[0].id} refers to it by {f.name}")
    return gone


def _settled(df: DataFrame) -> DataFrame:
    """Cut the plan of a round by a written copy."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(catalog: Catalog, type_name: str, ids: DataFrame, origin: int | None = None) -> Mutation:
    gone = delete_set(catalog, type_name, ids)
    objects, edges, vectors, changed, events = catalog.objects | {}, catalog.edges | {}, catalog.vectors | {}, set(), None
    for name, df in gone.items():
        t = catalog.schema.types[name]
        was = catalog.frame(name)
        rows = event_rows(was.join(df, "id", "left_semi"), t, "delete", origin)
        events = rows if events is None else events.unionByName(rows)
        objects[name] = objects[name].join(df, "id", "left_anti").select(*was.columns)
        changed.add(f"o:{name}")
        for key in [k for k in vectors if k[0] == name]:
            vectors[key] = vectors[key].join(df, "id", "left_anti").select("id", "vec")
            changed.add(f"v:{key[0]}:{key[1]}")
    for name, df in gone.items():
        for t, f in catalog.schema.holders(name):
            if (t.name, f.name) in edges:
                had = edges[t.name, f.name]
                edges[t.name, f.name] = had.join(df.select(F.col("id").alias("dst")), "dst", "left_anti").select(*had.columns)
                changed.add(f"e:{t.name}:{f.name}")
            if not f.many and f.name in objects[t.name].columns:
                was = objects[t.name]
                lost = df.select(F.col("id").alias(f.name)).distinct().withColumn("_gone", F.lit(True))
                cleared = was.join(lost, f.name, "left")
                objects[t.name] = cleared.select(*(F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == f.name else F.col(c) for c in was.columns))
                changed.add(f"o:{t.name}")
        for f in catalog.schema.types[name].relations:
            if (name, f.name) in edges:
                had = edges[name, f.name]
                edges[name, f.name] = had.join(df.select(F.col("id").alias("src")), "src", "left_anti").select(*had.columns)
                changed.add(f"e:{name}:{f.name}")
    return Mutation(replace(catalog, objects=objects, edges=edges, vectors=vectors), changed, events)


def relation_to(t: TypeDef, target: str) -> Field:
    """The one relation of ``t`` that leads to ``target``."""
    found = [f for f in t.relations if f.target == target]
    if len(found) != 1:
        raise InvalidArgument(f"{t.name} has {len(found)} relations to {target}")
    return found[0]


def _forward(catalog: Catalog, t: TypeDef, f: Field) -> tuple[TypeDef, Field, bool]:
    """The relation that stores the link, and whether it is the other way round."""
    if not f.inverse:
        return t, f, False
    other = catalog.schema.types[f.inverse[0]]
    return other, other.fields[f.inverse[1]], True


def link(catalog: Catalog, type_name: str, ids: DataFrame, target_type: str, target_id: int, edge: dict | None = None, unlink: bool = False) -> Mutation:
    """Link (or unlink) every object of ``ids`` and one target; linking again replaces the edge's fields."""
    t = catalog.schema.type(type_name)
    f = relation_to(t, target_type)
    if catalog.frame(target_type).where(F.col("id") == target_id).limit(1).count() == 0:
        raise ObjectNotFound(f"{target_type} {target_id}")
    owner, stored_in, turned = _forward(catalog, t, f)
    values = {}
    for name, v in (edge or {}).items():
        if name not in stored_in.edge_fields:
            raise InvalidArgument(f"{owner.name}.{stored_in.name} has no edge field {name}")
        values[name] = coerce(v, stored_in.edge_fields[name], f"{owner.name}.{stored_in.name}.{name}")
    one = F.lit(target_id).cast("long")
    pairs = ids.select(one.alias("src"), F.col("id").alias("dst")) if turned else ids.select(F.col("id").alias("src"), one.alias("dst"))
    out = replace(catalog, objects=catalog.objects | {}, edges=catalog.edges | {})
    changed: set[str] = set()
    key = (owner.name, stored_in.name)
    if stored_in.many or key in catalog.edges or stored_in.edge_fields:
        types = {n: Field(n, "scalar", scalar=s).spark_type for n, s in stored_in.edge_fields.items()}
        fresh = pairs.select("src", "dst", *(F.lit(values.get(n)).cast(ty).alias(n) for n, ty in types.items()))
        schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), *(T.StructField(n, ty) for n, ty in types.items())])
        had = catalog.edges.get(key)
        if had is None:
            had = ids.sparkSession.createDataFrame([], schema)
        # A to-one link has one target: linking replaces it; a to-many edge is a pair.
        same = ["src"] if not stored_in.many and not unlink else ["src", "dst"]
        rest = had.join(fresh.select(*same).distinct(), same, "left_anti").select(*had.columns)
        out.edges[key] = rest if unlink else rest.unionByName(fresh.distinct(), allowMissingColumns=True)
        changed.add(f"e:{owner.name}:{stored_in.name}")
    if not stored_in.many:
        frame = catalog.frame(owner.name)
        new = pairs.select(F.col("src").alias("id"), F.col("dst").alias("_dst")).dropDuplicates(["id"])
        moved = frame.join(new, "id", "left")
        hit = F.col("_dst").isNotNull() & (F.col(stored_in.name) == F.col("_dst")) if unlink else F.col("_dst").isNotNull()
        value = F.lit(None).cast("long") if unlink else F.col("_dst").cast(frame.schema[stored_in.name].dataType)
        out.objects[owner.name] = moved.select(*(F.when(hit, value).otherwise(F.col(c)).alias(c) if c == stored_in.name else F.col(c) for c in frame.columns))
        changed.add(f"o:{owner.name}")
    touched = catalog.frame(type_name).join(ids.select("id"), "id", "left_semi")
    return Mutation(out, changed, event_rows(touched, t, "update"))
