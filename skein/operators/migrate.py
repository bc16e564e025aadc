"""Schema evolution: additive changes, gated removals, renames, type changes with a policy for bad rows."""

from __future__ import annotations

import copy
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MigrationError
from ..plans.sdl import Schema
from ..sources.catalog import Catalog

#: Converters by name: source types, target type, expression. A null result for a value that is not null is a bad row.
CONVERTERS = {
    "widen_int_to_f64": (("i32", "i64", "u32", "u64"), "f64", lambda c: c.cast("double")),
    "lossless_widen_u32_to_u64": (("u32",), "u64", lambda c: c.cast("decimal(20,0)")),
    "lossless_widen_i32_to_i64": (("i32",), "i64", lambda c: c.cast("bigint")),
    "int_to_string": (("i32", "i64", "u32", "u64"), "String", lambda c: c.cast("string")),
    "parse_string_as_i64": (("String",), "i64", lambda c: F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("bigint"))),
}
POLICIES = ("stop", "skip", "quarantine")


def register_converter(name: str, sources: tuple[str, ...], target: str, expression) -> None:
    if name in CONVERTERS:
        raise MigrationError(f"converter {name} is there already")
    CONVERTERS[name] = (sources, target, expression)


def convert(c: Column, name: str) -> Column:
    if name not in CONVERTERS:
        raise MigrationError(f"no converter {name}")
    return CONVERTERS[name][2](c)


@dataclass
class TypeChange:
    """Outcome of a field's change of type: the catalog after it, and rows that could not be converted."""

    catalog: Catalog
    bad: DataFrame
    total: int
    failed: int


def change_field_type(catalog: Catalog, type_name: str, name: str, converter: str, policy: str = "stop", dry_run: bool = False) -> TypeChange:
    """Rewrite a field: ``stop`` refuses if a row fails, ``skip`` stores null, ``quarantine`` takes failed rows out."""
    if policy not in POLICIES:
        raise MigrationError(f"the policy is one of {', '.join(POLICIES)}")
    t = catalog.schema.type(type_name)
    f = t.fields.get(name)
    sources, target, _ = CONVERTERS.get(converter) or (_ for _ in ()).throw(MigrationError(f"no converter {converter}"))
    if f is None or f.scalar not in sources:
        raise MigrationError(f"{converter} does not convert {type_name}.{name}")
    frame = catalog.frame(type_name)
    new = convert(F.col(name), converter)
    failed = F.col(name).isNotNull() & new.isNull()
    bad = frame.where(failed).select("id", F.col(name).cast("string").alias("value"))
    counts = frame.agg(F.count("*").alias("n"), F.count(F.when(failed, 1)).alias("bad")).first()
    if dry_run:
        return TypeChange(catalog, bad, counts.n, counts.bad)
    if counts.bad and policy == "stop":
        raise MigrationError(f"{counts.bad} of {counts.n} rows of {type_name}.{name} cannot be converted")
    good = frame.where(~failed) if policy == "quarantine" else frame
    schema = copy.deepcopy(catalog.schema)
    schema.types[type_name].fields[name].scalar = target
    schema.validate()
    objects = catalog.objects | {type_name: good.withColumn(name, new)}
    return TypeChange(replace(catalog, schema=schema, objects=objects), bad, counts.n, counts.bad)


def diff(old: Schema, new: Schema) -> dict[str, list[str]]:
    """What a new schema adds, removes and changes, by names."""
    names = lambda s: {f"{t.name}.{f.name}": f for t in s.types.values() for f in t.fields.values()}
    a, b = names(old), names(new)
    kind = lambda f: (f.kind, f.scalar, f.target, f.many, f.dim)
    return {
        "added": sorted({*new.types} - {*old.types}) + sorted({*b} - {*a}),
        "removed": sorted({*old.types} - {*new.types}) + sorted({*a} - {*b}),
        "changed": sorted(n for n in {*a} & {*b} if kind(a[n]) != kind(b[n])),
    }


def evolve(catalog: Catalog, new: Schema, allow_removal: bool = False, retired: frozenset[str] = frozenset()) -> Catalog:
    """Take a new schema: additions are free (null until set); removals need consent, and names once removed stay retired."""
    d = diff(catalog.schema, new)
    if d["changed"]:
        raise MigrationError(f"types change by migration: {', '.join(d['changed'])}")
    if d["removed"] and not allow_removal:
        raise MigrationError(f"would remove {', '.join(d['removed'])}")
    if back := retired & {*d["added"]}:
        raise MigrationError(f"retired names: {', '.join(sorted(back))}")
    spark = next(iter(catalog.objects.values())).sparkSession
    objects = {}
    for n, t in new.types.items():
        struct = t.struct()
        frame = catalog.objects.get(n)
        if frame is None:
            objects[n] = spark.createDataFrame([], struct)
            continue
        objects[n] = frame.select("id", *(F.col(s.name) if s.name in frame.columns else F.lit(None).cast(s.dataType).alias(s.name) for s in struct.fields if s.name != "id"))
    live = lambda k: k[0] in new.types and k[1] in new.types[k[0]].fields
    return replace(catalog, schema=new, objects=objects, edges={k: v for k, v in catalog.edges.items() if live(k)}, vectors={k: v for k, v in catalog.vectors.items() if live(k)})


def rename_field(catalog: Catalog, type_name: str, old: str, new: str) -> Catalog:
    schema = copy.deepcopy(catalog.schema)
    t = schema.type(type_name)
    if old not in t.fields or new in t.fields:
        raise MigrationError(f"cannot rename {type_name}.{old} to {new}")
    t.fields = {new if n == old else n: f for n, f in t.fields.items()}
    t.fields[new].name = new
    for other in schema.types.values():
        for f in other.fields.values():
            if f.inverse == (type_name, old):
                f.inverse = (type_name, new)
            if other is t and f.vectorize and f.vectorize[0] == old:
                f.vectorize = (new, f.vectorize[1])
    schema.validate()
    move = lambda d: {(k[0], new) if k == (type_name, old) else k: v for k, v in d.items()}
    return replace(catalog, schema=schema, objects=catalog.objects | {type_name: catalog.frame(type_name).withColumnRenamed(old, new)}, edges=move(catalog.edges), vectors=move(catalog.vectors))


def rename_type(catalog: Catalog, old: str, new: str) -> Catalog:
    schema = copy.deepcopy(catalog.schema)
    if old not in schema.types or new in schema.types:
        raise MigrationError(f"cannot rename {old} to {new}")
    schema.types = {new if n == old else n: t for n, t in schema.types.items()}
    schema.types[new].name = new
    for t in schema.types.values():
        for f in t.fields.values():
            f.target = new if f.target == old else f.target
            if f.inverse and f.inverse[0] == old:
                f.inverse = (new, f.inverse[1])
    schema.validate()
    move = lambda d: {(new, k[1]) if k[0] == old else k: v for k, v in d.items()}
    return replace(catalog, schema=schema, objects={new if n == old else n: d for n, d in catalog.objects.items()}, edges=move(catalog.edges), vectors=move(catalog.vectors))


class MigrationLog:
    """Named migrations in order, each applied once; ``done`` lists (name, digest) of those that were."""

    def __init__(self, done: list | None = None):
        self.done = [tuple(x) for x in done or []]

    def apply(self, catalog: Catalog, migrations: list) -> Catalog:
        """``migrations``: (name, function of a catalog). What has been applied must be a prefix of them."""
        names = [n for n, _ in migrations]
        if [n for n, _ in self.done] != names[: len(self.done)]:
            raise MigrationError("the log has other migrations than the list begins with")
        for name, run in migrations[len(self.done) :]:
            catalog = run(catalog)
            self.done.append((name, catalog.schema.digest()))
        return catalog
