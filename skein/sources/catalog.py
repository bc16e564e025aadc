"""Where the objects are: a frame per type, a frame per forward to-many link, a frame per vector field."""

from __future__ import annotations

from collections.abc import Callable, MutableMapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..plans.sdl import Field, Schema, TypeDef


class Frames(MutableMapping):
    """Frames by name, opened when they are first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._made: dict = {}
        self._makers = dict(makers)

    def __getitem__(self, name):
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __setitem__(self, name, df) -> None:
        self._made[name] = df
        self._makers[name] = lambda: df

    def __delitem__(self, name) -> None:
        del self._makers[name]
        self._made.pop(name, None)

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __or__(self, more: dict) -> Frames:
        out = Frames(self._makers)
        out._made = dict(self._made)
        for k, v in more.items():
            out[k] = v
        return out


@dataclass
class Catalog:
    """Frames by name. Objects: ``id``, scalars, and a key column for each forward to-one link. Edges:
    ``src, dst`` and edge fields, under (type, field). Vectors: ``id, vec``. A to-one link with edge fields
    has an edge frame besides its key column."""

    schema: Schema
    objects: MutableMapping[str, DataFrame]
    edges: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    vectors: MutableMapping[tuple[str, str], DataFrame] = field(default_factory=dict)
    version: int = 0

    def frame(self, name: str) -> DataFrame:
        self.schema.type(name)
        try:
            return self.objects[name]
        except KeyError:
            raise InvalidArgument(f"type {name} has no data") from None

    def relation(self, t: TypeDef, name: str) -> Field:
        f = t.fields.get(name)
        if f is None or f.kind != "relation":
            raise InvalidArgument(f"{t.name} has no relation {name}")
        return f

    def edge_frame(self, t: TypeDef, f: Field) -> DataFrame:
        """(src, dst) of a relation as seen from ``t``; an inverse is the same edges, turned round."""
        if f.inverse:
            other = self.schema.types[f.inverse[0]]
            forward = self.edge_frame(other, other.fields[f.inverse[1]])
            rest = [c for c in forward.columns if c not in ("src", "dst")]
            return forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
        if (t.name, f.name) in self.edges:
            return self.edges[t.name, f.name]
        if f.many:
            raise InvalidArgument(f"{t.name}.{f.name} has no edges")
        own = self.frame(t.name)
        return own.select(F.col("id").alias("src"), F.col(f.name).alias("dst")).where("dst is not null")

    def vector_frame(self, type_name: str, name: str) -> DataFrame:
        f = self.schema.type(type_name).fields.get(name)
        if f is None or f.kind != "vector":
            raise InvalidArgument(f"{type_name} has no vector field {name}")
        try:
            return self.vectors[type_name, name]
        except KeyError:
            raise InvalidArgument(f"{type_name}.{name} has no vectors") from None


Loader = Callable[[SparkSession, str], DataFrame]


def from_tables(spark: SparkSession, schema: Schema, loaders: dict[str, Loader], folder: str, vectors: dict[tuple[str, str], Loader] | None = None) -> Catalog:
    """A catalog over files: each loader gives a type's columns (``id``, scalars, keys)."""
    later = lambda made: Frames({k: (lambda f=f: f(spark, folder)) for k, f in made.items()})
    return Catalog(schema, later(loaders), {}, later(vectors or {}))
