"""The schema language: parser, validation, canonical text, and Spark types.

::

    type Movie {
      title: String @unique
      year: u32 @indexed
      director: Director                      // to-one link
      ratings: [Rating] @inverse(Rating.movie)
      embedding: Vector<384> @index(hnsw, metric: cosine)
    }
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import SchemaError

SCALARS = ("String", "Bool", "i32", "i64", "u32", "u64", "f32", "f64", "DateTime", "Bytes", "Json")
_SPARK = {
    "String": T.StringType(), "Bool": T.BooleanType(), "i32": T.IntegerType(), "i64": T.LongType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "DateTime": T.TimestampNTZType(), "Bytes": T.BinaryType(), "Json": T.StringType(),
}
INT_RANGE = {"i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1)}
METRICS = ("cosine", "l2", "dot")
ANALYZERS = ("simple", "english")


@dataclass
class VectorIndex:
    metric: str = "cosine"
    quantization: int = 4
    m: int = 16
    ef_construction: int = 100


@dataclass
class FullText:
    analyzer: str = "simple"
    positions: bool = True


@dataclass
class Field:
    name: str
    kind: str  # scalar, relation or vector
    scalar: str | None = None
    target: str | None = None
    many: bool = False
    edge_fields: dict[str, str] = field(default_factory=dict)
    dim: int = 0
    unique: bool = False
    indexed: bool = False
    fulltext: FullText | None = None
    on_delete: str | None = None
    inverse: tuple[str, str] | None = None
    index: VectorIndex | None = None
    vectorize: tuple[str, str] | None = None

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "scalar":
            return _SPARK[self.scalar]
        return T.ArrayType(T.FloatType()) if self.kind == "vector" else T.LongType()


@dataclass
class TypeDef:
    name: str
    fields: dict[str, Field]

    @property
    def scalars(self) -> list[Field]:
        return [f for f in self.fields.values() if f.kind == "scalar"]

    @property
    def relations(self) -> list[Field]:
        return [f for f in self.fields.values() if f.kind == "relation"]

    def struct(self) -> T.StructType:
        """Columns of the type's own table: id, scalars, and a key for each forward to-one link."""
        keys = [f for f in self.relations if not f.many and not f.inverse]
        return T.StructType([T.StructField("id", T.LongType(), False), *(T.StructField(f.name, f.spark_type) for f in [*self.scalars, *keys])])


_TOKEN = re.compile(r"\s+|//[^\n]*|#[^\n]*|/\*.*?\*/|(?P<str>\"(?:[^\"\\]|\\.)*\")|(?P<word>\w+)|(?P<sym>[{}\[\]()<>:,.@])", re.S)


class _Reader:
    def __init__(self, text: str):
        self.toks: list[tuple[str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup:
                self.toks.append((m[0], at))
            at = m.end()
        self.i = 0

    def peek(self) -> str | None:
        return self.toks[self.i][0] if self.i < len(self.toks) else None

    def take(self, want: str | None = None, what: str = "") -> str:
        got = self.peek()
        if got is None or want is not None and got != want:
            raise SchemaError(f"expected {want or what}, found {got or 'the end'}")
        self.i += 1
        return got

    def ident(self, what: str) -> str:
        got = self.take(None, what)
        if not re.fullmatch(r"\w+", got):
            raise SchemaError(f"expected {what}, found {got}")
        return got

    def accept(self, want: str) -> bool:
        if self.peek() == want:
            self.i += 1
            return True
        return False


class Schema:
    def __init__(self, types: dict[str, TypeDef]):
        self.types = types

    @classmethod
    def parse(cls, text: str) -> Schema:
        r, types = _Reader(text), {}
        while r.peek() is not None:
            r.take("type")
            name = r.ident("a type name")
            if name in types:
                raise SchemaError(f"type {name} is declared twice")
            types[name] = TypeDef(name, _fields(r, name))
        schema = cls(types)
        schema.validate()
        return schema

    def type(self, name: str) -> TypeDef:
        try:
            return self.types[name]
        except KeyError:
            from ..errors import InvalidArgument

            raise InvalidArgument(f"no type {name} in the schema") from None

    def validate(self) -> None:
        for t in self.types.values():
            for f in t.fields.values():
                self._check(t, f)

    def _check(self, t: TypeDef, f: Field) -> None:
        where = f"{t.name}.{f.name}"
        if "__" in f.name:
            raise SchemaError(f"{where}: '__' is reserved")
        if f.name == "id":
            raise SchemaError(f"{where}: every object has an id already")
        if f.kind == "relation" and f.target not in self.types:
            raise SchemaError(f"{where}: no type {f.target}")
        for e, s in f.edge_fields.items():
            if s not in SCALARS:
                raise SchemaError(f"{where}.{e}: edge fields are scalars")
        if f.vectorize:
            source = t.fields.get(f.vectorize[0])
            if f.kind != "vector":
                raise SchemaError(f"{where}: @vectorize is for Vector fields")
            if source is None or source.scalar != "String":
                raise SchemaError(f"{where}: @vectorize needs a String field as its source")
        if f.indexed and (f.kind != "scalar" or f.scalar == "Json"):
            raise SchemaError(f"{where}: @indexed is for scalars other than Json")
        if f.unique and f.kind != "scalar":
            raise SchemaError(f"{where}: @unique is for scalars")
        if f.fulltext and f.scalar != "String":
            raise SchemaError(f"{where}: @fulltext is for String fields")
        if f.index and f.kind != "vector":
            raise SchemaError(f"{where}: @index is for Vector fields")
        if f.on_delete and f.kind != "relation":
            raise SchemaError(f"{where}: @on_delete is for relations")
        if f.inverse:
            other = self.types.get(f.inverse[0])
            back = other.fields.get(f.inverse[1]) if other else None
            if f.kind != "relation" or back is None or back.kind != "relation" or back.inverse:
                raise SchemaError(f"{where}: @inverse({f.inverse[0]}.{f.inverse[1]}) names no forward relation")
            if back.target != t.name or f.target != other.name:
                raise SchemaError(f"{where}: @inverse({f.inverse[0]}.{f.inverse[1]}) links other types")

    def emit(self) -> str:
        """Canonical text: parsing it gives the same schema."""
        return "\n".join(_emit_type(t) for t in self.types.values())

    def digest(self) -> str:
        return hashlib.sha256("\n".join(_emit_type(self.types[n]) for n in sorted(self.types)).encode()).hexdigest()

    def describe(self) -> dict:
        """Types by name, fields in declaration order, and the canonical text."""
        kind = lambda f: f.scalar or (f"Vector<{f.dim}>" if f.kind == "vector" else f"[{f.target}]" if f.many else f.target)
        types = [{"name": n, "fields": [{"name": f.name, "kind": f.kind, "type": kind(f), "directives": _directives(f)} for f in self.types[n].fields.values()]} for n in sorted(self.types)]
        return {"types": types, "sdl": self.emit(), "digest": self.digest()}

    def inverse_source(self, f: Field) -> Field:
        return self.types[f.inverse[0]].fields[f.inverse[1]]

    def holders(self, target: str):
        """Forward relations that point at ``target``: (type, field)."""
        return [(t, f) for t in self.types.values() for f in t.relations if f.target == target and not f.inverse]


def _fields(r: _Reader, owner: str) -> dict[str, Field]:
    r.take("{")
    out: dict[str, Field] = {}
    while not r.accept("}"):
        name = r.ident("a field name")
        if name in out:
            raise SchemaError(f"field {owner}.{name} is declared twice")
        r.take(":")
        f = _field_type(r, name)
        while r.accept("@"):
            _directive(r, f, f"{owner}.{name}")
        out[name] = f
        r.accept(",")
    return out


def _field_type(r: _Reader, name: str) -> Field:
    if r.accept("["):
        f = Field(name, "relation", target=r.ident("a type name"), many=True)
        r.take("]")
    else:
        word = r.ident("a type")
        if word == "Vector":
            r.take("<")
            dim = r.ident("a dimension")
            r.take(">")
            if not dim.isdigit() or not int(dim):
                raise SchemaError(f"{name}: a vector needs a positive dimension")
            return Field(name, "vector", dim=int(dim))
        if word in SCALARS:
            return Field(name, "scalar", scalar=word)
        f = Field(name, "relation", target=word)
    if r.accept("{"):
        while not r.accept("}"):
            e = r.ident("an edge field")
            r.take(":")
            if e in f.edge_fields:
                raise SchemaError(f"edge field {name}.{e} is declared twice")
            f.edge_fields[e] = r.ident("a scalar type")
            r.accept(",")
    return f


def _arguments(r: _Reader) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, str]] = []
    if r.accept("("):
        while not r.accept(")"):
            word = r.take(None, "an argument")
            if r.accept(":"):
                out.append((word, r.take(None, "a value").strip('"')))
            elif r.accept("."):
                out.append((None, f"{word}.{r.ident('a field')}"))
            else:
                out.append((None, word.strip('"')))
            r.accept(",")
    return out


def _directive(r: _Reader, f: Field, where: str) -> None:
    name = r.ident("a directive")
    args = _arguments(r)
    named = {k: v for k, v in args if k}
    if len(named) != sum(k is not None for k, _ in args):
        raise SchemaError(f"{where}: @{name} has an argument twice")
    plain = [v for k, v in args if not k]
    unknown = lambda allowed: [k for k in named if k not in allowed]
    if name == "unique":
        f.unique = True
    elif name == "indexed":
        f.indexed = True
    elif name == "on_delete":
        if plain not in (["remove"], ["cascade"], ["deny"]):
            raise SchemaError(f"{where}: @on_delete takes remove, cascade or deny")
        f.on_delete = plain[0]
    elif name == "inverse":
        if len(plain) != 1 or plain[0].count(".") != 1:
            raise SchemaError(f"{where}: @inverse takes Type.field")
        f.inverse = tuple(plain[0].split("."))
    elif name == "fulltext":
        if f.fulltext:
            raise SchemaError(f"{where}: @fulltext is given twice")
        analyzer, positions = named.get("analyzer", "simple"), named.get("positions", "true")
        if analyzer not in ANALYZERS or positions not in ("true", "false") or unknown(("analyzer", "positions")) or plain:
            raise SchemaError(f"{where}: @fulltext takes analyzer (simple, english) and positions (true, false)")
        f.fulltext = FullText(analyzer, positions == "true")
    elif name == "index":
        if plain != ["hnsw"] or unknown(("metric", "quantization", "m", "ef_construction")):
            raise SchemaError(f"{where}: @index(hnsw, metric, quantization, m, ef_construction)")
        metric, q = named.get("metric", "cosine"), named.get("quantization", "4")
        q = re.sub(r"\D", "", q)
        if metric not in METRICS:
            raise SchemaError(f"{where}: metric is cosine, l2 or dot")
        if q not in ("2", "3", "4"):
            raise SchemaError(f"{where}: quantization is 2, 3 or 4 bits")
        m, ef = named.get("m", "16"), named.get("ef_construction", "100")
        if not m.isdigit() or not ef.isdigit() or int(m) < 1 or int(ef) < 1:
            raise SchemaError(f"{where}: m and ef_construction are at least 1")
        f.index = VectorIndex(metric, int(q), int(m), int(ef))
    elif name == "vectorize":
        source = named.get("source") or (plain[0] if plain else None)
        if not source or unknown(("source", "model")):
            raise SchemaError(f"{where}: @vectorize(source, model)")
        f.vectorize = (source, named.get("model", plain[1] if len(plain) > 1 else "default"))
    else:
        raise SchemaError(f"{where}: unknown directive @{name}")


def _directives(f: Field) -> list[str]:
    out = []
    if f.unique:
        out.append("@unique")
    if f.indexed:
        out.append("@indexed")
    if f.fulltext:
        out.append(f'@fulltext(analyzer: "{f.fulltext.analyzer}", positions: {str(f.fulltext.positions).lower()})')
    if f.on_delete:
        out.append(f"@on_delete({f.on_delete})")
    if f.inverse:
        out.append(f"@inverse({f.inverse[0]}.{f.inverse[1]})")
    if f.index:
        out.append(f"@index(hnsw, metric: {f.index.metric}, quantization: {f.index.quantization}, m: {f.index.m}, ef_construction: {f.index.ef_construction})")
    if f.vectorize:
        out.append(f'@vectorize(source: {f.vectorize[0]}, model: "{f.vectorize[1]}")')
    return out


def _emit_type(t: TypeDef) -> str:
    lines = []
    for f in t.fields.values():
        kind = f.scalar or (f"Vector<{f.dim}>" if f.kind == "vector" else f"[{f.target}]" if f.many else f.target)
        edge = " { " + ", ".join(f"{k}: {v}" for k, v in f.edge_fields.items()) + " }" if f.edge_fields else ""
        lines.append("  " + " ".join([f"{f.name}: {kind}{edge}", *_directives(f)]))
    return f"type {t.name} {{\n" + "\n".join(lines) + "\n}"
