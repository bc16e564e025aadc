"""Security rules: who may read, create, update, delete and subscribe to which objects.

::

    match Post {
      allow read: if resource.published || request.auth.uid == resource.author.uid;
      allow write: if request.auth.uid in resource.editors.uid;
    }

An operation is denied unless a clause is true. Conditions have three values; a missing field, claim, link
or stored null makes its comparison unknown. They become nullable boolean columns, links become joins: a
to-one link a left join on its key, ``in`` over a to-many link a left join with the objects of which any
linked value, of however many, is the asked one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..plans.sdl import Schema, TypeDef
from ..sources.catalog import Catalog

OPS = ("read", "create", "update", "delete", "subscribe")
_TOKEN = re.compile(r"\s+|//[^\n]*|(?P<num>\d+(?:\.\d+)?)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<word>\w+)|(?P<sym>&&|\|\||==|!=|<=|>=|[{}():;,.<>!])")


@dataclass(frozen=True)
class Principal:
    """A verified caller; without ``uid`` and claims it is nobody. Whoever builds it has checked the token."""

    uid: str | None = None
    claims: dict = field(default_factory=dict)

    @property
    def known(self) -> bool:
        return self.uid is not None or bool(self.claims)


NOBODY = Principal()


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple


class Rules:
    def __init__(self, clauses: dict[tuple[str, str], list], schema: Schema):
        self.clauses, self.schema = clauses, schema

    @classmethod
    def parse(cls, text: str, schema: Schema) -> Rules:
        r, clauses = _Reader(text), {}
        while r.peek() is not None:
            r.take("match")
            name = r.take()
            if name not in schema.types:
                raise SchemaError(f"rules: no type {name}")
            r.take("{")
            while not r.accept("}"):
                r.take("allow")
                ops: list[str] = []
                while True:
                    op = r.take()
                    if op not in (*OPS, "write"):
                        raise SchemaError(f"rules: unknown operation {op}")
                    ops += ("create", "update", "delete") if op == "write" else (op,)
                    if not r.accept(","):
                        break
                r.take(":")
                r.take("if")
                expr = r.either()
                r.take(";")
                _check(expr, schema.types[name], schema)
                for op in ops:
                    clauses.setdefault((name, op), []).append(expr)
        return cls(clauses, schema)

    def allowed(self, df: DataFrame, type_name: str, op: str, who: Principal, catalog: Catalog, request: dict | None = None) -> DataFrame:
        """``df`` (frame of objects of the type, all own columns) with a boolean ``_allowed``."""
        compiler = _Compiler(df, self.schema.types[type_name], catalog, who, request or {})
        verdict = F.lit(False)
        for expr in self.clauses.get((type_name, op), []):
            verdict = verdict | F.coalesce(compiler.truth(expr), F.lit(False))
        return compiler.df.withColumn("_allowed", verdict).drop(*compiler.helpers)

    def readable(self, df: DataFrame, type_name: str, who: Principal, catalog: Catalog, op: str = "read") -> DataFrame:
        return self.allowed(df, type_name, op, who, catalog).where("_allowed").drop("_allowed")


class _Reader:
    def __init__(self, text: str):
        self.toks, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"rules: unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.i = 0

    def peek(self):
        return self.toks[self.i][1] if self.i < len(self.toks) else None

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if got is None or want is not None and got != want:
            raise SchemaError(f"rules: expected {want or 'a name'}, found {got or 'the end'}")
        self.i += 1
        return got

    def accept(self, want: str) -> bool:
        if self.peek() == want:
            self.i += 1
            return True
        return False

    def either(self):
        left = self.both()
        while self.accept("||"):
            left = Node("||", (left, self.both()))
        return left

    def both(self):
        left = self.compare()
        while self.accept("&&"):
            left = Node("&&", (left, self.compare()))
        return left

    def compare(self):
        left = self.unary()
        if self.peek() in ("==", "!=", "<", "<=", ">", ">=", "in"):
            return Node(self.take(), (left, self.unary()))
        return left

    def unary(self):
        if self.accept("!"):
            return Node("!", (self.unary(),))
        if self.accept("("):
            inner = self.either()
            self.take(")")
            return inner
        if self.peek() is None:
            raise SchemaError("rules: an expression is missing")
        kind, text = self.toks[self.i]
        self.i += 1
        if kind == "num":
            return Literal(float(text) if "." in text else int(text))
        if kind == "str":
            return Literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1]))
        if text in ("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[text])
        if kind != "word":
            raise SchemaError(f"rules: expected an expression, found {text}")
        parts = [text]
        while self.accept("."):
            parts.append(self.take())
        return Path(tuple(parts))


def _is_many(e, t: TypeDef) -> bool:
    return isinstance(e, Path) and e.parts[0] == "resource" and len(e.parts) == 3 and t.fields[e.parts[1]].many


def _check(e, t: TypeDef, schema: Schema) -> None:
    """Names, and shapes that can never be right, are refused when the rules are loaded."""
    if isinstance(e, Literal):
        return
    if isinstance(e, Node):
        for a in e.args:
            _check(a, t, schema)
        auth = [isinstance(a, Path) and a.parts == ("request", "auth") for a in e.args]
        if e.op in ("==", "!=", "<", "<=", ">", ">=", "in"):
            if any(auth):
                other = e.args[auth.index(False)] if False in auth else None
                if e.op not in ("==", "!=") or not (isinstance(other, Literal) and other.value is None):
                    raise SchemaError("rules: request.auth is only compared to null")
            if _is_many(e.args[0], t) or _is_many(e.args[1], t) and e.op != "in":
                raise SchemaError("rules: a to-many link stands on the right of `in`")
        return
    p = e.parts
    where = ".".join(p)
    if p[0] == "request" and len(p) > 1 and p[1] == "auth":
        if len(p) == 2 or p[2] == "claims" and len(p) > 3 or p[2] == "uid" and len(p) == 3:
            return
        raise SchemaError(f"rules: unknown {where}")
    if p[0] not in ("request", "resource") or len(p) < 2:
        raise SchemaError(f"rules: unknown {where}")
    f = t.fields.get(p[1])
    if f is None:
        raise SchemaError(f"rules: {where}: {t.name} has no {p[1]}")
    if f.kind == "vector":
        raise SchemaError(f"rules: {where}: vectors cannot be used")
    if p[0] == "request" and len(p) == 2:
        return
    if p[0] == "resource" and f.kind == "scalar" and len(p) == 2:
        return
    if p[0] == "resource" and f.kind == "relation" and len(p) == 3:
        target = schema.types[f.target].fields.get(p[2])
        if target is not None and target.kind == "scalar":
            return
    raise SchemaError(f"rules: {where} cannot be used here")


@dataclass
class _Value:
    """kind: str, num, bool, null, absent, auth or set; column for the first three and sets."""

    kind: str
    column: Column | None = None
    known: bool = False


_KIND = {"String": "str", "Bytes": "str", "DateTime": "str", "Json": "json", "Bool": "bool"}


class _Compiler:
    def __init__(self, df: DataFrame, t: TypeDef, catalog: Catalog, who: Principal, request: dict):
        self.df, self.t, self.catalog, self.who, self.request = df, t, catalog, who, request
        self.helpers: dict[str, _Value] = {}

    def _python(self, v) -> _Value:
        if v is None:
            return _Value("absent")
        if isinstance(v, bool):
            return _Value("bool", F.lit(v))
        if isinstance(v, (int, float)):
            return _Value("num", F.lit(float(v)))
        if isinstance(v, str):
            return _Value("str", F.lit(v))
        if isinstance(v, (list, tuple, set)):
            return _Value("set", F.array(*(F.lit(str(x)) for x in v)) if v else F.array().cast("array<string>"))
        return _Value("absent")

    def _scalar(self, scalar: str, c: Column) -> _Value:
        kind = _KIND.get(scalar, "num")
        if kind == "num":
            return _Value("num", c.cast("double"))
        if scalar == "Bytes":
            return _Value("str", F.base64(c))
        if scalar == "DateTime":
            return _Value("str", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        return _Value(kind, c)

    def value(self, e) -> _Value:
        if isinstance(e, Literal):
            return _Value("null") if e.value is None else self._python(e.value)
        if isinstance(e, Node):
            return _Value("bool", self.truth(e))
        p = e.parts
        if p[:2] == ("request", "auth"):
            if len(p) == 2:
                return _Value("auth", known=self.who.known)
            if p[2] == "uid":
                return self._python(self.who.uid)
            v = self.who.claims
            for part in p[3:]:
                v = v.get(part) if isinstance(v, dict) else None
            return self._python(v)
        if p[0] == "request":
            return self._python(self.request.get(p[1]))
        f = self.t.fields[p[1]]
        if f.kind == "scalar":
            return self._scalar(f.scalar, F.col(p[1]))
        return _Value("set") if f.many else self._linked(f, p[2])

    def _edges(self, f, name: str) -> tuple[DataFrame, DataFrame]:
        theirs = self.catalog.frame(f.target).select(F.col("id").alias("_t"), F.col(name).alias("_v"))
        return self.catalog.edge_frame(self.t, f).select(F.col("src").alias("_s"), F.col("dst").alias("_t")), theirs

    def _linked(self, f, name: str) -> _Value:
        helper = f"_rule_{f.name}_{name}"
        if helper in self.helpers:
            return self.helpers[helper]
        target = self.catalog.schema.types[f.target].fields[name]
        edges, theirs = self._edges(f, name)
        edges = edges.join(self.df.select(F.col("id").alias("_s")), "_s", "left_semi")
        one = edges.join(theirs, "_t").groupBy("_s").agg(F.first("_v").alias(helper))
        self.df = self.df.join(one, self.df["id"] == one["_s"], "left").drop("_s")
        got = self._scalar(target.scalar, F.col(helper))
        self.helpers[helper] = got
        return got

    def _among(self, a: _Value, f, name: str) -> Column:
        """Whether ``a`` is among the values of a to-many link; the links are joined, not collected."""
        if a.kind == "absent":
            return F.lit(None).cast("boolean")
        there = F.lit(True) if a.column is None else a.column.isNotNull()
        if a.kind not in ("str", "num", "bool"):
            return F.when(there, F.lit(False))
        helper = f"_rule_in_{len(self.helpers)}"
        edges, theirs = self._edges(f, name)
        asked = self.df.select(F.col("id").alias("_s"), a.column.alias("_a"))
        text = F.col("_v").cast("string")
        same = text.try_cast("double") == F.col("_a") if a.kind == "num" else text == F.col("_a").cast("string")
        found = edges.join(theirs, "_t").join(asked, "_s").where(same).groupBy("_s").agg(F.lit(True).alias(helper))
        self.df = self.df.join(found, self.df["id"] == found["_s"], "left").drop("_s")
        got = _Value("bool", F.when(there, F.col(helper).isNotNull()))
        self.helpers[helper] = got
        return got.column

    def truth(self, e) -> Column:
        """Nullable boolean: null is unknown."""
        unknown = F.lit(None).cast("boolean")
        if isinstance(e, Node):
            if e.op == "!":
                return ~self.truth(e.args[0])
            if e.op == "&&":
                return self.truth(e.args[0]) & self.truth(e.args[1])
            if e.op == "||":
                return self.truth(e.args[0]) | self.truth(e.args[1])
            if e.op == "in" and _is_many(e.args[1], self.t):
                p = e.args[1].parts
                return self._among(self.value(e.args[0]), self.t.fields[p[1]], p[2])
            return self._compare(e.op, self.value(e.args[0]), self.value(e.args[1]))
        v = self.value(e)
        if v.kind == "bool":
            return v.column
        if v.kind == "auth":
            return F.lit(v.known)
        return F.lit(False) if v.kind == "null" else unknown

    def _compare(self, op: str, a: _Value, b: _Value) -> Column:
        unknown = F.lit(None).cast("boolean")
        if "absent" in (a.kind, b.kind):
            return unknown
        there = F.lit(True)
        for v in (a, b):
            if v.column is not None:
                there &= v.column.isNotNull()
        fixed = lambda r: F.when(there, F.lit(r))  # noqa: E731  unknown where an operand is
        if op == "in":
            if b.kind != "set" or a.kind not in ("str", "num", "bool"):
                return fixed(False)
            if a.kind == "num":
                return F.when(there, F.exists(b.column, lambda x: F.coalesce(x.try_cast("double") == a.column, F.lit(False))))
            return F.when(there, F.array_contains(b.column, a.column.cast("string")))
        if "auth" in (a.kind, b.kind):
            v = a if a.kind == "auth" else b
            return F.lit(v.known == (op == "!="))
        if a.kind == "json" or b.kind == "json":
            # A stored JSON value against a scalar: its text, with strings in quotes.
            text = lambda v: F.to_json(F.struct(v.column.alias("x"))).substr(F.lit(6), F.lit(1 << 20)) if v.kind == "str" else v.column.cast("string")
            if a.kind == b.kind:
                same = a.column == b.column
            elif "null" in (a.kind, b.kind):
                return fixed(op == "!=")
            else:
                j, o = (a, b) if a.kind == "json" else (b, a)
                quoted = F.rtrim(text(o), F.lit("}")) if o.kind == "str" else text(o)
                same = j.column == quoted
            return same if op == "==" else ~same if op == "!=" else fixed(False)
        if a.kind != b.kind or a.kind in ("null", "set"):
            equal = a.kind == b.kind == "null"
            return fixed(equal if op in ("==", "<=", ">=") and equal else op == "!=" and not equal)
        if a.kind == "bool" and op not in ("==", "!="):
            return fixed(False)
        ops = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
        return getattr(a.column, ops[op])(b.column)
