"""Parser of the path language: ``Type.filter(..).relation.matches(..).limit(n)``."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from ..errors import QuerySyntaxError
from . import ast as A

_INT = re.compile(r"-?[0-9]+")
_FLOAT = re.compile(r"-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)")
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t", "r": "\r"}
_OPS = ("==", "!=", "<=", ">=", "<", ">")


def canonical_json(value) -> str:
    """Key order does not count; 1 and 1.0 stay apart."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class _Parser:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def fail(self, message: str):
        raise QuerySyntaxError(f"{message} at {self.i}")

    def space(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def at(self, word: str) -> bool:
        self.space()
        return self.s.startswith(word, self.i)

    def accept(self, word: str) -> bool:
        if self.at(word):
            self.i += len(word)
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.accept(word):
            self.fail(f"expected {word!r}")

    def ident(self) -> str:
        self.space()
        start = self.i
        while self.i < len(self.s) and (self.s[self.i].isalnum() or self.s[self.i] == "_"):
            self.i += 1
        if start == self.i:
            self.fail("expected a name")
        return self.s[start : self.i]

    def integer(self) -> int:
        self.space()
        m = _INT.match(self.s, self.i)
        if not m:
            self.fail("expected a whole number")
        v = int(m[0])
        if not -(2**63) <= v < 2**63:
            self.fail("number out of range")
        self.i = m.end()
        return v

    def count(self) -> int:
        n = self.integer()
        if n < 0:
            self.fail("a count cannot be negative")
        return n

    def number(self) -> int | float:
        self.space()
        if m := _FLOAT.match(self.s, self.i):
            self.i = m.end()
            return float(m[0])
        return self.integer()

    def string(self) -> str:
        self.expect('"')
        out = []
        while True:
            if self.i >= len(self.s):
                self.fail("unterminated string")
            c = self.s[self.i]
            self.i += 1
            if c == '"':
                return "".join(out)
            if c == "\\" and self.i < len(self.s):
                e = self.s[self.i]
                self.i += 1
                out.append(_ESCAPES.get(e, "\\" + e))
            else:
                out.append(c)

    def container(self) -> A.Json:
        start, depth, quoted = self.i, 0, False
        while self.i < len(self.s):
            c = self.s[self.i]
            if quoted:
                if c == "\\":
                    self.i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    self.i += 1
                    try:
                        return A.Json(canonical_json(json.loads(self.s[start : self.i])))
                    except ValueError as e:
                        self.fail(f"bad JSON ({e})")
            self.i += 1
        self.fail("unterminated JSON")

    def literal(self):
        self.space()
        c = self.s[self.i : self.i + 1]
        if c == '"':
            return self.string()
        if c and c in "{[":
            return self.container()
        for word, value in (("true", True), ("false", False), ("null", None)):
            if self.s.startswith(word, self.i) and not (self.s[self.i + len(word) : self.i + len(word) + 1].isalnum() or self.s[self.i + len(word) : self.i + len(word) + 1] == "_"):
                self.i += len(word)
                return value
        if c and (c.isdigit() or c == "-"):
            return self.number()
        self.fail("expected a value")

    def object(self) -> tuple:
        self.expect("{")
        out: dict = {}
        while not self.accept("}"):
            name = self.ident()
            self.expect(":")
            out[name] = self.literal()
            self.accept(",")
        return tuple(out.items())

    # Predicates: "or" binds weaker than "and", both to the left.
    def predicate(self):
        left = self.conjunction()
        while self.accept("||") or self.accept("or "):
            left = A.Or(left, self.conjunction())
        return left

    def conjunction(self):
        left = self.term()
        while self.accept("&&") or self.accept("and "):
            left = A.And(left, self.term())
        return left

    def term(self):
        if self.accept("("):
            inner = self.predicate()
            self.expect(")")
            return inner
        self.expect(".")
        path = self.ident()
        while self.accept("."):
            name = self.ident()
            if name == "contains" and self.accept("("):
                needle = self.string()
                self.expect(")")
                return A.Contains(path, needle)
            path += "." + name
        for op in _OPS:
            if self.accept(op):
                return A.Compare(path, op, self.literal())
        self.fail("expected a comparison")

    def query(self) -> A.Query:
        name = self.ident()
        source, steps = A.All(), []
        collection_limited = False
        first = True
        while self.accept("."):
            step = self.ident()
            if not self.at("("):
                steps.append(A.Traverse(step))
                collection_limited = first = False
                continue
            self.expect("(")
            if first and step in ("get", "filter", "create", "create_batch"):
                source = self.source(step)
                first = False
                continue
            first = False
            made = self.step(step)
            if isinstance(made, A.Limit):
                collection_limited = True
            elif isinstance(made, A.Offset) and collection_limited:
                self.fail(".offset must come before .limit")
            elif isinstance(made, (A.Similar, A.Matches)):
                collection_limited = False
            steps.append(made)
        self.space()
        if self.i < len(self.s):
            self.fail("unexpected text after the query")
        return A.Query(name, source, tuple(steps))

    def source(self, step: str):
        if step == "get":
            made = A.Get(self.integer())
            if made.id < 0:
                self.fail("an id cannot be negative")
        elif step == "filter":
            made = A.Filter(self.predicate())
        elif step == "create":
            made = A.Create(self.object())
        else:
            self.expect("[")
            rows = []
            while not self.accept("]"):
                rows.append(self.object())
                self.accept(",")
            made = A.CreateBatch(tuple(rows))
        self.expect(")")
        return made

    def reference(self) -> tuple[str, int]:
        name = self.ident()
        self.expect(".")
        if self.ident() != "get":
            self.fail("expected Type.get(id)")
        self.expect("(")
        id_ = self.integer()
        if id_ < 0:
            self.fail("an id cannot be negative")
        self.expect(")")
        return name, id_

    def named_counts(self, allowed: tuple[str, ...]) -> dict[str, int]:
        out: dict[str, int] = {}
        while self.accept(","):
            if self.at(")"):
                break
            name = self.ident()
            if name not in allowed or name in out:
                self.fail(f"{'unknown' if name not in allowed else 'repeated'} argument {name}")
            self.expect(":")
            out[name] = self.count()
        if out.get("ef") == 0:
            self.fail("ef must be at least 1")
        if "k" not in out:
            self.fail("k is missing")
        return out

    def step(self, step: str):
        if step == "filter":
            made = A.Filter(self.predicate())
        elif step == "similar":
            self.expect(".")
            name = self.ident()
            self.expect(",")
            query = self.string() if self.at('"') else self.vector()
            made = A.Similar(name, query, **self.named_counts(("k", "ef", "rerank")))
        elif step == "matches":
            self.expect(".")
            name = self.ident()
            self.expect(",")
            text = self.string()
            made = A.Matches(name, text, **self.named_counts(("k",)))
        elif step == "update":
            made = A.Update(self.object())
        elif step == "delete":
            made = A.Delete()
        elif step == "link":
            type_name, id_ = self.reference()
            fields = self.object() if self.accept(",") and not self.at(")") else ()
            made = A.Link(type_name, id_, fields)
        elif step == "unlink":
            made = A.Unlink(*self.reference())
            self.accept(",")
        elif step == "limit":
            made = A.Limit(self.count())
        elif step == "offset":
            made = A.Offset(self.count())
        else:
            self.fail(f"unknown step {step}")
        self.expect(")")
        return made

    def vector(self) -> tuple:
        self.expect("[")
        out = []
        while not self.accept("]"):
            out.append(float(self.number()))
            self.accept(",")
        return tuple(out)


@lru_cache(256)
def parse_query(text: str) -> A.Query:
    """The tree of ``text``; parsed trees are kept, as they never change."""
    return _Parser(text).query()
