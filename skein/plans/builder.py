"""A fluent builder of query texts: ``Q("User").filter(F_("age") > 22).hop("friends").limit(10).text()``."""

from __future__ import annotations

import json


def literal(v) -> str:
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    if isinstance(v, float):
        return repr(v) if "e" in repr(v) or "." in repr(v) else f"{v}.0"
    return json.dumps(v)


class Cond:
    def __init__(self, text: str):
        self.text = text

    def __and__(self, other: Cond) -> Cond:
        return Cond(f"({self.text} && {other.text})")

    def __or__(self, other: Cond) -> Cond:
        return Cond(f"({self.text} || {other.text})")


class F_:  # noqa: N801
    """A field in a condition."""

    __hash__ = None

    def __init__(self, name: str):
        self.name = name

    def _cmp(self, op: str, v) -> Cond:
        return Cond(f".{self.name} {op} {literal(v)}")

    def __eq__(self, v) -> Cond:  # type: ignore[override]
        return self._cmp("==", v)

    def __ne__(self, v) -> Cond:  # type: ignore[override]
        return self._cmp("!=", v)

    def __lt__(self, v) -> Cond:
        return self._cmp("<", v)

    def __le__(self, v) -> Cond:
        return self._cmp("<=", v)

    def __gt__(self, v) -> Cond:
        return self._cmp(">", v)

    def __ge__(self, v) -> Cond:
        return self._cmp(">=", v)

    def contains(self, needle: str) -> Cond:
        return Cond(f".{self.name}.contains({literal(needle)})")


def _object(fields: dict) -> str:
    return "{" + ", ".join(f"{k}: {literal(v)}" for k, v in fields.items()) + "}"


class Q:
    def __init__(self, type_name: str, parts: tuple[str, ...] = ()):
        self.parts = parts or (type_name,)

    def _add(self, text: str) -> Q:
        return Q("", (*self.parts, text))

    def get(self, id_: int) -> Q:
        return self._add(f"get({id_})")

    def filter(self, cond: Cond) -> Q:
        return self._add(f"filter({cond.text})")

    def hop(self, name: str) -> Q:
        return self._add(name)

    def matches(self, name: str, text: str, k: int) -> Q:
        return self._add(f"matches(.{name}, {literal(text)}, k: {k})")

    def similar(self, name: str, query, k: int, **more: int) -> Q:
        value = literal(query) if isinstance(query, str) else "[" + ", ".join(repr(float(x)) for x in query) + "]"
        return self._add(f"similar(.{name}, {value}, k: {k}" + "".join(f", {n}: {v}" for n, v in more.items()) + ")")

    def limit(self, n: int) -> Q:
        return self._add(f"limit({n})")

    def offset(self, n: int) -> Q:
        return self._add(f"offset({n})")

    def create(self, **fields) -> Q:
        return self._add(f"create({_object(fields)})")

    def create_batch(self, rows: list[dict]) -> Q:
        return self._add("create_batch([" + ", ".join(_object(r) for r in rows) + "])")

    def update(self, **fields) -> Q:
        return self._add(f"update({_object(fields)})")

    def delete(self) -> Q:
        return self._add("delete()")

    def link(self, type_name: str, id_: int, **fields) -> Q:
        return self._add(f"link({type_name}.get({id_})" + (f", {_object(fields)}" if fields else "") + ")")

    def unlink(self, type_name: str, id_: int) -> Q:
        return self._add(f"unlink({type_name}.get({id_}))")

    def text(self) -> str:
        return ".".join(self.parts)
