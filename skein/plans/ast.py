"""The query tree: a source and the steps after it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Json:
    """A JSON container written as a literal; ``text`` is canonical."""

    text: str


@dataclass(frozen=True)
class Compare:
    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class Contains:
    path: str
    needle: str


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Get:
    id: int


@dataclass(frozen=True)
class Filter:
    predicate: Any


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Create:
    fields: tuple


@dataclass(frozen=True)
class CreateBatch:
    rows: tuple


@dataclass(frozen=True)
class Traverse:
    field: str


@dataclass(frozen=True)
class Similar:
    field: str
    query: Any  # text, or a tuple of numbers
    k: int
    ef: int | None = None
    rerank: int | None = None


@dataclass(frozen=True)
class Matches:
    field: str
    text: str
    k: int


@dataclass(frozen=True)
class Update:
    fields: tuple


@dataclass(frozen=True)
class Delete:
    pass


@dataclass(frozen=True)
class Link:
    target_type: str
    target_id: int
    fields: tuple = ()


@dataclass(frozen=True)
class Unlink:
    target_type: str
    target_id: int


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Offset:
    n: int


@dataclass(frozen=True)
class Query:
    type_name: str
    source: Any
    steps: tuple
