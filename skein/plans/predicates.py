"""Predicates as columns.

Comparisons are two-valued: nulls, fields that are no scalars and values of another kind do not match.
Floats compare as IEEE numbers (NaN equals nothing and has no order). A column of the type's frame that is
NULL counts as an explicit null, unless the frame tells absent fields apart in ``_present`` (an array of
the names that are there): an absent field matches nothing, ``== null`` included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryTypeError
from ..functions.literals import from_millis, parse_datetime
from . import ast as A
from .parser import canonical_json
from .sdl import INT_RANGE, TypeDef

PRESENT = "_present"
_OPS = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def validate(p, t: TypeDef) -> None:
    """Raise what must be told before anything runs."""
    if isinstance(p, (A.And, A.Or)):
        validate(p.left, t)
        validate(p.right, t)
        return
    root = t.fields.get(p.path.split(".")[0])
    scalar = root.scalar if root else None
    where = f"{t.name}.{p.path}"
    if isinstance(p, A.Contains):
        if "." in p.path or scalar != "String":
            raise QueryTypeError(f"{where}: contains is for String fields")
        return
    if scalar == "Json":
        if "." in p.path:
            raise QueryTypeError(f"{where}: there are no paths into Json")
        if p.op not in ("==", "!="):
            raise QueryTypeError(f"{where}: Json has no order")
    elif scalar == "Bytes" and (p.value is not None or p.op not in ("==", "!=")):
        raise QueryTypeError(f"{where}: Bytes can only be compared to null")


def _ieee(c: Column, op: str, value: float) -> Column:
    if value != value:
        return F.lit(op == "!=") & c.isNotNull()
    made = getattr(c, _OPS[op])(F.lit(float(value)))
    return made | F.isnan(c) if op == "!=" else made & ~F.isnan(c)


def _compare(c: Column, scalar: str, op: str, v) -> Column:
    if v is None:
        return c.isNull() if op == "==" else c.isNotNull() if op == "!=" else F.lit(False)
    apply = getattr(c, _OPS[op])
    if scalar == "Json":
        # Stored text is canonical, so equal values have equal text.
        return apply(F.lit(v.text if isinstance(v, A.Json) else canonical_json(v)))
    if isinstance(v, A.Json):
        return F.lit(False)
    if scalar == "Bool":
        return apply(F.lit(v)) if isinstance(v, bool) and op in ("==", "!=") else F.lit(False)
    if isinstance(v, bool):
        return F.lit(False)
    if scalar == "String":
        return apply(F.lit(v)) if isinstance(v, str) else F.lit(False)
    if scalar == "DateTime":
        millis = parse_datetime(v) if isinstance(v, str) else v if isinstance(v, int) else None
        if millis is None:
            return F.lit(False)
        try:
            return apply(F.lit(from_millis(millis)).cast("timestamp_ntz"))
        except OverflowError:
            return F.lit(op in ("!=", "<", "<=") if millis > 0 else op in ("!=", ">", ">="))
    if isinstance(v, str):
        return F.lit(False)
    if scalar in INT_RANGE:
        if isinstance(v, float):
            return _ieee(c.cast("double"), op, v)
        return getattr(c.cast("decimal(20,0)"), _OPS[op])(F.lit(v).cast("decimal(20,0)")) if scalar == "u64" else apply(F.lit(v).cast("bigint"))
    if scalar in ("f32", "f64"):
        return _ieee(c.cast("double"), op, float(v))
    return F.lit(False)


def to_column(p, t: TypeDef, present: bool = False) -> Column:
    """``present``: the frame has a ``_present`` column."""
    if isinstance(p, A.And):
        return to_column(p.left, t, present) & to_column(p.right, t, present)
    if isinstance(p, A.Or):
        return to_column(p.left, t, present) | to_column(p.right, t, present)
    f = t.fields.get(p.path)
    if f is None or f.kind != "scalar":
        return F.lit(False)
    c = F.col(p.path)
    if isinstance(p, A.Contains):
        return F.coalesce(F.contains(c, F.lit(p.needle)), F.lit(False))
    made = _compare(c, f.scalar, p.op, p.value)
    if p.value is None:
        return made & F.array_contains(PRESENT, p.path) if present else made
    return F.coalesce(made, F.lit(False)) if present else made
