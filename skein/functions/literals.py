"""Literals against field types: dates, coercion for writes."""

from __future__ import annotations

import base64
import datetime as dt
import math
import re

from ..errors import QueryTypeError
from ..plans.ast import Json
from ..plans.parser import canonical_json
from ..plans.sdl import INT_RANGE

_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)")
_EPOCH = dt.datetime(1970, 1, 1)


def parse_datetime(text: str) -> int | None:
    """Milliseconds since 1970 in UTC, finer parts cut off; None if the text is no RFC 3339 date."""
    m = _RFC3339.fullmatch(text.strip())
    if not m:
        return None
    try:
        at = dt.datetime(*(int(x) for x in m.groups()[:6]))
    except ValueError:
        return None
    millis = (at - _EPOCH) // dt.timedelta(seconds=1) * 1000 + int(((m[7] or "") + "000")[:3])
    if m[8] not in "Zz":
        hours, minutes = int(m[8][1:3]), int(m[8][4:])
        if hours > 23 or minutes > 59:
            return None
        millis -= (1 if m[8][0] == "+" else -1) * (hours * 60 + minutes) * 60_000
    return millis


def from_millis(millis: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(milliseconds=millis)


def coerce(value, scalar: str | None, where: str):
    """The Python value to store for a literal in a field of type ``scalar``; null fits every type."""
    if value is None:
        return None

    def wrong():
        raise QueryTypeError(f"{where}: {value!r} does not fit {scalar}")

    if scalar == "Json":
        return value.text if isinstance(value, Json) else canonical_json(value)
    if isinstance(value, Json):
        wrong()
    if scalar == "String":
        return value if isinstance(value, str) else wrong()
    if scalar == "Bool":
        return value if isinstance(value, bool) else wrong()
    if scalar in INT_RANGE:
        low, high = INT_RANGE[scalar]
        return value if isinstance(value, int) and not isinstance(value, bool) and low <= value <= high else wrong()
    if scalar in ("f32", "f64"):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else wrong()
    if scalar == "DateTime":
        millis = parse_datetime(value) if isinstance(value, str) else value if isinstance(value, int) and not isinstance(value, bool) else None
        return from_millis(millis) if millis is not None else wrong()
    if scalar == "Bytes":
        try:
            return base64.b64decode(value, validate=True) if isinstance(value, str) else wrong()
        except ValueError:
            wrong()
    wrong()


def check_vector(values, dim: int, where: str) -> list[float]:
    out = [float(v) for v in values]
    if len(out) != dim or not all(map(math.isfinite, out)):
        raise QueryTypeError(f"{where}: a vector of {dim} finite numbers is needed")
    return out
