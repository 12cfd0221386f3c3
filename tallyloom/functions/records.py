"""Column functions for JSON text, times, maps and padded sequences. Python is used only where JSON must be walked to any depth."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _no_constant(name: str):
    raise ValueError(name)


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys, no spaces and raw UTF-8; None if the text isn't JSON, or holds NaN or an infinity."""
    try:
        value = json.loads(text, parse_constant=_no_constant)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError, RecursionError):
        return None


def same_json(left: object, right: object) -> bool:
    """Deep equality: numbers by value, a boolean is no number, keys in any order, lists in order."""
    if isinstance(left, dict) and isinstance(right, dict):
        return left.keys() == right.keys() and all(same_json(v, right[k]) for k, v in left.items())
    if isinstance(left, list) and isinstance(right, list):
        return len(left) == len(right) and all(map(same_json, left, right))
    numbers = (int, Decimal)
    if isinstance(left, bool) or isinstance(right, bool):
        return left is right
    if isinstance(left, numbers) and isinstance(right, numbers):
        return left == right
    return type(left) is type(right) and left == right


def equivalent_texts(left: str | None, right: str | None) -> bool | None:
    """same_json of two texts; None if either isn't JSON."""
    try:
        return same_json(*(json.loads(t, parse_float=Decimal, parse_constant=_no_constant) for t in (left, right)))
    except (TypeError, ValueError, RecursionError):
        return None


def canonical_json(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(canonical), "string")(text)


def equivalent_json(left: Column, right: Column) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series([equivalent_texts(x, y) for x, y in zip(a, b, strict=True)], dtype=object), "boolean")(left, right)


def pointer_token(name: Column) -> Column:
    """A key as a step of a JSON pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def utc_timestamp(text: Column) -> Column:
    """The time of an ISO text whose offset is zero (Z, +00:00 or -00:00); null for any other."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-]00:00)$"
    return F.when(text.rlike(shape), F.try_to_timestamp(F.regexp_replace(text, "(Z|[+-]00:00)$", "Z")))


def changed_keys(before: Column, after: Column) -> Column:
    """Sorted keys whose values differ between two maps; a missing key differs from every value but null."""
    both = F.map_zip_with(before, after, lambda k, x, y: ~x.eqNullSafe(y))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, differs: differs)))


def padded(ids: Column, pad: int, size: Column) -> Column:
    """ids with pads on the right up to `size`; null if size is null or smaller than the ids."""
    return F.when(F.size(ids) <= size, F.concat(ids, F.array_repeat(F.lit(pad), (size - F.size(ids)).cast("int"))))
