"""Texts of numbers and records for keys: ECMAScript's number text, canonical JSON, length-prefixed records and locale order."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def js_number(value: float) -> str:
    """The shortest text that reads back as value, as ECMAScript writes it."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "0"
    sign = "-" if value < 0 else ""
    digits, _, power = f"{abs(value)!r}".partition("e")
    whole, _, part = digits.partition(".")
    point = len(whole) + int(power or 0)
    text = (whole + ("" if part == "0" else part)).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0")) if whole.strip("0") == "" else 0
    text = text.rstrip("0")
    n = len(text)
    if n <= point <= 21:
        return sign + text + "0" * (point - n)
    if 0 < point <= 21:
        return sign + text[:point] + "." + text[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + text
    e = point - 1
    return f"{sign}{text[0]}{'.' + text[1:] if n > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"


@F.pandas_udf(T.StringType())
def js_number_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else js_number(float(v)))


def canonical_json(value) -> str:
    """JSON with sorted keys, no spaces and ECMAScript's numbers."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return js_number(float(value))


def record_key(*fields: Column) -> Column:
    """Fields with their lengths before them, so that no two different records read alike."""
    return F.concat_ws("", *[F.concat(F.length(F.coalesce(f.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(f.cast("string"), F.lit(""))) for f in fields])


def locale_key(text: Column) -> Column:
    """Sorts as readers of a language expect: letters before their case."""
    return F.collate(text, "UNICODE")
