"""Parsing of recorded model replies: fences, truncated JSON, coercion."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, strip_fences


def close_truncated(text: str) -> str | None:
    """A JSON object cut off somewhere, ended after its last complete top-level field; None where there is none."""
    depth, quoted, skip, cut = 0, False, False, -1
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth = max(depth - 1, 0)
        elif c == "," and depth == 1:
            cut = i
    start = text.lstrip()[:1]
    if cut < 0 or start not in ("{", "["):
        return None
    fixed = text[:cut].rstrip() + ("}" if start == "{" else "]")
    try:
        json.loads(fixed)
    except ValueError:
        return None
    return fixed


@F.pandas_udf(T.StringType())
def _closed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else close_truncated(t))


def reply_json(raw: Column | str, repair: bool = True) -> Column:
    """The reply as VARIANT: fences stripped, repaired only where it doesn't parse; null where nothing helps."""
    text = strip_fences(raw)
    parsed = F.try_parse_json(text)
    return F.coalesce(parsed, F.try_parse_json(F.when(parsed.isNull() & text.isNotNull(), _closed(text)))) if repair else parsed


def text_of(v: Column | str, path: str, default: str | None = "") -> Column:
    return F.coalesce(F.try_variant_get(col(v), f"$.{path}", "string"), F.lit(default).cast("string"))


def list_of(v: Column | str, path: str) -> Column:
    """A list of texts; a single value as a list of one, nothing as an empty list; blank entries stay."""
    many = F.try_variant_get(col(v), f"$.{path}", "array<string>")
    one = F.try_variant_get(col(v), f"$.{path}", "string")
    return F.coalesce(F.filter(many, lambda x: x.isNotNull()), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def int_of(v: Column | str, path: str) -> Column:
    """A whole number, from a number or its text; null otherwise."""
    text = F.try_variant_get(col(v), f"$.{path}", "string")
    return F.coalesce(F.try_variant_get(col(v), f"$.{path}", "double").cast("int"), F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.try_to_number(F.trim(text), F.lit("S999999999")).cast("int")))


def double_of(v: Column | str, path: str) -> Column:
    return F.try_variant_get(col(v), f"$.{path}", "double")


def bool_of(v: Column | str, path: str, default: bool) -> Column:
    return F.coalesce(F.try_variant_get(col(v), f"$.{path}", "boolean"), F.lit(default))


def map_of(v: Column | str, path: str, kind: str = "map<string,string>") -> Column:
    return F.coalesce(F.try_variant_get(col(v), f"$.{path}", kind), F.from_json(F.lit("{}"), kind))
