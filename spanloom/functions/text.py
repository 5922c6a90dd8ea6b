"""Nested values and texts that need Python, in batches."""

from __future__ import annotations

import ast
import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.events import REDACTED, SECRET_KEYS

_SECRET = re.compile(SECRET_KEYS)


def _redact(value: object) -> object:
    if isinstance(value, dict):
        return {k: REDACTED if _SECRET.search(str(k)) else _redact(v) for k, v in value.items()}
    return [_redact(v) for v in value] if isinstance(value, list) else value


def _summarise(value: object, depth: int, items: int, chars: int) -> object:
    if isinstance(value, str):
        return value if len(value) <= chars else f"{value[:chars]}…(+{len(value) - chars} chars)"
    if isinstance(value, dict | list) and depth <= 0:
        return f"<{type(value).__name__}>"
    if isinstance(value, dict):
        kept = {k: _summarise(v, depth - 1, items, chars) for k, v in list(value.items())[:items]}
        return kept | ({"…": f"+{len(value) - items} more"} if len(value) > items else {})
    if isinstance(value, list):
        return [_summarise(v, depth - 1, items, chars) for v in value[:items]] + ([f"…+{len(value) - items} more"] if len(value) > items else [])
    return value


def _each(texts: pd.Series, change) -> pd.Series:  # noqa: ANN001
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(change(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return t

    return pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def redact_nested(texts: pd.Series) -> pd.Series:
    """JSON with values under secret keys replaced at every level; other text is left as it is."""
    return _each(texts, _redact)


def summarise_nested(text: Column, depth: int = 6, items: int = 200, chars: int = 2000) -> Column:
    """JSON with long texts, long lists and deep levels cut and marked."""

    @F.pandas_udf(StringType())
    def summarise(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda v: _summarise(v, depth, items, chars))

    return summarise(text)


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Character references decoded twice at most, once if that changes nothing more."""
    return pd.Series([None if t is None else html.unescape(html.unescape(t)) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def normalise_payload(texts: pd.Series) -> pd.Series:
    """JSON, or a Python literal turned into JSON; null if it is neither."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(json.loads(t), ensure_ascii=False)
        except ValueError:
            pass
        try:
            return json.dumps(ast.literal_eval(t), ensure_ascii=False, default=str)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)
