"""Column normalization, run before any check. One expression per column, one select in all."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rowassay.functions.text import as_text, change_case, col, null_if_token, printable, strip


def normalized(c: Column, dtype: T.DataType, spec: dict | None) -> Column:
    """Trim, drop unprintable characters, null out tokens, change case, in that order.

    Typed columns keep their type unless a token or a case rule needs their text.
    """
    if not spec:
        return c
    if isinstance(dtype, T.StringType):
        if spec.get("trim_whitespace", True):
            c = strip(c)
        if spec.get("remove_non_printable", True):
            c = printable(c)
        c = null_if_token(c, spec.get("null_tokens") or [])
        return change_case(c, spec.get("case"))
    text = as_text(c, dtype)
    # only tokens that a value of this type can print as
    tokens = [t for t in spec.get("null_tokens") or [] if re.search(r"\d|inf|True|False", t)]
    if spec.get("case") in ("lower", "upper", "title"):
        return change_case(null_if_token(text, tokens), spec["case"])
    return F.when(~text.isin(tokens), c) if tokens else c


def normalize(df: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Normalize the named columns in place."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            normalized(col(n), types[n], specs.get(n)).alias(n) if specs.get(n) else col(n)
            for n in df.columns
        ]
    )
