"""Column functions that the operators share."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"(?U)^\s*$"


def is_blank(c: Column) -> Column:
    """Null, empty, or white space of any script only."""
    return F.coalesce(c.rlike(_BLANK), F.lit(True))


def micros(c: Column) -> Column:
    """Microseconds since the epoch; timestamps without a zone count as UTC in a UTC session."""
    return F.unix_micros(c.cast("timestamp"))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (later - earlier) / F.lit(1e6)


def ratio(n: Column, d: Column, otherwise: float) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(otherwise))


def fixed(c: Column, digits: int) -> Column:
    """The double with so many digits, ties as Python and SQL engines with exact binary values round them."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return shown(c.cast("double"))


def canonical_json(value) -> str:
    """Keys in order, so that equal values give equal bytes."""
    return json.dumps(value, sort_keys=True, default=str)
