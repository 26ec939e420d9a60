"""JSON in one fixed form, made by column expressions from a column's schema.

The form is that of canonical_json: keys in the order of their code points, ", " and ": " between, all but printable ASCII escaped, so equal values give equal bytes. All of it
runs in the JVM; only doubles, whose shortest form is Python's own, go through an Arrow function.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Escapes with a letter, fixed values.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _u(unit: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(unit.cast("long"))), 4, "0"))


def _escaped(c: Column) -> Column:
    """One character as it stands in a JSON string."""
    point = F.ascii(c)
    over = point - 0x10000
    out = F.when(point > 0xFFFF, F.concat(_u(F.shiftright(over, 10) + 0xD800), _u(over.bitwiseAND(0x3FF) + 0xDC00))).when((point < 32) | (point > 126), _u(point)).otherwise(c)
    for plain, short in reversed(_SHORT.items()):
        out = F.when(c == plain, short).otherwise(out)
    return out


def quoted(c: Column) -> Column:
    """A JSON string; texts without characters to escape, which most are, are not taken apart."""
    each = F.array_join(F.transform(F.split(c, ""), _escaped), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r'[^ -~]|["\\]'), each).otherwise(c), F.lit('"'))


@F.pandas_udf(T.StringType())
def _double(values: pd.Series) -> pd.Series:
    return values.map(json.dumps)


def _doubles(c: Column) -> Column:
    # the mask keeps nulls apart from NaN, which pandas would not
    return F.when(c.isNotNull(), _double(F.coalesce(c.cast("double"), F.lit(0.0))))


def _of(c: Column, kind: T.DataType) -> Column:
    """The JSON text of c; null where c is."""
    if isinstance(kind, T.StringType):
        return quoted(c)
    if isinstance(kind, (*_WHOLE, T.BooleanType)):
        return c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _doubles(c)
    if isinstance(kind, T.DateType):
        return quoted(c.cast("string"))
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        if _has_doubles(kind.elementType):  # a Python function cannot be called inside a lambda
            if not isinstance(kind.elementType, (T.DoubleType, T.FloatType, T.StructType)):
                raise TypeError(f"no canonical form for {kind.simpleString()}")
            return _array_udf(kind)(c)
        inside = F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ", ")
        return F.when(c.isNotNull(), F.concat(F.lit("["), inside, F.lit("]")))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(("" if i == 0 else ", ") + json.dumps(f.name) + ": "), canonical(c[f.name], f.dataType)) for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and not _has_doubles(kind.valueType):
        keys = F.array_sort(F.map_keys(c))
        inside = F.array_join(F.transform(keys, lambda k: F.concat(quoted(k), F.lit(": "), canonical(c[k], kind.valueType))), ", ")
        return F.when(c.isNotNull(), F.concat(F.lit("{"), inside, F.lit("}")))
    raise TypeError(f"no canonical form for {kind.simpleString()}")


def _has_doubles(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_doubles(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_doubles(kind.elementType)
    return _has_doubles(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (T.DoubleType, T.FloatType))


def _array_udf(kind: T.ArrayType):
    """Arrays with doubles in them, from their own JSON: Spark writes a double so that it reads back as the same one."""

    @F.pandas_udf(T.StringType())
    def again(texts: pd.Series) -> pd.Series:
        special = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}

        def back(value, of):
            if isinstance(of, T.ArrayType):
                return None if value is None else [back(v, of.elementType) for v in value]
            if isinstance(of, T.StructType):
                return None if value is None else {f.name: back(value[f.name], f.dataType) for f in of.fields}
            return special.get(value, value) if isinstance(of, (T.DoubleType, T.FloatType)) else value

        return texts.map(lambda t: None if t is None else json.dumps(back(json.loads(t), kind), sort_keys=True))

    return lambda c: again(F.to_json(c, {"ignoreNullFields": "false"}))


def canonical(c: Column, kind: T.DataType) -> Column:
    """The canonical JSON text of a column of this type; null gives null as JSON writes it.

    Types: strings, booleans, whole numbers, doubles, dates, arrays, structs, and maps from strings (to values without doubles); others are a TypeError.
    """
    return F.coalesce(_of(c, kind), F.lit("null"))
