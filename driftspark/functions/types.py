"""The five type classes and numeric coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_STRINGS = (T.StringType, T.CharType, T.VarcharType)

_NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def type_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, _INTS):
        return "int"
    if isinstance(data_type, _FLOATS):
        return "float"
    if isinstance(data_type, _STRINGS):
        return "string"
    return "object"


# Classes a column takes when a null forces a wider in-memory type.
WITH_NULLS = {"bool": "object", "int": "float", "string": "object"}


def is_missing(column: Column, data_type: T.DataType) -> Column:
    """Null, or NaN for floating types."""
    if isinstance(data_type, _FLOATS):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def numeric_coerce(text: Column) -> Column:
    """Text to DOUBLE; null where it is no number.

    The pattern keeps out what the cast takes beyond numbers (``1d``, ``0x1p3``); NaN becomes null.
    """
    return F.when(text.rlike(_NUMBER_TEXT), F.trim(text).try_cast("double"))
