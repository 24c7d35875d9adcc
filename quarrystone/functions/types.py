"""Which column types a table may have when it is committed, and which can be ordered."""

from __future__ import annotations

from pyspark.sql import types as T

DECIMAL = T.DecimalType(18, 3)

_SCALARS = (
    T.NullType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType,
)
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.DateType)


class UnsupportedType(TypeError):
    """A nested column in a table that is to be committed."""


def committable(kind: T.DataType) -> bool:
    return isinstance(kind, _SCALARS)


def orderable(kind: T.DataType) -> bool:
    """Whether < and sorting are covered by certificates; floats only once they are decimals."""
    return isinstance(kind, _ORDERED)


def require_committable(schema: T.StructType) -> None:
    bad = [f"{f.name}: {f.dataType.simpleString()}" for f in schema if not committable(f.dataType)]
    if bad:
        raise UnsupportedType(f"nested columns cannot be committed ({', '.join(bad)})")
