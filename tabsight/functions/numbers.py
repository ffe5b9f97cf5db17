"""Columns as numbers, whatever their type (F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types with a cast to double; dates, times, binary and nested values have none.
NUMBER_LIKE = (T.NumericType, T.BooleanType, T.StringType)


def is_number_like(dt: T.DataType) -> bool:
    return isinstance(dt, NUMBER_LIKE)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double: unparseable values and columns of other types are NULL, NaN as well."""
    if not is_number_like(df.schema[name].dataType):
        return F.lit(None).cast("double")
    number = F.col(f"`{name}`").try_cast("double")
    if isinstance(df.schema[name].dataType, T.StringType):
        # every refused text costs an exception in the cast: texts without a digit are no numbers but NaN and infinities
        number = F.when(F.col(f"`{name}`").rlike("(?i)[0-9]|inf|nan"), number)
    return F.when(~F.isnan(number), number)
