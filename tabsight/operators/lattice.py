"""Column facts of a whole table in one scan: a mergeable set of types per column.

Every row becomes one small row per column (explode of an array of structs), so
the plan has one scan, one expression per fact and one exchange of a row per
column and task, whether the table has five columns or five thousand. The set
of types that a text value fits is a bit mask; the types of a column are the
``bit_and`` of its values' masks. Bits are ordered from the narrowest type to
the widest, date formats by preference, so the first bit left decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions import distinct
from tabsight.functions.text import strip_ws

UNKNOWN = "Unknown"

# Datetime formats in order of preference. A column is promoted only if every value parses with one of
# them; where day and month could change places for all values, the month comes first.
DEFAULT_DATE_FORMATS = (
    "yyyy-M-d H:mm:ss[.SSSSSS]",
    "yyyy-M-d'T'H:mm:ss[.SSSSSS]",
    "yyyy-M-d'T'H:mm:ss[.SSSSSS]XXX",
    "yyyy-M-d H:mm:ss[.SSSSSS]XXX",
    "yyyy-M-d'T'H:mm",
    "yyyy-M-d H:mm",
    "yyyy-M-d",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "d.M.yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
)
BOOL_TOKENS = ("true", "false")
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
#: Values of any date format start like this; others never reach the (exception-driven) parser.
DATE_START = r"^[0-9A-Za-z]{1,9}[-/. ]"
LONG, INTEGER, DOUBLE, BOOLEAN, FIRST_DATE = range(5)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# What the letters of a format stand for.
FORMAT_PARTS = {"yyyy": "[0-9]{4}", "SSSSSS": "[0-9]{1,6}", "XXX": r"(?:Z|[+-][0-9]{2}:[0-9]{2})", "MMMM": "[A-Za-z]{3,9}",
                "MMM": "[A-Za-z]{3}", "MM": "[0-9]{1,2}", "M": "[0-9]{1,2}", "dd": "[0-9]{1,2}", "d": "[0-9]{1,2}",
                "HH": "[0-9]{1,2}", "H": "[0-9]{1,2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "'T'": "T", "[": "(?:", "]": ")?",
                ".": r"\."}


def date_shape(fmt: str) -> str:
    """The regular expression of what a format can parse: digits for digits, names for names."""
    out, i = "^", 0
    while i < len(fmt):
        token = next((t for t in sorted(FORMAT_PARTS, key=len, reverse=True) if fmt.startswith(t, i)), fmt[i])
        out += FORMAT_PARTS.get(token, token)
        i += len(token)
    return out + "$"


def number(col: Column) -> Column:
    return F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))


def timestamp(col: Column, fmt: str) -> Column:
    """The value under a format; null where its shape does not fit, so that nothing is parsed in vain."""
    return F.when(col.rlike(DATE_START) & col.rlike(date_shape(fmt)), F.try_to_timestamp(col, F.lit(fmt)))


def type_mask(text: Column, value: Column, date_formats=DEFAULT_DATE_FORMATS) -> Column:
    """Bits of all types that a text value fits; ``value`` is its :func:`number`.

    The formats sit in a lambda: generated code for all of them would make the
    methods that every cell passes too long to be compiled.
    """
    bit = lambda k, on: F.when(on, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    whole = F.when(text.rlike(INTEGER_PATTERN), bit(LONG, text.try_cast("bigint").isNotNull())
                   + bit(INTEGER, text.try_cast("decimal(38,0)").isNotNull())).otherwise(F.lit(0).cast("long"))

    def dates(found: Column, t: Column) -> Column:
        for j, fmt in enumerate(date_formats):
            found = found + bit(FIRST_DATE + j, timestamp(t, fmt).isNotNull())
        return found

    return (F.when(value.isNotNull(), whole + F.lit(1 << DOUBLE).cast("long"))
            .when(text.rlike(DATE_START), F.aggregate(F.array(text), F.lit(0).cast("long"), dates))
            .otherwise(bit(BOOLEAN, F.lower(text).isin(*BOOL_TOKENS))))


@dataclass
class Facts:
    """Of one column: values that are not null, bits of the types they all fit, least and greatest number,
    number of ``true``, lower bound of the distinct texts after strip."""

    count: int
    mask: int
    least: float | None
    greatest: float | None
    true: int
    distinct_bound: int

    def fits(self, bit: int) -> bool:
        return bool(self.count and self.mask >> bit & 1)

    def date_format(self, date_formats) -> str | None:
        return next((f for j, f in enumerate(date_formats) if self.fits(FIRST_DATE + j)), None)


@dataclass
class TableFacts:
    rows_in: int
    rows: int                       # with any value
    columns: dict[str, Facts]


def facts_frame(df: DataFrame, date_formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """One row per column (``at``, its place) and one for the rows (-1)."""
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    cells, some = [], F.lit(False)
    for i, f in enumerate(df.schema.fields):
        c = _q(f.name)
        some = some | c.isNotNull()
        text = c if isinstance(f.dataType, T.StringType) else none_text
        if isinstance(f.dataType, T.BooleanType):
            value = c.cast("int").cast("double")
        else:
            value = c.cast("double") if isinstance(f.dataType, NUMERIC_TYPES) else none_number
        cells.append(F.struct(F.lit(i).alias("at"), c.isNotNull().alias("present"), text.alias("text"), value.alias("number")))
    cells.append(F.struct(F.lit(-1).alias("at"), some.alias("present"), none_text.alias("text"), none_number.alias("number")))
    cell = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    text, value = F.col("text"), F.col("value")
    cell = cell.select("at", "present", "text", "number", F.when(text.isNotNull(), number(text)).alias("value"),
                       F.when(text.isNotNull(), strip_ws(text)).alias("bare"))
    word, bit = distinct.bitmap_parts(F.col("bare"))
    known = cell.select("at", "present", F.when(text.isNotNull(), type_mask(text, value, date_formats)).alias("mask"),
                        F.coalesce("number", "value").alias("number"), (F.lower("text") == "true").alias("true"),
                        F.when(text.isNotNull(), word).alias("word"), F.when(text.isNotNull(), bit).alias("bit"))
    return known.groupBy("at").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("present").alias("count"), F.bit_and("mask").alias("mask"),
        F.min("number").alias("least"), F.max("number").alias("greatest"), F.count_if("true").alias("true"),
        *distinct.bitmap_aggs(F.col("word"), F.col("bit"), "b"))


def table_facts(df: DataFrame, date_formats=DEFAULT_DATE_FORMATS) -> TableFacts:
    """The facts of every column; what comes to the driver is one row per column."""
    found = {r["at"]: r.asDict() for r in facts_frame(df, date_formats).collect()}
    empty = {"cells": 0, "count": 0, "mask": 0, "least": None, "greatest": None, "true": 0}
    columns = {}
    for i, f in enumerate(df.schema.fields):
        r = found.get(i, empty)
        bound = distinct.popcount(r, "b") if i in found and isinstance(f.dataType, T.StringType) else 0
        columns[f.name] = Facts(r["count"], r["mask"] or 0, r["least"], r["greatest"], r["true"], bound)
    rows = found.get(-1, empty)
    return TableFacts(rows["cells"], rows["count"], columns)
