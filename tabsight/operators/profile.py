"""Cleaning and profiling (P1-P13): ``profile(df) -> (clean_df, ontology_df)``.

Work is a fixed number of passes however wide the table is:

* one scan gives row and non-null counts, numeric min/max and the types that
  every value of a column fits (``operators.lattice``: one row per column);
* one exact-quantile job gives every numeric median (``functions.quantiles``);
* one unpivot + ``groupBy(column, value)`` gives the distinct counts of all
  text columns (never many ``count_distinct`` in one aggregate).

Filling a column with its median leaves min and max unchanged, so P7's stats
come from the first pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.quantiles import column_quantiles
from tabsight.functions.text import strip_ws
from tabsight.operators import lattice
from tabsight.operators.lattice import DEFAULT_DATE_FORMATS, NUMERIC_TYPES, UNKNOWN, TableFacts, table_facts

# Fixed value: distinct-count threshold for categorical columns.
CATEGORICAL_MAX_DISTINCT = 20

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

ONTOLOGY_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("allowed_values", T.ArrayType(T.StringType())),
    T.StructField("distinct_count", T.LongType()),
])


def _q(name: str):
    return F.col(f"`{name}`")


def _chunks(items, n):
    for i in range(0, len(items), n):
        yield items[i:i + n]


def wide_agg(df: DataFrame, exprs: list, chunk: int = 400) -> dict:
    """Run many scalar aggregates as few one-row jobs; returns {alias: value}."""
    out = {}
    for part in _chunks(exprs, chunk):
        row = df.agg(*part).first()
        out.update(row.asDict())
    return out


def normalise_name(name: str) -> str:
    """Strip, lower, each run of non-word characters -> '_'."""
    return re.sub(r"\W+", "_", str(name).strip().lower())


def clean_names(df: DataFrame) -> DataFrame:
    """P3 with collision suffixes ``_2``, ``_3`` (the reference breaks on collisions)."""
    names: list[str] = []
    taken = {normalise_name(c) for c in df.columns}
    for c in df.columns:
        base = name = normalise_name(c)
        n = 1
        while name in names or (n > 1 and name in taken):
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return df.toDF(*names)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value: NULL in every float column."""
    return df.select(*[(F.when(~F.isnan(_q(f.name)), _q(f.name)).alias(f.name)
                        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else _q(f.name)) for f in df.schema.fields])


def drop_empty(df: DataFrame) -> DataFrame:
    """P1 + P2: drop all-null columns, then all-null rows."""
    facts = table_facts(df)
    return df.select(*[_q(c) for c in df.columns if facts.columns[c].count > 0]).dropna(how="all")


def _is_string(dt):
    return isinstance(dt, T.StringType)


def infer_types(df: DataFrame, date_formats=DEFAULT_DATE_FORMATS, facts: TableFacts | None = None) -> DataFrame:
    """Cast text columns that fully parse as integer, double, boolean or datetime.

    Integers beyond a long become ``decimal(38, 0)``; integers with gaps become
    double (as pandas does), booleans with gaps ``True`` / ``False`` text; a
    datetime column needs every value to parse with one format, else it stays
    text.
    """
    if not any(_is_string(f.dataType) for f in df.schema.fields):
        return df
    casts = _casts(df, facts or table_facts(df, date_formats), date_formats)
    return df.select(*[(casts[c].alias(c) if c in casts else _q(c)) for c in df.columns])


def _casts(df: DataFrame, facts: TableFacts, date_formats) -> dict:
    """What each column becomes (P4, P5); columns that stay as they are do not occur."""
    out = {}
    for f in df.schema.fields:
        c, x = _q(f.name), facts.columns[f.name]
        gaps = x.count < facts.rows
        if isinstance(f.dataType, T.BooleanType) and gaps and x.count:
            out[f.name] = F.initcap(c.cast("string"))
        if not _is_string(f.dataType):
            continue
        if x.fits(lattice.LONG) and not gaps:
            out[f.name] = c.try_cast("bigint")
        elif x.fits(lattice.INTEGER) and not gaps:
            out[f.name] = c.try_cast("decimal(38,0)")
        elif x.fits(lattice.DOUBLE):
            out[f.name] = lattice.number(c)
        elif x.fits(lattice.BOOLEAN):
            out[f.name] = F.initcap(F.lower(c)) if gaps else F.lower(c) == "true"
        elif fmt := x.date_format(date_formats):
            out[f.name] = lattice.timestamp(c, fmt)
    return out


def column_kind(dt) -> str:
    if isinstance(dt, T.BooleanType) or isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "other"


@dataclass
class Profile:
    clean: DataFrame
    ontology: DataFrame
    summary: DataFrame
    medians: dict = field(default_factory=dict)


def profile(df: DataFrame, exact_median: bool = True, date_formats=DEFAULT_DATE_FORMATS,
            categorical_max: int = CATEGORICAL_MAX_DISTINCT) -> Profile:
    """P1-P13 in at most three passes over the data.

    1. the facts of every column and the types all its values fit;
    2. (only if some numeric column has gaps) the exact-median job;
    3. one unpivot + ``groupBy(column, value)`` for text distinct counts.

    NaN counts as missing throughout.
    """
    spark = df.sparkSession
    df = without_nan(df)
    cols = df.columns
    facts = table_facts(df, date_formats)
    rows = facts.rows

    keep = [c for c in cols if facts.columns[c].count > 0]                  # P1
    casts = _casts(df, facts, date_formats)                                 # P4, P5
    typed = df.select(*[(casts[c].alias(c) if c in casts else _q(c)) for c in keep]).dropna(how="all")   # P2
    names = clean_names(typed).columns                                      # P3
    rename = dict(zip(keep, names))
    typed = typed.toDF(*names)
    tfields = {f.name: f.dataType for f in typed.schema.fields}
    kind = {c: column_kind(tfields[rename[c]]) for c in keep}
    num_cols = [c for c in keep if kind[c] == "numeric"]
    txt_cols = [c for c in keep if kind[c] == "other"]

    # Pass 2: medians of numeric columns with gaps (exact, bounded memory).
    need = [c for c in num_cols if facts.columns[c].count < rows]
    medians = {}
    if need:
        nn = [rename[c] for c in need]
        if exact_median:
            med = column_quantiles(typed, nn, [0.5], names=["median"]).collect()
        else:
            med = typed.unpivot([], nn, "column", "v").groupBy("column").agg(
                F.percentile_approx(F.col("v").cast("double"), 0.5, 10000).alias("median")).collect()
        medians = {r["column"]: r["median"] for r in med}

    out = []
    for c in keep:
        n, dt = rename[c], tfields[rename[c]]
        if n in medians:
            target = T.DoubleType() if isinstance(dt, INTEGRAL_TYPES) else dt    # integers with gaps -> double
            out.append(F.coalesce(_q(n).cast(target), F.lit(medians[n]).cast(target)).alias(n))
        elif c in txt_cols:
            out.append(strip_ws(F.coalesce(_q(n).cast("string"), F.lit(UNKNOWN))).alias(n))   # P9
        else:
            out.append(_q(n))
    clean = typed.select(*out)

    # Filling a column with its median leaves min and max unchanged, so P7's stats come from the first pass.
    onto_rows = []
    for pos, c in enumerate(keep):
        if kind[c] == "numeric":
            x = facts.columns[c]
            onto_rows.append((rename[c], pos, "numeric", x.least, x.greatest, None, None))
        elif kind[c] == "datetime":
            onto_rows.append((rename[c], pos, "datetime", None, None, None, None))
    onto = spark.createDataFrame(onto_rows, ONTOLOGY_SCHEMA)
    onto = onto.select("column", "position", "type", F.round("min", 2).alias("min"),
                       F.round("max", 2).alias("max"), "allowed_values", "distinct_count")   # P7
    if txt_cols:
        wide = [rename[c] for c in txt_cols if c not in casts and facts.columns[c].distinct_bound > categorical_max]
        onto = onto.unionByName(text_ontology(clean, [rename[c] for c in txt_cols], names, categorical_max, wide))

    filled_num = sum(rows - facts.columns[c].count for c in need)
    filled_txt = sum(rows - facts.columns[c].count for c in txt_cols)
    summary = spark.createDataFrame(
        [(len(cols), len(keep), int(facts.rows_in), int(rows), int(filled_num), int(filled_txt),
          f"Ontology Map Generated. Sanitized {len(keep)} columns.")],
        "columns_in int, columns_out int, rows_in long, rows_out long, "
        "numeric_filled long, text_filled long, message string")
    return Profile(clean, onto, summary, medians)


def text_ontology(clean: DataFrame, txt_cols: list[str], all_cols: list[str],
                  categorical_max: int = CATEGORICAL_MAX_DISTINCT, wide: list | None = None) -> DataFrame:
    """Distinct count per text column; allowed values when <= ``categorical_max``.

    One unpivot + ``groupBy(column, value)`` (map-side combine collapses hot
    values), then a count per column. Columns in ``wide`` (proven to hold more
    than ``categorical_max`` values) need no values, so two 64-bit hashes stand
    for each of theirs and long texts are not shuffled. The values of the other
    columns are cut to ``categorical_max + 1`` before they are gathered.
    """
    wide = set(wide or ())
    cells = F.array(*[F.struct(F.lit(all_cols.index(c)).alias("position"), F.lit(c).alias("column"), F.lit(c in wide).alias("wide"),
                               _q(c).alias("value")) for c in txt_cols])
    value = F.col("value")
    pairs = (clean.select(F.explode(cells).alias("cell")).select("cell.*")
             .select("position", "column", F.when(F.col("wide"), F.xxhash64(value)).alias("h1"),
                     F.when(F.col("wide"), F.xxhash64(F.lit("distinct"), value)).alias("h2"),
                     F.when(~F.col("wide"), value).alias("value"))
             .groupBy("position", "column", "h1", "h2", "value").agg(F.lit(1).alias("one")))
    counts = pairs.groupBy("position", "column").agg(F.count(F.lit(1)).alias("distinct_count"))
    place = F.row_number().over(Window.partitionBy("position").orderBy("value"))
    values = (pairs.filter(F.col("h1").isNull()).withColumn("place", place).filter(F.col("place") <= categorical_max + 1)
              .groupBy("position").agg(F.array_sort(F.collect_list("value")).alias("found")))
    categorical = F.col("distinct_count") <= categorical_max
    # both sides have a row per column of the table
    return counts.join(F.broadcast(values), "position", "left").select(
        "column", "position", F.when(categorical, "categorical").otherwise("text").alias("type"),
        F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
        F.when(categorical, F.col("found")).alias("allowed_values"), F.col("distinct_count").cast("long").alias("distinct_count"))


def impute_median(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """P6 on its own: numeric nulls and NaN -> exact column median (integers become double)."""
    df = without_nan(df)
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, NUMERIC_TYPES)]
    if exact:
        med = {r["column"]: r["median"] for r in column_quantiles(df, cols, [0.5], names=["median"]).collect()}
    else:
        med = wide_agg(df, [F.percentile_approx(_q(c), 0.5, 10000).alias(c) for c in cols])
    out = []
    for f in df.schema.fields:
        if f.name in med and med[f.name] is not None:
            v = _q(f.name).cast("double") if isinstance(f.dataType, INTEGRAL_TYPES) else _q(f.name)
            out.append(F.coalesce(v, F.lit(float(med[f.name]))).alias(f.name))
        else:
            out.append(_q(f.name))
    return df.select(*out)


def fill_unknown(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null -> 'Unknown', as text, whitespace stripped on both ends."""
    return df.select(*[(strip_ws(F.coalesce(_q(c).cast("string"), F.lit(UNKNOWN))).alias(c)
                        if c in cols else _q(c)) for c in df.columns])
