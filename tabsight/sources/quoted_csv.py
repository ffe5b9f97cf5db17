"""CSV with quoted line breaks, read in splits.

A line that begins outside quotes ends inside them when it holds an open quoted
field; which of both a line begins with depends on every line before it. Each
scan split therefore tells what it does to either beginning (two bits), and a
prefix composition over the splits of a file, one row per split, gives every
split its true beginning. The second pass then joins the lines of each record
within its split; a record that runs over split borders leaves one fragment per
split, and only these are shuffled. Records are parsed by Spark's own CSV
expressions. A file is never read by one task as ``multiLine`` would.

The first pass looks at lines with a quote only. Where no record holds a line
break the second pass is Spark's plain CSV scan.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsight.session import materialize

#: Kinds of joined lines: a whole record, or its end, middle or begin where it runs over split borders.
WHOLE, END, MIDDLE, BEGIN = range(4)
_EFFECT = "path string, start long, from_out int, from_in int, broken_out int, broken_in int"
_PIECE = "split long, kind int, first boolean, text string"


class LineState:
    """Whether the end of a line lies inside a quoted field, given where the line begins."""

    def __init__(self, sep: str, quote: str):
        q, s = re.escape(quote), re.escape(sep)
        # A field at the begin of a line or after a separator: quoted (with doubled quotes, and whatever follows
        # up to the separator), or not quoted. A quote within an unquoted field is a sign like others.
        closed = f"{q}[^{q}]*(?:{q}{q}[^{q}]*)*{q}(?!{q})[^{s}]*"
        plain = f"(?!{q})[^{s}]*"
        self._fields = re.compile(f"(?:{closed}|{plain})(?:{s}|$)", re.S)
        self._rest = re.compile(f"[^{q}]*(?:{q}{q}[^{q}]*)*{q}(?!{q})[^{s}]*(?:{s}|$)", re.S)
        self.quote = quote

    def after(self, line: str, inside: bool) -> bool:
        if self.quote not in line:
            return inside
        at = 0
        if inside:
            end = self._rest.match(line)
            if end is None:
                return True
            at = end.end()
            if at == len(line):
                return False
        while at < len(line):
            field = self._fields.match(line, at)
            if field is None:
                return True
            at = field.end()
        return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split they come from; a task yields the lines of a split in their order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _effects(state: LineState):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, int], list] = {}       # one entry per split of the task
        for batch in batches:
            for line, path, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                split = out.setdefault((path, start), [False, True, 0, 0])
                for k in (0, 1):
                    split[k] = state.after(line, split[k])
                    split[2 + k] += split[k]
        rows = [(*k, int(v[0]), int(v[1]), v[2], v[3]) for k, v in out.items()]
        names = [f.split()[0] for f in _EFFECT.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.int32()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=names)
    return found


def split_states(lines: DataFrame, state: LineState) -> DataFrame:
    """One row per split: its number in (path, start) order, where it begins and ends, whether a line ends inside quotes.

    A split is an identity, a swap or a constant on {outside, inside}. The
    beginning of a split follows from the last constant before it and the
    number of swaps since: two running sums over one small row per split.
    """
    quoted = lines.filter(F.instr("value", state.quote) > 0)
    found = quoted.mapInArrow(_effects(state), _EFFECT)
    # Splits without a quote leave every state as it is.
    every = lines.groupBy("path", "start").agg(F.lit(0).alias("n")).join(found, ["path", "start"], "left")
    effect = every.select("path", "start", F.coalesce("from_out", F.lit(0)).alias("from_out"),
                          F.coalesce("from_in", F.lit(1)).alias("from_in"),
                          F.coalesce("broken_out", F.lit(0)).alias("broken_out"),
                          F.coalesce("broken_in", F.lit(1)).alias("broken_in"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swap = ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int")
    fixed = F.col("from_out") == F.col("from_in")
    running = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    placed = effect.withColumn("swaps", F.sum(swap).over(running))
    placed = placed.withColumn("known", F.last(F.when(fixed, F.struct("from_out", "swaps")), ignorenulls=True).over(before))
    placed = placed.withColumn("swaps_before", F.col("swaps") - swap)
    inside = F.pmod(F.coalesce(F.col("known.from_out"), F.lit(0)) + F.col("swaps_before")
                    - F.coalesce(F.col("known.swaps"), F.lit(0)), F.lit(2)) == 1
    numbered = placed.withColumn("inside", inside)
    return numbered.select(
        "path", "start", "inside", F.when(F.col("inside"), F.col("from_in") == 1).otherwise(F.col("from_out") == 1).alias("open"),
        (F.when(F.col("inside"), F.col("broken_in")).otherwise(F.col("broken_out")) > 0).alias("broken"),
        F.row_number().over(Window.partitionBy("path").orderBy("start")).alias("place"))


def _pieces(state: LineState, whole: bool):
    """Joined lines: the whole records of every split, or the fragments at its borders."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, kind, first = None, [], False, WHOLE, False
        out: list[tuple] = []

        def close(last: int) -> None:
            if (last == WHOLE) == whole:
                out.append((at, last, first, "\n".join(held)))

        for batch in batches:
            for line, split, begins_inside, head in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if split != at:
                    if inside:
                        close(MIDDLE if kind == END else BEGIN)
                    at, held, inside = split, [], begins_inside
                    kind, first = (END if inside else WHOLE), head and not inside
                held.append(line)
                inside = state.after(line, inside)
                if not inside:
                    close(kind)
                    first = first and held in ([""], ["\r"])       # blank lines before the header
                    held, kind = [], WHOLE
            yield _batch(out)
            out.clear()
        if inside:
            close(MIDDLE if kind == END else BEGIN)
        yield _batch(out)
    return found


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [[]] * 4
    arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, names=["split", "kind", "first", "text"])


def _names(record: str, sep: str, quote: str) -> list[str]:
    """Column names of a header record; empty ones are named by place, later equal ones get a number."""
    names: list[str] = []
    for i, n in enumerate(next(csv.reader(io.StringIO(record, newline=""), delimiter=sep, quotechar=quote))):
        name = base = n or f"_c{i}"
        k = 1
        while name in names:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    return names


def _records(lines: DataFrame, states: DataFrame, state: LineState) -> DataFrame:
    """Every record as one text, ``first`` for the headers; ``path`` is known for those that were put together."""
    side = F.broadcast(states.select("path", "start", "split", "inside", "place", "crossing"))
    marked = lines.join(side, ["path", "start"]).select("value", "split", "inside", (F.col("place") == 1).alias("head"), "crossing")
    whole = marked.drop("crossing").mapInArrow(_pieces(state, True), _PIECE)
    parts = marked.filter("crossing").drop("crossing").mapInArrow(_pieces(state, False), _PIECE).join(
        F.broadcast(states.select("split", "path", "place")), "split")
    # A record's fragments follow one another: its begin, whole splits in the middle, its end. Two rows per split at most.
    begins = F.when(F.col("kind") == BEGIN, 1).otherwise(0)
    chain = F.sum(begins).over(Window.partitionBy("path").orderBy("place", begins))
    joined = parts.withColumn("chain", chain).groupBy("path", "chain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text), "\n").alias("text"),
        F.max("first").alias("first"))
    return whole.select("text", "first").unionByName(joined.select("text", "first")).withColumn(
        "text", F.regexp_replace("text", r"\r$", ""))


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """All columns as text; the first record of each file is its header, that of the first file by path names them.

    Fields may hold separators, doubled quotes and line breaks, which stay as
    they are. Blank lines between records go, missing fields are NULL, surplus
    ones go, a carriage return before the line feed that ends a record goes.
    A record must fit a task's memory. A file that ends inside a quoted field
    is an error, as nothing says where the field ends, and so is a first file
    without a header.
    """
    if len(sep) != 1 or len(quote) != 1 or sep == quote:
        raise ValueError("separator and quote must be one sign each, and differ")
    state = LineState(sep, quote)
    lines = _lines(spark, path)
    # One row per split of 128 MB or so: about 1 MB a TB of input. It is read by every job below.
    states = materialize(split_states(lines, state).withColumn("split", F.monotonically_increasing_id()).withColumn(
        "crossing", F.col("inside") | F.col("open")))
    last = Window.partitionBy("path").orderBy(F.desc("place"))
    unfinished = [r.path for r in states.withColumn("r", F.row_number().over(last)).filter("r = 1 and open").take(1)]
    if unfinished:
        raise ValueError(f"a file ends inside a quoted field: {unfinished[0]}")
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    broken = not states.filter("broken").isEmpty()
    leading = states.agg(F.min("path")).first()[0]
    if broken:
        header = _records(lines.filter(F.col("path") == F.lit(leading)), states, state).filter("first and text <> ''").first()
    else:
        begin = lines.filter((F.col("path") == F.lit(leading)) & (F.col("start") == 0))
        header = begin.select(F.regexp_replace("value", r"\r$", "").alias("text")).filter("text <> ''").first()
    if header is None:
        raise ValueError("no record names the columns")
    names = _names(header["text"].removeprefix("\ufeff"), sep, quote)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    if not broken:
        return spark.read.options(**options).option("header", True).schema(schema).csv(path).toDF(*names)
    parsed = F.from_csv("text", schema, {**options, "multiLine": "true"}).alias("r")
    records = _records(lines, states, state)
    return records.filter(~F.col("first") & (F.col("text") != "")).select(parsed).select("r.*").toDF(*names)


__all__ = ["LineState", "read_quoted_csv", "split_states"]
