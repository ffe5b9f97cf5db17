"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabsight.session import materialize, scratch_path


#: Rows that a task hands to Python at once: each batch of whole texts is held several times over by both sides.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its rows hold whole texts, so the session's batches get ``_BATCH_ROWS`` unless their size was set."""
    if spark.conf.get(_BATCH_ROWS[0], None) is None:
        spark.conf.set(*_BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's settings while a frame is written: shuffle files go with the execution that made them, as what it wrote to the shared
#: folder replaces them.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **dict([_BATCH_ROWS])}


@contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    """Executions begun inside run under ``_WRITING``; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Frames stored since the innermost :func:`temporary` began; None outside.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def temporary() -> Iterator[None]:
    """Frames that are :func:`stored` inside are deleted at the end, unless they were stored to be kept."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for df in made:
            discard(df)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame under the shared checkpoint folder and read it back: later jobs start from the files.

    Inside :func:`temporary` it goes at the end unless ``keep``.
    """
    path = scratch_path(df.sparkSession, name)
    with while_writing(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if not keep and _MADE.get() is not None:
        _MADE.get().append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`stored` gave, once everything that reads them has been written."""
    session = df.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give free memory back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def lean(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function on a task's batches that gives back what the worker holds free at its end: it lives on for other tasks."""
    @wraps(f)
    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from f(batches)
        finally:
            trim()
    return inner


__all__ = ["discard", "lean", "materialize", "stored", "table", "temporary", "trim"]
