"""Multi-statement SQL scripts with a pluggable repair hook.

Each statement is one ``spark.sql`` call; Catalyst plans it against the
mounted ``dataset`` view. Results are materialised once (reliable checkpoint
in the shared folder) so that running a statement both surfaces its runtime
errors and yields the table later steps reuse, without a second execution.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.functions.text import SELECT_START, STATEMENT_START
from tabsight.session import materialize

MAX_STATEMENTS = 3
MAX_ATTEMPTS = 3

Repair = Callable[[str, str, object], str]


@dataclass
class ScriptResult:
    results: dict[str, DataFrame]
    sql: str
    attempts: int
    error: str | None = None


# Quoted text, names and comments are tokens of their own, so nothing inside them is read as SQL.
_TOKEN = re.compile(r"""(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:[^']|'')*(?:'|\Z))|(?P<name>"(?:[^"]|"")*(?:"|\Z)|`[^`]*(?:`|\Z))
                        |(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<sign>.)""", re.DOTALL | re.VERBOSE)


def tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text) of the pieces of a script; joined they give the script again."""
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]


def rewrite_code(sql: str, change: Callable[[str], str]) -> str:
    """``change`` applied to the runs of code between quoted text, quoted names and comments."""
    out, code = [], []
    for kind, text in tokens(sql):
        if kind in ("text", "name", "comment"):
            out += [change("".join(code)), text]
            code = []
        else:
            code.append(text)
    return "".join(out) + change("".join(code))


def split_statements(sql: str, max_statements: int = MAX_STATEMENTS) -> list[str]:
    """The first ``max_statements`` statements that hold more than blanks and comments."""
    parts: list[list[tuple[str, str]]] = [[]]
    for kind, text in tokens(sql):
        if (kind, text) == ("sign", ";"):
            parts.append([])
        else:
            parts[-1].append((kind, text))
    told = ["".join(text for _, text in p).strip() for p in parts if any(kind not in ("space", "comment") for kind, _ in p)]
    return told[:max_statements]


FENCE = "`" * 3
SQL_SELECT = re.compile(SELECT_START)
SQL_START = re.compile(STATEMENT_START)

# Session settings under which script text is parsed: SQLite reads "x" as an
# identifier, and Spark does so too with ANSI double-quoted identifiers.
SCRIPT_CONF = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}


def sqlite_like(stmt: str) -> str:
    """SQLite's LIKE ignores ASCII case; Spark's ILIKE is the same operator."""
    return "".join("ILIKE" if kind == "word" and text.upper() == "LIKE" else text for kind, text in tokens(stmt))


def run_script(spark: SparkSession, sql: str, max_statements: int = MAX_STATEMENTS,
               execute: bool = True, sqlite_compat: bool = True) -> dict[str, DataFrame]:
    """Run statements in order as ``Query_1..n``; the first error aborts (raises).

    With ``sqlite_compat`` statements are parsed with double-quoted
    identifiers and case-insensitive LIKE, so SQLite-style text means what it
    meant there instead of silently comparing string literals.
    """
    out = {}
    saved = {k: spark.conf.get(k, None) for k in SCRIPT_CONF} if sqlite_compat else {}
    try:
        if sqlite_compat:
            for k, v in SCRIPT_CONF.items():
                spark.conf.set(k, v)
        for i, stmt in enumerate(split_statements(sql, max_statements)):
            df = spark.sql(sqlite_like(stmt) if sqlite_compat else stmt)
            if execute:
                df = materialize(df)
            out[f"Query_{i + 1}"] = df
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return out


def extract_sql_text(raw: str, keep_with: bool = True) -> str:
    """V15 for one reply string (the repair hook's output)."""
    opened, _, after = raw.partition(FENCE)
    inner, closed, _ = after.partition(FENCE)
    body = inner if closed else raw
    if closed and body[:3].lower() == "sql":
        body = body[3:]
    starts = SQL_START if keep_with else SQL_SELECT
    found = starts.search(body)
    return body[found.start():].strip() if found else body.strip()


def error_result(spark: SparkSession, message: str) -> dict[str, DataFrame]:
    """One result with a single ``error`` row."""
    return {"Query_1": spark.createDataFrame([(f"Failed: {message}",)], "error string")}


def run_with_repair(spark: SparkSession, sql: str, repair: Repair | None = None, ontology=None,
                    max_attempts: int = MAX_ATTEMPTS, max_statements: int = MAX_STATEMENTS,
                    execute: bool = True) -> ScriptResult:
    """Up to ``max_attempts`` runs; after a failure the repair hook rewrites the script."""
    current = sql
    error = None
    for attempt in range(1, max_attempts + 1):
        try:
            return ScriptResult(run_script(spark, current, max_statements, execute), current, attempt)
        except Exception as exc:  # any analysis or runtime error aborts the attempt
            error = _short_error(exc)
            if repair is None:
                continue
            current = extract_sql_text(repair(current, error, ontology))
    return ScriptResult(error_result(spark, error or "unknown error"), current, max_attempts, error)


def _short_error(exc: Exception) -> str:
    text = str(exc).strip().splitlines()
    return text[0] if text else type(exc).__name__


# SQLite strftime tokens and their Spark datetime patterns.
STRFTIME_TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def dialect_repair(sql: str, error: str, ontology=None) -> str:
    """A built-in repair hook for common SQLite-isms.

    Double-quoted identifiers become backticks, ``LIKE`` becomes the
    case-insensitive ``ILIKE``, ``strftime(fmt, x)`` becomes
    ``date_format(x, pattern)`` and ``a / b`` becomes ``try_divide(a, b)``
    when the error was a division by zero.
    """
    out = "".join(f"`{text[1:-1]}`" if kind == "name" and text[0] == '"' else text for kind, text in tokens(sqlite_like(sql)))

    def _strftime(m):
        fmt = m.group(1)
        for k, v in STRFTIME_TOKENS.items():
            fmt = fmt.replace(k, v)
        return f"date_format({m.group(2).strip()}, '{fmt}')"

    out = re.sub(r"(?i)strftime\(\s*'([^']*)'\s*,\s*([^)]+)\)", _strftime, out)
    if "DIVIDE_BY_ZERO" in error.upper():
        out = rewrite_code(out, lambda code: re.sub(r"([\w.]+)\s*/\s*([\w.]+)", r"try_divide(\1, \2)", code))
    return out


def results_union(results: dict[str, DataFrame]) -> DataFrame:
    """All results tagged by query name, as JSON rows (for logs and previews)."""
    frames = [df.select(F.lit(name).alias("query"), F.to_json(F.struct(*df.columns)).alias("row"))
              for name, df in results.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
