"""Exact linear-interpolation quantiles that never buffer a whole group.

Spark's exact ``percentile`` keeps every value of a group in one buffer, which
fails when one group (or a whole column) holds billions of rows. Here:

1. one partial aggregate gives ``count`` and an approximate bracket
   ``[lo, hi]`` around each wanted rank (``percentile_approx`` sketches merge
   map-side, so no raw rows are shuffled);
2. if the largest group could leave more than ``max_bracket_rows`` rows in a
   bracket (about ``6 n / accuracy``), the brackets are narrowed first: each
   pass counts the rows of a bracket in ``bins`` equal-width value bins (a
   partial aggregate, at most ``bins`` rows per bracket) and keeps the bins
   that hold the wanted ranks; a bracket of a single value is final;
3. the last pass ships one "below lo" count per bracket and partition and the
   distinct values inside the bracket as a (value, count) histogram - at most
   ``max_bracket_rows`` entries, and a hot value collapses to one entry in the
   map-side combine;
4. a running count over that histogram finds the values at ranks ``floor(k)``
   and ``ceil(k)``, ``k = (n - 1) p``, and interpolates. Counts below and inside
   prove that both ranks lie in the bracket; brackets without this certificate
   are done again, four times as wide each time, at last over the whole range.

Brackets are few rows (groups x probabilities) and checkpointed, so their size
is known when the rows meet them: up to ``BROADCAST_ROWS`` of them go to the
rows by broadcast, and no row is shuffled on its group.

Result equals pandas' default ``quantile`` / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.session import materialize

DEFAULT_ACCURACY = 20000
SMALL_GROUP_FACTOR = 4
MAX_BRACKET_ROWS = 2_000_000
REFINE_BINS = 4096
# Brackets (about 100 bytes each) that are broadcast to the rows; more of them are joined by shuffle.
BROADCAST_ROWS = 100_000
MAX_REFINE_PASSES = 12


def group_side(groups: DataFrame) -> DataFrame:
    """A frame of one row per group, computed once; broadcast where it has few rows."""
    done = materialize(groups)
    return F.broadcast(done) if done.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else done


def join_groups(left: DataFrame, right: DataFrame, keys: list[str] | tuple, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` (one row per group); null keys match null keys.

    Give ``right`` as :func:`group_side` where ``left`` has all rows: they then stay where they are.
    """
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))
    side = right.withColumnsRenamed({k: f"__group{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__group{i}"))
    return left.join(side, same, how).drop(*[f"__group{i}" for i in range(len(keys))])


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    group_cols: list[str] | tuple = (), accuracy: int = DEFAULT_ACCURACY,
                    names: list[str] | None = None, max_bracket_rows: int = MAX_BRACKET_ROWS,
                    bins: int = REFINE_BINS) -> DataFrame:
    """Per group, one column per probability (named ``names`` or ``q0, q1, ...``)."""
    g = list(group_cols)
    names = names or [f"q{i}" for i in range(len(probs))]
    m = len(probs)

    src = (df.select(*[F.col(c) for c in g], F.col(value_col).cast("double").alias("__v"))
           .where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    picked, todo, width = None, None, 3.0 / accuracy
    while True:
        found = _picked(src, _brackets(src, g, probs, accuracy, width, todo), g, accuracy, max_bracket_rows, bins)
        good = found.where("__proven")
        picked = good if picked is None else picked.unionByName(good)
        todo = found.where("not __proven").select(*g, "__i")
        if todo.isEmpty():
            break
        width = width * 4 if width < 1 else 2.0        # from 1 on the bracket is the whole range, which needs no proof
    val = F.col("__v0") + (F.col("__k") - F.floor("__k")) * (F.col("__v1") - F.col("__v0"))
    return picked.groupBy(*g).agg(*[F.max(F.when(F.col("__i") == i, val)).alias(names[i]) for i in range(m)])


def _brackets(src: DataFrame, g: list[str], probs: list[float], accuracy: int, width: float, only: DataFrame | None) -> DataFrame:
    """One row per (group, probability): target rank and value bracket; those of ``only`` where it is given.

    A group of at most ``small`` rows takes the whole range: its histogram is
    bounded by ``small`` and the sketch's rank error could be below one rank step.
    """
    m = len(probs)
    lo_p, hi_p = [max(0.0, p - width) for p in probs], [min(1.0, p + width) for p in probs]
    if only is not None:
        src = join_groups(src, group_side(only.select(*g).distinct()), g) if g else src
    stats = src.groupBy(*g).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", lo_p + hi_p, accuracy).alias("__br"))
    whole = (F.col("__n") <= F.lit(SMALL_GROUP_FACTOR * accuracy)) | F.lit(width >= 1)
    at = F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("__i", "__p")
    out = (stats.where(F.col("__n") > 0).select(*g, "__n", "__br", at).select(
        *g, "__i", "__n", ((F.col("__n") - 1) * F.col("__p")).alias("__k"),
        F.when(whole, F.lit(float("-inf"))).otherwise(F.col("__br")[F.col("__i")]).alias("__lo"),
        F.when(whole, F.lit(float("inf"))).otherwise(F.col("__br")[F.col("__i") + m]).alias("__hi"),
        F.lit(None).cast("long").alias("__below")))
    return out if only is None else join_groups(out, group_side(only), [*g, "__i"])


def _picked(src: DataFrame, brackets: DataFrame, g: list[str], accuracy: int, max_bracket_rows: int | None, bins: int) -> DataFrame:
    """Per (group, probability) the values at both ranks, and whether the counts prove that they are these."""
    brackets = materialize(brackets)
    if max_bracket_rows is not None and (brackets.agg(F.max("__n")).first()[0] or 0) * 6.0 / accuracy > max_bracket_rows:
        brackets = _refine(src, brackets, g, max_bracket_rows, bins)
    # Final pass: "below" counts (unless refinement already knows them) and the
    # histogram of distinct values inside each bracket.
    joined = join_groups(src, group_side(brackets), g)
    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    below_unknown = F.col("__below").isNull() & (F.col("__v") < F.col("__lo"))
    marked = (joined.where(below_unknown | inside)
              .select(*g, "__i", "__n", "__k", "__below",
                      F.when(inside, F.col("__v")).alias("__vv")))
    hist = marked.groupBy(*g, "__i", "__n", "__k", "__below", "__vv").agg(F.count(F.lit(1)).alias("__c"))

    w = Window.partitionBy(*g, "__i").orderBy(F.col("__vv").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.col("__below"), F.lit(0))
    ranked = hist.withColumn("__end", base + F.sum("__c").over(w))
    r0, r1 = F.floor("__k"), F.ceil("__k")
    found = F.col("__vv").isNotNull()
    picked = ranked.groupBy(*g, "__i").agg(
        F.min(F.when(found & (F.col("__end") > r0), F.col("__vv"))).alias("__v0"),
        F.min(F.when(found & (F.col("__end") > r1), F.col("__vv"))).alias("__v1"),
        # rows below the bracket: not more than floor(k); rows up to its end: more than ceil(k)
        F.min(F.when(found, F.col("__end") - F.col("__c"))).alias("__before"), F.max("__end").alias("__upto"),
        F.first("__k").alias("__k"),
    )
    proven = F.coalesce((F.col("__before") <= r0) & (F.col("__upto") > r1), F.lit(False))
    # Brackets in which no row lies have no histogram: they are not proven either.
    every = join_groups(brackets.select(*g, "__i"), picked.select(*g, "__i", "__v0", "__v1", "__k", proven.alias("__proven")),
                        [*g, "__i"], "left")
    return materialize(every.withColumn("__proven", F.coalesce("__proven", F.lit(False))))


def _refine(src: DataFrame, brackets: DataFrame, g: list[str], max_rows: int, bins: int) -> DataFrame:
    """Narrow every bracket until it holds at most ``max_rows`` rows.

    Each pass: rows below each bracket are counted, rows inside are counted per
    equal-width value bin (at most ``bins`` rows per bracket after the partial
    aggregate), and the bracket becomes [min of the bin holding rank floor(k),
    max of the bin holding rank ceil(k)]. Brackets (one row per group and
    probability) are checkpointed between passes.
    """
    finite = ~F.isnan(F.col("__lo") - F.col("__hi")) & (F.abs(F.col("__hi") - F.col("__lo")) < F.lit(float("inf")))
    done = brackets.where(~finite)          # whole-range brackets of small groups
    br = brackets.where(finite)
    for _ in range(MAX_REFINE_PASSES):
        joined = join_groups(src, br, g)
        width = F.col("__hi") - F.col("__lo")
        b = F.when(F.col("__v") < F.col("__lo"), F.lit(-1)).otherwise(
            F.when(width == 0, F.lit(0)).otherwise(
                F.least(F.floor((F.col("__v") - F.col("__lo")) / width * bins), F.lit(bins - 1)))).cast("int")
        per_bin = (joined.where(F.col("__v") <= F.col("__hi")).withColumn("__bin", b)
                   .groupBy(*g, "__i", "__n", "__k", "__bin")
                   .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__bmin"), F.max("__v").alias("__bmax")))
        w = Window.partitionBy(*g, "__i").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        cum = per_bin.withColumn("__end", F.sum("__c").over(w))
        r0, r1 = F.floor("__k"), F.ceil("__k")
        first0 = F.min(F.when((F.col("__bin") >= 0) & (F.col("__end") > r0), F.struct("__bin", "__bmin", "__end", "__c")))
        first1 = F.min(F.when((F.col("__bin") >= 0) & (F.col("__end") > r1), F.struct("__bin", "__bmax", "__end")))
        nxt = (cum.groupBy(*g, "__i", "__n", "__k").agg(first0.alias("__f0"), first1.alias("__f1"))
               .select(*g, "__i", "__n", "__k",
                       F.col("__f0.__bmin").alias("__lo"), F.col("__f1.__bmax").alias("__hi"),
                       (F.col("__f0.__end") - F.col("__f0.__c")).alias("__below"),
                       (F.col("__f1.__end") - F.col("__f0.__end") + F.col("__f0.__c")).alias("__inside")))
        # A reliable checkpoint (shared folder) cuts the lineage between passes.
        nxt = materialize(nxt)
        final = (F.col("__hi") == F.col("__lo")) | (F.col("__inside") <= max_rows)
        done = done.unionByName(nxt.where(final).drop("__inside"))
        br = nxt.where(~final).drop("__inside")
        if br.isEmpty():
            break
    return done.unionByName(br)


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = DEFAULT_ACCURACY, names: list[str] | None = None) -> DataFrame:
    """Exact quantiles of many numeric columns at once: (column, q0, q1, ...)."""
    if not cols:
        raise ValueError("no columns")
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        ids=[], values=cols, variableColumnName="column", valueColumnName="__val")
    return exact_quantiles(long, "__val", probs, ["column"], accuracy, names)
