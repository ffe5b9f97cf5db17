"""The three-shape analysis plan (X4) without a language model.

Given the dimension(s), the metric, an optional filter and the distribution
intent, the plan is three DataFrames over the same cleaned table:

* ``Query_1`` - grouped aggregate (A1), or raw filtered rows capped at 500 (L3)
  when a distribution chart is asked for;
* ``Query_2`` - cross aggregate over two dimensions (A3) with a continuous
  second dimension binned (F4), else a second one-dimension aggregate (A4);
* ``Query_3`` - raw ordered sample capped at 300 (L2) with the continuous
  segmentation column binned into Low / Mid / High (F3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.operators import shapes


def _ranges(ontology: dict | None, df: DataFrame, cols: list[str]) -> dict:
    """Min/max per column: from the ontology when known, else one aggregate for all."""
    out, need = {}, []
    for c in dict.fromkeys(cols):
        if ontology and c in ontology and ontology[c].get("min") is not None:
            out[c] = (float(ontology[c]["min"]), float(ontology[c]["max"]))
        else:
            need.append(c)
    if need:
        row = df.agg(*[x for i, c in enumerate(need)
                       for x in (F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}"))]).first()
        out.update({c: (float(row[f"mn{i}"]), float(row[f"mx{i}"])) for i, c in enumerate(need)})
    return out


def _is_continuous(ontology: dict | None, df: DataFrame, col: str) -> bool:
    if ontology and col in ontology:
        return ontology[col].get("type") == "numeric"
    return col in shapes.feature_columns(df) or df.schema[col].dataType.typeName() in ("double", "float")


def analysis_plan(df: DataFrame, dim: str, metric: str, dim2: str | None = None,
                  where: Column | str | None = None, distribution: bool = False,
                  order_by: list[str] | None = None, ontology: dict | None = None,
                  tier_col: str | None = None, round_to: int | None = 4) -> dict[str, DataFrame]:
    order_by = order_by or [dim, metric]
    src = df.where(where) if where is not None else df
    seg = tier_col or metric
    cont2 = bool(dim2) and _is_continuous(ontology, df, dim2)
    ranges = _ranges(ontology, df, ([dim2] if cont2 else []) + [seg])
    out = {}
    if distribution:
        out["Query_1"] = shapes.raw_sample(src, [dim, metric], order_by, shapes.DISTRIBUTION_SAMPLE_ROWS)
    else:
        out["Query_1"] = shapes.primary_agg(src, dim, metric, round_to)

    if dim2:
        d2 = dim2
        if cont2:
            mn, mx = ranges[dim2]
            edges = [mn + (mx - mn) * i / 3 for i in (1, 2)]
            d2 = f"{dim2}_tier"
            src2 = src.withColumn(d2, shapes.tier_expr(dim2, edges))
        else:
            src2 = src
        out["Query_2"] = shapes.cross_agg(src2, dim, d2, metric, round_to)
    else:
        out["Query_2"] = shapes.grouped(src, [dim], [("sum", metric), ("max", metric)], "row_count", round_to)

    mn, mx = ranges[seg]
    edges = [mn + (mx - mn) * i / 3 for i in (1, 2)]
    sample = src.withColumn(f"{seg}_tier", shapes.tier_expr(seg, edges))
    out["Query_3"] = shapes.raw_sample(sample, [dim, metric, f"{seg}_tier"], order_by + [f"{seg}_tier"],
                                       shapes.RAW_SAMPLE_ROWS)
    return out
