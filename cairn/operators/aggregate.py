"""Metrics, groups and filters over one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .describe import melt

METRICS = {"total": F.sum, "average": F.avg, "count": F.count, "maximum": F.max, "minimum": F.min}


def aggregate(df: DataFrame, column: str, metric: str | None = None, *, where: Column | None = None, digits: int = 2) -> DataFrame:
    """(metric, value): one metric, or all five without a name. The total of no rows is 0."""
    rows = df if where is None else df.where(where)
    names = list(METRICS) if metric is None else [metric]
    of = lambda m: F.coalesce(F.sum(column), F.lit(0)) if m == "total" else METRICS[m](column)
    return melt(rows.agg(*[of(m).cast("double").alias(m) for m in names]), ("metric", "value"), [(m, F.round(m, digits)) for m in names])


def received_paid(df: DataFrame, amount: str) -> DataFrame:
    """(type, total, n): sums and counts above and below zero."""
    a = F.col(amount)
    row = df.agg(*[x for t, test in (("received", a > 0), ("paid", a < 0)) for x in (F.coalesce(F.sum(F.when(test, a)), F.lit(0.0)).alias(f"{t}_sum"), F.count_if(test).alias(f"{t}_n"))])
    return melt(row, ("type", "total", "n"), [(t, F.round(f"{t}_sum", 2), F.col(f"{t}_n")) for t in ("received", "paid")])


def group_total(df: DataFrame, group: str, target: str | None = None, *, limit: int | None = 15) -> DataFrame:
    """(group_value, total, n, rank): groups by their sum (by their count without a target), NULL groups left out; ties by value."""
    total = F.count(F.lit(1)).cast("double") if target is None else F.round(F.sum(target), 2)
    out = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_value")).agg(total.alias("total"), F.count(F.lit(1)).alias("n"))
    ranked = out.orderBy(F.desc("total"), "group_value")
    return ranked.limit(limit) if limit else out


def value_ranking(df: DataFrame, column: str, *, limit: int | None = 10) -> DataFrame:
    """(value, n): the commonest values; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit) if limit else counts


def categorical_metric(df: DataFrame, column: str) -> DataFrame:
    """(metric, value, n): rows, distinct values and the ten commonest."""
    head = melt(df.agg(F.count(column).alias("rows"), F.count_distinct(column).alias("distinct")), ("metric", "value", "n"), [("rows", F.lit(None).cast("string"), F.col("rows")), ("distinct", F.lit(None).cast("string"), F.col("distinct"))])
    return head.unionByName(value_ranking(df, column).select(F.lit("top").alias("metric"), "value", "n"))
