"""Findings made of the other analyses, as one table (seq, kind, column, metric, value, text)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import with_role
from .anomalies import zscore_counts
from .describe import key_metrics, most_diverse, nulls_overall, overview, strongest_pair, top_total_column, trend_first_last


def finding(df: DataFrame, seq: int, kind: str, column, metric: str | Column, value, text: Column) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), col(column).cast("string").alias("column"), col(metric).alias("metric"), col(value).cast("double").alias("value"), text.alias("text"))


def insights(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Overview, largest total, trends, strongest correlation (0.5 or more), outliers, most diverse text column, missing cells."""
    numeric, texts = with_role(df, "numeric"), with_role(df, "text")
    out = [finding(overview(df), 1, "overview", None, F.col("metric"), F.col("value"), F.format_string("%s: %d", "metric", "value"))]
    if numeric:
        out.append(finding(top_total_column(df), 2, "driver", F.col("column"), "total", F.col("total"), F.format_string("%s has the largest total", "column")))
        out.append(finding(trend_first_last(df, numeric, order_by).where("strong"), 3, "trend", F.col("column"), "change_pct", F.col("change_pct"), F.format_string("%s went %s", "column", "direction")))
        out.append(finding(zscore_counts(df).where("n > 0"), 5, "anomaly", F.col("column"), "outliers", F.col("n"), F.format_string("%s has %d outliers", "column", "n")))
    if len(numeric) >= 2:
        out.append(finding(strongest_pair(df).where("abs_r >= 0.5"), 4, "correlation", F.concat_ws("~", "col_a", "col_b"), "r", F.col("r"), F.format_string("%s and %s move together", "col_a", "col_b")))
    if texts:
        out.append(finding(most_diverse(df), 6, "category", F.col("column"), "categories", F.col("n_categories"), F.format_string("%s has the most values, %s leads", "column", "top_value")))
    out.append(finding(nulls_overall(df).where("metric = 'null_cells' and value > 0"), 7, "recommendation", None, "null_cells", F.col("value"), F.lit("Fill or drop missing cells")))
    return reduce(DataFrame.unionByName, out)


def report(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """(section, item, value): overview, key metrics and the numbers of the findings."""
    item = lambda *c: F.concat_ws(".", *c)
    return (
        overview(df).select(F.lit("overview").alias("section"), F.col("metric").alias("item"), F.col("value").cast("double").alias("value"))
        .unionByName(key_metrics(df).select(F.lit("key_metrics").alias("section"), item("column", "metric").alias("item"), "value"))
        .unionByName(insights(df, order_by).where("seq > 1").select(F.lit("insights").alias("section"), item("kind", "column", "metric").alias("item"), "value"))
    )


def summary_insights(df: DataFrame) -> DataFrame:
    """(item, column, value): rows, missing cells, largest total, strongest correlation, most diverse column."""
    none = F.lit(None).cast("string")
    out = overview(df).where("metric in ('rows', 'missing_cells')").select(F.col("metric").alias("item"), none.alias("column"), F.col("value").cast("double").alias("value"))
    if with_role(df, "numeric"):
        out = out.unionByName(top_total_column(df).select(F.lit("top_total").alias("item"), "column", F.col("total").alias("value")))
    if len(with_role(df, "numeric")) >= 2:
        out = out.unionByName(strongest_pair(df).select(F.lit("strongest_pair").alias("item"), F.concat_ws("~", "col_a", "col_b").alias("column"), F.col("r").alias("value")))
    if with_role(df, "text"):
        out = out.unionByName(most_diverse(df).select(F.lit("most_diverse").alias("item"), "column", F.col("n_categories").cast("double").alias("value")))
    return out
