"""Outliers by z-score and by interquartile range: one aggregate for the bounds, one pass against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import with_role
from .describe import melt, stats_row


def bounds(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    return stats_row(df, columns, exact).select(F.struct("*").alias("_s"))


def _s(c: str, stat: str) -> Column:
    return F.col(f"_s.`{c}`.{stat}")


def by_z(c: str, limit: float = 3.0) -> Column:
    return F.coalesce(F.abs(F.try_divide(F.col(c) - _s(c, "mean"), _s(c, "std"))) > limit, F.lit(False))


def by_iqr(c: str) -> Column:
    low, high = fences(c)
    return F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))


def fences(c: str) -> tuple[Column, Column]:
    iqr = _s(c, "p75") - _s(c, "p25")
    return _s(c, "p25") - 1.5 * iqr, _s(c, "p75") + 1.5 * iqr


def counts(df: DataFrame, columns: Sequence[str] | None, test, exact: bool = True) -> DataFrame:
    """(column, n) of cells that ``test`` flags."""
    columns = list(columns or with_role(df, "numeric"))
    rows = df.crossJoin(F.broadcast(bounds(df, columns, exact)))  # the bounds are one row
    return melt(rows.agg(*[F.count_if(test(c)).alias(c) for c in columns]), ("column", "n"), [(c, F.col(f"`{c}`")) for c in columns])


def zscore_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return counts(df, columns, by_z, False)  # no quartile is used


def iqr_counts(df: DataFrame, columns: Sequence[str] | None = None, *, exact: bool = True) -> DataFrame:
    return counts(df, columns, by_iqr, exact)


def usable(c: str) -> Column:
    return (_s(c, "count") >= 4) & (_s(c, "std") > 0)


def anomalies_summary(df: DataFrame, columns: Sequence[str] | None = None, *, exact: bool = True) -> DataFrame:
    """(column, n, total, pct, mean, std, lower, upper) of columns with at least 4 values that vary; flagged by either rule."""
    columns = list(columns or with_role(df, "numeric"))
    rows = df.crossJoin(F.broadcast(bounds(df, columns, exact)))
    row = rows.agg(F.first("_s").alias("_s"), *[F.count_if((by_z(c) | by_iqr(c)) & usable(c)).alias(f"_n_{c}") for c in columns])
    r = lambda x: F.round(x, 4)
    out = [(c, F.col(f"`_n_{c}`"), _s(c, "count").cast("long"), F.round(F.try_divide(F.col(f"`_n_{c}`") * 100.0, _s(c, "count")), 2), r(_s(c, "mean")), r(_s(c, "std")), r(fences(c)[0]), r(fences(c)[1]), usable(c)) for c in columns]
    return melt(row, ("column", "n", "total", "pct", "mean", "std", "lower", "upper", "_ok"), out).where("_ok").drop("_ok")


def anomalies_rows(df: DataFrame, column: str, keys: Sequence[str], *, limit: int = 20, exact: bool = True) -> DataFrame:
    """(column, keys, value): the first ``limit`` flagged cells by the keys (a report)."""
    rows = df.crossJoin(F.broadcast(bounds(df, [column], exact))).where(usable(column) & (by_z(column) | by_iqr(column)))
    return rows.orderBy(*keys).limit(limit).select(F.lit(column).alias("column"), *keys, F.col(column).alias("value"))


def anomalies_all(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, *, limit: int = 20, exact: bool = True) -> DataFrame:
    """(column, keys, value): of every numeric column the first ``limit`` flagged cells by the keys (a report)."""
    columns = list(columns or [c for c in with_role(df, "numeric") if c not in keys])
    rows = df.crossJoin(F.broadcast(bounds(df, columns, exact)))
    flagged = F.array_compact(F.array(*[F.when(usable(c) & (by_z(c) | by_iqr(c)), F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c in columns]))
    cells = rows.select(*keys, F.explode(flagged).alias("f")).select("f.column", *keys, "f.value")
    out = None
    for c in columns:  # each a top-k, of which no task sorts all cells
        one = cells.where(F.col("column") == c).orderBy(*keys).limit(limit)
        out = one if out is None else out.unionByName(one)
    return out


def txn_anomalies(df: DataFrame, amount: str, *, limit: float = 2.5) -> DataFrame:
    """All columns with ``z_score`` of rows beyond ``limit``."""
    rows = df.crossJoin(F.broadcast(bounds(df, [amount], False)))  # no quartile is used
    z = F.try_divide(F.col(amount) - _s(amount, "mean"), _s(amount, "std"))
    return rows.withColumn("z_score", F.round(z, 4)).where(F.abs(z) > limit).drop("_s")


