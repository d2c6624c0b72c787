"""Series behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import with_role
from .aggregate import value_ranking
from .anomalies import bounds, fences
from .describe import melt


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths, empty bins too; the maximum is in the last bin, equal values in the first."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    rows = v.crossJoin(F.broadcast(ends))
    # Widths from the lowest value, as the edges are made: width_bucket rounds otherwise, which moves values on an edge.
    place = F.when(F.col("a") == F.col("b"), 1).otherwise(F.least(F.floor((F.col("v") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)) + 1, F.lit(bins)))
    found = rows.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.where("a is not null").select("a", ((F.col("b") - F.col("a")) / bins).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    low = F.round(F.col("a") + (F.col("bin") - 1) * F.col("w"), 6)
    return every.join(found, "bin", "left").select("bin", low.alias("low"), F.round(F.col("a") + F.col("bin") * F.col("w"), 6).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def scatter(df: DataFrame, x: str, y: str, key: str, *, max_points: int = 1000) -> DataFrame:
    """(x, y): complete pairs; of more than ``max_points`` those with the smallest key hashes (a chart's sample)."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(max_points).select(F.col(x).alias("x"), F.col(y).alias("y"))


def bar(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    return value_ranking(df, column, limit=n)


def pie(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """(value, n, share, share_of_all): shares in percent, of the shown values and of all."""
    counts = value_ranking(df, column, limit=None)
    total = counts.agg(F.sum("n").alias("_all"))
    shown = counts.orderBy(F.desc("n"), "value").limit(n)
    part = shown.agg(F.sum("n").alias("_part"))
    both = shown.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(part))  # one row each
    return both.select("value", "n", F.round(F.col("n") * 100.0 / F.col("_part"), 2).alias("share"), F.round(F.col("n") * 100.0 / F.col("_all"), 2).alias("share_of_all"))


def line(df: DataFrame, x: str, y: str, bucket: str | None = None) -> DataFrame:
    """(x, y) by x; with a ``bucket`` such as month the sums by it."""
    if bucket is None:
        return df.select(F.col(x).alias("x"), F.col(y).alias("y")).orderBy("x")
    return df.groupBy(F.date_trunc(bucket, F.col(x)).cast("date").alias("x")).agg(F.round(F.sum(y), 2).alias("y")).orderBy("x")


def box(df: DataFrame, column: str, *, exact: bool = True) -> DataFrame:
    """(stat, value): quartiles, whiskers to the furthest values within 1.5 interquartile ranges, number of fliers."""
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds(df, [column], exact)))
    low, high = fences(column)
    inside = F.col(column).between(low, high)
    row = rows.agg(F.first("_s").alias("_s"), F.min(F.when(inside, F.col(column))).cast("double").alias("lo"), F.max(F.when(inside, F.col(column))).cast("double").alias("hi"), F.count_if(~inside).cast("double").alias("fliers"))
    s = lambda k: F.round(F.col(f"_s.`{column}`.{k}"), 4)
    return melt(row, ("stat", "value"), [("p25", s("p25")), ("p50", s("p50")), ("p75", s("p75")), ("whisker_low", F.col("lo")), ("whisker_high", F.col("hi")), ("fliers", F.col("fliers"))])


def chart_type(df: DataFrame) -> str:
    """scatter for two numeric columns, else bar for a text column, else line."""
    if len(with_role(df, "numeric")) >= 2:
        return "scatter"
    return "bar" if with_role(df, "text") else "line"


def default_columns(df: DataFrame, kind: str, x: str | None = None, y: str | None = None) -> dict[str, str]:
    """The columns of a chart: ``x`` and ``y`` where the table has them, else the first that fit.

    histogram and box: the first numeric column; scatter: the first two; bar and pie: the first text column, else the first column; line: the first column over
    the first numeric one.
    """
    numeric, texts = with_role(df, "numeric"), with_role(df, "text")
    least = {"histogram": 1, "box": 1, "scatter": 2, "line": 1}.get(kind, 0)
    if len(numeric) < least:
        raise ValueError(f"a {kind} chart needs {least} numeric column(s); the table has {numeric}")
    own = lambda c, other: c if c in df.columns else other
    if kind in ("histogram", "box"):
        return {"column": own(x, numeric[0])}
    if kind == "scatter":
        return {"x": own(x, numeric[0]), "y": own(y, numeric[1])}
    if kind == "line":
        return {"x": own(x, df.columns[0]), "y": own(y, numeric[0])}
    return {"column": own(x, texts[0] if texts else df.columns[0])}


def auto_chart(df: DataFrame, kind: str | None = None, x: str | None = None, y: str | None = None, **more) -> DataFrame:
    """The series of a chart, of the kind and columns that fit the table unless given; ``more`` goes to its function."""
    kind = kind or chart_type(df)
    makers = {"histogram": histogram, "scatter": scatter, "bar": bar, "pie": pie, "line": line, "box": box}
    if kind not in makers:
        raise ValueError(f"unknown chart {kind!r}; there are {', '.join(makers)}")
    if kind == "scatter":
        more.setdefault("key", df.columns[0])
    return makers[kind](df, **default_columns(df, kind, x, y), **more)
