"""Descriptive statistics. Each reads the table once in one aggregate and returns a long table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import roles, with_role

STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def melt(row: DataFrame, names: Sequence[str], rows: list[tuple]) -> DataFrame:
    """One row of aggregates as a table: ``rows`` are tuples of labels and expressions over it."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return row.select(F.explode(F.array(*[F.struct(*[lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])).alias("r")).select("r.*")


#: Fixed by the report: the shares of the quartiles. SKETCH bounds the error of the brackets that exact ones are sought in.
SHARES, SKETCH = (0.25, 0.5, 0.75), 10_000
#: Values that a bracket may keep, the points of a pass that narrows it, and the values of a column up to which the first sketch's brackets keep few enough: their ranks span 6 / SKETCH of the column.
KEPT, GRID = 60_000, 200
DIRECT = KEPT * SKETCH // 6


def number(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def moments_row(df: DataFrame, columns: Sequence[str], exact: bool) -> DataFrame:
    """One row with a struct for each column: count, mean, std, min, max and ``q``, approximate quartiles or the edges of the brackets around each."""
    shares = [min(1.0, max(0.0, p + d)) for p in SHARES for d in (-2 / SKETCH, 2 / SKETCH)] if exact else list(SHARES)
    return df.agg(*[F.struct(
        F.count(f"`{c}`").cast("double").alias("count"), F.avg(f"`{c}`").alias("mean"), F.stddev_samp(f"`{c}`").alias("std"), F.min(f"`{c}`").cast("double").alias("min"),
        F.max(f"`{c}`").cast("double").alias("max"), F.percentile_approx(number(c), shares, SKETCH).alias("q")).alias(c) for c in columns])


def between(v: Column, low: float | None, high: float | None) -> Column:
    return F.lit(False) if low is None else v.between(F.lit(low), F.lit(high))


def narrowed(df: DataFrame, columns: Sequence[str], brackets: dict[tuple[str, int], tuple[float, float]], counts: dict[str, int]) -> None:
    """Narrow the brackets of columns of over DIRECT values until each has at most KEPT of them, or one value.

    A pass over the table counts what is below and in each bracket, and sketches GRID points of what is in it; the bracket shrinks to the points around the wanted rank, to
    some 2 percent of its values.
    """
    open_ = [b for b in brackets if counts[b[0]] > DIRECT]
    while open_:
        points = [k / GRID for k in range(GRID + 1)]
        row = df.agg(*[F.struct(
            F.count_if(number(c) < F.lit(brackets[c, k][0])).alias("below"), F.count_if(between(number(c), *brackets[c, k])).alias("inside"),
            F.percentile_approx(F.when(between(number(c), *brackets[c, k]), number(c)), points, SKETCH).alias("grid")).alias(f"b{i}") for i, (c, k) in enumerate(open_)]).first()
        still = []
        for i, (c, k) in enumerate(open_):
            found = row[f"b{i}"]
            if found["inside"] <= KEPT or brackets[c, k][0] == brackets[c, k][1]:
                continue
            at = (SHARES[k] * (counts[c] - 1) - found["below"]) / found["inside"] * GRID  # two neighbouring ranks are wanted
            low, high = max(0, min(GRID, int(at) - 1)), max(0, min(GRID, int(at) + 3))
            new = (found["grid"][low], found["grid"][high])
            if new == brackets[c, k]:
                continue  # a few values fill it
            brackets[c, k] = new
            still.append((c, k))
        open_ = still


def quartiles(df: DataFrame, columns: Sequence[str], row) -> dict[str, list[float | None]]:
    """Exact quartiles by column, from the sketched brackets of :func:`moments_row`'s row."""
    known = [c for c in columns if row[c]["count"]]
    counts = {c: int(row[c]["count"]) for c in known}
    brackets = {(c, k): (row[c]["q"][2 * k], row[c]["q"][2 * k + 1]) for c in known for k in range(len(SHARES))}
    narrowed(df, known, brackets, counts)
    if not known:
        return {c: [None] * 3 for c in columns}
    cells = []
    for i, c in enumerate(known):
        v, edge = number(c), [F.lit(x) for k in range(len(SHARES)) for x in brackets[c, k]]
        # Even zones lie between brackets. Brackets may overlap or be one value.
        zone = F.when(v < edge[0], 0).when(v <= edge[1], 1).when(v < edge[2], 2).when(v <= edge[3], 3).when(v < edge[4], 4).when(v <= edge[5], 5).otherwise(6)
        cells.append(F.struct(F.lit(i).alias("k"), v.alias("v"), zone.alias("zone")))
    cells = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v is not null")
    groups = cells.groupBy("k", "zone", F.when(F.col("zone") % 2 == 1, F.col("v")).alias("kept")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    by_value = Window.partitionBy("k").orderBy("low")  # the values kept in three brackets
    ranked = groups.withColumn("stop", F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    # A rank is in a bracket, or next to one: the first or last of an interval.
    at = lambda rank: F.max(F.when((F.col("stop") > rank) & (F.col("stop") - F.col("n") <= rank), F.when(F.col("stop") - F.col("n") == rank, F.col("low")).otherwise(F.col("high"))))
    ends = []
    for p in SHARES:
        place = (F.col("total") - 1) * p
        ends += [at(F.floor(place)), at(F.floor(place) + 1), F.max(place - F.floor(place))]
    found = ranked.groupBy("k").agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)])
    middle = [(F.col(f"e{i}") + F.coalesce((F.col(f"e{i + 1}") - F.col(f"e{i}")) * F.col(f"e{i + 2}"), F.lit(0.0))).alias(p) for i, p in zip((0, 3, 6), ("p25", "p50", "p75"), strict=True)]
    rows = {known[r["k"]]: [r["p25"], r["p50"], r["p75"]] for r in found.select("k", *middle).collect()}  # a row for each column
    return {c: rows.get(c, [None] * 3) for c in columns}


def stats_row(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """One row with a struct of STATS for each column.

    Exact quartiles take a job now: a sketch of bounded size brackets each, brackets of very many values are narrowed by further passes, and values within the
    brackets (at most KEPT each) are counted one by one, all others by the interval between brackets. So no task holds a share of the rows. Running counts give the ranks.
    """
    row = moments_row(df, columns, exact)
    own = lambda c, s: F.col(f"`{c}`.{s}")
    if not exact:
        return row.select(*[F.struct(*[own(c, s).alias(s) for s in ("count", "mean", "std", "min")], *[F.get(own(c, "q"), F.lit(k)).alias(p) for k, p in enumerate(("p25", "p50", "p75"))], own(c, "max").alias("max")).alias(c) for c in columns])
    if not columns:
        return row
    moments = row.first()
    middle = quartiles(df, columns, moments)
    value = lambda x: F.lit(x).cast("double")
    made = [F.struct(*[value(moments[c][s]).alias(s) for s in ("count", "mean", "std", "min")], *[value(x).alias(p) for x, p in zip(middle[c], ("p25", "p50", "p75"), strict=True)], value(moments[c]["max"]).alias("max")).alias(c) for c in columns]
    return df.sparkSession.range(1).select(*made)


def describe(df: DataFrame, columns: Sequence[str] | None = None, *, exact: bool = True, digits: int = 4) -> DataFrame:
    """(column, stat, value) of numeric columns."""
    columns = list(columns or with_role(df, "numeric"))
    return melt(stats_row(df, columns, exact), ("column", "stat", "value"), [(c, s, F.round(F.col(f"`{c}`.{s}"), digits) + 0.0) for c in columns for s in STATS])


def nulls_by_column(df: DataFrame) -> DataFrame:
    """(column, n_null, pct)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    missing = lambda c: F.col("_n") - F.col(f"`{c}`")
    return melt(row, ("column", "n_null", "pct"), [(c, missing(c), F.round(F.try_divide(missing(c) * 100.0, F.col("_n")), 2)) for c in df.columns])


def nulls_overall(df: DataFrame) -> DataFrame:
    """(metric, value): null cells, rows with any null, rows, percent of cells."""
    any_null = F.greatest(*[F.col(f"`{c}`").isNull().cast("int") for c in df.columns], F.lit(0))
    cells = sum((F.count(F.lit(1)) - F.count(c) for c in df.columns[1:]), F.count(F.lit(1)) - F.count(df.columns[0]))
    row = df.agg(F.count(F.lit(1)).alias("rows"), cells.alias("cells"), F.coalesce(F.sum(any_null), F.lit(0)).alias("with_null"))
    pct = F.round(F.try_divide(F.col("cells") * 100.0, F.col("rows") * len(df.columns)), 2)
    return melt(row, ("metric", "value"), [("null_cells", F.col("cells").cast("double")), ("rows_with_null", F.col("with_null").cast("double")), ("rows", F.col("rows").cast("double")), ("pct_of_cells", pct)])


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, *, digits: int = 6, pairs_at_once: int = 200) -> DataFrame:
    """(col_a, col_b, r) over pairs of numeric columns, rows where both are known; NULL for a constant column."""
    columns = list(columns or with_role(df, "numeric"))
    pairs = list(combinations(columns, 2))
    out = None
    for at in range(0, len(pairs), pairs_at_once):
        part = pairs[at : at + pairs_at_once]
        aggs = []
        for k, (a, b) in enumerate(part):
            x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
            aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{k}"))
        one = melt(df.agg(*aggs), ("col_a", "col_b", "r"), [(a, b, F.round(F.col(f"r{k}"), digits)) for k, (a, b) in enumerate(part)])
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a correlation needs two numeric columns")
    return out


def strongest_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, r, abs_r): one row."""
    return correlation_pairs(df, columns).withColumn("abs_r", F.abs("r")).where("r is not null").orderBy(F.desc("abs_r"), "col_a", "col_b").limit(1)


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None, *, approx: bool = False) -> DataFrame:
    """(column, n_unique) of non-null values."""
    columns = list(columns or df.columns)
    count = F.approx_count_distinct if approx else F.count_distinct
    return melt(df.agg(*[count(F.col(c)).alias(c) for c in columns]), ("column", "n_unique"), [(c, F.col(f"`{c}`")) for c in columns])


def key_metrics(df: DataFrame, columns: Sequence[str] | None = None, *, first: int = 5) -> DataFrame:
    """(column, metric, value): total, average, min and max of the first numeric columns."""
    columns = list(columns or with_role(df, "numeric"))[:first]
    row = df.agg(*[F.struct(F.sum(c).cast("double").alias("total"), F.avg(c).alias("average"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    return melt(row, ("column", "metric", "value"), [(c, m, F.round(F.col(f"`{c}`.{m}"), 2) + 0.0) for c in columns for m in ("total", "average", "min", "max")])


def top_total_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, total): the numeric column of the largest sum."""
    columns = list(columns or with_role(df, "numeric"))
    totals = melt(df.agg(*[F.sum(c).cast("double").alias(c) for c in columns]), ("column", "total"), [(c, F.round(F.col(f"`{c}`"), 2)) for c in columns])
    return totals.where("total is not null").orderBy(F.desc("total"), "column").limit(1)


def trend_first_last(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """(column, first_value, last_value, change_pct, direction, strong) by the given order."""
    order = F.struct(*order_by)
    row = df.agg(*[F.struct(F.min_by(F.col(c).cast("double"), order).alias("a"), F.max_by(F.col(c).cast("double"), order).alias("b")).alias(c) for c in columns])
    rows = []
    for c in columns:
        a, b = F.col(f"`{c}`.a"), F.col(f"`{c}`.b")
        pct = F.round(F.try_divide(b - a, F.abs(a)) * 100, 2)
        rows.append((c, a, b, pct, F.when(b > a, "up").when(b < a, "down").otherwise("flat"), F.coalesce(F.abs(pct) > 20, F.lit(False))))
    return melt(row, ("column", "first_value", "last_value", "change_pct", "direction", "strong"), rows)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of non-null values of text columns, in one shuffle."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).select("c.*")
    return cells.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_categories, top_value, top_n); ties go to the smallest value."""
    counts = value_counts(df, list(columns or with_role(df, "text")))
    top = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_categories"), F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("t"))
    return top.select("column", "n_categories", F.col("t.value").alias("top_value"), (-F.col("t.m")).alias("top_n"))


def most_diverse(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_categories, top_value, top_n): the text column of most values."""
    return categorical_profile(df, columns).orderBy(F.desc("n_categories"), "column").limit(1)


def grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key, ``_n``; equal NULLs are equal."""
    types = dict(df.dtypes)
    cols = [F.to_json(c).alias(c) if types[c].startswith("map") else F.col(f"`{c}`") for c in keys]
    return df.select(*cols).groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias("_n"))


def overview(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(metric, value): rows, columns, numeric and text columns, missing cells, repeated rows. ``groups`` are those of whole rows, where they are at hand."""
    r = roles(df)
    groups = grouped(df, df.columns) if groups is None else groups
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns[1:]), F.col(f"`{df.columns[0]}`").isNull().cast("long"))
    row = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(missing * F.col("_n")), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"))
    count = lambda role: F.lit(sum(x == role for x in r.values())).cast("long")
    return melt(row, ("metric", "value"), [("rows", F.col("rows")), ("columns", F.lit(len(r)).cast("long")), ("numeric_columns", count("numeric")), ("text_columns", count("text")), ("missing_cells", F.col("missing")), ("repeated_rows", F.col("repeats"))])
