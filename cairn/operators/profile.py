"""Profiles, duplicates and quality scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import roles
from ..functions.values import to_date
from .describe import grouped, melt, nulls_by_column, unique_counts


def duplicate_analysis(df: DataFrame, *, id_columns: Sequence[str] | None = None, name_columns: Sequence[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(kind, n): rows in any group of repeats, repeats after the first, repeats over the id and over the name columns.

    Unless given, those are the columns with "id" or "name" anywhere in their names, ``paid`` and ``width`` among them.
    ``groups`` are those of whole rows, where they are at hand.
    """
    ids = list(id_columns if id_columns is not None else [c for c in df.columns if "id" in c.lower()])
    names = list(name_columns if name_columns is not None else [c for c in df.columns if "name" in c.lower()])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = grouped(df, df.columns) if groups is None else groups
    whole = groups.agg(zero(F.sum(F.when(F.col("_n") > 1, F.col("_n")))).alias("a"), zero(F.sum(F.col("_n") - 1)).alias("b"))
    out = melt(whole, ("kind", "n"), [("rows_in_groups", F.col("a")), ("repeats", F.col("b"))])
    for kind, keys in (("id_repeats", ids), ("name_repeats", names)):
        if keys:
            out = out.unionByName(grouped(df, keys).agg(zero(F.sum(F.col("_n") - 1)).alias("n")).select(F.lit(kind).alias("kind"), "n"))
    return out


def quality(df: DataFrame, form: str = "profile", groups: DataFrame | None = None) -> DataFrame:
    """(score): 100 less missing and repeated shares, 0 to 100.

    profile: the sum of the columns' missing percentages and the percentage of rows in groups of repeats;
    clean: the mean of the former and the percentage of repeats after the first.
    """
    groups = grouped(df, df.columns) if groups is None else groups
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns[1:]), F.col(f"`{df.columns[0]}`").isNull().cast("long"))
    bad = F.when(F.col("_n") > 1, F.col("_n")).otherwise(0) if form == "profile" else F.col("_n") - 1
    row = groups.agg(F.sum("_n").alias("n"), F.sum(missing * F.col("_n")).alias("m"), F.sum(bad).alias("d"))
    share = F.col("m") * 100.0 / F.col("n") / (1 if form == "profile" else len(df.columns))
    loss = F.floor(F.round(share + F.col("d") * 100.0 / F.col("n"), 9))
    return row.select(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), 100 - loss)), F.lit(100)).cast("long").alias("score"))


def column_profile(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """(column, dtype, n_null, pct, n_unique)."""
    dtypes = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return nulls_by_column(df).join(unique_counts(df, approx=approx), "column").select("column", F.get(F.array(dtypes[F.col("column")]), F.lit(0)).alias("dtype"), "n_null", "pct", "n_unique")


def examples(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(column, value): the n smallest distinct values, as text."""
    out = None
    for c in columns:
        one = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct().orderBy("value").limit(n)
        out = one if out is None else out.unionByName(one)
    return out


def recommendations(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(priority, column, text) by five rules over missing cells, repeats and dates kept as text."""
    nulls = nulls_by_column(df)
    order = F.create_map(*[F.lit(x) for k, c in enumerate(df.columns) for x in (c, k)])
    repeats = duplicate_analysis(df, id_columns=[], name_columns=[], groups=groups).where("kind = 'repeats' and n > 0").select(F.lit(1).alias("priority"), F.lit(None).cast("string").alias("column"), F.format_string("Remove %d repeated rows", "n").alias("text"))
    high = nulls.where("pct > 20").select(F.lit(2).alias("priority"), "column", F.format_string("Review column %s: %.2f%% missing", "column", "pct").alias("text"))
    low = nulls.where("pct > 0 and pct <= 20").orderBy(order[F.col("column")]).limit(1).select(F.lit(3).alias("priority"), "column", F.format_string("Fill missing values of %s", "column").alias("text"))
    out = repeats.unionByName(high).unionByName(low)
    texts = [c for c, r in roles(df).items() if r == "text"]
    if texts:
        row = df.agg(*[F.struct(F.count(c).alias("n"), F.count(to_date(F.col(c))).alias("d")).alias(c) for c in texts])
        dates = melt(row, ("column", "n", "d"), [(c, F.col(f"`{c}`.n"), F.col(f"`{c}`.d")) for c in texts]).where("n > 0 and d = n")
        out = out.unionByName(dates.select(F.lit(4).alias("priority"), "column", F.format_string("Convert %s to dates", "column").alias("text")))
    healthy = out.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(5).alias("priority"), F.lit(None).cast("string").alias("column"), F.lit("The data looks healthy").alias("text"))
    return out.unionByName(healthy)
