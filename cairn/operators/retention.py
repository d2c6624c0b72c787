"""Who comes back: cohorts by first period, and active users by what they did before.

A user's periods are gathered as a set, so a user with very many rows is one small array before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import STEPS


def since(a: Column, b: Column, period: str) -> Column:
    """Whole periods from ``a`` to ``b``, both beginnings of a period."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return {"day": F.date_diff(b, a), "week": F.floor(F.date_diff(b, a) / 7), "month": months, "quarter": F.floor(months / 3), "year": F.year(b) - F.year(a)}[period].cast("int")


def visits(df: DataFrame, user: str, date: str, period: str) -> DataFrame:
    """(cohort, seen): of each user the first period and all, ascending. Rows without user or date are left out."""
    if period not in STEPS:
        raise ValueError(f"unknown period {period!r}; there are {', '.join(STEPS)}")
    rows = df.where(F.col(user).isNotNull() & F.col(date).isNotNull()).select(F.col(user).alias("_user"), F.date_trunc(period, F.col(date)).cast("date").alias("_period"))
    seen = rows.groupBy("_user").agg(F.array_sort(F.collect_set("_period")).alias("seen"))
    return seen.select(F.get("seen", F.lit(0)).alias("cohort"), "seen")


def retention(df: DataFrame, user: str, date: str, *, period: str = "week", digits: int = 2) -> DataFrame:
    """(cohort, offset, users, cohort_size, rate): of the users whose first period is ``cohort`` those seen ``offset`` periods later, in percent.

    Every offset up to the table's last period is there, with 0 where no user came back.
    """
    rows = visits(df, user, date, period)
    last = rows.agg(F.max(F.element_at("seen", -1)).alias("_last"))
    counts = rows.select("cohort", F.explode("seen").alias("p")).groupBy("cohort", since(F.col("cohort"), F.col("p"), period).alias("offset")).agg(F.count(F.lit(1)).alias("users"))
    sizes = counts.where("offset = 0").select("cohort", F.col("users").alias("cohort_size")).crossJoin(F.broadcast(last))  # one row
    every = sizes.select("cohort", "cohort_size", F.explode(F.sequence(F.lit(0), since(F.col("cohort"), F.col("_last"), period))).alias("offset"))
    users = F.coalesce("users", F.lit(0))
    return every.join(counts, ["cohort", "offset"], "left").select("cohort", "offset", users.alias("users"), "cohort_size", F.round(users * 100.0 / F.col("cohort_size"), digits).alias("rate"))


def retention_triangle(df: DataFrame, user: str, date: str, *, period: str = "week", offsets: int = 5) -> DataFrame:
    """(cohort, cohort_size, p0, p1, ...): the rates of the first ``offsets`` periods; NULL beyond the table's end."""
    cells = [F.max(F.when(F.col("offset") == k, F.col("rate"))).alias(f"p{k}") for k in range(offsets)]
    return retention(df, user, date, period=period).groupBy("cohort", "cohort_size").agg(*cells)


def activity(df: DataFrame, user: str, date: str, *, period: str = "week") -> DataFrame:
    """(period, active, new, retained, returned, lost): users seen; for the first time; also in the period before; after a gap; and those of the period before who weren't seen."""
    rows = visits(df, user, date, period)
    last = rows.agg(F.max(F.element_at("seen", -1)).alias("_last"))
    near = lambda x, i, step: F.get(F.col("seen"), i + step)
    every = rows.select(F.explode(F.transform("seen", lambda x, i: F.struct(x.alias("p"), near(x, i, -1).alias("was"), near(x, i, 1).alias("next")))).alias("v")).select("v.*")
    gap = since(F.col("was"), F.col("p"), period)
    seen = every.groupBy(F.col("p").alias("period")).agg(
        F.count(F.lit(1)).alias("active"), F.count_if(F.col("was").isNull()).alias("new"), F.count_if(gap == 1).alias("retained"), F.count_if(gap > 1).alias("returned"))
    after = F.expr(f"p + {STEPS[period]}").cast("date")
    stops = F.coalesce(since(F.col("p"), F.col("next"), period) > 1, F.lit(True))
    gone = every.crossJoin(F.broadcast(last)).where(stops & (F.col("p") < F.col("_last"))).groupBy(after.alias("period")).agg(F.count(F.lit(1)).alias("lost"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seen.join(gone, "period", "full").select("period", *[zero(c) for c in ("active", "new", "retained", "returned", "lost")])
