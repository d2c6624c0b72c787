"""Series by period: growth, seasonality, forecasts with intervals.

Rows are summed up by period first; what follows has a row for each period between the first and the last, so its windows are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.statistics import t_quantile

#: The step of each period, and how many periods the next larger cycle has.
STEPS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}
CYCLES = {"day": 7, "week": 52, "month": 12, "quarter": 4, "year": 1}
MEASURES = {"total": F.sum, "average": F.avg, "count": F.count}
ROUND = 6


def series(df: DataFrame, date: str, value: str | None = None, *, period: str = "month", measure: str = "total") -> DataFrame:
    """(t, period, value, n): a row for each period from the first to the last, numbered from 0.

    A period without rows has a total or count of 0 and no average. Rows without a date are left out; without ``value`` rows are counted.
    """
    if period not in STEPS:
        raise ValueError(f"unknown period {period!r}; there are {', '.join(STEPS)}")
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; there are {', '.join(MEASURES)}")
    made = F.count(F.lit(1)).cast("double") if value is None else MEASURES[measure](F.col(value).cast("double")).cast("double")
    found = df.where(F.col(date).isNotNull()).groupBy(F.date_trunc(period, F.col(date)).cast("date").alias("period")).agg(made.alias("value"), F.count(F.lit(1)).alias("n"))
    ends = found.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null")
    every = ends.select(F.posexplode(F.sequence("a", "b", F.expr(STEPS[period]))).alias("t", "period"))
    empty = F.lit(None).cast("double") if measure == "average" and value is not None else F.lit(0.0)
    return every.join(found, "period", "left").select("t", "period", F.when(F.col("n").isNotNull(), F.col("value")).otherwise(empty).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def growth(df: DataFrame, date: str, value: str | None = None, *, period: str = "month", measure: str = "total", digits: int = 2) -> DataFrame:
    """(period, value, n, previous, change, growth_pct, cycle_ago, cycle_growth_pct, total_to_date).

    Compared with the period before and with the one a cycle (a year; for days a week) before; NULL where there is none or where it is 0.
    """
    rows = series(df, date, value, period=period, measure=measure)
    by_time = Window.partitionBy(F.lit(0)).orderBy("t")  # a row for each period
    rows = rows.withColumns({"previous": F.lag("value").over(by_time), "cycle_ago": F.lag("value", CYCLES[period]).over(by_time), "total_to_date": F.sum("value").over(by_time)})
    rate = lambda was: F.round(F.try_divide(F.col("value") - F.col(was), F.abs(was)) * 100, digits)
    r = lambda c: F.round(c, digits)
    return rows.select(
        "period", r("value").alias("value"), "n", r("previous").alias("previous"), r(F.col("value") - F.col("previous")).alias("change"), rate("previous").alias("growth_pct"),
        r("cycle_ago").alias("cycle_ago"), rate("cycle_ago").alias("cycle_growth_pct"), r("total_to_date").alias("total_to_date"))


def detrended(rows: DataFrame) -> DataFrame:
    """(t, period, value, e): known values and what a straight line leaves of them."""
    known = rows.where("value is not null")
    fit = known.agg(F.coalesce(F.regr_slope("value", "t"), F.lit(0.0)).alias("_b"), F.avg("t").alias("_mt"), F.avg("value").alias("_mv"))  # one row
    return known.crossJoin(F.broadcast(fit)).select("t", "period", "value", (F.col("value") - F.col("_mv") - F.col("_b") * (F.col("t") - F.col("_mt"))).alias("e"))


def seasonality(df: DataFrame, date: str, value: str | None = None, *, period: str = "month", measure: str = "total", max_lag: int | None = None) -> DataFrame:
    """(lag, pairs, autocorrelation, strength, best) for lags of 1 to ``max_lag`` (by default two cycles), as far as the series has two of them.

    The straight trend is taken off first. ``strength`` is the share of the variance that the means of the places in the cycle explain, less what as many random
    means would (0 at least). ``best`` marks the lag of 2 or more with the largest autocorrelation, if that is beyond chance (2 / sqrt(n)) and the strength is above 0.
    """
    max_lag = max_lag or 2 * max(CYCLES[period], 2)
    e = detrended(series(df, date, value, period=period, measure=measure)).select("t", "e")
    lags = e.select("t", "e", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    whole = e.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("e") * F.col("e")).alias("_ss"))
    later = e.select(F.col("t").alias("_t2"), F.col("e").alias("_e2"))
    pairs = lags.join(later, F.col("t") + F.col("lag") == F.col("_t2")).groupBy("lag").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("e") * F.col("_e2")).alias("_c"))
    phases = lags.groupBy("lag", (F.col("t") % F.col("lag")).alias("_phase")).agg(F.count(F.lit(1)).alias("_k"), F.avg("e").alias("_m"))
    means = phases.groupBy("lag").agg(F.count(F.lit(1)).alias("_groups"), F.sum(F.col("_k") * F.col("_m") * F.col("_m")).alias("_between"))
    both = pairs.join(means, "lag").crossJoin(F.broadcast(whole)).where("_n >= 2 * lag")
    left = F.try_divide(F.col("_ss") - F.col("_between"), F.col("_n") - F.col("_groups"))
    strength = F.round(F.greatest(F.lit(0.0), 1 - F.try_divide(left * (F.col("_n") - 1), F.col("_ss"))), ROUND)
    acf = F.round(F.try_divide(F.col("_c"), F.col("_ss")), ROUND)
    rows = both.select("lag", "pairs", acf.alias("autocorrelation"), strength.alias("strength"), "_n")
    candidate = (F.col("lag") >= 2) & (F.col("autocorrelation") > 2 / F.sqrt("_n")) & (F.col("strength") > 0)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(candidate), F.desc("autocorrelation"), "lag")  # a row for each lag
    return rows.withColumn("best", F.coalesce(candidate & (F.row_number().over(order) == 1), F.lit(False))).drop("_n")


def seasonal_fit(rows: DataFrame, cycle: int) -> tuple[DataFrame, DataFrame]:
    """Trend and effects fitted together: (_phase, _k, _t, _v), means of each place in the cycle, and one row of their common slope ``_b``, its ``_sxx``, residual squares ``_rss`` and degrees of freedom ``_dof``.

    The slope is that of the distances from the phases' means, so effects don't lean on the trend, nor it on them. With a cycle of 1 it is the straight line.
    """
    known = rows.where("value is not null")
    n = F.count(F.lit(1)).cast("double")
    phases = known.groupBy((F.col("t") % cycle).alias("_phase")).agg(
        n.alias("_k"), F.avg("t").alias("_t"), F.avg("value").alias("_v"), (n * F.var_pop("t")).alias("_tt"), (n * F.covar_pop("t", "value")).alias("_tv"), (n * F.var_pop("value")).alias("_vv"))
    sums = phases.agg(F.sum("_tt").alias("_sxx"), F.sum("_tv").alias("_sxy"), F.sum("_vv").alias("_syy"), (F.sum("_k") - F.count(F.lit(1)) - 1).alias("_dof"), F.sum("_k").alias("_n"),
                      (F.sum(F.col("_k") * F.col("_t")) / F.sum("_k")).alias("_mt"), (F.sum(F.col("_k") * F.col("_v")) / F.sum("_k")).alias("_mv"))
    slope = F.coalesce(F.try_divide(F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    return phases.select("_phase", "_k", "_t", "_v"), sums.select(slope.alias("_b"), "_sxx", F.greatest(F.lit(0.0), F.col("_syy") - slope * F.col("_sxy")).alias("_rss"), "_dof", "_mt", "_mv")


def seasonal_effects(df: DataFrame, date: str, value: str | None = None, *, period: str = "month", measure: str = "total", cycle: int | None = None, digits: int = 4) -> DataFrame:
    """(phase, n, mean, effect, effect_pct): of each place in the cycle, the mean value and its distance from the trend, also in percent of the mean of all. Phase 0 is that of the first period."""
    phases, fit = seasonal_fit(series(df, date, value, period=period, measure=measure), cycle or CYCLES[period])
    rows = phases.crossJoin(F.broadcast(fit))  # one row
    effect = F.col("_v") - F.col("_mv") - F.col("_b") * (F.col("_t") - F.col("_mt"))
    return rows.select(F.col("_phase").cast("int").alias("phase"), F.col("_k").cast("long").alias("n"), F.round("_v", digits).alias("mean"), F.round(effect, digits).alias("effect"), F.round(F.try_divide(effect * 100, F.abs("_mv")), digits).alias("effect_pct"))


def forecast_series(df: DataFrame, date: str, value: str | None = None, *, period: str = "month", measure: str = "total", periods: int = 6, level: float = 0.95, cycle: int | None = None, digits: int = 4) -> DataFrame:
    """(period, forecast, low, high): trend, and with a ``cycle`` the effects of its places, for the periods after the last one.

    The interval holds a new value with a chance of ``level`` if residuals are normal; each effect costs a degree of freedom. No rows where none is left or where
    a place of the cycle has no value.
    """
    rows = series(df, date, value, period=period, measure=measure)
    cycle = cycle or 1
    phases, fit = seasonal_fit(rows, cycle)
    last = rows.agg(F.max("t").alias("_last"), F.max("period").alias("_end"))
    ahead = fit.where("_dof >= 1").crossJoin(F.broadcast(last)).select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_i"))  # one row each
    ahead = ahead.withColumn("_at", F.col("_last") + F.col("_i")).withColumn("_phase", F.col("_at") % cycle).join(phases, "_phase")
    apart = F.col("_at") - F.col("_t")
    point = F.col("_v") + F.col("_b") * apart
    wide = t_quantile(level, F.col("_dof")) * F.sqrt(F.col("_rss") / F.col("_dof")) * F.sqrt(1 + 1 / F.col("_k") + F.coalesce(F.try_divide(apart * apart, F.col("_sxx")), F.lit(0.0)))
    shift = F.expr(f"_end + _i * {STEPS[period]}").cast("date")
    r = lambda c: F.round(c, digits)
    return ahead.select(shift.alias("period"), r(point).alias("forecast"), r(point - wide).alias("low"), r(point + wide).alias("high"))
