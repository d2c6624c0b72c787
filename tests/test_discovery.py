"""Segments, series, intervals, retention, findings and associations against plain versions and by hand."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.statistics import t_quantile, t_solved
from cairn.operators import association, findings, models, retention, segments, series

# -- segments -----------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    """Three clusters of 120, 60 and 30 rows in features of very different scales, with a missing value and a constant."""
    rng = random.Random(4)
    rows = []
    for label, (x, y, n) in enumerate([(0.0, 1000.0, 120), (10.0, 9000.0, 60), (-12.0, 25000.0, 30)]):
        rows += [(len(rows) + i, x + rng.gauss(0, 0.5), y + rng.gauss(0, 300), 7.0, label) for i in range(n)]
    rows[5] = (5, None, *rows[5][2:])
    return spark.createDataFrame(rows, "id long, x double, y double, flat double, label int").repartition(5)


def test_planted_clusters_are_found(planted):
    model = segments.fit_segments(planted, "id", ["x", "y", "flat"], k=3)
    rows = segments.assign_segments(planted, model).collect()
    assert {(r.label, r.segment) for r in rows} == {(0, 0), (1, 1), (2, 2)}  # the largest first
    profile = {(r.segment, r.feature): r for r in segments.segment_profile(planted, model).collect()}
    assert [profile[k, "x"].n for k in range(3)] == [120, 60, 30] and profile[2, "x"].share == 14.29
    assert abs(profile[1, "y"].mean - 9000) < 200 and profile[2, "y"].main and not profile[2, "flat"].main and profile[0, "flat"].lift == 0


def test_number_of_segments_is_chosen(planted):
    model = segments.fit_segments(planted, "id", ["x", "y"])
    assert len(model.centres) == 3
    again = segments.fit_segments(planted.repartition(2), "id", ["x", "y"], k=3)
    assert np.allclose(model.centres, again.centres)  # draws don't depend on partitions


def test_silhouette_is_that_of_all_pairs(planted):
    model = segments.fit_segments(planted, "id", ["x", "y"], k=4)
    found = {r.segment: r for r in segments.segment_quality(planted, model).collect()}
    names = [f"p{j}" for j in range(2)]
    rows = planted.select(*[x.alias(n) for x, n in zip(model.scaled(), names, strict=True)], model.nearest()["i"].alias("s")).collect()
    points, own = np.array([[r.p0, r.p1] for r in rows]), np.array([r.s for r in rows])
    far = ((points[:, None] - points[None]) ** 2).sum(-1)
    values = []
    for i, s in enumerate(own):
        mean = {t: far[i, own == t].sum() / ((own == t).sum() - (t == s)) if (own == t).sum() > (t == s) else 0 for t in set(own.tolist())}
        a, b = mean.pop(int(s)), min(mean.values())
        values.append((b - a) / max(a, b))
    assert math.isclose(found[None].silhouette, np.mean(values), abs_tol=1e-4) and found[None].n == 210
    for s in set(own.tolist()):
        assert math.isclose(found[s].silhouette, np.mean([v for v, t in zip(values, own, strict=True) if s == t]), abs_tol=1e-4)


def test_segments_of_odd_tables(spark, planted):
    same = spark.createDataFrame([(i, 1.0) for i in range(9)], "id long, x double")
    model = segments.fit_segments(same, "id", k=4)
    assert len(model.centres) == 1 and {r.segment for r in segments.assign_segments(same, model).collect()} == {0}
    assert segments.segment_quality(same, model).where("segment is null").first().silhouette == 0
    two = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, float("nan"))], "id long, x double")
    assert segments.segments(two, "id", k=2).agg(F.sum("n")).first()[0] == 3
    for bad in (same.limit(0), same.select("id")):
        with pytest.raises(ValueError, match="segments need"):
            segments.fit_segments(bad, "id", k=2)


# -- statistics and forecasts -------------------------------------------------


def test_t_quantiles(spark):
    known = {(0.95, 1): 12.7062, (0.95, 2): 4.302653, (0.95, 3): 3.182446, (0.95, 10): 2.228139, (0.99, 5): 4.032143, (0.95, 30): 2.042272, (0.95, 60): 2.000298, (0.9, 120): 1.657651, (0.95, 10**9): 1.959964}
    for (level, dof), want in known.items():
        got = spark.range(1).select(t_quantile(level, F.lit(dof)).alias("t")).first().t
        assert math.isclose(got, want, abs_tol=6e-5 if dof == 1 else 2e-6)
    for dof in (31, 45):  # the series meets the solution
        assert math.isclose(spark.range(1).select(t_quantile(0.99, F.lit(dof)).alias("t")).first().t, t_solved(0.99, dof), abs_tol=1e-5)
    assert spark.range(1).select(t_quantile(0.9, F.lit(0)).alias("t")).first().t is None
    with pytest.raises(ValueError, match="level"):
        t_quantile(1.0, F.lit(3))


def test_line_over_places(spark):
    rng = random.Random(8)
    rows = [(dt.date(2024, 1, 1 + min(i % 40, 9)), i, 3.0 * i + rng.gauss(0, 40) + 1e6) for i in range(500)]  # most on one day
    rows += [(None, 1000 + i, float(i)) for i in range(3)] + [(dt.date(2024, 1, 2), 2000, None)]
    df = spark.createDataFrame(rows, "d date, k int, v double").repartition(7)
    order = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] is not None, r[0] or dt.date.min, r[1]))
    x, y = np.arange(len(order), dtype=float), np.array([r[2] for r in order])
    slope, intercept = np.polyfit(x, y, 1)
    fit = models.line_fit(df, "d", "k", "v").first()
    assert fit.n == len(order) and math.isclose(fit.slope, slope, rel_tol=1e-6) and math.isclose(fit.intercept, intercept, rel_tol=1e-6) and fit["last"] == y[-1]
    left = ((y - intercept - slope * x) ** 2).sum()
    got = models.forecast_interval(df, "v", "d", "k", periods=3, level=0.9).orderBy("period").collect()
    for i, r in enumerate(got):
        at = len(x) + i
        wide = t_solved(0.9, len(x) - 2) * math.sqrt(left / (len(x) - 2) * (1 + 1 / len(x) + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
        assert r.period == at + 1 and math.isclose(r.forecast, intercept + slope * at, rel_tol=1e-6) and math.isclose(r.high - r.low, 2 * wide, rel_tol=1e-5)
    assert models.forecast_interval(df.limit(4), "v", "d", "k").count() == 0
    flat = models.forecast_interval(spark.range(9).select(F.lit(dt.date(2024, 1, 1)).alias("d"), F.col("id").alias("k"), F.lit(5.0).alias("v")), "v", "d", "k").first()
    assert (flat.forecast, flat.low, flat.high) == (5.0, 5.0, 5.0)


def test_intervals_cover(spark):
    """Of new values of the same kind some nine in ten lie within."""
    inside = 0
    for seed in range(12):
        rng = random.Random(seed)
        month = lambda i: dt.date(2020 + i // 12, 1 + i % 12, 15)
        value = lambda i, rng=rng: 100 + 2 * i + 30 * math.sin(i * math.pi / 6) + rng.gauss(0, 5)
        df = spark.createDataFrame([(month(i), value(i)) for i in range(36)], "d date, v double").coalesce(1)
        rows = series.forecast_series(df, "d", "v", periods=4, level=0.9, cycle=12).orderBy("period").collect()
        assert [r.period for r in rows] == [dt.date(2023, k, 1) for k in (1, 2, 3, 4)]
        inside += sum(r.low <= value(36 + i) <= r.high for i, r in enumerate(rows))
    assert 40 <= inside <= 48


# -- series -------------------------------------------------------------------


@pytest.fixture(scope="module")
def months(spark):
    rows = [(dt.date(2021 + i // 12, 1 + i % 12, 3), float(10 + i + 5 * (i % 12 == 11))) for i in range(30) if i != 7]
    return spark.createDataFrame([*rows, (dt.date(2021, 1, 9), 2.0), (None, 99.0)], "d date, v double")


def test_growth_fills_gaps(months):
    rows = {r.period: r for r in series.growth(months, "d", "v").collect()}
    assert len(rows) == 30 and rows[dt.date(2021, 1, 1)].value == 12 and rows[dt.date(2021, 1, 1)].previous is None
    gap, after = rows[dt.date(2021, 8, 1)], rows[dt.date(2021, 9, 1)]
    assert (gap.value, gap.n, gap.growth_pct) == (0, 0, -100) and after.previous == 0 and after.growth_pct is None
    assert rows[dt.date(2022, 3, 1)].cycle_ago == 12 and rows[dt.date(2022, 3, 1)].cycle_growth_pct == 100 and rows[dt.date(2023, 6, 1)].total_to_date == sum(10 + i for i in range(30) if i != 7) + 2 + 10
    average = {r.period: r for r in series.growth(months, "d", "v", measure="average").collect()}
    assert average[dt.date(2021, 8, 1)].value is None and average[dt.date(2021, 1, 1)].value == 6
    assert series.growth(months.limit(0), "d", "v").count() == 0
    for arguments in ({"period": "hour"}, {"measure": "middle"}):
        with pytest.raises(ValueError, match="unknown"):
            series.growth(months, "d", "v", **arguments)


def test_seasons_are_found(spark):
    rng = random.Random(2)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 50 + i + [0, 1, 2, 9, 4, -8, -8][i % 7] + rng.gauss(0, 0.5)) for i in range(70)]
    df = spark.createDataFrame(rows, "d date, v double")
    lags = {r.lag: r for r in series.seasonality(df, "d", "v", period="day").collect()}
    assert [k for k, r in lags.items() if r.best] == [7] and lags[7].strength > 0.95 and lags[7].autocorrelation > 0.8 and lags[3].strength < 0.2
    effects = {r.phase: r.effect for r in series.seasonal_effects(df, "d", "v", period="day").collect()}
    assert max(effects, key=effects.get) == 3 and min(effects, key=effects.get) in (5, 6) and abs(sum(effects.values())) < 1e-6
    line = spark.createDataFrame([(r[0], float(i)) for i, r in enumerate(rows)], "d date, v double")
    assert series.seasonality(line, "d", "v", period="day").where("best").count() == 0
    assert series.seasonality(df.limit(0), "d", "v", period="day").count() == 0


def test_autocorrelation_is_the_plain_one(months):
    rows = [r.value for r in series.series(months, "d", "v").orderBy("t").collect()]
    x = np.arange(len(rows))
    e = np.array(rows) - np.polyval(np.polyfit(x, rows, 1), x)
    for r in series.seasonality(months, "d", "v", max_lag=12).collect():
        assert math.isclose(r.autocorrelation, (e[: -r.lag] * e[r.lag :]).sum() / (e * e).sum(), abs_tol=1e-6) and r.pairs == len(rows) - r.lag


# -- retention ----------------------------------------------------------------


def test_retention_by_hand(spark):
    week = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=7 * k + 2)
    seen = {"a": [0, 1, 2, 3], "b": [0, 2], "c": [0], "d": [1, 3], "e": [3]}
    rows = [(u, week(k)) for u, ks in seen.items() for k in ks for _ in range(3)] + [(None, week(1)), ("z", None)]
    df = spark.createDataFrame(rows, "u string, d date")
    first = dt.date(2024, 1, 1)
    got = {((r.cohort - first).days // 7, r.offset): (r.users, r.cohort_size, r.rate) for r in retention.retention(df, "u", "d").collect()}
    assert got == {
        (0, 0): (3, 3, 100.0), (0, 1): (1, 3, 33.33), (0, 2): (2, 3, 66.67), (0, 3): (1, 3, 33.33),
        (1, 0): (1, 1, 100.0), (1, 1): (0, 1, 0.0), (1, 2): (1, 1, 100.0), (3, 0): (1, 1, 100.0)}
    wide = {(r.cohort - first).days // 7: [r.p0, r.p1, r.p2, r.p3, r.p4] for r in retention.retention_triangle(df, "u", "d").collect()}
    assert wide[1] == [100.0, 0.0, 100.0, None, None]
    flow = {(r.period - first).days // 7: (r.active, r.new, r.retained, r.returned, r.lost) for r in retention.activity(df, "u", "d").collect()}
    assert flow == {0: (3, 3, 0, 0, 0), 1: (2, 1, 1, 0, 2), 2: (2, 0, 1, 1, 1), 3: (3, 1, 1, 1, 1)}
    assert retention.retention(df.limit(0), "u", "d").count() == 0 and retention.activity(df.limit(0), "u", "d").count() == 0


@pytest.mark.parametrize("period", ["day", "week", "month", "quarter", "year"])
def test_retention_is_the_plain_one(spark, period):
    rng = random.Random(6)
    rows = [(rng.randint(1, 25), dt.date(2022, 11, 20) + dt.timedelta(days=rng.randint(0, 500))) for _ in range(300)]
    step = {"day": lambda d: d.toordinal(), "week": lambda d: (d.toordinal() - 1) // 7, "month": lambda d: d.year * 12 + d.month - 1, "quarter": lambda d: d.year * 4 + (d.month - 1) // 3, "year": lambda d: d.year}[period]
    seen = {}
    for u, d in rows:
        seen.setdefault(u, set()).add(step(d))
    want = Counter((min(s), k - min(s)) for s in seen.values() for k in s)
    got = retention.retention(spark.createDataFrame(rows, "u int, d date"), "u", "d", period=period).collect()
    assert {(step(r.cohort), r.offset): r.users for r in got if r.users} == dict(want)
    last = max(max(s) for s in seen.values())
    assert len(got) == sum(last - c + 1 for c in {min(s) for s in seen.values()})


# -- findings -----------------------------------------------------------------


def test_findings_by_hand(spark):
    rows = [(i, -1.0 if i == 3 else float(i), float("nan") if i < 2 else 1.5 * i, "2024-01-0%d" % (1 + i % 9) if i % 4 else "soon", f"name {i}", dt.date(1800, 1, 1) if i == 7 else dt.date(2024, 5, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, unitPrice double, delta double, seen string, label string, made date")
    found = {(r.kind, r.column): r for r in findings.quality_issues(df, as_of=dt.date(2024, 4, 1)).collect()}
    assert set(found) == {("negative", "unitPrice"), ("missing", "delta"), ("invalid_date", "seen"), ("high_cardinality", "label"), ("early_date", "made"), ("late_date", "made")}
    assert found["missing", "delta"].n == 2 and found["missing", "delta"].severity == "informational" and found["invalid_date", "seen"].n == 10 and found["late_date", "made"].pct == 97.5
    order = [r.priority for r in findings.quality_issues(df).collect()]
    assert order == sorted(order)
    twice = findings.quality_issues(df.unionByName(df)).where("kind = 'repeated_rows'").first()
    assert (twice.severity, twice.n, twice.pct) == ("critical", 40, 50.0)
    assert findings.quality_issues(df.limit(0)).count() == 0
    assert findings.quality_issues(spark.createDataFrame([(1, None)], "a int, b string")).first().kind == "empty_column"
    assert not findings.can_not_be_negative("package_name") and findings.can_not_be_negative("Age") and findings.can_not_be_negative("order_qty")


def test_sketches_merge(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("day"), (F.col("id") % 700).alias("user"), F.when(F.col("id") % 10 > 0, F.col("id") * 0.5).alias("v"), F.concat(F.lit("t"), F.col("id") % 5).alias("t"))
    parts = findings.column_sketches(df, ["day"])
    assert parts.count() == 9 and "sketch" in parts.columns
    whole = {r.column: r for r in findings.merged_profile(parts).collect()}
    once = {r.column: r for r in findings.merged_profile(findings.column_sketches(df, columns=["user", "v", "t"])).collect()}
    for c in ("user", "v", "t"):
        assert [whole[c][k] for k in ("n", "n_null", "pct_null", "low", "high")] == [once[c][k] for k in ("n", "n_null", "pct_null", "low", "high")]
        assert math.isclose(whole[c].distinct, df.select(c).distinct().where(f"{c} is not null").count(), rel_tol=0.05)
    assert {r.day for r in findings.merged_profile(parts, ["day"]).collect()} == {0, 1, 2}


# -- associations -------------------------------------------------------------


def test_associations_are_the_plain_ones(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), None if rng.random() < 0.1 else rng.choice("xy"), rng.gauss(0, 1), None if rng.random() < 0.1 else rng.random()) for _ in range(400)]
    rows = [(a, "x" if a == "a" and rng.random() < 0.7 else b, v + (a == "b"), w) for a, b, v, w in rows]
    df = spark.createDataFrame(rows, "a string, b string, v double, w double").withColumn("one", F.lit("k"))
    got = {(r.col_a, r.col_b): r.association for r in association.associations(df).collect()}
    met = Counter((a, b) for a, b, _, _ in rows if b is not None)
    n = sum(met.values())
    ra, cb = Counter(), Counter()
    for (a, b), k in met.items():
        ra[a] += k
        cb[b] += k
    chi = sum((met[a, b] - ra[a] * cb[b] / n) ** 2 / (ra[a] * cb[b] / n) for a in ra for b in cb)
    assert math.isclose(got["a", "b"], math.sqrt(chi / n / (min(len(ra), len(cb)) - 1)), abs_tol=1e-6) and got["a", "one"] is None
    values = [(a, w) for a, _, _, w in rows if w is not None]
    mean = np.mean([w for _, w in values])
    groups = [[w for a, w in values if a == g] for g in "abc"]
    assert math.isclose(got["a", "w"], math.sqrt(sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups) / sum((w - mean) ** 2 for _, w in values)), abs_tol=1e-6)
    assert math.isclose(got["v", "w"], np.corrcoef([r[2] for r in rows if r[3] is not None], [r[3] for r in rows if r[3] is not None])[0, 1], abs_tol=1e-6)
    cells = association.heatmap(df).collect()
    assert len(cells) == 25 and {(r.x, r.y): r.association for r in cells}["b", "a"] == got["a", "b"]


def test_charts_by_roles(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    trend = spark.createDataFrame([(day(i), float(i * i)) for i in range(30)], "d date, v double")
    assert association.best_chart(trend)[0] == "line"
    bars = spark.createDataFrame([("ab"[i % 2], float(100 * (i % 2) + i % 7)) for i in range(60)], "t string, v double")
    kind, rows = association.best_chart(bars)
    assert kind == "bar" and [r.x for r in rows.collect()] == ["b", "a"]
    points = spark.createDataFrame([(float(i), float(-3 * i)) for i in range(30)], "u double, v double")
    assert association.best_chart(points)[0] == "scatter"
    three = spark.createDataFrame([(float(i), float(-3 * i), 2.0 * i) for i in range(30)], "u double, v double, w double")
    choice = [(r.chart, r.x, r.y) for r in association.chart_choice(three).orderBy("rank").collect()]
    assert ("heatmap", None, None) in choice and ("histogram", "u", None) in choice and len(choice) == 7
    assert association.best_chart(spark.createDataFrame([("a",), ("b",)], "t string"))[0] == "pie"
    assert association.best_chart(spark.createDataFrame([(1.0,), (2.0,)], "v double"))[0] == "histogram"
    with pytest.raises(ValueError, match="a chart needs"):
        association.best_chart(spark.createDataFrame([(True,)], "b boolean"))


# -- predictions --------------------------------------------------------------


def test_many_values_are_coded_by_their_means(spark, monkeypatch):
    monkeypatch.setattr(models, "MAX_LABELS", 20)
    rng = random.Random(1)
    effect = {f"v{k}": rng.gauss(0, 10) for k in range(60)}
    rows = [(i, t, float(effect[t] + rng.gauss(0, 0.1)), "yes" if effect[t] > 0 else "no") for i in range(3000) for t in [f"v{rng.randrange(60)}"]]
    df = spark.createDataFrame(rows, "id long, t string, y double, c string")
    made = {r.metric: r.value for r in models.predict_regression(df, "y", ["t"], "id").collect()}
    assert made["r2"] > 0.97
    assert {r.metric: r.value for r in models.predict_classification(df.drop("y"), "c", ["t"], "id").collect()}["accuracy"] > 0.95
    coded = models.target_means(df.withColumn("_test", models.in_test(df, "id")), "y", ["t"])
    assert coded.count() == 3000
    train = [r for r in rows if r[0] % 5]
    prior = np.mean([r[2] for r in train])
    first = coded.where("id = 1").first()
    others = [r[2] for r in train if r[1] == first.t and r[0] != 1]
    assert math.isclose(first["_x_t"], (sum(others) + models.PULL * prior) / (len(others) + models.PULL), rel_tol=1e-9)
