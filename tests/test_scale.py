"""Forms that have to hold at scale give what the plain ones give; edges of charts, models and sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import charts, cleaning, describe, models
from cairn.plans import pipeline
from cairn.sources import readers


def test_exact_quartiles_by_brackets(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 33, 700):
        for draw in (lambda: rng.lognormvariate(0, 3), lambda: float(rng.randint(0, 5)), lambda: 1.5):
            rows = [(draw(), None if rng.random() < 0.3 else draw()) for _ in range(n)]
            df = spark.createDataFrame(rows, "a double, `b.c` double").withColumnRenamed("b.c", "b")
            row = describe.stats_row(df, ["a", "b"]).first()
            want = df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in "ab"]).first()
            for c in "ab":
                got = [row[c][p] for p in ("p25", "p50", "p75")]
                assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, rel_tol=1e-9)) for g, w in zip(got, want[c] or [None] * 3, strict=True))


def test_fillers_are_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (5.0, "a"), (2.0, "b"), (None, "a"), (9.0, None)], "x double, t string")
    filled, report = cleaning.impute(df)
    assert sorted((r.x, r.t) for r in filled.collect()) == [(1.0, "b"), (2.0, "b"), (3.5, "a"), (5.0, "a"), (9.0, "a")]
    assert {(r.column, r.n) for r in report.collect()} == {("x", 1), ("t", 1)}


def test_duplicates_are_grouped_once(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, None)], "a int, b string")
    kept, report = cleaning.drop_duplicates(df)
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, None), (2, "x")] and report.first().n == 2


def test_positions_over_time_stamps(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, 1 + k % 3, k % 24, k) for k in range(40)]
    df = spark.createDataFrame([(t, k, float(k)) for k, t in enumerate(at)], "t timestamp, k int, v double")
    order = sorted(range(40), key=lambda k: (at[k], k))
    assert {(int(r.x), int(r.y)) for r in models.positions(df, "t", "k", "v").collect()} == {(x, k) for x, k in enumerate(order)}


def test_charts_choose_kind_and_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 3, 4.0), ("a", 5, 6.0)], "t string, x int, y double")
    assert charts.chart_type(df) == "scatter" and charts.default_columns(df, "bar") == {"column": "t"}
    assert {tuple(r) for r in pipeline.chart(df).collect()} == {(1, 2.0), (3, 4.0), (5, 6.0)}
    assert {tuple(r) for r in pipeline.chart(df.select("t")).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in pipeline.chart(df, "line", x="x", y="nothing").collect()} == {(1, 1), (3, 3), (5, 5)}
    assert sum(r.n for r in pipeline.chart(df, "histogram").collect()) == 3 and pipeline.chart(df, "box").count() == 6
    with pytest.raises(ValueError, match="needs 2 numeric"):
        pipeline.chart(df.select("t", "x"), "scatter")
    with pytest.raises(ValueError, match="unknown chart"):
        pipeline.chart(df, "radar")


def test_predictions(spark):
    rows = [(k, float(k % 13), "ab"[k % 2], float(3 * (k % 13) + 1), k % 3) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, u double, t string, v double, c int")
    made = models.predict(df, "v", key="id").collect()
    assert {r.task for r in made} == {"regression"} and abs(next(r.value for r in made if r.metric == "r2") - 1) < 1e-6
    assert {(r.task, r.target) for r in models.predict(df).collect()} == {("classification", "c")}
    nulls = df.withColumn("t", F.when(F.col("id") % 10 != 0, F.col("t")))
    found = {r.metric: r.value for r in models.predict_classification(nulls, "t", ["u", "c"], "id").collect()}
    assert found["classes"] == 3 and found["train_rows"] + found["test_rows"] == 120
    with pytest.raises(ValueError, match="at least 10"):
        models.predict_regression(df.limit(9), "v", ["u"], "id")
    with pytest.raises(ValueError, match="two numeric columns or a text column"):
        models.predict(df.select("u"))


def test_null_lines(spark):
    lines = spark.createDataFrame([(None,), ("1;a",), ("2;b",), (None,)], "text string").coalesce(1)
    assert readers.detect_delimiter(lines, "text") == ";"
    assert sorted((tuple(r) for r in readers.split_delimited(lines, "text").collect()), key=str) == [("1", "a"), ("2", "b"), (None, None), (None, None)]
    assert readers.split_delimited(lines.where("text is null"), "text").columns == ["text"]


def test_catalog_tables_json_and_files(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").createOrReplaceTempView("one_view")
    found = readers.catalog_tables(spark, names=["one_view"])
    assert found["one_view"].count() == 1
    with pytest.raises(ValueError, match="no tables"):
        readers.catalog_tables(spark, names=["none of these"])
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for kind in ("json", "parquet", "orc"):
        readers.write(df, str(tmp_path / f"t.{kind}"), kind)
    assert {tuple(r) for r in readers.read(spark, str(tmp_path / "t.parquet")).collect()} == {(1, "x"), (2, None)}
    assert {(r.a, r.b) for r in readers.read(spark, str(tmp_path / "t.json"), "jsonl").collect()} == {(1, "x"), (2, None)}
    assert [tuple(r) for r in readers.head(df, 1, ["a"]).collect()] == [(1, "x")]


def test_summary_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = {(r.section, r.item, r.metric): r.value for r in pipeline.summary(df, ["a"]).collect()}
    assert rows["shape", None, "rows"] == 0 and rows["nulls", "a", "n_null"] == 0 and rows["describe", "a", "count"] == 0
    assert pipeline.upload_profile(df, ["a"]).where("section = 'quality'").count() == 2


def test_narrowed_brackets_are_exact(spark, monkeypatch):
    """Limits so low that brackets are narrowed several times."""
    for name, value in (("KEPT", 12), ("GRID", 20), ("SKETCH", 200), ("DIRECT", 100)):
        monkeypatch.setattr(describe, name, value)
    passes = []
    narrowed = describe.narrowed
    monkeypatch.setattr(describe, "narrowed", lambda df, *a: (passes.append(1), narrowed(df, *a))[1])
    rng = random.Random(5)
    for draw in (lambda: rng.lognormvariate(0, 2), lambda: float(rng.randint(0, 4)), lambda: round(rng.gauss(0, 1), 2) if rng.random() < 0.6 else 0.25):
        df = spark.createDataFrame([(draw(), None if rng.random() < 0.2 else draw(), 1.0) for _ in range(6000)], "a double, b double, c double")
        row, want = describe.stats_row(df, ["a", "b", "c"]).first(), df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in "abc"]).first()
        for c in "abc":
            assert all(math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-12) for g, w in zip([row[c][p] for p in ("p25", "p50", "p75")], want[c], strict=True))
    assert len(passes) == 3


def test_brackets_keep_few_values(spark, monkeypatch):
    for name, value in (("KEPT", 12), ("GRID", 20), ("SKETCH", 200), ("DIRECT", 100)):
        monkeypatch.setattr(describe, name, value)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    brackets, counts = {("v", k): (float(20_000 * p - 400), float(20_000 * p + 400)) for k, p in enumerate(describe.SHARES)}, {"v": 20_000}
    describe.narrowed(df, ["v"], brackets, counts)
    assert all(b - a <= 12 and a <= 19_999 * p <= b for (a, b), p in zip(brackets.values(), describe.SHARES, strict=True))


def test_types_stay_where_nothing_is_missing(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (4, 5)], "a int, b int")
    filled, report = cleaning.impute(df)
    assert dict(filled.dtypes) == {"a": "int", "b": "double"} and [tuple(r) for r in report.collect()] == [("impute", "b", "filled", 1)]
    same, report = cleaning.impute(df.select("a"))
    assert same.dtypes == [("a", "int")] and report.count() == 0


def test_tidy_is_the_three_steps(spark):
    df = spark.createDataFrame([(" a ", "$1,200", "2024/01/02", "7"), ("b", " 30 ", "none", None), (None, "5", "2024-02-03", "x")], "t string, n string, date string, m string")
    tidy, report = cleaning.tidy_text(df)
    plain, counted = cleaning.trim_text(df)
    plain = cleaning.coerce_dates(cleaning.coerce_numbers(plain)[0])[0]
    assert tidy.dtypes == plain.dtypes and sorted(map(str, tidy.collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, counted.collect())) == [("trim", "n", "trimmed", 1), ("trim", "t", "trimmed", 1)]


def test_run_names_every_action_and_releases(spark):
    import datetime as dt

    rows = [(dt.date(2024, 1, 1 + k % 28), k % 9, f"word{k % 4} and more.", float(k % 17), k % 3) for k in range(80)]
    df = spark.createDataFrame(rows, "day date, user int, note string, amount double, units int")
    with pipeline.run(df) as made:
        assert list(made) == ["clean_report", "clean", "summary", "insights"]
        assert made["clean"].storageLevel.useMemory and made["clean"].count() == 80 and {r.step for r in pipeline.steps_report(made).collect()} >= {"summary", "insights"}
        cleaned = made["clean"]
    assert not cleaned.storageLevel.useMemory and not made.kept
    every = pipeline.run(df, [n for n in pipeline.ANALYSES if n not in ("predict", "segments")], arguments={"forecast": {"target": "units", "periods": 2}, "head": {"n": 3}, "retention": {"user": "user"}})
    counts = {name: rows.count() for name, rows in every.items()}
    assert counts["forecast"] == 2 and counts["head"] == 3 and {name for name, n in counts.items() if not n} <= {"anomalies", "quality_issues", "seasonality"}  # one month
    assert {r.section for r in pipeline.run(df, ["no such step"])["no such step"].collect()} >= {"shape", "describe"}
    with pytest.raises(ValueError, match="needs a date column"):
        pipeline.run(df.drop("day"), ["clean", "growth"])
