"""Nulls, ties, constants, empty tables and small hand-computed cases."""

import datetime as dt
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.functions import columns as cl
from cairn.functions import values as vl
from cairn.operators import aggregate as ag
from cairn.operators import anomalies as an
from cairn.operators import charts as ch
from cairn.operators import cleaning as cn
from cairn.operators import describe as ds
from cairn.operators import profile as pf
from cairn.operators import statements as st
from cairn.operators import text as tx
from cairn.plans import pipeline as pl
from cairn.plans import registry
from cairn.sources import readers as rd


@pytest.fixture(scope="module")
def cleaning_frame(spark):
    rows = [("Alice", 25.0, 100, "2024/01/01"), ("Alice", 25.0, 100, "2024/01/01"), ("Bob", None, 200, "bad"), (None, 40.0, 300, "2024/01/03")]
    return spark.createDataFrame(rows, "`Customer Name` string, `Customer Age` double, Sales long, `Order Date` string")


def test_clean_v2_by_hand(cleaning_frame):
    before = pf.quality(cleaning_frame, "clean").first().score
    out, report = cn.clean(cleaning_frame, cn.V2)
    assert out.columns == ["customer_name", "customer_age", "sales", "order_date"]
    rows = {r.sales: r for r in out.collect()}
    assert len(rows) == 3 and rows[200].customer_age == 25.0 and rows[300].customer_name == "Alice"
    assert before == 63 and pf.quality(out, "clean").first().score == 92
    assert {(r.step, r.column, r.n) for r in report.collect()} >= {("impute", "customer_age", 1), ("duplicates", None, 1)}
    again, _ = cn.clean(out, (cn.impute_v2, cn.drop_duplicates))
    assert again.count() == 3


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "a double, b double, c string")
    assert {r.value for r in ag.aggregate(df, "a").collect()} == {0.0, None}
    assert ds.describe(df).where("stat = 'count' and value = 0").count() == 2
    assert ds.correlation_pairs(df).first().r is None
    assert an.anomalies_summary(df).count() == 0 and ch.histogram(df, "a").count() == 0
    assert pf.quality(df).first().score == 100 and ds.categorical_profile(df).count() == 0
    assert pf.recommendations(df).first().text == "The data looks healthy"
    one = spark.createDataFrame([(1.0, None, "x")], df.schema)
    assert {r.bin: r.n for r in ch.histogram(one, "a").collect() if r.n} == {1: 1}
    assert ds.nulls_overall(one).where("metric = 'null_cells'").first().value == 1


def test_constants_ties_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0, "b"), (1.0, 3.0, "a"), (1.0, float("nan"), "a"), (1.0, 5.0, "b")], "k double, v double, c string")
    clean = vl.canonical_nulls(df)
    assert clean.where("v is null").count() == 1
    assert ds.correlation_pairs(clean).first().r is None
    assert an.zscore_counts(clean, ["k"]).first().n == 0
    assert ds.categorical_profile(clean).first().top_value == "a"
    assert cn.impute(clean)[0].where("v = 3.0").count() == 2


def test_names_and_columns(spark):
    assert cl.standard_names([" A b ", "a_b", "A-b!", "é"]) == ["a_b", "a_b_2", "ab", "column"]
    df = spark.createDataFrame([], "price double, Amount double, Name string, flag boolean")
    assert cl.resolve_column(df, hints=cl.AMOUNT_HINTS) == "price" and cl.resolve_column(df, hints=cl.AMOUNT_HINTS, take="last") == "Amount"
    assert cl.resolve_column(df, "amount") == "Amount" and cl.resolve_column(df, "nam") == "Name"
    assert cl.roles(df)["flag"] == "boolean"


def test_values(spark):
    rows = spark.createDataFrame([("- Rs.1,700.50",), ("+ Rs.20",), ("31 Feb'24",), ("05 aug",)], "t string")
    got = [tuple(r) for r in rows.select(vl.amount_of(F.col("t")), vl.flow_of(F.col("t")), vl.day_month(F.col("t"), F.lit("2023"))).collect()]
    assert got == [(-1700.5, "paid", None), (20.0, "received", None), (None, None, None), (None, None, dt.date(2023, 8, 5))]


def test_statement_rules(spark):
    lines = ["before", "05 Aug'24", "9:48 PM Paid to Shop", "UPI Ref No 1", "- Rs.1,200", "# Food", "12 items", "Received from Ann", "+ Rs.5", "06 Aug", "no amount"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "statement_id long, line_no int, text string")
    got = sorted(tuple(r) for r in st.transactions(df, 2020).select("time", "description", "type", "category", "amount", F.col("date").cast("string")).collect() if r.time)
    assert got == [("9:48 PM", "Paid to Shop", "paid", "Food", -1200.0, "2024-08-05")]
    assert st.transactions(df, 2020).count() == 2


def test_sentences_across_cells(spark):
    cells = ["One. Two", "goes on", None, "and ends. Three!", "  ", "Four"]
    df = spark.createDataFrame(list(enumerate(cells)), "o long, t string")
    for n in (1, 7):
        assert tx.joined_sentences(df.repartition(n), "t", "o", buckets=3).first().sentences == 4
    assert {r.metric: r.value for r in tx.text_stats(df, "t").collect()}["words"] == 8


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,NA\n2,b\n")
    (tmp_path / "n.txt").write_text("1\n\n 2.5 \n")
    (tmp_path / "l.txt").write_text("a;1\nb;2\n")
    assert rd.read(spark, str(tmp_path / "a.csv")).where("y is null").count() == 1
    assert rd.read(spark, str(tmp_path / "n.txt")).columns == ["value"]
    split = rd.split_delimited(rd.read(spark, str(tmp_path / "l.txt")), "line")
    assert [tuple(r) for r in split.collect()] == [("a", "1"), ("b", "2")]
    with pytest.raises(ValueError, match="unsupported"):
        rd.read(spark, "x.exe")


def test_pipeline_steps(cleaning_frame):
    out = pl.run(cleaning_frame, ("clean", "describe", "quality"), cn.V2)
    assert set(out) == {"clean", "clean_report", "describe", "quality"} and out["quality"].first().score == 67
    out["clean"].unpersist()


def test_windows_over_a_year_end():
    assert vl.time_window("last_month", dt.date(2024, 1, 15)) == (dt.date(2023, 12, 1), dt.date(2024, 1, 1))
    assert vl.time_window("this_quarter", dt.date(2024, 12, 31)) == (dt.date(2024, 10, 1), dt.date(2025, 1, 1))


def test_histogram_of_values_on_edges(spark, tmp_path):
    """Values of two digits on and around the edges of 20 bins fall where the SQL puts them."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT round(k * 30.61 + d, 2)::DOUBLE AS value FROM range(21) t(k), (VALUES (0.0), (0.01), (-0.01)) u(d) WHERE round(k * 30.61 + d, 2) BETWEEN 0 AND 612.2) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = registry.hist20(spark, str(tmp_path)).select("bin", "low", "high", "n").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLES["hist20"]).fetchall())


def test_only_texts_of_a_dates_shape_are_parsed(spark):
    """The same timestamps as by parsing every text, and texts that are no dates cost less than a few parses of dates."""
    days = ["2024-01-05", "2024/01/05", "05/01/2024", "05-01-2024", "2024-01-05 10:11:12", "2024-01-05T10:11:12", "12024-01-05", "+12024-01-05", "-2024-01-05"]
    texts = [*days, *[f" {d}" for d in days], *[f"{d} " for d in days], *[f"{d}x" for d in days], *[d[:-1] for d in days], *[d.replace("-", "/") for d in days], "31/02/2024", "2024-13-01", "1-URGENT", "5 Aug", "", " ", "-", "1/2", "1-2-3", "٢٠٢٤-٠١-٠٥", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in vl.DATE_FORMATS])
    assert df.where(~vl.to_date(F.col("t")).eqNullSafe(every)).count() == 0
    assert df.where(vl.to_date(F.col("t")).isNotNull()).count() >= len(days) - 2
    named = spark.createDataFrame([("5-Aug-2024",), ("Aug 5, 2024",), ("5-8-2024",)], "t string")
    assert [r.d is not None for r in named.select(vl.to_date(F.col("t"), ["d-MMM-yyyy", "MMM d, yyyy"]).alias("d")).collect()] == [True, True, False]

    def seconds(text):
        rows = spark.range(0, 400_000, numPartitions=4).select(F.concat(F.lit(text), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("t")).localCheckpoint()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            rows.agg(F.count(vl.to_date(F.col("t")))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds("1-URGENT") < 2 * seconds("2024-01-") + 0.2
