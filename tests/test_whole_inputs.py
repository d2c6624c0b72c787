"""Results over the whole input, beyond what the registered SQL covers."""

import duckdb

from cairn.operators import statements as st
from cairn.plans import registry
from cairn.sources import readers as rd

DATA = "/root/testdata/sf0.001"
#: The first 200 lines of each statement are those of its first 50 events.
DETECT_SQL = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM '{DATA}/events.parquet')
SELECT user_id, (max((event_id % 3 <> 0)::INT) + max((event_id % 3 = 0)::INT))::INT FROM e WHERE nth <= 50 GROUP BY 1"""


def test_statement_detect_reads_every_statement(spark):
    got = {(r.statement_id, r.score, r.is_statement) for r in registry.statement_detect(spark, DATA).collect()}
    assert got == {(i, n, n >= 2) for i, n in duckdb.sql(DETECT_SQL).fetchall()}


def test_first_200_lines_are_those_of_each_statement(spark):
    rows = [(1, 5000 + k, "UPI" if k == 199 else "Bank" if k == 200 else "x") for k in range(201)] + [(2, 900, "bank upi"), (3, 10**9, "x")]
    got = {tuple(r) for r in st.detect_statements(spark.createDataFrame(rows, "statement_id long, line_no long, text string")).collect()}
    assert got == {(1, 1, False), (2, 2, True), (3, 0, False)}


def test_columns_of_the_longest_line(spark):
    lines = spark.createDataFrame([("1;a",), ("2;b",), (None,), ("3;c;d;",)], "text string").coalesce(1)
    split = rd.split_delimited(lines, "text", ";")
    assert split.columns == ["col_0", "col_1", "col_2", "col_3"]
    assert [tuple(r) for r in split.where("col_0 = 3").collect()] == [("3", "c", "d", "")]
    assert rd.split_delimited(lines.limit(0), "text", ";").count() == 0
