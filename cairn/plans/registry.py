"""Registered queries and their SQL. Derived inputs are written once in either language below."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as cl
from ..functions import values as vl
from ..operators import aggregate as ag
from ..operators import anomalies as an
from ..operators import charts as ch
from ..operators import cleaning as cn
from ..operators import describe as ds
from ..operators import insights as ins
from ..operators import models as md
from ..operators import profile as pf
from ..operators import statements as st
from ..operators import text as tx
from ..sources import readers as rd
from . import discovery  # noqa: F401  registers its queries
from . import pipeline as pl
from .base import ORACLES, QUERIES, query, table, union_sql

FLAGSHIP = "group_total_top15"

# -- derived inputs -----------------------------------------------------------

ORDERS_NULLS_SQL = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"
REPEATS_SQL = f"(SELECT * FROM {ORDERS_NULLS_SQL} UNION ALL SELECT * FROM {ORDERS_NULLS_SQL} WHERE o_orderkey % 10 = 0)"
DIRTY_SQL = """(SELECT c_custkey, '  ' || c_name || ' ' AS c_name, '$' || CASE WHEN c_custkey % 3 = 0 THEN '1,' ELSE '' END || cast(100 + c_custkey % 900 AS VARCHAR) AS balance,
  CASE WHEN c_custkey % 13 = 0 THEN 'bad-date' ELSE '2024/01/' || lpad(cast(1 + c_custkey % 28 AS VARCHAR), 2, '0') END AS date FROM customer)"""
LINEITEM_SQL = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE AS one FROM lineitem)"


def orders_nulls(s, d) -> DataFrame:
    return table(s, d, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


def orders_repeats(s, d) -> DataFrame:
    o = orders_nulls(s, d)
    return o.unionByName(o.where("o_orderkey % 10 = 0"))


def customer_dirty(s, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k, F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"),
        F.concat(F.lit("$"), F.when(k % 3 == 0, "1,").otherwise(""), (100 + k % 900).cast("string")).alias("balance"),
        F.when(k % 13 == 0, "bad-date").otherwise(F.concat(F.lit("2024/01/"), F.lpad((1 + k % 28).cast("string"), 2, "0"))).alias("date"))


def lineitem_const(s, d) -> DataFrame:
    return table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(1.0).alias("one"))


LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "one")


def event_amounts(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", "user_id", (F.col("value") - 50).alias("amount"), F.col("event_type").alias("category"), F.col("ts").alias("date"))


# -- aggregates ---------------------------------------------------------------


@query("SELECT o_orderpriority AS group_value, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def group_total_top15(s, d):
    return ag.group_total(table(s, d, "orders"), "o_orderpriority", "o_totalprice")


@query("SELECT event_type AS group_value, count(*)::DOUBLE AS total, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def group_count_top15(s, d):
    return ag.group_total(table(s, d, "events"), "event_type")


@query("SELECT event_type AS group_value, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def group_sum_count(s, d):
    events = table(s, d, "events")
    return ag.group_total(events, cl.resolve_column(events, hints=(*cl.CATEGORY_HINTS, "event_type")), "value")


@query("SELECT 'total' AS metric, round(sum(l_extendedprice), 2) AS value FROM lineitem")
def metric_scalar(s, d):
    return ag.aggregate(table(s, d, "lineitem"), "l_extendedprice", "total")


def metrics_sql(column: str, source: str) -> str:
    return union_sql(f"SELECT '{m}' AS metric, round({f}, 2) AS value FROM {source}" for m, f in (("total", f"coalesce(sum({column}), 0)"), ("average", f"avg({column})"), ("count", f"count({column})::DOUBLE"), ("maximum", f"max({column})"), ("minimum", f"min({column})")))


@query(metrics_sql("l_extendedprice", "lineitem"))
def metric_bundle(s, d):
    return ag.aggregate(table(s, d, "lineitem"), "l_extendedprice")


@query(metrics_sql("o_totalprice", "orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-06-01'"))
def metric_time_range(s, d):
    return ag.aggregate(table(s, d, "orders"), "o_totalprice", where=vl.in_range("o_orderdate", dt.date(1996, 3, 1), dt.date(1996, 6, 1)))


@query(metrics_sql("o_totalprice", "orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 12"))
def metric_month(s, d):
    return ag.aggregate(table(s, d, "orders"), "o_totalprice", where=vl.in_month("o_orderdate", 12, 1997))


@query(metrics_sql("o_totalprice", "orders WHERE month(o_orderdate) = 2"))
def metric_month_any_year(s, d):
    return ag.aggregate(table(s, d, "orders"), "o_totalprice", where=vl.in_month("o_orderdate", 2))


PRESETS = {"today": ("2024-01-31", "2024-02-01"), "yesterday": ("2024-01-30", "2024-01-31"), "this_week": ("2024-01-29", "2024-02-05"), "last_week": ("2024-01-22", "2024-01-29"), "this_month": ("2024-01-01", "2024-02-01"), "last_month": ("2023-12-01", "2024-01-01"), "this_quarter": ("2024-01-01", "2024-04-01"), "last_quarter": ("2023-10-01", "2024-01-01"), "this_year": ("2024-01-01", "2025-01-01"), "last_year": ("2023-01-01", "2024-01-01"), "last_7_days": ("2024-01-25", "2024-02-01"), "last_30_days": ("2024-01-02", "2024-02-01"), "last_90_days": ("2023-11-03", "2024-02-01"), "past_year": ("2023-02-01", "2024-02-01")}


@query(union_sql(f"SELECT '{p}' AS preset, DATE '{a}' AS start_date, DATE '{b}' AS end_date, round(coalesce(sum(value), 0), 2) AS value, count(*) AS n FROM events WHERE ts >= DATE '{a}' AND ts < DATE '{b}'" for p, (a, b) in PRESETS.items()))
def metric_relative_window(s, d):
    windows = {p: vl.time_window(p, dt.date(2024, 1, 31)) for p in PRESETS}
    row = table(s, d, "events").agg(*[F.struct(F.coalesce(F.sum(F.when(vl.in_range("ts", a, b), F.col("value"))), F.lit(0.0)).alias("v"), F.count_if(vl.in_range("ts", a, b)).alias("n")).alias(p) for p, (a, b) in windows.items()])
    return ds.melt(row, ("preset", "start_date", "end_date", "value", "n"), [(p, F.lit(a), F.lit(b), F.round(F.col(f"{p}.v"), 2), F.col(f"{p}.n")) for p, (a, b) in windows.items()])


@query("SELECT 'received' AS type, round(sum(value - 50), 2) AS total, count(*) AS n FROM events WHERE value - 50 > 0 UNION ALL SELECT 'paid', round(sum(value - 50), 2), count(*) FROM events WHERE value - 50 < 0")
def received_paid_split(s, d):
    return ag.received_paid(event_amounts(s, d), "amount")


@query("SELECT 'rows' AS metric, NULL::VARCHAR AS value, count(c_mktsegment) AS n FROM customer UNION ALL SELECT 'distinct', NULL, count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT * FROM (SELECT 'top', c_mktsegment, count(*) FROM customer GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)")
def categorical_metric(s, d):
    return ag.categorical_metric(table(s, d, "customer"), "c_mktsegment")


# -- descriptive --------------------------------------------------------------

STAT_SQL = {"count": "count({c})::DOUBLE", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})::DOUBLE", "p25": "quantile_cont({c}, 0.25)", "p50": "quantile_cont({c}, 0.5)", "p75": "quantile_cont({c}, 0.75)", "max": "max({c})::DOUBLE"}


def describe_sql(columns, source, digits=4) -> str:
    return union_sql(f"SELECT '{c}' AS \"column\", '{k}' AS stat, round({f.format(c=c)}, {digits}) + 0.0 AS value FROM {source}" for c in columns for k, f in STAT_SQL.items())


@query(describe_sql(LINE_COLUMNS, LINEITEM_SQL))
def describe_numeric(s, d):
    return ds.describe(lineitem_const(s, d))


@query(describe_sql(("p_partkey", "p_size", "p_retailprice"), "part"))
def numeric_profile(s, d):
    return ds.describe(table(s, d, "part"))


def nulls_sql(columns, source) -> str:
    return union_sql(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS pct FROM {source}" for c in columns)


@query(nulls_sql(("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), ORDERS_NULLS_SQL))
def nulls_by_column(s, d):
    return ds.nulls_by_column(orders_nulls(s, d))


@query(nulls_sql(("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), REPEATS_SQL))
def missing_summary(s, d):
    return ds.nulls_by_column(orders_repeats(s, d))


_CELLS = "count(*) * 4 - count(o_orderkey) - count(o_custkey) - count(o_totalprice) - count(o_orderpriority)"


@query(f"SELECT 'null_cells' AS metric, ({_CELLS})::DOUBLE AS value FROM {ORDERS_NULLS_SQL} UNION ALL SELECT 'rows_with_null', count(*)::DOUBLE FROM {ORDERS_NULLS_SQL} WHERE o_totalprice IS NULL OR o_orderpriority IS NULL UNION ALL SELECT 'rows', count(*)::DOUBLE FROM orders UNION ALL SELECT 'pct_of_cells', round(({_CELLS}) * 100.0 / (count(*) * 4), 2)::DOUBLE FROM {ORDERS_NULLS_SQL}")
def nulls_overall(s, d):
    return ds.nulls_overall(orders_nulls(s, d))


def corr_sql(columns, source) -> str:
    return union_sql(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) END AS r FROM {source}" for k, a in enumerate(columns) for b in columns[k + 1 :])


@query(corr_sql(LINE_COLUMNS, LINEITEM_SQL))
def correlation_pairs(s, d):
    return ds.correlation_pairs(lineitem_const(s, d))


@query(f"SELECT *, abs(r) AS abs_r FROM ({corr_sql(LINE_COLUMNS, LINEITEM_SQL)}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, col_a, col_b LIMIT 1")
def strongest_pair(s, d):
    return ds.strongest_pair(lineitem_const(s, d))


@query(union_sql(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def unique_counts(s, d):
    return ds.unique_counts(table(s, d, "orders"))


def categorical_sql(columns, source) -> str:
    return union_sql(f"SELECT * FROM (SELECT '{c}' AS \"column\", count(*) OVER () AS n_categories, {c} AS top_value, count(*) AS top_n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY top_n DESC, top_value LIMIT 1)" for c in columns)


@query(categorical_sql(("p_name", "p_brand", "p_type"), "part"))
def categorical_profile(s, d):
    return ds.categorical_profile(table(s, d, "part"))


@query(f"SELECT * FROM ({categorical_sql(('o_orderstatus', 'o_orderpriority'), 'orders')}) ORDER BY n_categories DESC, \"column\" LIMIT 1")
def most_diverse(s, d):
    return ds.most_diverse(table(s, d, "orders"))


@query(union_sql(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS n_null, round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS pct, count(DISTINCT {c}) AS n_unique FROM {ORDERS_NULLS_SQL}" for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderpriority", "string"))))
def column_profile(s, d):
    return pf.column_profile(orders_nulls(s, d))


@query(union_sql(f"SELECT * FROM (SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM part ORDER BY value LIMIT 5)" for c in ("p_brand", "p_type")))
def column_examples(s, d):
    return pf.examples(table(s, d, "part"), ["p_brand", "p_type"])


_PAIRS = "(SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"


@query(f"SELECT 'rows_in_groups' AS kind, sum(n) FILTER (n > 1)::BIGINT AS n FROM {_PAIRS} UNION ALL SELECT 'repeats', sum(n - 1)::BIGINT FROM {_PAIRS} UNION ALL SELECT 'id_repeats', (count(*) - count(DISTINCT user_id))::BIGINT FROM events")
def duplicate_analysis(s, d):
    return pf.duplicate_analysis(table(s, d, "events").select("user_id", "event_type"))


def quality_sql(form: str) -> str:
    dup = "sum(CASE WHEN n > 1 THEN n ELSE 0 END)" if form == "profile" else "sum(n - 1)"
    share = "sum(m * n) * 100.0 / sum(n)" + ("" if form == "profile" else " / 4")
    return f"SELECT greatest(0, least(100, 100 - floor(round({share} + {dup} * 100.0 / sum(n), 9))))::BIGINT AS score FROM (SELECT count(*) AS n, (o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT AS m FROM {REPEATS_SQL} GROUP BY o_orderkey, o_custkey, o_totalprice, o_orderpriority)"


@query(quality_sql("profile"))
def quality_profile(s, d):
    return pf.quality(orders_repeats(s, d), "profile")


@query(quality_sql("clean"))
def quality_clean(s, d):
    return pf.quality(orders_repeats(s, d), "clean")


@query(f"""SELECT 1 AS priority, NULL::VARCHAR AS "column", 'Remove ' || n || ' repeated rows' AS text FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 = 0) WHERE n > 0
UNION ALL SELECT 3, 'o_totalprice', 'Fill missing values of o_totalprice'""")
def recommendations(s, d):
    return pf.recommendations(orders_repeats(s, d))


@query(f"""SELECT unnest(['rows', 'columns', 'numeric_columns', 'text_columns', 'missing_cells', 'repeated_rows']) AS metric,
unnest([count(*), 4, 3, 1, {_CELLS}, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0)]) AS value FROM {REPEATS_SQL}""")
def overview(s, d):
    return ds.overview(orders_repeats(s, d))


@query(union_sql(f"SELECT '{c}' AS \"column\", '{m}' AS metric, round({f}({c}), 2)::DOUBLE + 0.0 AS value FROM {LINEITEM_SQL}" for c in LINE_COLUMNS for m, f in (("total", "sum"), ("average", "avg"), ("min", "min"), ("max", "max"))))
def key_metrics(s, d):
    return ds.key_metrics(lineitem_const(s, d))


@query(f"SELECT * FROM ({union_sql(f'''SELECT '{c}' AS \"column\", round(sum({c}), 2) AS total FROM {LINEITEM_SQL}''' for c in LINE_COLUMNS)}) ORDER BY total DESC LIMIT 1")
def top_total_column(s, d):
    return ds.top_total_column(lineitem_const(s, d))


@query("SELECT 'o_totalprice' AS \"column\", a AS first_value, b AS last_value, round((b - a) / abs(a) * 100, 2) AS change_pct, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END AS direction, abs(round((b - a) / abs(a) * 100, 2)) > 20 AS strong FROM (SELECT (SELECT o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) AS a, (SELECT o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS b)")
def trend_first_last(s, d):
    return ds.trend_first_last(table(s, d, "orders"), ["o_totalprice"], ["o_orderdate", "o_orderkey"])


# -- anomalies ----------------------------------------------------------------

FENCE_SQL = "(SELECT count(value) AS k, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"
ODD_SQL = "(abs((value - m) / sd) > 3 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"


@query(f"SELECT 'value' AS \"column\", count(*) FILTER ({ODD_SQL}) AS n, count(*) AS total, round(count(*) FILTER ({ODD_SQL}) * 100.0 / count(*), 2)::DOUBLE AS pct, round(any_value(m), 4) AS mean, round(any_value(sd), 4) AS std, round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper FROM events, {FENCE_SQL}")
def anomalies_summary(s, d):
    return an.anomalies_summary(table(s, d, "events"), ["value"])


@query(f"SELECT 'value' AS \"column\", event_id, value FROM events, {FENCE_SQL} WHERE {ODD_SQL} ORDER BY event_id LIMIT 20")
def anomalies_rows(s, d):
    return an.anomalies_rows(table(s, d, "events"), "value", ["event_id"])


def odd_rows_sql(column: str, key: str, source: str) -> str:
    fence = f"(SELECT count({column}) AS k, avg({column}) AS m, stddev_samp({column}) AS sd, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"
    return f"SELECT * FROM (SELECT '{column}' AS \"column\", {key}, {column}::DOUBLE AS value FROM {source}, {fence} WHERE {ODD_SQL.replace('value', column)} ORDER BY {key} LIMIT 20)"


@query(union_sql(odd_rows_sql(c, "event_id", "events") for c in ("user_id", "value")))
def anomalies_all(s, d):
    return an.anomalies_all(table(s, d, "events").drop("props"), ["event_id"])


@query("SELECT event_id, value, round((value - m) / sd, 4) AS z_score FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events) WHERE abs(round((value - m) / sd, 4)) > 2.5")
def txn_anomalies(s, d):
    return an.txn_anomalies(table(s, d, "events").select("event_id", "value"), "value")


@query(union_sql(f"SELECT '{c}' AS \"column\", count(*) FILTER (abs(({c} - m) / nullif(sd, 0)) > 3) AS n FROM part, (SELECT avg({c}) AS m, stddev_samp({c}) AS sd FROM part)" for c in ("p_partkey", "p_size", "p_retailprice")))
def zscore_counts(s, d):
    return an.zscore_counts(table(s, d, "part"))


@query(f"SELECT 'value' AS \"column\", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n FROM events, {FENCE_SQL}")
def iqr_counts(s, d):
    return an.iqr_counts(table(s, d, "events"), ["value"])


# -- cleaning -----------------------------------------------------------------


@query(f"SELECT DISTINCT * FROM {REPEATS_SQL}")
def dedup(s, d):
    return cn.drop_duplicates(orders_repeats(s, d))[0]


MODE_SQL = "(SELECT o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
IMPUTE_SQL = f"SELECT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders WHERE o_orderkey % 7 <> 0)) AS o_totalprice, coalesce(o_orderpriority, {MODE_SQL}) AS o_orderpriority FROM {ORDERS_NULLS_SQL}"


@query(IMPUTE_SQL)
def impute_v1(s, d):
    return cn.impute(orders_nulls(s, d), "v1")[0]


@query(IMPUTE_SQL)
def impute_v2(s, d):
    return cn.impute(orders_nulls(s, d), "v2")[0]


@query(f"SELECT c_custkey, trim(c_name) AS c_name, balance, date FROM {DIRTY_SQL}")
def trim(s, d):
    return cn.trim_text(customer_dirty(s, d))[0]


NUMBER_SQL = "replace(replace(balance, '$', ''), ',', '')::DOUBLE"
DATE_SQL = "try_strptime(date, '%Y/%m/%d')"


@query(f"SELECT c_custkey, c_name, {NUMBER_SQL} AS balance, date FROM {DIRTY_SQL}")
def coerce_numeric(s, d):
    return cn.coerce_numbers(customer_dirty(s, d))[0]


@query(f"SELECT c_custkey, c_name, balance, {DATE_SQL} AS date FROM {DIRTY_SQL}")
def coerce_date(s, d):
    out = cn.coerce_dates(customer_dirty(s, d))[0]
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"SELECT c_custkey, c_name, balance, {DATE_SQL} AS date FROM {DIRTY_SQL}")
def fix_types(s, d):
    return cn.fix_types(customer_dirty(s, d))[0].withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"SELECT c_custkey AS customer_key, c_name AS customer_name, balance AS customer_key_2, date AS date FROM {DIRTY_SQL}")
def std_names(s, d):
    return cl.standardise_names(customer_dirty(s, d).toDF(" Customer Key", "Customer Name ", "customer_key!", "Date"))


@query(f"SELECT DISTINCT c_custkey, trim(c_name) AS c_name, {NUMBER_SQL} AS balance, {DATE_SQL} AS date FROM {DIRTY_SQL}")
def clean_v1(s, d):
    out, _ = cn.clean(customer_dirty(s, d), cn.V1)
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"SELECT DISTINCT * FROM (SELECT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {REPEATS_SQL})) AS o_totalprice, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {REPEATS_SQL} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM {REPEATS_SQL})")
def clean_v2(s, d):
    return cn.clean(orders_repeats(s, d), cn.V2)[0]


@query(f"""SELECT 'impute' AS step, 'o_totalprice' AS "column", 'filled' AS action, count(*) - count(o_totalprice) AS n FROM {REPEATS_SQL}
UNION ALL SELECT 'impute', 'o_orderpriority', 'filled', count(*) - count(o_orderpriority) FROM {REPEATS_SQL}
UNION ALL SELECT 'duplicates', NULL, 'removed', count(*) FROM orders WHERE o_orderkey % 10 = 0""")
def clean_report(s, d):
    return cn.clean(orders_repeats(s, d), (cn.names_step, cn.impute_v2, cn.drop_duplicates, cn.fix_types))[1]


@query(f"SELECT * FROM {ORDERS_NULLS_SQL} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def drop_missing(s, d):
    return cn.drop_missing(orders_nulls(s, d))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN substr(o_orderpriority, 1, 1)::DOUBLE END AS priority, NULL::DOUBLE AS status FROM orders")
def to_numbers(s, d):
    priority = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1))).otherwise("n/a")
    return cn.to_numbers(table(s, d, "orders").select("o_orderkey", priority.alias("priority"), F.col("o_orderstatus").alias("status")), ["priority", "status"])


# -- chart series -------------------------------------------------------------


@query("""WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events),
f AS (SELECT least(floor((value - a) / ((b - a) / 20))::INT + 1, 20) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT bin::INT AS bin, round(a + (bin - 1) * ((b - a) / 20), 6) AS low, round(a + bin * ((b - a) / 20), 6) AS high, coalesce(n, 0) AS n FROM e, (SELECT unnest(range(1, 21))::INT AS bin) LEFT JOIN f USING (bin)""")
def hist20(s, d):
    return ch.histogram(table(s, d, "events"), "value")


@query("SELECT p_size AS x, p_retailprice AS y FROM part ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT 1000")
def scatter(s, d):
    return ch.scatter(table(s, d, "part"), "p_size", "p_retailprice", "p_partkey")


@query("SELECT p_partkey AS x, p_size AS y FROM part ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT 1000")
def chart_auto(s, d):
    return pl.chart(table(s, d, "part"))


@query("SELECT c_nationkey::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def bar15(s, d):
    return ch.bar(table(s, d, "customer"), "c_nationkey")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def line(s, d):
    return ch.line(table(s, d, "orders"), "o_orderdate", "o_totalprice", "month")


@query("SELECT value, n, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS share, round(n * 100.0 / t, 2)::DOUBLE AS share_of_all FROM (SELECT c_nationkey::VARCHAR AS value, count(*) AS n, sum(count(*)) OVER () AS t FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8)")
def pie8(s, d):
    return ch.pie(table(s, d, "customer"), "c_nationkey")


_IN = "value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


@query(f"SELECT unnest(['p25', 'p50', 'p75', 'whisker_low', 'whisker_high', 'fliers']) AS stat, unnest([round(any_value(q1), 4), round(quantile_cont(value, 0.5), 4), round(any_value(q3), 4), min(value) FILTER ({_IN}), max(value) FILTER ({_IN}), count(*) FILTER (NOT ({_IN}))::DOUBLE]) AS value FROM events, {FENCE_SQL}")
def box(s, d):
    return ch.box(table(s, d, "events"), "value")


# -- text and lines -----------------------------------------------------------

WORDS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


@query(rf"""SELECT 'cells' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'words', sum(len({WORDS_SQL}))::BIGINT FROM documents
UNION ALL SELECT 'characters', (sum(length(text)) + count(*) - 1)::BIGINT FROM documents
UNION ALL SELECT 'sentences', sum(len(list_filter(string_split_regex(text, '[.!?]+'), lambda p: regexp_replace(p, '\s', '', 'g') <> '')))::BIGINT FROM documents
UNION ALL SELECT 'distinct_words', count(DISTINCT w)::BIGINT FROM (SELECT lower(unnest({WORDS_SQL})) AS w FROM documents)""")
def text_stats(s, d):
    return tx.text_stats(table(s, d, "documents"), "text")


@query(rf"""WITH p AS (SELECT doc_id, list_transform(string_split_regex(text, '[.!?]+'), lambda p: regexp_replace(p, '\s', '', 'g') <> '') AS b FROM documents),
t AS (SELECT doc_id, len(list_filter(b, lambda x: x)) AS n, b[1] AS lead, CASE WHEN len(b) > 1 OR b[-1] THEN b[-1] END AS tail FROM p),
o AS (SELECT n, lead, coalesce(last_value(tail IGNORE NULLS) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS op FROM t)
SELECT sum(n - (op AND lead)::INT)::BIGINT AS sentences FROM o""")
def sentences_joined(s, d):
    return tx.joined_sentences(table(s, d, "documents"), "text", "doc_id")


@query(f"SELECT * FROM (SELECT w AS word, count(*) AS n FROM (SELECT lower(unnest({WORDS_SQL})) AS w FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) WHERE word NOT IN ({', '.join(repr(w) for w in tx.STOP_WORDS)})")
def common_words(s, d):
    return tx.common_words(table(s, d, "documents"), "text")


@query("SELECT n_nationkey::VARCHAR AS col_0, n_name AS col_1, n_regionkey::VARCHAR AS col_2 FROM nation")
def delimited_split(s, d):
    lines = table(s, d, "nation").select(F.concat_ws(";", "n_nationkey", "n_name", "n_regionkey").alias("text"))
    return rd.split_delimited(lines, "text")


@query("SELECT l_orderkey::VARCHAR AS col_0, l_linenumber::VARCHAR AS col_1, l_returnflag AS col_2, CASE WHEN l_linenumber > 3 THEN l_linestatus END AS col_3 FROM lineitem")
def delimited_split_lineitem(s, d):
    long = F.when(F.col("l_linenumber") > 3, F.col("l_linestatus"))
    lines = table(s, d, "lineitem").select(F.concat_ws(";", "l_orderkey", "l_linenumber", "l_returnflag", long).alias("text"))
    return rd.split_delimited(lines, "text", ";")


@query(r"SELECT doc_id, line_no::INT AS line_no, trim(line, ' ') AS text FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\x0B\x0C\r\x{0085}\x{2028}\x{2029}]')) AS line, generate_subscripts(string_split_regex(text, '\r\n|[\n\x0B\x0C\r\x{0085}\x{2028}\x{2029}]'), 1) - 1 AS line_no FROM documents) WHERE trim(line, ' ') <> ''")
def text_lines(s, d):
    return rd.document_lines(table(s, d, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, page::INT AS page, line_no::INT AS line_no, trim(line, ' ') AS text
FROM (SELECT doc_id, page, unnest(string_split_regex(p, '\r\n|[\n\x0B\x0C\r\x{0085}\x{2028}\x{2029}]')) AS line, generate_subscripts(string_split_regex(p, '\r\n|[\n\x0B\x0C\r\x{0085}\x{2028}\x{2029}]'), 1) - 1 AS line_no
FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(12)), chr(12))) AS p, generate_subscripts(string_split(replace(text, '. ', chr(12)), chr(12)), 1) AS page FROM documents)) WHERE trim(line, ' ') <> ''""")
def text_pages(s, d):
    """Documents whose sentences stand on pages of their own."""
    return rd.page_lines(table(s, d, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit("\f"))), "doc_id", "text")


# -- statements ---------------------------------------------------------------


def statement_lines(s, d) -> DataFrame:
    """Four lines for each event under its user's statement."""
    e = table(s, d, "events")
    sign = F.when(F.col("event_id") % 3 == 0, "+").otherwise("-")
    verb = F.when(F.col("event_id") % 3 == 0, "Received from ").otherwise("Paid to ")
    parts = F.array(
        F.date_format("ts", "dd MMM''yy"), F.concat(F.date_format("ts", "h:mm a"), F.lit(" "), verb, "event_type"),
        F.concat(sign, F.lit(" Rs."), F.format_string("%.2f", "value")), F.concat(F.lit("# "), "event_type"))
    return e.select(F.col("user_id").alias("statement_id"), F.posexplode(parts).alias("k", "text"), "event_id").select("statement_id", (F.col("event_id") * 4 + F.col("k")).alias("line_no"), "text")


@query("""SELECT *, score >= 2 AS is_statement FROM (SELECT user_id AS statement_id, (max((event_id % 3 <> 0)::INT) + max((event_id % 3 = 0)::INT))::INT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth <= 50 GROUP BY 1)""")
def statement_detect(s, d):
    return st.detect_statements(statement_lines(s, d))


@query("SELECT user_id AS statement_id, ts::DATE AS date, strftime(ts, '%-I:%M %p') AS time, CASE WHEN event_id % 3 = 0 THEN 'Received from ' ELSE 'Paid to ' END || event_type AS description, CASE WHEN event_id % 3 = 0 THEN 'received' ELSE 'paid' END AS type, trim(regexp_extract('# ' || event_type, '#\\s*([A-Za-z\\s]+)', 1)) AS category, round(CASE WHEN event_id % 3 = 0 THEN value ELSE -value END, 2) AS amount FROM events".replace("\\\\", "\\"))
def statement_txns(s, d):
    return st.transactions(statement_lines(s, d), 2024)


# -- models -------------------------------------------------------------------

FIT_SQL = "(SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max_by(y, x) AS last FROM (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS x, o_totalprice AS y FROM orders))"


@query(f"SELECT n + i AS period, round(a + b * (n + i - 1), 4) AS forecast FROM {FIT_SQL}, (SELECT unnest(range(1, 6)) AS i)")
def forecast_linear(s, d):
    return md.forecast(table(s, d, "orders"), "o_totalprice", "o_orderdate", "o_orderkey")


@query(f"SELECT unnest(['n', 'slope', 'intercept', 'last_value', 'up', 'change_pct']) AS metric, unnest([n::DOUBLE, round(b, 6), round(a, 4), last, (b > 0)::INT::DOUBLE, round((a + b * (n + 4) - last) / last * 100, 4)]) AS value FROM {FIT_SQL}")
def forecast_stats(s, d):
    return md.forecast_stats(table(s, d, "orders"), "o_totalprice", "o_orderdate", "o_orderkey")


def least_squares_sql(source: str, target: str, features: tuple[str, ...], head: str = "") -> str:
    """Normal equations by elimination, a CTE for each feature; every fifth key ``k`` is held out."""
    n = len(features)
    cell = lambda i, j: f"covar_pop({features[i]}, {features[j] if j < n else target})"
    steps = [f"a0 AS MATERIALIZED (SELECT {', '.join(f'{cell(i, j)} AS a{i}_{j}' for i in range(n) for j in range(n + 1))}, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate((*features, target)))} FROM f WHERE k % 5 <> 0)"]
    for k in range(n):
        made = [f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}" for i in range(n) for j in range(n + 1)]
        steps.append(f"a{k + 1} AS MATERIALIZED (SELECT {', '.join(f'{x} AS a{i // (n + 1)}_{i % (n + 1)}' for i, x in enumerate(made))}, {', '.join(f'm{i}' for i in range(n + 1))} FROM a{k})")
    line = f"(m{n}" + "".join(f" - a{i}_{n} * m{i}" for i in range(n)) + ")"
    short = lambda v: f"round({v}, (6 - floor(log10(abs({v}))))::INT)"
    error = f"({target} - {line}" + "".join(f" - a{i}_{n} * {c}" for i, c in enumerate(features)) + ")"
    coefficients = union_sql(f"SELECT {head}'coefficient_{c}' AS metric, {short(f'a{i}_{n}')} AS value FROM a{n}" for i, c in enumerate(features))
    return f"""WITH f AS MATERIALIZED ({source}), {", ".join(steps)}, s AS (SELECT avg({error} ** 2) AS mse, var_pop({target}) AS v FROM f, a{n} WHERE k % 5 = 0)
SELECT {head}'r2' AS metric, round(1 - mse / v, 6) AS value FROM s UNION ALL SELECT {head}'mse', {short("mse")} FROM s UNION ALL SELECT {head}'intercept', {short(line)} FROM a{n} UNION ALL {coefficients}"""


@query(least_squares_sql("SELECT l_orderkey AS k, * FROM lineitem", "l_extendedprice", ("l_quantity", "l_discount")))
def predict_regression(s, d):
    return md.predict_regression(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_orderkey")


@query()
def predict_classification(s, d):
    return md.predict_classification(table(s, d, "events").select("event_id", "user_id", "event_type", "value"), "event_type", ["value", "user_id"], "event_id")


@query("SELECT unnest(['classes', 'train_rows', 'test_rows']) AS metric, unnest([count(DISTINCT event_type), count(*) FILTER (event_id % 5 <> 0), count(*) FILTER (event_id % 5 = 0)])::DOUBLE AS value FROM events")
def predict_split(s, d):
    """What predict_classification counts besides its accuracy."""
    return md.split_counts(table(s, d, "events"), "event_type", ["value", "user_id"], "event_id")


_CODED = "SELECT l_orderkey AS k, l_orderkey, l_quantity, l_discount, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::DOUBLE AS l_returnflag, l_extendedprice FROM lineitem"


@query(least_squares_sql(_CODED, "l_extendedprice", ("l_orderkey", "l_quantity", "l_discount", "l_returnflag"), "'regression' AS task, 'l_extendedprice' AS target, "))
def predict_auto(s, d):
    return md.predict(table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice"))


# -- compositions -------------------------------------------------------------

_NUMBERS, _FIRST_LAST = ("o_orderkey", "o_custkey", "o_totalprice"), "o_orderdate, o_orderkey"
_METRIC_NAMES = "['rows', 'columns', 'numeric_columns', 'text_columns', 'missing_cells', 'repeated_rows']"
ORDERS_OVERVIEW_SQL = f"(SELECT unnest({_METRIC_NAMES}) AS metric, unnest([count(*), 6, 3, 2, 0, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders))]) AS value FROM orders)"
_ENDS_SQL = union_sql(f"SELECT '{c}' AS c, (SELECT {c} FROM orders ORDER BY {_FIRST_LAST} LIMIT 1)::DOUBLE AS a, (SELECT {c} FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)::DOUBLE AS b" for c in _NUMBERS)
_TOTALS_SQL = union_sql(f"SELECT '{c}' AS c, round(sum({c}), 2)::DOUBLE AS v FROM orders" for c in _NUMBERS)
_ODD_COUNTS_SQL = union_sql(f"SELECT '{c}' AS c, count(*) FILTER (abs(({c} - m) / nullif(sd, 0)) > 3) AS n FROM orders, (SELECT avg({c}) AS m, stddev_samp({c}) AS sd FROM orders)" for c in _NUMBERS)
INSIGHTS_SQL = f"""SELECT 1 AS seq, 'overview' AS kind, NULL::VARCHAR AS "column", metric, value::DOUBLE AS value, metric || ': ' || value AS text FROM {ORDERS_OVERVIEW_SQL}
UNION ALL SELECT * FROM (SELECT 2, 'driver', c, 'total', v, c || ' has the largest total' FROM ({_TOTALS_SQL}) ORDER BY v DESC, c LIMIT 1)
UNION ALL SELECT 3, 'trend', c, 'change_pct', p, c || ' went ' || CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END FROM (SELECT *, round((b - a) / abs(a) * 100, 2) AS p FROM ({_ENDS_SQL})) WHERE abs(p) > 20
UNION ALL SELECT * FROM (SELECT 4, 'correlation', col_a || '~' || col_b, 'r', r, col_a || ' and ' || col_b || ' move together' FROM (SELECT * FROM ({corr_sql(_NUMBERS, "orders")}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, col_a, col_b LIMIT 1) WHERE abs(r) >= 0.5)
UNION ALL SELECT 5, 'anomaly', c, 'outliers', n, c || ' has ' || n || ' outliers' FROM ({_ODD_COUNTS_SQL}) WHERE n > 0
UNION ALL SELECT * FROM (SELECT 6, 'category', "column", 'categories', n_categories, "column" || ' has the most values, ' || top_value || ' leads' FROM ({categorical_sql(("o_orderstatus", "o_orderpriority"), "orders")}) ORDER BY n_categories DESC, "column" LIMIT 1)"""
_KEY_SQL = union_sql(f"SELECT '{c}' AS c, '{m}' AS m, round({f}({c}), 2)::DOUBLE + 0.0 AS v FROM orders" for c in _NUMBERS for m, f in (("total", "sum"), ("average", "avg"), ("min", "min"), ("max", "max")))
REPORT_SQL = f"""SELECT 'overview' AS section, metric AS item, value::DOUBLE AS value FROM {ORDERS_OVERVIEW_SQL}
UNION ALL SELECT 'key_metrics', c || '.' || m, v FROM ({_KEY_SQL})
UNION ALL SELECT 'insights', concat_ws('.', kind, "column", metric), value FROM ({INSIGHTS_SQL}) WHERE seq > 1"""


@query(INSIGHTS_SQL)
def insights(s, d):
    return ins.insights(table(s, d, "orders"), ["o_orderdate", "o_orderkey"])


@query(REPORT_SQL)
def report(s, d):
    return ins.report(table(s, d, "orders"), ["o_orderdate", "o_orderkey"])


@query("""SELECT 'rows' AS item, NULL::VARCHAR AS "column", count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'missing_cells', NULL, 0 UNION ALL
SELECT * FROM (SELECT 'top_total', c, v FROM (SELECT 'o_orderkey' AS c, round(sum(o_orderkey), 2)::DOUBLE AS v FROM orders UNION ALL SELECT 'o_custkey', round(sum(o_custkey), 2)::DOUBLE FROM orders UNION ALL SELECT 'o_totalprice', round(sum(o_totalprice), 2) FROM orders) ORDER BY v DESC LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'strongest_pair', a || '~' || b, round(r, 6) FROM (SELECT 'o_orderkey' AS a, 'o_custkey' AS b, corr(o_orderkey, o_custkey) AS r FROM orders UNION ALL SELECT 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice) FROM orders UNION ALL SELECT 'o_custkey', 'o_totalprice', corr(o_custkey, o_totalprice) FROM orders) ORDER BY abs(r) DESC LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'most_diverse', c, n FROM (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus)::DOUBLE AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders) ORDER BY n DESC, c LIMIT 1)""")
def summary_insights(s, d):
    return ins.summary_insights(table(s, d, "orders"))


_COLUMNS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderpriority", "string"))
_REPEAT_NAMES = [c for c, _ in _COLUMNS]


def entries_sql(section: str, source: str, item: str = "NULL::VARCHAR", metric: str = "metric", value: str = "NULL::DOUBLE", text: str = "NULL::VARCHAR") -> str:
    return f"SELECT '{section}' AS section, {item} AS item, {metric} AS metric, ({value})::DOUBLE AS value, {text} AS text FROM ({source})"


def cells_sql(section: str, n: int, source: str) -> str:
    rows = f"SELECT *, row_number() OVER (ORDER BY o_orderkey, o_custkey) AS r FROM {source} ORDER BY o_orderkey, o_custkey LIMIT {n}"
    return union_sql(f"SELECT '{section}', r::VARCHAR, '{c}', NULL::DOUBLE, {c}::VARCHAR FROM ({rows})" for c in _REPEAT_NAMES)


def categories_sql(section: str, source: str) -> str:
    top = categorical_sql(("o_orderpriority",), source)
    return union_sql((entries_sql(section, top, '"column"', "'unique'", "n_categories"), entries_sql(section, top, '"column"', "'top'", "top_n", "top_value")))


_PROFILE_SQL = union_sql(f"SELECT '{c}' AS c, '{t}' AS t, count(*) - count({c}) AS n_null, round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS pct, count(DISTINCT {c}) AS n_unique FROM {REPEATS_SQL}" for c, t in _COLUMNS)
_GROUPS_SQL = f"(SELECT count(*) AS n FROM {REPEATS_SQL} GROUP BY o_orderkey, o_custkey, o_totalprice, o_orderpriority)"
_CLEAN_FENCE = union_sql(f"SELECT '{c}' AS c, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n FROM ({ORACLES['clean_v2']}), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({ORACLES['clean_v2']}))" for c in _REPEAT_NAMES[:3])


@query(union_sql((
    entries_sql("shape", f"SELECT unnest(['rows', 'columns']) AS metric, unnest([count(*), 4]) AS value FROM {REPEATS_SQL}", value="value"),
    entries_sql("dtypes", union_sql(f"SELECT '{c}' AS c, '{t}' AS t" for c, t in _COLUMNS), "c", "'dtype'", text="t"),
    entries_sql("nulls", _PROFILE_SQL, "c", "'n_null'", "n_null"), cells_sql("head", 10, REPEATS_SQL),
    entries_sql("describe", describe_sql(_REPEAT_NAMES[:3], REPEATS_SQL), '"column"', "stat", "value"), categories_sql("describe", REPEATS_SQL))))
def summary(s, d):
    return pl.summary(orders_repeats(s, d), ["o_orderkey", "o_custkey"])


@query(union_sql((
    entries_sql("overview", ORACLES["overview"], value="value"), *[entries_sql("columns", _PROFILE_SQL, "c", f"'{m}'", m, "t") for m in ("n_null", "pct", "n_unique")],
    entries_sql("duplicates", f"SELECT sum(n) FILTER (n > 1) AS g, sum(n - 1) AS p FROM {_GROUPS_SQL}", metric="'rows_in_groups'", value="coalesce(g, 0)"),
    entries_sql("duplicates", f"SELECT sum(n - 1) AS p FROM {_GROUPS_SQL}", metric="'repeats'", value="p"),
    entries_sql("quality", ORACLES["quality_clean"], metric="'before'", value="score"),
    entries_sql("quality", ORACLES["quality_clean"].replace(REPEATS_SQL, f"({ORACLES['clean_v2']})"), metric="'after'", value="score"),
    entries_sql("cleaning", ORACLES["clean_report"], '"column"', "step || '.' || action", "n"), entries_sql("cleaning", f"SELECT * FROM ({_CLEAN_FENCE}) WHERE n > 0", "c", "'outliers.flagged'", "n"),
    entries_sql("recommendations", ORACLES["recommendations"], '"column"', "'priority'", "priority", "text"), cells_sql("preview", 20, REPEATS_SQL),
    entries_sql("numeric", describe_sql(_REPEAT_NAMES[:3], REPEATS_SQL), '"column"', "stat", "value"), categories_sql("categorical", REPEATS_SQL))))
def upload_profile(s, d):
    return pl.upload_profile(orders_repeats(s, d), ["o_orderkey", "o_custkey"])


_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
_FIRST_ORDERS = "(SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10)"
_ORDER_TOPS = categorical_sql(("o_orderstatus", "o_orderpriority"), "orders")


def _step_sql(step: str, parts) -> str:
    return f"SELECT '{step}' AS step, * FROM ({union_sql(parts)})"


@query(union_sql((
    _step_sql("clean_report", (
        entries_sql("duplicates", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 = 0", metric="'removed'", value="n") + " WHERE n > 0",
        entries_sql("outliers", f"SELECT * FROM ({_ODD_COUNTS_SQL}) WHERE n > 0", "c", "'flagged'", "n"))),
    _step_sql("summary", (
        entries_sql("shape", "SELECT unnest(['rows', 'columns']) AS metric, unnest([count(*), 6]) AS value FROM orders", value="value"),
        entries_sql("dtypes", union_sql(f"SELECT '{c}' AS c, '{t}' AS t" for c, t in _ORDER_TYPES.items()), "c", "'dtype'", text="t"),
        entries_sql("nulls", union_sql(f"SELECT '{c}' AS c, 0 AS n" for c in _ORDER_TYPES), "c", "'n_null'", "n"),
        union_sql(f"SELECT 'head', r::VARCHAR, '{c}', NULL::DOUBLE, {c}::VARCHAR FROM {_FIRST_ORDERS}" for c in _ORDER_TYPES),
        entries_sql("describe", describe_sql(_NUMBERS, "orders"), '"column"', "stat", "value"), entries_sql("describe", _ORDER_TOPS, '"column"', "'unique'", "n_categories"),
        entries_sql("describe", _ORDER_TOPS, '"column"', "'top'", "top_n", "top_value"))),
    f"SELECT 'insights', kind, \"column\", metric, value, text FROM ({INSIGHTS_SQL})")))
def pipeline_steps(s, d):
    """The default chain (clean, summary, insights) over orders of which a tenth is repeated."""
    orders = table(s, d, "orders")
    return pl.steps_report(pl.run(orders.unionByName(orders.where("o_orderkey % 10 = 0"))))


@query("SELECT table_name, metric, value FROM (SELECT 'region' AS table_name, unnest(['rows', 'columns', 'numeric_columns', 'text_columns', 'missing_cells', 'repeated_rows']) AS metric, unnest([count(*), 2, 1, 1, 0, 0]) AS value FROM region UNION ALL SELECT 'nation', unnest(['rows', 'columns', 'numeric_columns', 'text_columns', 'missing_cells', 'repeated_rows']), unnest([count(*), 3, 2, 1, 0, 0]) FROM nation)")
def tables_overview(s, d):
    return pl.over_tables(rd.read_tables(s, d, ["region", "nation"]), ds.overview)


_METRICS = "unnest(['rows', 'columns', 'numeric_columns', 'text_columns', 'missing_cells', 'repeated_rows'])"


def _overview_sql(name: str, columns: int, numeric: int, text: int) -> str:
    return f"SELECT '{name}' AS table_name, {_METRICS} AS metric, unnest([count(*), {columns}, {numeric}, {text}, 0, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name}))]) AS value FROM {name}"


@query(f"{_overview_sql('orders', 6, 3, 2)} UNION ALL {_overview_sql('customer', 5, 3, 2)} UNION ALL {_overview_sql('events', 6, 3, 2)}")
def tables_overview_large(s, d):
    return pl.over_tables(rd.read_tables(s, d, ["orders", "customer", "events"]), ds.overview)
