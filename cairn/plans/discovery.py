"""Queries of segments, series, forecasts with intervals, retention, quality findings and associations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import t_series
from ..operators import association as asc
from ..operators import findings as fd
from ..operators import models as md
from ..operators import retention as rt
from ..operators import segments as sg
from ..operators import series as sr
from .base import query, table, union_sql

# -- segments -----------------------------------------------------------------

BUYER_FEATURES = ("orders", "spent", "idle_days")
BUYERS_SQL = "SELECT o_custkey AS custkey, count(*)::DOUBLE AS orders, sum(o_totalprice) AS spent, date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-01')::DOUBLE AS idle_days FROM orders GROUP BY 1"


def buyers(s, d) -> DataFrame:
    """How often, how much and how recently each customer ordered."""
    idle = F.date_diff(F.lit("2001-08-01").cast("date"), F.max("o_orderdate").cast("date")).cast("double")
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("spent"), idle.alias("idle_days"))


def segments_sql(source: str, key: str, features: tuple[str, ...], k: int) -> str:
    """CTEs up to ``owned`` (key, features, x1, ..., segment, d) and ``centre``: scaling, seeding, the choice among candidates, and a CTE for each round."""
    n = range(1, len(features) + 1)
    xs = ", ".join(f"x{j}" for j in n)
    own = lambda a: ", ".join(f"{a}.x{j}" for j in n)
    far = " + ".join(f"(a.x{j} - b.x{j}) * (a.x{j} - b.x{j})" for j in n)
    parts = [
        f"f AS MATERIALIZED ({source})",
        "st AS (SELECT " + ", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in zip(n, features, strict=True)) + " FROM f)",
        f"x AS MATERIALIZED (SELECT f.*, {key}::VARCHAR AS k, " + ", ".join(f"coalesce(({c} - m{j}) / nullif(s{j}, 0), 0) AS x{j}" for j, c in zip(n, features, strict=True)) + " FROM f, st)",
        f"c0 AS MATERIALIZED (SELECT {xs} FROM x ORDER BY md5('0:' || k), k LIMIT 1)",
    ]
    for r in range(1, sg.SEEDING + 1):
        parts += [
            f"d{r} AS MATERIALIZED (SELECT a.k, {own('a')}, min({far}) AS d FROM x a, c{r - 1} b GROUP BY ALL)",
            f"c{r} AS MATERIALIZED (SELECT {xs} FROM c{r - 1} UNION SELECT {xs} FROM d{r}, (SELECT sum(d) AS phi FROM d{r}) WHERE ('0x' || substr(md5('{r}:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE * phi < {sg.PER_SEGMENT * k} * d)",
        ]
    parts += [
        f"cand AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {xs}) AS i, {xs} FROM c{sg.SEEDING})",
        f"w AS MATERIALIZED (SELECT i, count(*) AS w FROM (SELECT arg_min(b.i, {far}) AS i FROM x a, cand b GROUP BY a.k) GROUP BY 1)",
        f"g1 AS MATERIALIZED (SELECT 1 AS o, i, {xs} FROM cand JOIN w USING (i) ORDER BY w DESC, i LIMIT 1)",
    ]
    for r in range(2, k + 1):
        parts.append(f"g{r} AS MATERIALIZED (SELECT * FROM g{r - 1} UNION ALL SELECT * FROM (SELECT {r} AS o, a.i, {own('a')} FROM cand a JOIN w USING (i), g{r - 1} b GROUP BY a.i, w, {own('a')} ORDER BY w * min({far}) DESC, a.i LIMIT 1))")
    parts.append(f"l0 AS MATERIALIZED (SELECT o, {xs} FROM g{k})")
    nearest = f"SELECT a.k, {own('a')}, arg_min(b.o, {far}) AS o FROM x a, {{}} b GROUP BY ALL"
    for r in range(1, sg.ROUNDS + 1):
        parts.append(f"l{r} AS MATERIALIZED (SELECT b.o, " + ", ".join(f"coalesce(m{j}, b.x{j}) AS x{j}" for j in n) + f" FROM l{r - 1} b LEFT JOIN (SELECT o, " + ", ".join(f"avg(x{j}) AS m{j}" for j in n) + f" FROM ({nearest.format(f'l{r - 1}')}) GROUP BY o) USING (o))")
    last = sg.ROUNDS
    parts += [
        f"size AS (SELECT o, count(*) AS c FROM ({nearest.format(f'l{last - 1}')}) GROUP BY o)",
        f"centre AS MATERIALIZED (SELECT row_number() OVER (ORDER BY coalesce(c, 0) DESC, {xs}) - 1 AS o, {xs} FROM l{last} LEFT JOIN size USING (o))",
        f"owned AS MATERIALIZED (SELECT x.*, o AS segment, d FROM x JOIN (SELECT a.k, arg_min(b.o, {far}) AS o, min({far}) AS d FROM x a, centre b GROUP BY a.k) USING (k))",
    ]
    return "WITH " + ",\n".join(parts)


_FIT = segments_sql(BUYERS_SQL, "custkey", BUYER_FEATURES, 4)
_TOP = "greatest(" + ", ".join(f"abs(x{j})" for j in (1, 2, 3)) + ")"


@query(f"""{_FIT}, p AS (SELECT segment, count(*) AS n, {", ".join(f"avg({c}) AS v{j}, avg(x{j}) AS x{j}" for j, c in enumerate(BUYER_FEATURES, 1))} FROM owned GROUP BY segment)
{union_sql(f"SELECT segment::INT AS segment, n, round(n * 100.0 / sum(n) OVER (), 2)::DOUBLE AS share, '{c}' AS feature, round(v{j}, 4) AS mean, round(m{j}, 4) AS overall, round(x{j}, 4) + 0.0 AS lift, abs(x{j}) = {_TOP} AS main FROM p, st" for j, c in enumerate(BUYER_FEATURES, 1))}""")
def segments(s, d):
    return sg.segments(buyers(s, d), "custkey", BUYER_FEATURES, k=4)


@query(f"{_FIT} SELECT custkey, segment::INT AS segment, round(sqrt(d), 6) AS distance FROM owned")
def segment_rows(s, d):
    rows = buyers(s, d)
    model = sg.fit_segments(rows, "custkey", BUYER_FEATURES, k=4)
    return sg.assign_segments(rows, model).select("custkey", "segment", F.round("distance", 6).alias("distance"))


_PAIR = " + ".join(f"(a.x{j} - b.x{j}) ** 2" for j in (1, 2, 3))


@query(f"""{_FIT}, far AS (SELECT a.k, a.segment, b.segment AS other, sum({_PAIR}) AS s, count(*) AS n FROM owned a, owned b GROUP BY ALL),
ab AS (SELECT k, segment, max(CASE WHEN other = segment THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> segment THEN s / n END) AS b FROM far GROUP BY ALL),
sil AS (SELECT segment, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS v FROM ab)
SELECT segment::INT AS segment, count(*) AS n, round(avg(v), 4) AS silhouette FROM sil GROUP BY 1 UNION ALL SELECT NULL, count(*), round(avg(v), 4) FROM sil""")
def segment_quality(s, d):
    """The SQL compares all pairs of rows; the library doesn't."""
    rows = buyers(s, d)
    return sg.segment_quality(rows, sg.fit_segments(rows, "custkey", BUYER_FEATURES, k=4))


# -- forecasts with intervals -------------------------------------------------


def t_sql(level: float, dof: str) -> str:
    """The quantile's series; the tables have more rows than it needs to be exact to the digits shown."""
    return "(" + " + ".join(f"{c!r}::DOUBLE / pow({dof}, {k})" for k, c in enumerate(t_series(level))) + ")"


_LINE = "(SELECT count(*)::DOUBLE AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS rss FROM {})"
_PLACES = "(SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS x, o_totalprice AS y FROM orders)"


@query(f"""SELECT (n + i)::BIGINT AS period, round(y, 4) AS forecast, round(y - w, 4) AS low, round(y + w, 4) AS high
FROM (SELECT n, i, a + b * (n + i - 1) AS y, {t_sql(0.95, "(n - 2)")} * sqrt(rss / (n - 2)) * sqrt(1 + 1 / n + (n + i - 1 - mx) ** 2 / sxx) AS w FROM {_LINE.format(_PLACES)}, (SELECT unnest(range(1, 6)) AS i))""")
def forecast_interval(s, d):
    return md.forecast_interval(table(s, d, "orders"), "o_totalprice", "o_orderdate", "o_orderkey")


def series_sql(table_name: str, date: str, value: str, period: str) -> str:
    """(t, period, value, n) with gaps filled."""
    return f"""(SELECT row_number() OVER (ORDER BY period) - 1 AS t, period, coalesce(v, 0) AS value, coalesce(c, 0) AS n
  FROM (SELECT unnest(generate_series(min(date_trunc('{period}', {date})), max(date_trunc('{period}', {date})), INTERVAL 1 {period}))::DATE AS period FROM {table_name})
  LEFT JOIN (SELECT date_trunc('{period}', {date})::DATE AS period, sum({value})::DOUBLE AS v, count(*) AS c FROM {table_name} GROUP BY 1) USING (period))"""


MONTHS, DAYS = series_sql("orders", "o_orderdate", "o_totalprice", "month"), series_sql("events", "ts", "value", "day")


def residuals_sql(rows: str) -> str:
    return f"(SELECT t, period, value, value - mv - b * (t - mt) AS e FROM {rows}, (SELECT regr_slope(value, t) AS b, avg(t) AS mt, avg(value) AS mv FROM {rows}))"


#: Means of each calendar month, and the slope that all months have in common.
_SEASONS = f"""e AS MATERIALIZED {MONTHS}, g AS (SELECT t % 12 AS p, avg(t) AS mt, avg(value) AS mv, count(*) AS k, regr_sxx(value, t) AS sxx, regr_sxy(value, t) AS sxy, regr_syy(value, t) AS syy FROM e GROUP BY 1),
l AS (SELECT sum(sxy) / sum(sxx) AS b, sum(sxx) AS sxx, sum(syy) - sum(sxy) ** 2 / sum(sxx) AS rss, sum(k) - count(*) - 1 AS dof FROM g)"""


@query(f"""WITH {_SEASONS}, a AS (SELECT *, last + i AS x FROM l, (SELECT max(t) AS last, max(period) AS stop FROM e), (SELECT unnest(range(1, 7)) AS i))
SELECT (stop + to_months(i::INT))::DATE AS period, round(y, 4) AS forecast, round(y - w, 4) AS low, round(y + w, 4) AS high
FROM (SELECT *, mv + b * (x - mt) AS y, {t_sql(0.9, "dof")} * sqrt(rss / dof) * sqrt(1 + 1.0 / k + (x - mt) ** 2 / a.sxx) AS w FROM a JOIN g ON p = x % 12)""")
def forecast_series(s, d):
    """Monthly totals with effects of the calendar month, 90 percent intervals; the SQL has more than 30 degrees of freedom."""
    return sr.forecast_series(table(s, d, "orders"), "o_orderdate", "o_totalprice", level=0.9, cycle=12)


# -- series -------------------------------------------------------------------


def growth_sql(rows: str, cycle: int) -> str:
    rate = lambda was: f"round((value - {was}) / nullif(abs({was}), 0) * 100, 2)"
    return f"""SELECT period, round(value, 2) AS value, n, round(p, 2) AS previous, round(value - p, 2) AS change, {rate("p")} AS growth_pct, round(y, 2) AS cycle_ago, {rate("y")} AS cycle_growth_pct, round(s, 2) AS total_to_date
FROM (SELECT *, lag(value) OVER w AS p, lag(value, {cycle}) OVER w AS y, sum(value) OVER w AS s FROM {rows} WINDOW w AS (ORDER BY t))"""


@query(growth_sql(MONTHS, 12))
def monthly_growth(s, d):
    return sr.growth(table(s, d, "orders"), "o_orderdate", "o_totalprice")


_GAPPY = "(SELECT * FROM events WHERE event_type = 'error' AND user_id % 5 = 0)"


@query(growth_sql(series_sql(_GAPPY, "ts", "value", "day"), 7))
def daily_growth(s, d):
    """Days of one kind of event and a fifth of the users: gaps are filled."""
    return sr.growth(table(s, d, "events").where("event_type = 'error' and user_id % 5 = 0"), "ts", "value", period="day")


def seasonality_sql(rows: str, most: int) -> str:
    return f"""WITH e AS MATERIALIZED {residuals_sql(rows)}, al AS (SELECT e.*, lag FROM e, (SELECT unnest(range(1, {most + 1})) AS lag)),
w AS (SELECT count(*) AS n, sum(e * e) AS ss FROM e), c AS (SELECT a.lag, count(*) AS pairs, sum(a.e * b.e) AS c FROM al a JOIN e b ON b.t = a.t + a.lag GROUP BY 1),
m AS (SELECT lag, count(*) AS groups, sum(k * m * m) AS between FROM (SELECT lag, t % lag AS p, count(*) AS k, avg(e) AS m FROM al GROUP BY ALL) GROUP BY 1),
r AS (SELECT lag, pairs, round(c / ss, 6) AS autocorrelation, round(greatest(0, 1 - (ss - between) / (n - groups) * (n - 1) / ss), 6) AS strength, n FROM c JOIN m USING (lag), w WHERE n >= 2 * lag),
q AS (SELECT *, lag >= 2 AND autocorrelation > 2 / sqrt(n) AND strength > 0 AS ok FROM r)
SELECT lag::INT AS lag, pairs, autocorrelation, strength, ok AND row_number() OVER (ORDER BY ok DESC, autocorrelation DESC, lag) = 1 AS best FROM q"""


@query(seasonality_sql(MONTHS, 24))
def seasonality(s, d):
    return sr.seasonality(table(s, d, "orders"), "o_orderdate", "o_totalprice")


@query(seasonality_sql(DAYS, 14))
def seasonality_daily(s, d):
    return sr.seasonality(table(s, d, "events"), "ts", "value", period="day")


@query(f"""WITH {_SEASONS}, m AS (SELECT avg(t) AS t, avg(value) AS v FROM e) SELECT p::INT AS phase, k AS n, round(mv, 4) AS mean, round(f, 4) AS effect, round(f * 100 / abs(v), 4) AS effect_pct
FROM (SELECT *, mv - v - b * (mt - t) AS f FROM g, l, m)""")
def seasonal_effects(s, d):
    return sr.seasonal_effects(table(s, d, "orders"), "o_orderdate", "o_totalprice")


# -- retention ----------------------------------------------------------------


def retention_sql(source: str, user: str, date: str, period: str, apart: str) -> str:
    """(cohort, offset, users, cohort_size, rate); ``apart`` counts the periods from {a} to {b}."""
    return f"""(WITH v AS (SELECT DISTINCT {user} AS u, date_trunc('{period}', {date})::DATE AS p FROM {source}), c AS (SELECT u, p, min(p) OVER (PARTITION BY u) AS cohort FROM v),
n AS (SELECT cohort, {apart.format(a="cohort", b="p")} AS k, count(*) AS users FROM c GROUP BY ALL), z AS (SELECT cohort, users AS cohort_size FROM n WHERE k = 0),
f AS (SELECT cohort, cohort_size, unnest(range(0, 1 + {apart.format(a="cohort", b="(SELECT max(p) FROM v)")})) AS k FROM z)
SELECT cohort, k::INT AS "offset", coalesce(users, 0) AS users, cohort_size, round(coalesce(users, 0) * 100.0 / cohort_size, 2)::DOUBLE AS rate FROM f LEFT JOIN n USING (cohort, k))"""


_WEEKS, _QUARTERS = "date_diff('day', {a}, {b}) // 7", "date_diff('quarter', {a}, {b})"


@query(f"SELECT * FROM {retention_sql('events', 'user_id', 'ts', 'week', _WEEKS)}")
def retention(s, d):
    return rt.retention(table(s, d, "events"), "user_id", "ts")


@query(f"SELECT * FROM {retention_sql('orders', 'o_custkey', 'o_orderdate', 'quarter', _QUARTERS)}")
def retention_quarterly(s, d):
    return rt.retention(table(s, d, "orders"), "o_custkey", "o_orderdate", period="quarter")


@query(f"""SELECT cohort, cohort_size, {", ".join(f'max(rate) FILTER ("offset" = {k}) AS p{k}' for k in range(5))} FROM {retention_sql("orders", "o_custkey", "o_orderdate", "quarter", _QUARTERS)} GROUP BY 1, 2""")
def retention_triangle(s, d):
    return rt.retention_triangle(table(s, d, "orders"), "o_custkey", "o_orderdate", period="quarter")


@query("""WITH v AS (SELECT DISTINCT o_custkey AS u, date_trunc('quarter', o_orderdate)::DATE AS p FROM orders),
g AS (SELECT u, p, lag(p) OVER w AS was, lead(p) OVER w AS next FROM v WINDOW w AS (PARTITION BY u ORDER BY p)),
a AS (SELECT p AS period, count(*) AS active, count(*) FILTER (was IS NULL) AS new, count(*) FILTER (date_diff('quarter', was, p) = 1) AS retained, count(*) FILTER (date_diff('quarter', was, p) > 1) AS returned FROM g GROUP BY 1),
l AS (SELECT (p + INTERVAL 3 MONTH)::DATE AS period, count(*) AS lost FROM g WHERE p < (SELECT max(p) FROM v) AND (next IS NULL OR date_diff('quarter', p, next) > 1) GROUP BY 1)
SELECT period, coalesce(active, 0) AS active, coalesce(new, 0) AS new, coalesce(retained, 0) AS retained, coalesce(returned, 0) AS returned, coalesce(lost, 0) AS lost FROM a FULL JOIN l USING (period)""")
def activity(s, d):
    return rt.activity(table(s, d, "orders"), "o_custkey", "o_orderdate", period="quarter")


# -- findings -----------------------------------------------------------------

_FLAWED = """SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 1 THEN -o_totalprice WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS total_price, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'n/a so far'
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shipped, CASE WHEN o_orderkey % 5 = 0 THEN ' ' || o_orderpriority WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE o_orderpriority END AS priority, 'EUR' AS currency,
  '$' || o_custkey AS customer, 'order ' || o_orderkey AS label, NULL::VARCHAR AS remark, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS ordered FROM orders"""
FLAWED_SQL = f"(SELECT * FROM ({_FLAWED}) UNION ALL SELECT * FROM ({_FLAWED}) WHERE o_orderkey % 10 = 0)"


def flawed_orders(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(
        k, F.when(k % 40 == 1, -F.col("o_totalprice")).when(k % 3 > 0, F.col("o_totalprice")).alias("total_price"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "n/a so far").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shipped"),
        F.when(k % 5 == 0, F.concat(F.lit(" "), "o_orderpriority")).when(k % 13 == 0, "N/A").otherwise(F.col("o_orderpriority")).alias("priority"), F.lit("EUR").alias("currency"),
        F.concat(F.lit("$"), "o_custkey").alias("customer"), F.concat(F.lit("order "), "o_orderkey").alias("label"), F.lit(None).cast("string").alias("remark"),
        F.when(k % 3 != 0, F.col("o_orderdate")).alias("ordered"))
    return rows.unionByName(rows.where("o_orderkey % 10 = 0"))


def finding_sql(severity: str, kind: str, column: str | None, n: str, of: str, text: str, where: str = "n > 0") -> str:
    """``text`` has {n}; percentages are of ``of``."""
    name = f"'{column}'" if column else "NULL::VARCHAR"
    words = "'" + text.replace("{n}", "' || n || '") + "'"
    return f"SELECT {fd.SEVERITIES.index(severity) + 1}::INT AS priority, '{severity}' AS severity, '{kind}' AS kind, {name} AS \"column\", n, round(n * 100.0::DOUBLE / m, 2) AS pct, {words} AS text FROM (SELECT {n} AS n, {of} AS m FROM f) WHERE {where}"


def missing_sql(column: str) -> str:
    cells = (f"count(*) - count({column})", "count(*)", f"{column} has {{n}} missing cells")
    return union_sql((
        finding_sql("critical", "missing", column, *cells, "n >= 0.5 * m"), finding_sql("warning", "missing", column, *cells, "n >= 0.2 * m AND n < 0.5 * m"),
        finding_sql("informational", "missing", column, *cells, "n > 0 AND n < 0.2 * m")))


_REPEATS = f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {FLAWED_SQL})) AS n, count(*) AS m FROM f"


@query(f"""WITH f AS MATERIALIZED {FLAWED_SQL} {union_sql((
    *[missing_sql(c) for c in ("total_price", "shipped", "ordered")], finding_sql("critical", "empty_column", "remark", "count(*)", "count(*)", "remark has no values"),
    finding_sql("critical", "negative", "total_price", "count(*) FILTER (total_price < 0)", "count(total_price)", "total_price has {n} negative values"),
    finding_sql("warning", "constant", "currency", "count(*)", "count(*)", "currency has one value"),
    finding_sql("warning", "invalid_date", "shipped", "count(*) FILTER (shipped LIKE 'n/a%')", "count(shipped)", "shipped has {n} texts that are no dates"),
    finding_sql("warning", "placeholder", "priority", "count(*) FILTER (trim(priority) = 'N/A')", "count(*)", "priority has {n} texts that stand for a missing cell"),
    finding_sql("informational", "outer_blanks", "priority", "count(*) FILTER (priority <> trim(priority))", "count(*)", "priority has {n} texts with outer blanks"),
    finding_sql("warning", "numbers_as_text", "customer", "count(*)", "count(*)", "customer keeps numbers as text"),
    finding_sql("informational", "high_cardinality", "label", "count(DISTINCT label)", "count(*)", "label has {n} different texts"),
    finding_sql("warning", "repeated_rows", None, "n", "m", "{n} rows repeat others").replace("FROM f)", f"FROM ({_REPEATS}))"),
))}""")
def quality_issues(s, d):
    return fd.quality_issues(flawed_orders(s, d))


# -- associations -------------------------------------------------------------


def linked_parts(s, d) -> DataFrame:
    """Parts with two texts, two numbers and a date that depend on each other to a degree."""
    size = F.col("p_size")
    return table(s, d, "part").select(
        F.when(size > 25, "large").otherwise("small").alias("class"), "p_brand", "p_size", "p_retailprice",
        F.date_add(F.lit("2024-01-01").cast("date"), (size * 7 + F.col("p_partkey") % 30).cast("int")).alias("added"))


PARTS_SQL = "(SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS class, p_brand, p_size, p_retailprice, epoch(DATE '2024-01-01' + (p_size * 7 + p_partkey % 30)::INT) AS added FROM part)"
_NUMBERS, _TEXTS = ("p_size", "p_retailprice", "added"), ("class", "p_brand")


def associations_sql() -> str:
    pearson = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, 'pearson' AS measure, round(corr({a}, {b}), 6) AS association FROM f" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]
    a, b = _TEXTS
    v = f"""SELECT '{a}', '{b}', 'cramers_v', round(sqrt(greatest(0, (sum(n * n / (r * c)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6)
FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM f GROUP BY ALL))"""
    ratio = [f"SELECT '{t}', '{x}', 'correlation_ratio', round(sqrt(sum(n * (m - mm) ** 2) / (sum(n * (m - mm) ** 2) + sum(n * s))), 6) FROM (SELECT avg({x}) AS m, count(*) AS n, var_pop({x}) AS s FROM f GROUP BY {t}), (SELECT avg({x}) AS mm FROM f)" for t in _TEXTS for x in _NUMBERS]
    return f"f AS MATERIALIZED {PARTS_SQL}, found AS ({union_sql((*pearson, v, *ratio))})"


@query(f"""WITH {associations_sql()} SELECT col_a AS x, col_b AS y, measure, association FROM found UNION ALL SELECT col_b, col_a, measure, association FROM found
UNION ALL SELECT unnest(['class', 'p_brand', 'p_size', 'p_retailprice', 'added']), unnest(['class', 'p_brand', 'p_size', 'p_retailprice', 'added']), 'same', 1.0""")
def heatmap(s, d):
    return asc.heatmap(linked_parts(s, d))


def score_sql(kind: str, strength: str) -> str:
    low, more = asc.RULES[kind]
    return f"{low} + {more}::DOUBLE * least(1, greatest(0, {strength}))"


@query(f"""WITH {associations_sql()}, n AS (SELECT * FROM found WHERE measure = 'pearson' AND 'added' NOT IN (col_a, col_b)), k AS ({union_sql(f"SELECT '{t}' AS c, count(DISTINCT {t}) AS k FROM f" for t in _TEXTS)}),
s AS (SELECT 'pie' AS chart, c AS x, NULL::VARCHAR AS y, {score_sql("pie", "(8 - k) / 6.0")} AS score FROM k WHERE k BETWEEN 2 AND 8
UNION ALL SELECT 'bar', col_a, col_b, ({score_sql("bar", "association")}) * CASE WHEN k BETWEEN 2 AND 50 THEN 1 ELSE 0.5 END FROM found JOIN k ON c = col_a WHERE measure = 'correlation_ratio' AND col_b <> 'added'
UNION ALL SELECT 'scatter', col_a, col_b, {score_sql("scatter", "abs(association)")} FROM n
UNION ALL SELECT 'line', 'added', CASE WHEN col_a = 'added' THEN col_b ELSE col_a END, {score_sql("line", "abs(association)")} FROM found WHERE measure = 'pearson' AND 'added' IN (col_a, col_b)
UNION ALL {union_sql(f"SELECT 'histogram', '{c}', NULL, {score_sql('histogram', f'abs(sum(({c} - m) ** 3) / count(*) / (var_pop({c}) ** 1.5)) / 2')} FROM f, (SELECT avg({c}) AS m FROM f)" for c in _NUMBERS[:2])})
SELECT row_number() OVER (ORDER BY round(score, 4) DESC, chart, x NULLS FIRST, y NULLS FIRST)::INT AS rank, chart, x, y, round(score, 4) AS score FROM s""")
def chart_choice(s, d):
    return asc.chart_choice(linked_parts(s, d))
