"""How strongly columns of any kind go together, as a heatmap, and the charts that show a table best."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import roles
from .charts import auto_chart
from .describe import correlation_pairs, melt

EMPTY = "col_a string, col_b string, measure string, association double"


def union(parts: list[DataFrame], df: DataFrame, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def categories(df: DataFrame, texts: list[str]) -> DataFrame:
    """(pair, a, b, n): how often two categories meet, for all pairs of text columns in one shuffle; rows where either is missing are left out."""
    pairs = list(combinations(texts, 2))
    cells = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")) for k, (a, b) in enumerate(pairs)])
    return df.select(F.explode(cells).alias("c")).select("c.*").where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def text_association(df: DataFrame, texts: list[str]) -> DataFrame:
    """Cramér's V: the root of the chi-square statistic over its largest value; NULL where a column has one category."""
    pairs = list(combinations(texts, 2))
    met = categories(df, texts)
    rows, columns = met.groupBy("pair", "a").agg(F.sum("n").alias("r")), met.groupBy("pair", "b").agg(F.sum("n").alias("c"))
    share = met.join(rows, ["pair", "a"]).join(columns, ["pair", "b"]).groupBy("pair").agg(F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"))
    sizes = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("ra")).join(columns.groupBy("pair").agg(F.count(F.lit(1)).alias("cb")), "pair")
    v = F.when(F.least("ra", "cb") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / (F.least("ra", "cb") - 1)))
    names = [F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), F.col("pair") + 1) for i in (0, 1)]
    return share.join(sizes, "pair").select(names[0].alias("col_a"), names[1].alias("col_b"), F.lit("cramers_v").alias("measure"), v.alias("association"))


def mixed_association(df: DataFrame, texts: list[str], numeric: list[str]) -> DataFrame:
    """Correlation ratio: the root of the share of a number's variance that lies between the categories; NULL for a constant."""
    cells = F.array(*[F.struct(F.lit(c).alias("t"), F.col(f"`{c}`").alias("v")) for c in texts])
    values = [F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(numeric)]
    exploded = df.select(*values, F.explode(cells).alias("c")).select("c.*", *[f"x{j}" for j in range(len(numeric))]).where("v is not null")
    each = [F.struct(F.count(f"x{j}").alias("n"), F.avg(f"x{j}").alias("m"), F.var_pop(f"x{j}").alias("s")).alias(f"g{j}") for j in range(len(numeric))]
    groups = exploded.groupBy("t", "v").agg(*each).select("t", F.explode(F.array(*[F.struct(F.lit(c).alias("x"), F.col(f"g{j}.n").alias("n"), F.col(f"g{j}.m").alias("m"), F.col(f"g{j}.s").alias("s")) for j, c in enumerate(numeric)])).alias("g")).select("t", "g.*")
    known = groups.where("n > 0")
    means = known.groupBy("t", "x").agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mm"))  # a row for each pair of columns
    shares = known.join(F.broadcast(means), ["t", "x"]).groupBy("t", "x").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"))
    ratio = F.sqrt(F.try_divide(F.col("between"), F.col("between") + F.col("within")))
    return shares.select(F.col("t").alias("col_a"), F.col("x").alias("col_b"), F.lit("correlation_ratio").alias("measure"), ratio.alias("association"))


def timed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Dates as seconds, and the roles of the columns."""
    kinds = roles(df)
    seconds = {c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double") / 1e6 for c, r in kinds.items() if r == "date"}
    return df.withColumns(seconds) if seconds else df, kinds


def associations(df: DataFrame, *, digits: int = 6) -> DataFrame:
    """(col_a, col_b, measure, association) over pairs of numeric, text and date columns, 0 to 1 but for Pearson's r, which has a sign.

    Two numbers (or dates, as numbers): ``pearson``; two texts: ``cramers_v``; a text and a number: ``correlation_ratio``. Pairs that never occur together have no row.
    Categories are counted before they are exchanged; a pair of texts that are nearly all different exchanges nearly all rows, so leave such columns out of wide tables.
    """
    rows, kinds = timed(df)
    texts = [c for c, r in kinds.items() if r == "text"]
    numbers = [c for c, r in kinds.items() if r in ("numeric", "date")]
    parts = []
    if len(numbers) >= 2:
        parts.append(correlation_pairs(rows, numbers, digits=digits).select("col_a", "col_b", F.lit("pearson").alias("measure"), F.col("r").alias("association")))
    if len(texts) >= 2:
        parts.append(text_association(rows, texts))
    if texts and numbers:
        parts.append(mixed_association(rows, texts, numbers))
    return union(parts, df, EMPTY).withColumn("association", F.round("association", digits) + 0.0)


def heatmap(df: DataFrame) -> DataFrame:
    """(x, y, measure, association): a cell for each ordered pair of columns, and 1 on the diagonal; the series of a heatmap."""
    found = associations(df)
    turned = found.select(F.col("col_b").alias("x"), F.col("col_a").alias("y"), "measure", "association")
    columns = [c for c, r in roles(df).items() if r in ("numeric", "text", "date")]
    one = df.sparkSession.createDataFrame([(c, c, "same", 1.0) for c in columns], "x string, y string, measure string, association double")
    return found.select(F.col("col_a").alias("x"), F.col("col_b").alias("y"), "measure", "association").unionByName(turned).unionByName(one)


#: A chart's score without and with the full strength of what it shows. Bars suit MANY categories at most, pies FEW.
RULES = {"line": (0.6, 0.4), "bar": (0.5, 0.5), "scatter": (0.4, 0.6), "heatmap": (0.3, 0.6), "histogram": (0.3, 0.3), "pie": (0.45, 0.2)}
MANY, FEW = 50, 8


def score(kind: str, strength: Column) -> Column:
    low, more = RULES[kind]
    return F.lit(low) + more * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(strength, F.lit(0.0))))


def chart_choice(df: DataFrame, *, digits: int = 4) -> DataFrame:
    """(rank, chart, x, y, score): charts for the columns of a table, best first.

    Category and number: bar; date and number: line; two numbers: scatter; one number: histogram; three numbers or more: heatmap; a category of 2 to FEW values: pie.
    A chart scores between its two values in RULES by the strength of what it shows: the association of its columns (by absolute value; for a heatmap the mean of all), skewness
    for a histogram, few categories for a pie. Bars of more than MANY categories, or of one, count half.
    """
    kinds = roles(df)
    texts, numeric = ([c for c, r in kinds.items() if r == role] for role in ("text", "numeric"))
    found = associations(df).withColumn("strength", F.abs("association"))
    none = F.lit(None).cast("string")
    numbers = lambda c: F.col(c).isin(*numeric)
    row = lambda rows, kind, x, y, value: rows.select(F.lit(kind).alias("chart"), x.alias("x"), y.alias("y"), value.alias("score"))
    a, b = F.col("col_a"), F.col("col_b")
    parts = []
    if texts:
        sizes = melt(df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in texts]), ("_c", "_k"), [(c, F.col(f"`{c}`")) for c in texts])  # a row for each column
        parts.append(row(sizes.where(F.col("_k").between(2, FEW)), "pie", F.col("_c"), none, score("pie", (FEW - F.col("_k")) / (FEW - 2))))
        bars = found.where((F.col("measure") == "correlation_ratio") & numbers("col_b")).join(F.broadcast(sizes), a == F.col("_c"))
        parts.append(row(bars, "bar", a, b, score("bar", F.col("strength")) * F.when(F.col("_k").between(2, MANY), 1.0).otherwise(0.5)))
    pearson = found.where("measure = 'pearson'")
    both = pearson.where(numbers("col_a") & numbers("col_b"))
    parts.append(row(both, "scatter", a, b, score("scatter", F.col("strength"))))
    dated = F.when(numbers("col_a"), b).otherwise(a)
    parts.append(row(pearson.where(numbers("col_a") != numbers("col_b")), "line", dated, F.when(numbers("col_a"), a).otherwise(b), score("line", F.col("strength"))))
    if len(numeric) >= 3:
        parts.append(row(both.agg(F.avg(F.coalesce("strength", F.lit(0.0))).alias("m")), "heatmap", none, none, score("heatmap", F.col("m"))))
    if numeric:
        skew = melt(df.agg(*[F.skewness(F.col(f"`{c}`").cast("double")).alias(c) for c in numeric]), ("_c", "_s"), [(c, F.nanvl(F.col(f"`{c}`"), F.lit(0.0))) for c in numeric])
        parts.append(row(skew, "histogram", F.col("_c"), none, score("histogram", F.abs("_s") / 2)))
    made = union(parts, df, "chart string, x string, y string, score double").withColumn("score", F.round("score", digits))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chart", "x", "y")  # a row for each pair of columns
    return made.select(F.row_number().over(order).alias("rank"), "chart", "x", "y", "score")


def best_chart(df: DataFrame) -> tuple[str, DataFrame]:
    """The kind of the chart of rank 1 and its series."""
    top = chart_choice(df).orderBy("rank").first()
    if top is None:
        raise ValueError("a chart needs a numeric or a text column")
    if top["chart"] == "heatmap":
        return "heatmap", heatmap(df)
    if top["chart"] == "bar":
        return "bar", df.groupBy(F.col(f"`{top['x']}`").alias("x")).agg(F.round(F.sum(f"`{top['y']}`"), 2).alias("y")).orderBy(F.desc("y"), "x").limit(MANY)
    return top["chart"], auto_chart(df, top["chart"], x=top["x"], y=top["y"])
