"""Linear forecast, regression and classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import roles
from ..functions.statistics import t_quantile
from .cleaning import drop_missing
from .describe import melt


def positions(df: DataFrame, bucket: str, key: str, value: str) -> DataFrame:
    """(x, y): place 0, 1, ... of each row by (bucket, key); a fit needs none of them, see :func:`line_fit`. Days are counted and summed up, so no task sorts all rows, nor all time stamps; a bucket that is no date counts as its value's whole part."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(bucket).alias("b"), F.col(key).alias("k"), F.col(value).cast("double").alias("y"))
    day = F.col("b").cast("date") if roles(df)[bucket] == "date" else F.floor(F.col("b").cast("double"))
    rows = rows.withColumn("d", day)
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("d", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("d")) - F.col("n")).alias("o"))  # a row for each day
    inner = F.row_number().over(Window.partitionBy("d").orderBy("b", "k")) - 1
    same = F.col("r.d").eqNullSafe(F.col("s.d"))
    return rows.withColumn("i", inner).alias("r").join(offsets.alias("s"), same).select((F.col("i") + F.col("o")).cast("double").alias("x"), "y")


def line_fit(df: DataFrame, bucket: str, key: str, value: str) -> DataFrame:
    """One row for the line through the values over their places 0, 1, ... by (bucket, key): n, slope, intercept, last, mean_x, sxx, sxy, syy; none for fewer than 5 rows.

    Rows are range-partitioned and sorted once. A part gives the moments over its own places, in one row; a running count shifts those of the later parts, and the
    moments of all parts add up. So no row gets its place, and a day or a key with very many rows is split like any other range.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(bucket).alias("b"), F.col(key).alias("k"), F.col(value).cast("double").alias("y"))
    by = [F.col(c).asc_nulls_first() for c in ("b", "k", "y")]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = sorted_rows.select(F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).cast("double").alias("i"), "y")
    n = F.count(F.lit(1)).cast("double")
    parts = placed.groupBy("part").agg(n.alias("n"), F.avg("i").alias("mi"), F.avg("y").alias("my"), (n * F.var_pop("i")).alias("ii"), (n * F.covar_pop("i", "y")).alias("iy"), (n * F.var_pop("y")).alias("yy"), F.max_by("y", "i").alias("last"))
    every = Window.partitionBy(F.lit(0))  # a row for each part
    total = F.sum("n").over(every)
    moved = parts.select("*", (F.sum("n").over(every.orderBy("part")) - F.col("n") + F.col("mi")).alias("mx"), total.alias("t"), ((total - 1) / 2).alias("x"), (F.sum(F.col("n") * F.col("my")).over(every) / total).alias("m"))
    dx, dy = F.col("mx") - F.col("x"), F.col("my") - F.col("m")
    fit = moved.agg(
        F.max("t").cast("long").alias("n"), F.max("x").alias("mean_x"), F.max("m").alias("mean_y"), F.max_by("last", "part").alias("last"),
        F.sum(F.col("ii") + F.col("n") * dx * dx).alias("sxx"), F.sum(F.col("iy") + F.col("n") * dx * dy).alias("sxy"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("syy"))
    slope = F.col("sxy") / F.col("sxx")
    return fit.where("n >= 5").select("n", slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), "last", "mean_x", "sxx", "sxy", "syy")


def ahead(fit: DataFrame, periods: int) -> DataFrame:
    """The fit once for each coming place ``x``, with its ``period`` (from n + 1) and ``y`` on the line."""
    rows = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("i")).withColumn("x", F.col("n") + F.col("i") - 1)
    return rows.select("*", (F.col("n") + F.col("i")).cast("long").alias("period"), (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))


def forecast(df: DataFrame, target: str, date: str, key: str, periods: int = 5) -> DataFrame:
    """(period, forecast): the fitted line beyond the last row; none for fewer than 5 rows."""
    return ahead(line_fit(df, date, key, target), periods).select("period", F.round("y", 4).alias("forecast"))


def forecast_interval(df: DataFrame, target: str, date: str, key: str, periods: int = 5, *, level: float = 0.95) -> DataFrame:
    """(period, forecast, low, high): the line beyond the last row, and the interval that holds a new value with a chance of ``level`` if residuals are normal.

    Its width has the residual variance (n - 2 degrees of freedom), the distance from the mean place, and the Student quantile. None for fewer than 5 rows.
    """
    rows = ahead(line_fit(df, date, key, target), periods)
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / (F.col("n") - 2)
    apart = F.col("x") - F.col("mean_x")
    wide = t_quantile(level, F.col("n") - 2) * F.sqrt(left) * F.sqrt(1 + 1 / F.col("n") + apart * apart / F.col("sxx"))
    r = lambda c: F.round(c, 4)
    return rows.select("period", r(F.col("y")).alias("forecast"), r(F.col("y") - wide).alias("low"), r(F.col("y") + wide).alias("high"))


def forecast_stats(df: DataFrame, target: str, date: str, key: str, periods: int = 5) -> DataFrame:
    """(metric, value): n, slope, intercept, last value, direction (1 up, else 0) and projected change in percent."""
    fit = line_fit(df, date, key, target)
    end = F.col("intercept") + F.col("slope") * (F.col("n") + periods - 1)
    r = lambda c, d=6: F.round(c, d)
    return melt(fit, ("metric", "value"), [("n", F.col("n").cast("double")), ("slope", r(F.col("slope"))), ("intercept", r(F.col("intercept"), 4)), ("last_value", F.col("last")), ("up", (F.col("slope") > 0).cast("double")), ("change_pct", r(F.try_divide(end - F.col("last"), F.col("last")) * 100, 4))])


#: A numeric target of so many distinct values at most is a class; a model needs so many complete rows.
MAX_CLASSES, LEAST_ROWS = 10, 10
#: A text feature of more values isn't indexed on the driver. Rows of the mean of all that pull the mean of one value.
MAX_LABELS, PULL = 1000, 10


def choose_target(df: DataFrame, target: str | None = None) -> str:
    """``target`` if the table has it, else the last of two or more numeric columns, else the first text column."""
    r = roles(df)
    numeric = [c for c, k in r.items() if k == "numeric"]
    if target in r:
        return target
    found = numeric[-1] if len(numeric) >= 2 else next((c for c, k in r.items() if k == "text"), None)
    if found is None:
        raise ValueError("a prediction needs two numeric columns or a text column")
    return found


def is_class(df: DataFrame, target: str) -> bool:
    """Whether a target is a class: text, or at most MAX_CLASSES distinct values."""
    return roles(df)[target] == "text" or df.select(target).where(F.col(target).isNotNull()).distinct().limit(MAX_CLASSES + 1).count() <= MAX_CLASSES


def in_test(df: DataFrame, key: str) -> Column:
    """Every fifth row by its key is test data: whole numbers by their remainder, other keys by that of the CRC-32 of their text; a missing key is training data."""
    number = isinstance(df.schema[key].dataType, T.IntegralType)
    return F.coalesce(F.pmod(F.col(key) if number else F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))


def target_means(rows: DataFrame, target: str, texts: Sequence[str]) -> DataFrame:
    """``rows`` with ``_x_<column>``, for each value of a text column the mean target of its training rows, pulled to that of all by PULL rows.

    A training row leaves itself out. Values are joined, so none is gathered on the driver; a value that no training row has gets the mean of all.
    """
    y = F.col(target).cast("double")
    train = rows.where("not _test")
    prior = train.agg(F.avg(y)).first()[0] or 0.0
    for c in texts:
        known = train.groupBy(F.col(c).alias("_value")).agg(F.sum(y).alias("_sum"), F.count(y).alias("_n"))
        own = F.when(F.col("_test") | F.col("_n").isNull(), 0).otherwise(1)
        mean = (F.coalesce("_sum", F.lit(0.0)) - own * F.coalesce(y, F.lit(0.0)) + PULL * prior) / (F.coalesce("_n", F.lit(0)) - own + PULL)
        rows = rows.join(known, F.col(c) == F.col("_value"), "left").withColumn(f"_x_{c}", mean).drop("_value", "_sum", "_n")
    return rows


def prepared(df: DataFrame, target: str, features: Sequence[str], key: str, classes: bool = False):
    """Rows with complete numeric features and an assembled vector; every fifth key is test data.

    Text of up to MAX_LABELS values is coded by the order of its values; with more, by the mean target of a value's training rows (of a classification by their share of the
    commonest class). A missing one is the text "nan". So is the missing target of a classification; a regression drops it.
    """
    r = roles(df)
    numeric = [*([] if classes else [target]), *[c for c in features if r[c] == "numeric"]]
    rows = (drop_missing(df, numeric) if numeric else df).withColumn("_test", in_test(df, key))
    if classes:
        rows = rows.withColumn(target, F.coalesce(F.col(target).cast("string"), F.lit("nan")))
    texts = [c for c in features if r[c] == "text"]
    rows = rows.fillna("nan", texts) if texts else rows
    n = {x["_test"]: x["n"] for x in rows.groupBy("_test").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(n.values()) < LEAST_ROWS:
        raise ValueError(f"a prediction needs at least {LEAST_ROWS} complete rows; there are {sum(n.values())}")
    sizes = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in texts]).first() if texts else {}
    many = [c for c in texts if sizes[c] > MAX_LABELS]
    few = [c for c in texts if c not in many]
    if many and classes:
        top = rows.where("not _test").groupBy(target).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), target).first()
        rows = target_means(rows.withColumn("_is_top", (F.col(target) == F.lit(top[0] if top else None)).cast("double")), "_is_top", many).drop("_is_top")
    elif many:
        rows = target_means(rows, target, many)
    stages = [StringIndexer(inputCols=few, outputCols=[f"_x_{c}" for c in few], stringOrderType="alphabetAsc", handleInvalid="keep")] if few else []
    stages.append(VectorAssembler(inputCols=[f"_x_{c}" if c in texts else c for c in features], outputCol="_features"))
    return rows, stages, n


def split_counts(df: DataFrame, target: str, features: Sequence[str], key: str) -> DataFrame:
    """(metric, value): classes of all complete rows of a classification, and the rows that it trains on and is tested on."""
    numeric = [c for c in features if roles(df)[c] == "numeric"]
    rows = drop_missing(df, numeric) if numeric else df
    row = rows.select(F.coalesce(F.col(target).cast("string"), F.lit("nan")).alias("c"), in_test(df, key).alias("t")).agg(F.count_distinct("c").alias("n"), F.count_if(~F.col("t")).alias("train"), F.count_if(F.col("t")).alias("test"))
    return melt(row, ("metric", "value"), [(m, F.col(c).cast("double")) for m, c in (("classes", "n"), ("train_rows", "train"), ("test_rows", "test"))])


def predict_regression(df: DataFrame, target: str, features: Sequence[str], key: str) -> DataFrame:
    """(metric, value): r2, mse, intercept and a coefficient for each feature, to seven digits (r2: six decimals), over held-out rows; an error for fewer than 10 complete rows."""
    rows, stages, _ = prepared(df, target, features, key)
    model = Pipeline(stages=[*stages, LinearRegression(featuresCol="_features", labelCol=target, solver="normal")]).fit(rows.where("not _test"))
    scored = model.transform(rows.where("_test"))
    of = lambda m: RegressionEvaluator(labelCol=target, metricName=m).evaluate(scored)
    line = model.stages[-1]
    out = [("r2", round(of("r2"), 6)), ("mse", of("mse")), ("intercept", line.intercept), *[(f"coefficient_{c}", float(k)) for c, k in zip(features, line.coefficients, strict=True)]]
    return df.sparkSession.createDataFrame([(m, float(f"{v:.7g}")) for m, v in out], "metric string, value double")


def predict_classification(df: DataFrame, target: str, features: Sequence[str], key: str) -> DataFrame:
    """(metric, value): accuracy over held-out rows, classes of all rows, rows of either part; an error for fewer than 10 complete rows."""
    rows, stages, n = prepared(df, target, features, key, classes=True)
    # The indexer sees all rows, so no class of the test part is unknown.
    labels = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error").fit(rows)
    rows = labels.transform(rows)
    model = Pipeline(stages=[*stages, LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=50, regParam=0.01)]).fit(rows.where("not _test"))
    scored = model.transform(rows.where("_test"))
    accuracy = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy").evaluate(scored)
    out = [("accuracy", accuracy), ("classes", len(labels.labels)), ("train_rows", n.get(False, 0)), ("test_rows", n.get(True, 0))]
    return df.sparkSession.createDataFrame([(m, float(v)) for m, v in out], "metric string, value double")


def predict(df: DataFrame, target: str | None = None, *, key: str | None = None) -> DataFrame:
    """(task, target, metric, value) of a model that chooses its target, its task and, from all other numeric and text columns, its features.

    ``key`` (by default the first column) only deals rows to the training and the test part.
    """
    target = choose_target(df, target)
    r = roles(df)
    features = [c for c in df.columns if c != target and r[c] in ("numeric", "text")]
    if not features:
        raise ValueError("a prediction needs a feature besides its target")
    task = "classification" if is_class(df, target) else "regression"
    made = {"classification": predict_classification, "regression": predict_regression}[task](df, target, features, key or df.columns[0])
    return made.select(F.lit(task).alias("task"), F.lit(target).alias("target"), "metric", "value")
