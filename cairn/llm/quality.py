"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards its own
diagonal. A score is the difference of the two Mahalanobis log densities, from cached Cholesky factors,
on a logistic scale. Means and covariances are sums over all labelled rows, added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, materialize, require, text_batches

FEATURES = (
    "log_bytes", "upper", "digit", "symbol", "exclamation", "pipe", "sentence_end", "comma", "line_break",
    "non_ascii", "distinct_words", "word_repeats", "word_length", "marked_words",
)
#: Weights of the pooled covariance, of the class's own diagonal, and of the unit matrix.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.1, 0.1, 0.02
#: Scores are squeezed by this before the logistic function, so that they don't all end at 0 and 1.
TEMPER = 0.25

_BYTE_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~=+<>{}[]_\\", b"!", b"|", b".?", b",;:", b"\n"), 1):
    _BYTE_CLASS[list(_chars)] = _i
_BYTE_CLASS[128:] = 9


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; null and empty texts give those of no words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    kinds = np.bincount(_BYTE_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 10)
    words = (text or "").split()
    m = len(words)
    logs = np.log((kinds[1:] + 0.5) / (n + 100.0))
    distinct = np.log((len(set(words)) + 1) / (m + 1)) / np.log(m + 10)
    repeats = np.log((sum(map(eq, words, words[1:])) + 0.5) / (m + 50.0))
    marked = np.log((kinds[3] + kinds[4] + kinds[5] + 0.5) / (m + 20.0))
    return np.array([np.log1p(n), *logs, distinct, repeats, np.log((n + 5.0) / (m + 1)), marked])


def statistics_udf():
    """Statistics of a column of texts."""

    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([statistics(t) for t in part])

    return of


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of class 0 and 1; ``None`` factors: one class only."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            y = (z - mean) @ factor.T
            density.append(-0.5 * np.einsum("ij,ij->i", y, y) - logdet)
        gain = np.clip(TEMPER * (density[1] - density[0] + np.log(self.prior / (1 - self.prior))), -30, 30)
        return 1 / (1 + np.exp(-gain))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products for each label of ``(label, features)``: one small row for each task and label, then added up."""
    d = len(FEATURES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for label, part in b.groupby("label"):
                x = np.column_stack([np.ones(len(part)), np.stack(part["features"].to_numpy())])
                sums[int(label)] = sums.get(int(label), 0) + x.T @ x
        if sums:
            yield pd.DataFrame({"label": list(sums), "products": [s.ravel() for s in sums.values()]})

    parts = rows.mapInPandas(partial, "label int, products array<double>")
    added = parts.select("label", F.posexplode("products").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in added.collect():  # (1 + features) squared numbers for each label
        out.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["at"]] = r["v"]
    return {k: ((m := v.reshape(d + 1, d + 1))[0, 0], m[0, 1:], m[1:, 1:]) for k, v in out.items()}


def fit(features: DataFrame) -> Discriminant:
    """From ``(label, features)``; labels other than 0 and 1 are left out. Without rows of both classes the score is their share (0.5 without any)."""
    m = moments(features.where("label in (0, 1)").select(F.col("label").cast("int").alias("label"), "features"))
    d = len(FEATURES)
    n0, n1 = (m[k][0] if k in m else 0.0 for k in (0, 1))
    if min(n0, n1) < 2:
        return Discriminant((n1 + 1) / (n0 + n1 + 2), np.zeros(d), np.ones(d))
    centre = (m[0][1] + m[1][1]) / (n0 + n1)
    spread = np.diag(m[0][2] + m[1][2]) / (n0 + n1) - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, scatter = [], []
    for k in (0, 1):
        n, s, p = m[k]
        mean = (s / n - centre) / scale
        z = (p / n - np.outer(centre, s / n) - np.outer(s / n, centre) + np.outer(centre, centre)) / np.outer(scale, scale)
        means.append(mean)
        scatter.append(z - np.outer(mean, mean))
    pooled = (n0 * scatter[0] + n1 * scatter[1]) / (n0 + n1)
    factors, logdets = [], []
    for s in scatter:
        cov = (1 - TO_POOLED - TO_DIAGONAL) * s + TO_POOLED * pooled + TO_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logdets.append(np.log(np.diag(low)).sum())
    return Discriminant(n1 / (n0 + n1), centre, scale, np.array(means), np.array(factors), np.array(logdets))


def training_rows(features: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``features`` with the label of their id, held-out ids left out. Of several labels of an id the largest counts."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    return features.join(known, features[id_col] == known["_id"]).select("label", "features")


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Discriminant, DataFrame]:
    """The classifier, and the statistics of all documents ``(id, features)`` in a scratch table.

    Null and empty texts have the statistics of no words; texts of any length are read whole; a repeated id trains with each of its
    rows. Labels and ids that are null are left out, and other columns aren't read. An empty table gives a classifier of one score.
    """
    require(docs, [id_col, text_col])
    require(labels, [id_col, label_col])
    text_batches(docs.sparkSession)
    features = materialize(docs.select(id_col, statistics_udf()(text_col).alias("features")), "quality")
    return fit(training_rows(features, labels, id_col, label_col)), features


def score_udf(model: Discriminant):
    """Score of a column of statistics."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.scores(np.stack(part.to_numpy())) if len(part) else np.zeros(0))

    return score


def text_score_udf(model: Discriminant):
    """Score of a column of texts."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.scores(np.stack([statistics(t) for t in part])) if len(part) else np.zeros(0))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text_col: str = "text", **columns: str) -> DataFrame:
    """``docs`` whose score is at least ``threshold``; every column stays as it is, whatever its name. Equal texts share their fate, and null texts are scored as empty ones."""
    model, _ = fit_quality(docs, labels, text_col=text_col, **columns)
    return docs.where(text_score_udf(model)(F.col(text_col)) >= threshold)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Score of every document. Null texts score as empty ones; documents with equal texts score alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model, features = fit_quality(docs, labels)
    scored = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_udf(model)("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
