"""Segments of rows: k-means over scaled numeric features, its quality, and what sets each segment apart.

Fitting reads a slim table of scaled features, once for each round. The driver holds centres and, while seeding, some ``2 * k`` candidates for each seeding round;
all else are aggregates. A fitted model is a projection of literals, so rows are assigned without a shuffle, in any table with the same features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import with_role
from .describe import melt

#: Rounds of seeding, candidates drawn in each for every segment (on average), rounds of moving centres, and the shift that counts as none.
SEEDING, PER_SEGMENT, ROUNDS, STILL = 4, 2, 20, 1e-9
Point = tuple[float, ...]


@dataclass(frozen=True)
class Segments:
    """Scaled centres, largest segment first, with what scales a row."""

    features: tuple[str, ...]
    means: Point
    deviations: Point
    centres: tuple[Point, ...]

    def scaled(self) -> list[Column]:
        """The features less their means, in standard deviations; missing values and constant features are 0."""
        value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        return [F.coalesce((value(c) - m) / s, F.lit(0.0)) if s else F.lit(0.0) for c, m, s in zip(self.features, self.means, self.deviations, strict=True)]

    def nearest(self, at: Sequence[Column] | None = None) -> Column:
        """A struct of squared distance ``d`` and segment ``i``."""
        return nearest(self.scaled() if at is None else at, self.centres)


def squared(at: Sequence[Column], centre: Point) -> Column:
    return reduce(add, [(x - c) * (x - c) for x, c in zip(at, centre, strict=True)])


def nearest(at: Sequence[Column], centres: Sequence[Point]) -> Column:
    return F.array_min(F.array(*[F.struct(squared(at, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))


def draw(round_no: int) -> Column:
    """A number in [0, 1) for each row, from a digest of its key, so that a lost task draws the same again."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{round_no}:"), F.col("_key"))), 1, 8), 16, 10).cast("double") / 2.0**32


def seeds(points: DataFrame, at: list[Column], k: int) -> list[Point]:
    """Parallel seeding: each round draws candidates with a chance that grows with their distance from those before; then the candidates that stand for most rows, far from each other, are taken."""
    names = [f"x{j}" for j in range(len(at))]
    found = [tuple(points.orderBy(F.md5(F.concat(F.lit("0:"), F.col("_key"))), "_key").select(*names).first())]
    for r in range(1, SEEDING + 1):
        distance = nearest(at, found)["d"]
        total = points.agg(F.sum(distance)).first()[0]
        if not total:
            break
        drawn = points.where(draw(r) * total < PER_SEGMENT * k * distance).select(*names).distinct().collect()  # some PER_SEGMENT * k rows
        found = sorted({*found, *map(tuple, drawn)})
    weights = {r["i"]: r["n"] for r in points.groupBy(nearest(at, found)["i"].alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    chosen = [min(weights, key=lambda i: (-weights[i], i))]
    while len(chosen) < min(k, len(weights)):
        chosen.append(min(weights, key=lambda i: (-weights[i] * min(apart(found[i], found[j]) for j in chosen), i)))
    return [found[i] for i in chosen]


def moved(points: DataFrame, at: list[Column], centres: list[Point]) -> tuple[list[Point], list[int]]:
    """Means of the rows nearest to each centre (a centre without rows stays) and their numbers."""
    means = [F.avg(f"x{j}").alias(f"x{j}") for j in range(len(at))]
    rows = {r["i"]: r for r in points.groupBy(nearest(at, centres)["i"].alias("i")).agg(F.count(F.lit(1)).alias("n"), *means).collect()}
    return [tuple(rows[i][f"x{j}"] for j in range(len(at))) if i in rows else c for i, c in enumerate(centres)], [rows[i]["n"] if i in rows else 0 for i in range(len(centres))]


def fit_segments(df: DataFrame, key: str, features: Sequence[str] | None = None, *, k: int | None = None, most: int = 6, rounds: int = ROUNDS) -> Segments:
    """A model of ``k`` segments; without ``k`` that of 2 to ``most`` with the best silhouette.

    Features are all numeric columns but ``key`` unless given, scaled by mean and standard deviation. ``key`` deals the draws of the seeding. Fewer distinct rows than ``k``
    make fewer segments; an empty table is an error.
    """
    features = tuple(features or [c for c in with_role(df, "numeric") if c != key])
    if not features:
        raise ValueError("segments need a numeric feature")
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(value(c)).alias(f"{n}{j}") for j, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not row["n"]:
        raise ValueError("segments need rows")
    scale = Segments(features, tuple(row[f"m{j}"] or 0.0 for j in range(len(features))), tuple(row[f"s{j}"] or 0.0 for j in range(len(features))), ())
    points = df.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"), *[x.alias(f"x{j}") for j, x in enumerate(scale.scaled())]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = [fit_scaled(points, scale, n, rounds) for n in ([k] if k else range(2, most + 1))]
        if len(models) == 1:
            return models[0]
        at = [F.col(f"x{j}") for j in range(len(features))]
        return max(models, key=lambda m: silhouettes(points, m, at).agg(F.sum("total") / F.sum("n")).first()[0])
    finally:
        points.unpersist()


def fit_scaled(points: DataFrame, scale: Segments, k: int, rounds: int) -> Segments:
    at = [F.col(f"x{j}") for j in range(len(scale.features))]
    centres = seeds(points, at, k)
    sizes = [0] * len(centres)
    for _ in range(rounds):
        new, sizes = moved(points, at, centres)
        shift = max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True))
        centres = new
        if shift <= STILL:
            break
    order = sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i]))
    return Segments(scale.features, scale.means, scale.deviations, tuple(centres[i] for i in order))


def assign_segments(df: DataFrame, model: Segments) -> DataFrame:
    """``df`` with ``segment`` (0 is the largest of the fitted table) and ``distance`` from its centre, in standard deviations."""
    found = df.withColumn("_near", model.nearest())
    return found.withColumns({"segment": F.col("_near.i"), "distance": F.sqrt("_near.d")}).drop("_near")


def segment_profile(df: DataFrame, model: Segments, *, digits: int = 4) -> DataFrame:
    """(segment, n, share, feature, mean, overall, lift, main): means of each feature inside and over all rows, their difference in standard deviations, and whether it is the segment's largest."""
    features = model.features
    inside = df.select(model.nearest()["i"].alias("segment"), *[F.col(f"`{c}`").cast("double").alias(f"v{j}") for j, c in enumerate(features)], *[x.alias(f"x{j}") for j, x in enumerate(model.scaled())])
    means = [f(f"{p}{j}").alias(f"{p}{j}") for j in range(len(features)) for p, f in (("v", F.avg), ("x", F.avg))]
    rows = inside.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *means)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("_all"))))  # one row
    top = F.greatest(*[F.abs(f"x{j}") for j in range(len(features))], F.lit(0.0))
    named = [(F.col("segment"), F.col("n"), F.round(F.col("n") * 100.0 / F.col("_all"), 2), c, F.round(f"v{j}", digits), F.round(F.lit(model.means[j]), digits), F.round(F.col(f"x{j}"), digits) + 0.0, F.abs(f"x{j}") == top) for j, c in enumerate(features)]
    return melt(rows, ("segment", "n", "share", "feature", "mean", "overall", "lift", "main"), named)


def silhouettes(df: DataFrame, model: Segments, at: list[Column] | None = None) -> DataFrame:
    """(segment, n, total): rows and the sum of their silhouettes for squared distances.

    The mean distance from a row to a segment follows from the segment's number of rows, their sum and their sum of squares, so no pair of rows is compared.
    """
    at = model.scaled() if at is None else at
    names = [f"_x{j}" for j in range(len(at))]
    rows = df.select(*[x.alias(n) for x, n in zip(at, names, strict=True)]).withColumn("segment", model.nearest([F.col(n) for n in names])["i"])
    norm = reduce(add, [F.col(n) * F.col(n) for n in names])
    known = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"), *[F.sum(n).alias(n) for n in names]).collect()  # a row for each segment
    if len(known) < 2:
        return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("total"))
    far = {r["segment"]: F.lit(float(r["n"])) * norm + r["q"] - 2 * reduce(add, [F.col(n) * r[n] for n in names]) for r in known}
    size = {r["segment"]: r["n"] for r in known}
    inside = reduce(lambda out, i: F.when(F.col("segment") == i, far[i] / (size[i] - 1) if size[i] > 1 else F.lit(None).cast("double")).otherwise(out), far, F.lit(None).cast("double"))
    outside = F.array_min(F.array(*[F.when(F.col("segment") != i, far[i] / size[i]) for i in far]))
    own = rows.select("segment", inside.alias("a"), outside.alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return own.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def segment_quality(df: DataFrame, model: Segments, *, digits: int = 4) -> DataFrame:
    """(segment, n, silhouette), and a row of null segment for all rows; 1 is far apart, 0 between two segments, a segment of one row counts 0."""
    made = silhouettes(df, model)
    value = F.round(F.sum("total") / F.sum("n"), digits).alias("silhouette")
    return made.groupBy("segment").agg(F.sum("n").alias("n"), value).unionByName(made.agg(F.lit(None).cast("int").alias("segment"), F.sum("n").alias("n"), value))


def segments(df: DataFrame, key: str, features: Sequence[str] | None = None, *, k: int | None = None) -> DataFrame:
    """Fit and profile in one call."""
    return segment_profile(df, fit_segments(df, key, features, k=k))
