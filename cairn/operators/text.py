"""Statistics of text columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .describe import melt

WORD = r"[\p{L}\p{N}_]+"
#: Words that are left out of the common ones.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "be", "been", "with", "at", "by", "this", "that", "it",
    "as", "from", "we", "you", "i", "they",
)


def words(df: DataFrame, text: str) -> DataFrame:
    """(word): lower-cased, one row each."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("word")).select(F.lower("word").alias("word"))


def common_words(df: DataFrame, text: str, *, top: int = 15, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(word, n): the ``top`` words by count (ties by word), then without stop words."""
    counts = words(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(top).where(~F.col("word").isin(*stop_words))


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """(metric, value): cells, words, distinct words, characters (cells joined by a blank) and sentences within cells."""
    t = F.col(text)
    pieces = F.filter(F.split(t, r"[.!?]+"), lambda p: F.trim(F.regexp_replace(p, r"\s", "")) != "")
    per_cell = df.where(t.isNotNull()).agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.size(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))).alias("words"),
        (F.sum(F.char_length(t)) + F.count(F.lit(1)) - 1).alias("characters"), F.sum(F.size(pieces)).alias("sentences"),
    )
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    long = melt(per_cell, ("metric", "value"), [(m, zero(m)) for m in ("cells", "words", "characters", "sentences")])
    return long.unionByName(words(df, text).select("word").distinct().agg(F.count(F.lit(1)).alias("value")).select(F.lit("distinct_words").alias("metric"), "value"))


def joined_sentences(df: DataFrame, text: str, order_by: str, group: str | None = None, *, buckets: int = 1024) -> DataFrame:
    """(sentences): over the cells of each group joined in order, so that one may run across cells. The order is a number, date or time; NULL comes first.

    A cell's first piece continues the sentence that the last non-blank tail before it left open. The state is carried in two
    steps, within ``buckets`` parts of about as many cells (cut by approximate quantiles) and over the parts' last states, so that no task
    holds all cells.
    """
    cuts_each = math.ceil(math.sqrt(buckets))  # a cell is placed among coarse cuts first, then among the finer ones of its part
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.transform(F.split(t, r"[.!?]+"), lambda p: F.regexp_replace(p, r"\s", "") != "")
    n = F.size(F.filter(parts, lambda b: b))
    last = F.element_at(parts, -1)
    keys = [group] if group else []
    place = F.col(order_by).cast("double")
    cuts = df.agg(F.percentile_approx(place, [i / cuts_each**2 for i in range(1, cuts_each**2)], 10_000).alias("_c"))
    coarse = F.transform(F.sequence(F.lit(cuts_each), F.lit(cuts_each * (cuts_each - 1)), F.lit(cuts_each)), lambda i: F.get("_c", i - 1))
    rows = df.crossJoin(F.broadcast(cuts.select("_c", coarse.alias("_b"))))  # one row
    passed = lambda edges: F.size(F.filter(edges, lambda e: e <= place))
    first = F.when(place.isNull(), 0).otherwise(F.coalesce(passed(F.col("_b")), F.lit(0)))
    rows = rows.withColumn("_f", first).withColumn("_k", F.col("_f") * cuts_each + F.when(place.isNull(), -1).otherwise(F.coalesce(passed(F.slice("_c", F.col("_f") * cuts_each + 1, F.lit(cuts_each - 1))), F.lit(0))))
    rows = rows.select(*keys, F.col(order_by).alias("_o"), n.alias("_n"), F.element_at(parts, 1).alias("_lead"), F.when((F.size(parts) > 1) | last, last).alias("_tail"), "_k")
    inner = Window.partitionBy(*keys, "_k").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_open", F.last("_tail", ignorenulls=True).over(inner))
    # A tail without an order can only be in the first part, where it comes before all others.
    states = rows.groupBy(*keys, "_k").agg(F.max_by(F.struct("_tail"), F.when(F.col("_tail").isNotNull(), F.struct(F.col("_o").isNotNull().alias("known"), "_o"))).alias("_s"))
    outer = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("_before", F.last(F.col("_s._tail"), ignorenulls=True).over(outer)).drop("_s")
    rows = rows.join(F.broadcast(states) if not group else states, [*keys, "_k"])  # at most about as many rows as buckets
    open_ = F.coalesce("_open", "_before", F.lit(False))
    return rows.groupBy(*keys).agg(F.sum(F.col("_n") - (open_ & F.col("_lead")).cast("int")).alias("sentences"))
