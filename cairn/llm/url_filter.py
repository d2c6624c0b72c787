"""URL filter: rules first, gradient-boosted trees on lexical features for the rest. No Python on the executors.

The trees are trained on the URLs of the table that the rules label. Where those are all of
one class, the verdict of the method is that class; where there are none, it is ``allow``.

Among the features are statistics of the host's suffix, alone and with the first segment of the path: how many labelled URLs it has and how many of
them are allowed. They are counted over all labelled URLs, for all suffixes; a training row gets those of the other folds, so it never
sees its own label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, materialize, refuse, require

#: Labelled URLs that the trees are fitted on, at most: those with the smallest hashes.
MAX_TRAINING_ROWS = 100_000
#: Folds of the suffix statistics, and how many URLs of the mean class balance each suffix starts with.
FOLDS, PRIOR_ROWS = 5, 10
#: Characters whose frequencies give the entropy; all others count as one more symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#=&%+"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` and for null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".replace("{u}", "_url"))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fits(rule: Rule) -> Column:
    host, path = F.col("host"), F.col("path")
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def apply_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Rule and verdict: of the longest rule that fits; among equally long ones of the longer host, then block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict)):
        rule, verdict = F.when(fits(r), r.text).otherwise(rule), F.when(fits(r), r.verdict).otherwise(verdict)
    return rule, verdict


def lexical_features() -> dict[str, Column]:
    """Features of a row with ``_url``, ``host`` and ``path``."""
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    length = F.char_length(url)
    count = lambda s, c: F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit("")))
    low = F.lower(url)
    known = [count(low, c) for c in ALPHABET]
    share = lambda n: F.when(n > 0, -(n / length) * F.log2(n / length)).otherwise(0.0)
    other = length - sum(known[1:], known[0])
    entropy = sum((share(n) for n in known[1:]), share(known[0])) + share(other)
    digits = F.char_length(url) - F.char_length(F.translate(url, "0123456789", ""))
    has_query = F.instr(url, "?") > 0
    return {
        "length": length,
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "depth": count(path, "/"),
        "host_labels": count(host, ".") + 1,
        "hyphens": count(host, "-"),
        "digit_ratio": F.when(length > 0, digits / length).otherwise(0.0),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "parameters": F.when(has_query, count(F.substring_index(url, "?", -1), "&") + 1).otherwise(0),
        "has_fragment": (F.instr(url, "#") > 0).cast("int"),
        "is_https": low.startswith("https://").cast("int"),
        "last_segment_length": F.char_length(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)),
        "suffix_length": F.char_length(F.substring_index(host, ".", -1)),
    }


#: Columns with statistics: the last two labels of the host, and those with the first segment of the path.
COUNTED = ("suffix", "segment")


def suffix_statistics(labelled: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, rows, allowed), and the same by fold, of rows with ``_<key>``, ``_fold`` and ``label``; both in scratch tables. Partial sums leave no hot suffix."""
    by_fold = labelled.groupBy(f"_{key}", "_fold").agg(F.count(F.lit(1)).alias(f"_{key}_fold_rows"), F.sum("label").alias(f"_{key}_fold_allowed"))
    by_fold = materialize(by_fold, f"{key}-folds")
    total = by_fold.groupBy(f"_{key}").agg(F.sum(f"_{key}_fold_rows").alias(f"_{key}_rows"), F.sum(f"_{key}_fold_allowed").alias(f"_{key}_allowed"))
    return materialize(total, key), by_fold


def filter_urls(
    pages: DataFrame, *, url_col: str = "url", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, learn_from: Column | None = None,
    max_training_rows: int = MAX_TRAINING_ROWS, trees: int = 12, depth: int = 4, seed: int = 6,
) -> DataFrame:
    """The columns ``keep`` (all by default) with ``host``, ``path``, ``rule``, ``verdict`` and ``allow_score``.

    ``verdict`` is the rule's, else the trees': allow if their probability is at least a half. ``learn_from`` says which
    rows' labels may be learned; all by default. Null and malformed URLs have an empty host and path, fit no rule and are judged by the
    trees. URLs may be of any length; the longest rule wins, at equal length that of the longer host, then block. Repeated rows get
    equal verdicts. An empty table gives an empty result. Columns of ``keep`` with the names of the results are refused.
    """
    require(pages, [url_col])
    keep = pages.columns if keep is None else keep
    refuse(keep, ["host", "path", "rule", "verdict", "allow_score"])
    learn = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), learn.alias("_learn"))
    host, path = split_url(F.col("_url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = apply_rules(rules)
    base = base.withColumns({"rule": rule, "_rule_verdict": verdict, "_suffix": F.substring_index("host", ".", -2), "_fold": F.pmod(F.xxhash64("_url"), F.lit(FOLDS))})
    base = base.withColumn("_segment", F.concat("_suffix", F.lit("/"), F.regexp_extract("path", r"(?s)^/?([^/]*)", 1)))
    features = lexical_features()
    base = base.withColumns({f"_f_{k}": v.cast("double") for k, v in features.items()})
    base = materialize(base, "urls")

    labelled = base.where("_learn and _rule_verdict is not null").withColumn("label", (F.col("_rule_verdict") == "allow").cast("double")).drop("_kept")
    seen = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        only = 0.0 if 0.0 in seen else 1.0
        scored = base.withColumn("allow_score", F.lit(only))
    else:
        prior = seen[1.0] / (seen[0.0] + seen[1.0])
        statistics = {key: suffix_statistics(labelled, key) for key in COUNTED}

        def with_share(df: DataFrame, key: str, rows: Column, allowed: Column) -> DataFrame:
            rows, allowed = F.coalesce(rows, F.lit(0)), F.coalesce(allowed, F.lit(0.0))
            return df.withColumns({f"_f_{key}_rows": F.log1p(rows.cast("double")), f"_f_{key}_allowed": (allowed + PRIOR_ROWS * prior) / (rows + PRIOR_ROWS)})

        inputs = [f"_f_{k}" for k in features] + [f"_f_{key}_{x}" for key in COUNTED for x in ("rows", "allowed")]
        assembler = VectorAssembler(inputCols=inputs, outputCol="_features")
        # Rows of the training sample are few, and its ties are equal URLs.
        train = materialize(labelled.orderBy(F.xxhash64("_url"), "_url").limit(max_training_rows), "url-sample")
        every = base
        for key, (total, by_fold) in statistics.items():
            train = train.join(by_fold, [f"_{key}", "_fold"]).join(total, f"_{key}")
            train = with_share(train, key, F.col(f"_{key}_rows") - F.col(f"_{key}_fold_rows"), F.col(f"_{key}_allowed") - F.col(f"_{key}_fold_allowed"))
            # A row for each suffix: Spark broadcasts them while they are small, and can split a hot suffix otherwise.
            every = with_share(every.join(total, f"_{key}", "left"), key, F.col(f"_{key}_rows"), F.col(f"_{key}_allowed"))
        train = materialize(assembler.transform(train).select("_features", "label").coalesce(6), "url-training")
        boosted = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=seed)
        model = boosted.setPredictionCol("_class").setProbabilityCol("_p").setRawPredictionCol("_raw").fit(train)
        scored = model.transform(assembler.transform(every)).withColumn("allow_score", vector_to_array("_p")[1])
    verdict = F.coalesce("_rule_verdict", F.when(F.col("allow_score") >= 0.5, "allow").otherwise("block"))
    return scored.select("_kept.*", "host", "path", "rule", verdict.alias("verdict"), "allow_score")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; null, malformed, long and repeated URLs as in :func:`filter_urls`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")
