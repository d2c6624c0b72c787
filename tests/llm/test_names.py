"""Columns of a table that bear the names operators use inside are kept as they are, or refused by name."""

import pytest
from pyspark.sql import functions as F

from cairn.llm import decontaminate, exact_dedup, quality, shared, shuffle_shards, simhash, url_filter

INNER = ("_row", "_block", "_fp", "_salt", "_tag", "_id", "_text", "_doc", "_tie", "_found", "_recipe", "_packed", "_order", "_n", "component_id", "root", "keep_id", "kept", "a.b")


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, "one two three four five"), (2, "ONE two three four five"), (3, "something else altogether here"), (None, None), (None, "no id"), (3, "something else altogether here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(INNER)])


def values(df):
    return {tuple(r)[2 : 2 + len(INNER)] for r in df.collect()}


def test_kept(spark, frame):
    bench = spark.createDataFrame([(1, "something else altogether here")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    results = {
        "exact": (exact_dedup.drop_exact_copies(frame), 4), "near": (simhash.drop_near_copies(frame), 4), "clean": (decontaminate.drop_contaminated(frame, bench), 4),
        "good": (quality.keep_good(frame, labels), 6),
    }
    for name, (df, n) in results.items():
        assert df.columns == frame.columns, name
        assert df.count() == n, name
        assert values(df) == {tuple(range(len(INNER)))}, name
    out = shuffle_shards.shuffle_shards(frame, "doc_id", shards=2)
    assert out.columns == [*frame.columns, "shard", "slot"] and out.count() == 6 and values(out) == {tuple(range(len(INNER)))}
    out = decontaminate.find_contamination(frame, bench)
    assert out.columns == [*frame.columns, "n_words", "spans", "items", "contaminated"] and values(out) == {tuple(range(len(INNER)))}
    several = decontaminate.find_contamination(frame, bench.unionByName(bench), block_bytes=20)
    assert several.columns == out.columns and several.where("contaminated").count() == out.where("contaminated").count() == 2
    pages = spark.createDataFrame([(1, "https://a.org/x", "u", "f")], "page_id long, url string, _url string, _features string")
    assert tuple(url_filter.filter_urls(pages).first())[2:4] == ("u", "f")


def test_refused(frame):
    with pytest.raises(ValueError, match="SHARD"):
        shuffle_shards.shuffle_shards(frame.withColumn("SHARD", F.lit(1)), "doc_id")
    with pytest.raises(ValueError, match="items"):
        decontaminate.find_contamination(frame.withColumn("items", F.lit(1)), frame, item_col="doc_id")
    with pytest.raises(ValueError, match="_salt"):
        exact_dedup.exact_dedup(frame, keep=["doc_id", "_salt"])
    with pytest.raises(ValueError, match="host"):
        url_filter.filter_urls(frame.withColumnRenamed("text", "url").withColumn("host", F.lit(1)))
    with pytest.raises(ValueError, match="missing columns"):
        exact_dedup.exact_dedup(frame, text_col="body")


def test_scratch_is_cleared(spark, frame):
    import glob

    shared.materialize(frame.select("doc_id"), "cleared").count()
    assert glob.glob(f"{shared.scratch_folder(spark)}/cleared-*")
    shared.clear_scratch(spark)
    assert not glob.glob(f"{shared.scratch_folder(spark)}/*")
