"""The corpus pipeline: quality filter, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
into the shared folder and reads again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.decontaminate import drop_contaminated
from cairn.llm.exact_dedup import drop_exact_copies
from cairn.llm.near_copies import drop_similar
from cairn.llm.packing import digest_pieces, pack
from cairn.llm.quality import keep_good
from cairn.llm.shared import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least a half stay.

    A null text is scored as an empty one, a text of any length whole. Rows of null or repeated ids are scored by their texts and go or stay each by itself; a label of
    a repeated id counts for each of its rows. Repeated rows and ties go or stay together. Further columns stay. An empty table stays empty.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) that with the largest id stays.

    A null text equals an empty one; texts of any length are compared whole. Null ids are the smallest; of rows of one text and id one stays. Further columns stay. An empty table stays empty.
    """
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard of 0.8 or more) that with the smallest id stays.

    Null and empty texts are near copies of each other, texts of fewer than five words of equal ones; texts of any length are compared whole. Null ids are the largest; of
    repeated ids and rows any one stays. Further columns stay. An empty table stays empty.
    """
    return drop_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those of which a twentieth of the words or more lies in windows of 13 words of a benchmark item.

    Null and empty texts have no words and stay. Texts of any length are searched whole. Rows of null or repeated ids are judged by their texts, repeated rows alike.
    Further columns stay. An empty table stays empty; an empty benchmark lets everything stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null or empty text is its end id alone; a text of any length is cut into as many pieces as it needs. Rows of null or repeated ids, and repeated rows, are packed as often as
    they occur; a null source is a source of its own. Other columns aren't read. An empty table gives no pieces.
    """
    return digest_pieces(pack(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
