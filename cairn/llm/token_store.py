"""Token-id output: documents compressed one by one with a shared zstandard dictionary.

The format is a folder of three Parquet tables. ``blocks`` holds the documents in ascending order of ids, file after file
and row after row. A block has the frames of its documents one after another (``blob``), the offset index to
them (``offsets``), their ids (``doc_ids``) and token counts, and the hash of the dictionary. ``index`` has
one row for each range (the blocks of one file): its first and last id and the ids of all ranges before it. ``dictionary`` is
a table of one row. A short document is read by its range in the index, its block's id range, its offset and one small frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import require, scratch_path, text_batches
from .tokens import encode_in_parts, public_tokenizer_path

END_ID, LEVEL = 1, 3
#: Bytes of frames in a block, at most (one frame may be longer), and its documents.
BLOCK_BYTES, BLOCK_DOCS = 256 << 10, 4096
#: The dictionary is trained on so many documents at most, those with the smallest hashes, of so many bytes of ids at most together.
DICTIONARY_DOCS, DICTIONARY_SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8 << 20, 64 << 10
#: Longer texts don't train the dictionary, which serves short documents; they are encoded like all others.
DICTIONARY_TEXT_BYTES = 8 << 10
#: Bytes of texts of a range aimed at; ranges are written in parallel, so many at most: beyond that they grow and sort on disk.
RANGE_BYTES, MAX_RANGES = 16 << 20, 100_000
#: Ranges whose token counts are summed up in one group.
INDEX_GROUP = 1024

BLOCK_SCHEMA = "range_no int, block_no int, first_id long, last_id long, doc_ids array<long>, null_ids int, offsets array<long>, n_tokens array<long>, first_start long, block_tokens long, dictionary_hash string, blob binary"


def train_dictionary(samples: list[bytes]) -> bytes:
    """From serialized id arrays; with too few samples for training the samples themselves are the dictionary."""
    kept, size = [], 0
    for s in samples:
        if s and size + len(s) <= DICTIONARY_SAMPLE_BYTES:
            kept.append(s)
            size += len(s)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, kept, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(kept)[:DICTIONARY_BYTES]


def dictionary_hash(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def ids_of(path: str, texts: list[str | None], end_id: int) -> Iterator[bytes]:
    end = np.array([end_id], "<u4").tobytes()
    for b in encode_in_parts(path, texts):
        yield b + end


class BlockWriter:
    """Gathers documents of one range in order and gives full blocks."""

    def __init__(self, raw_dictionary: bytes, range_no: int):
        self.hash, self.range_no = dictionary_hash(raw_dictionary), range_no
        data = zstandard.ZstdCompressionDict(raw_dictionary) if raw_dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        self.start = self.block_no = 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.frames, self.counts, self.size, self.first_start = [], [], [], 0, self.start

    def add(self, doc_id, raw: bytes) -> bool:
        """True if the block is full."""
        frame = self.compressor.compress(raw)
        self.ids.append(doc_id)
        self.frames.append(frame)
        self.counts.append(len(raw) // 4)
        self.size += len(frame)
        self.start += len(raw) // 4
        return self.size >= BLOCK_BYTES or len(self.ids) >= BLOCK_DOCS

    def block(self) -> dict:
        known = [i for i in self.ids if i is not None]
        row = {
            "range_no": self.range_no, "block_no": self.block_no, "first_id": known[0] if known else -(2**63), "last_id": known[-1] if known else -(2**63),
            "doc_ids": [i or 0 for i in self.ids], "null_ids": len(self.ids) - len(known),
            "offsets": np.concatenate([[0], np.cumsum([len(f) for f in self.frames])]).astype(np.int64).tolist(), "n_tokens": self.counts,
            "first_start": self.first_start, "block_tokens": sum(self.counts), "dictionary_hash": self.hash, "blob": b"".join(self.frames),
        }
        self.block_no += 1
        self.clear()
        return row


def dictionary_sample(rows: DataFrame, path: str, end_id: int) -> list[bytes]:
    """Ids of DICTIONARY_DOCS short texts at most: those of the smallest hashes of id and text; repeated rows count once."""

    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(ids_of(path, part.tolist(), end_id)))

    short = rows.where(F.octet_length("_text") <= DICTIONARY_TEXT_BYTES).select("_text", F.xxhash64("_id", "_text").alias("h"))
    least = [r["h"] for r in short.groupBy("h").agg(F.lit(1).alias("one")).orderBy("h").limit(DICTIONARY_DOCS).select("h").collect()]
    if not least:
        return []
    # Texts of DICTIONARY_TEXT_BYTES each: 16 MB on the driver at most.
    texts = short.where(F.col("h") <= least[-1]).groupBy("h").agg(F.first("_text").alias("_text"))
    return sorted(bytes(r["b"]) for r in texts.select(encode("_text").alias("b")).collect())


def write_tokens(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode whole texts and write them in ascending order of ids (nulls first; equal ids by a hash of their texts).

    Rows are dealt to ranges by a sort key of id, hash and row number, so rows without ids, or of one id, fill as many ranges as they
    need; rows that are wholly repeated are interchangeable. A text of any length is one frame. Null and empty texts are the end id alone. An
    empty table gives a store without blocks. Other columns of ``docs`` aren't read.
    """
    require(docs, [id_col, text_col])
    spark, path = docs.sparkSession, tokenizer or public_tokenizer_path()
    text_batches(spark, 1500)  # the more texts at once, the fewer words are looked up
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    raw = train_dictionary(dictionary_sample(rows, path, end_id))
    digest = dictionary_hash(raw)
    spark.createDataFrame([(digest, raw)], "dictionary_hash string, dictionary binary").write.parquet(f"{folder}/dictionary")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = BlockWriter(raw, TaskContext.get().partitionId())
        for batch in batches:
            full = []
            for doc_id, lost, ids in zip(batch["_id"], batch["_lost"], ids_of(path, batch["_text"].tolist(), end_id), strict=True):
                if writer.add(None if lost else int(doc_id), ids):
                    full.append(writer.block())
            if full:
                yield pd.DataFrame(full)
        if writer.ids:
            yield pd.DataFrame([writer.block()])

    size = rows.agg(F.sum(F.octet_length("_text").cast("long")), F.count(F.lit(1))).first()
    n = max(1, min(MAX_RANGES, -(-((size[0] or 0) + 64 * size[1]) // RANGE_BYTES)))
    lost = F.col("_id").isNull()
    keyed = rows.select(lost.alias("_lost"), F.coalesce("_id", F.lit(0)).alias("_id"), "_text", F.xxhash64("_text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    order = [F.desc("_lost"), F.asc("_id"), F.asc("_h"), F.asc("_row")]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("_id", "_lost", "_text")
    dealt.mapInPandas(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")
    index_of(spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")).write.parquet(f"{folder}/index")


def index_of(blocks: DataFrame) -> DataFrame:
    """(range_no, first_id, last_id, before) of each range; sums of INDEX_GROUP ranges are added up first, so no task sorts all ranges."""
    ranges = blocks.groupBy("range_no").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("block_tokens").alias("t"))
    ranges = ranges.withColumn("g", F.floor(F.col("range_no") / INDEX_GROUP).cast("int"))
    earlier = Window.unboundedPreceding, -1
    groups = ranges.groupBy("g").agg(F.sum("t").alias("t"))
    groups = groups.select("g", F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("t").over(Window.partitionBy("g").orderBy("range_no").rowsBetween(*earlier)), F.lit(0))
    return ranges.withColumn("within", within).join(groups, "g").select("range_no", "first_id", "last_id", (F.col("base") + F.col("within")).alias("before"))


def read_tokens(spark: SparkSession, folder: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of those of one id; ``start`` counts the ids of all documents before it."""
    (head,) = spark.read.parquet(f"{folder}/dictionary").collect()
    raw = bytes(head["dictionary"])
    if dictionary_hash(raw) != head["dictionary_hash"]:
        raise ValueError("the dictionary doesn't fit its hash")
    table = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    # A row for each RANGE_BYTES of texts. Its size is known: while it is small Spark broadcasts it and leaves the blocks where they are.
    index = spark.read.schema("range_no int, first_id long, last_id long, before long").parquet(f"{folder}/index")
    if doc_id is not None:
        holds = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
        table, index = table.where(holds), index.where(holds)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for batch in batches:
            for b in batch.itertuples():
                if b.dictionary_hash != head["dictionary_hash"]:
                    raise ValueError("a block was written with another dictionary")
                blob, at = b.blob, b.before + b.first_start
                out = []
                for k, (doc, n, lo, hi) in enumerate(zip(b.doc_ids, b.n_tokens, b.offsets, b.offsets[1:], strict=False)):
                    known = None if k < b.null_ids else int(doc)
                    if doc_id is None or known == doc_id:
                        out.append((known, at, n, tool.decompress(blob[lo:hi])))
                    at += n
                frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids"])
                yield frame.astype({"doc_id": "Int64"})

    wanted = table.join(index.select("range_no", "before"), "range_no").select("before", "first_start", "doc_ids", "null_ids", "offsets", "n_tokens", "dictionary_hash", "blob")
    return wanted.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    """Every document as read back from the store: its place, number and crc32 of ids. Null, empty, long and repeated texts as in :func:`write_tokens`."""
    folder = scratch_path(spark, "store")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
