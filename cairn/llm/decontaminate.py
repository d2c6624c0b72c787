"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. A table tells for the hash of each block of two words how far
the search may shift; at shift 0, the bucket of the block's hash (with the hash of the words before the block) names the windows that
may end there, and direct comparison of the words confirms them. Windows of equal length share a matcher.

Tables are arrays over the numbered words of the benchmark. They are broadcast, and hold BLOCK_BYTES of benchmark text;
a larger benchmark is searched in several passes, each a job of its own whose finds are written before the next begins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize, refuse, require, tagged, text_batches, whole_text

WINDOW = 13
#: Bytes of benchmark text that one set of tables holds: measured, tables take 6 to 8 times as much. An item is never split.
BLOCK_BYTES = 8 << 20
#: A document is contaminated if it has hits and at least one word in so many is hit.
ONE_IN = 20
#: Words that are searched at once.
CHUNK_WORDS = 1 << 17

#: Digits, letters and all bytes of other scripts are parts of words; A-Z become a-z; the rest is blank.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TIMES = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(1, WINDOW + 1)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _hash(words: np.ndarray) -> np.ndarray:
    """32 bits for each row of word numbers."""
    h = (words.astype(np.uint64) * _TIMES[: words.shape[1]]).sum(1, dtype=np.uint64)
    return ((h ^ (h >> np.uint64(29))) * _TIMES[0]) >> np.uint64(32)


@dataclass
class Matcher:
    """Wu-Manber tables for windows of ``length`` words; blocks are of two words (one, for windows of one word)."""

    length: int
    #: Word numbers of the items, one item after another.
    text: np.ndarray
    #: Shift by the low bits of a block's hash.
    shifts: np.ndarray
    #: Sorted: the hash of the last block and of the words before it. Beside it a window's place in ``text`` and where its items begin in ``items``.
    keys: np.ndarray
    places: np.ndarray
    first_item: np.ndarray
    items: np.ndarray

    @property
    def block(self) -> int:
        return min(2, self.length)

    @classmethod
    def of(cls, length: int, numbered: list[tuple[int, np.ndarray]]) -> Matcher:
        """For (item, word numbers) pairs of at least ``length`` words."""
        block = min(2, length)
        text = np.concatenate([w for _, w in numbered]).astype(np.int32)
        sizes = np.array([len(w) for _, w in numbered])
        counts = sizes - length + 1
        first = np.cumsum(counts) - counts
        starts = np.repeat(np.cumsum(sizes) - sizes - first, counts) + np.arange(counts.sum())
        owner = np.repeat(np.array([i for i, _ in numbered], np.int32), counts)
        hashes = _hash(np.lib.stride_tricks.sliding_window_view(text, block))
        shifts = np.full(1 << min(24, max(8, int(4 * len(text)).bit_length())), length - block + 1, np.uint8)
        slots = (hashes & np.uint64(len(shifts) - 1)).astype(np.int64)
        for to_end in range(length - block, -1, -1):  # the least shift of a slot is written last
            shifts[slots[starts + (length - block - to_end)]] = to_end
        keys = cls.key(text, starts, length, hashes)
        order = np.argsort(keys, kind="stable")
        keys, starts, owner = keys[order], starts[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        for k in range(length):
            new[1:] |= text[starts[1:] + k] != text[starts[:-1] + k]
        heads = np.flatnonzero(new)
        return cls(length, text, shifts, keys[heads], starts[heads].astype(np.int64), np.append(heads, len(keys)), owner)

    @staticmethod
    def key(text: np.ndarray, starts: np.ndarray, length: int, hashes: np.ndarray) -> np.ndarray:
        block = min(2, length)
        before = np.zeros(len(starts), np.uint64)
        if length > block:
            h = np.zeros(len(starts), np.uint64)
            for k in range(length - block):
                h += text[starts + k].astype(np.uint64) * _TIMES[k]
            before = ((h ^ (h >> np.uint64(29))) * _TIMES[0]) >> np.uint64(32)
        return hashes[starts + length - block] << np.uint64(32) | before

    def find(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(start, items) of each window that occurs."""
        m, b = self.length, self.block
        if len(words) < m:
            return
        hashes = _hash(np.lib.stride_tricks.sliding_window_view(words, b))
        shift = self.shifts[(hashes & np.uint64(len(self.shifts) - 1)).astype(np.int64)].tobytes()
        ends, at, stop = [], m - b, len(shift)
        while at < stop:
            if step := shift[at]:
                at += step
            else:
                ends.append(at)
                at += 1
        if not ends:
            return
        starts = np.array(ends) - (m - b)
        keys = self.key(words, starts, m, hashes)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        within = np.arange(m)
        # Windows of one key are the same but for collisions, so a second round is rare.
        while len(on := np.flatnonzero(low < high)):
            starts, low, high = starts[on], low[on], high[on]
            for at in range(0, len(on), CHUNK_WORDS):
                part, place = starts[at : at + CHUNK_WORDS], self.places[low[at : at + CHUNK_WORDS]]
                same = (words[part[:, None] + within] == self.text[place[:, None] + within]).all(1)
                for start, g in zip(part[same].tolist(), low[at : at + CHUNK_WORDS][same].tolist(), strict=True):
                    yield start, self.items[self.first_item[g] : self.first_item[g + 1]]
            low = low + 1


@dataclass
class Tables:
    """Word numbers (from 1 on; 0 is any other word), item ids, and a matcher for each length of windows."""

    numbers: dict[bytes, int]
    names: list
    matchers: list[Matcher]

    def search(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For each text its number of words, merged spans of hit words (start, stop), and the items found."""
        part: list[list[bytes]] = []
        size = 0
        for t in texts:
            part.append(words_of(t))
            size += len(part[-1])
            if size >= CHUNK_WORDS:
                yield from self._search(part)
                part, size = [], 0
        yield from self._search(part)

    def _search(self, texts: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        # A word that no window has stands between texts.
        sizes = np.array([len(w) + 1 for w in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        words = np.zeros(int(sizes.sum()), np.int32)
        for at, w in zip(begins.tolist(), texts, strict=True):
            words[at : at + len(w)] = list(map(self.numbers.get, w, repeat(0)))
        marks: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set] = {}
        first = begins.tolist()
        for matcher in self.matchers:
            for start, found in matcher.find(words):
                doc = bisect_right(first, start) - 1
                marks.setdefault(doc, []).append((start - first[doc], start - first[doc] + matcher.length))
                items.setdefault(doc, set()).update(found.tolist())
        for doc, w in enumerate(texts):
            yield len(w), merged(marks.get(doc, ())), {self.names[i] for i in items.get(doc, ())}


def merged(marks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; touching and overlapping ones are one."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans


def tables_of(items: Iterable[tuple]) -> Tables:
    """For (item, text) pairs: items of at least one word, of WINDOW words at a time."""
    numbers: dict[bytes, int] = {}
    names: list = []
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            row = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int32)
            by_length.setdefault(min(WINDOW, len(words)), []).append((len(names), row))
            names.append(item)
    return Tables(numbers, names, [Matcher.of(m, rows) for m, rows in by_length.items()])


RESULT = "n_words long, spans array<struct<start: long, stop: long>>, items array<string>"


def search_udf(spark, tables: Tables):
    """Column of texts to struct RESULT, for one block of the benchmark."""
    shared = spark.sparkContext.broadcast(tables)  # of bounded size: BLOCK_BYTES

    @F.pandas_udf(RESULT)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = list(shared.value.search(part))
            yield pd.DataFrame({
                "n_words": np.array([r[0] for r in rows], np.int64),
                "spans": [[{"start": a, "stop": b} for a, b in r[1]] for r in rows],
                "items": [sorted(str(i) for i in r[2] if i is not None) for r in rows],
            })

    return found


def union_udf():
    """Struct of n_words, spans and items of a text and of what all passes found in it."""

    @F.pandas_udf(RESULT)
    def united(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans, items in parts:
            own = [merged((x["start"], x["stop"]) for x in s) if s is not None else [] for s in spans]
            yield pd.DataFrame({
                "n_words": np.array([len(words_of(t)) for t in texts], np.int64),
                "spans": [[{"start": a, "stop": b} for a, b in s] for s in own],
                "items": [sorted(set(i)) if i is not None else [] for i in items],
            })

    return united


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(number of blocks, items) of each block of bounded size; the driver has one block at a time."""
    size = F.octet_length(whole_text(text_col))
    items = benchmark.where(size > 0).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"), size.alias("size"))
    total = items.agg(F.sum("size").alias("s")).first()["s"] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, ((r["item"], r["text"]) for r in part.toLocalIterator())


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit words, start and stop, merged), ``items`` (sorted ids as text) and ``contaminated``.

    No row is dropped, repeated rows and null ids are rows like any other, and texts may be of any length. Null and empty texts have no words and aren't
    contaminated. Repeated items count once; an item without an id hits words but is not listed. An empty benchmark hits nothing, and
    an empty table gives an empty result. Columns of ``docs`` with the names of the four results are refused.
    """
    require(docs, [text_col])
    require(benchmark, [item_col, item_text_col])
    refuse(docs.columns, ["n_words", "spans", "items", "contaminated"])
    text_batches(docs.sparkSession)
    names, found, row = docs.columns, free_name(docs, "_found"), free_name(docs, "_row")
    spark, hits = docs.sparkSession, []
    for n, block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        search = search_udf(spark, tables_of(block))(F.col(text_col))
        if n == 1:
            out = docs.withColumn(found, search)
            break
        if not hits:
            docs = tagged(docs, "contamination-input", row)
        hits.append(materialize(docs.select(F.col(row).alias("_r"), search.alias("f")).where(F.size("f.spans") > 0).select("_r", "f.spans", "f.items"), "contamination"))
    else:
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        # At most one row of each pass for a document.
        every = every.groupBy("_r").agg(F.flatten(F.collect_list("spans")).alias("_s"), F.flatten(F.collect_list("items")).alias("_i"))
        every = materialize(every, "contamination")
        out = docs.join(every, docs[row] == every["_r"], "left").withColumn(found, union_udf()(F.col(text_col), F.col("_s"), F.col("_i")))
    f = F.col(found)
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    own = [f["n_words"].alias("n_words"), f["spans"].alias("spans"), f["items"].alias("items"), ((n_hit > 0) & (ONE_IN * n_hit >= f["n_words"])).alias("contaminated")]
    return out.select(*[F.col(f"`{c}`") for c in names], *own)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``docs`` without contaminated rows; every column stays as it is, whatever its name. Nulls, empty and long texts, repeated rows: see :func:`find_contamination`."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(columns.get("text_col", "text")).alias("_text"))
    rest = {k: v for k, v in columns.items() if k != "text_col"}
    return find_contamination(packed, benchmark, text_col="_text", **rest).where(~F.col("contaminated")).select("_row.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Digest of what :func:`find_contamination` finds in every document; nulls, empty, long and repeated rows as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS m FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
ms AS (SELECT DISTINCT m FROM bs),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms)),
hit AS (SELECT doc_id, dwin.m, i, item_id FROM dwin JOIN win ON dwin.s = win.s AND dwin.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
