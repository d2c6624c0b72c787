"""Removal of repeated text: ranks of ever longer strings, sorted by Spark, at the positions that still matter.

Plain prefix doubling ranks every byte position at each length: some 16 bytes for each byte of text and round, four times
what the disk limit allows in one round alone. So here positions stand for their neighbours, and unique ranks drop out at once:

1. Each 100-byte string has one anchor: the place of its least 50-byte hash (leftmost). Strings with one anchor start
   side by side, in a run. Equal strings have equal anchors at equal places, so a run whose anchor hash is
   unique repeats nothing and is dropped. These hashes only drop: what is left may still be unique.
2. Runs are ranked by (anchor, the bytes that the run covers), sorted by Spark. A run that is not the first of its
   rank repeats an earlier one wholly. The first is settled too, unless its anchor has other ranks.
3. The runs that are left are cut into cells of up to 13 starts at fixed distances from the anchor. All strings of a
   cell share 88 bytes; cells are ranked by (those, the bytes that the cell covers) and settled likewise.
4. The strings of the cells that are left are ranked by their 100 bytes; all but the first of a rank are repeats.

In steps 2 to 4 bytes are equal if their salted BLAKE2b digests of 128 bits are. The salt is drawn anew by each job, so no
text can be made to collide. Every byte is looked at; nothing is sampled. Copies within a batch are merged before they are sorted.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, placed, require, text_batches, whole_text

LENGTH, HALF = 100, 50
#: Hashes in a string: its anchor is the least of them.
SPAN = LENGTH - HALF + 1
#: Starts in a cell, and the bytes that all strings of a cell share.
CELL = 13
CORE = LENGTH - CELL + 1
#: Strings of a text that are hashed at once; runs end at the cuts, which moves work to later steps and changes no result.
SEGMENT = 1 << 18
#: Ranked rows that are merged at once, and the groups that known repeats of one anchor are spread over.
MERGED, SALTS = 200_000, 256

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SEGMENT + LENGTH
    up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
    down = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * _powers()[0][: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Of all strings of ``length`` bytes."""
    n = len(sums) - length
    return _mixed((sums[length:] - sums[:-length]) * _powers()[1][:n])


def _segments(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    n = len(data) - LENGTH + 1
    for at in range(0, n, SEGMENT):
        yield at, np.frombuffer(data, np.uint8, min(SEGMENT + LENGTH - 1, len(data) - at), at)


#: A run or cell as one number: first start, distance from there to the anchor (12 bits hold that and the count), count, and whether it repeats.
def pack(start, to_anchor, count, repeats=0):
    return start << 13 | to_anchor << 7 | count << 1 | repeats


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, distance to the anchor, count)."""
    return packed >> 13, packed >> 7 & 63, packed >> 1 & 63


def anchor_runs(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash of the anchor, packed run) of each run, by segment."""
    out = []
    for at, part in _segments(data):
        low = _hashes(_sums(part), HALF)
        first, where = low, np.arange(len(low))
        span = 1
        while span < SPAN:
            step = min(span, SPAN - span)
            right = low[step:] < low[:-step]
            where = np.where(right, where[step:], where[:-step])
            low = np.minimum(low[step:], low[:-step])
            span += step
        starts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
        count = np.diff(np.append(starts, len(where)))
        anchor = where[starts]
        out.append((first[anchor], pack(starts + at, anchor - starts, count)))
    return out


#: Of the rows of a text: ranks, digests of the covered bytes (16 each, joined), packed runs.
Ranked = tuple[np.ndarray, bytes, np.ndarray]


def _ranked(data: bytes, salt: bytes, at: np.ndarray, length: int, seeds: np.ndarray, start: np.ndarray, stop: np.ndarray, runs: np.ndarray) -> Ranked:
    """Ranks are hashes of ``length`` bytes at ``at``; they only tell which rows to look at together."""
    ranks = [xxhash.xxh64_intdigest(data[a : a + length], k) for a, k in zip(at.tolist(), seeds.tolist(), strict=True)]
    digests = [blake2b(data[a:b], digest_size=16, salt=salt).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
    return np.array(ranks, np.uint64).view(np.int64), b"".join(digests), runs


def ranked_runs(data: bytes, runs: np.ndarray, salt: bytes) -> Ranked:
    """Step 2: runs of a text, by their anchors."""
    start, far, count = unpack(runs)
    return _ranked(data, salt, start + far, HALF, np.zeros_like(start), start, start + count + LENGTH - 1, runs)


def ranked_cells(data: bytes, runs: np.ndarray, salt: bytes) -> Ranked:
    """Step 3: cells of runs."""
    start, far, count = unpack(runs)
    low, high = (far - count + 1) // CELL, far // CELL
    n = high - low + 1
    r = np.repeat(np.arange(len(n)), n)
    cell = high[r] - (np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n))
    anchor = start[r] + far[r]
    core = anchor - cell * CELL
    x, end = np.maximum(start[r], core - CELL + 1), np.minimum(start[r] + count[r], core + 1)
    return _ranked(data, salt, core, CORE, cell, x, end + LENGTH - 1, pack(x, anchor - x, end - x))


def ranked_strings(data: bytes, cells: np.ndarray, salt: bytes) -> Ranked:
    """Step 4: strings of cells."""
    start, _, count = unpack(cells)
    x = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return _ranked(data, salt, x, LENGTH, np.zeros_like(x), x, x + LENGTH, pack(x, 0, 1))


def spans_of(n: int, starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered spans, for runs of strings; touching ones are one."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + counts + LENGTH - 1, 1)
    on = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]])
    turns = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


RANKED = "rank long, one long, two long, _doc long, _tie int, run long, more_docs array<long>, more_ties array<int>, more_runs array<long>, done array<long>"


def gathered(texts: Iterable[tuple[int, int, Ranked, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """RANKED frames of (doc, tie, ranked rows, known repeats) of texts. Rows of one rank and digest are one row: the first place, with the others, which repeat it, in its lists."""

    def frame(parts: list, done: list) -> pd.DataFrame:
        sizes = [len(p[2][2]) for p in parts]
        rank, run = (np.concatenate([p[2][k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 2))
        digest = np.frombuffer(b"".join(p[2][1] for p in parts), np.int64).reshape(-1, 2)
        docs, ties = (np.repeat(np.array([p[k] for p in parts], kind), sizes) for k, kind in ((0, np.int64), (1, np.int32)))
        order = np.lexsort((run, ties, docs, digest[:, 1], digest[:, 0], rank))
        rank, run, docs, ties, one, two = (x[order] for x in (rank, run, docs, ties, digest[:, 0], digest[:, 1]))
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(rank))
        more = {name: [None] * (len(first) + len(done)) for name in ("more_docs", "more_ties", "more_runs")}
        odd = run | 1
        for k in np.flatnonzero(stop - first > 1).tolist():
            for name, values in (("more_docs", docs), ("more_ties", ties), ("more_runs", odd)):
                more[name][k] = values[first[k] + 1 : stop[k]]
        end = np.array([(d, t) for d, t, _ in done], np.int64).reshape(-1, 2)
        zero = np.zeros(len(done), np.int64)
        # Known repeats are spread by their documents.
        columns = {"rank": np.append(rank[first], end[:, 0] * np.int64(0x5851F42D4C957F2D)), "one": np.append(one[first], zero), "two": np.append(two[first], zero)}
        columns |= {"_doc": np.append(docs[first], end[:, 0]), "_tie": np.append(ties[first], end[:, 1]).astype(np.int32), "run": np.append(run[first], zero + 1)}
        return pd.DataFrame({**columns, **more, "done": [None] * len(first) + [runs for _, _, runs in done]})

    parts: list = []
    done: list = []
    size = 0
    for doc, tie, rows, repeats in texts:
        if len(repeats):
            done.append((doc, tie, repeats))
        if len(rows[2]):
            parts.append((doc, tie, rows))
        size += len(rows[2]) + len(repeats)
        if size >= MERGED:
            yield frame(parts, done)
            parts, done, size = [], [], 0
    if parts or done:
        yield frame(parts, done)


def settled(ranked: DataFrame) -> DataFrame:
    """Of RANKED rows, by text: packed runs that repeat an earlier one (odd), and those that another step must judge (even)."""
    kind = "array<struct<_doc: bigint, _tie: int, run: bigint>>"
    place = F.struct("_doc", "_tie", "run")
    by_pair = Window.partitionBy("rank", "one", "two").orderBy("_doc", "_tie", "run")
    by_rank = Window.partitionBy("rank")
    known = F.col("done").isNotNull()
    differ = [F.min(F.when(~known, F.col(c))).over(by_rank) != F.max(F.when(~known, F.col(c))).over(by_rank) for c in ("one", "two")]
    # The wider groups come first, so that their exchange serves both.
    judged = (
        ranked.withColumn("others", differ[0] | differ[1])
        .withColumn("first", F.first(place).over(by_pair))
        .withColumn("repeats", place != F.col("first"))
        .where("repeats or others or more_runs is not null or done is not null")
    )
    own = F.when(~known & (F.col("repeats") | F.col("others")), F.array(F.struct("_doc", "_tie", (F.col("run") + F.col("repeats").cast("long")).alias("run"))))
    more = F.arrays_zip("more_docs", "more_ties", "more_runs").cast(kind)
    done = F.transform("done", lambda r: F.struct(F.col("_doc"), F.col("_tie"), r.alias("run"))).cast(kind)
    none = F.array().cast(kind)
    every = judged.select(F.explode(F.concat(*[F.coalesce(c, none) for c in (own, more, done)])).alias("r")).select("r.*")
    return every.groupBy("_doc", "_tie").agg(F.collect_set("run").alias("_runs"))


def next_step(texts: DataFrame, runs: DataFrame, cut: Callable[[bytes, np.ndarray, bytes], Ranked], salt: bytes) -> DataFrame:
    """(_doc, _tie, _runs) after one more step: even runs are cut and ranked anew, odd ones are passed on."""

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["_doc"].tolist(), b["_tie"].tolist(), b["_text"], b["_runs"], strict=True)
            yield from gathered((doc, tie, cut(_bytes(text), np.sort(runs[runs % 2 == 0]), salt), runs[runs % 2 == 1]) for doc, tie, text, runs in rows)

    known = texts.join(runs, ["_doc", "_tie"]).select("_doc", "_tie", "_text", "_runs")
    return settled(known.mapInPandas(ranked, RANKED))


def surviving_runs(texts: DataFrame) -> DataFrame:
    """Step 1 for ``(_doc, _tie, _text)``: (_doc, _tie, _runs), the runs whose anchor hash occurs again.

    Of runs that share an anchor within a batch only the first is counted against other batches; the others are known to repeat
    and are spread, so a very common anchor has no more rows in one group than there are batches.
    """

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(doc, tie, *run) for doc, tie, text in zip(b["_doc"], b["_tie"], b["_text"], strict=True) for run in anchor_runs(_bytes(text))]
            if not parts:
                continue
            hashes, run = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
            sizes = [len(p[2]) for p in parts]
            order = np.argsort(hashes, kind="stable")
            new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
            alone = new & np.append(new[1:], True)
            kind = np.empty(len(order), np.int32)
            kind[order] = np.where(alone, 0, np.where(new, 1, 2))
            yield pd.DataFrame({"hash": hashes.view(np.int64), "kind": kind, "_doc": np.repeat([p[0] for p in parts], sizes), "_tie": np.repeat([p[1] for p in parts], sizes).astype(np.int32), "run": run})

    rows = texts.mapInPandas(anchors, "hash long, kind int, _doc long, _tie int, run long")
    salt = F.when(F.col("kind") == 2, F.pmod(F.xxhash64("_doc", "run"), F.lit(SALTS)) + 1).otherwise(0)
    n = F.count(F.lit(1)).over(Window.partitionBy("hash", salt))
    return rows.withColumn("n", n).where("kind > 0 or n > 1").groupBy("_doc", "_tie").agg(F.collect_set("run").alias("_runs"))


def numbered(texts: DataFrame) -> DataFrame:
    """(_id, _text) with ``_doc``, a number for each different text of each id in their order, and ``_copy``, true for all but one of wholly repeated rows.

    Different texts of an id are told apart by SHA-256 and ordered by a hash, then by that digest; numbers come from ranges of this order, so an id with any number
    of texts is split. Partial minima leave no hot key.
    """
    texts = materialize(texts.withColumns({"_hash": F.xxhash64("_text").bitwiseAND(F.lit(0x7FFFFFFF)), "_digest": F.unhex(F.sha2("_text", 256)), "_tag": F.monotonically_increasing_id()}), "repeat-input")
    firsts = texts.groupBy("_id", "_hash", "_digest").agg(F.min("_tag").alias("_first")).withColumn("_g", F.lit(0))
    order = placed(firsts, ["_id", "_hash", "_digest"]).select("_id", "_digest", "_first", F.col("_i").alias("_doc"))
    known = texts.join(materialize(order, "repeat-firsts"), ["_id", "_digest"])
    return materialize(known.select("_id", "_text", "_doc", (F.col("_tag") > F.col("_first")).alias("_copy")), "repeat-tagged")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, ``n_bytes``, ``spans`` (removed, start and stop in UTF-8 bytes) and ``kept`` (the remaining bytes).

    A byte goes if a 100-byte string over it also starts earlier: in a document of smaller id or earlier in the same
    one. Strings never cross documents and are judged on the input. Null texts are empty; null ids come first. Different texts of one id,
    or of none, are ordered by a hash and then a digest; of wholly repeated rows one is judged as if it were alone, and the others repeat it. Kept bytes may end within a
    character. Texts may be of any length. Other columns aren't read. An empty table gives an empty result.
    """
    require(docs, [id_col, text_col])
    text_batches(docs.sparkSession)
    text = whole_text(text_col)
    no_id = F.lit(-(2**63))
    doc = F.coalesce(F.col(id_col).cast("long"), no_id)
    unique = docs.groupBy(doc.alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # Zero, but no literal, which would drop out of the join and deal groups by document and tie a second time.
    zero = lambda c: F.coalesce(F.pmod(c, F.lit(1)), F.lit(0)).cast("int")  # noqa: E731  never null, so all joins read the texts alike
    texts = docs.select(doc.alias("_doc"), zero(doc).alias("_tie"), text.alias("_text")) if unique else numbered(docs.select(doc.alias("_id"), text.alias("_text"))).withColumn("_tie", zero(F.col("_doc")))
    copy = F.lit(False) if unique else F.col("_copy")
    runs = materialize(surviving_runs((texts if unique else texts.where("not _copy")).select("_doc", "_tie", "_text")), "runs")
    salt = os.urandom(blake2b.SALT_SIZE)
    # The texts are moved once: the plan reads this exchange again for each join.
    for cut_further in (ranked_runs, ranked_cells, ranked_strings):
        runs = next_step(texts, runs, cut_further, salt)
    judged = texts.join(runs, ["_doc", "_tie"], "left")

    @F.pandas_udf("spans array<struct<start: long, stop: long>>, kept binary")
    def cut(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, runs, copies in parts:
            spans, kept = [], []
            for text, packed, copy in zip(texts, runs, copies, strict=True):
                data = _bytes(text)
                if copy and len(data) >= LENGTH:
                    own = [(0, len(data))]
                elif packed is not None:
                    start, _, count = unpack(packed)
                    own = spans_of(len(data), start, count)
                else:
                    own = []
                at, rest = 0, []
                for a, b in own:
                    rest.append(data[at:a])
                    at = b
                spans.append([{"start": a, "stop": b} for a, b in own])
                kept.append(b"".join([*rest, data[at:]]))
            yield pd.DataFrame({"spans": spans, "kept": kept})

    done = judged.withColumn("_cut", cut("_text", "_runs", copy))
    # Where ids are numbers of texts already, all joins need the same columns of them, so that the texts are moved once.
    given = F.col("_doc" if unique else "_id")
    own_id = F.when(given != no_id, given).cast(docs.schema[id_col].dataType)
    return done.select(own_id.alias(id_col), F.octet_length("_text").cast("long").alias("n_bytes"), "_cut.spans", "_cut.kept")


def op8_repeated_text(spark, sf_dir: str) -> DataFrame:
    """Every document's numbers of bytes and the digest of what is left; null, empty, long and repeated rows as in :func:`remove_repeats`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
