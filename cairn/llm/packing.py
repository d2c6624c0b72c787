"""Mixture-controlled packing: deficit round-robin over source queues, window by window.

Each source is a queue of tokens. A window (a sequence of 4096 tokens) takes from every queue its share of the target;
what a share is short of a whole token is carried to the next windows. The carry has a closed form: in a phase
of n windows in which queue s gives A(s) tokens, floor(k A(s) / n) of them are in the first k windows, for each s
but the largest, which fills the windows up. So any task knows the deficits at any window, and windows
are filled on all partitions at once.

Tasks number the tokens of each source while they tokenize; what they exchange is one sum for each task and source. Documents stay
where they are while the table of those sums is small enough for Spark to broadcast it, else they are joined to it by task and source.

The sources of most tokens have a queue each, as many as a window can hold a few tokens of. All others share the last queue, in which they are interleaved in parts of TAIL_PART tokens: a part's
place is the share of its source that comes before it, so any stretch of the queue holds each of them in its proportion, to a part, however long the documents are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, require, text_batches
from .tokens import encode_in_parts, public_tokenizer_path

WINDOW, END_ID = 4096, 2
#: Queues: the sources of most tokens have one each, all further sources are interleaved in the last one. Sources that a target names always have one.
MAX_QUEUES, TAIL_PART = 1024, 64
#: Tokens of a bucket of the shared queue aimed at; buckets are summed up in parallel.
BUCKET_TOKENS = 4_000_000
#: Window edges, of all queues together, that are computed at once.
EDGES = 1 << 18


@dataclass(frozen=True)
class Phase:
    """``windows`` windows from ``first`` on; by queue the offset at which they begin and the tokens they take."""

    first: int
    windows: int
    tokens: int
    begin: tuple[int, ...]
    take: tuple[int, ...]

    def edges(self, k: np.ndarray) -> np.ndarray:
        """For each number ``k`` of windows the tokens taken, one column for each queue."""
        take = np.array(self.take, np.int64)
        if int(take.max()) * self.windows < 1 << 62:
            taken = k[:, None] * take // self.windows
        else:
            taken = np.array([[int(x) * t // self.windows for t in self.take] for x in k], np.int64)
        filler = int(take.argmax())
        taken[:, filler] += k * self.tokens - taken.sum(1)
        return taken


def share_out(total: int, weights: list[float], most: list[int]) -> list[int]:
    """Whole numbers that sum up to ``total``, as near to the weights as ``most`` lets them."""
    left, out = total, [0] * len(weights)
    while left:
        open_ = [s for s in range(len(out)) if out[s] < most[s]]
        w = sum(weights[s] for s in open_)
        parts = {s: min(most[s] - out[s], int(left * weights[s] / w) if w else 0) for s in open_}
        if not any(parts.values()):
            for s in sorted(open_, key=lambda s: -weights[s])[:left]:
                out[s] += 1
                left -= 1
            continue
        for s, n in parts.items():
            out[s] += n
            left -= n
    return out


def phases(totals: list[int], target: list[float] | None = None, window: int = WINDOW) -> list[Phase]:
    """How all tokens are dealt to windows. Without a target, in proportion to the queues.

    Window 0 alone may be short. With a target, a phase ends when a queue runs low; its rest is dealt out in the next
    window and the others go on in the target's proportions.
    """
    total, n_queues = sum(totals), len(totals)
    weights = [float(t) for t in totals] if target is None else [float(w) for w in target]
    done: list[Phase] = []
    at, rest, first = [0] * n_queues, list(totals), 0

    def add(windows: int, tokens: int, take: list[int]) -> None:
        nonlocal first
        done.append(Phase(first, windows, tokens, tuple(at), tuple(take)))
        first += windows
        for s, n in enumerate(take):
            at[s] += n
            rest[s] -= n

    if total % window:
        add(1, total % window, share_out(total % window, weights, rest))
    if target is None and sum(rest):
        add(sum(rest) // window, window, list(rest))
    while sum(rest):
        live = [s for s in range(n_queues) if rest[s] and weights[s] > 0] or [s for s in range(n_queues) if rest[s]]
        w = sum(weights[s] for s in live)
        share = {s: (weights[s] / w if w else 1 / len(live)) * window for s in live}
        n = min(int(rest[s] / share[s]) for s in live) if w else 0
        if n >= 1:
            add(n, window, share_out(n * window, [weights[s] if s in share else 0.0 for s in range(n_queues)], [min(r, int(share[s] * n) + 1) if s in share else 0 for s, r in enumerate(rest)]))
        else:
            low = {s for s in live if rest[s] < share[s]} if w else set()
            owed = [min(rest[s], window) if s in low else 0 for s in range(n_queues)]
            if sum(owed) > window:
                owed = share_out(window, [float(x) for x in owed], owed)
            more = share_out(window - sum(owed), weights, [r - o for r, o in zip(rest, owed, strict=True)])
            add(1, window, [a + b for a, b in zip(owed, more, strict=True)])
    return done


def near_windows(doc: np.ndarray, a: np.ndarray, b: np.ndarray, queues: np.ndarray, phase: Phase) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) pairs in order, all windows of the phase among them that hold tokens ``a`` to ``b`` of the queues.

    Edges are less than a token from their shares, those of the filler less than one for each queue. Where a queue gives
    less than a token to a window, only windows near each token's are listed: many windows in between hold none.
    """
    share = np.array(phase.take)[queues] / phase.windows
    slack = np.where(queues == int(np.argmax(phase.take)), len(phase.take) / share, 1 / share).astype(np.int64) + 2
    thin = (share < 1) & (slack < phase.windows) & (queues != int(np.argmax(phase.take)))
    low, high = np.maximum(0, (a / share).astype(np.int64) - slack), np.minimum(phase.windows, (b / share).astype(np.int64) + slack)
    # A thin queue's token j is in the window whose number is just below (j + 1) / share.
    first, sizes = np.where(thin, a, low), np.where(thin, b - a, high - low)
    at = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    doc, thin, share = np.repeat(doc, sizes), np.repeat(thin, sizes), np.repeat(share, sizes)
    wide = ~thin
    about = ((at[thin] + 1) / share[thin]).astype(np.int64)[:, None] + np.arange(-2, 2)
    near = np.column_stack([np.repeat(doc[thin], 4), np.clip(about, 0, phase.windows - 1).ravel()])
    pairs = np.concatenate([np.column_stack([doc[wide], at[wide]]), np.unique(near, axis=0)])
    return pairs[:, 0], pairs[:, 1]


def cut_pieces(queues: np.ndarray, starts: np.ndarray, counts: np.ndarray, plan: list[Phase]) -> list[np.ndarray]:
    """For each document of so many tokens at its start in its queue, its pieces one after another: offset in the document, length, window, offset in the window."""
    owners, found = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
    for p in plan:
        begin, take = np.array(p.begin, np.int64)[queues], np.array(p.take, np.int64)[queues]
        a, b = np.maximum(starts, begin), np.minimum(starts + counts, begin + take)
        on = np.flatnonzero(a < b)
        if not len(on):
            continue
        doc, k = near_windows(on, (a - begin)[on], (b - begin)[on], queues[on], p)
        left, right, before = (np.empty(len(k), np.int64) for _ in range(3))
        step = max(1, EDGES // len(p.take))
        for i in range(0, len(k), step):
            at, q = slice(i, i + step), queues[doc[i : i + step], None]
            low, high = p.edges(k[at]), p.edges(k[at] + 1)
            left[at], right[at] = (np.take_along_axis(e, q, 1)[:, 0] for e in (low, high))
            taken = high - low
            before[at] = np.take_along_axis(taken.cumsum(1) - taken, q, 1)[:, 0]
        left, right = left + begin[doc], right + begin[doc]
        hit = np.flatnonzero((right > a[doc]) & (left < b[doc]) & (right > left))
        d, left, right = doc[hit], left[hit], right[hit]
        x, y = np.maximum(a[d], left), np.minimum(b[d], right)
        owners.append(d)
        found.append(np.column_stack([x - starts[d], y - x, p.first + k[hit], before[hit] + x - left]))
    owner, flat = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(queues)))
    return [rows.ravel() for rows in np.split(flat[order], ends[:-1])][: len(queues)]


def pieces(queue: int, start: int, n: int, plan: list[Phase]) -> Iterator[tuple[int, ...]]:
    """:func:`cut_pieces` of one document."""
    (flat,) = cut_pieces(np.array([queue]), np.array([start]), np.array([n]), plan)
    yield from map(tuple, flat.reshape(-1, 4).tolist())


def tokenize(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, end_id: int) -> DataFrame:
    """(id, source, ids, n, task, at) in a scratch table; ids are little-endian unsigned 32-bit numbers, ``at`` counts the ids of the source before it in its task."""

    @F.pandas_udf("ids binary, at long")
    def encode(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        end, seen = np.array([end_id], "<u4").tobytes(), defaultdict(int)
        for texts, sources in parts:
            ids, at = [b + end for b in encode_in_parts(path, texts.tolist())], []
            for source, b in zip(sources.tolist(), ids, strict=True):
                at.append(seen[source])
                seen[source] += len(b) // 4
            yield pd.DataFrame({"ids": ids, "at": at})

    source = F.col(source_col)
    rows = docs.select(F.col(id_col).alias("_id"), source.alias("_source"), encode(text_col, source.cast("string")).alias("_e"), F.spark_partition_id().alias("_task"))
    rows = rows.select("_id", "_source", F.col("_e.ids").alias("_ids"), F.col("_e.at").alias("_at"), "_task")
    return materialize(rows.withColumn("_n", (F.octet_length("_ids") / 4).cast("long")), "packing-tokens")


def in_parts(tail: DataFrame) -> DataFrame:
    """Documents as parts of TAIL_PART ids at most, each with its own ids, ``_from`` in its document, ``_part`` ids and ``_place`` in its source."""

    def part(k: Column) -> Column:
        start = k * TAIL_PART
        n = F.least(F.col("_n") - start, F.lit(TAIL_PART).cast("long"))
        return F.struct(start.alias("_from"), n.alias("_part"), F.col("_ids").substr((4 * start + 1).cast("int"), (4 * n).cast("int")).alias("_ids"))

    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / TAIL_PART)), part)
    rows = tail.withColumn("_p", F.explode(parts)).drop("_ids", "_from", "_part")
    return rows.select("*", "_p.*").drop("_p").withColumn("_place", F.col("_place") + F.col("_from"))


def interleaved(tail: DataFrame, total: int) -> DataFrame:
    """``tail`` with ``_start`` in the shared queue. Rows have ``_place`` and ``_all``: ids of the source before it, and in all."""
    # The hash keeps sources of one part apart, which would all be in the middle.
    jitter = F.pmod(F.xxhash64("_source"), F.lit(1 << 20)) / (1 << 20)
    share = (F.col("_place") + jitter * F.col("_part")) / F.col("_all")
    buckets = max(1, -(-total // BUCKET_TOKENS))
    tail = tail.withColumn("_share", share).withColumn("_bucket", F.least(F.floor(F.col("_share") * buckets), F.lit(buckets - 1)).cast("int"))
    earlier = Window.unboundedPreceding, -1
    sums = tail.groupBy("_bucket").agg(F.sum("_part").alias("t"))  # a row for each BUCKET_TOKENS ids
    sums = sums.select("_bucket", F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(*earlier)), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_bucket").orderBy("_share", "_source", "_task", "_at", "_from").rowsBetween(*earlier)
    return tail.withColumn("_inner", F.coalesce(F.sum("_part").over(inner), F.lit(0))).join(sums, "_bucket").withColumn("_start", F.col("_base") + F.col("_inner"))


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW, target: dict[str, float] | None = None,
) -> DataFrame:
    """One row for each piece of a document: the id, ``source``, ``doc_tokens``, ``start``, ``length``, ``ids`` (32-bit little-endian), ``sequence_id``, ``offset``.

    All tokens of all documents are dealt to windows 0, 1, ...; all but window 0 are full. Without a ``target`` (weights by
    source) windows keep the proportions of the whole table. A null or empty text is its end id alone; a text of any length is cut into as many pieces as
    it needs. A null source is a source of its own. Each source of the target has a queue; sources it doesn't name follow when those have run out. Repeated
    rows, null and repeated ids are packed as often as they occur. Other columns aren't read. An empty table gives an empty result.
    """
    require(docs, [id_col, text_col, source_col])
    text_batches(docs.sparkSession, 500)
    rows = tokenize(docs, id_col, text_col, source_col, tokenizer or public_tokenizer_path(), end_id)
    sums = rows.groupBy("_task", "_source").agg(F.sum("_n").alias("t"))
    by_source, earlier = Window.partitionBy("_source"), Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_task", "_source", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_before"), F.sum("t").over(by_source).alias("_all"))
    sums = materialize(sums, "packing-sums")

    named = [s for s in target or () if s is not None]
    is_named = F.when(F.col("_source").isNull(), F.lit(None in (target or ()))).otherwise(F.col("_source").isin(named))
    sources = sums.groupBy("_source").agg(F.first("_all").alias("t"))
    total = sources.agg(F.sum("t").alias("t")).first()["t"] or 0
    top = [(r["_source"], r["t"]) for r in sources.orderBy(F.desc(is_named), F.desc("t"), "_source").limit(max(MAX_QUEUES - 1, len(target or ()))).collect()]
    totals = [t for _, t in top] + [total - sum(t for _, t in top)]
    weights = None
    if target is not None:
        weights = [target.get(s, 0.0) for s, _ in top] + [0.0]
    plan = phases(totals, weights, window)

    number = {s: i for i, (s, _) in enumerate(top)}
    known = [F.lit(x) for s, i in number.items() if s is not None for x in (s, i)]
    queue = F.coalesce(F.try_element_at(F.create_map(*known), F.col("_source")), F.lit(len(top))) if known else F.lit(len(top))
    queue = F.when(F.col("_source").isNull(), number.get(None, len(top))).otherwise(queue)
    same = (F.col("r._task") == F.col("s._task")) & F.col("r._source").eqNullSafe(F.col("s._source"))
    rows = rows.alias("r").join(sums.alias("s"), same).select("r.*", (F.col("_before") + F.col("_at")).alias("_place"), "_all").withColumns({"_queue": queue.cast("int"), "_from": F.lit(0).cast("long"), "_part": F.col("_n")})
    placed = rows.where(F.col("_queue") < len(top)).withColumn("_start", F.col("_place"))
    if totals[-1]:
        placed = placed.unionByName(interleaved(in_parts(rows.where(F.col("_queue") == len(top))), totals[-1]).select(placed.columns))

    @F.pandas_udf("array<long>")
    def cut(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(cut_pieces(*(c.to_numpy(np.int64) for c in part), plan))

    # Every document has a piece at least, for its end id. Explode and the cutting of ids compile into one loop, which reads a document's ids once.
    placed = placed.withColumn("_cut", cut("_queue", "_start", "_part"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), (F.size("_cut") / 4).cast("int") - 1)).alias("_i"))
    start, length, sequence, offset = (F.get("_cut", 4 * F.col("_i") + k) for k in range(4))
    ids = F.col("_ids").substr((4 * start + 1).cast("int"), (4 * length).cast("int"))
    return placed.select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_n").alias("doc_tokens"),
        (F.col("_from") + start).alias("start"), length.alias("length"), ids.alias("ids"), sequence.alias("sequence_id"), offset.alias("offset"),
    )


def digest_pieces(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in the table's own proportions; null, empty, long and repeated rows as in :func:`pack`."""
    return digest_pieces(pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")))
