"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of three hashed embeddings, of the word and of its first four and five letters.
Filters of widths 1 to 3 slide over the vectors of the whole text, each keeps its maximum, and a
linear layer gives the score. It is trained in numpy on a bounded sample of labelled texts. The
threshold is calibrated for each language, which is told from common words of the text itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, materialize, require, text_batches

#: Labelled texts in training and calibration, at most, for each class: those with the smallest hashes.
MAX_PER_CLASS = 4000
#: Bytes of their texts for each class, at most; a text that doesn't fit any more is left out whole.
MAX_CLASS_BYTES = 16 << 20
BUCKET_BITS, DIM, WIDTHS, FILTERS = 15, 12, (1, 2, 3), 12
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 5, 1000, 32, 0.01, 1e-3
#: A language needs this many texts of either class in the calibration to get a threshold of its own.
LEAST_FOR_LANGUAGE = 25
#: The score at a language's threshold.
AT_THRESHOLD = 0.7
#: Words of a text that are scored at once; windows across the cuts are kept.
BLOCK = 1 << 16
#: Some of the commonest words of each language.
COMMON_WORDS = (
    "the of and to that is was for with this are on it be as by",
    "der die das und den dem von zu ist nicht ein eine mit sich des auf für als auch im",
    "le les des et du une est que qui dans pour pas sur avec au plus elle la",
    "el los las y por una del para con no se su lo como más la que",
)
_VOTES = {w: i for i, words in reversed(list(enumerate(COMMON_WORDS, 1))) for w in words.split()}
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»…“”‘’–—"
#: Bucket 0 is padding: its vector stays zero.
_MASK = (1 << BUCKET_BITS) - 1


def buckets(packed: np.ndarray) -> list[np.ndarray]:
    """The three buckets of each word."""
    return [(packed >> shift) & 0xFFFF for shift in (0, 16, 32)]


class _Words(dict):
    """Word to packed (buckets of the word and of its beginnings, language); grows to a bound and starts anew."""

    def __missing__(self, word: str) -> int:
        w = word.strip(_STRIP) or word
        data = w.encode("utf-8", "surrogatepass")
        whole = zlib.crc32(data) % _MASK + 1
        four, five = (zlib.crc32(b"^" + w[:n].encode("utf-8", "surrogatepass")) % _MASK + 1 for n in (4, 5))
        if len(self) > 400_000:
            self.clear()
        self[word] = packed = whole | four << 16 | five << 32 | _VOTES.get(w, 0) << 48
        return packed


_words = _Words()


def encode(text: str | None) -> np.ndarray:
    """Packed words of a whole text."""
    words = (text or "").lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words))


def language(packed: np.ndarray) -> int:
    """0 (unknown) to 4."""
    votes = np.bincount(packed >> 48, minlength=5)
    votes[0] = 0
    return int(votes.argmax())


@dataclass
class ConvNet:
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    #: By language: the raw score at the threshold; index 0 holds for all others.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(5))

    @classmethod
    def fresh(cls, seed: int) -> ConvNet:
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.02, (1 << BUCKET_BITS, DIM)).astype(np.float32)
        e[0] = 0
        kernels = [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(e, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32), -2.0)

    def responses(self, packed: np.ndarray) -> list[np.ndarray]:
        """Filter values at each word, for each width; the text is followed by padding."""
        pad = np.zeros(max(WIDTHS) - 1, np.int64)
        ids = np.concatenate([packed, pad])
        x = sum(self.embedding[b] for b in buckets(ids))
        n = len(packed)
        return [sum(x[j : j + n] @ k[j] for j in range(len(k))) + b for k, b in zip(self.kernels, self.biases, strict=True)]

    def raw(self, packed: np.ndarray) -> float:
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        for at in range(0, len(packed), BLOCK):
            part = packed[at : at + BLOCK + max(WIDTHS) - 1]
            best = np.maximum(best, np.concatenate([r[:BLOCK].max(0) for r in self.responses(part)]))
        return float(best @ self.out + self.out_bias)

    def score(self, packed: np.ndarray) -> float:
        gap = self.raw(packed) - self.thresholds[language(packed)]
        return float(1 / (1 + np.exp(-np.clip(gap + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -30, 30))))


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int) -> ConvNet:
    """Adam on the weighted logistic loss. Only the words at the maxima of a filter get gradients."""
    net, rng = ConvNet.fresh(seed), np.random.default_rng(seed)
    params = [net.embedding, *net.kernels, *net.biases, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    mb = vb = 0.0
    gap, step = max(WIDTHS) - 1, 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            pieces, starts, at = [], [], 0
            for i in batch:
                starts.append(at)
                pieces += [texts[i], np.zeros(gap + (len(texts[i]) == 0), np.int64)]
                at += len(texts[i]) + gap + (len(texts[i]) == 0)
            ids = np.concatenate(pieces)
            pooled, arg = [], []
            for r in net.responses(ids):
                top = np.maximum.reduceat(r, starts, axis=0)
                ends = [*starts[1:], len(ids)]
                arg.append(np.stack([s + r[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)]))
                pooled.append(top)
            h = np.concatenate(pooled, 1)
            act = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.out_bias, -30, 30)))
            d = ((p - labels[batch]) * weights[batch] / len(batch)).astype(np.float32)
            g_out, g_b = act.T @ d, float(d.sum())
            dh = np.outer(d, net.out) * (h > 0)
            ids = np.concatenate([ids, np.zeros(gap, np.int64)])
            rows, grads, g_k, g_bias = [], [], [], []
            for q, (kernel, where) in enumerate(zip(net.kernels, arg, strict=True)):
                dq = dh[:, q * FILTERS : (q + 1) * FILTERS]
                on, f = np.nonzero(dq)
                val, pos = dq[on, f], where[on, f]
                g = np.zeros_like(kernel)
                for j in range(len(kernel)):
                    at_words = buckets(ids[pos + j])
                    np.add.at(g[j].T, f, sum(net.embedding[b] for b in at_words) * val[:, None])
                    rows += at_words
                    grads += [kernel[j][:, f].T * val[:, None]] * 3
                g_k.append(g)
                g_bias.append(dq.sum(0))
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            touched, inverse = np.unique(rows, return_inverse=True)
            g_e = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g_e, inverse, grads)
            g_e[touched == 0] = 0
            e, em, ev = params[0], m[0], v[0]
            em[touched] = 0.9 * em[touched] + 0.1 * g_e
            ev[touched] = 0.999 * ev[touched] + 0.001 * g_e**2
            e[touched] -= RATE * (fix * em[touched] / (np.sqrt(ev[touched]) + 1e-8) + DECAY * e[touched])
            for k, g in enumerate([*g_k, *g_bias, g_out], 1):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                params[k] -= RATE * (fix * m[k] / (np.sqrt(v[k]) + 1e-8) + DECAY * params[k])
            mb, vb = 0.9 * mb + 0.1 * g_b, 0.999 * vb + 0.001 * g_b**2
            net.out_bias -= RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    return net


def best_threshold(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The raw score, midway between two neighbours, that errs least by weight."""
    order = np.argsort(raw, kind="stable")
    r, y, w = raw[order], labels[order], weights[order]
    wrong = np.concatenate([[0], np.cumsum(np.where(y == 1, w, -w))]) + (w * (y == 0)).sum()
    edges = np.concatenate([[r[0] - 2], (r[1:] + r[:-1]) / 2, [r[-1] + 2]])
    wrong[1:-1][r[1:] == r[:-1]] = np.inf
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(edges[best[len(best) // 2]])


def calibrate(net: ConvNet, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
    raw, lang = np.array([net.raw(t) for t in texts]), np.array([language(t) for t in texts])
    net.thresholds[:] = best_threshold(raw, labels, weights)
    for k in range(1, 5):
        own = lang == k
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= LEAST_FOR_LANGUAGE:
            net.thresholds[k] = best_threshold(raw[own], labels[own], weights[own])


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_per_class: int) -> list:
    """Packed words of at most ``max_per_class`` labelled texts and MAX_CLASS_BYTES of each class, held-out ids left out, those with the smallest hashes.

    Of several labels of an id the largest counts, of several texts that with the smallest hash.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    known = known.withColumn("_o", F.xxhash64("_id"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy("_o", "_id").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "toxicity-sample")  # 2 x max_per_class ids at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).alias("size")
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_y", "_o", "_id").agg(F.min(F.struct("_h", size)).alias("t"))
    picked, room = [], {0: MAX_CLASS_BYTES, 1: MAX_CLASS_BYTES}
    for r in found.orderBy("_o", "_id").collect():
        if r["t"]["size"] <= room[r["_y"]]:
            room[r["_y"]] -= r["t"]["size"]
            picked.append((r["_id"], r["t"]["_h"], r["_y"]))
    if not picked:
        return []
    picked = docs.sparkSession.createDataFrame(picked, known.select("_id", F.lit(0).cast("long").alias("_h"), F.col("_y").cast("int")).schema)

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([encode(t).tobytes() for t in part])

    # Repeated rows are merged where they are.
    own = texts.join(F.broadcast(picked), ["_id", "_h"]).groupBy("_id", "_y").agg(F.first("_text").alias("_text"))
    rows = own.select("_id", "_y", packed("_text").alias("words")).collect()
    seen = sorted((r["_id"], r["_y"], bytes(r["words"])) for r in rows)
    weight = {y: sizes.get(y, 0) / max(1, sum(k[1] == y for k in seen)) for y in (0, 1)}
    return [(i, y, np.frombuffer(b, np.int64), weight[y]) for i, y, b in seen]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS, seed: int = 1) -> ConvNet:
    """Two thirds of the sample train, one third calibrates. Without texts of both classes every raw score is the same, below the threshold unless all labels are 1.

    Labels and ids that are null are left out, null and empty texts have no words, and other columns aren't read. Empty tables give that one score.
    """
    require(docs, [id_col, text_col])
    require(labels, [id_col, label_col])
    text_batches(docs.sparkSession)
    rows = training_texts(docs, labels, id_col, text_col, label_col, max_per_class)
    y = np.array([r[1] for r in rows], np.float64)
    if len(set(y)) < 2:
        net = ConvNet.fresh(seed)
        net.out[:] = 0
        net.thresholds[:] = net.out_bias + (-4 if len(y) and y[0] == 1 else 4)
        return net
    texts, w = [r[2] for r in rows], np.array([r[3] for r in rows])
    w = w / w.mean()
    part = np.array([zlib.crc32(f"part{r[0]}".encode()) % 3 for r in rows])
    learn, judge = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    if len(set(y[learn])) < 2 or len(set(y[judge])) < 2:
        learn = judge = np.arange(len(y))
    net = train([texts[i] for i in learn], y[learn], w[learn], seed)
    calibrate(net, [texts[i] for i in judge], y[judge], w[judge])
    return net


def toxicity_udf(net: ConvNet):
    """Score of a column of whole texts: 0.7 at the threshold of the text's language. Null scores as the empty text."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([net.score(encode(t)) for t in part], dtype="float64")

    return score


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document. Null texts score as empty ones, texts of any length are read whole, and equal texts score alike; a score of just 0.7 is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    net = fit_toxicity(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_udf(net)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
