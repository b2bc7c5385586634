"""Quality classification by supervised subword embeddings.

A document is the average of the vectors of its features, which are hashed into buckets:
its words, its pairs of neighbouring words, and its character n-grams across blanks; each kind weighs the same.
A softmax layer over the average gives the classes. Vectors and layer are learned together
by stochastic gradient descent in numpy. For scoring, a bucket's vector and the
layer multiply into one number, so that a text costs one look-up for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaerix.llm.common import materialize, record
from quaerix.llm.langid import held_out
from quaerix.llm.shingles import BUFFER, buffers, mix, word_hashes

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
DIMENSION = 8
EPOCHS = 12
RATE = 4.0
#: Labelled texts of each class that are learned from, about, and bytes of all their features, about: beyond it, fewer texts are learned from.
PER_CLASS = 2000
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.3


def _grams(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets of the n-grams that begin at each byte) of bytes whose blanks are 32."""
    code = buf.astype(np.uint32)
    wide = code
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ wide[n - 1 :]
        if n in GRAMS:
            h = code * np.uint32(0x9E3779B1) + np.uint32(n)
            h ^= h >> np.uint32(15)
            yield n, ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def _plain(buf: np.ndarray) -> np.ndarray:
    return np.where((buf == 32) | ((buf >= 9) & (buf <= 13)), np.uint8(32), buf)


def _words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and of the pairs that begin at each word."""
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return (words >> np.uint64(48)).astype(np.uint16), (pairs >> np.uint64(48)).astype(np.uint16)


def kinds(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets of all texts' features in order, and where each text's begin and end.

    The texts fit into a buffer. No feature spans two texts, so that a text's features do not depend on its neighbours.
    """
    words, first = word_hashes(data)
    for found in _words(words):
        yield found, first[:-1], np.maximum(first[1:] - (len(words) - len(found)), first[:-1])
    padded = [b" " + d + b" " for d in data]
    buf = _plain(np.frombuffer(b"".join(padded), dtype=np.uint8))
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in padded])))
    for n, found in _grams(buf):
        yield found, bounds[:-1], np.maximum(bounds[1:] - (n - 1), bounds[:-1])


def long_kinds(data: bytes) -> Iterator[list[np.ndarray]]:
    """What `kinds` gives for one text of any length: for each kind its buckets, in pieces, with the n-grams across their edges."""
    yield from ([found] for found in _words(word_hashes([data])[0]))
    pieces: dict[int, list[np.ndarray]] = {n: [] for n in GRAMS}
    padded = np.frombuffer(b" " + data + b" ", dtype=np.uint8)
    for at in range(0, len(padded), BUFFER):
        for n, found in _grams(_plain(padded[at : at + BUFFER + max(GRAMS) - 1])):
            pieces[n].append(found[: BUFFER if at + BUFFER < len(padded) else None])
    yield from pieces.values()


def means(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean of each run; 0 of an empty one."""
    n = ends - starts
    out, full = np.zeros(len(n)), n > 0
    if full.any():
        # Sums from each start to its end, and between runs, which are left out. One value more: an end may be the last.
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        out[full] = np.add.reduceat(np.append(values, np.float32(0)), edges, dtype=np.float64)[::2] / n[full]
    return out


def bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's features as distinct buckets and weights that sum to 1 (to 0 for a text without any)."""
    total, used = np.zeros(BUCKETS, dtype=np.float64), 0
    for parts in long_kinds(data):
        n = sum(map(len, parts))
        if n:
            total += sum(np.bincount(p, minlength=BUCKETS) for p in parts) / n
            used += 1
    total /= max(used, 1)
    at = np.flatnonzero(total)
    return at.astype(np.uint32), total[at].astype(np.float32)


class Model:
    """One number for each bucket and a bias: the difference of the softmax layer's two outputs."""

    def __init__(self, value: np.ndarray, bias: float) -> None:
        self.value, self.bias = value.astype(np.float32), float(bias)

    def score(self, data: list[bytes]) -> np.ndarray:
        """The chance of label 1 of UTF-8 texts of any length."""
        out = np.zeros(len(data))
        for at, end in buffers(data):
            logit, used = np.zeros(end - at), np.zeros(end - at)
            if len(data[at]) >= BUFFER:
                for parts in long_kinds(data[at]):
                    n = sum(map(len, parts))
                    logit += sum(float(self.value[p].sum(dtype=np.float64)) for p in parts) / max(n, 1)
                    used += n > 0
            else:
                for found, starts, ends in kinds(data[at:end]):
                    logit += means(self.value[found], starts, ends)
                    used += ends > starts
            logit = logit / np.maximum(used, 1) + self.bias
            out[at:end] = 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))
        return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, dimension: int = DIMENSION, seed: int = 7) -> Model:
    """Stochastic gradient descent on the weighted cross-entropy of the softmax of (average vector) x layer + bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0, 1.0, (BUCKETS, dimension)) / dimension
    layer, bias = rng.uniform(-0.5, 0.5, (dimension, 2)), np.zeros(2)
    if not len(bags):
        return Model(np.zeros(BUCKETS), 0.0)
    share = np.array([weights[labels == k].sum() for k in (0, 1)])
    bias[:] = np.log((share + 1.0) / (share.sum() + 2.0))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, w = bags[i]
            pace = rate * (1.0 - done / steps) * weights[i]
            done += 1
            h = w @ vectors[at] if len(at) else np.zeros(dimension)
            e = h @ layer + bias
            p = np.exp(e - e.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = layer @ p
            layer -= 0.1 * pace * np.outer(h, p)
            bias -= 0.02 * pace * p
            if len(at):
                vectors[at] -= pace * 8.0 * w[:, None] * back[None, :]
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", text: str = "text", id_col: str = "doc_id", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from about *per_class* labelled texts of each class, whole ones, taken by a hash of the id, none of them held out.

    Their features are sent to the driver; where those of all would take more than *sample_bytes*, a smaller share of the texts is learned from.

    Rows weigh so that the classes count as they do among all labels. Labels
    that are null or neither 0 nor 1 are left out; of several labels of an id the largest counts.
    """
    pool = labels.filter(F.col(target).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(target).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in pool.groupBy("y").count().collect()}
    if not counts:
        return train([], np.zeros(0, int), np.zeros(0))
    rate = {k: min(1.0, per_class / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("i", F.lit(2)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    taken = pool.filter(draw < F.when(F.col("y") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0)))
    # About 2 * per_class ids by the rates above, whatever the table's size.
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).join(F.broadcast(taken), "i")
    learned = "i long, y int, at binary, w binary"

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t) for t in batch.column("text").to_pylist()]
            yield record(learned, batch.column("i"), batch.column("y"), [a.astype("<u2").tobytes() for a, _ in found], [w.astype("<f4").tobytes() for _, w in found])

    # Of several rows of an id one is learned from, so that the sample keeps its bound.
    one = rows.mapInArrow(bags, learned).groupBy("i", "y").agg(F.min(F.struct("at", "w")).alias("b")).select("i", "y", "b.at", "b.w")
    one = materialize(one, "bags")
    size = one.agg(F.sum(F.length("at") + F.length("w"))).first()[0] or 0
    share = int(min(1.0, sample_bytes / max(size, 1)) * (1 << 24))
    few = one.filter(F.pmod(F.xxhash64("i", F.lit(4)), F.lit(1 << 24)) < share) if size > sample_bytes else one
    got = sorted((r["i"], r["y"], bytes(r["at"]), bytes(r["w"])) for r in few.collect())
    y = np.array([g[1] for g in got], dtype=int)
    n = {k: max(int((y == k).sum()), 1) for k in (0, 1)}
    total = sum(counts.values())
    weight = np.array([counts[k] / total * len(y) / n[k] for k in y])
    return train([(np.frombuffer(a, "<u2"), np.frombuffer(w, "<f4")) for _, _, a, w in got], y, weight)


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (the chance of label 1), predicted (1 if score >= *threshold*).

    Null text counts as empty; a text without features gets the score of the bias. If nothing was learned all scores are one half.
    A null id stays null and its held_out is null. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    result = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            s = own.score(batch.column("text").to_pylist())
            yield record(result, batch.column("doc_id"), batch.column("held_out"), s, (s >= threshold).astype(np.int32))

    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), body).mapInArrow(run, result)
