"""Language identification by a string kernel.

The kernel blends spectra: for texts x and y it is the mean over n = 1, 2, 3 of the cosine of
their sets of character n-grams (presence, not counts). Landmark texts give Nystrom
features ``K(x, L) K(L, L)^(-1/2)``, on which one-versus-rest kernel ridge regression is
fitted. Since each part of the kernel is a product of presence vectors, the
landmarks, the Nystrom map and the regression multiply into one matrix of weights by n-gram
and language, and a batch of texts is scored by one product for each n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaerix.llm.common import record

#: Hash buckets of the n-grams of each n.
WIDTHS = (2048, 8192, 16384)
OFFSETS = (0, 2048, 10240)
DIMENSIONS = 26624
#: Labelled texts that are learned from: of each language, about, and in all, at most; languages, the most frequent ones; and landmarks.
PER_LANGUAGE = 400
SAMPLE = 8000
LANGUAGES = 500
LANDMARKS = 192
RIDGE = 1e-3
#: Texts scored at once, and characters whose n-grams are hashed at once.
BATCH, BUFFER = 64, 1 << 19
UNKNOWN = "und"

_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _ALPHA[0]


def presence(texts: list[str]) -> np.ndarray:
    """0/1 rows of the n-grams of whole texts: lower-cased letters, all else as one blank."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.uint8)
    alpha = _alpha()
    for row, text in enumerate(texts):
        tail, flags = np.array([32], dtype=np.uint32), out[row]
        for at in range(0, len(text), BUFFER):
            c = np.frombuffer(text[at : at + BUFFER].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letter = alpha[np.minimum(c, 0x10FFFF)]
            # Of blanks in a row the first one stays, also where they lie in two buffers.
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[0] |= tail[-1] != 32
            c = np.concatenate((tail, np.where(letter, c, 32)[keep], [32] if at + BUFFER >= len(text) else [])).astype(np.uint32)
            # The last two characters go on with the next buffer: no n-gram is lost and none is made up.
            tail = c[-2:]
            if (c == 32).all():
                continue
            one = c * np.uint32(0x9E3779B1)
            flags[(one >> np.uint32(21))[c != 32]] = 1
            two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:]
            flags[OFFSETS[1] + ((two * np.uint32(0xC2B2AE35)) >> np.uint32(19))] = 1
            three = two[:-1] * np.uint32(0x27D4EB2F) + one[2:]
            flags[OFFSETS[2] + ((three * np.uint32(0xC2B2AE35)) >> np.uint32(18))] = 1
    return out


def normalised(flags: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the kernel."""
    x = flags.astype(np.float32)
    for a, w in zip(OFFSETS, WIDTHS, strict=True):
        part = x[:, a : a + w]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1.0) * len(WIDTHS))
    return x


class Classifier:
    """Weights by n-gram and language; no languages if nothing was learned. *landmarks* are the numbers of the texts that were landmarks."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, landmarks: tuple[int, ...] = ()) -> None:
        self.languages, self.weights, self.bias, self.landmarks = languages, weights, bias, landmarks

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1: half of one plus the winner's margin form, clipped."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for at in range(0, len(texts), BATCH):
            flags = presence([t or "" for t in texts[at : at + BATCH]])
            f = normalised(flags) @ self.weights + self.bias
            best = f.argmax(axis=1)
            for i in np.flatnonzero(flags[:, : WIDTHS[0]].any(axis=1)).tolist():
                names[at + i] = self.languages[best[i]]
                scores[at + i] = min(max((float(f[i, best[i]]) + 1.0) / 2.0, 0.0), 1.0)
        return names, scores


def train(flags: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """Nystrom kernel ridge regression, one language against the rest."""
    languages = sorted(set(labels))
    if not languages:
        return Classifier([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    x = normalised(flags)
    y = np.array([[1.0 if a == b else -1.0 for b in languages] for a in labels])
    # Landmarks by turns over the languages, so that a rare one has as many.
    turn = {a: 0 for a in languages}
    order = sorted(range(len(labels)), key=lambda i: (turn.__setitem__(labels[i], turn[labels[i]] + 1) or turn[labels[i]], labels[i]))
    chosen = tuple(order[:landmarks])
    marks = x[list(chosen)]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors * np.where(values > 1e-8, 1.0 / np.sqrt(np.maximum(values, 1e-8)), 0.0)
    z = (x @ marks.T).astype(np.float64) @ root
    share = np.array([labels.count(a) for a in languages], dtype=np.float64)
    weight = np.array([1.0 / share[languages.index(a)] for a in labels]) * len(labels) / len(languages)
    mean, mean_y = np.average(z, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    zc = z - mean
    fit = np.linalg.solve((zc * weight[:, None]).T @ zc + ridge * len(labels) * np.eye(z.shape[1]), (zc * weight[:, None]).T @ (y - mean_y))
    return Classifier(languages, (marks.T.astype(np.float64) @ (root @ fit)).astype(np.float32), mean_y - mean @ fit, chosen)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def _decoded(batch: pa.RecordBatch) -> list[str]:
    """Texts travel as bytes, so that invalid UTF-8 is no error; null stays null."""
    return [None if b is None else b.decode("utf-8", "replace") for b in batch.column("text").to_pylist()]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, languages: int = LANGUAGES) -> Classifier:
    """Learn from about *per_language* whole texts of each of the *languages* most frequent languages, *sample* in all at most.

    They are taken by a hash of the id, none of them held out. Rows that repeat id, language and n-grams count once.
    """
    pool = docs.filter(~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["l"]: r["n"] for r in pool.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages).collect()}
    if not counts:
        return train(np.zeros((0, DIMENSIONS), np.uint8), [])
    each = min(per_language, max(sample // len(counts), 1))
    rate = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    taken = pool.filter(draw < F.coalesce(F.try_element_at(rate, F.col(lang)), F.lit(0.0)))
    taken = taken.select(F.col(id_col).cast("long").alias("i"), F.col(lang).alias("l"), F.col(text).cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(presence([t])[0]).tobytes() for t in _decoded(batch)]
            yield record("i long, l string, bits binary", batch.column("i"), batch.column("l"), bits)

    # Hot rows that repeat are one row each task before they are shuffled; the limit is the sample's bound.
    got = taken.mapInArrow(pack, "i long, l string, bits binary").distinct().orderBy(F.xxhash64("i"), "i", "l", "bits").limit(2 * sample)
    rows = sorted(((r["i"] is not None, r["i"] or 0), r["l"], bytes(r["bits"])) for r in got.collect())
    flags = np.array([np.unpackbits(np.frombuffer(b, np.uint8)) for _, _, b in rows], dtype=np.uint8).reshape(len(rows), DIMENSIONS)
    has = flags[:, : WIDTHS[0]].any(axis=1)
    return train(flags[has], [r[1] for r, k in zip(rows, has, strict=True) if k])


RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Classifier, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, and so is all if nothing was learned.
    A null id stays null and its held_out is null. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            names, scores = own.predict(_decoded(batch))
            yield record(RESULT, batch.column("doc_id"), batch.column("held_out"), names, scores)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, model: Classifier, text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of *docs* whose language is identified, with all their columns; a null *lang* is filled with the prediction.

    Rejected are texts that are null or have no letter, and those that every one-versus-rest classifier says no to: the
    winner's score is below *least* (0.5 is a decision value of 0). If nothing was learned, every text with a letter stays.
    Without a column *lang*, columns stay as they are.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def name(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        if not shipped.value.languages:
            has = presence([t or "" for t in texts])[:, : WIDTHS[0]].any(axis=1) if texts else []
            return pd.Series(["" if h else None for h in has], dtype=object)
        names, scores = shipped.value.predict(texts)
        return pd.Series([n if n != UNKNOWN and s >= least else None for n, s in zip(names, scores, strict=True)], dtype=object)

    found = "_lang"
    while found in docs.columns:
        found += "_"
    # Not to be repeated: the filter stays above the one evaluation.
    once = name.asNondeterministic()
    rows = docs.withColumn(found, once(F.col(text))).filter(F.col(found).isNotNull())
    if lang in docs.columns:
        rows = rows.withColumn(lang, F.coalesce(lang, F.nullif(found, F.lit("")).cast(docs.schema[lang].dataType)))
    return rows.drop(found)
