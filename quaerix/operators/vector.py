"""Exact cosine search, batched by question, and the vector store's operations.

A block of vectors meets the questions that may ask for it in one matrix product; a task keeps k candidates of
each question over all its blocks, and only those are shuffled. The store is a Parquet table partitioned by repository.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Question vectors that are sent to all tasks at once; a larger batch is searched in parts, each by one reading of the vectors.
MAX_QUESTIONS = 1 << 14
#: Scores of one matrix product.
PRODUCT = 1 << 23


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays."""
    d = v.cast("array<double>")
    return F.when(norm(d) > 0, F.transform(d, lambda x: x / norm(d))).otherwise(d)


def cosine(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def vector_topk(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest of one question; the filter reaches the scan, the sort keeps k rows in each task."""
    held = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return held.select("id", F.round(cosine(F.col("embedding"), q), 6).alias("semantic_score")).filter("semantic_score is not null").orderBy(F.col("semantic_score").desc(), "id").limit(k)


def _unit(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, np.nan)


class _Best:
    """The k best (score, id) of each question over all blocks of a task."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def add(self, number: int, score: np.ndarray, ids: list) -> None:
        held = self.held.get(number, [])
        if len(held) == self.k:
            at = np.flatnonzero(score >= held[-1][0])
        else:
            at = np.flatnonzero(~np.isnan(score))
        if len(at) > self.k:
            # What is below the k-th score of this block cannot stay; ties can.
            at = at[score[at] >= np.partition(score[at], len(at) - self.k)[len(at) - self.k]]
        if len(at):
            new = held + [(float(score[i]) + 0.0, ids[i]) for i in at.tolist()]
            self.held[number] = sorted(new, key=lambda x: (-x[0], x[1]))[: self.k]


def vector_batch(vectors: DataFrame, questions: DataFrame, k: int, filtered: bool = False, most: int = MAX_QUESTIONS) -> DataFrame:
    """(qid, id, semantic_score, semantic_rank) for questions (qid, qvec[, qfilter]) over vectors (id, embedding[, vfilter]).

    With *filtered*, only vectors whose vfilter equals the question's qfilter count, and only they are multiplied. Scores are rounded to 6 places, ties by id.
    """
    spark = vectors.sparkSession
    names = ["qid", "qvec"] + ["qfilter"] * filtered
    asked = questions.select(*names).filter("qvec is not null")
    parts = max(1, -(-asked.count() // most))
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    kinds = [questions.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()]
    found = None
    for number in range(parts):
        # About *most* questions: the batch is split by a hash, and no more than one part is on the driver at a time.
        part = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == number)
        rows = part.collect()
        groups: dict = {}
        for i, r in enumerate(rows):
            groups.setdefault(r["qfilter"] if filtered else None, []).append(i)
        unit = _unit(pa.array([r["qvec"] for r in rows])) if rows else np.zeros((0, 1))
        shipped = spark.sparkContext.broadcast(([r["qid"] for r in rows], {f: (at, unit[at]) for f, at in groups.items()}))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            qid, by = shipped.value
            best = _Best(k)
            for batch in batches:
                ids = batch.column("id").to_pylist()
                filters = batch.column("vfilter").to_pylist() if filtered else [None] * len(ids)
                at_of: dict = {}
                for i, f in enumerate(filters):
                    if f in by and (f is not None or not filtered):
                        at_of.setdefault(f, []).append(i)
                for f, at in at_of.items():
                    numbers, q = by[f]
                    x, own = _unit(batch.column("embedding").take(pa.array(at))), [ids[i] for i in at]
                    step = max(1, PRODUCT // len(x))
                    for a in range(0, len(numbers), step):
                        score = np.round(x @ q[a : a + step].T, 6)
                        for j, n in enumerate(numbers[a : a + step]):
                            best.add(n, score[:, j], own)
            out = [(qid[n], i, s) for n, held in best.held.items() for s, i in held]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], arrow[kinds[0]]), pa.array(columns[1], arrow[kinds[1]]), pa.array(columns[2], pa.float64())], names=["qid", "id", "semantic_score"])

        cols = ["id", "embedding"] + ["vfilter"] * filtered
        one = vectors.select(*cols).filter("embedding is not null").mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, semantic_score double")
        found = one if found is None else found.unionByName(one)
    return semantic_ranks(found).filter(F.col("semantic_rank") <= k)


def semantic_ranks(hits: DataFrame) -> DataFrame:
    """Adds 1-based ranks to scored hits."""
    order = Window.partitionBy("qid").orderBy(F.col("semantic_score").desc(), "id")
    return hits.withColumn("semantic_rank", F.row_number().over(order).cast("long"))


def store_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("long").alias("dimension"))


def vector_ids(rows: DataFrame, *key: str) -> DataFrame:
    """Adds a stable id from the key columns, so that a rerun writes the same points."""
    return rows.withColumn("id", F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key]), 256))


def write_vectors(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Points by repository; with mode ``overwrite`` only the repositories at hand are replaced."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("repository").parquet(path)


def delete_repository(vectors: DataFrame, repositories: DataFrame) -> DataFrame:
    """The points that stay when *repositories* (repository) go."""
    return vectors.join(repositories.select("repository").distinct(), "repository", "left_anti")


def approximate_topk(vectors: DataFrame, query: list[float], k: int, bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """Nearest by random-projection hashing of unit vectors: a candidate search for tables too large to scan."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = vectors.select("id", array_to_vector(l2_normalise(F.col("embedding"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=11).fit(unit)
    q = np.asarray(query, dtype=float)
    near = model.approxNearestNeighbors(unit, Vectors.dense(q / np.linalg.norm(q)), k, distCol="d")
    return near.select("id", F.round(1 - F.col("d") * F.col("d") / 2, 6).alias("semantic_score"))
