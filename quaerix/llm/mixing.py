"""Mixing sources to target weights by entropy balancing.

The mix takes each document at a rate w. Two families of token constraints are to hold: each source's words meet its target, and the
words of each length class (documents whose sizes have the same power of two) keep their share of all words, so that weighing
sources does not shift the mix towards short or long documents. The first hold exactly; the second as far as the first and the cap allow, at a
price. Among all rates from 0 to the cap, entropy balancing takes those nearest to 1 in the sense of ``sum(size * (w log w - w + 1))``; they are
exponentially tilted, ``w = min(cap, exp(lambda[source] + mu[class]))``. The convex dual couples all sources by mu and is solved by Newton
iterations: in each, the tasks that hold the sources solve their own lambda for the present mu and add up gradient and Hessian of what is
left, which has one row for each length class; the driver solves that small system for the next mu.

Rates are rounded into whole copies by carrying the remainder of
words from document to document, large ones first, in bounded buckets; documents that outweigh a bucket have buckets of their own.
What all buckets of a source have left is then settled: bucket after bucket takes all or nothing, and the last one is rounded anew with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaerix.llm.common import WORD, join_keyed, materialize, record

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Documents that are rounded together; more are spread by a hash of their id.
BUCKET = 192
#: Buckets of one source, at most; their totals are summed up in one task.
MAX_BUCKETS = 1 << 14
#: A document with over one part in LARGE of an average bucket's words is rounded with others of about its size.
LARGE = 8
#: Length classes: powers of two up to 2**39 words.
CLASSES = 40
#: What a class may be off: its words miss their share by SLACK * mu.
SLACK = 0.05
NEWTON_STEPS = 60
#: Sources up to this number are ranked in one task; and tasks that hold the sources while the dual is solved.
ONE_TASK, TASKS = 1 << 18, 64


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sizes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size): size is the number of runs of non-blanks; null text has none."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), _size(F.col(text)).alias("size"))


def _class(size: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(CLASSES - 1)).cast("int")


def _ranked(totals: DataFrame, one_task: int) -> DataFrame:
    """Adds _rank: 1, 2, ... by source, by code point, null last. *totals* is materialised and has one row for each source."""
    order = F.col("source").asc_nulls_last()
    if totals.count() <= one_task:
        return totals.withColumn("_rank", F.row_number().over(Window.orderBy(order)))
    ranged = materialize(totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_pid", F.shiftright("_at", 33))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    ends = ranged.groupBy("_pid").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    return ranged.join(F.broadcast(ends.drop("_k")), "_pid").withColumn("_rank", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_pid", "_at", "_before")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, one_task: int = ONE_TASK) -> DataFrame:
    """Add *target* to (source, source_size, ...).

    Sources by code point, null last, weigh *weights* in turn and share
    ``share`` of all words; a target stops at ``cap`` times its source's size and
    the excess is shared again by weight, until none is above. There is one row per source here, and
    each round of resharing is one aggregation over them that stops at least one more of them.
    """
    table = F.array(*[F.lit(float(x)) for x in weights])
    ranked = _ranked(materialize(totals, "totals"), one_task).withColumn("_w", F.element_at(table, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = materialize(ranked.withColumn("_top", F.col("source_size") * F.lit(float(cap))).drop("_rank"), "sources")
    pool = ranked.agg(F.sum("source_size").alias("n"), F.sum("_top").alias("top")).first()
    pool, top = float(pool["n"] or 0) * share, float(pool["top"] or 0)
    if pool >= top:
        return ranked.withColumn("target", F.col("_top")).drop("_w", "_top")
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("_w") * F.lit(level) >= F.col("_top")
        r = ranked.agg(F.sum(F.when(over, F.col("_top")).otherwise(0.0)).alias("spent"), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))).alias("w"), F.sum(over.cast("int")).alias("full")).first()
        if not r["w"] or r["full"] <= full:
            break
        level, full = (pool - r["spent"]) / r["w"], r["full"]
    return ranked.withColumn("target", F.least("_top", F.col("_w") * F.lit(level or 0.0))).drop("_w", "_top")


def source_rates(words: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float = CAP) -> np.ndarray:
    """The rates (a row for each source, a column for each class) that meet each source's target given *mu*.

    They are min(cap, exp(lambda + mu)): lambda has a closed form once it is known which classes are at the cap, and these only grow in number.
    """
    tilt = np.exp(mu)[None, :] * np.ones((len(words), 1))
    capped = np.zeros(words.shape, dtype=bool)
    live = (target > 0) & (words.sum(axis=1) > 0)
    full = live & (target >= cap * words.sum(axis=1))
    for _ in range(words.shape[1] + 1):
        free = np.where(capped, 0.0, words * tilt).sum(axis=1)
        left = np.maximum(target - cap * np.where(capped, words, 0.0).sum(axis=1), 0.0)
        scale = np.where(free > 0, left / np.where(free > 0, free, 1.0), 0.0)
        rate = np.where(capped, cap, scale[:, None] * tilt)
        more = (rate > cap) & ~capped & (words > 0)
        if not more.any():
            break
        capped |= more
    rate = np.where(full[:, None], cap, np.minimum(rate, cap))
    return np.where(live[:, None], rate, 0.0)


def system(words: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float = CAP) -> tuple[np.ndarray, np.ndarray]:
    """By class, the words that sources take given *mu*, and the derivative of that by mu with each source's lambda following."""
    rate = source_rates(words, target, mu, cap)
    moving = np.where(rate < cap, words * rate, 0.0)
    every = moving.sum(axis=1)
    scaled = moving / np.sqrt(np.where(every > 0, every, 1.0))[:, None]
    return (words * rate).sum(axis=0), np.diag(moving.sum(axis=0)) - scaled.T @ scaled


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = np.array(batch.column("words").to_pylist(), dtype=np.float64).reshape(batch.num_rows, CLASSES)
    return words, batch.column("target").to_numpy(zero_copy_only=False).astype(np.float64)


def entropy_balance(cells: DataFrame, cap: float = CAP, slack: float = SLACK, steps: int = NEWTON_STEPS) -> tuple[DataFrame, np.ndarray]:
    """Solve the dual for *cells* (materialised, one row for each source: words by class, target, ...): adds *rates*, by class; and mu.

    Every iteration is one job over the sources; the driver gets at most TASKS systems of CLASSES rows. A step is
    halved while the constraints get worse. A source with a target or a size of zero has rates of zero.
    """
    parts = cells.select("words", "target").coalesce(TASKS)

    def solve(mu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            took, bend, have, goal = np.zeros(CLASSES), np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES), 0.0
            for batch in batches:
                words, target = _words(batch)
                a, b = system(words, target, mu, cap)
                took, bend, have, goal = took + a, bend + b, have + words.sum(axis=0), goal + float(target.sum())
            yield record("s binary", [np.concatenate((took, bend.ravel(), have, [goal])).tobytes()])

        s = sum(np.frombuffer(bytes(r["s"])) for r in parts.mapInArrow(add, "s binary").collect())
        c = CLASSES
        return s[:c], s[c : c + c * c].reshape(c, c), s[c + c * c : -1], float(s[-1])

    mu = np.zeros(CLASSES)
    took, bend, have, goal = solve(mu)
    every = have.sum()
    here = have > 0
    if every <= 0 or goal <= 0 or not here.any():
        mu[:] = 0.0
    else:
        miss = lambda took, mu: (took - have * goal / every + slack * have * mu)[here] / every
        off = miss(took, mu)
        for _ in range(steps):
            if np.abs(off).max() < 1e-11:
                break
            bent = bend[np.ix_(here, here)] / every + np.diag(slack * have[here] / every)
            step, size = np.linalg.solve(bent, off), 1.0
            step *= min(1.0, 2.0 / np.abs(step).max())
            while True:
                new = mu.copy()
                new[here] -= size * step
                took, bend_new, _, _ = solve(new)
                off_new = miss(took, new)
                if np.abs(off_new).sum() < np.abs(off).sum() or size < 1e-3:
                    break
                size /= 2
            better = np.abs(off_new).sum() < np.abs(off).sum()
            if not better:
                break
            mu, bend, off = new, bend_new, off_new
    # So that the order in which tasks end does not show.
    mu = np.round(mu, 8)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, target = _words(batch)
            rates = source_rates(words, target, mu, cap)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rates), pa.list_(pa.float64()))], names=[*batch.schema.names, "rates"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
    return cells.mapInArrow(rated, f"{schema}, rates array<double>"), mu


COLUMNS = ["_rid", "doc_id", "source", "size", "source_size", "target", "rate", "copies"]
SCHEMA = "_rid long, doc_id long, source string, size long, source_size long, target double, rate double, copies long"


def _copies(rows: pa.Table, cap: float = CAP) -> pa.Table:
    """Round one bucket. With *copies* and *left* (words that its source still misses), round it anew so that it takes those as well."""
    number = lambda c: rows.column(c).to_numpy().astype(np.float64)
    size, rate = number("size"), number("rate")
    ids = np.array([-1 << 63 if x is None else x for x in rows.column("doc_id").to_pylist()], dtype=np.int64)
    order = np.lexsort((rows.column("_rid").to_numpy(), ids, -size))
    out, due, most = np.zeros(len(size), dtype=np.int64), 0.0, int(cap)
    anew = "left" in rows.column_names
    if anew:
        old, left = rows.column("copies").to_numpy(), float(rows.column("left")[0].as_py())
        due = left + float((old * size).sum() - (rate * size).sum())
    for i in order.tolist():
        n = size[i]
        due += rate[i] * n
        if n:
            out[i] = min(max(int(due / n + 0.5), 0), most)
            due -= out[i] * n
    if anew and abs(due) > abs(left):
        out = old
    if "copies" in rows.column_names:
        rows = rows.drop_columns(["copies"])
    return rows.append_column("copies", pa.array(out, pa.int64()))


def _settle(rounded: DataFrame, cap: float, n: int) -> DataFrame:
    """Let buckets, in the order of their numbers, take all or nothing until the words that a source misses are met; the last is rounded anew.

    rounded: COLUMNS, _key, _b. Sums are of whole numbers, so reruns agree. One row for each source is joined to the documents.
    """
    most = int(cap)
    taken, size = F.col("copies") * F.col("size"), F.col("size")
    buckets = rounded.groupBy("_key", "_b").agg(F.sum(taken).alias("took"), F.sum(size).alias("words"), F.count("*").alias("docs"), F.first("target").alias("target"))
    every, before = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumns({"miss": F.col("target") - F.sum("took").over(every), "docs": F.sum("docs").over(every)})
    room = F.when(F.col("miss") >= 0, F.col("words") * most - F.col("took")).otherwise(F.col("took"))
    buckets = buckets.withColumn("room", room).withColumn("before", F.coalesce(F.sum("room").over(before), F.lit(0)))
    cut = F.when(F.col("before") + F.col("room") > F.abs("miss"), F.struct("_b", (F.col("miss") - F.signum("miss") * F.col("before")).alias("left")))
    plan = buckets.groupBy("_key").agg(F.min(cut).alias("cut"), F.first("miss").alias("miss"), F.first("docs").alias("docs"))
    plan = plan.select("_key", "docs", F.col("cut._b").alias("cut"), F.col("cut.left").alias("left"), (F.col("miss") >= 0).alias("more"))
    joined = join_keyed(rounded, materialize(plan, "settling"), "_key", "docs", n)
    at = F.col("_b").eqNullSafe(F.col("cut"))
    # Without a cut, all buckets together cannot meet the target: they all take all or nothing.
    spent = F.col("cut").isNull() | (F.col("_b") < F.col("cut"))
    limit = F.when(F.col("more") & (size > 0), F.lit(most)).otherwise(F.lit(0)).cast("long")
    whole = joined.filter(~at).withColumn("copies", F.when(spent, limit).otherwise(F.col("copies"))).select(COLUMNS)
    anew = joined.filter(at).groupBy("_key", "_b").applyInArrow(lambda rows: _copies(rows, cap).select(COLUMNS), SCHEMA)
    return whole.unionByName(anew)


def _mixed(rows: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """COLUMNS of *rows* (materialised): _rid, doc_id, source, size."""
    cells = rows.groupBy("source", _class(F.col("size")).alias("c")).agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    by = F.map_from_entries(F.collect_list(F.struct("c", "n")))
    totals = cells.groupBy("source").agg(F.sum("n").alias("source_size"), F.sum("k").alias("docs"), by.alias("by"))
    words = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.coalesce(F.try_element_at("by", c), F.lit(0)).cast("double"))
    solved = targets(totals.select("source", "source_size", "docs", words.alias("words")), weights, share, cap)
    # A null source needs a key that equals itself and no other source.
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    solved, _ = entropy_balance(materialize(solved.withColumn("_key", key).drop("source"), "cells"), cap)
    n = rows.count()
    joined = join_keyed(rows.withColumn("_key", key), materialize(solved.drop("words"), "rates"), "_key", "docs", n)
    joined = joined.withColumn("rate", F.element_at("rates", _class(F.col("size")) + 1)).drop("rates")
    number = F.least(F.greatest(F.ceil(F.col("docs") / F.lit(BUCKET)), F.lit(1)), F.lit(MAX_BUCKETS))
    # Fewer than LARGE * _n documents are large. Their buckets are numbered after the others, by size.
    large = (F.col("_n") > 1) & (F.col("size") * F.col("_n") * LARGE > F.col("source_size"))
    parts = F.ceil(F.col("_n") * LARGE / F.lit(BUCKET))
    hashed = F.xxhash64("doc_id")
    bucket = F.when(large, F.col("_n") + F.floor(F.log2(F.greatest("size", F.lit(1)))) * parts + F.pmod(hashed, parts)).otherwise(F.pmod(hashed, F.col("_n")))
    dealt = joined.withColumn("_n", number).withColumn("_b", bucket.cast("long")).drop("_n", "docs")
    # A bucket much larger than an average one holds an id, or no id, many times: its rows are dealt by their numbers.
    fair = max(BUCKET, -(-n // MAX_BUCKETS))
    heavy = materialize(dealt.groupBy("_key", "_b").agg(F.count("*").alias("_m")).filter(F.col("_m") > 8 * fair), "heavy")
    if not heavy.isEmpty():
        # At most n / (8 * fair) rows, which is 1 / 8 of MAX_BUCKETS.
        dealt = dealt.join(F.broadcast(heavy), ["_key", "_b"], "left")
        part = F.pmod(F.xxhash64("_rid"), F.ceil(F.col("_m") / F.lit(fair)).cast("long")) + 1
        dealt = dealt.withColumn("_b", F.col("_b") + F.coalesce(part, F.lit(0)) * F.lit(1 << 32)).drop("_m")
    rounded = dealt.groupBy("_key", "_b").applyInArrow(lambda rows: _copies(rows, cap).select([*COLUMNS, "_key", "_b"]), f"{SCHEMA}, _key string, _b long")
    return _settle(materialize(rounded, "rounded"), cap, n)


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    ``copies`` is a whole number up to *cap* and ``taken = copies * size``.
    Documents without words (null or blank text) are never taken; null is a
    source of its own. Rows repeated with one id, and rows without an id, are documents of their own.
    An empty table gives no rows; other columns are ignored. Reruns agree:
    buckets and order depend on ids and sizes (and for rows that repeat an id, on their places in the table).
    """
    rows = materialize(sizes(docs, text, id_col, source).withColumn("_rid", F.monotonically_increasing_id()), "sizes")
    done = _mixed(rows, weights, share, cap)
    return done.withColumn("taken", F.col("copies") * F.col("size")).drop("_rid")


def take(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: the rows of *docs* with all their columns, each as often as its copies.

    Rows are numbered first, so that those that repeat an id or have none are documents of their own.
    """
    # As one struct, so that no column of the input clashes with a name used here.
    held = materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_rid")), "numbered")
    rows = held.select("_rid", F.col("_row")[id_col].cast("long").alias("doc_id"), F.col("_row")[source].cast("string").alias("source"), _size(F.col("_row")[text]).alias("size"))
    copies = _mixed(materialize(rows, "sizes"), weights, share, cap).filter("copies > 0").select("_rid", F.col("copies").cast("int").alias("_n"))
    return held.join(copies, "_rid").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_c")).select("_row.*")
