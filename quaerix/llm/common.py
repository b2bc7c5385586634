"""Helpers that the training-data operators share.

`materialize` cuts lineage with a Parquet table in the shared folder that the
session names in ``spark.checkpoint.dir``; `join_keyed` and `look_up` join many rows to one
row per key without sending a hot key to one task; `connected_components`
contracts a graph by rounds, never on the driver; `pivoted` and `core_blocks` compare large groups.
Rows travel to Python as Arrow batches, never as pandas frames with ids: a null would turn a column of longs into floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaerix.session import settled

#: What Python's re knows as blanks in the contracts: space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it back: a table that survives lost executors."""
    return settled(df, name)


#: A key that holds more than one row in HOT_SHARE is joined by broadcast; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000
#: A table of narrow rows up to this size may meet in one task without harm: its keys are not counted.
FEW = 1 << 18


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join *rows* to *keyed*, which has one row per *key* and, in *count*, how many rows of *rows* have it.

    Keys with more than ``total / HOT_SHARE`` rows are broadcast: they are fewer
    than HOT_SHARE by counting, whatever the data. Other keys are joined by a
    shuffle in which no key is large. *count* must not be underestimated.
    """
    floor = max(total // HOT_SHARE, 64)
    hot = keyed.filter(F.col(count) > floor)
    rest = keyed.filter(F.col(count) <= floor)
    names = hot.select(F.col(key).alias("_hot"))
    cold_rows = rows.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti")
    return rows.join(F.broadcast(hot), key, "inner").unionByName(cold_rows.join(rest, key, how), allowMissingColumns=True)


def look_up(rows: DataFrame, keyed: DataFrame, key: str, n: int, few: int = FEW) -> DataFrame:
    """*rows* (n of them, materialised) left-joined to *keyed*, which has one row per *key*; hot keys are counted and broadcast."""
    if n <= few:
        return rows.join(keyed, key, "left")
    heat = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(n // HOT_SHARE, 1)).select(key)
    hot = materialize(heat.join(keyed, key, "left"), "hot")
    names = hot.select(F.col(key).alias("_hot"))
    cold = rows.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti").join(keyed, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Up to so many (id, hash) pairs are broadcast to leave rows out; more are joined by a shuffle.
MAX_IDS = 1 << 19


def sha_text(col: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, as binary; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256))


def drop_rows(docs: DataFrame, losers: DataFrame, repeats: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of *docs*, with all their columns, whose (id, text) is not in *losers*; of those in *repeats* one row each.

    losers, repeats: doc_id, sha (see `sha_text`), materialised. A null id equals a null id.
    Only rows in *repeats* are grouped, and they are pre-aggregated where they are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), sha_text(F.col(text)).alias("_sha"), F.struct("*").alias("_row"))
    same = lambda side: F.col("_id").eqNullSafe(side["_i"]) & (F.col("_sha") == side["_s"])

    def sided(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.col("doc_id").alias("_i"), F.col("sha").alias("_s"))
        return F.broadcast(pairs) if pairs.count() <= MAX_IDS else pairs

    if not losers.isEmpty():
        side = sided(losers)
        rows = rows.join(side, same(side), "left_anti")
    if repeats.isEmpty():
        return rows.select("_row.*")
    side = sided(repeats)
    many = rows.join(side, same(side), "left_semi").groupBy("_id", "_sha").agg(F.first("_row").alias("_row"))
    return rows.join(side, same(side), "left_anti").select("_row.*").unionByName(many.select("_row.*"))


def _hop(low: DataFrame, n: int, few: int) -> DataFrame:
    up = low.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
    return look_up(low.select("node", "parent"), up, "parent", n, few).select("node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved"))


def _to_ends(low: DataFrame, n: int, max_rounds: int, few: int) -> DataFrame:
    """Pointers (node, parent) of a forest moved to its roots: every step doubles what a pointer spans, twice in small tables."""
    for _ in range(max_rounds):
        low = _hop(low, n, few)
        low = materialize(_hop(low, n, few) if n <= few else low, "ccp")
        if low.filter("moved").isEmpty():
            return low.select("node", "parent")
        low = low.select("node", "parent")
    raise RuntimeError("pointers did not end; raise max_rounds")


def connected_components(edges: DataFrame, max_rounds: int = 64, few: int = FEW) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) longs; component is the smallest node.

    Each round points every node at its smallest neighbour if that is smaller, doubles
    the pointers until all reach the ends of their chains, and relabels the edges by them; edges inside a
    component vanish, and only nodes without a smaller neighbour are left for the next round.
    A node that many others point at (the hub of a giant component) is a hot key, which `look_up` broadcasts.
    Every table lives in the shared folder; only counts reach the driver. Edges with a null end do not count.
    Empty edges give an empty table. Self-loops make a node its own component.
    """
    live = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null")
    live = materialize(live.distinct(), "cc")
    nodes = materialize(live.select(F.col("a").alias("node")).union(live.select("b")).distinct(), "ccn")
    n_nodes = nodes.count()
    levels: list[DataFrame] = []
    live = live.filter("a <> b")
    for _ in range(max_rounds):
        n = live.count()
        if not n:
            break
        low = (
            live.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
            .groupBy("node").agg(F.min("parent").alias("parent"))
        )
        low = _to_ends(materialize(low, "ccp"), n, max_rounds, few)
        levels.append(low)
        to = lambda c: low.select(F.col("node").alias(c), F.col("parent").alias(f"{c}2"))
        half = look_up(live, to("a"), "a", n, few)
        half = look_up(half if n <= few else materialize(half, "cc"), to("b"), "b", n, few)
        live = (
            half.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
            .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        live = materialize(live, "cc")
    else:
        raise RuntimeError("connected_components did not end; raise max_rounds")
    out = nodes.select("node", F.col("node").alias("component"))
    for low in levels:
        hop = low.select(F.col("node").alias("component"), F.col("parent").alias("_to"))
        out = look_up(out, hop, "component", n_nodes, few).select("node", F.coalesce("_to", "component").alias("component"))
        out = out if n_nodes <= few else materialize(out, "cco")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record(schema: str, *columns) -> pa.RecordBatch:
    """A record batch of *columns* (Arrow arrays, numpy arrays or lists) with the names and types of a DDL *schema*."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal *keys* (longs, not null) in sorted batches, one table each; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        start = 0
        for end in [*edge.tolist(), len(k)]:
            now = tuple(k[start].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
            last, start = now, end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def values(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy()


def in_blocks(rows: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """Add _i, _j, _side: a group of at most *block* rows is one block; a larger one is cut into parts of about
    that many, and each pair of parts is a block that holds both, so that no task holds a large group."""
    parts = F.ceil(F.col(size) / F.lit(block)).cast("int")
    rows = rows.withColumn("_s", F.when(F.col(size) <= block, 1).otherwise(parts))
    rows = rows.withColumn("_side", F.pmod(F.xxhash64(group, member), F.col("_s")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return rows.withColumn("_i", F.least("_side", "_o")).withColumn("_j", F.greatest("_side", "_o")).drop("_o", "_s")


def core_blocks(rows: DataFrame, group: str, member: str, total: int, block: int) -> DataFrame:
    """Add _i, _j, _side to rows of large groups, of which those with _in are known to be linked among themselves.

    Parts of the rows that are not _in meet every part; parts of _in rows meet only the former. A group whose
    rows are all _in gives no blocks: its work is linear. *rows* is materialised.
    """
    counts = rows.groupBy(group).agg(F.count_if("_in").alias("_core"), F.count_if(~F.col("_in")).alias("_out"), F.count("*").alias("_n"))
    placed = join_keyed(rows, materialize(counts, "cores"), group, "_n", total)
    parts = lambda c: F.greatest(F.ceil(F.col(c) / F.lit(block / 2)), F.lit(1)).cast("int")
    outs = F.when(F.col("_out") > 0, parts("_out")).otherwise(0)
    spread = F.xxhash64(member, F.lit(3))
    side = F.when(F.col("_in"), outs + F.pmod(spread, parts("_core"))).otherwise(F.pmod(spread, parts("_out"))).cast("int")
    met = F.when(F.col("_in"), outs).otherwise(outs + F.when(F.col("_core") > 0, parts("_core")).otherwise(0)).cast("int")
    blocks = placed.withColumns({"_side": side, "_met": met}).filter("_met > 0").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_met") - 1)))
    return blocks.withColumn("_i", F.least("_side", "_o")).withColumn("_j", F.greatest("_side", "_o")).drop("_o", "_met", "_core", "_out", "_n")


#: Pivots of a large group, about, and rows of one part of it.
PIVOTS, PART = 16, 512


def pivoted(rows: DataFrame, group: str, size: str, member: str, pivots: int = PIVOTS, part: int = PART) -> DataFrame:
    """Large groups in parts, with a few members of the group (about *pivots*, chosen by hash) in every part.

    Adds _part and _pivot (1 for the added copies); sorted by group, part and pivots first. Each row is there
    once and *pivots* rows more in each part: what compares the rows with the pivots does work in proportion to the group.
    """
    share = F.lit(float(pivots << 20)) / F.col(size)
    chosen = rows.filter(F.pmod(F.xxhash64(member, F.lit(7)), F.lit(1 << 20)) < share)
    parts = F.ceil(F.col(size) / F.lit(part)).cast("int")
    spread = rows.withColumn("_part", F.pmod(F.xxhash64(member, F.lit(5)), parts).cast("int")).withColumn("_pivot", F.lit(0))
    copies = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("_pivot", F.lit(1))
    both = spread.unionByName(copies)
    return both.repartition(group, "_part").sortWithinPartitions(group, "_part", F.col("_pivot").desc(), member)


def forest(n: int, linked: np.ndarray) -> np.ndarray:
    """Edges, as rows (from, to), of a spanning forest of the graph with boolean adjacency *linked* (n by n, symmetric)."""
    left = np.ones(n, dtype=bool)
    out = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            out += [(at, x) for x in new.tolist()]
            queue += new.tolist()
    return np.array(out, dtype=np.int64).reshape(-1, 2)
