"""Embedding near-duplicates by iterative quantisation.

Equal vectors of a label are one class. A rotation of the centred vectors is learned by iterative quantisation, which alternates
between binary codes and the rotation that fits them best; signs of the turned vectors are balanced
binary codes. Codes longer than a vector come from further rotations, each learned from its own start. A code is cut into
substrings, one for each table of a multi-index. A class is entered under all keys in the Hamming ball of radius
`radius` around each of its substrings, so that two codes meet in a table if their substrings differ in up to twice as many bits.
Among the classes that meet, those whose whole codes differ in more bits than the
threshold explains are told apart by the codes alone; only what is left is joined to its vectors and reranked by cosine in double precision.

How many bits, tables and differing bits are needed is measured on pairs made for it: vectors of the sample and their images at just the
threshold in random directions. So the index also fits vectors that share a direction, where centring widens angles.

Buckets and clusters may be large. A large bucket is compared with a few pivots first (see `common.pivoted`). In a large cluster,
vectors within half the linking angle of the cluster's mean are linked to one another by the triangle inequality,
whatever their number: they are chained and counted without comparing them; only vectors outside are compared with all others, in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaerix.llm.common import connected_components, core_blocks, forest, join_keyed, look_up, materialize, pivoted, record, runs, values

#: Vectors that rotations are learned from, at most; taken by a hash.
SAMPLE = 4096
ITERATIONS = 40
#: The share of pairs just at the threshold that meet in no table, and of those whose codes differ in more bits than are allowed.
MISS, CUT = 0.01, 0.002
#: Pairs of codes compared that weigh as much as one key that is shuffled, when the tables are chosen.
COLLISIONS = 64
#: Radii of the balls that are tried. With 0 (no probing) fewer keys would do, but several times as many rotations.
RADII = (1, 2)
#: Most bits of a code.
LONGEST = 2048
#: Rows of one block.
BLOCK = 256

UNIT = "vec_id long, label string, digest binary, unit binary"
EDGE = "a long, b long"


def learn_rotation(x: np.ndarray, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Iterative quantisation: from a random rotation, alternate codes B = sign(xR) and the orthogonal Procrustes R."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    # With fewer vectors than dimensions nothing can be fitted: codes would only follow the few.
    for _ in range(iterations if len(x) > d else 0):
        b = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(b.T @ x)
        r = (u @ vt).T
    return r


def _at_threshold(x: np.ndarray, cosine: float, seed: int = 1) -> np.ndarray:
    """For each unit vector another one at just that cosine, in a random direction."""
    y = np.random.default_rng(seed).standard_normal(x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    return cosine * x + math.sqrt(1.0 - cosine * cosine) * y / np.where(norm > 0, norm, 1.0)


class Index:
    """Rotations, substrings and the Hamming bound for vectors of one length."""

    def __init__(self, x: np.ndarray, n: int, cosine: float) -> None:
        """Learn from the unit vectors *x* an index for *n* vectors.

        Of two centres (mean and origin), two radii and all lengths of substrings, those are taken that need the least work: keys, and
        rows compared because they meet by chance.
        """
        d = x.shape[1]
        fit = x if len(x) else np.random.default_rng(0).standard_normal((64, d)) / math.sqrt(d)
        near = _at_threshold(fit, cosine) if d > 1 else fit
        best: tuple | None = None
        for centre in (fit.mean(axis=0), np.zeros(d)):
            c = fit - centre
            axes = np.linalg.svd(np.cov(c.T).reshape(d, d))[0] if len(fit) > d else np.eye(d)
            # The mean is nothing to learn around if a vector may lie on it: such vectors have no direction from there.
            apart = 1.0 - np.minimum(np.linalg.norm(c, axis=1), 1.0)
            if centre.any() and (apart > 1.0 - 1e-9).any():
                continue
            turns = [axes @ learn_rotation(c @ axes, seed) for seed in range(2)]
            r = np.concatenate(turns, axis=1)
            same = ((fit - centre) @ r >= 0) == ((near - centre) @ r >= 0)
            others = np.random.default_rng(2).permutation(len(fit))
            chance = (((fit - centre) @ r >= 0) == ((fit[others] - centre) @ r >= 0))[others != np.arange(len(fit))]
            most = min(28 + max(n, 2).bit_length() // 2, 2 * d)
            for bits in range(min(8, 2 * d), most + 1):
                for radius in RADII:
                    keys = sum(math.comb(bits, k) for k in range(radius + 1))
                    meet = _meeting(same, bits, radius)
                    if meet <= 0:
                        continue
                    tables = max(1, math.ceil(math.log(MISS) / math.log1p(-min(meet, 1.0 - MISS))))
                    if tables * bits > LONGEST:
                        continue
                    by_chance = n * max(_meeting(chance, bits, radius) if len(chance) else 0.0, float(keys) / 2.0**bits)
                    work = tables * keys * (1.0 + min(by_chance, 1.0) + by_chance / (COLLISIONS * keys))
                    if best is None or work < best[0]:
                        best = (work, centre, axes, bits, radius, tables)
        if best is None:
            best = (0, np.zeros(d), np.eye(d), min(16, 2 * d), 1, LONGEST // min(16, 2 * d))
        _, self.mean, axes, self.bits, self.radius, self.tables = best
        c = (fit - self.mean) @ axes
        # Long enough for the tables, and for telling vectors apart that only meet by chance.
        need = max(self.bits * self.tables, 2 * math.ceil(math.log2(max(n, 2))) + 64)
        self.turns = np.concatenate([axes @ learn_rotation(c, seed) for seed in range(-(-need // d))], axis=1)
        apart = (self.signs(fit) != self.signs(near)).sum(axis=1)
        self.most = int(np.quantile(apart, 1.0 - CUT)) + 2
        self.masks = _ball(self.bits, self.radius)

    def signs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turns >= 0

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes (bytes), and for each row its substring of each table."""
        s = self.signs(x)
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return np.packbits(s, axis=1), s[:, : self.bits * self.tables].reshape(len(x), self.tables, self.bits) @ weights

    def keys(self, substrings: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """64-bit keys of all balls' members, by table and salt (a label's hash)."""
        table = np.arange(self.tables, dtype=np.uint64)[None, :, None] * np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            h = (substrings[:, :, None] ^ self.masks[None, None, :]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + table + salt[:, None, None]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return h.reshape(len(substrings), -1).astype(np.int64)


def _ball(bits: int, radius: int) -> np.ndarray:
    """Masks with at most *radius* of *bits* bits."""
    out = [0]
    if radius:
        out += [1 << i for i in range(bits)]
    if radius > 1:
        out += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return np.array(out, dtype=np.int64)


def _meeting(same: np.ndarray, bits: int, radius: int) -> float:
    """The share of pairs whose substrings of so many bits differ in at most twice *radius* bits, over all substrings of *same*."""
    whole = same[:, : same.shape[1] // bits * bits]
    if not whole.size:
        return 0.0
    return float(((~whole).reshape(len(same), -1, bits).sum(axis=2) <= 2 * radius).mean())


_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of packed codes, all with all."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(a.shape[1]):
        out += _BITS[a[:, k][:, None] ^ b[:, k][None, :]]
    return out


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what may not be linked."""
    out: list[np.ndarray | None] = []
    for scalar in column:
        v = None if not scalar.is_valid else scalar.values
        if v is None or not len(v) or v.null_count:
            out.append(None)
            continue
        x = v.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        # Scaled by the largest component first: squares of very large or small ones neither overflow nor vanish.
        x = x / top
        out.append(x / np.sqrt((x * x).sum()) + 0.0)
    return out


def usable(vectors: DataFrame, vec: str, id_col: str, label: str) -> DataFrame:
    """UNIT of every row: digest (of label and unit vector) and unit are null for a vector that is linked with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            units = [None if lab is None else u for lab, u in zip(labels, _units(batch.column("v")), strict=True)]
            data = [None if u is None else u.tobytes() for u in units]
            digests = [None if b is None else hashlib.blake2b(b + lab.encode(), digest_size=16).digest() for b, lab in zip(data, labels, strict=True)]
            yield record(UNIT, batch.column("vec_id"), batch.column("label"), digests, data)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, UNIT)


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def learn(classes: DataFrame, n: int, cosine: float, sample: int = SAMPLE) -> dict[int, Index]:
    """An index for each length of vector (bytes), from at most *sample* vectors in all; every length that occurs has one."""
    rate = min(1.0, sample / max(n, 1))
    some = classes.filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) + 1)).select("digest", "unit")
    taken = some.orderBy("digest").limit(sample).select("unit").collect()
    by: dict[int, list] = {}
    for r in taken:
        by.setdefault(len(r["unit"]), []).append(np.frombuffer(bytes(r["unit"])))
    # Lengths are a few numbers, whatever the number of vectors; one that the sample lacks is rare.
    lengths = [r["n"] for r in classes.select(F.length("unit").alias("n")).distinct().collect()]
    return {d: Index(np.array(by[d]) if d in by else np.zeros((0, d // 8)), n, cosine) for d in lengths}


def candidate_edges(classes: DataFrame, models: dict[int, Index], block: int = BLOCK) -> DataFrame:
    """(a, b): for every bucket of the tables a spanning forest of the pairs whose codes may be of linked vectors."""
    shipped = classes.sparkSession.sparkContext.broadcast(models)
    code = "cid long, length long, code binary, keys array<long>"

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("unit").to_pylist()
            size = np.array([len(b) for b in data])
            for d in np.unique(size).tolist():
                at, own = np.flatnonzero(size == d), shipped.value[d]
                cid = batch.column("cid").take(pa.array(at))
                salt = np.array([int.from_bytes(hashlib.blake2b(f"{d}:{batch.column('label')[int(i)].as_py()}".encode(), digest_size=8).digest(), "little") for i in at], dtype=np.uint64)
                # In parts, so that the keys of many tables do not fill the memory.
                step = max(1, (1 << 20) // max(own.tables * len(own.masks), own.turns.shape[1]))
                for i in range(0, len(at), step):
                    some = at[i : i + step]
                    packed, substrings = own.codes(np.frombuffer(b"".join(data[j] for j in some)).reshape(len(some), -1))
                    keys = own.keys(substrings, salt[i : i + step])
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
                    yield record(code, cid.slice(i, len(some)), [d] * len(some), [c.tobytes() for c in packed], lists)

    coded = materialize(classes.select("cid", "label", "unit").mapInArrow(entered, code), "codes")
    keys = coded.select("cid", F.explode("keys").alias("key"))
    total = int(coded.agg(F.sum(F.size("keys"))).first()[0] or 0)
    crowded = materialize(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "crowded")

    def held(some: DataFrame) -> DataFrame:
        return join_keyed(keys, some, "key", "m", total).join(coded.select("cid", "length", "code"), "cid")

    def codes(g: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        data = g.column("code").to_pylist()
        return values(g, "cid"), np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1), shipped.value[g.column("length")[0].as_py()].most

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ["key", "_i", "_j", "length"]):
            cid, c, most = codes(g)
            linked = hamming(c, c) <= most
            if g.column("_i")[0].as_py() != g.column("_j")[0].as_py():
                side = values(g, "_side")
                linked &= side[:, None] != side[None, :]
            e = forest(len(cid), linked)
            yield record(EDGE, cid[e[:, 0]], cid[e[:, 1]])

    names = ["key", "length", "cid", "code", "_i", "_j", "_side"]
    dealt = lambda rows: rows.select(names).repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "length", "cid").mapInArrow(near, EDGE)
    found = dealt(held(crowded.filter(F.col("m") <= block)).withColumns({"_i": F.lit(0), "_j": F.lit(0), "_side": F.lit(0)}))
    if crowded.filter(F.col("m") > block).isEmpty():
        return found

    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ["key", "_part"]):
            p, length = values(g, "_pivot") == 1, values(g, "length")
            key, to = g.column("key")[0].as_py(), {}
            # One key may, by chance, be shared by vectors of several lengths.
            for d in np.unique(length).tolist():
                part = g.filter(pa.array(length == d))
                cid, c, most = codes(part)
                mine = p[length == d]
                linked = hamming(c[~mine], c[mine]) <= most if mine.any() else np.zeros(((~mine).sum(), 0), dtype=bool)
                for i, row in zip(cid[~mine].tolist(), linked, strict=True):
                    to[i] = int(cid[mine][row.argmax()]) if row.any() else None
            yield record("key long, a long, b long", [key] * len(to), list(to), list(to.values()))

    large = materialize(held(crowded.filter(F.col("m") > block)), "large")
    stars = materialize(pivoted(large, "key", "m", "cid").mapInArrow(near_pivot, "key long, a long, b long"), "stars")
    core = stars.filter("b is not null")
    tops = core.groupBy("key").agg(F.min("b").alias("a"))
    # What pivots of a bucket may be linked to is one cluster; cosines tell its parts apart.
    pivots = core.select("key", "b").distinct().join(tops, "key").select("a", "b").filter("a <> b")
    flags = stars.select("key", F.col("a").alias("cid"), F.col("b").isNotNull().alias("_in"))
    rest = core_blocks(materialize(large.join(flags, ["key", "cid"]), "placed"), "key", "cid", large.count(), block)
    return found.unionByName(core.select("a", "b")).unionByName(pivots).unionByName(dealt(rest))


def _paired(rows: DataFrame, cosine: float, total: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks in which the pairs of each cluster meet, and the members of the tight balls (cluster, cid, w, ball, first), which need not meet.

    rows, materialised: cluster, m, cid, w, unit. A cluster of at most *block* rows is one block. Of a larger one, the
    rows within half the linking angle of the cluster's mean are its ball; the parts of the others meet every part.
    """
    names = ["cluster", "cid", "w", "unit", "_i", "_j", "_side"]
    small = rows.filter(F.col("m") <= block).withColumns({"_i": F.lit(0), "_j": F.lit(0), "_side": F.lit(0)}).select(names)
    large = rows.filter(F.col("m") > block)
    half = math.cos(math.acos(cosine) / 2 - 1e-7)
    sums = "cluster long, d long, total binary"

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One sum of vectors for each cluster that a task meets; there are fewer large clusters than rows over *block*."""
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for cluster, unit in zip(batch.column("cluster").to_pylist(), batch.column("unit").to_pylist(), strict=True):
                x = np.frombuffer(unit)
                key = cluster, len(x)
                totals[key] = totals[key] + x if key in totals else x.copy()
        yield record(sums, [k[0] for k in totals], [k[1] for k in totals], [v.tobytes() for v in totals.values()])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ["cluster", "d"]):
            x = matrix(g.column("total")).sum(axis=0)
            n = np.linalg.norm(x)
            yield record("cluster long, mean binary", [g.column("cluster")[0].as_py()], [(x / n if n > 0 else x).tobytes()])

    parts = large.select("cluster", "unit").mapInArrow(added, sums).repartition("cluster").sortWithinPartitions("cluster", "d")
    means = parts.mapInArrow(merged, "cluster long, mean binary").join(large.groupBy("cluster").agg(F.count("*").alias("_rows")), "cluster")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [len(u) == len(c) and float(np.frombuffer(u) @ np.frombuffer(c)) >= half for u, c in zip(batch.column("unit").to_pylist(), batch.column("mean").to_pylist(), strict=True)]
            yield record("cluster long, cid long, w long, unit binary, _in boolean", *(batch.column(c) for c in ("cluster", "cid", "w", "unit")), near)

    held = join_keyed(large, materialize(means, "means"), "cluster", "_rows", total).select("cluster", "cid", "w", "unit", "mean")
    placed = materialize(held.mapInArrow(inside, "cluster long, cid long, w long, unit binary, _in boolean"), "placed")
    ball = placed.filter("_in").select("cluster", "cid", "w")
    sized = ball.groupBy("cluster").agg(F.sum("w").alias("ball"), F.min("cid").alias("first"), F.count("*").alias("_rows"))
    balls = join_keyed(ball, materialize(sized, "balls"), "cluster", "_rows", total)
    return small.unionByName(core_blocks(placed, "cluster", "cid", total, block).select(names)), balls


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.93, vec: str = "embedding", id_col: str = "vec_id", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label (not null) are linked if their cosine is at least
    *cosine*; component_id is the smallest vec_id reachable by links, and its
    vector is kept. Null, empty and zero vectors and those with null or
    non-finite components are linked with nothing, and so are vectors of different lengths. Equal vectors are linked like any others.
    A vector with a null id is linked and counted, but gives no name: it is kept only if no vector of its component has an
    id (component_id is null then). Rows that repeat an id are vectors of their own. An empty
    table gives no rows; other columns are ignored.
    """
    rows = materialize(usable(vectors, vec, id_col, label), "units")
    total = rows.count()
    full = rows.filter("digest is not null")
    grouped = full.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    # The number of a class is settled when the table is written; ids may be null or repeat, so they name no class.
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    found = connected_components(candidate_edges(classes, learn(classes, n, cosine, sample)))
    found = materialize(found.withColumnsRenamed({"node": "cid", "component": "cluster"}), "clusters")
    held = found.count()
    sizes = materialize(found.groupBy("cluster").agg(F.count("*").alias("m")), "sizes")
    inside = join_keyed(found, sizes, "cluster", "m", held).join(classes.select("cid", "w", "unit"), "cid")
    blocks, balls = _paired(materialize(inside, "inside"), cosine, held)
    result = "a long, b long, n long"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of a spanning forest of a block (n null), and how many rows each class is linked with there (b null)."""
        for g in runs(batches, ["cluster", "_i", "_j"]):
            cid, w = values(g, "cid"), values(g, "w")
            x = matrix(g.column("unit"))
            linked = x @ x.T >= cosine
            if g.column("_i")[0].as_py() != g.column("_j")[0].as_py():
                side = values(g, "_side")
                linked &= side[:, None] != side[None, :]
            np.fill_diagonal(linked, False)
            e = forest(len(cid), linked)
            yield record(result, [*cid[e[:, 0]].tolist(), *cid.tolist()], [*cid[e[:, 1]].tolist(), *[None] * len(cid)], [*[None] * len(e), *(linked @ w).tolist()])

    order = ["cluster", "_i", "_j"]
    linked = materialize(blocks.repartition(*order).sortWithinPartitions(*order, "cid").mapInArrow(link, result), "linked")
    balls = materialize(balls, "chained")
    edges = linked.filter("b is not null").select("a", "b").unionByName(balls.filter("cid <> first").select(F.col("cid").alias("a"), F.col("first").alias("b")))
    counted = linked.filter("b is null").select(F.col("a").alias("cid"), "n").unionByName(balls.select("cid", (F.col("ball") - F.col("w")).alias("n")))
    counted = counted.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = materialize(connected_components(edges).withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid"), "parts")
    smallest = materialize(parts.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    parts = look_up(parts.select("cid", "component"), smallest, "component", held)
    named = classes.select("digest", "cid", "rep", "w").join(parts, "cid", "left").join(counted, "cid", "left")
    # Rows of one class are linked with one another, too.
    component = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id"))
    named = named.select("digest", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"), component.alias("component_id"))
    names = ["vec_id", "n_links", "component_id"]
    out = join_keyed(full.select("vec_id", "digest"), materialize(named, "named"), "digest", "w", total).select(names)
    alone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.unionByName(alone).withColumn("kept", kept)


#: Of `embedding_duplicates` over vectors with unique ids: all pairs of a label, and a recursion over the links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) >= 0.93 * a.n * b.n),
r AS (SELECT a AS vec_id, b AS to_id FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.to_id),
c AS (SELECT vec_id, least(vec_id, min(to_id)) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT v.vec_id, coalesce(k.n_links, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, v.vec_id = coalesce(c.component_id, v.vec_id) AS kept FROM v LEFT JOIN k USING (vec_id) LEFT JOIN c USING (vec_id)
"""
