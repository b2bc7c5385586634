"""Near-duplicate detection by SetSketch registers.

A sketch has registers ``max over shingles of floor(1 - log_b h_i)``, with h_i independent
exponential hashes: minima truncated to exponentially spaced values, which
merge by maximum and agree with a probability near the Jaccard similarity. The
stages are

1. collapse: documents with one shingle set become one class, which has a number of its own;
2. band: classes that agree in all registers of a band are compared there, by
   the joint likelihood of their two sketches; a pair is dropped only if the
   threshold is implausible by a likelihood-ratio test;
3. cluster: plausible pairs, as a spanning forest for each bucket, are contracted to clusters;
4. verify: the full shingle sets of a cluster are compared exactly, and
   components of exact links are the result.

No stage emits all pairs of a group: a bucket or cluster gives a spanning forest. A large
bucket or cluster is compared with a few pivots first, in parts; what a pivot links is one core, whose members need not meet
one another. Only what lies outside the core is compared with everything, in blocks: a group of near copies of
something costs work in proportion to its size. Work grows with the square only of what no pivot links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaerix.llm.common import connected_components, core_blocks, drop_rows, forest, in_blocks, join_keyed, look_up, materialize, pivoted, record, runs, sha_text, values
from quaerix.llm.shingles import Against, intersections, shingle_sets

BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
#: Registers in a band, and the chance that a pair at the threshold shares no band.
ROWS = 4
MISS = 1e-6
#: Twice the log-likelihood by which a similarity below the threshold must be likelier for a pair to be dropped.
DROP = 30.0
#: Classes compared in one block of a bucket, and documents verified in one block of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK = 256, 96
#: Up to so many clustered classes are broadcast (about 100 bytes each) to read their texts; more are joined by a shuffle.
MAX_BROADCAST = 1 << 19


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares none with a chance of *miss* at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _seeds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = rng.integers(0, 1 << 32, size=(2, registers), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return draw[0][:, None], draw[1][:, None]


def registers(hashes: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes (not empty), as uint16 registers."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    low = None
    for at in range(0, x.shape[1], 512):
        y = x[:, at : at + 512] * seeds[0]
        y ^= y >> np.uint32(15)
        y *= seeds[1]
        y ^= y >> np.uint32(13)
        now = y.min(axis=1)
        low = now if low is None else np.minimum(low, now)
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, drop: float = DROP) -> np.ndarray:
    """Which pairs of sketches (a[i], b[j]) may reach the threshold.

    Given both set sizes, the numbers of registers that are larger in a, larger in b and equal are
    multinomial with chances u - vJ, v - uJ and J, where u and v are the shares of the sizes.
    The likelihood's maximum over J has a closed form; a pair is dropped
    if it lies below the threshold and the likelihood there is smaller by *drop* / 2 in logarithm.
    """
    m = a.shape[1]
    above = np.zeros((len(a), len(b)), dtype=np.int32)
    same = np.zeros((len(a), len(b)), dtype=np.int32)
    for i in range(len(a)):
        above[i] = (a[i] > b).sum(axis=1)
        same[i] = (a[i] == b).sum(axis=1)
    below = m - above - same
    u = na[:, None] / (na[:, None] + nb[None, :])
    v = 1.0 - u
    p, q = u * u * (same + below), v * v * (same + above)
    best = (p + q - np.sqrt((p - q) ** 2 + 4.0 * below * above * u * u * v * v)) / (2.0 * m * u * v)
    most = np.minimum(u / v, v / u)
    best = np.clip(best, 0.0, most)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        term = lambda n, x: n * np.log(np.maximum(x, 1e-6))
        return term(above, u - v * j) + term(below, v - u * j) + term(same, j)

    fits = most >= threshold - 1e-9
    return fits & ((best >= threshold) | (2.0 * (log_likelihood(best) - log_likelihood(np.full_like(best, threshold))) < drop))


SKETCH = "doc_id long, sha binary, n_shingles long, set_id binary, regs binary"
EDGE = "a long, b long"


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def _body(text: str) -> F.Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def sketches(docs: DataFrame, width: int, count: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """SKETCH: sha is the text's SHA-256, set_id a 128-bit digest of the sorted set; set_id and regs are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(count)
        for batch in batches:
            sizes, names, regs = [], [], []
            for s in shingle_sets(_texts(batch), width):
                sizes.append(len(s))
                names.append(_digest(s) if len(s) else None)
                regs.append(registers(s, seeds).astype("<u2").tobytes() if len(s) else None)
            yield record(SKETCH, batch.column("doc_id"), batch.column("sha"), sizes, names, regs)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sha_text(F.col(text)).alias("sha"), _body(text))
    return rows.mapInArrow(run, SKETCH)


def _edges(member: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
    e = forest(len(member), linked)
    return record(EDGE, member[e[:, 0]], member[e[:, 1]])


def _sides(g: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    """Which rows of a block are of its first and of its second part; None if it is one part."""
    i, j, side = g.column("_i")[0].as_py(), g.column("_j")[0].as_py(), values(g, "_side")
    return None if i == j else (np.flatnonzero(side == i), np.flatnonzero(side == j))


def _grouped(blocks: DataFrame, group: str, member: str) -> DataFrame:
    return blocks.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j", member)


def candidate_edges(classes: DataFrame, bands: int, threshold: float, rows: int = ROWS, block: int = BUCKET_BLOCK) -> DataFrame:
    """(a, b): for every bucket of every band a spanning forest of its plausible pairs; of a large one, its core is one tree."""
    n = classes.count()
    width = rows * 2
    key = lambda b: F.xxhash64(b, F.substring(F.col("regs"), b * width + 1, F.lit(width)))
    keys = classes.select("cid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).alias("key"))
    crowded = materialize(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "crowded")

    def held(some: DataFrame) -> DataFrame:
        return join_keyed(keys, some, "key", "m", n).join(classes.select("cid", "n_shingles", "regs"), "cid")

    def sketch(g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        regs = np.frombuffer(b"".join(g.column("regs").to_pylist()), dtype="<u2").reshape(g.num_rows, -1)
        return values(g, "cid"), regs, values(g, "n_shingles").astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ["key", "_i", "_j"]):
            cid, regs, size = sketch(g)
            sides = _sides(g)
            if sides is None:
                linked = plausible(regs, regs, size, size, threshold)
            else:
                x, y = sides
                linked = np.zeros((len(cid), len(cid)), dtype=bool)
                if len(x) and len(y):
                    cross = plausible(regs[x], regs[y], size[x], size[y], threshold)
                    linked[np.ix_(x, y)] = cross
                    linked[np.ix_(y, x)] = cross.T
            yield _edges(cid, linked)

    names = ["key", "cid", "n_shingles", "regs", "_i", "_j", "_side"]
    small = held(crowded.filter(F.col("m") <= block))
    blocks = small.withColumns({"_i": F.lit(0), "_j": F.lit(0), "_side": F.lit(0)}).select(names)
    found = _grouped(blocks, "key", "cid").mapInArrow(run, EDGE)
    if crowded.filter(F.col("m") > block).isEmpty():
        return found

    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row the bucket's pivot that it may be linked to, or null."""
        for g in runs(batches, ["key", "_part"]):
            cid, regs, size = sketch(g)
            p = values(g, "_pivot") == 1
            own, key = np.flatnonzero(~p), g.column("key")[0].as_py()
            to: list[int | None] = [None] * len(own)
            if p.any() and len(own):
                linked = plausible(regs[own], regs[p], size[own], size[p], threshold)
                first = cid[p][linked.argmax(axis=1)]
                to = [int(x) if ok else None for x, ok in zip(first, linked.any(axis=1), strict=True)]
            yield record("key long, a long, b long", [key] * len(own), cid[own], to)

    large = materialize(held(crowded.filter(F.col("m") > block)), "large")
    total = large.count()
    stars = materialize(pivoted(large, "key", "m", "cid").mapInArrow(near_pivot, "key long, a long, b long"), "stars")
    # All pivots of a bucket and what they may be linked to are one cluster: verifying tells them apart.
    core = stars.filter("b is not null")
    tops = core.groupBy("key").agg(F.min("b").alias("a"))
    pivot_edges = core.select("key", "b").distinct().join(tops, "key").select("a", "b").filter("a <> b")
    flags = stars.select("key", F.col("a").alias("cid"), F.col("b").isNotNull().alias("_in"))
    rest = core_blocks(materialize(large.join(flags, ["key", "cid"]), "placed"), "key", "cid", total, block).select(names)
    return found.unionByName(core.select("a", "b")).unionByName(pivot_edges).unionByName(_grouped(rest, "key", "cid").mapInArrow(run, EDGE))


def verified_edges(docs: DataFrame, clusters: DataFrame, width: int, percent: int, text: str = "text", id_col: str = "doc_id", block: int = CLUSTER_BLOCK) -> DataFrame:
    """(a, b): edges between classes of a cluster (cid, doc_id, set_id, cluster, m) whose full sets reach the threshold.

    They have the components of all such pairs: those of a small cluster are a spanning forest; in a large one, the core of
    what its pivots link is left out of the comparison of all with all.
    """
    small = clusters.count() <= MAX_BROADCAST
    side = clusters.withColumnRenamed("doc_id", "_rep")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _body(text))
    held = texts.join(F.broadcast(side) if small else side, F.col("doc_id").eqNullSafe(F.col("_rep")))
    sets_of = "cid long, cluster long, m long, shingles binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An id may stand for several texts and a text for several rows: the digest finds the class's own set, once in a task.
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            names = zip(*(batch.column(c).to_pylist() for c in ("cid", "cluster", "m", "set_id")), strict=True)
            for s, (cid, cluster, m, digest) in zip(shingle_sets(_texts(batch), width), names, strict=True):
                if cid not in seen and _digest(s) == digest:
                    seen.add(cid)
                    out.append((cid, cluster, m, s.tobytes()))
            yield record(sets_of, *(zip(*out, strict=True) if out else [[]] * 4))

    def own_sets(g: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The rows of distinct classes, which are sorted, and their sets."""
        cid = values(g, "cid")
        at = np.flatnonzero(np.concatenate(([True], cid[1:] != cid[:-1])))
        data = g.column("shingles")
        return at, cid[at], [np.frombuffer(data[int(i)].as_py(), dtype=np.uint64) for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ["cluster", "_i", "_j"]):
            at, cid, sets = own_sets(g)
            if len(cid) < 2:
                continue
            both = intersections(sets)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            if _sides(g) is not None:
                side = values(g, "_side")[at]
                linked &= side[:, None] != side[None, :]
            yield _edges(cid, linked)

    sets = held.mapInArrow(read, sets_of)
    large = clusters.filter(F.col("m") > block).select("cluster").distinct()
    some = not large.isEmpty()
    if some:
        sets = materialize(sets, "sets")
    names = ["cluster", "cid", "shingles", "_i", "_j", "_side"]
    blocks = in_blocks(sets.filter(F.col("m") <= block), "cluster", "m", "cid", block).select(names)
    found = _grouped(blocks, "cluster", "cid").mapInArrow(run, EDGE)
    if not some:
        return found

    def near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a part's members to the cluster's pivots: each member's first one, and those that join pivots."""
        at = None
        for batch in batches:
            part = [tuple(x) for x in zip(*(batch.column(c).to_pylist() for c in ("cluster", "_part", "_pivot", "cid")), strict=True)]
            data, out = batch.column("shingles"), []
            for i, (cluster, number, is_pivot, cid) in enumerate(part):
                if at != (cluster, number):
                    at, fixed, against, up, last = (cluster, number), {}, None, {}, None
                s = np.frombuffer(data[i].as_py(), dtype=np.uint64)
                if is_pivot:
                    fixed[cid] = s
                    continue
                if cid == last or not fixed:
                    continue
                last = cid
                if against is None:
                    ids, against = list(fixed), Against(list(fixed.values()))
                    up = {c: c for c in ids}
                both = against.both(s)
                first = None
                for k in np.flatnonzero(100 * both >= percent * (against.sizes + len(s) - both)).tolist():
                    top = ids[k]
                    while up[top] != top:
                        top = up[top]
                    if first is None:
                        first = top
                        out.append((cid, ids[k]))
                    elif top != first:
                        up[top] = first
                        out.append((cid, ids[k]))
            yield record(EDGE, *(zip(*out, strict=True) if out else [[]] * 2))

    big = sets.filter(F.col("m") > block)
    total = big.count()
    stars = materialize(pivoted(big, "cluster", "m", "cid").mapInArrow(near_pivots, EDGE), "stars")
    parts = materialize(connected_components(stars).withColumnRenamed("node", "cid"), "parts")
    placed = big.join(parts, "cid", "left")
    tops = placed.filter("component is not null").groupBy("cluster", "component").agg(F.count("*").alias("n"))
    tops = tops.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("_core"))
    sized = materialize(big.groupBy("cluster").agg(F.count("*").alias("_rows")).join(tops, "cluster", "left"), "tops")
    placed = join_keyed(placed, sized, "cluster", "_rows", total).withColumn("_in", F.coalesce(F.col("component") == F.col("_core"), F.lit(False)))
    rest = core_blocks(materialize(placed.select("cluster", "cid", "shingles", "_in"), "placed"), "cluster", "cid", total, block).select(names)
    return found.unionByName(stars).unionByName(_grouped(rest, "cluster", "cid").mapInArrow(run, EDGE))


def _named(docs: DataFrame, width: int, percent: int, text: str, id_col: str) -> DataFrame:
    """(doc_id, sha, n_shingles, component, component_id): component is a class's number, null without shingles."""
    bands = bands_for(percent)
    rows = materialize(sketches(docs, width, bands * ROWS, text, id_col), "sketches")
    n = rows.count()
    full = rows.filter("n_shingles > 0")
    grouped = full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    # The number of a class is settled when the table is written; ids may be null or repeat, so they name no class.
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    maybe = materialize(connected_components(candidate_edges(classes, bands, percent / 100)).withColumnsRenamed({"node": "cid", "component": "cluster"}), "clusters")
    total = maybe.count()
    sizes = materialize(maybe.groupBy("cluster").agg(F.count("*").alias("m")), "sizes")
    maybe = join_keyed(maybe, sizes, "cluster", "m", total).join(classes.select("cid", F.col("rep").alias("doc_id"), "set_id"), "cid")
    sure = connected_components(verified_edges(docs, materialize(maybe, "clustered"), width, percent, text, id_col))
    sure = materialize(sure.withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid"), "sure")
    smallest = materialize(sure.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    sure = look_up(sure.select("cid", "component"), smallest, "component", total)
    named = classes.select("set_id", "cid", "rep", "members").join(sure, "cid", "left")
    named = named.select("set_id", "members", F.coalesce("component", "cid").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    named = materialize(named, "named")
    names = ["doc_id", "sha", "n_shingles", "component", "component_id"]
    out = join_keyed(full.select("doc_id", "sha", "n_shingles", "set_id"), named, "set_id", "members", n).select(names)
    alone = rows.filter("n_shingles = 0").select("doc_id", "sha", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of
    *width*-word shingles; component_id is the smallest doc_id reachable by links,
    and the document with that id is kept. A text with fewer words is one
    shingle; null, empty and blank texts have none and are linked with nothing.

    A document with a null id is linked like others but gives no name: it is kept only if no document of its component
    has an id (component_id is null then). Rows that repeat an id with one text are in one component; an id
    with two texts stands for two documents. An empty table gives no rows; other columns are ignored.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return _named(docs, width, percent, text, id_col).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (then the smallest hash of its text);
    rows that repeat id and text count once. Documents without words stay, each row of them."""
    rows = materialize(_named(docs, width, percent, text, id_col).filter("component is not null").select("doc_id", "sha", "component"), "named")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "sha"))
    groups = materialize(rows.groupBy("component").agg(F.count("*").alias("m"), best.alias("best")).filter("m > 1"), "groups")
    marked = materialize(join_keyed(rows, groups, "component", "m", rows.count()), "marked")
    wins = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sha") == F.col("best.sha"))
    losers = materialize(marked.filter(~wins).select("doc_id", "sha").distinct(), "losers")
    repeats = materialize(marked.filter(wins).groupBy("doc_id", "sha").agg(F.count("*").alias("m")).filter("m > 1").drop("m"), "repeats")
    return drop_rows(docs, losers, repeats, text, id_col)


#: Of `near_duplicates` over documents with unique ids, with 3 words and 85 %: all pairs by their common shingles, and a recursion over the links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, b AS to_id FROM d UNION SELECT r.doc_id, d.b FROM r JOIN d ON d.a = r.to_id),
c AS (SELECT doc_id, least(doc_id, min(to_id)) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
