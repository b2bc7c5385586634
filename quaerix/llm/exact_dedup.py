"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Every row has one bit of a virtual bit array, chosen by a hash of its text's SHA-256. Pass 1 finds the bits that at least
two rows set: a task gathers the positions of its rows by range of the array, one row for each range,
and ranges are merged in two steps, each of which keeps what is there once and what is there twice. Those bits are put into a
Bloom filter, which is broadcast. Pass 2 probes: a row that the filter does not know is certainly alone
and passes straight through; the other rows, and no others, are shuffled and grouped by
hash. The filter's size has a bound: beyond it, it grows denser and more rows are shuffled than
need be, but the method and its result stay the same. False positives cost a shuffled row, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaerix.llm.common import drop_rows, join_keyed, materialize, sha_text

#: Rows of one range of the bit array, about; a range has 2**32 bits.
RANGE = 1 << 18
#: Groups of tasks whose positions are merged before all are.
SALTS = 8
#: Bits of the broadcast filter for each repeated bit, and 64-bit words that it has at most (about 50 bytes of memory each).
BITS, MAX_WORDS = 16, 1 << 20


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, sha) of every row; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), sha_text(F.col(text)).alias("sha"))


def _bit(ranges: int) -> tuple[Column, Column]:
    """The range and the position in it (an int) of a row's bit."""
    h = F.xxhash64("sha")
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(ranges)).alias("range"), (h.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int").alias("pos")


def _twice(positions: Column) -> Column:
    """The distinct positions that an array has at least twice."""
    ordered = F.array_sort(positions)
    return F.array_distinct(F.array_compact(F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: F.when(a == b, a))))


def repeated_bits(prints: DataFrame, rows: int) -> DataFrame:
    """(range, pos): the bits that at least two rows set. What is shuffled has one row for each range and task."""
    where, pos = _bit(max(1, -(-rows // RANGE)))
    local = prints.select(where, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), pos).groupBy("range", "salt").agg(F.collect_list("pos").alias("p"))
    local = local.select("range", F.array_distinct("p").alias("once"), _twice(F.col("p")).alias("twice"))
    merged = local.groupBy("range").agg(F.flatten(F.collect_list("once")).alias("once"), F.flatten(F.collect_list("twice")).alias("twice"))
    return merged.select("range", F.explode(F.array_union(_twice(F.col("once")), F.array_distinct("twice"))).alias("pos"))


def _slots(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("range", "pos", F.lit(k)), F.lit(bits)) for k in (1, 2)]


def bloom(repeats: DataFrame, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """(word, mask) of a Bloom filter of *repeats* (materialised) with two hashes, and its number of bits."""
    bits = min(1 << max(16, (repeats.count() * BITS - 1).bit_length()), max_words * 64)
    slots = repeats.select(F.explode(F.array(*_slots(bits))).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("mask")), bits


def probed(prints: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """*prints* (materialised) with _maybe: whether a row's text may occur again; false is certain. Nothing is shuffled by row."""
    rows = prints.count()
    words, bits = bloom(materialize(repeated_bits(prints, rows), "repeats"), max_words)
    words = materialize(words, "bloom")
    where, pos = _bit(max(1, -(-rows // RANGE)))
    one, two = _slots(bits)
    probe = prints.withColumns({"range": where, "pos": pos}).withColumns({"_one": one, "_two": two})
    for c in ("_one", "_two"):
        # At most max_words rows.
        side = words.select(F.col("word").alias(f"{c}w"), F.col("mask").alias(f"{c}m"))
        probe = probe.join(F.broadcast(side), F.shiftright(c, 6) == F.col(f"{c}w"), "left")
    hit = lambda c: F.coalesce(F.expr(f"{c}m & shiftleft(1L, cast({c} & 63 as int))"), F.lit(0)) != 0
    return probe.select("doc_id", "sha", (hit("_one") & hit("_two")).alias("_maybe"))


def _grouped(docs: DataFrame, text: str, id_col: str, max_words: int) -> tuple[DataFrame, DataFrame]:
    """The rows that are certainly alone (doc_id, sha), and the others with keep_id and group_size of their group."""
    prints = materialize(fingerprints(docs, text, id_col), "prints")
    probe = probed(prints, max_words)
    maybe = materialize(probe.filter("_maybe").drop("_maybe"), "maybe")
    groups = materialize(maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return probe.filter("not _maybe").drop("_maybe"), join_keyed(maybe, groups, "sha", "group_size", maybe.count())


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_words: int = MAX_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null text equals empty
    text. Rows repeated with the same id and text count as members of their
    group, and each of them is kept if its id is the largest. A null id never beats a number; where all ids of
    a group are null, keep_id is null and its rows are kept. An id with two texts is two documents. An empty table
    gives no rows; other columns are ignored.
    """
    alone, seen = _grouped(docs, text, id_col, max_words)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept")
    name = F.lower(F.hex("sha")).alias("text_sha256")
    out = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), name)
    return out.unionByName(seen.select("doc_id", "keep_id", "group_size", kept, name))


def drop_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each text, with all its columns: one with the largest id. Only hashes are shuffled, and rows that repeat id and text."""
    _, seen = _grouped(docs, text, id_col, MAX_WORDS)
    seen = materialize(seen.filter("group_size > 1"), "seen")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    losers = materialize(seen.filter(~wins).select("doc_id", "sha").distinct(), "losers")
    repeats = materialize(seen.filter(wins).groupBy("doc_id", "sha").agg(F.count("*").alias("m")).filter("m > 1").drop("m"), "repeats")
    return drop_rows(docs, losers, repeats, text, id_col)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
