"""Okapi BM25 over stored postings, for many questions at once.

An index holds each document's length and counted terms, the terms' idf and sizes of repositories; it is built once and
written by repository. Terms are counted within their document, so no posting is shuffled or sorted. A question's terms meet
postings by a join on (repository, term), and scores are one aggregation. Documents that match nothing score zero and are part of the result, so
the first ``2k`` of a repository stand by to fill a list of fewer than k matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaerix.functions.text import tokens
from quaerix.session import settled

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Question terms, documents that stand by, and the like are broadcast up to so many rows.
MAX_BROADCAST = 1 << 18


def fits(df: DataFrame, most: int = MAX_BROADCAST) -> bool:
    """Whether *df* has at most *most* rows, which is counted."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """*df* with a broadcast hint if it has at most *most* rows; joined by a shuffle otherwise."""
    return F.broadcast(df) if fits(df, most) else df


#: Characters of a repository's texts that are counted and written at once.
PART = 1 << 23


def seen(chunks: DataFrame) -> DataFrame:
    """(repository, id, n, chars): how many rows have an id, and characters of their texts."""
    return chunks.groupBy("repository", "id").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("searchable_text", F.lit("")))).alias("chars"))


def counted(chunks: DataFrame) -> DataFrame:
    """(repository, id, dl, terms, tfs): a row for each text, its distinct terms and their counts side by side.

    Sorted tokens are counted by where a run begins: the work stays within the row.
    """
    t = chunks.select("repository", "id", F.sort_array(tokens(F.col("searchable_text"))).alias("_s"))
    t = t.withColumn("_at", F.filter(F.transform("_s", lambda x, i: F.when((i == 0) | (x != F.get("_s", i - 1)), i)), lambda i: i.isNotNull()))
    n = F.size("_s")
    return t.select(
        "repository", "id", n.cast("long").alias("dl"), F.transform("_at", lambda i: F.get("_s", i)).alias("terms"),
        F.transform("_at", lambda i, j: (F.coalesce(F.get("_at", j + 1), n) - i).cast("long")).alias("tfs"),
    )


def counted_together(chunks: DataFrame) -> DataFrame:
    """`counted` for ids that have several rows: those of an id and length have one list of terms, in one of their rows."""
    t = chunks.select("repository", "id", tokens(F.col("searchable_text")).alias("_s")).withColumn("dl", F.size("_s").cast("long"))
    key = ["repository", "id", "dl"]
    one = t.select(*key, F.explode("_s").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf")).groupBy(*key).agg(F.collect_list(F.struct("term", "tf")).alias("_l"))
    one = one.select(*key, F.col("_l.term").alias("terms"), F.col("_l.tf").alias("tfs"))
    rest = t.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_n", F.col("_n") - F.when(F.col("dl") > 0, 1).otherwise(0)).filter("_n > 0")
    rest = rest.select(*key, F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("col")
    return one.unionByName(rest.select(*key, F.array().cast("array<string>").alias("terms"), F.array().cast("array<bigint>").alias("tfs")))


def words(chunks: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """`counted` of all rows; ids: `seen`, in which an id has several rows if *repeated*."""
    if not repeated:
        return counted(chunks)
    again = ids.filter("n > 1").select(F.col("repository").alias("_r"), F.col("id").alias("_i"))
    again, same = small(again), F.col("repository").eqNullSafe(F.col("_r")) & F.col("id").eqNullSafe(F.col("_i"))
    return counted(chunks.join(again, same, "left_anti")).unionByName(counted_together(chunks.join(again, same, "left_semi")))


def postings(held: DataFrame) -> DataFrame:
    """(repository, term, id, dl, tf) of `words`."""
    return held.select("repository", "id", "dl", "tfs", F.posexplode("terms").alias("_k", "term")).select("repository", "term", "id", "dl", F.get("tfs", F.col("_k")).alias("tf"))


def term_stats(held: DataFrame) -> DataFrame:
    """(repository, term, df) of `words`."""
    return held.select("repository", F.explode("terms").alias("term")).groupBy("repository", "term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(repository, n, avgdl)."""
    return docs.groupBy("repository").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def idf_table(terms: DataFrame, corpus: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(repository, term, df, idf): a negative idf is replaced by epsilon times the mean over the vocabulary."""
    # Both tables have a row for each repository: these are counted once.
    hint = F.broadcast if fits(corpus.select("repository")) else (lambda df: df)
    raw = terms.join(hint(corpus.select("repository", "n")), "repository").withColumn("raw", raw_idf(F.col("n"), F.col("df")))
    mean = raw.groupBy("repository").agg(F.avg("raw").alias("mean"))
    return raw.join(hint(mean), "repository").select("repository", "term", "df", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Index:
    """words (repository, id, dl, terms, tfs), terms (repository, term, df, idf), corpus (repository, n, avgdl)."""

    words: DataFrame
    terms: DataFrame
    corpus: DataFrame


TABLES = ("corpus", "words", "terms")


def write_index(chunks: DataFrame, path: str) -> Index:
    """Index *chunks* (repository, id, searchable_text) below *path*; repositories that it has already are replaced.

    Texts are dealt out by repository and id in parts of PART characters, and read as tokens once; terms and sizes come from their counts.
    """
    spark = chunks.sparkSession

    def kept(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository").parquet(f"{path}/{name}")

    ids = seen(chunks)
    here = settled(ids.groupBy("repository").agg(F.max("n").alias("n"), F.ceil(F.sum("chars") / PART).alias("parts")), "sizes")
    most, parts = here.agg(F.max("n"), F.sum(F.greatest("parts", F.lit(1)))).first()
    # A repository's name may be null: it is its own.
    sizes = small(here.select(F.col("repository").alias("_r"), F.greatest("parts", F.lit(1)).alias("_parts")))
    dealt = chunks.join(sizes, F.col("repository").eqNullSafe(F.col("_r"))).withColumn("_part", F.pmod(F.xxhash64("id"), "_parts"))
    dealt = dealt.repartition(max(1, parts or 0), "repository", "_part").select("repository", "id", "searchable_text")
    kept(words(dealt, ids, (most or 0) > 1), "words")
    read = lambda name: read_table(spark, path, name, chunks).join(small(here.select("repository")), "repository", "left_semi")
    kept(corpus_stats(read("words").select("repository", "dl")), "corpus")
    kept(idf_table(term_stats(read("words")), read("corpus")).repartition("repository", F.pmod(F.xxhash64("term"), F.lit(8))), "terms")
    return read_index(spark, path, chunks)


def read_table(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    """A table of the index, with the repository's type as in *like* (a folder's name has no type)."""
    return spark.read.parquet(f"{path}/{name}").withColumn("repository", F.col("repository").cast(like.schema["repository"].dataType))


def read_index(spark: SparkSession, path: str, like: DataFrame) -> Index:
    return Index(**{name: read_table(spark, path, name, like) for name in TABLES})


def build_index(chunks: DataFrame) -> Index:
    """The tables of an index as plans over *chunks*, for few texts that are asked once."""
    ids = seen(chunks)
    held = words(chunks, ids, not ids.filter("n > 1").isEmpty())
    corpus = corpus_stats(held)
    return Index(held, idf_table(term_stats(held), corpus), corpus)


def search(index: Index, questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, repository, id, bm25_score, bm25_rank): the k best of each question's repository.

    questions: qid, repository, query. Scores are rounded to 6 places before
    they are ranked, ties by id. A query without tokens or a repository without chunks gives no rows.
    """
    asked = questions.select("qid", "repository", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "repository", "term").agg(F.count("*").alias("times"))
    # What is joined below has at most a row for each asked term: its size is counted here, once.
    hint = F.broadcast if fits(asked) else (lambda df: df)
    weights = index.terms.join(hint(asked), ["repository", "term"]).join(small(index.corpus.select("repository", "avgdl")), "repository")
    held = index.words.join(hint(asked.select("repository").distinct()), "repository", "left_semi")
    sized = postings(held).join(hint(weights.select("qid", "repository", "term", "times", "idf", "avgdl")), ["repository", "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = sized.groupBy("qid", "repository", "id").agg(F.round(F.sum(part), 6).alias("bm25_score"))
    first = Window.partitionBy("repository").orderBy("id")
    # A task keeps 2k rows of a repository before they are shuffled.
    spare = index.words.select("repository", "id").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 2 * k).drop("_n")
    spare = spare.join(hint(asked.select("qid", "repository").distinct()), "repository").select("qid", "repository", "id", F.lit(0.0).alias("bm25_score"))
    every = scored.unionByName(spare).groupBy("qid", "repository", "id").agg(F.max_by("bm25_score", F.abs("bm25_score")).alias("bm25_score"))
    order = Window.partitionBy("qid").orderBy(F.col("bm25_score").desc(), "id")
    return every.withColumn("bm25_rank", F.row_number().over(order).cast("long")).filter(F.col("bm25_rank") <= k)


def bm25(chunks: DataFrame, questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """`search` over chunks without a stored index."""
    return search(build_index(chunks), questions, k, k1, b)
