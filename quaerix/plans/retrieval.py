"""The whole retrieval of a batch of questions as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaerix.functions import vocab
from quaerix.functions.queryx import features, intent, retrieval_query, search_depth
from quaerix.operators import fusion, lexical, vector
from quaerix.session import settled

RERANKED, SOURCES = 20, 5
FIELDS = ("file_path", "language", "symbol_name", "symbol_type", "line_start", "line_end", "signature", "content")


def prepared(questions: DataFrame, top_k: int, rules=()) -> DataFrame:
    """questions (qid, repository, question[, last_user, last_assistant]) -> with query, depth, f (path search) and g (ranking).

    There are few questions and long expressions on them: each step is settled, so that it is planned and computed once.
    """
    have = questions.columns
    absent = F.lit(None).cast("string")
    user = F.col("last_user") if "last_user" in have else absent
    said = F.col("last_assistant") if "last_assistant" in have else absent
    q = questions.withColumn("query", retrieval_query(F.col("question"), user, said, rules)).withColumn("depth", search_depth(F.col("question"), F.lit(top_k)))
    q = settled(q.withColumns({"_f": F.concat_ws("\n", "question", "query"), "_g": F.lower(F.concat_ws(" ", "question", "query"))}), "asked")
    q = features(features(q, "_f", rules).withColumnRenamed("f", "_h"), "_g", rules).withColumnsRenamed({"f": "g", "_h": "f"})
    return settled(q.drop("_f", "_g"), "questions")


def lists(chunks: DataFrame, vectors: DataFrame | None, q: DataFrame, top_k: int, index: lexical.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """The fused and path rankings of prepared questions, each cut at the question's depth."""
    most = max(top_k, min(top_k * 8, 120))
    # Questions are counted once; everything of them that is joined has a row for each.
    hint = F.broadcast if lexical.fits(q.select("qid")) else (lambda df: df)
    cut = lambda df, rank: df.join(hint(q.select("qid", "depth")), "qid").filter(F.col(rank) <= F.col("depth")).drop("depth")
    lex = cut(lexical.search(index or lexical.build_index(chunks), q.select("qid", "repository", "query"), most), "bm25_rank")
    kind = chunks.schema["id"].dataType
    if vectors is None:
        sem = lex.select("qid", "id", F.lit(0.0).alias("semantic_score"), F.lit(0).cast("long").alias("semantic_rank")).limit(0)
    else:
        held = vectors.select(F.col("id").cast(kind).alias("id"), "embedding", F.col("repository").alias("vfilter"))
        sem = cut(vector.vector_batch(held, q.select("qid", "qvec", F.col("repository").alias("qfilter")), most, True), "semantic_rank")
    fused = cut(fusion.rrf(lex, sem, most), "candidate_rank")
    paths = cut(fusion.path_intent_search(chunks, hint(q.select("qid", "repository", "f")), most), "path_rank")
    return fused, paths


def retrieve(chunks: DataFrame, vectors: DataFrame | None, questions: DataFrame, top_k: int = 8, rules=(), reranker=None, index: lexical.Index | None = None) -> DataFrame:
    """The sources of each question: qid, source_no, id, the chunk's fields, scores.

    chunks: repository, id, FIELDS, searchable_text; vectors: repository, id, embedding; questions: qid, repository,
    question, qvec if there are vectors, last_user and last_assistant if there is a history. Texts join once the
    rankings are cut. *reranker* maps (query, body) columns to a score; *index* is the stored index of the chunks, without which their texts are tokenised anew.
    """
    q = prepared(questions, top_k, rules)
    fused, paths = lists(chunks, vectors, q, top_k, index)
    most = max(top_k, min(top_k * 8, 120))
    # At most *most* rows of ids and scores for each question.
    merged = settled(fusion.merge_path(fused, paths, most), "merged")
    asked = q.select("qid", "repository", "question", "query", "depth", F.col("g").alias("f"))
    merged = merged.join(lexical.small(asked.select("qid", "repository", "depth")), "qid").filter(F.col("merged_rank") <= F.col("depth"))
    rows = fusion.with_texts(merged, chunks.select("repository", "id", *FIELDS), ["repository", "id"]).join(lexical.small(asked.drop("repository", "depth")), "qid")
    deep: Column = F.when(intent(F.col("question")).isin(*vocab.DEEP), F.col("query")).otherwise(F.col("question"))
    body = F.concat_ws("\n", "file_path", "signature", "content")
    scored = rows.withColumn("rerank_score", (reranker or fusion.lexical_rerank_score)(deep, body))
    order = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "merged_rank")
    kept = scored.withColumn("rerank_rank", F.row_number().over(order).cast("long")).filter(F.col("rerank_rank") <= F.least(F.col("depth"), F.lit(RERANKED)))
    return fusion.cap_per_file(fusion.prioritise(kept, top_k), min(top_k, SOURCES))
