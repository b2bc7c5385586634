"""Fusing, ranking and choosing candidates. Rankings carry ids and scores only; texts are joined to the few rows that are left."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaerix.functions import vocab
from quaerix.functions.queryx import intent, is_documentation, is_overview
from quaerix.functions.text import has_any
from quaerix.operators.lexical import small

RRF_K, PATH_K = 60, 20


def rrf(lexical: DataFrame, semantic: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (qid, id, scores, ranks, rrf_score, candidate_rank). Ties: lexical order first, then semantic."""
    both = lexical.select("qid", "id", "bm25_score", "bm25_rank").join(semantic.select("qid", "id", "semantic_score", "semantic_rank"), ["qid", "id"], "full")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(part("bm25_rank") + part("semantic_rank"), 9))
    order = Window.partitionBy("qid").orderBy(F.col("rrf_score").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("semantic_rank").asc_nulls_last(), "id")
    return both.withColumn("candidate_rank", F.row_number().over(order).cast("long")).filter(F.col("candidate_rank") <= k)


def merge_path(fused: DataFrame, paths: DataFrame, k: int, path_k: int = PATH_K) -> DataFrame:
    """Adds path hits (qid, id, path_score, path_rank) and their bonus to fused candidates."""
    both = fused.join(paths.select("qid", "id", "path_score", "path_rank"), ["qid", "id"], "full")
    bonus = F.coalesce(F.lit(1.0) / (F.lit(path_k) + F.col("path_rank")), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(F.coalesce("rrf_score", F.lit(0.0)) + bonus, 9))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).desc()
    order = Window.partitionBy("qid").orderBy(F.col("rrf_score").desc(), zero("path_score"), zero("semantic_score"), F.col("candidate_rank").asc_nulls_last(), F.col("path_rank").asc_nulls_last())
    return both.withColumn("merged_rank", F.row_number().over(order).cast("long")).filter(F.col("merged_rank") <= k)


def is_doc(path: Column, language: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return (F.lower(F.coalesce(language, F.lit(""))) == "text") | low.endswith(".md") | low.contains("/readme")


def doc_priority(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.when(low.isin("readme.md", "readme"), 3).when(low.startswith("docs/") | low.contains("/docs/"), 2).when(low.endswith(".md"), 1).otherwise(0)


def _sum(items: Column, score) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, x: s + score(x))


def _hit(flag: Column, points: int) -> Column:
    return F.when(flag, points).otherwise(0)


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def fragment_points(path: Column, fragments: Column, points: int) -> Column:
    return _sum(fragments, lambda f: _hit(F.contains(path, f), points))


def hint_points(path: Column, hints: Column, whole: int, part: int) -> Column:
    def score(h: Column) -> Column:
        n = F.lower(F.regexp_replace(h, "/+$", ""))
        return F.when((path == n) | F.startswith(path, F.concat(n, F.lit("/"))), whole).when(F.contains(path, n), part).otherwise(0)

    return _sum(hints, score)


#: What ranking needs to know of a chunk, computed once for each chunk before it meets questions.
KNOWN = ("_path", "_symbol", "_signature", "_source", "_base", "_stem", "_doc", "_doc_priority", "_tested", "_flags")


def known(chunks: DataFrame) -> DataFrame:
    """Adds KNOWN: lower-case parts of the path and signature, and what does not depend on the question."""
    path, base = F.col("_path"), F.col("_base")
    out = chunks.withColumns({"_path": _low("file_path"), "_symbol": _low("symbol_name"), "_signature": _low("signature"), "_doc": is_doc(F.col("file_path"), F.col("language"))})
    out = out.withColumns({"_source": F.concat_ws(" ", "_path", "_symbol", "_signature"), "_base": F.regexp_extract("_path", r"[^/]*$", 0), "_doc_priority": doc_priority(F.col("file_path"))})
    tested = path.startswith("tests/") | path.contains("/tests/") | base.startswith("test_") | base.rlike(r"(?:_test\.py|\.(?:test|spec)\.(?:js|ts))$")
    out = out.withColumns({"_stem": F.regexp_replace("_base", r"\.[^.]*$", ""), "_tested": tested})
    # Points by intent: fixed values.
    api = _hit((base == "__init__.py") | F.col("_stem").isin(*vocab.API_STEMS), 4) + _hit(has_any(path, vocab.API_PATHS), 2)
    code = _hit(~F.col("_doc"), 2) + _hit(F.coalesce("symbol_type", F.lit("")) != "fallback_chunk", 1)
    error = _hit(has_any(F.col("_source"), vocab.ERROR_WORDS), 3) + _hit(path.contains("test"), 1)
    setup = _hit(base.isin(*vocab.SETUP_FILES) | has_any(path, vocab.SETUP_PATHS), 3) + _hit(has_any(F.col("_source"), vocab.SETUP_WORDS), 1)
    docs = F.when(F.col("_doc"), F.col("_doc_priority") + 1).otherwise(0)
    away = _hit(path.startswith(".agents/") | path.startswith(".opencode/"), -8)
    flags = F.struct(api.alias("api"), code.alias("code"), error.alias("error"), setup.alias("setup"), docs.alias("docs"), away.alias("away"))
    return out.withColumn("_flags", flags)


def canonical_priority(f: Column) -> Column:
    """Points of a chunk with KNOWN for a question's features *f*."""
    path, symbol, signature, base, stem = (F.col(c) for c in ("_path", "_symbol", "_signature", "_base", "_stem"))
    source, flags, doc = F.col("_source"), F.col("_flags"), F.col("_doc")
    what = lambda *names: f["intent"].isin(*names)

    def term(t: Column) -> Column:
        named = F.when((t == base) | (t == stem), 4).when(F.contains(base, t), 3).otherwise(0)
        return named + _hit(F.contains(symbol, t), 3) + _hit(F.contains(path, t), 2) + _hit(F.contains(signature, t), 1)

    score = fragment_points(path, f["fragments"], 8) + hint_points(path, f["hints"], 8, 4)
    score += F.least(F.size(F.filter(f["terms"], lambda t: F.contains(source, t))), F.lit(6)) + _sum(f["terms"], term)
    score += F.when(what("api"), flags["api"]).when(what("implementation", "cross_file"), flags["code"]).when(what("tests"), _hit(F.col("_tested"), 5)).when(what("error_handling"), flags["error"]).when(what("setup"), flags["setup"]).when(what("docs", "overview"), flags["docs"]).otherwise(0)
    return score + _hit(doc & what(*vocab.DOC_PENALTY), -3) + flags["away"]


def path_intent_search(chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, id, path_score, path_rank): asked has qid, repository and the features f of question and retrieval query.

    A chunk is lower-cased and looked at once; a pair costs a few substring tests, and only pairs with a hint, fragment or term are ranked.
    """
    f = F.col("f")
    text = F.concat_ws(" ", "_source", F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 500)))
    held = known(chunks).withColumn("_text", text).select("repository", "id", "_text", *KNOWN)
    q = asked.select("qid", "repository", "f").filter((F.size("f.hints") > 0) | (F.size("f.terms") > 0))
    found = F.least(F.size(F.filter(f["terms"], lambda t: F.contains(F.col("_text"), t))), F.lit(8))
    points = fragment_points(F.col("_path"), f["fragments"], 12) + hint_points(F.col("_path"), f["hints"], 10, 6) + found
    pairs = held.join(q, "repository").withColumn("_points", points).filter("_points > 0")
    scored = pairs.withColumn("path_score", (F.col("_points") + F.greatest(canonical_priority(f), F.lit(0))).cast("double"))
    order = Window.partitionBy("qid").orderBy(F.col("path_score").desc(), "id")
    return scored.select("qid", "id", "path_score").withColumn("path_rank", F.row_number().over(order).cast("long")).filter(F.col("path_rank") <= k)


def with_texts(found: DataFrame, chunks: DataFrame, on) -> DataFrame:
    """*found*, a settled table of ids and scores, with its chunks' fields: it goes to the texts by broadcast up to the counted bound, so that texts are not shuffled."""
    return small(found).join(chunks, on)


def lexical_rerank_score(query: Column, body: Column) -> Column:
    """The default reranker: the share of the query's distinct code terms that the text has, from 0 to 1. It stands
    in for a cross-encoder, which has another scale; `model_reranker` puts one in its place."""
    from quaerix.functions.text import code_terms

    terms = code_terms(query)
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.coalesce(F.round(F.try_divide(F.size(F.filter(terms, lambda t: F.contains(low, t))), F.size(terms)), 6), F.lit(0.0))


class PairScorer(Protocol):
    """A cross-encoder: scores of (query, text) pairs, a batch at a time."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def model_reranker(model: PairScorer, batch: int = 64):
    """A reranker for `retrieve` from a model, which travels once to each task."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, bodies in parts:
            pairs = list(zip(queries.fillna(""), bodies.fillna(""), strict=True))
            out = [float(x) for at in range(0, len(pairs), batch) for x in model.score(pairs[at : at + batch])]
            yield pd.Series(out, index=queries.index, dtype=float)

    return scored


def prioritise(rows: DataFrame, k: int) -> DataFrame:
    """Adds position and keeps k of each question: rows have the chunk's fields, scores, question, query and f of both in lower case.

    Ten keys in order; unless documents are asked for, code comes first and documents fill what is left.
    """
    both = F.lower(F.concat_ws(" ", "question", "query"))
    doc = is_doc(F.col("file_path"), F.col("language"))
    about = intent(F.col("question"))
    docs = is_documentation(both) & about.isin("docs", "overview")
    overview = is_overview(F.col("question")) | is_overview(F.col("query"))
    keys = known(rows).withColumns({
        "_k1": canonical_priority(F.col("f")), "_k2": F.coalesce("path_score", F.lit(0.0)), "_k3": doc_priority(F.col("file_path")),
        "_k4": _hit(overview & doc, 1), "_k5": _hit(docs == doc, 1), "_k6": _hit(has_any(both, vocab.WANTS_CODE) & ~doc, 1),
        "_k7": _hit(about.isin(*vocab.CODE_FIRST) & ~doc, 1), "_k8": F.coalesce("rerank_score", F.lit(0.0)),
        "_k9": F.coalesce("semantic_score", F.lit(0.0)), "_k10": F.coalesce("bm25_score", F.lit(0.0)),
        "_last": _hit(~(docs | overview) & doc, 1),
    })
    order = Window.partitionBy("qid").orderBy("_last", *[F.col(f"_k{i}").desc() for i in range(1, 11)], "merged_rank")
    out = keys.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= k)
    return out.drop("_last", *KNOWN, *[f"_k{i}" for i in range(1, 11)])


def cap_per_file(rows: DataFrame, k: int) -> DataFrame:
    """At most two of a file for overview and documentation questions, else one; then the first k: adds source_no."""
    most = F.when(intent(F.col("question")).isin("overview", "docs"), 2).otherwise(1)
    each = Window.partitionBy("qid", "file_path").orderBy("position")
    kept = rows.withColumn("_n", F.row_number().over(each)).filter(F.col("_n") <= most).drop("_n")
    order = Window.partitionBy("qid").orderBy("position")
    return kept.withColumn("source_no", F.row_number().over(order).cast("long")).filter(F.col("source_no") <= k)
