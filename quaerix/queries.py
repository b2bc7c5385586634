"""The registered queries of the engine's own operators: plans over the driver's tables, and their SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaerix import oracle as O
from quaerix.functions import queryx, text as T, vocab
from quaerix.operators import answer, catalog, chunking, evaluation, fusion, lexical, vector
from quaerix.plans import retrieval
from quaerix.session import made, scratch, settled, ship
from quaerix.sources import files
from quaerix.streaming.sessions import session_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = vocab.EXAMPLE_RULES


def query(sql: str | None = None):
    """Register a query, and its SQL if there is one; SQL that begins with a name of a table expression gets WITH."""

    def register(f):
        QUERIES[f.__name__] = functools.wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the repository, and ids give paths of several kinds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    path = (
        F.when(k == 0, F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), n, F.lit(".md"))).when(k == 1, F.concat(F.lit("src/api_"), n, F.lit(".py")))
        .when(k == 2, F.concat(F.lit("tests/test_"), n, F.lit(".py"))).when(k == 3, F.concat(F.lit("docs/"), "lang", F.lit("/doc_"), n, F.lit(".md")))
        .otherwise(F.concat(F.lit("lib/config_"), n, F.lit(".rs")))
    )
    d = d.withColumn("file_path", path)
    return d.select(
        F.col("source").alias("repository"), F.col("doc_id").alias("id"), "file_path", chunking.detect_language(F.col("file_path")).alias("language"), F.concat(F.lit("doc_"), n).alias("symbol_name"),
        F.when(k.isin(1, 2, 4), "function_definition").otherwise("fallback_chunk").alias("symbol_type"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("signature"), F.col("text").alias("content"), F.col("text").alias("searchable_text"),
    )


_INDEXES: dict[tuple[str, str], lexical.Index] = {}


def indexed(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index of the tables' chunks: written once in a Spark application, in its shared folder, and read by all queries after that."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        texts = table(spark, sf_dir, "documents").select(F.col("source").alias("repository"), F.col("doc_id").alias("id"), F.col("text").alias("searchable_text"))
        _INDEXES[key] = lexical.write_index(texts, made(spark, f"{scratch(spark)}/quaerix/index-{uuid.uuid4().hex}"))
    return _INDEXES[key]


def _found(spark: SparkSession, sf_dir: str, q: DataFrame, k: int) -> DataFrame:
    """The k best of each question by BM25, settled before texts join: qid, id, bm25_score, bm25_rank."""
    return settled(lexical.search(indexed(spark, sf_dir), q.withColumnRenamed("question", "query"), k).drop("repository"), "found")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions: a template by id and the passage's first six words, asked of one repository."""
    six = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    said: Column = F.lit(None).cast("string")
    for i, t in enumerate(O.TEMPLATES):
        before, mark, after = t.partition("{w}")
        said = F.when(F.col("item_id") % len(O.TEMPLATES) == i, F.concat(F.lit(before), six, F.lit(after)) if mark else F.lit(t)).otherwise(said)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repository"), said.alias("question"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("vfilter"))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's vector is that of the row with its id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qfilter"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(e, "qid")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    s = lambda c: c.cast("string")
    words = F.split("text", " ")
    got = F.array(F.concat(F.lit("src/d"), s(i % 5), F.lit("/f"), s(i % 2), F.lit(".py")), F.concat(F.lit("docs/a"), s(i % 3), F.lit(".md")), F.concat(F.lit("docs/a"), s(i % 2), F.lit(".md")), F.lit("dockerfile"))
    following = b.select((i - 1).alias("item_id"), F.col("text").alias("_next"))
    return b.join(following, "item_id", "left").select(
        F.concat(F.lit("case-"), s(i)).alias("id"), F.concat(F.lit("c"), s(i % 4)).alias("category"), F.col("text").alias("question"), F.col("text").alias("ground_truth"),
        F.array(F.concat(F.lit("src/d"), s(i % 7), F.lit("/f"), s(i % 3), F.lit(".py")), F.when(i % 2 == 0, "./Docs/").otherwise("Dockerfile")).alias("expected_sources"),
        F.slice(got, (1 + i % 2).cast("int"), (4 - i % 2).cast("int")).alias("retrieved_sources"),
        F.concat(F.array_join(F.slice(words, F.lit(1), (10 + i % 50).cast("int")), " "), F.lit(" sessionMaker in lib/config.py "), F.coalesce("_next", F.lit(""))).alias("answer"),
        F.array(F.array_join(F.slice(words, 2, 2), " "), F.lit("sessionMaker"), F.lit("SESSIONMAKER"), F.lit("lib/config.py"), F.lit("absent-word"), F.lit("")).alias("must_include_any"),
        (i % 5).cast("int").alias("min_keyword_matches"),
    )


# --- lexical -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents)")
def tokenize_docs(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"WITH {O.BM25_BASE.strip()} SELECT repository, term, df FROM df")
def term_document_freq(spark, d):
    return indexed(spark, d).terms.select("repository", "term", "df")


@query(f"WITH {O.BM25_BASE.strip()} SELECT repository, n, round(avgdl, 6) AS avgdl FROM co")
def doc_length_stats(spark, d):
    return indexed(spark, d).corpus.select("repository", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {O.BM25_BASE.strip()} SELECT repository, term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf_table(spark, d):
    return indexed(spark, d).terms.select("repository", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {O.QUESTIONS}, o AS (SELECT qid, 'src3' AS repository, question FROM q WHERE qid = 3), {O.BM25_BASE.strip()}, {O.bm25(50, source='o').strip()} SELECT qid, repository, id, bm25_score, bm25_rank FROM lx")
def bm25_topk(spark, d):
    q = questions(spark, d).filter("qid = 3").select("qid", F.lit("src3").alias("repository"), F.col("question").alias("query"))
    return lexical.search(indexed(spark, d), q, 50)


@query(f"WITH {O.QUESTIONS}, o AS (SELECT r.repository AS qid, r.repository, question FROM q, (SELECT DISTINCT source AS repository FROM documents) r WHERE qid = 0), {O.BM25_BASE.strip()}, {O.bm25(10, source='o').strip()} SELECT qid, repository, id, bm25_score, bm25_rank FROM lx")
def bm25_topk_per_repo(spark, d):
    one = questions(spark, d).filter("qid = 0").select(F.col("question").alias("query"))
    repos = table(spark, d, "documents").select(F.col("source").alias("repository")).distinct()
    # One question is asked of every repository.
    return lexical.search(indexed(spark, d), repos.join(F.broadcast(one.limit(1)), F.lit(True)).select(F.col("repository").alias("qid"), "repository", "query"), 10)


@query(f"WITH {O.QUESTIONS}, {O.BM25_BASE.strip()}, {O.bm25(20).strip()} SELECT qid, repository, id, bm25_score, bm25_rank FROM lx")
def bm25_batch(spark, d):
    return lexical.search(indexed(spark, d), questions(spark, d).withColumnRenamed("question", "query"), 20)


# --- vectors -------------------------------------------------------------------------------------------------------

_FIRST = "(SELECT embedding AS qv FROM embeddings WHERE vec_id = 7)"


def _probe(spark, d) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 7").select("embedding").first()[0]


@query(f"SELECT vec_id AS id, round({O.cos('embedding', 'qv')}, 6) AS semantic_score FROM embeddings, {_FIRST} ORDER BY 2 DESC, 1 LIMIT 20")
def vector_topk(spark, d):
    return vector.vector_topk(embedded(spark, d), _probe(spark, d), 20)


@query(f"SELECT vec_id AS id, round({O.cos('embedding', 'qv')}, 6) AS semantic_score FROM embeddings, {_FIRST} WHERE label = 3 ORDER BY 2 DESC, 1 LIMIT 20")
def vector_topk_filtered(spark, d):
    return vector.vector_topk(embedded(spark, d), _probe(spark, d), 20, F.col("vfilter") == 3)


@query(f"WITH {O.semantic(10).strip()} SELECT qid, id, semantic_score, semantic_rank FROM sm")
def vector_batch_topk(spark, d):
    return vector.vector_batch(embedded(spark, d), vector_questions(spark, d), 10)


@query(f"WITH {O.semantic(10, 'label = ql').strip()} SELECT qid, id, semantic_score, semantic_rank FROM sm")
def vector_batch_filtered(spark, d):
    return vector.vector_batch(embedded(spark, d), vector_questions(spark, d), 10, filtered=True)


@query("SELECT count(*) AS n_vectors, max(len(embedding)) AS dimension FROM embeddings")
def vector_store_stats(spark, d):
    return vector.store_stats(embedded(spark, d))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total, len(embedding) AS n FROM embeddings")
def l2_normalize(spark, d):
    u = embedded(spark, d).select("id", vector.l2_normalise(F.col("embedding")).alias("u"))
    return u.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("u").cast("long").alias("n"))


@query("SELECT qid, id, semantic_score, row_number() OVER (PARTITION BY qid ORDER BY semantic_score DESC, id) AS semantic_rank FROM (SELECT label AS qid, vec_id AS id, round(embedding[1]::DOUBLE, 4) AS semantic_score FROM embeddings)")
def semantic_ranks(spark, d):
    hits = embedded(spark, d).select(F.col("vfilter").alias("qid"), "id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("semantic_score"))
    return vector.semantic_ranks(hits)


@query("SELECT vec_id AS id, label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id < 3)")
def vector_delete(spark, d):
    e = embedded(spark, d).withColumnRenamed("vfilter", "repository")
    return vector.delete_repository(e, e.filter("id < 3")).select("id", F.col("repository").alias("label"))


# --- fusion and ranking --------------------------------------------------------------------------------------------

_SEM = O.semantic(20, "d.source = qr AND e.vec_id = d.doc_id", "SELECT qid, repository AS qr, e.embedding AS qv FROM q JOIN embeddings e ON e.vec_id = qid")
_SEM = O.swap(_SEM, ("FROM qv, embeddings WHERE", "FROM qv, embeddings e, documents d WHERE"), ("(embedding::", "(e.embedding::"))


def _lists(spark, d, k: int):
    c, q = chunks(spark, d), questions(spark, d)
    lex = lexical.search(indexed(spark, d), q.withColumnRenamed("question", "query"), k)
    v = embedded(spark, d).select("id", "embedding").join(c.select("id", F.col("repository").alias("vfilter")), "id")
    asked = vector_questions(spark, d).select("qid", "qvec").join(q.select("qid", F.col("repository").alias("qfilter")), "qid")
    return c, q, lex, vector.vector_batch(v, asked, k, filtered=True), v


_FUSED = f"{O.QUESTIONS}, {O.BM25_BASE.strip()}, {O.bm25(20).strip()}, {_SEM.strip()}, {O.rrf(20).strip()}"


@query(f"WITH {_FUSED} SELECT qid, id, bm25_score, bm25_rank, semantic_score, semantic_rank, rrf_score, candidate_rank FROM fu")
def rrf_fusion(spark, d):
    _, _, lex, sem, _ = _lists(spark, d, 20)
    return fusion.rrf(lex, sem, 20)


def _path_questions(q: DataFrame) -> DataFrame:
    """Questions with the features that path search asks for; each step is settled, so that long expressions are planned once."""
    expanded = q.withColumn("query", queryx.expand(F.col("question"), RULES)).withColumn("_c", F.concat_ws("\n", "question", "query"))
    return lexical.small(settled(queryx.features(settled(expanded, "asked"), "_c", RULES), "questions"))


_QQ = f"qq AS (SELECT *, {O.expand('question')} AS query FROM q)"


@query(f"WITH {O.QUESTIONS}, {_QQ}, {O.CHUNKS}, {O.path_search(20).strip()} SELECT qid, id, path_score, path_rank FROM pa")
def path_intent_search(spark, d):
    return fusion.path_intent_search(chunks(spark, d), _path_questions(questions(spark, d)), 20)


@query(f"WITH {_FUSED}, {_QQ}, {O.CHUNKS}, {O.path_search(20).strip()}, {O.merged(20).strip()} SELECT qid, id, rrf_score, path_score, semantic_score, merged_rank FROM mg")
def merge_path_bonus(spark, d):
    c, q, lex, sem, _ = _lists(spark, d, 20)
    paths = fusion.path_intent_search(c, _path_questions(q), 20)
    return fusion.merge_path(fusion.rrf(lex, sem, 20), paths, 20).select("qid", "id", "rrf_score", "path_score", "semantic_score", "merged_rank")


@query(f"WITH {O.QUESTIONS}, {O.CHUNKS}, f AS (SELECT qid, repository, {O.with_features('question')} FROM q) SELECT qid, id, {O.priority()} AS priority FROM f JOIN c USING (repository)")
def canonical_priority(spark, d):
    q = settled(queryx.features(questions(spark, d), "question", RULES).select("qid", "repository", "f"), "questions")
    return fusion.known(chunks(spark, d)).join(lexical.small(q), "repository").select("qid", "id", fusion.canonical_priority(F.col("f")).cast("long").alias("priority"))


@query(f"WITH {O.CHUNKS} SELECT id, {O.DOC} AS is_doc, {O.DOCPRI} AS priority FROM c")
def doc_source_flags(spark, d):
    return chunks(spark, d).select("id", fusion.is_doc(F.col("file_path"), F.col("language")).alias("is_doc"), fusion.doc_priority(F.col("file_path")).alias("priority"))


@query(f"WITH {O.QUESTIONS} SELECT qid, {O.depth('question', 8)} AS depth FROM q")
def search_depth(spark, d):
    return questions(spark, d).select("qid", queryx.search_depth(F.col("question"), F.lit(8)).alias("depth"))


_RERANKED = f"WITH {O.QUESTIONS}, {O.BM25_BASE.strip()}, {O.bm25(20).strip()}, {O.CHUNKS}, rr AS (SELECT lx.qid, lx.id, {O.rerank('question', chr(10).join(['content']))} AS rerank_score FROM lx JOIN q USING (qid) JOIN c ON c.id = lx.id)"


@query(f"{_RERANKED} SELECT qid, id, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, id) AS rerank_rank FROM rr")
def lexical_rerank(spark, d):
    c, q = chunks(spark, d), questions(spark, d)
    rows = fusion.with_texts(_found(spark, d, q, 20).select("qid", "id"), c.select("id", "content"), "id").join(lexical.small(q.select("qid", "question")), "qid").withColumn("rerank_score", fusion.lexical_rerank_score(F.col("question"), F.col("content")))
    order = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "id")
    return rows.select("qid", "id", "rerank_score", F.row_number().over(order).cast("long").alias("rerank_rank"))


_RQ = f"qq AS (SELECT *, CASE WHEN {O.overview('question')} THEN {O.sq('question')} || chr(10) || '{vocab.OVERVIEW_SUFFIX}' ELSE {O.expand('question')} END AS query, {O.depth('question', 8)} AS depth, {O.intent('question')} AS qi FROM q)"
_DEEP = f"CASE WHEN qi IN ({O._lit(vocab.DEEP)}) THEN query ELSE question END"
def _deep(sql: str, rank: str) -> str:
    """A ranking that is cut at its question's depth."""
    return O.swap(sql, (f"WHERE {rank}", f"JOIN (SELECT qid, depth FROM qq) USING (qid) WHERE {rank.split()[0]} <= depth"))


_FULL = f"""WITH {O.QUESTIONS}, {_RQ}, {O.BM25_BASE.strip()}, {_deep(O.bm25(64, 'query', 'qq').strip(), 'bm25_rank <= 64')},
{_deep(_SEM.strip(), 'semantic_rank <= 20')}, {_deep(O.rrf(64).strip(), 'candidate_rank <= 64')},
{O.CHUNKS}, {_deep(O.path_search(64).strip(), 'path_rank <= 64')}, {O.merged(64).strip()},
ft AS (SELECT qid, question, query, depth, qi, {O.with_features("lower(question || ' ' || query)")} FROM qq),
r0 AS (SELECT mg.*, c.* EXCLUDE (id, repository), ft.* EXCLUDE (qid), {O.rerank(_DEEP, "file_path || chr(10) || signature || chr(10) || content")} AS rerank_score FROM mg JOIN ft USING (qid) JOIN c ON c.id = mg.id WHERE merged_rank <= depth),
rw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, merged_rank) AS rerank_rank FROM r0) WHERE rerank_rank <= least(depth, 20)),
{O.ranked(8).strip()}, {O.capped(5).strip()}"""


def _retrieve(spark, d) -> DataFrame:
    c = chunks(spark, d)
    v = embedded(spark, d).select("id", "embedding").join(c.select("id", "repository"), "id")
    q = questions(spark, d).join(vector_questions(spark, d).select("qid", "qvec"), "qid", "left")
    return retrieval.retrieve(c, v, q, 8, RULES, index=indexed(spark, d))


_SHOWN = ("qid", "source_no", "id", "file_path", "rrf_score", "path_score", "rerank_score", "semantic_score", "bm25_score")


@query(f"{_FULL} SELECT {', '.join(_SHOWN)} FROM cp")
def hybrid_retrieve_flagship(spark, d):
    return _retrieve(spark, d).select(*_SHOWN)


_CAND = f"WITH {O.QUESTIONS}, qq AS (SELECT *, question AS query, {O.intent('question')} AS qi FROM q), {O.BM25_BASE.strip()}, {O.bm25(20).strip()}, {O.CHUNKS}, rw AS (SELECT lx.qid, lx.id, bm25_score, bm25_rank AS merged_rank, NULL::DOUBLE AS path_score, NULL::DOUBLE AS semantic_score, NULL::DOUBLE AS rerank_score, c.* EXCLUDE (id, repository), qq.question, qq.query, qi, {O.with_features('lower(question || chr(32) || query)')} FROM lx JOIN qq USING (qid) JOIN c ON c.id = lx.id), {O.ranked(12).strip()}"


def _prioritised(spark, d) -> DataFrame:
    c, q = chunks(spark, d), questions(spark, d)
    f = settled(queryx.features(q.withColumn("query", F.col("question")).withColumn("_c", F.lower(F.concat_ws(" ", "question", "query"))), "_c", RULES).drop("_c", "repository"), "questions")
    lex = _found(spark, d, q, 20).withColumnRenamed("bm25_rank", "merged_rank")
    none = F.lit(None).cast("double")
    rows = fusion.with_texts(lex, c.drop("repository", "searchable_text"), "id").join(lexical.small(f), "qid").withColumns({"path_score": none, "semantic_score": none, "rerank_score": none})
    return fusion.prioritise(rows, 12)


@query(f"{_CAND} SELECT qid, id, position FROM rk")
def prioritize(spark, d):
    return _prioritised(spark, d).select("qid", "id", "position")


@query(f"{_CAND}, {O.swap(O.capped(5).strip(), ('PARTITION BY qid, file_path', 'PARTITION BY qid, language'))} SELECT qid, id, source_no FROM cp")
def cap_per_file(spark, d):
    # The tables have one chunk for each file: the language stands for the file, so that the cap binds.
    rows = _prioritised(spark, d).drop("file_path").withColumnRenamed("language", "file_path")
    return fusion.cap_per_file(rows, 5).select("qid", "id", "source_no")


# --- questions -----------------------------------------------------------------------------------------------------


def _said(name: str, sql: str, column: Callable[[Column], Column]) -> None:
    def f(spark, d):
        return questions(spark, d).select("qid", column(F.col("question")).alias(name))

    f.__name__ = {"intent": "query_intent", "is_overview": "overview_question", "is_documentation": "documentation_query", "query": "expand_query", "hints": "domain_hints", "terms": "code_terms", "fragments": "path_fragments", "follow_up": "follow_up_flag"}[name]
    query(f"WITH {O.QUESTIONS} SELECT qid, {sql} AS {name} FROM q")(f)


_said("intent", O.intent("question"), queryx.intent)
_said("is_overview", O.overview("question"), queryx.is_overview)
_said("is_documentation", O.has_any("lower(question)", vocab.DOCS), lambda c: queryx.is_documentation(F.lower(c)))
_said("query", O.expand("question"), lambda c: queryx.expand(c, RULES))
_said("hints", f"array_to_string({O.hints('question')}, ' ')", lambda c: F.array_join(queryx.domain_hints(c, RULES), " "))
_said("terms", f"array_to_string({O.code_terms('question')}, ' ')", lambda c: F.array_join(T.code_terms(c), " "))
_said("fragments", f"array_to_string({O.fragments('question')}, ' ')", lambda c: F.array_join(T.path_fragments(c), " "))
_FOLLOW = f"len(string_split({O.sq('question')}, ' ')) <= 6 OR regexp_matches({O.low('question')}, '^({'|'.join(vocab.FOLLOW_UP_STARTS)})( .+)?$') OR {O.has_any(O.low('question'), vocab.FOLLOW_UP_WORDS)}"
_said("follow_up", _FOLLOW, queryx.is_follow_up)


def _turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), "turn", "role", "text")


@query("SELECT qid, turn, back FROM (SELECT conv_id AS qid, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE (role = 'user' OR (role = 'assistant' AND turn % 2 = 0)) AND trim(text) <> '') WHERE back <= 6")
def history_answered(spark, d):
    return queryx.history_window(_turns(spark, d).withColumn("answered", F.col("turn") % 2 == 0), answered="answered").select("qid", "turn", "back")


@query("SELECT qid, turn, role, back FROM (SELECT conv_id AS qid, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE back <= 6")
def history_window(spark, d):
    return queryx.history_window(_turns(spark, d)).select("qid", "turn", "role", "back")


_H = f"SELECT conv_id AS qid, string_agg(upper(role[1:1]) || lower(role[2:]) || ': ' || substring({O.sq('text')}, 1, 400), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE text <> '' AND role <> '') WHERE r <= 4 GROUP BY conv_id"


@query(_H)
def format_history(spark, d):
    return queryx.format_history(_turns(spark, d))


_SUB = f"length({O.low('text')}) >= 24 AND {O.low('text')} NOT IN ({O._lit(vocab.GREETINGS)})"


@query(f"SELECT conv_id AS qid, turn, {_SUB} AS substantive FROM conversations WHERE role = 'assistant'")
def substantive_turns(spark, d):
    return _turns(spark, d).filter("role = 'assistant'").select("qid", "turn", queryx.is_substantive(F.col("text")).alias("substantive"))


@query(f"""WITH {O.QUESTIONS}, h AS (SELECT conv_id AS qid, max_by(text, turn) FILTER (role = 'user') AS u, max_by(text, turn) FILTER (role = 'assistant' AND {_SUB}) AS a FROM conversations WHERE trim(text) <> '' GROUP BY 1)
SELECT qid, CASE WHEN {O.overview('question')} THEN {O.sq('question')} || chr(10) || '{vocab.OVERVIEW_SUFFIX}' WHEN u IS NOT NULL AND ({_FOLLOW})
THEN {O.expand('question')} || chr(10) || 'Follow-up to: ' || trim(u) || coalesce(chr(10) || 'Previous answer: ' || substring(trim(a), 1, 300), '') ELSE {O.expand('question')} END AS query FROM q LEFT JOIN h USING (qid)""")
def follow_up_query(spark, d):
    q = questions(spark, d).join(queryx.latest_turns(_turns(spark, d)), "qid", "left")
    return q.select("qid", queryx.retrieval_query(F.col("question"), F.col("last_user"), F.col("last_assistant"), RULES).alias("query"))


# --- chunking and sources ------------------------------------------------------------------------------------------


def _marked(spark, d) -> DataFrame:
    """Documents as files of text or of code without symbols, in which every twelfth line is a heading or a definition."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 12 == 11, F.concat(F.when(F.col("doc_id") % 2 == 0, "# ").otherwise("export "), x)).otherwise(x))
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".rs"))
    return table(spark, d, "documents").select(F.col("source").alias("repository"), path.alias("file_path"), F.array_join(lines, "\n").alias("content"))


@query(O.FALLBACK)
def fallback_chunks_text(spark, d):
    b = chunking.chunk_files(_marked(spark, d))
    return b.select("file_path", "chunk_ordinal", "symbol_name", "symbol_type", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "signature", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"WITH {O.CHUNKS} SELECT id, file_path, language FROM c")
def detect_language(spark, d):
    return chunks(spark, d).select("id", "file_path", "language")


_FILE = "CASE doc_id % 6 WHEN 0 THEN 'src/node_modules/' || doc_id || '.js' WHEN 1 THEN 'a/Dockerfile' WHEN 2 THEN 'b/yarn.lock' WHEN 3 THEN 'lib/x' || doc_id || '.PY' WHEN 4 THEN 'notes.txt' ELSE 'c/' || source || '.yml' END"


@query(f"""SELECT doc_id, p AS file_path, NOT regexp_matches(p, '(^|/)({'|'.join(x.replace('.', chr(92) + '.') for x in vocab.SKIPPED_DIRS)})(/|$)') AND (list_contains([{O._lit(vocab.SUFFIXES)}], lower(regexp_extract(p, '[^/](\\.[^./]*)$', 1))) OR regexp_extract(p, '[^/]*$') IN ({O._lit(vocab.FILE_NAMES)}))
AND regexp_extract(p, '[^/]*$') NOT IN ({O._lit(vocab.LOCK_FILES)}) AND n_chars * 100 <= {vocab.MAX_BYTES} AS accepted FROM (SELECT doc_id, n_chars, {_FILE} AS p FROM documents)""")
def file_filter(spark, d):
    k, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    p = F.when(k == 0, F.concat(F.lit("src/node_modules/"), n, F.lit(".js"))).when(k == 1, F.lit("a/Dockerfile")).when(k == 2, F.lit("b/yarn.lock")).when(k == 3, F.concat(F.lit("lib/x"), n, F.lit(".PY"))).when(k == 4, F.lit("notes.txt")).otherwise(F.concat(F.lit("c/"), "source", F.lit(".yml")))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", p.alias("file_path"))
    return rows.select("doc_id", "file_path", files.accepted(F.col("file_path"), F.col("n_chars") * 100).alias("accepted"))


@query(O.OVERLAP)
def overlap_chunks(spark, d):
    return chunking.overlap_chunks(table(spark, d, "documents").select("doc_id", "text"))


_LINES = "string_split(replace(replace(text, chr(39), ' '), chr(92), ' '), chr(10))"


@query(f"""WITH s AS (SELECT doc_id, {O.PATH} AS file_path, list_concat(['def f():'], list_transform({_LINES}, lambda x, i: (CASE WHEN i = 1 THEN '    ' || repeat(chr(39), 3) ELSE '' END) || x || (CASE WHEN i = len({_LINES}) THEN repeat(chr(39), 3) ELSE '' END)), ['    return 1']) AS l FROM documents WHERE doc_id % 5 IN (1, 2))
SELECT file_path, 'python' AS language, 0::BIGINT AS chunk_ordinal, 'f' AS symbol_name, 'function_definition' AS symbol_type, 1::BIGINT AS line_start, len(l)::BIGINT AS line_end, l[1] AS signature, md5(array_to_string(l, chr(10))) AS digest FROM s""")
def symbol_chunks(spark, d):
    f = chunks(spark, d).filter("language = 'python'").select("repository", "file_path", F.concat(F.lit("def f():\n    '''"), F.regexp_replace("content", r"['\\]", " "), F.lit("'''\n    return 1\n\nx = 1\n")).alias("content"))
    b = chunking.chunk_files(f)
    return b.select("file_path", "language", "chunk_ordinal", "symbol_name", "symbol_type", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "signature", F.md5(F.col("content").cast("binary")).alias("digest"))


_RUST = "'use std::fmt;' || chr(10) || 'mod m {' || chr(10) || '    pub fn f' || doc_id || '() {' || chr(10) || '        let s = \"}\"; // ' || source || chr(10) || '    }' || chr(10) || '}' || chr(10) || 'impl Show for T' || doc_id || ' {' || chr(10) || '    fn g() {}' || chr(10) || '}' || chr(10) || 'struct One;' || chr(10)"


@query(f"""WITH s AS (SELECT doc_id, string_split({_RUST}, chr(10)) AS l FROM documents), c AS (SELECT doc_id, 0::BIGINT AS chunk_ordinal, 'f' || doc_id AS symbol_name, 'function_item' AS symbol_type, 3::BIGINT AS line_start, 5::BIGINT AS line_end, l FROM s
UNION ALL SELECT doc_id, 1, 'Show', 'impl_item', 7, 9, l FROM s) SELECT 'f' || doc_id || '.rs' AS file_path, chunk_ordinal, symbol_name, symbol_type, line_start, line_end, trim(l[line_start]) AS signature, md5(trim(array_to_string(l[line_start:line_end], chr(10)))) AS digest FROM c""")
def brace_chunks(spark, d):
    n = F.col("doc_id").cast("string")
    lines = ["use std::fmt;", "mod m {", F.concat(F.lit("    pub fn f"), n, F.lit("() {")), F.concat(F.lit('        let s = "}"; // '), "source"), "    }", "}", F.concat(F.lit("impl Show for T"), n, F.lit(" {")), "    fn g() {}", "}", "struct One;", ""]
    body = F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    f = table(spark, d, "documents").select(F.col("source").alias("repository"), F.concat(F.lit("f"), n, F.lit(".rs")).alias("file_path"), body.alias("content"))
    b = chunking.chunk_files(f)
    return b.select("file_path", "chunk_ordinal", "symbol_name", "symbol_type", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "signature", F.md5(F.col("content").cast("binary")).alias("digest"))


_U = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(rf"""WITH u AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, list_filter(string_split({_U}, '/'), lambda p: p <> '') AS ps FROM pages)
SELECT page_id, ps[1] AS owner, regexp_replace(ps[2], '\.git$', '') AS repo, regexp_replace(ps[1] || '-' || regexp_replace(ps[2], '\.git$', ''), '[^a-zA-Z0-9_.-]+', '-', 'g') AS slug, CASE WHEN len(ps) >= 4 AND ps[3] IN ('tree', 'blob') THEN ps[4] ELSE 'main' END AS branch, 'https://' || host || '/' || ps[1] || '/' || regexp_replace(ps[2], '\.git$', '') AS repo_url FROM u WHERE len(ps) >= 2""")
def parse_repo_url(spark, d):
    r = table(spark, d, "pages").select("page_id", files.parse_repo_url(F.col("url"), hosts=None).alias("r"))
    return r.filter("r.error is null").select("page_id", "r.owner", "r.repo", "r.slug", "r.branch", "r.repo_url")


@query(f"WITH {O.CHUNKS} SELECT id, 'https://code.example/o/' || repository || '/blob/' || CASE WHEN id % 3 = 0 THEN 'dev' ELSE 'main' END || '/' || file_path || '#L' || line_start || '-L' || line_end AS link FROM c")
def source_link(spark, d):
    c = chunks(spark, d)
    branch = F.when(F.col("id") % 3 == 0, "dev").when(F.col("id") % 3 == 1, "")
    return c.select("id", answer.source_link(F.concat(F.lit("https://code.example/o/"), "repository", F.lit("/")), branch, F.col("file_path"), F.col("line_start"), F.col("line_end")).alias("link"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def doc_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# --- answers -------------------------------------------------------------------------------------------------------

_SRC = f"WITH {O.QUESTIONS}, {O.BM25_BASE.strip()}, {O.bm25(4).strip()}, {O.CHUNKS}, s AS (SELECT lx.qid, bm25_rank AS source_no, bm25_score, (bm25_score / 40)::DOUBLE AS semantic_score, c.* EXCLUDE (repository) FROM lx JOIN c ON c.id = lx.id)"


def _sources(spark, d) -> DataFrame:
    c = chunks(spark, d)
    lex = _found(spark, d, questions(spark, d), 4).withColumnRenamed("bm25_rank", "source_no")
    return fusion.with_texts(lex, c.drop("repository"), "id").withColumns({"semantic_score": F.col("bm25_score") / 40, "rrf_score": F.lit(None).cast("double"), "rerank_score": F.lit(None).cast("double")})


@query(f"{_SRC} SELECT qid, md5(string_agg('[Source ' || source_no || ']' || chr(10) || 'File: ' || file_path || chr(10) || 'Symbol: ' || symbol_name || chr(10) || 'Lines: ' || line_start || '-' || line_end || chr(10) || substring(content, 1, 1500), chr(10) || chr(10) ORDER BY source_no)) AS digest FROM s GROUP BY qid")
def context_blocks(spark, d):
    return answer.contexts(_sources(spark, d)).select("qid", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(f"{_SRC} SELECT qid, source_no, file_path, language, symbol_name, symbol_type, line_start, line_end, signature, md5(content) AS snippet, round(semantic_score, 4) AS semantic_score, round(bm25_score, 4) AS bm25_score, 0::DOUBLE AS rrf_score, 0::DOUBLE AS rerank_score FROM s")
def slim_sources(spark, d):
    return answer.slim_sources(_sources(spark, d)).withColumn("snippet", F.md5(F.col("snippet").cast("binary"))).withColumn("line_end", F.col("line_end").cast("long"))


@query(f"{_SRC} SELECT qid, CASE WHEN count(*) >= 3 AND arg_min(semantic_score, source_no) >= 0.75 THEN 'high' WHEN arg_min(semantic_score, source_no) >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM s GROUP BY qid")
def confidence_label(spark, d):
    return answer.confidence_label(_sources(spark, d))


@query("SELECT vec_id, CASE WHEN embedding[1] > 0 THEN least(greatest(floor(100 * embedding[1]::DOUBLE + 0.5), 8), 99)::BIGINT WHEN embedding[2] <> 0 THEN least(greatest(floor(100 / (1 + exp(-embedding[2]::DOUBLE / 4)) + 0.5), 8), 99)::BIGINT ELSE 0 END AS percent FROM embeddings")
def confidence_percent(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", answer.confidence_percent(at(0), at(1)).alias("percent"))


_MD = "CASE doc_id % 6 WHEN 0 THEN '```markdown' || chr(10) || text || chr(10) || '```' WHEN 1 THEN 'Based on the provided context, ' || text || ' [Source 1, Source 2]' WHEN 2 THEN text || chr(10) || '- ' WHEN 3 THEN text || chr(10) || chr(10) || chr(10) || chr(10) || 'end.' WHEN 4 THEN '' ELSE text || ' (see [Source 3]' END"


def _drafts(spark, d) -> DataFrame:
    k = F.col("doc_id") % 6
    t = (
        F.when(k == 0, F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Based on the provided context, "), "text", F.lit(" [Source 1, Source 2]")))
        .when(k == 2, F.concat("text", F.lit("\n- "))).when(k == 3, F.concat("text", F.lit("\n\n\n\nend."))).when(k == 4, F.lit("")).otherwise(F.concat("text", F.lit(" (see [Source 3]")))
    )
    return table(spark, d, "documents").select("doc_id", t.alias("draft"))


def _st(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_CLEAN = _st(r"regexp_replace(X, '(?i)^```(?:markdown|md)?\s*|\s*```$', '', 'g')".replace("X", _st("draft")))
_CLEAN = rf"regexp_replace({_CLEAN}, '(?i)\s*\[Source\s+\d+(?:\s*,\s*Source\s+\d+)*\]', '', 'g')"
_CLEAN = _st(rf"regexp_replace({_CLEAN}, '(?i)^(?:based on|from) the provided context[,:\s-]*', '')")
_CLEAN = _st(rf"regexp_replace({_CLEAN}, '(?m)\n(?:#{{1,6}}|[-*])\s*$', '', 'g')")
_CLEAN = _st(rf"regexp_replace({_CLEAN}, '(?:\n\s*){{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, md5(CASE WHEN c = '' THEN '{answer.EMPTY}' ELSE c END) AS digest FROM (SELECT doc_id, {_CLEAN} AS c FROM (SELECT doc_id, {_MD} AS draft FROM documents))")
def clean_markdown(spark, d):
    return _drafts(spark, d).select("doc_id", F.md5(answer.clean_markdown(F.col("draft")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, {O.incomplete(_st('draft'))} AS incomplete FROM (SELECT doc_id, {_MD} AS draft FROM documents)")
def looks_incomplete(spark, d):
    return _drafts(spark, d).select("doc_id", answer.looks_incomplete(F.col("draft")).alias("incomplete"))


@query(rf"""WITH t AS (SELECT doc_id, {_st('draft')} AS t FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substring(text, 1, 400) || chr(10) || '- and then the' WHEN 1 THEN 'Short. Then ' || substring(text, 1, 30) || chr(10) || 'goes to' ELSE text END AS draft FROM documents)),
l AS (SELECT doc_id, t, {_st("regexp_extract(t, '(?s)^(.*[.!?][''" + '"' + "`)" + chr(92) + "]]*)', 1)")} AS sentences, string_split(t, chr(10)) AS ls FROM t),
w AS (SELECT *, coalesce(list_max(list_transform(ls, lambda x, i: CASE WHEN {O.incomplete(_st('x'))} THEN NULL ELSE i END)), 0) AS last FROM l),
x AS (SELECT *, {_st("array_to_string(ls[1:last], chr(10))")} AS whole FROM w)
SELECT doc_id, md5(CASE WHEN t = '' THEN '{answer.EMPTY}' WHEN NOT ({O.incomplete('t')}) THEN t WHEN len(regexp_extract_all(sentences, '\S+')) >= 12 THEN sentences WHEN last > 0 AND whole <> '' THEN whole ELSE t END) AS digest FROM x""")
def finalize_answer(spark, d):
    k, n = F.col("doc_id") % 3, F.substring("text", 1, 400)
    t = F.when(k == 0, F.concat(n, F.lit("\n- and then the"))).when(k == 1, F.concat(F.lit("Short. Then "), F.substring("text", 1, 30), F.lit("\ngoes to"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(answer.finalised(t).cast("binary")).alias("digest"))


@query(f"""WITH {O.QUESTIONS} SELECT qid, md5('{answer.RULES[0]}' || chr(10) || '{answer.RULES[1]}' || chr(10) || '{answer.RULES[2]}' || CASE WHEN i = 'overview' THEN chr(10) || '{answer.OVERVIEW_RULE}' WHEN i IN ({O._lit(vocab.CODE_FIRST)}) THEN chr(10) || '{answer.CODE_RULE}' ELSE '' END
|| chr(10) || chr(10) || 'Repository: ' || repository || chr(10) || chr(10) || 'context of ' || qid || chr(10) || chr(10) || 'Conversation: None' || chr(10) || chr(10) || 'Question: ' || question) AS digest FROM (SELECT *, {O.intent('question')} AS i FROM q)""")
def answer_prompt(spark, d):
    q = questions(spark, d).withColumns({"context": F.concat(F.lit("context of "), F.col("qid").cast("string")), "history": F.lit(None).cast("string")})
    return answer.prompts(q).select("qid", F.md5(F.col("prompt").cast("binary")).alias("digest"))


_PERCENT = "CASE WHEN semantic_score > 0 THEN least(greatest(floor(100 * semantic_score + 0.5), 8), 99)::BIGINT ELSE 0 END"


@query(f"{_SRC} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY percent DESC, source_no) AS citation_no, file_path AS source, symbol_name AS reason, percent FROM (SELECT *, {_PERCENT} AS percent FROM (SELECT * REPLACE (CASE WHEN source_no = 1 THEN semantic_score / 2 ELSE semantic_score END AS semantic_score) FROM s))")
def citation_order(spark, d):
    # The first source's score is halved, so that the order is not that of the sources.
    rows = _sources(spark, d).withColumn("semantic_score", F.when(F.col("source_no") == 1, F.col("semantic_score") / 2).otherwise(F.col("semantic_score")))
    return answer.citations(rows)


@query(f"SELECT doc_id, substring({O.sq('text')}, 1, 160) AS summary FROM documents")
def answer_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", answer.summary(F.col("text")).alias("summary"))


_ERR = "CASE page_id % 5 WHEN 0 THEN 'fatal: could not read Username for x' WHEN 1 THEN 'remote: Repository not found.' WHEN 2 THEN 'clone timed out' WHEN 3 THEN 'Authentication FAILED' ELSE url END"


@query(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'The repository is private or does not exist.' WHEN 3 THEN 'The repository is private or does not exist.' WHEN 1 THEN 'The repository was not found.' WHEN 2 THEN 'The repository took too long to read.' ELSE url END AS shown FROM pages")
def error_text(spark, d):
    said = {0: "fatal: could not read Username for x", 1: "remote: Repository not found.", 2: "clone timed out", 3: "Authentication FAILED"}
    m = F.col("url")
    for k, v in said.items():
        m = F.when(F.col("page_id") % 5 == k, v).otherwise(m)
    return table(spark, d, "pages").select("page_id", answer.friendly_error(m).alias("shown"))


@query(O.BLOCKS)
def markdown_blocks(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 9 == 0, F.concat(F.lit("## "), x)).when(i % 9 == 2, F.concat(F.lit("- "), x)).when(i % 9 == 3, F.concat(F.lit("* "), x)).when(i % 9 == 5, F.lit("```py")).when(i % 9 == 7, F.lit("```")).when(i % 9 == 8, F.lit("")).otherwise(x))
    b = answer.markdown_blocks(table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")))
    return b.select("doc_id", "block_no", "kind", "level", "language", F.md5(F.col("body").cast("binary")).alias("digest"))


# --- catalog and sessions ------------------------------------------------------------------------------------------

_NOW = "1996-06-01"
_CAT = "SELECT o_orderkey AS id, 's' || (o_custkey % 50) || '::u' || (o_orderkey % 997) AS github_url, 's' || (o_custkey % 50) AS session_key, o_orderdate::TIMESTAMP AS updated_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::TIMESTAMP + INTERVAL 120 MINUTE END AS session_expires_at FROM orders"


def _catalog(spark, d) -> DataFrame:
    session = F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string"))
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), catalog.url_key(session, F.concat(F.lit("u"), (F.col("o_orderkey") % 997).cast("string"))).alias("github_url"), session.alias("session_key"),
        at.alias("updated_at"), F.when(F.col("o_orderkey") % 7 != 0, catalog.expiry(at)).alias("session_expires_at"),
    )


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp_ntz")


@query(f"SELECT id, updated_at FROM ({_CAT}) WHERE session_key = 's7' ORDER BY updated_at DESC, id")
def session_list(spark, d):
    return catalog.session_list(_catalog(spark, d), F.lit("s7")).select("id", "updated_at")


@query(f"SELECT id, session_key FROM ({_CAT}) WHERE session_expires_at < TIMESTAMP '{_NOW}'")
def expired_sessions(spark, d):
    return catalog.expired(_catalog(spark, d), _now()).select("id", "session_key")


@query(f"SELECT id, CASE WHEN session_key = 's7' THEN TIMESTAMP '{_NOW}' + INTERVAL 120 MINUTE ELSE session_expires_at END AS session_expires_at FROM ({_CAT})")
def session_touch(spark, d):
    return catalog.touch(_catalog(spark, d), F.lit("s7"), _now()).select("id", "session_expires_at")


@query(f"WITH k AS ({_CAT}) SELECT l_orderkey AS repository, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM k WHERE session_expires_at < TIMESTAMP '{_NOW}') GROUP BY 1")
def cascade_delete(spark, d):
    gone = catalog.expired(_catalog(spark, d), _now())
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("repository"))
    return catalog.cascade(rows, gone).groupBy("repository").agg(F.count("*").alias("n"))


@query(f"WITH k AS (SELECT min(id) AS id, github_url, min(updated_at) AS updated_at FROM ({_CAT}) GROUP BY github_url), n AS (SELECT max(id) AS id, github_url, max(updated_at) AS updated_at FROM ({_CAT}) WHERE id % 4 = 1 GROUP BY github_url) SELECT coalesce(k.id, n.id) AS id, github_url, coalesce(n.updated_at, k.updated_at) AS updated_at FROM k FULL JOIN n USING (github_url)")
def catalog_upsert(spark, d):
    c = _catalog(spark, d).withColumn("created_at", F.col("updated_at"))
    old = c.groupBy("github_url").agg(F.min("id").alias("id"), F.min("updated_at").alias("updated_at"), F.min("created_at").alias("created_at"))
    new = c.filter("id % 4 = 1").groupBy("github_url").agg(F.max("id").alias("id"), F.max("updated_at").alias("updated_at"), F.max("created_at").alias("created_at"))
    return catalog.upsert(old, new).select("id", "github_url", "updated_at")


@query(f"SELECT count(*) AS gone, 0::BIGINT AS left_over FROM ({_CAT})")
def catalog_wipe(spark, d):
    stays, goes = catalog.wiped(_catalog(spark, d))
    return goes.agg(F.count("*").alias("gone")).join(stays.agg(F.count("*").alias("left_over")), F.lit(True))


@query("SELECT doc_id, sha256(source || chr(31) || doc_id || chr(31) || lang) AS id FROM documents")
def vector_ids(spark, d):
    return vector.vector_ids(table(spark, d, "documents"), "source", "doc_id", "lang").select("doc_id", "id")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 120 MINUTE AS expires_at, count(*) AS n_events FROM s GROUP BY user_id, s""")
def session_ttl_windows(spark, d):
    return session_windows(table(spark, d, "events").select("user_id", "ts"))


@query("SELECT user_id AS repository, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS progress FROM (SELECT user_id, event_type, arg_max(event_id, event_id) AS v FROM events GROUP BY ALL) GROUP BY 1")
def progress_merge(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("repository"), F.col("event_id").alias("at"), F.create_map("event_type", F.col("event_id").cast("string")).alias("values"))
    pair = F.transform(F.map_entries("progress"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return catalog.progress(u).select("repository", F.array_join(pair, ",").alias("progress"))


# --- evaluation ----------------------------------------------------------------------------------------------------

_E = f"WITH {O.eval_details().strip()}"
_M = ("retrieval_hit", "top1_hit", "source_recall", "mrr", "unique_source_precision", "duplicate_source_rate")


def _metrics(spark, d) -> DataFrame:
    return evaluation.details(cases(spark, d))


@query(f"WITH {O.CASES.strip()} SELECT id, a AS actual, e AS expected, {O.path_match(O.norm_path('a'), O.norm_path('e'))} AS matched FROM (SELECT id, unnest(retrieved_sources) AS a, expected_sources FROM cs), LATERAL (SELECT unnest(expected_sources) AS e)")
def eval_path_match(spark, d):
    p = cases(spark, d).select("id", F.explode("retrieved_sources").alias("actual"), "expected_sources").select("id", "actual", F.explode("expected_sources").alias("expected"))
    return p.withColumn("matched", evaluation.path_matches(T.normal_path(F.col("actual")), T.normal_path(F.col("expected"))))


@query(f"{_E} SELECT id, {', '.join(f'round({m}, 6) AS {m}' if m not in ('retrieval_hit', 'top1_hit') else m for m in _M)} FROM d")
def eval_retrieval_metrics(spark, d):
    return _metrics(spark, d).select("id", *[F.round(m, 6).alias(m) if m not in ("retrieval_hit", "top1_hit") else m for m in _M])


@query(f"{_E} SELECT id, round(keyword_coverage, 6) AS keyword_coverage, keyword_pass, matched_keyword_count, total_keywords, matched_keywords, missing_keywords FROM d")
def eval_keyword_match(spark, d):
    return _metrics(spark, d).select("id", F.round("keyword_coverage", 6).alias("keyword_coverage"), "keyword_pass", "matched_keyword_count", "total_keywords", F.array_join("matched_keywords", "|").alias("matched_keywords"), F.array_join("missing_keywords", "|").alias("missing_keywords"))


@query(f"{_E} SELECT id, round(ground_truth_lexical_overlap, 6) AS ground_truth_lexical_overlap, reference_support_pass, reference_term_match_count, reference_term_count, matched_reference_terms, answer_word_count, has_substantive_answer FROM d")
def eval_reference_support(spark, d):
    return _metrics(spark, d).select("id", F.round("ground_truth_lexical_overlap", 6).alias("ground_truth_lexical_overlap"), "reference_support_pass", "reference_term_match_count", "reference_term_count", F.array_join("matched_reference_terms", "|").alias("matched_reference_terms"), "answer_word_count", "has_substantive_answer")


@query(f"{_E} SELECT {O.RATES} FROM d")
def eval_summary(spark, d):
    return evaluation.overall(_metrics(spark, d))


@query(f"{_E} SELECT category, {O.RATES} FROM d GROUP BY category")
def eval_by_category(spark, d):
    return evaluation.by_category(_metrics(spark, d))


@query(f"{_E} SELECT category, {O.RATES} FROM d GROUP BY ROLLUP (category)")
def eval_report(spark, d):
    return evaluation.report(_metrics(spark, d))


def _suspect(spark, d) -> DataFrame:
    c = cases(spark, d)
    i = F.regexp_extract("id", r"\d+", 0).cast("long")
    return c.select(
        F.when(i % 10 == 9, "case-0").otherwise(F.col("id")).alias("id"), F.when(i % 9 == 0, " ").otherwise(F.col("question")).alias("question"), F.when(i % 11 == 0, None).otherwise(F.col("ground_truth")).alias("ground_truth"),
        F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("expected_sources")).alias("expected_sources"), "must_include_any",
    )


@query(f"""WITH {O.CASES.strip()}, x AS (SELECT CASE WHEN item_id % 10 = 9 THEN 'case-0' ELSE id END AS id, CASE WHEN item_id % 9 = 0 THEN ' ' ELSE question END AS question, CASE WHEN item_id % 11 <> 0 THEN ground_truth END AS ground_truth,
CASE WHEN item_id % 13 = 0 THEN [] ELSE expected_sources END AS expected_sources, list_filter(list_transform(must_include_any, lambda k: array_to_string({O.eval_tokens("k")}, ' ')), lambda p: p <> '') AS kw FROM cs)
SELECT id, 'error' AS severity, 'missing question' AS problem FROM x WHERE trim(question) = '' UNION ALL SELECT id, 'error', 'missing ground_truth' FROM x WHERE ground_truth IS NULL UNION ALL SELECT id, 'error', 'expected_sources must not be empty' FROM x WHERE len(expected_sources) = 0
UNION ALL SELECT id, 'warning', 'keywords repeat after normalisation' FROM x WHERE len(list_distinct(kw)) <> len(kw) UNION ALL SELECT id, 'error', 'duplicate id' FROM x GROUP BY id HAVING count(*) > 1""")
def eval_audit(spark, d):
    return evaluation.audit_rows(_suspect(spark, d))


@query(f"""WITH {O.CASES.strip()} SELECT count(*) AS case_count, 0::BIGINT AS conversations, round(avg(len(expected_sources)), 2) AS average_expected_sources, round(avg(len(must_include_any)), 2) AS average_keywords, count(DISTINCT category) AS categories,
(SELECT count(*) FROM (SELECT category FROM cs GROUP BY 1 HAVING count(*) < 2)) AS sparse_categories, 'case' AS dominant_prefix, 1::DOUBLE AS dominant_prefix_fraction, 'single_repository' AS scope FROM cs""")
def eval_audit_set(spark, d):
    return evaluation.audit_set(cases(spark, d).withColumn("turns", F.array().cast("array<struct<role:string,content:string>>")))


@query("""SELECT 'warning' AS severity, problem FROM (SELECT unnest([CASE WHEN n < 25 THEN 'fewer than 25 cases' END, CASE WHEN c < 4 THEN 'fewer than 4 categories' END, 'fewer than 2 conversations', CASE WHEN s > 0 THEN 'categories with fewer than 2 cases' END, 'most ids have one prefix']) AS problem
FROM (SELECT count(*) AS n, count(DISTINCT CASE WHEN item_id = 7 THEN 9 ELSE item_id % 3 END) AS c, 1 AS s FROM benchmark WHERE item_id < 20)) WHERE problem IS NOT NULL""")
def eval_audit_warnings(spark, d):
    few = cases(spark, d).filter(F.regexp_extract("id", r"\d+", 0).cast("long") < 20)
    i = F.regexp_extract("id", r"\d+", 0).cast("long")
    few = few.withColumns({"category": F.concat(F.lit("c"), F.when(i == 7, 9).otherwise(i % 3).cast("string")), "turns": F.array().cast("array<struct<role:string,content:string>>")})
    return evaluation.audit_warnings(few)


_HEAD = " UNION ALL ".join(
    f"SELECT {i + 1}::BIGINT AS position, '{name}' AS metric, {c if c not in evaluation.JUDGED else 'NULL'}::DOUBLE AS value, {evaluation.GATES.get(c, 'NULL')}::DOUBLE AS gate FROM o" for i, (name, c) in enumerate(evaluation.HEADLINES)
)


@query(f"{_E}, o AS (SELECT {O.RATES} FROM d), h AS ({_HEAD}) SELECT *, CASE WHEN value IS NULL THEN 'absent' WHEN gate IS NULL THEN 'measured' WHEN value >= gate THEN 'pass' ELSE 'needs_work' END AS status FROM h")
def eval_headline(spark, d):
    return evaluation.headline(evaluation.overall(_metrics(spark, d)))


#: Words of a passage by which documents are found that may hold it.
ANCHOR = 3


@query("""WITH g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT b.item_id, count(g.doc_id) AS n_gold, coalesce(min(g.doc_id), -1) AS first_gold FROM benchmark b LEFT JOIN g USING (item_id) GROUP BY 1""")
def gold_passages(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    found = files.containing(table(spark, d, "documents").select("doc_id", "text"), b, ANCHOR)
    g = found.groupBy("item_id").agg(F.count("*").alias("n_gold"), F.min("doc_id").alias("first_gold"))
    return b.select("item_id").join(g, "item_id", "left").select("item_id", F.coalesce("n_gold", F.lit(0)).cast("long").alias("n_gold"), F.coalesce("first_gold", F.lit(-1)).cast("long").alias("first_gold"))
