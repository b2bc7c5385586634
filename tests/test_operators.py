"""Hand-computed cases of the retrieval engine's operators."""

import datetime
import hashlib
import math
import os
import random
import subprocess

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaerix import queries
from quaerix.functions import queryx, text, vocab
from quaerix.operators import answer, catalog, chunking, evaluation, fusion, lexical, vector
from quaerix.operators.chunking import chunk_files, fallback_blocks, overlap_slices, symbol_blocks
from quaerix.operators.embed import HashingEmbedder, RemoteEmbedder, embedder_from, in_batches
from quaerix.plans.engine import Engine
from quaerix.sources.files import accepted, clone, containing, eval_set, parse_repo_url, source_files, text_documents, write_report
from quaerix.streaming.sessions import ingest_chunks, latest_chunks, session_windows, stream_sessions


def one(spark, column, **values):
    """A column's value over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


SF = "/root/testdata/sf0.01"

# --- lexical -------------------------------------------------------------------------------------------------------

CORPUS = {"a": "apple banana apple", "b": "apple cherry", "c": "date 42 été"}


def okapi(corpus, query):
    """BM25 from its formula."""
    import re

    docs = {k: [t.lower() for t in re.findall(text.TOKEN, v)] for k, v in corpus.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    words = [t.lower() for t in re.findall(text.TOKEN, query)]
    return {k: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in words) for k, d in docs.items()}


@pytest.mark.parametrize("query", ["apple", "cherry apple apple", "nothing", "Apple date"])
def test_bm25(spark, query):
    chunks = spark.createDataFrame([(1, k, v) for k, v in CORPUS.items()], "repository long, id string, searchable_text string")
    q = spark.createDataFrame([(7, 1, query)], "qid long, repository long, query string")
    got = {r["id"]: (r["bm25_score"], r["bm25_rank"]) for r in lexical.bm25(chunks, q, 3).collect()}
    want = okapi(CORPUS, query)
    # Documents that match nothing stay, with a score of zero; ties go by id.
    order = sorted(want, key=lambda k: (-round(want[k], 6), k))
    assert {k: s for k, (s, _) in got.items()} == pytest.approx(want, abs=1e-6)
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1][1])] == order


def test_bm25_without_tokens_or_chunks(spark):
    chunks = spark.createDataFrame([(1, "a", "x y")], "repository long, id string, searchable_text string")
    q = spark.createDataFrame([(1, 1, "42 !"), (2, 9, "x")], "qid long, repository long, query string")
    assert lexical.bm25(chunks, q, 3).count() == 0


def test_stored_index(spark, tmp_path):
    """A written index gives what texts give, keeps empty documents, and replaces only the repositories at hand."""
    rows = [(1, k, v) for k, v in CORPUS.items()] + [(1, "e", ""), (2, "a", "apple pie"), (2, "b", "tart")]
    chunks = spark.createDataFrame(rows, "repository long, id string, searchable_text string")
    q = spark.createDataFrame([(7, 1, "apple date"), (8, 2, "tart")], "qid long, repository long, query string")
    path = str(tmp_path / "index")
    want = sorted(map(tuple, lexical.bm25(chunks, q, 9).collect()))
    assert sorted(map(tuple, lexical.search(lexical.write_index(chunks, path), q, 9).collect())) == want
    again = spark.createDataFrame([(2, "c", "tart tart")], "repository long, id string, searchable_text string")
    lexical.write_index(again, path)
    got = lexical.search(lexical.read_index(spark, path, chunks), q, 9).collect()
    assert sorted(tuple(r) for r in got if r["repository"] == 1) == [r for r in want if r[1] == 1]
    assert [r["id"] for r in got if r["repository"] == 2] == ["c"]


def shuffled(spark, work) -> int:
    """Bytes that *work* shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    old = total()
    work()
    return total() - old


def test_index_shuffles_no_postings(spark, tmp_path):
    """Texts may be dealt out once; their postings, which are several times larger, stay where they are counted."""
    rng = random.Random(3)
    terms = [f"{rng.getrandbits(40):010x}x".replace("0", "a") for _ in range(3000)]
    rows = [(k % 2, k, " ".join(f"t{t}" for t in rng.sample(terms, 1000))) for k in range(300)]
    chunks = spark.createDataFrame(rows, "repository long, id long, searchable_text string").repartition(4).cache()
    chunks.count()
    size = sum(len(r[2]) for r in rows)
    assert shuffled(spark, lambda: lexical.write_index(chunks, str(tmp_path / "index"))) < size
    chunks.unpersist()


def test_index_of_repeated_ids(spark, tmp_path):
    """Rows of one id and length are one document with several texts; each counts in its repository's size. A null id or repository is its own."""
    rows = [(1, "a", "b b a"), (1, "a", "c b d"), (1, "a", "x"), (1, "b", ""), (1, "b", ""), (1, "c", None), (1, None, "x y"), (None, None, "z")]
    chunks = spark.createDataFrame(rows, "repository long, id string, searchable_text string")
    for index in (lexical.build_index(chunks), lexical.write_index(chunks, str(tmp_path / "index"))):
        got = sorted(tuple(r) for r in lexical.postings(index.words).filter("repository = 1").select("term", F.coalesce("id", F.lit("-")), "dl", "tf").collect())
        assert got == [("a", "a", 3, 1), ("b", "a", 3, 3), ("c", "a", 3, 1), ("d", "a", 3, 1), ("x", "-", 2, 1), ("x", "a", 1, 1), ("y", "-", 2, 1)]
        assert index.corpus.filter("repository = 1").select("n", "avgdl").first()[:] == (7, 9 / 7)
        assert {(r["term"], r["df"]) for r in index.terms.filter("repository = 1").collect()} == {("a", 1), ("b", 1), ("c", 1), ("d", 1), ("x", 2), ("y", 1)}
        assert index.words.count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_texts_are_not_shuffled(spark):
    """What was found goes to the texts, not the texts to what was found."""
    queries.indexed(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size = shuffled(spark, lambda: queries.QUERIES["hybrid_retrieve_flagship"](spark, SF).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert size < 2 << 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["bm25_idf_table", "prioritize", "rrf_fusion", "bm25_batch"])
def test_queries_that_build_an_index(spark, name):
    """A query that has to build the index shuffles its texts and vocabulary (here mostly words of one text), not postings: these were five times the texts."""
    queries._INDEXES.clear()
    size = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    got = shuffled(spark, lambda: queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert got < 3.5 * size


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("a/b.py:c 42 Été foo_Bar"))) == ["a/b.py:c", "t", "foo_bar"]
    assert one(spark, text.code_terms(F.lit("getUserName a.beta/c-delta the 12"))) == ["a.beta/c-delta", "beta", "delta", "get", "getusername", "name", "user"]
    assert one(spark, text.path_fragments(F.lit("see ./Src/a.py, x"))) == ["src/a.py"]


# --- vectors and fusion --------------------------------------------------------------------------------------------


def test_vector_search(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [0.6, 0.8], 1), ("c", [0.0, 2.0], 2), ("z", [0.0, 0.0], 1), ("n", None, 1)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>, vfilter int")
    q = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2)], "qid long, qvec array<float>, qfilter int")
    got = [tuple(r) for r in vector.vector_batch(v, q, 2).orderBy("qid", "semantic_rank").select("qid", "id", "semantic_score").collect()]
    assert got == [(1, "a", 1.0), (1, "b", 0.6), (2, "c", 1.0), (2, "b", 0.8)]
    kept = [(r["qid"], r["id"]) for r in vector.vector_batch(v, q, 5, True).orderBy("qid", "semantic_rank").collect()]
    assert kept == [(1, "a"), (1, "b"), (2, "c")]
    assert [r["id"] for r in vector.vector_topk(v, [0.0, 1.0], 2, F.col("vfilter") == 1).collect()] == ["b", "a"]


def test_vector_batches_by_parts(spark):
    """Questions beyond the bound are searched in parts, over several blocks of vectors, with ties by id."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 4)), 1)
    v = spark.createDataFrame([(f"v{i:03d}", r.tolist(), i % 3) for i, r in enumerate(x)], "id string, embedding array<double>, vfilter int").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist(), i % 3 if i else None) for i in range(25)], "qid long, qvec array<double>, qfilter int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for filtered in (False, True):
        got = {}
        for r in vector.vector_batch(v, q, 6, filtered, most=10).orderBy("qid", "semantic_rank").collect():
            got.setdefault(r["qid"], []).append((r["id"], r["semantic_score"]))
        for i in range(25):
            score = np.round(unit @ unit[i], 6)
            order = sorted((j for j in range(300) if not filtered or (i and j % 3 == i % 3)), key=lambda j: (-score[j], j))[:6]
            assert got.get(i, []) == [(f"v{j:03d}", float(score[j]) + 0.0) for j in order]


def test_model_reranker(spark):
    class Length:
        def score(self, pairs):
            return [len(q) + len(b) for q, b in pairs]

    df = spark.createDataFrame([("ab", "c"), ("a", None)], "q string, b string")
    assert sorted(r["s"] for r in df.select(fusion.model_reranker(Length(), batch=1)("q", "b").alias("s")).collect()) == [1.0, 3.0]


def test_rrf_order_and_bound(spark):
    lex = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", 1.0, 2)], "qid long, id string, bm25_score double, bm25_rank long")
    sem = spark.createDataFrame([(1, "c", 0.9, 1), (1, "b", 0.8, 2)], "qid long, id string, semantic_score double, semantic_rank long")
    got = fusion.rrf(lex, sem, 10).orderBy("candidate_rank").collect()
    # b is in both lists; a and c tie, and the lexical one comes first.
    assert [r["id"] for r in got] == ["b", "a", "c"]
    assert max(r["rrf_score"] for r in got) <= 2 / 61
    paths = spark.createDataFrame([(1, "d", 9.0, 1), (1, "a", 5.0, 2)], "qid long, id string, path_score double, path_rank long")
    merged = fusion.merge_path(fusion.rrf(lex, sem, 10), paths, 10).orderBy("merged_rank").collect()
    assert [r["id"] for r in merged] == ["a", "d", "b", "c"]


def test_cap_per_file(spark):
    rows = [(1, "q", "f1", 1), (1, "q", "f1", 2), (1, "q", "f2", 3), (2, "repo overview", "f1", 1), (2, "repo overview", "f1", 2), (2, "repo overview", "f1", 3)]
    got = fusion.cap_per_file(spark.createDataFrame(rows, "qid long, question string, file_path string, position long"), 5)
    assert sorted((r["qid"], r["position"]) for r in got.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2)]


# --- questions -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("question", "want"),
    [("What does this repo do?", "overview"), ("which tests cover it", "tests"), ("the latest news", "general"), ("error_code here", "error_handling"), ("api route", "api"), ("where is the class", "implementation"), ("usage", "docs"), ("", "general"), ("  ", "general")],
)
def test_intent(spark, question, want):
    assert one(spark, queryx.intent(F.lit(question))) == want


def test_expand_and_follow_up(spark):
    assert one(spark, queryx.expand(F.lit("plain words"))) == "plain words"
    assert one(spark, queryx.expand(F.lit("async here"))) == "async here\nasync await asyncio"
    assert one(spark, queryx.is_follow_up(F.lit("a b c d e f g"))) is False
    assert one(spark, queryx.is_follow_up(F.lit("show a b c d e f g"))) is True
    got = one(spark, queryx.retrieval_query(F.lit("and then?"), F.lit("first ask"), F.lit("x" * 400)))
    assert got == "and then?\nFollow-up to: first ask\nPrevious answer: " + "x" * 300


def test_history(spark):
    turns = [(1, i, role, said) for i, (role, said) in enumerate([("user", "one"), ("assistant", "ask a question"), ("user", " "), ("system", "s"), ("user", "two\n three")])]
    h = spark.createDataFrame(turns, "qid long, turn long, role string, text string")
    r = queryx.latest_turns(h).first()
    assert (r["last_user"], r["last_assistant"]) == ("two\n three", None)
    assert queryx.format_history(h).first()["history"].endswith("System: s\nUser: two three")
    assert queryx.history_window(h).count() == 3


def test_vocabularies_are_distinct():
    for name in ("OVERVIEW", "DOCS", "CODE_STOP", "EVAL_STOP", "SUFFIXES", "SKIPPED_DIRS"):
        values = getattr(vocab, name)
        assert len(values) == len(set(values)), name
    assert (len(vocab.OVERVIEW), len(vocab.DOCS), len(vocab.CODE_STOP), len(vocab.EVAL_STOP)) == (16, 19, 32, 29)


# --- chunking and sources ------------------------------------------------------------------------------------------


def test_fallback_boundaries():
    eight, nine = "\n".join(["x"] * 7 + ["# h", "y"]), "\n".join(["x"] * 8 + ["# h", "y"])
    assert [(c["line_start"], c["line_end"]) for c in fallback_blocks(eight, "f", "text")] == [(1, 9)]
    # A heading closes the block before it.
    assert [(c["line_start"], c["line_end"]) for c in fallback_blocks(nine, "f", "text")] == [(1, 9), (10, 10)]
    assert [(c["line_start"], c["line_end"]) for c in fallback_blocks("\n".join(["x"] * 61), "f", "text")] == [(1, 60), (61, 61)]
    assert [(c["line_start"], c["line_end"]) for c in fallback_blocks("\n".join(["x"] * 81), "f", "go")] == [(1, 80), (81, 81)]
    assert fallback_blocks(" \n \n", "f", "text") == []


def test_symbols():
    py = "import os\nclass A:\n    def m(self):\n        pass\n\ndef one(): pass\n\n@dec\ndef two():\n    return 1\n"
    assert [(c["symbol_name"], c["line_start"], c["line_end"]) for c in symbol_blocks(py, "f.py", "python")] == [("A", 2, 4), ("two", 9, 10)]
    js = 'export function f() {\n  return "}";\n}\nclass B {\n  m() {}\n}\n'
    assert [c["symbol_name"] for c in symbol_blocks(js, "f.js", "javascript")] == ["f", "B"]
    assert symbol_blocks("x = 1\n", "f.py", "python")[0]["symbol_type"] == "fallback_chunk"
    assert symbol_blocks("def broken(:\n  x\n", "f.py", "python")[0]["symbol_type"] == "fallback_chunk"
    assert symbol_blocks("  ", "f.py", "python") == []


def kinds(source, name, language):
    return [(c["symbol_name"], c["symbol_type"], c["line_start"], c["line_end"]) for c in symbol_blocks(source, name, language)]


def test_symbols_of_languages_with_braces():
    js = "const one = 1;\nconst two = (a) => {\n  return a;\n};\nfunction* gen() {\n  yield 1;\n}\nmodule.exports = {\n  act(x) {\n    if (x) {\n      go();\n    }\n  },\n};\nvar v = [\n  1,\n]\nlet w = a\n  .b()\nasync function f(\n  a,\n  b\n) {\n}\n"
    assert kinds(js, "f.js", "javascript") == [("two", "lexical_declaration", 2, 4), ("gen", "generator_function_declaration", 5, 7), ("act", "method_definition", 9, 13), ("v", "variable_declaration", 15, 17), ("w", "lexical_declaration", 18, 19), ("f", "function_declaration", 20, 24)]
    ts = "export interface P {\n  a: number;\n}\nexport type T =\n  | 'a'\n  | 'b';\nabstract class Q {\n  m(): void {\n    x();\n  }\n}\nexport default class R {\n  m() {\n  }\n}\n"
    # An abstract class is no kind of its own: its methods are.
    assert kinds(ts, "f.ts", "typescript") == [("P", "interface_declaration", 1, 3), ("T", "type_alias_declaration", 4, 6), ("m", "method_definition", 8, 10), ("R", "class_declaration", 12, 15)]
    java = "package p;\n\n@Service\npublic class A {\n  int f() {\n    return 1;\n  }\n}\nrecord B(int x) {\n  @Override\n  public String toString() {\n    return \"}\";\n  }\n}\nenum C {\n  X, Y\n}\n"
    assert kinds(java, "A.java", "java") == [("A", "class_declaration", 3, 8), ("toString", "method_declaration", 10, 13), ("C", "enum_declaration", 15, 17)]
    go = "package m\n\nfunc (s *S) Do(a int) error {\n\treturn nil\n}\n\nfunc Run() {\n\tx()\n}\n\ntype S struct {\n\ta int\n}\n\ntype One int\n"
    assert kinds(go, "m.go", "go") == [("Do", "method_declaration", 3, 5), ("Run", "function_declaration", 7, 9), ("S", "type_declaration", 11, 13)]
    rust = "pub struct A {\n    x: i32,\n}\nimpl<T> Show for A {\n    fn f<'a>(&'a self) -> char {\n        '{'\n    }\n}\nmod m {\n    pub async fn g() {\n        h();\n    }\n}\npub trait U {\n    fn z();\n}\nenum E {\n    P,\n}\nstruct Unit;\n"
    assert kinds(rust, "a.rs", "rust") == [("A", "struct_item", 1, 3), ("Show", "impl_item", 4, 8), ("g", "function_item", 10, 12), ("U", "trait_item", 14, 16), ("E", "enum_item", 17, 19)]
    assert kinds("let x = 1\n", "f.js", "javascript")[0][1] == "fallback_chunk"


def test_chunks_are_cut_in_small_parts():
    """A large batch of files comes back in parts: chunks of 2 MB of them are held at a time."""
    n = 300
    body = "def f():\n" + "    x = 1\n" * 5000
    names = ["repository", "file_path", "language", "content"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"a/{i}.py" for i in range(n)]), pa.array(["python"] * n), pa.array([None, *[body] * (n - 2), "y = 1"])], names=names)
    out = list(chunking._cut(iter([batch])))
    assert max(b.nbytes for b in out) < 2 * chunking.HELD < batch.nbytes
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["repository"] for r in rows] == list(range(1, n))
    assert {(r["symbol_name"], r["line_end"], r["chunk_ordinal"]) for r in rows[:-1]} == {("f", 5001, 0)}
    assert (rows[-1]["symbol_type"], rows[-1]["file_path"]) == ("fallback_chunk", f"a/{n - 1}.py")
    assert list(chunking.parts([5, 1, 9, 0, 1], 6)) == [(0, 2), (2, 3), (3, 5)] and list(chunking.parts([], 6)) == []


def test_overlap_slices():
    assert [len(x) for x in overlap_slices("a" * 1100)] == [1100, 50]
    assert [len(x) for x in overlap_slices("a" * 1201)] == [1200, 151]
    assert overlap_slices("a" * 700 + "\n\n" + "b" * 700)[0] == "a" * 700
    assert overlap_slices("") == []
    with pytest.raises(ValueError, match="overlap"):
        overlap_slices("x", 200, 150)


def test_accepted_files(spark):
    cases = {"src/a.py": True, "src/a.PY": True, "node_modules/a.js": False, "package-lock.json": False, ".env.example": True, "x/Dockerfile": True, "a.bin": False, "md": False, "a.md": True}
    rows = spark.createDataFrame([(p, 10) for p in cases] + [("big.py", 250_001), ("edge.py", 250_000)], "p string, n long")
    got = {r["p"]: r["x"] for r in rows.select("p", accepted(F.col("p"), F.col("n")).alias("x")).collect()}
    assert got == cases | {"big.py": False, "edge.py": True}


def test_repo_urls(spark):
    rows = {"https://github.com/o/r.git": ("o", "r", "main"), "https://www.github.com/o/r/tree/dev/x": ("o", "r", "dev"), "https://github.com/o": None, "https://example.com/o/r": None, "nonsense": None}
    df = spark.createDataFrame([(u,) for u in rows], "u string").select("u", parse_repo_url(F.col("u")).alias("p"))
    for r in df.collect():
        want = rows[r["u"]]
        assert (r["p"]["error"] is None) == (want is not None)
        assert want is None or (r["p"]["owner"], r["p"]["repo"], r["p"]["branch"]) == want


def test_cloning(tmp_path):
    target, asked = tmp_path / "t", []

    def run(words):
        asked.append(words[words.index("--branch") + 1] if "--branch" in words else "")
        if asked[-1]:
            raise subprocess.CalledProcessError(128, words, stderr="fatal: Remote branch not found")
        target.mkdir()

    assert clone("https://host/o/r", str(target), "dev", run=run) == ""
    assert asked == ["dev", "main", ""]
    with pytest.raises(ValueError, match="no access"):
        clone("https://host/o/r", str(target), run=lambda w: (_ for _ in ()).throw(subprocess.CalledProcessError(1, w, stderr="no access")))
    assert not target.exists()
    # A real repository on this machine.
    source = tmp_path / "source"
    git = lambda *w: subprocess.run(["git", "-C", str(source), "-c", "user.name=a", "-c", "user.email=a@b", *w], check=True, capture_output=True)
    source.mkdir()
    git("init", "-q", "-b", "trunk")
    (source / "a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    assert clone(f"file://{source}", str(target), "none") == ""
    assert (target / "a.py").exists()


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.bin").write_bytes(b"x")
    r = text_documents(spark, str(tmp_path)).collect()
    assert [(x["content"], x["digest"]) for x in r] == [("one\ntwo", hashlib.md5(b"one\ntwo").hexdigest())]


def test_containing(spark):
    """Also where a passage begins or ends inside a word, spans lines, or is short."""
    docs = spark.createDataFrame([(1, "xone two three four fivey"), (2, "one two  three four five"), (3, "one two\nthree four five"), (4, None), (5, "ab")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "one two three four five"), (2, "one two\nthree four five"), (3, "b"), (4, "two  three four"), (5, None), (6, "absent words of some length here")], "item_id long, passage string")
    got = sorted(map(tuple, containing(docs, passages).collect()))
    assert got == [(1, 1), (2, 4), (3, 2), (5, 3)]


# --- answers -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("said", "want"),
    [("Done.", False), ("", True), ("open (", True), ("a [b", True), ("```x", True), ("this goes to", True), ("one two", False), ("word " * 20, True), ("word " * 20 + "end.", False), ("see [Source 2", True), ("…", True), ("- ", True)],
)
def test_incomplete(spark, said, want):
    assert one(spark, answer.looks_incomplete(F.lit(said))) is want


def test_incomplete_by_reason(spark):
    assert one(spark, answer.looks_incomplete(F.lit("Done."), F.lit("length"))) is True
    assert one(spark, answer.looks_incomplete(F.lit("Done."), F.lit(" STOP "))) is False


def test_finalised(spark):
    f = lambda t: one(spark, answer.finalised(F.lit(t)))
    twelve = "one two three four five six seven eight nine ten eleven twelve."
    assert f(twelve + " and then the") == twelve
    # Too little of it is whole sentences: whole lines are kept.
    assert f("Good line\nbad line with the") == "Good line"
    assert f("First.\n\nSecond line\n\n- ") == "First.\n\nSecond line"
    assert f("nothing whole (") == "nothing whole ("
    assert f("") == answer.EMPTY
    assert f(None) == answer.EMPTY
    assert f(" whole. ") == "whole."
    assert f('He said "yes." ' + twelve + '") and the') == 'He said "yes." ' + twelve + '")'


class Scripted:
    """Answers from a list, and the prompts that it was asked."""

    def __init__(self, *said):
        self.said, self.asked = list(said), []

    def ask(self, prompt, context):
        self.asked.append(prompt)
        return self.said.pop(0)


def test_asking_until_complete(spark):
    good = Scripted(("It ends here.", "stop"))
    assert answer.ask_until_complete(spark, good, "p", "c") == "It ends here."
    assert good.asked == ["p"]
    cut = Scripted(("This goes to", "stop"), ("Now whole [Source 1].", "length"), ("Now whole [Source 2].", "STOP"))
    assert answer.ask_until_complete(spark, cut, "p", "c") == "Now whole."
    assert cut.asked == ["p", f"p\n{answer.AGAIN[0]}", f"p\n{answer.AGAIN[1]}"]
    never = Scripted(*[("Good line\nbad line with the", "stop")] * 3)
    assert answer.ask_until_complete(spark, never, "p", "c") == "Good line"


def test_prompts(spark):
    rows = spark.createDataFrame([(1, "o/r", "What does this repo do?", "ctx", None), (2, None, "where is the class", None, "User: hi"), (3, "o/r", "tell me", "", "")], "qid long, repository string, question string, context string, history string")
    got = {r["qid"]: r["prompt"] for r in answer.prompts(rows).collect()}
    assert answer.OVERVIEW_RULE in got[1] and answer.CODE_RULE in got[2] and answer.CODE_RULE not in got[3]
    assert got[1].index("ctx") < got[1].index("Question: ") and "Conversation: None" in got[1] and "Conversation: User: hi" in got[2]


def test_remote_models():
    calls, waits = [], []

    def chat(url, body, headers, timeout):
        calls.append((url, body["model"], headers))
        return {"choices": [{"message": {"content": "Said."}, "finish_reason": "stop"}]}

    assert answer.ChatAnswerer("http://h/chat", "m", "k", post=chat).ask("p", "c") == ("Said.", "stop")
    assert calls == [("http://h/chat", "m", {"Authorization": "Bearer k"})]

    def vectors(url, body, headers, timeout):
        return {"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}][: len(body["input"]) if body["input"][0].startswith("q: ") else 2]}

    e = RemoteEmbedder("http://h/e", "m", 2, query_prefix="q: ", post=vectors)
    assert e.embed(["a", "b"]).tolist() == [[1, 0], [0, 1]]
    assert e.embed([]).shape == (0, 2)
    with pytest.raises(ValueError, match="dimension"):
        e.embed(["a", "b", "c"])
    assert isinstance(embedder_from({}), HashingEmbedder) and embedder_from({"dimension": 8}).dimension == 8
    assert isinstance(embedder_from({"url": "http://h", "model": "m", "dimension": 3}), RemoteEmbedder)
    with pytest.raises(ValueError, match="provider"):
        embedder_from({"provider": "none"})
    # A service that names a wait is waited for as long as that.
    tries = []

    def busy():
        tries.append(1)
        if len(tries) < 2:
            raise answer.Busy("429", 7.0)
        return "ok"

    assert answer.retrying(busy, sleep=waits.append) == "ok" and waits == [7.0]


def test_citations(spark):
    rows = [(1, 1, "a.py", "f", 0.2, None), (1, 2, "b.py", "", 0.9, None), (1, 3, "c.py", "g", 0.0, 4.0), (1, 4, "d.py", None, 0.9, None), (1, 5, "e.py", "h", 1.0, None)]
    df = spark.createDataFrame(rows, "qid long, source_no long, file_path string, symbol_name string, semantic_score double, rerank_score double")
    assert [(r["citation_no"], r["source"], r["reason"], r["percent"]) for r in answer.citations(df).orderBy("citation_no").collect()] == [(1, "b.py", "b.py", 90), (2, "d.py", "d.py", 90), (3, "c.py", "g", 73), (4, "a.py", "f", 20)]


def test_markdown_blocks(spark):
    said = "# Title\nfirst line\nsecond line\n\n- one\n* two\n## Sub\n## Sub\n```py\ndef f():\n\n# no heading\n```\n#### four\n```\nopen\nfence"
    got = answer.markdown_blocks(spark.createDataFrame([(1, said), (2, ""), (3, None)], "id long, text string")).orderBy("id", "block_no").collect()
    assert [(r["id"], r["kind"], r["level"], r["language"], r["body"]) for r in got] == [
        (1, "heading", 1, None, "Title"), (1, "paragraph", None, None, "first line\nsecond line"), (1, "list", None, None, "one\ntwo"), (1, "heading", 2, None, "Sub"), (1, "heading", 2, None, "Sub"),
        (1, "code", None, "py", "def f():\n\n# no heading"), (1, "paragraph", None, None, "#### four"), (1, "code", None, None, "open\nfence"),
    ]


def test_error_statuses():
    assert catalog.status_of(catalog.NotFound("x"))[0] == 404
    assert catalog.status_of(ValueError("x")) == (400, {})
    assert catalog.status_of(answer.Busy("429", 3.0)) == (429, {"Retry-After": "3"})
    assert catalog.status_of(RuntimeError("x"))[0] == 500


def test_clean_markdown(spark):
    c = lambda t: one(spark, answer.clean_markdown(F.lit(t)))
    assert c("```md\nText [Source 1, Source 2] here.\n```") == "Text here."
    assert c("Based on the provided context, it works.") == "it works."
    assert c("a\n\n\n\nb\n- ") == "a\n\nb"
    assert c("") == answer.EMPTY


def test_confidence(spark):
    rows = [(1, i, 0.0, 0.8) for i in (1, 2, 3)] + [(2, 1, 0.1, None), (3, 1, 0.0, 0.1), (3, 2, 0.9, 0.9)]
    got = {r["qid"]: r["confidence"] for r in answer.confidence_label(spark.createDataFrame(rows, "qid long, source_no long, rerank_score double, semantic_score double")).collect()}
    assert got == {1: "high", 2: "medium", 3: "low"}
    assert one(spark, answer.confidence_percent(F.lit(0.005), F.lit(0.0))) == 8
    assert one(spark, answer.confidence_percent(F.lit(0.0), F.lit(0.0))) == 0


def test_retrying():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 too many")
        return "ok"

    assert answer.retrying(flaky, sleep=waits.append) == "ok"
    assert len(waits) == 2
    with pytest.raises(ValueError, match="no"):
        answer.retrying(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)
    assert answer.backoff(0) == 1.5
    assert answer.backoff(9) == 30.0


# --- evaluation ----------------------------------------------------------------------------------------------------


def test_paths(spark):
    match = lambda a, e: one(spark, evaluation.path_matches(text.normal_path(F.lit(a)), text.normal_path(F.lit(e))))
    assert match("./a/b.ts", "a/b.ts")
    assert match("pkg/x/y.py", "pkg/")
    assert not match("pkg2/y.py", "pkg/")
    assert match("Dockerfile/x", "dockerfile")
    assert not match("a.py/x", "a.py")
    assert one(spark, text.normal_path(F.lit(" ./.env.example"))) == "env.example"


def test_retrieval_metrics(spark):
    rows = [(["a.py", "docs/"], ["x.py", "docs/1.md", "docs/1.md"]), ([], ["a"]), (["a.py"], []), (None, None)]
    df = spark.createDataFrame(rows, "want array<string>, got array<string>")
    got = [r.asDict() for r in df.select(*[c.alias(k) for k, c in evaluation.retrieval_metrics(F.col("want"), F.col("got")).items()]).collect()]
    assert got[0] == pytest.approx({"retrieval_hit": 1, "top1_hit": 0, "source_recall": 0.5, "mrr": 0.5, "unique_source_precision": 0.5, "duplicate_source_rate": 1 / 3})
    for r in got[1:]:
        assert not any(r.values())
    for r in got:
        assert r["mrr"] <= r["retrieval_hit"]
        assert r["top1_hit"] <= r["retrieval_hit"]


def test_gates_and_readiness():
    row = {"retrieval_hit_rate": 0.8, "top1_hit_rate": 0.8, "mrr": 0.75, "source_recall": 0.6, "duplicate_source_rate": 0.2, "grounded_answer_rate": None}
    got = evaluation.guidance(row)
    assert got["primary_gate"] == "pass"
    assert len(got["next_focus"]) == 2
    assert evaluation.readiness(row, {"case_count": 5, "categories": 1, "errors": 0})["status"] == "limited"
    assert evaluation.readiness(row | {"mrr": 0.1}, {"case_count": 50, "categories": 9, "errors": 0})["status"] == "not_ready"


def test_audit_headline_and_judge(spark):
    rows = [(f"x-{i}", "c" if i else "d", "q", "g", ["a.py"], None, 1, None) for i in range(5)]
    cases = spark.createDataFrame(rows, evaluation.CASE)
    said = [r["problem"] for r in evaluation.audit_warnings(cases).collect()]
    assert said == ["fewer than 25 cases", "fewer than 4 categories", "fewer than 2 conversations", "categories with fewer than 2 cases", "most ids have one prefix"]
    report = spark.createDataFrame([(0.9, 0.5, 0.8)], "retrieval_hit_rate double, top1_hit_rate double, mrr double")
    got = {r["metric"]: r["status"] for r in evaluation.headline(report).collect()}
    assert (got["Retrieval hit rate"], got["Top-1 hit rate"], got["Faithfulness"]) == ("pass", "needs_work", "absent")

    class Same:
        def judge(self, question, answer, contexts, reference):
            return {"faithfulness": float(answer == reference), "context_precision": len(contexts) / 2}

    df = spark.createDataFrame([("q", "g", ["c"], "g"), ("q", "x", None, "g")], "question string, answer string, contexts array<string>, ground_truth string")
    r = evaluation.judge_summary(evaluation.judged(df, Same())).first()
    assert (r["faithfulness"], r["answer_relevancy"], r["context_precision"], r["judged_cases"]) == (0.5, None, 0.25, 0)
    made = evaluation.run_metadata(spark, embedder=HashingEmbedder(8), answerer=answer.ChatAnswerer("http://h", "m", "secret"), judge=None).first()
    assert made["settings"]["embedder"] == "HashingEmbedder(dimension=8)" and "secret" not in str(made["settings"]) and made["settings"]["judge"] == "None"


def test_eval_files(spark, tmp_path):
    p = tmp_path / "set.json"
    p.write_text('[{"id": "a-1", "question": "q", "ground_truth": "g", "expected_sources": ["x.py"], "turns": [{"role": "user", "content": "c"}]}]')
    cases = eval_set(spark, str(p))
    assert cases.first()["turns"][0]["content"] == "c"
    write_report(cases.select("id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["id"] == "a-1"


# --- catalog, engine and streams -----------------------------------------------------------------------------------


def test_expiry_is_strict(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, now - datetime.timedelta(seconds=1)), (2, now), (3, None)]
    c = spark.createDataFrame(rows, "id long, session_expires_at timestamp_ntz")
    assert [r["id"] for r in catalog.expired(c, F.lit(now)).collect()] == [1]
    assert sorted(r["id"] for r in catalog.alive(c, F.lit(now)).collect()) == [2, 3]


def test_guards():
    for args in ((None, 0), ("queued", 3), ("indexed", 0)):
        with pytest.raises(ValueError, match="repository"):
            catalog.ask_guard(*args)
    catalog.ask_guard("indexed", 1)


def test_embedding_halves_its_batch():
    class Narrow(HashingEmbedder):
        def embed(self, texts, query=False):
            if len(texts) > 2:
                raise MemoryError
            return super().embed(texts, query)

    assert in_batches(Narrow(8), ["a b", "c", "d", "e", "f"], 8).shape == (5, 8)
    assert in_batches(HashingEmbedder(8), [], 8).shape == (0, 8)


def test_engine(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "pkg").mkdir(parents=True)
    (tree / "pkg" / "mail.py").write_text("def send_mail(to):\n    return smtp(to)\n\nclass Box:\n    def m(self):\n        pass\n")
    (tree / "README.md").write_text("# Mail\nThis sends mail.\n")
    (tree / "node_modules").mkdir()
    (tree / "node_modules" / "x.js").write_text("function no() {\n}\n")
    assert sorted(r["file_path"] for r in source_files(spark, str(tree)).collect()) == ["README.md", "pkg/mail.py"]
    e = Engine(spark, str(tmp_path / "store"))
    row = e.index(str(tree), "session-one", "https://github.com/o/mail/tree/dev")
    assert (row["status"], row["file_count"], row["chunk_count"]) == ("indexed", 2, 3)
    assert (row["owner"], row["name"], row["branch"]) == ("o", "mail", "dev")
    said = e.ask(row["id"], "session-one", "where is the send_mail function?", 3)
    assert said["sources"][0]["file_path"] == "pkg/mail.py"
    assert said["confidence"] in ("low", "medium", "high")
    assert len(said["summary"]) <= 160
    assert said["citations"][0].keys() == {"source", "reason", "percent"}
    # The prompt that an answerer gets has the sources, the history and the question.
    e.answerer = Scripted(("It is in a file.", "stop"))
    e.ask(row["id"], "session-one", "where is the send_mail function?", 3, [{"role": "user", "content": "hello there"}])
    assert all(x in e.answerer.asked[0] for x in ("o/mail", "pkg/mail.py", "def send_mail(to):", "User: hello there", "Question: where is"))
    assert [r["github_url"] for r in e.list("session-one")] == ["https://github.com/o/mail"]
    assert e.get(row["id"], "session-two") is None
    # An engine that is made anew over the path goes on; sessions stay apart.
    e = Engine(spark, str(tmp_path / "store"))
    assert e.get(row["id"], "session-one")["status"] == "indexed"
    assert e.health() == {"status": "ok", "repositories": 1, "vectors": 3, "dimension": 64}
    with pytest.raises(catalog.NotFound, match="repository"):
        e.ask(row["id"], "session-two", "where is it?")
    with pytest.raises(ValueError, match="top_k"):
        e.ask(row["id"], "session-one", "where is it?", 99)
    with pytest.raises(ValueError, match="host"):
        e.index(str(tree), "session-one", "https://elsewhere.example/o/r")
    again = e.index(str(tree), "session-one", "https://github.com/o/mail")
    assert again["id"] == row["id"] and again["created_at"] == row["created_at"]
    other = e.index(str(tree), "session-two")
    assert e.end_session("session-one") == 1
    assert e.list("session-one") == []
    assert e.ask(other["id"], "session-two", "where is the send_mail function?", 3)["sources"]
    assert len(e._versions()) <= 2
    assert Engine(spark, str(tmp_path / "store"), fresh=True).health()["repositories"] == 0


def test_indexing_a_url(spark, tmp_path):
    import os

    def run(words):
        os.makedirs(words[-1] + "/.git")
        with open(words[-1] + "/a.py", "w") as f:
            f.write("def f():\n    return 1\n")

    e = Engine(spark, str(tmp_path / "store"))
    row = e.index_url("https://github.com/o/r", "session-one", run=run)
    assert (row["status"], row["name"], row["chunk_count"]) == ("indexed", "r", 1)
    assert not e._exists(row["local_path"])
    with pytest.raises(ValueError, match="host"):
        e.index_url("https://elsewhere.example/o/r", "session-one", run=run)


def test_submitting_and_waiting(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("def f():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "store"))
    e.submit(str(tmp_path / "tree"), "session-one").join()
    row = e.wait(1, "session-one")
    assert row["status"] == "indexed" and e.failed == []
    said = e.progress(1, "session-one")
    assert (said["step"], said["files"]) == ("done", "1") and "started_at" in said
    with pytest.raises(catalog.NotFound):
        e.progress(1, "session-two")
    e.submit(str(tmp_path / "absent"), "session-one").join()
    assert len(e.failed) == 1
    stop, calls = None, []
    e.health = lambda: calls.append(1)
    stop = e.keep_alive(0.0, least=0.05)
    while not calls:
        pass
    stop.set()


def test_approximate_search(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((400, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    exact = [r["id"] for r in vector.vector_topk(v, x[5].tolist(), 10).collect()]
    near = {r["id"]: r["semantic_score"] for r in vector.approximate_topk(v, x[5].tolist(), 10, 1.5, 12).collect()}
    assert near[5] == pytest.approx(1.0, abs=1e-6)
    assert len(set(exact) & set(near)) >= 7


def test_ending_a_session_cancels_its_indexing(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("def f():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "store"))

    check = e._go_on

    def ending(repository, session):
        e.end_session(session)
        check(repository, session)

    e._go_on = ending
    with pytest.raises(catalog.Cancelled):
        e.index(str(tmp_path / "tree"), "session-one")
    assert e.catalog().count() == 0


def test_a_failed_index_says_why(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="."):
        e.index(str(tmp_path / "absent"), "session-one")
    row = e.catalog().first()
    assert row["status"] == "failed" and row["error_message"]


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + datetime.timedelta(minutes=119)), (1, t + datetime.timedelta(minutes=400)), (2, t)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = stream_sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["user_id"], r["started_at"], r["n_events"]) for r in df.collect())
    assert key(spark.table("sessions")) == key(session_windows(events)) == [(1, t, 2), (1, t + datetime.timedelta(minutes=400), 1), (2, t, 1)]


def test_ingest_chunks(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.py", "def f():\n    return 1\n")], "repository long, file_path string, content string")
    files.write.parquet(str(tmp_path / "files"))
    source = spark.readStream.schema(files.schema).parquet(str(tmp_path / "files"))
    ingest_chunks(source, str(tmp_path / "chunks"), str(tmp_path / "check")).awaitTermination()
    assert latest_chunks(spark, str(tmp_path / "chunks")).first()["symbol_name"] == "f"
    # The file comes again, and another one: of the first, only the new chunks are left.
    more = [(1, "a.py", "def g():\n    return 2\n"), (1, "b.py", "def h():\n    return 3\n")]
    spark.createDataFrame(more, files.schema).write.mode("append").parquet(str(tmp_path / "files"))
    ingest_chunks(source, str(tmp_path / "chunks"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["symbol_name"] for r in latest_chunks(spark, str(tmp_path / "chunks")).collect()) == ["g", "h"]
    assert chunk_files(files).first()["searchable_text"].startswith("a.py\nf\n")
