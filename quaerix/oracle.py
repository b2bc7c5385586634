"""DuckDB SQL for the registered queries, written apart from the plans that it checks."""

from __future__ import annotations

from quaerix.functions import vocab

WORDS = "array_to_string(string_split(text, ' ')[1:6], ' ')"
TEMPLATES = (
    "where is the {w} function implemented", "what does this repo do", "how do I install {w}", "which endpoint handles {w}", "show tests for {w}", "why is {w} invalid",
    "explain the flow across {w}", "{w}", "see src/api_7.py and lib/queue for {w}", "documentation of sessionMaker.exec_many in {w}",
    "how is mail sent by the async worker {w}", "import of pkg.core/init-file in {w}",
)
_Q = " ".join(f"WHEN {i} THEN " + " || ".join(f"'{p}'" if p != "{w}" else WORDS for p in _split) for i, _split in enumerate([x for x in t.replace("{w}", "\0{w}\0").split("\0") if x] for t in TEMPLATES))
QUESTIONS = f"q AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS repository, CASE item_id % {len(TEMPLATES)} {_Q} END AS question, item_id FROM benchmark)"
PATH = "CASE doc_id % 5 WHEN 0 THEN source || '/' || lang || '/doc_' || doc_id || '.md' WHEN 1 THEN 'src/api_' || doc_id || '.py' WHEN 2 THEN 'tests/test_' || doc_id || '.py' WHEN 3 THEN 'docs/' || lang || '/doc_' || doc_id || '.md' ELSE 'lib/config_' || doc_id || '.rs' END"
CHUNKS = f"""c AS (SELECT source AS repository, doc_id AS id, {PATH} AS file_path, CASE doc_id % 5 WHEN 1 THEN 'python' WHEN 2 THEN 'python' WHEN 4 THEN 'rust' ELSE 'text' END AS language,
  'doc_' || doc_id AS symbol_name, CASE WHEN doc_id % 5 IN (1, 2, 4) THEN 'function_definition' ELSE 'fallback_chunk' END AS symbol_type, 1 AS line_start,
  len(string_split(text, chr(10))) AS line_end, string_split(text, chr(10))[1] AS signature, text AS content, text AS searchable_text FROM documents)"""


def _lit(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sq(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def has_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")" if parts else "false"


def has_term(x: str, terms) -> str:
    esc = "|".join(t.replace(".", r"\.").replace("-", r"\-") for t in terms)
    return f"regexp_matches({x}, '(^|[^a-z0-9])(?:{esc})([^a-z0-9]|$)')" if terms else "false"


def low(x: str) -> str:
    return f"lower({sq(x)})"


def overview(x: str) -> str:
    return has_any(low(x), vocab.OVERVIEW)


def intent(x: str) -> str:
    n = low(x)
    whens = " ".join(f"WHEN {has_term(n, t)} THEN '{name}'" for name, t in vocab.INTENTS)
    return f"CASE WHEN {n} = '' THEN 'general' WHEN {overview(x)} THEN 'overview' {whens} WHEN {has_any(n, vocab.DOCS)} THEN 'docs' ELSE 'general' END"


_CAMEL = r"string_split(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ')"


def code_terms(x: str) -> str:
    raw = f"regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*(?:[./-][A-Za-z_][A-Za-z0-9_]*)*')"
    parts = f"flatten(list_transform({raw}, lambda t: list_concat([t], regexp_split_to_array(t, '[._/-]+'), {_CAMEL})))"
    clean = f"list_transform({parts}, lambda p: lower(regexp_replace(p, '^[_./-]+|[_./-]+$', '', 'g')))"
    return f"list_sort(list_distinct(list_filter({clean}, lambda p: length(p) >= 3 AND p NOT IN ({_lit(vocab.CODE_STOP)}))))"


def fragments(x: str) -> str:
    raw = rf"regexp_extract_all({x}, '[A-Za-z0-9_./-]+(?:\.[A-Za-z0-9_./-]+|/[A-Za-z0-9_./-]+)')"
    return f"list_sort(list_distinct(list_filter(list_transform({raw}, lambda p: lower(regexp_replace(p, '^[./]+|[./]+$', '', 'g'))), lambda p: contains(p, '/') OR contains(p, '.'))))"


def hints(x: str, rules=vocab.EXAMPLE_RULES) -> str:
    out = []
    for terms, paths in rules:
        hit = f"{has_term(low(x), [t for t in terms if t[0] != '/'])} OR {has_any(low(x), [t for t in terms if t[0] == '/'])}"
        out.append(f"CASE WHEN {hit} THEN [{_lit(paths)}] ELSE []::VARCHAR[] END")
    every = f"list_concat({', '.join(out)})"
    return f"list_filter({every}, lambda h, i: list_position({every}, h) = i)"


def expand(x: str) -> str:
    n, parts = low(x), []
    for triggers, every, adds in vocab.EXPANSIONS:
        hit = " AND ".join(f"contains({n}, '{t}')" for t in triggers) if every else has_any(n, triggers)
        parts.append(f"CASE WHEN {hit} THEN [{_lit(adds)}] ELSE []::VARCHAR[] END")
    compound = f"list_transform(list_filter(list_transform({code_terms(sq(x))}, lambda t: list_filter(regexp_split_to_array(t, '[._/-]+'), lambda p: length(p) > 2)), lambda p: len(p) > 1), lambda p: array_to_string(p, ' '))"
    every = f"list_concat({', '.join(parts)}, {hints(x)}, {compound})"
    return f"{sq(x)} || CASE WHEN len({every}) > 0 THEN chr(10) || array_to_string({every}, ' ') ELSE '' END"


def depth(x: str, k: int) -> str:
    return f"greatest({k}, least(CASE WHEN {intent(x)} IN ({_lit(vocab.DEEP)}) THEN {k * 8} ELSE {k * 4} END, 120))"


TOKENS = "list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_./:-]*'), lambda t: lower(t))"


def tokens(x: str) -> str:
    return TOKENS.replace("{x}", x)


BM25_BASE = f"""
tk AS (SELECT source AS repository, doc_id AS id, {tokens("text")} AS t FROM documents),
dl AS (SELECT repository, id, len(t) AS dl FROM tk),
po AS (SELECT repository, id, term, count(*) AS tf FROM (SELECT repository, id, unnest(t) AS term FROM tk) GROUP BY ALL),
co AS (SELECT repository, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY ALL),
df AS (SELECT repository, term, count(*) AS df FROM po GROUP BY ALL),
ri AS (SELECT repository, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN co USING (repository)),
me AS (SELECT repository, avg(raw) AS mean FROM ri GROUP BY ALL),
idf AS (SELECT repository, term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM ri JOIN me USING (repository))"""


def bm25(k: int, query: str = "question", source: str = "q", prefix: str = "") -> str:
    return f"""
qt AS (SELECT qid, repository, term, count(*) AS times FROM (SELECT qid, repository, unnest({tokens(query)}) AS term FROM {source}) GROUP BY ALL),
sc AS (SELECT qid, repository, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s
  FROM qt JOIN idf USING (repository, term) JOIN po USING (repository, term) JOIN dl USING (repository, id) JOIN co USING (repository) GROUP BY ALL),
al AS (SELECT x.qid, x.repository, dl.id, coalesce(sc.s, 0) AS bm25_score FROM (SELECT DISTINCT qid, repository FROM qt) x JOIN dl USING (repository) LEFT JOIN sc ON sc.qid = x.qid AND sc.id = dl.id),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, id) AS bm25_rank FROM al) WHERE bm25_rank <= {k})"""


COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def cos(a: str, b: str) -> str:
    return COS.replace("{a}", a).replace("{b}", b)


def semantic(k: int, where: str = "true", who: str = "SELECT item_id AS qid, e.embedding AS qv, e.label AS ql FROM benchmark JOIN embeddings e ON e.vec_id = item_id") -> str:
    return f"""
qv AS ({who}),
sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY semantic_score DESC, id) AS semantic_rank FROM (
  SELECT qid, vec_id AS id, round({cos("embedding", "qv")}, 6) AS semantic_score FROM qv, embeddings WHERE {where})) WHERE semantic_rank <= {k})"""


def rrf(k: int) -> str:
    return f"""
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, bm25_rank NULLS LAST, semantic_rank NULLS LAST, id) AS candidate_rank FROM (
  SELECT qid, id, bm25_score, bm25_rank, semantic_score, semantic_rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0), 9) AS rrf_score
  FROM lx FULL JOIN sm USING (qid, id))) WHERE candidate_rank <= {k})"""


def _points(items: str, var: str, expr: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda {var}: {expr})), 0)"


DOC = "(language = 'text' OR ends_with(lower(file_path), '.md') OR contains(lower(file_path), '/readme'))"
DOCPRI = "CASE WHEN lower(file_path) IN ('readme.md', 'readme') THEN 3 WHEN starts_with(lower(file_path), 'docs/') OR contains(lower(file_path), '/docs/') THEN 2 WHEN ends_with(lower(file_path), '.md') THEN 1 ELSE 0 END"


def _hint_points(whole: int, part: int) -> str:
    n = "lower(regexp_replace(h, '/+$', ''))"
    return _points("hints", "h", f"CASE WHEN lower(file_path) = {n} OR starts_with(lower(file_path), {n} || '/') THEN {whole} WHEN contains(lower(file_path), {n}) THEN {part} ELSE 0 END")


def priority() -> str:
    p, s, g = "lower(file_path)", "lower(symbol_name)", "lower(signature)"
    src = f"({p} || ' ' || {s} || ' ' || {g})"
    base = f"regexp_extract({p}, '[^/]*$')"
    stem = f"regexp_replace({base}, '\\.[^.]*$', '')"
    term = f"CASE WHEN t = {base} OR t = {stem} THEN 4 WHEN contains({base}, t) THEN 3 ELSE 0 END + CASE WHEN contains({s}, t) THEN 3 ELSE 0 END + CASE WHEN contains({p}, t) THEN 2 ELSE 0 END + CASE WHEN contains({g}, t) THEN 1 ELSE 0 END"
    b = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    parts = [
        _points("frags", "f", f"CASE WHEN contains({p}, f) THEN 8 ELSE 0 END"), _hint_points(8, 4),
        f"least(len(list_filter(terms, lambda t: contains({src}, t))), 6)", _points("terms", "t", term),
        b(f"about = 'api' AND ({base} = '__init__.py' OR {stem} IN ({_lit(vocab.API_STEMS)}))", 4), b(f"about = 'api' AND {has_any(p, vocab.API_PATHS)}", 2),
        b(f"about IN ('implementation', 'cross_file') AND NOT {DOC}", 2), b("about IN ('implementation', 'cross_file') AND symbol_type <> 'fallback_chunk'", 1),
        b(f"about = 'tests' AND (starts_with({p}, 'tests/') OR contains({p}, '/tests/') OR starts_with({base}, 'test_') OR regexp_matches({base}, '(_test\\.py|\\.(test|spec)\\.(js|ts))$'))", 5),
        b(f"about = 'error_handling' AND {has_any(src, vocab.ERROR_WORDS)}", 3), b(f"about = 'error_handling' AND contains({p}, 'test')", 1),
        b(f"about = 'setup' AND ({base} IN ({_lit(vocab.SETUP_FILES)}) OR {has_any(p, vocab.SETUP_PATHS)})", 3),
        b(f"about = 'setup' AND {has_any(src, vocab.SETUP_WORDS)}", 1),
        f"CASE WHEN about IN ('docs', 'overview') AND {DOC} THEN {DOCPRI} + 1 ELSE 0 END", b(f"{DOC} AND about IN ({_lit(vocab.DOC_PENALTY)})", -3),
        b(f"starts_with({p}, '.agents/') OR starts_with({p}, '.opencode/')", -8),
    ]
    return "(" + " + ".join(f"({x})" for x in parts) + ")"


def with_features(x: str) -> str:
    return f"{intent(x)} AS about, {code_terms(x)} AS terms, {fragments(x)} AS frags, {hints(x)} AS hints"


def path_search(k: int, combined: str = "(question || chr(10) || query)", source: str = "qq") -> str:
    text = "lower(file_path) || ' ' || lower(symbol_name) || ' ' || lower(signature) || ' ' || lower(substring(content, 1, 500))"
    raw = f"{_points('frags', 'f', 'CASE WHEN contains(lower(file_path), f) THEN 12 ELSE 0 END')} + {_hint_points(10, 6)} + least(len(list_filter(terms, lambda t: contains({text}, t))), 8)"
    return f"""
pf AS (SELECT qid, repository, {with_features(combined)} FROM {source}),
pr AS (SELECT qid, id, raw + greatest(pri, 0) AS path_score FROM (SELECT qid, id, ({raw})::DOUBLE AS raw, {priority()} AS pri FROM pf JOIN c USING (repository) WHERE len(hints) > 0 OR len(terms) > 0) WHERE raw > 0),
pa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY path_score DESC, id) AS path_rank FROM pr) WHERE path_rank <= {k})"""


def merged(k: int) -> str:
    return f"""
mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, coalesce(path_score, 0) DESC, coalesce(semantic_score, 0) DESC, candidate_rank NULLS LAST, path_rank NULLS LAST) AS merged_rank FROM (
  SELECT qid, id, bm25_score, bm25_rank, semantic_score, semantic_rank, candidate_rank, path_score, path_rank, round(coalesce(rrf_score, 0) + coalesce(1.0::DOUBLE / (20 + path_rank), 0), 9) AS rrf_score FROM fu FULL JOIN pa USING (qid, id))) WHERE merged_rank <= {k})"""


def ranked(k: int) -> str:
    """From rw: mg joined with chunks, question, query, features of both in lower case, rerank_score."""
    both = "lower(question || ' ' || query)"
    docs = f"({has_any(both, vocab.DOCS)} AND qi IN ('docs', 'overview'))"
    over = f"({overview('question')} OR {overview('query')})"
    b = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END DESC"
    keys = [
        b(f"NOT (NOT ({docs} OR {over}) AND {DOC})"), f"{priority()} DESC", "coalesce(path_score, 0) DESC", f"{DOCPRI} DESC", b(f"{over} AND {DOC}"), b(f"{docs} = {DOC}"),
        b(f"{has_any(both, vocab.WANTS_CODE)} AND NOT {DOC}"), b(f"qi IN ({_lit(vocab.CODE_FIRST)}) AND NOT {DOC}"), "coalesce(rerank_score, 0) DESC", "coalesce(semantic_score, 0) DESC", "coalesce(bm25_score, 0) DESC", "merged_rank",
    ]
    return f"""
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {", ".join(keys)}) AS position FROM rw) WHERE position <= {k})"""


def capped(k: int) -> str:
    return f"""
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position) AS source_no FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY position) AS each_no FROM rk) WHERE each_no <= CASE WHEN qi IN ('overview', 'docs') THEN 2 ELSE 1 END) WHERE source_no <= {k})"""


def rerank(query: str, body: str) -> str:
    t = code_terms(query)
    return f"CASE WHEN len({t}) = 0 THEN 0 ELSE round(len(list_filter({t}, lambda x: contains(lower({body}), x)))::DOUBLE / len({t}), 6) END"


def eval_tokens(x: str) -> str:
    raw = f"regexp_extract_all({x}, '[A-Za-z0-9_./+-]+')"
    parts = f"list_transform(list_concat({_CAMEL}, regexp_split_to_array(t, '[._/+-]+')), lambda p: lower(p))"
    return f"flatten(list_transform({raw}, lambda t: list_concat([lower(t)], list_filter({parts}, lambda p: p <> '' AND p <> lower(t)))))"


def norm_path(x: str) -> str:
    return rf"lower(regexp_replace(trim({x}), '^[./]+', ''))"


def path_match(a: str, e: str) -> str:
    return f"({a} = {e} OR ((ends_with({e}, '/') OR NOT contains(regexp_extract({e}, '[^/]*$'), '.')) AND starts_with({a}, regexp_replace({e}, '/+$', '') || '/')))"


CASES = """
cs AS (SELECT b.item_id, 'case-' || b.item_id AS id, 'c' || (b.item_id % 4) AS category, b.text AS question, b.text AS ground_truth,
  ['src/d' || (b.item_id % 7) || '/f' || (b.item_id % 3) || '.py', CASE WHEN b.item_id % 2 = 0 THEN './Docs/' ELSE 'Dockerfile' END] AS expected_sources,
  ['src/d' || (b.item_id % 5) || '/f' || (b.item_id % 2) || '.py', 'docs/a' || (b.item_id % 3) || '.md', 'docs/a' || (b.item_id % 2) || '.md', 'dockerfile'][1 + b.item_id % 2:4] AS retrieved_sources,
  array_to_string(string_split(b.text, ' ')[1:10 + b.item_id % 50], ' ') || ' sessionMaker in lib/config.py ' || coalesce(n.text, '') AS answer,
  [array_to_string(string_split(b.text, ' ')[2:3], ' '), 'sessionMaker', 'SESSIONMAKER', 'lib/config.py', 'absent-word', ''] AS must_include_any, (b.item_id % 5) AS min_keyword_matches
  FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1)"""


def eval_details() -> str:
    want, got = f"list_transform(expected_sources, lambda e: {norm_path('e')})", f"list_transform(retrieved_sources, lambda a: {norm_path('a')})"
    stop = _lit(vocab.EVAL_STOP)
    return f"""{CASES},
e0 AS (SELECT *, {want} AS want, {got} AS got, {eval_tokens("answer")} AS said, {eval_tokens("ground_truth")} AS gt,
  list_filter(list_transform(must_include_any, lambda k: array_to_string({eval_tokens("k")}, ' ')), lambda p: p <> '') AS kw0 FROM cs),
e1 AS (SELECT *, list_transform(got, lambda a: len(list_filter(want, lambda e: {path_match("a", "e")})) > 0) AS flags, list_distinct(got) AS uq,
  list_filter(kw0, lambda k, i: list_position(kw0, k) = i) AS kw, list_distinct(list_filter(gt, lambda t: length(t) > 2 AND t NOT IN ({stop}))) AS rt FROM e0),
e2 AS (SELECT *, coalesce(list_position(flags, true), 0) AS first, list_sort(list_filter(kw, lambda k: contains(' ' || array_to_string(said, ' ') || ' ', ' ' || k || ' '))) AS mk,
  list_sort(list_filter(rt, lambda t: list_contains(said, t))) AS mt FROM e1),
d AS (SELECT id, category, (first > 0)::INT AS retrieval_hit, coalesce(flags[1], false)::INT AS top1_hit,
  len(list_filter(list_distinct(want), lambda e: len(list_filter(got, lambda a: {path_match("a", "e")})) > 0))::DOUBLE / len(list_distinct(want)) AS source_recall,
  CASE WHEN first > 0 THEN 1.0::DOUBLE / first ELSE 0 END AS mrr, len(list_filter(uq, lambda a: len(list_filter(want, lambda e: {path_match("a", "e")})) > 0))::DOUBLE / len(uq) AS unique_source_precision,
  (len(got) - len(uq))::DOUBLE / len(got) AS duplicate_source_rate, CASE WHEN len(kw) > 0 THEN len(mk)::DOUBLE / len(kw) END AS keyword_coverage,
  CASE WHEN len(kw) > 0 THEN (len(mk) >= min_keyword_matches)::INT END AS keyword_pass, len(mk) AS matched_keyword_count, len(kw) AS total_keywords, array_to_string(mk, '|') AS matched_keywords,
  array_to_string(list_filter(kw, lambda k: NOT list_contains(mk, k)), '|') AS missing_keywords, CASE WHEN len(rt) > 0 THEN len(mt)::DOUBLE / len(rt) END AS ground_truth_lexical_overlap,
  CASE WHEN len(rt) > 0 THEN (len(mt)::DOUBLE / len(rt) >= 0.2 AND len(mt) >= 2)::INT END AS reference_support_pass, len(mt) AS reference_term_match_count, len(rt) AS reference_term_count,
  array_to_string(mt, '|') AS matched_reference_terms, len(said) AS answer_word_count, (len(said) >= 40)::INT AS has_substantive_answer FROM e2)"""


RATES = """count(*) AS case_count, round(avg(retrieval_hit), 4) AS retrieval_hit_rate, round(avg(top1_hit), 4) AS top1_hit_rate, round(avg(source_recall), 4) AS source_recall, round(avg(mrr), 4) AS mrr,
round(avg(unique_source_precision), 4) AS unique_source_precision, round(avg(duplicate_source_rate), 4) AS duplicate_source_rate, round(avg(keyword_coverage), 4) AS keyword_coverage, round(avg(keyword_pass), 4) AS keyword_pass_rate,
round(avg(reference_support_pass), 4) AS reference_support_rate, round(avg(ground_truth_lexical_overlap), 4) AS ground_truth_lexical_overlap, round(avg(has_substantive_answer), 4) AS substantive_answer_rate,
round(avg((retrieval_hit = 1 AND has_substantive_answer = 1 AND coalesce(keyword_pass, 1) = 1 AND coalesce(reference_support_pass, 1) = 1)::INT), 4) AS grounded_answer_rate, round(avg((source_recall = 1)::INT), 4) AS exact_source_recall_rate"""


def swap(sql: str, *pairs: tuple[str, str]) -> str:
    """*sql* with parts replaced; a part that does not occur is an error."""
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"not in the SQL: {old}")
        sql = sql.replace(old, new)
    return sql


def incomplete(t: str) -> str:
    """Whether a stripped text breaks off."""
    words = rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}\p{{M}}_''-]*[\p{{L}}\p{{N}}_])?')"
    return rf"""(len({words}) = 0 OR regexp_matches({t}, '[#*:(\[/`-]$') OR regexp_matches(lower({t}), '\[source( [1-4])?$') OR len(string_split({t}, '```')) % 2 = 0 OR len(string_split({t}, '(')) > len(string_split({t}, ')'))
OR len(string_split({t}, '[')) > len(string_split({t}, ']')) OR coalesce({words}[-1] IN ({_lit(vocab.TAIL_WORDS)}), false) OR (len({words}) >= 20 AND NOT regexp_matches({t}, '[.!?"''`]$')))"""


#: Blocks of text and code without symbols: a recursion over each file's lines.
FALLBACK = r"""WITH RECURSIVE l AS (SELECT doc_id, i, CASE WHEN i % 12 = 0 THEN (CASE WHEN doc_id % 2 = 0 THEN '# ' ELSE 'export ' END) || x ELSE x END AS x, i % 12 = 0 AS marked, n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents) WHERE NOT (i = n AND x = '' AND i % 12 <> 0)),
f AS (SELECT doc_id, i, 1 AS held, false AS cut, 0 AS b FROM l WHERE i = 1
  UNION ALL SELECT doc_id, i, held, held >= (CASE WHEN doc_id % 2 = 0 THEN 60 ELSE 80 END) OR (marked AND held > 8), b FROM (
    SELECT l.doc_id, l.i, CASE WHEN f.cut THEN 1 ELSE f.held + 1 END AS held, f.b + f.cut::INT AS b, l.marked FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)),
g AS (SELECT f.doc_id, b, min(f.i) AS line_start, max(f.i) AS line_end, string_agg(x, chr(10) ORDER BY f.i) AS t, arg_min(x, f.i) AS first FROM f JOIN l USING (doc_id, i) GROUP BY ALL),
c AS (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS content, 'doc_' || doc_id || (CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.rs' END) AS file_path FROM g)
SELECT file_path, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS chunk_ordinal, file_path || ':' || line_start AS symbol_name, 'fallback_chunk' AS symbol_type, line_start, line_end, regexp_replace(first, '^\s+|\s+$', '', 'g') AS signature, md5(content) AS digest FROM c WHERE content <> ''"""

#: Slices of 1200 characters with an overlap of 150: a recursion over each text's cuts.
OVERLAP = r"""WITH RECURSIVE s AS (SELECT doc_id, text, 0 AS start, substring(text, 1, 1200) AS part FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, next, substring(text, next + 1, 1200) FROM (SELECT doc_id, text, start + step - 150 AS next FROM (SELECT *, CASE WHEN start + 1200 >= length(text) THEN 1200
      WHEN p > 480 THEN p + 1 WHEN d > 600 THEN d + 1 WHEN n > 480 THEN n + 1 ELSE 1200 END AS step FROM (SELECT *,
        CASE WHEN contains(part, chr(10) || chr(10)) THEN length(part) - strpos(reverse(part), chr(10) || chr(10)) - 1 ELSE -1 END AS p, CASE WHEN contains(part, '.') THEN length(part) - strpos(reverse(part), '.') ELSE -1 END AS d,
        CASE WHEN contains(part, chr(10)) THEN length(part) - strpos(reverse(part), chr(10)) ELSE -1 END AS n FROM s))) WHERE next < length(text)),
c AS (SELECT doc_id, start, regexp_replace(substring(part, 1, CASE WHEN start + 1200 >= length(text) THEN 1200 WHEN p > 480 THEN p + 1 WHEN d > 600 THEN d + 1 WHEN n > 480 THEN n + 1 ELSE 1200 END), '^\s+|\s+$', '', 'g') AS content FROM (SELECT *,
        CASE WHEN contains(part, chr(10) || chr(10)) THEN length(part) - strpos(reverse(part), chr(10) || chr(10)) - 1 ELSE -1 END AS p, CASE WHEN contains(part, '.') THEN length(part) - strpos(reverse(part), '.') ELSE -1 END AS d,
        CASE WHEN contains(part, chr(10)) THEN length(part) - strpos(reverse(part), chr(10)) ELSE -1 END AS n FROM s))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_no, content FROM c WHERE content <> ''"""

#: Blocks of Markdown texts made of the documents' lines.
BLOCKS = r"""WITH l AS (SELECT doc_id, i, CASE (i - 1) % 9 WHEN 0 THEN '## ' || x WHEN 2 THEN '- ' || x WHEN 3 THEN '* ' || x WHEN 5 THEN '```py' WHEN 7 THEN '```' WHEN 8 THEN '' ELSE x END AS x
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT *, starts_with(x, '```') AS fence, sum(starts_with(x, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l),
k AS (SELECT *, CASE WHEN fence THEN (CASE WHEN n % 2 = 1 THEN 'open' ELSE 'close' END) WHEN n % 2 = 1 THEN 'code' WHEN trim(x) = '' THEN 'blank' WHEN regexp_matches(x, '^#{1,3}\s+\S') THEN 'heading' WHEN regexp_matches(x, '^\s*[-*]\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM f),
b AS (SELECT *, sum(CASE WHEN kind = 'heading' OR before IS NULL OR before <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)),
g AS (SELECT doc_id, b, kind, string_agg(CASE kind WHEN 'heading' THEN regexp_replace(x, '^#{1,3}\s+', '') WHEN 'list' THEN regexp_replace(x, '^\s*[-*]\s+', '') ELSE x END, chr(10) ORDER BY i) AS body, max(length(regexp_extract(x, '^(#{1,3})\s', 1))) AS level FROM b WHERE kind IN ('code', 'heading', 'list', 'paragraph') GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block_no, kind, CASE WHEN kind = 'heading' THEN level END AS level, CASE WHEN kind = 'code' THEN 'py' END AS language, md5(body) AS digest FROM g"""
