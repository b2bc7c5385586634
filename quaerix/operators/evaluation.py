"""Measuring retrieval and answers: column expressions by case, and grouped reports."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaerix.functions import vocab
from quaerix.functions.text import eval_tokens, normal_path, squash, strip

CASE = "id string, category string, question string, ground_truth string, expected_sources array<string>, must_include_any array<string>, min_keyword_matches int, turns array<struct<role:string,content:string>>"
GATES = {"retrieval_hit_rate": 0.8, "top1_hit_rate": 0.8, "mrr": 0.75}
ADVICE = (
    ("source_recall", "<", 0.7, "More of the expected files should be found for questions across files."),
    ("duplicate_source_rate", ">", 0.15, "Fewer chunks of one file should reach the answer."),
    ("grounded_answer_rate", "<", 0.75, "Answers should cover more of the checklist and reference."),
    ("context_precision", "<", 0.7, "Fewer sources that do not bear on the question should reach the answer."),
)


def path_matches(actual: Column, expected: Column) -> Column:
    """Normalised paths: equal, or *expected* is a directory (a final slash, or no dot in its last part) above *actual*."""
    directory = expected.endswith("/") | ~F.regexp_extract(expected, r"[^/]*$", 0).contains(".")
    return (actual == expected) | (directory & F.startswith(actual, F.concat(F.regexp_replace(expected, "/+$", ""), F.lit("/"))))


def retrieval_metrics(expected: Column, actual: Column) -> dict[str, Column]:
    """Metrics of one case from its expected and retrieved paths, arrays in order."""
    want = F.array_distinct(F.transform(F.coalesce(expected, F.array().cast("array<string>")), normal_path))
    got = F.transform(F.coalesce(actual, F.array().cast("array<string>")), normal_path)
    hit = lambda a: F.exists(want, lambda e: path_matches(a, e))
    flags = F.transform(got, hit)
    unique = F.array_distinct(got)
    found = F.size(F.filter(want, lambda e: F.exists(got, lambda a: path_matches(a, e))))
    first = F.array_position(flags, True)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return {
        "retrieval_hit": (first > 0).cast("int"),
        "top1_hit": F.coalesce(F.get(flags, F.lit(0)), F.lit(False)).cast("int"),
        "source_recall": ratio(found, F.size(want)),
        "mrr": F.when(first > 0, 1.0 / first).otherwise(0.0),
        "unique_source_precision": ratio(F.size(F.filter(unique, hit)), F.size(unique)),
        "duplicate_source_rate": ratio(F.size(got) - F.size(unique), F.size(got)),
    }


def keywords(c: Column) -> Column:
    """Distinct normalised phrases in order."""
    phrases = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda k: F.array_join(eval_tokens(k), " "))
    return F.array_distinct(F.filter(phrases, lambda p: p != ""))


def keyword_metrics(wanted: Column, answer: Column, least: Column) -> dict[str, Column]:
    """Phrases found as consecutive tokens; all null where none is wanted."""
    phrases = keywords(wanted)
    body = F.concat(F.lit(" "), F.array_join(eval_tokens(answer), " "), F.lit(" "))
    inside = lambda p: F.contains(body, F.concat(F.lit(" "), p, F.lit(" ")))
    found = F.array_sort(F.filter(phrases, inside))
    n, some = F.size(found), F.size(phrases) > 0
    return {
        "keyword_coverage": F.when(some, n / F.size(phrases)),
        "keyword_pass": F.when(some, (n >= F.coalesce(least, F.lit(1))).cast("int")),
        "matched_keyword_count": F.when(some, n.cast("long")), "total_keywords": F.when(some, F.size(phrases).cast("long")),
        "matched_keywords": F.when(some, found), "missing_keywords": F.when(some, F.filter(phrases, lambda p: ~inside(p))),
    }


def length_metrics(answer: Column) -> dict[str, Column]:
    n = F.size(eval_tokens(answer))
    return {"answer_word_count": n.cast("long"), "has_substantive_answer": (n >= 40).cast("int")}


def support_metrics(reference: Column, answer: Column, ratio: float = 0.2, least: int = 2) -> dict[str, Column]:
    """The share of the reference's distinct terms that the answer has; null without terms."""
    terms = F.array_distinct(F.filter(eval_tokens(reference), lambda t: (F.length(t) > 2) & ~t.isin(*vocab.EVAL_STOP)))
    found = F.array_sort(F.array_intersect(terms, eval_tokens(answer)))
    some = F.size(terms) > 0
    share = F.size(found) / F.size(terms)
    return {
        "ground_truth_lexical_overlap": F.when(some, share),
        "reference_support_pass": F.when(some, ((share >= ratio) & (F.size(found) >= least)).cast("int")),
        "reference_term_match_count": F.when(some, F.size(found).cast("long")), "reference_term_count": F.when(some, F.size(terms).cast("long")),
        "matched_reference_terms": F.when(some, found),
    }


def details(cases: DataFrame) -> DataFrame:
    """cases: CASE columns, answer and retrieved_sources -> one row of metrics each."""
    out = cases.withColumns(retrieval_metrics(F.col("expected_sources"), F.col("retrieved_sources")))
    out = out.withColumns(keyword_metrics(F.col("must_include_any"), F.col("answer"), F.col("min_keyword_matches")))
    out = out.withColumns(support_metrics(F.col("ground_truth"), F.col("answer"))).withColumns(length_metrics(F.col("answer")))
    return out.withColumn("category", F.coalesce("category", F.lit("general")))


def grounded() -> Column:
    ok = lambda c: F.coalesce(F.col(c) == 1, F.lit(True))
    return ((F.col("retrieval_hit") == 1) & (F.col("has_substantive_answer") == 1) & ok("keyword_pass") & ok("reference_support_pass")).cast("int")


def _rates() -> list[Column]:
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return [
        F.count("*").alias("case_count"), mean("retrieval_hit", "retrieval_hit_rate"), mean("top1_hit", "top1_hit_rate"), mean("source_recall", "source_recall"),
        mean("mrr", "mrr"), mean("unique_source_precision", "unique_source_precision"), mean("duplicate_source_rate", "duplicate_source_rate"),
        mean("keyword_coverage", "keyword_coverage"), mean("keyword_pass", "keyword_pass_rate"), mean("reference_support_pass", "reference_support_rate"),
        mean("ground_truth_lexical_overlap", "ground_truth_lexical_overlap"), mean("has_substantive_answer", "substantive_answer_rate"),
        mean(grounded(), "grounded_answer_rate"), mean((F.col("source_recall") == 1.0).cast("int"), "exact_source_recall_rate"),
    ]


def overall(metrics: DataFrame) -> DataFrame:
    """Means over all cases; gates that are null do not count."""
    return metrics.agg(*_rates())


def by_category(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("category").agg(*_rates()).orderBy("category")


def report(metrics: DataFrame) -> DataFrame:
    """All and each category in one pass: category is null in the row of all."""
    return metrics.rollup("category").agg(*_rates())


def guidance(row: dict) -> dict:
    """The gate and advice for one row of `overall`."""
    ok = all(row[k] is not None and row[k] >= v for k, v in GATES.items())
    say = [text for k, op, v, text in ADVICE if row.get(k) is not None and (row[k] < v if op == "<" else row[k] > v)]
    return {"primary_gate": "pass" if ok else "needs_work", "thresholds": GATES, "next_focus": say}


#: The figures that a report begins with: name in the report, column, and the gate if it has one.
HEADLINES = (
    ("Retrieval hit rate", "retrieval_hit_rate"), ("Top-1 hit rate", "top1_hit_rate"), ("Mean reciprocal rank", "mrr"), ("Source recall", "source_recall"),
    ("Duplicate source rate", "duplicate_source_rate"), ("Grounded answer rate", "grounded_answer_rate"), ("Keyword pass rate", "keyword_pass_rate"),
    ("Reference support rate", "reference_support_rate"), ("Faithfulness", "faithfulness"), ("Answer relevancy", "answer_relevancy"), ("Context precision", "context_precision"),
)


def headline(report: DataFrame) -> DataFrame:
    """(position, metric, value, gate, status): the headline figures of `overall`, one row each; judge metrics where they were measured.

    status: pass or needs_work by the gate, measured without one, absent for a figure that was not measured.
    """
    row = [(i + 1, name, c, GATES.get(c)) for i, (name, c) in enumerate(HEADLINES)]
    have = set(report.columns)
    made = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(name).alias("metric"), (F.col(c).cast("double") if c in have else F.lit(None).cast("double")).alias("value"), F.lit(g).cast("double").alias("gate")) for i, name, c, g in row])
    out = report.select(F.explode(made).alias("r")).select("r.*")
    status = F.when(F.col("value").isNull(), "absent").when(F.col("gate").isNull(), "measured").when(F.col("value") >= F.col("gate"), "pass").otherwise("needs_work")
    return out.withColumn("status", status)


def readiness(row: dict, audit: dict) -> dict:
    """ready, limited (the set is small, narrow, or all of one repository) or not_ready, and what that rests on in prose."""
    advice = guidance(row)
    wide = audit["case_count"] >= LEAST_CASES and audit["categories"] >= LEAST_CATEGORIES
    status = "not_ready" if advice["primary_gate"] != "pass" or audit["errors"] else "ready" if wide else "limited"
    said = [
        f"{audit['case_count']} cases in {audit['categories']} categories: hit rate {row['retrieval_hit_rate']}, top-1 {row['top1_hit_rate']}, reciprocal rank {row['mrr']}.",
        {"ready": "All gates are passed.", "limited": "All gates are passed, but the set is too small or narrow to rely on.", "not_ready": f"Errors in the set: {audit['errors']}." if audit["errors"] else "A gate is missed."}[status],
        *advice["next_focus"],
    ]
    return {"status": status, "summary": " ".join(said)}


class Judge(Protocol):
    """A model that judges answers; each figure is from 0 to 1."""

    def judge(self, question: str, answer: str, contexts: list[str], reference: str) -> dict[str, float]:
        """faithfulness, answer_relevancy and context_precision."""


JUDGED = ("faithfulness", "answer_relevancy", "context_precision")


def judged(cases: DataFrame, judge: Judge) -> DataFrame:
    """Adds JUDGED to cases (question, answer, contexts, ground_truth); null where the judge gave no figure. The judge travels once to each task."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for q, a, c, r in parts:
            out = []
            for one in zip(q.fillna(""), a.fillna(""), c, r.fillna(""), strict=True):
                said = judge.judge(one[0], one[1], list(one[2]) if one[2] is not None else [], one[3])
                out.append([None if said.get(k) is None else float(said[k]) for k in JUDGED])
            yield pd.Series(out, index=q.index, dtype=object)

    rows = cases.withColumn("_j", run("question", "answer", "contexts", "ground_truth"))
    return rows.withColumns({k: F.get("_j", F.lit(i)) for i, k in enumerate(JUDGED)}).drop("_j")


def judge_summary(rows: DataFrame) -> DataFrame:
    """One row: the means of JUDGED over the cases that have them, and how many have all."""
    whole = F.lit(True)
    for k in JUDGED:
        whole = whole & F.col(k).isNotNull()
    return rows.agg(*[F.round(F.avg(k), 4).alias(k) for k in JUDGED], F.count_if(whole).alias("judged_cases"))


def run_metadata(spark, **parts) -> DataFrame:
    """One row (recorded_at, settings): which embedder, reranker, answerer and judge a report was made with; a part is named by its class and its plain attributes, secrets left out."""
    def described(x) -> str:
        if x is None or isinstance(x, (str, int, float, bool)):
            return str(x)
        shown = {k: v for k, v in sorted(vars(x).items()) if isinstance(v, (str, int, float, bool)) and k not in ("key", "token", "password", "secret")}
        return type(x).__name__ + ("(" + ", ".join(f"{k}={v}" for k, v in shown.items()) + ")" if shown else "")

    made = F.create_map(*[F.lit(x) for k, v in sorted(parts.items()) for x in (k, described(v))]) if parts else F.create_map().cast("map<string,string>")
    return spark.range(1).select(F.current_timestamp().alias("recorded_at"), made.alias("settings"))


#: A set below these is too small: fixed values.
LEAST_CASES, LEAST_CATEGORIES, LEAST_CONVERSATIONS, LEAST_OF_CATEGORY, DOMINANT = 25, 4, 2, 2, 0.8


def audit_rows(cases: DataFrame) -> DataFrame:
    """(id, severity, problem) of single cases and of ids that repeat."""
    blank = lambda c: squash(F.col(c)) == ""
    named = cases.withColumn("id", F.coalesce(F.when(F.col("id") != "", F.col("id")), "question", F.lit("?")))
    raw = F.size(F.filter(F.coalesce("must_include_any", F.array().cast("array<string>")), lambda k: strip(k) != ""))
    found = lambda severity, problem: F.struct(F.lit(severity).alias("severity"), F.lit(problem).alias("problem"))
    checks = F.array(
        F.when(blank("question"), found("error", "missing question")),
        F.when(blank("ground_truth"), found("error", "missing ground_truth")),
        F.when(F.size(F.coalesce("expected_sources", F.array().cast("array<string>"))) == 0, found("error", "expected_sources must not be empty")),
        F.when(F.size(keywords(F.col("must_include_any"))) != raw, found("warning", "keywords repeat after normalisation")),
    )
    single = named.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("c")).select("id", "c.severity", "c.problem")
    twice = named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("error").alias("severity"), F.lit("duplicate id").alias("problem"))
    return single.unionByName(twice)


def audit_set(cases: DataFrame) -> DataFrame:
    """One row on the whole set: sizes, breadth, and the largest share of one id prefix."""
    prefix = F.lower(F.regexp_extract("id", r"^[^-]*", 0))
    top = cases.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).filter("p <> ''").agg(F.max_by("p", F.struct("n", "p")).alias("dominant_prefix"), F.max("n").alias("_n"))
    sparse = cases.groupBy(F.coalesce("category", F.lit("general")).alias("c")).agg(F.count("*").alias("n")).agg(F.count("*").alias("categories"), F.count_if(F.col("n") < LEAST_OF_CATEGORY).alias("sparse_categories"))
    whole = cases.agg(
        F.count("*").alias("case_count"), F.count_if(F.size(F.coalesce("turns", F.array().cast("array<struct<role:string,content:string>>"))) > 0).alias("conversations"),
        F.round(F.avg(F.size("expected_sources")), 2).alias("average_expected_sources"), F.round(F.avg(F.size(F.coalesce("must_include_any", F.array().cast("array<string>")))), 2).alias("average_keywords"),
    )
    # Three one-row results.
    out = whole.join(sparse, F.lit(True)).join(top, F.lit(True))
    share = F.round(F.col("_n") / F.col("case_count"), 4)
    return out.withColumn("dominant_prefix_fraction", share).withColumn("scope", F.when(share >= DOMINANT, "single_repository").otherwise("mixed_or_unknown")).drop("_n")


def audit_warnings(cases: DataFrame) -> DataFrame:
    """(severity, problem) of the whole set: too few cases, categories, conversations, or cases of a category; ids mostly of one prefix."""
    one = audit_set(cases)
    found = lambda flag, text: F.when(flag, F.lit(text))
    checks = F.array(
        found(F.col("case_count") < LEAST_CASES, f"fewer than {LEAST_CASES} cases"), found(F.col("categories") < LEAST_CATEGORIES, f"fewer than {LEAST_CATEGORIES} categories"),
        found(F.col("conversations") < LEAST_CONVERSATIONS, f"fewer than {LEAST_CONVERSATIONS} conversations"), found(F.col("sparse_categories") > 0, f"categories with fewer than {LEAST_OF_CATEGORY} cases"),
        found(F.col("dominant_prefix_fraction") >= DOMINANT, "most ids have one prefix"),
    )
    return one.select(F.lit("warning").alias("severity"), F.explode(F.array_compact(checks)).alias("problem"))
