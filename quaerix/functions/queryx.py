"""Understanding questions: intents, expansions, hints and follow-ups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaerix.functions import vocab
from quaerix.functions.text import code_terms, has_any, has_term, path_fragments, squash, strip


def is_overview(c: Column) -> Column:
    return has_any(F.lower(squash(c)), vocab.OVERVIEW)


def is_documentation(c: Column) -> Column:
    """Of text that is lower-case already, as callers of the substring test are."""
    return has_any(c, vocab.DOCS)


def intent(c: Column) -> Column:
    """The first intent whose terms occur; overview first, documentation last, else general."""
    low = F.lower(squash(c))
    out = F.when(low == "", "general").when(is_overview(c), "overview")
    for name, terms in vocab.INTENTS:
        out = out.when(has_term(low, terms), name)
    return out.when(is_documentation(low), "docs").otherwise("general")


def domain_hints(c: Column, rules=()) -> Column:
    """Paths of the rules whose terms occur, in order and distinct; a term with a leading slash may stand anywhere."""
    low = F.lower(squash(c))
    empty = F.array().cast("array<string>")
    parts = [empty]
    for terms, paths in rules:
        whole, part = [t for t in terms if t[0] != "/"], [t for t in terms if t[0] == "/"]
        hit = (has_term(low, whole) if whole else F.lit(False)) | has_any(low, part)
        parts.append(F.when(hit, F.array(*[F.lit(p) for p in paths])).otherwise(empty))
    return F.array_distinct(F.concat(*parts))


def expand(c: Column, rules=()) -> Column:
    """The question and, on a second line, the hints of its triggers, path rules and compound terms."""
    text = squash(c)
    low = F.lower(text)
    empty = F.array().cast("array<string>")
    groups = []
    for triggers, every, hints in vocab.EXPANSIONS:
        hit = has_any(low, triggers)
        if every:
            hit = F.lit(True)
            for t in triggers:
                hit = hit & low.contains(t)
        groups.append(F.when(hit, F.array(*[F.lit(h) for h in hints])).otherwise(empty))
    compound = F.transform(code_terms(text), lambda t: F.filter(F.split(t, r"[._/-]+"), lambda p: F.length(p) > 2))
    joined = F.transform(F.filter(compound, lambda p: F.size(p) > 1), lambda p: F.array_join(p, " "))
    hints = F.concat(*groups, domain_hints(text, rules), joined)
    return F.when(F.size(hints) == 0, text).otherwise(F.concat_ws("\n", text, F.array_join(hints, " ")))


def is_substantive(c: Column) -> Column:
    low = F.lower(squash(c))
    return (F.length(low) >= 24) & ~low.isin(*vocab.GREETINGS)


def is_follow_up(c: Column) -> Column:
    text = squash(c)
    low = F.lower(text)
    few = F.size(F.filter(F.split(text, " "), lambda w: w != "")) <= 6
    return few | low.rlike(rf"^(?:{'|'.join(vocab.FOLLOW_UP_STARTS)})(?: .+)?$") | has_any(low, vocab.FOLLOW_UP_WORDS)


def retrieval_query(question: Column, last_user: Column, last_assistant: Column, rules=()) -> Column:
    """What is searched: the expanded question, and for a follow-up the latest turns. Null turns are absent ones."""
    text = squash(question)
    expanded = expand(text, rules)
    followed = F.concat_ws("\n", expanded, F.concat(F.lit("Follow-up to: "), strip(last_user)), F.concat(F.lit("Previous answer: "), F.substring(strip(last_assistant), 1, 300)))
    return (
        F.when(is_overview(text), F.concat_ws("\n", text, F.lit(vocab.OVERVIEW_SUFFIX)))
        .when(last_user.isNotNull() & is_follow_up(text), followed).otherwise(expanded)
    )


def latest_turns(history: DataFrame, key: str = "qid") -> DataFrame:
    """(key, last_user, last_assistant) of turns (key, turn, role, text); blank turns and greetings do not count."""
    full = F.col("role").isNotNull() & (strip(F.coalesce("text", F.lit(""))) != "")
    user = full & (F.col("role") == "user")
    said = full & (F.col("role") == "assistant") & is_substantive(F.col("text"))
    return history.groupBy(key).agg(
        F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("last_user"),
        F.max_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))).alias("last_assistant"),
    )


def format_history(history: DataFrame, key: str = "qid", last: int = 4, width: int = 400) -> DataFrame:
    """(key, history): the last turns as ``Role: text`` lines."""
    kept = history.filter((F.coalesce("role", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    order = Window.partitionBy(key).orderBy(F.col("turn").desc())
    tail = kept.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= last)
    name = F.concat(F.upper(F.substring("role", 1, 1)), F.lower(F.expr("substring(role, 2)")))
    line = F.when(squash(F.col("text")) != "", F.concat(name, F.lit(": "), F.substring(squash(F.col("text")), 1, width)))
    got = tail.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    text = F.concat_ws("\n", F.transform("l", lambda s: s["line"]))
    return got.select(key, F.when(text == "", "None").otherwise(text).alias("history"))


def history_window(history: DataFrame, key: str = "qid", last: int = 6, answered: str | None = None) -> DataFrame:
    """The last turns by user or assistant that are not blank; of the assistant's only those that the boolean column *answered* marks, if there is one."""
    kept = history.filter(F.col("role").isin("user", "assistant") & (strip(F.coalesce("text", F.lit(""))) != ""))
    if answered is not None:
        kept = kept.filter((F.col("role") == "user") | F.coalesce(F.col(answered), F.lit(False)))
    order = Window.partitionBy(key).orderBy(F.col("turn").desc())
    return kept.withColumn("back", F.row_number().over(order).cast("long")).filter(F.col("back") <= last)


def search_depth(question: Column, top_k: Column, deep: int = 8, shallow: int = 4, most: int = 120) -> Column:
    wide = F.when(intent(question).isin(*vocab.DEEP), top_k * deep).otherwise(top_k * shallow)
    return F.greatest(top_k, F.least(wide, F.lit(most)))


def features(questions: DataFrame, question: str = "question", rules=(), lower: bool = False) -> DataFrame:
    """Adds f: one struct of what ranking needs to know of a question, computed once for each."""
    c = F.lower(F.col(question)) if lower else F.col(question)
    f = F.struct(intent(c).alias("intent"), code_terms(c).alias("terms"), path_fragments(c).alias("fragments"), domain_hints(c, rules).alias("hints"))
    return questions.withColumn("f", f)
