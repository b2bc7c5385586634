"""Token and string functions, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaerix.functions import vocab

# Patterns on which tokens, terms and fragments depend.
TOKEN = r"[A-Za-z_][A-Za-z0-9_./:-]*"
CODE_TERM = r"[A-Za-z_][A-Za-z0-9_]*(?:[./-][A-Za-z_][A-Za-z0-9_]*)*"
FRAGMENT = r"[A-Za-z0-9_./-]+(?:\.[A-Za-z0-9_./-]+|/[A-Za-z0-9_./-]+)"
EVAL_TOKEN = r"[A-Za-z0-9_./+-]+"
_CAMEL = r"(?<=[a-z0-9])(?=[A-Z])"


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Stripped, and runs of blanks as one space; null as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case lexical tokens with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def code_terms(c: Column, stop=vocab.CODE_STOP) -> Column:
    """Sorted distinct identifiers with their split and camel-case parts; at least 3 characters, no stop words."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CODE_TERM), F.lit(0))
    parts = F.flatten(F.transform(raw, lambda t: F.concat(F.array(t), F.split(t, r"[._/-]+"), F.split(F.regexp_replace(t, _CAMEL, " "), " "))))
    clean = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r"^[_./-]+|[_./-]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda p: (F.length(p) >= 3) & ~p.isin(*stop))))


def path_fragments(c: Column) -> Column:
    """Sorted distinct path-like parts of a text."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FRAGMENT), F.lit(0))
    clean = F.transform(raw, lambda p: F.lower(F.regexp_replace(p, r"^[./]+|[./]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda p: p.contains("/") | p.contains("."))))


def eval_tokens(c: Column) -> Column:
    """Evaluation tokens: each token, then its camel-case and split parts where they differ from it; with repeats."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EVAL_TOKEN), F.lit(0))

    def expand(t: Column) -> Column:
        parts = F.concat(F.split(F.regexp_replace(t, _CAMEL, " "), " "), F.split(t, r"[._/+-]+"))
        return F.concat(F.array(F.lower(t)), F.filter(F.transform(parts, F.lower), lambda p: (p != "") & (p != F.lower(t))))

    return F.flatten(F.transform(raw, expand))


def normal_path(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"^[./]+", ""))


def has_term(c: Column, terms) -> Column:
    """Whether lower-case text *c* has one of *terms* between characters other than a-z and 0-9."""
    escaped = "|".join(t.replace(".", r"\.").replace("-", r"\-").replace("+", r"\+") for t in terms)
    return c.rlike(rf"(?<![a-z0-9])(?:{escaped})(?![a-z0-9])")


def has_any(c: Column, parts) -> Column:
    """Whether *c* contains one of *parts*."""
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out
