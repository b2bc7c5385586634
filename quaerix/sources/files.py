"""Reading source trees, URLs and evaluation sets, and writing reports."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaerix.functions import vocab
from quaerix.operators.evaluation import CASE
from quaerix.operators.lexical import fits, small

HOSTS = ("github.com", "www.github.com")


def accepted(path: Column, length: Column) -> Column:
    """Whether a file (path relative to its root, size in bytes) is read."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    suffix = F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))
    known = suffix.isin(*vocab.SUFFIXES) | name.isin(*vocab.FILE_NAMES)
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in vocab.SKIPPED_DIRS]))
    return known & ~skipped & ~name.isin(*vocab.LOCK_FILES) & (length <= vocab.MAX_BYTES)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, length, content) of the accepted files below *root*. Paths and sizes are filtered before contents are read."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    top = base.split("://")[-1].lstrip("/") + "/"
    relative = F.substring(plain, F.instr(plain, top) + F.lit(len(top)), F.length(plain))
    kept = found.withColumn("file_path", relative).filter(accepted(F.col("file_path"), F.col("length")))

    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return kept.select("file_path", "length", decode("content").alias("content"))


def parse_repo_url(url: Column, hosts=HOSTS) -> Column:
    """struct(owner, repo, branch, slug, repo_url, error) of a repository's URL on one of *hosts* (None: any)."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    error = F.when(host == "", "not a URL")
    if hosts is not None:
        error = F.when(~host.isin(*hosts), "host is not supported")
    error = error.when(F.size(parts) < 2, "owner and repository are needed")
    owner = F.get(parts, F.lit(0))
    repo = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    branch = F.when((F.size(parts) >= 4) & F.get(parts, F.lit(2)).isin("blob", "tree"), F.get(parts, F.lit(3))).otherwise(F.lit("main"))
    ok = lambda c: F.when(error.isNull(), c)
    slug = F.regexp_replace(F.concat_ws("-", owner, repo), r"[^a-zA-Z0-9_.-]+", "-")
    home = F.concat(F.lit("https://"), host if hosts is None else F.lit(hosts[0]), F.lit("/"), owner, F.lit("/"), repo)
    return F.struct(ok(owner).alias("owner"), ok(repo).alias("repo"), ok(branch).alias("branch"), ok(slug).alias("slug"), ok(home).alias("repo_url"), error.alias("error"))


def clone(url: str, target: str, branch: str = "main", timeout: float = 600.0, run=None) -> str:
    """A shallow copy of a repository's branch in *target*, which is emptied first: the branch, then ``main``, then the remote's default. The branch that was read.

    *run* takes a command's words and stands for ``git`` in tests. Errors are worded by `answer.friendly_error`.
    """
    import shutil
    import subprocess

    def git(words: list[str]) -> None:
        subprocess.run(words, check=True, capture_output=True, text=True, timeout=timeout, env={"GIT_TERMINAL_PROMPT": "0", "PATH": os.environ.get("PATH", "")})

    said = "not found"
    for name in dict.fromkeys((branch, "main", "")):
        shutil.rmtree(target, ignore_errors=True)
        try:
            (run or git)(["git", "clone", "--depth", "1", "--single-branch", *(["--branch", name] if name else []), "--", url, target])
            return name
        except subprocess.CalledProcessError as e:
            said = (e.stderr or str(e)).strip()
        except subprocess.TimeoutExpired:
            said = "timed out"
    shutil.rmtree(target, ignore_errors=True)
    raise ValueError(said)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, content, digest) of the text files below *path*: whole texts, and the MD5 of their bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return found.select(F.col("path").alias("file_path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.md5("content").alias("digest"))


def containing(documents: DataFrame, passages: DataFrame, anchor: int = 3) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) that have a passage (item_id, passage) as a substring.

    The first *anchor* whole words inside a passage are whole words of a document that has it: documents and passages are joined by
    a hash of them, and texts are compared for the pairs that are left. Passages that are too short for an anchor meet all documents, if they are few.
    """
    def hashed(words: Column) -> Column:
        shifted = [words if k == 0 else F.slice(words, F.lit(k + 1), F.size(words)) for k in range(anchor)]
        named = F.transform(F.arrays_zip(*[w.alias(f"w{k}") for k, w in enumerate(shifted)]), lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(anchor)]))
        return F.array_distinct(F.slice(named, F.lit(1), F.greatest(F.size(words) - anchor + 1, F.lit(0))))

    # A passage may begin and end inside a word of the document.
    inner = lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))
    keyed = passages.filter("passage is not null").withColumn("_w", inner(F.split("passage", r"\s+")))
    long = keyed.filter(F.size("_w") >= anchor).select("item_id", "passage", F.get(hashed(F.col("_w")), F.lit(0)).alias("key"))
    short = keyed.filter(F.size("_w") < anchor).select("item_id", "passage")
    at = documents.select("doc_id", F.explode(hashed(F.split("text", r"\s+"))).alias("key"))
    pairs = at.join(small(long.select("key", "item_id")), "key").select("doc_id", "item_id")
    texts = pairs.join(documents, "doc_id").join(small(long.select("item_id", "passage")), "item_id").filter(F.contains("text", "passage"))
    out = texts.select("doc_id", "item_id").distinct()
    if short.isEmpty():
        return out
    if not fits(short, 1 << 12):
        raise ValueError("too many passages of fewer than five words: find them as words")
    return out.unionByName(documents.join(F.broadcast(short), F.contains("text", "passage")).select("doc_id", "item_id"))


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).option("multiLine", True).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines; reports have a row for each category."""
    rows.coalesce(1).write.mode("overwrite").json(path)
