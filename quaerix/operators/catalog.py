"""The catalog of repositories and its sessions, as operations on tables that give the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "id long, github_url string, source_url string, session_key string, session_expires_at timestamp_ntz, owner string, name string, "
    "branch string, local_path string, status string, error_message string, file_count long, chunk_count long, "
    "indexed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
STATUSES = ("queued", "indexing", "indexed", "failed")
TTL_MINUTES = 120


def url_key(session: Column, url: Column) -> Column:
    return F.concat_ws("::", session, url)


def expiry(now: Column, minutes: int = TTL_MINUTES) -> Column:
    return now + F.make_dt_interval(mins=F.lit(minutes))


def upsert(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of *incoming* replace those of the same github_url, keeping id and created_at; others stay."""
    old = catalog.select(F.col("github_url"), F.col("id").alias("_id"), F.col("created_at").alias("_created"))
    merged = incoming.join(old, "github_url", "left").withColumn("id", F.coalesce("_id", "id")).withColumn("created_at", F.coalesce("_created", "created_at")).drop("_id", "_created")
    return catalog.join(incoming.select("github_url"), "github_url", "left_anti").unionByName(merged, allowMissingColumns=True)


def session_list(catalog: DataFrame, session: Column) -> DataFrame:
    return catalog.filter(F.col("session_key") == session).orderBy(F.col("updated_at").desc(), "id")


def get(catalog: DataFrame, repository: int, session: str) -> DataFrame:
    """Both must match: sessions do not see each other's repositories."""
    return catalog.filter((F.col("id") == repository) & (F.col("session_key") == session))


class NotFound(ValueError):
    """There is no such repository in this session."""


class Cancelled(RuntimeError):
    """The session ended while its repository was indexed."""


def status_of(error: Exception) -> tuple[int, dict[str, str]]:
    """The HTTP status and headers that a service answers an error with: 404 and 400 for what was asked wrongly, 429 for a busy model, else 500."""
    from quaerix.operators.answer import Busy

    if isinstance(error, NotFound):
        return 404, {}
    if isinstance(error, ValueError):
        return 400, {}
    if isinstance(error, Busy):
        return 429, {"Retry-After": str(int(error.after if error.after is not None else 30))}
    return 500, {}


def touch(catalog: DataFrame, session: Column, now: Column, minutes: int = TTL_MINUTES) -> DataFrame:
    return catalog.withColumn("session_expires_at", F.when(F.col("session_key") == session, expiry(now, minutes)).otherwise(F.col("session_expires_at")))


def expired(catalog: DataFrame, now: Column) -> DataFrame:
    """Strictly before now; a null expiry never ends."""
    return catalog.filter(F.col("session_expires_at").isNotNull() & (F.col("session_expires_at") < now))


def alive(catalog: DataFrame, now: Column) -> DataFrame:
    return catalog.filter(F.col("session_expires_at").isNull() | (F.col("session_expires_at") >= now))


def cascade(rows: DataFrame, gone: DataFrame, key: str = "repository", gone_key: str = "id") -> DataFrame:
    """What stays of a dependent table when the repositories *gone* are deleted."""
    return rows.join(gone.select(F.col(gone_key).alias(key)).distinct(), key, "left_anti")


def end_session(catalog: DataFrame, session: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes)."""
    mine = F.coalesce(F.col("session_key") == session, F.lit(False))
    return catalog.filter(~mine), catalog.filter(mine)


def wiped(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) when everything is forgotten, as at a fresh start."""
    return catalog.limit(0), catalog


def progress(updates: DataFrame) -> DataFrame:
    """(repository, progress): a map in which the last update of each key counts. updates: repository, at, values (map)."""
    each = updates.select("repository", "at", F.explode("values").alias("k", "v")).groupBy("repository", "k").agg(F.max_by("v", "at").alias("v"))
    return each.groupBy("repository").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("progress"))


def serialised(catalog: DataFrame) -> DataFrame:
    """What is shown of a repository: the plain URL, times as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    shown = F.coalesce("source_url", "github_url").alias("github_url")
    return catalog.select("id", shown, "owner", "name", "branch", "status", "error_message", "file_count", "chunk_count", iso("indexed_at"), iso("created_at"), iso("updated_at"), iso("session_expires_at"))


def ask_guard(status: str | None, chunks: int) -> None:
    """Raise ValueError where a question cannot be asked."""
    if status is None:
        raise NotFound("no such repository in this session")
    if status != "indexed":
        raise ValueError("the repository is not indexed yet")
    if not chunks:
        raise ValueError("the repository has no indexed chunks")
