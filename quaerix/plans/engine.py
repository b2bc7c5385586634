"""The engine: index source trees, ask questions, list and end sessions. All tables live below one path, the catalog among them."""

from __future__ import annotations

import datetime
import shutil
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaerix.functions.queryx import format_history, latest_turns
from quaerix.operators import answer, catalog, lexical, vector
from quaerix.operators.chunking import chunk_files
from quaerix.operators.embed import Embedder, HashingEmbedder, embed
from quaerix.plans.retrieval import retrieve
from quaerix.session import scratch, ship
from quaerix.sources.files import HOSTS, clone, parse_repo_url, source_files

NAMES = [c.split()[0] for c in catalog.SCHEMA.split(", ")]
#: Catalog versions that are kept for readers that opened them before the last change.
KEPT = 2


class Engine:
    """A catalog, chunks, an index and vectors in Parquet, by repository; sessions see only their own repositories.

    The catalog is a table of versions: a change writes a whole new version, and readers take the last one that is complete. So an engine that is made anew over a
    path goes on where the last one ended. One engine writes to a path at a time.
    """

    def __init__(
        self, spark: SparkSession, path: str, embedder: Embedder | None = None, answerer: answer.Answerer | None = None, rules=(), minutes: int = catalog.TTL_MINUTES, hosts=HOSTS, reranker=None, fresh: bool = False,
    ) -> None:
        self.spark, self.path = ship(spark), path.rstrip("/")
        self.embedder, self.answerer = embedder or HashingEmbedder(), answerer or answer.ExtractiveAnswerer()
        self.rules, self.minutes, self.hosts, self.reranker = rules, minutes, hosts, reranker
        self.lock = threading.RLock()
        #: What indexing says, by repository, and what `submit` could not do: (session, source, why).
        self._updates: dict[int, list[tuple[int, dict[str, str]]]] = {}
        self.failed: list[tuple[str, str, str]] = []
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        if fresh:
            self.wipe()

    # --- files ---

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return bool(fs.exists(p))

    # --- catalog ---

    def _versions(self) -> list[int]:
        p, fs = self._fs(f"{self.path}/catalog")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._exists(f"{self.path}/catalog/{n}/_SUCCESS"))

    def catalog(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], catalog.SCHEMA)
        return self.spark.read.schema(catalog.SCHEMA).parquet(f"{self.path}/catalog/v={versions[-1]}")

    def _save(self, rows: DataFrame) -> None:
        versions = self._versions()
        # A row for each repository: one file.
        rows.select(NAMES).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalog/v={(versions or [0])[-1] + 1}")
        for old in versions[: -KEPT + 1] if KEPT > 1 else versions:
            self._delete(f"{self.path}/catalog/v={old}")

    def _upsert(self, row: dict) -> dict:
        with self.lock:
            self._save(catalog.upsert(self.catalog(), self.spark.createDataFrame([tuple(row[n] for n in NAMES)], catalog.SCHEMA)))
        return row

    def _row(self, repository: int, session: str) -> dict | None:
        r = catalog.get(self.catalog(), repository, session).first()
        return r.asDict() if r else None

    def _now(self) -> datetime.datetime:
        return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)

    def _drop(self, repositories: list[int]) -> None:
        for repository in repositories:
            for t in ("chunks", "vectors", *(f"index/{name}" for name in lexical.TABLES)):
                self._delete(f"{self.path}/{t}/repository={repository}")

    def _forget(self, stays: DataFrame, goes: DataFrame) -> int:
        gone = [r["id"] for r in goes.select("id").collect()]
        if gone:
            with self.lock:
                self._save(stays)
            for rid in gone:
                self.spark.sparkContext.cancelJobsWithTag(self._tag(rid))
            self._drop(gone)
        return len(gone)

    def _sweep(self) -> None:
        c, now = self.catalog(), F.lit(self._now())
        self._forget(catalog.alive(c, now), catalog.expired(c, now))

    def _touch(self, session: str) -> None:
        with self.lock:
            self._save(catalog.touch(self.catalog(), F.lit(session), F.lit(self._now()), self.minutes))

    def _tag(self, repository: int) -> str:
        return "quaerix-" + uuid.uuid5(uuid.NAMESPACE_URL, f"{self.path}/{repository}").hex

    def wipe(self) -> int:
        """Forget all repositories and their tables."""
        return self._forget(*catalog.wiped(self.catalog()))

    # --- indexing ---

    def _placed(self, url: str) -> dict:
        """owner, name, branch and plain URL; a ValueError for a URL that is not a repository's on one of the hosts."""
        r = self.spark.range(1).select(parse_repo_url(F.lit(url), self.hosts).alias("r")).first()["r"]
        if r["error"]:
            raise ValueError(r["error"])
        return {"owner": r["owner"], "name": r["repo"], "branch": r["branch"], "source_url": r["repo_url"]}

    def index(self, root: str, session: str, url: str | None = None) -> dict:
        """Chunk, embed and store the tree at *root*; the same URL in a session replaces what it had.

        Steps check whether the session still has the repository, and ending it cancels their jobs.
        """
        if not session.strip():
            raise ValueError("a session key is needed")
        self._sweep()
        at = self._placed(url) if url else {"owner": None, "name": root.rstrip("/").rsplit("/", 1)[-1], "branch": "main", "source_url": root}
        now, key = self._now(), f"{session}::{at['source_url']}"
        with self.lock:
            c = self.catalog()
            old = c.filter(F.col("github_url") == key).first()
            last = c.agg(F.max("id")).first()[0] or 0
            row = dict.fromkeys(NAMES) | at | {
                "id": old["id"] if old else last + 1, "github_url": key, "session_key": session, "session_expires_at": now + datetime.timedelta(minutes=self.minutes),
                "local_path": root, "status": "indexing", "file_count": 0, "chunk_count": 0, "created_at": old["created_at"] if old else now, "updated_at": now,
            }
            self._upsert(row)
        rid = row["id"]
        self._drop([rid])
        self._tell(rid, step="reading", started_at=now.isoformat())
        tag = self._tag(rid)
        self.spark.sparkContext.addJobTag(tag)
        try:
            files = source_files(self.spark, root).withColumn("repository", F.lit(rid).cast("long"))
            chunk_files(files).write.mode("overwrite").partitionBy("repository").parquet(f"{self.path}/chunks")
            chunks = self._table("chunks", rid)
            self._tell(rid, step="indexing words")
            self._go_on(rid, session)
            lexical.write_index(chunks.select("repository", "id", "searchable_text"), f"{self.path}/index")
            self._tell(rid, step="embedding")
            self._go_on(rid, session)
            vectors = embed(chunks.select("repository", "id", "searchable_text"), self.embedder, "searchable_text").drop("searchable_text")
            vector.write_vectors(vectors, f"{self.path}/vectors", "overwrite")
            n = chunks.agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("f")).first()
            self._go_on(rid, session)
            self._tell(rid, step="done", chunks=n["n"], files=n["f"])
            return self._upsert(row | {"status": "indexed", "chunk_count": n["n"], "file_count": n["f"], "indexed_at": self._now(), "updated_at": self._now()})
        except catalog.Cancelled:
            self._drop([rid])
            raise
        except Exception as e:
            self._drop([rid])
            if self._row(rid, session) is None:
                raise catalog.Cancelled("the session ended") from e
            said = self.spark.range(1).select(answer.friendly_error(F.lit(str(e)[:500]))).first()[0]
            self._tell(rid, step="failed", error=said)
            self._upsert(row | {"status": "failed", "error_message": said, "updated_at": self._now()})
            raise
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def _tell(self, repository: int, **values) -> None:
        self._updates.setdefault(repository, []).append((len(self._updates.get(repository, [])), {k: str(v) for k, v in values.items()}))

    def progress(self, repository: int, session: str) -> dict:
        """What indexing of a repository has said so far; the last word on each key counts."""
        if self._row(repository, session) is None:
            raise catalog.NotFound("no such repository in this session")
        said = [(repository, at, values) for at, values in self._updates.get(repository, [])]
        r = catalog.progress(self.spark.createDataFrame(said, "repository long, at long, values map<string,string>")).first()
        return dict(r["progress"]) if r else {}

    def submit(self, root: str, session: str, url: str | None = None) -> threading.Thread:
        """`index` in a thread of its own; `wait` for it, or ask for its row and `progress`. A failure is in the row."""
        def run() -> None:
            try:
                self.index(root, session, url)
            except Exception as e:  # noqa: BLE001  the catalog's row says what went wrong
                self.failed.append((session, url or root, str(e)))

        from pyspark import inheritable_thread_target

        thread = threading.Thread(target=inheritable_thread_target(self.spark)(run), daemon=True)
        thread.start()
        return thread

    def wait(self, repository: int, session: str, every: float = 3.0, timeout: float = 3600.0) -> dict | None:
        """A repository's row once it is neither queued nor being indexed; None if there is none."""
        until = time.monotonic() + timeout
        while True:
            row = self.get(repository, session)
            if row is None or row["status"] not in ("queued", "indexing"):
                return row
            if time.monotonic() > until:
                raise TimeoutError("the repository is still being indexed")
            time.sleep(every)

    def keep_alive(self, seconds: float = 43_200.0, least: float = 60.0) -> threading.Event:
        """Ask for `health` every so many seconds, *least* at least, in a daemon thread; set the event to end it. For stores that fall asleep."""
        stop, pause = threading.Event(), max(seconds, least)

        def run() -> None:
            while not stop.wait(pause):
                self.health()

        threading.Thread(target=run, daemon=True).start()
        return stop

    def index_url(self, url: str, session: str, run=None) -> dict:
        """Clone a repository, index it, and remove the copy, also after a failure.

        The driver clones into a folder of its own and copies the tree to the shared scratch folder, where all executors read it. *run* as in `files.clone`.
        """
        at = self._placed(url)
        local = tempfile.mkdtemp(prefix="quaerix_clone_")
        shared = f"{scratch(self.spark)}/trees/{uuid.uuid4().hex}"
        try:
            clone(at["source_url"], f"{local}/tree", at["branch"], run=run)
            shutil.rmtree(f"{local}/tree/.git", ignore_errors=True)
            p, fs = self._fs(shared)
            fs.copyFromLocalFile(False, True, self._fs(f"file://{local}/tree")[0], p)
            return self.index(shared, session, url)
        finally:
            shutil.rmtree(local, ignore_errors=True)
            self._delete(shared)

    def _go_on(self, repository: int, session: str) -> None:
        if self._row(repository, session) is None:
            raise catalog.Cancelled("the session ended")

    def _table(self, name: str, repository: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("repository") == repository).withColumn("repository", F.col("repository").cast("long"))

    # --- reading ---

    def health(self) -> dict:
        """How many repositories, chunks' vectors and which dimension there are."""
        n = self.catalog().filter("status = 'indexed'").count()
        stats = vector.store_stats(self.spark.read.parquet(f"{self.path}/vectors")).first() if n else None
        return {"status": "ok", "repositories": n, "vectors": stats["n_vectors"] if stats else 0, "dimension": stats["dimension"] if stats else None}

    def list(self, session: str) -> list[dict]:
        self._sweep()
        self._touch(session)
        return [r.asDict() for r in catalog.serialised(catalog.session_list(self.catalog(), F.lit(session))).collect()]

    def get(self, repository: int, session: str) -> dict | None:
        self._sweep()
        r = catalog.serialised(catalog.get(self.catalog(), repository, session)).first()
        return r.asDict() if r else None

    def end_session(self, session: str) -> int:
        if len(session) < 8:
            raise ValueError("a session key of 8 characters or more is needed")
        return self._forget(*catalog.end_session(self.catalog(), F.lit(session)))

    def ask(self, repository: int, session: str, question: str, top_k: int = 8, history: list[dict] | None = None) -> dict:
        """One question is a batch of one row."""
        if len(question.strip()) < 3 or not 3 <= top_k <= 12 or len(history or []) > 8:
            raise ValueError("a question has 3 characters or more, top_k is from 3 to 12, and a history has 8 turns at most")
        if any(t.get("role") not in ("user", "assistant") or not 1 <= len(t.get("content") or "") <= 4000 for t in history or []):
            raise ValueError("turns are by user or assistant and have 1 to 4000 characters")
        self._sweep()
        row = self._row(repository, session)
        catalog.ask_guard(row and row["status"], row["chunk_count"] if row else 0)
        self._touch(session)
        turns = self.spark.createDataFrame([(0, i, t["role"], t["content"]) for i, t in enumerate(history or [])], "qid long, turn long, role string, text string")
        q = self.spark.createDataFrame([(0, repository, question)], "qid long, repository long, question string")
        q = embed(q.join(latest_turns(turns), "qid", "left"), self.embedder, "question", "qvec", query=True)
        index = lexical.Index(**{name: self._table(f"index/{name}", repository) for name in lexical.TABLES})
        sources = retrieve(self._table("chunks", repository), self._table("vectors", repository), q, top_k, self.rules, self.reranker, index).cache()
        try:
            found = answer.slim_sources(sources).orderBy("source_no").drop("qid").collect()
            if not found:
                return answer.refusal(0) | {"repository": repository}
            said = q.select("qid", "question", F.lit(f"{row['owner'] or ''}/{row['name']}".strip("/")).alias("repository"))
            said = said.join(answer.contexts(sources), "qid").join(format_history(turns), "qid", "left")
            asked = said.join(answer.prompts(said), "qid").select("prompt", "context").first()
            label = answer.confidence_label(sources).first()["confidence"]
            cited = [r.asDict() for r in answer.citations(sources).orderBy("citation_no").select("source", "reason", "percent").collect()]
        finally:
            sources.unpersist()
        text = answer.ask_until_complete(self.spark, self.answerer, asked["prompt"], asked["context"])
        short = self.spark.createDataFrame([(text,)], "t string").select(answer.summary(F.col("t"))).first()[0]
        return {"answer": text, "confidence": label, "summary": short, "citations": cited, "sources": [s.asDict() for s in found], "repository": repository}
