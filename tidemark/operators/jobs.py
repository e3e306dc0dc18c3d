"""Long work: bounded pools, progress, cancellation, retries, and migrations in steps that can be taken up again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.movement import estimate
from tidemark.plans.context import QueryError

CATEGORIES = ("metadata_only", "rewrite", "world_time_shift")


class Token:
    """Ends the Spark jobs of whoever holds it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.group, self.cancelled = spark, f"tidemark-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        if self.cancelled:
            raise QueryError("cancelled")


@dataclass
class Job:
    name: str
    token: Token
    future: Future

    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks in all of the Spark stages under way."""
        tracker = self.token.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.token.group) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
        known = [s for s in stages if s]
        return sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known)


class Supervisor:
    """Runs jobs in two pools of bounded size; what doesn't fit waits, and a full queue is refused."""

    def __init__(self, spark: SparkSession, cpu: int = 4, io: int = 2, waiting: int = 64):
        self.spark, self.waiting, self.jobs = spark, waiting, {}
        self.pools = {"cpu": ThreadPoolExecutor(cpu), "io": ThreadPoolExecutor(io)}

    def submit(self, name: str, work: Callable[[Token], object], pool: str = "cpu") -> Job:
        if sum(not j.future.done() for j in self.jobs.values()) >= self.waiting:
            raise QueryError("too many jobs wait")
        token = Token(self.spark)

        def run():
            token.check()
            self.spark.sparkContext.setJobGroup(token.group, name, interruptOnCancel=True)
            out = work(token)
            token.check()
            return out

        job = self.jobs[name] = Job(name, token, self.pools[pool].submit(inheritable_thread_target(run)))
        return job

    def close(self) -> None:
        """No new jobs; those under way end first."""
        for pool in self.pools.values():
            pool.shutdown(wait=True)


def retried(work: Callable[[], object], attempts: int = 3, wait: float = 0.0, retryable: tuple = (QueryError,)) -> object:
    """The result of work that may be repeated safely, tried again after a conflict."""
    for k in range(attempts):
        try:
            return work()
        except retryable:
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2**k)
    raise QueryError("no attempt was made")


@dataclass(frozen=True)
class Step:
    """One change of a migration: a table, and what becomes of its rows."""

    name: str
    category: str
    table: str
    change: Callable[[DataFrame], DataFrame]

    def __post_init__(self):
        if self.category not in CATEGORIES:
            raise QueryError("unknown category of migration")


def impact(store, steps: list[Step]) -> DataFrame:
    """(step, category, n, n_bytes): what each step would touch.  Nothing is written."""
    out = None
    for k, s in enumerate(steps):
        rows = getattr(store, s.table)
        part = estimate(rows, rows.columns).select(F.lit(k).alias("step"), F.lit(s.category).alias("category"), "n", "n_bytes")
        out = part if out is None else out.unionByName(part)
    return out


def dry_run(store, steps: list[Step]) -> DataFrame:
    """(step, n_before, n_after, n_changed) of the steps run without writing; columns may not change."""
    out = None
    for k, s in enumerate(steps):
        rows = getattr(store, s.table)
        after = s.change(rows)
        if after.columns != rows.columns:
            raise QueryError(f"step {s.name} changes the columns")
        same = rows.select(F.xxhash64(*rows.columns).alias("h")).groupBy("h").agg(F.count("*").alias("before"))
        now = after.select(F.xxhash64(*after.columns).alias("h")).groupBy("h").agg(F.count("*").alias("after"))
        both = same.join(now, "h", "full").select(F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
        part = both.agg(F.lit(k).alias("step"), F.sum("before").alias("n_before"), F.sum("after").alias("n_after"), F.sum(F.greatest(F.col("after") - F.col("before"), F.lit(0))).alias("n_changed"))
        out = part if out is None else out.unionByName(part)
    return out


def migrate(database, steps: list[Step], expected: int, migration: str) -> int:
    """Runs the steps, each one version; steps that a run before has committed are skipped.  The head must be what the caller expects."""
    head = database.head()
    done = {m["step"] for m in database.notes("migration") if m["migration"] == migration}
    if head != expected and not done:
        raise QueryError("the head has moved")
    for k, s in enumerate(steps):
        if k in done:
            continue
        rows = database.read(s.table, head)
        head = database.replace(s.table, s.change(rows), head, note=("migration", {"migration": migration, "step": k, "name": s.name}))
    return head
