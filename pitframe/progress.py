"""Progress from running work: tasks done so far, rows as they are counted, batches of streams."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: ``report(current, total, message)``.
Report = Callable[..., None]


@contextmanager
def watched(spark: SparkSession, report: Report, every_s: float = 1.0) -> Iterator[None]:
    """Reports the tasks done and known of the jobs that run within, as they run.

    Reads the driver's status store, so it starts no job.  Jobs are known by a
    group of their own; stages that are still to be planned are not counted,
    so the total can grow.
    """
    sc, group, over = spark.sparkContext, f"watched-{uuid.uuid4().hex}", threading.Event()
    status = sc.statusTracker()
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    seen: dict[int, tuple[int, int]] = {}

    def look() -> None:
        for job in status.getJobIdsForGroup(group):
            info = status.getJobInfo(job)
            for stage in info.stageIds if info else []:
                if (s := status.getStageInfo(stage)) is not None:
                    seen[stage] = (s.numCompletedTasks, s.numTasks)
        if seen:
            report(sum(done for done, _ in seen.values()), sum(n for _, n in seen.values()))

    def poll() -> None:
        while not over.wait(every_s):
            look()

    sc.setJobGroup(group, before[1] or "")
    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        look()
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])


class Counted:
    """``df`` with its rows counted while some action reads it; no job of its own."""

    def __init__(self, df: DataFrame, name: str, **more) -> None:
        self.name, self._seen = name, Observation(f"{name}-{uuid.uuid4().hex}")
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"), *[x.alias(k) for k, x in more.items()])

    def metrics(self) -> dict:
        """What was counted, once the action is over."""
        return dict(self._seen.get)

    def report(self, report: Report) -> dict:
        got = self.metrics()
        report(1, 1, f"{self.name}: " + ", ".join(f"{k} {x}" for k, x in got.items()))
        return got


class StreamProgress(StreamingQueryListener):
    """Reports each micro-batch of streams: its number, its rows, and what the stream observes."""

    def __init__(self, report: Report) -> None:
        self.report, self.rows = report, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.report(0, 0, f"{event.name or event.id}: begins")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows += p.numInputRows
        seen = "".join(f", {k} {v}" for m in p.observedMetrics.values() for k, v in m.asDict().items())
        self.report(p.batchId + 1, 0, f"{p.name or p.id}: batch {p.batchId}, {p.numInputRows} rows{seen}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.report(0, 0, f"{event.id}: " + (f"failed: {event.exception}" if event.exception else "ends"))
