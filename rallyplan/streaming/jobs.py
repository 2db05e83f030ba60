"""A queue of jobs as a stream of events: leases that run out, jobs put back after a lost worker, progress not told more often than needed.

Events are (job_id, at, kind, worker, progress) with kind queued, claimed, progress, done,
failed or cancelled. A claim of a queued job gives its worker a lease of ``LEASE_S``
seconds, which each sign of life (progress) renews. When a lease runs out, the job is
queued again with one more attempt, at that moment, whether a later event of the job or
the watermark shows it. Events of workers that don't hold the lease, and events that
don't fit the job's status, change nothing. Progress is told when at least ``TELL_S``
seconds have passed since it was told last.

Defined results: events of a job at one time count in the order of ``ORDER``; a job that
is over stays over; a null progress is a sign of life only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE_S, TELL_S = 30.0, 0.5
ORDER = ("queued", "claimed", "progress", "done", "failed", "cancelled")
OVER = {"done", "failed", "cancelled"}
EVENTS = "job_id long, at timestamp, kind string, worker string, progress double"
TOLD = "job_id long, at_s double, status string, worker string, attempt int, progress double"
STATE = "status string, worker string, attempt int, until_s double, told_s double, progress double"


class Job:
    """One job's status; ``take`` and ``expire`` give the rows (at_s, status, worker, attempt, progress) to tell."""

    def __init__(self, status: str | None = None, worker: str | None = None, attempt: int = 0, until: float = 0.0, told: float = float("-inf"), progress: float = 0.0):
        self.status, self.worker, self.attempt, self.until, self.told, self.progress = status, worker, attempt, until, told, progress

    def _tell(self, at: float) -> tuple:
        self.told = at
        return at, self.status, self.worker, self.attempt, self.progress

    def expire(self, now: float) -> Iterator[tuple]:
        """A lease that ran out before ``now``."""
        if self.status == "running" and now > self.until:
            at = self.until
            self.status, self.worker, self.attempt, self.progress = "queued", None, self.attempt + 1, 0.0
            yield self._tell(at)

    def take(self, at: float, kind: str, worker: str | None, progress: float | None) -> Iterator[tuple]:
        yield from self.expire(at)
        if kind == "queued" and self.status is None:
            self.status, self.attempt = "queued", 1
            yield self._tell(at)
        elif kind == "claimed" and self.status == "queued":
            self.status, self.worker, self.until = "running", worker, at + LEASE_S
            yield self._tell(at)
        elif kind == "cancelled" and self.status is not None and self.status not in OVER:
            self.status = "cancelled"
            yield self._tell(at)
        elif self.status == "running" and worker == self.worker:
            if kind == "progress":
                self.until = at + LEASE_S
                self.progress = self.progress if progress is None else progress
                if progress is not None and at - self.told >= TELL_S:
                    yield self._tell(at)
            elif kind in ("done", "failed"):
                self.status, self.progress = kind, 1.0 if kind == "done" else self.progress
                yield self._tell(at)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    job, out = Job(*state.get) if state.exists else Job(), []
    if state.hasTimedOut:
        out += job.expire(state.getCurrentWatermarkMs() / 1000)
    else:
        rows = pd.concat(list(batches))
        rows["place"] = rows.kind.map({k: i for i, k in enumerate(ORDER)})
        for r in rows.sort_values(["at", "place"], kind="stable").itertuples():
            out += job.take(r.at.timestamp(), r.kind, r.worker, None if pd.isna(r.progress) else float(r.progress))
    state.update((job.status, job.worker, job.attempt, job.until, job.told, job.progress))
    if job.status == "running":  # just after the lease, or as soon as a watermark beyond it allows
        state.setTimeoutTimestamp(max(int(job.until * 1000) + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in TOLD.split(", ")])


def job_statuses(events: DataFrame, late: str = "5 seconds") -> DataFrame:
    """What is to be told of each job, as it happens; a job's events come in order from trigger to trigger."""
    return events.withWatermark("at", late).groupBy("job_id").applyInPandasWithState(_advance, TOLD, STATE, "append", GroupStateTimeout.EventTimeTimeout)
