"""Progress of long work by phases: each phase tags its jobs, and the status tracker counts their tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class State:
    """Jobs, and tasks of their stages, of a phase so far; ``ended`` once the phase is left."""

    phase: str
    jobs: int
    running: int
    tasks: int
    done: int
    failed: int
    ended: bool


class Progress:
    """Phases of one piece of work. Another thread may ask for states or cancel while a phase runs."""

    def __init__(self, spark: SparkSession) -> None:
        self.context, self.own = spark.sparkContext, uuid.uuid4().hex
        self.phases: dict[str, bool] = {}

    def _tag(self, phase: str) -> str:
        return f"{self.own}-{phase}"

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Jobs started in this thread belong to the phase."""
        self.phases[name] = False
        self.context.addJobTag(self._tag(name))
        try:
            yield
        finally:
            self.context.removeJobTag(self._tag(name))
            self.phases[name] = True

    def states(self) -> list[State]:
        """States of all phases begun, in order. Spark forgets the oldest jobs, so old phases may count fewer."""
        tracker, out = self.context.statusTracker(), []
        for name, ended in list(self.phases.items()):
            jobs = [j for i in self.context._jsc.sc().statusTracker().getJobIdsForTag(self._tag(name)) if (j := tracker.getJobInfo(i))]
            stages = [s for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))]
            out.append(State(name, len(jobs), sum(j.status == "RUNNING" for j in jobs), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), sum(s.numFailedTasks for s in stages), ended))
        return out

    def cancel(self, phase: str | None = None) -> None:
        """Stop the jobs of a phase, or of all; the thread that waits for them gets an error."""
        for name in [phase] if phase else list(self.phases):
            self.context.cancelJobsWithTag(self._tag(name))
