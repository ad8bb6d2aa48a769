"""Syncs in the background: one at a time, a folder that waits or runs already is not taken twice."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone


def _now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class Job:
    """state: waiting, running, done or error."""

    folder: str
    state: str = "waiting"
    report: dict = field(default_factory=dict)
    error: str | None = None
    started_at: datetime | None = None
    finished_at: datetime | None = None


class Jobs:
    """engine: has sync_folder(folder) -> report."""

    def __init__(self, engine):
        self.engine = engine
        self._pool = ThreadPoolExecutor(1)
        self._lock = threading.Lock()
        self._jobs: dict[str, Job] = {}

    def start(self, folder: str) -> Job:
        """The folder's job: the one that waits or runs, or else a new one."""
        with self._lock:
            job = self._jobs.get(folder)
            if job is None or job.state in ("done", "error"):
                job = self._jobs[folder] = Job(folder)
                self._pool.submit(self._run, job)
            return job

    def status(self, folder: str) -> Job | None:
        return self._jobs.get(folder)

    def _run(self, job: Job) -> None:
        job.state, job.started_at = "running", _now()
        try:
            job.report = self.engine.sync_folder(job.folder)
            job.state = "done"
        except Exception as e:  # a job that fails must not stop the next
            job.state, job.error = "error", str(e)
        job.finished_at = _now()

    def close(self) -> None:
        """Wait for what runs."""
        self._pool.shutdown()
