"""Run records: audit, error, lineage and data-quality rows of a job."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from keelson.config import Config
from keelson.schema import SYSTEM
from keelson.sources.store import Table

SUCCESS, FAILED = "SUCCESS", "FAILED"


def now() -> datetime:
    return datetime.now(UTC)


@dataclass
class Outcome:
    """What a step did for one target."""

    target: str
    load_type: str
    incoming: int = 0
    inserted: int = 0
    conflicted: int = 0
    status: str = SUCCESS
    start: datetime = field(default_factory=now)
    end: datetime = field(default_factory=now)


@dataclass
class Run:
    """One job: collects outcomes and writes the system tables once, at its end."""

    spark: SparkSession
    config: Config
    job_name: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    start: datetime = field(default_factory=now)
    outcomes: list[Outcome] = field(default_factory=list)
    errors: list[tuple] = field(default_factory=list)
    lineage: list[tuple] = field(default_factory=list)
    dq: list[tuple] = field(default_factory=list)

    def failed(self, source: str, target: str, error: Exception, start: datetime) -> None:
        """Record a failure; the caller goes on with the next source."""
        self.errors.append((self.run_id, source, f"{type(error).__name__}: {error}"[:4000], now(), self.config.environment))
        self.outcomes.append(Outcome(target, FAILED, status=FAILED, start=start, end=now()))

    def done(self, source: str, source_path: str, target_path: str, outcome: Outcome) -> None:
        outcome.end = now()
        self.outcomes.append(outcome)
        self.lineage.append((self.run_id, source, source_path, target_path, outcome.start, outcome.end, self.config.environment, outcome.load_type))

    def rejected(self, source: str, entity: str, rule: str, rows: int) -> None:
        if rows:
            self.dq.append((self.run_id, source, entity, rule, rows, now()))

    @property
    def status(self) -> str:
        return FAILED if any(o.status == FAILED for o in self.outcomes) else SUCCESS

    def _audit_row(self, o: Outcome) -> tuple:
        return (self.run_id, self.job_name, o.target, o.start, o.end, (o.end - o.start).total_seconds(), o.incoming, o.inserted, o.conflicted, self.config.environment, o.status, o.load_type)

    def finish(self) -> str:
        """Write a row for each outcome and a summary; errors, lineage and rejects beside them.  Returns the status."""
        total = Outcome("JOB_SUMMARY", "SUMMARY", *(sum(getattr(o, k) for o in self.outcomes) for k in ("incoming", "inserted", "conflicted")), self.status, self.start, now())
        rows = {"audit": [self._audit_row(o) for o in [*self.outcomes, total]], "error": self.errors, "lineage": self.lineage, "dq": self.dq}
        for name, found in rows.items():
            if found:
                Table(self.spark, self.config.path("system", name)).append(self.spark.createDataFrame(found, SYSTEM[name]).coalesce(1))
        return self.status
