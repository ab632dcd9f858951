"""Which ids of a table are taken: a ledger of leased ranges beside it.

An append without ids leases a range before it writes and gives the unused rest back
afterwards, so it never reads the table, and appends that run at the same time write into
different ranges.  Leases are numbered files that are published once
(:mod:`.shared_files`); lease n starts where lease n - 1 ends, so only the newest one is read.
Inside a range a row's id is its task's number and its place in the task.

A writer that dies keeps its whole range: its ids are lost, never given out again.  There is
room for 8,192 such or simultaneous leases of ``RESERVE`` ids, and for any number of closed
ones.  Ids that callers bring themselves raise the start of later leases before they are
written; callers who bring ids while leases are open must keep clear of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .shared_files import Sequence

#: Ids of an open lease: 2^17 tasks of 2^33 rows.
RESERVE = 1 << 50
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Lease:
    number: int
    start: int


class Ledger:
    def __init__(self, spark: SparkSession, table: str):
        folder = table.rstrip("/") + "_ids"
        self.leases, self.ends = Sequence(spark, folder, "lease"), Sequence(spark, folder, "end")

    def _next(self) -> tuple[int, int]:
        """Number and least start of the next lease."""
        n = self.leases.last()
        if n < 0:
            return 0, 0
        if self.ends.has(n):
            return n + 1, self.ends.read(n)["end"]
        return n + 1, self.leases.read(n)["start"] + RESERVE

    def lease(self, least: int = 0) -> Lease:
        """A range of ``RESERVE`` ids from ``least`` on that nobody else has or will get."""
        while True:
            n, start = self._next()
            start = max(start, least)
            if start > LAST_ID - RESERVE:
                raise RuntimeError("no ids left in the ledger")
            if self.leases.offer(n, {"start": start}):
                return Lease(n, start)

    def close(self, lease: Lease, end: int) -> None:
        """Give back what lies from ``end`` on (a lease is closed once)."""
        if not lease.start <= end <= lease.start + RESERVE:
            raise ValueError("a lease ends inside its range")
        self.ends.offer(lease.number, {"end": end})

    def lease_of_batch(self, checkpoint: str, batch: int, least: int = 0) -> Lease:
        """The lease of a stream's batch: the same one each time the batch is repeated.  Which one
        it is lies beside the stream's checkpoint; one that was leased but not noted is lost."""
        noted = Sequence(self.leases.spark, checkpoint.rstrip("/") + "_leases", "batch")
        if not noted.has(batch):
            lease = self.lease(least)
            noted.offer(batch, {"number": lease.number, "start": lease.start})
        found = noted.read(batch)
        return Lease(found["number"], found["start"])
