"""Limits of a query: what it may ask for, and what it may cost."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from dataclasses import dataclass

from ..errors import BudgetExceeded


@dataclass(frozen=True)
class Governor:
    max_rows: int = 100_000
    max_scan: int | None = None
    max_depth: int = 64
    seconds: float | None = None
    max_expansion: int | None = None  # terms that a prefix of a text query may stand for

    def clamp(self, n: int) -> int:
        return min(n, self.max_rows)

    def check_depth(self, hops: int) -> None:
        if hops > self.max_depth:
            raise BudgetExceeded(f"{hops} hops; {self.max_depth} are allowed")

    def check_scan(self, frame) -> None:
        """Refuse a scan of more rows than allowed; a count of a Parquet table reads footers only."""
        if self.max_scan is not None and frame.limit(self.max_scan + 1).count() > self.max_scan:
            raise BudgetExceeded(f"the scan would pass {self.max_scan} objects")

    def collect(self, df) -> list:
        """Rows of a result, refused if they are too many, cancelled if they take too long."""
        with self.deadline(df.sparkSession):
            rows = df.limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise BudgetExceeded(f"the result has more than {self.max_rows} rows")
        return rows

    @contextmanager
    def deadline(self, spark):
        if self.seconds is None:
            yield
            return
        sc, tag, late = spark.sparkContext, f"skein-{id(self)}-{threading.get_ident()}", threading.Event()

        def stop():
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.seconds, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            yield
        except Exception as e:
            if late.is_set():
                raise BudgetExceeded(f"the query took more than {self.seconds} s") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
