"""Progress of a run told to listeners, from rows that are bounded by the number of checks and kinds of issues."""

from __future__ import annotations

import logging
from collections.abc import Callable
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import constants as K
from docloom.plans import report


class Verbosity(IntEnum):
    QUIET, NORMAL, VERBOSE, DEBUG = range(4)


class Listener:
    """Nothing is told; others override what they want to hear."""

    def started(self, documents: int) -> None: ...

    def check(self, name: str, number: int, of: int) -> None: ...

    def group(self, kind: str, label: str, n: int, pages: str) -> None: ...

    def issue(self, text: str) -> None: ...

    def fixed(self, kind: str, n: int) -> None: ...

    def failed(self, kind: str, n: int) -> None: ...

    def finished(self, detected: int, resolved: int, remaining: int) -> None: ...


class Logged(Listener):
    def __init__(self, logger: logging.Logger | None = None):
        self.log = logger or logging.getLogger("docloom")

    def started(self, documents: int) -> None:
        self.log.info("documents=%d", documents)

    def check(self, name: str, number: int, of: int) -> None:
        self.log.debug("check=%s number=%d of=%d", name, number, of)

    def group(self, kind: str, label: str, n: int, pages: str) -> None:
        self.log.info("type=%s n=%d pages=%s", kind, n, pages)

    def issue(self, text: str) -> None:
        self.log.debug("issue %s", text)

    def fixed(self, kind: str, n: int) -> None:
        self.log.info("fix=%s n=%d", kind, n)

    def failed(self, kind: str, n: int) -> None:
        self.log.warning("fix=%s failed=%d", kind, n)

    def finished(self, detected: int, resolved: int, remaining: int) -> None:
        self.log.info("detected=%d resolved=%d remaining=%d", detected, resolved, remaining)


class Console(Listener):
    """Boxes of text, a check each; at lower verbosity checks that found nothing aren't shown."""

    def __init__(self, write: Callable[[str], None] = print, verbosity: Verbosity = Verbosity.NORMAL, width: int = 80):
        self.write, self.verbosity, self.width = write, verbosity, width
        self.held: list[str] = []
        self.title = ""

    def _flush(self) -> None:
        if self.title and (self.held or self.verbosity >= Verbosity.VERBOSE) and self.verbosity > Verbosity.QUIET:
            self.write(f"┌─ {self.title} {'─' * max(0, self.width - len(self.title) - 4)}")
            for line in self.held:
                self.write(f"│ {line}")
            self.write("└" + "─" * (self.width - 1))
        self.held, self.title = [], ""

    def check(self, name: str, number: int, of: int) -> None:
        self._flush()
        self.title = f"{name} ({number}/{of})"

    def group(self, kind: str, label: str, n: int, pages: str) -> None:
        self.held.append(f"✗ {n} {label}" + (f" (p. {pages})" if pages else ""))

    def issue(self, text: str) -> None:
        if self.verbosity >= Verbosity.VERBOSE:
            self.held.append(f"  {text}")

    def fixed(self, kind: str, n: int) -> None:
        self.held.append(f"✓ {n} by {kind}")

    def failed(self, kind: str, n: int) -> None:
        self.held.append(f"! {n} failed: {kind}")

    def finished(self, detected: int, resolved: int, remaining: int) -> None:
        self._flush()
        self.write(f"{detected} issues, {resolved} resolved, {remaining} remaining")


def tell(issues: DataFrame, names: list[str], listener: Listener, verbosity: Verbosity = Verbosity.NORMAL) -> None:
    """A run's issues (with status) to a listener, check by check.

    What is collected is a row a check, kind and status. Single issues are told from verbosity
    VERBOSE on, of groups too small to be shown as one line.
    """
    done = F.col("status").isin("resolved", "superseded")
    pages = report.exprs.page_range(F.collect_set(F.when(F.col("page") > 0, F.col("page"))))
    g = issues.groupBy("check_ord", "type", "fix_kind").agg(F.count("*").alias("n"), F.count_if(done).alias("fixed"), F.count_if(F.col("status") == "failed").alias("failed"), pages.alias("pages"), F.min("seq").alias("seq"))
    rows = g.orderBy("check_ord", "seq", "type").collect()
    listener.started(issues.select("doc_id").distinct().count())
    few = issues.select("*", report.message().alias("says"), report.location().alias("where")) if verbosity >= Verbosity.VERBOSE else None
    for i, name in enumerate(names):
        listener.check(name, i + 1, len(names))
        for r in (r for r in rows if r.check_ord == i):
            listener.group(r.type, K.LABELS.get(r.type, r.type), r.n, r.pages if len(r.pages) < 200 else "")
            if few is not None and r.n < report.GROUP_FROM:
                for x in few.where((F.col("check_ord") == i) & (F.col("type") == r.type)).orderBy("doc_id", "seq").collect():
                    listener.issue(f"{x.says}{x['where']}")
            if r.fixed:
                listener.fixed(r.fix_kind, r.fixed)
            if r.failed:
                listener.failed(r.fix_kind, r.failed)
    total = issues.agg(F.count("*").alias("n"), F.count_if(done).alias("done")).first()
    listener.finished(total.n, total.done, total.n - total.done)
