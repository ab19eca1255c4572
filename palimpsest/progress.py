"""Progress of runs: counts observed while rows pass by, in batches and streams, and one line a page for the log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .functions import display
from .operators.state import DONE


def counts() -> list[Column]:
    """What is counted of pages (status, estimated_cost): in one pass, without a job of its own."""
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    return [F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status").isin(*DONE)).alias("done"), *map(of, ("complete", "extracted", "skipped", "failed", "pending")), F.round(F.sum(F.coalesce("estimated_cost", F.lit(0.0))), 4).alias("cost")]


def observed(pages: DataFrame, name: str = "pages") -> tuple[DataFrame, Observation]:
    """``pages``, and the counts that are known once an action over them has ended (``observation.get``).

    To be written as they are: a global sort behind it would read, and count, them twice."""
    seen = Observation(name)
    return pages.observe(seen, *counts()), seen


def observed_stream(pages: DataFrame, name: str = "pages") -> DataFrame:
    """The same for a stream: each micro-batch reports its counts to listeners."""
    return pages.observe(name, *counts())


def page_line(path: str = "path", index: str = "page_index") -> Column:
    """``path page_0001: complete, 97 %, $0.0050`` or with the error."""
    sure = F.when(F.col("confidence").isNotNull(), F.concat(F.lit(", "), F.round(F.col("confidence") * 100).cast("int"), F.lit(" %"))).otherwise("")
    cost = F.when(F.coalesce("estimated_cost", F.lit(0.0)) > 0, F.concat(F.lit(", $"), F.format_string("%.4f", "estimated_cost"))).otherwise("")
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit(": "), F.col("error"))).otherwise("")
    return F.concat(F.col(path), F.lit(" "), display.page_label(F.col(index)), F.lit(": "), F.col("status"), sure, cost, why)


class ProgressLog(StreamingQueryListener):
    """Adds up what a stream's micro-batches report under ``name``; ``say`` (a function of text) is called for each.

    Register with ``spark.streams.addListener``. A micro-batch counts once, however often its progress is told."""

    def __init__(self, name: str = "pages", say=None):
        self.name, self.say = name, say
        self.batches: dict[tuple[str, int], dict] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        """Nothing is counted before the first micro-batch."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is None:
            return
        self.batches[str(p.id), p.batchId] = seen.asDict()
        if self.say:
            self.say(json.dumps({"batch": p.batchId, "rows": p.numInputRows, **seen.asDict()}))

    def onQueryIdle(self, event) -> None:
        """An idle stream has made no progress."""

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))

    def total(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for seen in self.batches.values():
            for k, v in seen.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out
