"""Counters and latency histograms of detection: as an aggregation, as observations of a running job, and of streams by a listener.

All three give the same rows (metric, labels, value), cumulative in the histogram's bounds as scrapers expect them.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# fixed values: upper bounds of the latency histogram in seconds
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
RISKS = ("low", "medium", "high")
COUNT, DURATION = "detection_total", "detection_duration_seconds"


def _values(seconds: Column) -> dict[str, Column]:
    """What is counted of detections with ``is_fake`` and ``risk_level``; a name says metric and labels."""
    fake, risk = F.col("is_fake"), F.col("risk_level")
    out = {f"{COUNT}|{str(f).lower()}|{r}": F.count_if((fake == f) & (risk == r)) for f in (False, True) for r in RISKS}
    out |= {f"{DURATION}_bucket|{b}": F.count_if(seconds <= b) for b in BOUNDS}
    out[f"{DURATION}_bucket|+Inf"] = F.count(seconds)
    out[f"{DURATION}_count"] = F.count(seconds)
    # whole microseconds: the sum does not hang on the order of adding
    out[f"{DURATION}_us"] = F.coalesce(F.sum(F.round(seconds * 1_000_000).cast("long")), F.lit(0))
    return out


def rows_of(values: dict[str, int]) -> list[tuple[str, dict[str, str], float]]:
    """(metric, labels, value) of the numbers behind ``_values``; counters without an event are left out, as they have not been seen."""
    out = []
    for name, v in values.items():
        metric, *labels = name.split("|")
        if metric == COUNT:
            if v:
                out.append((metric, {"is_fake": labels[0], "risk_level": labels[1]}, float(v)))
        elif metric == f"{DURATION}_us":
            out.append((f"{DURATION}_sum", {}, v / 1_000_000))
        else:
            out.append((metric, {"le": labels[0]} if labels else {}, float(v)))
    return out


def _seconds(ms: str) -> Column:
    return F.col(ms).cast("double") / 1000


def detection_metrics(df: DataFrame, ms: str = "processing_time_ms") -> DataFrame:
    """Rows (metric, labels, value) of detections (is_fake, risk_level, processing time): one aggregation to one row, turned on its side. Null risks and times are not counted."""
    values = _values(_seconds(ms))
    one = df.agg(*[v.cast("long").alias(k) for k, v in values.items()])
    cells = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.col(f"`{k}`") for k in values]))).alias("k", "v")
    part = F.split("k", "[|]")
    metric, us = part[0], F.col("k") == f"{DURATION}_us"
    labels = F.when(metric == COUNT, F.create_map(F.lit("is_fake"), F.get(part, F.lit(1)), F.lit("risk_level"), F.get(part, F.lit(2)))).when(F.size(part) == 2, F.create_map(F.lit("le"), F.get(part, F.lit(1)))).otherwise(F.create_map().cast("map<string,string>"))
    out = one.select(cells).where(~F.col("k").startswith(COUNT) | (F.col("v") > 0))
    return out.select(F.when(us, f"{DURATION}_sum").otherwise(metric).alias("metric"), labels.alias("labels"), F.when(us, F.col("v") / 1_000_000).otherwise(F.col("v").cast("double")).alias("value"))


def observed(df: DataFrame, ms: str = "processing_time_ms") -> tuple[DataFrame, Observation]:
    """``df`` and an observation that any action on it fills on the way, at no further pass; ``rows_of(observation.get)`` are its metrics."""
    seen = Observation()
    return df.observe(seen, *[v.cast("long").alias(k) for k, v in _values(_seconds(ms)).items()]), seen


def watched(df: DataFrame, ms: str = "processing_time_ms", name: str = "detections") -> DataFrame:
    """A streaming ``df`` whose batches report to a ``StreamMetrics`` of the same ``name``."""
    return df.observe(name, *[v.cast("long").alias(k) for k, v in _values(_seconds(ms)).items()])


class StreamMetrics(StreamingQueryListener):
    """Adds up what ``watched`` reports of every batch, and counts batches, rows and failures of the queries it sees.

    Register it with ``spark.streams.addListener``. Numbers are of this driver's life, as those of a process are; a batch that
    is done again after a restart counts again.
    """

    def __init__(self, name: str = "detections"):
        self.name, self.lock = name, threading.Lock()
        self.values: dict[str, int] = {}
        self.batches = self.input_rows = self.failures = 0
        self.batch_ms: list[int] = [0] * (len(BOUNDS) + 1)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        got = p.observedMetrics.get(self.name)
        with self.lock:
            self.batches += 1
            self.input_rows += int(p.numInputRows or 0)
            seconds = (p.batchDuration or 0) / 1000
            self.batch_ms[next((i for i, b in enumerate(BOUNDS) if seconds <= b), len(BOUNDS))] += 1
            for k, v in (got.asDict() if got is not None else {}).items():
                self.values[k] = self.values.get(k, 0) + int(v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            with self.lock:
                self.failures += 1

    def rows(self) -> list[tuple[str, dict[str, str], float]]:
        with self.lock:
            out = rows_of(self.values)
            total = 0
            for b, n in zip((*map(str, BOUNDS), "+Inf"), self.batch_ms, strict=True):
                total += n
                out.append(("batch_duration_seconds_bucket", {"le": b}, float(total)))
            return [*out, ("batches_total", {}, float(self.batches)), ("input_rows_total", {}, float(self.input_rows)), ("query_failures_total", {}, float(self.failures))]


def exposition(rows: list[tuple[str, dict[str, str], float]]) -> str:
    """The rows as the text that scrapers read."""
    line = lambda m, labels, v: m + ("{" + ",".join(f'{k}="{x}"' for k, x in sorted(labels.items())) + "}" if labels else "") + f" {v}"
    return "".join(line(*r) + "\n" for r in rows)


def as_table(spark: SparkSession, rows: list[tuple[str, dict[str, str], float]]) -> DataFrame:
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, value double")
