"""Debounced changes, re-scan of what changed, and the latest state per path."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.paths import Matcher, WatchFilter
from ..operators.extract import analyze
from ..operators.store import Store, latest_by
from ..sources.files import changes, listed


def debounce(events: DataFrame, gap: str = "100 milliseconds", watermark: str | None = None) -> DataFrame:
    """(path, first_ts, last_ts, events): bursts on a path with gaps below ``gap`` are one.

    Sessions end after a quiet gap; the watermark, for streams, is this
    engine's own addition.
    """
    d = events.withWatermark("ts", watermark) if watermark else events
    s = d.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    return s.drop("w")


def accepted(events: DataFrame, watch: WatchFilter | None = None, extra: Column | None = None) -> DataFrame:
    """The filter stands before any state."""
    d = events.where((watch or WatchFilter()).accepts(F.col("path")))
    return d.where(extra) if extra is not None else d


def rescan(spark: SparkSession, changed: DataFrame, matcher: Matcher | None = None, registry: DataFrame | None = None) -> DataFrame:
    """Analysed rows of the changed paths (path, deleted), with ``deleted`` for those that are gone.

    A batch's paths are what one trigger found, which the source bounds.
    """
    once = changed.groupBy("path").agg(F.max_by("deleted", "ts").alias("deleted"))
    paths = [r[0] for r in once.where("NOT deleted").select("path").toLocalIterator()]
    files = listed(spark, paths)
    there = F.col("content").isNotNull() | F.col("error").isNotNull()
    rows = analyze(files.where(there), matcher, registry).withColumn("deleted", F.lit(False))
    lost = files.where(~there).select("path").union(once.where("deleted").select("path"))
    return rows.unionByName(lost.withColumn("deleted", F.lit(True)), allowMissingColumns=True)


def follow(
    spark: SparkSession,
    root: str,
    store: Store,
    checkpoint: str,
    *,
    watch: WatchFilter | None = None,
    matcher: Matcher | None = None,
    registry: DataFrame | None = None,
    on_update: Callable[[Store], None] | None = None,
    interval: str | None = None,
    max_files: int = 1000,
    quiet_ms: int = 0,
    skip_dirs: tuple[str, ...] = (),
) -> StreamingQuery:
    """Keep ``store`` at the latest state of every file below ``root``.

    Without ``interval`` it takes in what is there and ends; the same
    checkpoint goes on from there later.  Each micro-batch is taken in once,
    whatever is retried.  Bursts of changes to a file end ``quiet_ms`` after
    the last; only then it is read.  Snapshots of the tree lie beside a
    checkpoint that is a folder of this machine, as the tree is; beside any
    other the offsets hold them.
    """
    state_dir = "" if "://" in checkpoint else checkpoint.removeprefix("file:").rstrip("/") + ".snapshots"
    events = changes(spark, root, state_dir=state_dir, skip_dirs=skip_dirs, max_files=max_files, quiet_ms=quiet_ms)
    events = accepted(events, watch)

    def take(batch: DataFrame, number: int) -> None:
        if number <= store.batch():
            return
        store.upsert(rescan(batch.sparkSession, batch, matcher, registry), deleted="deleted", batch=number)
        if on_update:
            on_update(store)

    w = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


STATE = "status string"
CHANGES = "path string, old_status string, new_status string"


def _changed(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
    old = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    new = rows["status"].iloc[-1]
    state.update((new,))
    if new != old:
        yield pd.DataFrame({"path": [key[0]], "old_status": [old], "new_status": [new]})


def status_changes(updates: DataFrame) -> DataFrame:
    """Stream of (path, old_status, new_status) from a stream (path, ts, status): state is one status per path."""
    return updates.groupBy("path").applyInPandasWithState(_changed, CHANGES, STATE, "update", "NoTimeout")


def latest_status(updates: DataFrame) -> DataFrame:
    """Batch twin of the stream's state."""
    return latest_by(updates, "path", "ts")


class ScanProgress(StreamingQueryListener):
    """Files a stream has taken in so far; ``say`` hears of every ``each`` of them."""

    def __init__(self, say: Callable[[str], None] = print, each: int = 100):
        self.say, self.each, self.scanned = say, each, 0

    def onQueryStarted(self, event) -> None:
        self.say("scan started")

    def onQueryProgress(self, event) -> None:
        before = self.scanned
        self.scanned += event.progress.numInputRows
        if self.scanned // self.each > before // self.each:
            self.say(f"{self.scanned} files scanned")

    def onQueryTerminated(self, event) -> None:
        self.say(f"scan complete: {self.scanned} files")


def restart(query: StreamingQuery, again: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Stop a query and start the one for another root."""
    query.stop()
    return again()
