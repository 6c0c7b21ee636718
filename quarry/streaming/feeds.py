"""Streams of accesses and file states: windowed activity, counters, deduplicated change feeds, refresh by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.extract import state_diff
from quarry.store import Store


def access_counts(access: DataFrame) -> DataFrame:
    """(node_id, accesses, last_access) over a stream of (node_id, ts); for update or complete mode."""
    return access.groupBy("node_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


def activity(access: DataFrame, length: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, end, node_id, accesses) of sliding windows; rows later than ``late`` are left out once their window has closed."""
    windowed = access.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "node_id").agg(F.count("*").alias("accesses"))
    return windowed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "node_id", "accesses")


def sessions(access: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, node_id, accesses) of runs of accesses without a pause of ``gap``."""
    grouped = access.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "node_id").agg(F.count("*").alias("accesses"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "node_id", "accesses")


def distinct_changes(changes: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A change feed with repeated deliveries of a key within the watermark left out."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def recent_notes(notes: DataFrame, most: int = 100) -> DataFrame:
    """(owner, key, value, size) after each new value: a bounded memory of each owner, the oldest key goes first.

    ``notes`` has (owner, key, value, ts).
    """

    def remember(owner: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, values = (list(x) for x in state.get) if state.exists else ([], [])
        rows = []
        for pdf in frames:
            for row in pdf.sort_values("ts").itertuples():
                if row.key in keys:
                    at = keys.index(row.key)
                    del keys[at], values[at]
                elif len(keys) >= most:
                    del keys[0], values[0]
                keys.append(row.key)
                values.append(row.value)
                rows.append((owner[0], row.key, row.value, len(keys)))
        state.update((keys, values))
        yield pd.DataFrame(rows, columns=["owner", "key", "value", "size"])

    return notes.groupBy("owner").applyInPandasWithState(remember, "owner string, key string, value string, size int", "keys array<string>, vals array<string>", "append", GroupStateTimeout.NoTimeout)


def refresh_states(stream: DataFrame, store: Store, table: str = "file_states", checkpoint: str | None = None) -> StreamingQuery:
    """Merge a stream of (project_id, file_path, content_hash) into a stored table; changes go to ``<table>_changes``.

    A micro-batch that is replayed after a failure finds its rows merged and changes nothing more.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["project_id", "file_path"]).select("project_id", "file_path", "content_hash")
        if store.exists(table):
            known = store.read(table).join(rows.select("project_id", "file_path"), ["project_id", "file_path"], "left_semi")
        else:
            known = rows.limit(0)
        moved = state_diff(known, rows).where("status in ('new', 'changed')").withColumn("batch", F.lit(number))
        store.append(f"{table}_changes", moved)
        store.upsert(table, rows, ["project_id", "file_path"])

    writer = stream.writeStream.foreachBatch(merge).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
