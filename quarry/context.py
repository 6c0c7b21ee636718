"""Context for a task or a node, assembled from searches, traversal and notes, and a bounded session memory."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import estimate_tokens


class SessionMemory:
    """A small in-process key-value memory; when full, the oldest key goes, also if a known key is written anew."""

    def __init__(self, most: int = 100):
        self.most, self.entries = most, OrderedDict()

    def remember(self, key: str, value: str, source: str = "agent") -> None:
        if len(self.entries) >= self.most:
            self.entries.popitem(last=False)
        self.entries[key] = {"value": value, "source": source, "at": time.time()}
        self.entries.move_to_end(key)

    def recall(self, key: str) -> dict | None:
        return self.entries.get(key)

    def search(self, text: str) -> list[tuple[str, dict]]:
        low = text.lower()
        return [(k, e) for k, e in self.entries.items() if low in k.lower() or low in e["value"].lower()]

    def all(self) -> list[tuple[str, dict]]:
        return list(self.entries.items())

    def clear(self) -> None:
        self.entries.clear()


def within_budget(parts: DataFrame, max_tokens: int) -> DataFrame:
    """The parts (section, position, text) of a context that fit into ``max_tokens`` tokens, in order.

    The number of parts is that of a few top-k lists, so one window over them is small.
    """
    sized = parts.withColumn("tokens", estimate_tokens(F.coalesce("text", F.lit(""))))
    order = Window.orderBy("section", "position", "text").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= max_tokens)


def edit_context(node: DataFrame, callers: DataFrame, callees: DataFrame, notes: DataFrame | None = None, most_notes: int = 10) -> DataFrame:
    """(section, position, text): a node, who calls it, whom it calls, and notes that name it."""
    line = F.concat_ws(" ", "kind", "qualified_name", "file_path")
    one = lambda df, section: df.select(F.lit(section).alias("section"), F.col("id").alias("position"), line.alias("text"))
    out = one(node, "1 node").unionByName(one(callers, "2 callers")).unionByName(one(callees, "3 callees"))
    if notes is not None:
        out = out.unionByName(notes.limit(most_notes).select(F.lit("4 notes").alias("section"), F.col("id").alias("position"), F.col("content").alias("text")))
    return out
