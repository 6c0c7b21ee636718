"""Source files that do not parse: the least syntax repair of each file, and rates per project and language.

Every file is lexed and its bracket spans parsed from the inside out against the grammar of its language
(``quarry.llm.syntax``). A file whose repair costs nothing is valid. The chart is filled by levels of cost:
level 0 alone tells whether the cost is above 0; with ``located`` the levels up to the least cost are filled,
and where its edits lie tells truncation, merge conflict and wrong language apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "file_id long, project_id long, language string, broken boolean, edits int, cause string"


def _checked(batches: Iterator[pa.RecordBatch], located: bool) -> Iterator[pa.RecordBatch]:
    from quarry.llm.syntax.parse import check, language_of

    for batch in batches:
        languages, costs, causes = [], [], []
        for path, stated, source in zip(batch["file_path"].to_pylist(), batch["language"].to_pylist(), batch["source"].to_pylist(), strict=True):
            language = language_of(path, stated)
            result = check(source, language)
            if result.cost and located:
                result = check(source, language, thorough=True)
            languages.append(language)
            costs.append(result.cost)
            causes.append(result.cause if located else None)
        yield pa.RecordBatch.from_arrays(
            [batch["file_id"], batch["project_id"], pa.array(languages, pa.string()), pa.array([c > 0 for c in costs]), pa.array(costs if located else [None] * len(costs), pa.int32()), pa.array(causes, pa.string())],
            ["file_id", "project_id", "language", "broken", "edits", "cause"],
        )


def checked_files(files: DataFrame, located: bool = False) -> DataFrame:
    """(file_id, project_id, language, broken, edits, cause), one row per distinct result of a file.

    A null language is that of the extension; a language without a grammar, a null or empty source and a
    file of comments only are valid. ``edits`` and ``cause`` are null unless ``located``; then ``edits`` is the
    least cost of a repair and ``cause`` one of ``truncation``, ``conflict``, ``mismatch`` and ``damage``. Rows
    with a null id are left out. No row depends on another.
    """
    rows = files.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("project_id").cast("long").alias("project_id"), "file_path", "language", "source")
    return rows.mapInArrow(lambda batches: _checked(batches, located), _SCHEMA).distinct()


def broken_rates(checked: DataFrame) -> DataFrame:
    """(project_id, language, files, broken, rate, truncated, conflicted, mismatched) of the checked files."""
    cause = lambda name: F.sum(F.when(F.col("cause") == name, 1).otherwise(0)).alias
    rates = checked.groupBy("project_id", "language").agg(
        F.count("*").alias("files"), F.sum(F.col("broken").cast("long")).alias("broken"),
        cause("truncation")("truncated"), cause("conflict")("conflicted"), cause("mismatch")("mismatched"),
    )
    return rates.select("project_id", "language", "files", "broken", (F.col("broken") / F.col("files")).alias("rate"), "truncated", "conflicted", "mismatched")
