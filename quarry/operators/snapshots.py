"""Differences between consecutive full snapshots of a table.

The snapshots are sorted by key and cut into content-defined chunks: a chunk begins at every
key whose hash is 0 modulo ``chunk_rows``, so the cut depends only on the key and an insertion
moves the borders of its own chunk alone. A chunk's digest combines the hashes of its rows.
Chunks whose digest occurs at the same border in both snapshots are equal row by row and are
discarded; only rows of unmatched chunks are joined and classified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.tables import partitions, slashed

CHUNK_ROWS = 16


def latest_rows(rows: DataFrame) -> DataFrame:
    """One row per (project_id, snapshot_no, qualified_name): that of the latest ``delivered_at``.

    Equal delivery times are decided by the greatest (content_hash, file_path); a null time is the earliest.
    Rows without a name, project or snapshot number name no record and are left out.
    The rows are partitioned by ranges of (project_id, qualified_name), so a project of any size is
    spread over many tasks, and all snapshots of a record meet without a further shuffle.
    """
    slim = rows.where("project_id is not null and snapshot_no is not null and qualified_name is not null").select(
        "project_id", "qualified_name", F.col("snapshot_no").cast("int").alias("snapshot_no"), "delivered_at",
        F.lower("content_hash").alias("content_hash"), slashed(F.col("file_path")).alias("file_path"),
    )
    ranged = slim.repartitionByRange(partitions(rows), "project_id", "qualified_name")
    best = F.max(F.struct("delivered_at", "content_hash", "file_path")).alias("best")
    return ranged.groupBy("project_id", "qualified_name", "snapshot_no").agg(best).select(
        "project_id", "snapshot_no", "qualified_name", "best.content_hash", "best.file_path"
    )


def complete_pairs(deliveries: DataFrame) -> DataFrame:
    """(project_id, previous_no, snapshot_no) of consecutive complete deliveries. A project has few deliveries."""
    numbers = F.array_sort(F.collect_set(F.col("snapshot_no").cast("int")))
    lists = deliveries.where("status = 'complete' and project_id is not null").groupBy("project_id").agg(numbers.alias("nos"))
    pairs = F.expr("arrays_zip(slice(nos, 1, size(nos) - 1), slice(nos, 2, size(nos) - 1))")
    return lists.where("size(nos) > 1").select("project_id", F.explode(pairs).alias("p")).select(
        "project_id", F.col("p")["0"].alias("previous_no"), F.col("p")["1"].alias("snapshot_no")
    )


def _carry_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill ``chunk`` of rows sorted by (project_id, snapshot_no, qualified_name) with the last border at or before the row."""
    last_key, last_border = None, ""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = pc.binary_join_element_wise(batch["project_id"].cast("string"), batch["snapshot_no"].cast("string"), ":")
        previous = pa.concat_arrays([pa.array([last_key], pa.string()), group[:-1]])
        starts = pc.fill_null(pc.not_equal(group, previous), True)
        border = pc.if_else(batch["is_border"], batch["qualified_name"], pc.if_else(starts, pa.scalar(""), pa.scalar(None, pa.string())))
        filled = pc.fill_null(pc.fill_null_forward(border), last_border)
        last_key, last_border = group[-1].as_py(), filled[-1].as_py()
        columns = {name: batch[name] for name in ("project_id", "snapshot_no", "qualified_name", "content_hash", "file_path")}
        yield pa.RecordBatch.from_pydict(columns | {"chunk": filled})


def _digests(*parts: Column) -> list[Column]:
    present = [x for p in parts for x in (p.isNull(), F.coalesce(p, F.lit("")))]
    return [F.xxhash64(*present), F.xxhash64(F.lit(7), *present)]


def chunked(latest: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``latest`` with ``chunk`` and the partition-independent range part ``part`` of each row.

    Within one range partition every snapshot is cut at the same keys: at its borders and at the
    partition's first key (chunk ''), so chunks of any two snapshots can be compared by name.
    """
    flagged = latest.withColumn("is_border", F.pmod(F.xxhash64("qualified_name"), F.lit(chunk_rows)) == 0)
    ordered = flagged.sortWithinPartitions("project_id", "snapshot_no", "qualified_name")
    schema = T.StructType([*latest.schema.fields, T.StructField("chunk", T.StringType())])
    cut = ordered.mapInArrow(_carry_borders, schema)
    first, second = _digests(F.col("qualified_name"), F.col("content_hash"), F.col("file_path"))
    return cut.select("*", F.spark_partition_id().alias("part"), first.alias("h1"), second.alias("h2"))


def snapshot_changes(rows: DataFrame, deliveries: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(project_id, snapshot_no, qualified_name, change) between consecutive complete deliveries of each project.

    ``change`` is ``added``, ``removed`` or ``changed`` (content_hash or file_path differ; null equals null
    and nothing else; letter case of the hash and the kind of path separator do not count).
    Only deliveries whose status is ``complete`` are compared, each with the previous complete one of its
    project; empty tables give no rows, extra columns are ignored.
    """
    from quarry.session import stored

    pairs = complete_pairs(deliveries)
    ends = F.explode(F.array("snapshot_no", "previous_no")).alias("snapshot_no")
    # Deliveries that are compared with none are left out before anything is shuffled.
    used = rows.join(pairs.select("project_id", ends).distinct(), ["project_id", "snapshot_no"], "left_semi")
    named = chunked(latest_rows(used), chunk_rows)
    # The range borders are sampled, so the cut rows are written once and both uses read the same cut.
    cut = stored(named)
    sums = cut.groupBy("project_id", "part", "chunk", "snapshot_no").agg(
        F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"), F.count("*").alias("n")
    )
    sided = F.array(
        F.struct(F.col("snapshot_no").alias("at"), F.lit(1).alias("side")),
        F.struct(F.col("previous_no").alias("at"), F.lit(0).alias("side")),
    )
    sides = pairs.select("project_id", F.col("snapshot_no").alias("pair_no"), F.explode(sided).alias("s")).select(
        "project_id", "pair_no", F.col("s.at").alias("snapshot_no"), F.col("s.side").alias("side")
    )
    paired = sums.join(sides, ["project_id", "snapshot_no"])
    unmatched = paired.groupBy("project_id", "part", "chunk", "pair_no").agg(
        F.count("*").alias("sides"), F.min("d1").alias("a1"), F.max("d1").alias("b1"),
        F.min("d2").alias("a2"), F.max("d2").alias("b2"), F.min("n").alias("an"), F.max("n").alias("bn"),
    ).where("sides = 1 or a1 <> b1 or a2 <> b2 or an <> bn").select("project_id", "part", "chunk", "pair_no")
    left = cut.join(sides, ["project_id", "snapshot_no"]).join(unmatched, ["project_id", "part", "chunk", "pair_no"], "left_semi")
    value = F.struct("content_hash", "file_path")
    both = left.groupBy("project_id", "pair_no", "qualified_name").agg(
        F.max(F.when(F.col("side") == 1, value)).alias("new"), F.max(F.when(F.col("side") == 0, value)).alias("old")
    )
    differs = ~(F.col("new.content_hash").eqNullSafe(F.col("old.content_hash")) & F.col("new.file_path").eqNullSafe(F.col("old.file_path")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs, "changed")
    return both.select("project_id", F.col("pair_no").alias("snapshot_no"), "qualified_name", change.alias("change")).where("change is not null")
