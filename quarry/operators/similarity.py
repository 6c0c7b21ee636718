"""Code similarity: normalised text, MinHash signatures, LSH candidates and the composite score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHES, BANDS, ROWS = 100, 20, 5
#: Bits of each value in a sketch; classes of one band beyond which they meet in blocks; numbers of the table that tells whose signatures are moved.
PLANES, LONGEST, SIEVE = 2, 10_000, 1 << 21
#: Runs of more rows are compared as tiles of a matrix.
WIDE, TILE = 64, 128


def normalize_code(source: Column) -> Column:
    """The text without comment lines (``//`` or ``#``) and without white space."""
    lines = F.filter(F.transform(F.split(source, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " "))), lambda x: ~x.startswith("//") & ~x.startswith("#"))
    return F.regexp_replace(F.array_join(lines, ""), r"\s", "")


def char_shingles(text: Column, size: int = 3) -> Column:
    """The distinct runs of ``size`` characters; none for a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _minima(text: str | None, size: int = 3, hashes: int = HASHES) -> np.ndarray | None:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < size:
        return None
    runs = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        runs = (runs << np.uint64(21)) | codes[k : k + len(runs)]
    runs = np.unique(runs)
    seeds = (np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    return _mixed(runs[None, :] ^ seeds).min(axis=1).view(np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _signature(text: str | None, size: int = 3, hashes: int = HASHES) -> list[int] | None:
    found = _minima(text, size, hashes)
    return None if found is None else found.tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(text: pd.Series) -> pd.Series:
    """The least hash of a text's runs of three characters for each of 100 functions; null below three characters."""
    return text.map(_signature)


def estimated_similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures; 0 for signatures of unlike length or none."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return F.when(F.size(a) == F.size(b), equal / F.size(a)).otherwise(F.lit(0.0))


def signatures(nodes: DataFrame, min_bytes: int = 50, min_lines: int = 3) -> DataFrame:
    """(id, signature) of functions and methods of a least length. A row of ``nodes`` gives one row; equal rows are not merged."""
    rows = nodes.where(F.col("kind").isin("function", "method") & (F.octet_length("source") >= min_bytes) & (F.col("end_line") - F.col("start_line") >= min_lines))
    return rows.select("id", normalize_code(F.col("source")).alias("text")).mapInArrow(_signed, T.StructType([rows.schema["id"], T.StructField("signature", T.ArrayType(T.LongType()))]))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Not a column function and a filter on it: the filter would be moved below and the function called twice.
    for batch in batches:
        found = [_minima(text) for text in batch.column("text").to_pylist()]
        kept = [k for k, x in enumerate(found) if x is not None]
        if kept:
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), _lists(np.stack([found[k] for k in kept]))], ["id", "signature"])


def _lists(values: np.ndarray) -> pa.ListArray:
    """Each row of a matrix as a list."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def similar_pairs(signed: DataFrame, threshold: float = 0.7, bands: int = BANDS, rows: int = ROWS, longest: int = LONGEST) -> DataFrame:
    """(a, b, similarity) of ids that share a band of their signatures (of ``bands * rows`` values) and agree in at least ``threshold`` of it.

    Equal signatures are one class, paired through its least id only, so a group of copies never meets itself
    pair by pair; the copies are listed against their class.

    Classes meet where they share a band, and chance makes such meetings grow as the square of the table. So no
    meeting is written down before it is tried: a class takes the two lowest bits of each value along, which agree
    wherever the values do, and only pairs whose bits agree in ``threshold`` of the places are compared in full.
    A band that more than ``longest`` classes share is held against itself in blocks.
    """
    from quarry.session import stored

    kind, long = signed.schema["id"].dataType, T.LongType()
    id_, numbers, words = T.StructField("id", kind), T.ArrayType(long), PLANES * -(-bands * rows // 64)
    marked = T.StructType([id_, T.StructField("class", T.BinaryType()), T.StructField("signature", numbers), T.StructField("hashes", numbers), T.StructField("sketch", numbers)])
    known = stored(signed.mapInArrow(lambda batches: _marked(batches, bands, rows), marked))
    reps = stored(known.where("id is not null").groupBy("class").agg(F.min("id").alias("rep"), F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch")))
    sketch = [f"s{k}" for k in range(words)]
    banded = reps.select("hashes", F.col("rep").alias("a"), *[F.col("sketch")[k].alias(c) for k, c in enumerate(sketch)]).select(F.explode("hashes").alias("hash"), "a", *sketch)
    pairs = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("hash", long), *[T.StructField(c, long) for c in sketch]])
    meet = lambda table, most: table.repartition("hash").sortWithinPartitions("hash").mapInArrow(lambda batches: _meet(batches, threshold, bands * rows, most), pairs)
    met = stored(meet(banded, longest))
    near = stored(met.unionByName(meet(_blocks(met.where("b is null"), longest), None)).where("b is not null").select("a", "b").distinct())

    # Signatures are moved only of ids that may be in a pair; the table of their hashes has SIEVE rows at most.
    at = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).select(at.alias("at")).distinct()
    chosen = known.select("id", "class", "signature").withColumn("at", at).join(F.broadcast(wanted), "at", "left_semi").dropDuplicates(["id", "class"]).join(reps.select(F.col("rep").alias("id"), "class"), ["id", "class"])
    sa, sb = chosen.select(F.col("id").alias("a"), F.col("signature").alias("sa")), chosen.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    across = near.join(sa, "a").join(sb, "b").select("a", "b", estimated_similarity(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    copies = known.select("id", "class").join(reps.select("class", "rep"), "class").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    return across.unionByName(copies)


def _marked(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Signatures with a digest, a hash of each band, and the lowest bits of the values as planes of 64-bit words."""
    places = bands * rows
    for batch in batches:
        batch = batch.filter(batch.column("signature").is_valid())
        if not len(batch):
            continue
        values = batch.column("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(batch), places)
        hashes = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(batch), axis=0)
        for k in range(rows):
            hashes = _mixed(hashes ^ values[:, k::rows])
        bits = np.zeros((len(batch), PLANES, -(-places // 64) * 64), np.uint8)
        for k in range(PLANES):
            bits[:, k, :places] = (values >> np.uint64(k)) & np.uint64(1)
        sketch = np.packbits(bits, axis=2).reshape(len(batch), -1).view(np.uint64)
        digests = pa.array([hashlib.md5(row, usedforsecurity=False).digest() for row in values], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), digests, _lists(values), _lists(hashes), _lists(sketch)], ["id", "class", "signature", "hashes", "sketch"])


def _blocks(rows: DataFrame, longest: int) -> DataFrame:
    """Lists of more than ``longest`` classes in blocks; ``hash`` becomes that of two blocks that meet. Every two rows of a list share one."""
    sized = rows.groupBy("hash").agg(F.count("*").alias("n")).select("hash", F.greatest(F.lit(2), F.ceil(F.col("n") / longest)).cast("int").alias("blocks"))
    placed = rows.drop("b").join(sized, "hash").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> own")
    return cells.withColumn("hash", F.xxhash64("hash", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, places: int, longest: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows of equal hash whose sketches agree often enough; rows in order of hash.

    Runs of more than ``longest`` rows are handed on as they came, with no ``b``.
    """
    rest: pa.Table | None = None
    crowded = None
    for batch in batches:
        here = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        hashes = here.column("hash").to_numpy()
        if not len(hashes):
            continue
        if crowded is not None:
            begun = int(np.searchsorted(hashes, crowded, "right"))
            yield from _handed_on(here.slice(0, begun))
            here, hashes = here.slice(begun), hashes[begun:]
            if not len(hashes):
                continue
            crowded = None
        last = int(np.searchsorted(hashes, hashes[-1]))
        yield from _agreeing(here.slice(0, last), threshold, places)
        rest = here.slice(last)
        if longest is not None and len(rest) > longest:
            yield from _handed_on(rest)
            crowded, rest = hashes[-1], None
    if rest is not None:
        yield from _agreeing(rest, threshold, places)


def _handed_on(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    columns = ["a", "b", *[c for c in rows.column_names if c != "a"]]
    yield from rows.append_column("b", pa.nulls(len(rows), rows.schema.field("a").type)).select(columns).to_batches()


def _agreeing(rows: pa.Table, threshold: float, places: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    ids, hashes = rows.column("a").to_numpy(), rows.column("hash").to_numpy()
    sketch = [c for c in rows.column_names if c not in ("a", "hash")]
    words = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in sketch]).reshape(PLANES, -1, len(rows))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        sizes = np.diff(np.r_[starts, len(hashes)])
        for start, size in zip(starts[sizes > WIDE], sizes[sizes > WIDE], strict=True):
            end = start + size
            for i in range(start, end, TILE):
                for j in range(i, end, 4 * TILE):
                    mine, theirs = words[:, :, i : min(i + TILE, end), None], words[:, :, None, j : min(j + 4 * TILE, end)]
                    p, q = np.nonzero(_likely(mine, theirs, threshold, places))
                    own = p + i < q + j
                    yield p[own] + i, q[own] + j
        here, step = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= WIDE), sizes)), 1
        while True:
            here = here[here < len(hashes) - step]
            here = here[hashes[here] == hashes[here + step]]
            if not len(here):
                return
            kept = here[_likely(words[:, :, here], words[:, :, here + step], threshold, places)]
            yield kept, kept + step
            step += 1

    for p, q in pairs():
        a, b = np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])
        kept = a < b
        if kept.any():
            n = int(kept.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept]), *[pa.nulls(n, pa.int64()) for _ in range(1 + len(sketch))]], ["a", "b", "hash", *sketch])


def _likely(mine: np.ndarray, theirs: np.ndarray, threshold: float, places: int) -> np.ndarray:
    """Whether two signatures can agree in ``threshold`` of their places: places with a bit that differs do not agree."""
    unlike = np.bitwise_or.reduce(mine ^ theirs, axis=0)
    differing = np.bitwise_count(unlike).sum(axis=0, dtype=np.int64)
    return (places - differing) / places >= threshold


def neighbours(edges: DataFrame, node_id: int, threshold: float = 0.7) -> DataFrame:
    """(node_id, similar_id, score) of one node from stored edges. Copies are stored against one of them, whose neighbours are theirs too."""
    known = similar_to(edges, threshold)
    own = known.where(F.col("node_id") == node_id)
    twins = own.where("score >= 1").select(F.col("similar_id").alias("node_id"))
    through = known.join(twins, "node_id", "left_semi").where(F.col("similar_id") != node_id).select(F.lit(node_id).cast("long").alias("node_id"), "similar_id", "score")
    return own.unionByName(through).groupBy("node_id", "similar_id").agg(F.max("score").alias("score"))


def similar_to(edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(node_id, similar_id, score) from stored ``similar_to`` edges, both ways; a missing score is 0."""
    kept = edges.where("kind = 'similar_to'").select("source_node_id", "target_node_id", F.coalesce(F.get_json_object("metadata", "$.jaccard_score").try_cast("double"), F.lit(0.0)).alias("score")).where(F.col("score") >= threshold)
    ways = F.array(F.struct(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("similar_id")), F.struct(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("similar_id")))
    return kept.select(F.explode(ways).alias("w"), "score").groupBy("w.node_id", "w.similar_id").agg(F.max("score").alias("score"))


def code_tokens(source: Column) -> Column:
    """The distinct lower-case tokens of more than one byte."""
    return F.array_distinct(F.filter(F.split(F.lower(source), r"[^\p{L}\p{N}_]+"), lambda t: F.octet_length(t) > 1))


def token_overlap(a: Column, b: Column) -> Column:
    """The Jaccard coefficient of the tokens of two texts; 1 where both have none."""
    ta, tb = code_tokens(F.coalesce(a, F.lit(""))), code_tokens(F.coalesce(b, F.lit("")))
    union = F.size(F.array_union(ta, tb))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ta, tb)) / F.nullif(union, F.lit(0)))


def directory_proximity(a: Column, b: Column) -> Column:
    """Common leading folders over the longer of both lists of folders; 0 where there are none."""
    folders = lambda p: F.slice(F.split(p, r"[/\\]"), 1, F.size(F.split(p, r"[/\\]")) - 1)
    fa, fb = folders(a), folders(b)
    longest = F.greatest(F.size(fa), F.size(fb))
    same = F.zip_with(fa, fb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("long")) - 1, F.size(same).cast("long"))
    return F.when(longest == 0, F.lit(0.0)).otherwise(first / F.nullif(longest, F.lit(0)))


def _ratio(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == 0, F.lit(1.0)).otherwise(1 - F.abs(a - b) / F.nullif(top, F.lit(0).cast("long")))


def profile_similarity(lines_a: Column, lines_b: Column, complexity_a: Column, complexity_b: Column, exported_a: Column, exported_b: Column) -> Column:
    """0.4 for like length, 0.4 for like complexity, 0.2 for equal visibility (half of it otherwise)."""
    return 0.4 * _ratio(lines_a, lines_b) + 0.4 * _ratio(F.coalesce(complexity_a, F.lit(1)), F.coalesce(complexity_b, F.lit(1))) + 0.2 * F.when(exported_a.eqNullSafe(exported_b), 1.0).otherwise(0.5)


def semantic_scores(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, minhash, overlap, proximity, profile, score) of pairs (a, b) of node ids."""
    signed = nodes.withColumn("signature", minhash(normalize_code(F.coalesce("source", F.lit("")))))
    wanted = ("id", "source", "signature", "file_path", "start_line", "end_line", "complexity", "is_exported")
    side = lambda s: signed.select(*[F.col(c).alias(f"{c}_{s}") for c in wanted])
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    parts = both.select(
        "a", "b", F.coalesce(estimated_similarity(F.col("signature_a"), F.col("signature_b")), F.lit(0.0)).alias("minhash"), token_overlap(F.col("source_a"), F.col("source_b")).alias("overlap"),
        directory_proximity(F.col("file_path_a"), F.col("file_path_b")).alias("proximity"),
        profile_similarity(F.col("end_line_a") - F.col("start_line_a"), F.col("end_line_b") - F.col("start_line_b"), F.col("complexity_a"), F.col("complexity_b"), F.col("is_exported_a"), F.col("is_exported_b")).alias("profile"),
    )
    return parts.withColumn("score", 0.40 * F.col("minhash") + 0.30 * F.col("overlap") + 0.15 * F.col("proximity") + 0.15 * F.col("profile"))
