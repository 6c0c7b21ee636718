"""Near-duplicate records after small edits: bottom-k sketches, inverted lists, exact verification.

Each record is the set of its runs of three tokens, hashed by one function. Records of equal sets are
one class, represented by the least id. The sketch of a class is the k least hashes of its set. Every
retained value has an inverted list of the classes that retain it. Values retained once are dropped; of
the rest a class keeps its rarest ones, just so many that two sketches of which at least a stated number
of values agree must share one of them. Classes that meet in a list are held against each other by
union-sketch estimation, and what remains by the exact Jaccard coefficient of the whole sets.

Classes that agree in a list of at most ``LONG_LIST`` entries are found there; others can be similar only if
they agree in as many longer ones, so only classes that retain so many long values are paired in long lists,
each pair only in the list of the rarest value it shares, and only if the values that follow it in both suffice
for the agreement. A list is held against itself in blocks of bounded size, so no task has a whole one. What
remains quadratic is a group whose members nearly all share a great part of their content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9_]+")
SHINGLE, MIN_TOKENS, THRESHOLD = 3, 40, 0.6
SKETCH = 48
#: Retained values in which the sketches of two sets at the threshold agree at least: five standard deviations below the least mean, that of a set inside another.
AGREEING = 14
#: How far below the threshold the union-sketch estimate may lie: more than four standard deviations at k = 48.
SLACK = 0.32
LONG_LIST = 200
#: Classes of a long list in one block, and members of a class in one block.
BLOCK = 2_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        value = xxhash.xxh3_64_intdigest(token)
        if len(self) < 1_000_000:
            self[token] = value
        return value


def shingle_set(source: str, known: dict[str, int], min_tokens: int = MIN_TOKENS) -> np.ndarray | None:
    """The sorted distinct hashes of all runs of three tokens, or None below ``min_tokens`` tokens."""
    tokens = TOKEN.findall(source)
    if len(tokens) < max(min_tokens, SHINGLE):
        return None
    words = np.array([known[t] for t in tokens], np.uint64)
    mixed = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ words[k : k + len(mixed)]) * _ODD
        mixed ^= mixed >> np.uint64(32)
    return np.unique((mixed * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch], min_tokens: int, size: int) -> Iterator[pa.RecordBatch]:
    known = _Hashes()
    for batch in batches:
        ids, digests, counts, heads = [], [], [], []
        for node, source in zip(batch["id"].to_pylist(), batch["source"].to_pylist(), strict=True):
            values = shingle_set(source, known, min_tokens)
            if values is None:
                continue
            ids.append(node)
            digests.append(xxhash.xxh3_128_digest(values.tobytes()))
            counts.append(len(values))
            heads.append(values[:size])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads) if heads else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), lists], ["id", "class", "n", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[pa.RecordBatch]:
    known = _Hashes()
    for batch in batches:
        rows = [shingle_set(s, known, min_tokens) for s in batch["source"].to_pylist()]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["id"], lists], ["id", "values"])


def texts_of(nodes: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """(id, source) of the records that can be compared."""
    return nodes.where(F.col("kind").isin(*kinds) & F.col("source").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "source")


def classes(texts: DataFrame, min_tokens: int = MIN_TOKENS, size: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every compared record and (rep, n, sketch) of the classes of equal sets."""
    from quarry.session import stored

    rows = stored(texts.mapInArrow(lambda b: _sketches(b, min_tokens, size), "id long, class binary, n int, sketch array<long>"))
    reps = rows.groupBy("class").agg(F.min("id").alias("rep"))
    members = rows.select("id", "class").distinct().join(reps, "class").select("id", "rep")
    return members, rows.join(reps, (rows["class"] == reps["class"]) & (rows["id"] == reps["rep"]), "left_semi").select(F.col("id").alias("rep"), "n", "sketch").dropDuplicates(["rep"])


def _paired(listed: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the classes of one list whose sizes allow the threshold."""
    a, b = listed.select("key", F.col("rep").alias("a"), F.col("n").alias("na")), listed.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & fits).select("a", "b")


def candidates(reps: DataFrame, threshold: float, long_list: int = LONG_LIST, size: int = SKETCH, agreeing: int = AGREEING) -> DataFrame:
    """Distinct (a, b), a < b, of classes that meet in an inverted list of kept values."""
    entries = reps.select("rep", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("listed")).where("listed > 1")
    used = entries.join(shared, "value")
    # Of k retained values at least `least` agree with those of a similar set; the rarest k - least + 1 then share one.
    least = F.least(F.ceil(F.col("k") * threshold), F.lit(agreeing)).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("listed", "value")))
    per_class = used.groupBy("rep", "n", "k").agg(ordered.alias("values")).withColumn("least", least)
    take = F.greatest(F.lit(0), F.col("least") * -1 + 1 + F.size("values"))
    kept = per_class.select("rep", "n", F.slice("values", F.lit(1), take).alias("values"))
    short = kept.select("rep", "n", F.explode(F.filter("values", lambda v: v["listed"] <= long_list)).alias("v")).select("rep", "n", F.array("v.value").alias("key"))
    pairs = _paired(short, threshold)
    # Similar classes that share no short list agree in `least` long ones, and the rarest of these is among the first
    # size - least + 1 long values of both; a pair is kept in the list of just that value.
    many = F.transform(F.filter("values", lambda v: v["listed"] > long_list), lambda v: v["value"])
    long = per_class.select("rep", "n", "least", many.alias("rest")).where(F.size("rest") >= F.col("least"))
    placed = F.posexplode(F.slice("rest", F.lit(1), F.size("rest") - F.col("least") + 1)).alias("at", "key")
    keyed = long.select("rep", "n", "least", "rest", placed).join(shared.where(F.col("listed") > long_list).withColumnRenamed("value", "key"), "key")
    # Blocks of a list meet each other once: the row of block i goes to the cells (i, j) and (j, i) with the lower number first.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("listed") / BLOCK)).cast("int")
    own = keyed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    left = own.select("key", "block", "rep", "n", "least", "rest", "at", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    right = own.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"), F.col("block").alias("other"), "rep", "n", "least", "rest", "at")
    one = left.select("key", "block", "other", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("least").alias("la"), F.col("rest").alias("ra"), F.col("at").alias("pa"))
    two = right.select("key", "block", "other", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("least").alias("lb"), F.col("rest").alias("rb"), F.col("at").alias("pb"))
    fits = (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na")) & ((F.col("block") < F.col("other")) | (F.col("a") < F.col("b")))
    # The key and what follows it in both: if it is the first they share, they share no more than that.
    enough = F.least(F.size("ra") - F.col("pa"), F.size("rb") - F.col("pb")) >= F.least("la", "lb")
    met = one.join(two, ["key", "block", "other"]).where((F.col("a") != F.col("b")) & fits & enough).select("a", "b", "key", "la", "lb", F.array_intersect("ra", "rb").alias("shared"))
    rare = met.where((F.size("shared") >= F.least("la", "lb")) & (F.get("shared", F.lit(0)) == F.col("key"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(rare).distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, floor: float, size: int) -> DataFrame:
    """Pairs whose union sketch has at least the share ``floor`` of values retained by both."""
    a = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, size)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return pairs.join(a, "a").join(b, "b").where(both >= floor * F.size(union)).select("a", "b")


def similar_classes(texts: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS, size: int = SKETCH) -> DataFrame:
    """(a, b, similarity) of classes with an exact Jaccard coefficient of at least ``threshold``."""
    from quarry.session import stored

    likely = stored(_estimated(candidates(reps, threshold, size=size), reps, threshold - SLACK, size))
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = texts.join(wanted, "id", "left_semi").mapInArrow(lambda b: _sets(b, min_tokens), "id long, values array<long>").dropDuplicates(["id"])
    a = sets.select(F.col("id").alias("a"), F.col("values").alias("va"))
    b = sets.select(F.col("id").alias("b"), F.col("values").alias("vb"))
    same = F.size(F.array_intersect("va", "vb"))
    similarity = same / (F.size("va") + F.size("vb") - same)
    return likely.join(a, "a").join(b, "b").select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(nodes: DataFrame, threshold: float = THRESHOLD, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity) between class representatives, (id, rep) membership of every compared record).

    Records are functions and methods with a source of at least ``min_tokens`` tokens; others, null sources
    among them, are compared with none. Exact duplicate rows count once; an id that occurs with several
    sources stands for each of them. Extra columns are ignored, an empty table gives empty results.
    """
    texts = texts_of(nodes)
    members, reps = classes(texts, min_tokens)
    from quarry.session import stored

    reps = stored(reps)
    return similar_classes(texts, reps, threshold, min_tokens), members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(node_a, node_b), node_a < node_b, of all records whose classes are linked or equal."""
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    # A class is held against itself in blocks, so that one of very many copies is no single task.
    sized = members.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    several = members.join(sized, "rep").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    one = several.select(F.col("id").alias("x"), "rep", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    two = several.select(F.col("id").alias("y"), "rep", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"), F.col("block").alias("other"))
    within = one.join(two, ["rep", "block", "other"]).where("block < other or x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b")).distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, group_id, links) of every compared record: its class, its connected group, its class's links.

    Groups are the connected components of the links.
    """
    from quarry.operators.graph import components

    root = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node_id").alias("rep"), F.col("component").alias("root"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    joined = members.join(root, "rep", "left").join(degree, "rep", "left")
    return joined.select("id", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
