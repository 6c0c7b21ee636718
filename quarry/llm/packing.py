"""Filling containers of fixed capacity with texts measured in tokens: conflict-constrained best-fit.

Texts are measured where they are read; only (id, size, source, duplicate cluster) is shuffled. Items are
dealt to shards by the hash of their id, so a source or cluster of any size is spread evenly and a shard
holds a bounded number of items. Within a shard items come by falling size. The open bins are kept by
residual capacity, each set of bins as a bitmap; a source and a duplicate cluster have a bitmap of the bins
they are in. For an item the successors of its size among the residuals are searched upwards until one has
a bin outside both bitmaps: the tightest compatible bin. Copies of a text never share a bin; texts of one
source share one only where the item would else need a new bin.
"""

from __future__ import annotations

import base64
import importlib.util
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2_048
SHARD_ITEMS = 20_000
TOKENIZER_FOLDER, TOKENIZER_FILE = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"

_LOADED: dict[tuple[str, str], object] = {}
_SPACE = re.compile(r"\s+")


def tokenizer(folder: str = TOKENIZER_FOLDER, file: str = TOKENIZER_FILE):
    """The public byte-level BPE tokenizer of a vocabulary file, loaded once a process."""
    if (folder, file) not in _LOADED:
        import tiktoken

        spec = importlib.util.spec_from_file_location("_vocabularies", f"{folder}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(f"{folder}/{file}", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[folder, file] = tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[folder, file]


def _measured(batches: Iterator[pa.RecordBatch], folder: str, file: str) -> Iterator[pa.RecordBatch]:
    encode = tokenizer(folder, file).encode_ordinary
    for batch in batches:
        sizes, clusters, sources = [], [], []
        for text, source in zip(batch["text"].to_pylist(), batch["source"].to_pylist(), strict=True):
            text = text or ""
            sizes.append(len(encode(text)))
            clusters.append(xxhash.xxh3_64_intdigest(_SPACE.sub(" ", text).strip().encode("utf-8", "surrogatepass")) >> 1)
            sources.append(xxhash.xxh3_64_intdigest((source or "").encode()) >> 1)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(sources, pa.int64()), pa.array(clusters, pa.int64())], ["doc_id", "tokens", "source", "cluster"])


def measured(documents: DataFrame, folder: str = TOKENIZER_FOLDER, file: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, tokens, source, cluster) of distinct rows; a null text has no tokens, rows without an id are left out."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(lambda b: _measured(b, folder, file), "doc_id long, tokens long, source long, cluster long").distinct()


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Sizes are at most the capacity; the order of equal sizes is that given."""
    out = np.empty(len(sizes), np.int64)
    by_residual: list[int] = [0] * (capacity + 1)
    levels = 0
    in_source: dict[int, int] = {}
    in_cluster: dict[int, int] = {}
    bins = 0
    for k in np.argsort(-sizes, kind="stable"):
        size, source, cluster = int(sizes[k]), int(sources[k]), int(clusters[k])
        copies = in_cluster.get(cluster, 0)
        chosen = residual = -1
        for barred in (copies | in_source.get(source, 0), copies):
            above = levels >> size
            while above:
                low = above & -above
                at = size + low.bit_length() - 1
                free = by_residual[at] & ~barred
                if free:
                    chosen, residual = (free & -free).bit_length() - 1, at
                    break
                above ^= low
            if chosen >= 0:
                break
        if chosen < 0:
            chosen, residual = bins, capacity
            bins += 1
        else:
            by_residual[residual] ^= 1 << chosen
            if not by_residual[residual]:
                levels &= ~(1 << residual)
        left = residual - size
        by_residual[left] |= 1 << chosen
        levels |= 1 << left
        in_cluster[cluster] = copies | 1 << chosen
        in_source[source] = in_source.get(source, 0) | 1 << chosen
        out[k] = chosen
    return out


def _packed(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pack each shard; rows come sorted by shard, so one shard is held at a time."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch:
        sizes = rows["tokens"].to_numpy()
        bins = best_fit(sizes, rows["source"].to_numpy(), rows["cluster"].to_numpy(), capacity)
        container = rows["shard"].to_numpy().astype(np.int64) * (1 << 32) + bins
        return pa.RecordBatch.from_arrays([pa.array(rows["doc_id"].to_numpy()), pa.array(rows["piece"].to_numpy()), pa.array(sizes), pa.array(container)], ["doc_id", "piece", "tokens", "container"])

    for batch in batches:
        shards = batch["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1), len(shards)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(start, end - start)
            if held and part.num_rows and held[0]["shard"][0] != part["shard"][0]:
                yield flush(pa.Table.from_batches(held))
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield flush(pa.Table.from_batches(held))


def packed(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, tokens, container): every item in a container of at most ``capacity`` tokens.

    An item above the capacity is split into full pieces and a rest, numbered from 0; no other is split. A
    document without tokens takes a place of size 0. An empty table gives no rows.
    """
    from quarry.session import stored
    from quarry.tables import partitions

    items = stored(items)
    whole = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    pieces = items.select("*", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    size = F.least(F.lit(capacity), F.col("tokens") - F.col("piece").cast("long") * capacity)
    count = items.agg(F.count("*").alias("n")).first()["n"]
    shards = max(1, -(-count // shard_items))
    dealt = pieces.select("doc_id", "piece", size.alias("tokens"), "source", "cluster", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long").alias("shard"))
    keyed = dealt.repartition(min(shards, 16 * partitions(items)), "shard").sortWithinPartitions("shard", F.col("tokens").desc(), "doc_id", "piece")
    return keyed.mapInArrow(lambda b: _packed(b, capacity), "doc_id long, piece int, tokens long, container long")
