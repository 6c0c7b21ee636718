"""Full-text, vector and hybrid search: postings, BM25, cosine, reciprocal rank fusion."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B, RRF = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    """The lower-case runs of letters and digits of a text; an underscore separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


# The endings of steps 2, 3 and 4 of Porter's algorithm (M. F. Porter, 1980) and what they become.
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``v`` for every vowel and ``c`` for every consonant; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _closed(word: str) -> bool:
    """Whether a word ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:  # noqa: ANN001
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """An English word without its endings, by Porter's algorithm with its published departures (bli, logi)."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    end = _longest(word, ("sses", "ies", "ss", "s"))
    word = word[:-2] if end in ("sses", "ies") else word[:-1] if end == "s" else word
    end = _longest(word, ("eed", "ed", "ing"))
    if end == "eed":
        word = word[:-1] if _measure(word[:-3]) else word
    elif end and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _closed(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step in (_STEP_2, _STEP_3):
        end = _longest(word, step)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + step[end]
    end = _longest(word, _STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _closed(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def folded(word: str) -> str:
    """A word without the marks above and below its Latin letters."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stem of each word of each list; the different words of a batch are stemmed once."""
    flat = words.explode()
    different = flat.dropna().unique()
    known = {w: stem(folded(w)) for w in different}
    return words.map(lambda ws: None if ws is None else [known[w] for w in ws])


def postings(documents: DataFrame, key: str, text: str, stemmed: bool = False) -> DataFrame:
    """(doc, term, tf, length) of every text."""
    words = documents.select(F.col(key).alias("doc"), terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    if stemmed:
        words = words.withColumn("words", stems("words"))
    return words.select("doc", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("doc", "term", "length").agg(F.count("*").alias("tf"))


def bm25(documents: DataFrame, key: str, text: str, queries: DataFrame, limit: int = 20, stemmed: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, rank): the ``limit`` best texts of each query by BM25; the lower score is the better.

    ``queries`` has (query_id, query), a stated set; with ``only`` (doc) just its texts are ranked. The statistics are those of all texts. Only postings of
    query terms are kept, so the corpus is tokenised once and what is shuffled is small.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    if stemmed:
        asked = asked.groupBy("query_id").agg(F.collect_list("term").alias("w")).select("query_id", F.explode(F.array_distinct(stems("w"))).alias("term"))
    words = documents.select(F.col(key).alias("doc"), terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    if stemmed:
        words = words.withColumn("words", stems("words"))
    stats = words.agg(F.count("*").alias("docs"), F.avg(F.size("words")).alias("mean"))
    wanted = asked.select("term").distinct()
    hits = words.select("doc", F.size("words").alias("length"), F.explode("words").alias("term")).join(wanted, "term").groupBy("doc", "term", "length").agg(F.count("*").alias("tf"))
    seen = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(seen, "term").join(stats)
    raw = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    summed = scored.select("term", "doc", (-weight).alias("part")).join(asked, "term").groupBy("query_id", "doc").agg(F.sum("part").alias("score"))
    if only is not None:
        summed = summed.join(only.select("doc").distinct(), "doc", "left_semi").select("query_id", "doc", "score")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), "doc")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def snippet(text: Column, chars: int = 200) -> Column:
    """The first characters of a text, with an ellipsis where there are more."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors over their common length, norms over their whole; null for a zero vector."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.try_divide(total(both), norm(a) * norm(b))


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, block: int = 512) -> DataFrame:
    """(query_id, node_id, similarity, rank): of each query's ``limit`` nearest vectors those above 0.

    ``vectors`` has (node_id, embedding), ``queries`` (query_id, embedding), a stated set that is broadcast in
    blocks. Each task multiplies its vectors with a block and keeps its own best, so what is shuffled is
    ``limit`` rows a query and task.
    """
    spark = vectors.sparkSession
    out: DataFrame | None = None
    rows = queries.select("query_id", "embedding").toLocalIterator()
    while True:
        chunk = [r for _, r in zip(range(block), rows, strict=False)]
        if not chunk:
            break
        ids, width = np.array([r[0] for r in chunk]), max(len(r[1]) for r in chunk)
        matrix = np.zeros((len(chunk), width))
        for k, r in enumerate(chunk):
            matrix[k, : len(r[1])] = r[1]
        norms = np.linalg.norm(matrix, axis=1)
        shared = spark.sparkContext.broadcast((ids, matrix, norms))

        def best(batches: Iterator[pd.DataFrame], shared=shared, width=width) -> Iterator[pd.DataFrame]:
            ids, matrix, norms = shared.value
            kept = pd.DataFrame({"query_id": [], "node_id": [], "similarity": []})
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna()]
                if pdf.empty:
                    continue
                stacked = np.stack([np.pad(np.asarray(v, float)[:width], (0, max(0, width - len(v)))) for v in pdf["embedding"]])
                own = np.array([np.linalg.norm(np.asarray(v, float)) for v in pdf["embedding"]])
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = (matrix @ stacked.T) / (norms[:, None] * own[None, :])
                scores = np.where(np.isfinite(scores), scores, -2.0)
                top = np.argsort(-scores, axis=1, kind="stable")[:, : limit * 2]
                part = pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "node_id": pdf["node_id"].to_numpy()[top.ravel()], "similarity": np.take_along_axis(scores, top, 1).ravel()})
                kept = pd.concat([kept, part[part["similarity"] > -2]]).sort_values(["query_id", "similarity", "node_id"], ascending=[True, False, True]).groupby("query_id").head(limit)
            yield kept.astype({"query_id": "int64", "node_id": "int64", "similarity": "float64"})

        part = vectors.select("node_id", "embedding").mapInPandas(best, "query_id long, node_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.limit(0).select(F.lit(0).cast("long").alias("query_id"), "node_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "node_id")
    return out.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= limit) & (F.col("similarity") > 0))


def fuse(lists: list[DataFrame], ranks: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(query_id, item, score, rank) by reciprocal rank fusion of lists of (query_id, item, rank), lifted by 1 + 5 pagerank."""
    from functools import reduce

    together = reduce(DataFrame.unionByName, [x.select("query_id", "item", "rank") for x in lists])
    summed = together.groupBy("query_id", "item").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"))
    if ranks is not None:
        summed = summed.join(ranks.select(F.col("node_id").alias("item"), "pagerank"), "item", "left").select("query_id", "item", (F.col("score") * (1 + 5 * F.coalesce("pagerank", F.lit(0.0)))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hashed_embedding(text: Column, dimensions: int = 384, most_chars: int = 2000) -> Column:
    """A deterministic term-frequency vector of hashed terms, of length 1; for use where no model is at hand."""
    slots = F.transform(terms(F.substring(F.coalesce(text, F.lit("")), 1, most_chars)), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def counted(places: pd.Series) -> pd.Series:
        def one(at: np.ndarray) -> np.ndarray:
            counts = np.bincount(np.asarray(at, int), minlength=dimensions).astype(float)
            return counts / (np.linalg.norm(counts) or 1.0)

        return places.map(one)

    return counted(slots)
