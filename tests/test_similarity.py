"""Pairs of similar code against all pairs, and what finding them writes."""

import random

import numpy as np
import pytest

from quarry.operators import similarity

SCHEMA = "id long, signature array<long>"


def _every_pair(rows, threshold=0.7):
    """The rule itself: classes of equal signatures by their least id, all pairs of them that share a band, then the copies."""
    reps = {}
    for i, s in rows:
        reps[tuple(s)] = min(i, reps.get(tuple(s), i))
    out = {(reps[tuple(s)], i, 1.0) for i, s in rows if reps[tuple(s)] != i}
    signed = sorted((i, s) for s, i in reps.items())
    ids, values = [i for i, _ in signed], np.array([s for _, s in signed])
    for k, a in enumerate(ids):
        equal = values[k + 1 :] == values[k]
        for n in np.flatnonzero(equal.mean(axis=1) >= threshold):
            if equal[n].reshape(20, 5).all(axis=1).any():
                out.add((a, ids[k + 1 + n], equal[n].mean()))
    return sorted(out)


def _crowd(size, seed):
    """Signatures of which all share one band and some are like others, from barely below the threshold upwards."""
    draw = np.random.default_rng(seed)
    values = draw.integers(-(2**63), 2**63, (size, 100))
    for k in range(0, size - 1, size // 40):
        at = draw.permutation(100)[: 66 + k * 40 // size]
        values[k + 1, at] = values[k, at]
    values[:, 35:40] = values[0, 35:40]
    return [(int(i), [int(x) for x in v]) for i, v in zip(draw.permutation(size), values, strict=True)]


def _written(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(10_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@pytest.mark.parametrize("longest", [similarity.LONGEST, 300, 7])
def test_similar_pairs_equal_all_pairs(spark, longest):
    rows = _crowd(400, 3)
    rows += [(1_000 + k, rows[k * 9][1]) for k in range(20)] + [(1_000, rows[0][1])]
    got = similarity.similar_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), longest=longest)
    want = _every_pair(rows)
    assert sorted(map(tuple, got.collect())) == want and len([w for w in want if w[2] < 1]) > 20


def test_a_band_shared_by_many_writes_no_pair_that_is_not_like(spark):
    rows = _crowd(3_000, 5)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = _written(spark)
    got = sorted(map(tuple, similarity.similar_pairs(table).collect()))
    # 4.5 million pairs share the band; written to shuffle files they take over 30 MB, the signatures alone 2.4 MB.
    assert _written(spark) - before < 12e6
    assert got == _every_pair(rows) and 20 < len(got) < 60


def test_signatures_keep_short_texts_out_and_rows_apart(spark):
    long, comments = "def f(x):\n" + "\n".join(f"    x += {k}" for k in range(12)), "\n".join(["# " + "-" * 30] * 5)
    rows = [(1, "function", long, 1, 14), (1, "function", long, 1, 14), (2, "method", comments, 1, 6), (3, "class", long, 1, 14), (4, "function", long, 1, 3), (5, "method", "x" * 49, 1, 9), (6, "function", None, 1, 9)]
    got = similarity.signatures(spark.createDataFrame(rows, "id long, kind string, source string, start_line int, end_line int")).collect()
    assert [r.id for r in got] == [1, 1] and got[0].signature == similarity._signature("".join(long.split()))
    random.seed(1)
    texts = ["".join(random.choices("abcdef(){};= ", k=random.randrange(60, 300))) for _ in range(40)]
    table = spark.createDataFrame([(k, "function", t, 1, 9) for k, t in enumerate(texts)], "id long, kind string, source string, start_line int, end_line int")
    assert {r.id: r.signature for r in similarity.signatures(table).collect()} == {k: similarity._signature("".join(t.split())) for k, t in enumerate(texts)}
