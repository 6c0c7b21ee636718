import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import snapshots

ROWS = "project_id long, snapshot_no int, qualified_name string, delivered_at timestamp, content_hash string, file_path string, project_name string"
DELIVERIES = "project_id long, snapshot_no int, status string"


def rows(spark, data):
    df = spark.createDataFrame([(p, s, q, d, h, f, "x") for p, s, q, d, h, f in data], ROWS.replace("delivered_at timestamp", "delivered_at string"))
    return df.withColumn("delivered_at", F.col("delivered_at").cast("timestamp"))


def found(spark, data, deliveries, **kw):
    out = snapshots.snapshot_changes(rows(spark, data), spark.createDataFrame(deliveries, DELIVERIES), **kw)
    return {tuple(r) for r in out.collect()}


def test_added_removed_changed_and_equal_forms(spark):
    t = "2025-01-01 00:00:00"
    data = [
        (1, 1, "a", t, "AB", "x\\y"), (1, 2, "a", t, "ab", "x/y"),
        (1, 1, "b", t, None, "f"), (1, 2, "b", t, None, "f"),
        (1, 1, "c", t, None, "f"), (1, 2, "c", t, "00", "f"),
        (1, 1, "d", t, "1", "f"), (1, 2, "e", t, "1", "f"),
        (1, 1, "g", t, "1", "f"), (1, 2, "g", t, "2", "f"), (1, 2, "g", "2025-01-02 00:00:00", "1", "f"), (1, 2, "g", "2025-01-02 00:00:00", "1", "f"),
        (1, 1, None, t, "1", "f"),
    ]
    got = found(spark, data, [(1, 1, "complete"), (1, 2, "complete")])
    assert got == {(1, 2, "c", "changed"), (1, 2, "d", "removed"), (1, 2, "e", "added")}


def test_partial_deliveries_are_passed_over(spark):
    t = "2025-01-01 00:00:00"
    data = [(1, 1, "a", t, "1", "f"), (1, 2, "b", t, "1", "f"), (1, 3, "a", t, "2", "f")]
    got = found(spark, data, [(1, 1, "complete"), (1, 2, "partial"), (1, 3, "complete"), (2, 1, "complete")])
    assert got == {(1, 3, "a", "changed")}


def test_stored_tables_can_be_released(spark):
    from quarry.session import release, stored

    release(spark)
    kept = stored(spark.range(3))
    assert kept.count() == 3 and release(spark) == 1 and release(spark) == 0


def test_empty_tables(spark):
    assert found(spark, [], []) == set()


@pytest.mark.parametrize("chunk_rows", [1, 4, 64])
def test_random_snapshots_against_brute_force(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    state, data, states = {}, [], []
    for number in range(1, 5):
        for _ in range(60):
            key = (rng.choice([7, 7, 7, 8]), f"n{rng.randrange(120):03}")
            if rng.random() < 0.3:
                state.pop(key, None)
            else:
                state[key] = (rng.choice(["aa", "bb", None]), rng.choice(["p", "q"]))
        states.append(dict(state))
        data += [(p, number, q, "2025-01-01 00:00:00", h, f) for (p, q), (h, f) in state.items()]
    want = set()
    for number in range(2, 5):
        old, new = states[number - 2], states[number - 1]
        for key in old.keys() | new.keys():
            change = "added" if key not in old else "removed" if key not in new else "changed" if old[key] != new[key] else None
            if change:
                want.add((key[0], number, key[1], change))
    deliveries = [(p, s, "complete") for p in (7, 8) for s in range(1, 5)]
    assert found(spark, data, deliveries, chunk_rows=chunk_rows) == want


def test_file_states_of_all_snapshots_against_brute_force(spark, tmp_path):
    from quarry import queries

    rng = random.Random(1)
    data = [(p, s, f"n{f}{k}", "2025-01-01 00:00:00", rng.choice(["aa", "AA", "bb"]), f"d\\f{f}") for p, numbers in ((7, (1, 2, 3, 4)), (8, (2, 5, 6))) for s in numbers for f in range(12) for k in range(2) if rng.random() < 0.6]
    rows(spark, data).write.parquet(f"{tmp_path}/node_snapshots.parquet")
    states: dict = {}
    for p, s, q, _, h, f in data:
        states.setdefault((p, s), {}).setdefault(f.replace("\\", "/"), set()).add((q, h.lower()))
    want = set()
    for p, numbers in ((7, (1, 2, 3, 4)), (8, (2, 5, 6))):
        for before, after in zip(numbers, numbers[1:], strict=False):
            old, new = states[p, before], states[p, after]
            want |= {(p, after, f, "new" if f not in old else "deleted" if f not in new else "same" if old[f] == new[f] else "changed") for f in old.keys() | new.keys()}
    got = queries.QUERIES["file_state_diff"](spark, str(tmp_path)).collect()
    assert {(r.project_id, r.snapshot_no, r.file_path, r.status) for r in got} == want and len(got) == len(want)
