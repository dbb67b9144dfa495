import random

import pytest
from pyspark.sql import functions as F

from tradeloom.operators.messages import BucketStore, StoreConflict, dlq_copies, first_by_linked_ids, outbox_copies

OUT = "delivery_id long, batch_id string, id string, first string"
DLQ = "delivery_id long, consumer_group string, stream string, stream_message_id string, event_id string, label string"


def union_find(rows, keys):
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for n, row in rows:
        for k in keys(row):
            parent[find(("d", n))] = find(k)
    groups = {}
    for n, row in rows:
        if keys(row):
            groups.setdefault(find(("d", n)), []).append(n)
    return sorted((min(g), n) for g in groups.values() for n in g if n != min(g))


def test_outbox(spark):
    rows = [(5, "b", "A-1", ""), (3, "b", " a-1\t", ""), (9, "c", "a-1", ""), (1, None, None, ""), (2, "b", "  ", ""), (4, "b", "z", ""), (4, "b", "z", ""), (7, "b", None, "")]
    got = outbox_copies(spark.createDataFrame(rows, OUT)).collect()
    assert sorted((r.first_delivery_id, r.copy_delivery_id) for r in got) == [(3, 5), (3, 9)]
    assert outbox_copies(spark.createDataFrame([], OUT)).count() == 0


def test_dlq_chains_match_union_find(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["g", "h", None]), "s", rng.choice([None, " ", f"m{rng.randrange(25)}"]), rng.choice([None, "", f"E{rng.randrange(25)}", f" e{rng.randrange(25)}"]), "") for k in rng.sample(range(1000), 90)]
    rows += [(2000 + k, "long", "s", f"m{k // 2}", f"e{(k + 1) // 2}", "") for k in range(40)]  # one chain of 40

    def keys(r):
        _, g, s, m, e, _ = r
        out = []
        if g and e and e.strip():
            out.append(("e", g, e.strip().lower()))
        if g and s and m and m.strip():
            out.append(("m", g, s, m.strip().lower()))
        return out

    got = sorted((r.first_delivery_id, r.copy_delivery_id) for r in dlq_copies(spark.createDataFrame(rows, DLQ)).collect())
    assert got == union_find([(r[0], r) for r in rows], keys)
    assert dlq_copies(spark.createDataFrame([], DLQ)).count() == 0


def test_hot_key_is_one_message(spark):
    df = spark.range(5000).select(F.col("id").alias("delivery_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = first_by_linked_ids(df, [F.col("k")], batch=None).filter("delivery <> first")
    assert got.count() == 1666 and got.select("first").distinct().collect()[0][0] == 0


def test_upsert_is_idempotent_and_compaction_collapses(spark):
    store = BucketStore(spark)
    one = spark.createDataFrame([("a", 5), ("a", 3), ("b", 9), (None, 1)], "key string, value long")
    two = spark.createDataFrame([("a", 1), ("c", 2)], "key string, value long")
    store.upsert("r1", one)
    store.upsert("r1", one)
    store.upsert("r2", two)
    assert sorted(map(tuple, store.compact().collect())) == [("a", 1), ("b", 9), ("c", 2)]
    store.upsert("r1", one)
    assert sorted(map(tuple, store.compact().collect())) == [("a", 1), ("b", 9), ("c", 2)]
    assert BucketStore(spark).compact().count() == 0


def test_a_store_opened_again_goes_on(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "b1", "a"), (2, "b1", "b"), (3, "b1", "a")], "delivery_id long, batch_id string, id string")
    outbox_copies(first, BucketStore(spark, path)).collect()
    again = BucketStore(spark, path)
    assert list(again.runs) == ["merged"]
    late = spark.createDataFrame([(7, "b2", "A"), (8, "b2", "c"), (1, "b1", "a")], "delivery_id long, batch_id string, id string")
    got = outbox_copies(late, again).collect()
    assert [(r.first_delivery_id, r.copy_delivery_id) for r in got] == [(1, 7)]
    again.vacuum()
    assert sorted(map(tuple, BucketStore(spark, path).compact().collect())) == [("a", 1), ("b", 2), ("c", 8)]


def test_compaction_merges_without_exchange_or_sort(spark):
    store = BucketStore(spark)
    for k in range(3):
        store.upsert(f"r{k}", spark.range(200 * k, 200 * k + 300).selectExpr("cast(id as string) key", f"id + {k} value"))
    a, b, _ = store.runs.values()
    with store._sorted_scans():
        plan = store.merged(a, b, store.commits.last()[1]["buckets"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert store.compact().count() == 700


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = BucketStore(spark, str(tmp_path / "s")), BucketStore(spark, str(tmp_path / "s"))
    number, state = a.commits.last()
    b.upsert("x", spark.createDataFrame([("k", 1)], "key string, value long"))
    with pytest.raises(StoreConflict):
        a._commit(number, state["buckets"], {})
