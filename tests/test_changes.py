import json
import datetime as dt
import random

from pyspark.sql import functions as F

from tradeloom.functions.textnorm import FieldMapping
from tradeloom.operators.changes import classify, counters, head_state, over_budget, versions
from tradeloom.operators.runs import next_state, process_run
from tradeloom.operators.tables import SnapshotStore
from tradeloom.session import scratch

T = [dt.datetime(2026, 1, 1) + dt.timedelta(hours=k) for k in range(12)]
REC = "source_id string, external_product_id string, id string, sua timestamp_ntz, ra timestamp_ntz, fp string, s_old string"
STATE = "source_id string, external_product_id string, s_sua timestamp_ntz, s_ra timestamp_ntz, s_fp string, s_refp string, s_version long"


def newer(a, b):
    return b if a is None else a if b is None else max(a, b)


def fold_one(records, state):
    """One record after another."""
    out = {}
    have, sua, ra, fp, ref, version = state is not None, *(state or (None, None, None, None, 0))
    version = version or 0
    first = True
    for r in sorted(records, key=lambda r: (r[3] is not None, r[3] or T[0], r[4], r[2])):
        _, _, i, s, t, f, _ = r
        if have:
            if s is not None and sua is not None:
                stale = s < sua or (s == sua and ra is not None and t < ra)
            else:
                stale = ra is not None and t < ra
            if stale:
                out[i] = ("STALE", None)
                continue
        if not have or fp is None:
            kind = "NEW"
        elif not fp.startswith("v1:") and first and ref == f:
            kind = "VERSION_MISMATCH"
        elif fp == f:
            kind = "UNCHANGED"
        else:
            kind = "CHANGED"
        first = False
        version += kind in ("NEW", "CHANGED")
        out[i] = (kind, version if kind in ("NEW", "CHANGED") else None)
        have, fp, sua, ra = True, f, newer(sua, s), newer(ra, t)
    return out


def test_closed_form_equals_the_fold(spark):
    rng = random.Random(11)
    recs, states, want = [], [], {}
    for k in range(700):
        key = ("s", str(k))
        own = [(*key, f"{k}-{n}", rng.choice([None, *T[:5]]), rng.choice(T[:6]), f"v1:{rng.choice('abc')}", "clash") for n in range(rng.randrange(1, 7))]
        state = None
        if rng.random() < 0.5:
            state = (rng.choice([None, *T[:5]]), rng.choice(T[:6]), rng.choice(["v1:a", "v1:b", "old"]), "v1:a", rng.randrange(1, 4))
            states.append((*key, *state))
        recs += own
        want |= fold_one(own, state)
    df = classify(spark.createDataFrame(recs, REC), spark.createDataFrame(states, STATE))
    assert {r.id: (r.transition, r.version_number) for r in df.collect()} == want
    total = counters(df).collect()[0]
    assert total.seen == len(recs) == total.new + total.changed + total.unchanged
    assert versions(df).select("version_id").distinct().count() == total.new + total.changed
    assert head_state(df).count() <= 700
    empty = spark.createDataFrame([], REC)
    assert classify(empty, spark.createDataFrame(states, STATE)).count() == 0


def test_plan_shuffles_once_by_identity(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = classify(spark.createDataFrame([], REC).repartition(3), F.broadcast(spark.createDataFrame([], STATE)))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan and "ArrowEvalPython" not in plan


def payload(name):
    return '{"title":"%s","vendor":"B"}' % name


def test_run_twice_changes_nothing(spark):
    rows = [("s", str(k % 40), f"r{k}", payload(f"n{k % 40}-{k // 40}"), T[k // 40], T[k // 40]) for k in range(80)] + [("s", "bad", "x", "{", T[0], T[0])]
    df = spark.createDataFrame(rows, "source_id string, external_product_id string, id string, payload string, source_updated_at timestamp_ntz, received_at timestamp_ntz")
    store = SnapshotStore(spark, scratch(spark, "store"))
    m = FieldMapping("title", None, "vendor")
    one = process_run(df, m, store)
    assert (one.seen, one.new, one.changed, one.unchanged, one.failed, one.over_budget) == (81, 40, 40, 0, 1, False)
    two = process_run(df, m, store, max_error_rate=0.001, min_rows=10)
    assert (two.new, two.changed, two.unchanged, two.over_budget) == (0, 0, 80, True)
    assert store.read("product_versions").count() == 80 and store.read("outbox_events").count() == 80 and store.read("state").count() == 40
    assert len(store.manifest()["tables"]["product_versions"]) == 2  # added to, not written anew
    assert store.read("products").count() == 40 == store.read("product_sources").filter("last_changed_at is not null").count()
    kinds = {(r.change_type, tuple(r.changed_fields)) for r in store.read("product_changes").collect()}
    assert kinds == {("NEW", ()), ("CHANGED", ("canonical_name",))}
    body = json.loads(store.read("outbox_events").first().payload)
    assert list(body) == ["product_id", "version_id", "version_number", "fingerprint", "change_type", "changed_fields"]


def test_old_fingerprints_are_adopted_and_pages_agree(spark):
    schema = "source_id string, external_product_id string, id string, payload string, source_updated_at timestamp_ntz, received_at timestamp_ntz, payload_raw binary"
    m = FieldMapping("title", None, "vendor")
    rows = [("s", "a", "r1", payload("n"), T[0], T[0], None), ("s", "b", "r2", payload("n"), T[0], T[0], b"\xff{}")]
    store = SnapshotStore(spark, scratch(spark, "store"))
    assert process_run(spark.createDataFrame(rows, schema), m, store).failed == 1
    # the fingerprint of an older scheme, whose version gives today's one
    old = store.read("state").withColumn("s_fp", F.lit("old"))
    store.publish({"state": old}, store.manifest()["id"])
    again = process_run(spark.createDataFrame([("s", "a", "r3", payload("n"), T[1], T[1], None)], schema), m, store)
    assert (again.new, again.changed, again.unchanged) == (0, 0, 1)
    state = store.read("state").first()
    assert state.s_fp.startswith("v1:") and state.s_version == 1 and store.read("product_versions").count() == 1
    many = spark.createDataFrame([("s", str(k), f"r{k:03}{j}", payload(f"{k}{j}"), T[j], T[j], None) for k in range(12) for j in range(2)], schema)
    one, paged = SnapshotStore(spark, scratch(spark, "one")), SnapshotStore(spark, scratch(spark, "paged"))
    assert process_run(many, m, one) == process_run(many, m, paged, page_size=12)
    heads = lambda s: sorted((r.canonical_name, r.current_fingerprint) for r in s.read("products").collect())
    assert heads(one) == heads(paged) and len(heads(one)) == 12


def test_states_and_budget(spark):
    assert next_state("RUNNING", "COMPLETED", 2) == "PARTIAL" and next_state("PENDING", "RUNNING") == "RUNNING"
    df = spark.createDataFrame([(10, 5), (10, 6), (5, 5)], "seen long, failed long")
    assert [r.over_budget for r in over_budget(df, 0.5, 10).orderBy("seen", "failed").collect()] == [False, False, True]
