import datetime as dt
import random

import pytest

from tradeloom.session import scratch
from tradeloom.streaming.lateness import LambdaViews

LOG = "id string, source_id string, source_updated_at timestamp_ntz, received_at timestamp_ntz, verdict string, period string, batch string, grp string"
D = dt.datetime


def log_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], LOG)


def served(views):
    return {(r.source_id, str(r.period)): (r.on_time, r.corrections, r.records, r.too_late, r.frozen) for r in views.serve().collect()}


def test_verdicts_on_their_edges(spark):
    rows = [("a", "s", D(2026, 1, 1), D(2026, 1, 1, 23, 59, 59, 999999)), ("b", "s", D(2026, 1, 1, 23), D(2026, 1, 2)), ("c", "s", D(2026, 1, 1), D(2026, 1, 4, 23, 59, 59, 999999)), ("d", "s", D(2026, 1, 1), D(2026, 1, 5)), ("e", "s", None, D(2026, 1, 5)), ("f", "s", D(2026, 1, 1), None), ("g", None, D(2027, 1, 1), D(2026, 1, 1)), ("b", "s", D(2026, 1, 1, 23), D(2026, 1, 2)), ("h", "s", D(1970, 1, 1), D(2026, 1, 1)), (None, "s", D(2025, 12, 31), D(2026, 1, 2))]
    views = LambdaViews(spark)
    views.replay(log_of(spark, rows))
    got = sorted((str(r[0]), r[1]) for r in views.decisions().collect())
    assert got == [("None", "corrects"), ("a", "provisional"), ("b", "corrects"), ("b", "corrects"), ("c", "corrects"), ("d", "too_late"), ("g", "provisional"), ("h", "too_late")]
    assert served(views) == {("s", "2026-01-01"): (1, 3, 4, 1, True), (None, "2027-01-01"): (1, 0, 1, 0, False), ("s", "1970-01-01"): (0, 0, 0, 1, True), ("s", "2025-12-31"): (0, 1, 1, 0, True)}
    empty = LambdaViews(spark)
    empty.replay(log_of(spark, []))
    assert empty.decisions().count() == 0 and empty.serve().count() == 0
    assert LambdaViews(spark).decisions().count() == 0 and LambdaViews(spark).serve().count() == 0


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        at = D(2026, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 6))
        out.append((str(k), rng.choice(["s", "t", None]), at, at + dt.timedelta(hours=rng.choice([0, 1, 30, 60, 90, 200]))))
    return out


def test_replay_equals_a_run_at_each_midnight(spark):
    rows = rows_of(150, 2)
    steps, at_once = LambdaViews(spark), LambdaViews(spark)
    at_once.replay(log_of(spark, rows))
    first, last = min(r[3] for r in rows).date(), max(r[3] for r in rows).date()
    steps.run_batch(D(first.year, first.month, first.day))
    for k in range((last - first).days + 1):
        day = first + dt.timedelta(days=k)
        steps.on_micro_batch(log_of(spark, [r for r in rows if r[3].date() == day]), k)
        steps.run_batch(D(day.year, day.month, day.day) + dt.timedelta(days=1))
    assert served(steps) == served(at_once)
    assert sorted(map(tuple, steps.decisions().collect())) == sorted(map(tuple, at_once.decisions().collect()))


def test_a_record_delivered_after_the_run_that_it_arrived_before_is_served(spark):
    views = LambdaViews(spark)
    views.on_micro_batch(log_of(spark, [("a", "s", D(2026, 1, 5), D(2026, 1, 5, 1))]), 0)
    views.run_batch(D(2026, 1, 6))
    views.on_micro_batch(log_of(spark, [("b", "s", D(2026, 1, 5), D(2026, 1, 5, 2)), ("c", "s", D(2026, 1, 5), D(2026, 1, 9))]), 1)
    assert served(views) == {("s", "2026-01-05"): (1, 1, 2, 0, False)}
    again = LambdaViews(spark, views.path)  # opened again from its folder
    again.run_batch(D(2026, 1, 7))
    assert served(again) == {("s", "2026-01-05"): (1, 1, 2, 1, False)}
    again.run_batch(D(2026, 1, 9))
    again.on_micro_batch(log_of(spark, [("d", "s", D(2026, 1, 5), D(2026, 1, 5, 3))]), 2)
    again.run_batch(D(2026, 1, 10))
    assert served(again) == {("s", "2026-01-05"): (1, 1, 2, 2, True)}


def test_increments_are_what_is_served_before_a_run(spark):
    views = LambdaViews(spark)
    views.on_micro_batch(log_of(spark, rows_of(50, 4)), 0)
    views.on_micro_batch(log_of(spark, rows_of(50, 4)), 0)  # the same micro-batch again
    before = sum(v[2] for v in served(views).values())
    assert 0 < before < 50
    views.commits.folder.delete("fast")
    assert served(views) == {}


def test_runs_read_open_periods_only(spark):
    views = LambdaViews(spark)
    views.on_micro_batch(log_of(spark, rows_of(80, 5)), 0)
    views.run_batch(D(2026, 1, 20))
    frozen = served(views)
    assert all(v[4] for v in frozen.values())
    views.commits.folder.delete("log/batch-000000000000")  # frozen periods don't need it any more
    views.run_batch(D(2026, 1, 21))
    assert served(views) == frozen
    with pytest.raises(ValueError):
        views.replay(log_of(spark, []))


def test_stream(spark):
    rows = sorted(rows_of(120, 3), key=lambda r: r[3])
    path = scratch(spark, "log")
    for k in range(4):
        log_of(spark, rows[k::4]).coalesce(1).write.mode("append").parquet(path)
    views = LambdaViews(spark)
    s = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(views.on_micro_batch)
    s.option("checkpointLocation", scratch(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    fast = {k: v[2] for k, v in served(views).items()}
    views.run_batch(D(2026, 1, 8))
    views.run_batch(D(2026, 1, 12))
    assert {k: v[2] for k, v in served(views).items() if v[2]} == fast
