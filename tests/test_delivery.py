from pyspark.sql import functions as F

from tradeloom.session import scratch
from tradeloom.streaming import delivery


def test_redeliveries_in_later_batches(spark):
    path, done, checkpoint = (scratch(spark, n) for n in ("messages", "effects", "checkpoint"))
    at = F.lit("2026-01-01T00:00:00.000000Z")

    def deliver(ids):
        rows = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "delivery_id long, id string")
        rows.select("delivery_id", F.lit("s").alias("stream"), F.create_map(F.lit("event_id"), "id", F.lit("event_type"), F.lit("t"), F.lit("created_at"), at).alias("envelope")).coalesce(1).write.mode("append").parquet(path)

    def run(fail=False):
        def handle(df, n):
            df.select("event_id").write.mode("overwrite").parquet(f"{done}/batch={n}")
            if fail:
                raise RuntimeError("after the effects")

        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
        delivery.consume(stream, "g", handle, lambda df, n: None, checkpoint).awaitTermination()

    deliver(["a", "b", "a"])
    deliver(["b", "c"])
    run()
    deliver(["a", "c", "d"])
    try:
        run(fail=True)
    except Exception:  # noqa: BLE001
        pass
    run()  # the failed micro-batch runs again
    assert sorted(r.event_id for r in spark.read.parquet(done).collect()) == ["a", "b", "c", "d"]


DLQ = "id string, stream string, consumer_group string, stream_message_id string, event_id string, event_type string, aggregate_type string, aggregate_id string, payload binary, last_error string, status string, replayable boolean, delivery_id long, dead_lettered_at timestamp_ntz"


def dead(k, event="e", kind="t", payload=b"{}", status="DEAD", replayable=True):
    return (f"d{k}", "s", "g", f"m{k}", event, kind, "a", "1", payload, "bad\x00text", status, replayable, k, None)


def test_what_can_be_replayed(spark):
    empty = spark.createDataFrame([], DLQ)
    rows = spark.createDataFrame([dead(1), dead(2, kind=" "), dead(3, payload=b"{"), dead(4, event="e\x00"), dead(5), dead(5)], DLQ)
    got = {r.id: (r.replayable, r.last_error) for r in delivery.dead_letters(empty, rows.withColumn("corrupt", F.col("id") == "d5")).collect()}
    assert got == {"d1": (True, "badtext"), "d2": (False, "badtext"), "d3": (False, "badtext"), "d4": (False, "badtext"), "d5": (False, "badtext")}


def test_replay_goes_from_dead_to_replayed_once(spark):
    dlq = spark.createDataFrame([dead(1), dead(2, status="REPLAYED"), dead(3, replayable=False), dead(4)], DLQ)
    asked = spark.createDataFrame([("d1",), ("d1",), ("d2",), ("d3",), ("gone",), (None,)], "id string")
    events, after, outcomes = delivery.replayed(dlq, asked, "2026-01-01 00:00:00")
    assert {r.id: r.outcome for r in outcomes.collect()} == {"d1": "REPLAYED", "d2": "ALREADY_REPLAYED", "d3": "NOT_REPLAYABLE", "gone": "NOT_FOUND"}
    assert [(r.replay_of_event_id, r.target_group) for r in events.collect()] == [("e", "g")]
    assert {r.id: r.status for r in after.collect()} == {"d1": "REPLAYED", "d2": "REPLAYED", "d3": "DEAD", "d4": "DEAD"}


def test_another_payload_under_a_handled_id_is_dead(spark):
    path, done, lost = (scratch(spark, n) for n in ("messages", "effects", "dead"))
    checkpoint = scratch(spark, "checkpoint")
    at = F.lit("2026-01-01T00:00:00.000000Z")

    def deliver(rows):
        df = spark.createDataFrame(rows, "delivery_id long, id string, payload string")
        df.select("delivery_id", F.lit("s").alias("stream"), F.create_map(F.lit("event_id"), "id", F.lit("event_type"), F.lit("t"), F.lit("created_at"), at, F.lit("payload"), "payload").alias("envelope")).coalesce(1).write.mode("append").parquet(path)

    for rows in ([(1, "a", "1"), (2, "a", "2"), (3, " ", "1")], [(4, "a", "1"), (5, "a", "3"), (6, "b", "1")]):
        deliver(rows)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        delivery.consume(stream, "g", lambda df, n: df.select("delivery_id").write.mode("overwrite").parquet(f"{done}/batch={n}"), lambda df, n: df.select("delivery_id", "failure_class").write.mode("overwrite").parquet(f"{lost}/batch={n}"), checkpoint).awaitTermination()
    assert sorted(r.delivery_id for r in spark.read.parquet(done).collect()) == [1, 6]
    assert sorted((r.delivery_id, r.failure_class) for r in spark.read.parquet(lost).collect()) == [(2, "PAYLOAD_MISMATCH"), (3, "CORRUPT_ENVELOPE"), (5, "PAYLOAD_MISMATCH")]
