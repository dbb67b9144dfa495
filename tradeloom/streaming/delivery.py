"""Event delivery: outbox claims and outcomes, envelopes, consumer groups, idempotent effects, dead letters and replay."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codes import backoff_seconds, sanitised, stable_uuid
from ..operators.tables import insert_if_absent, latest_per_key

#: Failures that no retry mends, most specific first, and how each is classed; failures after which a message stays as it is.
PERMANENT = ("HANDLER_PANIC", "CORRUPT_ENVELOPE", "PAYLOAD_MISMATCH", "NOT_COMPLETED_IN_TX", "CONTRACT_VIOLATION", "MALFORMED_RECORD", "INVALID_CONFIG", "PERMANENT")
LEFT_PENDING = ("SHUTDOWN", "KEY_IN_PROGRESS", "LEASE_LOST")
EXHAUSTED = "TRANSIENT_EXHAUSTED"


def claim(outbox: DataFrame, now: str, batch: int) -> DataFrame:
    """The next pending events that are due, oldest first, with the event id consumers see (a replay keeps the original's)."""
    due = outbox.filter((F.col("status") == "PENDING") & (F.col("available_at") <= F.lit(now).cast("timestamp_ntz")))
    return due.orderBy("available_at", "id", "delivery_id").limit(max(1, min(batch, 1000))).withColumn("event_id", F.coalesce("replay_of_event_id", "id"))


def with_claims(outbox: DataFrame, claimed: DataFrame, token: str) -> DataFrame:
    """outbox with claim_token: the token on the rows that were claimed, joined back by delivery."""
    c = claimed.select(F.col("delivery_id").alias("_claimed"))
    return outbox.join(c, F.col("delivery_id") == F.col("_claimed"), "left").withColumn("claim_token", F.when(F.col("_claimed").isNotNull(), token)).drop("_claimed")


def released(outbox: DataFrame, published: DataFrame, now: str) -> DataFrame:
    """After a broker went down: claimed rows that were published are PROCESSED, the others are released without counting as a retry."""
    p = published.select(F.col("delivery_id").alias("_sent"))
    out = outbox.join(p, F.col("delivery_id") == F.col("_sent"), "left")
    sent = F.col("_sent").isNotNull() & F.col("claim_token").isNotNull()
    at = F.when(sent, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("processed_at"))
    return out.withColumn("status", F.when(sent, "PROCESSED").otherwise(F.col("status"))).withColumn("processed_at", at).withColumn("claim_token", F.lit(None).cast("string")).drop("_sent")


def claimable(rows: DataFrame, now: str, status: str = "status", lease: str = "lease_until") -> DataFrame:
    """Rows that are PENDING, or RUNNING under a lease that has run out."""
    expired = (F.col(status) == "RUNNING") & (F.col(lease) <= F.lit(now).cast("timestamp_ntz"))
    return rows.filter((F.col(status) == "PENDING") | F.coalesce(expired, F.lit(False)))


def retention(published: DataFrame, reads: DataFrame, keep_from: str) -> DataFrame:
    """stream, kept, trimmed, lost: messages published before keep_from are trimmed; those a reader (stream, entries_read) hadn't read by then are lost."""
    old = F.col("created_at") < F.lit(keep_from).cast("timestamp_ntz")
    g = published.groupBy("stream").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("trimmed"))
    read = F.coalesce("entries_read", F.lit(0))
    return g.join(reads, "stream", "left").select("stream", "kept", "trimmed", F.greatest(F.lit(0).cast("long"), F.col("trimmed") - read).alias("lost"))


def with_outcome(claimed: DataFrame, failed: str, base_seconds: float, max_seconds: float, max_attempts: int) -> DataFrame:
    """claimed after a publication: `failed` names a boolean column. Failures count, wait longer each time and end as FAILED."""
    bad, retries = F.coalesce(F.col(failed), F.lit(False)), F.col("retry_count")
    last = bad & (retries + 1 >= max_attempts)
    wait = backoff_seconds(retries, base_seconds, max_seconds)
    out = claimed.withColumn("wait_seconds", F.when(bad, wait)).withColumn("status", F.when(last, "FAILED").when(bad, "PENDING").otherwise("PROCESSED"))
    return out.withColumn("retry_count", F.when(bad, retries + 1).otherwise(retries))


def encode(events: DataFrame) -> DataFrame:
    """delivery_id, stream and the envelope of each event, a map of strings. Absent fields are left out."""
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = {"event_id": F.coalesce("replay_of_event_id", "id"), "aggregate_type": F.col("aggregate_type"), "aggregate_id": F.col("aggregate_id"), "event_type": F.col("event_type"), "payload": F.col("payload"), "created_at": at, "target_group": F.col("target_group")}
    if "correlation_id" in events.columns:
        fields["correlation_id"] = F.col("correlation_id")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    return events.select("delivery_id", F.col("event_type").alias("stream"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("envelope"))


def decode(messages: DataFrame) -> DataFrame:
    """Envelopes read back; corrupt tells of a missing event_id, event_type or valid created_at, whose message goes to the dead letters."""
    e = F.col("envelope")
    field = lambda k: F.when(F.length(F.trim(e[k])) > 0, e[k])
    at = F.try_to_timestamp(field("created_at"))
    names = ["event_id", "aggregate_type", "aggregate_id", "correlation_id", "event_type", "payload", "target_group"]
    out = messages.select("delivery_id", "stream", *[field(n).alias(n) for n in names], at.cast("timestamp_ntz").alias("created_at"))
    return out.withColumn("corrupt", F.col("event_id").isNull() | F.col("event_type").isNull() | F.col("created_at").isNull())


def for_group(messages: DataFrame, group: str) -> DataFrame:
    """What a consumer group handles: everything but replays meant for another group."""
    return messages.filter(F.col("target_group").isNull() | (F.col("target_group") == group))


def routed(failures: DataFrame, error: str, attempts: str, max_attempts: int) -> DataFrame:
    """failures with decision (DEAD_LETTER, RETRY or LEAVE_PENDING) and failure_class."""
    e = F.col(error)
    spent = F.col(attempts) >= max_attempts
    decision = F.when(e.isin(*LEFT_PENDING), "LEAVE_PENDING").when(e.isin(*PERMANENT) | spent, "DEAD_LETTER").otherwise("RETRY")
    kind = F.when(e.isin(*PERMANENT), e).when(~e.isin(*LEFT_PENDING) & spent, EXHAUSTED)
    return failures.withColumn("decision", decision).withColumn("failure_class", kind)


def replayable(corrupt: Column, texts: Sequence[str], payload: str = "payload") -> Column:
    """Whether a dead message can be sent again: its envelope was whole, the texts a replay copies hold no damage, it has a type, its payload is JSON."""
    intact = F.lit(True)
    for c in texts:
        intact = intact & F.coalesce(F.col(c) == sanitised(F.col(c), 1 << 30), F.lit(True))
    valid = F.try_parse_json(F.col(payload).cast("string")).isNotNull()
    return ~corrupt & intact & (F.coalesce(F.length(F.trim("event_type")), F.lit(0)) > 0) & F.coalesce(valid, F.lit(False))


def dead_letters(stored: DataFrame, dead: DataFrame) -> DataFrame:
    """The dead messages not stored yet, by (stream, consumer_group, stream_message_id), with clean error texts. If dead tells `corrupt`, `replayable` is computed."""
    own = dead
    if "corrupt" in dead.columns:
        own = own.withColumn("replayable", replayable(F.col("corrupt"), ["event_id", "event_type", "aggregate_type", "aggregate_id"]))
    own = own.select(*stored.columns).withColumn("last_error", sanitised(F.col("last_error"), 2000))
    return insert_if_absent(stored, own, ["stream", "consumer_group", "stream_message_id"])


def replay_events(dlq: DataFrame, now: str) -> DataFrame:
    """Outbox events that replay dead messages: a new id, the original event id, meant for the group that failed. A message is replayed once:
    the latest delivery of each (stream, group, message) that is DEAD and replayable."""
    one = latest_per_key(dlq, ["stream", "consumer_group", "stream_message_id"], [F.desc("dead_lettered_at"), F.desc("delivery_id")])
    good = one.filter((F.col("status") == "DEAD") & F.col("replayable") & (F.length("event_id") > 0))
    return good.select(stable_uuid(F.lit("replay"), F.col("stream"), F.col("consumer_group"), F.col("stream_message_id")).alias("id"), F.col("event_id").alias("replay_of_event_id"), F.col("consumer_group").alias("target_group"), "event_type", "aggregate_type", "aggregate_id", F.lit("PENDING").alias("status"), F.lit(now).cast("timestamp_ntz").alias("available_at"))


def replayed(dlq: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, dlq after, outcomes) of a request to replay messages by id: outcomes (id, outcome) are NOT_FOUND, ALREADY_REPLAYED, NOT_REPLAYABLE or
    REPLAYED; only the latter give an event and go from DEAD to REPLAYED. A message that several ids or deliveries name is replayed once."""
    one = latest_per_key(dlq, ["id"], [F.desc("dead_lettered_at"), F.desc("delivery_id")])
    ids = asked.select("id").dropna().distinct()
    own = ids.join(one.select("id", "status", "replayable", F.lit(True).alias("_held")), "id", "left")
    outcome = F.when(F.col("_held").isNull(), "NOT_FOUND").when(F.col("status") != "DEAD", "ALREADY_REPLAYED").when(~F.coalesce("replayable", F.lit(False)), "NOT_REPLAYABLE").otherwise("REPLAYED")
    outcomes = own.select("id", outcome.alias("outcome"))
    good = outcomes.filter("outcome = 'REPLAYED'").select("id")
    events = replay_events(one.join(good, "id"), now)
    after = dlq.join(good.withColumn("_good", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_good"), "REPLAYED").otherwise(F.col("status")))
    return events, after.select(*dlq.columns), outcomes


def acquire(effects: DataFrame, stored: DataFrame, now: str) -> DataFrame:
    """effects (scope, key, payload_hash, seq) with outcome: the first of each key is ACQUIRED unless the key is COMPLETED (ALREADY_COMPLETED) or held by an
    unexpired lease (IN_PROGRESS); another payload under the key is a MISMATCH; later copies are ALREADY_COMPLETED. stored: scope, key, s_hash, s_status, s_lease_until."""
    k = effects.join(stored, ["scope", "key"], "left")
    first = k.groupBy("scope", "key").agg(F.min_by("payload_hash", "seq").alias("first_hash"), F.min("seq").alias("first_seq"))
    k = k.join(first, ["scope", "key"])
    held = F.coalesce("s_hash", "first_hash")
    free = F.col("s_status").isNull() | ((F.col("s_status") != "COMPLETED") & (F.col("s_lease_until") <= F.lit(now).cast("timestamp_ntz")))
    outcome = F.when(F.col("payload_hash") != held, "MISMATCH").when(F.col("s_status") == "COMPLETED", "ALREADY_COMPLETED").when(~free, "IN_PROGRESS").when(F.col("seq") == F.col("first_seq"), "ACQUIRED").otherwise("ALREADY_COMPLETED")
    return k.select("scope", "key", "seq", outcome.alias("outcome"))


def relay(outbox_stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Publish an append-only outbox, a micro-batch at a time. A publication that raises runs again with the same batch id."""
    query = outbox_stream.writeStream.foreachBatch(lambda df, n: publish(encode(df), n)).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def consume(messages: DataFrame, group: str, handle: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """One consumer group with its own checkpoint: each event id is handled once, in whichever micro-batch it comes first. Every micro-batch is guarded by
    acquire against the effects completed before, a table beside the checkpoint that is written by batch id after the handler is done: a micro-batch that runs
    again leaves out its own effects, is handled as before and replaces them. handle must bear such a second run with the same batch id.
    dead gets what can't be handled, with failure_class: corrupt envelopes, and events whose id came before with another payload."""
    effects = f"{checkpoint.rstrip('/')}-effects"

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        df.persist()
        try:
            read = decode(df)
            # the table is created empty, under no batch id of a stream
            spark.createDataFrame([], "key string, s_hash string").write.mode("overwrite").parquet(f"{effects}/batch=-1")
            done = spark.read.schema("key string, s_hash string, batch long").parquet(effects).filter(F.col("batch") < n)
            held = done.select(F.lit(group).alias("scope"), "key", "s_hash", F.lit("COMPLETED").alias("s_status"), F.lit(None).cast("timestamp_ntz").alias("s_lease_until"))
            own = for_group(read.filter("not corrupt"), group).withColumn("payload_hash", F.sha2(F.coalesce("payload", F.lit("")), 256))
            asked = own.select(F.lit(group).alias("scope"), F.col("event_id").alias("key"), "payload_hash", F.col("delivery_id").alias("seq"))
            told = acquire(asked, held, "1970-01-01 00:00:00").select(F.col("key").alias("event_id"), F.col("seq").alias("delivery_id"), "outcome").distinct()
            own = own.join(told, ["event_id", "delivery_id"]).persist()
            try:
                fresh = own.filter("outcome = 'ACQUIRED'").dropDuplicates(["event_id"])
                mismatched = own.filter("outcome = 'MISMATCH'").select(*read.columns, F.lit("PAYLOAD_MISMATCH").alias("failure_class"))
                dead(read.filter("corrupt").withColumn("failure_class", F.lit("CORRUPT_ENVELOPE")).unionByName(mismatched), n)
                handle(fresh.select(*read.columns), n)
                fresh.select(F.col("event_id").alias("key"), F.col("payload_hash").alias("s_hash")).write.mode("overwrite").parquet(f"{effects}/batch={n}")
            finally:
                own.unpersist()
        finally:
            df.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
