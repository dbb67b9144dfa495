"""Exactly one copy of each message, by idempotent upserts into hash-bucketed sorted storage.

A store holds, for each identifier, the smallest delivery. An upsert writes a run: identifiers collapsed (map side first),
bucketed by hash and sorted within each bucket. Compaction merges the sorted runs bucket by bucket, without moving a row between
buckets, and equal identifiers collapse to one. Which runs a store has is a commit in its folder, so that it can be opened again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Commits
from ..session import or_null, scratch, scratch_table, stored, trimmed

FOUND = "feed string, first_delivery_id long, copy_delivery_id long"
#: Identifiers a bucket is meant to hold; a compaction that finds four times as many moves to more buckets.
BUCKET_ROWS = 1_000_000
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def message_id(c: str) -> Column:
    """An identifier without regard to letter case and surrounding white space; null if blank."""
    return F.lower(or_null(trimmed(F.col(c))))


class StoreConflict(RuntimeError):
    """Another writer has committed since the store's state was read."""


class BucketStore:
    """Identifiers (key) and the smallest value of each, in sorted buckets under path. An existing store keeps its number of buckets; a new
    one takes it from expected_rows, at least one for each core."""

    def __init__(self, spark: SparkSession, path: str | None = None, expected_rows: int = 0) -> None:
        self.spark, self.path = spark, path or scratch(spark, "messages")
        self.commits, self._tables = Commits(spark, self.path), {}
        if not self.commits.last()[0]:
            buckets = max(spark.sparkContext.defaultParallelism, -(-expected_rows // BUCKET_ROWS))
            self.commits.make(1, {"buckets": buckets, "runs": {}})

    @property
    def runs(self) -> dict[str, str]:
        """The folder of each run."""
        return self.commits.last()[1]["runs"]

    def _commit(self, number: int, buckets: int, runs: dict[str, str]) -> None:
        if not self.commits.make(number + 1, {"buckets": buckets, "runs": runs}):
            raise StoreConflict(f"commit {number + 1} of {self.path} has been made")

    def upsert(self, run: str, rows: DataFrame, key: str = "key", value: str = "value") -> None:
        """Write a run of (key string, value long); null keys identify nothing and are left out. A run of a name the store has replaces that one."""
        number, state = self.commits.last()
        own = rows.select(F.col(key).alias("key"), F.col(value).cast("long").alias("value")).dropna()
        # a hot identifier collapses map side, before the shuffle; what is left is laid out one file for each bucket
        own = own.groupBy("key").agg(F.min("value").alias("value")).repartition(state["buckets"], "key")
        self._commit(number, state["buckets"], state["runs"] | {run: self._write(own, state["buckets"])})

    def _write(self, own: DataFrame, buckets: int) -> str:
        folder, name = f"run-{uuid.uuid4().hex}", scratch_table(self.spark)
        own.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", f"{self.path}/{folder}").saveAsTable(name)
        self._tables[folder] = name
        return folder

    def _read(self, folder: str, buckets: int) -> DataFrame:
        if folder not in self._tables:
            name = scratch_table(self.spark)
            self.spark.sql(f"CREATE TABLE {name} (key STRING, value BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'")
            self._tables[folder] = name
        return self.spark.table(self._tables[folder])

    @contextmanager
    def _sorted_scans(self):  # noqa: ANN202
        """Scans of one file for each bucket tell their order, so that a merge needs no sort. The session's setting is put back."""
        before = self.spark.conf.get(_ORDERED, "false")
        self.spark.conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_ORDERED, before)

    def merged(self, left: str, right: str, buckets: int) -> DataFrame:
        """Two runs merged: a merge join of sorted buckets, without exchange or sort; of equal keys the smaller value stays."""
        a, b = self._read(left, buckets), self._read(right, buckets).withColumnRenamed("value", "other")
        return a.hint("merge").join(b, "key", "full_outer").select("key", F.least("value", "other").alias("value"))

    def compact(self) -> DataFrame:
        """All runs merged into one, two at a time; returns it (key, value)."""
        number, state = self.commits.last()
        buckets, folders = state["buckets"], list(state["runs"].values())
        if not folders:
            folders = [self._write(self.spark.createDataFrame([], "key string, value long").repartition(buckets, "key"), buckets)]
        with self._sorted_scans():
            while len(folders) > 1:
                pairs = [folders[k : k + 2] for k in range(0, len(folders), 2)]
                folders = [self._write(self.merged(*p, buckets), buckets) if len(p) == 2 else p[0] for p in pairs]
        only = self._read(folders[0], buckets)
        rows = only.count()  # from the files' footers
        if rows > 4 * BUCKET_ROWS * buckets:
            wider = -(-rows // BUCKET_ROWS)
            folders, buckets = [self._write(only.repartition(wider, "key"), wider)], wider
        self._commit(number, buckets, {"merged": folders[0]})
        for folder in set(state["runs"].values()) - {folders[0]}:
            self._forget(folder)
        return self._read(folders[0], buckets)

    def _forget(self, folder: str) -> None:
        """The table's name is dropped; its files stay until vacuum(), as earlier results may read them."""
        if folder in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(folder)}")

    def vacuum(self) -> None:
        """Delete the runs that no commit names any more."""
        kept = set(self.runs.values())
        for name in self.commits.folder.names():
            if name.startswith("run-") and name not in kept:
                self._forget(name)
                self.commits.folder.delete(name)


def _arrivals(deliveries: DataFrame, keys: dict[str, Column], delivery: str, batch: str | None, runs: int) -> DataFrame:
    """The deliveries' identifiers, read once: keys, delivery, run. Batches are spread over `runs`; a null batch is one of its own."""
    run = F.pmod(F.xxhash64(F.coalesce(F.col(batch), F.lit(""))), F.lit(runs)).cast("int") if batch else F.lit(0)
    own = deliveries.select(*[k.alias(n) for n, k in keys.items()], F.col(delivery).cast("long").alias("delivery"), run.alias("run"))
    return stored(own.dropna(subset=["delivery"]).dropna("all", subset=list(keys)), "arrivals")


def first_by_id(deliveries: DataFrame, key: Column, delivery: str = "delivery_id", batch: str | None = "batch_id", runs: int = 2, store: BucketStore | None = None) -> DataFrame:
    """Each delivery that has an identifier, with the first delivery of its message: columns delivery, first.

    The batches are upserted in `runs` runs, which compaction merges. Null ids and null deliveries are left out; equal deliveries are rows each.
    A store that is given keeps what it held before, so a later call finds copies of earlier batches too.
    """
    rows = _arrivals(deliveries, {"key": key}, delivery, batch, runs if batch else 1)
    store = store or BucketStore(deliveries.sparkSession, expected_rows=rows.count())
    for k in range(runs if batch else 1):
        store.upsert(f"run-{k}", rows.filter(F.col("run") == k), "key", "delivery")
    return rows.drop("run").join(store.compact().withColumnRenamed("value", "first"), "key").select("delivery", "first")


def first_by_linked_ids(deliveries: DataFrame, keys: Sequence[Column], delivery: str = "delivery_id", batch: str | None = "batch_id", runs: int = 2, max_rounds: int = 60) -> DataFrame:
    """Like first_by_id where any of several identifiers may link deliveries, and so on through chains.

    The store holds the smallest label of every identifier. Batches are upserted as runs first; then each round upserts, of the deliveries
    with an identifier whose label is behind theirs, their label under all their identifiers, and compaction merges that run into the store. A label is also replaced by its own delivery's
    label, which halves chains. It ends when no label falls. Deliveries without any identifier are left out.
    """
    names = [f"k{n}" for n in range(len(keys))]
    # kinds of identifiers are kept apart by a prefix
    rows = _arrivals(deliveries, {n: F.concat(F.lit(f"{n}\x1f"), k) for n, k in zip(names, keys, strict=True)}, delivery, batch, runs if batch else 1)
    store = BucketStore(deliveries.sparkSession, expected_rows=len(names) * rows.count())

    def labels(of: DataFrame, label: str) -> DataFrame:
        return of.select(F.explode(F.array(*names)).alias("key"), F.col(label).alias("value")).dropna()

    for k in range(runs if batch else 1):
        store.upsert(f"run-{k}", labels(rows.filter(F.col("run") == k), "delivery"))
    # deliveries with the same identifiers have the same label; only those with several identifiers can carry one on
    several = rows.filter(F.size(F.array_compact(F.array(*names))) > 1)
    nodes = several.groupBy(*names).agg(F.min("delivery").alias("node")).withColumn("label", F.col("node")).checkpoint()
    for round_no in range(max_rounds):
        held = store.compact()
        new = nodes
        for n in names:
            new = new.join(held.select(F.col("key").alias(n), F.col("value").alias(f"{n}_held")), n, "left")
        new = new.withColumn("label", F.array_min(F.array("label", *[f"{n}_held" for n in names])))
        jump = nodes.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = new.join(jump, "label", "left").withColumn("label", F.least("label", "further")).drop("further").checkpoint()
        nodes = new.select(*names, "node", "label")
        fallen = new.filter(F.array_max(F.array(*[f"{n}_held" for n in names])) > F.col("label"))
        if fallen.isEmpty():
            break
        store.upsert(f"round-{round_no}", labels(fallen, "label"))
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    found = rows.select("delivery", F.coalesce(*names).alias("key")).join(held, "key")
    return found.select("delivery", F.col("value").alias("first"))


def _batch(df: DataFrame) -> str | None:
    return "batch_id" if "batch_id" in df.columns else None


def _copies(both: DataFrame, feed: str) -> DataFrame:
    return both.filter("delivery <> first").select(F.lit(feed).alias("feed"), F.col("first").alias("first_delivery_id"), F.col("delivery").alias("copy_delivery_id"))


def outbox_copies(outbox: DataFrame, store: BucketStore | None = None) -> DataFrame:
    """feed, first_delivery_id, copy_delivery_id of repeated deliveries in outbox_events; equal ids are one message."""
    return _copies(first_by_id(outbox, message_id("id"), batch=_batch(outbox), store=store), "outbox_events")


def dlq_copies(dlq: DataFrame) -> DataFrame:
    """The same for dlq_messages: within a consumer group, equal event_id or equal stream and stream_message_id link. A null
    group, or a null stream, is the same as no other."""
    event = F.concat_ws("\x1f", "consumer_group", message_id("event_id"))
    place = F.concat_ws("\x1f", "consumer_group", "stream", message_id("stream_message_id"))
    has = F.col("consumer_group").isNotNull()
    keys = [F.when(has & message_id("event_id").isNotNull(), event), F.when(has & F.col("stream").isNotNull() & message_id("stream_message_id").isNotNull(), place)]
    return _copies(first_by_linked_ids(dlq, keys, batch=_batch(dlq)), "dlq_messages")
