"""Set updates of tables without MERGE, keyset pages, and snapshots published as one."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import Commits
from ..functions.codes import decode_cursor, encode_cursor, limit_of


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[k]) for k in keys]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(stored: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """stored with updates in place of the rows of the same keys; columns in keep stay as stored. Keys are unique in both."""
    kept = stored.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_had"))
    new = updates.join(kept, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    for c in keep:
        new = new.withColumn(c, F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    untouched = stored.join(updates.select(*keys), _on(stored, updates, keys), "left_anti")
    return untouched.unionByName(new.select(*stored.columns))


def insert_if_absent(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys aren't stored yet, one of each key (the smallest row)."""
    own = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in rows.columns if c not in keys])).alias("_r")).select(*keys, "_r.*")
    return own.join(stored.select(*keys), _on(own, stored, keys), "left_anti").select(*rows.columns)


def guarded_update(stored: DataFrame, updates: DataFrame, key: str, guard: str, expected: str, sets: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(stored with `sets` taken from updates where stored.guard is the expected value, nulls being values; the updates that weren't applied)."""
    u = updates.select(F.col(key).alias("_k"), F.col(expected).alias("_expected"), *[F.col(c).alias(f"_new_{c}") for c in sets])
    j = stored.join(u, F.col(key) == F.col("_k"), "left").withColumn("_hit", F.col("_k").isNotNull() & F.col(guard).eqNullSafe(F.col("_expected")))
    out = j.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in stored.columns])
    hit = j.filter("_hit").select(F.col("_k").alias("_done"))
    return out, updates.join(hit, F.col(key) == F.col("_done"), "left_anti")


def raise_watermarks(stored: DataFrame, seen: DataFrame, keys: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """The rows that change, with each mark the greater of both; null marks count as never."""
    s = seen.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(m).alias(f"_new_{m}") for m in marks])
    j = stored.join(s, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    moved = [~F.greatest(F.col(m), F.col(f"_new_{m}")).eqNullSafe(F.col(m)) for m in marks]
    any_moved = moved[0]
    for m in moved[1:]:
        any_moved |= m
    return j.filter(any_moved).select(*[F.greatest(F.col(c), F.col(f"_new_{c}")).alias(c) if c in marks else F.col(c) for c in stored.columns])


def change_marks(stored: DataFrame, changed: DataFrame, keys: Sequence[str], marks: Sequence[str], changed_at: str) -> DataFrame:
    """The rows of the keys in `changed`, with changed_at taken from it as it is and each mark the greater of both."""
    s = changed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(m).alias(f"_new_{m}") for m in marks], F.col(changed_at).alias("_at"))
    j = stored.join(s, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    return j.select(*[F.greatest(F.col(c), F.col(f"_new_{c}")).alias(c) if c in marks else F.col("_at").alias(c) if c == changed_at else F.col(c) for c in stored.columns])


def delete_unreferenced(stored: DataFrame, doomed: DataFrame, key: str, *children: tuple[DataFrame, str]) -> tuple[DataFrame, DataFrame]:
    """(stored without the doomed keys that no child refers to, the doomed keys that are in use)."""
    used = doomed.select(key).distinct().withColumn("_used", F.lit(False))
    for child, column in children:
        refs = child.select(F.col(column).alias(key)).dropna().distinct().withColumn("_ref", F.lit(True))
        used = used.join(refs, key, "left").withColumn("_used", F.col("_used") | F.coalesce("_ref", F.lit(False))).drop("_ref")
    return stored.join(used.filter(~F.col("_used")), key, "left_anti"), used.filter("_used").select(key)


def api_products(products: DataFrame) -> DataFrame:
    """The columns a reader of products is shown: no fingerprint, no identity in its source."""
    return products.select("id", "canonical_name", "description", "brand", "origin_country", "status", "current_version_id", "created_at", "updated_at")


def run_page(records: DataFrame, run_id: str, limit: int = 0, after: str | None = None) -> tuple[DataFrame, str | None]:
    """One page of a run's records in ascending order of id after the cursor (an id), and the next cursor. Limits: 50 by default, 1,000 at most."""
    n = limit_of(limit, 50, 1000)
    own = records.filter(F.col("ingestion_run_id") == run_id)
    rows = (own.filter(F.col("id") > after) if after else own).orderBy("id").limit(n + 1)
    ids = [r[0] for r in rows.select("id").collect()]  # at most 1,001 rows
    return (rows, None) if len(ids) <= n else (rows.orderBy("id").limit(n), ids[n - 1])


def page(df: DataFrame, limit: int = 0, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """One page in the order created_at desc, id desc, after the cursor, and the next cursor (null at the end). Limits: 50 by default, 500 at most.
    The condition is spelled out, so that it reaches the scan."""
    n = limit_of(limit, 50, 500)
    if cursor:
        at, row_id = decode_cursor(cursor)
        at = F.lit(str(at)).cast(df.schema["created_at"].dataType)
        df = df.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < row_id)))
    rows = df.orderBy(F.desc("created_at"), F.desc("id")).limit(n + 1)
    ends = rows.select("created_at", "id").collect()  # at most 501 rows
    if len(ends) <= n:
        return rows, None
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n), encode_cursor(*ends[n - 1])


class SnapshotConflict(RuntimeError):
    """Another writer published since the snapshot was read."""


class SnapshotStore:
    """Tables under a folder, published together: new files are written beside the old, then one commit names them. A reader sees all of a
    publication or nothing. Commits are numbered and each can be made once, so of two writers that read the same state one fails."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.commits = spark, path, Commits(spark, path)

    def manifest(self) -> dict:
        """id (a number, null before the first publication) and the folders of each table."""
        number, state = self.commits.last()
        return {"id": number or None, "tables": state.get("tables", {})}

    def read(self, name: str) -> DataFrame | None:
        folders = self.manifest()["tables"].get(name)
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def publish(self, tables: dict[str, DataFrame], expected: int | None, append: dict[str, DataFrame] | None = None) -> int:
        """Replace `tables` and add to those of `append`, whose earlier files stay as they are."""
        written = {}
        for name, df in [*tables.items(), *(append or {}).items()]:
            written[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{written[name]}")
        now = self.manifest()
        held = now["tables"] | {n: [written[n]] for n in tables} | {n: [*now["tables"].get(n, []), written[n]] for n in append or {}}
        number = (expected or 0) + 1
        if now["id"] != expected or not self.commits.make(number, {"tables": held}):
            raise SnapshotConflict(f"expected {expected}, found {self.manifest()['id']}")
        return number
