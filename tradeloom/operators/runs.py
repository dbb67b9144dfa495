"""Runs over raw records: normalise, classify, publish as one, with an error budget over the run's totals."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import stable_uuid
from ..functions.textnorm import CANON, FieldMapping, canonical_fields, with_normalised
from ..session import stored
from .changes import IDENTITY, change_events, classify, head_state, versions
from .tables import SnapshotConflict, SnapshotStore, upsert

CANON_TYPE = "struct<" + ",".join(f"{c}:string" for c in CANON) + ">"
STATE = f"source_id string, external_product_id string, s_product_id string, s_sua timestamp_ntz, s_ra timestamp_ntz, s_fp string, s_refp string, s_version long, s_canon {CANON_TYPE}"
#: From each state of a run, the states it may go to.
RUN_STATES = {"PENDING": {"RUNNING", "FAILED", "CANCELLED"}, "RUNNING": {"COMPLETED", "PARTIAL", "FAILED", "CANCELLED"}, "COMPLETED": set(), "PARTIAL": set(), "FAILED": set(), "CANCELLED": set()}


def next_state(state: str, to: str, failed: int = 0) -> str:
    """`to`, or PARTIAL in place of COMPLETED if rows failed; ValueError if the run can't go there."""
    to = "PARTIAL" if to == "COMPLETED" and failed else to
    if to not in RUN_STATES[state]:
        raise ValueError(f"a {state} run can't become {to}")
    return to


@dataclass(frozen=True)
class RunResult:
    seen: int
    new: int
    changed: int
    unchanged: int
    failed: int
    over_budget: bool


def accepted(records: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """records with `refused`: null, or why a record may not be stored: NO_SOURCE, SOURCE_DISABLED (sources: id, enabled) or NO_RUN (runs: id, source_id; a record
    without run needs none). Sources and runs are looked up by distinct id, so repeated ones don't repeat records."""
    s = sources.groupBy(F.col("id").alias("_source")).agg(F.bool_or("enabled").alias("_enabled"))
    r = runs.select(F.col("id").alias("_run"), F.col("source_id").alias("_run_source")).distinct().withColumn("_has_run", F.lit(True))
    j = records.join(s, F.col("source_id") == F.col("_source"), "left").join(r, (F.col("ingestion_run_id") == F.col("_run")) & (F.col("source_id") == F.col("_run_source")), "left")
    why = F.when(F.col("_source").isNull(), "NO_SOURCE").when(~F.coalesce("_enabled", F.lit(False)), "SOURCE_DISABLED").when(F.col("ingestion_run_id").isNotNull() & F.col("_has_run").isNull(), "NO_RUN")
    return j.withColumn("refused", why).select(*records.columns, "refused")


def process_run(records: DataFrame, mapping: FieldMapping, store: SnapshotStore, max_error_rate: float = 0.5, min_rows: int = 100, now: dt.datetime | None = None, page_size: int | None = None) -> RunResult:
    """Fold records (IDENTITY, id, payload, source_updated_at, received_at, perhaps payload_raw) into the store's tables: products, product_sources and the
    fold's state are replaced for the identities touched; product_versions, product_changes and outbox_events are added to.

    What was folded is published before the budget is judged: a run that fails keeps its work. If another writer published meanwhile,
    the fold runs once more over the new state. Running the same records again changes nothing but the counters. page_size folds pages in the
    order of id one after another, as readers that page do; it is meant for comparison, as every page is a publication.
    """
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    raw = ["payload_raw"] if "payload_raw" in records.columns else []
    own = records.select(*IDENTITY, "id", F.col("source_updated_at").alias("sua"), F.col("received_at").alias("ra"), "payload", *raw)
    p = F.col("product")
    normal = with_normalised(own, mapping).withColumn("fp", p["fingerprint"])
    canon = canonical_fields(p["name"], p["description"], p["brand"], p["origin_country"], F.to_json(p["attributes"]))
    normal = stored(normal.withColumn("canon", F.when(F.col("fp").isNotNull(), canon)).drop("payload", *raw), "normalised")
    good = normal.filter("fp is not null")
    if page_size is None:
        n = _fold(good, store, now)
    else:
        numbered = stored(good.withColumn("_page", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / page_size)), "pages")
        n = Counter()
        for k in range(-(-numbered.count() // page_size)):
            n += _fold(numbered.filter(F.col("_page") == k).drop("_page"), store, now)
    failed = normal.filter("fp is null").count()
    good_n = sum(n.values())
    seen = good_n + failed
    return RunResult(seen, n["NEW"], n["CHANGED"], good_n - n["NEW"] - n["CHANGED"], failed, seen >= min_rows and failed > max_error_rate * seen)


def _fold(good: DataFrame, store: SnapshotStore, now: dt.datetime) -> Counter:
    """Classify against the store's state and publish; the number of records of each transition."""
    spark, at = good.sparkSession, F.lit(str(now)).cast("timestamp_ntz")
    for attempt in range(2):
        expected = store.manifest()["id"]
        state = store.read("state")
        state = spark.createDataFrame([], STATE) if state is None else state
        classified = stored(classify(good, state), "classified")
        made = versions(classified)
        head = head_state(classified).withColumnsRenamed({"fingerprint": "fp", "version_number": "version"})
        latest = made.groupBy(*IDENTITY).agg(F.max_by(F.struct("canon", "product", "version_id", "product_id"), "version_number").alias("last"))
        known = state.select(*IDENTITY, "s_product_id", F.col("s_version").alias("_v"), F.col("s_fp").alias("_f"), F.col("s_refp").alias("_r"), F.col("s_canon").alias("_c"))
        touched = head.join(known, IDENTITY, "left").join(latest, IDENTITY, "left")
        new_state = touched.select(*IDENTITY, F.coalesce("s_product_id", "last.product_id").alias("s_product_id"), F.col("last_source_updated_at").alias("s_sua"), F.col("last_received_at").alias("s_ra"), F.coalesce("fp", "_f").alias("s_fp"), F.coalesce("fp", "_r").alias("s_refp"), F.coalesce("version", "_v").alias("s_version"), F.coalesce("last.canon", "_c").alias("s_canon"))
        changed = touched.filter("version is not null")
        heads = changed.select(F.coalesce("s_product_id", "last.product_id").alias("id"), F.col("last.product.name").alias("canonical_name"), F.col("last.product.description").alias("description"), F.col("last.product.brand").alias("brand"), F.col("last.product.origin_country").alias("origin_country"), F.lit("DRAFT").alias("status"), F.col("last.version_id").alias("current_version_id"), F.col("fp").alias("current_fingerprint"), at.alias("created_at"), at.alias("updated_at"))
        sources = touched.select(F.coalesce("s_product_id", "last.product_id").alias("product_id"), *IDENTITY, at.alias("first_seen_at"), F.when(F.col("version").isNotNull(), at).alias("last_changed_at"), "last_source_updated_at", "last_received_at")
        old_heads, old_sources = store.read("products"), store.read("product_sources")
        if old_heads is not None:
            # adopted fingerprints and later watermarks move without a version
            adopted = touched.filter("version is null and fp is not null").select(F.col("s_product_id").alias("id"), F.col("fp").alias("_adopted"))
            old_heads = old_heads.join(adopted, "id", "left").withColumn("current_fingerprint", F.coalesce("_adopted", "current_fingerprint")).drop("_adopted")
            heads = upsert(old_heads, heads.select(*old_heads.columns), ["id"], keep=["created_at", "status"])
            before = old_sources.select(*IDENTITY, F.col("last_changed_at").alias("_changed"))
            sources = sources.join(before, IDENTITY, "left").withColumn("last_changed_at", F.coalesce("last_changed_at", "_changed")).drop("_changed")
            sources = upsert(old_sources, sources.select(*old_sources.columns), IDENTITY, keep=["first_seen_at"])
        own = ["product_id", "version_id", "version_number", "id", "fp", "product"]
        change = made.select(stable_uuid(F.lit("change"), F.col("version_id")).alias("id"), "product_id", F.col("version_id").alias("to_version_id"), F.col("transition").alias("change_type"), "changed_fields", F.col("id").alias("raw_record_id"), at.alias("detected_at"))
        tables = {"state": upsert(state, new_state, IDENTITY), "products": heads, "product_sources": sources}
        more = {"product_versions": made.select(*IDENTITY, *own), "product_changes": change, "outbox_events": change_events(classified).withColumn("created_at", at)}
        try:
            store.publish(tables, expected, more)
            break
        except SnapshotConflict:
            if attempt:
                raise
    return Counter({r["transition"]: r["n"] for r in classified.groupBy("transition").agg(F.count("*").alias("n")).collect()})
