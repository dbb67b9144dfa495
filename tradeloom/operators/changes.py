"""Change detection: records of each identity folded in order against its stored state, in closed form over windows.

One shuffle by identity serves all windows. No record is handled one after another, so a hot source is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import stable_uuid
from ..functions.textnorm import FINGERPRINT_PREFIX, changed_fields

IDENTITY = ["source_id", "external_product_id"]


def classify(records: DataFrame, state: DataFrame) -> DataFrame:
    """records (IDENTITY, id, sua, ra, fp and anything else) with transition, prev_fp and version_number.

    state has one row for each known identity: IDENTITY, s_sua, s_ra, s_fp, s_refp (fingerprint computed anew from the
    stored version, or null), s_version. Records of an identity are ordered by (sua, nulls first; ra; id). STALE records change nothing; NEW and CHANGED
    ones are versions, numbered from the stored one; VERSION_MISMATCH is a stored fingerprint of an older scheme; else UNCHANGED.

    With a struct `canon` (textnorm.CANON) in records, and s_canon in state, changed_fields names what a CHANGED record changes; else it is empty.
    product_id is the state's s_product_id, if it has one, else made from the identity.
    """
    own = Window.partitionBy(*IDENTITY)
    order = own.orderBy(F.asc_nulls_first("sua"), "ra", "id")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    sua, ra = F.col("sua"), F.col("ra")
    extra = [c for c in ("s_product_id", "s_canon") if c in state.columns]
    known = state.select(*[F.col(k).alias(f"_{k}") for k in IDENTITY], "s_sua", "s_ra", "s_fp", "s_refp", "s_version", *extra)
    r = records.join(known, [F.col(k) == F.col(f"_{k}") for k in IDENTITY], "left").drop(*[f"_{k}" for k in IDENTITY])
    behind = F.coalesce(sua < F.col("s_sua"), F.lit(False))
    floor = F.greatest("s_ra", F.max(F.when(sua.isNull(), ra)).over(own))
    # without a stored source time, dated records count from the first that isn't received before the undated ones
    r = r.withColumn("_floor", floor)
    started = F.max(F.when(sua.isNotNull() & (F.col("_floor").isNull() | (ra >= F.col("_floor"))), 1).otherwise(0)).over(so_far) == 1
    r = r.withColumn("_alive", F.when(behind, False).when(sua.isNull() | F.col("s_sua").isNotNull(), True).otherwise(started))
    last_ra = F.greatest("s_ra", F.max(F.when(F.col("_alive"), ra)).over(before))
    last_sua = F.greatest("s_sua", F.max(F.when(F.col("_alive"), sua)).over(before))
    r = r.withColumn("_last_ra", last_ra).withColumn("_last_sua", last_sua)
    overtaken = F.coalesce((ra < F.col("_last_ra")) & (sua.isNull() | F.col("_last_sua").isNull() | (sua == F.col("_last_sua"))), F.lit(False))
    r = r.withColumn("_fresh", F.col("_alive") & ~overtaken)
    fresh_order = Window.partitionBy(*IDENTITY, "_fresh").orderBy(F.asc_nulls_first("sua"), "ra", "id")
    r = r.withColumn("prev_fp", F.when(F.col("_fresh"), F.coalesce(F.lag("fp").over(fresh_order), F.col("s_fp"))))
    adopted = ~F.col("prev_fp").startswith(FINGERPRINT_PREFIX) & F.coalesce(F.col("s_refp") == F.col("fp"), F.lit(False))
    transition = F.when(~F.col("_fresh"), "STALE").when(F.col("prev_fp").isNull(), "NEW").when(adopted, "VERSION_MISMATCH").when(F.col("prev_fp") == F.col("fp"), "UNCHANGED").otherwise("CHANGED")
    r = r.withColumn("transition", transition)
    fields = F.array().cast("array<string>")
    if "canon" in records.columns:
        stored_canon = F.col("s_canon") if "s_canon" in extra else F.lit(None).cast(records.schema["canon"].dataType)
        before_canon = F.coalesce(F.lag("canon").over(fresh_order), stored_canon)
        fields = F.when((F.col("transition") == "CHANGED") & before_canon.isNotNull(), changed_fields(before_canon, F.col("canon"))).otherwise(fields)
    made = stable_uuid(F.lit("product"), *[F.col(k) for k in IDENTITY])
    r = r.withColumn("changed_fields", fields).withColumn("product_id", F.coalesce("s_product_id", made) if "s_product_id" in extra else made)
    versioned = F.col("transition").isin("NEW", "CHANGED")
    number = F.coalesce("s_version", F.lit(0)) + F.sum(F.when(versioned, 1).otherwise(0)).over(so_far)
    return r.withColumn("version_number", F.when(versioned, number.cast("long"))).drop("_floor", "_alive", "_last_ra", "_last_sua", "_fresh")


def versions(classified: DataFrame) -> DataFrame:
    """The versions to append: IDENTITY, id of the record, version_number, fp, and a stable version id."""
    v = classified.filter(F.col("version_number").isNotNull())
    return v.withColumn("version_id", stable_uuid(F.lit("version"), *[F.col(k) for k in IDENTITY], F.col("version_number")))


def head_state(classified: DataFrame) -> DataFrame:
    """The final state of each identity that is touched: last version made (null if none), its fingerprint or the one adopted, watermarks."""
    live = F.col("transition") != "STALE"
    at = F.struct("version_number", "fp")
    g = classified.groupBy(*IDENTITY).agg(
        F.max(F.when(F.col("version_number").isNotNull(), at)).alias("last"),
        F.greatest(F.first("s_sua"), F.max(F.when(live, F.col("sua")))).alias("last_source_updated_at"),
        F.greatest(F.first("s_ra"), F.max(F.when(live, F.col("ra")))).alias("last_received_at"),
        F.bool_or(F.col("s_fp").isNull()).alias("is_new"),
        F.max(F.when(F.col("transition") == "VERSION_MISMATCH", F.col("fp"))).alias("adopted"),
        F.count_if(live).alias("live"),
    )
    return g.filter("live > 0").select(*IDENTITY, F.col("last.version_number").alias("version_number"), F.coalesce("last.fp", "adopted").alias("fingerprint"), "last_source_updated_at", "last_received_at", "is_new")


def counters(classified: DataFrame, *by: str, failed: Column | None = None) -> DataFrame:
    """seen, new, changed, unchanged (with stale and adopted ones) and failed, by the columns named."""
    is_failed = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    n = lambda *t: F.count_if(F.col("transition").isin(*t) & ~is_failed)
    return classified.groupBy(*by).agg(F.count("*").alias("seen"), n("NEW").alias("new"), n("CHANGED").alias("changed"), n("UNCHANGED", "STALE", "VERSION_MISMATCH").alias("unchanged"), F.count_if(is_failed).alias("failed"))


def over_budget(counted: DataFrame, max_error_rate: float, min_rows: int) -> DataFrame:
    """counted with error_rate and over_budget: more than the rate failed, of at least min_rows seen."""
    rate = F.when(F.col("seen") > 0, F.col("failed") / F.col("seen")).otherwise(0.0)
    return counted.withColumn("error_rate", rate).withColumn("over_budget", (F.col("seen") >= min_rows) & (F.col("error_rate") > max_error_rate))


def change_events(classified: DataFrame) -> DataFrame:
    """event_id, aggregate_type, aggregate_id, event_type and JSON payload of each version made."""
    v = versions(classified)
    # fixed values: the fields of the event's contract
    body = F.to_json(F.struct("product_id", "version_id", "version_number", F.col("fp").alias("fingerprint"), F.col("transition").alias("change_type"), "changed_fields"), {"ignoreNullFields": "false"})
    return v.select(stable_uuid(F.lit("event"), F.col("version_id")).alias("event_id"), F.lit("product").alias("aggregate_type"), F.col("product_id").alias("aggregate_id"), F.lit("product.changed").alias("event_type"), body.alias("payload"))
