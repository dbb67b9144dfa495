"""Declared constraints, re-checked: each validator gives (constraint, key), one row for each broken rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import overlaps


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows for which a rule is false; a rule that is null holds, as in SQL. One pass over df."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("constraint"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has; null keys are no duplicates."""
    g = df.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1")
    return g.select(F.lit(name).alias("constraint"), F.concat_ws("/", *keys).alias("key"))


def _together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_tariff_rates(rates: DataFrame) -> DataFrame:
    c = F.col
    single = violations(rates, "id", {
        "hs_code_format": c("hs_code").rlike(r"\A([0-9]{2}){1,5}\z"),
        "origin_format": c("origin_country").rlike(r"\A([A-Z]{2}|\*)\z"),
        "range": c("effective_to") > c("effective_from"),
        "measure_code_iff_not_mfn": (c("measure_type") == "MFN") == c("measure_code").isNull(),
        "ad_valorem_present": ~c("rate_type").isin("AD_VALOREM", "COMPOUND") | c("ad_valorem_percent").isNotNull(),
        "specific_present": ~c("rate_type").isin("SPECIFIC", "COMPOUND") | c("specific_amount").isNotNull(),
        "preferential_needs_origin": (c("measure_type") != "PREFERENTIAL") | (c("origin_country") != "*"),
    })
    over = overlaps(rates, ["dataset_id", "hs_code", "origin_country", "measure_type", "measure_code"], "effective_from", "effective_to")
    return _together(single, over.select(F.lit("no_overlap").alias("constraint"), F.col("id").alias("key")))


def check_datasets(datasets: DataFrame) -> DataFrame:
    c = F.col
    single = violations(datasets, "id", {
        "status": c("status").isin("LOADED", "ACTIVE", "SUPERSEDED", "REJECTED"),
        "sha256_length": F.octet_length("content_sha256") == 32,
        "active_needs_activation": ~c("status").isin("ACTIVE", "SUPERSEDED") | c("activated_at").isNotNull(),
        "superseded_iff_end": (c("status") == "SUPERSEDED") == c("superseded_at").isNotNull(),
        "range": c("superseded_at") > c("activated_at"),
    })
    line = ["jurisdiction", "category", "source"]
    return _together(single, duplicates(datasets, "unique_version", [*line, "version"]), duplicates(datasets.filter("status = 'ACTIVE'"), "one_active", line))


def check_outbox(outbox: DataFrame) -> DataFrame:
    c = F.col
    own = outbox if "claim_token" in outbox.columns else outbox.withColumn("claim_token", F.lit(None).cast("string"))
    return violations(own, "delivery_id", {
        "status": c("status").isin("PENDING", "PROCESSED", "FAILED"),
        "processed_iff_time": (c("status") == "PROCESSED") == c("processed_at").isNotNull(),
        "replay_fields": c("replay_of_event_id").isNull() == c("target_group").isNull(),
        "retry_count": c("retry_count") >= 0,
        "claim_only_pending": c("claim_token").isNull() | (c("status") == "PENDING"),
    })


def check_dlq(dlq: DataFrame) -> DataFrame:
    c = F.col
    return violations(dlq, "delivery_id", {
        "status": c("status").isin("DEAD", "REPLAYED"),
        "attempts": c("attempts") >= 1,
        "order": c("first_failed_at") <= c("dead_lettered_at"),
        "replayable_needs_event": ~c("replayable") | (F.length(c("event_type")) > 0),
    })


def check_changes(versions: DataFrame) -> DataFrame:
    return _together(violations(versions, "id", {"version_number": F.col("version_number") >= 1, "name_length": F.length("canonical_name") <= 512}), duplicates(versions, "unique_number", ["product_id", "version_number"]))


@dataclass(frozen=True)
class RuleTable:
    """What rows of a rule table must keep: texts that aren't blank, columns with a pattern, and the key under which validities don't overlap."""

    category: str
    texts: tuple[str, ...]
    patterns: dict[str, str]
    key: tuple[str, ...]


_HS, _ANY, _COUNTRY = r"\A([0-9]{2}){1,5}\z", r"\A([A-Z]{2}|\*)\z", r"\A[A-Z]{2}\z"
#: The rule tables beside the tariff's.
RULE_TABLES = {
    "import_restrictions": RuleTable("IMPORT_RESTRICTION", ("description",), {"hs_code": _HS, "origin_country": _ANY}, ("hs_code", "origin_country")),
    "permit_requirements": RuleTable("PERMIT", ("permit_code", "issuing_agency", "document_type"), {"hs_code": _HS, "origin_country": _ANY}, ("hs_code", "origin_country", "permit_code")),
    "sanctions_list": RuleTable("SANCTIONS", ("list_entry_id", "primary_name", "program"), {"entity_type": r"\A(INDIVIDUAL|ENTITY|VESSEL|AIRCRAFT)\z"}, ("list_entry_id",)),
    "export_controls": RuleTable("EXPORT_CONTROL", ("control_code", "licence_type"), {"hs_code": _HS, "destination_country": _ANY}, ("hs_code", "destination_country", "control_code")),
    "preferential_agreements": RuleTable("PREFERENTIAL_AGREEMENT", ("proof_of_origin",), {"agreement_code": r"\A[A-Z0-9_]+\z", "partner_country": _COUNTRY}, ("agreement_code", "partner_country")),
}


def check_rules(rules: DataFrame, datasets: DataFrame, name: str) -> DataFrame:
    """Broken rules of a table of RULE_TABLES: blank or missing texts, patterns, range, dataset of the category, overlaps."""
    t = RULE_TABLES[name]
    held = {f"{c}_present": F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0 for c in (*t.texts, "source_reference")}
    held |= {f"{c}_format": F.coalesce(F.col(c).rlike(p), F.lit(False)) for c, p in t.patterns.items()}
    held |= {"starts": F.col("effective_from").isNotNull(), "range": F.col("effective_to") > F.col("effective_from")}
    own = datasets.filter(F.col("category") == t.category).select(F.col("id").alias("dataset_id"))
    strays = rules.join(own, "dataset_id", "left_anti").select(F.lit("dataset_of_category").alias("constraint"), F.col("id").alias("key"))
    over = overlaps(rules, ["dataset_id", *t.key], "effective_from", "effective_to").select(F.lit("no_overlap").alias("constraint"), F.col("id").alias("key"))
    return _together(violations(rules, "id", held), strays, over)


def check_idempotency(keys: DataFrame) -> DataFrame:
    c = F.col
    open_ = (c("status") == "IN_PROGRESS") & c("lease_token").isNotNull() & c("lease_expires_at").isNotNull() & c("completed_at").isNull()
    done = (c("status") == "COMPLETED") & c("completed_at").isNotNull() & c("lease_token").isNull() & c("lease_expires_at").isNull()
    return _together(violations(keys, "key", {"state": open_ | done, "hash_length": F.octet_length("payload_hash") == 32, "attempts": c("attempts") >= 1}), duplicates(keys, "unique_key", ["scope", "key"]))


def check_runs(runs: DataFrame) -> DataFrame:
    """States, and one active run for each source."""
    active = runs.filter(F.col("status").isin("PENDING", "RUNNING"))
    return _together(violations(runs, "id", {"status": F.col("status").isin("PENDING", "RUNNING", "COMPLETED", "PARTIAL", "FAILED", "CANCELLED")}), duplicates(active, "one_active_run", ["source_id"]))


def check_product_changes(changes: DataFrame) -> DataFrame:
    return _together(violations(changes, "id", {"change_type": F.col("change_type").isin("NEW", "CHANGED")}), duplicates(changes, "unique_to_version", ["to_version_id"]))
