import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradeloom.functions.codes import decode_cursor, encode_cursor, hs_code, limit_of, parse_checkpoint, retries_fit, stable_uuid
from tradeloom.operators.constraints import check_tariff_rates
from tradeloom.operators.rules import overlaps, resolve_tariffs
from tradeloom.operators.tables import SnapshotConflict, SnapshotStore, guarded_update, insert_if_absent, page, raise_watermarks, upsert
from tradeloom.session import scratch

D, TS = dt.date, dt.datetime
RATE = "id string, dataset_id string, hs_code string, origin_country string, measure_type string, measure_code string, rate_type string, ad_valorem_percent decimal(12,4), specific_amount decimal(12,4), effective_from date, effective_to date"


def rate(i, code, origin, kind="MFN", mcode=None, rtype="AD_VALOREM", pct="5", start=D(2026, 1, 1), end=None, dataset="d"):
    from decimal import Decimal

    return (i, dataset, code, origin, kind, mcode, rtype, Decimal(pct) if pct else None, None, start, end)


def resolved(spark, rates, queries):
    sets = spark.createDataFrame([("d", "EU", "TARIFF", TS(2026, 3, 1), TS(2025, 1, 1), None), ("j", "JP", "TARIFF", TS(2026, 2, 28, 23), TS(2025, 1, 1), None)], "id string, jurisdiction string, category string, fetched_at timestamp_ntz, activated_at timestamp_ntz, superseded_at timestamp_ntz")
    q = spark.createDataFrame([(k, j, o, c, TS(2026, 3, 1), TS(2026, 3, 2)) for k, (j, o, c) in enumerate(queries)], "query_id long, jurisdiction string, origin string, hs_code string, transaction_at timestamp_ntz, evaluated_at timestamp_ntz")
    out = resolve_tariffs(q, spark.createDataFrame(rates, RATE), sets, 24).orderBy("query_id").collect()
    return [r.hold_reason or (r.n_measures, float(r.ad_valorem_percent)) for r in out]


def test_resolution(spark):
    rates = [rate("a", "85", "*", pct="10"), rate("b", "8516", "*", pct="8"), rate("c", "85", "CN", pct="3"), rate("d", "8516", "*", "ADDITIONAL_DUTY", "X", pct="1.5"), rate("e", "90", "*"), rate("f", "90", "*"), rate("g", "91", "*", rtype="UNSUPPORTED_MEASURE", pct=None), rate("h", "92", "*", "ADDITIONAL_DUTY", "X"), rate("p", "8516", "CN", "PREFERENTIAL", "P", pct="0")]
    got = resolved(spark, rates, [("EU", "CN", "8516.10"), ("EU", "VN", "8516"), ("EU", "VN", "90"), ("EU", "VN", "91"), ("EU", "VN", "92"), ("US", "VN", "85"), ("EU", "VN", "8"), ("EU", None, "85"), ("EU", "VN", "77"), ("EU", "DE", "85"), ("JP", "CN", "85"), ("US", "US", "85")])
    # an own-origin rule of a short code beats an any-origin rule of a longer one
    assert got == [(2, 4.5), (2, 9.5), "AMBIGUOUS_TARIFF", "UNSUPPORTED_MEASURE", "NO_TARIFF_RATE", "NO_REGULATORY_COVERAGE", "INVALID_QUERY", "INVALID_QUERY", "NO_TARIFF_RATE", "INVALID_QUERY", "STALE_REGULATORY_DATA", "INVALID_QUERY"]


def test_overlaps_and_constraints(spark):
    rows = [rate("a", "85", "*", end=D(2026, 6, 1)), rate("b", "85", "*", start=D(2026, 2, 1), end=D(2026, 3, 1)), rate("c", "85", "*", start=D(2026, 5, 1)), rate("d", "85", "*", start=D(2026, 6, 1)), rate("e", "85", "CN", end=D(2026, 1, 1)), rate("f", "8", "c", "ADDITIONAL_DUTY", pct=None)]
    df = spark.createDataFrame(rows, RATE)
    assert sorted(r.id for r in overlaps(df, ["hs_code", "origin_country"], "effective_from", "effective_to").collect()) == ["b", "c", "d"]
    bad = {(r.constraint, r.key) for r in check_tariff_rates(df).collect()}
    assert {("range", "e"), ("hs_code_format", "f"), ("origin_format", "f"), ("measure_code_iff_not_mfn", "f"), ("ad_valorem_present", "f"), ("no_overlap", "b")} <= bad
    assert check_tariff_rates(df.limit(0)).count() == 0


def test_set_updates(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", None)], "id int, v string, mark int")
    new = spark.createDataFrame([(2, "B", 1), (4, "D", 9)], "id int, v string, mark int")
    assert sorted(map(tuple, upsert(old, new, ["id"], keep=["mark"]).collect())) == [(1, "a", 5), (2, "B", 6), (3, "c", None), (4, "D", 9)]
    assert sorted(map(tuple, insert_if_absent(old, new.unionByName(new), ["id"]).collect())) == [(4, "D", 9)]
    updates = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "wrong", "z"), (9, "a", "q")], "id int, expected string, v string")
    out, lost = guarded_update(old, updates, "id", "v", "expected", ["v"])
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, "x"), (2, "y"), (3, "c")] and sorted(r.id for r in lost.collect()) == [3, 9]
    seen = spark.createDataFrame([(1, 4), (2, 7), (3, 1)], "id int, mark int")
    assert sorted((r.id, r.mark) for r in raise_watermarks(old, seen, ["id"], ["mark"]).collect()) == [(2, 7), (3, 1)]


def test_pages_cover_ties(spark):
    df = spark.createDataFrame([(f"{k:03}", TS(2026, 1, 1 + k // 40)) for k in range(100)], "id string, created_at timestamp_ntz")
    got, cursor = [], None
    while True:
        rows, cursor = page(df, 30, cursor)
        got += [r.id for r in rows.collect()]
        if cursor is None:
            break
    assert got == [r.id for r in df.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    plan = page(df, 30, encode_cursor(TS(2026, 1, 2), "050"))[0]._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_codecs(spark):
    at = TS(2026, 1, 2, 3, 4, 5, 6)
    assert decode_cursor(encode_cursor(at, "x")) == (at, "x")
    for bad in ["", "a b", encode_cursor(at, "x") + "!", "eyJpZCI6IjEifQ"]:
        with pytest.raises(ValueError):
            decode_cursor(bad)
    assert parse_checkpoint("OFFSET:7") == ("offset", 7) and parse_checkpoint("cursor:a:b") == ("cursor", "a:b") and parse_checkpoint(" ") is None
    assert parse_checkpoint("2026-01-01T00:00:00Z")[0] == "time"
    with pytest.raises(ValueError):
        parse_checkpoint("offset:-1")
    assert limit_of(0, 50, 500) == 50 and limit_of(900, 50, 500) == 500 and retries_fit(3, 10, 5, 41) and not retries_fit(3, 10, 5, 40)
    df = spark.createDataFrame([("85.16 10",), ("851",), (None,), ("８５",)], "c string")
    assert [r.h for r in df.select(hs_code(F.col("c")).alias("h")).collect()] == ["851610", None, None, None]
    u = spark.range(50).select(stable_uuid(F.col("id")).alias("u")).distinct()
    assert u.count() == 50 and u.filter(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}$")).count() == 50


def test_snapshots_are_published_whole(spark):
    store = SnapshotStore(spark, scratch(spark, "snap"))
    one = store.publish({"a": spark.range(3), "b": spark.range(1)}, None)
    with pytest.raises(SnapshotConflict):
        store.publish({"a": spark.range(9)}, None)
    assert store.read("a").count() == 3
    store.publish({"a": spark.range(4)}, one)
    assert store.read("a").count() == 4 and store.read("b").count() == 1 and store.read("c") is None


def test_rule_tables(spark):
    from tradeloom.operators.constraints import RULE_TABLES, check_idempotency, check_product_changes, check_rules, check_runs

    sets = spark.createDataFrame([(f"d{k}", t.category) for k, t in enumerate(RULE_TABLES.values())], "id string, category string")
    good = {"hs_code": "8516", "origin_country": "CN", "destination_country": "*", "partner_country": "VN", "agreement_code": "PACT_1", "entity_type": "VESSEL"}
    for k, (name, t) in enumerate(RULE_TABLES.items()):
        columns = ["id", "dataset_id", *dict.fromkeys([*t.texts, *t.patterns, *t.key]), "source_reference", "effective_from", "effective_to"]
        schema = ", ".join(f"{c} {'date' if c.startswith('effective') else 'string'}" for c in columns)

        def row(i, start=D(2026, 1, 1), end=None, dataset=f"d{k}", columns=columns, **other):
            known = {"id": i, "dataset_id": dataset, "effective_from": start, "effective_to": end} | other
            return tuple(known[c] if c in known else good.get(c, f"text {c}") for c in columns)

        first = t.key[0]
        rows = [row("a", end=D(2026, 2, 1)), row("b", start=D(2026, 2, 1)), row("c", start=D(2026, 3, 1)), row("r", start=D(2020, 1, 1), end=D(2020, 1, 1)), row("x", start=D(2010, 1, 1), end=D(2011, 1, 1), dataset="elsewhere"), row("s", start=D(2012, 1, 1), end=D(2013, 1, 1), source_reference=" ")]
        if first in t.patterns:
            rows.append(row("p", start=D(2014, 1, 1), end=D(2015, 1, 1), **{first: "?"}))
        got = {(r.constraint, r.key) for r in check_rules(spark.createDataFrame(rows, schema), sets, name).collect()}
        want = {("no_overlap", "c"), ("range", "r"), ("dataset_of_category", "x"), ("source_reference_present", "s")} | ({(f"{first}_format", "p")} if first in t.patterns else set())
        assert got == want, (name, got)
    keys = "scope string, key string, status string, payload_hash binary, lease_token string, lease_expires_at timestamp_ntz, attempts int, completed_at timestamp_ntz"
    at, h = TS(2026, 1, 1), b"x" * 32
    rows = [("s", "open", "IN_PROGRESS", h, "t", at, 1, None), ("s", "done", "COMPLETED", h, None, None, 2, at), ("s", "bad", "COMPLETED", h, "t", at, 1, at), ("s", "short", "COMPLETED", b"x", None, None, 0, at), ("s", "open", "IN_PROGRESS", h, "t", at, 1, None)]
    got = {(r.constraint, r.key) for r in check_idempotency(spark.createDataFrame(rows, keys)).collect()}
    assert got == {("state", "bad"), ("hash_length", "short"), ("attempts", "short"), ("unique_key", "s/open")}
    runs = spark.createDataFrame([("1", "s", "PENDING"), ("2", "s", "RUNNING"), ("3", "t", "RUNNING"), ("4", "t", "LOST")], "id string, source_id string, status string")
    assert {(r.constraint, r.key) for r in check_runs(runs).collect()} == {("status", "4"), ("one_active_run", "s")}
    changes = spark.createDataFrame([("1", "v", "NEW"), ("2", "v", "CHANGED"), ("3", "w", "OLD")], "id string, to_version_id string, change_type string")
    assert {(r.constraint, r.key) for r in check_product_changes(changes).collect()} == {("change_type", "3"), ("unique_to_version", "v")}


def test_checkpoint_texts():
    from tradeloom.functions.codes import format_checkpoint

    for kind, value in (("offset", 7), ("page", 3), ("cursor", "tok:en"), ("time", TS(2026, 1, 2, 3, tzinfo=dt.UTC))):
        assert parse_checkpoint(format_checkpoint(kind, value)) == (kind, value)
    assert format_checkpoint("cursor", " ") == "" and format_checkpoint("cursor", "cursor:x") == "cursor:x"
    with pytest.raises(ValueError):
        format_checkpoint("offset", -1)
