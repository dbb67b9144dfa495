"""python workloads.py: times keyset pages at three depths, a run of 10,000 records and rate resolution over 205,000 rules; medians of five after a warm-up, one JSON line."""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.codes import encode_cursor
from tradeloom.functions.textnorm import FieldMapping
from tradeloom.operators.rules import resolve_tariffs
from tradeloom.operators.runs import process_run
from tradeloom.operators.tables import SnapshotStore, page
from tradeloom.session import build_session, scratch, ship_package, stored

START = dt.datetime(2026, 1, 1)


def median(work: Callable[[], object], times: int = 5) -> float:
    work()
    took = []
    for _ in range(times):
        began = time.time()
        work()
        took.append(time.time() - began)
    return round(statistics.median(took), 3)


def pages(spark: SparkSession) -> dict[str, float]:
    """A million rows in 2,000 batches of one created_at each."""
    at = F.lit(str(START)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.floor(F.col("id") / 500).cast("int"))
    rows = stored(spark.range(1_000_000).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("id"), at.alias("created_at")), "million")
    out = {}
    for depth in (0, 500_000, 999_500):
        last = 1_000_000 - depth  # the row before the page, counted from the end
        cursor = encode_cursor(START + dt.timedelta(minutes=last // 500), f"{last:07d}") if depth else None
        assert [r.id for r in page(rows, 500, cursor)[0].collect()][:2] == [f"{last - 1:07d}", f"{last - 2:07d}"]
        out[f"keyset_page_at_{depth}"] = median(lambda c=cursor: page(rows, 500, c)[0].collect())
    return out


def run(spark: SparkSession) -> dict[str, float]:
    """5,000 new and 5,000 changed records against a store of 5,000 products, 10,000 seen."""

    def records(first: int, n: int, round_no: int) -> DataFrame:
        k = F.col("id")
        payload = F.to_json(F.struct(F.concat(F.lit(f"Product {round_no} "), k.cast("string")).alias("title"), F.lit("Brand").alias("vendor"), F.lit("US").alias("country_code")))
        at = F.lit(str(START + dt.timedelta(days=round_no))).cast("timestamp_ntz")
        return spark.range(first, first + n).select(F.lit("s").alias("source_id"), k.cast("string").alias("external_product_id"), F.concat(F.lit(f"r{round_no}-"), k.cast("string")).alias("id"), payload.alias("payload"), at.alias("source_updated_at"), at.alias("received_at"))

    mapping = FieldMapping("title", None, "vendor", "country_code")
    stores = []
    for _ in range(4):
        stores.append(SnapshotStore(spark, scratch(spark, "store")))
        process_run(records(0, 5_000, 0), mapping, stores[-1])

    def once() -> None:
        got = process_run(records(0, 10_000, 1), mapping, stores.pop())
        assert (got.seen, got.new, got.changed) == (10_000, 5_000, 5_000)

    return {"run_10000_records": median(once, 3)}


def rates(spark: SparkSession) -> dict[str, float]:
    """205,000 rules in 11 datasets; each of 9,000 queries resolves to two measures of 11.5 %."""
    k = F.col("id")
    sets = spark.range(11).select(F.concat(F.lit("d"), k).alias("id"), F.when(k == 0, "US").otherwise(F.concat(F.lit("J"), F.chr(65 + k))).alias("jurisdiction"), F.lit("TARIFF").alias("category"), F.lit(str(START)).cast("timestamp_ntz").alias("fetched_at"), F.lit(str(START)).cast("timestamp_ntz").alias("activated_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    day, money = F.lit("2026-01-01").cast("date"), "decimal(12,4)"
    common = [F.lit("*").alias("origin_country"), F.lit("AD_VALOREM").alias("rate_type"), day.alias("effective_from"), F.lit(None).cast("date").alias("effective_to")]
    code = (k + 1_000_000_000).cast("string")
    mfn = spark.range(102_500).select(F.concat(F.lit("m"), k).alias("id"), F.concat(F.lit("d"), k % 11).alias("dataset_id"), code.alias("hs_code"), F.lit("MFN").alias("measure_type"), F.lit(None).cast("string").alias("measure_code"), F.lit("4").cast(money).alias("ad_valorem_percent"), *common)
    duty = spark.range(102_500).select(F.concat(F.lit("a"), k).alias("id"), F.concat(F.lit("d"), k % 11).alias("dataset_id"), code.alias("hs_code"), F.lit("ADDITIONAL_DUTY").alias("measure_type"), F.lit("SEC").alias("measure_code"), F.lit("7.5").cast(money).alias("ad_valorem_percent"), *common)
    rules = stored(mfn.unionByName(duty), "rules-205000")
    at = F.lit("2026-03-01 00:00:00").cast("timestamp_ntz")
    queries = stored(spark.range(0, 110_000, 11).select(k.alias("query_id"), F.lit("US").alias("jurisdiction"), F.lit("CN").alias("origin"), code.alias("hs_code"), at.alias("transaction_at"), at.alias("evaluated_at")).limit(9_000), "queries")
    sets = stored(sets, "sets")
    work = lambda: resolve_tariffs(queries, rules, sets).groupBy("hold_reason", "n_measures", "ad_valorem_percent").count().collect()
    got = work()
    assert [(r.hold_reason, r.n_measures, float(r.ad_valorem_percent)) for r in got] == [(None, 2, 11.5)], got
    return {"resolve_9000_queries_over_205000_rules": median(work)}


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    print(json.dumps(pages(spark) | run(spark) | rates(spark)))


if __name__ == "__main__":
    main()
