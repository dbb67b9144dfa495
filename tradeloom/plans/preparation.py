"""Queries of the general training-data problems (1, 2, 5, 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.known_at import known_rows, tariffs_known
from ..operators.messages import BucketStore, dlq_copies, first_by_id, message_id, outbox_copies
from ..operators.nested import flatten
from ..session import scratch, table
from ..streaming.lateness import LambdaViews

def p1_found(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("positions")
    prices = flatten(table(spark, d, "raw_records")).tagged().filter("table_tag = 'prices'")
    return prices.select(F.col("record_id").alias("raw_record_id"), at[0].alias("variant_no"), at[1].alias("pack_no"), at[2].alias("price_no"))


def p1_table_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows, parents and records of each flat table."""
    rows = flatten(table(spark, d, "raw_records")).tagged()
    return rows.groupBy("table_tag").agg(F.count("*").alias("n_rows"), F.count_distinct("record_id").alias("n_records"))


def p1_price_list(spark: SparkSession, d: str) -> DataFrame:
    """Prices under their schema, with their pack's code and variant's sku reached over the parent keys."""
    flat = flatten(table(spark, d, "raw_records"))
    packs = flat.get("packs").select(F.col("pk").alias("pack_pk"), F.col("parent_pk").alias("variant_pk"), "code")
    variants = flat.get("variants").select(F.col("pk").alias("variant_pk"), "sku")
    prices = flat.get("prices").select("pk", F.col("parent_pk").alias("pack_pk"), "currency", F.expr("try_cast(amount as decimal(18,4))").alias("amount"))
    return prices.join(packs, "pack_pk").join(variants, "variant_pk").select("pk", "sku", "code", "currency", "amount")


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    return tariffs_known(table(spark, d, "tariff_queries"), table(spark, d, "tariff_rates"), table(spark, d, "regulatory_datasets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    wide, names = _known(spark, d)
    return known_rows(wide, ["query_id"], names, "rate_id")


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each query with a measure: each measure with the rates known of it, in the order of measures. Measures come from the data."""
    wide, names = _known(spark, d)
    told = [F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit(f"{n}="), F.array_join(f"`{n}`", ","))) for n in names]
    return wide.select("query_id", F.concat_ws(";", *told).alias("known"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return outbox_copies(table(spark, d, "outbox_events")).unionByName(dlq_copies(table(spark, d, "dlq_messages")))


def p5_reopened(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries of batches upserted into one store, which is opened again in between; messages and the sum of their first deliveries."""
    outbox, path = table(spark, d, "outbox_events"), scratch(spark, "store")
    later = F.crc32(F.coalesce("batch_id", F.lit(""))) % 3 == 0
    for part in (outbox.filter(~later), outbox.filter(later)):
        store = BucketStore(spark, path)
        first_by_id(part, message_id("id"), store=store)
    return BucketStore(spark, path).compact().agg(F.count("*").alias("messages"), F.sum("value").alias("first_deliveries"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """The one delivery of each outbox message that is kept; deliveries without id are kept all."""
    outbox = table(spark, d, "outbox_events")
    copies = outbox_copies(outbox).select(F.col("copy_delivery_id").alias("delivery_id"))
    return outbox.select("delivery_id", "event_type", "status").join(copies, "delivery_id", "left_anti")


def _views(spark: SparkSession, d: str) -> LambdaViews:
    """The catalogue's log replayed through both layers: micro-batches of a day, a batch run at each midnight."""
    views = LambdaViews(spark)
    views.replay(table(spark, d, "raw_records"))
    return views


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d).decisions().filter("verdict <> 'provisional'")


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    """Counts for each supplier and day, as served at the midnight after the last arrival."""
    return _views(spark, d).serve()


QUERIES = {f.__name__: f for f in (p1_found, p1_table_sizes, p1_price_list, p2_found, p2_attributes, p5_found, p5_kept, p5_reopened, p6_found, p6_periods)}

# DuckDB's json_tree walks every node of a payload; the product is the first object that has a title.
_PAYLOADS = r"""
opened AS (SELECT id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN
             CASE WHEN json_valid(json_extract_string(payload, '$')) THEN json_extract_string(payload, '$') END ELSE payload END END AS body FROM raw_records),
objects AS (SELECT id, body FROM opened WHERE body IS NOT NULL AND json_type(body) = 'OBJECT'),
products_of AS (SELECT id, CASE WHEN json_exists(body, '$.title') THEN body WHEN json_exists(body, '$.item.title') THEN json_extract(body, '$.item')
             WHEN json_exists(body, '$.payload.catalog.entry.title') THEN json_extract(body, '$.payload.catalog.entry') END AS product FROM objects)"""


def _unnested(parent: str, column: str, key: str, names: tuple[str, str, str], out: str, carried: str) -> str:
    lists = ", ".join(f"CASE WHEN json_type({column}, '$.{n}') IN ('ARRAY', 'OBJECT') THEN json_extract({column}, '$.{n}') END" for n in names)
    return f"""
{out}_of AS (SELECT {carried}, coalesce({lists}) AS l FROM {parent} WHERE {column} IS NOT NULL),
{out}_lists AS (SELECT {carried}, CASE WHEN json_type(l) = 'OBJECT' THEN [l] ELSE json_extract(l, '$[*]') END AS ls FROM {out}_of WHERE l IS NOT NULL),
{out} AS (SELECT * FROM (SELECT {carried}, CAST(k - 1 AS INTEGER) AS {key}, ls[k] AS {key}_json FROM (SELECT {carried}, ls, unnest(range(1, len(ls) + 1)) AS k FROM {out}_lists)) WHERE json_type({key}_json) = 'OBJECT')"""


_FLAT = (
    "WITH" + _PAYLOADS + ","
    + _unnested("products_of", "product", "variant_no", ("variants", "skus", "items"), "variants", "id") + ","
    + _unnested("variants", "variant_no_json", "pack_no", ("packs", "packagings", "units"), "packs", "id, variant_no") + ","
    + _unnested("packs", "pack_no_json", "price_no", ("prices", "offers", "price_list"), "prices", "id, variant_no, pack_no")
)

_KNOWN = r"""WITH q AS (SELECT query_id, jurisdiction, transaction_at, upper(trim(origin)) AS origin, regexp_replace(hs_code, '[. ]', '', 'g') AS code FROM tariff_queries),
ok AS (SELECT * FROM q WHERE transaction_at IS NOT NULL AND origin <> '' AND regexp_full_match(code, '([0-9]{2}){1,5}')),
found AS (SELECT ok.query_id, r.id AS rate_id, r.measure_type || coalesce(':' || r.measure_code, '') AS attribute
  FROM ok JOIN regulatory_datasets d ON d.jurisdiction = ok.jurisdiction AND d.activated_at <= ok.transaction_at AND (d.superseded_at IS NULL OR ok.transaction_at < d.superseded_at)
  JOIN tariff_rates r ON r.dataset_id = d.id AND starts_with(ok.code, r.hs_code) AND r.origin_country IN (ok.origin, '*')
   AND r.effective_from <= CAST(ok.transaction_at AS DATE) AND (r.effective_to IS NULL OR CAST(ok.transaction_at AS DATE) < r.effective_to))"""

_OUTBOX = r"""WITH o AS (SELECT delivery_id, lower(nullif(regexp_replace(id, '^\s+|\s+$', '', 'g'), '')) AS k, event_type, status FROM outbox_events),
f AS (SELECT *, min(delivery_id) OVER (PARTITION BY k) AS first FROM o)"""

_VERDICTS = """WITH v AS (SELECT id, source_id, CAST(source_updated_at AS DATE) AS period, CASE WHEN received_at < CAST(source_updated_at AS DATE) + INTERVAL 1 DAY THEN 'on_time'
  WHEN received_at < CAST(source_updated_at AS DATE) + INTERVAL 4 DAY THEN 'corrects' ELSE 'too_late' END AS verdict
  FROM raw_records WHERE source_updated_at IS NOT NULL AND received_at IS NOT NULL)"""

ORACLE = {
    "p1_found": _FLAT + "\nSELECT id AS raw_record_id, variant_no, pack_no, price_no FROM prices",
    "p1_table_sizes": _FLAT + """
SELECT * FROM (SELECT 'products' AS table_tag, count(*) AS n_rows, count(DISTINCT id) AS n_records FROM products_of WHERE product IS NOT NULL
UNION ALL SELECT 'variants', count(*), count(DISTINCT id) FROM variants UNION ALL SELECT 'packs', count(*), count(DISTINCT id) FROM packs
UNION ALL SELECT 'prices', count(*), count(DISTINCT id) FROM prices
UNION ALL SELECT 'rejects', count(*), count(DISTINCT id) FROM raw_records WHERE id NOT IN (SELECT id FROM products_of WHERE product IS NOT NULL)) WHERE n_rows > 0""",
    "p1_price_list": _FLAT + """
SELECT p.id || '/v' || p.variant_no || '/p' || p.pack_no || '/r' || p.price_no AS pk, json_extract_string(v.variant_no_json, '$.sku') AS sku, json_extract_string(k.pack_no_json, '$.code') AS code,
 json_extract_string(p.price_no_json, '$.currency') AS currency, try_cast(json_extract_string(p.price_no_json, '$.amount') AS DECIMAL(18,4)) AS amount
FROM prices p JOIN packs k USING (id, variant_no, pack_no) JOIN variants v USING (id, variant_no)""",
    "p2_found": _KNOWN + "\nSELECT query_id, rate_id FROM found",
    "p2_attributes": _KNOWN + """ SELECT query_id, string_agg(attribute || '=' || rates, ';' ORDER BY attribute) AS known
FROM (SELECT query_id, attribute, string_agg(rate_id, ',' ORDER BY rate_id) AS rates FROM found GROUP BY query_id, attribute) GROUP BY query_id""",
    "p5_found": r"""WITH RECURSIVE o AS (SELECT delivery_id, lower(nullif(regexp_replace(id, '^\s+|\s+$', '', 'g'), '')) AS k FROM outbox_events),
f AS (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY k) AS first FROM o WHERE k IS NOT NULL),
d AS (SELECT delivery_id AS n, consumer_group || '/' || lower(nullif(regexp_replace(event_id, '^\s+|\s+$', '', 'g'), '')) AS e,
  consumer_group || '/' || stream || '/' || lower(nullif(regexp_replace(stream_message_id, '^\s+|\s+$', '', 'g'), '')) AS m FROM dlq_messages),
e AS (SELECT DISTINCT a.n AS x, b.n AS y FROM d a JOIN d b ON a.e = b.e UNION SELECT DISTINCT a.n, b.n FROM d a JOIN d b ON a.m = b.m),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT 'outbox_events' AS feed, first AS first_delivery_id, delivery_id AS copy_delivery_id FROM f WHERE first <> delivery_id
UNION ALL SELECT 'dlq_messages', min(y), x FROM reach GROUP BY x HAVING min(y) <> x""",
    "p5_kept": _OUTBOX + "\nSELECT delivery_id, event_type, status FROM f WHERE k IS NULL OR delivery_id = first",
    "p5_reopened": _OUTBOX + "\nSELECT count(*) AS messages, CAST(sum(first) AS BIGINT) AS first_deliveries FROM (SELECT DISTINCT k, first FROM f WHERE k IS NOT NULL)",
    "p6_found": _VERDICTS + "\nSELECT id AS raw_record_id, verdict FROM v WHERE verdict <> 'on_time'",
    "p6_periods": _VERDICTS + """
SELECT source_id, period, count(*) FILTER (verdict = 'on_time') AS on_time, count(*) FILTER (verdict = 'corrects') AS corrections, count(*) FILTER (verdict <> 'too_late') AS records,
 count(*) FILTER (verdict = 'too_late') AS too_late, period + INTERVAL 4 DAY <= (SELECT max(CAST(received_at AS DATE)) + 1 FROM raw_records) AS frozen FROM v GROUP BY source_id, period""",
}
