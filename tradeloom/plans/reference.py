"""Queries over the engine's operators on the catalogue, delivery and rule tables, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, textnorm
from ..operators import changes, constraints, rules, runs, tables
from ..session import scratch, table
from ..sources import feeds
from ..sources.rest import RestSource
from ..streaming import delivery
from ..streaming.lateness import LambdaViews

AT, NOW = "2026-04-01 00:00:00", "2026-06-01 00:00:00"
MID = "00000000-0000-0000-0000-000000000000"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- filters and projections


@query("SELECT id, external_product_id FROM products WHERE source_id = 'src-harbourline'")
def filter_equal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").filter("source_id = 'src-harbourline'").select("id", "external_product_id")


@query("SELECT delivery_id, event_type FROM dlq_messages WHERE replayable")
def filter_boolean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dlq_messages").filter("replayable").select("delivery_id", "event_type")


@query("SELECT source_id, count(*) AS n FROM raw_records WHERE source_id IN ('src-harbourline', 'src-jorelko-01', 'src-ravavera-03') GROUP BY source_id")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records")
    return r.filter(F.col("source_id").isin("src-harbourline", "src-jorelko-01", "src-ravavera-03")).groupBy("source_id").agg(F.count("*").alias("n"))


@query("SELECT source_id, count(*) AS n FROM raw_records WHERE (source_id, external_product_id) IN (SELECT source_id, external_product_id FROM products) GROUP BY source_id")
def row_value_in(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "products").select("source_id", "external_product_id")
    return table(spark, d, "raw_records").join(known, ["source_id", "external_product_id"], "left_semi").groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"SELECT id, created_at FROM products WHERE (created_at, id) < (TIMESTAMP '{AT}', '{MID}')")
def row_value_less(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit(AT).cast("timestamp_ntz")
    p = table(spark, d, "products").filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < MID)))
    return p.select("id", "created_at")


@query("SELECT p.id FROM products p JOIN product_versions v ON v.id = p.current_version_id WHERE p.description IS NOT DISTINCT FROM v.description AND p.brand IS NOT DISTINCT FROM v.brand")
def null_safe_equal(spark: SparkSession, d: str) -> DataFrame:
    p, v = table(spark, d, "products").alias("p"), table(spark, d, "product_versions").alias("v")
    same = F.col("p.description").eqNullSafe(F.col("v.description")) & F.col("p.brand").eqNullSafe(F.col("v.brand"))
    return p.join(v, F.col("v.id") == F.col("p.current_version_id")).filter(same).select("p.id")


@query("SELECT id, hs_code FROM tariff_rates WHERE origin_country IN ('CN', '*')")
def wildcard_origin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tariff_rates").filter(F.col("origin_country").isin("CN", "*")).select("id", "hs_code")


@query("SELECT delivery_id, CASE WHEN retry_count + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS next_status, retry_count + 1 AS next_retry FROM outbox_events WHERE status <> 'PROCESSED'")
def case_projection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "outbox_events").filter("status <> 'PROCESSED'")
    return o.select("delivery_id", F.when(F.col("retry_count") + 1 >= 3, "FAILED").otherwise("PENDING").alias("next_status"), (F.col("retry_count") + 1).alias("next_retry"))


@query("SELECT delivery_id, coalesce(replay_of_event_id, id) AS event_id FROM outbox_events")
def coalesce_event_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outbox_events").select("delivery_id", F.coalesce("replay_of_event_id", "id").alias("event_id"))


# --- joins


@query("""SELECT s.source_id, s.external_product_id, p.id AS product_id, v.version_number
FROM (SELECT DISTINCT source_id, external_product_id FROM raw_records) s JOIN products p USING (source_id, external_product_id) LEFT JOIN product_versions v ON v.id = p.current_version_id""")
def snapshot_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "raw_records").select(*changes.IDENTITY).distinct()
    p = table(spark, d, "products").select(*changes.IDENTITY, F.col("id").alias("product_id"), "current_version_id")
    v = table(spark, d, "product_versions").select(F.col("id").alias("current_version_id"), "version_number")
    return s.join(p, changes.IDENTITY).join(v, "current_version_id", "left").select(*changes.IDENTITY, "product_id", "version_number")


@query("SELECT id FROM raw_records r WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.source_id = r.source_id AND p.external_product_id = r.external_product_id)")
def anti_unknown(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "products").select(*changes.IDENTITY)
    return table(spark, d, "raw_records").join(known, changes.IDENTITY, "left_anti").select("id")


@query("""SELECT p.id, coalesce(u.brand, p.brand) AS brand FROM products p LEFT JOIN
(SELECT product_id, arg_max(brand, version_number) AS brand FROM product_versions WHERE brand IS NOT NULL GROUP BY product_id) u ON u.product_id = p.id""")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "product_versions").filter("brand is not null").groupBy(F.col("product_id").alias("id")).agg(F.max_by("brand", "version_number").alias("b"))
    return table(spark, d, "products").join(u, "id", "left").select("id", F.coalesce("b", "brand").alias("brand"))


# --- latest, top-k, pages


@query("""SELECT source_id, external_product_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_product_id ORDER BY received_at DESC NULLS LAST, id DESC) AS k FROM raw_records) WHERE k = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").select(*changes.IDENTITY, "id", "received_at")
    return tables.latest_per_key(r, changes.IDENTITY, [F.desc_nulls_last("received_at"), F.desc("id")]).select(*changes.IDENTITY, "id")


@query("SELECT id, received_at FROM raw_records WHERE source_id = 'src-harbourline' ORDER BY received_at DESC NULLS LAST, id DESC LIMIT 50")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").filter("source_id = 'src-harbourline'").select("id", "received_at")
    return r.orderBy(F.desc_nulls_last("received_at"), F.desc("id")).limit(50)


@query("SELECT id, created_at FROM products ORDER BY created_at DESC, id DESC LIMIT 500")
def keyset_first(spark: SparkSession, d: str) -> DataFrame:
    return tables.page(table(spark, d, "products").select("id", "created_at"), 500)[0]


@query("SELECT id, created_at FROM products ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 200")
def keyset_after(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").select("id", "created_at")
    return tables.page(p, 200, tables.page(p, 200)[1])[0]


# --- change detection

_FOLD = """WITH recs AS (SELECT source_id, external_product_id, id, source_updated_at AS sua, received_at AS ra, 'v1:' || payload_sha256 AS fp FROM raw_records WHERE payload_sha256 IS NOT NULL),
refs AS (SELECT source_id, external_product_id, min(fp) AS ref FROM recs GROUP BY source_id, external_product_id),
snap AS (SELECT p.source_id, p.external_product_id, CASE WHEN v.version_number % 2 = 0 THEN TIMESTAMP '2026-03-01' END AS s_sua, TIMESTAMP '2026-02-01' AS s_ra, CASE WHEN ascii(p.id) % 3 = 0 THEN 'old-scheme' ELSE p.current_fingerprint END AS s_fp, refs.ref AS s_refp, v.version_number AS s_version
  FROM products p JOIN product_versions v ON v.id = p.current_version_id LEFT JOIN refs USING (source_id, external_product_id)),
base AS (SELECT r.*, s_sua, s_ra, s_fp, s_refp, s_version, (s_sua IS NOT NULL AND sua IS NOT NULL AND sua < s_sua) AS hard_stale,
  greatest(s_ra, max(CASE WHEN sua IS NULL THEN ra END) OVER (PARTITION BY source_id, external_product_id)) AS m FROM recs r LEFT JOIN snap USING (source_id, external_product_id)),
act AS (SELECT *, CASE WHEN hard_stale THEN FALSE WHEN sua IS NULL OR s_sua IS NOT NULL THEN TRUE ELSE max(CASE WHEN sua IS NOT NULL AND (m IS NULL OR ra >= m) THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id, external_product_id ORDER BY sua NULLS FIRST, ra NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 END AS alive FROM base),
prev AS (SELECT *, greatest(s_ra, max(CASE WHEN alive THEN ra END) OVER w) AS prev_ra, greatest(s_sua, max(CASE WHEN alive THEN sua END) OVER w) AS prev_sua FROM act
  WINDOW w AS (PARTITION BY source_id, external_product_id ORDER BY sua NULLS FIRST, ra NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fresh AS (SELECT *, alive AND NOT coalesce(ra < prev_ra AND (sua IS NULL OR prev_sua IS NULL OR sua = prev_sua), FALSE) AS is_fresh FROM prev),
lagged AS (SELECT *, CASE WHEN is_fresh THEN coalesce(lag(fp) OVER (PARTITION BY source_id, external_product_id, is_fresh ORDER BY sua NULLS FIRST, ra NULLS FIRST, id), s_fp) END AS prev_fp FROM fresh),
typed AS (SELECT *, CASE WHEN NOT is_fresh THEN 'STALE' WHEN prev_fp IS NULL THEN 'NEW' WHEN prev_fp NOT LIKE 'v1:%' AND s_refp = fp THEN 'VERSION_MISMATCH' WHEN prev_fp = fp THEN 'UNCHANGED' ELSE 'CHANGED' END AS transition FROM lagged),
folded AS (SELECT *, CASE WHEN transition IN ('NEW', 'CHANGED') THEN CAST(coalesce(s_version, 0) + sum(CASE WHEN transition IN ('NEW', 'CHANGED') THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id, external_product_id ORDER BY sua NULLS FIRST, ra NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS version_number FROM typed)
"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").filter("payload_sha256 is not null")
    r = r.select(*changes.IDENTITY, "id", F.col("source_updated_at").alias("sua"), F.col("received_at").alias("ra"), F.concat(F.lit("v1:"), "payload_sha256").alias("fp"))
    v = table(spark, d, "product_versions").select(F.col("id").alias("current_version_id"), F.col("version_number").cast("long").alias("s_version"))
    p = table(spark, d, "products").select(*changes.IDENTITY, "current_version_id", F.when(F.ascii("id") % 3 == 0, "old-scheme").otherwise(F.col("current_fingerprint")).alias("s_fp")).join(v, "current_version_id")
    refs = r.groupBy(*changes.IDENTITY).agg(F.min("fp").alias("s_refp"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    state = p.join(refs, changes.IDENTITY, "left").select(*changes.IDENTITY, F.when(F.col("s_version") % 2 == 0, at("2026-03-01 00:00:00")).alias("s_sua"), at("2026-02-01 00:00:00").alias("s_ra"), "s_fp", "s_refp", "s_version")
    return changes.classify(r, state)


@query(_FOLD + "SELECT id, transition FROM folded")
def change_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("id", "transition")


@query(_FOLD + "SELECT source_id, external_product_id, id, version_number, fp FROM folded WHERE version_number IS NOT NULL")
def change_versions(spark: SparkSession, d: str) -> DataFrame:
    return changes.versions(_classified(spark, d)).select(*changes.IDENTITY, "id", "version_number", "fp")


@query(_FOLD + """SELECT source_id, external_product_id, max(version_number) AS version_number, coalesce(arg_max(fp, version_number) FILTER (version_number IS NOT NULL), max(fp) FILTER (transition = 'VERSION_MISMATCH')) AS fingerprint,
greatest(any_value(s_sua), max(CASE WHEN transition <> 'STALE' THEN sua END)) AS last_source_updated_at, greatest(any_value(s_ra), max(CASE WHEN transition <> 'STALE' THEN ra END)) AS last_received_at, any_value(s_fp) IS NULL AS is_new
FROM folded GROUP BY source_id, external_product_id HAVING count(*) FILTER (transition <> 'STALE') > 0""")
def change_head_state(spark: SparkSession, d: str) -> DataFrame:
    return changes.head_state(_classified(spark, d))


@query(_FOLD + """SELECT source_id, count(*) AS seen, count(*) FILTER (transition = 'NEW') AS new, count(*) FILTER (transition = 'CHANGED') AS changed, count(*) FILTER (transition NOT IN ('NEW', 'CHANGED')) AS unchanged, CAST(0 AS BIGINT) AS failed FROM folded GROUP BY source_id""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return changes.counters(_classified(spark, d), "source_id")


@query(_FOLD + """SELECT 'product.changed' AS event_type, 'product' AS aggregate_type, '{"version_number":' || version_number || ',"fingerprint":"' || fp || '","change_type":"' || transition || '","changed_fields":[]}' AS payload FROM folded WHERE version_number IS NOT NULL""")
def change_events_json(spark: SparkSession, d: str) -> DataFrame:
    """The events' contract; the ids, which are made here, are left out of the comparison."""
    e = changes.change_events(_classified(spark, d))
    return e.select("event_type", "aggregate_type", F.regexp_replace("payload", '"(product_id|version_id)":"[0-9a-f-]{36}",', "").alias("payload"))


_OUTCOME = r"""WITH o AS (SELECT source_id, CASE WHEN payload IS NULL OR NOT json_valid(payload) THEN 'malformed' WHEN json_type(payload) <> 'OBJECT' THEN 'malformed'
 WHEN coalesce(trim(json_extract_string(payload, '$.title')), '') = '' THEN 'missing_field' WHEN length(json_extract_string(payload, '$.title')) > 512 THEN 'malformed'
 WHEN coalesce(trim(regexp_replace(json_extract_string(payload, '$.country_code'), '[\s ]+', ' ', 'g')), '') NOT IN ('') AND NOT regexp_full_match(trim(regexp_replace(json_extract_string(payload, '$.country_code'), '[\s ]+', ' ', 'g')), '[A-Za-z]{2}') THEN 'invalid_origin'
 ELSE 'ok' END AS outcome FROM raw_records)
"""
MAPPING = textnorm.FieldMapping("title", "body", "vendor", "country_code", {"color": "details.color", "size": "details.size"})


@query(_OUTCOME + "SELECT source_id, outcome, count(*) AS n FROM o GROUP BY source_id, outcome")
def normalise_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = textnorm.with_normalised(table(spark, d, "raw_records").select("source_id", "payload"), MAPPING)
    return r.groupBy("source_id", F.coalesce("product.error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


_COLLAPSED = r"trim(regexp_replace(regexp_replace(nfc_normalize({0}), '[\x{{200B}}\x{{FEFF}}\x{{200C}}\x{{200D}}]', '', 'g'), '[\t\n\x0B\f\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def _field(path: str) -> str:
    """SQL for a scalar of a payload as text, numbers without zeros at the end of their fraction."""
    text = f"json_extract_string(payload, '{path}')"
    number = f"CASE WHEN contains({text}, '.') THEN regexp_replace({text}, '[.]?0+$', '') ELSE {text} END"
    return _COLLAPSED.format(f"CASE WHEN json_type(payload, '{path}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN {number} ELSE {text} END")


@query(_OUTCOME.replace("SELECT source_id, CASE", "SELECT id, payload, CASE") + f"""SELECT id, {_field('$.title')} AS name, coalesce({_field('$.body')}, '') AS description, coalesce({_field('$.vendor')}, '') AS brand, upper(coalesce({_field('$.country_code')}, '')) AS origin_country,
 nullif({_field('$.details.color')}, '') AS color, nullif({_field('$.details.size')}, '') AS size FROM o WHERE outcome = 'ok'""")
def normalise_values(spark: SparkSession, d: str) -> DataFrame:
    """What the good records are normalised to."""
    r = textnorm.with_normalised(table(spark, d, "raw_records").select("id", "payload"), MAPPING).filter("product.error is null")
    a = F.col("product.attributes")
    return r.select("id", "product.name", "product.description", "product.brand", "product.origin_country", a["color"].alias("color"), a["size"].alias("size"))


@query(_OUTCOME + """SELECT source_id, seen, failed, failed / seen AS error_rate, seen >= 20 AND failed / seen > 0.5 AS over_budget FROM (SELECT source_id, count(*) AS seen, count(*) FILTER (outcome <> 'ok') AS failed FROM o GROUP BY source_id)""")
def error_budget(spark: SparkSession, d: str) -> DataFrame:
    r = textnorm.with_normalised(table(spark, d, "raw_records").select("source_id", "payload"), MAPPING)
    counted = r.groupBy("source_id").agg(F.count("*").alias("seen"), F.count_if(F.col("product.error").isNotNull()).alias("failed"))
    return changes.over_budget(counted, 0.5, 20)


@query("""WITH c AS (SELECT id, product_id, version_number, canonical_name AS n, coalesce(description, '') AS d, lower(trim(coalesce(brand, ''))) AS b, coalesce(origin_country, '') AS o,
 coalesce((SELECT string_agg(lower(trim(k)) || '=' || json_extract_string(attributes, '$."' || k || '"'), chr(31) ORDER BY lower(trim(k))) FROM unnest(json_keys(attributes)) t(k) WHERE json_extract_string(attributes, '$."' || k || '"') IS NOT NULL), '') AS a FROM product_versions),
v AS (SELECT *, lag(n) OVER w AS pn, lag(d) OVER w AS pd, lag(b) OVER w AS pb, lag(o) OVER w AS po, lag(a) OVER w AS pa, lag(id) OVER w AS pid FROM c WINDOW w AS (PARTITION BY product_id ORDER BY version_number))
SELECT id, concat_ws(',', CASE WHEN a <> pa THEN 'attributes' END, CASE WHEN b <> pb THEN 'brand' END, CASE WHEN n IS DISTINCT FROM pn THEN 'canonical_name' END, CASE WHEN d <> pd THEN 'description' END, CASE WHEN o <> po THEN 'origin_country' END) AS changed FROM v WHERE pid IS NOT NULL""")
def change_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields in which each version differs from the one before, on canonical forms: the order of attributes and the case of their names don't count."""
    w = Window.partitionBy("product_id").orderBy("version_number")
    v = table(spark, d, "product_versions")
    v = v.withColumn("canon", textnorm.canonical_fields(F.col("canonical_name"), F.col("description"), F.col("brand"), F.col("origin_country"), F.col("attributes")))
    v = v.select("id", "canon", F.lag("canon").over(w).alias("before")).filter("before is not null")
    return v.select("id", F.concat_ws(",", textnorm.changed_fields(F.col("before"), F.col("canon"))).alias("changed"))


# --- scalar functions


def _escaped(x: str) -> str:
    """SQL for a value as the fingerprint's JSON has it."""
    sql = f"to_json({x})::VARCHAR"
    for c in ("'<', '\\u003c'", "'>', '\\u003e'", "'&', '\\u0026'", "chr(8232), '\\u2028'", "chr(8233), '\\u2029'"):
        sql = f"replace({sql}, {c})"
    return sql


_BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _folded(x: str) -> str:
    return f"lower(nfc_normalize(regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')))"


@query(f"""WITH kv AS (SELECT id, {_folded('k')} AS k, coalesce(json_extract_string(attributes, '$."' || k || '"'), '') AS v FROM (SELECT id, attributes, unnest(json_keys(attributes)) AS k FROM product_versions)),
a AS (SELECT id, string_agg({_escaped('k')} || ':' || {_escaped('v')}, ',' ORDER BY encode(k)) AS a FROM kv GROUP BY id),
f AS (SELECT v.id, a.a, {_folded("coalesce(v.brand, '')")} AS b, coalesce(v.canonical_name, '') AS n, v.description AS d, v.origin_country AS o FROM product_versions v LEFT JOIN a USING (id))
SELECT id, 'v1:' || sha256('{{' || concat_ws(',', '"attributes":{{' || a || '}}', CASE WHEN b <> '' THEN '"brand":' || {_escaped('b')} END, '"canonical_name":' || {_escaped('n')}, CASE WHEN d <> '' THEN '"description":' || {_escaped('d')} END, CASE WHEN o <> '' THEN '"origin_country":' || {_escaped('o')} END) || '}}') AS fingerprint FROM f""")
def fingerprint_versions(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all versions."""
    v = table(spark, d, "product_versions")
    return v.select("id", textnorm.version_fingerprint(F.col("canonical_name"), F.col("description"), F.col("brand"), F.col("origin_country"), F.col("attributes")).alias("fingerprint"))


@query("SELECT id, sha256(payload) AS digest, sha256(payload) = payload_sha256 AS intact FROM raw_records")
def sha_payload(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(F.encode("payload", "UTF-8"), 256)
    return table(spark, d, "raw_records").select("id", digest.alias("digest"), (digest == F.col("payload_sha256")).alias("intact"))


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(nfc_normalize(canonical_name), '[\x{200B}\x{FEFF}\x{200C}\x{200D}]', '', 'g'), '[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS name FROM products""")
def collapse_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("id", textnorm.collapse_text(F.col("canonical_name")).alias("name"))


@query("SELECT id, length(canonical_name) <= 512 AS name_fits, length(brand) <= 255 AS brand_fits FROM products")
def length_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("id", (F.length("canonical_name") <= 512).alias("name_fits"), (F.length("brand") <= 255).alias("brand_fits"))


@query("SELECT id, CASE WHEN regexp_full_match(upper(trim(origin_country)), '[A-Z]{2}') THEN upper(trim(origin_country)) END AS country FROM products")
def country_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("id", codes.country(F.col("origin_country")).alias("country"))


@query("""SELECT query_id, CASE WHEN regexp_full_match(c, '([0-9]{2}){1,5}') THEN c END AS code, CASE WHEN regexp_full_match(c, '([0-9]{2}){1,5}') THEN array_to_string([c[1:len(c) - 2 * k] for k in range(len(c) // 2)], ',') END AS prefixes
FROM (SELECT query_id, translate(hs_code, '. ', '') AS c FROM tariff_queries)""")
def hs_codes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "tariff_queries").select("query_id", codes.hs_code(F.col("hs_code")).alias("code"))
    return q.select("query_id", "code", F.when(F.col("code").isNotNull(), F.array_join(codes.hs_prefixes(F.col("code")), ",")).alias("prefixes"))


_MEMBERS = ", ".join(f"'{m}'" for m in codes.MEMBERS)


@query(f"SELECT query_id, CASE WHEN upper(trim(origin)) IN ({_MEMBERS}) THEN 'EU' WHEN regexp_full_match(upper(trim(origin)), '[A-Z]{{2}}') THEN upper(trim(origin)) END AS rules_of, CAST(transaction_at AS DATE) AS on_date FROM tariff_queries")
def jurisdictions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "tariff_queries")
    return q.select("query_id", codes.jurisdiction(codes.country(F.col("origin"))).alias("rules_of"), codes.utc_date(F.col("transaction_at")).alias("on_date"))


@query("SELECT delivery_id, least(60.0, 0.5 * pow(2.0, retry_count)) AS wait_seconds FROM outbox_events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outbox_events").select("delivery_id", codes.backoff_seconds(F.col("retry_count"), 0.5, 60.0).alias("wait_seconds"))


# --- rules


@query(f"SELECT id, jurisdiction, version FROM regulatory_datasets WHERE activated_at <= TIMESTAMP '{AT}' AND (superseded_at IS NULL OR TIMESTAMP '{AT}' < superseded_at)")
def datasets_active_at(spark: SparkSession, d: str) -> DataFrame:
    return rules.active_at(table(spark, d, "regulatory_datasets"), AT).select("id", "jurisdiction", "version")


@query("SELECT id, lead(activated_at) OVER (PARTITION BY jurisdiction, category, source ORDER BY activated_at, id) AS closed_at FROM regulatory_datasets WHERE activated_at IS NOT NULL")
def supersession(spark: SparkSession, d: str) -> DataFrame:
    return rules.supersession(table(spark, d, "regulatory_datasets")).select("id", "closed_at")


@query(f"""SELECT *, CASE WHEN in_force = 0 THEN 'NO_REGULATORY_COVERAGE' WHEN stale THEN 'STALE_REGULATORY_DATA' END AS hold_reason FROM (SELECT jurisdiction, category, count(*) FILTER (a) AS in_force,
coalesce(bool_or(TIMESTAMP '{AT}' - fetched_at > CASE category WHEN 'TARIFF' THEN INTERVAL 720 HOUR WHEN 'SANCTIONS' THEN INTERVAL 24 HOUR ELSE INTERVAL 2000 HOUR END) FILTER (a), false) AS stale
FROM (SELECT *, coalesce(activated_at <= TIMESTAMP '{AT}' AND (superseded_at IS NULL OR TIMESTAMP '{AT}' < superseded_at), false) AS a FROM regulatory_datasets) GROUP BY jurisdiction, category)""")
def coverage_sla(spark: SparkSession, d: str) -> DataFrame:
    return rules.freshness(table(spark, d, "regulatory_datasets"), AT, {"TARIFF": 720, "SANCTIONS": 24, "IMPORT_RESTRICTION": 2000, "PERMIT": 2000, "EXPORT_CONTROL": 2000, "PREFERENTIAL_AGREEMENT": 2000})


# the tables obey their rules, so breaches are planted: copies of rates that begin later, and values no rule allows
_RATES = """WITH rates AS (SELECT id, dataset_id, hs_code, origin_country, measure_type, measure_code, rate_type, ad_valorem_percent, specific_amount, effective_from, effective_to FROM tariff_rates
UNION ALL SELECT id || '-later', dataset_id, CASE WHEN ascii(id) % 2 = 0 THEN hs_code || '7' ELSE hs_code END, origin_country, measure_type, CASE WHEN measure_type = 'MFN' AND ascii(id) % 3 = 0 THEN 'X' ELSE measure_code END, rate_type, CASE WHEN ascii(id) % 5 = 0 THEN NULL ELSE ad_valorem_percent END, specific_amount,
 effective_from + 10, CASE WHEN ascii(id) % 7 = 0 THEN effective_from ELSE effective_to END FROM tariff_rates) """
_OVERLAP = """SELECT DISTINCT b.id FROM rates a JOIN rates b ON a.dataset_id = b.dataset_id AND a.hs_code = b.hs_code AND a.origin_country = b.origin_country AND a.measure_type = b.measure_type AND a.measure_code IS NOT DISTINCT FROM b.measure_code AND a.id <> b.id
WHERE (a.effective_from, coalesce(a.effective_to, DATE '9999-12-31'), a.id) < (b.effective_from, coalesce(b.effective_to, DATE '9999-12-31'), b.id) AND b.effective_from < coalesce(a.effective_to, DATE '9999-12-31')"""


def _rates(spark: SparkSession, d: str) -> DataFrame:
    names = ["id", "dataset_id", "hs_code", "origin_country", "measure_type", "measure_code", "rate_type", "ad_valorem_percent", "specific_amount", "effective_from", "effective_to"]
    r = table(spark, d, "tariff_rates").select(*names)
    code, m = F.ascii("id"), F.col("measure_code")
    later = r.select(
        F.concat("id", F.lit("-later")).alias("id"), "dataset_id", F.when(code % 2 == 0, F.concat("hs_code", F.lit("7"))).otherwise(F.col("hs_code")).alias("hs_code"), "origin_country", "measure_type", F.when((F.col("measure_type") == "MFN") & (code % 3 == 0), "X").otherwise(m).alias("measure_code"),
        "rate_type", F.when(code % 5 != 0, F.col("ad_valorem_percent")).alias("ad_valorem_percent"), "specific_amount", F.date_add("effective_from", 10).alias("effective_from"), F.when(code % 7 == 0, F.col("effective_from")).otherwise(F.col("effective_to")).alias("effective_to"),
    )
    return r.unionByName(later)


@query(_RATES + _OVERLAP)
def validity_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rules.overlaps(_rates(spark, d), ["dataset_id", "hs_code", "origin_country", "measure_type", "measure_code"], "effective_from", "effective_to").select("id")


_CANDIDATES = """WITH q AS (SELECT query_id, jurisdiction, transaction_at, evaluated_at, CAST(transaction_at AS DATE) AS on_date, CASE WHEN regexp_full_match(translate(hs_code, '. ', ''), '([0-9]{2}){1,5}') THEN translate(hs_code, '. ', '') END AS code,
  CASE WHEN regexp_full_match(upper(trim(origin)), '[A-Z]{2}') AND CASE WHEN upper(trim(origin)) IN (""" + ", ".join(f"'{m}'" for m in codes.MEMBERS) + """) THEN 'EU' ELSE upper(trim(origin)) END <> jurisdiction THEN upper(trim(origin)) END AS origin FROM tariff_queries),
cand AS (SELECT q.query_id, q.origin AS q_origin, r.id AS rate_id, r.hs_code AS rule_code, r.origin_country, r.measure_type, coalesce(r.measure_code, '') AS measure_code, r.rate_type, r.ad_valorem_percent
  FROM q JOIN tariff_rates r ON starts_with(q.code, r.hs_code) AND length(r.hs_code) % 2 = 0 AND r.origin_country IN (q.origin, '*') JOIN regulatory_datasets s ON s.id = r.dataset_id AND s.category = 'TARIFF' AND s.jurisdiction = q.jurisdiction
   AND s.activated_at <= q.evaluated_at AND (s.superseded_at IS NULL OR q.evaluated_at < s.superseded_at) WHERE q.origin IS NOT NULL AND r.effective_from <= q.on_date AND (r.effective_to IS NULL OR q.on_date < r.effective_to))"""

_RESOLVED = _CANDIDATES + """, ranked AS (SELECT *, rank() OVER (PARTITION BY query_id, measure_type, measure_code ORDER BY CASE WHEN origin_country = q_origin THEN 0 ELSE 1 END, length(rule_code) DESC) AS rk FROM cand WHERE measure_type <> 'PREFERENTIAL'),
best AS (SELECT query_id, measure_type, measure_code, sum(ad_valorem_percent) AS ad_valorem, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS_TARIFF' WHEN min(rate_type) = 'UNSUPPORTED_MEASURE' THEN 'UNSUPPORTED_MEASURE' END AS problem,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN measure_type = 'MFN' THEN 0 ELSE 1 END, measure_type, measure_code) AS pos FROM ranked WHERE rk = 1 GROUP BY query_id, measure_type, measure_code),
agg AS (SELECT query_id, bool_or(measure_type = 'MFN') AS has_mfn, count(*) AS n, sum(coalesce(ad_valorem, 0)) AS total, arg_min(problem, pos) FILTER (problem IS NOT NULL) AS problem FROM best GROUP BY query_id),
cov AS (SELECT q.query_id, bool_or(q.evaluated_at - s.fetched_at > INTERVAL 2400 HOUR) AS stale FROM q JOIN regulatory_datasets s ON s.category = 'TARIFF' AND s.jurisdiction = q.jurisdiction AND s.activated_at <= q.evaluated_at AND (s.superseded_at IS NULL OR q.evaluated_at < s.superseded_at) GROUP BY q.query_id),
res AS (SELECT q.query_id, CASE WHEN q.code IS NULL OR q.origin IS NULL OR q.on_date IS NULL OR q.jurisdiction IS NULL OR q.evaluated_at IS NULL THEN 'INVALID_QUERY' WHEN cov.query_id IS NULL THEN 'NO_REGULATORY_COVERAGE' WHEN cov.stale THEN 'STALE_REGULATORY_DATA' WHEN NOT coalesce(has_mfn, false) THEN 'NO_TARIFF_RATE' ELSE problem END AS hold_reason, n, total
  FROM q LEFT JOIN agg USING (query_id) LEFT JOIN cov USING (query_id))"""


@query(_CANDIDATES + " SELECT query_id, rate_id FROM cand")
def tariff_candidates(spark: SparkSession, d: str) -> DataFrame:
    tariff = table(spark, d, "regulatory_datasets").filter("category = 'TARIFF'")
    return rules.candidates(table(spark, d, "tariff_queries"), table(spark, d, "tariff_rates"), tariff).select("query_id", "rate_id")


@query(_RESOLVED + " SELECT query_id, hold_reason, CASE WHEN hold_reason IS NULL THEN n END AS n_measures, CASE WHEN hold_reason IS NULL THEN CAST(total AS DECIMAL(38,6)) END AS ad_valorem_percent FROM res")
def tariff_resolve(spark: SparkSession, d: str) -> DataFrame:
    return rules.resolve_tariffs(table(spark, d, "tariff_queries"), table(spark, d, "tariff_rates"), table(spark, d, "regulatory_datasets"), 2400)


@query(_RESOLVED + " SELECT coalesce(hold_reason, 'RESOLVED') AS outcome, count(*) AS n FROM res GROUP BY outcome")
def tariff_holds(spark: SparkSession, d: str) -> DataFrame:
    return tariff_resolve(spark, d).groupBy(F.coalesce("hold_reason", F.lit("RESOLVED")).alias("outcome")).agg(F.count("*").alias("n"))


# --- constraints, with breaches planted


def _sql_checks(source: str, key: str, broken: dict[str, str], more: str = "") -> str:
    return source + " UNION ALL ".join(f"SELECT '{n}' AS \"constraint\", CAST({key} AS VARCHAR) AS key FROM t WHERE {c}" for n, c in broken.items()) + more


@query(_sql_checks("WITH t AS (SELECT * REPLACE (CASE WHEN delivery_id % 50 = 0 THEN 'GONE' ELSE status END AS status, CASE WHEN delivery_id % 60 = 0 THEN 0 ELSE attempts END AS attempts, CASE WHEN delivery_id % 70 = 0 THEN '' ELSE event_type END AS event_type, CASE WHEN delivery_id % 80 = 0 THEN dead_lettered_at + INTERVAL 1 HOUR ELSE first_failed_at END AS first_failed_at) FROM dlq_messages) ",
    "delivery_id", {"status": "status NOT IN ('DEAD', 'REPLAYED')", "attempts": "attempts < 1", "order": "first_failed_at > dead_lettered_at", "replayable_needs_event": "replayable AND event_type = ''"}))
def constraints_dlq(spark: SparkSession, d: str) -> DataFrame:
    t, n = table(spark, d, "dlq_messages"), F.col("delivery_id")
    later = F.col("dead_lettered_at") + F.make_dt_interval(hours=F.lit(1))
    t = t.withColumns({"status": F.when(n % 50 == 0, "GONE").otherwise(F.col("status")), "attempts": F.when(n % 60 == 0, 0).otherwise(F.col("attempts")), "event_type": F.when(n % 70 == 0, "").otherwise(F.col("event_type")), "first_failed_at": F.when(n % 80 == 0, later).otherwise(F.col("first_failed_at"))})
    return constraints.check_dlq(t)


@query(_sql_checks("WITH t AS (SELECT * REPLACE (CASE WHEN delivery_id % 50 = 0 THEN 'GONE' ELSE status END AS status, CASE WHEN delivery_id % 60 = 0 THEN -1 ELSE retry_count END AS retry_count, CASE WHEN delivery_id % 70 = 0 THEN 'g' ELSE target_group END AS target_group, CASE WHEN delivery_id % 80 = 0 THEN NULL ELSE processed_at END AS processed_at), CASE WHEN delivery_id % 90 = 0 THEN 'token' END AS claim_token FROM outbox_events) ",
    "delivery_id", {"status": "status NOT IN ('PENDING', 'PROCESSED', 'FAILED')", "processed_iff_time": "(status = 'PROCESSED') <> (processed_at IS NOT NULL)", "replay_fields": "(replay_of_event_id IS NULL) <> (target_group IS NULL)", "retry_count": "retry_count < 0", "claim_only_pending": "claim_token IS NOT NULL AND status <> 'PENDING'"}))
def constraints_outbox(spark: SparkSession, d: str) -> DataFrame:
    t, n = table(spark, d, "outbox_events"), F.col("delivery_id")
    t = t.withColumns({"status": F.when(n % 50 == 0, "GONE").otherwise(F.col("status")), "retry_count": F.when(n % 60 == 0, -1).otherwise(F.col("retry_count")), "target_group": F.when(n % 70 == 0, "g").otherwise(F.col("target_group")), "processed_at": F.when(n % 80 != 0, F.col("processed_at")), "claim_token": F.when(n % 90 == 0, "token")})
    return constraints.check_outbox(t)


@query(_sql_checks("WITH t AS (SELECT id, product_id, canonical_name, version_number FROM product_versions UNION ALL SELECT id || '-again', product_id, repeat(canonical_name, CASE WHEN ascii(id) % 2 = 0 THEN 20 ELSE 1 END), CASE WHEN ascii(id) % 3 = 0 THEN 0 ELSE version_number END FROM product_versions) ",
    "id", {"version_number": "version_number < 1", "name_length": "length(canonical_name) > 512"}, " UNION ALL SELECT 'unique_number', product_id || '/' || version_number FROM t GROUP BY product_id, version_number HAVING count(*) > 1"))
def constraints_versions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "product_versions").select("id", "product_id", "canonical_name", "version_number")
    name = F.when(F.ascii("id") % 2 == 0, F.repeat("canonical_name", F.lit(20))).otherwise(F.col("canonical_name"))
    again = t.select(F.concat("id", F.lit("-again")).alias("id"), "product_id", name.alias("canonical_name"), F.when(F.ascii("id") % 3 == 0, 0).otherwise(F.col("version_number")).alias("version_number"))
    return constraints.check_changes(t.unionByName(again))


@query(_sql_checks(_RATES.replace("WITH rates AS", "WITH t AS"), "id", {
    "hs_code_format": "NOT regexp_full_match(hs_code, '([0-9]{2}){1,5}')", "origin_format": r"NOT regexp_full_match(origin_country, '[A-Z]{2}|\*')", "range": "effective_to <= effective_from", "measure_code_iff_not_mfn": "(measure_type = 'MFN') <> (measure_code IS NULL)",
    "ad_valorem_present": "rate_type IN ('AD_VALOREM', 'COMPOUND') AND ad_valorem_percent IS NULL", "specific_present": "rate_type IN ('SPECIFIC', 'COMPOUND') AND specific_amount IS NULL", "preferential_needs_origin": "measure_type = 'PREFERENTIAL' AND origin_country = '*'"},
    " UNION ALL SELECT 'no_overlap', id FROM (" + _OVERLAP.replace("FROM rates a JOIN rates b", "FROM t a JOIN t b") + ")"))
def constraints_rates(spark: SparkSession, d: str) -> DataFrame:
    return constraints.check_tariff_rates(_rates(spark, d))


@query(_sql_checks("WITH t AS (SELECT id, jurisdiction, category, source, version, status, content_sha256, activated_at, superseded_at FROM regulatory_datasets UNION ALL SELECT id || '-again', jurisdiction, category, source, version, CASE WHEN ascii(id) % 2 = 0 THEN 'ACTIVE' ELSE 'LOST' END, encode('short'), NULL, activated_at FROM regulatory_datasets) ", "id", {
    "status": "status NOT IN ('LOADED', 'ACTIVE', 'SUPERSEDED', 'REJECTED')", "sha256_length": "octet_length(content_sha256) <> 32", "active_needs_activation": "status IN ('ACTIVE', 'SUPERSEDED') AND activated_at IS NULL", "superseded_iff_end": "(status = 'SUPERSEDED') <> (superseded_at IS NOT NULL)", "range": "superseded_at <= activated_at"},
    " UNION ALL SELECT 'unique_version', concat_ws('/', jurisdiction, category, source, version) FROM t GROUP BY jurisdiction, category, source, version HAVING count(*) > 1 UNION ALL SELECT 'one_active', concat_ws('/', jurisdiction, category, source) FROM t WHERE status = 'ACTIVE' GROUP BY jurisdiction, category, source HAVING count(*) > 1"))
def constraints_datasets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "regulatory_datasets").select("id", "jurisdiction", "category", "source", "version", "status", "content_sha256", "activated_at", "superseded_at")
    again = t.select(F.concat("id", F.lit("-again")).alias("id"), "jurisdiction", "category", "source", "version", F.when(F.ascii("id") % 2 == 0, "ACTIVE").otherwise("LOST").alias("status"), F.encode(F.lit("short"), "UTF-8").alias("content_sha256"), F.lit(None).cast("timestamp_ntz").alias("activated_at"), F.col("activated_at").alias("superseded_at"))
    return constraints.check_datasets(t.unionByName(again))


# --- set updates


@query("""WITH u AS (SELECT product_id, arg_max(canonical_name, version_number) AS new_name, arg_max(id, version_number) AS expected FROM product_versions GROUP BY product_id)
SELECT p.id, CASE WHEN p.current_version_id IS NOT DISTINCT FROM u.expected AND u.product_id IS NOT NULL THEN u.new_name ELSE p.canonical_name END AS canonical_name FROM products p LEFT JOIN u ON u.product_id = p.id""")
def guarded_update(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "product_versions").groupBy(F.col("product_id").alias("id")).agg(F.max_by("canonical_name", "version_number").alias("canonical_name"), F.max_by("id", "version_number").alias("expected"))
    p = table(spark, d, "products").select("id", "canonical_name", "current_version_id")
    return tables.guarded_update(p, u, "id", "current_version_id", "expected", ["canonical_name"])[0].select("id", "canonical_name")


@query("""WITH u AS (SELECT source_id, external_product_id, max(received_at) AS r FROM raw_records GROUP BY source_id, external_product_id)
SELECT p.source_id, p.external_product_id, greatest(p.updated_at, u.r) AS updated_at FROM products p JOIN u USING (source_id, external_product_id) WHERE greatest(p.updated_at, u.r) IS DISTINCT FROM p.updated_at""")
def watermarks(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "raw_records").groupBy(*changes.IDENTITY).agg(F.max("received_at").alias("updated_at"))
    return tables.raise_watermarks(table(spark, d, "products").select(*changes.IDENTITY, "updated_at"), seen, changes.IDENTITY, ["updated_at"])


@query("""WITH u AS (SELECT source_id, count(*) AS n, max(received_at) AS at FROM raw_records GROUP BY source_id), s AS (SELECT source_id, count(*) AS n, min(created_at) AS at FROM products GROUP BY source_id)
SELECT coalesce(u.source_id, s.source_id) AS source_id, coalesce(u.n, s.n) AS n, CASE WHEN s.source_id IS NOT NULL THEN s.at ELSE u.at END AS at FROM s FULL JOIN u ON u.source_id = s.source_id""")
def upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "raw_records").groupBy("source_id").agg(F.count("*").alias("n"), F.max("received_at").alias("at"))
    s = table(spark, d, "products").groupBy("source_id").agg(F.count("*").alias("n"), F.min("created_at").alias("at"))
    return tables.upsert(s, u, ["source_id"], keep=["at"])


@query("SELECT event_id, min(event_type) AS event_type FROM dlq_messages d WHERE event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM outbox_events o WHERE o.id = d.event_id) GROUP BY event_id")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "outbox_events").select(F.col("id").alias("event_id"), "event_type")
    new = table(spark, d, "dlq_messages").filter("event_id is not null").select("event_id", "event_type")
    return tables.insert_if_absent(kept, new, ["event_id"])


@query("SELECT query_id, unnest(range(1, len(string_split(hs_code, '.')) + 1)) AS pos, unnest(string_split(hs_code, '.')) AS part FROM tariff_queries WHERE hs_code IS NOT NULL")
def zip_unnest(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "tariff_queries").filter("hs_code is not null")
    parts = F.split("hs_code", r"\.", -1)
    return q.select("query_id", F.inline(F.arrays_zip(F.sequence(F.lit(1).cast("long"), F.size(parts).cast("long")).alias("pos"), parts.alias("part"))))


# --- delivery


@query(f"SELECT delivery_id, coalesce(replay_of_event_id, id) AS event_id FROM outbox_events WHERE status = 'PENDING' AND available_at <= TIMESTAMP '2026-12-31' ORDER BY available_at, id, delivery_id LIMIT 100")
def outbox_claim(spark: SparkSession, d: str) -> DataFrame:
    return delivery.claim(table(spark, d, "outbox_events"), "2026-12-31 00:00:00", 100).select("delivery_id", "event_id")


@query("""SELECT delivery_id, CASE WHEN bad AND retry_count + 1 >= 3 THEN 'FAILED' WHEN bad THEN 'PENDING' ELSE 'PROCESSED' END AS status, CASE WHEN bad THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN bad THEN least(30.0, 1.0 * pow(2.0, retry_count)) END AS wait_seconds
FROM (SELECT *, last_error IS NOT NULL AS bad FROM outbox_events)""")
def outbox_failure(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "outbox_events").withColumn("bad", F.col("last_error").isNotNull())
    return delivery.with_outcome(o, "bad", 1.0, 30.0, 3).select("delivery_id", "status", "retry_count", "wait_seconds")


@query("SELECT delivery_id, coalesce(replay_of_event_id, id) AS event_id, aggregate_type, aggregate_id, event_type, payload, target_group, aggregate_id AS correlation_id, nullif(trim(coalesce(replay_of_event_id, id)), '') IS NULL OR nullif(trim(event_type), '') IS NULL OR created_at IS NULL AS corrupt, created_at FROM (SELECT * REPLACE (CASE WHEN trim(id) <> '' THEN id END AS id) FROM outbox_events)")
def envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "outbox_events").withColumn("correlation_id", F.col("aggregate_id"))
    return delivery.decode(delivery.encode(o)).drop("stream")


@query("SELECT g AS consumer_group, count(*) AS n FROM outbox_events, (SELECT DISTINCT consumer_group AS g FROM dlq_messages) WHERE target_group IS NULL OR target_group = g GROUP BY g")
def group_fanout(spark: SparkSession, d: str) -> DataFrame:
    """What each configured group handles: the messages for all, counted once, and those meant for it."""
    o = table(spark, d, "outbox_events")
    groups = sorted(r[0] for r in table(spark, d, "dlq_messages").select("consumer_group").dropna().distinct().collect())  # named in the configuration
    counts = [F.count_if(F.col("target_group").isNull() | (F.col("target_group") == g)).alias(f"g{k}") for k, g in enumerate(groups)]
    pairs = F.array(*[F.struct(F.lit(g).alias("consumer_group"), F.col(f"g{k}").alias("n")) for k, g in enumerate(groups)])
    return o.agg(*counts).select(F.inline(pairs)).filter("n > 0")


@query("SELECT status, claim_token IS NOT NULL AS claimed, count(*) AS n FROM (SELECT status, CASE WHEN delivery_id IN (SELECT delivery_id FROM outbox_events WHERE status = 'PENDING' AND available_at <= TIMESTAMP '2026-12-31' ORDER BY available_at, id, delivery_id LIMIT 100) THEN 'x' END AS claim_token FROM outbox_events) GROUP BY ALL")
def outbox_claimed(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "outbox_events")
    return delivery.with_claims(o, delivery.claim(o, "2026-12-31 00:00:00", 100), "x").groupBy("status", F.col("claim_token").isNotNull().alias("claimed")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT delivery_id, row_number() OVER (ORDER BY available_at, id, delivery_id) AS k FROM outbox_events WHERE status = 'PENDING' AND available_at <= TIMESTAMP '2026-12-31')
SELECT CASE WHEN k <= 60 THEN 'PROCESSED' ELSE status END AS status, CAST(sum(retry_count) AS BIGINT) AS retries, count(*) AS n FROM outbox_events LEFT JOIN c USING (delivery_id) GROUP BY ALL""")
def outbox_broker_down(spark: SparkSession, d: str) -> DataFrame:
    """Of 100 claimed events 60 were published before the broker went down; the others are released without a penalty."""
    o = table(spark, d, "outbox_events")
    claimed = delivery.with_claims(o, delivery.claim(o, "2026-12-31 00:00:00", 100), "x")
    after = delivery.released(claimed, delivery.claim(o, "2026-12-31 00:00:00", 60), NOW)
    return after.groupBy("status").agg(F.sum("retry_count").alias("retries"), F.count("*").alias("n"))


@query("SELECT event_type AS stream, count(*) FILTER (created_at >= TIMESTAMP '2026-04-01') AS kept, count(*) FILTER (created_at < TIMESTAMP '2026-04-01') AS trimmed, greatest(0, count(*) FILTER (created_at < TIMESTAMP '2026-04-01') - count(*) FILTER (status = 'PROCESSED') // 2) AS lost FROM outbox_events GROUP BY event_type")
def retention_audit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "outbox_events").withColumnRenamed("event_type", "stream")
    reads = o.groupBy("stream").agg(F.floor(F.count_if(F.col("status") == "PROCESSED") / 2).alias("entries_read"))
    return delivery.retention(o, reads, "2026-04-01 00:00:00")


@query("""WITH r AS (SELECT ingestion_run_id AS id, min(received_at) AS started, CASE count(*) % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, max(received_at) AS lease_until FROM raw_records WHERE ingestion_run_id IS NOT NULL GROUP BY ingestion_run_id)
SELECT id, status FROM r WHERE status = 'PENDING' OR (status = 'RUNNING' AND lease_until <= TIMESTAMP '2026-04-01') ORDER BY started, id LIMIT 20""")
def run_claims(spark: SparkSession, d: str) -> DataFrame:
    """The oldest runs that may be claimed: pending, or left running under a lease that has run out."""
    n = F.count("*") % 3
    r = table(spark, d, "raw_records").filter("ingestion_run_id is not null").groupBy(F.col("ingestion_run_id").alias("id"))
    r = r.agg(F.min("received_at").alias("started"), F.when(n == 0, "PENDING").when(n == 1, "RUNNING").otherwise("COMPLETED").alias("status"), F.max("received_at").alias("lease_until"))
    return delivery.claimable(r, AT).orderBy("started", "id").limit(20).select("id", "status")


@query("""WITH ids AS (SELECT DISTINCT id FROM dlq_messages WHERE id IS NOT NULL UNION SELECT DISTINCT id FROM outbox_events WHERE id IS NOT NULL),
one AS (SELECT * FROM (SELECT id, status, replayable, row_number() OVER (PARTITION BY id ORDER BY dead_lettered_at DESC NULLS LAST, delivery_id DESC) AS k FROM dlq_messages) WHERE k = 1)
SELECT CASE WHEN one.id IS NULL THEN 'NOT_FOUND' WHEN status <> 'DEAD' THEN 'ALREADY_REPLAYED' WHEN NOT coalesce(replayable, false) THEN 'NOT_REPLAYABLE' ELSE 'REPLAYED' END AS outcome, count(*) AS n FROM ids LEFT JOIN one USING (id) GROUP BY outcome""")
def dlq_replay_outcomes(spark: SparkSession, d: str) -> DataFrame:
    dlq = table(spark, d, "dlq_messages")
    asked = dlq.select("id").unionByName(table(spark, d, "outbox_events").select("id"))
    return delivery.replayed(dlq, asked, NOW)[2].groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT id, canonical_name, description, brand, origin_country, status, current_version_id, created_at, updated_at FROM products")
def api_products(spark: SparkSession, d: str) -> DataFrame:
    return tables.api_products(table(spark, d, "products"))


@query("SELECT id, received_at FROM raw_records WHERE ingestion_run_id = (SELECT ingestion_run_id FROM raw_records WHERE ingestion_run_id IS NOT NULL GROUP BY ingestion_run_id ORDER BY count(*) DESC, ingestion_run_id LIMIT 1) ORDER BY id LIMIT 3 OFFSET 3")
def run_page_after(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").select("id", "received_at", "ingestion_run_id")
    run = r.dropna(subset=["ingestion_run_id"]).groupBy("ingestion_run_id").count().orderBy(F.desc("count"), "ingestion_run_id").first()[0]
    return tables.run_page(r, run, 3, tables.run_page(r, run, 3)[1])[0].select("id", "received_at")


@query("""WITH u AS (SELECT source_id, external_product_id, max(received_at) AS r, max(source_updated_at) AS s FROM raw_records GROUP BY source_id, external_product_id)
SELECT p.source_id, p.external_product_id, greatest(p.updated_at, u.r) AS updated_at, u.s AS created_at FROM products p JOIN u USING (source_id, external_product_id)""")
def change_marks(spark: SparkSession, d: str) -> DataFrame:
    """Identities that changed: the time of change is set whatever it was, watermarks only rise."""
    seen = table(spark, d, "raw_records").groupBy(*changes.IDENTITY).agg(F.max("received_at").alias("updated_at"), F.max("source_updated_at").alias("created_at"))
    return tables.change_marks(table(spark, d, "products").select(*changes.IDENTITY, "updated_at", "created_at"), seen, changes.IDENTITY, ["updated_at"], "created_at")


@query("SELECT id FROM products p WHERE NOT EXISTS (SELECT 1 FROM product_versions v WHERE v.product_id = p.id AND v.version_number > 1)")
def delete_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    """All products were to go; those that a later version refers to are in use and are told apart from those that are left."""
    p = table(spark, d, "products").select("id")
    kept, used = tables.delete_unreferenced(p, p, "id", (table(spark, d, "product_versions").filter("version_number > 1"), "product_id"))
    return p.join(used, "id", "left_anti").unionByName(kept.join(used, "id", "left_anti"))


_EFFECTS = """WITH e AS (SELECT 'relay' AS scope, coalesce(replay_of_event_id, id) AS key, sha256(payload) AS h, delivery_id AS seq FROM outbox_events WHERE coalesce(replay_of_event_id, id) IS NOT NULL),
s AS (SELECT DISTINCT event_id AS key FROM dlq_messages WHERE event_id IS NOT NULL AND status = 'REPLAYED'),
x AS (SELECT e.*, s.key IS NOT NULL AS done, arg_min(h, seq) OVER (PARTITION BY e.key) AS fh, min(seq) OVER (PARTITION BY e.key) AS fs FROM e LEFT JOIN s ON s.key = e.key)
SELECT scope, key, seq, CASE WHEN h <> fh THEN 'MISMATCH' WHEN done THEN 'ALREADY_COMPLETED' WHEN seq = fs THEN 'ACQUIRED' ELSE 'ALREADY_COMPLETED' END AS outcome FROM x"""


@query(_EFFECTS)
def idempotent_effects(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "outbox_events")
    e = o.select(F.lit("relay").alias("scope"), F.coalesce("replay_of_event_id", "id").alias("key"), F.sha2(F.encode("payload", "UTF-8"), 256).alias("payload_hash"), F.col("delivery_id").alias("seq")).filter("key is not null")
    s = table(spark, d, "dlq_messages").filter("event_id is not null and status = 'REPLAYED'").select(F.lit("relay").alias("scope"), F.col("event_id").alias("key")).distinct()
    s = s.select("scope", "key", F.lit(None).cast("string").alias("s_hash"), F.lit("COMPLETED").alias("s_status"), F.lit(None).cast("timestamp_ntz").alias("s_lease_until"))
    return delivery.acquire(e, s, NOW)


@query("""SELECT failure_class AS error, attempts, CASE WHEN failure_class IN ('HANDLER_PANIC', 'CORRUPT_ENVELOPE', 'PAYLOAD_MISMATCH', 'NOT_COMPLETED_IN_TX', 'CONTRACT_VIOLATION', 'MALFORMED_RECORD', 'INVALID_CONFIG', 'PERMANENT') OR attempts >= 3 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS decision, count(*) AS n FROM dlq_messages GROUP BY ALL""")
def dlq_route(spark: SparkSession, d: str) -> DataFrame:
    q = delivery.routed(table(spark, d, "dlq_messages").withColumnRenamed("failure_class", "error"), "error", "attempts", 3)
    return q.groupBy("error", "attempts", "decision").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS replay_of_event_id, consumer_group AS target_group, event_type FROM (SELECT *, row_number() OVER (PARTITION BY stream, consumer_group, stream_message_id ORDER BY dead_lettered_at DESC NULLS LAST, delivery_id DESC) AS k FROM dlq_messages)
WHERE k = 1 AND status = 'DEAD' AND replayable AND length(event_id) > 0""")
def dlq_replay(spark: SparkSession, d: str) -> DataFrame:
    return delivery.replay_events(table(spark, d, "dlq_messages"), NOW).select("replay_of_event_id", "target_group", "event_type")


@query("SELECT event_type, min(available_at) AS oldest, count(*) AS n FROM outbox_events WHERE status = 'PENDING' GROUP BY event_type")
def oldest_pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outbox_events").filter("status = 'PENDING'").groupBy("event_type").agg(F.min("available_at").alias("oldest"), F.count("*").alias("n"))


# --- sources


@query("SELECT external_product_id, coalesce(canonical_name, '') AS canonical_name, coalesce(brand, '') AS brand FROM products WHERE external_product_id <> ''")
def csv_feed(spark: SparkSession, d: str) -> DataFrame:
    """Products written as a feed with untidy headers, and read back by the CSV scan."""
    path = scratch(spark, "feed-csv")
    rows = table(spark, d, "products").select(F.col("external_product_id").alias(" ID "), F.coalesce("canonical_name", F.lit("")).alias("Name"), F.coalesce("brand", F.lit("")).alias("BRAND "))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    found = feeds.identities(feeds.read_csv(spark, path))
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    return found.filter("error is null").select("external_product_id", field("name").alias("canonical_name"), field("brand").alias("brand"))


@query("SELECT external_product_id, canonical_name FROM products WHERE canonical_name IS NOT NULL")
def ndjson_feed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "feed-ndjson")
    table(spark, d, "products").filter("canonical_name is not null").select(F.to_json(F.struct(F.col("external_product_id").alias("id"), F.col("canonical_name").alias("title")))).write.text(path)
    good, _ = feeds.apply_policy(feeds.identities(feeds.read_ndjson(spark, path)), fail_fast=False)
    return good.select("external_product_id", F.get_json_object("payload", "$.title").alias("canonical_name"))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM products)
SELECT CASE WHEN k = 1 THEN 'malformed: line too long' WHEN ascii(id) % 5 = 0 THEN 'malformed: no object' WHEN ascii(id) % 3 = 0 THEN 'malformed: no id' ELSE 'good' END AS outcome, count(*) AS n FROM p GROUP BY outcome""")
def ndjson_rejects(spark: SparkSession, d: str) -> DataFrame:
    """A feed with a line beyond the limit, lines that are no object, lines without identity, and blank lines, which are neither good nor bad."""
    path = scratch(spark, "feed-rejects")
    p, first = table(spark, d, "products").select("id"), table(spark, d, "products").agg(F.min("id")).first()[0]
    code = F.ascii("id")
    line = F.when(F.col("id") == first, F.concat(F.lit('{"id":"'), F.repeat(F.lit("x"), F.lit(feeds.MAX_LINE)), F.lit('"}'))).when(code % 5 == 0, "[1]").when(code % 3 == 0, '{"id":" "}').otherwise(F.concat(F.lit('{"id":"'), "id", F.lit('"}')))
    p.select(F.concat(line, F.lit("\n  \r\n"))).write.text(path)
    rows = feeds.identities(feeds.read_ndjson(spark, path))
    return rows.groupBy(F.coalesce("error", F.lit("good")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT hs_code, origin_country, min(effective_from) AS effective_from, max(effective_to) AS effective_to FROM tariff_rates GROUP BY hs_code, origin_country HAVING max(effective_to) IS NULL OR max(effective_to) > min(effective_from)")
def curated_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules written as a curated file, and loaded by its strict scan."""
    path = scratch(spark, "curated")
    r = table(spark, d, "tariff_rates").groupBy("hs_code", "origin_country").agg(F.min("effective_from").alias("f"), F.max("effective_to").alias("t")).filter("t is null or t > f")
    text = r.select("hs_code", "origin_country", F.lit("held, \"as said\"").alias("description"), F.col("f").cast("string").alias("effective_from"), F.coalesce(F.col("t").cast("string"), F.lit("")).alias("effective_to"), F.lit("note").alias("source_reference"))
    text.coalesce(1).write.csv(path, header=True, escape='"', emptyValue="")
    return feeds.read_curated(spark, path, "IMPORT_RESTRICTION").select("hs_code", "origin_country", "effective_from", "effective_to")


@query("""SELECT s || '-' || k AS external_product_id, 'Record ' || k AS title, CAST(k AS BIGINT) AS n FROM (VALUES ('north'), ('south')) t(s), range(230) r(k)""")
def rest_pages(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(RestSource)
    pages = spark.read.format("paged_rest").options(url="north south", transport="tradeloom.sources.numbered:transport", pagination="page", page_size="50", records_path="data.items").load()
    return feeds.identities(pages).select("external_product_id", F.get_json_object("payload", "$.title").alias("title"), F.get_json_object("payload", "$.n").cast("long").alias("n"))


@query("""WITH s AS (SELECT DISTINCT source_id AS id, ascii(right(source_id, 1)) % 4 <> 0 AS enabled FROM products WHERE source_id <> 'src-harbourline'), r AS (SELECT DISTINCT ingestion_run_id AS id, source_id FROM raw_records WHERE ingestion_run_id < 'c')
SELECT CASE WHEN s.id IS NULL THEN 'NO_SOURCE' WHEN NOT s.enabled THEN 'SOURCE_DISABLED' WHEN x.ingestion_run_id IS NOT NULL AND r.id IS NULL THEN 'NO_RUN' ELSE 'STORED' END AS outcome, count(*) AS n
FROM raw_records x LEFT JOIN s ON s.id = x.source_id LEFT JOIN r ON r.id = x.ingestion_run_id AND r.source_id = x.source_id GROUP BY outcome""")
def raw_accepts(spark: SparkSession, d: str) -> DataFrame:
    """Records whose source is known and enabled and whose run exists; one source is made unknown here, others disabled, runs left out."""
    raw = table(spark, d, "raw_records").select("id", "source_id", "ingestion_run_id")
    sources = table(spark, d, "products").filter("source_id <> 'src-harbourline'").select(F.col("source_id").alias("id"), (F.ascii(F.right("source_id", F.lit(1))) % 4 != 0).alias("enabled")).distinct()
    known = raw.filter("ingestion_run_id < 'c'").select(F.col("ingestion_run_id").alias("id"), "source_id")
    return runs.accepted(raw, sources, known).groupBy(F.coalesce("refused", F.lit("STORED")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT id, coalesce(nullif(trim(source_version), ''), nullif(trim(etag), '')) AS version FROM raw_records")
def record_metadata(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").select("id", F.to_json(F.struct(F.col("source_version").alias("version"), "etag")).alias("payload"))
    return feeds.with_metadata(r).select("id", F.col("source_version").alias("version"))


@query("SELECT id, source_id || ':' || external_product_id AS identity FROM raw_records WHERE trim(source_id) <> '' AND trim(external_product_id) <> ''")
def composite_identity(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").select("id", F.to_json(F.struct(F.col("source_id").alias("source"), F.struct(F.col("external_product_id").alias("key")).alias("item"))).alias("payload"))
    return feeds.identities(r, parts=("source", "item.key")).filter("error is null").select("id", F.col("external_product_id").alias("identity"))


# --- streams


@query("""WITH r AS (SELECT source_id, CAST(source_updated_at AS DATE) AS period, received_at, received_at < TIMESTAMP '2026-04-01' AS early FROM raw_records WHERE source_updated_at IS NOT NULL AND received_at IS NOT NULL)
SELECT source_id, period, count(*) FILTER (counted) AS records, count(*) FILTER (early AND NOT counted) AS too_late, period <= DATE '2026-03-28' AS frozen
FROM (SELECT *, received_at < period + INTERVAL 4 DAY AND (early OR period > DATE '2026-03-28') AS counted FROM r) GROUP BY source_id, period
HAVING count(*) FILTER (counted) > 0 OR count(*) FILTER (early) > 0""")
def stream_periods(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream of two deliveries through both layers: a batch run after the first freezes periods, which refuse what the second brings for
    them; what the second brings for open ones is served from the fast layer's increments."""
    views = LambdaViews(spark)
    r = table(spark, d, "raw_records").select("id", "source_id", "source_updated_at", "received_at")
    path, checkpoint = scratch(spark, "log"), scratch(spark, "log-checkpoint")
    run_at = dt.datetime(2026, 4, 1)
    early = F.col("received_at") < F.lit(str(run_at)).cast("timestamp_ntz")
    for part in (r.filter(early), r.filter(~early)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 4).parquet(path)
        stream.writeStream.foreachBatch(views.on_micro_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if not views.runs:
            views.run_batch(run_at)
    return views.serve().filter("records > 0 or frozen").select("source_id", "period", "records", "too_late", "frozen")


@query("SELECT event_type AS stream, count(*) AS n FROM outbox_events GROUP BY event_type")
def stream_relay(spark: SparkSession, d: str) -> DataFrame:
    """The outbox relayed as a stream; a micro-batch that runs again replaces what it published."""
    out, path = scratch(spark, "published"), scratch(spark, "outbox")
    o = table(spark, d, "outbox_events")
    o.write.parquet(path)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 4).parquet(path)
    delivery.relay(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), scratch(spark, "relay-checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("stream").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT event_id) AS handled FROM (SELECT coalesce(replay_of_event_id, id) AS event_id, target_group, event_type FROM outbox_events) WHERE trim(event_id) <> '' AND nullif(trim(event_type), '') IS NOT NULL AND (target_group IS NULL OR target_group = 'duty-screen')")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One consumer group reads the outbox as a stream of several micro-batches; its effects are counted as they come."""
    path, done = scratch(spark, "messages"), scratch(spark, "effects")
    delivery.encode(table(spark, d, "outbox_events")).repartition(12).write.parquet(path)
    sample = spark.read.parquet(path)
    stream = spark.readStream.schema(sample.schema).option("maxFilesPerTrigger", 4).parquet(path)
    keep = lambda df, n: df.select("event_id").write.mode("overwrite").parquet(f"{done}/batch={n}")
    delivery.consume(stream, "duty-screen", keep, lambda df, n: None, scratch(spark, "group-checkpoint")).awaitTermination()
    return spark.read.parquet(done).agg(F.count("*").alias("handled"))
