"""Schemas of the engine's tables; nothing is inferred from data."""

from __future__ import annotations

SOURCES = "id string, name string, source_type string, config string, rate_limit_per_second double, enabled boolean, created_at timestamp, updated_at timestamp"
INGESTION_RUNS = "id string, source_id string, status string, seen int, new int, changed int, unchanged int, failed int, checkpoint string, started_at timestamp, finished_at timestamp"
RAW_RECORDS = "id string, source_id string, external_product_id string, payload string, payload_raw binary, payload_sha256 string, source_version string, etag string, source_updated_at timestamp_ntz, ingestion_run_id string, received_at timestamp_ntz"
PRODUCTS = "id string, source_id string, external_product_id string, canonical_name string, description string, brand string, origin_country string, status string, current_version_id string, current_fingerprint string, created_at timestamp_ntz, updated_at timestamp_ntz"
PRODUCT_VERSIONS = "id string, product_id string, version_number int, fingerprint string, canonical_name string, description string, brand string, origin_country string, attributes string, ingestion_run_id string, created_at timestamp_ntz"
PRODUCT_SOURCES = "id string, product_id string, source_id string, external_product_id string, last_source_updated_at timestamp_ntz, last_received_at timestamp_ntz, last_changed_at timestamp_ntz"
PRODUCT_CHANGES = "id string, product_id string, from_version_id string, to_version_id string, change_type string, changed_fields array<string>, created_at timestamp_ntz"
OUTBOX_EVENTS = "id string, aggregate_type string, aggregate_id string, event_type string, payload string, status string, retry_count int, available_at timestamp_ntz, last_error string, replay_of_event_id string, target_group string, created_at timestamp_ntz, processed_at timestamp_ntz"
IDEMPOTENCY_KEYS = "scope string, key string, payload_hash string, status string, attempts int, lease_until timestamp_ntz"
DLQ_MESSAGES = "id string, stream string, consumer_group string, stream_message_id string, event_id string, event_type string, payload binary, failure_class string, last_error string, attempts int, replayable boolean, status string, dead_lettered_at timestamp_ntz"
REGULATORY_DATASETS = "id string, jurisdiction string, category string, source string, version string, status string, content_sha256 binary, fetched_at timestamp_ntz, activated_at timestamp_ntz, superseded_at timestamp_ntz, created_at timestamp_ntz"
TARIFF_RATES = "id string, dataset_id string, hs_code string, origin_country string, measure_type string, measure_code string, rate_type string, ad_valorem_percent decimal(12,4), specific_amount decimal(12,4), effective_from date, effective_to date"
IMPORT_RESTRICTIONS = "id string, dataset_id string, hs_code string, origin_country string, description string, effective_from date, effective_to date, source_reference string"
PERMIT_REQUIREMENTS = "id string, dataset_id string, hs_code string, origin_country string, permit_code string, issuing_agency string, document_type string, effective_from date, effective_to date, source_reference string"
SANCTIONS_LIST = "id string, dataset_id string, list_entry_id string, party_name string, effective_from date, effective_to date"
EXPORT_CONTROLS = "id string, dataset_id string, hs_code string, destination_country string, control_code string, effective_from date, effective_to date"
PREFERENTIAL_AGREEMENTS = "id string, dataset_id string, agreement_code string, partner_country string, effective_from date, effective_to date"
