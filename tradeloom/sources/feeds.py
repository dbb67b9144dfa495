"""Supplier feeds: CSV, newline-delimited JSON and curated rule files, as scans with a row policy."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import stable_uuid
from ..functions.textnorm import decode_json, look_up, parse_path, scalar_text
from ..session import stored

#: Fixed value: longer lines of a feed are malformed.
MAX_LINE = 1 << 20
#: Fields a feed's record may name its version and time of change by.
VERSION_FIELDS, TIME_FIELDS = ("version", "v", "etag", "revision"), ("updated_at", "source_updated_at", "modified_at")


class FeedError(ValueError):
    """A feed that can't be read, or a malformed row under fail-fast."""


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The names of the first line, trimmed and in lower case."""
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip():
        raise FeedError("empty feed")
    return [h.strip().lower() for h in next(csv.reader(io.StringIO(first[0][0])))]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """payload: one JSON object of strings for each row. Short rows are padded with empty strings, surplus cells dropped, quoted cells
    may hold line ends. Files are split unless some line leaves a quote open, which a first scan of the text tells."""
    names = csv_header(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    spans = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=spans, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
    return rows.select(F.to_json(F.struct(*[F.coalesce(F.col(f"c{k}"), F.lit("")).alias(n) for k, n in enumerate(names)])).alias("payload"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """payload: each line that isn't blank, its bytes kept, without a carriage return at the end."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r\\z", "").alias("payload"))
    return lines.filter(F.length(F.trim("payload")) > 0)


def identities(rows: DataFrame, id_path: str | None = None, parts: tuple[str, ...] = (), separator: str = ":", custom: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with external_product_id and error. The identity is the trimmed scalar at id_path, or all parts joined, or what custom makes of the payload; a
    missing or blank part is an error, as are lines that are too long or no JSON object."""
    if custom is not None:
        found = F.trim(custom(F.col("payload")))
        bad = F.when(F.octet_length("payload") > MAX_LINE, "malformed: line too long").when(F.coalesce(F.length(found), F.lit(0)) == 0, "malformed: no id")
        return rows.withColumn("error", bad).withColumn("external_product_id", F.when(F.col("error").isNull(), found)).select(*rows.columns, "external_product_id", "error")
    paths = parts or (id_path or "id",)
    for p in paths:
        parse_path(p)

    @F.pandas_udf("external_product_id string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for payloads in batches:
            out = []
            for text in payloads:
                try:
                    if len(text.encode()) > MAX_LINE:
                        raise ValueError("line too long")
                    root = decode_json(text)
                    if not isinstance(root, dict):
                        raise ValueError("no object")
                    found = [look_up(root, p) for p in paths]
                    ids = ["" if v is None else scalar_text(v).strip() for v in found]
                    if not all(ids):
                        raise ValueError("no id")
                    out.append((separator.join(ids), None))
                except (ValueError, RecursionError) as e:
                    out.append((None, "malformed: " + str(e)[:60]))
            yield pd.DataFrame(out, columns=["external_product_id", "error"])

    return rows.withColumn("_i", run("payload")).select(*rows.columns, "_i.external_product_id", "_i.error")


def with_metadata(rows: DataFrame) -> DataFrame:
    """rows with source_version (the first field of VERSION_FIELDS that isn't blank) and source_updated_at (the first of TIME_FIELDS that is a time, UTC)."""
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    text = [F.when(F.length(F.trim(field(n))) > 0, F.trim(field(n))) for n in VERSION_FIELDS]
    times = [F.try_to_timestamp(F.when(field(n).rlike(r"\A\d{4}-\d{2}-\d{2}T"), field(n))) for n in TIME_FIELDS]
    return rows.withColumn("source_version", F.coalesce(*text)).withColumn("source_updated_at", F.coalesce(*times))


def raw_records(rows: DataFrame, source_id: str, run_id: str, received_at: Column) -> DataFrame:
    """Immutable raw records: a stable id, trimmed identity, the payload, its exact bytes and their SHA-256. ValueError without source; rows without
    identity or payload are left out (apply_policy reports them)."""
    if not source_id.strip():
        raise ValueError("a raw record needs a source")
    raw = F.encode("payload", "UTF-8")
    rows = rows.filter((F.length(F.trim("external_product_id")) > 0) & F.col("payload").isNotNull()).withColumn("external_product_id", F.trim("external_product_id"))
    made = stable_uuid(F.lit(source_id.strip()), F.col("external_product_id"), F.lit(run_id), F.sha2(raw, 256))
    return rows.select(made.alias("id"), F.lit(source_id.strip()).alias("source_id"), "external_product_id", "payload", raw.alias("payload_raw"), F.sha2(raw, 256).alias("payload_sha256"), "source_version", "source_updated_at", F.lit(run_id).alias("ingestion_run_id"), received_at.alias("received_at"))


def apply_policy(rows: DataFrame, fail_fast: bool) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects). Under fail-fast a reject raises when the good rows are read."""
    if fail_fast:
        checked = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("row policy: "), F.col("error")))))
        return checked.filter("error is null").drop("error"), rows.limit(0)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


#: The columns of curated rule files.
CURATED = {
    "IMPORT_RESTRICTION": ["hs_code", "origin_country", "description", "effective_from", "effective_to", "source_reference"],
    "PERMIT": ["hs_code", "origin_country", "permit_code", "issuing_agency", "document_type", "effective_from", "effective_to", "source_reference"],
}


def read_curated(spark: SparkSession, path: str, category: str) -> DataFrame:
    """The rules of a curated file, all or none: the header must be exact, each row complete, dates valid, and a rule must end after it begins."""
    if category not in CURATED:
        raise FeedError(f"category {category} has no curated file")
    names = CURATED[category]
    if csv_header(spark, path) != names:
        raise FeedError(f"header must be {names}")
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    rows = stored(rows, "curated").select(*[F.trim(F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names], "_bad")
    day = {n: F.try_to_date(F.when(F.col(n).rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.col(n)), "yyyy-MM-dd") for n in ("effective_from", "effective_to")}
    wrong = F.col("_bad").isNotNull() | day["effective_from"].isNull() | ((F.col("effective_to") != "") & day["effective_to"].isNull()) | (day["effective_to"] <= day["effective_from"])
    wrong |= ~F.col("hs_code").rlike(r"\A([0-9]{2}){1,5}\z") | ~F.col("origin_country").rlike(r"\A([A-Z]{2}|\*)\z")
    bad = rows.filter(F.coalesce(wrong, F.lit(False))).limit(1).collect()
    if bad:
        raise FeedError(f"bad row: {bad[0].asDict()}")
    return rows.select(*[day[n].alias(n) if n in day else F.col(n) for n in names])


def feed_slice(rows: DataFrame, order: str, offset: int, limit: int) -> tuple[DataFrame, str | None]:
    """A page of a feed in the order of a column, and the next checkpoint; for parity with readers that go by offset."""
    part = rows.orderBy(order).offset(offset).limit(limit)
    more = rows.orderBy(order).offset(offset + limit).limit(1).count()
    return part, f"offset:{offset + limit}" if more else None



@dataclass(frozen=True)
class FeedConfig:
    """How a feed is read. Names of CSV columns are in lower case, so its id field is too; composite ids keep theirs."""

    path: str
    format: str = "CSV"
    id_field: str = "id"
    parts: tuple[str, ...] = ()
    separator: str = ":"
    batch: int = 500
    fail_fast: bool = False
    custom: Callable[[Column], Column] | None = None


def _feed(spark: SparkSession, config: FeedConfig) -> DataFrame:
    csv_feed = config.format.upper() == "CSV"
    rows = read_csv(spark, config.path) if csv_feed else read_ndjson(spark, config.path)
    return identities(rows, config.id_field.lower() if csv_feed else config.id_field, config.parts, config.separator, config.custom)


#: What reads a source, by its type; add() puts in more.
ADAPTERS: dict[str, Callable] = {"FEED": _feed}


def add(source_type: str, adapter: Callable) -> None:
    ADAPTERS[source_type.strip().upper()] = adapter


def adapter(source_type: str) -> Callable:
    """FeedError for a type that nothing reads."""
    found = ADAPTERS.get(source_type.strip().upper())
    if found is None:
        raise FeedError(f"no adapter for {source_type}")
    return found
