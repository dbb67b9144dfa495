"""Attributes as they were known at the time of an event.

Each attribute of an entity has a change history of its own: rows (entity key, attribute, known_from, known_to,
values). An event takes, for each attribute apart, the last state known at its time; the states are then pivoted back
into one row for each event. No wide version of the entity is built, so attributes may change at different times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import SPACE, broadcast_up_to, or_null, stored, trimmed

#: Histories of up to so many rows (and session.BROADCAST_BYTES) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Days of a time bucket, by which long histories are joined.
BUCKET_DAYS = 32
#: Attributes are columns of the pivoted result; more than so many are an error.
MAX_ATTRIBUTES = 2_000


def change_history(facts: DataFrame, keys: Sequence[str], attribute: str, value: str, start: str, end: str) -> DataFrame:
    """Facts valid in [start, end) (null end = open) as one history for each key and attribute: a row for each time
    at which the set of valid values changes, holding that set (`known_values`, sorted, may be empty) and the time of
    the next change. Facts with a null key, attribute or start, or that end before they begin, hold never. Repeated facts count once.

    The times of change are numbered for each key and attribute, and a fact is laid on the numbers from its start to its end, so the work is that of
    the histories written, not facts times changes.
    """
    by = [*keys, attribute]
    f = facts.select(*by, F.col(value).alias("v"), F.col(start).alias("s"), F.col(end).alias("e")).dropna(subset=[*by, "v", "s"])
    f = f.filter(F.col("e").isNull() | (F.col("s") < F.col("e"))).distinct()
    # distinct instants, collapsed map side: a hot key has many facts, but few times at which something is published
    points = f.select(*by, F.explode(F.array("s", "e")).alias("known_from")).filter("known_from is not null").distinct()
    w = Window.partitionBy(*by).orderBy("known_from")
    points = points.withColumn("n", F.row_number().over(w)).withColumn("known_to", F.lead("known_from").over(w))
    first = points.select(*by, F.col("known_from").alias("s"), F.col("n").alias("n_s"))
    last = points.select(*by, F.col("known_from").alias("e"), F.col("n").alias("n_e"))
    total = points.groupBy(*by).agg(F.max("n").alias("n_all"))
    laid = f.join(first, [*by, "s"]).join(last, [*by, "e"], "left").join(total, by)
    laid = laid.select(*by, "v", F.explode(F.sequence("n_s", F.coalesce(F.col("n_e") - 1, "n_all"))).alias("n"))
    held = laid.groupBy(*by, "n").agg(F.array_sort(F.collect_set("v")).alias("known_values"))
    return points.join(held, [*by, "n"], "left").select(*by, "known_from", "known_to", F.coalesce("known_values", F.array().cast("array<string>")).alias("known_values"))


def _day(c: str):  # noqa: ANN202
    return F.unix_date(F.to_date(c))


def last_known(events: DataFrame, history: DataFrame, keys: Sequence[str], at: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each event with the state of each attribute that was the last known at its time: a row for each event and attribute
    that has a non-empty state. Events with a null key or time match nothing. history should be a stored table.

    A history too large to broadcast is laid on time buckets, so that an event meets the states of its key in its bucket only, however long the
    key's history is; skewed keys are split by AQE.
    """
    h = history.filter(F.size("known_values") > 0).withColumnsRenamed({k: f"_h_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    known = (F.col("known_from") <= F.col(at)) & (F.col("known_to").isNull() | (F.col(at) < F.col("known_to")))
    small = broadcast_up_to(h, broadcast_rows)
    if small is not h:
        return events.join(small, [*on, known]).drop(*[f"_h_{k}" for k in keys])
    first, last = events.agg(F.min(_day(at)), F.max(_day(at))).first()
    if first is None:
        first, last = 0, 0
    begin, end = F.greatest(_day("known_from"), F.lit(first)), F.least(F.coalesce(_day("known_to"), F.lit(last)), F.lit(last))
    bucket = lambda c: F.floor(c / BUCKET_DAYS)
    laid = h.filter(begin <= end).withColumn("_h_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    e = events.withColumn("_bucket", bucket(_day(at)))
    return e.join(laid, [*on, F.col("_bucket") == F.col("_h_bucket"), known]).drop(*[f"_h_{k}" for k in keys], "_h_bucket", "_bucket")


def attribute_names(history: DataFrame, attribute: str = "attribute") -> list[str]:
    """The attributes a history has, sorted; ValueError if they are too many to be columns."""
    names = [r[0] for r in history.select(attribute).distinct().limit(MAX_ATTRIBUTES + 1).collect()]
    if len(names) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    return sorted(names)


def known_rows(wide: DataFrame, ids: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
    """What pivot_back gives, a row for each event and known value."""
    if not names:
        return wide.select(*ids, F.lit(None).cast("string").alias(value)).limit(0)
    return wide.select(*ids, F.explode(F.flatten(F.array_compact(F.array(*[F.col(f"`{n}`") for n in names])))).alias(value))


def pivot_back(matches: DataFrame, ids: Sequence[str], attribute: str, values: str, names: Sequence[str]) -> DataFrame:
    """One row for each event, one column for each attribute named: the sorted values known, from all the matches; null if there are none."""
    if not names:
        return matches.select(*ids).distinct()
    return matches.groupBy(*ids).pivot(attribute, list(names)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias("v")).select(*ids, *[F.when(F.size(F.col(f"`{n}`")) > 0, F.col(f"`{n}`")).alias(n) for n in names])


def tariff_history(rates: DataFrame, datasets: DataFrame) -> DataFrame:
    """The change history of each measure: key (jurisdiction, hs_code, origin_country), attribute = type and code of
    the measure. A rate is known while its dataset version is published and its own dates hold."""
    d = datasets.select(F.col("id").alias("dataset_id"), "jurisdiction", "activated_at", "superseded_at").filter("activated_at is not null")
    r = rates.select(F.col("id").alias("rate_id"), "dataset_id", "hs_code", "origin_country", "measure_type", "measure_code", "effective_from", "effective_to").filter("effective_from is not null")
    facts = r.join(d, "dataset_id").select(
        "jurisdiction",
        "hs_code",
        "origin_country",
        F.concat_ws(":", F.coalesce("measure_type", F.lit("")), "measure_code").alias("attribute"),
        "rate_id",
        F.greatest(F.col("activated_at"), F.col("effective_from").cast("timestamp_ntz")).alias("valid_from"),
        F.least(F.col("superseded_at"), F.col("effective_to").cast("timestamp_ntz")).alias("valid_to"),
    )
    return change_history(facts, ["jurisdiction", "hs_code", "origin_country"], "attribute", "rate_id", "valid_from", "valid_to")


def tariff_lookups(queries: DataFrame) -> DataFrame:
    """query_id, jurisdiction, known_at, hs_code, origin_country: a row for each leading part of the query's code and each of
    its origin and `*`. Queries without time, code or origin, or with a code that isn't 2 to 10 digits in pairs, have none."""
    code, origin = F.regexp_replace("hs_code", rf"[.]|{SPACE}", ""), F.upper(or_null(trimmed(F.col("origin"))))
    q = queries.select("query_id", "jurisdiction", F.col("transaction_at").alias("known_at"), code.alias("code"), origin.alias("origin"))
    q = q.filter(F.col("code").rlike(r"\A([0-9]{2}){1,5}\z") & F.col("origin").isNotNull() & F.col("known_at").isNotNull() & F.col("jurisdiction").isNotNull())
    prefixes = F.transform(F.sequence(F.lit(2), F.length("code"), F.lit(2)), lambda n: F.substring(F.col("code"), F.lit(1), n))
    q = q.select("query_id", "jurisdiction", "known_at", "origin", F.explode(prefixes).alias("hs_code"))
    return q.select("query_id", "jurisdiction", "known_at", "hs_code", F.explode(F.array_distinct(F.array("origin", F.lit("*")))).alias("origin_country"))


def tariffs_known(queries: DataFrame, rates: DataFrame, datasets: DataFrame) -> tuple[DataFrame, list[str]]:
    """(frame, measures): one row for each query of which any measure is known, with query_id and a column for each measure of the rates, which
    holds the ids of the rates in force and published at the query's time. A repeated query_id is one query with the rates of all its rows."""
    keys = ["jurisdiction", "hs_code", "origin_country"]
    history = stored(tariff_history(rates, datasets), "tariff-history")
    names = attribute_names(history)
    found = last_known(tariff_lookups(queries), history, keys, "known_at")
    return pivot_back(found, ["query_id"], "attribute", "known_values", names), names
