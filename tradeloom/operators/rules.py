"""Effective-dated rules: coverage, as-of candidates, the most specific rule, supersession and overlaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import country, hs_code, hs_prefixes, in_force, jurisdiction, utc_date
from ..session import broadcast_up_to, stored

#: The reasons for which no rate is given.
NO_COVERAGE, STALE_DATA, NO_RATE, AMBIGUOUS, UNSUPPORTED = "NO_REGULATORY_COVERAGE", "STALE_REGULATORY_DATA", "NO_TARIFF_RATE", "AMBIGUOUS_TARIFF", "UNSUPPORTED_MEASURE"

#: Rule tables are versions of published books; beyond so many rows they are joined by shuffle.
MAX_BROADCAST = 500_000


def active_at(datasets: DataFrame, at: str) -> DataFrame:
    """Dataset versions in force at an instant (ISO text, UTC)."""
    return datasets.filter(in_force(F.col("activated_at"), F.col("superseded_at"), F.lit(at).cast("timestamp_ntz")))


def supersession(datasets: DataFrame) -> DataFrame:
    """Each activated version with the instant at which its successor of the same line takes over."""
    w = Window.partitionBy("jurisdiction", "category", "source").orderBy("activated_at", "id")
    return datasets.filter("activated_at is not null").withColumn("closed_at", F.lead("activated_at").over(w))


def freshness(datasets: DataFrame, at: str, sla_hours: Mapping[str, int]) -> DataFrame:
    """jurisdiction, category, datasets in force, whether any is older than its category's SLA (exactly as old is fresh), and the hold reason. Every
    category of the datasets needs a positive SLA; one without counts as stale at any age."""
    if not sla_hours or min(sla_hours.values()) <= 0:
        raise ValueError("every SLA must be greater than zero")
    held = in_force(F.col("activated_at"), F.col("superseded_at"), F.lit(at).cast("timestamp_ntz"))
    g = datasets.groupBy("jurisdiction", "category").agg(F.count_if(held).alias("in_force"), F.coalesce(F.bool_or(F.when(held, _too_old(F.lit(at).cast("timestamp_ntz"), sla_hours))), F.lit(False)).alias("stale"))
    return g.withColumn("hold_reason", F.when(F.col("in_force") == 0, NO_COVERAGE).when(F.col("stale"), STALE_DATA))


def _too_old(at: Column, sla_hours: Mapping[str, int]) -> Column:
    sla = F.coalesce(*[F.when(F.col("category") == c, F.make_dt_interval(hours=F.lit(h))) for c, h in sla_hours.items()], F.make_dt_interval(hours=F.lit(-1)))
    return at - F.col("fetched_at") > sla


def overlaps(rules: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rules that begin before an earlier one of the same keys has ended: a running maximum instead of a self-join. An open end overlaps
    all that follow; null keys are a key of their own."""
    far = F.lit("9999-12-31").cast("date")
    w = Window.partitionBy(*keys).orderBy(start, F.coalesce(F.col(end), far), "id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.coalesce(F.col(end), far)).over(w)
    return rules.withColumn("earlier_until", until).filter(F.col(start) < F.col("earlier_until"))


def parsed_queries(queries: DataFrame) -> DataFrame:
    """query_id, jurisdiction, code, origin, on_date, evaluated_at; invalid codes and origins are null, as are origins that aren't imported into the jurisdiction
    (its own, and its members')."""
    origin = country(F.col("origin"))
    origin = F.when(jurisdiction(origin) != F.col("jurisdiction"), origin)
    return queries.select("query_id", "jurisdiction", hs_code(F.col("hs_code")).alias("code"), origin.alias("q_origin"), utc_date(F.col("transaction_at")).alias("on_date"), "evaluated_at")


def candidates(queries: DataFrame, rates: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rates that may apply to each query: published when it was evaluated, valid on its date, of its code's leading parts, its origin or any. The rates are joined
    by equal (jurisdiction, code, origin), a row of the query for each leading part and for each of its origin and `*`."""
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("jurisdiction").alias("d_jurisdiction"), "activated_at", "superseded_at")
    r = rates.join(broadcast_up_to(d, MAX_BROADCAST), "dataset_id")
    r = r.select(F.col("id").alias("rate_id"), F.col("hs_code").alias("rule_code"), "origin_country", "measure_type", F.coalesce("measure_code", F.lit("")).alias("measure_code"), "rate_type", "ad_valorem_percent", "effective_from", "effective_to", "d_jurisdiction", "activated_at", "superseded_at")
    rules = broadcast_up_to(stored(r, "rules"), MAX_BROADCAST)
    q = parsed_queries(queries).filter(F.col("code").isNotNull() & F.col("q_origin").isNotNull() & F.col("on_date").isNotNull() & F.col("evaluated_at").isNotNull())
    q = q.withColumn("prefix", F.explode(hs_prefixes(F.col("code")))).withColumn("any_origin", F.explode(F.array("q_origin", F.lit("*"))))
    q = q.join(rules, (F.col("prefix") == F.col("rule_code")) & (F.col("jurisdiction") == F.col("d_jurisdiction")) & (F.col("any_origin") == F.col("origin_country")))
    return q.filter(in_force(F.col("activated_at"), F.col("superseded_at"), F.col("evaluated_at")) & in_force(F.col("effective_from"), F.col("effective_to"), F.col("on_date")))


def most_specific(found: DataFrame) -> DataFrame:
    """For each query and measure the best-placed rate: own origin before any, longer code before shorter. n_tied tells of ties."""
    w = Window.partitionBy("query_id", "measure_type", "measure_code").orderBy((F.col("origin_country") != F.col("q_origin")).cast("int"), F.desc(F.length("rule_code")))
    top = found.filter(F.col("measure_type") != "PREFERENTIAL").withColumn("_rank", F.rank().over(w)).filter("_rank = 1")
    return top.groupBy("query_id", "measure_type", "measure_code").agg(F.count("*").alias("n_tied"), F.min("rate_type").alias("rate_type"), F.sum("ad_valorem_percent").alias("ad_valorem"))


def resolve_tariffs(queries: DataFrame, rates: DataFrame, datasets: DataFrame, sla_hours: int = 10**6, category: str = "TARIFF") -> DataFrame:
    """query_id, hold_reason, n_measures, ad_valorem_percent of every query. Reasons, first that holds: INVALID_QUERY, NO_REGULATORY_COVERAGE,
    STALE_REGULATORY_DATA (a dataset in force was fetched more than sla_hours before the evaluation), NO_TARIFF_RATE, then of the measures in
    order (MFN first, then by code) AMBIGUOUS_TARIFF before UNSUPPORTED_MEASURE. Only datasets of the category are read."""
    own = datasets.filter(F.col("category") == category)
    best = most_specific(candidates(queries, rates, own))
    first = F.struct((F.col("measure_type") != "MFN").cast("int"), "measure_code")
    problem = F.when(F.col("n_tied") > 1, AMBIGUOUS).when(F.col("rate_type") == UNSUPPORTED, UNSUPPORTED)
    per = best.groupBy("query_id").agg(
        F.bool_or(F.col("measure_type") == "MFN").alias("has_mfn"), F.count("*").alias("n"), F.sum(F.coalesce("ad_valorem", F.lit(0))).alias("total"), F.min_by(problem, F.when(problem.isNotNull(), first)).alias("problem")
    )
    lines = own.filter("activated_at is not null").select(F.col("jurisdiction").alias("d_jurisdiction"), "category", "fetched_at", "activated_at", "superseded_at")
    q = parsed_queries(queries)
    instants = q.select("query_id", "jurisdiction", "evaluated_at").join(broadcast_up_to(lines, MAX_BROADCAST), F.col("jurisdiction") == F.col("d_jurisdiction"))
    covered = instants.filter(in_force(F.col("activated_at"), F.col("superseded_at"), F.col("evaluated_at")))
    covered = covered.groupBy("query_id").agg(F.bool_or(_too_old(F.col("evaluated_at"), {category: sla_hours})).alias("stale"))
    out = q.join(per, "query_id", "left").join(covered, "query_id", "left")
    bad = F.col("code").isNull() | F.col("q_origin").isNull() | F.col("on_date").isNull() | F.col("jurisdiction").isNull() | F.col("evaluated_at").isNull()
    hold = F.when(bad, "INVALID_QUERY").when(F.col("stale").isNull(), NO_COVERAGE).when(F.col("stale"), STALE_DATA).when(~F.coalesce("has_mfn", F.lit(False)), NO_RATE).otherwise(F.col("problem"))
    out = out.withColumn("hold_reason", hold)
    return out.select("query_id", "hold_reason", F.when(hold.isNull(), F.col("n")).alias("n_measures"), F.when(hold.isNull(), F.col("total").cast("decimal(38,6)")).alias("ad_valorem_percent"))
