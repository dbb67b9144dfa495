"""Set-similarity join with a prefix filter, exact at its threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_up_to, stored

#: Tables of up to so many rows are broadcast (rows of some hundred bytes).
BROADCAST_ROWS = 50_000


def _by_rarity(sets: DataFrame, ranks: DataFrame) -> DataFrame:
    """id, tokens: the ranks of each set's tokens, the rarest of both sides first."""
    one = sets.select("id", F.explode("tokens").alias("token")).join(ranks, "token")
    return one.groupBy("id").agg(F.array_sort(F.collect_set("rank")).alias("tokens"))


def _prefixes(sets: DataFrame, threshold: float, name: str) -> DataFrame:
    size = F.size("tokens")
    kept = size - F.ceil(F.lit(threshold) * size) + 1
    return sets.select(F.col("id").alias(name), F.col("tokens").alias(f"{name}_tokens"), size.alias(f"{name}_size"), F.posexplode(F.slice("tokens", F.lit(1), kept.cast("int"))).alias(f"{name}_at", "rank"))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left_id, right_id, jaccard of all pairs with a Jaccard of at least threshold. left and right hold (id, tokens array<string>),
    ids unique; empty or null sets match nothing, repeated tokens count once.

    Two sets that similar share a token among the rarest of each: only those prefixes are joined. Pairs whose sizes, or whose
    positions of the shared token, rule the threshold out are dropped before the exact count. Tokens are numbered by rarity, so sets are sorted numbers.
    """
    l, r = (x.select("id", F.array_distinct("tokens").alias("tokens")).filter(F.size("tokens") > 0) for x in (left, right))
    frequency = l.select(F.explode("tokens").alias("token")).unionByName(r.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("n"))
    # after a global sort the ids of rows rise in its order
    ranks = stored(frequency.orderBy("n", "token").select("token", F.monotonically_increasing_id().alias("rank")), "token-ranks")
    ranks = broadcast_up_to(ranks, BROADCAST_ROWS)
    a, b = _prefixes(_by_rarity(l, ranks), threshold, "left_id"), _prefixes(_by_rarity(r, ranks), threshold, "right_id")
    b = broadcast_up_to(stored(b, "prefixes"), BROADCAST_ROWS)
    x, y = F.col("left_id_size"), F.col("right_id_size")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (x + y) - 1e-9)
    lengths = (y >= F.lit(threshold) * x - 1e-9) & (x >= F.lit(threshold) * y - 1e-9)
    positions = 1 + F.least(x - F.col("left_id_at") - 1, y - F.col("right_id_at") - 1) >= need
    # a pair is kept at its first shared token only: before it the prefixes have none in common
    before = [F.slice(f"{s}_tokens", F.lit(1), F.col(f"{s}_at")) for s in ("left_id", "right_id")]
    pairs = a.join(b, "rank").filter(lengths).filter(positions).filter(~F.arrays_overlap(*before))
    both = F.size(F.array_intersect("left_id_tokens", "right_id_tokens"))
    found = pairs.select("left_id", "right_id", x.alias("x"), y.alias("y"), both.alias("both")).filter(F.col("both") >= F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x") + F.col("y")) - 1e-9))
    found = found.select("left_id", "right_id", (F.col("both") / (F.col("x") + F.col("y") - F.col("both"))).alias("jaccard"))
    return found.filter(F.col("jaccard") >= threshold - 1e-9)
