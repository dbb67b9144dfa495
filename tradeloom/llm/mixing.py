"""Mixing sources to target shares of tokens, by Efraimidis-Spirakis sampling.

Each text gets an exponential key, -ln(u) over its quality weight, with u from a hash of its id and the seed. Within a source texts are taken in
the order of their keys, smallest first, until the source's token budget is spent; whole epochs over a source come before the fractional
selection. The order is never materialised: texts are counted into buckets of the key's logarithm, the buckets' token sums give the bucket in
which the budget ends, and only that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_up_to, stored
from .tokens import VOCABULARY, spread, token_count

#: Width of a bucket of ln(key). For texts of one weight ln(key) has a Gumbel density of at most 1/e, and a mixture of weights less, so a bucket
#: expects at most 0.2 % of its source's texts, however many there are.
BUCKET_WIDTH = 0.005
#: The tables of one row for each source are broadcast up to so many sources.
MAX_SOURCES = 100_000


def quality(text: Column) -> Column:
    """A weight in [0.05, 1]: soft forms of published heuristics for web text, each a factor that is 1 from its threshold on. Words that hold a
    letter (80 %), distinct words (40 %), distinct lines (70 %), lines that end in a sentence mark (30 %, at least 0.5), few marks of lists and
    tables (one to ten words), no damage (replacement and control characters, tags), at least 50 words."""
    words = F.split(text, r"\s+")
    lines = F.split(F.trim(text), r"[\r\n]+")
    n, n_lines = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    upto = lambda share, full: F.least(F.lit(1.0), share / full)
    lettered = upto(F.regexp_count(text, F.lit(r"\p{L}\S*")) / n, 0.8)
    varied = upto(F.size(F.array_distinct(words)) / n, 0.4)
    lines_varied = upto(F.size(F.array_distinct(lines)) / n_lines, 0.7)
    ended = F.greatest(F.lit(0.5), upto(F.regexp_count(text, F.lit(r"[.!?。！？][\"'”’)»]*[^\S\r\n]*(?:[\r\n]|\z)")) / n_lines, 0.3))
    marks = upto(F.lit(0.1) * n, F.greatest(F.regexp_count(text, F.lit(r"[|#*•~=_<>{}\[\]]")), F.lit(1)))
    clean = upto(F.lit(0.01) * n, F.greatest(F.regexp_count(text, F.lit(r"[\x{fffd}\x{00}-\x{08}]|</?[A-Za-z][^<>]*>")), F.lit(0.01) * n))
    return F.greatest(F.lit(0.05), lettered * varied * lines_varied * ended * marks * clean * upto(n, 50.0))


def _targets(targets: DataFrame) -> DataFrame:
    """One row for each source; of several the smallest."""
    rows = targets.filter("source is not null").groupBy("source").agg(F.min(F.struct("target_weight", "max_repeats")).alias("t"))
    return rows.select("source", "t.target_weight", "t.max_repeats")


def sized_texts(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """source, doc_id, n_tokens, weight of the distinct texts of the targets' sources, a row each; the texts are read once.

    Equal texts are one text, of the smallest doc_id, so copies can't be used beyond max_repeats; equal texts of
    several sources belong to the source with the smallest max_repeats (then name). Empty and null texts have no size and are left out.
    """
    caps = broadcast_up_to(_targets(targets).select("source", "max_repeats"), MAX_SOURCES)
    own = spread(docs.select("doc_id", "source", "text").filter(F.length("text") > 0)).join(caps, "source")
    own = own.select("doc_id", "source", "max_repeats", F.sha2("text", 256).alias("digest"), token_count("text", path).alias("n_tokens"), quality(F.col("text")).alias("weight"))
    one = own.groupBy("digest").agg(F.min(F.struct("max_repeats", "source", "doc_id", "n_tokens", "weight")).alias("f"))
    return one.select("f.source", "f.doc_id", "f.n_tokens", "f.weight").filter("n_tokens > 0")


def sampling_key(seed: int) -> Column:
    """An exponential variate of rate weight: -ln(u) / weight, where u in (0, 1) is uniform by doc_id, source and seed; small keys come first."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / F.col("weight")


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """source, target_weight, max_repeats, available, budget, epochs, rest. Without total_tokens the mix is as large as the
    scarcest source allows; with it, a source gives at most what max_repeats allows."""
    available = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("texts"))
    t = _targets(targets).join(available, "source", "left").fillna(0, ["available", "texts"])
    most = F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    if total_tokens is None:
        total = F.min(F.when((F.col("target_weight") > 0) & (most > 0), F.floor(most / F.col("target_weight")))).over(Window.partitionBy(F.lit(0)))
    else:
        total = F.lit(total_tokens)
    t = t.withColumn("total", total).withColumn("budget", F.greatest(F.lit(0), F.coalesce(F.least(most, F.floor(F.col("total") * F.col("target_weight"))), F.lit(0))).cast("long"))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    return t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available")).drop("total")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, path: str = VOCABULARY, close_gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). selection: doc_id, source, n_tokens, times_used (1 or more). shares: source, target_weight, max_repeats,
    available, budget, epochs, used_tokens, used_texts, share (of all used tokens; 0 for a source without texts).

    Texts are taken in key order as long as their running sum fits, so a source's used tokens fall short of its budget by less than its largest
    text. close_gaps then adds the largest text that fits, which leaves the sampling's probabilities. A source that isn't in targets isn't used;
    a null source never is. A target without weight gets nothing.
    """
    sizes = stored(sized_texts(docs, targets, path), "sizes").withColumn("key", sampling_key(seed))
    plan = stored(budgets(sizes, targets, total_tokens), "budgets")
    keyed = sizes.withColumn("bucket", F.floor(F.log("key") / BUCKET_WIDTH).cast("long"))
    by_bucket = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    over = by_bucket.withColumn("upto", upto).join(broadcast_up_to(plan.select("source", "rest"), MAX_SOURCES), "source").filter("upto > rest")
    edges = over.groupBy("source").agg(F.min("bucket").alias("edge"), F.min(F.col("upto") - F.col("tokens")).alias("before"))
    # a bucket before the edge is taken whole, the edge in part
    ends = stored(plan.select("source", "epochs", "rest").join(edges, "source", "left"), "edges")
    marked = keyed.join(broadcast_up_to(ends, MAX_SOURCES), "source")
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inner = marked.filter(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("extra", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True)).cast("int"))
    edge = marked.filter(F.col("bucket") == F.col("edge")).withColumn("extra", (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("int"))
    both = inner.unionByName(edge).select("doc_id", "source", "n_tokens", "key", "epochs", "rest", "extra")
    if close_gaps:
        both = _closed(stored(both, "drawn"))
    selection = both.withColumn("times_used", F.col("epochs") + F.col("extra")).filter("times_used > 0").select("doc_id", "source", "n_tokens", "times_used")
    selection = stored(selection, "mix")
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("used_tokens"), F.sum("times_used").alias("used_texts"))
    shares = plan.drop("texts", "rest").join(used, "source", "left").fillna(0, ["used_tokens", "used_texts"])
    everything = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    return selection, shares.withColumn("share", F.when(everything > 0, F.col("used_tokens") / everything).otherwise(0.0))


def _closed(drawn: DataFrame) -> DataFrame:
    """drawn with the largest text that fits what each source's running sum leaves."""
    gaps = drawn.groupBy("source").agg((F.first("rest") - F.sum(F.col("n_tokens") * F.col("extra"))).alias("gap"))
    fitting = drawn.filter("extra = 0").join(broadcast_up_to(stored(gaps, "gaps"), MAX_SOURCES), "source").filter("n_tokens <= gap")
    closing = fitting.groupBy("source").agg(F.max_by("doc_id", F.struct("n_tokens", -F.col("key"), "doc_id")).alias("closing"))
    both = drawn.join(broadcast_up_to(stored(closing, "closing"), MAX_SOURCES), "source", "left")
    return both.withColumn("extra", F.when(F.col("doc_id") == F.col("closing"), 1).otherwise(F.col("extra"))).drop("closing")
