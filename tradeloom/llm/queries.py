"""Queries of the problems tagged llm (3, 4, 7, 8, 9) and their SQL, where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from .canonical import map_fields
from .listings import current_attributes, pairs, same_article
from .mixing import mix
from .packing import pack
from .splitting import split_documents

CONTAINER, PIECE, OVERLAP = 2048, 512, 64


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return stored(same_article(table(spark, d, "products"), table(spark, d, "product_versions"), table(spark, d, "brand_refs")), "articles")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs(_articles(spark, d))


def p3_articles(spark: SparkSession, d: str) -> DataFrame:
    """Each listing with its article and the number of its listings."""
    a = _articles(spark, d)
    return a.join(a.groupBy("article").agg(F.count("*").alias("listings")), "article").select("product_id", "article", "listings")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return map_fields(table(spark, d, "products"), table(spark, d, "brand_refs"), table(spark, d, "country_refs"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), CONTAINER)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the fewest that could hold all tokens, and the share of room left unused."""
    c = p7_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("docs"))
    n, tokens = F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))
    return c.agg(n.alias("containers"), F.ceil(tokens / CONTAINER).alias("fewest"), F.max("tokens").alias("largest"), (1 - tokens / (n * CONTAINER)).alias("unused_share"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(table(spark, d, "documents"), PIECE, OVERLAP, with_text=False)
    return pieces.filter("piece_no = 0 and cut <> 'whole'").select("doc_id", "cut")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each document, without their text: number, tokens, shared tokens, characters."""
    return split_documents(table(spark, d, "documents"), PIECE, OVERLAP, with_text=False).drop("text")


# --- what SQL can say of the results: each query counts, beside its SQL, what must hold over whole tables


def _counts(df: DataFrame, **counts: Column) -> DataFrame:
    """One row for each count: rule, n."""
    one = df.agg(*[c.alias(k) for k, c in counts.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in counts]), F.array(*[F.coalesce(F.col(k), F.lit(0)).cast("long") for k in counts]))).alias("rule", "n"))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Listings printed alike (same title, brand and current attributes) are of one article, or all of none; a listing has one article."""
    a = _articles(spark, d)
    p, v = table(spark, d, "products"), table(spark, d, "product_versions")
    told = current_attributes(p, v).select("product_id", F.xxhash64("canonical_name", "brand", "description", "attributes").alias("told")).join(a, "product_id", "left")
    alike = told.groupBy("told").agg(F.count("*").alias("listings"), F.count("article").alias("with_article"), F.count_distinct("article").alias("articles"))
    once = a.groupBy("product_id").agg(F.count("*").alias("k"))
    half = F.count_if((F.col("with_article") > 0) & (F.col("with_article") < F.col("listings")))
    return _counts(alike, products=F.sum("listings"), listings_alike_told_apart=F.count_if(F.col("articles") > 1), listings_alike_half_told=half).unionByName(_counts(once, listings_in_two_articles=F.count_if(F.col("k") > 1)))


def p4_plain(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p4_found whose value has the same ASCII letters and digits as one entry's name, which then is the entry."""
    refs = {"brand": table(spark, d, "brand_refs"), "origin_country": table(spark, d, "country_refs")}
    plain = lambda c: F.lower(F.regexp_replace(c, "[ .,_-]", ""))
    typed = table(spark, d, "products")
    out = None
    for field, ref in refs.items():
        names = ref.select(plain("name").alias("plain"), F.lit(field).alias("field")).distinct()
        rows = typed.select(F.col("id").alias("product_id"), plain(field).alias("plain")).join(names, "plain").select("product_id", "field")
        out = rows if out is None else out.unionByName(rows)
    return p4_found(spark, d).join(out, ["product_id", "field"])


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every text packed once and whole: documents, containers over the capacity, texts that fit a container but were split, gaps between the parts of a text."""
    c = stored(p7_containers(spark, d), "containers")
    by_doc = c.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("until"))
    by_container = c.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    split = F.count_if((F.col("parts") > 1) & (F.col("tokens") <= CONTAINER))
    docs = _counts(by_doc, documents=F.count("*"), small_texts_split=split, texts_with_gaps=F.count_if(F.col("tokens") != F.col("until")))
    return docs.unionByName(_counts(by_container, containers_over_capacity=F.count_if(F.col("tokens") > CONTAINER)))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Sources reported, of which over their budget or off their target by more than a text, texts used too often, used copies of one text."""
    selection, shares = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    docs = table(spark, d, "documents")
    longest = docs.groupBy("source").agg(F.max(F.octet_length("text")).alias("longest"))  # a text has at most a token for each byte
    s = shares.join(longest, "source", "left").withColumn("short", F.col("budget") - F.col("used_tokens"))
    used = selection.join(table(spark, d, "mix_targets").select("source", "max_repeats"), "source")
    texts = used.join(docs.select("doc_id", "source", F.sha2("text", 256).alias("digest")), ["doc_id", "source"])
    texts = texts.groupBy("digest").agg(F.max(F.col("times_used") - F.col("max_repeats")).alias("beyond"), F.count("*").alias("copies"))
    sources = _counts(s, sources=F.count("*"), sources_over_budget=F.count_if(F.col("short") < 0), sources_far_under_budget=F.count_if(F.col("short") > F.coalesce("longest", F.lit(0))))
    return sources.unionByName(_counts(texts, texts_used_too_often=F.count_if(F.col("beyond") > 0), texts_used_as_copies=F.count_if(F.col("copies") > 1)))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with pieces and their characters, pieces over the limit, pieces that leave characters out, overlaps of less than OVERLAP tokens."""
    p = p9_pieces(spark, d).withColumn("until", F.col("first_char") + F.col("n_chars"))
    by_doc = p.groupBy("doc_id").agg(
        F.max("until").alias("until"), F.count_if(F.col("n_tokens") > PIECE).alias("over"), F.count_if((F.col("piece_no") > 0) & ~F.col("shared_tokens").between(OVERLAP, OVERLAP + 3)).alias("overlap"), F.array_sort(F.collect_list(F.struct("piece_no", "first_char", "until"))).alias("ps")
    )
    gaps = F.size(F.filter(F.arrays_zip(F.slice("ps", F.lit(1), F.size("ps") - 1).alias("a"), F.slice("ps", F.lit(2), F.greatest(F.size("ps") - 1, F.lit(0))).alias("b")), lambda x: x["b"]["first_char"] > x["a"]["until"]))
    by_doc = by_doc.withColumn("gaps", F.when(F.size("ps") > 1, gaps).otherwise(0) + (F.col("ps")[0]["first_char"] > 0).cast("int"))
    return _counts(by_doc, documents=F.count("*"), characters=F.sum("until"), pieces_over_limit=F.sum("over"), gaps=F.sum("gaps"), overlaps_off=F.sum("overlap"))


QUERIES = {f.__name__: f for f in (p3_found, p3_articles, p3_checks, p4_found, p4_plain, p7_containers, p7_fill, p7_checks, p8_mix, p8_shares, p8_checks, p9_found, p9_pieces, p9_checks)}


def _rules(**counts: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST(({v}) AS BIGINT))" for k, v in counts.items()) + ") t(rule, n)"


_PLAIN = "lower(regexp_replace({0}, '[ .,_-]', '', 'g'))"
#: p3_found, p3_articles, p4_found, p7_containers, p7_fill, p8_mix, p8_shares and p9_pieces can't be said in SQL; the checks and tests/llm cover them.
ORACLE: dict[str, str] = {
    "p3_checks": _rules(products="SELECT count(*) FROM products WHERE id IS NOT NULL", listings_alike_told_apart="0", listings_alike_half_told="0", listings_in_two_articles="0"),
    "p4_plain": " UNION ALL ".join(
        f"""SELECT p.id AS product_id, '{field}' AS field, r.ref_id FROM products p JOIN {refs} r ON {_PLAIN.format('p.' + field)} = {_PLAIN.format('r.name')}
WHERE trim(p.{field}) <> '' AND p.{field} NOT IN (SELECT name FROM {refs}{codes})"""
        for field, refs, codes in (("brand", "brand_refs", ""), ("origin_country", "country_refs", " UNION ALL SELECT ref_id FROM country_refs"))
    ),
    "p7_checks": _rules(documents="SELECT count(DISTINCT doc_id) FROM documents", containers_over_capacity="0", small_texts_split="0", texts_with_gaps="0"),
    "p8_checks": _rules(sources="SELECT count(DISTINCT source) FROM mix_targets", sources_over_budget="0", sources_far_under_budget="0", texts_used_too_often="0", texts_used_as_copies="0"),
    # no size is close to the limit: texts of up to 512 tokens have fewer than 1,300 bytes, larger ones more than 2,000; stretches are of under 30 letters or of thousands
    "p9_found": r"""SELECT doc_id, CASE WHEN list_max([length(x) FOR x IN regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+')]) > 1000 THEN 'forced' ELSE 'boundary' END AS cut FROM documents WHERE octet_length(encode(text)) > 1600""",
    "p9_checks": _rules(documents="SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL", characters="SELECT sum(length(text)) FROM documents", pieces_over_limit="0", gaps="0", overlaps_off="0"),
}
