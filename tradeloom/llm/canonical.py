"""Freely typed values mapped to the entries of a reference list.

Distinct typed values are read (decorations, codes and marks taken off), turned into sets of character tokens and joined
with the references' sets by prefix-filtered similarity. Candidates with more typing errors than the value's length allows are
checked out; of the others the one with the highest exact Jaccard is kept. Values without one are reported as NONE.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_up_to, or_null, stored, trimmed
from .similarity import BROADCAST_ROWS, similarity_join

NONE = "NONE"
#: A typing error of each kind in a short word leaves at least this much of its token set in common.
THRESHOLD = 0.4

# What sellers write around a brand or an origin.
BRAND_BEFORE = r"^\W*(?:brand\s*:|by\b|from\b|the\b|original\b)\s*"
BRAND_AFTER = r"[\s,.\-–(]*(?:\(?\s*(?:r|tm)\s*\)|[®™©]|\binc|\bgmbh|\bltd|\bllc|\bag|\bb\.\s?v|\bs\.\s?a|\bco\.?,?\s*ltd|\binternational|\beurope|\bshop|\bofficial store|\bauthorised dealer)[\s.)]*$"
ORIGIN_BEFORE = r"^\W*(?:made in|product of|origin\s*:|country of origin\s*:|from)\s+"
LOOKALIKE = {"0": "o", "1": "i", "5": "s", "3": "e"}

# Other names of the countries, by two-letter code; three-letter codes first.
COUNTRY_ALIASES = {
    "AR": "ARG|Argentine Republic", "AT": "AUT|Republic of Austria|Österreich|Oesterreich", "AU": "AUS|Commonwealth of Australia", "BD": "BGD|People's Republic of Bangladesh",
    "BE": "BEL|Kingdom of Belgium|België|Belgique|Belgien", "BG": "BGR|Republic of Bulgaria", "BR": "BRA|Brasil|Federative Republic of Brazil", "CA": "CAN",
    "CH": "CHE|Swiss Confederation|Schweiz|Suisse|Svizzera", "CL": "CHL|Republic of Chile", "CN": "CHN|P.R. China|PRC|People's Republic of China|Mainland China", "CO": "COL|Republic of Colombia",
    "CZ": "CZE|Czech Republic|Česko", "DE": "DEU|Deutschland|Federal Republic of Germany|Allemagne", "DK": "DNK|Danmark|Kingdom of Denmark", "EG": "EGY|Arab Republic of Egypt",
    "ES": "ESP|España|Kingdom of Spain|Spanien", "FI": "FIN|Suomi|Republic of Finland", "FR": "FRA|French Republic|République française|Frankreich", "GB": "GBR|UK|U.K.|Great Britain|Britain|England|United Kingdom of Great Britain and Northern Ireland",
    "GR": "GRC|Hellenic Republic|Hellas|Ellada", "HU": "HUN|Magyarország", "ID": "IDN|Republic of Indonesia", "IE": "IRL|Éire|Republic of Ireland", "IN": "IND|Republic of India|Bharat",
    "IT": "ITA|Italia|Italian Republic|Italien", "JP": "JPN|Nippon|Nihon", "KE": "KEN|Republic of Kenya", "KR": "KOR|Republic of Korea|Korea|Korea, Republic of", "MA": "MAR|Maroc|Kingdom of Morocco",
    "MX": "MEX|México|United Mexican States", "MY": "MYS", "NE": "NER|Republic of the Niger|Republic of Niger", "NG": "NGA|Federal Republic of Nigeria", "NL": "NLD|Holland|Nederland|The Netherlands|Kingdom of the Netherlands",
    "NO": "NOR|Norge|Kingdom of Norway", "PE": "PER|Republic of Peru|Perú", "PL": "POL|Polska|Republic of Poland|Polen", "PT": "PRT|Portuguese Republic", "RO": "ROU|România",
    "SE": "SWE|Sverige|Kingdom of Sweden", "SI": "SVN|Republic of Slovenia|Slovenija", "SK": "SVK|Slovak Republic|Slovensko", "TH": "THA|Kingdom of Thailand", "TR": "TUR|Turkey|Republic of Türkiye|Republic of Turkey",
    "US": "USA|U.S.|U.S.A.|United States of America|America", "VN": "VNM|Viet Nam|Socialist Republic of Vietnam|Socialist Republic of Viet Nam", "ZA": "ZAF|Republic of South Africa|RSA",
}


def letters(text: str, umlaut_e: bool = False) -> str:
    """Lower-case letters and digits only, accents and look-alike digits resolved; ö may be written oe."""
    text = text.lower().replace("ß", "ss")
    if umlaut_e:
        text = text.translate({ord("ä"): "ae", ord("ö"): "oe", ord("ü"): "ue"})
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if c.isalnum())
    if re.search("[a-z]", text):
        text = "".join(LOOKALIKE.get(c, c) for c in text)
    return text.replace("ı", "i")


def tokens(reading: str) -> list[str]:
    """The reading's letters and letter pairs, numbered where they repeat. One or two letters are one token: codes match whole."""
    if len(reading) <= 2:
        return [f"={reading}"] if reading else []
    seen: dict[str, int] = {}
    out = []
    for t in [*reading, *(a + b for a, b in zip("^" + reading, reading + "$", strict=True))]:
        seen[t] = seen.get(t, 0) + 1
        out.append(f"{t}{seen[t]}")
    return out


def brand_readings(value: str) -> list[str]:
    text = value.strip()
    for _ in range(3):
        text = re.sub(BRAND_AFTER, "", re.sub(BRAND_BEFORE, "", text, flags=re.I), flags=re.I)
    return [letters(text), letters(text, True), letters(value)]


def origin_readings(value: str) -> list[str]:
    """The value, without what stands before it, and what is left of it beside a two-letter code."""
    text = re.sub(ORIGIN_BEFORE, "", value.strip(), flags=re.I)
    out = [letters(text), letters(text, True), letters(value)]
    if m := re.match(r"^\W*([A-Za-z]{2})\s*(?:[/,(]|-\s|\s-)\W*(\w.*)$", text):
        out.append(letters(m[2]))
    if m := re.match(r"^(.*\w)\s*(?:[/,(]|-\s|\s-)\W*([A-Za-z]{2})\W*$", text):
        out.append(letters(m[1]))
    return out


def brand_names(ref_id: str, name: str) -> list[str]:
    """How a name may be read: as it is, with its words turned round, with its last word as an initial."""
    words = name.split()
    turned = [" ".join([*words[k:], *words[:k]]) for k in range(len(words))] if len(words) > 1 else [name]
    short = [" ".join([*words[:-1], words[-1][0]])] if len(words) > 1 else []
    return [letters(x, e) for x in (*turned, *short) for e in (False, True)]


def origin_names(ref_id: str, name: str) -> list[str]:
    return [letters(x, e) for x in (ref_id, name, *COUNTRY_ALIASES.get(ref_id, "").split("|")) if x for e in (False, True)]


def errors_allowed(reading: Column, name: Column) -> Column:
    """Typing errors by the shorter one's letters. Codes of up to three letters allow none, but three letters may be a name of four."""
    a, b = F.length(reading), F.length(name)
    shorter = F.least(a, b)
    return F.when((a == 3) & (b == 4), 1).when(shorter <= 3, 0).when(shorter <= 6, 1).otherwise(2)


def errors(a: str, b: str) -> int:
    """Letters put in, left out, replaced, or swapped with the next."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(T.IntegerType())
def _errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([errors(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for readings in batches:
        yield pd.Series([tokens(r) for r in readings])


def _readings(read: Callable[[str], list[str]]) -> Callable:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([[r for r in dict.fromkeys(read(v)) if r] for v in values])

    return run


def _names(read: Callable[[str, str], list[str]]) -> Callable:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, names in batches:
            yield pd.Series([[r for r in dict.fromkeys(read(i, n)) if r] for i, n in zip(ids, names, strict=True)])

    return run


def canonical(values: DataFrame, refs: DataFrame, read: Callable[[str], list[str]], names: Callable[[str, str], list[str]]) -> DataFrame:
    """value, ref_id for each distinct value of the column `value`: the entry of refs (ref_id, name) it stands for, or NONE. Null values
    have no row, blank ones are NONE. Of entries with the same Jaccard the one with fewer typing errors, then the same first letter, then the smaller ref_id, is kept."""
    v = stored(values.select("value").dropna().distinct(), "typed").withColumn("reading", F.explode_outer(_readings(read)("value")))
    typed = stored(v, "readings")
    known = refs.select(F.col("ref_id").cast("string"), "name").dropna().select("ref_id", F.explode(_names(names)("ref_id", "name")).alias("name")).distinct()
    known = stored(known, "names")
    left = typed.select(F.col("reading").alias("id")).dropna().distinct().withColumn("tokens", _tokens("id"))
    right = known.select(F.col("name").alias("id")).distinct().withColumn("tokens", _tokens("id"))
    near = similarity_join(left, right, THRESHOLD).filter(F.levenshtein("left_id", "right_id", 4) >= 0)
    near = near.withColumn("errors", _errors("left_id", "right_id"))
    near = near.filter(F.col("errors") <= errors_allowed(F.col("left_id"), F.col("right_id")))
    hits = near.join(broadcast_up_to(known, BROADCAST_ROWS), F.col("right_id") == F.col("name"))
    other = F.substring("left_id", 1, 1) != F.substring("right_id", 1, 1)
    best = typed.join(hits, F.col("reading") == F.col("left_id")).groupBy("value").agg(F.min_by("ref_id", F.struct(-F.col("jaccard"), "errors", other, "ref_id")).alias("ref_id"))
    return v.select("value").distinct().join(best, "value", "left").select("value", F.coalesce("ref_id", F.lit(NONE)).alias("ref_id"))


def map_fields(products: DataFrame, brand_refs: DataFrame, country_refs: DataFrame) -> DataFrame:
    """product_id, field, ref_id for each brand and origin that is neither blank nor exactly a name (or, of a country, a code)."""
    out = None
    for field, refs, read, names, exact in (("brand", brand_refs, brand_readings, brand_names, ["name"]), ("origin_country", country_refs, origin_readings, origin_names, ["ref_id", "name"])):
        listed = broadcast_up_to(stored(refs.select(F.explode(F.array(*exact)).alias("value")).dropna().distinct(), "listed"), BROADCAST_ROWS)
        typed = products.select(F.col("id").alias("product_id"), F.col(field).alias("value")).filter(or_null(trimmed(F.col(field))).isNotNull()).join(listed, "value", "left_anti")
        found = broadcast_up_to(stored(canonical(typed, refs, read, names), "canonical"), BROADCAST_ROWS)
        rows = typed.join(found, "value").select("product_id", F.lit(field).alias("field"), "ref_id")
        out = rows if out is None else out.unionByName(rows)
    return out
