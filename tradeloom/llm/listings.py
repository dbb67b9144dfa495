"""Listings of the same article, by a reference dictionary of brand-model phrases.

Listings whose brand is known are trusted: the shapes of model codes, the codes, and the series words that go with one brand are
mined from them. Aho-Corasick automata of a brand's phrases then find them in the text of every listing of the brand, codes with
look-alike characters and separators folded; the longest consistent match names the model, and the remaining attributes (edition, colour,
sizes, pieces, accessory) decide which variant a listing offers.
"""

from __future__ import annotations

import functools
import html
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_up_to, stored
from .canonical import NONE, brand_names, brand_readings, canonical, errors, letters

# Colours and how sellers write them.
COLOURS = {
    "black": "black blk schwarz noir", "white": "white wht weiss weiß blanc", "red": "red rot rouge", "blue": "blue blu blau bleu", "green": "green grn grün gruen vert", "yellow": "yellow yel gelb jaune",
    "brown": "brown brn braun marron", "grey": "grey gray gry grau gris", "orange": "orange org", "violet": "violet purple prp lila",
}
# Units by dimension, as factors of ml, mm, g and W.
UNITS = {
    "volume": {"ml": 1, "cl": 10, "l": 1000, "ltr": 1000, "liter": 1000, "liters": 1000, "litre": 1000, "litres": 1000, "floz": 29.5735},
    "length": {"mm": 1, "cm": 10, "m": 1000, "mtr": 1000, "meter": 1000, "metre": 1000, "metres": 1000, "in": 25.4, "inch": 25.4, '"': 25.4, "ft": 304.8},
    "weight": {"g": 1, "gr": 1, "gram": 1, "grams": 1, "kg": 1000, "kilo": 1000, "lb": 453.592, "lbs": 453.592},
    "power": {"w": 1, "watt": 1, "watts": 1, "kw": 1000},
}
OUNCE = {"volume": 29.5735, "weight": 28.3495}
# Words that tell goods sold by weight, accessories, editions, attributes that count pieces, stand-ins for a brand.
BY_WEIGHT = re.compile(r"coffee|kaffee|café|dumbbell|weight|hantel|haltère", re.I)
ACCESSORY = re.compile(r"\b(carry case|replacement lid|spare handle|care kit|wall bracket)\b", re.I)
EDITION = re.compile(r"(?<![^\W_])(plus|pro|xl|ii)(?![^\W_])", re.I)
PIECES = {"units", "quantity", "pieces", "pack_size", "stück"}
NO_BRAND = {"", "none", "nobrand", "unknown", "whitelabel", "oem", "na", "unbranded", "generic", "various"}
PACK = re.compile(r"\b(?:pack|set) of (\d{1,4})\b|\b(\d{1,4})[ -]?(?:pack|pcs|pieces|pièces|stück|stk)\b|(?<![^\s,|(])(\d{1,3})x(?![^\s,|)])|(?<![^\s,|(])x(\d{1,3})(?![^\s,|)])", re.I)
ASIDE = re.compile(r"(?:also available in|auch in anderen farben|existe aussi)[^.<|]*|\b20\d\d model\b", re.I)
FACTS = re.compile(r"(?:specification|daten|fiche)\s*:(.*?)(?=[.!?]\s+(?-i:[A-ZÄÖÜÉÈ])|[|]|$)", re.I)
_UNIT = "|".join(sorted((re.escape(u) for d in UNITS.values() for u in d if u != "floz"), key=len, reverse=True))
SIZE = re.compile(rf"(?<![\w.,])(\d+(?:[.,]\d+)?)\s*(?:(fl\.?\s*oz|oz)|({_UNIT}))(?![^\W\d_])", re.I)
_TO_LETTERS, _TO_DIGITS = str.maketrans("0125689", "OIZSGBG"), str.maketrans("OSBIGZ", "058162")
#: How texts are folded for the search of codes: look-alikes as one, separators left out.
_FOLD = str.maketrans("oiszbg", "015286", " -._")
_NO_UNIT = rf"(?!\s*(?:{_UNIT}|OZ|FL\.? ?OZ)(?![A-Z]))"
_COLOUR = {w: c for c, ws in COLOURS.items() for w in ws.split()}
_WORD = re.compile(r"[^\W\d_]{5,}")

FEATURES = "product_id string, typed string, text string, given string, title string, words array<string>, codes array<string>, edition string, colour string, sizes map<string,double>, pack int, accessory string"


def clean(text: str | None) -> str:
    """Composed, without tags, entities and invisible characters."""
    text = re.sub(r"</?[A-Za-z][^<>]*>", " ", html.unescape(unicodedata.normalize("NFKC", text or "")))
    return " ".join(re.sub("[\u200b-\u200f\u2060\ufeff]", "", text).split())


#: A shape (number of letters, number of digits) is a model code's if so large a share of all that looks like a code in trusted listings has it.
SHAPE_SHARE = 0.2


def mined_shapes(products: DataFrame) -> list[tuple[int, int]]:
    """The shapes of model codes, mined from the plainly printed codes of listings with a brand; at most 35 rows reach the driver."""
    text = F.upper(F.concat_ws(" . ", "canonical_name", "description"))
    plain = F.regexp_extract_all(text, F.lit(r"(?<![A-Z0-9])([A-Z]{2,6}[-._ ]?[0-9]{2,8})(?![A-Z0-9])"), F.lit(1))
    codes = products.filter(F.length(F.trim("brand")) > 0).select(F.explode(plain).alias("code"))
    shape = [F.length(F.regexp_extract("code", "^[A-Z]+", 0)).alias("letters"), F.length(F.regexp_extract("code", "[0-9]+$", 0)).alias("digits")]
    counts = [tuple(r) for r in codes.groupBy(*shape).agg(F.count("*").alias("n")).collect()]
    return sorted((a, b) for a, b, n in counts if n >= SHAPE_SHARE * sum(c[2] for c in counts))


@functools.cache
def shape_pattern(letters: int, digits: int) -> re.Pattern:
    """Any code of a shape."""
    half = digits // 2
    return re.compile(rf"(?<![A-Z0-9])([A-Z0-9]{{{letters}}})[ \-._]?0?([0-9OSBIGZ]{{{half}}} ?[0-9OSBIGZ]{{{digits - half}}})(?![A-Z0-9]){_NO_UNIT}", re.I)


def _is_code(m: re.Match, text: str) -> bool:
    """Letters and digits are not all look-alikes, and the letters are no colour before a number."""
    return bool(re.search("[A-Z]", m[1], re.I) and re.search("[0-9]", m[2])) and not (m[1].lower() in _COLOUR and text[m.end(1)] not in "-._")


def codes_of(text: str, shapes: Sequence[tuple[int, int]]) -> list[str]:
    """The codes of these shapes that a text holds, look-alikes resolved."""
    found = [(m.start(), m[1].upper().translate(_TO_LETTERS) + m[2].replace(" ", "").upper().translate(_TO_DIGITS)) for s in shapes for m in shape_pattern(*s).finditer(text) if _is_code(m, text)]
    return [c for _, c in sorted(found)]


def shape_of(code: str) -> tuple[int, int]:
    n = len(code.rstrip("0123456789"))
    return n, len(code) - n


def colour_of(text: str) -> str | None:
    return next((_COLOUR[w] for w in re.findall(r"[^\W\d_]+", text.lower()) if w in _COLOUR), None)


def sizes_of(text: str, by_weight: bool) -> dict[str, float]:
    out: dict[str, float] = {}
    for number, ounce, unit in SIZE.findall(text):
        n = float(number.replace(",", "."))
        if ounce:
            dimension = "weight" if by_weight and not ounce.lower().startswith("fl") else "volume"
            factor = OUNCE[dimension]
        else:
            dimension, factor = next((d, u[unit.lower()]) for d, u in UNITS.items() if unit.lower() in u)
        if n > 0:
            out.setdefault(dimension, n * factor)
    return out


def pack_of(text: str) -> int | None:
    m = PACK.search(text)
    return int(next(g for g in m.groups() if g)) if m else None


def features(product_id: str, title: str | None, brand: str | None, description: str | None, attributes: str | None, shapes: Sequence[tuple[int, int]]) -> tuple:
    """What a listing tells. Of title, facts in the description and attributes the first that tells something counts."""
    title, description = ASIDE.sub(" ", clean(title)), ASIDE.sub(" ", clean(description))
    try:
        given = json.loads(attributes) if attributes else {}
    except ValueError:
        given = {}
    given = {clean(str(k)).lower(): clean(str(v)) for k, v in given.items() if v is not None} if isinstance(given, dict) else {}
    facts = " ".join(FACTS.findall(description))
    by_weight = bool(BY_WEIGHT.search(f"{title} {description}"))
    told = codes_of(f"{title} . {description}", shapes)
    codes = list(dict.fromkeys([*told, *(c for v in given.values() for c in codes_of(v, shapes))]))
    edition = EDITION.search(title) or EDITION.search(" ".join(s for s in re.split(r"[.!]\s", description) if s[:1].isupper() or codes_of(s, shapes)))
    colour = colour_of(title) or colour_of(facts) or next((c for v in given.values() if len(v.split()) <= 3 and (c := colour_of(v))), None)
    sizes = sizes_of(title, by_weight)
    for text in (facts, *given.values()):
        for d, n in sizes_of(text, by_weight).items():
            sizes.setdefault(d, n)
    pack = pack_of(title) or next((int(v) for k, v in given.items() if k in PIECES and v.isdecimal() and 0 < int(v) < 10_000), None) or 1
    accessory = ACCESSORY.search(title)
    words = list(dict.fromkeys(w.lower() for w in _WORD.findall(f"{title} {description}") if w.lower() not in _COLOUR))
    return (product_id, (brand or "").strip() or None, f"{title} . {description}".lower(), " | ".join(given.values()).lower(), title.lower(), words, codes, edition[1].lower() if edition else "" if told else None, colour, sizes, pack, accessory[1].lower() if accessory else "")


def current_attributes(products: DataFrame, versions: DataFrame) -> DataFrame:
    """product_id, canonical_name, brand, description, attributes: those of the version current_version_id names, else of the highest number."""
    # one partitioning serves the join, the aggregate and the reading of texts after it; a set number keeps the latter parallel
    spark = products.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = versions.select(F.col("id").alias("v_id"), F.col("product_id").alias("v_product"), "version_number", "attributes").repartition(n, "v_product")
    p = products.select("id", "canonical_name", "brand", "description", "current_version_id").filter("id is not null").repartition(n, "id")
    named = F.coalesce(F.col("v_id") == F.col("current_version_id"), F.lit(False))
    joined = p.join(v, F.col("id") == F.col("v_product"), "left").groupBy("id")
    first = [F.first(c).alias(c) for c in ("canonical_name", "brand", "description")]
    return joined.agg(*first, F.max_by("attributes", F.struct(named, "version_number")).alias("attributes")).withColumnRenamed("id", "product_id")


def listing_features(products: DataFrame, versions: DataFrame) -> DataFrame:
    columns, shapes = [c.split()[0] for c in FEATURES.split(", ")], mined_shapes(products)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([features(*r, shapes) for r in pdf.itertuples(index=False, name=None)], columns=columns)

    rows = current_attributes(products, versions).select("product_id", "canonical_name", "brand", "description", "attributes")
    return rows.mapInPandas(run, FEATURES)


def with_brand(listings: DataFrame, brand_refs: DataFrame) -> DataFrame:
    """listings with `brand`: the reference the typed value stands for, an unlisted name as typed (letters only), or null."""
    typed = listings.select(F.col("typed").alias("value"))
    known = canonical(typed, brand_refs, brand_readings, brand_names)

    @F.pandas_udf(T.StringType())
    def unlisted(values: pd.Series) -> pd.Series:
        return values.map(lambda v: r if (r := brand_readings(v)[0]) not in NO_BRAND else None)

    key = F.when(F.col("ref_id") != NONE, F.concat(F.lit("ref:"), "ref_id")).otherwise(F.concat(F.lit("own:"), unlisted("value")))
    known = broadcast_up_to(stored(known.select(F.col("value").alias("typed"), key.alias("brand")), "listing-brands"), 50_000)
    return listings.join(known, "typed", "left")


#: A series word is met in so many listings, and so large a share of those whose brand is known are of one brand.
MIN_LISTINGS, MIN_SHARE = 2, 0.8
#: A word is common if no brand has more than such a share of its trusted listings. A word one typing error from a common one that is so many
#: times as frequent is a slip of it, no series word.
COMMON_SHARE, COMMON_TIMES = 0.5, 10


def mined_phrases(listings: DataFrame) -> DataFrame:
    """brand, phrase, n: model codes and series words of each brand, with the number of trusted listings."""
    codes = listings.filter("brand is not null").select("brand", F.explode("codes").alias("phrase")).groupBy("brand", "phrase").agg(F.count("*").alias("n"))
    by = listings.select("brand", F.explode("words").alias("phrase")).groupBy("phrase", "brand").agg(F.count("*").alias("n"))
    by = stored(by, "words")
    known = F.when(F.col("brand").isNotNull(), F.col("n"))
    total = by.groupBy("phrase").agg(F.sum("n").alias("all"), F.sum(known).alias("trusted"), F.max(known).alias("most"))
    words = by.filter("brand is not null").join(total, "phrase").filter((F.col("all") >= MIN_LISTINGS) & (F.col("n") >= MIN_SHARE * F.col("trusted")))
    common = total.filter((F.col("all") >= COMMON_TIMES * MIN_LISTINGS) & (F.col("most") <= COMMON_SHARE * F.col("trusted"))).select(F.col("phrase").alias("common"), F.col("all").alias("frequency"))
    shorter = F.array_distinct(F.concat(F.array("common"), F.transform(F.sequence(F.lit(1), F.length("common")), lambda k: F.concat(F.substring("common", F.lit(1), k - 1), F.substring("common", k + 1, F.length("common"))))))
    near = common.select(F.explode(shorter).alias("key"), "frequency").groupBy("key").agg(F.max("frequency").alias("frequency"))
    own = F.array_distinct(F.concat(F.array("phrase"), F.transform(F.sequence(F.lit(1), F.length("phrase")), lambda k: F.concat(F.substring("phrase", F.lit(1), k - 1), F.substring("phrase", k + 1, F.length("phrase"))))))
    keys = words.select("brand", "phrase", "all", F.explode(own).alias("key"))
    typing = keys.join(broadcast_up_to(stored(near, "common-words"), 50_000), "key").filter(F.col("frequency") >= COMMON_TIMES * F.col("all")).select("brand", "phrase").distinct()
    words = words.select("brand", "phrase", "n").join(typing, ["brand", "phrase"], "left_anti")
    return codes.unionByName(words)


def routed(listings: DataFrame, phrases: DataFrame) -> DataFrame:
    """listings with the brand whose phrases they are to be searched for: their own, or, without one, the only brand of a phrase they hold."""
    sole = phrases.groupBy("phrase").agg(F.min("brand").alias("sole"), F.count_distinct("brand").alias("k"), F.sum("n").alias("n")).filter("k = 1")
    lost = listings.filter("brand is null").select("product_id", F.explode(F.concat("codes", "words")).alias("phrase"))
    guess = lost.join(sole, "phrase").groupBy("product_id").agg(F.max_by("sole", F.struct(F.length("phrase"), "n", "phrase")).alias("guess"))
    return listings.join(guess, "product_id", "left").withColumn("brand", F.coalesce("brand", "guess")).drop("guess")


class Phrases:
    """The automata of one brand's phrases: codes over folded text, series words over plain text. Series words that are a typing error of a
    commoner one stand for it; words within two errors of a word of the brand's names are none."""

    def __init__(self, counted: Iterable[tuple[str, int]], brand_words: set[str]) -> None:
        self.codes, self.words, self.meant = ahocorasick.Automaton(), ahocorasick.Automaton(), {}
        self.near: dict[str, list[str]] = {}
        self.rank: dict[str, int] = {}
        for rank, (phrase, _) in enumerate(sorted(counted, key=lambda x: (-x[1], x[0]))):
            self.rank[phrase] = rank
            if any(c.isdigit() for c in phrase):
                for folded in self.folded(phrase):
                    self.codes.add_word(folded, (*self.codes.get(folded, ()), phrase))
            elif not any(errors(phrase, w) <= 2 for w in brand_words):
                self.meant[phrase] = self.typing(phrase) or phrase
                self.words.add_word(phrase, phrase)
                if self.meant[phrase] == phrase:
                    for k in self.shorter(phrase):
                        self.near.setdefault(k, []).append(phrase)
        self.codes.make_automaton()
        self.words.make_automaton()

    @staticmethod
    def folded(code: str) -> set[str]:
        """The forms a code may have in folded text: with a nought in between or not, a G as 6 or 9."""
        n, _ = shape_of(code)
        letters = ("".join(x) for x in itertools.product(*["69" if c == "G" else c.lower().translate(_FOLD) for c in code[:n]]))
        return {a + between + code[n:].lower().translate(_FOLD) for a in letters for between in ("", "0")}

    @staticmethod
    def shorter(word: str) -> set[str]:
        return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}

    def typing(self, word: str) -> str | None:
        """The kept word that is at most one typing error away; of several one with the same first letter, then the commonest."""
        found = dict.fromkeys(w for k in sorted(self.shorter(word)) for w in self.near.get(k, ()) if errors(w, word) <= 1)
        return min(found, key=lambda w: (w != word, w[0] != word[0], self.rank[w]), default=None)

    def code_in(self, text: str) -> str | None:
        """The longest known code in the text, the first of several. What the automaton finds in the folded text is checked for how it is printed."""
        if not len(self.codes) or not (found := {c for _, held in self.codes.iter(text.translate(_FOLD)) for c in held}):
            return None
        return max((c for c in codes_of(text, list({shape_of(c) for c in found})) if c in found), key=len, default=None)

    def find(self, text: str, given: str, words: Iterable[str]) -> str | None:
        """The code in the text, else in the attributes; else the longest series word that stands in the text; failing that, a word one typing error away."""
        if code := self.code_in(text) or self.code_in(given):
            return code
        hits = []
        if len(self.words):
            for end, phrase in self.words.iter(text):
                start = end - len(phrase) + 1
                if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                    hits.append((len(phrase), -start, phrase))
        if hits:
            return self.meant[max(hits)[2]]
        return next((w for x in words if (w := self.typing(x))), None)


#: Listings of a brand that one task searches; a larger brand is split.
LISTINGS_A_TASK = 20_000
#: A word is one of a brand's names if so large a share of the brand's listings is typed with it.
BRAND_WORD_SHARE = 0.01
ASSIGNED = "product_id string, brand string, model string, told boolean"


def brand_words(listings: DataFrame) -> DataFrame:
    """brand, word: the words of the names a brand's listings are typed with, from all its listings."""
    typed = listings.select("brand", "typed").dropna()
    total = typed.groupBy("brand").agg(F.count("*").alias("of"))
    words = typed.select("brand", F.explode(F.array_distinct(F.split(F.lower("typed"), r"[\s\-]+"))).alias("word")).filter(F.length("word") > 3)
    counted = words.groupBy("brand", "word").agg(F.count("*").alias("n")).join(total, "brand")
    return counted.filter(F.col("n") >= BRAND_WORD_SHARE * F.col("of")).select("brand", "word")


def assign_models(listings: DataFrame, phrases: DataFrame, listings_a_task: int = LISTINGS_A_TASK) -> DataFrame:
    """product_id, brand, model, told: the model each listing names, and whether its title (not only an attribute) does. A brand's phrases and words
    are those of all its listings, so the result doesn't depend on how large brands are split."""
    sizes = listings.groupBy("brand").agg(F.ceil(F.count("*") / listings_a_task).cast("int").alias("parts")).filter("brand is not null")
    sizes = broadcast_up_to(stored(sizes, "brand-sizes"), 50_000)
    left = listings.select("product_id", "brand", "text", "given", "title", "words").join(sizes, "brand").withColumn("part", F.pmod(F.xxhash64("product_id"), F.col("parts").cast("long"))).drop("parts")
    # words of the brand's own names travel with its phrases, marked by a count of -1
    known = phrases.select("brand", "phrase", "n").unionByName(brand_words(listings).select("brand", F.col("word").alias("phrase"), F.lit(-1).cast("long").alias("n")))
    right = known.join(sizes, "brand").select("brand", "phrase", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))

    def search(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names = {letters(w) for w in found["phrase"][found["n"] < 0]}
        found = found[found["n"] >= 0]
        phrases = Phrases(list(zip(found["phrase"], found["n"], strict=True)), names)
        models = [phrases.find(t, g, w) for t, g, w in zip(own["text"], own["given"], own["words"], strict=True)]
        told = [bool(m) and (not any(c.isdigit() for c in m) or m in codes_of(t, [shape_of(m)])) for m, t in zip(models, own["title"], strict=True)]
        return pd.DataFrame({"product_id": own["product_id"].tolist(), "brand": own["brand"].tolist(), "model": models, "told": told}, dtype=object)

    return left.groupBy("brand", "part").cogroup(right.groupBy("brand", "part")).applyInPandas(search, ASSIGNED).filter("model is not null")


#: Sizes closer than this are one size: units are rounded when they are converted.
SAME_SIZE = 0.013
SIGNATURE = ["edition", "colour", "pack", "volume", "length", "weight", "power"]


def resolve(rows: list[tuple]) -> list[int | None]:
    """Variant number of each distinct signature of one model; None if it could be any of several.

    rows: (edition, colour, pack, volume, length, weight, power, n). The signatures that tell most come first; each joins the only
    variant it agrees with, the one that holds two thirds of the listings it agrees with, or founds its own if it agrees with none.
    """
    table = [list(r) for r in rows]
    for d in range(3, 7):  # sizes become the first of their cluster
        values = sorted({r[d] for r in table if r[d] is not None})
        of, base = {}, None
        for v in values:
            if base is None or v > base * (1 + SAME_SIZE):
                base = v
            of[v] = base
        for r in table:
            r[d] = of.get(r[d])
    varying = [d for d in range(7) if len({r[d] for r in table if r[d] is not None}) > 1]
    order = sorted(range(len(table)), key=lambda k: (-sum(table[k][d] is not None for d in varying), -table[k][7], tuple(str(x) for x in table[k])))
    variants: list[list] = []
    support: list[int] = []
    out: list[int | None] = [None] * len(table)
    for k in order:
        own = [table[k][d] for d in varying]
        fits = [v for v, known in enumerate(variants) if all(a is None or b is None or a == b for a, b in zip(own, known, strict=True))]
        if not fits:
            variants.append(own)
            support.append(table[k][7])
            out[k] = len(variants) - 1
            continue
        best = max(fits, key=lambda v: (support[v], -v))
        if len(fits) == 1 or support[best] * 3 >= 2 * sum(support[v] for v in fits):
            out[k] = best
            support[best] += table[k][7]
    return out


def same_article(products: DataFrame, versions: DataFrame, brand_refs: DataFrame) -> DataFrame:
    """product_id, article: listings with the same article offer the same. Listings whose model isn't told, or whose variant stays
    open, have no row. Null ids are left out; null titles, brands, descriptions, attributes tell nothing."""
    listings = stored(with_brand(stored(listing_features(products, versions), "features"), brand_refs), "branded")
    phrases = stored(mined_phrases(listings), "phrases")
    listings = stored(routed(listings, phrases), "routed")
    models = stored(assign_models(listings, phrases), "models")
    told = listings.select("product_id", "accessory", "edition", "colour", "pack", *[F.col("sizes")[d].alias(d) for d in UNITS])
    rows = models.join(told, "product_id").withColumn("edition", F.when(F.col("told") | (F.col("edition") != ""), F.coalesce("edition", F.lit(""))))
    rows = stored(rows, "told")
    family = ["brand", "model", "accessory"]
    distinct = rows.groupBy(*family, *SIGNATURE).agg(F.count("*").alias("n"))

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [resolve([tuple(s[c] for c in (*SIGNATURE, "n")) for s in signatures]) for signatures in pdf["signatures"]]
            yield pd.DataFrame([(*f, *(s[c] for c in SIGNATURE), v) for *f, signatures, vs in zip(*[pdf[c] for c in family], pdf["signatures"], found, strict=True) for s, v in zip(signatures, vs, strict=True)], columns=[*family, *SIGNATURE, "variant"]).astype({"variant": "Int64", "pack": "Int64"})

    schema = "brand string, model string, accessory string, edition string, colour string, pack int, volume double, length double, weight double, power double, variant long"
    # a family's distinct signatures are few, whatever the number of its listings
    held = distinct.groupBy(*family).agg(F.array_sort(F.collect_list(F.struct(*SIGNATURE, "n"))).alias("signatures"))
    solved = stored(held.mapInPandas(variants, schema).filter("variant is not null"), "variants")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*family, *SIGNATURE)]
    article = F.concat_ws("|", *[F.col(f"r.{c}") for c in family], F.col("s.variant").cast("string"))
    return rows.alias("r").join(solved.alias("s"), on).select("r.product_id", article.alias("article"))


def pairs(articles: DataFrame) -> DataFrame:
    """product_id_a, product_id_b of all pairs of listings of one article, the smaller id first."""
    a = articles.select("article", F.col("product_id").alias("product_id_a"))
    b = articles.select("article", F.col("product_id").alias("product_id_b"))
    return a.join(b, "article").filter("product_id_a < product_id_b").select("product_id_a", "product_id_b")
