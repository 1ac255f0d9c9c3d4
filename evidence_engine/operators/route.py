"""The question router: parsed fields and query type as Columns over a whole table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions.clean import any_hint, collapse, normalize
from .dictionary import longest_entries


def comparative_tags(q: Column) -> Column:
    """Tags in their fixed order; 역 counts unless 지, 구 or 권 stands before it."""
    hits = []
    for tag, aliases in C.COMPARATIVE_ALIASES.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | (q.rlike("(?<!지)(?<!구)(?<!권)역") if a == "역" else q.contains(a))
        hits.append(F.when(hit, tag))
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def asked_band(q: Column, strict: bool = False) -> Column:
    """strict: the first band in list order whose word is in the question; else the longest."""
    out = F
    for band in C.BAND_ORDER if strict else sorted(C.BAND_ORDER, key=lambda b: (-len(b), C.BAND_ORDER.index(b))):
        out = out.when(q.contains(band), band)
    return out


def _int(q: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(q, pattern, 1), F.lit("")).try_cast("bigint")


def filters(q: Column, strict_band: bool = False) -> Column:
    near = any_hint(q, C.NEAR_SUBWAY)
    return F.struct(
        (_int(q, r"(?U)(\d+)\s*억\s*이하") * 10000).alias("price_max_manwon"),
        F.coalesce(_int(q, r"(?iU)(\d+)\s*m\s*이내"), F.when(near, F.lit(500).cast("bigint"))).alias("distance_subway_max_m"),
        F.nullif(F.regexp_extract(q, r"(?U)전용(?:면적)?\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double").alias("exclusive_area_min"),
        _int(q, r"(?U)(\d+)\s*세대\s*이상").alias("households_min"),
        F.when(q.contains("신축"), F.lit(2020).cast("bigint")).alias("move_in_year_min"),
        any_hint(q, C.PRICE_FINE).alias("prefer_low_price"),
        near.alias("prefer_near_subway"),
        q.contains(C.PARK_AND_HOSPITAL).alias("prefer_park_hospital_access"),
        asked_band(q, strict_band).alias("area_band_label"),
    )


def objective(f: Column) -> Column:
    """A limit or a preference other than the area's."""
    there = f["price_max_manwon"].isNotNull() | f["distance_subway_max_m"].isNotNull() | f["move_in_year_min"].isNotNull() | f["households_min"].isNotNull()
    return there | f["prefer_low_price"] | f["prefer_near_subway"] | f["prefer_park_hospital_access"]


def explicit(f: Column) -> Column:
    return objective(f) | f["exclusive_area_min"].isNotNull()


def with_flags(df: DataFrame) -> DataFrame:
    """Adds the predicates that decide a route. Needs q, name, term, sido, sigungu, dong, tags, filters."""
    q, f, tags = F.col("q"), F.col("filters"), F.col("tags")
    has = lambda hints: any_hint(q, hints)
    region = F.col("sido").isNotNull() | F.col("sigungu").isNotNull() | F.col("dong").isNotNull()
    tagged, band, fine = F.size(tags) > 0, f["area_band_label"].isNotNull(), has(C.PRICE_FINE)
    plain = ~explicit(f) & ~tagged & ~has(C.SUPPORTED_PHRASES)
    general = (
        F.col("name").isNull() & F.col("term").isNull() & ~tagged & ~has(C.AMBIGUOUS_SCOPE) & ~has(C.UNSUPPORTED_QUALIFIERS) & ~has(C.VAGUE_AMENITIES)
        & ~explicit(f) & ~has(C.HARD_SELECTION) & ~has(C.COMPARISON) & region & has(C.GENERAL_RETRIEVAL)
    )
    unsupported = (
        (has(C.UNSUPPORTED_QUALIFIERS) & ~objective(f)) | has(C.VAGUE_AMENITIES) | (band & fine) | (band & ~objective(f) & ~has(C.SUPPORTED_PHRASES))
        | (region & has(C.RECOMMEND) & plain) | (region & has(C.VAGUE_SYNTAX) & plain)
    )
    return df.withColumns({
        "has_region": region,
        "general_retrieval": general,
        "subjective_comparative": ~fine & has(C.SUBJECTIVE) & has(C.SELECTION),
        "ambiguous_scope": region & has(C.AMBIGUOUS_SCOPE) & ~explicit(f),
        "unsupported_structured": unsupported,
        "vague_place": tagged & has(C.VAGUE_PLACES),
        "unsupported_comparative": ~fine & (has(C.UNSUPPORTED_COMPARATIVE) | (tagged & has(C.UNSUPPORTED_COMPARATIVE_SYNTAX))),
    })


def query_type() -> Column:
    """Rules in order; the first that holds decides."""
    q, f = F.col("q"), F.col("filters")
    rules: list[tuple[Column, str]] = [
        (any_hint(q, C.META), "DATA_SCOPE_META"),
        (F.col("term").isNotNull() & any_hint(q, C.KNOWLEDGE), "REAL_ESTATE_KNOWLEDGE"),
        (F.col("name").isNotNull(), "APARTMENT_FACT_LOOKUP"),
        (F.col("general_retrieval"), "GENERAL_RETRIEVAL_QA"),
        (F.col("subjective_comparative"), "RECOMMEND_COMPARATIVE"),
        (F.col("ambiguous_scope") | F.col("unsupported_structured"), "RECOMMEND_STRUCTURED"),
        (F.col("vague_place") | F.col("unsupported_comparative"), "RECOMMEND_COMPARATIVE"),
        ((F.size("tags") > 0) & any_hint(q, C.COMPARISON), "RECOMMEND_COMPARATIVE"),
        (any_hint(q, C.RECOMMEND) | explicit(f) | f["area_band_label"].isNotNull() | F.col("has_region"), "RECOMMEND_STRUCTURED"),
    ]
    out = F
    for holds, name in rules:
        out = out.when(holds, name)
    return out.otherwise("GENERAL_RETRIEVAL_QA")


def parse(questions: DataFrame, listing: DataFrame, terms: DataFrame, *, key: str = "qid", question: str = "question", term: str = "term", strict_band: bool = False) -> DataFrame:
    """One row a question: q, name, term, sido, sigungu, dong, tags, filters, the predicates and query_type.

    listing has name, sido, sigungu and dong. The five dictionaries go through one automaton together.
    """
    q = questions.withColumn("q", collapse(F.col(question)))
    own = ["name", "sido", "sigungu", "dong"]
    entries = listing.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("entry")) for k in own)))).unionByName(terms.select(F.lit("term").alias("kind"), F.col(term).cast("string").alias("entry")))
    out = q.join(longest_entries(q, entries, key, "q", ["name", "term", *own[1:]]), key, "left")
    out = out.withColumns({"tags": comparative_tags(F.col("q")), "filters": filters(F.col("q"), strict_band)})
    return with_flags(out).withColumn("query_type", query_type())


def _fields(q: Column, rules: tuple) -> Column:
    parts = F.flatten(F.array(*(F.when(any_hint(q, words), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for words, names in rules)))
    found = F.array_distinct(parts)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("description")))


def used_fields(q: Column) -> Column:
    return _fields(normalize(q), C.USED_FIELDS)


def lookup_fields(q: Column) -> Column:
    return _fields(q, C.LOOKUP_FIELDS)
