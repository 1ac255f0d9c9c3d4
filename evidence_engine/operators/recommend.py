"""Structured and comparative recommendations, facts and the other answers, for all questions at once.

A listing row has: doc_id, name, sido, sigungu, dong, area, price, distance, households, year, band, park,
hospital, subway, station, lifestyle and the other columns of the facts.
"""

from __future__ import annotations

from functools import reduce
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions.clean import text
from ..sources.scratch import Scratch
from .order import with_ordinal
from .route import lookup_fields

SCORES = {"공원": "park", "병원": "hospital", "지하철": "subway", "학교": "school"}


def in_region(sido=None, sigungu=None, dong=None) -> Column:
    """Equality on the levels given; a level that is None is no constraint."""
    given = [(c, v) for c, v in (("sido", sido), ("sigungu", sigungu), ("dong", dong)) if v is not None]
    return reduce(Column.__and__, (F.col(c) == v for c, v in given), F.lit(True))


def meets(listing: DataFrame, *, band=None, price_max=None, distance_max=None, area_min=None, area_max=None, year_min=None, households_min=None) -> tuple[DataFrame, list[str]]:
    """Rows that meet all limits (null meets none), and the names of limits whose column is absent."""
    wanted = [("band", band, Column.__eq__, "면적대"), ("price", price_max, Column.__le__, "가격"), ("distance", distance_max, Column.__le__, "지하철 거리"), ("area", area_min, Column.__ge__, "전용면적"), ("area", area_max, Column.__lt__, "전용면적"), ("year", year_min, Column.__ge__, "입주예정연도"), ("households", households_min, Column.__ge__, "세대수")]
    unknown = []
    for column, value, test, label in wanted:
        if value is None:
            continue
        if column in listing.columns:
            listing = listing.where(test(F.col(column), F.lit(value)))
        else:
            unknown.append(label)
    return listing, unknown


def order_for(low_price: bool = False, near_subway: bool = False, park_hospital: bool = False) -> list[Column]:
    """Sort keys by preference, nulls last on each, the id last of all."""
    keys: list[Column] = []
    if park_hospital:
        keys += [F.desc_nulls_last("park"), F.desc_nulls_last("hospital")]
    if near_subway:
        keys.append(F.asc_nulls_last("distance"))
    if low_price:
        keys.append(F.asc_nulls_last("price"))
    return [*(keys or [F.asc_nulls_last("distance"), F.asc_nulls_last("price"), F.desc_nulls_last("households")]), F.asc("doc_id")]


def best_names(df: DataFrame, by: list[str], order: list[Column], k: int = 3) -> DataFrame:
    """The first row of each name, and of those the first k of each group, with their rank."""
    one = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "name").orderBy(*order))).where("__n = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).drop("__n")


#: Rows of a block of listings in the order of a preference.
BLOCK = 4096
#: A block's bounds, by the question's limit that they can refuse: (limit, column, is the least value what counts, test against it).
_BOUNDS = (
    ("price_max_manwon", "price", True, Column.__le__), ("distance_subway_max_m", "distance", True, Column.__le__), ("exclusive_area_min", "area", False, Column.__ge__),
    ("move_in_year_min", "year", False, Column.__ge__), ("households_min", "households", False, Column.__ge__),
)


def _within_limits(f: Column) -> Column:
    free = lambda v, test: v.isNull() | F.coalesce(test, F.lit(False))
    tests = [free(f[limit], test(F.col(column), f[limit])) for limit, column, _, test in _BOUNDS]
    return reduce(Column.__and__, tests, free(f["area_band_label"], F.col("band") == f["area_band_label"]))


def _keys(wishes: tuple[bool, bool, bool]) -> list[Column]:
    """The sort keys of order_for as numbers in ascending order, nulls last."""
    low_price, near_subway, park_hospital = wishes
    use = {"park": park_hospital, "hospital": park_hospital, "distance": near_subway, "price": low_price, "households": False}
    if not any(wishes):
        use |= {"distance": True, "price": True, "households": True}
    sign = {"park": -1, "hospital": -1, "households": -1}
    return [F.coalesce(F.col(c).cast("double") * sign.get(c, 1), F.lit(inf)) if on else F.lit(0.0) for c, on in use.items()]


def first_names(asks: DataFrame, listing: DataFrame, views: dict[str, tuple[str | None, list[Column], Column | None]], k: int = 3, block: int = BLOCK) -> DataFrame:
    """(ask, rank, row): the first k names that meet each ask, by a threshold algorithm over listings sorted once a view.

    A view is an order of the listings: a region level or None, sort keys, and which listings take part. asks: ask,
    view, region (of the view's level), filters, ask_sido, ask_sigungu, ask_dong. Listings lie in blocks of
    consecutive ordinals; asks read their region's blocks from the first on, ever more at a time, and stop at k
    names: nothing behind can come before them. Blocks whose bounds refuse an ask's limits are not read.
    """
    scratch = Scratch(asks.sparkSession, "first-names")
    sorts = [f"__k{i}" for i in range(max((len(v[1]) for v in views.values()), default=0))]
    parts = []
    for name, (level, keys, where) in views.items():
        own = listing if where is None else listing.where(where)
        region = F.lit("") if level is None else F.col(level)
        own = own.where(region.isNotNull()).withColumns({"__view": F.lit(name), "__region": region})
        parts.append(own.withColumns({s: keys[i] if i < len(keys) else F.lit(0.0) for i, s in enumerate(sorts)}))
    if not parts:
        return asks.limit(0).select("ask", F.lit(1).alias("rank"), F.lit(None).cast(f"struct<{','.join(f'`{n}`:{t}' for n, t in listing.dtypes)}>").alias("row"))
    ordered = with_ordinal(reduce(DataFrame.unionByName, parts), ["__view", "__region", *sorts, "doc_id"], "__at", 0, scratch=scratch).withColumn("__block", F.floor(F.col("__at") / block))
    least = [(F.min(c) if small else F.max(c)).alias(f"z_{c}") for _, c, small, _ in _BOUNDS]
    zones = scratch.settled(ordered.groupBy("__block").agg(*least, F.collect_set("band").alias("z_band")))
    span = ordered.groupBy(F.col("__view").alias("view"), F.col("__region").alias("region")).agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"))
    left = scratch.settled(asks.join(span, ["view", "region"]).withColumn("__next", F.floor(F.col("__low") / block)).drop("view", "region"))
    found = None
    f, width = F.col("filters"), 1
    same = reduce(Column.__and__, (F.col(f"ask_{c}").isNull() | F.coalesce(F.col(f"ask_{c}") == F.col(c), F.lit(False)) for c in ("sido", "sigungu", "dong")))
    while not left.isEmpty():
        end = F.least(F.floor(F.col("__high") / block), F.col("__next") + width - 1)
        asked = left.withColumn("__block", F.explode(F.sequence(F.col("__next"), end))).join(zones, "__block")
        may = [f[limit].isNull() | F.coalesce(test(F.col(f"z_{c}"), f[limit]), F.lit(False)) for limit, c, _, test in _BOUNDS]
        asked = asked.where(reduce(Column.__and__, may, f["area_band_label"].isNull() | F.array_contains("z_band", f["area_band_label"])))
        met = asked.select(*left.columns, "__block").join(ordered, "__block")
        met = met.where((F.col("__at") >= F.col("__low")) & (F.col("__at") <= F.col("__high")) & same & _within_limits(f)).select("ask", "name", "__at")
        named = (met if found is None else found.unionByName(met)).groupBy("ask", "name").agg(F.min("__at").alias("__at"))
        found = scratch.settled(named.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy("__at"))).where(F.col("rank") <= k).drop("rank"))
        full = found.groupBy("ask").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        after = left.withColumn("__next", F.col("__next") + width).where(F.col("__next") <= F.floor(F.col("__high") / block))
        left, width = scratch.settled(after.join(full, "ask", "left_anti").select(left.columns)), width * 4
    found = found if found is not None else left.select("ask", F.lit("").alias("name"), F.col("__low").alias("__at"))
    rank = F.row_number().over(Window.partitionBy("ask").orderBy("__at"))
    out = scratch.settled(found.withColumn("rank", rank).join(ordered.select("__at", F.struct(*listing.columns).alias("row")), "__at").select("ask", "rank", "row"))
    scratch.clear(out)
    return out


def best_of(questions: DataFrame, listing: DataFrame, key: str = "qid", k: int = 3, block: int = BLOCK) -> DataFrame:
    """(key, rank, row) of the best names of structured questions (score null) and of comparisons by a score.

    questions: key, filters, score, sido, sigungu, dong. Questions of equal filters, score and region are searched
    once; the search goes by the finest region that they name, the coarser ones are filters.
    """
    scratch = Scratch(questions.sparkSession, "best-of")
    wishes = ("prefer_low_price", "prefer_near_subway", "prefer_park_hospital_access")
    levels = [F.when(F.col(f"ask_{c}").isNotNull(), c) for c in ("dong", "sigungu", "sido")]
    asks = questions.select(key, "filters", "score", *(F.col(c).alias(f"ask_{c}") for c in ("sido", "sigungu", "dong"))).withColumns({
        "ask": F.sha2(F.to_json(F.struct("filters", "score", "ask_sido", "ask_sigungu", "ask_dong"), {"ignoreNullFields": "false"}), 256),
        "level": F.coalesce(*levels), "region": F.coalesce("ask_dong", "ask_sigungu", "ask_sido", F.lit("")),
    })
    asks = scratch.settled(asks.withColumns({w: F.coalesce(F.col("filters")[w], F.lit(False)) & F.col("score").isNull() for w in wishes}).withColumn("view", F.concat_ws("|", F.coalesce("level", F.lit("")), F.coalesce("score", F.lit("")), *(F.col(w).cast("string") for w in wishes))))
    views = {}
    for v in asks.select("view", "level", "score", *wishes).distinct().collect():  # four levels, eight orders or a score
        wanted = None if v.score is None else F.col(v.score).isNotNull()
        views[v.view] = (v.level, _keys(tuple(v[w] for w in wishes)) if v.score is None else [-F.col(v.score).cast("double")], wanted)
    once = asks.dropDuplicates(["ask"]).select("ask", "view", "region", "filters", "ask_sido", "ask_sigungu", "ask_dong")
    return asks.select(key, "ask").join(first_names(once, listing, views, k, block), "ask").drop("ask")


def comparative(listing: DataFrame, score: str, by: list[str] | None = None, k: int = 3) -> DataFrame:
    """The k best names by one score; rows without it take no part, a listing without the column has none."""
    if score not in listing.columns:
        return listing.withColumn("rank", F.lit(1)).limit(0)
    return best_names(listing.where(F.col(score).isNotNull()), by or [F.lit(1)], [F.desc(score), F.asc("doc_id")], k)


def data_cutoff(listing: DataFrame, column: str = "cutoff", ordinal: str = "doc_id") -> DataFrame:
    """One row: the first non-null cutoff."""
    return listing.agg(F.coalesce(F.min_by(column, F.when(F.col(column).isNotNull(), F.col(ordinal))), F.lit(C.NO_CUTOFF)).alias("cutoff"))


def citation(answer: Column, ids: Column) -> Column:
    """Adds the cited ids, unless there are none or the answer has them."""
    cite = F.concat(F.lit("근거 문서: "), F.array_join(ids, ", "))
    return F.when((F.size(ids) == 0) | answer.contains(cite), answer).otherwise(F.concat_ws(" ", F.regexp_replace(answer, r"(?U)\s+$", ""), cite))


def disclosure(cutoff: Column) -> Column:
    return F.concat(F.lit("데이터 기준: "), cutoff, F.lit("\n" + C.DISCLOSURE_SCOPE))


def _facts(fields: Column, values: dict[str, Column], name: Column, cutoff: Column) -> Column:
    """The asked fields that have a value, a line each, or the line that says that there is none."""
    said = F.array(*(F.struct(F.lit(field).alias("f"), F.nullif(text(values[column]), F.lit("")).alias("v")) for field, column in C.FIELD_COLUMNS.items() if column in values))
    line = lambda f: F.array_max(F.transform(F.filter(said, lambda x: (x["f"] == f) & x["v"].isNotNull()), lambda x: F.concat(x["f"], F.lit(": "), x["v"])))
    lines = F.filter(F.transform(fields, line), lambda x: x.isNotNull())
    return F.concat_ws("\n", F.concat(name, F.lit(" 정보입니다.")), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(C.NO_FACT), F.concat(F.lit("데이터 기준: "), cutoff))


def answers(parsed: DataFrame, listing: DataFrame, knowledge: DataFrame, key: str = "qid", block: int = BLOCK) -> DataFrame:
    """(key, query_type, answer_type, match_status, top_doc_id, cited_doc_ids, answer) of all questions but those for retrieval.

    A written table. Of listings of one name the first by id tells the facts. knowledge is small: terms and their definitions.
    """
    scratch = Scratch(parsed.sparkSession, "answers")
    cutoff = data_cutoff(listing).first()[0] if "cutoff" in listing.columns else C.NO_CUTOFF
    p, listing = scratch.settled(parsed), scratch.settled(listing)
    tail, cut = disclosure(F.lit(cutoff)), F.lit(cutoff)
    none = F.array().cast("array<string>")
    shape = lambda df, kind, status, answer, ids=none: df.select(key, "query_type", F.lit(kind).alias("answer_type"), F.lit(status).alias("match_status"), F.coalesce(F.get(ids, 0), F.lit("")).alias("top_doc_id"), ids.alias("cited_doc_ids"), answer.alias("answer"))
    of = lambda kind: p.where(F.col("query_type") == kind)
    unknown = lambda what: F.concat(F.lit(f"{C.FALLBACK}\n판단 보류 항목: {what}\n"), tail)
    out = [shape(of("DATA_SCOPE_META"), "meta_answer", "KNOWN", F.concat(F.lit("데이터 기준: "), cut, F.lit(f"\n{C.META_SCOPE}\n{C.META_EXAMPLES}")))]
    k = of("REAL_ESTATE_KNOWLEDGE").join(knowledge.select("term", "definition", "related_dataset_fields", "caution"), "term")
    out.append(shape(k, "knowledge_answer", "KNOWN", F.concat_ws("\n", F.concat(F.lit("일반 설명: "), F.col("definition")), F.concat(F.lit("우리 데이터에 연결 가능한 필드: "), F.col("related_dataset_fields")), F.concat(F.lit("주의사항: "), F.nullif(F.col("caution"), F.lit(""))), F.concat(F.lit("데이터 기준: "), cut))))
    told = [c for c in dict.fromkeys(C.FIELD_COLUMNS.values()) if c in listing.columns]
    first = listing.groupBy("name").agg(F.min("doc_id").alias("doc_id"), *(F.min_by(F.struct(c), "doc_id")[c].alias(f"v_{c}") for c in told))
    fact = of("APARTMENT_FACT_LOOKUP").join(first, "name")
    out.append(shape(fact, "apartment_fact_lookup", "EXACT_MATCH", _facts(lookup_fields(F.col("q")), {c: F.col(f"v_{c}") for c in told}, F.col("name"), cut), F.array("doc_id")))
    s = of("RECOMMEND_STRUCTURED")
    out.append(shape(s.where("ambiguous_scope"), "unknown_response", "UNKNOWN", unknown("범위 표현")))
    out.append(shape(s.where("not ambiguous_scope and unsupported_structured"), "unknown_response", "UNKNOWN", unknown("지원하지 않는 추천 표현")))
    of_row = lambda c: F.nullif(text(F.col(f"row.{c}")), F.lit("")) if c in listing.columns else F.lit(None).cast("string")
    bits = F.concat_ws(", ", F.concat(F.lit("역 "), of_row("station")), F.concat(of_row("distance"), F.lit("m")), F.concat(F.lit("공급액 "), of_row("price"), F.lit("만원")), F.concat(F.lit("전용 "), of_row("area"), F.lit("㎡")), of_row("lifestyle"))
    three = lambda found, said: found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("row.doc_id").alias("doc_id"), F.concat(F.lit("- "), F.col("row.name"), F.lit(": "), said).alias("line")))).alias("top"))
    c = of("RECOMMEND_COMPARATIVE")
    cannot = F.col("unsupported_comparative") | F.col("vague_place")
    tagged = c.where(~cannot & (F.size("tags") > 0)).withColumn("tag", F.get("tags", 0))
    scores = {tag: score for tag, score in SCORES.items() if score in listing.columns}
    score = F.coalesce(*(F.when(F.col("tag") == tag, s) for tag, s in scores.items()), F.lit(None).cast("string"))
    searched = s.where("not ambiguous_scope and not unsupported_structured").withColumn("score", F.lit(None).cast("string"))
    nothing = F.from_json(F.lit("{}"), dict(p.dtypes)["filters"])  # comparisons have no limits
    by_score = tagged.withColumns({"score": score, "filters": nothing}).where("score is not null")
    wanted = [key, "filters", "score", "sido", "sigungu", "dong"]
    best = scratch.settled(best_of(searched.select(wanted).unionByName(by_score.select(wanted)), listing, key, 3, block))
    asked = searched.join(three(best, bits), key, "left")
    out.append(shape(asked.where("top is null"), "no_match_response", "NO_MATCH", F.concat(F.lit("현재 데이터 기준("), cut, F.lit(")으로 해당 조건에 맞는 아파트를 찾지 못했습니다.\n조건을 완화하거나 지역, 예산, 거리 기준을 다시 지정해 주세요.\n"), tail)))
    out.append(shape(asked.where("top is not null"), "recommendation", "EXACT_MATCH", F.concat_ws("\n", F.lit("조건에 맞는 아파트 후보입니다."), F.array_join(F.col("top.line"), "\n"), tail), F.col("top.doc_id")))
    out.append(shape(c.where(cannot), "unsupported_comparative_response", "UNKNOWN", F.concat(F.lit("\n".join(C.UNSUPPORTED_ANSWER) + "\n"), tail)))
    out.append(shape(c.where(~cannot & (F.size("tags") == 0)), "unsupported_comparative_response", "UNKNOWN", F.lit("비교 기준을 해석하지 못했습니다. 공원, 병원, 지하철, 학교처럼 명시적인 기준으로 다시 질문해 주세요.")))
    said = F.coalesce(*(F.when(F.col("tag") == tag, F.col(f"row.{s}").cast("string")) for tag, s in scores.items()), F.lit(""))
    own = tagged.join(three(best.join(tagged.select(key, "tag"), key), said), key, "left")
    out.append(shape(own.where("top is null"), "unknown_response", "UNKNOWN", F.concat(F.lit("현재 데이터로는 "), F.col("tag"), F.lit(" 기준 비교를 안전하게 판단할 수 없습니다.\n"), tail)))
    out.append(shape(own.where("top is not null"), "comparison_recommendation", "EXACT_MATCH", F.concat_ws("\n", F.concat(F.lit("비교 기준: "), F.col("tag")), F.array_join(F.col("top.line"), "\n"), tail), F.col("top.doc_id")))
    written = scratch.settled(reduce(DataFrame.unionByName, out))
    scratch.clear(written)
    return written
