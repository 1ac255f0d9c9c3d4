"""Question generation: templates over listings, edge questions with their expected outcome, exact quotas."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions.clean import format_number, metric, nullify, number, strip
from ..sources.scratch import Scratch
from .relational import keep_one


def subjects(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``subject``: the name; where several rows share it, with the areas and the unit type that are known.

    Counts are aggregated before they meet the rows, so that a name of very many rows is an ordinary skewed join.
    """
    shared = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.count("*").alias("__rows")).where("__rows > 1")
    part = lambda label, c: F.concat(F.lit(f"{label} "), c)
    known = (part("전용", metric(_number(df, "area"), "㎡")), part("공급", metric(_number(df, "supply_area"), "㎡")), part("타입", _text(df, "unit_type")))
    joined = df.withColumn("__long", F.concat_ws(" ", nullify(F.col(name)), *known)).join(shared, F.col(name) == F.col("__name"), "left")
    return joined.withColumn("subject", F.when(F.col("__rows").isNotNull(), F.col("__long")).otherwise(nullify(F.col(name)))).drop("__long", "__name", "__rows")


def _text(df: DataFrame, column: str) -> Column:
    return nullify(F.col(column)) if column in df.columns else F.lit(None).cast("string")


def _number(df: DataFrame, column: str) -> Column:
    return number(F.col(column)) if column in df.columns else F.lit(None).cast("double")


def qa_answers(df: DataFrame) -> dict[str, Column]:
    """Answer by key; null where its column is missing or blank."""
    t, n = (lambda x: _text(df, x)), (lambda x, digits=0: format_number(_number(df, x), digits))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    name, place = t("name"), F.nullif(F.concat_ws(" ", t("sido"), t("sigungu"), t("dong")), F.lit(""))
    station = t("station")
    return {
        "fact_area": say(name, "의 전용면적은 ", n("area", 2), "㎡입니다."),
        "supply_area": say(name, "의 공급면적은 ", n("supply_area", 2), "㎡입니다."),
        "households": say(name, "은 총 ", n("households"), "세대 규모입니다."),
        "structure": say(name, "의 구조 요약은 ", t("structure")),
        "area_band": say(name, "은 ", t("band"), " 면적대로 분류됩니다."),
        "location": say(name, "은 ", place, "에 위치합니다."),
        "location_detail": say(name, "의 주소는 ", t("address"), "입니다."),
        "station": F.coalesce(say("가장 가까운 역은 ", station, "이며 약 ", n("distance"), "m 거리입니다."), say("가장 가까운 역은 ", station, "입니다.")),
        "transport_summary": F.coalesce(t("transport_compare"), t("line_summary")),
        "distance": say("가장 가까운 역까지 거리는 약 ", n("distance"), "m입니다."),
        "price": say(name, "의 공급액은 ", n("price"), "만원입니다."),
        "price_per_pyeong": say("평당 공급액은 ", n("price_per_pyeong", 2), "만원입니다."),
        **{key: t(key) for key in ("price_summary", "lifestyle", "medical", "commute", "builder", "policy", "description")},
    }


def qa_rows(listing: DataFrame) -> DataFrame:
    """Contract rows of the nineteen templates in one pass over the listing; null answers and rows without name or id are left out.

    Columns that the listing lacks count as null. ``ord`` is the template's place. Questions are not yet unique.
    """
    df = subjects(listing).where(nullify(F.col("name")).isNotNull() & nullify(F.col("doc_id")).isNotNull())
    answers = qa_answers(df)
    made = [F.struct(F.lit(i).alias("ord"), F.concat(F.col("subject"), F.lit(asked)).alias("question"), answers[key].alias("answer"), F.lit(category).alias("category")) for i, (category, key, asked) in enumerate(C.QA_TEMPLATES)]
    rows = df.select(nullify(F.col("name")).alias("name"), nullify(F.col("doc_id")).alias("doc_id"), F.inline(F.array(*made)))
    kind, status = C.QA_LOOKUP
    return rows.where(F.col("answer").isNotNull()).withColumns({"answer_type": F.lit(kind), "expected_match_status": F.lit(status), "must_include": F.col("name"), "must_not_include": F.lit("")})


def knowledge_rows(knowledge: DataFrame, order: str = "ordinal") -> DataFrame:
    """Two questions for each term with a definition; ids are numbered by ``order`` over all rows, those left out included."""
    term, definition, caution = (nullify(F.col(x)) for x in ("term", "definition", "caution"))
    fields = F.coalesce(nullify(F.col("related_dataset_fields")), F.lit("없음"))
    answer = F.concat(F.lit("일반 설명: "), definition, F.lit("\n우리 데이터에서 대응 가능한 필드: "), fields, F.coalesce(F.concat(F.lit("\n주의사항: "), caution), F.lit("")))
    asked = F.array(F.struct(F.concat(term, F.lit("이 뭐야")).alias("question"), F.lit("일반 설명").alias("must_include"), F.lit(0).alias("__q")), F.struct(F.concat(term, F.lit(" 설명해줘")).alias("question"), term.alias("must_include"), F.lit(1).alias("__q")))
    rows = knowledge.where(term.isNotNull() & definition.isNotNull()).select(F.col(order).alias("__at"), answer.alias("answer"), F.inline(asked))
    return rows.select(
        F.lit("GENERAL_KNOWLEDGE").alias("name"), F.format_string("KNOW_%03d", F.col("__at") + 1).alias("doc_id"), (F.col("__at") * 2 + F.col("__q")).cast("int").alias("ord"), "question", "answer", F.lit("knowledge_term").alias("category"),
        F.lit("knowledge_answer").alias("answer_type"), F.lit("KNOWN").alias("expected_match_status"), "must_include", F.lit("").alias("must_not_include"),
    )


def fixed_rows(listing: DataFrame) -> DataFrame:
    """Scope, no-match and comparison records, filled with the data's date (that of the smallest id) and its commonest district (ties: the smaller).

    Without any listing the comparison records are absent. Both values are aggregates of one row.
    """
    cutoff, region = _text(listing, "cutoff"), _text(listing, "sigungu")
    when = listing.agg(F.min_by(cutoff, F.when(cutoff.isNotNull(), F.col("doc_id"))).alias("__cutoff"), F.count("*").alias("__rows"))
    top = listing.where(region.isNotNull()).groupBy(region.alias("__r")).agg(F.count("*").alias("__n")).agg(F.min_by("__r", F.struct(-F.col("__n"), F.col("__r"))).alias("__region"))
    facts = when.join(top)
    rows = [F.struct(F.lit(i).alias("ord"), *(F.lit(v).alias(k) for k, v in zip(C.QA_FIXED_COLUMNS, r))) for i, r in enumerate(C.QA_FIXED)]
    fill = lambda x: F.replace(F.replace(F.col(x), F.lit("{cutoff}"), F.coalesce("__cutoff", F.lit(C.NO_CUTOFF))), F.lit("{region}"), F.coalesce("__region", F.lit(C.QA_TOP_REGION)))
    made = facts.select("__cutoff", "__region", "__rows", F.inline(F.array(*rows))).where((F.col("__rows") > 0) | (F.col("name") != "COMPARATIVE"))
    return made.withColumns({x: fill(x) for x in ("question", "answer", "must_include")}).drop("__cutoff", "__region", "__rows")


def qa_dataset(listing: DataFrame, knowledge: DataFrame, order: str = "ordinal") -> DataFrame:
    """All contract rows, the first of each question: listings by id and template, then terms, then the fixed records.

    ``answer_type`` and ``expected_answer_type`` are alike. Empty inputs leave only the fixed records that need none.
    """
    pools = (qa_rows(listing), knowledge_rows(knowledge, order), fixed_rows(listing))
    rows = reduce(DataFrame.unionByName, (p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)))
    whole = reduce(Column.__and__, (strip(F.col(x)) != "" for x in ("question", "answer", "name")))
    first = keep_one(rows.where(whole), ["question"], ["pool", "doc_id", "ord"])
    return first.withColumn("expected_answer_type", F.col("answer_type")).drop("pool", "ord")


def require_rows(df: DataFrame, least: int = C.QA_LEAST_ROWS) -> DataFrame:
    """The frame itself; ValueError where it has fewer rows. Counts no further than that many."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"too few questions: {found} of at least {least}")
    return df


def sampled(df: DataFrame, n: int, id_col: str = "question", salt: str = "sample::42") -> DataFrame:
    return df.orderBy(F.sha2(F.concat_ws("||", F.lit(salt), id_col), 256), id_col).limit(n)


def commonest(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, rank from 0): the n most frequent values, ties to the smaller; nulls are no value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), column).limit(n)
    return counts.withColumn(f"__{column}", F.row_number().over(Window.orderBy(F.desc("__n"), column)) - 1).drop("__n")


def _asked(listing: DataFrame, block: int, kind: str, levels: tuple, specs: tuple) -> DataFrame:
    """One block's questions: the commonest values of its levels, each spec's rows settled in one aggregate by those levels."""
    names = [n for n, _ in levels]
    tops = crossed(*(commonest(listing, n, most) for n, most in levels))
    held = []
    for i, (_, where, by, greatest, *_rest) in enumerate(specs):
        ok, value = F.coalesce(F.expr(where), F.lit(False)), F.col(by).cast("double")
        place = F.struct(value.isNull(), -value if greatest else value, F.col("doc_id"))
        held += [F.min_by(nullify(F.col("doc_id")), F.when(ok, place)).alias(f"__doc{i}"), F.count_if(ok).alias(f"__rows{i}")]
    found = tops.join(listing.groupBy(*(F.col(n).cast("string").alias(n) for n in names)).agg(*held), names, "left")
    made = []
    for i, (pattern, _, _, _, field, router, hit, miss, tell) in enumerate(specs):
        none = F.coalesce(F.col(f"__rows{i}"), F.lit(0)) == 0
        made.append(F.struct(
            F.array(F.lit(1 + block), *(F.col(f"__{n}") for n in names), F.lit(i)).alias("ord"), F.lit(kind).alias("type"), F.format_string(pattern, *map(F.col, names)).alias("question"),
            F.coalesce(f"__doc{i}", F.lit("")).alias("expected_doc"), F.lit(field).alias("expected_field"), F.lit(router).alias("expected_router_type"), F.when(none, miss).otherwise(hit).alias("expected_match_status"),
            F.when(none & F.lit(router != "GENERAL_RETRIEVAL_QA"), "Y").otherwise("N").alias("must_not_recommend"), F.when(none, tell).otherwise("N").alias("must_disclose_limit"),
        ))
    return found.select(F.inline(F.array(*made)))


def _filled(listing: DataFrame, block: int, kind: str, levels: tuple, pattern: str, words: tuple, field: str, router: str, refuse: str) -> DataFrame:
    """One block of fill questions: the commonest values of its levels by all combinations of its words."""
    one = listing.sparkSession.range(1).select()
    tops = one
    for n, most, otherwise in levels:
        ranked = one.join(commonest(listing, n, most), F.lit(True), "left")
        tops = crossed(tops, ranked.select(F.coalesce(n, F.lit(otherwise)).alias(n), F.coalesce(f"__{n}", F.lit(0)).alias(f"__{n}")))
    names = [n for n, *_ in levels]
    made = F.array(*(F.struct(F.lit(i).alias("__i"), F.format_string(pattern, *map(F.col, names), *map(F.lit, said)).alias("question")) for i, said in enumerate(product(*words))))
    rest = {"type": kind, "expected_doc": "", "expected_field": field, "expected_router_type": router, "expected_match_status": "UNKNOWN", "must_not_recommend": refuse, "must_disclose_limit": refuse}
    rows = tops.select(*(f"__{n}" for n in names), F.inline(made))
    return rows.select(F.array(F.lit(100 + block), *(F.col(f"__{n}") for n in names), F.col("__i")).alias("ord"), "question", *(F.lit(v).alias(k) for k, v in rest.items()))


def edge_questions(listing: DataFrame, quotas: dict[str, int] = C.EDGE_QUOTAS) -> DataFrame:
    """(type, question, expected_doc, expected_field, …): what the data answers about its commonest places, the first of each question, filled up to the quotas of the types.

    A typed question belongs to the first type that makes it, also where that one's quota leaves it out; a fill question
    only where the fill gets to it, else to a later type. Ties go to the smaller id or value. An empty listing leaves the questions over no place and the fill with its stand-ins. All but the
    aggregates by place is of a size that the fixed lists bound.
    """
    blocks = [_filled(listing, i, *block) for i, block in enumerate(C.EDGE_FILL)] + [_asked(listing, i, *block) for i, block in enumerate(C.EDGE_BLOCKS)]
    names = ("type", "question", "expected_field", "expected_router_type", "expected_match_status", "must_disclose_limit")
    fixed = [F.struct(F.array(F.lit(99 if at else 0), F.lit(i)).alias("ord"), *(F.lit(v).alias(n) for n, v in zip(names, (kind, *rest))), F.lit("").alias("expected_doc"), F.lit("Y").alias("must_not_recommend")) for i, (kind, at, *rest) in enumerate(C.EDGE_FIXED)]
    rows = reduce(DataFrame.unionByName, blocks + [listing.sparkSession.range(1).select(F.inline(F.array(*fixed)))])
    ready = rows.withColumn("question", strip(F.col("question"))).where("question <> ''")
    return first_come(ready, "question", "type", "ord", quotas, F.get("ord", F.lit(0)) < 100).drop("ord")


def first_come(rows: DataFrame, key: str, kind: str, order: str, quotas: dict[str, int], claims: Column) -> DataFrame:
    """Kinds in the quotas' order, each its first rows by order that no kind before it has, up to its quota; a written table.

    Rows that claim are a kind's before the others, and their keys are gone for later kinds also where the quota
    leaves them out. The others only fill what is left, and stop there: a key that no fill got to is free for the next
    kind. A round a kind settles what it took; the rows that a round sorts are bounded by its quota.
    """
    scratch = Scratch(rows.sparkSession, "first-come")
    own = scratch.settled(keep_one(rows.withColumn("__claims", claims), [kind, key], [order]))
    gone = scratch.settled(own.limit(0).select(key))
    taken = []
    for name, quota in quotas.items():
        mine = own.where(F.col(kind) == name).join(gone, key, "left_anti")
        claimed = scratch.settled(mine.where("__claims"))
        room = max(0, quota - claimed.count())
        fill = scratch.settled(mine.where("not __claims").join(claimed.select(key), key, "left_anti").orderBy(order).limit(room))
        taken += [claimed.orderBy(order).limit(quota), fill]
        gone = scratch.settled(gone.unionByName(claimed.select(key)).unionByName(fill.select(key)))
    out = scratch.settled(reduce(DataFrame.unionByName, taken).drop("__claims"))
    scratch.clear(out)
    return out


def literal_records(spark, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))))


def crossed(*frames: DataFrame) -> DataFrame:
    """All combinations of small literal frames (templates, bands, suffixes)."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), frames)
