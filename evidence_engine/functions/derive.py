"""Derived labels, scores and texts as Column expressions. Columns are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import contracts as C
from .clean import clean_numeric, format_number, is_missing, metric, nullify, number, py_round, text, to_bool


def area_band(c: Column) -> Column:
    out = F.when(c.isNull(), C.AREA_UNKNOWN)
    for limit, label in C.AREA_BANDS:
        out = out.when(c < limit, label) if limit is not None else out.otherwise(label)
    return out


def three_way(c: Column, low: Column, high: Column, labels: tuple[str, str, str, str]) -> Column:
    """labels: missing, at least high, at most low, between; high goes first."""
    return F.when(c.isNull(), labels[0]).when(c >= high, labels[1]).when(c <= low, labels[2]).otherwise(labels[3])


def medical_label(first: Column, second: Column, third: Column) -> Column:
    a, b, c = (F.coalesce(x, F.lit(0)).cast("long") for x in (first, second, third))
    return F.when(a + b + c == 0, C.MEDICAL_LABELS[0]).when((c > 0) & (b > 0), C.MEDICAL_LABELS[1]).when(c > 0, C.MEDICAL_LABELS[2]).when(b > 0, C.MEDICAL_LABELS[3]).otherwise(C.MEDICAL_LABELS[4])


def medical_score(first: Column, second: Column, third: Column) -> Column:
    a, b, c = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (first, second, third))
    return py_round(a + b * 2 + c * 3, 1)


def commute_label(inside: Column, outside: Column) -> Column:
    i, o = F.coalesce(inside, F.lit(0)), F.coalesce(outside, F.lit(0))
    return F.when(inside.isNull() & outside.isNull(), C.COMMUTE_LABELS[0]).when(o > i, C.COMMUTE_LABELS[1]).when(i > o, C.COMMUTE_LABELS[2]).otherwise(C.COMMUTE_LABELS[3])


def builder_label(c: Column) -> Column:
    b = to_bool(c)
    return F.when(b, C.BUILDER_LABELS[0]).when(~b, C.BUILDER_LABELS[1]).otherwise(C.BUILDER_LABELS[2])


def structure_text(area: Column, rooms: Column, baths: Column, hallway: Column) -> Column:
    bits = F.concat_ws(" ", F.concat(F.lit("전용면적 "), format_number(area), F.lit("㎡ 기준")), F.concat(F.lit("방 "), format_number(rooms), F.lit("개")), F.concat(F.lit("욕실 "), format_number(baths), F.lit("개")), F.concat(nullify(hallway), F.lit(" 현관구조")))
    return F.when(bits == "", "구조 정보 없음").otherwise(F.concat(bits, F.lit(" 구조입니다.")))


def policy_text(*flags: Column) -> Column:
    labels = F.filter(F.array(*(F.when(to_bool(f), label) for f, label in zip(flags, C.POLICY_LABELS))), lambda x: x.isNotNull())
    n = F.size(labels)
    many = F.concat(F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" 및 "), F.get(labels, n - 1), F.lit(" 단지입니다."))
    return F.when(n == 0, C.POLICY_NONE).when(n == 1, F.concat(F.get(labels, 0), F.lit(" 단지입니다."))).otherwise(many)


def special_notes(*flags: Column) -> Column:
    """Labels of the flags that hold, in order; the default sentence where none does. Unknown flags say nothing."""
    return F.coalesce(F.nullif(F.concat_ws("; ", *(F.when(to_bool(f), label) for f, label in zip(flags, C.POLICY_LABELS))), F.lit("")), F.lit(C.NOTES_NONE))


def metres(kilometres: Column) -> Column:
    """Kilometres as metres, one decimal, half to even; null and text that is no number stay null."""
    return py_round(number(kilometres) * 1000.0, 1)


def percent(part: Column, whole: Column) -> Column:
    """Share as text with two decimals; null where the whole is zero or null."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.when(share.isNotNull(), F.format_string("%.2f", share))


def disclosed_answer(answer: Column, must_disclose: Column, data_date: Column, scope: Column) -> Column:
    """The answer, with the two lines on date and scope below it where they are asked for and not both there.

    A null or blank answer that must disclose becomes the two lines alone; others stay as they are.
    """
    said = text(answer)
    footer = F.concat_ws("\n", *(F.concat(F.lit(f"{mark} "), F.coalesce(nullify(c), F.lit(default))) for mark, c, default in zip(C.FOOTER_MARKS, (data_date, scope), C.FOOTER_DEFAULTS)))
    done = reduce(Column.__and__, (said.contains(mark) for mark in C.FOOTER_MARKS))
    return F.when((text(must_disclose) != "Y") | done, answer).when(said == "", footer).otherwise(F.concat(said, F.lit("\n"), footer))


def subway_score(distance: Column, lines: Column, transfer: Column, accept_korean_yes: bool = False) -> Column:
    bonus = F.when(to_bool(transfer, ("예",) if accept_korean_yes else ()), 75.0).otherwise(0.0)
    return F.when(distance.isNotNull(), py_round(F.greatest(F.lit(0.0), 1000.0 - distance) + F.coalesce(lines.cast("double"), F.lit(0.0)) * 50.0 + bonus, 1))


def subway_compare(station: Column, distance: Column, lines: Column, transfer: Column) -> Column:
    parts = F.concat_ws(", ", F.concat(nullify(station), F.lit(" 이용 가능")), F.concat(F.lit("도보 거리 약 "), format_number(distance), F.lit("m")), F.concat(format_number(lines), F.lit("개 노선 접근")), F.when(to_bool(transfer), "환승 가능"))
    return F.when(is_missing(station), "지하철 비교 정보 없음").otherwise(parts)


def park_compare(c: Column) -> Column:
    n = F.bround(c, 0).cast("long")
    return F.when(c.isNull(), "공원 비교 정보 없음").when(n <= 0, "공원 정보 없음").otherwise(F.concat(F.lit("주변 공원 관련 시설 수 "), n.cast("string"), F.lit("개 기준으로 비교 가능")))


def medical_compare(score: Column) -> Column:
    return F.when(score.isNull(), "병원 비교 정보 없음").otherwise(F.concat(F.lit("병원 접근 지표 "), format_number(score, 1), F.lit(" 기준으로 비교 가능")))


def transfer_columns(lines: Column) -> dict[str, Column]:
    """From an array of lines: how many, whether one can change, and their summary."""
    return {"line_count": F.size(lines), "transfer": F.when(F.size(lines) >= 2, "예").otherwise("아니오"), "line_summary": F.nullif(F.array_join(lines, ", "), F.lit(""))}


def all_missing(columns: list[Column]) -> Column:
    return reduce(Column.__and__, (is_missing(c) for c in columns), F.lit(True))


def missing_fields(groups: dict[str, list[Column]]) -> Column:
    """Labels of the groups all of whose columns are missing; a group without columns is missing."""
    out = F.concat_ws(", ", *(F.when(all_missing(cols), label) for label, cols in groups.items()))
    return F.when(out == "", "없음").otherwise(out)


def query_tags(groups: dict[str, list[Column]]) -> Column:
    return F.concat_ws("|", *(F.when(~all_missing(cols), tag) for tag, cols in groups.items() if cols))


def scope_text(park: Column, hospital: Column, school: Column) -> Column:
    there = lambda c: ~is_missing(c)
    return F.concat_ws(", ", *map(F.lit, ("아파트 기본정보", "가격", "교통", "정책")), F.when(there(park), "공원 비교"), F.when(there(hospital), "병원 비교"), F.when(there(school) & (school != "학교 데이터 없음"), "학교 비교"))


def source_flags(policy: Column) -> Column:
    return F.concat_ws("|", F.lit("dataset_fact"), F.when(~is_missing(policy), "derived_fact"))


def recommendable(name: Column, district: Column, description: Column) -> Column:
    return F.when(~(is_missing(name) | is_missing(district) | is_missing(description)), "Y").otherwise("N")


def location(*levels: Column, fallback: Column | None = None) -> Column:
    out = F.concat_ws(" ", *map(nullify, levels))
    return out if fallback is None else F.coalesce(F.nullif(out, F.lit("")), fallback)


def description(name: Column, place: Column, households: Column, area: Column, station: Column, distance: Column, price: Column, price_label: Column, *more: Column) -> Column:
    name = F.coalesce(name, F.lit("이 단지"))
    close = lambda c: F.when(c != "", F.concat(c, F.lit("입니다.")))
    first = F.when(place != "", F.concat(name, F.lit("은 "), place, F.lit("에 위치한 아파트 단지입니다."))).otherwise(F.concat(name, F.lit("은 청약 아파트 정보가 정리된 단지입니다.")))
    size = close(F.concat_ws(", ", F.concat(F.lit("총 "), format_number(households), F.lit("세대 규모")), F.concat(F.lit("전용면적은 "), metric(area, "㎡"))))
    traffic = close(F.concat_ws(", ", F.concat(F.lit("가장 가까운 지하철역은 "), nullify(station)), F.concat(F.lit("약 "), format_number(distance), F.lit("m 거리"))))
    cost = F.nullif(F.concat_ws(", ", F.concat(F.lit("공급가는 "), format_number(price), F.lit("만원 수준")), nullify(price_label)), F.lit(""))
    return F.concat_ws(" ", first, size, traffic, cost, *map(nullify, more))


def keywords(*columns: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(*map(nullify, columns)), lambda x: x.isNotNull())), ", ")


def search_text(*columns: Column) -> Column:
    return F.concat_ws(" ", *map(nullify, columns))


def cutoff(path: Column) -> Column:
    """YYYY-MM-DD of the first eight digits in the file's name."""
    digits = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), r"\D", "")
    return F.when(F.length(digits) >= 8, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).otherwise(C.NO_CUTOFF)


def total(*columns: Column) -> Column:
    return reduce(Column.__add__, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns))


def content_id(*columns: Column) -> Column:
    joined = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("nan")) for c in columns))
    return F.concat(F.lit("APT-"), F.substring(F.sha1(joined), 1, 24))


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__] + ["clean_numeric"]
