"""The threshold search over sorted listings against brute force, and facts by asked field."""

from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import recommend, route

FILTERS = "struct<price_max_manwon:bigint,distance_subway_max_m:bigint,exclusive_area_min:double,households_min:bigint,move_in_year_min:bigint,prefer_low_price:boolean,prefer_near_subway:boolean,prefer_park_hospital_access:boolean,area_band_label:string>"
LISTING = "doc_id string, name string, sido string, sigungu string, dong string, area double, price double, distance double, households int, year int, band string, park double, hospital double, cutoff string"


def listing_rows(n):
    rng = np.random.default_rng(7)
    maybe = lambda x: None if rng.random() < 0.1 else x
    rows = []
    for i in range(n):
        d = int(rng.integers(0, 12))
        rows.append((f"D{i:05d}", f"n{int(rng.integers(0, n // 3))}", f"s{d % 2}", f"g{d % 4}", maybe(f"d{d}"), maybe(float(rng.integers(20, 150))), maybe(float(rng.integers(1, 30) * 10_000)), maybe(float(rng.integers(0, 40) * 50)), maybe(int(rng.integers(0, 30) * 100)), 2000 + int(rng.integers(0, 25)), str(rng.choice(["소형", "중형", "대형"])), maybe(float(rng.integers(0, 6))), maybe(float(rng.integers(0, 5))), "2023-09-05"))
    return rows


NAMES = [c.split()[0] for c in LISTING.split(", ")]


def brute(row, f, score, sido, sigungu, dong):
    """The three best names for one question."""
    found = []
    for r in (dict(zip(NAMES, x)) for x in row):
        if any(v is not None and r[c] != v for c, v in (("sido", sido), ("sigungu", sigungu), ("dong", dong))):
            continue
        if score:
            if r[score] is None:
                continue
            found.append(((-r[score], r["doc_id"]), r))
            continue
        limits = [("price", f["price_max_manwon"], "<="), ("distance", f["distance_subway_max_m"], "<="), ("area", f["exclusive_area_min"], ">="), ("households", f["households_min"], ">="), ("year", f["move_in_year_min"], ">=")]
        if f["area_band_label"] not in (None, r["band"]) or any(v is not None and (r[c] is None or not (r[c] <= v if op == "<=" else r[c] >= v)) for c, v, op in limits):
            continue
        up, down = (lambda c: inf if r[c] is None else r[c]), (lambda c: inf if r[c] is None else -r[c])
        key = []
        if f["prefer_park_hospital_access"]:
            key += [down("park"), down("hospital")]
        if f["prefer_near_subway"]:
            key.append(up("distance"))
        if f["prefer_low_price"]:
            key.append(up("price"))
        found.append(((*(key or [up("distance"), up("price"), down("households")]), r["doc_id"]), r))
    names = {}
    for _, r in sorted(found, key=lambda x: x[0]):
        names.setdefault(r["name"], r["doc_id"])
    return list(names.values())[:3]


@pytest.mark.parametrize("block", [7, 4096])
def test_best_names_of_all_orders(spark, block):
    rows, rng, asks = listing_rows(400), np.random.default_rng(8), []
    for q in range(120):
        some = lambda x, p=0.3: x if rng.random() < p else None
        f = dict(price_max_manwon=some(int(rng.integers(0, 20) * 10_000)), distance_subway_max_m=some(int(rng.integers(0, 1500))), exclusive_area_min=some(float(rng.integers(10, 160))), households_min=some(int(rng.integers(0, 3000))), move_in_year_min=some(int(rng.integers(2000, 2026))), prefer_low_price=bool(q & 1), prefer_near_subway=bool(q & 2), prefer_park_hospital_access=bool(q & 4), area_band_label=some("중형", 0.2))
        d = int(rng.integers(0, 12))
        score = some(str(rng.choice(["park", "hospital"])), 0.2)
        asks.append((q, f if not score else dict.fromkeys(f), score, some(f"s{d % 2}"), some(f"g{d % 4}"), some(f"d{d}")))
    asks += [(900 + i, *asks[i][1:]) for i in range(10)] + [(990, asks[0][1], None, "nowhere", None, None)]
    df = spark.createDataFrame([(q, tuple(f.values()), *rest) for q, f, *rest in asks], f"qid long, filters {FILTERS}, score string, sido string, sigungu string, dong string")
    found = recommend.best_of(df, spark.createDataFrame(rows, LISTING).repartition(3), block=block)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.row.doc_id)
    assert got == {q: best for q, f, *rest in asks if (best := brute(rows, f, *rest))}
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_questions_and_no_listing(spark):
    empty, some = spark.createDataFrame([], LISTING), spark.createDataFrame(listing_rows(5), LISTING)
    none = spark.createDataFrame([], f"qid long, filters {FILTERS}, score string, sido string, sigungu string, dong string")
    assert recommend.best_of(none, some).isEmpty()
    one = spark.createDataFrame([(1, (None,) * 5 + (False, False, False, None), None, None, None, None)], none.schema)
    assert recommend.best_of(one, empty).isEmpty() and recommend.best_of(one, some).count() == 1  # five listings of one name


def test_facts_by_asked_field(spark):
    rows = [("D1", "가나", "s", "g", "d", 84.0, None, 300.0, 1000, 2018, "중형", 8.0, 9.0, "2023-09-05"), ("D0", "가나", "s", "g", "d", None, 5.0, None, 7, 2019, "중형", None, 1.0, "2023-09-05")]
    asked = [(1, "가나 세대수와 전용면적"), (2, "가나 공급면적"), (3, "가나 가격"), (4, "가나 공원 병원")]
    know = spark.createDataFrame([], "term string, definition string, related_dataset_fields string, caution string")
    listing = spark.createDataFrame(rows, LISTING)
    parsed = route.parse(spark.createDataFrame(asked, "qid long, question string"), listing, know)
    got = {r.qid: r.answer.split("\n") for r in recommend.answers(parsed, listing, know).collect()}
    assert got[1] == ["가나 정보입니다.", "세대수: 7", "데이터 기준: 2023-09-05"]
    assert got[2] == ["가나 정보입니다.", "해당 항목 데이터가 없습니다", "데이터 기준: 2023-09-05"]
    assert got[3] == ["가나 정보입니다.", "공급액(만원): 5.0", "데이터 기준: 2023-09-05"]
    assert got[4] == ["가나 정보입니다.", "병원_접근지표: 1.0", "데이터 기준: 2023-09-05"]
