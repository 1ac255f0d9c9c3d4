from pyspark.sql import functions as F

from evidence_engine.functions import clean as K
from evidence_engine.functions import derive as D


def values(spark, f, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_missing_words_and_unicode_space(spark):
    assert values(spark, K.nullify, [None, "", " nan ", "NULL", "null", "None", "　 ", " a "]) == [None] * 7 + ["a"]


def test_numbers(spark):
    given = ["1,234만원", "84.9㎡", "5d", "1e3", "inf", "nan", "", None, "-3.5", ".5", " 7 세대", "12km"]
    assert values(spark, K.clean_numeric, given) == [1234.0, 84.9, None, 1000.0, None, None, None, None, -3.5, 0.5, 7.0, 12.0]


def test_bools(spark):
    assert values(spark, K.to_bool, ["True", " 적용", "n", "비해당", "1.0", "0", "2", "예", None, "null"]) == [True, True, False, False, True, False, None, None, None, None]
    assert values(spark, K.flag, ["y", " N ", "maybe", None]) == ["Y", "N", "", ""]


def test_address(spark):
    got = values(spark, K.address, ["서울 송파구 가락동 1 2", "경기 수원시  팔달구 인계동", "세종 한솔동", "부산", None, " nan "])
    assert [tuple(r) for r in got] == [("서울", "송파구", "가락동", "1 2", True), ("경기", "수원시 팔달구", "인계동", None, True), ("세종", "한솔동", None, None, False), ("부산", None, None, None, False), (None, None, None, None, False), (None, None, None, None, False)]


def test_lists_and_tokens(spark):
    assert values(spark, K.line_list, ["['2호선', '8호선', '2호선']", "2호선, nan,", "[]", None]) == [["2호선", "8호선"], ["2호선"], [], []]
    assert values(spark, lambda c: K.pipe_values(c, 2), ["a| |b|c", "", None]) == [["a", "b"], [], []]
    assert values(spark, K.tokens, ["Foo, foo  바!", "…", None]) == [["foo", "바"], [], None]


def test_rounding_is_half_even_on_the_binary_value(spark):
    xs = [0.125, 2.675, 1.005, -0.5, 2.5, 1234.55]
    assert values(spark, lambda c: K.py_round(c, 2), xs, "double") == [round(x, 2) for x in xs]
    assert values(spark, K.py_round, xs, "double") == [float(round(x)) for x in xs]
    assert values(spark, lambda c: K.format_number(c, 2), [1234567.891, None], "double") == ["1,234,567.89", None]


def test_clip(spark):
    assert values(spark, lambda c: K.clip(c, 5), ["abcde", "abcdef", "abc def", None]) == ["abcde", "abcd…", "abc…", None]


def test_disclosure_profiles_differ(spark):
    said = ["데이터 기준 알림", "판단 할 수 없습니다", None]
    assert values(spark, lambda c: K.disclosed(c, "gate"), said) == [True, False, False]
    assert values(spark, lambda c: K.disclosed(c, "eval"), said) == [False, False, False]
    assert values(spark, lambda c: K.disclosed(c, "sft"), said) == [False, True, False]


def test_labels_at_their_limits(spark):
    assert values(spark, D.area_band, [39.9, 40.0, 60.0, 85.0, 120.0, None], "double") == ["소형", "중소형", "중형", "중대형", "대형", "면적 정보 없음"]
    low, high = F.lit(1.0), F.lit(2.0)
    assert values(spark, lambda c: D.three_way(c, low, high, ("none", "high", "low", "mid")), [1.0, 1.5, 2.0, None], "double") == ["low", "mid", "high", "none"]
    assert values(spark, lambda c: D.cutoff(c), ["/x/apartment_20230905.csv", "/x/data.csv"]) == ["2023-09-05", "기준일 미상"]


def test_transfer_bonus_and_policy(spark):
    df = spark.createDataFrame([(663.6, 2, "예", "Y", "n"), (None, 2, "예", "Y", "Y"), (1500.0, None, "1", None, None)], "d double, n int, t string, a string, b string")
    got = df.select(D.subway_score(F.col("d"), F.col("n"), F.col("t")).alias("s"), D.subway_score(F.col("d"), F.col("n"), F.col("t"), True).alias("k"), D.policy_text(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.s for r in got] == [436.4, None, 75.0] and [r.k for r in got] == [511.4, None, 75.0]
    assert got[0].p == "분양 당시 투기과열지구 단지입니다." and got[1].p == "분양 당시 투기과열지구 및 현재 투기과열지구 단지입니다." and got[2].p == "정책상 특이사항은 확인되지 않았습니다."
