"""Title, department and answer rules."""

from pyspark.sql import functions as F

from loomwright.functions import titles as T


def one(spark, value, *exprs):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*exprs).first())


def test_candidate_titles(spark):
    cases = {
        "닫기 닫기 새로운 정책을 발표하다 < 보도자료 < 교육청": "새로운 정책을 발표하다", "12 학교 급식을 바꾼다 2026.08.03 조회": "학교 급식을 바꾼다", "새 학기 준비를 마치다 작성자 홍길동": "새 학기 준비를 마치다",
        "abc - 너무 짧은 왼쪽 - 둘": "abc - 너무 짧은 왼쪽 - 둘", "행사 안내문 게시 새글": "행사 안내문 게시",
    }
    for raw, want in cases.items():
        assert one(spark, raw, T.candidate_title(F.col("t"))) == (want,)


def test_first_title(spark):
    assert one(spark, "x", T.first_title(F.array(F.lit("abc"), F.lit("보도자료 목록"), F.lit("진짜 제목입니다")), ["목록"])) == ("진짜 제목입니다",)
    assert one(spark, "x", T.first_title(F.array().cast("array<string>"), ["목록"], "none")) == ("none",)


def test_title_words(spark):
    got = one(spark, "[보도] 서울시교육청, 2026학년도 검정고시에서 합격자를 312명 발표", T.title_words(F.col("t")))[0]
    assert got == ["학년", "검정고시", "합격자", "발표"]


def test_query_words(spark):
    assert one(spark, "aa bbbb cc dddd eeee fffff", T.query_words(F.split("t", " "))) == (["bbbb", "dddd", "fffff"],)


def test_offices(spark):
    assert one(spark, "익산시, 청렴문화 확산", T.other_office(F.col("t"), ["교육청"]), T.support_office(F.col("t"))) == (True, False)
    assert one(spark, "익산시, 교육청과 협약", T.other_office(F.col("t"), ["교육청"]), T.support_office(F.lit("전주교육지원청 개소"))) == (False, True)
    assert one(spark, "A", T.department(F.col("t"), {"A": "B"}), T.department(F.lit("C"), {"A": "B"})) == ("B", "C")


def test_repeated_title_goes(spark):
    assert one(spark, "긴 제목이, 여기 (있다) 본문이 시작된다", T.without_repeated_title(F.col("t"), F.lit("[속보] 긴 제목이 여기 있다"))) == ("본문이 시작된다",)
    assert one(spark, "다른 본문", T.without_repeated_title(F.col("t"), F.lit("긴 제목이 여기 있다"))) == ("다른 본문",)


def test_answers_and_prompts(spark):
    assert one(spark, 'Sure:\n```json\n{"a": 1}\n```', T.json_answer(F.col("t"), "a int"))[0]["a"] == 1
    assert one(spark, "no object", T.json_answer(F.col("t"), "a int")) == (None,)
    assert one(spark, "x", T.prompt("Rate {{ITEM}} now", item=F.col("t"))) == ("Rate x now",)
