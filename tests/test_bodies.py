"""Bodies of releases: headers, titles, bundles, subtitles and own summaries."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions import bodies as B


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


HEADERS = [
    ("학생 안전 대응 강화", "보도자료\n2026. 7. 15.\n담당부서 교육안전과\n학생 안전 대응 강화\n경북교육청은 안전시스템을 운영한다.", "경북교육청은 안전시스템을 운영한다."),
    ("[교육안전과]경북교육청, '안전하이' 구축...학생 안전 강화", "보도자료\n담당부서 교육안전과\n경북교육청, ‘안전하이’ 구축…학생 안전 강화\n경북교육청은 시스템을 정식 운영한다.", "경북교육청은 시스템을 정식 운영한다."),
    ("A title of some words", "head\nA  title\nof some-words\nthe first body, a title OF some words and what follows", "and what follows"),  # the last place
    ("A title of some words", "head\nA title of some words\nlong enough a body\nA title of some words\nshort", "long enough a body\nA title of some words\nshort"),  # with something after it
    ("A title of some words here", "head\nA title of some words\nthe body that follows", "the body that follows"),  # a line that holds most of it
    ("A title of some words here", "head\nA title of\nthe body that follows", "head\nA title of\nthe body that follows"),  # less than 0.6 of it
    ("short", "short\na body that is long enough", "short\na body that is long enough"),
    ("A title of some words", "A title of some words", "A title of some words"),
    ("100% (a.b) [c]? \\E end", "x\n100% (a.b) [c]? \\E end\r\n  the body   comes after", "the body comes after"),
]


@pytest.mark.parametrize("title,text,want", HEADERS)
def test_header_goes(spark, title, text, want):
    assert one(spark, text, B.without_header(F.col("t"), F.lit(title))) == want


TITLES = [
    ("인천광역시교육청, 부평 특수학교 설립 추진", "인천광역시교육청 , 부평 특수학교 설립 추진\n인천광역시교육청은 주민 협의회를 개최했다.", "인천광역시교육청은 주민 협의회를 개최했다."),
    ("a title, twice said", "a title, twice said a ti tle,twice said and a body", "and a body"),
    ("a title, thrice", "a title, thrice a title, thrice a title, thrice and", "and"),  # two in spacing, one in punctuation
    ("[label] a title of words", "a title - of words. And the body", "a title - of words. And the body"),  # a mark right after it
    ("[label] a title of words", "a title - of words And the body", "And the body"),
    ("title", "title and body", "title and body"),
    ("a title of words", "a title of wordsmiths", "a title of wordsmiths"),
    ("a title of words", "a title of words", ""),
    ("a\\Eb.c(d)e$f", "a\\Eb.c(d)e$f rest", "rest"),
]


@pytest.mark.parametrize("title,text,want", TITLES)
def test_repeated_title_goes(spark, title, text, want):
    assert one(spark, text, B.without_title(F.col("t"), F.lit(title))) == want


def test_titles_as_long_as_texts(spark):
    import random

    title = " ".join(f"word{i}" for i in range(20_000))
    assert one(spark, f"head\n{title}\nthe body that follows", B.without_header(F.col("t"), F.lit(title))) == "the body that follows"
    assert one(spark, f"{title} and the body", B.without_title(F.col("t"), F.lit(title))) == "and the body"
    assert one(spark, f"{title}, and the body", B.without_title(F.col("t"), F.lit(f"[label] {title}"))) == f"{title}, and the body"
    assert one(spark, title.replace(" ", " - ") + " and the body", B.without_title(F.col("t"), F.lit(f"[label] {title}"))) == "and the body"
    lines = "a title of words\n" * 20_000
    assert one(spark, lines, B.without_header(F.col("t"), F.lit("a title of words"))) == "a title of words"
    dice = random.Random(1)  # few words, so that titles stand at many places and near the end
    texts = ["".join(dice.choice(["abcd", "efgh", "x", " ", "\n", "-"]) for _ in range(dice.randint(1, 40))) for _ in range(400)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", B.without_header(F.col("t"), F.lit("abcd-efgh")).alias("x")).collect():
        assert r["x"] == header_by_hand(r["t"], "abcdefgh"), r["t"]


def header_by_hand(text, key):
    import re

    clean = lambda x: "\n".join(w for w in (" ".join(y.split()) for y in x.split("\n")) if w)
    t, between = clean(text), "[^0-9a-z]*"
    rests = [clean(t[m.end() :]) for m in re.finditer(between.join(key), t)]
    rests = [x for x in rests if len(x) >= 10]
    bare, lines = (lambda x: re.sub("[^0-9a-z]", "", x)), t.split("\n")
    titled = [clean("\n".join(lines[i + 1 :])) for i, x in enumerate(lines) if len(bare(x)) >= 8 and (key in bare(x) or bare(x) in key)]
    return ([*rests[-1:], *[x for x in titled if len(x) >= 10][:1], t])[0]


def test_source_without_name(spark, tmp_path):
    from loomwright.plans.releases import bodies_without_header

    spark.createDataFrame([(1, "head\na title of words\nthe body that follows", None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bodies_without_header(spark, str(tmp_path)).first()["n"] == len("the body that follows")


def test_null_and_empty_bodies(spark):
    for f in (B.without_title, B.without_header):
        assert one(spark, None, f(F.col("t"), F.lit("a title of words"))) == "" and one(spark, "body", f(F.col("t"), F.lit(None).cast("string"))) == "body"
    assert one(spark, None, B.own_summary(F.col("t"), F.lit(None).cast("string"))) == ["보도자료"]
    assert one(spark, None, B.subtitle(F.col("t"), F.lit("title"), "#")) is None
    assert one(spark, None, B.bundle_sections(F.col("t"))) == [] and one(spark, None, B.section_title(F.col("t"), F.lit("fall back"))) == "fall back"


def test_attachment_replaces_boilerplate(spark):
    html = "보도자료 게시판 상세보기 테이블 작성자 등록일 카테고리 첨부파일 다운로드 횟수"
    file = "경북교육청은 통합 기상상황판을 구축해 학교의 기상 재난 대응 체계를 강화한다고 밝혔다."
    got = one(spark, html, B.chosen_summary(F.lit("통합 기상상황판 구축"), F.col("t"), F.lit(file), F.lit(True)))
    assert got["origin"] == "attachment" and "기상 재난 대응 체계" in got["summary"]
    long = "a page that says enough of itself. " * 10
    assert one(spark, long, B.chosen_summary(F.lit("some other title"), F.col("t"), F.lit("short file"), F.lit(True)))["origin"] == "html"
    # a preferred file of 120 characters wins over a better page, and loses its header
    file = "HEAD\nsome other title\n" + "file text " * 13
    got = one(spark, long, B.chosen_summary(F.lit("some other title"), F.col("t"), F.lit(file), F.lit(True)))
    assert (got["origin"], got["summary"]) == ("attachment", ("file text " * 13).strip())
    assert one(spark, long, B.chosen_summary(F.lit("some other title"), F.col("t"), F.lit(file), F.lit(False)))["origin"] == "html"


def test_subtitle_is_the_line_least_like_the_title(spark):
    document = "# 학교 급식 개선\n# 학교 급식 현장 점검 나서\n# 새로운 식단 도입과 알레르기 관리\n# 짧음\nno marker at all\n# 다른 주제의 소식 하나"
    assert one(spark, document, B.subtitle(F.col("t"), F.lit("학교 급식 개선"), "#")) == "새로운 식단 도입과 알레르기 관리"
    assert one(spark, "# 학교 급식 개선 안내", B.subtitle(F.col("t"), F.lit("학교 급식 개선"), "#")) is None


def test_own_summary(spark):
    first, second = "전북교육청은 학생 안전을 위한 새로운 체계를 마련했다.", "학교마다 담당자를 두고 매월 점검한다."
    body = f"◦ {first} {first}\n* English footnote only here\n- {second}\n○ 세 번째 문장은 여기에 더 이상 들어가지 않는다."
    assert one(spark, body, B.own_summary(F.col("t"), F.lit("제목"))) == [first, second]
    assert one(spark, body, B.own_summary(F.col("t"), F.lit(first)))[0] == second  # the title itself is no point
    long = "가나다라마바사아자차 " * 20
    got = one(spark, long, B.own_summary(F.col("t"), F.lit("제목")))
    assert got[0].endswith("...") and len(got[0]) <= 140
    assert one(spark, "only English here", B.own_summary(F.col("t"), F.lit("제목"))) == ["only English here"]
    assert one(spark, " - ", B.own_summary(F.col("t"), F.lit("제목"))) == ["제목"]


def section(name, n):
    return f"{name} 학교에서 행사 개최\n" + "본문이 이어진다. " * n


def test_bundle(spark):
    text = f"1. {section('인천', 20)}\n 2.\n{section('부평도서관', 20)}\n3. 그냥 목록\n4. {section('계양 학교', 2)}\n10. {section('연수 교육청', 20)}"
    got = one(spark, text, B.bundle_sections(F.col("t")))
    # 3 names no institution; 4 is too short, but counts; numbers are places
    assert [(s["index"], s["total"]) for s in got] == [(1, 4), (2, 4), (4, 4)]
    assert got[0]["section"].startswith("인천 학교에서") and got[1]["section"].startswith("부평도서관") and "그냥 목록" in got[1]["section"]
    titles = [one(spark, s["section"], B.section_title(F.col("t"), F.lit("x"))) for s in got]
    assert titles == ["인천 학교에서 행사 개최", "부평도서관 학교에서 행사 개최", "연수 교육청 학교에서 행사 개최"]
    assert one(spark, f"1. {section('인천', 20)}", B.bundle_sections(F.col("t"))) == []


def test_section_titles(spark):
    of = lambda t: one(spark, t, B.section_title(F.col("t"), F.lit("fall , back")))
    assert of("인천교육청 ,\n‘ 안전 ’ 주간 12 일 운영\n인천교육청은") == "인천교육청, ‘안전’ 주간 12일 운영"  # what precedes its first line's return
    assert of("첫 줄\n둘째 줄\n셋째 줄 확대\n넷째") == "첫 줄 둘째 줄 셋째 줄 확대"
    assert of("어떤 줄이 길게 이어지고 끝나지 않으며 계속\n둘째 줄도 역시 길게 이어지고 끝나지 않으며 계속된다") == "어떤 줄이 길게 이어지고 끝나지 않으며 계속 둘째 줄도 역시 길게 이어지고 끝나지 않으며 계속된다"
    assert of("끝이 없는 줄") == "끝이 없는 줄" and of("") == "fall, back"
