"""Text rules as Column expressions: all of them stay in the JVM and in one projection.

Patterns start with (?U) where white space, digits or letters beyond ASCII count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: phrases, particles and stop words that decide results -------------------------------------------
BOILERPLATE_PHRASES = (
    "본문 바로가기", "본문바로가기", "메뉴열기", "전체메뉴", "QUICK MENU", "보도자료 게시판 상세보기 테이블", "이 보도자료의 첨부파일을 확인해 보세요", "첨부파일 다운로드 횟수", "개인정보처리방침",
    "콘텐츠 만족도 조사",
)
HARD_FAILURE_PHRASES = ("QUICK MENU", "본문 바로가기", "본문바로가기", "보도자료 게시판 상세보기 테이블", "이 보도자료의 첨부파일을 확인해 보세요")
SUMMARY_MARKS = ("다.", "했다.", "밝혔다", "추진", "지원")
# -------------------------------------------------------------------------------------------------------------------


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_value(*cols: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """Whether one of the phrases occurs, letter by letter."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def semantic_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z가-힣]", ""))


def has_repeated_title(text: Column, title: Column) -> Column:
    key = semantic_key(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\[[^\]]+\]", ""))
    return once(key, lambda k: F.when(F.length(k) >= 8, F.startswith(semantic_key(text), k)).otherwise(False))


def times(text: Column, part: str) -> Column:
    """How often a part occurs without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def quality_score(text: Column, title: Column, marks: Sequence[str] = SUMMARY_MARKS, boilerplate: Sequence[str] = BOILERPLATE_PHRASES) -> Column:
    """Long texts with sentence marks score high; boilerplate, a repeated title and shortness cost; no text is -1000."""
    def scored(t: Column, low: Column) -> Column:
        score = F.least(F.length(t), F.lit(1200)) + F.least(F.lit(300), sum((times(t, m) for m in marks), F.lit(0)) * 30)
        for p in boilerplate:
            score = score - F.when(F.contains(low, F.lit(p.lower())), 350).otherwise(0)
        score = score - F.when(has_repeated_title(text, title), 120).otherwise(0) - F.when(F.length(t) < 120, 500).otherwise(0)
        return F.when(t == "", -1000).otherwise(score).cast("int")

    return once(normalize_space(text), lambda t: once(F.lower(t), lambda low: scored(t, low)))


def low_quality(text: Column, title: Column, hard: Sequence[str] = HARD_FAILURE_PHRASES, marks: Sequence[str] = SUMMARY_MARKS, boilerplate: Sequence[str] = BOILERPLATE_PHRASES) -> Column:
    def weak(t: Column, low: Column) -> Column:
        hits = sum((F.contains(low, F.lit(p.lower())).cast("int") for p in boilerplate), F.lit(0))
        return (F.length(t) < 120) | any_phrase(low, [p.lower() for p in hard]) | (hits >= 2) | (quality_score(text, title, marks, boilerplate) < 100)

    return once(normalize_space(text), lambda t: once(F.lower(t), lambda low: weak(t, low)))


def stable_id(source: Column, url: Column) -> Column:
    return F.concat(source, F.lit("-"), F.substring(F.sha1(url), 1, 16))


def number_set(text: Column) -> Column:
    """The distinct numbers of a text, without thousands separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def publisher_of(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def query_value(url: Column, name: str) -> Column:
    """A query parameter's value, the empty string if it is missing."""
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def keyword_list(text: Column) -> Column:
    """Keywords separated by lines or commas, without blanks."""
    return F.filter(F.transform(F.split(text, "[\n,]"), lambda w: F.trim(w)), lambda w: w != "")


def stars(importance: Column) -> Column:
    n = F.least(F.greatest(F.coalesce(importance, F.lit(1)), F.lit(1)), F.lit(5))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def korean_fragment(text: Column) -> Column:
    """15 characters or more, 10 Hangul syllables or more, and these at least half of what is no white space."""
    n = F.length(F.regexp_replace(text, "[^가-힣]", ""))
    return (F.length(text) >= 15) & (n >= 10) & (n * 2 >= F.length(compact(text)))


def body_issues(body: Column, least_chars: int, boilerplate: Sequence[str]) -> Column:
    """Codes of what is wrong with a body."""
    t = normalize_space(body)
    hits = sum((F.contains(F.lower(t), F.lit(p.lower())).cast("int") for p in boilerplate), F.lit(0))
    return F.array_compact(F.array(F.when(F.length(t) < least_chars, F.lit("SHORT")), F.when(hits >= 2, F.lit("BOILERPLATE"))))


# --- fixed values: what a body is rid of, in this order ---------------------------------------------------------------
BODY_REPAIRS = (
    (r"\A\s*[-–—]\s*[^\n]{4,70}?\s*[-–—]\s*(?=\n)", ""),
    (r"(?U)(\d)\s*\n\s*", "$1"),
    (r"[◦□○▪▫■●▲△▶◆➀-➉①-⑳※▸▹‣·]", " "),
    (r"(?Um)^\s*[-–—]\s+", " "),
    (r"(?U)\*\s*[A-Za-z][^\n]*", " "),
    (r"\n", " "),
    (r"(?U)(\d)\s+(?=[가-힣%])", "$1"),
    (r"(?U)~\s+(\d)", "~$1"),
    (r"(?U)\(\s+", "("),
    (r"(?U)\s+\)", ")"),
    (r"(?U)(?<=[가-힣])\s+\((?=[가-힣])", "("),
    (r"(?U)\s+([,.’”%])", "$1"),
    (r"(?U)([‘“])\s+", "$1"),
    (r"(?U)\s{2,}", " "),
)
# -------------------------------------------------------------------------------------------------------------------


def repaired(text: Column, repairs: Sequence[tuple[str, str]]) -> Column:
    """A text after replacements in their order."""
    for pattern, to in repairs:
        text = F.regexp_replace(text, pattern, to)
    return text


def clean_body(text: Column) -> Column:
    """Broken bodies in sentences: numbers joined with their units, bullets, dashes and foreign footnotes gone."""
    out = repaired(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), BODY_REPAIRS)
    return F.regexp_replace(out, r"(?U)\A\s+|\s+\z", "")


def date_in(text: Column) -> Column:
    """The first date of a text: four- or two-digit year, month and day, with the usual separators; null if there is none."""
    long = F.regexp_extract(text, r"(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})", 0)
    short = F.regexp_extract(text, r"(?<!\d)(\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})", 0)
    parts = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^\d]+", "-"), "^-|-$", "")
    a = F.when(long != "", F.try_to_date(parts(long), "yyyy-M-d"))
    b = F.when(short != "", F.try_to_date(F.concat(F.lit("20"), parts(short)), "yyyy-M-d"))
    return F.coalesce(a, b)
