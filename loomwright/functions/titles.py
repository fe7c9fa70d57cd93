"""Titles, departments, labels and answers of models as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_phrase, blank_to_null, normalize_space, once, semantic_key

# --- fixed values: what ends a title, what is no title word, particles -------------------------------------------------
TITLE_LEAD = r"(?U)\A(닫기\s+)+"
TITLE_DELIMITERS = (" < ", " | ", " - ")
TITLE_MARKERS = ("작성자", "등록일", "조회수", "담당부서", "▢", "□", "○")
TITLE_DATES = (r"(?U)\s+\d{4}[.-]\d{2}[.-]\d{2}", r"(?U)\s+\d{2}[.-]\d{2}[.-]\d{2}")
TITLE_COUNTER, TITLE_BADGE, TITLE_EDGE = r"\d+\s+", r"\s*새글\s*", r" \-|·"
BRACKETED, PUNCTUATION = r"\[[^\]]*\]", r"[\"'“”‘’(){}·,\.!?~…\-–—/]"
COUNTED = r"\d+명이?|\d+개교?|\d+회|\d+차|\d+종"
OFFICES = ("교육청", "교육부")
REGIONS = ("경기", "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주", "전남광주")
TITLE_STOP_WORDS = (
    "학년도", "년도", "보도참고자료", "추진", "운영", "개최", "실시", "위한", "통해", "나서", "시작", "강화", "본격", "착수", "지원", "사업", "대한", "관련", "위해", "및", "등", "첫", "제", "교육감", "예정", "계획",
)
TITLE_SUFFIXES = (
    "으로서", "으로써", "에서의", "에게서", "에서", "에게", "으로", "이라는", "라는", "와의", "과의", "부터", "까지", "보다", "처럼", "마다", "조차", "이나", "거나",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "로", "라", "께",
)
MUNICIPALITY_SUBJECT = r"(?U)^\s*[가-힣]{2,6}(?:시|군|구)\s*[,，]"
SUPPORT_OFFICE = r"[가-힣]교육지원청"
# -------------------------------------------------------------------------------------------------------------------


def candidate_title(text: Column) -> Column:
    """A title without what list pages append to it: site names, metadata, dates, counters.

    A title's place is a span: it starts after a counter and ends at the first of what can follow it. The part before a
    site's delimiter counts as the text if it is long enough."""
    edges = f"[{TITLE_EDGE}]"

    def span(t: Column) -> Column:
        # 1-based places at which something else begins: a marker (where at least nine characters come before it), a date
        ends = F.array(*[F.nullif(F.locate(m, t), F.lit(0)) for m in TITLE_MARKERS])
        dates = F.array(*[F.nullif(F.regexp_instr(t, F.lit(d)), F.lit(0)) for d in TITLE_DATES])
        end = F.array_min(F.concat(F.filter(ends, lambda i: i > 9), dates))
        title = F.substring(t, F.lit(1), F.coalesce(end - 1, F.length(t)))
        return F.regexp_replace(normalize_space(F.regexp_replace(title, rf"(?U)\A{TITLE_COUNTER}|{TITLE_BADGE}\z", "")), rf"\A{edges}+|{edges}+\z", "")

    def before_site(t: Column) -> Column:
        parts = F.array(*[F.when(F.contains(t, F.lit(d)), F.trim(F.split_part(t, F.lit(d), F.lit(1)))) for d in TITLE_DELIMITERS])
        return F.coalesce(F.get(F.filter(parts, lambda p: F.length(p) >= 5), F.lit(0)), t)

    return once(F.regexp_replace(normalize_space(text), TITLE_LEAD, ""), lambda t: once(before_site(t), span))


def generic_title(text: Column, phrases: Sequence[str]) -> Column:
    t = normalize_space(text)
    return (F.length(t) < 5) | any_phrase(t, phrases)


def first_title(candidates: Column, phrases: Sequence[str], otherwise: str = "") -> Column:
    """The first of an array of candidates that says something."""
    good = F.filter(F.transform(candidates, candidate_title), lambda t: ~generic_title(t, phrases))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(otherwise))


def title_words(title: Column) -> Column:
    """The distinct words by which titles are compared: no brackets, offices, regions, counts, particles, common words.

    One pattern tells what is no word; what is left of a word without digits before and a particle after it, if that is two
    characters or more, counts unless it is a common word."""
    no_word = rf"\A(?:\d+|{COUNTED})?\z|" + "|".join((*REGIONS, *OFFICES))
    stem = rf"\A\d*(.{{2,}}?)(?:{'|'.join(TITLE_SUFFIXES)})?\z"
    spoken = F.split(F.regexp_replace(title, f"{BRACKETED}|{PUNCTUATION}", " "), r"(?U)\s+")
    stems = F.transform(F.filter(spoken, lambda w: ~F.rlike(w, F.lit(no_word))), lambda w: F.regexp_extract(w, stem, 1))
    return F.array_distinct(F.filter(stems, lambda w: (w != "") & ~w.isin(list(TITLE_STOP_WORDS))))


def query_words(words: Column, n: int = 3) -> Column:
    """The n longest words in the order in which they stand; of equals, the first."""
    ranked = F.slice(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("k"), i.alias("i"), w.alias("w")))), 1, n)
    return F.transform(F.array_sort(F.transform(ranked, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"])


def other_office(title: Column, own: Sequence[str]) -> Column:
    """Whether a municipality is a title's subject and none of our own words occurs."""
    return F.rlike(title, F.lit(MUNICIPALITY_SUBJECT)) & ~any_phrase(title, own)


def support_office(title: Column) -> Column:
    return F.rlike(title, F.lit(SUPPORT_OFFICE))


def department(name: Column, aliases: dict[str, str]) -> Column:
    """A department under its present name."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), name) if aliases else name


def without_repeated_title(text: Column, title: Column) -> Column:
    """A text that begins with its title, in whatever spacing and punctuation, begins after it."""
    key = semantic_key(F.regexp_replace(title, r"^\[[^\]]+\]", ""))
    pattern = F.concat(F.lit(r"(?U)^\s*\Q"), F.array_join(F.split(key, "(?!^)"), r"\E[^0-9A-Za-z가-힣]*\Q"), F.lit(r"\E(?:\s+|$)"))
    return F.when((F.length(key) >= 8) & F.startswith(semantic_key(text), key), F.regexp_replace(text, F.concat(F.lit("(?i)"), pattern), F.lit(""))).otherwise(text)


def json_answer(text: Column, schema: str) -> Column:
    """The object in a model's answer, inside a fence or between the outermost braces; null if there is none."""
    fenced = blank_to_null(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1))
    braces = blank_to_null(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.from_json(F.coalesce(fenced, braces), schema)


def prompt(template: str, **values: Column) -> Column:
    """A template with {{NAME}} replaced by each row's values."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name.upper() + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def period_label(start: Column, end: Column) -> Column:
    """A window in hours."""
    return F.concat(F.round((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600).cast("int").cast("string"), F.lit("시간"))
