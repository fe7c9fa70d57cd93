"""Contracts of report agents, checks of report items, and merging of issues, as Column expressions.

An issue is struct<field string, pointIndex int, code string>; pointIndex is -1 where an issue is about a whole field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number_set, repaired

# --- fixed values: lengths, counts and phrases that decide results ---------------------------------------------------
POINT_LENGTH = 320
OWN_POINT_LENGTH = 140
LONG_COPY = 80
FACT_SECTIONS = (("summaryPoints", 1, 5), ("sourceFacts", 1, 8))
OWN_SECTIONS = (("summaryPoints", 1, 2),)
ANALYSIS_SECTIONS = (("analysisPoints", 1, 5), ("applicationReviewPoints", 0, 5))
REPORT_SECTIONS = (("summaryPoints", 1, 5), ("analysisPoints", 1, 5), ("applicationReviewPoints", 0, 5))
REVIEW_SECTION = "applicationReviewPoints"
DEPARTMENT_ASSIGNMENT = r"(관련|담당|주관)\s*부서|[가-힣]{2,15}(과|담당관|팀)\s*(에서|이|가|은|는)?\s*(담당|추진|검토)"
OVERSTATEMENT = r"반드시|즉시\s*도입|전면\s*도입해야|확정해야|의무화해야"
# -------------------------------------------------------------------------------------------------------------------
ISSUES = "array<struct<field:string,pointIndex:int,code:string>>"


def issue(field: Column | str, index: Column | int, code: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(field).alias("field"), lit(index).cast("int").alias("pointIndex"), lit(code).alias("code"))


def _kept(array: Column) -> Column:
    return F.coalesce(F.array_compact(array), F.array().cast(ISSUES))


def point_errors(points: Column, field: str, least: int, most: int, longest: int = POINT_LENGTH) -> Column:
    """MISSING, COUNT, EMPTY and LONG issues of a section's points."""
    whole = F.array(F.when(points.isNull(), issue(field, -1, "MISSING")), F.when(~F.size(points).between(least, most) & points.isNotNull(), issue(field, -1, "COUNT")))
    size = lambda p: F.length(F.regexp_replace(F.coalesce(p, F.lit("")), r"(?U)^\s+|\s+$", ""))
    each = F.transform(points, lambda p, i: F.when(size(p) == 0, issue(field, i, "EMPTY")).when(size(p) > longest, issue(field, i, "LONG")))
    return _kept(F.concat(whole, F.coalesce(each, F.array().cast(ISSUES))))


def agent_errors(sections: tuple[tuple[str, int, int], ...], confidence: Column, longest: int = POINT_LENGTH) -> Column:
    """What breaks the contract of an agent that answers sections of points with a confidence from 0 to 1."""
    own = F.array(F.when(~F.coalesce(confidence.between(0, 1), F.lit(False)), issue("confidence", -1, "RANGE")))
    return _kept(F.concat(*[point_errors(F.col(c), c, a, b, longest) for c, a, b in sections], own))


def verification_errors(status: Column, issues: Column, confidence: Column) -> Column:
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    return _kept(F.array(F.when(bad(status.isin("PASS", "REVISE")), issue("status", -1, "STATUS")), F.when(issues.isNull(), issue("issues", -1, "MISSING")), F.when(bad(confidence.between(0, 1)), issue("confidence", -1, "RANGE"))))


def normalized(points: Column) -> Column:
    return F.transform(points, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))


def section_checks(points: Column, field: str, body: Column) -> Column:
    """LONG_COPY, DEPARTMENT_ASSIGNMENT, OVERSTATEMENT (in the review section) and UNSUPPORTED_NUMBER (in the others), point by point."""

    def of(p: Column, i: Column) -> Column:
        new = F.filter(F.array_except(number_set(p), number_set(body)), lambda n: F.length(n) >= 2)
        last = F.rlike(p, F.lit(OVERSTATEMENT)) if field == REVIEW_SECTION else F.size(new) > 0
        rules = (("LONG_COPY", (F.length(p) >= LONG_COPY) & F.contains(body, p)), ("DEPARTMENT_ASSIGNMENT", F.rlike(p, F.lit(DEPARTMENT_ASSIGNMENT))), ("OVERSTATEMENT" if field == REVIEW_SECTION else "UNSUPPORTED_NUMBER", last))
        return F.array(*[F.when(bad, issue(field, i, code)) for code, bad in rules])

    return _kept(F.flatten(F.transform(normalized(points), of)))


def item_issues(body: Column, sections: tuple[tuple[str, int, int], ...] = REPORT_SECTIONS) -> Column:
    """All issues of an item that a row can tell; repeated points are found by operators.points.repeated_points()."""
    formats = [F.transform(point_errors(F.col(c), c, a, b), lambda x: issue(x["field"], x["pointIndex"], "FORMAT")) for c, a, b in sections]
    return F.concat(*formats, *[section_checks(F.col(c), c, body) for c, _, _ in sections])


def merged_issues(own: Column, status: Column, issues: Column, verified: Column) -> Column:
    """The issues of our checks and a verifier's; an item that no verifier answered, or that it refused without a word, has
    one issue about the whole."""
    whole = F.array(issue("item", -1, "OTHER"))
    theirs = F.transform(F.coalesce(issues, F.array().cast(ISSUES)), lambda x: issue(F.coalesce(x["field"], F.lit("item")), F.coalesce(x["pointIndex"], F.lit(-1)), F.coalesce(x["code"], F.lit("OTHER"))))
    silent = (F.coalesce(status, F.lit("")) != "PASS") & (F.size(theirs) == 0)
    return F.concat(own, F.when(~verified | silent, whole).otherwise(theirs))


# --- fixed values: what a fragment of a press release is rid of, in this order ------------------------------------------
FRAGMENT_REPAIRS = (
    (r"(?U)^[\-–—·•*\s]+", ""),
    (r"(?U)[\-–—·•\s]+$", ""),
    (r"(?U)\s+", " "),
    (r"(?U)\s+([,\.\’”\)\]%])", "$1"),
    (r"(?U)([‘“\(\[])\s+", "$1"),
    (r"(?U)(\d)\s+(?=[가-힣])", "$1"),
    (r"(?U)~\s+(\d)", "~$1"),
)
# -------------------------------------------------------------------------------------------------------------------


def clean_fragment(text: Column) -> Column:
    """A fragment of a press release without bullets, dashes and broken spaces."""
    return F.trim(repaired(text, FRAGMENT_REPAIRS))


def rule_relevance(personnel: Column, system: Column, local: Column, once: Column) -> tuple[Column, Column]:
    """decision and scope by rule, where no model answered: appointments go, and single events of one institution."""
    return F.when(personnel | (~system & local & once), "DROP").otherwise("KEEP"), F.when(local, "institution").otherwise("provincial")
