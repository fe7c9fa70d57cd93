"""Dates and moments against a table of forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwright.functions import dates as D

TODAY = dt.date(2026, 8, 20)
FORMS = {
    "등록일 2026. 8. 3. 조회 12": "2026-08-03", "2026년 8월 3일": "2026-08-03", "2026-08-03T09:00": "2026-08-03", "2026/8/3": "2026-08-03", "26-08-03 게시": "2026-08-03", "26.8.3": "2026-08-03",
    "posted 3 August 2026": "2026-08-03", "Aug 3, 2026 by x": "2026-08-03", "August 3rd 2026": "2026-08-03", "the 3rd of Aug. 2026": "2026-08-03", "3-Aug-26": "2026-08-03", "2026 Aug 3": "2026-08-03",
    "20260803": "2026-08-03", "08/03/2026": "2008-03-20", "8/3/2026": "2026-08-03", "1999-12-31": "2099-12-31", "Dec 31 '99": "1999-12-31", "Aug 2026": "2026-08-20", "Mon, 03 Aug 2026 09:00:00 +0900": "2026-08-03",
    # (years of two digits are looked for before the looser forms, inside others too)
    # no such day: on to the next form, and at last to the run's
    "2026-13-40": "2026-08-20", "2026.02.30": "2026-08-20", "2026-02-30, 26.3.1": "2026-08-20", "Feb 30, 2026": "2026-08-20", "2026-02-30 / March 1, 2026": "2026-03-01", "": "2026-08-20", "no date": "2026-08-20", "maybe 5": "2026-08-20",
}


def test_forms_of_dates(spark):
    df = spark.createDataFrame([(t,) for t in FORMS] + [(None,)], "t string")
    got = {r[0]: str(r[1]) for r in df.select("t", D.any_date(F.col("t"), F.lit(TODAY))).collect()}
    assert got == FORMS | {None: "2026-08-20"}


MOMENTS = {
    "2026-08-03": "2026-08-02T15:00:00", "2026-08-03 09:30": "2026-08-03T00:30:00", "2026-08-03T09:30:15": "2026-08-03T00:30:15", "2026-08-03T09:30:15.250Z": "2026-08-03T09:30:15.250000", "2026-08-03T09:30:15+09:00": "2026-08-03T00:30:15",
    "2026-08-03T09:30:15-0500": "2026-08-03T14:30:15", "2026.08.03 09:30": "2026-08-03T00:30:00", "Mon, 03 Aug 2026 09:30:15 GMT": "2026-08-03T09:30:15", "3 Aug 2026 09:30 +0100": "2026-08-03T08:30:00", "2026-08-03 09:30 KST": "2026-08-03T00:30:00",
    "2026-02-30": None, "2026-08-03T25:00": None, "soon": None, "": None, None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_moments_in_any_session(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in MOMENTS], "t string")
        got = {r["t"]: r["u"] for r in df.select("t", F.unix_micros(D.moment(F.col("t"))).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    micros = lambda s: None if s is None else round((dt.datetime.fromisoformat(s) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert got == {t: micros(s) for t, s in MOMENTS.items()}
