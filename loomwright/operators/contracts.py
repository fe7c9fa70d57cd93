"""Contracts of batch agents, guards over their decisions, rule fallbacks, and a bounded repair loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_phrase
from .lineage import checkpointing

# --- fixed values: the ceiling of importance for each level of change ------------------------------------------------
CHANGE_LEVEL_CAPS = {"routine_operation": 2, "project_change": 3, "policy_change": 4, "system_change": 5}
# -------------------------------------------------------------------------------------------------------------------


def calibrated(score: Column, level: Column, facility: Column, structural: Column) -> tuple[Column, Column, Column]:
    """Importance within 1 to 5 and its level's ceiling, the level, and whether either was changed."""
    known = F.when(level.isin(list(CHANGE_LEVEL_CAPS)), level).otherwise("routine_operation")
    own = F.when(facility & ~structural, "routine_operation").otherwise(known)
    raw = F.least(F.greatest(F.coalesce(score, F.lit(1)), F.lit(1)), F.lit(5))
    cap = F.lit(0)
    for name, n in CHANGE_LEVEL_CAPS.items():
        cap = F.when(own == name, n).otherwise(cap)
    value = F.least(raw, cap)
    return value, own, (value != raw) | (own != known)


def first_category(text: Column, rules: dict[str, Sequence[str]], other: str) -> tuple[Column, Column]:
    """The first category with a keyword in the text, and its keywords that occur."""
    name, hits = F.lit(other), F.array().cast("array<string>")
    for category, words in reversed(rules.items()):
        has = any_phrase(text, words)
        name = F.when(has, category).otherwise(name)
        hits = F.when(has, F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))).otherwise(hits)
    return name, hits


def guarded(rows: DataFrame, *guards: tuple[str, Column]) -> DataFrame:
    """Rows that are kept but meet a guard are dropped; the first guard that holds names the reason."""
    hit = F.lit(None).cast("string")
    for name, predicate in reversed(guards):
        hit = F.when(predicate, name).otherwise(hit)
    hit = F.when(F.col("decision") == "KEEP", hit)
    return rows.withColumn("guard_type", hit).withColumn("decision", F.when(F.col("guard_type").isNotNull(), "DROP").otherwise(F.col("decision")))


def errors(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules that a row breaks; a rule that cannot be told (null) is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))


def chunked(df: DataFrame, by: str, size: int) -> DataFrame:
    """df with `chunk`: consecutive rows of each partition's order in batches of `size`, without a global order."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(by), F.lit(64))).orderBy(by)) - 1) / size))


def batch_agent(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], valid: Callable[[pd.DataFrame, pd.DataFrame], bool], fallback: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 6, attempts: int = 2) -> DataFrame:
    """Runs an agent over batches of rows: an answer that breaks its contract is asked for again, then the rule decides.

    schema: of the answer; `attempts` int and `fallback` boolean are added. Memory holds one batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch].reset_index(drop=True)
                for k in range(1, attempts + 1):
                    try:
                        answer = call(part)
                    except (ValueError, KeyError):
                        continue
                    if valid(part, answer):
                        yield answer.assign(attempts=k, fallback=False)
                        break
                else:
                    yield fallback(part).assign(attempts=attempts, fallback=True)

    return rows.mapInPandas(run, f"{schema}, attempts int, fallback boolean")


def repaired(rows: DataFrame, faulty: Callable[[DataFrame], Column], repair: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Repairs what is faulty for at most `rounds` rounds; adds `rounds` (how many a row went through) and `ok`.

    Each round is checkpointed: a lost executor repeats no agent's call."""
    checkpointing(rows.sparkSession)
    now = rows.withColumn("rounds", F.lit(0))
    for _ in range(rounds):
        now = now.withColumn("_bad", faulty(now)).checkpoint()
        bad = now.where("_bad").drop("_bad")
        if bad.isEmpty():
            return now.drop("_bad").withColumn("ok", F.lit(True))
        now = now.where("not _bad").drop("_bad").unionByName(repair(bad).withColumn("rounds", F.col("rounds") + 1))
    return now.withColumn("ok", ~faulty(now))
