"""Casebook and containment as append-only logs; the current state is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.operators.rules import band


def new_cases(existing: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts that have no case yet, one a alert_id: adding the same alerts again adds none."""
    return alerts.join(existing, "alert_id", "left_anti").dropDuplicates(["alert_id"])


def current(events: DataFrame) -> DataFrame:
    """Each case's last event (alert_id, seq, status, actor)."""
    last = Window.partitionBy("alert_id").orderBy(F.col("seq").desc())
    return events.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def queue(cases: DataFrame, status: str | None = None, min_score: float = 0.0, limit: int = 50) -> DataFrame:
    rows = cases.where(F.col("risk") >= min_score)
    return (rows.where(F.col("status") == status) if status else rows).orderBy(F.col("risk").desc(), "alert_id").limit(limit)


def case_stats(cases: DataFrame) -> DataFrame:
    """status, band, cases, median risk."""
    return cases.groupBy("status", band(F.col("risk")).alias("band")).agg(F.count("*").alias("cases"), F.median("risk").alias("median_risk"))


def case_totals(cases: DataFrame) -> DataFrame:
    """One row: cases, open ones, resolved ones, precision on the resolved (null without any) and the median risk."""
    confirmed, resolved = F.count_if(F.col("status") == "CONFIRMED"), F.count_if(F.col("status").isin("CONFIRMED", "FALSE_POSITIVE"))
    return cases.agg(F.count("*").alias("cases"), F.count_if(~F.col("status").isin("CONFIRMED", "FALSE_POSITIVE")).alias("open"), resolved.alias("resolved"), F.round(confirmed / F.nullif(resolved, F.lit(0)), 4).alias("precision"), F.median("risk").alias("median_risk"))


#: What a case may go to from each status.
TRANSITIONS = {"OPEN": ("ASSIGNED", "CONFIRMED", "FALSE_POSITIVE"), "ASSIGNED": ("ASSIGNED", "OPEN", "CONFIRMED", "FALSE_POSITIVE")}


def apply_changes(events: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to append, changes refused): changes (alert_id, seq, status, actor, note) to cases as the log has them now.

    A change of status null is a note and keeps the status. Refused are changes of cases that aren't there or whose status
    doesn't lead there, and all but the first (by seq) of several changes of one case at once. An appended row carries the
    status before, so that the log is its own audit.
    """
    now = current(events).select("alert_id", F.col("status").alias("status_before"))
    first = Window.partitionBy("alert_id").orderBy("seq")
    rows = changes.withColumn("_n", F.row_number().over(first)).join(now, "alert_id", "left")
    allowed = F.lit(False)
    for status, targets in TRANSITIONS.items():
        allowed = allowed | ((F.col("status_before") == status) & F.col("status").isin(*targets))
    fine = F.coalesce((F.col("_n") == 1) & F.col("status_before").isNotNull() & (F.col("status").isNull() | allowed), F.lit(False))
    rows = rows.withColumn("_fine", fine)
    return rows.where("_fine").select("alert_id", "seq", F.coalesce("status", "status_before").alias("status"), "actor", "note", "status_before"), rows.where("not _fine").select(*changes.columns)


def feedback_labels(cases: DataFrame) -> DataFrame:
    """alert_id, label: 1 for confirmed cases, 0 for false positives; open ones teach nothing."""
    return cases.select("alert_id", F.when(F.col("status") == "CONFIRMED", 1).when(F.col("status") == "FALSE_POSITIVE", 0).alias("label")).where("label is not null")


def active_actions(log: DataFrame, now: int) -> DataFrame:
    """Actions in force: the account's last entry, not reverted, not expired (taken_at + ttl), and not mere monitoring."""
    last = Window.partitionBy("account").orderBy(F.col("taken_at").desc(), F.col("seq").desc())
    state = log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return state.where(~F.col("action").isin("REVERT", "MONITOR") & (F.col("ttl").isNull() | (F.col("taken_at") + F.col("ttl") > now)))
