"""Why an account scores as it does: reasons, evidence, narratives and draft filings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.functions.text import redact
from riskgraph.operators.rules import band

# The codes of reasons. Each is given by a feature, whose value is written as a share, a ratio or a number.
REASONS = {
    "rapid_passthrough": ("PASS_THROUGH", "pct"), "passthrough": ("FULL_DRAIN", "ratio"), "cashout": ("CASH_OUT", "pct"), "payers": ("FAN_IN", "number"), "fan_in": ("FAN_IN_RATIO", "ratio"), "burst_max_30min": ("VELOCITY_BURST", "number"),
    "structuring_frac": ("STRUCTURING", "pct"), "dormancy": ("DORMANT_BURST", "number"), "silence_days": ("LONG_DORMANCY", "number"), "device_max_accounts": ("DEVICE_FARM", "number"), "ip_max_accounts": ("SHARED_IP", "number"),
    "new_beneficiary_frac": ("FRESH_BENEFICIARY", "pct"), "first_time_payer_frac": ("FIRST_TIME_PAYERS", "pct"), "night_frac": ("OFF_HOURS", "pct"), "kyc_min": ("WEAK_KYC", "number"), "vintage_days": ("NEW_ACCOUNT", "number"),
    "median_delay": ("FAST_FORWARD", "number"), "cv_out": ("UNIFORM_AMOUNTS", "ratio"), "payee_concentration": ("SINGLE_PAYEE", "pct"), "reciprocity": ("ONE_WAY", "pct"), "frac_atm_aeps": ("CASH_CHANNEL", "pct"), "max_paise_1h": ("HOUR_VALUE", "number"),
}
SEVERITIES = ((0.8, "HIGH"), (0.3, "MEDIUM"), (0.08, "LOW"))
RANKS = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "INFO": 3}
MOST = 8
EVIDENCE = "array<struct<rank:int,minus:double,code:string,detail:string,contribution:double,severity:string>>"


def severity(contribution: Column) -> Column:
    out = F.lit("INFO")
    for least, name in reversed(SEVERITIES):
        out = F.when(F.abs(contribution) >= least, name).otherwise(out)
    return out


def written(value: Column, kind: Column) -> Column:
    share = F.concat(F.round(value * 100).cast("long").cast("string"), F.lit("%"))
    fraction = F.when(value.between(0, 1), share).otherwise(F.format_string("%.2f", value))
    return F.when(kind == "pct", fraction).when(kind == "ratio", F.format_string("%.2f", value)).otherwise(F.format_string("%.0f", value))


def top_reasons(attributions: DataFrame, k: int = 6, positive: bool = True) -> DataFrame:
    """account, place, feature, contribution, value: the k strongest of each account, by contribution or by its size."""
    c = F.col("contribution")
    rows = attributions.where(F.abs(c) > C.SMALL)
    order = Window.partitionBy("account").orderBy((c if positive else F.abs(c)).desc(), "feature")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("account", "place", "feature", "contribution", "value")


def _item(code, detail, contribution, how) -> Column:
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), how)
    return F.struct(rank.alias("rank"), (-F.abs(contribution)).cast("double").alias("minus"), code.alias("code"), detail.alias("detail"), F.round(contribution, 4).cast("double").alias("contribution"), how.alias("severity"))


def evidence(accounts: DataFrame, reasons: DataFrame, most: int = MOST) -> DataFrame:
    """account and evidence (array of code, detail, contribution, severity): at most so many, by severity, then by strength.

    reasons: account, feature, contribution, value; only positive ones whose feature is in REASONS tell. accounts: account, and
    where known graph and temporal (scores of the layers, 0 to 1), ring_size, ring_typology, ring_paise, ring_devices, tickets,
    ticket_paise, ioc_hit, ioc_confidence, malware, listed; what is missing or null gives no evidence.
    """
    spark = accounts.sparkSession
    names = spark.createDataFrame([(f, code, kind) for f, (code, kind) in REASONS.items()], "feature string, code string, kind string")
    c = F.col("contribution")
    told = reasons.where(c > 0).join(F.broadcast(names), "feature")
    detail = F.concat(F.col("feature"), F.lit(" is "), written(F.col("value").cast("double"), F.col("kind")))
    told = told.groupBy("account").agg(F.collect_list(_item(F.col("code"), detail, c, severity(c))).alias("told"))

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in accounts.columns else F.lit(None).cast(kind)

    def extra(when: Column, code: str, detail: Column, contribution: Column, how: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), _item(F.lit(code), detail, contribution, how))

    graph, temporal, in_ring = F.coalesce(given("graph", "double"), F.lit(0.0)), F.coalesce(given("temporal", "double"), F.lit(0.0)), given("ring_size", "long").isNotNull()
    rupees = lambda name: F.format_number(F.coalesce(given(name, "double"), F.lit(0.0)) / 100, 0)
    high, medium = F.lit("HIGH"), F.lit("MEDIUM")
    more = F.array_compact(F.array(
        extra(in_ring, "RING_MEMBERSHIP", F.concat(F.lit("one of "), given("ring_size", "string"), F.lit(" flagged accounts of a "), F.coalesce(given("ring_typology", "string"), F.lit("MULE_CLUSTER")), F.lit(" that moved INR "), rupees("ring_paise"), F.lit(" among them")), graph, high),
        extra(in_ring & (given("ring_devices", "long") > 0), "SHARED_DEVICE_RING", F.concat(F.lit("shares "), given("ring_devices", "string"), F.lit(" devices with others of its ring")), graph * 0.5, high),
        extra(~in_ring & (graph >= 0.5), "GRAPH_PROXIMITY", F.concat(F.lit("accounts around it score "), F.format_string("%.0f", graph * 100)), graph, medium),
        extra(temporal >= 0.5, "TEMPORAL_PATTERN", F.concat(F.lit("order of its events scores "), written(temporal, F.lit("pct"))), temporal, F.when(temporal > 0.75, "HIGH").otherwise("MEDIUM")),
        extra(given("tickets", "long") > 0, "NCRP_TICKET", F.concat(F.lit("named by "), given("tickets", "string"), F.lit(" complaints over INR "), rupees("ticket_paise")), F.lit(1.0), high),
        extra(given("ioc_hit", "long") > 0, "APK_IOC", F.concat(F.lit("found in a package of "), F.coalesce(given("malware", "string"), F.lit("unclassified")), F.lit(", sure by "), written(F.coalesce(given("ioc_confidence", "double"), F.lit(0.8)), F.lit("pct"))), F.lit(0.9), high),
        extra(given("listed", "long") > 0, "REGULATORY_LIST", F.lit("on a regulator's list of mule accounts"), F.lit(0.8), high),
    ))
    rows = accounts.withColumn("_more", more).join(told, "account", "left")
    ordered = F.slice(F.array_sort(F.concat(F.coalesce("told", F.array().cast(EVIDENCE)), F.col("_more").cast(EVIDENCE))), 1, most)
    return rows.select("account", F.transform(ordered, lambda x: F.struct(x["code"].alias("code"), x["detail"].alias("detail"), x["contribution"].alias("contribution"), x["severity"].alias("severity"))).alias("evidence"))


def codes(found: Column) -> Column:
    return F.transform(found, lambda x: x["code"])


def narrative(rows: DataFrame) -> DataFrame:
    """account, narrative: one paragraph. rows: account, risk, evidence, and if known ring_id, ring_size, ring_paise, exposure_paise."""
    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)

    top = F.slice("evidence", 1, 3)
    lead = F.concat(F.lit("Account "), F.col("account").cast("string"), F.lit(" scores "), F.format_string("%.0f", F.col("risk").cast("double")), F.lit("/100 ("), band(F.col("risk")), F.lit(")."))
    body = F.concat(F.array_join(F.transform(top, lambda x: x["detail"]), ". "), F.lit("."))
    said = F.array_contains(codes(top), "RING_MEMBERSHIP")
    ring = F.when(said, F.concat(F.lit("Ring "), given("ring_id", "string"), F.lit("."))).otherwise(F.concat(F.lit("One of "), given("ring_size", "string"), F.lit(" flagged members of ring "), given("ring_id", "string"), F.lit(", which moved INR "), F.format_number(given("ring_paise", "double") / 100, 0), F.lit(".")))
    exposed = F.when(given("exposure_paise", "double") > 0, F.concat(F.lit("Exposure INR "), F.format_number(given("exposure_paise", "double") / 100, 0), F.lit(".")))
    advice = F.when(F.col("risk") >= 65, f"Freeze debits until the customer is reached; file within {C.STR_FILING_DAYS} days if unexplained.")
    whole = F.when(F.size("evidence") > 0, F.concat_ws(" ", lead, body, ring, exposed, advice)).otherwise(F.concat_ws(" ", lead, F.lit("No indicator is over its threshold.")))
    return rows.select("account", whole.alias("narrative"))


def filings(alerts: DataFrame, ledger: DataFrame, now: int, most: int = 50) -> DataFrame:
    """account, reference, due_s, report (JSON) of each alert: a draft that a person must sign.

    alerts: account, risk, evidence, narrative; identifiers in texts are masked. The latest most transactions are listed, as a
    filing has them: each side of the ledger is cut to them before the alerts' own are brought together.
    """
    of = alerts.select(F.col("account").alias("subject"))
    sides = [ledger.join(of, F.col(mine) == F.col("subject")).select("subject", "txn_id", "ts_s", F.lit(kind).alias("direction"), F.col(other).alias("counterparty"), "paise", "channel") for mine, other, kind in (("src", "dst", "DEBIT"), ("dst", "src", "CREDIT"))]
    order = Window.partitionBy("subject").orderBy(F.col("ts_s").desc(), "txn_id")
    kept = sides[0].union(sides[1]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    listed = kept.groupBy(F.col("subject").alias("account")).agg(F.array_sort(F.collect_list(F.struct("place", "txn_id", "ts_s", "direction", "counterparty", "paise", "channel"))).alias("detail"), F.sum("paise").alias("total"), F.count("*").alias("n"))
    grounds = F.transform("evidence", lambda x: F.struct(x["code"].alias("code"), redact(x["detail"]).alias("detail")))
    none = F.array().cast("array<struct<place:int,txn_id:string,ts_s:bigint,direction:string,counterparty:bigint,paise:bigint,channel:string>>")
    report = F.to_json(F.struct(
        F.lit("STR").alias("report_type"), F.lit("DRAFT_PENDING_HUMAN_REVIEW").alias("status"), F.struct(F.col("account").alias("account_id")).alias("subject"),
        F.struct(F.col("risk").alias("risk_score"), band(F.col("risk")).alias("risk_band"), redact(F.col("narrative")).alias("summary"), grounds.alias("grounds")).alias("suspicion"),
        F.struct(F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("total", F.lit(0)).alias("total_paise"), F.coalesce(F.col("detail").cast("array<struct<place:int,txn_id:string,ts_s:bigint,direction:string,counterparty:bigint,paise:bigint,channel:string>>"), none).alias("detail")).alias("transactions"),
    ))
    return alerts.join(listed, "account", "left").select("account", F.concat(F.lit("STR-"), F.col("account").cast("string")).alias("reference"), F.lit(now + C.STR_FILING_DAYS * 86400).alias("due_s"), report.alias("report"))


REPORT = (
    "status string, subject struct<account_id:bigint>, suspicion struct<risk_score:double,risk_band:string,summary:string,grounds:array<struct<code:string,detail:string>>>, "
    "transactions struct<count:bigint,total_paise:bigint,detail:array<struct<place:int,txn_id:string,ts_s:bigint,direction:string,counterparty:bigint,paise:bigint,channel:string>>>"
)


def filing_texts(filed: DataFrame) -> DataFrame:
    """account, text: each draft filing as lines for a reader, with its grounds numbered. A part that is null is an empty word."""
    rows = filed.withColumn("r", F.from_json("report", REPORT))
    said = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    rupees = lambda paise: F.format_number(paise / 100, 2)
    grounds = F.transform(F.coalesce("r.suspicion.grounds", F.array().cast("array<struct<code:string,detail:string>>")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), said(x["code"]), F.lit(": "), said(x["detail"])))
    lines = F.concat(
        F.array(
            F.concat(F.lit("Draft report "), said(F.col("reference")), F.lit(" ("), said(F.col("r.status")), F.lit(")")), F.concat(F.lit("Due: "), F.date_format(F.timestamp_seconds("due_s"), "yyyy-MM-dd HH:mm")),
            F.concat(F.lit("Account: "), said(F.col("r.subject.account_id"))), F.concat(F.lit("Risk: "), said(F.col("r.suspicion.risk_score")), F.lit(" "), said(F.col("r.suspicion.risk_band"))), said(F.col("r.suspicion.summary")), F.lit("Grounds:"),
        ),
        grounds,
        F.array(F.concat(F.lit("Transactions: "), said(F.col("r.transactions.count")), F.lit(", INR "), said(rupees(F.col("r.transactions.total_paise")))), F.lit("Not filed until an officer has signed it.")),
    )
    return rows.select("account", F.array_join(lines, "\n").alias("text"))
