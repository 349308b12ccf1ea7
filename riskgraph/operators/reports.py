"""Evaluation reports over scores and truth, and summaries of a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The last part of a ledger's time that lead times are measured in, and how many instants of it are scored.
LEAD_SHARE, CUTS = 0.35, 12


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), 4)


def typology_recall(scores: DataFrame, truth: DataFrame, threshold: float = 40.0) -> DataFrame:
    """kind (typology or role), name, mules, detected, recall and median_score. truth: account, label, typology, role.

    Both groupings come from one pass; accounts without a score count as not detected.
    """
    mules = truth.where("label = 1").join(scores.select("account", "risk"), "account", "left")
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("name")) for k in ("typology", "role"))))
    rows = mules.select("risk", cells.alias("x")).select("risk", "x.*").where("name is not null")
    detected = F.count_if(F.col("risk") >= threshold)
    return rows.groupBy("kind", "name").agg(F.count("*").alias("mules"), detected.alias("detected"), share(detected, F.count("*")).alias("recall"), F.median("risk").alias("median_score"))


def decoy_report(scores: DataFrame, truth: DataFrame, populations: tuple[str, ...], threshold: float = 40.0) -> DataFrame:
    """population, n, false_positives, false_positive_rate, median_score of clean accounts: of each flag column, and the ordinary,
    who have none of them. An account of several populations counts in each."""
    clean = truth.where("label = 0").join(scores.select("account", "risk"), "account", "left")
    flags = {p: F.coalesce(F.col(p).cast("boolean"), F.lit(False)) for p in populations}
    none = ~reduce(lambda a, b: a | b, flags.values(), F.lit(False))
    names = F.array_compact(F.array(*(F.when(x, F.lit(p)) for p, x in flags.items()), F.when(none, "ordinary")))
    rows = clean.select("risk", F.explode(names).alias("population"))
    wrong = F.count_if(F.col("risk") >= threshold)
    return rows.groupBy("population").agg(F.count("*").alias("n"), wrong.alias("false_positives"), share(wrong, F.count("*")).alias("false_positive_rate"), F.median("risk").alias("median_score"))


def independence(scores: DataFrame, truth: DataFrame, tickets: DataFrame, threshold: float = 40.0) -> DataFrame:
    """One row: how many mules tickets (beneficiary) name, how many are detected, and detected without any ticket."""
    mules = truth.where("label = 1").select("account").join(scores.select("account", "risk"), "account", "left")
    named = tickets.select(F.col("beneficiary").alias("account")).distinct().withColumn("named", F.lit(True))
    rows = mules.join(named, "account", "left").select(F.coalesce(F.col("risk") >= threshold, F.lit(False)).alias("hit"), F.coalesce("named", F.lit(False)).alias("named"))
    hit, unseen = F.count_if("hit"), F.count_if(F.col("hit") & ~F.col("named"))
    return rows.agg(
        F.count("*").alias("mules"), F.count_if("named").alias("named"), F.count_if(~F.col("named")).alias("never_named"), hit.alias("detected"), unseen.alias("detected_never_named"),
        share(unseen, hit).alias("share_never_named"), share(unseen, F.count_if(~F.col("named"))).alias("recall_never_named"),
    )


def lead_cuts(ledger: DataFrame, cuts: int = CUTS, part: float = LEAD_SHARE) -> list[float]:
    """The instants at which a ledger is scored again to see how early it tells; one small aggregate."""
    first, last = ledger.agg(F.min("ts_s"), F.max("ts_s")).first()
    if first is None:
        return []
    begin = last - (last - first) * part
    return [begin + (last - begin) * i / max(1, cuts - 1) for i in range(cuts)]


def first_alerts(scored: list[tuple[float, DataFrame]], threshold: float = 40.0) -> DataFrame:
    """account, alert_s: the first of the instants at which an account's risk reaches the threshold."""
    hits = [s.where(F.col("risk") >= threshold).select("account", F.lit(float(at)).alias("alert_s")) for at, s in scored]
    return reduce(DataFrame.union, hits).groupBy("account").agg(F.min("alert_s").alias("alert_s"))


def lead_times(truth: DataFrame, fraud: DataFrame, alerts: DataFrame, tickets: DataFrame, begin: float) -> DataFrame:
    """account, first_fraud_s, alert_s, ticket_s and hours from alert to ticket (null without either) of each eligible mule.

    Eligible are mules whose first fraudulent transfer (src, dst, ts_s) is no earlier than begin. alerts: account, alert_s;
    tickets: beneficiary, ts_s.
    """
    touched = fraud.select(F.col("src").alias("account"), "ts_s").union(fraud.select("dst", "ts_s")).groupBy("account").agg(F.min("ts_s").alias("first_fraud_s"))
    named = tickets.groupBy(F.col("beneficiary").alias("account")).agg(F.min("ts_s").alias("ticket_s"))
    rows = truth.where("label = 1").select("account").join(touched.where(F.col("first_fraud_s") >= begin), "account")
    rows = rows.join(alerts, "account", "left").join(named, "account", "left")
    return rows.select("account", "first_fraud_s", "alert_s", "ticket_s", ((F.col("ticket_s") - F.col("alert_s")) / 3600.0).alias("hours"))


def lead_summary(leads: DataFrame) -> DataFrame:
    """One row: eligible, detected, never_ticketed, both, before, after, share_before, and median, mean and 90th percentile of hours."""
    told, before = F.col("alert_s").isNotNull(), F.count_if(F.col("hours") > 0)
    return leads.agg(
        F.count("*").alias("eligible"), F.count_if(told).alias("detected"), F.count_if(told & F.col("ticket_s").isNull()).alias("never_ticketed"), F.count("hours").alias("both"), before.alias("before"), F.count_if(F.col("hours") <= 0).alias("after"),
        share(before, F.count("hours")).alias("share_before"), F.round(F.median("hours"), 2).alias("median_hours"), F.round(F.avg("hours"), 2).alias("mean_hours"), F.round(F.percentile("hours", F.lit(0.9)), 2).alias("p90_hours"),
    )


def out_of_time(rings: DataFrame, scores: DataFrame, threshold: float = 40.0) -> DataFrame:
    """One row: late_rings, mules, detected, recall, median_score over the members of late rings (ring, members, late) with a score."""
    late = rings.where("late")
    named = late.select(F.explode(F.split("members", ",")).alias("account")).where("account <> ''").select(F.expr("try_cast(account as bigint)").alias("account")).distinct()
    hit = F.count_if(F.col("risk") >= threshold)
    found = named.join(scores.select("account", "risk"), "account").agg(F.count("*").alias("mules"), hit.alias("detected"), share(hit, F.count("*")).alias("recall"), F.median("risk").alias("median_score"))
    return late.agg(F.count("*").alias("late_rings")).crossJoin(found)


def equal_recall(scores: DataFrame, truth: DataFrame, fired: DataFrame) -> DataFrame:
    """One row: alerts, tp, fp, precision and recall of the rules (account, alert), and the same of the scores at the threshold
    at which they find at least as many mules; the threshold too. Counts by distinct score are summed, never the rows ordered."""
    rows = truth.select("account", "label").join(scores.select("account", "risk"), "account").join(fired.select("account", "alert"), "account")
    rules = rows.agg(F.count_if("alert").alias("rule_alerts"), F.count_if(F.col("alert") & (F.col("label") == 1)).alias("rule_tp"), F.sum("label").alias("mules"))
    from riskgraph.operators.metrics import by_score

    curve = by_score(rows.select("label", F.col("risk").alias("score"))).crossJoin(F.broadcast(rules))
    at = curve.where(F.col("tp") >= F.col("rule_tp")).agg(F.max(F.struct("score", "tp", "fp", "rule_alerts", "rule_tp", "mules")).alias("x")).select("x.*")
    return at.select(
        "rule_alerts", "rule_tp", (F.col("rule_alerts") - F.col("rule_tp")).alias("rule_fp"), share(F.col("rule_tp"), F.col("rule_alerts")).alias("rule_precision"), share(F.col("rule_tp"), F.col("mules")).alias("rule_recall"),
        F.col("score").alias("threshold"), (F.col("tp") + F.col("fp")).alias("alerts"), "tp", "fp", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("mules")).alias("recall"),
    )


def device_spans(ledger: DataFrame) -> DataFrame:
    """device, first_s, last_s, accounts."""
    return ledger.where("device is not null").groupBy("device").agg(F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.count_distinct("src").alias("accounts"))


def world_summary(accounts: DataFrame, ledger: DataFrame, truth: DataFrame, fraud: DataFrame) -> DataFrame:
    """One row: accounts, mules, mule_rate, transactions, fraud, fraud_rate. fraud: txn_id of the fraudulent transfers."""
    people = accounts.select("account").join(truth.select("account", "label"), "account", "left").agg(F.count("*").alias("accounts"), F.count_if(F.col("label") == 1).alias("mules"), F.round(F.avg((F.coalesce("label", F.lit(0)) == 1).cast("double")), 5).alias("mule_rate"))
    marked = ledger.join(fraud.select("txn_id").distinct().withColumn("bad", F.lit(1)), "txn_id", "left")
    return people.crossJoin(marked.agg(F.count("*").alias("transactions"), F.count("bad").alias("fraud"), F.round(F.avg(F.coalesce("bad", F.lit(0)).cast("double")), 5).alias("fraud_rate")))


def union_all(*frames: DataFrame) -> DataFrame:
    """Sub-streams of different columns as one, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
