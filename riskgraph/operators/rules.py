"""The rule baseline, bands, inline decisions, actions and the kill-switch, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph import config as C


def band(score: Column) -> Column:
    """Half-open bands, so that no score falls between two."""
    out = F.lit("LOW")
    for least, name in reversed(C.BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def rule_columns() -> dict[str, Column]:
    c = F.col
    return {
        "R01": ((c("max_paise_1h") > 50_000_000) & (c("payers") > 5)) | ((c("in_paise") > 50_000_000) & (c("payers") > 5) & (c("active_days") <= 3)),
        "R02": c("burst_max_30min") >= 10,
        "R03": (c("cashout") > 0.9) & (c("in_paise") > 1_000_000),
        "R04": c("structuring_frac") * c("out_count") >= 3,
        "R05": ((c("silence_days") >= 60) | (c("max_gap_days") >= 60)) & (c("max_out") > 5_000_000),
        "R06": c("device_max_accounts") > 3,
        "R07": (c("vintage_days") < 90) & (c("in_paise") + c("out_paise") > 20_000_000),
        "R08": (c("night_frac") > 0.5) & (c("in_paise") > 10_000_000),
    }


def rule_engine(features: DataFrame) -> DataFrame:
    """account, R01 to R08, rules_fired, rule_score, alert."""
    rules = rule_columns()
    fired = features.select("account", *(x.alias(n) for n, x in rules.items()))
    n = sum((F.col(r).cast("int") for r in rules), F.lit(0))
    score = sum((F.col(r).cast("int") * w for r, w in C.RULE_WEIGHTS.items()), F.lit(0.0))
    return fired.select("*", n.alias("rules_fired"), score.alias("rule_score"), (n > 0).alias("alert"))


def rule_summary(fired: DataFrame, truth: DataFrame) -> DataFrame:
    """rule, fired, tp, fp, precision, recall; the last row is any rule. truth: account, label."""
    names = [*C.RULE_WEIGHTS, "alert"]
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("hit")) for n in names)))
    rows = fired.join(truth, "account").select("label", cells.alias("x")).select("label", "x.*")
    sums = rows.groupBy("rule").agg(F.count_if("hit").alias("fired"), F.count_if(F.col("hit") & (F.col("label") == 1)).alias("tp"), F.count_if(F.col("hit") & (F.col("label") == 0)).alias("fp"), F.count_if(F.col("label") == 1).alias("p"))
    return sums.select("rule", "fired", "tp", "fp", (F.col("tp") / F.greatest("fired", F.lit(1))).alias("precision"), (F.col("tp") / F.greatest("p", F.lit(1))).alias("recall"))


def inline_decisions(ledger: DataFrame, risk: DataFrame) -> DataFrame:
    """txn_id, score, band, action and reasons of each transaction from the standing risk (account, risk) of its parties.

    An unknown party counts 0. ben_age: hours since the payee was added; 0 or null is unknown, as a record without it has it.
    """
    def of(side: str) -> DataFrame:
        return risk.select(F.col("account").alias(side), F.col("risk").alias(f"{side}_risk"))

    rows = ledger.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    src, dst = F.coalesce("src_risk", F.lit(0.0)), F.coalesce("dst_risk", F.lit(0.0))
    fresh = F.coalesce((F.col("ben_age") > 0) & (F.col("ben_age") < C.FRESH_PAYEE_HOURS) & (F.col("paise") >= 2_500_000), F.lit(False))
    cash_out = F.coalesce(F.col("channel").isin(*C.CASH_CHANNELS) & (src >= 55), F.lit(False))
    score = F.greatest(src * 0.35, dst) + F.when(fresh, 18).otherwise(0) + F.when(cash_out, 12).otherwise(0)
    score = F.least(score, F.lit(100.0))
    action = F.when(score >= 85, "BLOCK").when(score >= 65, "HOLD").when(score >= 40, "REVIEW").otherwise("ALLOW")
    reasons = F.array_compact(F.array(F.when(dst >= 65, "HIGH_RISK_BENEFICIARY"), F.when(fresh, "FRESH_BENEFICIARY"), F.when(cash_out, "CASH_OUT_ATTEMPT")))
    return rows.select("txn_id", score.alias("score"), band(score).alias("band"), action.alias("action"), F.array_join(reasons, ",").alias("reasons"))


def suggested_actions(scores: DataFrame) -> DataFrame:
    """account, band and the actions called for: never a freeze on a weak signal.

    scores: account, risk, and if known codes (those of the evidence) and amount_at_risk, in rupees.
    """
    s = F.col("risk")
    codes = F.coalesce("codes", F.array().cast("array<string>")) if "codes" in scores.columns else F.array().cast("array<string>")
    amount = F.coalesce("amount_at_risk", F.lit(0.0)) if "amount_at_risk" in scores.columns else F.lit(0.0)
    report = (s >= C.KILLSWITCH_FLOOR) | ((s >= 65) & ((amount > C.REPORT_ABOVE) | F.array_contains(codes, "NCRP_TICKET")))
    first = F.when(s >= C.KILLSWITCH_FLOOR, "FULL_FREEZE").when(s >= 65, "FREEZE_DEBIT").when(s >= 40, F.when(F.array_contains(codes, "FAN_IN"), "HOLD_CREDIT").otherwise("STEP_UP_AUTH")).otherwise("MONITOR")
    return scores.select("account", band(s).alias("band"), F.concat_ws(",", first, F.when(report, "REPORT_STR")).alias("actions"))


def kill_switch(requests: DataFrame, layers: list[str]) -> DataFrame:
    """What automation may do by itself: account, layers, refusals, action.

    requests: account, risk, proposed, protected and a score (0 to 1) for each layer. A refused freeze becomes HOLD_CREDIT from
    a risk of 65 on, else MONITOR. The hourly freeze budget depends on what was allowed before, so it is kept by
    riskgraph.streaming.decide.
    """
    severe = F.col("proposed").isin("FREEZE_DEBIT", "FULL_FREEZE")
    agreed = sum(((F.coalesce(F.col(x), F.lit(0.0)) >= C.LAYER_THRESHOLD).cast("int") for x in layers), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(severe & F.col("protected"), "PROTECTED"), F.when((F.col("proposed") == "FULL_FREEZE") & (F.col("risk") < C.KILLSWITCH_FLOOR), "BELOW_FLOOR"),
        F.when(severe & (agreed < C.MIN_LAYERS), "UNCORROBORATED"),
    ))
    instead = F.when(F.col("risk") >= 65, "HOLD_CREDIT").otherwise("MONITOR")
    return requests.select("account", agreed.alias("layers"), F.array_join(reasons, ",").alias("refusals"), F.when(F.size(reasons) > 0, instead).otherwise(F.col("proposed")).alias("action"))


def action_summary(log: DataFrame, now: int) -> DataFrame:
    """action, taken and freezes_last_hour of a containment log (account, seq, taken_at, ttl, action); reversals are no actions."""
    taken = log.where("action <> 'REVERT'")
    hour = F.col("action").isin("FREEZE_DEBIT", "FULL_FREEZE") & (F.col("taken_at") > now - 3600)
    return taken.groupBy("action").agg(F.count("*").alias("taken"), F.count_if(hour).alias("freezes_last_hour"))
