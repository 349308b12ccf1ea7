"""Queries of wide extracts, cases, folds, learned layers and rings; SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F


from riskgraph.operators import cases, models, rings, wide
from riskgraph.operators import features as O
from riskgraph.operators import graph as G
from riskgraph.plans.prelude import ACCOUNTS, with_
from riskgraph.plans.risk_queries import standing_risk
from riskgraph.sources import ledger as S

NAMES = ("AVG_CI_CASH_CR_AMT_L7D", "AVG_CI_CASH_CR_AMT_L31D", "TOT_UPI_DB_TXNS_L7_14D", "TOT_UPI_DB_TXNS_L31D", "MAX_ATM_DB_AMT_L7D", "SD_LOAN_CR_BAL_14_31D", "TOT_POS_DB_AMT_L14D")


def wide_rows(spark, sf):
    """A small wide extract from the events, with nulls."""
    e = S.table(spark, sf, "events").select("event_id", F.round("value", 2).alias("v"))
    return e.select("event_id", *(F.when(F.col("event_id") % (i + 3) != 0, F.col("v") * (i + 1)).alias(n) for i, n in enumerate(NAMES)))


def rounded(df):
    """Sums of fractions differ in their last digits by their order; the query rounds them, the operator doesn't."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes))


def family_rollups(spark, sf):
    return rounded(wide.family_rollups(wide_rows(spark, sf), ["event_id"]))


def channel_concentration(spark, sf):
    return rounded(wide.channel_concentration(wide_rows(spark, sf), ["event_id"]))


def row_missingness(spark, sf):
    return wide.missingness(wide_rows(spark, sf), ["event_id"])


def case_events(spark, sf):
    e = S.table(spark, sf, "events").where("event_type = 'click'")
    status = F.element_at(F.array(*map(F.lit, ("OPEN", "ASSIGNED", "CONFIRMED", "FALSE_POSITIVE"))), (F.col("event_id") % 4).cast("int") + 1)
    return e.select(F.col("user_id").alias("alert_id"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("user_id") % 101).cast("double").alias("risk"))


def case_state(spark, sf):
    return cases.current(case_events(spark, sf))


def case_stats(spark, sf):
    return cases.case_stats(cases.current(case_events(spark, sf)))


def case_queue(spark, sf):
    return cases.queue(cases.current(case_events(spark, sf)), "OPEN", 40.0, 20).select("alert_id", "risk")


def feedback_labels(spark, sf):
    return cases.feedback_labels(cases.current(case_events(spark, sf)))


def train_folds(spark, sf):
    return models.folds(S.read_accounts(spark, sf).select("account", (F.col("account") % 11 == 0).cast("int").alias("label")))


def layer_scores(spark, sf):
    a = S.read_accounts(spark, sf)
    return a.select("account", (F.col("account") % 11 == 0).cast("int").alias("label"), *((F.col("vintage_days") * (i + 3) % 97 / 100 + F.when(F.col("account") % 11 == 0, 0.02).otherwise(0.0)).alias(x) for i, x in enumerate(models.LAYERS)))


def prior_blend(spark, sf):
    return models.prior_blend(layer_scores(spark, sf)).select("account", F.round("prob", 9).alias("prob"), F.round("risk", 6).alias("risk"))


def fused_scores(spark, sf):
    scores = layer_scores(spark, sf)
    return models.fit_fusion(scores)(scores)


#: Boosted trees of a production fit, as the reference has them.
TREES = 150


def seed_risk(spark, sf):
    rows = O.behaviour(S.read_ledger(spark, sf), S.read_accounts(spark, sf))
    rows = rows.withColumns({f"kyc_{k.lower()}": F.col("kyc") == k for k in ("MIN", "VIDEO")}).drop("kyc")
    features = [c for c in rows.columns if c != "account"]
    rows = rows.select("account", *(F.col(c).cast("double").alias(c) for c in features))
    rows = models.folds(rows.withColumn("label", ((F.col("in_count") > 0) & (F.col("account") % 3 == 0)).cast("int")))
    return models.cross_fitted(rows, features, trees=TREES)


def ring_detection(spark, sf):
    ledger, accounts = S.read_ledger(spark, sf), S.read_accounts(spark, sf)
    return rings.detect_rings(G.graph_edges(ledger, accounts), standing_risk(spark, sf), G.money(ledger, accounts), ledger.where("device is not null").select(F.col("src").alias("account"), "device"))


QUERIES = {f.__name__: f for f in (family_rollups, channel_concentration, row_missingness, case_state, case_stats, case_queue, feedback_labels, train_folds, prior_blend, fused_scores, seed_risk, ring_detection)}

WIDE = "wd AS (SELECT event_id, " + ", ".join(f"CASE WHEN event_id % {i + 3} <> 0 THEN round(value, 2) * {i + 1} END AS c{i}" for i in range(7)) + " FROM events)"
CASES = """ce AS (SELECT user_id AS alert_id, event_id AS seq, ['OPEN', 'ASSIGNED', 'CONFIRMED', 'FALSE_POSITIVE'][event_id % 4 + 1] AS status, CAST(user_id % 101 AS DOUBLE) AS risk FROM events WHERE event_type = 'click'),
cs AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) AS k FROM ce) WHERE k = 1)"""
U = "CAST(('0x' || substr(md5('{}:' || account), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"


def rollup_sql(name: str, a: str, b: str, accel: bool = False) -> str:
    values = f"list_filter([{a}, {b}], lambda x: x IS NOT NULL)"
    out = f"round(list_avg({values}), 6) AS BX_{name}__mean, round(list_max({values}), 6) AS BX_{name}__max, round(list_stddev_pop({values}), 6) AS BX_{name}__std, CAST(2 - len({values}) AS INTEGER) AS BX_{name}__nmiss"
    return out + (f", round(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CASE WHEN abs({b}) > 1e-9 THEN {a} / {b} ELSE 0 END END, 6) AS BX_{name}__accel" if accel else "")


ORACLES = {
    "family_rollups": with_(WIDE) + f"SELECT event_id, {rollup_sql('AVG_CI_CASH_CR_AMT', 'c0', 'c1', True)}, {rollup_sql('TOT_UPI_DB_TXN', 'c2', 'c3', True)} FROM wd",
    "channel_concentration": with_(WIDE) + """, t AS (SELECT event_id, [coalesce(list_avg(list_filter([c0, c1], lambda x: x IS NOT NULL)), 0), coalesce(c6, 0)] AS t FROM wd), s AS (SELECT event_id, list_transform(t, lambda x: CASE WHEN abs(list_sum(t)) > 1e-9 THEN x / list_sum(t) ELSE 0 END) AS s FROM t)
SELECT event_id, round(list_max(s), 6) AS BX_channel_top_share, CAST(len(list_filter(s, lambda x: x > 0.01)) AS INTEGER) AS BX_channel_n_active, round(list_sum(list_transform(s, lambda x: x * x)), 6) AS BX_channel_hhi, round(0 - list_sum(list_transform(s, lambda x: x * ln(CASE WHEN x > 0 THEN x ELSE 1 END))), 6) AS BX_channel_entropy FROM s""",
    "row_missingness": with_(WIDE) + ", f AS (SELECT event_id, list_filter([c0, c1, c2, c3, c4, c5, c6], lambda x: x IS NOT NULL) AS v FROM wd) SELECT event_id, CAST(7 - len(v) AS INTEGER) AS BX_row_nmiss, CAST(7 - len(v) AS DOUBLE) / 7 AS BX_row_nmiss_frac, CAST(len(list_filter(v, lambda x: abs(x) > 1e-9)) AS DOUBLE) / 7 AS BX_row_nonzero_frac FROM f",
    "case_state": with_(CASES) + "SELECT * FROM cs",
    "case_stats": with_(CASES) + "SELECT status, CASE WHEN risk >= 85 THEN 'CRITICAL' WHEN risk >= 65 THEN 'HIGH' WHEN risk >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS cases, median(risk) AS median_risk FROM cs GROUP BY 1, 2",
    "case_queue": with_(CASES) + "SELECT alert_id, risk FROM cs WHERE status = 'OPEN' AND risk >= 40 ORDER BY risk DESC, alert_id LIMIT 20",
    "feedback_labels": with_(CASES) + "SELECT alert_id, CASE status WHEN 'CONFIRMED' THEN 1 ELSE 0 END AS label FROM cs WHERE status IN ('CONFIRMED', 'FALSE_POSITIVE')",
    "train_folds": with_(ACCOUNTS) + f""", u AS (SELECT account, CAST(account % 11 = 0 AS INTEGER) AS label, {U.format(42)} AS u, {U.format(43)} AS v FROM acc),
s AS (SELECT *, CASE WHEN label = 1 THEN (row_number() OVER (PARTITION BY label ORDER BY u, account) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY label) ELSE u END AS s FROM u)
SELECT account, label, CASE WHEN s < 0.5 THEN 'train' WHEN s < 0.65 THEN 'val' WHEN s < 0.8 THEN 'fuse' ELSE 'test' END AS fold, CAST(floor(v * 5) AS INTEGER) AS k FROM s""",
    "prior_blend": with_(ACCOUNTS) + """, s AS (SELECT account, CASE WHEN account % 11 = 0 THEN 0.02 ELSE 0.0 END::DOUBLE AS e, vintage_days AS v FROM acc), p AS (SELECT account, (v * 3 % 97 / 100.0::DOUBLE + e) * 0.45::DOUBLE + (v * 4 % 97 / 100.0::DOUBLE + e) * 0.25::DOUBLE + (v * 5 % 97 / 100.0::DOUBLE + e) * 0.2::DOUBLE + (v * 6 % 97 / 100.0::DOUBLE + e) * 0.1::DOUBLE AS prob FROM s)
SELECT account, round(prob, 9) AS prob, round(100 * sqrt(greatest(0, least(1, prob))), 6) AS risk FROM p""",
}
