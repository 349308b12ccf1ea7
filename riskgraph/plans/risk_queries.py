"""Queries and oracles of rules, intelligence, compliance, metrics and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import text as X
from riskgraph.operators import compliance, intel, metrics, rules
from riskgraph.operators import features as O
from riskgraph.operators import graph as G
from riskgraph.plans.feature_queries import DAYS, FLOW, PARTIES, BURSTS, STRUCTURE, devices
from riskgraph.plans.prelude import ACCOUNTS, DIRECTIVES, EVENTS, INDICATORS, LEDGER, SCORES, TICKETS, with_
from riskgraph.sources import ledger as S

#: A second after every event of the side tables, and one in the ledger.
NOW, LEDGER_NOW = 1_735_689_600, 1_770_000_000
KEY = b"salt"


def tables(spark, sf):
    return S.read_ledger(spark, sf), S.read_accounts(spark, sf)


def fired(spark, sf):
    ledger, accounts = tables(spark, sf)
    return rules.rule_engine(O.behaviour(ledger, accounts))


def truth(spark, sf):
    return S.read_accounts(spark, sf).select("account", (F.col("account") % 11 == 0).cast("int").alias("label"))


def standing_risk(spark, sf):
    return S.read_accounts(spark, sf).select("account", (F.col("vintage_days") % 101).cast("double").alias("risk"))


def rule_engine(spark, sf):
    return fired(spark, sf)


def rule_summary(spark, sf):
    return rules.rule_summary(fired(spark, sf), truth(spark, sf))


def inline_decisions(spark, sf):
    ledger = S.read_ledger(spark, sf).withColumn("ben_age", F.col("ben_age") / 100.0)
    return rules.inline_decisions(ledger, standing_risk(spark, sf)).withColumn("score", F.round("score", 6))


def suggested_actions(spark, sf):
    codes = F.array_compact(F.array(F.when(F.col("account") % 2 == 0, "FAN_IN"), F.when(F.col("account") % 3 == 0, "NCRP_TICKET")))
    return rules.suggested_actions(standing_risk(spark, sf).select("account", "risk", codes.alias("codes"), (F.col("account") % 5 * 50_000.0).alias("amount_at_risk")))


def risk_overview(spark, sf):
    return compliance.overview(standing_risk(spark, sf))


def kill_switch(spark, sf):
    a, layers = S.read_accounts(spark, sf), {"xgb": 100, "graph": 70, "temporal": 50, "intel": 30}
    proposed = F.when(F.col("account") % 3 == 0, "FULL_FREEZE").when(F.col("account") % 3 == 1, "FREEZE_DEBIT").otherwise("STEP_UP")
    return rules.kill_switch(a.select("account", (F.col("vintage_days") % 101).cast("double").alias("risk"), proposed.alias("proposed"), (F.col("account") % 7 == 0).alias("protected"), *((F.col("account") % m / m).alias(n) for n, m in layers.items())), [*layers])


def ticket_dedup(spark, sf):
    return intel.keep_last(S.read_tickets(spark, sf), "ticket_id", "arrival")


def hard_tickets(spark, sf):
    return intel.hard_tickets(S.read_tickets(spark, sf))


def ticket_lookback(spark, sf):
    return intel.lookback(S.read_tickets(spark, sf), 8, 72, 1_706_000_000).select("ticket_id", "arrival", "ts_s", "paise")


def beneficiary_summary(spark, sf):
    return intel.beneficiary_summary(S.read_tickets(spark, sf))


def best_indicators(spark, sf):
    return intel.best_indicators(S.read_indicators(spark, sf))


def listed_accounts(spark, sf):
    return intel.entities(S.read_directives(spark, sf), "LISTED")


def directive_limits(spark, sf):
    return intel.limits(S.read_directives(spark, sf), {"per_day": 100_000.0})


def intel_features(spark, sf):
    return intel.intel_features(S.read_accounts(spark, sf).withColumn("vpa", (F.col("account") + 1).cast("string")), S.read_tickets(spark, sf), S.read_indicators(spark, sf), S.read_directives(spark, sf), NOW)


def directive_overlay(spark, sf):
    ledger, accounts = tables(spark, sf)
    return intel.apply_directives(standing_risk(spark, sf), S.read_directives(spark, sf), G.shared_identifier_edges(ledger, accounts, "device", 1.0))


def ctr_candidates(spark, sf):
    return compliance.ctr_candidates(S.read_ledger(spark, sf), 100_000)


def exposure_7d(spark, sf):
    return compliance.exposure(O.event_view(*tables(spark, sf)), LEDGER_NOW)


def latest_transactions(spark, sf):
    return compliance.latest_transactions(S.read_ledger(spark, sf))


def audit_chain(spark, sf):
    e = S.table(spark, sf, "events")
    return compliance.audit_chain(e.select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("event"), F.col("props").alias("payload")))


def on_scores(metric):
    return lambda spark, sf: metric(S.read_scores(spark, sf))


def pii_redaction(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.redact(F.col("text"), strict=False).alias("redacted"))


def pii_redaction_strict(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", "turn", X.redact(F.col("text")).alias("redacted"))


def keyed_tokens(spark, sf):
    return S.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), X.token(F.col("c_name"), KEY).alias("token"))


def indicator_mining(spark, sf):
    kinds = ("vpa", "ipv4", "ifsc", "account", "url")
    return S.table(spark, sf, "pages").select("page_id", *(F.array_join(X.mine(F.col("html"), k), " ").alias(k) for k in kinds))


def number_coercion(spark, sf):
    raw = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("("), F.col("o_custkey").cast("string"), F.lit(",500%)"))).when(F.col("o_orderkey") % 10 == 1, "N/A").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(",25"))).alias("raw"))
    return raw.select("id", X.to_number(F.col("raw")).alias("value"))


QUERIES = {f.__name__: f for f in (rule_engine, rule_summary, inline_decisions, suggested_actions, risk_overview, kill_switch, ticket_dedup, hard_tickets, ticket_lookback, beneficiary_summary, best_indicators, listed_accounts, directive_limits, intel_features, directive_overlay, ctr_candidates, exposure_7d, latest_transactions, audit_chain, pii_redaction, pii_redaction_strict, keyed_tokens, indicator_mining, number_coercion)}
QUERIES |= {
    "roc_auc": on_scores(metrics.roc_auc), "average_precision": on_scores(metrics.average_precision), "precision_at_budget": on_scores(metrics.precision_at), "precision_at_recall": on_scores(lambda s: metrics.at_recall(s, 0.8)),
    "best_f1": on_scores(metrics.best_f1), "confusion": on_scores(lambda s: metrics.confusion(s, (0.2, 0.4, 0.55, 0.65, 0.85))), "calibration": on_scores(metrics.calibration), "calibration_error": on_scores(metrics.calibration_error),
}

RISK = "rk AS (SELECT account, CAST(vintage_days % 101 AS DOUBLE) AS risk FROM acc)"
RULES = """rl AS (SELECT acc.account,
  (coalesce(max_paise_1h, 0) > 50000000 AND coalesce(payers, 0) > 5) OR (coalesce(in_paise, 0) > 50000000 AND coalesce(payers, 0) > 5 AND coalesce(active_days, 0) <= 3) AS R01,
  coalesce(burst_max_30min, 0) >= 10 AS R02, coalesce(CAST(cash_paise AS DOUBLE) / greatest(in_paise, 1), 0) > 0.9 AND coalesce(in_paise, 0) > 1000000 AS R03,
  coalesce(CAST(b AS DOUBLE) / greatest(st.o, 1), 0) * coalesce(out_count, 0) >= 3 AS R04,
  (coalesce(silence, 0) >= 60 OR coalesce(gap / 86400.0::DOUBLE, 0) >= 60) AND coalesce(max_out, 0) > 5000000 AS R05, coalesce(device_max_accounts, 0) > 3 AS R06,
  vintage_days < 90 AND coalesce(in_paise, 0) + coalesce(out_paise, 0) > 20000000 AS R07, coalesce(CAST(night AS DOUBLE) / n, 0) > 0.5 AND coalesce(in_paise, 0) > 10000000 AS R08
  FROM acc LEFT JOIN flow USING (account) LEFT JOIN parties USING (account) LEFT JOIN bursts USING (account) LEFT JOIN timing USING (account) LEFT JOIN st USING (account) LEFT JOIN device_s USING (account)),
rf AS (SELECT *, CAST(R01::INT + R02::INT + R03::INT + R04::INT + R05::INT + R06::INT + R07::INT + R08::INT AS INTEGER) AS rules_fired,
  CAST(R01::INT * 3.0 + R02::INT * 2.0 + R03::INT * 3.0 + R04::INT * 2.5 + R05::INT * 2.0 + R06::INT * 1.5 + R07::INT * 2.0 + R08::INT * 1.5 AS DOUBLE) AS rule_score FROM rl)"""
FIRED = with_(LEDGER, ACCOUNTS, EVENTS, FLOW, PARTIES, BURSTS, DAYS, STRUCTURE, devices("device"), RULES)
NAMED = "SELECT DISTINCT CAST(unnest(string_split(entities, ',')) AS BIGINT) AS account FROM dir WHERE kind = '{}'"
SUMS = SCORES + """, sm AS (SELECT round(score, 6) AS score, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1),
cu AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n - pos) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(n - pos) OVER () AS BIGINT) AS q FROM sm WINDOW w AS (ORDER BY score DESC))"""


def redact_sql(text: str, strict: bool) -> str:
    patterns = dict(X.PII)
    for mask in X.STRICT if strict else patterns:
        text = f"regexp_replace({text}, '{patterns[mask]}', '{mask}', 'g')"
    return text


def mined_sql(kind: str) -> str:
    """Distinct matches of a kind in order, with the tests that payment addresses, network addresses and accounts must pass."""
    def found(k: str) -> str:
        return f"list_sort(list_distinct(regexp_extract_all(html, '{X.MINED[k].replace(chr(39), chr(39) * 2)}')))"

    hosts = ", ".join(f"'{h}'" for h in X.MAIL_HOSTS)
    out = found(kind)
    vpa = f"list_filter({found('vpa')}, lambda x: lower(string_split(x, '@')[-1]) NOT IN ({hosts}) AND len(string_split(x, '@')[-1]) BETWEEN 3 AND 12)"
    if kind == "vpa":
        out = vpa
    if kind == "account":
        out = f"CASE WHEN len({found('ifsc')}) > 0 OR len({vpa}) > 0 THEN {out} ELSE [] END"
    if kind == "ipv4":
        out = f"list_filter({out}, lambda x: len(list_filter(string_split(x, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0 AND CAST(string_split(x, '.')[1] AS INTEGER) NOT IN (0, 127, 255))"
    return f"array_to_string({out}, ' ') AS {kind}"


def hmac_sql(text: str) -> str:
    pads = ["".join(f"\\x{b ^ c:02X}" for b in KEY.ljust(64, b"\0")) for c in (0x36, 0x5C)]
    return f"'TKN_' || upper(substr(sha256('{pads[1]}'::BLOB || unhex(sha256('{pads[0]}'::BLOB || encode({text})))), 1, 12))"


BAND = "CASE WHEN risk >= 85 THEN 'CRITICAL' WHEN risk >= 65 THEN 'HIGH' WHEN risk >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
ORACLES = {
    "rule_engine": FIRED + "SELECT *, rules_fired > 0 AS alert FROM rf",
    "rule_summary": FIRED + """, x AS (SELECT account % 11 = 0 AS label, unnest([{'rule': 'R01', 'hit': R01}, {'rule': 'R02', 'hit': R02}, {'rule': 'R03', 'hit': R03}, {'rule': 'R04', 'hit': R04}, {'rule': 'R05', 'hit': R05}, {'rule': 'R06', 'hit': R06}, {'rule': 'R07', 'hit': R07}, {'rule': 'R08', 'hit': R08}, {'rule': 'alert', 'hit': rules_fired > 0}]) AS c FROM rf)
SELECT c.rule AS rule, count(*) FILTER (c.hit) AS fired, count(*) FILTER (c.hit AND label) AS tp, count(*) FILTER (c.hit AND NOT label) AS fp, CAST(count(*) FILTER (c.hit AND label) AS DOUBLE) / greatest(count(*) FILTER (c.hit), 1) AS precision, CAST(count(*) FILTER (c.hit AND label) AS DOUBLE) / greatest(count(*) FILTER (label), 1) AS recall FROM x GROUP BY 1""",
    "inline_decisions": with_(LEDGER, ACCOUNTS, RISK) + """, s AS (SELECT txn_id, least(greatest(coalesce(a.risk, 0) * 0.35::DOUBLE, coalesce(b.risk, 0)) + CASE WHEN ben_age > 0 AND ben_age / 100.0::DOUBLE < 1 AND paise >= 2500000 THEN 18 ELSE 0 END + CASE WHEN channel IN ('ATM', 'AEPS') AND coalesce(a.risk, 0) >= 55 THEN 12 ELSE 0 END, 100.0) AS risk,
  concat_ws(',', CASE WHEN coalesce(b.risk, 0) >= 65 THEN 'HIGH_RISK_BENEFICIARY' END, CASE WHEN ben_age > 0 AND ben_age / 100.0::DOUBLE < 1 AND paise >= 2500000 THEN 'FRESH_BENEFICIARY' END, CASE WHEN channel IN ('ATM', 'AEPS') AND coalesce(a.risk, 0) >= 55 THEN 'CASH_OUT_ATTEMPT' END) AS reasons FROM led LEFT JOIN rk a ON a.account = src LEFT JOIN rk b ON b.account = dst)
SELECT txn_id, round(risk, 6) AS score, """ + BAND + """ AS band, CASE WHEN risk >= 85 THEN 'BLOCK' WHEN risk >= 65 THEN 'HOLD' WHEN risk >= 40 THEN 'REVIEW' ELSE 'ALLOW' END AS action, reasons FROM s""",
    "suggested_actions": with_(ACCOUNTS, RISK) + f"SELECT account, {BAND} AS band, CASE WHEN risk >= 85 THEN 'FULL_FREEZE,REPORT_STR' WHEN risk >= 65 THEN CASE WHEN account % 5 * 50000 > 100000 OR account % 3 = 0 THEN 'FREEZE_DEBIT,REPORT_STR' ELSE 'FREEZE_DEBIT' END WHEN risk >= 40 THEN CASE WHEN account % 2 = 0 THEN 'HOLD_CREDIT' ELSE 'STEP_UP_AUTH' END ELSE 'MONITOR' END AS actions FROM rk",
    "risk_overview": with_(ACCOUNTS, RISK) + f"SELECT {BAND} AS band, count(*) AS accounts, round(avg(risk), 6) AS mean_risk FROM rk GROUP BY 1",
    "kill_switch": with_(ACCOUNTS) + """, r AS (SELECT account, CAST(vintage_days % 101 AS DOUBLE) AS risk, ['FULL_FREEZE', 'FREEZE_DEBIT', 'STEP_UP'][account % 3 + 1] AS proposed, account % 7 = 0 AS protected, CAST((account % 100 >= 50)::INT + (account % 70 >= 35)::INT + (account % 50 >= 25)::INT + (account % 30 >= 15)::INT AS INTEGER) AS layers FROM acc),
f AS (SELECT *, list_filter([CASE WHEN proposed <> 'STEP_UP' AND protected THEN 'PROTECTED' END, CASE WHEN proposed = 'FULL_FREEZE' AND risk < 85 THEN 'BELOW_FLOOR' END, CASE WHEN proposed <> 'STEP_UP' AND layers < 2 THEN 'UNCORROBORATED' END], lambda x: x IS NOT NULL) AS why FROM r)
SELECT account, layers, coalesce(array_to_string(why, ','), '') AS refusals, CASE WHEN len(why) > 0 THEN CASE WHEN risk >= 65 THEN 'HOLD_CREDIT' ELSE 'MONITOR' END ELSE proposed END AS action FROM f""",
    "ticket_dedup": with_(TICKETS) + "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY arrival DESC) AS k FROM tik) WHERE k = 1",
    "hard_tickets": with_(TICKETS) + "SELECT * FROM tik WHERE category IN ('UPI_FRAUD', 'OTP_FRAUD')",
    "ticket_lookback": with_(TICKETS) + "SELECT ticket_id, arrival, ts_s, paise FROM tik WHERE beneficiary = 8 AND ts_s BETWEEN 1706000000 - 259200 AND 1706000000",
    "beneficiary_summary": with_(TICKETS) + "SELECT beneficiary, count(*) AS tickets, CAST(sum(paise) AS BIGINT) AS paise, count(DISTINCT victim) AS victims, max(ts_s) AS last FROM tik GROUP BY 1",
    "best_indicators": with_(INDICATORS) + "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY confidence DESC, ioc_id DESC) AS k FROM ioc) WHERE k = 1",
    "listed_accounts": with_(DIRECTIVES) + NAMED.format("LISTED"),
    "directive_limits": with_(DIRECTIVES) + """, v AS (SELECT unnest(json_keys(payload)) AS key, payload, ts_s, feed_id FROM dir WHERE kind = 'VELOCITY_LIMIT'), w AS (SELECT key AS "limit", TRY_CAST(json_extract_string(payload, key) AS DOUBLE) AS value, ts_s, feed_id FROM v),
f AS (SELECT "limit", arg_max(value, (ts_s, feed_id)) AS value FROM w WHERE value IS NOT NULL GROUP BY 1) SELECT * FROM f UNION ALL SELECT 'per_day', 100000.0::DOUBLE WHERE 'per_day' NOT IN (SELECT "limit" FROM f)""",
    "intel_features": with_(ACCOUNTS, TICKETS, INDICATORS, DIRECTIVES) + f""", t AS (SELECT beneficiary AS account, count(*) AS n, CAST(sum(paise) AS BIGINT) AS p, max(ts_s) AS last, count(DISTINCT victim) AS v FROM tik WHERE ts_s <= {NOW} GROUP BY 1), h AS (SELECT TRY_CAST(value AS BIGINT) - CASE kind WHEN 'VPA' THEN 1 ELSE 0 END AS account, max(confidence) AS c FROM ioc WHERE kind IN ('ACCOUNT', 'VPA') AND ts_s <= {NOW} GROUP BY 1),
l AS (SELECT DISTINCT CAST(unnest(string_split(entities, ',')) AS BIGINT) AS account FROM dir WHERE kind = 'LISTED' AND ts_s <= {NOW})
SELECT acc.account, coalesce(n, 0) AS tickets, coalesce(p, 0) AS ticket_paise, CASE WHEN last IS NULL THEN 999 ELSE least(greatest(({NOW} - last) / 86400.0::DOUBLE, 0), 999) END AS ticket_recency, coalesce(v, 0) AS victims, (c IS NOT NULL)::INT AS ioc_hit, coalesce(c, 0) AS ioc_confidence, (c IS NOT NULL)::INT AS preemptive, (l.account IS NOT NULL)::INT AS listed,
  coalesce(n, 0) > 0 OR c IS NOT NULL OR l.account IS NOT NULL AS has_intelligence FROM acc LEFT JOIN t USING (account) LEFT JOIN h USING (account) LEFT JOIN l ON l.account = acc.account""",
    "directive_overlay": with_(LEDGER, ACCOUNTS, RISK, DIRECTIVES) + f""", l AS ({NAMED.format("LISTED")}), s AS ({NAMED.format("SANCTION")}), u AS (SELECT DISTINCT src AS account, device FROM led WHERE device IS NOT NULL AND src IN (SELECT account FROM acc)), few AS (SELECT device FROM u GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25),
n AS (SELECT DISTINCT b.account FROM u a JOIN u b USING (device) WHERE device IN (FROM few) AND a.account <> b.account AND a.account IN (SELECT account FROM l))
SELECT account, CASE WHEN account IN (SELECT account FROM s) THEN 100 WHEN account IN (SELECT account FROM l) THEN greatest(risk, 75) WHEN account IN (SELECT account FROM n) THEN least(risk + 8, 100) ELSE risk END AS risk FROM rk""",
    "ctr_candidates": with_(LEDGER) + "SELECT src AS account, ts_s // 86400 AS day, CAST(sum(paise) AS BIGINT) AS paise, count(*) AS n FROM led WHERE channel IN ('ATM', 'AEPS') GROUP BY 1, 2 HAVING sum(paise) >= 10000000",
    "exposure_7d": with_(LEDGER, ACCOUNTS, EVENTS) + f"SELECT account, CAST(greatest(sum(paise * dir), 0) AS BIGINT) AS exposure_paise FROM ev WHERE ts_s > {LEDGER_NOW - 604800} AND ts_s <= {LEDGER_NOW} GROUP BY 1",
    "latest_transactions": with_(LEDGER) + "SELECT src AS account, txn_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY ts_s DESC, txn_id) AS INTEGER) AS place FROM led) WHERE place <= 50",
    "audit_chain": """WITH RECURSIVE a AS MATERIALIZED (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "at", CAST(user_id AS VARCHAR) AS actor, event_type AS event, sha256(props) AS payload_digest, row_number() OVER (ORDER BY event_id) AS n FROM events),
c AS (SELECT seq, "at", actor, event, payload_digest, n, repeat('0', 64) AS prev_hash, sha256(concat_ws('|', seq, "at", actor, event, payload_digest, repeat('0', 64))) AS entry_hash FROM a WHERE n = 1
  UNION ALL SELECT a.seq, a."at", a.actor, a.event, a.payload_digest, a.n, c.entry_hash, sha256(concat_ws('|', a.seq, a."at", a.actor, a.event, a.payload_digest, c.entry_hash)) FROM c JOIN a ON a.n = c.n + 1)
SELECT seq, "at", actor, event, payload_digest, prev_hash, entry_hash FROM c""",
    "pii_redaction": f"SELECT doc_id, {redact_sql('text', False)} AS redacted FROM documents",
    "pii_redaction_strict": f"SELECT conv_id, turn, {redact_sql('text', True)} AS redacted FROM conversations",
    "keyed_tokens": f"SELECT c_custkey AS account, {hmac_sql('c_name')} AS token FROM customer",
    "indicator_mining": "SELECT page_id, " + ", ".join(mined_sql(k) for k in ("vpa", "ipv4", "ifsc", "account", "url")) + " FROM pages",
    "number_coercion": "SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN -CAST(o_custkey || '500' AS DOUBLE) WHEN 1 THEN NULL ELSE CAST(o_custkey || '25' AS DOUBLE) END AS value FROM orders",
    "roc_auc": with_(SCORES) + "SELECT round(CAST(count(*) FILTER (a.score > b.score) + count(*) FILTER (a.score = b.score) / 2.0::DOUBLE AS DOUBLE) / count(*), 9) AS roc_auc FROM sc a JOIN sc b ON a.label = 1 AND b.label = 0",
    "average_precision": with_(SUMS) + "SELECT round(sum(CAST(pos AS DOUBLE) / p * tp / (tp + fp)), 9) AS average_precision FROM cu",
    "precision_at_budget": with_(SCORES) + """, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS k, count(*) OVER () AS n, sum(label) OVER () AS p FROM sc), b AS (SELECT unnest([0.005::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE]) AS budget), s AS (SELECT budget, CAST(greatest(1, floor(budget * (SELECT count(*) FROM sc) + 0.5)) AS INTEGER) AS size FROM b)
SELECT budget, size AS k, CAST(sum(label) AS DOUBLE) / size AS precision, CAST(sum(label) AS DOUBLE) / any_value(p) AS recall FROM s JOIN r ON r.k <= size GROUP BY 1, 2""",
    "precision_at_recall": with_(SUMS) + "SELECT score AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / p AS recall, tp + fp AS alerts FROM cu WHERE CAST(tp AS DOUBLE) / p >= 0.8 ORDER BY score DESC LIMIT 1",
    "best_f1": with_(SUMS) + "SELECT score AS threshold, round(2.0::DOUBLE * tp / (tp + fp + p), 9) AS f1 FROM cu ORDER BY 2 DESC, 1 DESC LIMIT 1",
    "confusion": with_(SCORES) + ", t AS (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.55::DOUBLE, 0.65::DOUBLE, 0.85::DOUBLE]) AS threshold) SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn FROM sc, t GROUP BY 1",
    "calibration": with_(SCORES) + "SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(label), 9) AS observed FROM sc GROUP BY 1",
    "calibration_error": with_(SCORES) + ", b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(label) AS o, sum((score - label) ** 2) AS b FROM sc GROUP BY 1) SELECT round(sum(b) / sum(n), 9) AS brier, round(sum(n * abs(s - o)) / sum(n), 9) AS ece FROM b",
}
