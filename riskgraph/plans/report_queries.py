"""Queries and oracles of evaluation reports, explanations, summaries, wide dictionaries and feed ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import text as X
from riskgraph.operators import cases, compliance, explain, intel, reports, rules, wide
from riskgraph.operators import graph as G
from riskgraph.plans import risk_queries as R
from riskgraph.plans.graph_queries import GRAPH, graph_edges
from riskgraph.plans.model_queries import CASES, NAMES, WIDE, case_events, layer_scores, wide_rows
from riskgraph.plans.prelude import ACCOUNTS, DIRECTIVES, LEDGER, TICKETS, with_
from riskgraph.sources import ledger as S

POPULATIONS = ("merchant", "kyc_min", "senior")
BEGIN = 1_769_000_000


def pick(column, *names):
    return F.element_at(F.array(*map(F.lit, names)), (column % len(names)).cast("int") + 1)


def truth(spark, sf):
    a = S.read_accounts(spark, sf)
    return a.select("account", (F.col("account") % 11 == 0).cast("int").alias("label"), pick(F.col("account"), "FAN_IN", "CHAIN", "DEVICES").alias("typology"), pick(F.col("account"), "COLLECTOR", "CASHOUT").alias("role"), "merchant", (F.col("kyc") == "MIN").alias("kyc_min"), (F.col("age") > 50).alias("senior"))


def fraud(spark, sf):
    return S.read_ledger(spark, sf).where((F.col("src") % 11 == 0) & (F.col("paise") % 5 == 0))


def typology_recall(spark, sf):
    return reports.typology_recall(R.standing_risk(spark, sf), truth(spark, sf))


def decoy_report(spark, sf):
    return reports.decoy_report(R.standing_risk(spark, sf), truth(spark, sf), POPULATIONS)


def ticket_independence(spark, sf):
    return reports.independence(R.standing_risk(spark, sf), truth(spark, sf), S.read_tickets(spark, sf))


def leads(spark, sf):
    alerts = R.standing_risk(spark, sf).where("risk >= 40").select("account", (F.lit(BEGIN) + F.col("risk") * 3600).alias("alert_s"))
    tickets = S.read_tickets(spark, sf).select("beneficiary", (F.col("ts_s") + 66_000_000).alias("ts_s"))
    return reports.lead_times(truth(spark, sf), fraud(spark, sf), alerts, tickets, BEGIN)


def lead_times(spark, sf):
    return leads(spark, sf)


def lead_summary(spark, sf):
    return reports.lead_summary(leads(spark, sf))


def out_of_time(spark, sf):
    a = S.read_accounts(spark, sf)
    rings = a.select(F.col("account").alias("ring"), F.concat_ws(",", "account", F.col("account") + 1, F.lit("")).alias("members"), (F.col("account") % 2 == 0).alias("late"))
    return reports.out_of_time(rings, R.standing_risk(spark, sf))


def equal_recall(spark, sf):
    fired = S.read_accounts(spark, sf).select("account", ((F.col("account") % 4 == 0) | (F.col("account") % 33 == 0)).alias("alert"))
    return reports.equal_recall(R.standing_risk(spark, sf), truth(spark, sf), fired)


def device_spans(spark, sf):
    return reports.device_spans(S.read_ledger(spark, sf))


def world_summary(spark, sf):
    return reports.world_summary(S.read_accounts(spark, sf), S.read_ledger(spark, sf), truth(spark, sf), fraud(spark, sf))


def overview_totals(spark, sf):
    rings = S.read_accounts(spark, sf).select((F.col("account") % 13).alias("size"))
    return compliance.totals(S.read_accounts(spark, sf), S.read_ledger(spark, sf), R.standing_risk(spark, sf), rings).withColumn("mean_risk", F.round("mean_risk", 6))


def action_summary(spark, sf):
    e = S.table(spark, sf, "events")
    log = e.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("taken_at"), pick(F.col("event_id"), "FREEZE_DEBIT", "FULL_FREEZE", "MONITOR", "HOLD_CREDIT", "REVERT").alias("action"))
    return rules.action_summary(log, 1_706_000_000)


def case_totals(spark, sf):
    return cases.case_totals(cases.current(case_events(spark, sf))).withColumn("median_risk", F.round("median_risk", 6))


def case_changes(spark, sf):
    e = S.table(spark, sf, "events").where("event_type = 'error'")
    changes = e.select(F.col("user_id").alias("alert_id"), (F.col("event_id") + 10_000_000).alias("seq"), F.when(F.col("event_id") % 3 == 0, "CONFIRMED").when(F.col("event_id") % 3 == 1, "ASSIGNED").alias("status"), F.lit("officer").alias("actor"), F.lit("seen").alias("note"))
    return cases.apply_changes(case_events(spark, sf), changes)[0]


def stored_log(spark, sf):
    return S.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.sha2("props", 256).alias("entry_hash"))


def audit_head(spark, sf):
    return compliance.chain_head(stored_log(spark, sf))


def audit_tail(spark, sf):
    return compliance.chain_tail(stored_log(spark, sf), 25)


def redacted_frame(spark, sf):
    return X.redact_frame(S.read_ledger(spark, sf).select("txn_id", "src", "device", "paise"), R.KEY)


def obfuscation(spark, sf):
    made = F.array_join(F.transform(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), lambda w: F.concat(F.lit("Lcom/"), w, F.lit(";"))), " ")
    return S.table(spark, sf, "documents").select("doc_id", X.short_names(made).alias("ratio"))


def advisories(spark, sf):
    rows = S.read_directives(spark, sf)
    return intel.advisories(rows.withColumn("payload", F.when(F.col("feed_id") % 3 == 0, F.concat(F.lit("note "), "feed_id")).otherwise(F.col("payload"))))


def directive_ingest(spark, sf):
    rows = S.read_directives(spark, sf)
    raw = rows.select((F.col("feed_id") % 300).alias("feed_id"), F.col("feed_id").alias("arrival"), F.split("entities", ",").alias("entities"), F.create_map(F.lit("cap"), F.col("ts_s")).alias("payload"))
    return intel.ingest_directives(raw, "arrival")


def ledger_quarantine(spark, sf):
    ledger = S.read_ledger(spark, sf).withColumn("paise", F.when(F.col("src") % 50 == 0, 0).otherwise(F.col("paise"))).withColumn("ben_age", F.when(F.col("src") % 40 == 0, -1).otherwise(F.col("ben_age")))
    return intel.validated(ledger, ("RTGS", "IMPS", "UPI", "NEFT", "ATM", "AEPS"))[1].select("txn_id", "reasons")


def column_names(spark, sf):
    rows = wide.dictionary([*NAMES, "AVG_MM_CASH_CR_AMT_L7D", "AVG_CASH_CR_AMT_7D_OCC", "R_CI_NON_CASH_CHQ_DB_TXNS_7TO14DAYS_OCC", "AGE"])
    return spark.createDataFrame(rows, "name string, aggregation string, inducer string, channel string, direction string, measure string, period string, family string, static boolean")


def column_families(spark, sf):
    names = column_names(spark, sf)
    return names.where("not static").groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def dictionary_summary(spark, sf):
    names = column_names(spark, sf)
    cells = F.explode(F.array(F.struct(F.lit("aggregation").alias("slot"), F.col("aggregation").alias("value")), F.struct(F.lit("channel").alias("slot"), F.col("channel").alias("value"))))
    return names.select(cells.alias("x")).select("x.*").where("value is not null").groupBy("slot", "value").agg(F.count("*").alias("n"))


def balance_rows(spark, sf):
    rows = wide_rows(spark, sf)
    return rows.withColumn("AVG_BI_GST_DB_AMT_L7D", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 17 + 0.5))


def rounded(df, keys):
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in df.columns if c not in keys))


def flow_balance(spark, sf):
    return rounded(wide.flow_balance(balance_rows(spark, sf), ["event_id"]), ["event_id"])


def hygiene(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).when(F.col("event_id") % 4 == 1, F.lit(float("nan"))).when(F.col("event_id") % 4 == 2, F.col("value")).alias("v"))
    return wide.hygiene(e)


def attributions(spark, sf):
    a = S.read_accounts(spark, sf)
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), ((F.col("account") * (i + 3) % 41 - 12) / 20.0).cast("double").alias("contribution"), (F.col("account") * (i + 1) % 100 / 100.0).cast("double").alias("value")) for i, f in enumerate(WHY))))
    return a.select("account", cells.alias("x")).select("account", "x.*")


WHY = ("rapid_passthrough", "cashout", "payers", "burst_max_30min", "night_frac", "cv_out", "not_in_the_catalogue")


def top_reasons(spark, sf):
    return explain.top_reasons(attributions(spark, sf))


def explained(spark, sf):
    a = S.read_accounts(spark, sf)
    known = a.select("account", (F.col("account") % 10 / 10.0).alias("graph"), (F.col("account") % 7 / 7.0).alias("temporal"), (F.col("account") % 5).alias("tickets"), (F.col("account") * 1000).alias("ticket_paise"), (F.col("account") % 13 == 0).cast("int").alias("listed"))
    return explain.evidence(known, attributions(spark, sf))


def evidence(spark, sf):
    return explained(spark, sf).select("account", F.posexplode("evidence").alias("place", "x")).select("account", "place", "x.code", "x.contribution", "x.severity")


def evidence_actions(spark, sf):
    rows = R.standing_risk(spark, sf).join(explained(spark, sf), "account")
    return rules.suggested_actions(rows.select("account", "risk", explain.codes(F.col("evidence")).alias("codes")))


def narratives(spark, sf):
    rows = R.standing_risk(spark, sf).join(explained(spark, sf), "account")
    return explain.narrative(rows)


def filings(spark, sf):
    rows = R.standing_risk(spark, sf).where("risk >= 40").join(explained(spark, sf), "account")
    rows = rows.join(explain.narrative(rows), "account")
    return explain.filings(rows, S.read_ledger(spark, sf), R.LEDGER_NOW)


def layer_contributions(spark, sf):
    from riskgraph.operators import models

    return models.contributions(layer_scores(spark, sf)).withColumn("contribution", F.round("contribution", 9))


def neighbours(spark, sf):
    return G.neighbours(graph_edges(spark, sf), F.lit(8)).withColumn("weight", F.round("weight", 6))


def adjacency(spark, sf):
    out = G.adjacency(graph_edges(spark, sf))
    return out.select("account", F.size("edges").alias("n"), F.transform("edges", lambda x: x["dst"]).cast("array<string>").alias("e")).select("account", "n", F.array_join("e", ",").alias("neighbours"))


def union_streams(spark, sf):
    out = reports.union_all(S.read_tickets(spark, sf).select("ts_s", "beneficiary"), S.read_indicators(spark, sf).select("ts_s", "value"), S.read_directives(spark, sf).select("ts_s", "entities"))
    return out.groupBy((F.col("beneficiary").isNotNull()).alias("ticket"), (F.col("value").isNotNull()).alias("indicator")).agg(F.count("*").alias("n"), F.sum("ts_s").alias("seconds"))


QUERIES = {f.__name__: f for f in (
    typology_recall, decoy_report, ticket_independence, lead_times, lead_summary, out_of_time, equal_recall, device_spans, world_summary, overview_totals, action_summary, case_totals, case_changes, audit_head, audit_tail,
    redacted_frame, obfuscation, advisories, directive_ingest, ledger_quarantine, column_names, column_families, dictionary_summary, flow_balance, hygiene, top_reasons, evidence, evidence_actions, narratives, filings,
    layer_contributions, neighbours, adjacency, union_streams,
)}

TRUTH = """tr AS (SELECT account, CAST(account % 11 = 0 AS INTEGER) AS label, ['FAN_IN', 'CHAIN', 'DEVICES'][account % 3 + 1] AS typology, ['COLLECTOR', 'CASHOUT'][account % 2 + 1] AS role, merchant, kyc = 'MIN' AS kyc_min, age > 50 AS senior FROM acc)"""
BASE = (ACCOUNTS, R.RISK, TRUTH)
LEADS = with_(LEDGER, *BASE, TICKETS) + f""", al AS (SELECT account, {BEGIN} + risk * 3600 AS alert_s FROM rk WHERE risk >= 40), tk AS (SELECT beneficiary AS account, min(ts_s + 66000000) AS ticket_s FROM tik GROUP BY 1),
bad AS (SELECT * FROM led WHERE src % 11 = 0 AND paise % 5 = 0), tc AS (SELECT account, min(ts_s) AS first_fraud_s FROM (SELECT src AS account, ts_s FROM bad UNION ALL SELECT dst, ts_s FROM bad) GROUP BY 1),
ld AS (SELECT account, first_fraud_s, alert_s, ticket_s, (ticket_s - alert_s) / 3600.0::DOUBLE AS hours FROM tr JOIN tc USING (account) LEFT JOIN al USING (account) LEFT JOIN tk USING (account) WHERE label = 1 AND first_fraud_s >= {BEGIN})"""
ALL_NAMES = [*NAMES, "AVG_MM_CASH_CR_AMT_L7D", "AVG_CASH_CR_AMT_7D_OCC", "R_CI_NON_CASH_CHQ_DB_TXNS_7TO14DAYS_OCC", "AGE"]
# the grammar once more, as patterns over a table of names
GRAMMAR = "nm AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in ALL_NAMES) + r"""]) AS name), w AS (SELECT name, regexp_extract(name, '_(L?\d+(?:TO\d+|_\d+)?D(?:AYS)?(?:_OCC?)?)$', 1) AS win FROM nm),
b AS (SELECT name, win, CASE WHEN win = '' THEN name ELSE substr(name, 1, len(name) - len(win) - 1) END AS body FROM w),
g AS (SELECT *, regexp_extract(body, '^(D_TA_CI|D_TA|RA_CI|DA_CI|R_CI|D_CI|RA|DA|R|D|MIN|MAX|AVG|SD|TOT|CNT)_', 1) AS ag FROM b), h AS (SELECT *, CASE WHEN ag = '' THEN body ELSE substr(body, len(ag) + 2) END AS r1 FROM g),
i AS (SELECT *, starts_with(r1, 'MM_') AS mm, CASE WHEN starts_with(r1, 'MM_') THEN substr(r1, 4) ELSE r1 END AS r2 FROM h), j AS (SELECT *, regexp_extract(r2, '^(CI|BI)(?:_|$)', 1) AS ind FROM i), k AS (SELECT *, CASE WHEN ind = '' THEN r2 ELSE ltrim(substr(r2, 3), '_') END AS r3 FROM j),
l AS (SELECT *, regexp_extract(r3, '^(NON_CASH_CHQ|STDNG_INSTR|FEES_CHRGS|NET_BNKING|MOB_BNKING|ELEC_XFER|POS_PYMT|UPI_XFER|MBNKING|BBPS|CASH|CHQ|LOAN|GST|UPI|ATM|APB|POS)(?:_|$)', 1) AS ch FROM k), m AS (SELECT *, string_split(substr(r3, len(ch) + 1), '_') AS t FROM l),
o AS (SELECT name, CASE WHEN ag = '' THEN 'RAW' ELSE replace(ag, '_CI', '') END AS aggregation, coalesce(nullif(ind, ''), CASE WHEN ends_with(ag, '_CI') THEN 'CI' END) AS inducer, nullif(ch, '') AS channel, list_filter(t, lambda x: x IN ('CR', 'DB'))[1] AS direction, list_filter(t, lambda x: x IN ('TXNS', 'TXN', 'AMT', 'BAL'))[1] AS ms, nullif(win, '') AS period, mm FROM m),
names AS (SELECT name, aggregation, inducer, channel, direction, CASE WHEN ms = 'TXNS' THEN 'TXN' ELSE ms END AS measure, period, concat_ws('_', aggregation, CASE WHEN mm THEN 'MM' END, inducer, channel, direction, CASE WHEN ms = 'TXNS' THEN 'TXN' ELSE ms END, CASE WHEN period LIKE '%\_OC%' ESCAPE '\' THEN 'OCC' END) AS family, channel IS NULL AND period IS NULL AND ms IS NULL AS static FROM o)"""
REASON_TABLE = "why AS (SELECT account, unnest([" + ", ".join(f"{{'feature': '{f}', 'contribution': (account * {i + 3} % 41 - 12) / 20.0::DOUBLE, 'value': account * {i + 1} % 100 / 100.0::DOUBLE}}" for i, f in enumerate(WHY)) + "]) AS x FROM acc), att AS (SELECT account, x.feature AS feature, x.contribution AS contribution, x.value AS value FROM why)"
TOLD = with_(ACCOUNTS, R.RISK, REASON_TABLE) + ", cat AS (SELECT unnest([" + ", ".join(f"{{'feature': '{f}', 'code': '{c}'}}" for f, (c, _) in explain.REASONS.items()) + """]) AS c),
e0 AS (SELECT account, c.code AS code, contribution, CASE WHEN abs(contribution) >= 0.8 THEN 'HIGH' WHEN abs(contribution) >= 0.3 THEN 'MEDIUM' WHEN abs(contribution) >= 0.08 THEN 'LOW' ELSE 'INFO' END AS severity FROM att JOIN cat ON c.feature = att.feature WHERE contribution > 0
  UNION ALL SELECT account, 'GRAPH_PROXIMITY', account % 10 / 10.0::DOUBLE, 'MEDIUM' FROM acc WHERE account % 10 >= 5
  UNION ALL SELECT account, 'TEMPORAL_PATTERN', account % 7 / 7.0::DOUBLE, CASE WHEN account % 7 / 7.0::DOUBLE > 0.75 THEN 'HIGH' ELSE 'MEDIUM' END FROM acc WHERE account % 7 / 7.0::DOUBLE >= 0.5
  UNION ALL SELECT account, 'NCRP_TICKET', 1.0::DOUBLE, 'HIGH' FROM acc WHERE account % 5 > 0
  UNION ALL SELECT account, 'REGULATORY_LIST', 0.8::DOUBLE, 'HIGH' FROM acc WHERE account % 13 = 0),
ev AS (SELECT * FROM (SELECT account, CAST(row_number() OVER (PARTITION BY account ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, -abs(contribution), code) - 1 AS INTEGER) AS place, code, round(contribution, 4) AS contribution, severity FROM e0) WHERE place < 8)"""


def mean_sql(*columns: str) -> str:
    return f"coalesce(list_avg(list_filter([{', '.join(columns)}], lambda x: x IS NOT NULL)), 0)"


def ratio_sql(a: str, b: str, name: str) -> str:
    return f"round(CASE WHEN abs({b}) > 1e-9 THEN ({a}) / ({b}) ELSE 0 END, 6) AS BX_{name}"


ORACLES = {
    "typology_recall": with_(*BASE) + """, x AS (SELECT risk, unnest([{'kind': 'typology', 'name': typology}, {'kind': 'role', 'name': role}]) AS c FROM tr JOIN rk USING (account) WHERE label = 1)
SELECT c.kind AS kind, c.name AS name, count(*) AS mules, count(*) FILTER (risk >= 40) AS detected, round(count(*) FILTER (risk >= 40) / CAST(count(*) AS DOUBLE), 4) AS recall, median(risk) AS median_score FROM x GROUP BY 1, 2""",
    "decoy_report": with_(*BASE) + """, x AS (SELECT risk, unnest(list_filter([CASE WHEN merchant THEN 'merchant' END, CASE WHEN kyc_min THEN 'kyc_min' END, CASE WHEN senior THEN 'senior' END, CASE WHEN NOT merchant AND NOT kyc_min AND NOT senior THEN 'ordinary' END], lambda p: p IS NOT NULL)) AS population FROM tr JOIN rk USING (account) WHERE label = 0)
SELECT population, count(*) AS n, count(*) FILTER (risk >= 40) AS false_positives, round(count(*) FILTER (risk >= 40) / CAST(count(*) AS DOUBLE), 4) AS false_positive_rate, median(risk) AS median_score FROM x GROUP BY 1""",
    "ticket_independence": with_(*BASE, TICKETS) + """, x AS (SELECT risk >= 40 AS hit, account IN (SELECT beneficiary FROM tik) AS named FROM tr JOIN rk USING (account) WHERE label = 1), c AS (SELECT count(*) AS mules, count(*) FILTER (named) AS named, count(*) FILTER (NOT named) AS never_named, count(*) FILTER (hit) AS detected, count(*) FILTER (hit AND NOT named) AS detected_never_named FROM x)
SELECT *, round(CAST(detected_never_named AS DOUBLE) / greatest(detected, 1), 4) AS share_never_named, round(CAST(detected_never_named AS DOUBLE) / greatest(never_named, 1), 4) AS recall_never_named FROM c""",
    "lead_times": LEADS + "SELECT * FROM ld",
    "lead_summary": LEADS + """SELECT count(*) AS eligible, count(alert_s) AS detected, count(*) FILTER (alert_s IS NOT NULL AND ticket_s IS NULL) AS never_ticketed, count(hours) AS "both", count(*) FILTER (hours > 0) AS before, count(*) FILTER (hours <= 0) AS after,
round(CAST(count(*) FILTER (hours > 0) AS DOUBLE) / greatest(count(hours), 1), 4) AS share_before, round(median(hours), 2) AS median_hours, round(avg(hours), 2) AS mean_hours, round(quantile_cont(hours, 0.9), 2) AS p90_hours FROM ld""",
    "out_of_time": with_(*BASE) + """, late AS (SELECT account FROM acc WHERE account % 2 = 0), m AS (SELECT account FROM late UNION SELECT account + 1 FROM late)
SELECT (SELECT count(*) FROM late) AS late_rings, count(*) AS mules, count(*) FILTER (risk >= 40) AS detected, round(count(*) FILTER (risk >= 40) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS recall, median(risk) AS median_score FROM m JOIN rk USING (account)""",
    "equal_recall": with_(*BASE) + """, x AS (SELECT account, label, risk, account % 4 = 0 OR account % 33 = 0 AS alert FROM tr JOIN rk USING (account)), r AS (SELECT count(*) FILTER (alert) AS ra, count(*) FILTER (alert AND label = 1) AS rt, sum(label) AS m FROM x),
t AS (SELECT max(risk) AS threshold FROM (SELECT a.risk FROM (SELECT DISTINCT risk FROM x) a JOIN x b ON b.risk >= a.risk GROUP BY 1 HAVING sum(b.label) >= (SELECT rt FROM r))), s AS (SELECT count(*) AS alerts, CAST(sum(label) AS BIGINT) AS tp FROM x WHERE risk >= (SELECT threshold FROM t))
SELECT ra AS rule_alerts, rt AS rule_tp, ra - rt AS rule_fp, round(CAST(rt AS DOUBLE) / greatest(ra, 1), 4) AS rule_precision, round(CAST(rt AS DOUBLE) / greatest(m, 1), 4) AS rule_recall, threshold, alerts, tp, alerts - tp AS fp, round(CAST(tp AS DOUBLE) / greatest(alerts, 1), 4) AS precision, round(CAST(tp AS DOUBLE) / greatest(m, 1), 4) AS recall FROM r, t, s""",
    "device_spans": with_(LEDGER) + "SELECT device, min(ts_s) AS first_s, max(ts_s) AS last_s, count(DISTINCT src) AS accounts FROM led WHERE device IS NOT NULL GROUP BY 1",
    "world_summary": with_(LEDGER, *BASE) + "SELECT (SELECT count(*) FROM acc) AS accounts, (SELECT count(*) FROM tr WHERE label = 1) AS mules, (SELECT round(avg(label), 5) FROM tr) AS mule_rate, count(*) AS transactions, count(*) FILTER (src % 11 = 0 AND paise % 5 = 0) AS fraud, round(avg(CAST(src % 11 = 0 AND paise % 5 = 0 AS INTEGER)), 5) AS fraud_rate FROM led",
    "overview_totals": with_(LEDGER, *BASE) + "SELECT (SELECT count(*) FROM acc) AS accounts, count(*) AS transactions, CAST(sum(paise) AS BIGINT) AS paise, (SELECT count(*) FROM rk WHERE risk >= 40) AS alerts, (SELECT round(avg(risk), 6) FROM rk) AS mean_risk, (SELECT max(account % 13) FROM acc) AS largest_ring FROM led",
    "action_summary": """WITH l AS (SELECT ['FREEZE_DEBIT', 'FULL_FREEZE', 'MONITOR', 'HOLD_CREDIT', 'REVERT'][event_id % 5 + 1] AS action, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
SELECT action, count(*) AS taken, count(*) FILTER (action IN ('FREEZE_DEBIT', 'FULL_FREEZE') AND t > 1706000000 - 3600) AS freezes_last_hour FROM l WHERE action <> 'REVERT' GROUP BY 1""",
    "case_totals": with_(CASES) + """SELECT count(*) AS cases, count(*) FILTER (status NOT IN ('CONFIRMED', 'FALSE_POSITIVE')) AS open, count(*) FILTER (status IN ('CONFIRMED', 'FALSE_POSITIVE')) AS resolved,
round(count(*) FILTER (status = 'CONFIRMED') / CAST(nullif(count(*) FILTER (status IN ('CONFIRMED', 'FALSE_POSITIVE')), 0) AS DOUBLE), 4) AS precision, round(median(risk), 6) AS median_risk FROM cs""",
    "case_changes": with_(CASES) + """, ch AS (SELECT user_id AS alert_id, event_id + 10000000 AS seq, CASE event_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'ASSIGNED' END AS to_status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'error')
SELECT ch.alert_id, ch.seq, coalesce(to_status, cs.status) AS status, 'officer' AS actor, 'seen' AS note, cs.status AS status_before FROM ch JOIN cs USING (alert_id) WHERE k = 1 AND (to_status IS NULL OR cs.status IN ('OPEN', 'ASSIGNED'))""",
    "audit_head": "SELECT arg_max(sha256(props), event_id) AS head, count(*) AS entries FROM events",
    "audit_tail": "SELECT event_id AS seq, sha256(props) AS entry_hash FROM events ORDER BY event_id DESC LIMIT 25",
    "redacted_frame": with_(LEDGER) + f"SELECT txn_id, {R.hmac_sql('CAST(src AS VARCHAR)')} AS src, CASE WHEN device IS NOT NULL THEN {R.hmac_sql('device')} END AS device, paise FROM led",
    "obfuscation": "WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[a-z]+'), lambda x: len(x) <= 36) AS w FROM documents) SELECT doc_id, CASE WHEN len(w) >= 50 THEN round(CAST(len(list_filter(w, lambda x: len(x) <= 2)) AS DOUBLE) / len(w), 4) ELSE 0 END AS ratio FROM w",
    "advisories": with_(DIRECTIVES) + "SELECT feed_id, kind, ts_s, CASE WHEN feed_id % 3 = 0 THEN '{\"text\":\"note ' || feed_id || '\"}' ELSE payload END AS payload FROM dir WHERE kind = 'ADVISORY'",
    "directive_ingest": with_(DIRECTIVES) + "SELECT feed_id, arrival, entities, payload FROM (SELECT feed_id % 300 AS feed_id, feed_id AS arrival, entities, '{\"cap\":' || ts_s || '}' AS payload, row_number() OVER (PARTITION BY feed_id % 300 ORDER BY feed_id DESC) AS k FROM dir) WHERE k = 1",
    "ledger_quarantine": with_(LEDGER) + ", x AS (SELECT txn_id, concat_ws(',', CASE WHEN src % 50 = 0 OR paise <= 0 THEN 'AMOUNT' END, CASE WHEN channel = 'CARD' THEN 'CHANNEL' END, CASE WHEN src % 40 = 0 THEN 'BENEFICIARY_AGE' END) AS reasons FROM led) SELECT * FROM x WHERE reasons <> ''",
    "column_names": f"WITH {GRAMMAR} SELECT * FROM names",
    "column_families": f"WITH {GRAMMAR} SELECT family, string_agg(name, ',' ORDER BY name) AS names FROM names WHERE NOT static GROUP BY 1",
    "dictionary_summary": f"WITH {GRAMMAR} SELECT 'aggregation' AS slot, aggregation AS value, count(*) AS n FROM names GROUP BY 2 UNION ALL SELECT 'channel', channel, count(*) FROM names WHERE channel IS NOT NULL GROUP BY 2",
    "flow_balance": with_(WIDE) + f""", v AS (SELECT event_id, {mean_sql('c0', 'c1')} AS ci, {mean_sql("CASE WHEN event_id % 5 <> 0 THEN event_id % 17 + 0.5::DOUBLE END")} AS bi, {mean_sql('c0', 'c1')} AS cr, {mean_sql('c4', 'c6', "CASE WHEN event_id % 5 <> 0 THEN event_id % 17 + 0.5::DOUBLE END")} AS db FROM wd)
SELECT event_id, {ratio_sql('ci', 'ci + bi', 'customer_induced_share')}, {ratio_sql('db', 'cr', 'credit_debit_ratio')}, {ratio_sql('cr - db', 'cr + db', 'net_flow_share')} FROM v""",
    "hygiene": "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN coalesce(value, 0) ELSE 0 END AS v FROM events",
    "top_reasons": with_(ACCOUNTS, REASON_TABLE) + "SELECT * FROM (SELECT account, CAST(row_number() OVER (PARTITION BY account ORDER BY contribution DESC, feature) AS INTEGER) AS place, feature, contribution, value FROM att WHERE abs(contribution) > 1e-9) WHERE place <= 6",
    "evidence": TOLD + "SELECT * FROM ev",
    "evidence_actions": TOLD + f""", cd AS (SELECT account, list(code) AS codes FROM ev GROUP BY 1), z AS (SELECT account, risk, coalesce(codes, []) AS codes FROM rk LEFT JOIN cd USING (account))
SELECT account, {R.BAND} AS band, CASE WHEN risk >= 85 THEN 'FULL_FREEZE,REPORT_STR' WHEN risk >= 65 THEN CASE WHEN list_contains(codes, 'NCRP_TICKET') THEN 'FREEZE_DEBIT,REPORT_STR' ELSE 'FREEZE_DEBIT' END WHEN risk >= 40 THEN CASE WHEN list_contains(codes, 'FAN_IN') THEN 'HOLD_CREDIT' ELSE 'STEP_UP_AUTH' END ELSE 'MONITOR' END AS actions FROM z""",
    "layer_contributions": with_(ACCOUNTS) + """, s AS (SELECT account, CASE WHEN account % 11 = 0 THEN 0.02 ELSE 0.0 END::DOUBLE AS e, vintage_days AS v FROM acc)
SELECT account, l.layer AS layer, round(((v * l.k % 97) / 100.0::DOUBLE + e) * l.w, 9) AS contribution FROM s, (SELECT unnest([{'layer': 'xgb', 'k': 3, 'w': 0.45::DOUBLE}, {'layer': 'graph', 'k': 4, 'w': 0.25::DOUBLE}, {'layer': 'temporal', 'k': 5, 'w': 0.2::DOUBLE}, {'layer': 'intel', 'k': 6, 'w': 0.1::DOUBLE}]) AS l)""",
    "neighbours": with_(*GRAPH) + "SELECT account, max(weight) AS weight FROM (SELECT dst AS account, weight FROM gr WHERE src = 8 UNION ALL SELECT src, weight FROM gr WHERE dst = 8) GROUP BY 1",
    "adjacency": with_(*GRAPH) + """, bw AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM gr UNION ALL SELECT dst, src, weight FROM gr) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM bw)
SELECT src AS account, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY k) AS neighbours FROM t WHERE k <= 400 GROUP BY 1""",
    "union_streams": """WITH u AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_type FROM events WHERE event_type IN ('error', 'signup', 'purchase')) SELECT event_type = 'error' AS ticket, event_type = 'signup' AS indicator, count(*) AS n, CAST(sum(ts_s) AS BIGINT) AS seconds FROM u GROUP BY 1, 2""",
}
