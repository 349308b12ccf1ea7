"""Queries and oracles of the behavioural features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import features as O
from riskgraph.plans.prelude import ACCOUNTS, EVENTS, LEDGER, with_
from riskgraph.sources import ledger as S

BASE = with_(LEDGER, ACCOUNTS, EVENTS)
#: A second in the ledger's middle, for point-in-time queries.
AS_OF = 1_770_000_000


def events_of(spark, sf):
    return O.event_view(S.read_ledger(spark, sf), S.read_accounts(spark, sf))


def over_events(part):
    return lambda spark, sf: O.for_all(S.read_accounts(spark, sf), part(events_of(spark, sf)))


def ledger_scan(spark, sf):
    return S.read_ledger(spark, sf)


def event_view(spark, sf):
    return events_of(spark, sf)


def asof_channel_totals(spark, sf):
    return O.as_of(S.read_ledger(spark, sf), AS_OF).groupBy("channel").agg(F.count("*").alias("n"), F.sum("paise").alias("paise"), F.max("ts_s").alias("last"))


def timing(spark, sf):
    ledger, accounts = S.read_ledger(spark, sf), S.read_accounts(spark, sf)
    first, last = ledger.agg(F.min("ts_s"), F.max("ts_s")).first()
    return O.for_all(accounts, O.timing(O.event_view(ledger, accounts), first, last), recency_days=999.0)


def device_stats(spark, sf):
    ledger, accounts = S.read_ledger(spark, sf), S.read_accounts(spark, sf)
    return O.for_all(accounts, O.device_stats(ledger, accounts)).join(O.for_all(accounts, O.device_stats(ledger, accounts, "ip")), "account")


def behaviour_matrix(spark, sf):
    return O.behaviour(S.read_ledger(spark, sf), S.read_accounts(spark, sf)).select("account", "in_count", "out_count", "in_paise", "out_paise", "passthrough", "rapid_passthrough", "payers", "payees", "burst_max_30min", "active_days", "structuring_frac", "n_devices")


def in_flight_features(spark, sf):
    events = events_of(spark, sf)
    profile = O.flow_totals(events).join(O.counterparties(events), "account")
    return O.in_flight(S.read_ledger(spark, sf), profile)


def event_sequence(spark, sf):
    return O.event_sequence(events_of(spark, sf))


QUERIES = {
    "ledger_scan": ledger_scan, "event_view": event_view, "asof_channel_totals": asof_channel_totals, "flow_totals": over_events(O.flow_totals), "amount_spread": over_events(O.amount_spread),
    "rapid_passthrough": over_events(O.rapid_passthrough), "debit_delays": over_events(O.debit_delays), "counterparties": over_events(O.counterparties), "reciprocity": over_events(O.reciprocity),
    "bursts": over_events(O.bursts), "timing": timing, "structuring": over_events(O.structuring), "channel_mix": over_events(O.channel_mix), "device_stats": device_stats,
    "behaviour_matrix": behaviour_matrix, "in_flight_features": in_flight_features, "event_sequence": event_sequence,
}

FLOW = """flow AS (SELECT account, count(*) FILTER (dir = 1) AS in_count, count(*) FILTER (dir = -1) AS out_count,
  CAST(coalesce(sum(paise) FILTER (dir = 1), 0) AS BIGINT) AS in_paise, CAST(coalesce(sum(paise) FILTER (dir = -1), 0) AS BIGINT) AS out_paise,
  coalesce(max(paise) FILTER (dir = 1), 0) AS max_in, coalesce(max(paise) FILTER (dir = -1), 0) AS max_out,
  CAST(coalesce(sum(paise) FILTER (dir = -1 AND channel IN ('ATM', 'AEPS')), 0) AS BIGINT) AS cash_paise FROM ev GROUP BY 1)"""
PARTIES = """pairs AS (SELECT account, dir, other, CAST(sum(paise) AS BIGINT) AS pair, count(*) AS n FROM ev GROUP BY 1, 2, 3),
parties AS (SELECT account, count(*) FILTER (dir = 1) AS payers, count(*) FILTER (dir = -1 AND other <> -1) AS payees, coalesce(max(pair) FILTER (dir = 1), 0) AS top_in, coalesce(max(pair) FILTER (dir = -1 AND other <> -1), 0) AS top_out,
  CAST(coalesce(sum(pair) FILTER (dir = 1), 0) AS BIGINT) AS i, CAST(coalesce(sum(pair) FILTER (dir = -1), 0) AS BIGINT) AS o, CAST(coalesce(sum(n) FILTER (dir = 1), 0) AS BIGINT) AS ni, CAST(coalesce(sum(n) FILTER (dir = -1), 0) AS BIGINT) AS no FROM pairs GROUP BY 1)"""
RAPID = """spent AS (SELECT account, dir, paise, coalesce(sum(CASE WHEN dir = -1 THEN paise END) OVER (PARTITION BY account ORDER BY ts_s RANGE BETWEEN 1 FOLLOWING AND 3600 FOLLOWING), 0) AS spent FROM ev),
rapid AS (SELECT account, CAST(coalesce(sum(least(spent, paise)) FILTER (dir = 1), 0) AS BIGINT) AS rapid_paise, CAST(coalesce(sum(paise) FILTER (dir = 1), 0) AS BIGINT) AS in_paise FROM spent GROUP BY 1)"""
BURSTS = """b AS (SELECT account, count(*) OVER (w RANGE BETWEEN CURRENT ROW AND 1800 FOLLOWING) AS n, sum(paise) OVER (w RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS s FROM ev WINDOW w AS (PARTITION BY account ORDER BY ts_s)),
bursts AS (SELECT account, max(n) AS burst_max_30min, CAST(max(s) AS BIGINT) AS max_paise_1h FROM b GROUP BY 1)"""
STRUCTURE = """st AS (SELECT account, count(*) FILTER (dir = -1) AS o, count(*) FILTER (dir = 1) AS i, count(*) FILTER (dir = -1 AND paise >= 4500000 AND paise < 5000000) AS b, count(*) FILTER (dir = -1 AND paise % 100000 = 0) AS r,
  count(*) FILTER (dir = -1 AND paise > 2000000 AND paise < 10000000) AS s, count(*) FILTER (dir = -1 AND coalesce(ben_age, 9999) < 24) AS fo, count(*) FILTER (dir = 1 AND coalesce(ben_age, 9999) < 24) AS fi FROM ev GROUP BY 1)"""
DAYS = """gaps AS (SELECT account, ts_s, ts_s - lag(ts_s) OVER (PARTITION BY account ORDER BY ts_s, txn_id, dir) AS gap, (ts_s // 3600) % 24 AS hour, (ts_s // 86400 + 4) % 7 IN (5, 6) AS weekend FROM ev),
days AS (SELECT account, count(*) AS n, count(DISTINCT ts_s // 86400) AS active_days, coalesce(max(gap), 0) AS gap, count(*) FILTER (hour BETWEEN 0 AND 5) AS night, count(*) FILTER (weekend) AS weekend, min(ts_s) AS first, max(ts_s) AS last FROM gaps GROUP BY 1),
hk AS (SELECT account, hour, count(*) AS k FROM gaps GROUP BY 1, 2), hp AS (SELECT account, CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY account) AS p FROM hk),
he AS (SELECT account, round(-sum(p * ln(p)), 6) AS hour_entropy FROM hp GROUP BY 1),
span AS (SELECT min(ts_s) AS t0, max(ts_s) AS t1 FROM led),
timing AS (SELECT days.*, he.hour_entropy, (first - t0) / 86400.0::DOUBLE AS silence, greatest((last - first) / 86400.0::DOUBLE, 1e-9) AS active, CAST(n AS DOUBLE) / greatest(active_days, 1) AS per_day, (t1 - last) / 86400.0::DOUBLE AS recency FROM days JOIN he USING (account), span)"""


def devices(column: str) -> str:
    return f"""{column}_u AS (SELECT src AS account, {column}, count(*) AS k FROM led WHERE {column} IS NOT NULL AND src IN (SELECT account FROM acc) GROUP BY 1, 2),
{column}_o AS (SELECT {column}, count(*) AS on_it FROM {column}_u GROUP BY 1),
{column}_p AS (SELECT account, on_it, CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY account) AS p FROM {column}_u JOIN {column}_o USING ({column})),
{column}_s AS (SELECT account, count(*) AS n_{column}s, max(on_it) AS {column}_max_accounts, round(abs(sum(p * ln(p))), 6) AS {column}_entropy FROM {column}_p GROUP BY 1)"""


ALL = "SELECT acc.account, {} FROM acc LEFT JOIN {} USING (account)"
ORACLES = {
    "ledger_scan": with_(LEDGER) + "SELECT * FROM led",
    "event_view": BASE + "SELECT * FROM ev",
    "asof_channel_totals": with_(LEDGER) + f"SELECT channel, count(*) AS n, CAST(sum(paise) AS BIGINT) AS paise, max(ts_s) AS last FROM led WHERE ts_s <= {AS_OF} GROUP BY 1",
    "flow_totals": with_(LEDGER, ACCOUNTS, EVENTS, FLOW) + """SELECT acc.account, coalesce(in_count, 0) AS in_count, coalesce(out_count, 0) AS out_count, coalesce(in_paise, 0) AS in_paise, coalesce(out_paise, 0) AS out_paise, coalesce(max_in, 0) AS max_in,
  coalesce(max_out, 0) AS max_out, coalesce(cash_paise, 0) AS cash_paise, coalesce(CAST(in_paise AS DOUBLE) / greatest(in_count, 1), 0) AS avg_in, coalesce(CAST(out_paise AS DOUBLE) / greatest(out_count, 1), 0) AS avg_out,
  coalesce(CAST(out_paise AS DOUBLE) / greatest(in_paise, 1), 0) AS passthrough, coalesce(greatest(-5.0, least(1.0, 1 - CAST(out_paise AS DOUBLE) / greatest(in_paise, 1))), 0) AS retention, coalesce(CAST(cash_paise AS DOUBLE) / greatest(in_paise, 1), 0) AS cashout
FROM acc LEFT JOIN flow USING (account)""",
    "amount_spread": BASE + """, m AS (SELECT account, median(CAST(paise AS DOUBLE)) FILTER (dir = 1) AS md, avg(paise / 100.0::DOUBLE) FILTER (dir = 1) AS mi, avg(paise / 100.0::DOUBLE * (paise / 100.0::DOUBLE)) FILTER (dir = 1) AS qi,
  avg(paise / 100.0::DOUBLE) FILTER (dir = -1) AS mo, avg(paise / 100.0::DOUBLE * (paise / 100.0::DOUBLE)) FILTER (dir = -1) AS qo FROM ev GROUP BY 1)
SELECT acc.account, coalesce(md, 0) AS median_in, coalesce(round(sqrt(greatest(qi - mi * mi, 0)) / greatest(mi, 1), 4), 0) AS cv_in, coalesce(round(sqrt(greatest(qo - mo * mo, 0)) / greatest(mo, 1), 4), 0) AS cv_out FROM acc LEFT JOIN m USING (account)""",
    "rapid_passthrough": with_(LEDGER, ACCOUNTS, EVENTS, RAPID) + ALL.format("coalesce(rapid_paise, 0) AS rapid_paise, coalesce(CAST(rapid_paise AS DOUBLE) / greatest(in_paise, 1), 0) AS rapid_passthrough", "rapid"),
    "debit_delays": BASE + """, d AS (SELECT account, CASE WHEN dir = 1 THEN (min(CASE WHEN dir = -1 THEN ts_s END) OVER (PARTITION BY account ORDER BY ts_s RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - ts_s) / 60.0::DOUBLE END AS delay FROM ev),
s AS (SELECT account, round(coalesce(least(min(delay), 10000.0), 0), 6) AS min_delay, round(coalesce(least(median(delay), 10000.0), 0), 6) AS median_delay, count(delay) AS followed_credits FROM d GROUP BY 1) """ + ALL.format("coalesce(min_delay, 0) AS min_delay, coalesce(median_delay, 0) AS median_delay, coalesce(followed_credits, 0) AS followed_credits", "s"),
    "counterparties": with_(LEDGER, ACCOUNTS, EVENTS, PARTIES) + ALL.format("""coalesce(payers, 0) AS payers, coalesce(payees, 0) AS payees, coalesce(CAST(top_in AS DOUBLE) / greatest(i, 1), 0) AS payer_concentration, coalesce(CAST(top_out AS DOUBLE) / greatest(o, 1), 0) AS payee_concentration,
  coalesce(CAST(payers AS DOUBLE) / greatest(ni, 1), 0) AS fan_in, coalesce(CAST(payees AS DOUBLE) / greatest(no, 1), 0) AS fan_out, coalesce(CAST(payers AS DOUBLE) / greatest(payees, 1), 0) AS degree_ratio""", "parties"),
    "reciprocity": BASE + """, r AS (SELECT a.account, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM ev b WHERE b.dir = 1 AND b.account = a.account AND b.other = a.other)) AS DOUBLE) / count(*) AS reciprocity FROM ev a WHERE a.dir = -1 GROUP BY 1) """ + ALL.format("coalesce(reciprocity, 0) AS reciprocity", "r"),
    "bursts": with_(LEDGER, ACCOUNTS, EVENTS, BURSTS) + ALL.format("coalesce(burst_max_30min, 0) AS burst_max_30min, coalesce(max_paise_1h, 0) AS max_paise_1h", "bursts"),
    "timing": with_(LEDGER, ACCOUNTS, EVENTS, DAYS) + ALL.format("""coalesce(active_days, 0) AS active_days, coalesce(per_day, 0) AS events_per_day, coalesce(gap / 86400.0::DOUBLE, 0) AS max_gap_days, coalesce(CAST(night AS DOUBLE) / n, 0) AS night_frac, coalesce(CAST(weekend AS DOUBLE) / n, 0) AS weekend_frac,
  coalesce(hour_entropy, 0) AS hour_entropy, coalesce(silence, 0) AS silence_days, coalesce(recency, 999) AS recency_days, coalesce(round(silence / greatest(active + silence, 1.0) * least(per_day / 5, 3.0), 9), 0) AS dormancy""", "timing"),
    "structuring": with_(LEDGER, ACCOUNTS, EVENTS, STRUCTURE) + ALL.format(", ".join(f"coalesce(CAST({a} AS DOUBLE) / greatest({b}, 1), 0) AS {n}" for n, (a, b) in {"structuring_frac": ("b", "o"), "round_frac": ("r", "o"), "sub_threshold_frac": ("s", "o"), "new_beneficiary_frac": ("fo", "o"), "first_time_payer_frac": ("fi", "i")}.items()), "st"),
    "channel_mix": BASE + ", c AS (SELECT account, " + ", ".join(f"CAST(count(*) FILTER (channel IN {v}) AS DOUBLE) / count(*) AS frac_{k}" for k, v in {"upi": "('UPI')", "imps": "('IMPS')", "neft_rtgs": "('NEFT', 'RTGS')", "atm_aeps": "('ATM', 'AEPS')", "card": "('CARD', 'WALLET')"}.items()) + " FROM ev GROUP BY 1) " + ALL.format(", ".join(f"coalesce(frac_{k}, 0) AS frac_{k}" for k in ("upi", "imps", "neft_rtgs", "atm_aeps", "card")), "c"),
    "device_stats": with_(LEDGER, ACCOUNTS, devices("device"), devices("ip")) + "SELECT acc.account, " + ", ".join(f"coalesce({c}, 0) AS {c}" for d in ("device", "ip") for c in (f"n_{d}s", f"{d}_max_accounts", f"{d}_entropy")) + " FROM acc LEFT JOIN device_s USING (account) LEFT JOIN ip_s USING (account)",
    "behaviour_matrix": with_(LEDGER, ACCOUNTS, EVENTS, FLOW, PARTIES, RAPID, BURSTS, STRUCTURE, DAYS, devices("device")) + """SELECT acc.account, coalesce(in_count, 0) AS in_count, coalesce(out_count, 0) AS out_count, coalesce(flow.in_paise, 0) AS in_paise, coalesce(out_paise, 0) AS out_paise, coalesce(CAST(out_paise AS DOUBLE) / greatest(flow.in_paise, 1), 0) AS passthrough,
  coalesce(CAST(rapid_paise AS DOUBLE) / greatest(rapid.in_paise, 1), 0) AS rapid_passthrough, coalesce(payers, 0) AS payers, coalesce(payees, 0) AS payees, coalesce(burst_max_30min, 0) AS burst_max_30min, coalesce(active_days, 0) AS active_days, coalesce(CAST(b AS DOUBLE) / greatest(st.o, 1), 0) AS structuring_frac, coalesce(n_devices, 0) AS n_devices
FROM acc LEFT JOIN flow USING (account) LEFT JOIN rapid USING (account) LEFT JOIN parties USING (account) LEFT JOIN bursts USING (account) LEFT JOIN timing USING (account) LEFT JOIN st USING (account) LEFT JOIN device_s USING (account)""",
    "in_flight_features": with_(LEDGER, ACCOUNTS, EVENTS, FLOW, PARTIES) + ", pr AS (SELECT account, CAST(in_paise AS DOUBLE) / greatest(in_count, 1) AS avg_in, CAST(out_paise AS DOUBLE) / greatest(out_count, 1) AS avg_out, CAST(out_paise AS DOUBLE) / greatest(in_paise, 1) AS passthrough, payers FROM flow JOIN parties USING (account)) " + """
SELECT txn_id, paise, round(ln(1 + paise / 100.0::DOUBLE), 6) AS log_amount, (ts_s // 3600) % 24 AS hour, (ts_s // 3600) % 24 BETWEEN 0 AND 5 AS night, coalesce(ben_age, 9999) < 24 AS fresh, channel IN ('ATM', 'AEPS') AS cash, dst = -1 AS to_pool,
  coalesce(s.avg_in, 0) AS src_avg_in, coalesce(s.avg_out, 0) AS src_avg_out, coalesce(s.passthrough, 0) AS src_passthrough, coalesce(s.payers, 0) AS src_payers, coalesce(d.avg_in, 0) AS dst_avg_in, coalesce(d.avg_out, 0) AS dst_avg_out, coalesce(d.passthrough, 0) AS dst_passthrough, coalesce(d.payers, 0) AS dst_payers,
  paise / greatest(coalesce(s.avg_out, 0), 1) AS vs_src, paise / greatest(coalesce(d.avg_in, 0), 1) AS vs_dst FROM led LEFT JOIN pr s ON s.account = src LEFT JOIN pr d ON d.account = dst""",
    "event_sequence": BASE + """, r AS (SELECT account, txn_id, dir, ts_s, paise, coalesce(ts_s - lag(ts_s) OVER (PARTITION BY account ORDER BY ts_s, txn_id, dir), 0) AS gap, row_number() OVER (PARTITION BY account, other ORDER BY ts_s, txn_id, dir) = 1 AS novel,
  round(greatest(-6.0, least(6.0, ln(1 + paise / 100.0::DOUBLE) - ln(1 + greatest(avg(paise) OVER (PARTITION BY account) / 100, 1.0)))), 6) AS vs_mean, row_number() OVER (PARTITION BY account ORDER BY ts_s DESC, txn_id DESC, dir DESC) AS k FROM ev)
SELECT account, txn_id, dir, ts_s, paise, gap, novel, vs_mean, CAST(64 - k AS INTEGER) AS slot FROM r WHERE k <= 64""",
}
