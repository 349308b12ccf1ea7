"""The same tables as riskgraph.sources.ledger, as common table expressions of the oracle's SQL dialect."""

from __future__ import annotations

LEDGER = """led AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS txn_id,
    1767225600 + date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 3600 + (l_orderkey * 7919 + l_partkey * 613 + l_linenumber * 3571) % 3600 AS ts_s,
    o_custkey AS src, CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN -1 ELSE l_suppkey END AS dst,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS paise,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN CASE WHEN l_linestatus = 'F' THEN 'ATM' ELSE 'AEPS' END
      ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RTGS' WHEN '2' THEN 'IMPS' WHEN '3' THEN 'UPI' WHEN '4' THEN 'NEFT' ELSE 'CARD' END END AS channel,
    CASE WHEN l_linenumber IN (1, 7) THEN NULL ELSE 'D' || (o_custkey // 2) END AS device,
    CASE WHEN l_linenumber IN (1, 7) THEN NULL WHEN o_custkey % 7 = 0 THEN 'IPX' ELSE 'IP' || (o_custkey // 20) END AS ip,
    CASE WHEN l_linenumber = 7 THEN 9999 ELSE l_partkey % 240 END AS ben_age
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ACCOUNTS = """acc AS (
  SELECT c_custkey AS account, CASE c_mktsegment WHEN 'BUILDING' THEN 'MIN' WHEN 'MACHINERY' THEN 'VIDEO' ELSE 'FULL' END AS kyc,
    CAST(floor(abs(c_acctbal) / 5) AS BIGINT) AS vintage_days, CAST(18 + c_nationkey * 2 AS BIGINT) AS age, c_mktsegment = 'HOUSEHOLD' AS merchant FROM customer)"""

EVENTS = """ev AS (
  SELECT src AS account, dst AS other, -1 AS dir, ts_s, paise, channel, ben_age, txn_id FROM led WHERE src IN (SELECT account FROM acc)
  UNION ALL SELECT dst, src, 1, ts_s, paise, channel, ben_age, txn_id FROM led WHERE dst IN (SELECT account FROM acc))"""

TICKETS = """tik AS (
  SELECT event_id % 500 AS ticket_id, event_id AS arrival, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_id % 97 AS victim, user_id AS beneficiary, CAST(round(value * 100) AS BIGINT) AS paise,
    CASE WHEN event_id % 4 = 0 THEN 'DISPUTED_TXN' WHEN event_id % 4 = 1 THEN 'UPI_FRAUD' ELSE 'OTP_FRAUD' END AS category FROM events WHERE event_type = 'error')"""

INDICATORS = """ioc AS (
  SELECT event_id AS ioc_id, CASE WHEN event_id % 2 = 0 THEN 'ACCOUNT' ELSE 'VPA' END AS kind, CAST(user_id AS VARCHAR) AS value, CAST(event_id % 100 AS DOUBLE) / 100.0 AS confidence, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s
  FROM events WHERE event_type = 'signup')"""

DIRECTIVES = """dir AS (
  SELECT event_id AS feed_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, ['SANCTION', 'VELOCITY_LIMIT', 'ADVISORY', 'LISTED'][event_id % 4 + 1] AS kind, user_id || ',' || (user_id + 1) AS entities, props AS payload
  FROM events WHERE event_type = 'purchase')"""

SCORES = """sc AS (SELECT doc_id AS id, CAST(quality AS INTEGER) AS label, CAST(n_chars % 1000 AS DOUBLE) / 1000.0 AS score FROM labels JOIN documents USING (doc_id))"""


def with_(*tables: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(tables) + "\n"
