"""Queries and oracles of the account graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import graph as G
from riskgraph.plans.prelude import ACCOUNTS, LEDGER, with_
from riskgraph.sources import ledger as S

#: Steps of the SQL of the two PageRanks; the queries go on until the ranks settle, or to 40.
STEPS = 40


def tables(spark, sf):
    return S.read_ledger(spark, sf), S.read_accounts(spark, sf)


def transfers_of(spark, sf):
    return G.money(*tables(spark, sf))


def money_edges(spark, sf):
    return G.money_edges(transfers_of(spark, sf))


def device_edges(spark, sf):
    return G.shared_identifier_edges(*tables(spark, sf), "device", 6.0)


def address_edges(spark, sf):
    return G.shared_identifier_edges(*tables(spark, sf), "ip", 1.5)


def graph_edges(spark, sf):
    return G.graph_edges(*tables(spark, sf))


def degrees(spark, sf):
    return G.degrees(*tables(spark, sf))


def device_components(spark, sf):
    ledger, accounts = tables(spark, sf)
    return G.connected_components(accounts, G.shared_identifier_edges(ledger, accounts, "ip", 1.5).union(G.shared_identifier_edges(ledger, accounts, "device", 6.0)))


def ranked(ranks):
    return ranks.withColumn("pagerank", F.round("pagerank", 9))


def pagerank(spark, sf):
    return ranked(G.pagerank(S.read_accounts(spark, sf), G.flow_edges(transfers_of(spark, sf))))


def reverse_pagerank(spark, sf):
    edges = G.flow_edges(transfers_of(spark, sf))
    return ranked(G.pagerank(S.read_accounts(spark, sf), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))


def clustering(spark, sf):
    return G.clustering(S.read_accounts(spark, sf), transfers_of(spark, sf))


def two_hop(spark, sf):
    return G.two_hop(S.read_accounts(spark, sf), transfers_of(spark, sf))


def neighbour_risk(spark, sf):
    accounts = S.read_accounts(spark, sf)
    return G.neighbour_risk(accounts, transfers_of(spark, sf), accounts.select("account", (F.col("vintage_days") % 100).cast("double").alias("risk")))


def fanout_propagation(spark, sf):
    accounts = S.read_accounts(spark, sf)
    out = G.propagate(G.top_neighbours(graph_edges(spark, sf), 15), accounts.select("account", F.col("vintage_days").cast("double").alias("vintage"), F.col("age").cast("double").alias("age")), ["vintage", "age"])
    return out.select("account", *(F.round(c, 6).alias(c) for c in ("vintage", "age")))


def flow_paths(spark, sf):
    return G.flow_paths(transfers_of(spark, sf), S.read_accounts(spark, sf))


def ego_network(spark, sf):
    return G.ego_network(graph_edges(spark, sf), F.lit(8).cast("long"))


QUERIES = {f.__name__: f for f in (money_edges, device_edges, address_edges, graph_edges, degrees, device_components, pagerank, reverse_pagerank, clustering, two_hop, neighbour_risk, fanout_propagation, flow_paths, ego_network)}

MONEY = """mon AS (SELECT src, dst, paise, ts_s, txn_id FROM led WHERE dst <> -1 AND src <> dst AND src IN (SELECT account FROM acc) AND dst IN (SELECT account FROM acc)),
edge AS (SELECT src, dst, count(*) AS n, CAST(sum(paise) AS BIGINT) AS paise, round(ln(1 + sum(paise) / 100.0::DOUBLE) * (1 + ln(1 + count(*))), 3) AS weight FROM mon GROUP BY 1, 2)"""
LINKS = "lnk AS (SELECT src, dst FROM mon UNION SELECT dst, src FROM mon)"


def shared(column: str, weight: float) -> str:
    return f"""{column}_use AS (SELECT DISTINCT src AS account, {column} AS ident FROM led WHERE {column} IS NOT NULL AND src IN (SELECT account FROM acc)),
{column}_few AS (SELECT ident FROM {column}_use GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25),
{column}_edge AS (SELECT a.account AS src, b.account AS dst, count(*) AS shared, {weight}::DOUBLE AS weight FROM {column}_use a JOIN {column}_use b USING (ident) WHERE a.account <> b.account AND ident IN (FROM {column}_few) GROUP BY 1, 2)"""


EDGES = """part AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, weight, 'MONEY' AS kind FROM edge UNION ALL SELECT src, dst, weight, 'DEVICE' FROM device_edge WHERE src < dst UNION ALL SELECT src, dst, weight, 'IP' FROM ip_edge WHERE src < dst),
gr AS (SELECT src, dst, round(sum(weight), 6) AS weight, arg_max(kind, (weight, kind)) AS kind FROM part GROUP BY 1, 2)"""
GRAPH = (LEDGER, ACCOUNTS, MONEY, shared("device", 6.0), shared("ip", 1.5), EDGES)


def ranks(src: str, dst: str) -> str:
    """Power iteration step by step, each written once; a transfer's weight is log1p of its rupees."""
    head = with_(LEDGER, ACCOUNTS, MONEY) + f""", fe AS (SELECT {src} AS src, {dst} AS dst, sum(ln(1 + paise / 100.0::DOUBLE)) AS weight FROM mon GROUP BY 1, 2), sh AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS part FROM fe),
nd AS MATERIALIZED (SELECT account, account IN (SELECT src FROM sh) AS pays, count(*) OVER () AS n FROM acc), r0 AS MATERIALIZED (SELECT account, pays, n, 1.0::DOUBLE / n AS rank FROM nd)"""
    for i in range(STEPS):
        head += f""", r{i + 1} AS MATERIALIZED (SELECT r.account, r.pays, r.n, 0.15::DOUBLE / r.n + 0.85::DOUBLE * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank) FILTER (NOT pays), 0) FROM r{i}) / r.n) AS rank
  FROM r{i} r LEFT JOIN (SELECT dst, sum(part * rank) AS flow FROM sh JOIN r{i} ON src = account GROUP BY 1) f ON f.dst = r.account)"""
    return head + f" SELECT account, round(rank, 9) AS pagerank FROM r{STEPS}"


def trails_sql(hops: int = 4, seconds: int = 172800, most: int = 25) -> str:
    """The trails hop by hop: of each the three largest ways on, which end it where there are none and are dropped where they lead back."""
    out = with_(LEDGER, ACCOUNTS, MONEY) + """, p1 AS MATERIALIZED (SELECT src AS start, [src, dst] AS accounts, [paise] AS amounts, [ts_s] AS times, [txn_id] AS txns FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY paise DESC, ts_s, txn_id) AS k FROM mon) WHERE k <= 3)"""
    for n in range(2, hops + 1):
        out += f""", o{n} AS MATERIALIZED (SELECT a.*, b.dst, b.paise, b.ts_s, b.txn_id, row_number() OVER (PARTITION BY a.start, a.txns ORDER BY b.paise DESC, b.ts_s, b.txn_id) AS k FROM p{n - 1} a LEFT JOIN mon b ON a.accounts[-1] = b.src AND b.ts_s > a.times[-1] AND b.ts_s <= a.times[-1] + {seconds}),
p{n} AS MATERIALIZED (SELECT start, list_append(accounts, dst) AS accounts, list_append(amounts, paise) AS amounts, list_append(times, ts_s) AS times, list_append(txns, txn_id) AS txns FROM o{n} WHERE dst IS NOT NULL AND k <= 3 AND NOT list_contains(accounts, dst))"""
    ended = " UNION ALL ".join([f"SELECT start, accounts, amounts, times, txns FROM o{n} WHERE dst IS NULL" for n in range(2, hops + 1)] + [f"SELECT start, accounts, amounts, times, txns FROM p{hops}"])
    return out + f""", u AS ({ended}), v AS (SELECT start, array_to_string(accounts, '>') AS accounts, array_to_string(txns, '>') AS txns, len(amounts) AS hops, amounts[1] AS paise, amounts[-1] AS last_paise, CAST(amounts[-1] AS DOUBLE) / greatest(amounts[1], 100) AS retention, times[-1] - times[1] AS seconds,
  CASE WHEN len(times) > 1 THEN list_median(list_transform(range(2, len(times) + 1), lambda i: times[i] - times[i - 1])) ELSE 0 END AS median_gap FROM u)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY paise DESC, txns) AS k FROM v) WHERE k <= {most}"""


ORACLES = {
    "money_edges": with_(LEDGER, ACCOUNTS, MONEY) + "SELECT * FROM edge",
    "device_edges": with_(LEDGER, ACCOUNTS, shared("device", 6.0)) + "SELECT * FROM device_edge",
    "address_edges": with_(LEDGER, ACCOUNTS, shared("ip", 1.5)) + "SELECT * FROM ip_edge",
    "graph_edges": with_(*GRAPH) + "SELECT * FROM gr",
    "degrees": with_(LEDGER, ACCOUNTS, MONEY, shared("device", 1.0)) + """, i AS (SELECT dst AS account, count(*) AS n, sum(paise) AS p FROM mon GROUP BY 1), o AS (SELECT src AS account, count(*) AS n, sum(paise) AS p FROM mon GROUP BY 1), d AS (SELECT src AS account, count(*) AS n FROM device_edge GROUP BY 1)
SELECT acc.account, coalesce(i.n, 0) AS degree_money_in, coalesce(o.n, 0) AS degree_money_out, coalesce(d.n, 0) AS degree_device, CAST(coalesce(o.p, 0) - coalesce(i.p, 0) AS DOUBLE) / greatest(CAST(coalesce(o.p, 0) + coalesce(i.p, 0) AS DOUBLE), 1) AS imbalance
FROM acc LEFT JOIN i USING (account) LEFT JOIN o USING (account) LEFT JOIN d USING (account)""",
    "device_components": with_(LEDGER, ACCOUNTS, shared("device", 6.0), shared("ip", 1.5)) + """, lk AS (SELECT src, dst FROM device_edge UNION SELECT src, dst FROM ip_edge), reach AS (SELECT account AS node, account AS root FROM acc UNION SELECT lk.dst, r.root FROM reach r JOIN lk ON lk.src = r.node WHERE r.root < lk.dst),
c AS (SELECT node AS account, min(root) AS component FROM reach GROUP BY 1) SELECT account, component, count(*) OVER (PARTITION BY component) AS component_size FROM c""",
    "pagerank": ranks("src", "dst"),
    "reverse_pagerank": ranks("dst", "src"),
    "clustering": with_(LEDGER, ACCOUNTS, MONEY, LINKS) + """, k AS (SELECT src AS account, count(*) AS k FROM lnk GROUP BY 1), t AS (SELECT a.src AS account, count(*) // 2 AS t FROM lnk a JOIN lnk b ON a.dst = b.src JOIN lnk c ON b.dst = c.src AND c.dst = a.src WHERE a.src <> b.dst GROUP BY 1)
SELECT acc.account, coalesce(k, 0) AS neighbours, CAST(coalesce(t, 0) AS BIGINT) AS triangles, CASE WHEN k > 1 THEN coalesce(t, 0) / greatest(CAST(k * (k - 1) AS DOUBLE) / 2, 1) ELSE 0 END AS clustering FROM acc LEFT JOIN k USING (account) LEFT JOIN t USING (account)""",
    "two_hop": with_(LEDGER, ACCOUNTS, MONEY, LINKS) + ", h AS (SELECT a.src AS account, count(DISTINCT b.dst) AS two_hop FROM lnk a JOIN lnk b ON a.dst = b.src GROUP BY 1) SELECT acc.account, coalesce(two_hop, 0) AS two_hop FROM acc LEFT JOIN h USING (account)",
    "neighbour_risk": with_(LEDGER, ACCOUNTS, MONEY, LINKS) + ", h AS (SELECT src AS account, avg(CAST(vintage_days % 100 AS DOUBLE)) AS r FROM lnk JOIN acc ON dst = acc.account GROUP BY 1) SELECT acc.account, coalesce(r, 0) AS neighbour_risk FROM acc LEFT JOIN h USING (account)",
    "fanout_propagation": with_(*GRAPH) + """, bw AS (SELECT src, dst, weight FROM gr UNION ALL SELECT dst, src, weight FROM gr), tp AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM bw), pt AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS part FROM tp WHERE k <= 15)
SELECT src AS account, round(sum(part * vintage_days), 6) AS vintage, round(sum(part * age), 6) AS age FROM pt JOIN acc ON dst = account GROUP BY 1""",
    "flow_paths": trails_sql(),
    "ego_network": with_(*GRAPH) + """, bw AS (SELECT src, dst, weight FROM gr UNION ALL SELECT dst, src, weight FROM gr), n1 AS (SELECT dst AS account, max(weight) AS w FROM bw WHERE src = 8 AND dst <> 8 GROUP BY 1 ORDER BY w DESC, account LIMIT 250),
n2 AS (SELECT dst AS account, max(weight) AS w FROM bw WHERE src IN (SELECT account FROM n1) AND dst <> 8 AND dst NOT IN (SELECT account FROM n1) GROUP BY 1 ORDER BY w DESC, account LIMIT 250), s AS (SELECT 8 AS account, 0 AS hop UNION ALL SELECT account, 1 FROM n1 UNION ALL SELECT account, 2 FROM n2)
SELECT src, dst, weight, a.hop AS src_hop, b.hop AS dst_hop FROM gr JOIN s a ON a.account = src JOIN s b ON b.account = dst""",
}
