"""The account graph: edges, centrality, motifs, components, paths and propagation, all as joins and aggregates."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph import config as C


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("riskgraph.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    return f"{folder}/riskgraph-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so that iterations don't stack their plans."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def money(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers between two different known accounts, src, dst, paise, ts_s, txn_id; cash and self-transfers are out."""
    known = accounts.select("account")
    rows = ledger.where((F.col("dst") != C.CASH_SINK) & (F.col("src") != F.col("dst"))).select("src", "dst", "paise", "ts_s", "txn_id")
    return rows.join(known, F.col("src") == F.col("account"), "left_semi").join(known, F.col("dst") == F.col("account"), "left_semi")


def money_edges(transfers: DataFrame) -> DataFrame:
    """One directed edge a pair: transfers, paise, weight log1p(rupees) * (1 + log1p(transfers))."""
    edges = transfers.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("paise").alias("paise"))
    return edges.withColumn("weight", F.round(F.log1p(F.col("paise") / 100) * (1 + F.log1p("n")), 3))


def flow_edges(transfers: DataFrame) -> DataFrame:
    """One directed edge a pair for centrality: the sum of each transfer's log1p(rupees)."""
    return transfers.groupBy("src", "dst").agg(F.sum(F.log1p(F.col("paise") / 100)).alias("weight"))


def shared_identifier_edges(ledger: DataFrame, accounts: DataFrame, column: str, weight: float, most: int = C.MAX_SHARED) -> DataFrame:
    """Ordered pairs of accounts on one device or address, of 2 to most accounts; larger groups are hubs and make no edge.

    The cap comes before the self-join, so no identifier makes more than most squared pairs.
    """
    uses = ledger.where(F.col(column).isNotNull()).select(F.col("src").alias("account"), F.col(column).alias("ident")).join(accounts.select("account"), "account", "left_semi").distinct()
    few = uses.groupBy("ident").agg(F.count("*").alias("k")).where(F.col("k").between(2, most))
    uses = uses.join(few.select("ident"), "ident", "left_semi")
    pairs = uses.alias("a").join(uses.alias("b"), "ident").where("a.account <> b.account").groupBy(F.col("a.account").alias("src"), F.col("b.account").alias("dst")).agg(F.count("*").alias("shared"))
    return pairs.withColumn("weight", F.lit(weight))


def graph_edges(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """One undirected edge a pair (src < dst): the sum of the weights, and the kind of the heaviest part."""
    def part(edges: DataFrame, kind: str) -> DataFrame:
        return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", F.lit(kind).alias("kind"))

    parts = part(money_edges(money(ledger, accounts)), "MONEY")
    for column, kind in (("device", "DEVICE"), ("ip", "IP")):
        parts = parts.unionByName(part(shared_identifier_edges(ledger, accounts, column, C.EDGE_WEIGHTS[kind]).where("src < dst"), kind))
    return parts.groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("weight"), F.max_by("kind", F.struct("weight", "kind")).alias("kind"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge from both ends; only columns src and dst are kept."""
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()


def degrees(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers in and out, their amounts' imbalance, neighbours by device; for every account."""
    transfers = money(ledger, accounts)
    legs = transfers.select(F.col("src").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("pi"), F.col("paise").alias("po"))
    legs = legs.unionAll(transfers.select("dst", F.lit(1), F.lit(0), F.col("paise"), F.lit(0).cast("long")))
    sums = legs.groupBy("account").agg(F.sum("i").alias("money_in"), F.sum("o").alias("money_out"), F.sum("pi").alias("pi"), F.sum("po").alias("po"))
    device = shared_identifier_edges(ledger, accounts, "device", 1.0).groupBy(F.col("src").alias("account")).agg(F.count("*").alias("device"))
    zero = F.lit(0)
    return accounts.select("account").join(sums, "account", "left").join(device, "account", "left").select(
        "account", F.coalesce("money_in", zero).alias("degree_money_in"), F.coalesce("money_out", zero).alias("degree_money_out"), F.coalesce("device", zero).alias("degree_device"),
        ((F.coalesce("po", zero) - F.coalesce("pi", zero)) / F.greatest(F.coalesce(F.col("po") + F.col("pi"), zero), F.lit(1))).alias("imbalance"),
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """account, component (least account reachable), component_size. Label propagation with pointer jumping."""
    links = settled(both_ways(edges))
    labels = nodes.select("account", F.col("account").alias("label"))
    while True:
        near = links.join(labels, F.col("dst") == F.col("account")).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("account") == F.col("src"), "left").select("account", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("account").alias("at"), F.col("label").alias("beyond"))
        after = settled(step.join(jump, F.col("label") == F.col("at"), "left").select("account", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        labels = after.select("account", "label")
        if not after.where("was <> label").limit(1).count():
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("component_size"))
    return labels.join(sizes, "label").select("account", F.col("label").alias("component"), "component_size")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 40, damping: float = C.DAMPING, tolerance: float = 1e-10, settle_every: int = 5) -> DataFrame:
    """account, pagerank over directed weighted edges (src, dst, weight); dangling mass is spread evenly.

    Stops when the ranks change by less than the tolerance altogether. Edges with their shares are written once; a step is
    one join and one combinable sum.
    """
    n = nodes.count()
    total = Window.partitionBy("src")
    shares = settled(edges.select("src", "dst", (F.col("weight") / F.sum("weight").over(total)).alias("part")))
    ranks = nodes.select("account", F.lit(1.0 / max(n, 1)).alias("rank"))
    sources = shares.select(F.col("src").alias("account")).distinct()
    for step in range(iterations):
        dangling = ranks.join(sources, "account", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        flow = shares.join(ranks, F.col("src") == F.col("account")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("part") * F.col("rank")).alias("flow"))
        base = (1 - damping) / max(n, 1)
        after = ranks.join(flow, F.col("account") == F.col("to"), "left").crossJoin(F.broadcast(dangling))
        after = after.select("account", F.col("rank").alias("was"), (F.lit(base) + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / max(n, 1))).alias("rank"))
        if (step + 1) % settle_every == 0:
            after = settled(after)
            if (after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0) < tolerance:
                ranks = after.select("account", "rank")
                break
        ranks = after.select("account", "rank")
    return ranks.select("account", F.col("rank").alias("pagerank"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """account, neighbours, triangles and local clustering of the simple undirected graph.

    Triangles are found once, from the end of least degree, so hubs don't make wedges with the square of their degree.
    """
    links = settled(both_ways(edges))
    degree = links.groupBy(F.col("src").alias("account")).agg(F.count("*").alias("k"))
    ranked = links.join(degree.select(F.col("account").alias("src"), F.col("k").alias("ks")), "src").join(degree.select(F.col("account").alias("dst"), F.col("k").alias("kd")), "dst")
    up = settled(ranked.where("ks < kd or ks = kd and src < dst").select("src", "dst"))
    wedges = up.alias("x").join(up.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    closed = wedges.join(links, (F.col("b") == F.col("src")) & (F.col("c") == F.col("dst")), "left_semi")
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("account")).groupBy("account").agg(F.count("*").alias("triangles"))
    out = nodes.select("account").join(degree, "account", "left").join(corners, "account", "left").na.fill(0)
    wedge_count = F.col("k") * (F.col("k") - 1) / 2
    return out.select("account", F.col("k").alias("neighbours"), "triangles", F.when(F.col("k") > 1, F.col("triangles") / F.greatest(wedge_count, F.lit(1.0))).otherwise(0.0).alias("clustering"))


def two_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """account, two_hop: distinct accounts two steps away, itself included if it has a neighbour."""
    from riskgraph.operators import reach

    return reach.two_hop(nodes, edges)


def neighbour_risk(nodes: DataFrame, edges: DataFrame, risk: DataFrame) -> DataFrame:
    """account, neighbour_risk: mean risk (account, risk) of the distinct neighbours, 0 without any."""
    links = both_ways(edges).join(risk.select(F.col("account").alias("dst"), "risk"), "dst")
    return nodes.select("account").join(links.groupBy(F.col("src").alias("account")).agg(F.avg("risk").alias("neighbour_risk")), "account", "left").na.fill(0.0)


def top_neighbours(edges: DataFrame, fanout: int) -> DataFrame:
    """src, dst, part: of each account's edges the heaviest, their weights made to sum to 1. Ties go to the lesser account."""
    links = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    heaviest = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    kept = links.withColumn("place", F.row_number().over(heaviest)).where(F.col("place") <= fanout)
    return kept.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("part"))


def propagate(neighbours: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Weighted neighbour means of the columns of values, one aggregation layer; accounts without neighbours get none."""
    joined = neighbours.join(values.select(F.col("account").alias("dst"), *columns), "dst")
    return joined.groupBy(F.col("src").alias("account")).agg(*(F.sum(F.col("part") * F.col(c)).alias(c) for c in columns))


def flow_paths(transfers: DataFrame, starts: DataFrame, hops: int = C.FLOW_HOPS, seconds: int = C.FLOW_SECONDS, fan_out: int = C.FLOW_FAN_OUT, most: int | None = C.FLOW_PATHS, backward: bool = False) -> DataFrame:
    """Money trails from the accounts of starts: each hop later than the one before by at most the seconds, of all such hops
    the fan_out largest, of these none to an account that the trail has. One row a trail that has so many hops or goes no
    further; one whose only ways on lead back is left out. Of a start the most trails with the largest first amount (a report's
    length; None: all). backward: where the money came from, each hop earlier than the one before.

    start, accounts, txns, hops, paise (first), last_paise, retention (last over first), seconds (first to last hop) and
    median_gap (median seconds between hops, 0 of one hop).
    """
    ends, sign = (("dst", "src"), -1) if backward else (("src", "dst"), 1)
    step = transfers.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"), "paise", (F.col("ts_s") * sign).alias("ts_s"), "txn_id")

    def largest(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("paise").desc(), "ts_s", "txn_id")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fan_out).drop("place")

    paths = largest(step.join(starts.select(F.col("account").alias("src")), "src", "left_semi"), ["src"]).where("src <> dst")
    paths = paths.select(F.col("src").alias("start"), F.array("src", "dst").alias("accounts"), F.array("paise").alias("amounts"), F.array("ts_s").alias("times"), F.array("txn_id").alias("txns"))
    ended = []
    for _ in range(2, hops + 1):
        last, at = F.element_at("accounts", -1), F.element_at("times", -1)
        onward = paths.join(step, (last == F.col("src")) & (F.col("ts_s") > at) & (F.col("ts_s") <= at + seconds), "left")
        ended.append(onward.where("src is null").select(*paths.columns))
        longer = largest(onward.where("src is not null"), ["start", "txns"]).where(~F.array_contains("accounts", F.col("dst")))
        paths = longer.select("start", F.array_append("accounts", F.col("dst")).alias("accounts"), F.array_append("amounts", F.col("paise")).alias("amounts"), F.array_append("times", F.col("ts_s")).alias("times"), F.array_append("txns", F.col("txn_id")).alias("txns"))
    found = reduce(DataFrame.union, ended, paths)
    times, amounts = F.col("times"), F.col("amounts")
    gaps = F.array_sort(F.zip_with(F.slice(times, 2, F.size(times) - 1), F.slice(times, 1, F.size(times) - 1), lambda b, a: b - a))
    middle = (F.get(gaps, F.floor((F.size(gaps) - 1) / 2).cast("int")) + F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))) / 2
    out = found.select(
        "start", F.array_join("accounts", ">").alias("accounts"), F.array_join("txns", ">").alias("txns"), F.size("amounts").cast("long").alias("hops"), F.element_at(amounts, 1).alias("paise"), F.element_at(amounts, -1).alias("last_paise"),
        (F.element_at(amounts, -1) / F.greatest(F.element_at(amounts, 1), F.lit(100))).alias("retention"), (F.element_at(times, -1) - F.element_at(times, 1)).alias("seconds"), F.when(F.size(times) > 1, middle).otherwise(0.0).alias("median_gap"),
    )
    if most is None:
        return out
    order = Window.partitionBy("start").orderBy(F.col("paise").desc(), "txns")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def neighbours(edges: DataFrame, account: Column) -> DataFrame:
    """account, weight: the neighbours of one account in any direction, the heaviest edge of each."""
    return both_weighted(edges).where(F.col("src") == account).groupBy(F.col("dst").alias("account")).agg(F.max("weight").alias("weight"))


def both_weighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


def adjacency(edges: DataFrame, most: int = 400) -> DataFrame:
    """account, edges (array of dst and weight, heaviest first): each account's edges in one row, for display; most of them at most."""
    links = both_weighted(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    heaviest = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    kept = links.withColumn("place", F.row_number().over(heaviest)).where(F.col("place") <= most)
    listed = F.array_sort(F.collect_list(F.struct("place", "dst", "weight")))
    return kept.groupBy(F.col("src").alias("account")).agg(listed.alias("edges")).select("account", F.transform("edges", lambda x: F.struct(x["dst"].alias("dst"), x["weight"].alias("weight"))).alias("edges"))


def ego_network(edges: DataFrame, centre: Column, hops: int = 2, cap: int = 250) -> DataFrame:
    """Edges among the accounts within so many hops of the centre, strongest neighbours first where there are over cap."""
    links = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    seen = edges.sparkSession.range(1).select(centre.alias("account"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        near = links.join(front, F.col("src") == F.col("account")).groupBy(F.col("dst").alias("account")).agg(F.max("weight").alias("w"))
        near = near.join(seen, "account", "left_anti").orderBy(F.col("w").desc(), "account").limit(cap)
        front = near.select("account", F.lit(hop).alias("hop"))
        seen = seen.union(front)
    inside = settled(seen)
    return edges.join(inside.select(F.col("account").alias("src"), F.col("hop").alias("src_hop")), "src").join(inside.select(F.col("account").alias("dst"), F.col("hop").alias("dst_hop")), "dst").select("src", "dst", "weight", "src_hop", "dst_hop")
