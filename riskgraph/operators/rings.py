"""Rings: communities of risky accounts in the induced subgraph, by modularity, with guards and a typology."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph import connected_components, settled

#: Guards: least flagged members, most members, least flagged share, least mean risk of the flagged.
MIN_FLAGGED, MAX_SIZE, MIN_SHARE, MIN_RISK = 3, 60, 0.35, 50.0


def moves(near: dict[int, dict[int, float]], degree: dict[int, float], resolution: float, total: float) -> dict[int, int]:
    """Greedy modularity moves, nodes in ascending order until none gains."""
    home, mass = {a: a for a in near}, dict(degree)
    for _ in range(50):
        moved = False
        for a in sorted(near):
            links: dict[int, float] = {}
            for b, w in near[a].items():
                links[home[b]] = links.get(home[b], 0.0) + w
            mass[home[a]] -= degree[a]
            gain = {c: w - resolution * degree[a] * mass[c] / total for c, w in sorted(links.items())}
            best = max([home[a], *gain], key=lambda c: (round(gain.get(c, -resolution * degree[a] * mass[c] / total), 12), c == home[a]))
            moved |= best != home[a]
            home[a] = best
            mass[best] += degree[a]
        if not moved:
            break
    return home


def communities(frame: pd.DataFrame, resolution: float, total: float | None = None) -> dict[int, int]:
    """Louvain: moves, then the same among the communities as nodes, until none join. Each is named by its least member.

    total is twice the weight of the whole graph, of which frame may be one component.
    """
    near: dict[int, dict[int, float]] = {}
    for s, d, w in frame[["src", "dst", "weight"]].itertuples(index=False):
        near.setdefault(s, {})[d] = near.setdefault(s, {}).get(d, 0.0) + w
        near.setdefault(d, {})[s] = near.setdefault(d, {}).get(s, 0.0) + w
    degree = {a: sum(n.values()) for a, n in near.items()}
    total = total or sum(degree.values())
    home = {a: a for a in near}
    while True:
        step, least = moves(near, degree, resolution, total), {}
        for a, c in step.items():
            least[c] = min(least.get(c, a), a)
        if len(least) == len(near):
            return home
        step = {a: least[c] for a, c in step.items()}
        home = {a: step[c] for a, c in home.items()}
        joined: dict[int, dict[int, float]] = {c: {} for c in least.values()}
        mass = dict.fromkeys(joined, 0.0)
        for a, links in near.items():
            mass[step[a]] += degree[a]
            for b, w in links.items():
                if step[a] != step[b]:
                    joined[step[a]][step[b]] = joined[step[a]].get(step[b], 0.0) + w
        near, degree = joined, mass


def shape(frame: pd.DataFrame) -> pd.DataFrame:
    """Links, greatest degree and whether all hang together, of the distinct links (src, dst) among a ring's flagged members."""
    near: dict[int, set[int]] = {}
    for a, b in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, todo = set(), [min(near)]
    while todo:
        a = todo.pop()
        if a not in seen:
            seen.add(a)
            todo += near[a] - seen
    return pd.DataFrame({"ring": [frame["ring"].iloc[0]], "links": [len(frame)], "most": [max(map(len, near.values()))], "reached": [len(seen)]})


def detect_rings(edges: DataFrame, risk: DataFrame, transfers: DataFrame | None = None, devices: DataFrame | None = None, threshold: float = 55.0, resolution: float = 4.0, seeds: int = 2000) -> DataFrame:
    """ring, members, associated, size, mean_risk, max_risk, density, paise, shared_devices, collectors, cashouts, typology.

    The subgraph is that of the riskiest accounts over the threshold, at most so many (a report's limit, as each component of
    it is worked on in one task), and their device neighbours. Modularity is that of the whole subgraph, so a component's
    communities depend on its share of it. Members are the flagged accounts of a community; the others are associated, and no
    number is over them. transfers (src, dst, paise) give the turnover among members, the three that take in most beyond
    what they send, and the three the other way; devices (account, device) those that several members use. Strongest first.
    """
    spark = edges.sparkSession
    transfers = spark.createDataFrame([], "src long, dst long, paise long") if transfers is None else transfers.select("src", "dst", "paise")
    devices = spark.createDataFrame([], "account long, device string") if devices is None else devices.select("account", "device").distinct()
    risky = settled(risk.where(F.col("risk") >= threshold).orderBy(F.col("risk").desc(), "account").limit(seeds).select("account"))
    device = edges.where("kind = 'DEVICE'").select("src", "dst").union(edges.where("kind = 'DEVICE'").select("dst", "src"))
    nodes = settled(risky.union(device.join(risky, F.col("src") == F.col("account"), "left_semi").select(F.col("dst").alias("account"))).distinct())
    inside = edges.join(nodes.select(F.col("account").alias("src")), "src", "left_semi").join(nodes.select(F.col("account").alias("dst")), "dst", "left_semi")
    inside = settled(inside.select("src", "dst", "weight", "kind"))
    parts = connected_components(nodes, inside)
    total = 2 * (inside.agg(F.sum("weight")).first()[0] or 0)

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        found = communities(frame, resolution, total)
        return pd.DataFrame({"account": list(found), "ring": list(found.values())}).astype("int64")

    home = inside.join(parts.select(F.col("account").alias("src"), "component"), "src").groupBy("component").applyInPandas(split, "account long, ring long")
    members = settled(home.join(risk, "account").join(risky.withColumn("flagged", F.lit(True)), "account", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False))))
    flagged = F.col("flagged")
    rings = members.groupBy("ring").agg(
        F.array_sort(F.collect_list(F.when(flagged, F.col("account")))).alias("members"), F.array_sort(F.collect_list(F.when(~flagged, F.col("account")))).alias("associated"),
        F.count_if(flagged).alias("size"), F.count("*").alias("n"), F.avg(F.when(flagged, F.col("risk"))).alias("mean_risk"), F.max(F.when(flagged, F.col("risk"))).alias("max_risk"),
    )
    rings = settled(rings.where((F.col("size") >= MIN_FLAGGED) & (F.col("n") <= MAX_SIZE) & (F.col("size") / F.col("n") >= MIN_SHARE) & (F.col("mean_risk") >= MIN_RISK)))
    own = settled(members.where(flagged).join(rings.select("ring"), "ring", "left_semi").select("ring", "account"))

    def side(name: str) -> DataFrame:
        return own.select(F.col("account").alias(name), F.col("ring").alias(f"ring_{name}"))

    both = F.col("ring_src") == F.col("ring_dst")
    among = inside.join(side("src"), "src").join(side("dst"), "dst").where(both).select(F.col("ring_src").alias("ring"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    shapes = among.groupBy("ring").applyInPandas(shape, "ring long, links long, most long, reached long")
    turnover = transfers.join(side("src"), "src").join(side("dst"), "dst").where(both).groupBy(F.col("ring_src").alias("ring")).agg(F.sum("paise").alias("paise"))
    used = devices.join(own, "account").groupBy("ring", "device").agg(F.count("*").alias("users")).where("users > 1")
    used = used.groupBy("ring").agg(F.slice(F.array_sort(F.collect_list("device")), 1, 10).alias("shared_devices"))
    flows = transfers.select(F.col("dst").alias("account"), F.col("paise").alias("taken"), F.lit(0).cast("long").alias("sent")).union(transfers.select("src", F.lit(0).cast("long"), "paise"))
    flows = own.join(flows.groupBy("account").agg(F.sum("taken").alias("taken"), F.sum("sent").alias("sent")), "account")
    net = F.col("taken") - F.col("sent")

    def three(moved: str, order: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col(moved) > 0, F.struct(order.alias("order"), "account"))))
        return F.transform(F.slice(listed, 1, 3), lambda x: x["account"])

    money = flows.groupBy("ring").agg(three("taken", -net).alias("collectors"), three("sent", net).alias("cashouts"), (F.max("sent") / F.greatest(F.sum("sent"), F.lit(100))).alias("largest_share"))
    out = rings.join(shapes, "ring", "left").join(turnover, "ring", "left").join(used, "ring", "left").join(money, "ring", "left")
    links, size = F.coalesce("links", F.lit(0)), F.col("size")
    density = 2 * links / (size * (size - 1))
    most = F.coalesce("most", F.lit(0))
    kind = F.when(F.size("shared_devices") > 0, "DEVICE_FARM").when((most >= 0.6 * (size - 1)) & (size > 4), "FAN_IN_AGGREGATION")
    kind = kind.when((density < 0.35) & (F.coalesce("reached", F.lit(0)) == size) & (most <= 3), "LAYERING_CHAIN").when(F.coalesce("largest_share", F.lit(0.0)) > 0.5, "RAPID_CASHOUT").otherwise("MULE_CLUSTER")

    def joined(name: str) -> Column:
        return F.coalesce(F.array_join(F.col(name).cast("array<string>"), ","), F.lit("")).alias(name)

    return out.select(
        "ring", joined("members"), joined("associated"), "size", "mean_risk", "max_risk", density.alias("density"), F.coalesce("paise", F.lit(0)).alias("paise"), joined("shared_devices"), joined("collectors"), joined("cashouts"), kind.alias("typology"),
    ).orderBy(F.desc(F.col("mean_risk") * size), "ring")


def ring_of(rings: DataFrame) -> DataFrame:
    """account, ring: each flagged member with its ring."""
    return rings.select("ring", F.explode(F.split("members", ",")).alias("account")).select(F.col("account").cast("long").alias("account"), "ring")
