"""Ranking and calibration metrics over (id, label, score), from sums by distinct score.

Running sums over all scores would put all rows into one task, so rows are first summed by score, and the scores, unrounded,
are ordered in ranges: sums run inside each range, and what the ranges above it hold is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.operators.graph import settled


def by_score(scores: DataFrame) -> DataFrame:
    """score, n, pos and the running tp and fp from the highest score down; p and q: totals."""
    sums = scores.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, as a second run of the same plan may cut the ranges elsewhere
    sums = settled(sums.repartitionByRange(parts, F.col("score").desc()).withColumn("part", F.spark_partition_id()))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    held = sums.groupBy("part").agg(F.sum("pos").alias("hits"), F.sum(F.col("n") - F.col("pos")).alias("misses"))
    held = held.select("part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("hits", "misses")), F.sum("hits").over(every).alias("p"), F.sum("misses").over(every).alias("q"))
    down = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, fp = F.sum("pos").over(down), F.sum(F.col("n") - F.col("pos")).over(down)
    rows = sums.withColumn("tp", tp).withColumn("fp", fp).join(F.broadcast(held), "part")
    return rows.select("score", "n", "pos", (F.col("tp") + F.col("hits_above")).alias("tp"), (F.col("fp") + F.col("misses_above")).alias("fp"), "p", "q")


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve, a tie counting half."""
    rows = by_score(scores)
    won = F.sum(F.col("pos") * (F.col("q") - F.col("fp") + (F.col("n") - F.col("pos")) / 2))
    return rows.agg(F.round(won / F.greatest(F.max(F.col("p") * F.col("q")), F.lit(1)), 9).alias("roc_auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    rows = by_score(scores)
    return rows.agg(F.round(F.sum(F.col("pos") / F.greatest("p", F.lit(1)) * F.col("tp") / (F.col("tp") + F.col("fp"))), 9).alias("average_precision"))


def precision_at(scores: DataFrame, budgets: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05)) -> DataFrame:
    """budget, k, precision, recall of the k = max(1, round(budget * n)) highest scores, ties by id."""
    n = scores.count()
    sizes = {b: max(1, int(b * n + 0.5)) for b in budgets}
    top = scores.orderBy(F.col("score").desc(), "id").limit(max(sizes.values()))
    place = top.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
    p = scores.agg(F.greatest(F.sum("label"), F.lit(1)).alias("p"))
    cells = F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), F.lit(k).alias("k")) for b, k in sizes.items())))
    rows = place.select("*", cells.alias("c")).where("place <= c.k").groupBy("c.budget", "c.k").agg(F.sum("label").alias("hits"))
    return rows.join(F.broadcast(p)).select("budget", "k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / F.col("p")).alias("recall"))


def at_recall(scores: DataFrame, target: float) -> DataFrame:
    """threshold, precision, recall, alerts at the highest score from which recall reaches the target."""
    rows = by_score(scores).where(F.col("tp") / F.greatest("p", F.lit(1)) >= target)
    best = rows.agg(F.max_by(F.struct("score", "tp", "fp", "p"), "score").alias("b")).select("b.*")
    return best.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.greatest("p", F.lit(1))).alias("recall"), (F.col("tp") + F.col("fp")).alias("alerts"))


def best_f1(scores: DataFrame) -> DataFrame:
    """threshold and f1 of the best F1, the highest threshold of equals."""
    rows = by_score(scores).withColumn("f1", F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")), 9))
    return rows.agg(F.max(F.struct("f1", "score")).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def confusion(scores: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    cells = F.explode(F.array(*map(F.lit, thresholds)))
    rows = scores.select("label", "score", cells.alias("threshold"))
    hit, pos = F.col("score") >= F.col("threshold"), F.col("label") == 1
    return rows.groupBy("threshold").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


def calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, observed: equal-width bins."""
    rows = scores.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.avg("label"), 9).alias("observed"))


def calibration_error(scores: DataFrame, bins: int = 10) -> DataFrame:
    """brier and ece."""
    rows = scores.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("label").alias("o"), F.sum((F.col("score") - F.col("label")) ** 2).alias("b"))
    return rows.agg(F.round(F.sum("b") / F.sum("n"), 9).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("s") - F.col("o"))) / F.sum("n"), 9).alias("ece"))
